"""Literature records from two services, merged by DOI; ranking; upsert that keeps download columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

OPENALEX = "struct<id:string,doi:string,title:string,display_name:string,publication_year:int,authorships:array<struct<raw_author_name:string,author:struct<display_name:string>>>,primary_location:struct<source:struct<display_name:string,publisher:string>,pdf_url:string>,open_access:struct<oa_status:string,oa_url:string>,abstract_inverted_index:map<string,array<int>>>"
CROSSREF = "struct<DOI:string,URL:string,title:array<string>,`container-title`:array<string>,publisher:string,abstract:string,author:array<struct<given:string,family:string>>,link:array<struct<`content-type`:string,URL:string>>,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>>"


def candidate_id(doi: Column, title: Column, year: Column) -> Column:
    key = F.coalesce(doi, F.concat(F.lower(title), F.lit("::"), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit(""))))
    return F.concat(F.lit("lit_"), F.substring(F.sha1(key), 1, 16))


def abstract_of(index: Column) -> Column:
    """Text from an inverted index (word -> places): words in order of place; the later word of the map wins a place."""
    flat = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), i.alias("i"), e["key"].alias("w")))))
    by_place = F.array_sort(flat)
    after = F.concat(F.slice(by_place, 2, F.greatest(F.size(by_place), F.lit(1))), F.array(F.lit(None).cast("struct<p:int,i:int,w:string>")))
    last = F.zip_with(by_place, after, lambda x, y: F.when(y.isNull() | (x["p"] != y["p"]), x["w"]))
    return T.nonempty(F.array_join(F.filter(last, lambda w: w.isNotNull()), " "))


def from_openalex(raw: DataFrame) -> DataFrame:
    """raw: query, json (one work). Works without a title are left out; unreadable JSON too."""
    r = raw.select("query", F.from_json("json", OPENALEX).alias("j"))
    title, doi = T.html_clean(F.coalesce("j.title", "j.display_name")), T.resolver_doi(F.col("j.doi"))
    authors = F.array_join(F.filter(F.transform(F.slice(F.coalesce("j.authorships", F.array().cast("array<struct<raw_author_name:string,author:struct<display_name:string>>>")), 1, 12), lambda a: F.coalesce(a["raw_author_name"], a["author"]["display_name"])), lambda x: x.isNotNull()), ", ")
    abstract = abstract_of(F.col("j.abstract_inverted_index"))
    return r.select(
        candidate_id(doi, title, F.col("j.publication_year")).alias("candidate_id"), doi.alias("doi"), title.alias("title"), T.nonempty(authors).alias("authors"), T.html_clean(F.col("j.primary_location.source.display_name")).alias("journal"), T.html_clean(F.col("j.primary_location.source.publisher")).alias("publisher"),
        F.col("j.publication_year").alias("year"), abstract.alias("abstract"), F.lit("openalex").alias("source"), F.col("j.open_access.oa_status").alias("oa_status"), F.col("j.primary_location.pdf_url").alias("pdf_url"), "query", T.domain_score(title, abstract).alias("match_score"),
    ).where("title is not null")


def from_crossref(raw: DataFrame) -> DataFrame:
    r = raw.select("query", F.from_json("json", CROSSREF).alias("j"))
    title, doi = T.html_clean(F.get("j.title", F.lit(0))), T.resolver_doi(F.col("j.DOI"))
    names = F.transform(F.slice(F.coalesce("j.author", F.array().cast("array<struct<given:string,family:string>>")), 1, 12), lambda a: F.concat_ws(" ", F.nullif(F.trim(a["given"]), F.lit("")), F.nullif(F.trim(a["family"]), F.lit(""))))
    year = F.get(F.get(F.coalesce("j.published-print.date-parts", "j.published-online.date-parts"), F.lit(0)), F.lit(0))
    pdf = F.get(F.filter("j.link", lambda x: x["content-type"] == "application/pdf"), F.lit(0))["URL"]
    abstract = T.html_clean(F.col("j.abstract"))
    return r.select(
        candidate_id(doi, title, year).alias("candidate_id"), doi.alias("doi"), title.alias("title"), T.nonempty(F.array_join(names, ", ")).alias("authors"), T.html_clean(F.get("j.container-title", F.lit(0))).alias("journal"), T.html_clean(F.col("j.publisher")).alias("publisher"),
        year.alias("year"), abstract.alias("abstract"), F.lit("crossref").alias("source"), F.lit(None).cast("string").alias("oa_status"), pdf.alias("pdf_url"), "query", T.domain_score(title, abstract).alias("match_score"),
    ).where("title is not null")


def merged(first: DataFrame, second: DataFrame, least: float = 0.0) -> DataFrame:
    """One record per DOI (else identifier): the first service's record wins over the second's; within a service the later row by title and query."""
    both = first.withColumn("__p", F.lit(1)).unionByName(second.withColumn("__p", F.lit(0))).where(F.col("match_score") >= least)
    key = F.coalesce("doi", "candidate_id")
    rank = F.struct("__p", F.col("title"), F.col("query"), F.col("candidate_id"))
    return both.groupBy(key.alias("__k")).agg(F.max_by(F.struct(*first.columns), rank).alias("r")).select("r.*")


def ranked(c: DataFrame) -> DataFrame:
    return c.orderBy(F.desc(F.coalesce("year", F.lit(0))), F.desc("match_score"), F.desc(F.lower("title")), "candidate_id")


class Fetcher:
    """Services are reached through a callable (url -> text); none is built in, so nothing here opens a connection."""

    def __init__(self, get):
        self.get = get

    def openalex(self, query: str, start: str, end: str, rows: int) -> list[str]:
        import json
        import urllib.parse

        url = "https://api.openalex.org/works?" + urllib.parse.urlencode({"search": query, "filter": f"from_publication_date:{start},to_publication_date:{end}", "per-page": rows, "sort": "publication_date:desc"})
        return [json.dumps(x) for x in json.loads(self.get(url)).get("results", [])]

    def crossref(self, query: str, start: str, end: str, rows: int) -> list[str]:
        import json
        import urllib.parse

        url = "https://api.crossref.org/works?" + urllib.parse.urlencode({"query.bibliographic": query, "filter": f"from-pub-date:{start},until-pub-date:{end},type:journal-article", "rows": rows, "sort": "published", "order": "desc"})
        return [json.dumps(x) for x in json.loads(self.get(url)).get("message", {}).get("items", [])]


def titles_by_doi(dois: DataFrame, lookup) -> DataFrame:
    """doi, doi_title: titles by an injected lookup (doi -> title or null), once for each distinct DOI; a lookup that fails gives null."""

    def run(batches):
        for b in batches:
            out = []
            for doi in b["doi"]:
                try:
                    out.append(lookup(doi))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.DataFrame({"doi": b["doi"].to_numpy(), "doi_title": out})

    return dois.select("doi").where("doi is not null").distinct().mapInPandas(run, "doi string, doi_title string")


def first_with_hash(new: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """Downloaded files (sha256) marked: `duplicate` if the hash is known or an earlier one of the run has it.

    The first of each hash comes by partial aggregation, so that a content with any number of copies gathers in no task; files without a hash take no part and are no duplicates.
    `order` must tell the files of one hash apart."""
    have = new.where("sha256 is not null")
    first = have.groupBy("sha256").agg(F.min(F.struct(*order)).alias("__first"))
    k = known.select("sha256").where("sha256 is not null").distinct().withColumn("__k", F.lit(True))
    marks = first.join(k, "sha256", "left")
    out = have.join(marks, "sha256").withColumn("duplicate", F.coalesce("__k", F.lit(False)) | (F.struct(*order) != F.col("__first"))).select(*new.columns, "duplicate")
    return out.unionByName(new.where("sha256 is null").withColumn("duplicate", F.lit(False)))
