"""Files, pages and papers: duplicates by content, page quality, first metadata, upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V
from corpusmill.session import spread

from .chunks import table_chunk
from .numbering import numbered

LOW_TEXT = 80


def scan_files(spark, root: str, pattern: str = "*.[pP][dD][fF]") -> DataFrame:
    """A folder's files with content hash and size, below any depth; only hashes leave the scan, contents are not kept."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return raw.select(F.col("path").alias("file_path"), F.element_at(F.split("path", "/"), -1).alias("file_name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("file_size"), F.substring("content", 1, 5).cast("string").alias("magic"))


def with_identity(files: DataFrame) -> DataFrame:
    """Equal contents in path order: the first keeps the plain identifier, later ones carry their number and point to the first.

    Files without a hash are never duplicates and get null identifiers. A content may have any number of copies: they are numbered by range partitions."""
    have = files.where("sha256 is not null")
    n = numbered(have, ["sha256"], ["file_path"], "__n")
    first = F.concat(F.lit("pdf_"), F.substring("sha256", 1, 16))
    again = F.concat(F.lit("pdf_"), F.substring("sha256", 1, 12), F.lit("_"), F.col("__n").cast("string"))
    n = n.unionByName(files.where("sha256 is null").withColumn("__n", F.lit(0).cast("long")))
    return n.select(*files.columns, F.when(F.col("__n") == 0, first).otherwise(again).alias("new_pdf_id"), F.concat(F.lit("paper_"), F.substring("sha256", 1, 16)).alias("new_paper_id"), (F.col("__n") > 0).alias("is_dup"), F.when(F.col("__n") > 0, first).alias("dup_of"))


def first_of(files: DataFrame, key: str, order: str) -> DataFrame:
    """key, first: smallest order value per key, by partial aggregation; safe for keys of any frequency."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))


def page_quality(pages: DataFrame) -> DataFrame:
    """Per file: pages with text (80 characters or more), blank and low ones, the share with text, and whether it needs recognition."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    g = pages.groupBy("pdf_id").agg(F.count(F.lit(1)).alias("n_pages"), F.count_if(n >= LOW_TEXT).alias("text_pages"), F.count_if(n == 0).alias("blank_pages"), F.count_if((n > 0) & (n < LOW_TEXT)).alias("low_text_pages"))
    return g.withColumn("quality", F.bround(F.col("text_pages") / F.greatest("n_pages", F.lit(1)), 3)).withColumn("needs_ocr", F.col("quality") < 0.5)


def first_metadata(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Per file with pages: first DOI and year of its first two pages, a title, and its type; a year in the file's name comes first."""
    two = pages.where("page_number <= 2").groupBy("pdf_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n").alias("head"))  # two pages a file
    j = two.join(files.select("pdf_id", "file_name"), "pdf_id")
    title = T.page_title(F.col("head"), T.file_title(F.col("file_name")))
    j = j.withColumn("title", title)
    return j.select("pdf_id", T.first_doi(F.col("head")).alias("doi"), F.coalesce(T.file_year(F.col("file_name")), T.first_year(F.col("head"))).alias("year"), "title", T.paper_type(F.col("title"), F.col("file_name")).alias("paper_type"))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], overwrite: list[str], keep_old_if_null: list[str] = ()) -> DataFrame:
    """Base with updates: on a key match `overwrite` columns take the new value and `keep_old_if_null` ones the new value unless null; others stay; rows with new keys are added.

    Keys of the updates must be unique (else the match would multiply rows); columns that updates lack come out null for new rows. Null keys never match and are added."""
    u = updates.select(*[F.col(c).alias(f"__u_{c}") for c in updates.columns], F.lit(True).alias("__u"))
    b = base.withColumn("__b", F.lit(True))
    on = [F.col(k) == F.col(f"__u_{k}") for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    j = b.join(u, cond, "full")
    out = []
    for c in base.columns:
        new = F.col(f"__u_{c}") if c in updates.columns else F.lit(None)
        if c in overwrite:
            v = F.when(F.col("__u") & F.col("__b"), new).when(F.col("__b"), F.col(c)).otherwise(new)
        elif c in keep_old_if_null:
            v = F.coalesce(new, F.col(c))
        else:
            v = F.when(F.col("__b"), F.col(c)).otherwise(new)
        out.append(v.cast(base.schema[c].dataType).alias(c))
    return j.select(*out)


def evolve(df: DataFrame, schema, defaults: dict[str, object]) -> DataFrame:
    """The frame under a newer schema: missing columns take their default or null, types are cast, further columns are dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])


def write_snapshot(df: DataFrame, path: str, name: str) -> str:
    """Write a new snapshot below the path and return it: a table that is being read is never overwritten."""
    out = f"{path.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(out)
    return out


def layout_titles(spans: DataFrame, gap: float = 48.0, least: float = 12.0, region: float = 0.72) -> DataFrame:
    """page_id, title, y, size, score: of each page the group of large lines that scores best as a title (its score plus its mean type size; ties to the upper group).

    spans: page_id, y, x, size, text, and height of the page if only its upper `region` may hold a title. Large is what comes near the page's largest type: within 1.2 points of a type of
    16 or more, within 2.5 of a smaller one, and `least` anyway; lines that can't be a title don't set the largest type. A group ends at a smaller line and at a
    gap. A page's spans are few, so windows run by page. Blank spans take no part; a page without large type has no title."""
    s = spans.where(F.trim("text") != "")
    if "height" in spans.columns:
        s = s.where(F.col("y") < F.col("height") * region)
    page, order = Window.partitionBy("page_id"), Window.partitionBy("page_id").orderBy("y", "x", "text")
    top = F.max(F.when(~F.col("text").rlike(V.BAD_TITLE), F.col("size"))).over(page)
    s = s.withColumn("__max", top).withColumn("__big", F.coalesce(F.col("size") >= F.greatest(F.lit(least), F.col("__max") - F.when(F.col("__max") >= 16, 1.2).otherwise(2.5)), F.lit(False)))
    new = F.col("__big") & (~F.coalesce(F.lag("__big").over(order), F.lit(False)) | (F.col("y") - F.lag("y").over(order) > gap))
    s = s.withColumn("__new", new.cast("int")).withColumn("__g", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("__big")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda r: T.strip(r["text"])), " ")
    g = s.groupBy("page_id", "__g").agg(T.clean_title(text).alias("title"), F.min("y").alias("y"), F.avg("size").alias("size"))
    g = g.withColumn("score", T.title_score(F.col("title")) + F.col("size"))
    return g.groupBy("page_id").agg(F.max_by(F.struct("title", "y", "size", "score"), F.struct("score", -F.col("__g"))).alias("r")).select("page_id", "r.*")


def table_rows(tables: DataFrame, order: list[str]) -> DataFrame:
    """Tables (pdf_id, page_number, cells, further columns) with table_index from 1 in their page by the order given, table_id, row and column counts and text.

    Cells are tidied and blank rows dropped; a table without any row is left out. A page may hold any number of tables: they are numbered by range partitions."""
    t = table_chunk(tables.withColumn("table_index", F.lit(0)), keep=[c for c in tables.columns if c not in ("pdf_id", "page_number", "cells")]).where("row_count > 0").drop("table_index")
    n = numbered(t, ["pdf_id", "page_number"], order, "table_index").withColumn("table_index", (F.col("table_index") + 1).cast("int"))
    return n.withColumn("table_id", F.format_string("%s_table_p%04d_%03d", "pdf_id", "page_number", "table_index"))


def replace_partitions(df: DataFrame, path: str, by: str = "pdf_id") -> None:
    """Write the rows in place of all earlier ones of the same values of `by`; other partitions of the table stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def with_parse_result(manifest: DataFrame, quality: DataFrame) -> DataFrame:
    """The manifest with what parsing gave (`page_quality`): counts, quality, and the status parsed, or parse_error with a message where no page has text; files without pages stay as they are."""
    j = manifest.join(quality.select("pdf_id", "n_pages", "text_pages", "blank_pages", "quality"), "pdf_id", "left")
    seen, ok = F.col("n_pages").isNotNull(), F.col("text_pages") > 0
    new = {
        "page_count": F.coalesce("n_pages", "page_count"), "text_page_count": F.coalesce("text_pages", "text_page_count"), "blank_page_count": F.coalesce("blank_pages", "blank_page_count"), "parse_status": F.when(seen & ok, "parsed").when(seen, "parse_error").otherwise(F.col("parse_status")),
        "parse_quality_score": F.when(seen, F.col("quality")).otherwise(F.col("parse_quality_score")), "error_message": F.when(seen & ~ok, "no page has text").when(~seen, F.col("error_message")),
    }
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in manifest.columns])


def read_pages(files: DataFrame, reader) -> DataFrame:
    """pdf_id, page_number (from 1), text, error: pages by an injected reader, path -> list of texts, in Arrow batches; a file that fails has one row with its error and no page number."""

    def run(batches):
        for b in batches:
            rows = []
            for pdf, path in zip(b["pdf_id"], b["file_path"]):
                try:
                    rows.extend((pdf, i, x, None) for i, x in enumerate(reader(path), 1))
                except Exception as e:  # noqa: BLE001
                    rows.append((pdf, None, None, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["pdf_id", "page_number", "text", "error"]).astype({"page_number": "Int64"})

    return spread(files.select("pdf_id", "file_path")).mapInPandas(run, "pdf_id string, page_number int, text string, error string")


def page_counts(pages: DataFrame) -> DataFrame:
    """pdf_id, pages: pages read of each file, 0 for a file that failed."""
    return pages.groupBy("pdf_id").agg(F.count("page_number").alias("pages"))
