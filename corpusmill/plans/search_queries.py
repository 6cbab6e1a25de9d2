"""Queries on retrieval, questions, literature and logs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V
from corpusmill.operators import files, literature, logs, ontology, retrieval
from corpusmill.sources import read_table as t

from .fact_queries import _F, _facts, _fits_sql
from .text_queries import WS, any_sql, q

TERMS, TOP = retrieval.MAX_TERMS, 5
SEARCHES = [(1, "oxygen vacancies leakage current"), (2, "wake-up effect of the memristor"), (3, "atomic layer deposition of Hf0.5Zr0.5O2")]


def _docs(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents", "doc_id", "text").where("text is not null")


def tfidf_index(s, d):
    return retrieval.index(_docs(s, d), "doc_id", "text", TERMS).select(F.col("id").alias("doc_id"), "term", F.round("weight", 6).alias("weight"))


def tfidf_search(s, d):
    docs = _docs(s, d)
    asked = s.createDataFrame(SEARCHES, "query_id int, query string")
    return retrieval.search(retrieval.written_index(docs, "doc_id", "text", TERMS), docs, asked, "doc_id", TOP).select("query_id", "rank", F.col("id").alias("doc_id"), F.round("score", 4).alias("score"))


def keyword_index(s, d):
    """Postings of high-value chunks: term, chunks, occurrences."""
    c = t(s, d, "document_chunks", "chunk_id", "text", "is_high_value").where("is_high_value")
    return retrieval.exploded_terms(c, "chunk_id", "text", "chunk_id").groupBy("term").agg(F.countDistinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("occurrences"))


def tokenize(s, d):
    return t(s, d, "papers", "paper_id", "title").select("paper_id", F.array_join(F.array_sort(T.tokens(F.col("title"))), "|").alias("tokens"))


def question_intent(s, d):
    return retrieval.questions(s).select("question_id", "want_property", "want_family")


def _scored(s, d):
    f = _facts(s, d).join(t(s, d, "papers", "paper_id", "doi"), "paper_id", "left")
    return retrieval.score_facts(f, retrieval.questions(s))


def rag_retrieve(s, d):
    return retrieval.top_facts(_scored(s, d), 24).select("question_id", "rank", "fact_id", "score")


def answer_ranges(s, d):
    return retrieval.answer_ranges(_scored(s, d))


def evidence_select(s, d):
    return retrieval.evidence_for(_scored(s, d), 24)


def domain_score(s, d):
    return t(s, d, "literature_candidates", "candidate_id", "title", "abstract").select("candidate_id", T.domain_score(F.col("title"), F.col("abstract")).alias("score"))


def html_clean(s, d):
    c = t(s, d, "literature_candidates", "candidate_id", "title", "abstract")
    return c.select("candidate_id", T.html_clean(F.concat(F.lit("<p>\n "), "title", F.lit("</p> &amp; <b>"), F.coalesce("abstract", F.lit("")), F.lit("</b>&nbsp;"))).alias("text"))


def safe_filename(s, d):
    c = t(s, d, "literature_candidates", "candidate_id", "title", "doi", "year")
    return c.select("candidate_id", T.safe_filename(F.col("title"), F.col("doi"), F.col("year")).alias("file_name"))


def _people(c):
    return F.split(c, "; |, ")


def _raw_openalex(s, d):
    c = t(s, d, "literature_candidates", "candidate_id", "title", "doi", "authors", "journal", "publisher", "year", "abstract", "oa_status", "oa_url", "pdf_url", "source", "query").where("source = 'openalex'")
    words = c.select("candidate_id", F.posexplode(F.filter(F.split("abstract", r"\s+"), lambda w: w != "")).alias("p", "w"))
    places = words.groupBy("candidate_id", "w").agg(F.collect_list("p").alias("p")).groupBy("candidate_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("places"))
    c = c.join(places, "candidate_id", "left")
    j = F.struct(
        F.col("candidate_id").alias("id"), F.col("doi"), F.col("title"), F.col("year").alias("publication_year"), F.transform(_people(F.col("authors")), lambda a: F.struct(a.alias("raw_author_name"))).alias("authorships"),
        F.struct(F.struct(F.col("journal").alias("display_name"), F.col("publisher")).alias("source"), F.col("pdf_url")).alias("primary_location"), F.struct("oa_status", "oa_url").alias("open_access"), F.col("places").alias("abstract_inverted_index"),
    )
    return c.select("query", F.to_json(j).alias("json"))


def _raw_crossref(s, d):
    c = t(s, d, "literature_candidates", "candidate_id", "title", "doi", "authors", "journal", "publisher", "year", "abstract", "source", "query").where("source = 'crossref'")
    j = F.struct(F.col("doi").alias("DOI"), F.array("title").alias("title"), F.array("journal").alias("container-title"), F.col("publisher"), F.col("abstract"), F.transform(_people(F.col("authors")), lambda a: F.struct(F.lit("Dr").alias("given"), a.alias("family"))).alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("published-print"))
    return c.select("query", F.to_json(j).alias("json"))


def lit_openalex(s, d):
    return literature.from_openalex(_raw_openalex(s, d)).drop("pdf_url")


def lit_crossref(s, d):
    return literature.from_crossref(_raw_crossref(s, d)).drop("pdf_url", "oa_status")


def lit_merge(s, d):
    return literature.merged(literature.from_openalex(_raw_openalex(s, d)), literature.from_crossref(_raw_crossref(s, d)), 0.1).select("candidate_id", "doi", "title", "year", "source")


def lit_rank(s, d):
    return literature.ranked(t(s, d, "literature_candidates", "candidate_id", "title", "year", "match_score")).select("candidate_id")


def lit_stats(s, d):
    c = t(s, d, "literature_candidates", "source", "doi", "oa_url", "pdf_url")
    return c.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim("doi") != "").alias("with_doi"), F.count("oa_url").alias("with_oa_url"), F.count("pdf_url").alias("with_pdf_url"))


def lit_upsert(s, d):
    """Known records meet a new delivery: bibliographic columns and status are replaced, download_status stays."""
    c = t(s, d, "literature_candidates", "candidate_id", "title", "year", "status", "download_status", "created_at")
    old = c.where("created_at < timestamp'2024-06-01'").drop("created_at")
    new = c.where("created_at >= timestamp'2024-01-01'").select("candidate_id", F.upper("title").alias("title"), "year", F.lit("seen").alias("status"), F.lit("not_downloaded").alias("download_status"))
    return files.upsert(old, new, ["candidate_id"], ["title", "year", "status"])


def abstract_rebuild(s, d):
    return literature.from_openalex(_raw_openalex(s, d)).select("candidate_id", "abstract").where("abstract is not null")


def download_dedup(s, d):
    f = t(s, d, "pdf_files", "pdf_id", "sha256", "batch_no").withColumn("sha256", F.regexp_replace(F.lower(F.trim("sha256")), "^sha256:", ""))
    return literature.first_with_hash(f.where("batch_no > 15"), f.where("batch_no <= 15"), ["batch_no", "pdf_id"]).select("pdf_id", "duplicate")


def recent_events(s, d):
    """The 50 latest entries of a run log kept as JSON, decoded."""
    e = t(s, d, "events", "event_id", "ts", "event_type", "props")
    return logs.recent(e, "ts", "event_id", 50).select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))


def progress_log(s, d):
    lines = t(s, d, "events", "event_id", "user_id").select("event_id", F.format_string("processed=%d candidates=%d llm_used=0 llm_failed=0 empty=%d errors=%d", F.col("event_id"), F.col("user_id"), F.col("event_id") % 7, F.col("event_id") % 3).alias("line"))
    return logs.with_rate(logs.progress(lines, "event_id", "line", 20_000), 600.0)


def ontology_nodes(s, d):
    return ontology.node_table(s)


def ontology_relations(s, d):
    return ontology.relation_table(s)


#: A faulty ontology: unknown ends, a relation named twice, a node without a key.
FAULTY = {"nodes": {"Paper": "paper_id", "Dopant": "element", "Ghost": ""}, "relations": [["REPORTS", "Paper", "HafniaMaterial"], ["HAS_DOPANT", "Material", "Dopant"], ["CITES", "Paper", "Paper"], ["CITES", "Paper", "Paper"]]}


def ontology_validate(s, d):
    """Problems of the default ontology and of a faulty one."""
    return ontology.problems(s).select(F.lit("default").alias("ontology"), "*").unionByName(ontology.problems(s, FAULTY).select(F.lit("faulty").alias("ontology"), "*"))


def ontology_counts(s, d):
    return ontology.counts(s)


def ontology_bundle(s, d):
    """The bundle as one row a file: name and checksum of what is written."""
    return s.createDataFrame(ontology.bundle(ontology.default(), "1.0.0"), "file string, content string").select("file", F.sha2("content", 256).alias("checksum"), F.char_length("content").alias("chars"))


QUERIES = {f.__name__: f for f in (tfidf_index, tfidf_search, keyword_index, tokenize, question_intent, rag_retrieve, answer_ranges, evidence_select, domain_score, html_clean, safe_filename, lit_openalex, lit_crossref, lit_merge, lit_rank, lit_stats, lit_upsert, abstract_rebuild, download_dedup, recent_events, progress_log, ontology_nodes, ontology_relations, ontology_validate, ontology_counts, ontology_bundle)}


# SQL

_W = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}./-]+"


def _terms(col: str) -> str:
    w = f"regexp_extract_all(lower({col}), {q(_W)})"
    return f"list_concat({w}, CASE WHEN len({w}) > 1 THEN list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) ELSE [] END)"


_IDX = f"""w AS (SELECT doc_id, regexp_extract_all(lower(text), {q(_W)}) AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT doc_id, term, count(*) AS tf FROM e GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL), v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT {TERMS}),
i AS (SELECT term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM v, n), x AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN i USING (term)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM x GROUP BY 1), idx AS (SELECT doc_id, term, w / norm AS weight FROM x JOIN m USING (doc_id))"""
_SEARCH = "(VALUES " + ", ".join(f"({i}, {q(x)})" for i, x in SEARCHES) + ") s(query_id, query)"
_TOK = V.TOKEN
_toks = lambda c: f"list_distinct(list_filter(list_transform(regexp_extract_all({c}, {q(_TOK)}), lambda x: lower(x)), lambda x: length(x) > 1))"
_QS = "(VALUES " + ", ".join(f"({i}, {q(x)})" for i, x in retrieval.QUESTIONS) + ") s(question_id, question)"
_PROP = f"CASE WHEN regexp_matches(question, {q(V.ASK_2PR)}) THEN 'double_remanent_polarization_2Pr' WHEN regexp_matches(question, {q(V.ASK_EC)}) THEN 'coercive_field_Ec' WHEN regexp_matches(question, {q(V.ASK_PR)}) THEN 'remanent_polarization_Pr' " + " ".join(f"WHEN {any_sql('lower(question)', a)} THEN {q(p)}" for p, a in V.PROPERTY_ALIASES.items()) + " END"
_FAM = "CASE " + " ".join(f"WHEN {any_sql(chr(39) + ' ' + chr(39) + ' || lower(question) || ' + chr(39) + ' ' + chr(39), a)} THEN {q(f)}" for f, a in V.FAMILY_ALIASES.items()) + " END"
_MT = "lower(coalesce(material, '') || ' ' || coalesce(material_family, ''))"
_FM = "(want_family IS NULL OR CASE " + " ".join(f"WHEN want_family = {q(f)} THEN {any_sql(_MT, [f.lower(), *a])}" for f, a in V.FAMILY_ALIASES.items()) + " ELSE false END)"
_SCORED = f"""{_F}, qs AS (SELECT question_id, {_PROP} AS want_property, {_FAM} AS want_family, {_toks('question')} AS qt FROM {_QS}), ft AS (SELECT f.*, {_toks("concat_ws(' ', coalesce(f.title, ''), coalesce(p.doi, ''), coalesce(material, ''), coalesce(material_family, ''), coalesce(property_name, ''), coalesce(unit, ''), coalesce(evidence_text, ''))")} AS tk FROM f LEFT JOIN papers p ON p.paper_id = f.paper_id),
sc AS (SELECT question_id, want_property, fact_id, property_name, value, unit, len(list_intersect(qt, tk)) + CASE WHEN want_property IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN want_family IS NOT NULL THEN 2 ELSE 0 END + CASE context_quality WHEN 'strong' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END AS score FROM ft JOIN qs ON (want_property IS NULL OR want_property = property_name) AND {_FM}),
ok AS (SELECT * FROM sc WHERE score > 0), tp AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, fact_id) AS INT) AS rank FROM ok), nm AS (SELECT *, CASE WHEN value IS NOT NULL AND {_fits_sql('coalesce(want_property, property_name)', 'unit')} THEN value END AS v FROM ok),
ar AS (SELECT question_id, count(*) AS facts, count(v) AS numeric, min(v) AS min_v, max(v) AS max_v, quantile_cont(v, 0.5) AS median_v, arg_min(fact_id, {{'v': v, 'f': fact_id}}) FILTER (v IS NOT NULL) AS min_fact_id, arg_min(fact_id, {{'v': -v, 'f': fact_id}}) FILTER (v IS NOT NULL) AS max_fact_id FROM nm GROUP BY 1)"""


def _domain_sql(title: str, abstract: str) -> str:
    x = f"lower(coalesce({title}, '') || ' ' || coalesce({abstract}, ''))"
    hits = " + ".join(f"CASE WHEN contains({x}, {q(k)}) THEN 1 ELSE 0 END" for k in V.DOMAIN_KEYWORDS)
    return f"round(least(1.0, ({hits}) / 6.0)::DOUBLE * CASE WHEN contains({x}, 'ferroelectric') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN {any_sql(x, V.DOMAIN_MATERIALS)} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END, 3)"


def _html_sql(c: str) -> str:
    c = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for a, b in V.ENTITIES:
        c = f"replace({c}, {q(a)}, {q(b)})"
    return f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g'), {WS}), '')"


_DOI_S = f"nullif(trim(regexp_replace(lower(trim(doi, {WS})), '^https?://(dx\\.)?doi\\.org/', ''), {WS}), '')"
_ABS = "nullif(array_to_string(list_filter(regexp_split_to_array(abstract, '\\s+'), lambda x: x <> ''), ' '), '')"
_CID = "'lit_' || substr(sha1(coalesce(doi, lower(title) || '::' || coalesce(CAST(nullif(year, 0) AS VARCHAR), ''))), 1, 16)"
_OA = f"oa0 AS (SELECT {_DOI_S} AS doi, {_html_sql('title')} AS title, nullif(array_to_string(list_slice(regexp_split_to_array(authors, '; |, '), 1, 12), ', '), '') AS authors, {_html_sql('journal')} AS journal, {_html_sql('publisher')} AS publisher, year, {_ABS} AS abstract, 'openalex' AS source, oa_status, query FROM literature_candidates WHERE source = 'openalex'), oa AS (SELECT {_CID} AS candidate_id, *, {_domain_sql('title', 'abstract')} AS match_score FROM oa0 WHERE title IS NOT NULL)"
_CR = f"cr0 AS (SELECT {_DOI_S} AS doi, {_html_sql('title')} AS title, nullif(array_to_string(list_transform(list_slice(regexp_split_to_array(authors, '; |, '), 1, 12), lambda a: 'Dr' || CASE WHEN trim(a) <> '' THEN ' ' || trim(a) ELSE '' END), ', '), '') AS authors, {_html_sql('journal')} AS journal, {_html_sql('publisher')} AS publisher, year, {_html_sql('abstract')} AS abstract, 'crossref' AS source, query FROM literature_candidates WHERE source = 'crossref'), cr AS (SELECT {_CID} AS candidate_id, *, {_domain_sql('title', 'abstract')} AS match_score FROM cr0 WHERE title IS NOT NULL)"
_FILE = f"trim(substr(trim(regexp_replace(regexp_replace(trim(coalesce(nullif(doi, ''), title), {WS}), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '._-'), 1, 120), '')"



def _onto_sql(o: dict) -> str:
    rel = ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in o["relations"])
    nodes = ", ".join(f"({q(k)}, {q(v)})" for k, v in o["nodes"].items())
    return f"WITH r(relation, source, target) AS (VALUES {rel}), n(node_class, key_field) AS (VALUES {nodes}), e AS (SELECT relation, unnest([source, target]) AS node_class FROM r) SELECT DISTINCT 'unknown_end' AS problem, relation AS subject, node_class AS detail FROM e WHERE node_class NOT IN (SELECT node_class FROM n) UNION ALL SELECT 'repeated_relation', relation, source || '>' || target FROM r GROUP BY relation, source, target HAVING count(*) > 1 UNION ALL SELECT 'no_key', node_class, '' FROM n WHERE trim(key_field) = ''"


SQL = {
    "tfidf_index": f"WITH {_IDX} SELECT doc_id, term, round(weight, 6) AS weight FROM idx",
    "tfidf_search": f"WITH {_IDX}, qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_terms('query')}) AS term FROM {_SEARCH}) GROUP BY 1, 2), qw AS (SELECT query_id, term, qtf * idf AS qw FROM qt JOIN i USING (term)), qn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qn FROM qw GROUP BY 1), sc AS (SELECT query_id, doc_id, round(sum(weight * qw) / any_value(qn), 6) AS score FROM idx JOIN qw USING (term) JOIN qn USING (query_id) GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM sc WHERE score > 0) SELECT query_id, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= {TOP}",
    "keyword_index": f"WITH w AS (SELECT chunk_id, regexp_extract_all(lower(text), {q(_W)}) AS w FROM document_chunks WHERE is_high_value), e AS (SELECT chunk_id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w) SELECT term, count(DISTINCT chunk_id) AS chunks, count(*) AS occurrences FROM e GROUP BY 1",
    "tokenize": f"SELECT paper_id, array_to_string(list_sort({_toks('title')}), '|') AS tokens FROM papers",
    "question_intent": f"SELECT question_id, {_PROP} AS want_property, {_FAM} AS want_family FROM {_QS}",
    "rag_retrieve": f"WITH {_SCORED} SELECT question_id, rank, fact_id, score FROM tp WHERE rank <= 24",
    "answer_ranges": f"WITH {_SCORED} SELECT * FROM ar",
    "evidence_select": f"WITH {_SCORED}, en AS (SELECT question_id, 0 AS o, min_fact_id AS fact_id FROM ar UNION ALL SELECT question_id, 1, max_fact_id FROM ar UNION ALL SELECT question_id, rank + 1, fact_id FROM tp WHERE rank <= 24), fi AS (SELECT question_id, fact_id, min(o) AS o FROM en WHERE fact_id IS NOT NULL GROUP BY 1, 2), pl AS (SELECT question_id, fact_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY o, fact_id) AS INT) AS place FROM fi) SELECT question_id, place, fact_id FROM pl WHERE place <= 24",
    "domain_score": f"SELECT candidate_id, {_domain_sql('title', 'abstract')} AS score FROM literature_candidates",
    "html_clean": "SELECT candidate_id, " + _html_sql("('<p>' || chr(10) || ' ' || title || '</p> &amp; <b>' || coalesce(abstract, '') || '</b>&nbsp;')") + " AS text FROM literature_candidates",
    "safe_filename": f"SELECT candidate_id, coalesce(nullif(CAST(year AS VARCHAR), '') || '_', '') || coalesce(nullif({_FILE}, ''), 'open_access_paper') || '.pdf' AS file_name FROM literature_candidates",
    "lit_openalex": f"WITH {_OA} SELECT * FROM oa",
    "lit_crossref": f"WITH {_CR} SELECT * FROM cr",
    "lit_merge": f"WITH {_OA}, {_CR}, b AS (SELECT 1 AS p, candidate_id, doi, title, year, source, query, match_score FROM oa UNION ALL SELECT 0, candidate_id, doi, title, year, source, query, match_score FROM cr), k AS (SELECT *, row_number() OVER (PARTITION BY coalesce(doi, candidate_id) ORDER BY p DESC, title DESC, query DESC NULLS LAST, candidate_id DESC) AS r FROM b WHERE match_score >= 0.1) SELECT candidate_id, doi, title, year, source FROM k WHERE r = 1",
    "lit_rank": "SELECT candidate_id FROM literature_candidates ORDER BY coalesce(year, 0) DESC, match_score DESC, lower(title) DESC, candidate_id",
    "lit_stats": "SELECT source, count(*) AS n, count(*) FILTER (trim(doi) <> '') AS with_doi, count(oa_url) AS with_oa_url, count(pdf_url) AS with_pdf_url FROM literature_candidates GROUP BY 1",
    "lit_upsert": "WITH o AS (SELECT * FROM literature_candidates WHERE created_at < TIMESTAMP '2024-06-01'), n AS (SELECT candidate_id, upper(title) AS title, year FROM literature_candidates WHERE created_at >= TIMESTAMP '2024-01-01') SELECT coalesce(o.candidate_id, n.candidate_id) AS candidate_id, CASE WHEN n.candidate_id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.candidate_id IS NULL THEN o.year ELSE n.year END AS year, CASE WHEN n.candidate_id IS NULL THEN o.status ELSE 'seen' END AS status, CASE WHEN o.candidate_id IS NULL THEN 'not_downloaded' ELSE o.download_status END AS download_status FROM o FULL JOIN n ON o.candidate_id = n.candidate_id",
    "abstract_rebuild": f"WITH {_OA} SELECT candidate_id, abstract FROM oa WHERE abstract IS NOT NULL",
    "download_dedup": "WITH f AS (SELECT pdf_id, regexp_replace(lower(trim(sha256)), '^sha256:', '') AS h, batch_no FROM pdf_files) SELECT pdf_id, h IS NOT NULL AND (h IN (SELECT h FROM f WHERE batch_no <= 15 AND h IS NOT NULL) OR row_number() OVER (PARTITION BY h ORDER BY batch_no, pdf_id) > 1) AS duplicate FROM f WHERE batch_no > 15",
    "ontology_nodes": "SELECT * FROM (VALUES " + ", ".join(f"({q(k)}, {q(v)})" for k, v in ontology.NODES.items()) + ") t(node_class, key_field)",
    "ontology_relations": "SELECT * FROM (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in ontology.RELATIONS) + ") t(relation, source, target)",
    "ontology_validate": " UNION ALL ".join(f"SELECT '{name}' AS ontology, * FROM ({_onto_sql(o)})" for name, o in (("default", ontology.default()), ("faulty", FAULTY))),
    "ontology_counts": f"SELECT {len(ontology.NODES)}::BIGINT AS n_nodes, {len(ontology.RELATIONS)}::BIGINT AS n_relations, {len({r for r, _, _ in ontology.RELATIONS})}::BIGINT AS n_names, {len({e for _, a, b in ontology.RELATIONS for e in (a, b)})}::BIGINT AS n_linked",
    "ontology_bundle": "SELECT * FROM (VALUES " + ", ".join(f"({q(n)}, sha256({q(c)}), {len(c)})" for n, c in ontology.bundle(ontology.default(), "1.0.0")) + ") t(file, checksum, chars)",
    "recent_events": "SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "progress_log": "WITH l AS (SELECT max(event_id) AS processed FROM events), x AS (SELECT event_id AS processed, user_id AS candidates, event_id % 7 AS empty, event_id % 3 AS errors FROM events WHERE event_id = (SELECT processed FROM l)) SELECT processed, candidates, empty, errors, CAST(20000 - processed AS BIGINT) AS remaining, round(processed / 20000.0 * 100, 1)::DOUBLE AS percent, round(processed / 600.0::DOUBLE * 60, 2)::DOUBLE AS per_minute, round((20000 - processed) / (processed / 600.0::DOUBLE * 60) * 60, 0)::DOUBLE AS seconds_left, CASE WHEN errors > 0 AND errors = processed THEN 'failed' WHEN processed >= 20000 THEN 'finished' WHEN processed > 0 THEN 'running' ELSE 'waiting' END AS state FROM x",
}
