"""Queries on incremental work, upserts, schema changes and layout, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from corpusmill.functions import vocab as V
from corpusmill.operators import chunks, facts, files
from corpusmill.sources import read_table as t

from .text_queries import WS, clean_title_sql, q, title_score_sql

NEWER = StructType([StructField("pdf_id", StringType()), StructField("file_size", LongType()), StructField("ocr_needed", BooleanType()), StructField("table_parse_status", StringType()), StructField("language", StringType())])


def extract_incremental(s, d):
    """High-value chunks whose page has no fact yet."""
    work = t(s, d, "document_chunks", "chunk_id", "paper_id", "page_number", "is_high_value").where("is_high_value").drop("is_high_value")
    return chunks.not_yet(work, t(s, d, "fact_hits", "paper_id", "page_number"), ["paper_id", "page_number"]).select("chunk_id", "paper_id", "page_number")


def pages_upsert(s, d):
    """Pages after a second parse: text, count and status are replaced, identifiers stay, new pages are added."""
    p = t(s, d, "parsed_pages", "page_id", "pdf_id", "page_number", "text", "char_count")
    base = p.where("page_number <= 4")
    new = p.where("page_number >= 3").select(F.concat("page_id", F.lit("_new")).alias("page_id"), "pdf_id", "page_number", F.upper("text").alias("text"), F.char_length("text").alias("char_count"))
    return files.upsert(base, new, ["pdf_id", "page_number"], ["text", "char_count"])


def schema_evolve(s, d):
    return files.evolve(t(s, d, "pdf_files", "pdf_id", "file_size", "ocr_needed"), NEWER, {"table_parse_status": "pending"})


def json_salvage(s, d):
    e = t(s, d, "events", "event_id", "props").withColumn("answer", F.concat(F.lit("Here it is:\n"), "props", F.lit("\nDone.")))
    return e.select("event_id", F.get_json_object(facts.json_object(F.col("answer")), "$.k").cast("long").alias("k"))


def latest_facts(s, d):
    """The 200 latest facts, then those of one property: the filter stays behind the limit, as a list view shows it."""
    f = t(s, d, "fact_hits", "fact_id", "property_name", "created_at").distinct()
    return f.orderBy(F.desc("created_at"), "fact_id").limit(200).where("property_name = 'coercive_field_Ec'").select("fact_id", "created_at")


def title_spans(s, d):
    """Spans made from all lines of first pages: type size by the line's length, wide gaps after every fourth line."""
    p = t(s, d, "parsed_pages", "page_id", "page_number", "text").where("page_number = 1")
    lines = F.split("text", "\n")
    rows = p.select("page_id", (F.size(lines) * 29).cast("double").alias("height"), F.posexplode(lines).alias("n", "line"))
    return rows.select("page_id", (F.col("n") * 14 + F.floor(F.col("n") / 4) * 60).cast("double").alias("y"), F.lit(0.0).alias("x"), (F.lit(10.0) + F.char_length("line") % 9).alias("size"), F.col("line").alias("text"), "height")


def title_layout(s, d):
    """Titles by layout of first pages."""
    return files.layout_titles(title_spans(s, d)).withColumn("score", F.round("score", 4))


QUERIES = {f.__name__: f for f in (extract_incremental, pages_upsert, schema_evolve, json_salvage, latest_facts, title_layout)}

TITLE_LAYOUT_SQL = f"""WITH l AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n, len(string_split(text, chr(10))) * 29 AS height FROM parsed_pages WHERE page_number = 1), s AS (SELECT page_id, CAST(n * 14 + (n // 4) * 60 AS DOUBLE) AS y, CAST(10.0 + length(line) % 9 AS DOUBLE) AS size, line FROM l WHERE trim(line) <> '' AND n * 14 + (n // 4) * 60 < height * 0.72),
b AS (SELECT *, max(CASE WHEN NOT regexp_matches(line, {q(V.BAD_TITLE)}) THEN size END) OVER (PARTITION BY page_id) AS m FROM s), k0 AS (SELECT *, coalesce(size >= greatest(12.0, m - CASE WHEN m >= 16 THEN 1.2 ELSE 2.5 END), false) AS big FROM b), k AS (SELECT *, big AND (NOT coalesce(lag(big) OVER w, false) OR y - lag(y) OVER w > 48) AS nw FROM k0 WINDOW w AS (PARTITION BY page_id ORDER BY y)),
g AS (SELECT *, sum(nw::INT) OVER (PARTITION BY page_id ORDER BY y ROWS UNBOUNDED PRECEDING) AS g FROM k), h AS (SELECT page_id, g, string_agg(trim(line, {WS}), ' ' ORDER BY y) AS raw, min(y) AS y, avg(size) AS size FROM g WHERE big GROUP BY 1, 2), c AS (SELECT page_id, g, {clean_title_sql('raw')} AS title, y, size FROM h),
z AS (SELECT *, {title_score_sql('title')} + size AS score FROM c) SELECT page_id, arg_max(title, {{'s': score, 'g': -g}}) AS title, arg_max(y, {{'s': score, 'g': -g}}) AS y, arg_max(size, {{'s': score, 'g': -g}}) AS size, max(score) AS score FROM z GROUP BY 1"""

SQL = {
    "extract_incremental": "SELECT chunk_id, paper_id, page_number FROM document_chunks c WHERE is_high_value AND NOT EXISTS (SELECT 1 FROM fact_hits f WHERE f.paper_id = c.paper_id AND f.page_number = c.page_number)",
    "pages_upsert": "WITH b AS (SELECT * FROM parsed_pages WHERE page_number <= 4), u AS (SELECT page_id || '_new' AS page_id, pdf_id, page_number, upper(text) AS text, length(text) AS char_count FROM parsed_pages WHERE page_number >= 3) SELECT coalesce(b.page_id, u.page_id) AS page_id, coalesce(b.pdf_id, u.pdf_id) AS pdf_id, coalesce(b.page_number, u.page_number) AS page_number, CASE WHEN u.pdf_id IS NULL THEN b.text ELSE u.text END AS text, CASE WHEN u.pdf_id IS NULL THEN b.char_count ELSE u.char_count END AS char_count FROM b FULL JOIN u ON b.pdf_id = u.pdf_id AND b.page_number = u.page_number",
    "schema_evolve": "SELECT pdf_id, file_size, ocr_needed, 'pending' AS table_parse_status, CAST(NULL AS VARCHAR) AS language FROM pdf_files",
    "json_salvage": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "latest_facts": "WITH l AS (SELECT * FROM (SELECT DISTINCT fact_id, property_name, created_at FROM fact_hits) ORDER BY created_at DESC, fact_id LIMIT 200) SELECT fact_id, created_at FROM l WHERE property_name = 'coercive_field_Ec'",
    "title_layout": f"SELECT page_id, title, y, size, round(score, 4) AS score FROM ({TITLE_LAYOUT_SQL})",
}
