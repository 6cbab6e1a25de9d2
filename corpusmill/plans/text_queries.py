"""Queries on pages, files, papers and chunks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V
from corpusmill.operators import chunks, files
from corpusmill.sources import read_table as t

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
q = lambda s: "'" + s.replace("'", "''") + "'"


def any_sql(expr: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({expr}, {q(w)})" for w in words) + ")"


def flag_sql(col: str, words: list[str]) -> str:
    return any_sql(f"(' ' || lower({col}) || ' ')", words)


def section_sql(col: str) -> str:
    head = f"lower(substr({col}, 1, 160))"
    whens = " ".join(f"WHEN {any_sql(head, w)} THEN {q(n)}" for n, w in V.SECTIONS)
    return f"CASE {whens} WHEN starts_with({head}, 'fig.') OR contains(substr({head}, 1, 40), 'figure') THEN 'figure_caption' ELSE 'unknown' END"


def clean_sql(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace({col}, chr(0), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"


def dehyphenate_sql(col: str) -> str:
    w = r"[\p{L}\p{N}_]"
    return f"trim(regexp_replace(regexp_replace(regexp_replace({col}, '({w})-\\s*\\n\\s*({w})', '\\1\\2', 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"


def file_title_sql(col: str) -> str:
    stem = f"regexp_replace({col}, '\\.[^.]*$', '')"
    body = f"trim(regexp_replace(replace(regexp_replace({stem}, '^20[12]\\d[_\\-\\s]+', ''), '_', ' '), '\\s+', ' ', 'g'), {WS})"
    return f"CASE WHEN {body} = '' THEN {stem} ELSE {body} END"


def type_sql(title: str, name: str) -> str:
    x = f"(coalesce({title}, '') || ' ' || coalesce({name}, ''))"
    return f"CASE WHEN regexp_matches({x}, {q(V.COMPUTATIONAL)}) THEN 'computational' WHEN regexp_matches({x}, {q(V.THEORETICAL)}) THEN 'theoretical' WHEN regexp_matches({x}, {q(V.REVIEW_HINT)}) THEN 'review' ELSE 'experimental' END"


def clean_title_sql(col: str) -> str:
    for a, b in V.ENTITIES:
        col = f"replace({col}, {q(a)}, {q(b)})"
    for pattern, to in V.TITLE_REWRITES:
        to = to.replace("$1", "\\1").replace("$2", "\\2")
        col = f"regexp_replace({col}, {q(pattern)}, {q(to)}, 'g')"
    return f"trim({col}, ' .,' || chr(9) || chr(10) || chr(13))"


def title_score_sql(t_: str) -> str:
    n, low = f"length({t_})", f"lower({t_})"
    words = f"len(regexp_extract_all({t_}, '[A-Za-z][A-Za-z0-9-]*'))"
    kw = " + ".join(f"CASE WHEN contains({low}, {q(k)}) THEN 8 ELSE 0 END" for k in V.TITLE_KEYWORDS)
    score = f"least({n}, 180) / 3.0 + least({words}, 24) * 2 + {kw} - CASE WHEN regexp_matches({low}, {q(V.TITLE_NOISE)}) THEN 25 ELSE 0 END - CASE WHEN regexp_matches({t_}, '\\d{{4}}') AND {n} < 80 THEN 20 ELSE 0 END"
    bad = f"{t_} IS NULL OR {n} NOT BETWEEN 18 AND 260 OR regexp_matches({t_}, {q(V.BAD_TITLE)}) OR regexp_matches({t_}, '^\\p{{Ll}}') OR regexp_matches({t_}, {q(V.DANGLING)}) OR {words} < 4"
    return f"CASE WHEN {bad} THEN 0.0 ELSE greatest({score}, 0.0) END"


def clean_text(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "parsed_pages", "page_id", "text").select("page_id", T.clean_text(F.col("text")).alias("text"))


def dehyphenate(s, d):
    return t(s, d, "parsed_pages", "page_id", "text").select("page_id", T.dehyphenate(F.col("text")).alias("text"))


def doi_extract(s, d):
    p = t(s, d, "papers", "paper_id", "doi")
    return p.select("paper_id", T.parser_doi(F.col("doi")).alias("printed_doi"), T.resolver_doi(F.col("doi")).alias("service_doi"), T.first_doi(F.col("doi")).alias("found_doi"))


def filename_meta(s, d):
    return t(s, d, "pdf_files", "pdf_id", "file_name").select("pdf_id", T.file_title(F.col("file_name")).alias("title"), T.file_year(F.col("file_name")).alias("year"))


def doc_metadata(s, d):
    return files.first_metadata(t(s, d, "pdf_files", "pdf_id", "file_name"), t(s, d, "parsed_pages", "pdf_id", "page_number", "text"))


def paper_type(s, d):
    return t(s, d, "papers", "paper_id", "title").select("paper_id", T.paper_type(F.col("title"), F.lit("")).alias("found_type"))


def section_classify(s, d):
    return t(s, d, "document_chunks", "chunk_id", "text").select("chunk_id", T.section(F.col("text")).alias("section"))


def keyword_flags(s, d):
    return chunks.flags(t(s, d, "document_chunks", "chunk_id", "text")).drop("text")


def chunk_counts(s, d):
    return t(s, d, "document_chunks", "chunk_id", "text").select("chunk_id", F.char_length("text").alias("chars"), T.word_count(F.col("text")).cast("int").alias("words"), F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)).cast("int").alias("cost_units"))


def page_quality(s, d):
    return files.page_quality(t(s, d, "parsed_pages", "pdf_id", "text"))


def dedup_exact(s, d):
    f = t(s, d, "pdf_files", "pdf_id", "file_path", "sha256").withColumn("sha256", F.regexp_replace(F.lower(F.trim("sha256")), "^sha256:", ""))
    return files.with_identity(f).select("pdf_id", "new_pdf_id", "new_paper_id", "is_dup", "dup_of")


def manifest_stats(s, d):
    f = files.first_of(t(s, d, "pdf_files", "sha256", "pdf_id").withColumn("sha256", F.regexp_replace(F.lower(F.trim("sha256")), "^sha256:", "")), "sha256", "pdf_id")
    return f.agg(F.sum("copies").alias("files"), F.count(F.lit(1)).alias("contents"), F.sum(F.col("copies") - 1).alias("duplicates"))


def pending_scan(s, d):
    return t(s, d, "pdf_files", "pdf_id", "file_name", "parse_status").where(F.col("parse_status").isin("pending", "manifested", "manifest_error", "parse_error")).orderBy("file_name", "pdf_id")


def split_text(s, d):
    return t(s, d, "parsed_pages", "page_id", "text").select("page_id", F.posexplode(chunks.split_text(F.col("text"))).alias("piece", "text"))


def chunk_documents(s, d):
    return chunks.chunk_pages(t(s, d, "parsed_pages", "page_id", "paper_id", "pdf_id", "page_number", "text"))


def chunk_incremental(s, d):
    return chunks.not_yet(t(s, d, "parsed_pages", "page_id", "pdf_id", "page_number"), t(s, d, "document_chunks", "pdf_id", "page_number"), ["pdf_id", "page_number"])


def table_normalize(s, d):
    f = t(s, d, "fact_hits", "fact_id", "material", "unit", "raw_property_name", "page_number").distinct()
    cells = F.array(F.array(F.col("material"), F.col("raw_property_name")), F.array(F.lit(" "), F.lit("")), F.array(F.col("unit"), F.concat(F.lit("a  \n "), F.col("page_number").cast("string"))))
    return chunks.table_chunk(f.select(F.col("fact_id").alias("pdf_id"), F.col("page_number"), F.lit(0).alias("table_index"), cells.alias("cells"))).withColumnRenamed("pdf_id", "fact_id").drop("table_index")


def clean_title(s, d):
    return t(s, d, "literature_candidates", "candidate_id", "title").select("candidate_id", T.clean_title(F.col("title")).alias("title"))


def title_score(s, d):
    return t(s, d, "papers", "paper_id", "title").select("paper_id", F.round(T.title_score(F.col("title")), 4).alias("score"))


def title_repair(s, d):
    """Per paper and file: the better of the paper's title and the file name's, the latter 8 points down and only where the paper's is useless."""
    j = t(s, d, "papers", "paper_id", "title").join(t(s, d, "pdf_files", "pdf_id", "paper_id", "file_name"), "paper_id")
    clean, name = T.clean_title(F.col("title")), T.clean_title(T.file_title(F.col("file_name")))
    j = j.select("paper_id", "pdf_id", F.coalesce(T.title_score(F.col("title")), F.lit(0.0)).alias("old_score"), clean.alias("clean"), name.alias("name_title"), (T.title_score(T.file_title(F.col("file_name"))) - 8).alias("name_score"))
    use = (F.col("old_score") == 0) & (F.col("name_score") >= 45)
    return j.select("paper_id", "pdf_id", F.round("old_score", 4).alias("old_score"), F.when(use, F.col("name_title")).otherwise(F.col("clean")).alias("best_title"), F.when(use, "filename").otherwise("paper").alias("title_source"))


def distinct_counts(s, d):
    return t(s, d, "document_chunks", "pdf_id", "chunk_id", "paper_id", "is_high_value").where("is_high_value").agg(F.countDistinct("pdf_id").alias("pdfs"), F.countDistinct("chunk_id").alias("chunks"), F.countDistinct("paper_id").alias("papers"))


TABLES = ["papers", "pdf_files", "parsed_pages", "document_chunks", "literature_candidates", "fact_hits", "documents"]


def table_counts(s, d):
    out = None
    for name in TABLES:
        c = t(s, d, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


def corpus_summary(s, d):
    f = t(s, d, "fact_hits", "review_status", "material_family", "property_name")
    years = t(s, d, "papers", "year").select(F.lit("year").alias("dimension"), F.coalesce(F.when(F.col("year") != 0, F.col("year")).cast("string"), F.lit("unknown")).alias("value"))
    out = years
    for c in f.columns:
        out = out.unionByName(f.select(F.lit(c).alias("dimension"), F.coalesce(c, F.lit("unknown")).alias("value")))
    return out.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def manifest_upsert(s, d):
    """The manifest after a rescan of the last batches: size and hash are replaced, the parse status of known files stays."""
    f = t(s, d, "pdf_files", "pdf_id", "file_name", "sha256", "file_size", "parse_status", "batch_no")
    base = f.where("batch_no <= 15").drop("batch_no")
    new = f.where("batch_no >= 10").select("pdf_id", "file_name", F.lower("sha256").alias("sha256"), (F.col("file_size") + 1).alias("file_size"), F.lit("manifested").alias("parse_status"))
    return files.upsert(base, new, ["pdf_id"], ["file_name", "sha256", "file_size"])


def paper_metadata(s, d):
    """Papers after parsing: DOI, year and type found on the pages take the place of older ones where there are any; titles stay."""
    p = t(s, d, "papers", "paper_id", "doi", "title", "year", "paper_type", "is_review")
    found = doc_metadata(s, d).join(t(s, d, "pdf_files", "pdf_id", "paper_id").where("paper_id is not null"), "pdf_id")
    new = found.groupBy("paper_id").agg(*[F.min(c).alias(c) for c in ("doi", "year", "title", "paper_type")]).withColumn("is_review", F.col("paper_type") == "review")
    return files.upsert(p, new, ["paper_id"], [], ["doi", "year", "paper_type", "is_review"])


QUERIES = {f.__name__: f for f in (clean_text, dehyphenate, doi_extract, filename_meta, doc_metadata, paper_type, section_classify, keyword_flags, chunk_counts, page_quality, dedup_exact, manifest_stats, pending_scan, split_text, chunk_documents, chunk_incremental, table_normalize, clean_title, title_score, title_repair, distinct_counts, table_counts, corpus_summary, manifest_upsert, paper_metadata)}

_LINES = f"list_filter(list_transform(regexp_split_to_array(head, '\\r\\n|\\n|\\r'), lambda x: trim(x, {WS})), lambda x: length(x) > 8)"
_META = f"""WITH two AS (SELECT pdf_id, string_agg(text, chr(10) ORDER BY page_number, text) AS head FROM parsed_pages WHERE page_number <= 2 GROUP BY pdf_id),
j AS (SELECT pdf_id, head, file_name, coalesce(list_filter(list_slice({_LINES}, 1, 12), lambda x: length(x) BETWEEN 20 AND 220 AND NOT regexp_matches(lower(x), 'journal|doi|copyright'))[1], {file_title_sql('file_name')}) AS title FROM two JOIN pdf_files USING (pdf_id)),
m AS (SELECT pdf_id, nullif(lower(regexp_replace(regexp_extract(head, {q(V.DOI)}, 0), '[.,;)\\]}}]+$', '')), '') AS doi, CAST(coalesce(nullif(regexp_extract(file_name, {q(V.FILE_YEAR)}, 1), ''), nullif(regexp_extract(head, {q(V.YEAR)}, 1), '')) AS INT) AS year, title, {type_sql('title', 'file_name')} AS paper_type FROM j)"""
_SHA = "regexp_replace(lower(trim(sha256)), '^sha256:', '')"
_PARTS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace({dehyphenate_sql('text')}, '\\n\\s*\\n', chr(31), 'g'), '\\.\\s+([A-Z])', '.' || chr(31) || '\\1', 'g'), chr(31)), lambda x: trim(x, {WS})), lambda x: x <> '')"


def _fold(least: int, most: int, overlap: int) -> str:
    tail = f"trim(right(a.cur, {overlap}), {WS})"
    fits = f"(length(a.cur) < {least} OR length(a.cur) + length(p.cur) <= {most})"
    return f"list_reduce(list_prepend({{'done': CAST([] AS VARCHAR[]), 'cur': ''}}, list_transform({_PARTS}, lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x}})), lambda a, p: {{'done': CASE WHEN a.cur = '' OR {fits} THEN a.done ELSE list_append(a.done, a.cur) END, 'cur': CASE WHEN a.cur = '' THEN p.cur WHEN {fits} THEN a.cur || chr(10) || p.cur WHEN {tail} = '' THEN p.cur ELSE {tail} || chr(10) || p.cur END}})"


_CUT = f"WITH f AS (SELECT page_id, paper_id, pdf_id, page_number, {_fold(chunks.MIN_CHARS, chunks.MAX_CHARS, chunks.OVERLAP)} AS r FROM parsed_pages), cut AS (SELECT page_id, paper_id, pdf_id, page_number, CASE WHEN r.cur = '' THEN r.done ELSE list_append(r.done, r.cur) END AS parts FROM f)"
_FLAGS = f"{{0}} AS contains_formula, {{1}} AS contains_hfo2_keyword, {{2}} AS contains_process_keyword, {{3}} AS contains_property_keyword, (({{1}}) OR ({{0}})) AND (({{2}}) OR ({{3}})) AS is_high_value".format(f"regexp_matches(text, {q(V.FORMULA)})", flag_sql("text", V.HFO2_KEYWORDS), flag_sql("text", V.PROCESS_KEYWORDS), flag_sql("text", V.PROPERTY_KEYWORDS))
_WORDS = "CAST(greatest(1, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) AS INT)"
_SPACE = "regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g')"
_CELL = lambda c: f"trim({_SPACE.format(c)}, {WS})"

SQL = {
    "clean_text": f"SELECT page_id, {clean_sql('text')} AS text FROM parsed_pages",
    "dehyphenate": f"SELECT page_id, {dehyphenate_sql('text')} AS text FROM parsed_pages",
    "doi_extract": f"SELECT paper_id, nullif(lower(regexp_replace(trim(doi, {WS}), '[.,;)\\]}}]+$', '')), '') AS printed_doi, nullif(trim(regexp_replace(lower(trim(doi, {WS})), '^https?://(dx\\.)?doi\\.org/', ''), {WS}), '') AS service_doi, nullif(lower(regexp_replace(regexp_extract(doi, {q(V.DOI)}, 0), '[.,;)\\]}}]+$', '')), '') AS found_doi FROM papers",
    "filename_meta": f"SELECT pdf_id, {file_title_sql('file_name')} AS title, CAST(nullif(regexp_extract(file_name, {q(V.FILE_YEAR)}, 1), '') AS INT) AS year FROM pdf_files",
    "doc_metadata": f"{_META} SELECT * FROM m",
    "paper_type": f"SELECT paper_id, {type_sql('title', chr(39) * 2)} AS found_type FROM papers",
    "section_classify": f"SELECT chunk_id, {section_sql('text')} AS section FROM document_chunks",
    "keyword_flags": f"SELECT chunk_id, {_FLAGS} FROM document_chunks",
    "chunk_counts": f"SELECT chunk_id, length(text) AS chars, {_WORDS} AS words, CAST(greatest(1, length(text) // 4) AS INT) AS cost_units FROM document_chunks",
    "page_quality": "WITH g AS (SELECT pdf_id, count(*) AS n_pages, count(*) FILTER (length(coalesce(text, '')) >= 80) AS text_pages, count(*) FILTER (length(coalesce(text, '')) = 0) AS blank_pages, count(*) FILTER (length(text) BETWEEN 1 AND 79) AS low_text_pages FROM parsed_pages GROUP BY pdf_id) SELECT *, round_even(text_pages / greatest(n_pages, 1), 3) AS quality, round_even(text_pages / greatest(n_pages, 1), 3) < 0.5 AS needs_ocr FROM g",
    "dedup_exact": f"WITH f AS (SELECT pdf_id, file_path, {_SHA} AS h FROM pdf_files), n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(h, 'path:' || file_path) ORDER BY file_path) - 1 AS n FROM f) SELECT pdf_id, CASE WHEN n = 0 THEN 'pdf_' || substr(h, 1, 16) ELSE 'pdf_' || substr(h, 1, 12) || '_' || n END AS new_pdf_id, 'paper_' || substr(h, 1, 16) AS new_paper_id, n > 0 AS is_dup, CASE WHEN n > 0 THEN 'pdf_' || substr(h, 1, 16) END AS dup_of FROM n",
    "manifest_stats": f"WITH g AS (SELECT {_SHA} AS h, count(*) AS c FROM pdf_files WHERE sha256 IS NOT NULL GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS files, count(*) AS contents, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM g",
    "pending_scan": "SELECT pdf_id, file_name, parse_status FROM pdf_files WHERE parse_status IN ('pending', 'manifested', 'manifest_error', 'parse_error') ORDER BY file_name, pdf_id",
    "split_text": f"{_CUT} SELECT page_id, CAST(i - 1 AS INT) AS piece, parts[i] AS text FROM (SELECT page_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM cut)",
    "chunk_documents": f"{_CUT}, k AS (SELECT *, list_filter(parts, lambda text: {section_sql('text')} <> 'references') AS p FROM cut), o AS (SELECT *, coalesce(sum(len(p)) OVER (PARTITION BY pdf_id ORDER BY page_number, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM k), x AS (SELECT paper_id, pdf_id, page_number, off, p, unnest(range(1, len(p) + 1)) AS i FROM o), y AS (SELECT paper_id, pdf_id, page_number, CAST(off + i - 1 AS INT) AS chunk_index, p[i] AS text FROM x) SELECT printf('%s_c%05d', pdf_id, chunk_index) AS chunk_id, paper_id, pdf_id, page_number, {section_sql('text')} AS section, chunk_index, text, length(text) AS char_count, {_WORDS} AS token_count, {_FLAGS} FROM y",
    "chunk_incremental": "SELECT page_id, pdf_id, page_number FROM parsed_pages p WHERE NOT EXISTS (SELECT 1 FROM document_chunks c WHERE c.pdf_id = p.pdf_id AND c.page_number = p.page_number)",
    "table_normalize": f"WITH f AS (SELECT DISTINCT fact_id, material, unit, raw_property_name, page_number FROM fact_hits), r AS (SELECT fact_id, page_number, list_filter([[{_CELL('material')}, {_CELL('raw_property_name')}], ['', ''], [{_CELL('unit')}, {_CELL(chr(39) + 'a ' + chr(39) + ' || page_number')}]], lambda x: len(list_filter(x, lambda y: y <> '')) > 0) AS rows FROM f) SELECT fact_id, page_number, len(rows) AS row_count, 2 AS col_count, array_to_string(list_transform(rows, lambda x: array_to_string(x, ' | ')), chr(10)) AS table_text FROM r",
    "clean_title": f"SELECT candidate_id, {clean_title_sql('title')} AS title FROM literature_candidates",
    "title_score": f"WITH c AS (SELECT paper_id, {clean_title_sql('title')} AS t FROM papers) SELECT paper_id, round(CAST({title_score_sql('t')} AS DOUBLE), 4) AS score FROM c",
    "title_repair": f"WITH c AS (SELECT p.paper_id, f.pdf_id, {clean_title_sql('p.title')} AS t, {clean_title_sql(file_title_sql('f.file_name'))} AS n FROM papers p JOIN pdf_files f USING (paper_id)), s AS (SELECT *, CAST({title_score_sql('t')} AS DOUBLE) AS old_score, CAST({title_score_sql('n')} AS DOUBLE) - 8 AS name_score FROM c) SELECT paper_id, pdf_id, round(old_score, 4) AS old_score, CASE WHEN old_score = 0 AND name_score >= 45 THEN n ELSE t END AS best_title, CASE WHEN old_score = 0 AND name_score >= 45 THEN 'filename' ELSE 'paper' END AS title_source FROM s",
    "distinct_counts": "SELECT count(DISTINCT pdf_id) AS pdfs, count(DISTINCT chunk_id) AS chunks, count(DISTINCT paper_id) AS papers FROM document_chunks WHERE is_high_value",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in TABLES),
    "corpus_summary": "SELECT dimension, value, count(*) AS n FROM (SELECT 'year' AS dimension, coalesce(CAST(nullif(year, 0) AS VARCHAR), 'unknown') AS value FROM papers " + " ".join(f"UNION ALL SELECT '{c}', coalesce({c}, 'unknown') FROM fact_hits" for c in ("review_status", "material_family", "property_name")) + ") GROUP BY 1, 2",
    "manifest_upsert": "WITH b AS (SELECT * FROM pdf_files WHERE batch_no <= 15), u AS (SELECT pdf_id, file_name, lower(sha256) AS sha256, file_size + 1 AS file_size FROM pdf_files WHERE batch_no >= 10) SELECT coalesce(b.pdf_id, u.pdf_id) AS pdf_id, coalesce(u.file_name, b.file_name) AS file_name, CASE WHEN u.pdf_id IS NULL THEN b.sha256 ELSE u.sha256 END AS sha256, CASE WHEN u.pdf_id IS NULL THEN b.file_size ELSE u.file_size END AS file_size, CASE WHEN b.pdf_id IS NULL THEN 'manifested' ELSE b.parse_status END AS parse_status FROM b FULL JOIN u ON b.pdf_id = u.pdf_id",
    "paper_metadata": f"{_META}, n AS (SELECT f.paper_id, min(m.doi) AS doi, min(m.year) AS year, min(m.title) AS title, min(m.paper_type) AS paper_type FROM m JOIN pdf_files f USING (pdf_id) WHERE f.paper_id IS NOT NULL GROUP BY 1) SELECT coalesce(p.paper_id, n.paper_id) AS paper_id, coalesce(n.doi, p.doi) AS doi, CASE WHEN p.paper_id IS NULL THEN n.title ELSE p.title END AS title, coalesce(n.year, p.year) AS year, coalesce(n.paper_type, p.paper_type) AS paper_type, coalesce(n.paper_type = 'review', p.is_review) AS is_review FROM papers p FULL JOIN n ON p.paper_id = n.paper_id",
}
