"""Queries on extraction candidates, model payloads, merged context, schema, tables, titles and review joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V
from corpusmill.operators import chunks, facts, files, payloads, titles
from corpusmill.sources import read_table as t

from . import fact_queries as fq
from .fact_queries import _F, _SAMPLE, _facts, _materials_sql, _props_sql
from .store_queries import TITLE_LAYOUT_SQL, title_spans
from .text_queries import _FLAGS, _WORDS, WS, clean_title_sql, q, title_score_sql

VERSION = "rules-1"


def _high(s, d):
    """What is extracted from: high-value chunks, and the facts' evidence sentences as chunks of their own."""
    c = t(s, d, "document_chunks", "chunk_id", "paper_id", "pdf_id", "page_number", "text", "is_high_value").where("is_high_value")
    e = t(s, d, "fact_hits", "fact_id", "paper_id", "page_number", "evidence_text").distinct().select(F.col("fact_id").alias("chunk_id"), "paper_id", F.lit(None).cast("string").alias("pdf_id"), "page_number", F.col("evidence_text").alias("text"), F.lit(True).alias("is_high_value"))
    return c.unionByName(e)


def extract_candidates(s, d):
    """A candidate for each high-value chunk, with the numbers of what was found; chunks without anything are marked empty."""
    c = payloads.candidates(_high(s, d), VERSION)
    return c.select("candidate_id", "chunk_id", "status", *[F.size(f"payload.{k}").alias(f"n_{k}") for k in ("materials", "samples", "phases", "properties", "devices")])


def extract_facts(s, d):
    f = payloads.facts_of(payloads.candidates(_high(s, d), VERSION))
    return f.select("fact_id", "candidate_id", "chunk_id", "place", "property_name", "value", "unit", "material", "material_family")


def extract_pending(s, d):
    """What a rerun has to do when the texts with a formula have candidates of this version, and all chunks have candidates of an older one."""
    c = _high(s, d)
    done = payloads.candidates(c.where(T.formula_flag(F.col("text"))), VERSION).select("chunk_id", "version").unionByName(payloads.candidates(c, "rules-0").select("chunk_id", "version"))
    return payloads.pending(c, done, VERSION).select("chunk_id")


def table_chunks(s, d):
    """Facts as small tables of their page, chunked behind the text chunks of the file."""
    f = t(s, d, "fact_hits", "fact_id", "paper_id", "page_number", "raw_property_name", "value", "unit", "material").where("paper_id is not null and page_number is not null").distinct()
    p = t(s, d, "papers", "paper_id", "source_pdf_id").where("source_pdf_id is not null").withColumnRenamed("source_pdf_id", "pdf_id")
    cells = F.array(F.array(F.lit("property"), F.lit(" value"), F.lit("unit\n")), F.array(F.lit(""), F.lit("  ")), F.array(F.col("raw_property_name"), F.col("material"), F.col("unit")))
    tables = files.table_rows(f.join(p, "paper_id").select("fact_id", "paper_id", "pdf_id", "page_number", cells.alias("cells")), ["fact_id"])
    text = t(s, d, "document_chunks", "pdf_id").groupBy("pdf_id").agg(F.count(F.lit(1)).alias("n"))
    return chunks.table_chunks(tables, text).drop("paper_id")


def _answers(s, d):
    """A model's answer for each fact, in one of three forms by its page: the schema's own keys, other keys with a list of facts, single values."""
    f = t(s, d, "fact_hits", "fact_id", "page_number", "material", "property_name", "raw_property_name", "value", "unit", "evidence_text").distinct()
    v = F.coalesce(F.col("page_number"), F.lit(0)) % 3
    a = F.struct(F.array(F.struct(F.col("material").alias("raw_name"), F.lit("HfO2").alias("material_family"))).alias("materials"), F.array(F.struct("property_name", "raw_property_name", "value", "unit", "evidence_text")).alias("properties"))
    b = F.struct(F.struct(F.col("material").alias("material_name"), F.lit(" 12.5 nm").alias("thickness_nm"), F.array(F.lit("La"), F.lit(" ")).alias("dopants")).alias("material"), F.array(F.struct(F.col("property_name").alias("metric"), F.concat(F.lit("about "), F.col("value").cast("decimal(30,3)").cast("string")).alias("raw_value"), F.col("unit").alias("raw_unit"))).alias("facts"), F.struct(F.lit("Pca21").alias("space_group")).alias("phase"), F.lit("check it").alias("notes"))
    c = F.struct(F.col("material").alias("materials"), F.struct(F.lit("coercive field").alias("name"), F.col("value"), F.lit("kV/cm").alias("unit"), F.lit(7).alias("confidence")).alias("measurements"), F.array(F.struct(F.lit("FeFET").alias("type"), F.lit(1).alias("n")), F.struct(F.lit("").alias("type"), F.lit(2).alias("n"))).alias("devices"))
    js = F.when(v == 0, F.to_json(a)).when(v == 1, F.to_json(b)).otherwise(F.to_json(c))
    return f.select("fact_id", v.alias("form"), F.col("evidence_text").alias("text"), F.concat(F.lit("Sure:\n"), js, F.lit("\nthat is all")).alias("json"))


def coerce_payload(s, d):
    """The answers in one form: what each names first, and how much of each kind."""
    p = payloads.coerce_payload(_answers(s, d))
    m, pr, sm = (F.get(f"payload.{k}", F.lit(0)) for k in ("materials", "properties", "samples"))
    return p.select(
        "fact_id", F.col("payload.material_ref").alias("material_ref"), m["family"].alias("family"), F.array_join(m["dopants"], ",").alias("dopants"), pr["property_name"].alias("property_name"), (F.round(pr["value"], 3) + 0.0).alias("value"), pr["normalized_unit"].alias("unit"), pr["confidence"].alias("confidence"),
        sm["film_thickness_nm"].alias("thickness"), F.get("payload.phases", F.lit(0))["phase_name"].alias("phase"), F.array_join("payload.devices", ",").alias("devices"), F.array_join("payload.warnings", ",").alias("warnings"), F.when(F.col("form") < 2, pr["evidence"]).alias("evidence"),
    )


def enrich_facts(s, d):
    """Facts completed from the chunk of their page (as candidate) and from the whole of the file's longest chunk (as rules)."""
    f = facts.with_context(_facts(s, d)).select("fact_id", "paper_id", "page_number", "material", "sample", "phases", "devices")
    c = t(s, d, "document_chunks", "paper_id", "page_number", "chunk_id", "text")
    one = c.groupBy("paper_id", "page_number").agg(F.min_by("text", "chunk_id").alias("text"))
    big = c.groupBy("paper_id").agg(F.max_by("text", F.struct(F.char_length("text"), "chunk_id")).alias("text"))
    pay = lambda x, name: payloads.extract_chunks(x).drop("text").withColumnRenamed("payload", name)
    j = f.join(pay(one, "candidate"), ["paper_id", "page_number"], "left").join(pay(big, "chunk"), "paper_id", "left")
    m = payloads.merge_context(j, "candidate", "chunk")
    return m.select("fact_id", "material", "sample.film_thickness_nm", "sample.deposition_method", "sample.top_electrode", "sample.device_stack", F.array_join(F.array_sort(F.transform("phases", lambda p: p["phase_name"])), ",").alias("phases"), F.array_join(F.array_sort("devices"), ",").alias("devices"), "sources")


def schema_validate(s, d):
    return payloads.schema_problems(t(s, d, "fact_hits", "fact_id", "paper_id", "evidence_text", "property_name", "value", "unit", "material_family").distinct())


def title_best(s, d):
    """The best title of each paper and file by tiers: by DOI from the literature records, by layout of the first page, from the file's metadata (the paper's first title), from its name."""
    p, f = t(s, d, "papers", "paper_id", "title", "doi"), t(s, d, "pdf_files", "pdf_id", "paper_id", "file_name")
    lit = t(s, d, "literature_candidates", "doi", "title").select(T.resolver_doi(F.col("doi")).alias("d"), "title").where("d is not null and title is not null").groupBy("d").agg(F.min("title").alias("doi_title"))
    lay = files.layout_titles(title_spans(s, d)).join(t(s, d, "parsed_pages", "page_id", "pdf_id"), "page_id").groupBy("pdf_id").agg(F.min_by(F.struct("title", "size"), "page_id").alias("l")).select("pdf_id", F.col("l.title").alias("layout_title"), F.col("l.size").alias("layout_size"))
    j = p.join(f, "paper_id").withColumn("d", T.resolver_doi(F.col("doi"))).join(lit, "d", "left").join(lay, "pdf_id", "left")
    return titles.best(j).select("paper_id", "pdf_id", "new_title", "source", "score", "changed")


def fact_details(s, d):
    """Facts with paper and file, orphans kept: what a review list shows."""
    p = t(s, d, "papers", "paper_id", "title", "doi", "year", "source_pdf_id").withColumnRenamed("title", "paper_title")
    f = t(s, d, "pdf_files", "pdf_id", "file_name", "page_count")
    x = t(s, d, "fact_hits", "fact_id", "paper_id", "property_name", "value", "unit", "review_status").distinct()
    return x.join(p, "paper_id", "left").join(f, F.col("source_pdf_id") == F.col("pdf_id"), "left").select("fact_id", "paper_id", "property_name", "value", "unit", "review_status", "paper_title", "year", "file_name", "page_count")


def fact_lookup(s, d):
    """One fact by its identifier (the least of all), with its paper: a point lookup that is pushed into the scan."""
    one = t(s, d, "fact_hits", "fact_id").agg(F.min("fact_id")).first()[0]
    x = t(s, d, "fact_hits", "fact_id", "paper_id", "property_name", "value").where(F.col("fact_id") == F.lit(one)).distinct()
    return x.join(t(s, d, "papers", "paper_id", "title"), "paper_id", "left").select("fact_id", "paper_id", "property_name", "value", "title")


def chunk_papers(s, d):
    c = t(s, d, "document_chunks", "chunk_id", "paper_id", "page_number", "is_high_value").where("is_high_value").drop("is_high_value")
    return c.join(t(s, d, "papers", "paper_id", "title", "year"), "paper_id", "left").select("chunk_id", "paper_id", "page_number", "title", "year")


def parse_status(s, d):
    """The manifest after parsing: page counts and quality of files with pages, parsed where a page has text, parse_error where none has; others stay as they are."""
    base = t(s, d, "pdf_files", "pdf_id", "page_count", "text_page_count", "blank_page_count", "parse_status", "parse_quality_score", "error_message")
    return files.with_parse_result(base, files.page_quality(t(s, d, "parsed_pages", "pdf_id", "text")))


QUERIES = {f.__name__: f for f in (extract_candidates, extract_facts, extract_pending, table_chunks, coerce_payload, enrich_facts, schema_validate, title_best, fact_details, fact_lookup, chunk_papers, parse_status)}


# SQL

_HIGH = "f AS (SELECT chunk_id AS fact_id, coalesce(text, '') AS evidence_text FROM document_chunks WHERE is_high_value UNION ALL SELECT fact_id, coalesce(evidence_text, '') FROM (SELECT DISTINCT fact_id, paper_id, page_number, evidence_text FROM fact_hits))"
_sid = lambda prefix, *parts: f"('{prefix}' || substr(sha1({' || chr(124) || '.join(parts)}), 1, 16))"
_CAND = f"""{_HIGH}, {_props_sql()}, {_materials_sql().replace('x AS', 'mt AS', 1)}, {_SAMPLE},
pn AS (SELECT fact_id, count(*) AS n FROM x GROUP BY 1), mn AS (SELECT fact_id, count(*) AS n, arg_min(canonical_name, o) AS name, arg_min(family, o) AS fam FROM mt GROUP BY 1),
cn AS (SELECT ctx.fact_id, coalesce(mn.n, 0)::INT AS n_materials, has_sample::INT AS n_samples, len(phases)::INT AS n_phases, coalesce(pn.n, 0)::INT AS n_properties, len(devices)::INT AS n_devices, mn.name, mn.fam FROM ctx LEFT JOIN pn USING (fact_id) LEFT JOIN mn USING (fact_id)),
cd AS (SELECT *, n_materials + n_samples + n_phases + n_properties + n_devices > 0 AS found FROM cn), cs AS (SELECT CASE WHEN found THEN {_sid('cand_', 'fact_id', q(VERSION))} ELSE {_sid('cand_empty_', 'fact_id', q(VERSION))} END AS candidate_id, fact_id AS chunk_id, CASE WHEN found THEN 'extracted' ELSE 'empty_result' END AS status, * EXCLUDE (fact_id) FROM cd)"""
_TABLES = f"""tf AS (SELECT DISTINCT fact_id, paper_id, page_number, raw_property_name, value, unit, material FROM fact_hits WHERE paper_id IS NOT NULL AND page_number IS NOT NULL), tp AS (SELECT tf.*, source_pdf_id AS pdf_id, row_number() OVER (PARTITION BY source_pdf_id, page_number ORDER BY fact_id) AS table_index FROM tf JOIN papers USING (paper_id) WHERE source_pdf_id IS NOT NULL),
tt AS (SELECT *, 'Table ' || table_index || ' on page ' || page_number || chr(10) || 'property | value | unit' || CASE WHEN {' AND '.join(f"trim(regexp_replace(coalesce({c}, ''), '{chr(92)}s+', ' ', 'g'), {WS}) = ''" for c in ('raw_property_name', 'material', 'unit'))} THEN '' ELSE chr(10) || array_to_string([{', '.join(f"trim(regexp_replace(coalesce({c}, ''), '{chr(92)}s+', ' ', 'g'), {WS})" for c in ('raw_property_name', 'material', 'unit'))}], ' | ') END AS text FROM tp),
tn AS (SELECT pdf_id, count(*) AS n FROM document_chunks GROUP BY 1)"""
_V3 = "coalesce(page_number, 0) % 3"
_PN = "(" + ", ".join(q(x) for x in V.PROPERTY_NAMES) + ")"


def _alias_sql(r: str) -> str:
    return f"CASE WHEN contains({r}, '2pr') OR contains({r}, 'double remanent') THEN 'double_remanent_polarization_2Pr' WHEN {r} = 'pr' OR contains({r}, 'remanent polarization') THEN 'remanent_polarization_Pr' WHEN {r} = 'ec' OR contains({r}, 'coercive') THEN 'coercive_field_Ec' WHEN contains({r}, 'memory window') THEN 'memory_window' WHEN contains({r}, 'endurance') THEN 'endurance_cycles' WHEN contains({r}, 'retention') THEN 'retention_time' WHEN contains({r}, 'leakage') THEN 'leakage_current_density' END"


def _infer_sql(ev: str, prop: str) -> str:
    return f"CASE WHEN regexp_matches({ev}, '(?i)(?:μ|µ|u)\\s*C\\s*/?\\s*cm(?:\\^?2|²|−2|-2)') THEN 'μC/cm²' WHEN regexp_matches({ev}, '(?i)\\bkV\\s*/?\\s*cm\\b') THEN 'kV/cm' WHEN regexp_matches({ev}, '(?i)\\bMV\\s*/?\\s*cm\\b') THEN 'MV/cm' WHEN contains(lower({ev}), 'cycles') OR {prop} = 'endurance_cycles' THEN 'cycles' WHEN {prop} = 'memory_window' AND regexp_matches({ev}, '(?i)\\bV\\b') THEN 'V' END"


def _fam_sql(v: str) -> str:
    low = f"lower({v})"
    return f"CASE WHEN contains({low}, 'hzo') OR contains({low}, 'zr') THEN 'HZO' WHEN contains({low}, 'si') THEN 'Si:HfO2' WHEN contains({low}, 'al') THEN 'Al:HfO2' WHEN contains({low}, 'la') THEN 'La:HfO2' WHEN contains({low}, 'y:') OR starts_with({low}, 'y') OR contains({low}, ' y-') THEN 'Y:HfO2' WHEN contains({low}, 'gd') THEN 'Gd:HfO2' WHEN contains({low}, 'sr') THEN 'Sr:HfO2' WHEN regexp_matches({low}, 'hfo2|hafnia|hafnium') THEN 'HfO2' ELSE 'unknown_hafnia' END"


def _needle_sql(n: str) -> str:
    """The sentence of the needle in tx, or null."""
    at = f"strpos(lower(tx), lower({n}))"
    after = f"substr(tx, CAST({at} + length({n}) AS BIGINT))"
    stop = f"regexp_extract({after}, '^[^.\\n]*[.\\n]', 0)"
    return f"CASE WHEN {n} <> '' AND {at} > 0 THEN substr(trim(regexp_replace(regexp_extract(substr(tx, 1, CAST({at} - 1 AS BIGINT)), '[^.\\n]*$', 0) || substr(tx, CAST({at} AS BIGINT), length({n})) || CASE WHEN {stop} <> '' THEN {stop} ELSE substr({after}, 1, 260) END, '\\s+', ' ', 'g'), {WS}), 1, 700) END"


_TIDY = f"substr(trim(regexp_replace(substr(tx, 1, 700), '\\s+', ' ', 'g'), {WS}), 1, 700)"
_DEC = "CAST(CAST(value AS DECIMAL(30,3)) AS VARCHAR)"
# the value as the model's JSON shows it in form 0 and 2 isn't reproduced here: these forms' needles are the property's name, or their evidence is explicit
_COERCE = f"""a AS (SELECT DISTINCT fact_id, page_number, material, property_name, raw_property_name, value, unit, evidence_text FROM fact_hits), b AS (SELECT *, {_V3} AS form, coalesce(evidence_text, '') AS tx, nullif(material, '') AS mat FROM a),
e AS (SELECT *, CASE form WHEN 0 THEN coalesce(substr(nullif(trim(evidence_text, {WS}), ''), 1, 700), {_needle_sql("coalesce(raw_property_name, property_name, '')")}, {_TIDY}) WHEN 1 THEN coalesce({_needle_sql("coalesce(property_name, '')")}, {_TIDY}) ELSE coalesce({_needle_sql("'coercive field'")}, {_TIDY}) END AS ev,
 CASE form WHEN 0 THEN CASE WHEN property_name IN {_PN} THEN property_name ELSE {_alias_sql(f"lower(trim(coalesce(raw_property_name, property_name, ''), {WS}))")} END WHEN 1 THEN {_alias_sql(f"lower(trim(coalesce(property_name, ''), {WS}))")} ELSE 'coercive_field_Ec' END AS pname FROM b),
u AS (SELECT *, CASE form WHEN 2 THEN 'kV/cm' ELSE coalesce(nullif(trim(unit, {WS}), ''), {_infer_sql('ev', 'pname')}) END AS un, CASE form WHEN 1 THEN CAST({_DEC} AS DOUBLE) ELSE value END AS val FROM e),
k AS (SELECT *, pname IS NOT NULL AND (val IS NULL OR un IS NOT NULL) AS has FROM u)"""
_DOP = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(mat || ' ' || mat, '(?i)\\b{e}\\b') THEN '{e}' END" for e in ("Zr", "Si", "Al", "La", "Y", "Gd", "Sr")) + "], lambda x: x IS NOT NULL), ',')"


def _context_sql(source: str) -> str:
    mats = " UNION ALL ".join(f"SELECT fact_id, {i} AS o, {q(n)} AS canonical_name FROM f WHERE regexp_matches(evidence_text, {q('(?i)' + p)})" for i, (p, n, *_) in enumerate(V.MATERIALS))
    return f"(WITH {source}, {_SAMPLE}, mm AS ({mats}), m1 AS (SELECT fact_id, arg_min(canonical_name, o) AS mname FROM mm GROUP BY 1) SELECT ctx.fact_id, film_thickness_nm, deposition_method, annealing_temperature_c, top_electrode, bottom_electrode, substrate, device_stack, sample_form, list_transform(phases, lambda p: p.phase_name) AS ph, devices AS dv, mname FROM ctx LEFT JOIN m1 USING (fact_id))"


_FIELDS = payloads.SAMPLE_FIELDS
_ENRICH = f"""o AS {_context_sql(_F)}, one AS (SELECT paper_id, page_number, arg_min(text, chunk_id) AS text FROM document_chunks WHERE text IS NOT NULL GROUP BY 1, 2), c1 AS {_context_sql("f AS (SELECT paper_id || '|' || coalesce(CAST(page_number AS VARCHAR), 'x') AS fact_id, text AS evidence_text FROM (SELECT paper_id, page_number, arg_min(text, chunk_id) AS text FROM document_chunks GROUP BY 1, 2))")},
c2 AS {_context_sql("f AS (SELECT paper_id AS fact_id, arg_max(text, {'n': length(text), 'c': chunk_id}) AS evidence_text FROM document_chunks GROUP BY 1)")},
j AS (SELECT f.fact_id, nullif(trim(f.material), '') AS fm, c1.mname AS m1, c2.mname AS m2, {', '.join(f'o.{k} AS a_{k}, c1.{k} AS b_{k}, c2.{k} AS c_{k}' for k in _FIELDS)}, coalesce(o.ph, []) AS ap, coalesce(c1.ph, []) AS bp, coalesce(c2.ph, []) AS cp, coalesce(o.dv, []) AS ad, coalesce(c1.dv, []) AS bd, coalesce(c2.dv, []) AS cdv FROM f JOIN o USING (fact_id) LEFT JOIN c1 ON c1.fact_id = f.paper_id || '|' || f.page_number LEFT JOIN c2 ON c2.fact_id = f.paper_id),
g AS (SELECT *, CASE WHEN len(ap) > 0 THEN ap ELSE bp END AS p1, CASE WHEN len(ad) > 0 THEN ad ELSE bd END AS d1 FROM j), h AS (SELECT *, list_filter(cp, lambda x: NOT list_contains(p1, x)) AS np, list_filter(cdv, lambda x: NOT list_contains(d1, x)) AS nd FROM g)"""

_SC = "list_filter([CASE WHEN paper_id IS NULL THEN {'field': 'paper_id', 'reason': 'missing'} END, CASE WHEN length(coalesce(evidence_text, '')) < 8 THEN {'field': 'evidence_text', 'reason': 'too_short'} END, CASE WHEN NOT coalesce(property_name IN " + _PN + ", false) THEN {'field': 'property_name', 'reason': 'not_in_schema'} END, CASE WHEN value IS NOT NULL AND coalesce(unit, '') = '' THEN {'field': 'unit', 'reason': 'required_with_value'} END, CASE WHEN material_family IS NOT NULL AND material_family NOT IN " + fq._FAMS + " THEN {'field': 'material_family', 'reason': 'not_in_schema'} END], lambda x: x IS NOT NULL)"
_DOI_S = f"nullif(trim(regexp_replace(lower(trim(doi, {WS})), '^https?://(dx\\.)?doi\\.org/', ''), {WS}), '')"
_NAME_PARTS = "list_filter(list_filter(regexp_split_to_array(regexp_replace(file_name, '\\.[^.]*$', ''), '[_\\s]+'), lambda x: x <> ''), lambda x: NOT regexp_full_match(x, '20[12]\\d'))"
_DROP = "len(list_filter(np, lambda x, i: len(list_filter(np[1:i], lambda y: lower(y) NOT IN (" + ", ".join(q(x) for x in titles.SOURCE_TOKENS) + "))) = 0))"
_TIERS = f"""n0 AS (SELECT p.paper_id, f.pdf_id, p.title AS old, {_DOI_S.replace('doi,', 'p.doi,')} AS dkey, file_name, {_NAME_PARTS} AS np FROM papers p JOIN pdf_files f USING (paper_id)), n1 AS (SELECT *, array_to_string(np[{_DROP} + 1:], ' ') AS raw_name FROM n0),
lit AS (SELECT {_DOI_S} AS d, min(title) AS doi_title FROM literature_candidates WHERE title IS NOT NULL GROUP BY 1), lay0 AS ({TITLE_LAYOUT_SQL}), lay AS (SELECT pdf_id, arg_min(l.title, l.page_id) AS layout_title, arg_min(l.size, l.page_id) AS layout_size FROM lay0 l JOIN parsed_pages USING (page_id) GROUP BY 1),
n2 AS (SELECT n1.*, {clean_title_sql('doi_title')} AS t1, {clean_title_sql('layout_title')} AS t2, layout_size, {clean_title_sql("old")} AS t0, {clean_title_sql('raw_name')} AS t4 FROM n1 LEFT JOIN lit ON d = dkey LEFT JOIN lay USING (pdf_id)),
n3 AS (SELECT *, {title_score_sql('t0')}::DOUBLE AS s0, {title_score_sql('t1')}::DOUBLE AS r1, {title_score_sql('t2')}::DOUBLE AS r2, {title_score_sql('t4')}::DOUBLE AS r4 FROM n2), n4 AS (SELECT *, CASE WHEN r1 > 0 THEN r1 + 25 END AS s1, CASE WHEN r2 > 0 THEN r2 + layout_size END AS s2, CASE WHEN r4 > 0 THEN r4 - 8 END AS s4 FROM n3),
n5 AS (SELECT *, CASE WHEN s1 >= 45 THEN 'doi' WHEN s2 >= 45 THEN 'layout' WHEN s4 IS NOT NULL THEN 'filename' ELSE 'current' END AS source FROM n4), n6 AS (SELECT *, CASE source WHEN 'doi' THEN t1 WHEN 'layout' THEN t2 WHEN 'filename' THEN t4 ELSE coalesce(t0, '') END AS new_title, CASE source WHEN 'doi' THEN s1 WHEN 'layout' THEN s2 WHEN 'filename' THEN s4 ELSE s0 END AS score FROM n5)"""

SQL = {
    "extract_candidates": f"WITH {_CAND} SELECT candidate_id, chunk_id, status, n_materials, n_samples, n_phases, n_properties, n_devices FROM cs",
    "extract_facts": f"WITH {_CAND}, xp AS (SELECT fact_id AS chunk_id, property_name, value, unit, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY o, j) - 1 AS INT) AS place FROM x) SELECT {_sid('fact_', 'candidate_id', 'CAST(place AS VARCHAR)')} AS fact_id, candidate_id, chunk_id, place, property_name, value, unit, name AS material, fam AS material_family FROM xp JOIN cs USING (chunk_id)",
    "extract_pending": f"WITH {_HIGH} SELECT fact_id AS chunk_id FROM f WHERE NOT regexp_matches(evidence_text, {q(V.FORMULA)})",
    "table_chunks": f"WITH {_TABLES}, z AS (SELECT printf('%s_table_p%04d_%03d', pdf_id, page_number, table_index) AS chunk_id, pdf_id, page_number, 'table' AS section, CAST(coalesce(n, 0) + row_number() OVER (PARTITION BY pdf_id ORDER BY page_number, table_index) - 1 AS INT) AS chunk_index, text, length(text) AS char_count, true AS contains_table FROM tt LEFT JOIN tn USING (pdf_id)) SELECT *, {_WORDS} AS token_count, {_FLAGS} FROM z",
    "coerce_payload": f"WITH {_COERCE} SELECT fact_id, coalesce(mat, 'HfO2') AS material_ref, CASE WHEN mat IS NULL THEN NULL WHEN form = 0 THEN 'HfO2' WHEN form = 1 THEN {_fam_sql("mat || ' ' || mat || ' La'")} ELSE {_fam_sql("mat || ' ' || mat")} END AS family, CASE WHEN mat IS NULL THEN NULL WHEN form = 1 THEN 'La' ELSE {_DOP} END AS dopants, CASE WHEN has THEN pname END AS property_name, CASE WHEN has THEN round(val, 3) + 0.0::DOUBLE END AS value, CASE WHEN has THEN {fq._unit_sql('un')} END AS unit, CASE WHEN has THEN CASE form WHEN 2 THEN 1.0 ELSE 0.55 END END::DOUBLE AS confidence, CASE form WHEN 1 THEN 12.5::DOUBLE END AS thickness, CASE form WHEN 1 THEN 'orthorhombic' END AS phase, CASE form WHEN 2 THEN 'FeFET' ELSE '' END AS devices, CASE form WHEN 1 THEN 'check it' ELSE '' END AS warnings, CASE WHEN has AND form < 2 THEN ev END AS evidence FROM k",
    "enrich_facts": f"WITH {_F}, {_ENRICH} SELECT fact_id, coalesce(fm, m1, m2) AS material, {', '.join(f'coalesce(a_{k}, b_{k}, c_{k}) AS {k}' for k in ('film_thickness_nm', 'deposition_method', 'top_electrode', 'device_stack'))}, array_to_string(list_sort(list_concat(p1, np)), ',') AS phases, array_to_string(list_sort(list_concat(d1, nd)), ',') AS devices, array_to_string(list_filter([CASE WHEN (fm IS NULL AND m1 IS NOT NULL) OR {' OR '.join(f'(a_{k} IS NULL AND b_{k} IS NOT NULL)' for k in _FIELDS)} OR len(p1) <> len(ap) OR len(d1) <> len(ad) THEN 'candidate' END, CASE WHEN (coalesce(fm, m1) IS NULL AND m2 IS NOT NULL) OR {' OR '.join(f'(coalesce(a_{k}, b_{k}) IS NULL AND c_{k} IS NOT NULL)' for k in _FIELDS)} OR len(np) > 0 OR len(nd) > 0 THEN 'chunk' END, 'fact'], lambda x: x IS NOT NULL), ',') AS sources FROM h",
    "schema_validate": f"SELECT fact_id, r.field AS field, r.reason AS reason FROM (SELECT fact_id, unnest({_SC}) AS r FROM (SELECT DISTINCT fact_id, paper_id, evidence_text, property_name, value, unit, material_family FROM fact_hits))",
    "title_best": f"WITH {_TIERS} SELECT paper_id, pdf_id, new_title, source, round(score, 2) AS score, source <> 'current' AND coalesce(old, '') <> new_title AND (source <> 'filename' OR s0 = 0) AND score >= 45 AND (s0 = 0 OR source = 'doi' OR score >= s0 + 8) AS changed FROM n6",
    "fact_details": "SELECT f.fact_id, f.paper_id, f.property_name, f.value, f.unit, f.review_status, p.title AS paper_title, p.year, x.file_name, x.page_count FROM (SELECT DISTINCT fact_id, paper_id, property_name, value, unit, review_status FROM fact_hits) f LEFT JOIN papers p ON p.paper_id = f.paper_id LEFT JOIN pdf_files x ON x.pdf_id = p.source_pdf_id",
    "fact_lookup": "SELECT DISTINCT f.fact_id, f.paper_id, f.property_name, f.value, p.title FROM fact_hits f LEFT JOIN papers p ON p.paper_id = f.paper_id WHERE f.fact_id = (SELECT min(fact_id) FROM fact_hits)",
    "chunk_papers": "SELECT c.chunk_id, c.paper_id, c.page_number, p.title, p.year FROM document_chunks c LEFT JOIN papers p ON p.paper_id = c.paper_id WHERE c.is_high_value",
    "parse_status": "WITH g AS (SELECT pdf_id, count(*) AS n, count(*) FILTER (length(coalesce(text, '')) >= 80) AS tp, count(*) FILTER (length(coalesce(text, '')) = 0) AS bp FROM parsed_pages GROUP BY 1) SELECT f.pdf_id, coalesce(g.n, f.page_count) AS page_count, coalesce(g.tp, f.text_page_count) AS text_page_count, coalesce(g.bp, f.blank_page_count) AS blank_page_count, CASE WHEN g.pdf_id IS NULL THEN f.parse_status WHEN tp > 0 THEN 'parsed' ELSE 'parse_error' END AS parse_status, CASE WHEN g.pdf_id IS NULL THEN f.parse_quality_score ELSE round_even(tp / greatest(n, 1), 3) END AS parse_quality_score, CASE WHEN g.pdf_id IS NULL THEN f.error_message WHEN tp > 0 THEN NULL ELSE 'no page has text' END AS error_message FROM pdf_files f LEFT JOIN g ON g.pdf_id = f.pdf_id",
}
