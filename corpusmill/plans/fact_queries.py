"""Queries on facts: normalisation, extraction, context, graph, validation, statistics; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V
from corpusmill.functions.units import alias_values_sql, power_sql, reduce_unit_sql
from corpusmill.operators import convert, facts, graph
from corpusmill.sources import read_table as t

from .text_queries import WS, any_sql, q


def _facts(s: SparkSession, d: str) -> DataFrame:
    """Facts without the repeated deliveries, which are equal in every column."""
    return t(s, d, "fact_hits", "fact_id", "paper_id", "title", "page_number", "material", "material_family", "property_name", "raw_property_name", "value", "unit", "evidence_text", "context_quality", "review_status").distinct()


def _context(s, d):
    return facts.with_context(_facts(s, d))


def unit_normalize(s, d):
    f = t(s, d, "fact_hits", "fact_id", "unit").distinct()
    return f.select("fact_id", "unit", facts.normalize_unit(F.col("unit")).alias("normalized_unit"))


def property_alias(s, d):
    return t(s, d, "fact_hits", "fact_id", "raw_property_name").distinct().select("fact_id", facts.property_alias(F.col("raw_property_name")).alias("found_property"))


def material_normalize(s, d):
    m = facts.material_name(F.col("material"))
    return t(s, d, "fact_hits", "fact_id", "material").distinct().where("material is not null").select("fact_id", m["name"].alias("name"), m["family"].alias("family"))


def property_normalize(s, d):
    return facts.normalize_property(t(s, d, "fact_hits", "fact_id", "property_name", "value", "unit").distinct()).select("fact_id", "normalized_unit", "normalized_value", "warnings", "needs_check")


def parse_numeric(s, d):
    return t(s, d, "fact_hits", "fact_id", "evidence_text").distinct().select("fact_id", facts.parse_numeric(F.col("evidence_text")).alias("first_number"))


def safe_float(s, d):
    return t(s, d, "fact_hits", "fact_id", "value", "unit").distinct().select("fact_id", facts.safe_float(F.col("value")).alias("number"), facts.safe_float(F.col("unit")).alias("unit_number"))


def unit_guard(s, d):
    return t(s, d, "fact_hits", "fact_id", "property_name", "unit").distinct().select("fact_id", facts.unit_fits(F.col("property_name"), F.col("unit")).alias("fits"))


def extract_properties(s, d):
    p = facts.properties(F.col("evidence_text"))
    return _facts(s, d).select("fact_id", F.posexplode(p).alias("place", "p")).select("fact_id", "place", "p.property_name", "p.raw_name", "p.value", "p.unit")


def extract_materials(s, d):
    return _facts(s, d).select("fact_id", F.posexplode(facts.materials(F.col("evidence_text"))).alias("place", "m")).select("fact_id", "place", "m.canonical_name", "m.family", "m.raw_name")


def extract_phases(s, d):
    c = t(s, d, "document_chunks", "chunk_id", "text")
    return c.select("chunk_id", F.explode(facts.phases(F.col("text"))).alias("p")).select("chunk_id", "p.phase_name", "p.space_group")


def extract_devices(s, d):
    return t(s, d, "document_chunks", "chunk_id", "text").select("chunk_id", F.explode(facts.devices(F.col("text"))).alias("device_type"))


def extract_samples(s, d):
    return _facts(s, d).select("fact_id", facts.sample(F.col("evidence_text")).alias("s")).where("s is not null").select("fact_id", "s.*")


def extract_mentions(s, d):
    return facts.mentions(t(s, d, "document_chunks", "chunk_id", "text"), "chunk_id", "text")


def extract_stats(s, d):
    f = _facts(s, d).select(F.size(facts.properties(F.col("evidence_text"))).alias("p"), F.size(facts.materials(F.col("evidence_text"))).alias("m"))
    return f.agg(F.count(F.lit(1)).alias("texts"), F.sum("p").alias("properties"), F.sum("m").alias("materials"), F.count_if((F.col("p") == 0) & (F.col("m") == 0)).alias("empty"))


def evidence_window(s, d):
    c = t(s, d, "document_chunks", "chunk_id", "text")
    return c.select("chunk_id", facts.evidence(F.col("text"), "(?i)remanent polarization").alias("evidence")).where("evidence is not null")


def credible_stack(s, d):
    return _context(s, d).where("sample.device_stack is not null").select("fact_id", F.col("sample.device_stack").alias("device_stack"), "stack")


def measurement_state(s, d):
    w, e = facts.measurement_state(F.col("evidence_text"), F.col("property_name"))
    return t(s, d, "fact_hits", "fact_id", "evidence_text", "property_name").select("fact_id", w.alias("wake_up_state"), e.alias("endurance_state")).distinct()  # copies are dropped from the narrow rows


def ontology_context(s, d):
    return facts.with_context(t(s, d, "fact_hits", "fact_id", "evidence_text")).select("fact_id", "score", "quality", "comparison_ready", F.array_join("missing", ",").alias("missing"), "process_summary").distinct()


def relation_completion(s, d):
    """fact_id, relation, target, ready: what each fact's relations would point to."""
    c = _context(s, d)
    name = F.coalesce(F.nullif(F.trim("material"), F.lit("")), F.lit("unknown material"))
    dev = F.array_join(graph.device_types(c), ", ")
    ph = F.array_join(F.concat(F.transform("phases", lambda p: p["phase_name"]), F.array_distinct(F.array_compact(F.transform("phases", lambda p: p["space_group"])))), ", ")
    sample = F.coalesce("stack", "sample.sample_form", F.concat(name, F.lit(" sample")))
    pairs = [("REPORTS", name), ("HAS_SAMPLE", sample), ("FABRICATED_BY", F.col("process_summary")), ("HAS_PHASE", ph), ("USED_IN", dev), ("HAS_PROPERTY", F.col("property_name")), ("SUPPORTED_BY", F.col("evidence_text"))]
    rows = F.array(*[F.struct(F.lit(r).alias("relation"), v.cast("string").alias("target")) for r, v in pairs])
    return c.select("fact_id", F.explode(rows).alias("r")).select("fact_id", "r.relation", F.coalesce("r.target", F.lit("")).alias("target"), (F.trim(F.coalesce("r.target", F.lit(""))) != "").alias("ready"))


def enrich_stats(s, d):
    return _context(s, d).groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_if("comparison_ready").alias("ready"), F.round(F.avg(F.col("context_points").cast("double")), 6).alias("mean_points"))


def kg_nodes(s, d):
    return graph.nodes(_context(s, d))


def kg_edges(s, d):
    return graph.edges(_context(s, d))


def kg_triples(s, d):
    return graph.edges(_context(s, d)).select(F.col("source").alias("head"), F.col("type").alias("relation"), F.col("target").alias("tail"))


def graph_summary(s, d):
    c = _context(s, d)
    n = graph.nodes(c).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(graph.edges(c).groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def graph_neighbors(s, d):
    return graph.neighbours(graph.edges(_context(s, d)))


def graph_layout(s, d):
    return graph.layout(graph.nodes(_context(s, d))).withColumn("y", F.round("y", 4))


def graph_search(s, d):
    """Nodes that hold the words asked for, by type, with their neighbours' number: what a graph view looks up."""
    c = _context(s, d)
    return graph.search(graph.nodes(c), graph.edges(c), "hfo2", ["HafniaMaterial", "ThinFilmSample"])


def quality_counts(s, d):
    f = _facts(s, d)
    unit = F.concat(F.col("property_name"), F.lit(" | "), F.coalesce(F.trim("unit"), F.lit("")))
    cols = {"property": F.col("property_name"), "property_unit": unit, "family": F.nullif(F.trim(F.coalesce("material_family", F.lit(""))), F.lit("")), "status": F.col("review_status")}
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), F.coalesce(v, F.lit("unknown")).alias("value")) for k, v in cols.items()])
    return f.select(F.explode(rows).alias("r")).groupBy("r.dimension", "r.value").agg(F.count(F.lit(1)).alias("n"))


def domain_anomalies(s, d):
    return facts.anomalies(t(s, d, "fact_hits", "fact_id", "property_name", "value", "evidence_text")).distinct()


def missing_trace(s, d):
    f = t(s, d, "fact_hits", "fact_id", "evidence_text", "page_number", "paper_id")
    return f.where((F.trim(F.coalesce("evidence_text", F.lit(""))) == "") | F.col("page_number").isNull() | F.col("paper_id").isNull()).select("fact_id", F.col("page_number").isNull().alias("no_page"), F.col("paper_id").isNull().alias("no_paper")).distinct()


def range_stats(s, d):
    return facts.range_stats(t(s, d, "fact_hits", "fact_id", "property_name", "context_quality", "value", "unit").distinct(), ["property_name", "context_quality"])


def _checks(s, d):
    """The validators' rows; the copies of facts are dropped from these narrow rows, not from the texts."""
    f = t(s, d, "fact_hits", "fact_id", "paper_id", "page_number", "material", "material_family", "property_name", "value", "unit", "evidence_text", "context_quality")
    return facts.checks_long(f).distinct()


def mv_details(s, d):
    return _checks(s, d)


def mv_summary(s, d):
    m = _checks(s, d)
    share = F.round(F.avg((F.col("verdict") == "valid").cast("double")), 6)
    return m.groupBy("model").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in ("valid", "needs_check", "reject")], share.alias("valid_share"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def mv_ensemble(s, d):
    """The ensemble's verdict on each fact, with the votes of the three models."""
    m = _checks(s, d)
    e = lambda c: F.max(F.when(F.col("model") == "ensemble", F.col(c))).alias(c)
    return m.groupBy("fact_id").agg(F.count_if((F.col("verdict") == "valid") & (F.col("model") != "ensemble")).alias("votes"), e("verdict"), e("confidence"), e("issues"))


def mv_top_issues(s, d):
    m = _checks(s, d).where("issues <> ''").select("model", F.explode(F.split("issues", ";")).alias("issue"))
    n = m.groupBy("model", "issue").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    return n.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy(F.desc("n"), "issue"))).where("rank <= 8")


def fact_papers(s, d):
    """Facts with their paper, orphans kept: what review lists and graphs join."""
    p = t(s, d, "papers", "paper_id", "doi", "year")
    return t(s, d, "fact_hits", "fact_id", "paper_id").distinct().join(p, "paper_id", "left").select("fact_id", "paper_id", T.resolver_doi(F.col("doi")).alias("doi"), "year")


def p5_found(s, d):
    return convert.converted(t(s, d, "fact_hits"), t(s, d, "property_units"))


def p5_values(s, d):
    """Every fact's value in the common unit, with where its unit was found."""
    f = t(s, d, "fact_hits", "fact_id", "property_name", "value", "unit", "evidence_text")
    return convert.with_units(f, t(s, d, "property_units")).select("fact_id", "property_name", "value", "unit_used", "unit_from", "common_unit", F.format_string("%.6e", F.col("common_number")).alias("common_number"))


def p5_defaulted(s, d):
    """The facts whose unit is neither in their field nor in their text, with the unit that their paper writes most often for the property, and the value in the common unit."""
    f = t(s, d, "fact_hits", "fact_id", "paper_id", "property_name", "value", "unit", "evidence_text").distinct()
    u = convert.with_defaults(f, t(s, d, "property_units")).where("unit_from = 'default'")
    return u.select("fact_id", "property_name", "unit_used", "common_unit", F.format_string("%.6e", F.col("common_number")).alias("common_number"))


QUERIES = {f.__name__: f for f in (p5_found, p5_values, p5_defaulted, unit_normalize, property_alias, material_normalize, property_normalize, parse_numeric, safe_float, unit_guard, extract_properties, extract_materials, extract_phases, extract_devices, extract_samples, extract_mentions, extract_stats, evidence_window, credible_stack, measurement_state, ontology_context, relation_completion, enrich_stats, kg_nodes, kg_edges, kg_triples, graph_summary, graph_neighbors, graph_layout, graph_search, quality_counts, domain_anomalies, missing_trace, range_stats, mv_details, mv_summary, mv_ensemble, mv_top_issues, fact_papers)}


# SQL

_F = "f AS (SELECT DISTINCT fact_id, paper_id, title, page_number, material, material_family, property_name, raw_property_name, value, unit, evidence_text, context_quality, review_status FROM fact_hits)"


def _unit_sql(u: str) -> str:
    key = f"replace(lower(trim({u}, {WS})), 'µ', 'μ')"
    return f"CASE {' '.join(f'WHEN {key} = {q(k)} THEN {q(v)}' for k, v in V.UNIT_ALIASES.items())} ELSE trim({u}, {WS}) END"


def _limit_sql(p: str, v: str) -> str:
    return "coalesce(CASE " + p + " " + " ".join(f"WHEN {q(k)} THEN {v} > {x}" for k, x in V.LIMITS.items()) + " END, false)"


def _fits_sql(p: str, u: str) -> str:
    k = f"replace(replace(lower(coalesce({u}, '')), ' ', ''), 'µ', 'μ')"
    return f"CASE WHEN {p} IS NULL THEN true WHEN {p} IN ('double_remanent_polarization_2Pr', 'remanent_polarization_Pr', 'saturation_polarization_Ps') THEN contains({k}, 'c/cm') WHEN {p} = 'coercive_field_Ec' THEN contains({k}, 'v/cm') WHEN {p} = 'endurance_cycles' THEN contains({k}, 'cycle') WHEN {p} = 'memory_window' THEN {k} LIKE '%v' OR {k} IN ('v', 'volt', 'volts') WHEN {p} = 'retention_time' THEN {k} IN ('s', 'sec', 'second', 'seconds', 'h', 'hour', 'hours', 'year', 'years') OR regexp_matches({k}, '(^|/)(s|h)$') WHEN {p} = 'leakage_current_density' THEN contains({k}, 'a/cm') ELSE true END"


def _props_sql() -> str:
    """CTE x(fact_id, ord, j, property_name, raw_name, value, unit)."""
    out = []
    for i, (name, pattern, raw, unit) in enumerate(V.PROPERTIES):
        cond = ""
        rx = pattern
        if name == "remanent_polarization_Pr":
            rx = pattern.replace(r"(?i)\b", r"(?i)(?:2\s{0,3}\.?\s{0,3})?\b", 1)
            cond = f"WHERE NOT regexp_matches(m, '^2') AND NOT regexp_matches(m, {q(V.TWO_PR)})"
        val = f"power(10.0, CAST(regexp_extract(m, {q(pattern)}, 1) AS DOUBLE))" if name == "endurance_cycles" else f"CAST(regexp_extract(m, {q(pattern)}, 1) AS DOUBLE)"
        u = f"CASE WHEN regexp_extract(m, {q(pattern)}, 2) <> '' THEN regexp_extract(m, {q(pattern)}, 2) || 'V/cm' ELSE {q(unit)} END" if name == "coercive_field_Ec" else q(unit)
        out.append(f"SELECT fact_id, {i} AS o, j, {q(name)} AS property_name, {q(raw)} AS raw_name, {val} AS value, {u} AS unit FROM (SELECT fact_id, unnest(l) AS m, unnest(range(len(l))) AS j FROM (SELECT fact_id, regexp_extract_all(evidence_text, {q(rx)}, 0) AS l FROM f)) {cond}")
    return "x AS (" + " UNION ALL ".join(out) + ")"


def _materials_sql(text: str = "evidence_text") -> str:
    return "x AS (" + " UNION ALL ".join(f"SELECT fact_id, {i} AS o, {q(n)} AS canonical_name, {q(fam)} AS family, regexp_extract_all({text}, {q('(?i)' + p)}, 0)[-1] AS raw_name FROM f WHERE regexp_matches({text}, {q('(?i)' + p)})" for i, (p, n, fam, _, _) in enumerate(V.MATERIALS)) + ")"


def _num(p: str, text: str = "evidence_text") -> str:
    return f"CAST(nullif(regexp_extract({text}, {q(p)}, 1), '') AS DOUBLE)"


_DEP = "CASE " + " ".join(f"WHEN regexp_matches(evidence_text, {q(rf'(?i){chr(92)}b{x}{chr(92)}b')}) THEN {q('sputtering' if x == 'sputter' else x)}" for x in V.DEPOSITIONS) + " END"
_EL = f"list_transform(regexp_extract_all(evidence_text, {q(V.ELECTRODE)}, 1), lambda e: CASE WHEN lower(e) = 'ruo2' THEN 'RuO2' ELSE upper(e) END)"
_SAMPLE = f"""r AS (SELECT *, CASE WHEN {_num(V.THICKNESS)} > 0 THEN {_num(V.THICKNESS)} END AS film_thickness_nm, {_DEP} AS deposition_method, {_num(V.ANNEAL)} AS annealing_temperature_c, {_EL} AS el, nullif(regexp_replace(regexp_extract(evidence_text, {q(V.STACK)}, 1), '\\s+', '', 'g'), '') AS device_stack, CASE WHEN regexp_matches(evidence_text, '\\bSi\\b|SiO2/Si') THEN 'Si' END AS substrate0 FROM f),
smp AS (SELECT *, (film_thickness_nm IS NOT NULL OR deposition_method IS NOT NULL OR annealing_temperature_c IS NOT NULL OR len(el) > 0 OR device_stack IS NOT NULL) AS has_sample, el[1] AS top_electrode, CASE WHEN len(el) > 1 THEN el[-1] END AS bottom_electrode FROM r),
ctx0 AS (SELECT * EXCLUDE (substrate0), CASE WHEN has_sample THEN substrate0 END AS substrate, CASE WHEN has_sample THEN 'thin_film' END AS sample_form,
 CASE WHEN length(trim(device_stack, {WS})) <= 120 AND (contains(device_stack, '/') OR (len(regexp_extract_all(device_stack, {q(V.STACK_TOKEN)}, 1)) >= 2 AND regexp_matches(device_stack, '[-/]'))) THEN device_stack END AS stack,
 list_filter([{', '.join(f"CASE WHEN regexp_matches(evidence_text, {q('(?i)' + p)}) THEN {{'phase_name': {q(n)}, 'space_group': {q(g) if g else 'NULL'}}} END" for p, n, g in V.PHASES)}], lambda x: x IS NOT NULL) AS phases,
 list_filter([{', '.join(f"CASE WHEN regexp_matches(evidence_text, {q(rf'(?i){chr(92)}b{x}{chr(92)}b')}) THEN {q(x)} END" for x in V.DEVICES)}], lambda x: x IS NOT NULL) AS devices, CASE {' '.join(f"WHEN regexp_matches(evidence_text, {q('(?i)' + p)}) THEN [{', '.join(q(e) for e in els)}]::VARCHAR[]" for p, _, _, els, _ in V.MATERIALS)} ELSE []::VARCHAR[] END AS dopants FROM smp),
ctx1 AS (SELECT *, [has_sample, film_thickness_nm IS NOT NULL, deposition_method IS NOT NULL OR annealing_temperature_c IS NOT NULL, top_electrode IS NOT NULL OR substrate IS NOT NULL OR stack IS NOT NULL, len(phases) > 0, has_sample OR len(devices) > 0] AS checks FROM ctx0),
ctx AS (SELECT *, len(list_filter(checks, lambda x: x)) AS context_points, round_even(len(list_filter(checks, lambda x: x)) / 6.0, 2) AS score, array_to_string(list_filter([deposition_method, CAST(annealing_temperature_c AS VARCHAR) || ' C'], lambda x: x IS NOT NULL), ' + ') AS process_summary FROM ctx1)"""
_QUALITY = "CASE WHEN score >= 0.75 THEN 'strong' WHEN score >= 0.45 THEN 'partial' ELSE 'weak' END"
_nid = lambda kind, v: f"('{kind}:' || substr(translate({v}, ' /', '__'), 1, 80))"
_MAT = "coalesce(nullif(trim(material), ''), 'HfO2')"
_DEVS = "list_filter(list_concat([sample_form], devices), lambda x: x IS NOT NULL)"
_GRAPH = f"""g AS (SELECT *, {_MAT} AS mat, coalesce(stack, {_MAT} || ' sample') AS slabel, {_DEVS} AS dev FROM ctx),
n AS (SELECT *, {_nid('Paper', "coalesce(paper_id, 'unknown')")} AS paper_n, {_nid('HafniaMaterial', 'mat')} AS material_n, {_nid('ThinFilmSample', "fact_id || '_' || slabel")} AS sample_n, {_nid('FerroelectricProperty', 'fact_id')} AS property_n, {_nid('Evidence', 'fact_id')} AS evidence_n FROM g),
nodes0 AS (SELECT fact_id, 'Paper' AS type, paper_n AS id, coalesce(title, paper_id) AS label FROM n UNION ALL SELECT fact_id, 'HafniaMaterial', material_n, mat FROM n UNION ALL SELECT fact_id, 'ThinFilmSample', sample_n, slabel FROM n UNION ALL SELECT fact_id, 'FerroelectricProperty', property_n, property_name || ' ' || coalesce(unit, '') FROM n
 UNION ALL SELECT fact_id, 'Evidence', evidence_n, substr(evidence_text, 1, 120) FROM n UNION ALL SELECT fact_id, 'Electrode', {_nid('Electrode', 'top_electrode')}, top_electrode FROM n WHERE top_electrode IS NOT NULL UNION ALL SELECT fact_id, 'Electrode', {_nid('Electrode', 'bottom_electrode')}, bottom_electrode FROM n WHERE bottom_electrode IS NOT NULL
 UNION ALL SELECT fact_id, 'Substrate', {_nid('Substrate', 'substrate')}, substrate FROM n WHERE substrate IS NOT NULL UNION ALL SELECT fact_id, 'FabricationProcess', {_nid('FabricationProcess', "fact_id || '_' || process_summary")}, process_summary FROM n WHERE process_summary <> ''
 UNION ALL SELECT fact_id, 'Device', {_nid('Device', 'd')}, d FROM (SELECT fact_id, unnest(dev) AS d FROM n) UNION ALL SELECT fact_id, 'PhaseStructure', {_nid('PhaseStructure', 'p.phase_name')}, p.phase_name FROM (SELECT fact_id, unnest(phases) AS p FROM n) UNION ALL SELECT fact_id, 'Dopant', {_nid('Dopant', 'd')}, d FROM (SELECT fact_id, unnest(dopants) AS d FROM n)),
nodes AS (SELECT id, type, arg_max(label, {{'f': fact_id, 'l': label}}) AS label, count(*) AS n_facts FROM nodes0 GROUP BY id, type),
edges AS (SELECT paper_n AS source, material_n AS target, 'REPORTS' AS type FROM n UNION ALL SELECT material_n, sample_n, 'HAS_SAMPLE' FROM n UNION ALL SELECT sample_n, property_n, 'HAS_PROPERTY' FROM n UNION ALL SELECT property_n, evidence_n, 'SUPPORTED_BY' FROM n UNION ALL SELECT evidence_n, paper_n, 'FROM_PAPER' FROM n
 UNION ALL SELECT sample_n, {_nid('Electrode', 'top_electrode')}, 'HAS_TOP_ELECTRODE' FROM n WHERE top_electrode IS NOT NULL UNION ALL SELECT sample_n, {_nid('Electrode', 'bottom_electrode')}, 'HAS_BOTTOM_ELECTRODE' FROM n WHERE bottom_electrode IS NOT NULL UNION ALL SELECT sample_n, {_nid('Substrate', 'substrate')}, 'ON_SUBSTRATE' FROM n WHERE substrate IS NOT NULL
 UNION ALL SELECT sample_n, {_nid('FabricationProcess', "fact_id || '_' || process_summary")}, 'FABRICATED_BY' FROM n WHERE process_summary <> '' UNION ALL SELECT sample_n, {_nid('Device', 'd')}, 'USED_IN' FROM (SELECT sample_n, unnest(dev) AS d FROM n) UNION ALL SELECT sample_n, {_nid('PhaseStructure', 'p.phase_name')}, 'HAS_PHASE' FROM (SELECT sample_n, unnest(phases) AS p FROM n) UNION ALL SELECT material_n, {_nid('Dopant', 'd')}, 'HAS_DOPANT' FROM (SELECT material_n, unnest(dopants) AS d FROM n))"""
_V = "CASE WHEN isfinite(value) THEN value END"
_EV = "coalesce(evidence_text, '')"
_FAMS = "(" + ", ".join(q(x) for x in V.FAMILIES) + ")"
_QU = "coalesce(context_quality, 'weak')"
_NOMAT = "trim(coalesce(material, '')) = ''"
_CHK = f"""c AS (SELECT *, {_V} AS v, trim(coalesce(material_family, '')) AS fam FROM f), m0 AS (
SELECT fact_id, 'evidence' AS model, list_filter([CASE WHEN length({_EV}) < 30 THEN 'short_evidence' END, CASE WHEN page_number IS NULL THEN 'no_page' END, CASE WHEN v IS NULL THEN 'no_value' END, CASE WHEN v IS NOT NULL AND NOT contains(replace({_EV}, ',', ''), CAST(CAST(trunc(abs(v)) AS HUGEINT) AS VARCHAR)) THEN 'value_not_in_evidence' END, CASE WHEN trim(coalesce(unit, '')) = '' THEN 'no_unit' END, CASE WHEN property_name = 'remanent_polarization_Pr' AND regexp_matches({_EV}, {q(V.TWO_PR)}) THEN 'two_pr' END, CASE WHEN property_name = 'double_remanent_polarization_2Pr' AND NOT regexp_matches({_EV}, {q(V.TWO_PR_SAID)}) THEN 'two_pr_not_said' END, CASE WHEN regexp_matches({_EV}, {q(V.SECONDARY)}) THEN 'secondary_source' END], lambda x: x IS NOT NULL) AS i, NULL::BOOLEAN AS ok, NULL::DOUBLE AS sure FROM c
UNION ALL SELECT fact_id, 'relation', list_filter([CASE WHEN {_NOMAT} THEN 'no_material' END, CASE WHEN paper_id IS NULL THEN 'no_paper' END, CASE WHEN {_QU} = 'weak' THEN 'weak_context' END], lambda x: x IS NOT NULL), {_QU} <> 'weak' AND NOT ({_NOMAT}), CASE WHEN {_QU} = 'strong' THEN 0.9 ELSE 0.68 END FROM c
UNION ALL SELECT fact_id, 'range', list_filter([CASE WHEN fam = '' THEN 'no_family' END, CASE WHEN fam <> '' AND fam NOT IN {_FAMS} THEN 'reject_family' END, CASE WHEN v IS NULL THEN 'no_value' WHEN v < 0 THEN 'negative' WHEN {_limit_sql('property_name', 'v')} THEN 'above_limit' END], lambda x: x IS NOT NULL), NULL, NULL FROM c),
m AS (SELECT fact_id, model, list_sort(i) AS i, coalesce(ok, len(i) = 0) AS ok, coalesce(sure, CASE model WHEN 'evidence' THEN CASE WHEN len(i) = 0 THEN 0.94 ELSE 0.58 END ELSE CASE WHEN len(i) = 0 THEN 0.96 ELSE 0.55 END END) AS sure FROM m0),
k3 AS (SELECT fact_id, model, CASE WHEN ok AND len(i) = 0 THEN 'valid' WHEN len(list_filter(i, lambda x: starts_with(x, 'reject'))) > 0 THEN 'reject' ELSE 'needs_check' END AS verdict, CAST(sure AS DOUBLE) AS confidence, i FROM m),
e AS (SELECT fact_id, count(*) FILTER (verdict = 'valid') AS votes, list_sort(list_distinct(flatten(list(i)))) AS i, max(confidence) FILTER (model = 'evidence') + max(confidence) FILTER (model = 'relation') + max(confidence) FILTER (model = 'range') AS total FROM k3 GROUP BY 1),
k AS (SELECT fact_id, model, verdict, confidence, array_to_string(i, ';') AS issues FROM k3 UNION ALL SELECT fact_id, 'ensemble', CASE WHEN votes >= 2 AND len(i) = 0 THEN 'valid' WHEN len(list_filter(i, lambda x: starts_with(x, 'reject'))) > 0 THEN 'reject' ELSE 'needs_check' END, round_even(total / 3, 3), array_to_string(i, ';') FROM e)"""


def _p5_sql(final: str, defaults: bool = False) -> str:
    from corpusmill.operators.convert import QUANTITY

    u = reduce_unit_sql("unit", True)
    pf, kf = power_sql("u1", True)
    pt, kt = power_sql("u2", True)
    g = lambda i: f"regexp_extract(m, {q(QUANTITY)}, {i})"
    power = f"coalesce(try_cast(translate(regexp_replace({g(2)}, '^ ?[x×] ?10[~^]?', ''), '⁰¹²³⁴⁵⁶⁷⁸⁹⁻−', '0123456789--') AS INT), 0)"
    man = f"CAST({g(1)} AS DOUBLE)"
    close = lambda e: f"abs({e} - abs(value)) <= 1e-9 * abs(value)"
    spelled = f"list_filter(list_transform(regexp_extract_all(evidence_text, {q(QUANTITY)}, 0), lambda m: CASE WHEN {close(f'{man} * power(10.0, {power})')} THEN {g(3)} || {g(4)} WHEN {close(man)} THEN trim({g(2)}) || ' ' || {g(3)} || {g(4)} END), lambda x: x IS NOT NULL AND trim(x) <> '')[1]"
    ru2 = reduce_unit_sql("s2", True)
    uc = reduce_unit_sql("common_unit", True)
    pd_, kd = power_sql("u3", True)
    # the third way: the unit that the paper writes most often for the property
    dcol = f"(SELECT arg_max(unit, {{'n': n, 'u': unit}}) FROM dn WHERE dn.paper_id = fact_hits.paper_id AND dn.property_name = fact_hits.property_name)" if defaults else "NULL::VARCHAR"
    dcte = "fact_hits AS (SELECT DISTINCT fact_id, paper_id, property_name, value, unit, evidence_text FROM main.fact_hits), dn AS (SELECT paper_id, property_name, unit, count(*) AS n FROM fact_hits WHERE trim(unit) <> '' AND paper_id IS NOT NULL GROUP BY 1, 2, 3), " if defaults else ""
    return f"""WITH {dcte}a(key, canon, dim, factor, off) AS (VALUES {alias_values_sql()}), x AS (SELECT fact_id, property_name, value, evidence_text, {u} AS u1, {spelled} AS s2, {dcol} AS s3 FROM fact_hits), y AS (SELECT *, {ru2} AS u2, {reduce_unit_sql("s3", True)} AS u3 FROM x), z AS (SELECT *, {pf} AS p1, {kf} AS k1, {pt} AS p2, {kt} AS k2, {pd_} AS p3, {kd} AS k3 FROM y),
w AS (SELECT z.*, a1.canon AS c1, coalesce(a1.canon, a2.canon, a3.canon) AS canon, coalesce(a1.dim, a2.dim, a3.dim) AS dim, coalesce(a1.factor, a2.factor, a3.factor) AS factor, CASE WHEN a1.key IS NOT NULL THEN p1 WHEN a2.key IS NOT NULL THEN p2 WHEN a3.key IS NOT NULL THEN p3 ELSE 0 END AS p, CASE WHEN a1.key IS NOT NULL THEN 'field' WHEN a2.key IS NOT NULL THEN 'text' WHEN a3.key IS NOT NULL THEN 'default' END AS unit_from FROM z LEFT JOIN a a1 ON a1.key = k1 LEFT JOIN a a2 ON a2.key = k2 AND a1.key IS NULL AND z.value IS NOT NULL LEFT JOIN a a3 ON a3.key = k3 AND a1.key IS NULL AND a2.key IS NULL),
pu AS (SELECT DISTINCT ON (property_name) property_name, common_unit, a.canon AS cc, a.dim AS cd, a.factor AS cf FROM property_units JOIN a ON a.key = {uc}),
r AS (SELECT w.*, common_unit, dim = cd AS fits, canon = cc AND p = 0 AS same, CASE WHEN dim = cd THEN CASE WHEN canon = cc AND p = 0 THEN value ELSE value * power(10.0, p) * factor / cf END END AS num FROM w LEFT JOIN pu USING (property_name))
{final}"""


def _mentions_sql() -> str:
    """Each kind's matches with their places (from the lengths of the matches and of the pieces between) and sentences."""
    kinds = [("material", n, p) for p, n, *_ in V.MATERIALS] + [("phase", n, p) for p, n, _ in V.PHASES] + [("property", n, p.replace("(?i)", "")) for n, p, *_ in V.PROPERTIES] + [("device", d, rf"\b{d}\b") for d in V.DEVICES]
    total = lambda xs, n: f"coalesce(list_sum(list_transform({xs}[1:{n}], lambda x: length(x))), 0)"
    one = "SELECT chunk_id, text, {k} AS kind, {n} AS name, unnest(range(1, len(m) + 1)) AS i, m, p FROM (SELECT chunk_id, text, regexp_extract_all(text, {rx}, 0) AS m, regexp_split_to_array(text, {rx}) AS p FROM document_chunks WHERE text <> '')"
    rows = " UNION ALL ".join(one.format(k=q(k), n=q(n), rx=q("(?i)" + p)) for k, n, p in kinds)
    sp = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), {1})"
    return f"""WITH r AS ({rows}), a AS (SELECT chunk_id, text, kind, name, m[i] AS hit, CAST({total('p', 'i')} + {total('m', 'i - 1')} AS BIGINT) AS place FROM r), b AS (SELECT *, substr(text, 1, place) AS before, substr(text, place + length(hit) + 1) AS after FROM a), c AS (SELECT *, regexp_extract(after, '^[^.\\n]*[.\\n]', 0) AS stop FROM b),
d AS (SELECT *, {sp.format("regexp_extract(before, '[^.\\n]*$', 0) || hit || CASE WHEN stop <> '' THEN stop ELSE substr(after, 1, 220) END", WS)} AS sent, {sp.format("right(before, 160) || hit || substr(after, 1, 220)", WS)} AS wide FROM c) SELECT chunk_id, kind, name, CAST(place AS INT) AS place, substr(CASE WHEN length(sent) < 40 THEN wide ELSE sent END, 1, 700) AS evidence FROM d"""


SQL = {
    "extract_mentions": _mentions_sql(),
    "p5_found": _p5_sql("SELECT DISTINCT fact_id, printf('%.2e', num) AS common_value FROM r WHERE fits AND NOT same AND num IS NOT NULL"),
    "p5_values": _p5_sql("SELECT fact_id, property_name, value, CASE WHEN canon IS NOT NULL THEN CASE WHEN p <> 0 THEN '10^' || p || ' ' ELSE '' END || canon END AS unit_used, unit_from, common_unit, coalesce(printf('%.6e', num), 'null') AS common_number FROM r"),
    "p5_defaulted": _p5_sql("SELECT fact_id, property_name, CASE WHEN p <> 0 THEN '10^' || p || ' ' ELSE '' END || canon AS unit_used, common_unit, coalesce(printf('%.6e', num), 'null') AS common_number FROM r WHERE unit_from = 'default'", True),
    "unit_normalize": f"SELECT DISTINCT fact_id, unit, {_unit_sql('unit')} AS normalized_unit FROM fact_hits",
    "property_alias": f"WITH f AS (SELECT DISTINCT fact_id, raw_property_name, lower(trim(raw_property_name, {WS})) AS r FROM fact_hits) SELECT fact_id, CASE WHEN contains(r, '2pr') OR contains(r, 'double remanent') THEN 'double_remanent_polarization_2Pr' WHEN r = 'pr' OR contains(r, 'remanent polarization') THEN 'remanent_polarization_Pr' WHEN r = 'ec' OR contains(r, 'coercive') THEN 'coercive_field_Ec' WHEN contains(r, 'memory window') THEN 'memory_window' WHEN contains(r, 'endurance') THEN 'endurance_cycles' WHEN contains(r, 'retention') THEN 'retention_time' WHEN contains(r, 'leakage') THEN 'leakage_current_density' END AS found_property FROM f",
    "material_normalize": "WITH f AS (SELECT DISTINCT fact_id, material, replace(lower(material), ' ', '') AS l FROM fact_hits WHERE material IS NOT NULL), h AS (SELECT *, contains(l, 'hfo2') OR contains(lower(material), 'hafnia') OR contains(l, 'hafniumoxide') AS h, contains(l, 'zr') OR contains(l, 'hzo') AS z FROM f) SELECT fact_id, CASE WHEN h AND z THEN 'HZO' WHEN h THEN 'HfO2' ELSE material END AS name, CASE WHEN h AND z THEN 'HZO' WHEN h THEN 'HfO2' ELSE 'unknown_hafnia' END AS family FROM h",
    "property_normalize": f"WITH f AS (SELECT DISTINCT fact_id, property_name, value, unit FROM fact_hits), n AS (SELECT *, {_unit_sql('unit')} AS normalized_unit FROM f), v AS (SELECT *, CASE WHEN normalized_unit = 'MV/cm' AND contains(lower(unit), 'kv') THEN value / 1000 ELSE value END AS normalized_value FROM n) SELECT fact_id, normalized_unit, normalized_value, array_to_string(list_filter([CASE WHEN property_name = 'double_remanent_polarization_2Pr' THEN 'reported_as_2Pr' END, CASE WHEN {_limit_sql('property_name', 'normalized_value')} THEN 'above_limit' END], lambda x: x IS NOT NULL), ';') AS warnings, {_limit_sql('property_name', 'normalized_value')} AS needs_check FROM v",
    "parse_numeric": "SELECT DISTINCT ON (fact_id, evidence_text) fact_id, TRY_CAST(nullif(regexp_extract(evidence_text, '[-+]?\\d+(\\.\\d+)?', 0), '') AS DOUBLE) AS first_number FROM fact_hits",
    "safe_float": "WITH f AS (SELECT DISTINCT fact_id, value, unit FROM fact_hits) SELECT fact_id, CASE WHEN isfinite(value) THEN value END AS number, CASE WHEN isfinite(TRY_CAST(unit AS DOUBLE)) THEN TRY_CAST(unit AS DOUBLE) END AS unit_number FROM f",
    "unit_guard": f"WITH f AS (SELECT DISTINCT fact_id, property_name, unit FROM fact_hits) SELECT fact_id, {_fits_sql('property_name', 'unit')} AS fits FROM f",
    "extract_properties": f"WITH {_F}, {_props_sql()} SELECT fact_id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY o, j) - 1 AS INT) AS place, property_name, raw_name, value, unit FROM x",
    "extract_materials": f"WITH {_F}, {_materials_sql()} SELECT fact_id, CAST(row_number() OVER (PARTITION BY fact_id ORDER BY o) - 1 AS INT) AS place, canonical_name, family, raw_name FROM x",
    "extract_phases": " UNION ALL ".join(f"SELECT chunk_id, {q(n)} AS phase_name, {q(g) if g else 'CAST(NULL AS VARCHAR)'} AS space_group FROM document_chunks WHERE regexp_matches(text, {q('(?i)' + p)})" for p, n, g in V.PHASES),
    "extract_devices": " UNION ALL ".join(f"SELECT chunk_id, {q(x)} AS device_type FROM document_chunks WHERE regexp_matches(text, {q(rf'(?i){chr(92)}b{x}{chr(92)}b')})" for x in V.DEVICES),
    "extract_samples": f"WITH {_F}, {_SAMPLE} SELECT fact_id, film_thickness_nm, deposition_method, annealing_temperature_c, top_electrode, bottom_electrode, substrate, device_stack, sample_form FROM ctx WHERE has_sample",
    "extract_stats": f"WITH {_F}, {_props_sql()}, {_materials_sql().replace('x AS', 'y AS', 1)}, n AS (SELECT f.fact_id, (SELECT count(*) FROM x WHERE x.fact_id = f.fact_id) AS p, (SELECT count(*) FROM y WHERE y.fact_id = f.fact_id) AS m FROM f) SELECT count(*) AS texts, CAST(sum(p) AS BIGINT) AS properties, CAST(sum(m) AS BIGINT) AS materials, count(*) FILTER (p = 0 AND m = 0) AS empty FROM n",
    "evidence_window": f"WITH m AS (SELECT chunk_id, text, regexp_extract(text, '(?i)remanent polarization', 0) AS m FROM document_chunks), p AS (SELECT *, substr(text, 1, strpos(text, m) - 1) AS b, substr(text, strpos(text, m) + length(m)) AS a FROM m WHERE m <> ''), s AS (SELECT *, regexp_extract(a, '^[^.\\n]*[.\\n]', 0) AS stop FROM p), w AS (SELECT chunk_id, trim(regexp_replace(regexp_extract(b, '[^.\\n]*$', 0) || m || CASE WHEN stop <> '' THEN stop ELSE substr(a, 1, 220) END, '\\s+', ' ', 'g'), {WS}) AS sent, trim(regexp_replace(right(b, 160) || m || substr(a, 1, 220), '\\s+', ' ', 'g'), {WS}) AS wide FROM s) SELECT chunk_id, substr(CASE WHEN length(sent) < 40 THEN wide ELSE sent END, 1, 700) AS evidence FROM w",
    "credible_stack": f"WITH {_F}, {_SAMPLE} SELECT fact_id, device_stack, stack FROM ctx WHERE device_stack IS NOT NULL",
    "measurement_state": f"WITH {_F} SELECT fact_id, CASE WHEN {any_sql('lower(' + _EV + ')', ['wake-up', 'wake up', 'wakeup'])} THEN 'wake-up mentioned' WHEN {any_sql('lower(' + _EV + ')', ['pristine', 'fresh', 'initial'])} THEN 'pristine/initial mentioned' ELSE 'not specified' END AS wake_up_state, CASE WHEN property_name = 'endurance_cycles' THEN 'endurance metric' WHEN {any_sql('lower(' + _EV + ')', ['endurance', 'fatigue', 'cycle', 'cycling'])} THEN 'cycling/endurance mentioned' ELSE 'not specified' END AS endurance_state FROM f",
    "ontology_context": f"WITH {_F}, {_SAMPLE} SELECT fact_id, score, {_QUALITY} AS quality, score >= 0.75 AS comparison_ready, array_to_string(list_filter([{', '.join(f'CASE WHEN NOT checks[{i + 1}] THEN {q(k)} END' for i, k in enumerate(facts.CHECKS))}], lambda x: x IS NOT NULL), ',') AS missing, process_summary FROM ctx",
    "enrich_stats": f"WITH {_F}, {_SAMPLE} SELECT {_QUALITY} AS quality, count(*) AS n, count(*) FILTER (score >= 0.75) AS ready, round(avg(CAST(context_points AS DOUBLE)), 6) AS mean_points FROM ctx GROUP BY 1",
    "relation_completion": f"WITH {_F}, {_SAMPLE}, b AS (SELECT *, coalesce(nullif(trim(material), ''), 'unknown material') AS mat, array_to_string({_DEVS}, ', ') AS dv, array_to_string(list_concat(list_transform(phases, lambda p: p.phase_name), list_filter(list_transform(phases, lambda p: p.space_group), lambda x: x IS NOT NULL)), ', ') AS ph FROM ctx), u AS (SELECT fact_id, unnest(['REPORTS', 'HAS_SAMPLE', 'FABRICATED_BY', 'HAS_PHASE', 'USED_IN', 'HAS_PROPERTY', 'SUPPORTED_BY']) AS relation, unnest([mat, coalesce(stack, sample_form, mat || ' sample'), process_summary, ph, dv, property_name, evidence_text]) AS target FROM b) SELECT fact_id, relation, coalesce(target, '') AS target, trim(coalesce(target, '')) <> '' AS ready FROM u",
    "kg_nodes": f"WITH {_F}, {_SAMPLE}, {_GRAPH} SELECT * FROM nodes",
    "kg_edges": f"WITH {_F}, {_SAMPLE}, {_GRAPH} SELECT * FROM edges",
    "kg_triples": f"WITH {_F}, {_SAMPLE}, {_GRAPH} SELECT source AS head, type AS relation, target AS tail FROM edges",
    "graph_summary": f"WITH {_F}, {_SAMPLE}, {_GRAPH} SELECT 'node' AS kind, type, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type",
    "graph_neighbors": f"WITH {_F}, {_SAMPLE}, {_GRAPH} SELECT node, neighbour, count(*) AS n FROM (SELECT source AS node, target AS neighbour FROM edges UNION ALL SELECT target, source FROM edges) GROUP BY 1, 2",
    "graph_layout": f"WITH {_F}, {_SAMPLE}, {_GRAPH}, rk AS (SELECT id, type, row_number() OVER (PARTITION BY type ORDER BY id) - 1 AS rank, count(*) OVER (PARTITION BY type) AS total FROM nodes), z AS (SELECT *, CASE WHEN total < 500 THEN 24 ELSE 16 END AS gap, list_sum(list_transform(range(1, length(id) + 1), lambda i: unicode(substr(id, i, 1)) * i)) % 1000 / 1000.0 - 0.5 AS shift FROM rk) SELECT id, type, CAST(coalesce(list_position([{', '.join(q(c) for c in graph.COLUMNS)}], type), 0) * 220 AS DOUBLE) AS x, round(CAST(rank * gap - total * gap / 2.0 + shift * 10 AS DOUBLE), 4) AS y FROM z",
    "graph_search": f"WITH {_F}, {_SAMPLE}, {_GRAPH}, h AS (SELECT id, type, label FROM nodes WHERE type IN ('HafniaMaterial', 'ThinFilmSample') AND (contains(lower(id), 'hfo2') OR contains(lower(coalesce(label, '')), 'hfo2'))), b AS (SELECT DISTINCT source AS node, target AS nb FROM edges UNION SELECT DISTINCT target, source FROM edges) SELECT h.id, h.type, h.label, count(nb) AS neighbours FROM h LEFT JOIN b ON b.node = h.id GROUP BY ALL",
    "quality_counts": f"WITH {_F}, u AS (SELECT unnest(['property', 'property_unit', 'family', 'status']) AS dimension, unnest([property_name, property_name || ' | ' || coalesce(trim(unit), ''), nullif(trim(coalesce(material_family, '')), ''), review_status]) AS value FROM f) SELECT dimension, coalesce(value, 'unknown') AS value, count(*) AS n FROM u GROUP BY 1, 2",
    "domain_anomalies": f"WITH {_F} SELECT fact_id, property_name, value, reason FROM (SELECT fact_id, property_name, value, unnest([CASE WHEN property_name = 'remanent_polarization_Pr' AND regexp_matches(evidence_text, {q(V.TWO_PR)}) THEN 'evidence_mentions_2Pr' END, CASE WHEN {_V} < 0 THEN 'negative_value' END, CASE WHEN {_limit_sql('property_name', _V)} THEN 'above_limit' END]) AS reason FROM f) WHERE reason IS NOT NULL",
    "missing_trace": f"WITH {_F} SELECT fact_id, page_number IS NULL AS no_page, paper_id IS NULL AS no_paper FROM f WHERE trim(coalesce(evidence_text, '')) = '' OR page_number IS NULL OR paper_id IS NULL",
    "range_stats": f"WITH {_F}, g AS (SELECT *, value IS NOT NULL AND NOT isnan(value) AS num, CASE WHEN value IS NOT NULL AND NOT isnan(value) AND {_fits_sql('property_name', 'unit')} THEN value END AS v FROM f) SELECT property_name, context_quality, count(*) AS n, count(*) FILTER (num) AS n_candidates, count(*) FILTER (num AND v IS NULL) AS n_excluded_unit, min(v) AS min_v, max(v) AS max_v, quantile_cont(v, 0.5) AS median_v, arg_min(fact_id, {{'v': v, 'f': fact_id}}) FILTER (v IS NOT NULL) AS min_fact_id, arg_min(fact_id, {{'v': -v, 'f': fact_id}}) FILTER (v IS NOT NULL) AS max_fact_id FROM g GROUP BY 1, 2",
    "mv_details": f"WITH {_F}, {_CHK} SELECT * FROM k",
    "mv_summary": f"WITH {_F}, {_CHK} SELECT model, count(*) AS n, count(*) FILTER (verdict = 'valid') AS valid, count(*) FILTER (verdict = 'needs_check') AS needs_check, count(*) FILTER (verdict = 'reject') AS reject, round(avg(CASE WHEN verdict = 'valid' THEN 1.0 ELSE 0.0 END), 6) AS valid_share, round(avg(confidence), 4) AS mean_confidence FROM k GROUP BY 1",
    "mv_ensemble": f"WITH {_F}, {_CHK} SELECT fact_id, count(*) FILTER (verdict = 'valid' AND model <> 'ensemble') AS votes, max(verdict) FILTER (model = 'ensemble') AS verdict, max(confidence) FILTER (model = 'ensemble') AS confidence, max(issues) FILTER (model = 'ensemble') AS issues FROM k GROUP BY 1",
    "mv_top_issues": f"WITH {_F}, {_CHK}, i AS (SELECT model, unnest(string_split(issues, ';')) AS issue FROM k WHERE issues <> ''), n AS (SELECT model, issue, count(*) AS n FROM i GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY model ORDER BY n DESC, issue) AS INT) AS rank FROM n) SELECT * FROM r WHERE rank <= 8",
    "fact_papers": f"WITH {_F} SELECT f.fact_id, f.paper_id, nullif(trim(regexp_replace(lower(trim(p.doi, {WS})), '^https?://(dx\\.)?doi\\.org/', ''), {WS}), '') AS doi, p.year FROM f LEFT JOIN papers p ON p.paper_id = f.paper_id",
}
