"""Facts from text and about facts: entity extraction, normalisation, context scores, validation counts, range statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V
from corpusmill.session import spread


def lit_map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


# normalisation


def normalize_unit(unit: Column) -> Column:
    key = F.replace(F.replace(F.lower(T.strip(unit)), F.lit("µ"), F.lit("μ")), F.lit(" "), F.lit(" "))
    return F.coalesce(F.try_element_at(lit_map(V.UNIT_ALIASES), key), T.strip(unit))


def property_alias(raw: Column) -> Column:
    r = F.lower(T.strip(raw))
    return (
        F.when(r.contains("2pr") | r.contains("double remanent"), "double_remanent_polarization_2Pr")
        .when((r == "pr") | r.contains("remanent polarization"), "remanent_polarization_Pr")
        .when((r == "ec") | r.contains("coercive"), "coercive_field_Ec")
        .when(r.contains("memory window"), "memory_window")
        .when(r.contains("endurance"), "endurance_cycles")
        .when(r.contains("retention"), "retention_time")
        .when(r.contains("leakage"), "leakage_current_density")
    )


def material_name(raw: Column) -> Column:
    low = F.replace(F.lower(raw), F.lit(" "), F.lit(""))
    hafnia = low.contains("hfo2") | F.lower(raw).contains("hafnia") | low.contains("hafniumoxide")
    zr = low.contains("zr") | low.contains("hzo")
    return F.when(hafnia & zr, F.struct(F.lit("HZO").alias("name"), F.lit("HZO").alias("family"))).when(hafnia, F.struct(F.lit("HfO2").alias("name"), F.lit("HfO2").alias("family"))).otherwise(F.struct(raw.alias("name"), F.lit("unknown_hafnia").alias("family")))


def above_limit(prop: Column, value: Column) -> Column:
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in V.LIMITS.items() for x in kv]), prop)
    return F.coalesce(value > limit, F.lit(False))


def normalize_property(df: DataFrame) -> DataFrame:
    """normalized_unit, normalized_value (kV/cm over 1000), warnings, needs_check for property_name, value, unit."""
    nu = normalize_unit(F.col("unit"))
    kv = (nu == "MV/cm") & F.lower("unit").contains("kv")
    out = df.withColumn("normalized_unit", nu).withColumn("normalized_value", F.when(F.coalesce(kv, F.lit(False)), F.col("value") / 1000).otherwise(F.col("value")))
    high = above_limit(F.col("property_name"), F.col("normalized_value"))
    warn = F.array_compact(F.array(F.when(F.col("property_name") == "double_remanent_polarization_2Pr", "reported_as_2Pr"), F.when(high, "above_limit")))
    return out.withColumn("warnings", F.array_join(warn, ";")).withColumn("needs_check", high)


def parse_numeric(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"[-+]?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


def safe_float(c: Column) -> Column:
    """A finite number, or null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def unit_fits(prop: Column, unit: Column) -> Column:
    """Whether a unit is of the property's quantity, by its spelling; true for other properties."""
    u = F.replace(F.replace(F.lower(F.coalesce(unit, F.lit(""))), F.lit(" "), F.lit("")), F.lit("µ"), F.lit("μ"))
    return (
        F.when(prop.isNull(), True)
        .when(prop.isin("double_remanent_polarization_2Pr", "remanent_polarization_Pr", "saturation_polarization_Ps"), u.contains("c/cm"))
        .when(prop == "coercive_field_Ec", u.contains("v/cm"))
        .when(prop == "endurance_cycles", u.contains("cycle"))
        .when(prop == "memory_window", u.endswith("v") | u.isin("v", "volt", "volts"))
        .when(prop == "retention_time", u.isin("s", "sec", "second", "seconds", "h", "hour", "hours", "year", "years") | u.rlike("(^|/)(s|h)$"))
        .when(prop == "leakage_current_density", u.contains("a/cm"))
        .otherwise(True)
    )


# extraction by built-in expressions


def properties(text: Column, with_sentence: bool = False) -> Column:
    """Array of (property_name, raw_name, value, unit), in the order of the patterns, then of the text. A Pr that belongs to a 2Pr is left out.

    with_sentence adds evidence: the whole sentence around each match, or a window if that is short."""
    groups = []
    for name, pattern, raw, unit in V.PROPERTIES:
        if name == "remanent_polarization_Pr":
            pattern = pattern.replace(r"(?i)\b", r"(?i)(?<!2\s{0,3}\.?\s{0,3})\b", 1)
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        if with_sentence:
            whole = _with_sentences(text, whole, pattern)
        text_of = (lambda m: m["m"]) if with_sentence else (lambda m: m)
        if name == "remanent_polarization_Pr":
            whole = F.filter(whole, lambda m: ~text_of(m).rlike(V.TWO_PR))
        value = (lambda p: lambda m: F.pow(F.lit(10.0), F.regexp_extract(m, p, 1).cast("double")))(pattern) if name == "endurance_cycles" else (lambda p: lambda m: F.regexp_extract(m, p.replace(r"(?<!2\s{0,3}\.?\s{0,3})", ""), 1).cast("double"))(pattern)
        units = (lambda p, u: lambda m: F.when(F.regexp_extract(m, p, 2) != "", F.concat(F.regexp_extract(m, p, 2), F.lit("V/cm"))).otherwise(F.lit(u)))(pattern, unit) if name == "coercive_field_Ec" else (lambda u: lambda m: F.lit(u))(unit)
        groups.append(F.transform(whole, (lambda n, r, v, u, t: lambda m: F.struct(F.lit(n).alias("property_name"), F.lit(r).alias("raw_name"), v(t(m)).alias("value"), u(t(m)).alias("unit"), *([m["s"].alias("evidence")] if with_sentence else [])))(name, raw, value, units, text_of)))
    return F.concat(*groups)


def materials(text: Column) -> Column:
    """Array of (canonical_name, family, raw_name), in the order of the patterns; raw_name is the last mention."""
    one = []
    for pattern, name, family, _, _ in V.MATERIALS:
        last = F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0)), F.lit(-1))
        one.append(F.when(last.isNotNull(), F.struct(F.lit(name).alias("canonical_name"), F.lit(family).alias("family"), last.alias("raw_name"))))
    return F.array_compact(F.array(*one))


def dopants(text: Column) -> Column:
    """The dopant elements of the first material that the text names, in the order of the patterns; empty if it names none."""
    out = None
    for pattern, _, _, elements, _ in V.MATERIALS:
        hit, value = text.rlike(f"(?i){pattern}"), F.array(*[F.lit(e) for e in elements]).cast("array<string>")
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(F.array().cast("array<string>"))


def phases(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.struct(F.lit(n).alias("phase_name"), F.lit(g).cast("string").alias("space_group"))) for p, n, g in V.PHASES]))


def devices(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{d}\b"), F.lit(d)) for d in V.DEVICES]))


def sample(text: Column) -> Column:
    """(film_thickness_nm, deposition_method, annealing_temperature_c, top_electrode, bottom_electrode, substrate, device_stack, sample_form); null if nothing was found."""
    num = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double")
    thick = F.when(num(V.THICKNESS) > 0, num(V.THICKNESS))
    dep = None
    for d in V.DEPOSITIONS:
        hit, name = text.rlike(rf"(?i)\b{d}\b"), "sputtering" if d == "sputter" else d
        dep = F.when(hit, name) if dep is None else dep.when(hit, name)
    el = F.transform(F.regexp_extract_all(text, F.lit(V.ELECTRODE), F.lit(1)), lambda e: F.when(F.lower(e) == "ruo2", "RuO2").otherwise(F.upper(e)))
    stack = F.nullif(F.regexp_replace(F.regexp_extract(text, V.STACK, 1), r"\s+", ""), F.lit(""))
    anneal = num(V.ANNEAL)
    any_ = thick.isNotNull() | dep.isNotNull() | anneal.isNotNull() | (F.size(el) > 0) | stack.isNotNull()
    return F.when(
        any_,
        F.struct(
            thick.alias("film_thickness_nm"), dep.alias("deposition_method"), anneal.alias("annealing_temperature_c"), F.try_element_at(el, F.lit(1)).alias("top_electrode"), F.when(F.size(el) > 1, F.try_element_at(el, F.lit(-1))).alias("bottom_electrode"),
            F.when(text.rlike(r"\bSi\b|SiO2/Si"), "Si").alias("substrate"), stack.alias("device_stack"), F.lit("thin_film").alias("sample_form"),
        ),
    )


def _around(before: Column, m: Column, after: Column) -> Column:
    stop = F.regexp_extract(after, r"^[^.\n]*[.\n]", 0)
    right = F.when(stop != "", stop).otherwise(F.substring(after, 1, 220))
    tidy = lambda c: T.strip(F.regexp_replace(c, r"\s+", " "))
    sent = tidy(F.concat(F.regexp_extract(before, r"[^.\n]*$", 0), m, right))
    wide = tidy(F.concat(F.substring(before, -160, 160), m, F.substring(after, 1, 220)))
    return F.when(F.char_length(sent) < 40, wide).otherwise(sent)


def _with_sentences(text: Column, whole: Column, pattern: str) -> Column:
    """Array of (m, s): each match with its sentence. A match's place follows from the lengths of the matches before it and of the pieces between."""
    pieces = F.split(text, pattern, -1)
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + F.char_length(x))

    def one(m, i):
        at = length(F.slice(pieces, F.lit(1), i + 1)) + length(F.slice(whole, F.lit(1), i))
        return F.struct(m.alias("m"), _around(F.substring(text, F.lit(1), at), m, F.substring(text, at + F.char_length(m) + 1, F.char_length(text))).alias("s"))

    return F.transform(whole, one)


def evidence(text: Column, pattern: str) -> Column:
    """The sentence around the first match: up to the full stops or newlines beside it; a window of 160 and 220 characters if that is shorter than 40; at most 700 characters."""
    m = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    at = F.position(m, text) - 1
    before, after = F.substring(text, F.lit(1), at), F.substring(text, at + F.char_length(m) + 1, F.char_length(text))
    return F.when(at >= 0, F.substring(_around(before, m, after), 1, 700))


def credible_stack(stack: Column) -> Column:
    s = T.strip(stack)
    known = F.size(F.regexp_extract_all(s, F.lit(V.STACK_TOKEN), F.lit(1)))
    return F.when((F.char_length(s) <= 120) & (s != "") & (s.contains("/") | ((known >= 2) & s.rlike("[-/]"))), s)


def measurement_state(text: Column, prop: Column) -> tuple[Column, Column]:
    low = F.lower(F.coalesce(text, F.lit("")))
    wake = F.when(T.any_of(low, ["wake-up", "wake up", "wakeup"]), "wake-up mentioned").when(T.any_of(low, ["pristine", "fresh", "initial"]), "pristine/initial mentioned").otherwise("not specified")
    end = F.when(prop == "endurance_cycles", "endurance metric").when(T.any_of(low, ["endurance", "fatigue", "cycle", "cycling"]), "cycling/endurance mentioned").otherwise("not specified")
    return wake, end


CHECKS = ["sample_identity", "geometry", "process", "electrode_or_substrate", "phase", "device"]


def with_context(facts: DataFrame, text: str = "evidence_text") -> DataFrame:
    """Adds what the evidence tells about a fact's sample, phases and devices, with the context score (present of six checks) and its grade."""
    c = F.col(text)
    f = facts.withColumn("sample", sample(c)).withColumn("phases", phases(c)).withColumn("devices", devices(c)).withColumn("dopants", dopants(c))
    stack = credible_stack(F.col("sample.device_stack"))
    has = {
        "sample_identity": F.col("sample").isNotNull(), "geometry": F.col("sample.film_thickness_nm").isNotNull(), "process": F.col("sample.deposition_method").isNotNull() | F.col("sample.annealing_temperature_c").isNotNull(),
        "electrode_or_substrate": F.col("sample.top_electrode").isNotNull() | F.col("sample.bottom_electrode").isNotNull() | F.col("sample.substrate").isNotNull() | stack.isNotNull(),
        "phase": F.coalesce(F.size("phases") > 0, F.lit(False)), "device": F.col("sample").isNotNull() | F.coalesce(F.size("devices") > 0, F.lit(False)),
    }
    present = sum((F.when(has[k], 1).otherwise(0) for k in CHECKS), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(~has[k], F.lit(k)) for k in CHECKS]))
    process = F.array_join(F.array_compact(F.array(F.col("sample.deposition_method"), F.concat(F.col("sample.annealing_temperature_c").cast("string"), F.lit(" C")))), " + ")
    f = f.withColumn("context_points", present).withColumn("score", F.bround(present / 6, 2)).withColumn("missing", missing).withColumn("process_summary", process).withColumn("stack", stack)
    return f.withColumn("quality", F.when(F.col("score") >= 0.75, "strong").when(F.col("score") >= 0.45, "partial").otherwise("weak")).withColumn("comparison_ready", F.col("score") >= 0.75)


def anomalies(facts: DataFrame) -> DataFrame:
    """fact_id, property_name, value, reason: up to two rows a fact: 2Pr evidence under Pr, a negative value, a value above its limit."""
    v = safe_float(F.col("value"))
    reasons = F.array_compact(
        F.array(
            F.when((F.col("property_name") == "remanent_polarization_Pr") & F.col("evidence_text").rlike(V.TWO_PR), "evidence_mentions_2Pr"),
            F.when(v < 0, "negative_value"),
            F.when(above_limit(F.col("property_name"), v), "above_limit"),
        )
    )
    return facts.select("fact_id", "property_name", "value", F.explode(reasons).alias("reason"))


def range_stats(facts: DataFrame, by: list[str]) -> DataFrame:
    """Per group: numeric facts, those left out for their unit, smallest, largest and exact median value with the facts that hold the extremes (ties to the smaller id).

    The median is the exact percentile, which keeps counts per distinct value in its partial aggregates, so a hot group combines before the shuffle."""
    num = F.col("value").isNotNull() & ~F.isnan("value")
    fit = num & unit_fits(F.col("property_name"), F.col("unit"))
    v = F.when(fit, F.col("value"))
    return facts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(num).alias("n_candidates"), F.count_if(num & ~fit).alias("n_excluded_unit"), F.min(v).alias("min_v"), F.max(v).alias("max_v"), F.percentile(v, 0.5).alias("median_v"),
        F.min(F.when(fit, F.struct(F.col("value").alias("v"), F.col("fact_id").alias("f"))))["f"].alias("min_fact_id"), F.min(F.when(fit, F.struct((-F.col("value")).alias("v"), F.col("fact_id").alias("f"))))["f"].alias("max_fact_id"),
    )


def _issues(*found: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for c, name in found]))


def _verdict(valid: Column, issues: Column) -> Column:
    """valid only without issues; reject if an issue says so; else needs_check."""
    return F.when(valid & (F.size(issues) == 0), "valid").when(F.exists(issues, lambda i: i.startswith("reject")), "reject").otherwise("needs_check")


def checks_long(facts: DataFrame) -> DataFrame:
    """model, fact_id, verdict, confidence, issues: three independent validators (evidence, relation, range) and their ensemble, in long form.

    The ensemble is valid if two of three are and none has an issue; its issues are the union, its confidence the mean. All four come from one row, without a shuffle."""
    v = safe_float(F.col("value"))
    ev = F.coalesce("evidence_text", F.lit(""))
    prop, unit = F.col("property_name"), F.coalesce("unit", F.lit(""))
    whole = F.format_string("%d", F.abs(v).cast("long"))
    evidence = _issues(
        (F.char_length(ev) < 30, "short_evidence"), (F.col("page_number").isNull(), "no_page"), (v.isNull(), "no_value"), (v.isNotNull() & ~F.replace(ev, F.lit(","), F.lit("")).contains(whole), "value_not_in_evidence"), (F.trim(unit) == "", "no_unit"),
        ((prop == "remanent_polarization_Pr") & ev.rlike(V.TWO_PR), "two_pr"), ((prop == "double_remanent_polarization_2Pr") & ~ev.rlike(V.TWO_PR_SAID), "two_pr_not_said"), (ev.rlike(V.SECONDARY), "secondary_source"),
    )
    quality = F.coalesce("context_quality", F.lit("weak"))
    no_material = F.trim(F.coalesce("material", F.lit(""))) == ""
    relation = _issues((no_material, "no_material"), (F.col("paper_id").isNull(), "no_paper"), (quality == "weak", "weak_context"))
    family = F.trim(F.coalesce("material_family", F.lit("")))
    limit = F.when(v < 0, "negative").when(above_limit(prop, v), "above_limit")
    ranges = F.concat(_issues((family == "", "no_family"), ((family != "") & ~family.isin(V.FAMILIES), "reject_family"), (v.isNull(), "no_value")), F.array_compact(F.array(limit)))
    ok = {"evidence": F.size(evidence) == 0, "relation": (quality != "weak") & ~no_material, "range": F.size(ranges) == 0}
    sure = {"evidence": F.when(ok["evidence"], 0.94).otherwise(0.58), "relation": F.when(quality == "strong", 0.9).otherwise(0.68), "range": F.when(ok["range"], 0.96).otherwise(0.55)}
    issues = {"evidence": evidence, "relation": relation, "range": ranges}
    one = lambda m: F.struct(F.lit(m).alias("model"), _verdict(ok[m], issues[m]).alias("verdict"), sure[m].alias("confidence"), F.array_sort(issues[m]).alias("issues"))
    three = facts.select("fact_id", F.array(*[one(m) for m in ok]).alias("__m"))
    votes = F.size(F.filter("__m", lambda x: x["verdict"] == "valid"))
    union = F.array_sort(F.array_distinct(F.flatten(F.transform("__m", lambda x: x["issues"]))))
    mean = F.aggregate("__m", F.lit(0.0), lambda a, x: a + x["confidence"]) / 3
    both = F.struct(F.lit("ensemble").alias("model"), _verdict(votes >= 2, union).alias("verdict"), F.bround(mean, 3).alias("confidence"), union.alias("issues"))
    return three.select("fact_id", F.explode(F.concat("__m", F.array(both))).alias("r")).select("fact_id", "r.model", "r.verdict", "r.confidence", F.array_join("r.issues", ";").alias("issues"))


# extraction with all match offsets, in Arrow batches


def _sentence(text: str, start: int, end: int) -> str:
    cut = max(text.rfind(c, 0, start) for c in ".\n") + 1
    stops = [p for p in (text.find(c, end) for c in ".\n") if p >= 0]
    out = " ".join(text[cut : (min(stops) + 1 if stops else min(len(text), end + 220))].split())
    if len(out) < 40:
        out = " ".join(text[max(0, start - 160) : end + 220].split())
    return out[:700]


def mentions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, kind, name, place, evidence: every mention of a material, phase, property or device with its sentence. Null texts have none."""
    kinds = [("material", n, re.compile(p, re.I)) for p, n, *_ in V.MATERIALS] + [("phase", n, re.compile(p, re.I)) for p, n, _ in V.PHASES] + [("property", n, re.compile(p.replace("(?i)", ""), re.I)) for n, p, *_ in V.PROPERTIES] + [("device", d, re.compile(rf"\b{d}\b", re.I)) for d in V.DEVICES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, n, m.start(), _sentence(t, m.start(), m.end())) for i, t in zip(b[id_col], b[text_col]) if t for k, n, rx in kinds for m in rx.finditer(t)]
            yield pd.DataFrame(rows, columns=[id_col, "kind", "name", "place", "evidence"])

    return spread(texts.select(id_col, text_col)).mapInPandas(run, f"{id_col} string, kind string, name string, place int, evidence string")


def with_model(chunks: DataFrame, call, batch: int = 32) -> DataFrame:
    """Extraction by a model: `call` takes texts and gives JSON strings; off unless a callable is given. A text that fails comes out null with its error."""

    def run(batches):
        for b in batches:
            out, err = [], []
            for s in range(0, len(b), batch):
                part = list(b["text"].iloc[s : s + batch])
                try:
                    out.extend(call(part))
                    err.extend([None] * len(part))
                except Exception as e:  # noqa: BLE001
                    out.extend([None] * len(part))
                    err.extend([str(e)[:200]] * len(part))
            yield pd.DataFrame({"chunk_id": b["chunk_id"].to_numpy(), "payload": out, "error": err})

    return chunks.select("chunk_id", "text").mapInPandas(run, "chunk_id string, payload string, error string")


def json_object(c: Column) -> Column:
    """The JSON object inside a model's answer: from the first brace to the last."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def validation_prompt(fact: dict) -> str:
    """What a model is asked about a fact: whether it agrees with its evidence, as JSON with verdict, confidence and issues."""
    import json as js

    return "Does this fact agree with its evidence in value, unit, property and material? Answer with one JSON object with the keys verdict (valid, needs_check or reject), confidence (0 to 1) and issues (a list of texts).\n" + js.dumps(fact, ensure_ascii=False, sort_keys=True, default=str)


def model_verdicts(facts: DataFrame, call=None, columns: tuple[str, ...] = ("material", "property_name", "value", "unit", "evidence_text")) -> DataFrame:
    """fact_id, verdict, confidence, issues by a model (an injected callable, prompt -> text).

    Without a callable, and where it fails or its answer can't be read, a fact gets needs_check with confidence 0 and the reason; an unknown verdict counts as needs_check, confidence is kept within 0 and 1."""

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                if call is None:
                    out.append((row["fact_id"], None, "no model is configured"))
                    continue
                try:
                    out.append((row["fact_id"], call(validation_prompt({c: row[c] for c in columns})), None))
                except Exception as e:  # noqa: BLE001
                    out.append((row["fact_id"], None, str(e)[:300]))
            yield pd.DataFrame(out, columns=["fact_id", "answer", "error"])

    got = spread(facts.select("fact_id", *columns)).mapInPandas(run, "fact_id string, answer string, error string")
    j = got.select("fact_id", "error", F.explode(F.array(F.from_json(json_object(F.col("answer")), "struct<verdict:string,confidence:double,issues:array<string>>"))).alias("r"))
    read = F.col("r.verdict").isNotNull() | F.col("r.confidence").isNotNull()
    issues = F.when(F.col("error").isNotNull(), F.array("error")).when(~read, F.array(F.lit("unreadable answer"))).otherwise(F.coalesce("r.issues", F.array().cast("array<string>")))
    verdict = F.when(F.col("r.verdict").isin("valid", "needs_check", "reject"), F.col("r.verdict")).otherwise("needs_check")
    return j.select("fact_id", verdict.alias("verdict"), F.when(read, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("r.confidence", F.lit(0.5))))).otherwise(0.0).alias("confidence"), F.array_join(issues, ";").alias("issues"))
