"""Extraction results as payloads: candidates and facts of chunks, payloads coerced from a model's JSON, context merged from further sources, schema checks.

All of it is built-in expressions over columns; a payload is a struct (materials, samples, phases, properties, devices), never a parsed Python object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V

from . import facts as X

# The keys that models use for one thing, the one of the schema first.
KEYS = {
    "materials": ("materials", "material"), "raw_name": ("raw_name", "material_name", "name", "material", "composition", "formula"), "canonical_name": ("canonical_name", "formula", "composition", "material_name", "name"), "family": ("material_family", "family", "material_system", "material_type"),
    "dopants": ("dopant_elements", "dopants", "dopant", "alloying_elements"), "zr_fraction": ("zr_fraction", "Zr_fraction", "x", "zr_content"), "material_ref": ("material_ref", "material_name", "canonical_name"),
    "samples": ("samples", "sample", "thin_film_samples", "processes"), "film_thickness_nm": ("film_thickness_nm", "thickness_nm", "film_thickness"), "deposition_method": ("deposition_method", "deposition", "fabrication_method"), "annealing_temperature_c": ("annealing_temperature_c", "anneal_temperature_c", "annealing_temperature"),
    "top_electrode": ("top_electrode", "top_contact"), "bottom_electrode": ("bottom_electrode", "bottom_contact"), "substrate": ("substrate",), "device_stack": ("device_stack", "stack", "electrode_stack"), "annealing_time_s": ("annealing_time_s", "anneal_time_s", "annealing_time"),
    "annealing_atmosphere": ("annealing_atmosphere", "anneal_atmosphere", "atmosphere"), "sample_form": ("sample_form", "device_type", "form"), "phases": ("phases", "phase", "phase_structures", "structures"), "phase_name": ("phase_name", "phase", "structure", "crystal_phase"), "space_group": ("space_group", "spacegroup"),
    "properties": ("properties", "property", "ferroelectric_properties", "facts", "measurements"), "raw_property_name": ("raw_property_name", "property_name", "property", "name", "metric"), "property_name": ("property_name", "normalized_property_name"), "value": ("value", "raw_value", "numeric_value"), "unit": ("unit", "raw_unit"),
    "devices": ("devices", "device"), "device_type": ("device_type", "type", "name"), "warnings": ("warnings", "notes", "uncertainties"), "evidence": ("evidence_text", "evidence", "source_text", "source_sentence", "sentence", "quote"),
}
# The fields by which a material is a sample too.
SAMPLE_MARKS = ("film_thickness_nm", "thickness_nm", "deposition_method", "annealing_temperature_c", "anneal_temperature_c", "top_electrode", "bottom_electrode", "device_stack")
DOPANTS = ("Zr", "Si", "Al", "La", "Y", "Gd", "Sr")
SAMPLE_FIELDS = ["film_thickness_nm", "deposition_method", "annealing_temperature_c", "top_electrode", "bottom_electrode", "substrate", "device_stack", "sample_form"]


def _short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """The frame with the column, computed once a row: a generator stands between it and what reads its fields, so that the optimiser doesn't repeat the expression for each field."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


# extraction of chunks


def extract_chunks(chunks: DataFrame, text: str = "text") -> DataFrame:
    """The chunks with `payload`: what rules find in the text. A sample's form alone is no sample; null text gives an empty payload."""
    c = F.coalesce(F.col(text), F.lit(""))
    s = X.sample(c)
    p = F.struct(X.materials(c).alias("materials"), F.when(s.isNull(), F.array().cast(f"array<{_SAMPLE_TYPE}>")).otherwise(F.array(s)).alias("samples"), X.phases(c).alias("phases"), X.properties(c, with_sentence=True).alias("properties"), X.devices(c).alias("devices"))
    return _once(chunks, "payload", p)


_SAMPLE_TYPE = "struct<film_thickness_nm:double,deposition_method:string,annealing_temperature_c:double,top_electrode:string,bottom_electrode:string,substrate:string,device_stack:string,sample_form:string>"


def candidates(chunks: DataFrame, version: str) -> DataFrame:
    """One candidate a chunk: candidate_id, paper_id, pdf_id, chunk_id, page_number, version, status, payload. A chunk in which nothing was found gets the status
    empty_result, so that a later run of the same version passes it over."""
    p = extract_chunks(chunks)
    found = sum((F.size(f"payload.{k}") for k in ("materials", "samples", "phases", "properties", "devices")), F.lit(0)) > 0
    v = F.lit(version)
    return p.select(
        F.when(found, _short_id("cand_", F.col("chunk_id"), v)).otherwise(_short_id("cand_empty_", F.col("chunk_id"), v)).alias("candidate_id"),
        "paper_id", "pdf_id", "chunk_id", "page_number", v.alias("version"), F.when(found, "extracted").otherwise("empty_result").alias("status"), "payload",
    )


def with_errors(cand: DataFrame, errors: DataFrame) -> DataFrame:
    """Candidates with the status extraction_error and the message where a model failed on the chunk. errors: chunk_id, error."""
    e = errors.where("error is not null").groupBy("chunk_id").agg(F.min("error").alias("error_message"))
    j = cand.join(e, "chunk_id", "left")
    bad = F.col("error_message").isNotNull()
    return j.select(F.when(bad, _short_id("cand_error_", F.col("chunk_id"), F.col("error_message"))).otherwise(F.col("candidate_id")).alias("candidate_id"), *[c for c in cand.columns if c not in ("candidate_id", "status")], F.when(bad, "extraction_error").otherwise(F.col("status")).alias("status"), "error_message")


def pending(chunks: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """High-value chunks that have no candidate of this version yet."""
    return chunks.where("is_high_value").join(done.where(F.col("version") == version).select("chunk_id").distinct(), "chunk_id", "left_anti")


def facts_of(cand: DataFrame) -> DataFrame:
    """One fact a property of each candidate, with the candidate's first material and sample."""
    f = cand.where("status = 'extracted'").select("candidate_id", "paper_id", "pdf_id", "chunk_id", "page_number", F.posexplode("payload.properties").alias("place", "p"), F.get("payload.materials", F.lit(0)).alias("m"), F.get("payload.samples", F.lit(0)).alias("sample"), "payload.phases", "payload.devices")
    return f.select(
        _short_id("fact_", F.col("candidate_id"), F.col("place").cast("string")).alias("fact_id"), "candidate_id", "paper_id", "pdf_id", "chunk_id", "page_number", "place", F.col("m.canonical_name").alias("material"), F.col("m.family").alias("material_family"),
        "p.property_name", F.col("p.raw_name").alias("raw_property_name"), "p.value", "p.unit", F.substring("p.evidence", 1, 700).alias("evidence_text"), "sample", "phases", "devices",
    )


# payloads of a model


_MAP = "map<string,string>"


def pick(obj: Column, *keys: str) -> Column:
    """The first of the keys whose value in the parsed JSON object (a map of texts) isn't null, blank or an empty list; objects and lists as JSON."""
    found = [F.try_element_at(obj, F.lit(k)) for k in keys]
    return F.coalesce(*[F.when(~v.isin("", "[]", "null"), v) for v in found])


def as_list(value: Column) -> Column:
    """The elements as texts: of a JSON list its elements, of anything else itself, of null none."""
    none = F.array().cast("array<string>")
    return F.when(value.isNull(), none).when(value.startswith("["), F.coalesce(F.from_json(value, "array<string>"), none)).otherwise(F.array(value))


def number_of(value: Column) -> Column:
    """A number as it stands, else the first number in the text; truth values are none."""
    return F.when(value.isin("true", "false"), None).otherwise(F.coalesce(T.strip(value).try_cast("double"), X.parse_numeric(value)))


def string_of(value: Column) -> Column:
    return T.nonempty(T.strip(value))


def family_of(value: Column) -> Column:
    """The material family that a name says."""
    low = F.lower(value)
    out = F.when(low.contains("hzo") | low.contains("zr"), "HZO")
    for mark, name in (("si", "Si:HfO2"), ("al", "Al:HfO2"), ("la", "La:HfO2")):
        out = out.when(low.contains(mark), name)
    out = out.when(low.contains("y:") | low.startswith("y") | low.contains(" y-"), "Y:HfO2").when(low.contains("gd"), "Gd:HfO2").when(low.contains("sr"), "Sr:HfO2")
    return out.when(low.rlike("hfo2|hafnia|hafnium"), "HfO2").otherwise("unknown_hafnia")


def phase_of(value: Column) -> Column:
    low = F.lower(value)
    out = F.when(low.rlike("pca|orth"), "orthorhombic")
    for marks, name in (("monoclinic|p21/c", "monoclinic"), ("tetragonal|p42", "tetragonal"), ("cubic", "cubic"), ("rhombo", "rhombohedral"), ("amorph", "amorphous"), ("mixed", "mixed")):
        out = out.when(low.rlike(marks), name)
    return out.otherwise("unknown")


def unit_in(evidence: Column, prop: Column) -> Column:
    """The unit that an evidence text names, for a property."""
    return (
        F.when(evidence.rlike(r"(?i)(?:μ|µ|u)\s*C\s*/?\s*cm(?:\^?2|²|−2|-2)"), "μC/cm²").when(evidence.rlike(r"(?i)\bkV\s*/?\s*cm\b"), "kV/cm").when(evidence.rlike(r"(?i)\bMV\s*/?\s*cm\b"), "MV/cm")
        .when(F.lower(evidence).contains("cycles") | (prop == "endurance_cycles"), "cycles").when((prop == "memory_window") & evidence.rlike(r"(?i)\bV\b"), "V")
    )


def evidence_of(item: Column, text: Column, *needles: Column) -> Column:
    """The item's own evidence, else the sentence of the first needle that the text has, else the text's beginning; at most 700 characters, blanks tidied."""
    own = string_of(pick(item, *KEYS["evidence"]))
    tidy = lambda c: F.substring(T.strip(F.regexp_replace(c, r"\s+", " ")), 1, 700)
    outs = [F.substring(own, 1, 700)]
    for n in needles:
        n = string_of(n)
        at = F.position(F.lower(n), F.lower(text))
        before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, at + F.char_length(n), F.char_length(text))
        stop = F.regexp_extract(after, r"^[^.\n]*[.\n]", 0)
        outs.append(F.when(at > 0, tidy(F.concat(F.regexp_extract(before, r"[^.\n]*$", 0), F.substring(text, at, F.char_length(n)), F.when(stop != "", stop).otherwise(F.substring(after, 1, 260))))))
    return F.coalesce(*outs, tidy(F.substring(text, 1, 700)))


def extraction_prompt(text: str) -> str:
    """What a model is asked about a chunk: one JSON object in the schema's keys, with the sentence of each item."""
    keys = {k: KEYS[k][0] for k in ("materials", "samples", "phases", "properties", "devices")}
    return (
        f"Extract what the text reports about ferroelectric hafnia. Answer with one JSON object with the lists {', '.join(keys.values())}. Properties have {KEYS['property_name'][0]} (one of {', '.join(V.PROPERTY_NAMES)}), value, unit and "
        f"{KEYS['evidence'][0]}, the sentence that says it. Leave out what the text doesn't say.\n\n{text}"
    )


def coerce_payload(answers: DataFrame, json: str = "json", text: str = "text") -> DataFrame:
    """The answers with `payload`: a model's JSON object, whatever keys it uses for the same thing, single values for lists or texts for objects, brought into one form.

    Items that lack what they need are left out: materials without a name, samples without any field, properties that aren't of the schema or have a value without a unit,
    devices without a type. JSON that can't be read gives an empty payload."""
    answers = _once(answers, "__j", F.from_json(X.json_object(F.col(json)), _MAP))
    j = F.col("__j")
    t = F.coalesce(F.col(text), F.lit(""))
    maps = lambda xs: F.transform(F.filter(xs, lambda x: x.startswith("{")), lambda x: F.from_json(x, _MAP))
    objects = lambda name: maps(as_list(pick(j, *KEYS[name])))
    number, string = (lambda x, name: number_of(pick(x, *KEYS[name]))), (lambda x, name: string_of(pick(x, *KEYS[name])))

    def named(m: Column) -> Column:
        raw = pick(m, *KEYS["raw_name"])
        given = F.filter(F.transform(as_list(pick(m, *KEYS["dopants"])), lambda d: T.strip(d)), lambda d: d != "")
        return F.struct(m.alias("m"), raw.alias("raw"), F.coalesce(pick(m, *KEYS["canonical_name"]), raw).alias("canon"), given.alias("given"))

    def material(x: Column) -> Column:
        m, raw, canon, given = (x[k] for k in ("m", "raw", "canon", "given"))
        said = F.array_compact(F.array(*[F.when(F.concat(raw, F.lit(" "), canon).rlike(rf"(?i)\b{e}\b"), e) for e in DOPANTS]))
        family = family_of(F.coalesce(pick(m, *KEYS["family"]), F.concat_ws(" ", raw, canon, given)))
        return F.struct(raw.alias("raw_name"), canon.alias("canonical_name"), family.alias("family"), F.when(F.size(given) > 0, given).otherwise(said).alias("dopants"), number(m, "zr_fraction").alias("zr_fraction"), evidence_of(m, t, raw, canon).alias("evidence"))

    raw_materials = as_list(pick(j, *KEYS["materials"]))
    as_map = lambda x: F.when(x.startswith("{"), F.from_json(x, _MAP)).otherwise(F.create_map(F.lit("raw_name"), x))
    answers = _once(answers, "__materials", F.transform(F.filter(F.transform(F.transform(raw_materials, as_map), named), lambda x: x["raw"].isNotNull()), material))
    ref = F.coalesce(F.get("__materials", F.lit(0))["canonical_name"], pick(j, *KEYS["material_ref"]), F.lit("HfO2"))
    numbers = ("film_thickness_nm", "annealing_temperature_c", "annealing_time_s")
    fields = ("film_thickness_nm", "deposition_method", "annealing_temperature_c", "top_electrode", "bottom_electrode", "substrate", "device_stack", "annealing_time_s", "annealing_atmosphere")

    def sample(x: Column) -> Column:
        return F.struct(*[(number if k in numbers else string)(x, k).alias(k) for k in fields], F.coalesce(string(x, "sample_form"), F.lit("unknown")).alias("sample_form"))

    sources = F.concat(objects("samples"), F.filter(maps(raw_materials), lambda x: F.exists(F.array(*[F.lit(k) for k in SAMPLE_MARKS]), lambda k: F.map_contains_key(x, k))))
    samples = F.filter(F.transform(sources, sample), lambda x: F.coalesce(*[x[k].cast("string") for k in fields]).isNotNull())

    def phase(x: Column) -> Column:
        group = pick(x, *KEYS["space_group"])
        return F.struct(phase_of(F.coalesce(pick(x, *KEYS["phase_name"]), group, F.lit("unknown"))).alias("phase_name"), string_of(group).alias("space_group"))

    def measured(x: Column) -> Column:
        raw, given = pick(x, *KEYS["raw_property_name"]), pick(x, *KEYS["property_name"])
        name = F.when(given.isin(V.PROPERTY_NAMES), given).otherwise(X.property_alias(F.coalesce(raw, given, F.lit(""))))
        return F.struct(x.alias("m"), raw.alias("raw"), name.alias("name"), number(x, "value").alias("value"), evidence_of(x, t, raw, pick(x, "value")).alias("ev"))

    def with_unit(x: Column) -> Column:
        return F.struct(x.alias("x"), F.coalesce(string(x["m"], "unit"), unit_in(x["ev"], x["name"])).alias("unit"))

    def prop(y: Column) -> Column:
        x, unit = y["x"], y["unit"]
        sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nullif(number_of(pick(x["m"], "confidence")), F.lit(0.0)), F.lit(0.55))))
        return F.struct(x["name"].alias("property_name"), F.coalesce(x["raw"], x["name"]).alias("raw_name"), x["value"].alias("value"), unit.alias("unit"), X.normalize_unit(unit).alias("normalized_unit"), sure.alias("confidence"), x["ev"].alias("evidence"))

    known = F.filter(F.transform(objects("properties"), measured), lambda x: x["name"].isNotNull())
    properties = F.transform(F.filter(F.transform(known, with_unit), lambda y: y["x"]["value"].isNull() | y["unit"].isNotNull()), prop)
    devices = F.filter(F.transform(objects("devices"), lambda x: pick(x, *KEYS["device_type"])), lambda x: x.isNotNull())
    warnings = F.filter(F.transform(as_list(pick(j, *KEYS["warnings"])), lambda w: T.strip(w)), lambda w: w != "")
    payload = F.struct(ref.alias("material_ref"), F.col("__materials").alias("materials"), samples.alias("samples"), F.transform(objects("phases"), phase).alias("phases"), properties.alias("properties"), devices.alias("devices"), warnings.alias("warnings"))
    return _once(answers, "payload", payload).drop("__materials", "__j")


# context from further sources


def merge_context(facts: DataFrame, candidate: str, chunk: str) -> DataFrame:
    """The facts with material, sample, phases and devices completed: what a fact has stays; its candidate's payload fills what is missing, then the rules' payload of its chunk.

    candidate and chunk name payload structs (null where there is none). A sample is completed field by field; candidate phases and devices count only where the fact has none,
    the chunk's are added where they are new. `sources` tells who gave something."""
    first = lambda p, k: F.get(F.col(f"{p}.{k}"), F.lit(0))
    has = T.nonempty(F.trim("material"))
    names = [first(p, "materials")["canonical_name"] for p in (candidate, chunk)]
    material = F.coalesce(has, *names)
    mine = [F.col("sample")[k] for k in SAMPLE_FIELDS]
    theirs = [[first(p, "samples")[k] for k in SAMPLE_FIELDS] for p in (candidate, chunk)]
    sample = F.struct(*[F.coalesce(a, b, c).alias(k) for k, a, b, c in zip(SAMPLE_FIELDS, mine, *theirs)])
    gave = lambda later, *before: F.exists(F.array(*[F.coalesce(*b).isNull() & x.isNotNull() for x, b in zip(later, zip(*before))]), lambda z: z)
    none_p, none_d = F.array().cast("array<struct<phase_name:string,space_group:string>>"), F.array().cast("array<string>")
    or_none = lambda c, none: F.coalesce(c, none)
    p0, d0 = or_none(F.col("phases"), none_p), or_none(F.col("devices"), none_d)
    p1, d1 = (F.when(F.size(own) > 0, own).otherwise(or_none(F.col(f"{candidate}.{k}"), none)) for own, k, none in ((p0, "phases", none_p), (d0, "devices", none_d)))
    new_p = F.filter(or_none(F.col(f"{chunk}.phases"), none_p), lambda x: ~F.exists(p1, lambda y: y["phase_name"] == x["phase_name"]))
    new_d = F.array_except(or_none(F.col(f"{chunk}.devices"), none_d), d1)
    by_candidate = (has.isNull() & names[0].isNotNull()) | gave(theirs[0], mine) | (F.size(p1) != F.size(p0)) | (F.size(d1) != F.size(d0))
    by_chunk = (F.coalesce(has, names[0]).isNull() & names[1].isNotNull()) | gave(theirs[1], mine, theirs[0]) | (F.size(new_p) > 0) | (F.size(new_d) > 0)
    any_field = F.coalesce(*[sample[k].cast("string") for k in SAMPLE_FIELDS]).isNotNull()
    f = facts.withColumn("__m", material).withColumn("__s", F.when(any_field, sample)).withColumn("__p", F.concat(p1, new_p)).withColumn("__d", F.concat(d1, new_d))
    f = f.withColumn("sources", F.array_join(F.array_compact(F.array(F.when(by_candidate, "candidate"), F.when(by_chunk, "chunk"), F.lit("fact"))), ","))
    keep = [c for c in facts.columns if c not in ("material", "sample", "phases", "devices")]
    return f.select(*keep, F.col("__m").alias("material"), F.col("__s").alias("sample"), F.col("__p").alias("phases"), F.col("__d").alias("devices"), "sources")


# schema


def schema_problems(facts: DataFrame) -> DataFrame:
    """fact_id, field, reason: what keeps a fact out of the schema; several rows a fact, none for a sound one. Optional columns (zr_fraction, film_thickness_nm, confidence) are checked where they are."""
    c = F.col
    checks = [
        (c("paper_id").isNull(), "paper_id", "missing"), (F.char_length(F.coalesce("evidence_text", F.lit(""))) < 8, "evidence_text", "too_short"), (~F.coalesce(c("property_name").isin(V.PROPERTY_NAMES), F.lit(False)), "property_name", "not_in_schema"),
        (c("value").isNotNull() & (F.coalesce("unit", F.lit("")) == ""), "unit", "required_with_value"), (c("material_family").isNotNull() & ~c("material_family").isin(V.FAMILIES), "material_family", "not_in_schema"),
    ]
    bounds: dict[str, Column] = {}
    for name, low, high in (("zr_fraction", 0.0, 1.0), ("confidence", 0.0, 1.0)):
        if name in facts.columns:
            bounds[name] = ~c(name).between(low, high)
    if "film_thickness_nm" in facts.columns:
        bounds["film_thickness_nm"] = c("film_thickness_nm") <= 0
    checks += [(cond, name, "out_of_bounds") for name, cond in bounds.items()]
    rows = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(f).alias("field"), F.lit(r).alias("reason"))) for cond, f, r in checks]))
    return facts.select("fact_id", F.explode(rows).alias("r")).select("fact_id", "r.field", "r.reason")
