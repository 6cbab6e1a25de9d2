import json

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vocab as V
from corpusmill.operators import chunks, convert, facts, files, graph, literature, logs, ontology, retrieval
from corpusmill.sources import markdown, read_csv, write_csv


def test_split_text_packs_and_overlaps(spark):
    text = " ".join(f"Sentence number {i} is short." for i in range(160))
    parts = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(chunks.split_text(F.col("t"), 300, 520, 80)).collect()
    p = parts[0][0]
    assert len(p) > 1 and p[0][-40:] in p[1] and all(len(x) <= 520 + 82 for x in p)
    assert parts[1][0] == [] and parts[2][0] is None


def test_chunk_pages_numbers_through_pages_and_drops_references(spark):
    rows = [("a_p1", "x", "a", 1, "One. " * 200), ("a_p2", "x", "a", 2, "References\n[1] thing"), ("a_p3", "x", "a", 3, "Two two. " * 10), ("b_p1", "y", "b", 1, None)]
    got = chunks.chunk_pages(spark.createDataFrame(rows, "page_id string, paper_id string, pdf_id string, page_number int, text string")).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got)))
    assert got[-1].page_number == 3 and {r.pdf_id for r in got} == {"a"}


def test_table_chunk(spark):
    df = spark.createDataFrame([("a", 1, 0, [["x ", None], ["", " "], ["a\n b", "2"]]), ("a", 1, 1, [])], "pdf_id string, page_number int, table_index int, cells array<array<string>>")
    r = {x.table_index: x for x in chunks.table_chunk(df).collect()}
    assert (r[0].row_count, r[0].col_count, r[0].table_text) == (2, 2, "x | \na b | 2")
    assert (r[1].row_count, r[1].col_count, r[1].table_text) == (0, 0, "")


def test_identity_of_equal_files(spark):
    rows = [("b.pdf", "h" * 64), ("a.pdf", "h" * 64), ("c.pdf", None)]
    r = {x.file_path: x for x in files.with_identity(spark.createDataFrame(rows, "file_path string, sha256 string")).collect()}
    assert not r["a.pdf"].is_dup and r["b.pdf"].is_dup and r["b.pdf"].dup_of == "pdf_" + "h" * 16 and r["b.pdf"].new_pdf_id.endswith("_1")
    assert not r["c.pdf"].is_dup


def test_scan_files_hashes_and_sees_suffix_in_any_case(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1 x")
    (tmp_path / "d" / "b.PDF").write_bytes(b"%PDF-1 x")
    (tmp_path / "c.txt").write_bytes(b"no")
    r = files.scan_files(spark, str(tmp_path)).collect()
    assert len(r) == 2 and len({x.sha256 for x in r}) == 1 and {x.magic for x in r} == {"%PDF-"}


def test_upsert_overwrites_keeps_and_adds(spark):
    base = spark.createDataFrame([("1", "old", "k", 1), ("2", "old", "k", 2)], "id string, a string, b string, c int")
    new = spark.createDataFrame([("1", None, None), ("3", "new", "n")], "id string, a string, b string")
    r = {x.id: x for x in files.upsert(base, new, ["id"], ["a"], ["b"]).collect()}
    assert tuple(r["1"]) == ("1", None, "k", 1) and tuple(r["2"]) == ("2", "old", "k", 2) and tuple(r["3"]) == ("3", "new", "n", None)
    again = {x.id: tuple(x) for x in files.upsert(files.upsert(base, new, ["id"], ["a"], ["b"]), new, ["id"], ["a"], ["b"]).collect()}
    assert again == {k: tuple(v) for k, v in r.items()}


def test_evolve_adds_defaults(spark):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    df = spark.createDataFrame([("a", "5")], "id string, n string")
    r = files.evolve(df, StructType([StructField("id", StringType()), StructField("n", IntegerType()), StructField("s", StringType())]), {"s": "pending"}).first()
    assert tuple(r) == ("a", 5, "pending")


def test_page_quality_handles_null_and_blank(spark):
    r = files.page_quality(spark.createDataFrame([("a", "x" * 80), ("a", ""), ("a", None), ("a", "low")], "pdf_id string, text string")).first()
    assert (r.n_pages, r.text_pages, r.blank_pages, r.low_text_pages, r.quality, r.needs_ocr) == (4, 1, 2, 1, 0.25, True)


@pytest.mark.parametrize(("text", "want"), [("The film showed 2Pr of 40.5 μC/cm² after cycling", [("double_remanent_polarization_2Pr", 40.5, "μC/cm²")]), ("a 2. Pr = 30 uC/cm2 loop", [("double_remanent_polarization_2Pr", 30.0, "μC/cm²")]), ("Ec of 1200 kV/cm", [("coercive_field_Ec", 1200.0, "kV/cm")]), ("endurance of 10^9 cycles", [("endurance_cycles", 1e9, "cycles")]), ("nothing", []), ("", [])])
def test_properties(spark, text, want):
    r = spark.createDataFrame([(text,)], "t string").select(facts.properties(F.col("t")).alias("p")).first().p
    assert [(x.property_name, x.value, x.unit) for x in r] == want


def test_normalize_property_scales_and_warns(spark):
    rows = [("coercive_field_Ec", 1200.0, "kV/cm"), ("double_remanent_polarization_2Pr", 250.0, "uC/cm2"), ("remanent_polarization_Pr", None, None)]
    r = facts.normalize_property(spark.createDataFrame(rows, "property_name string, value double, unit string")).collect()
    assert r[0].normalized_value == pytest.approx(1.2) and r[0].normalized_unit == "MV/cm" and not r[0].needs_check
    assert r[1].needs_check and "reported_as_2Pr" in r[1].warnings and r[2].normalized_value is None and not r[2].needs_check


def test_evidence_widens_short_sentences(spark):
    t = "Before it all there was a long introduction to hafnia here. HZO won. And after it came more text of some length."
    r = spark.createDataFrame([(t,), ("x",)], "t string").select(facts.evidence(F.col("t"), "HZO").alias("e")).collect()
    assert len(r[0].e) >= 40 and "HZO won" in r[0].e and r[1].e is None


def test_context_grades(spark):
    full = "A 10 nm HfO2 film by ALD, annealed at 500 C, orthorhombic, TiN/HfO2/TiN capacitor"
    r = facts.with_context(spark.createDataFrame([("f", full), ("g", "nothing"), ("h", None)], "fact_id string, evidence_text string")).collect()
    assert r[0].quality == "strong" and r[0].comparison_ready and r[0].score == 1.0
    assert r[1].quality == "weak" and r[2].quality == "weak" and r[2].score == 0.0


def test_graph_of_a_fact(spark):
    f = spark.createDataFrame([("f1", "p1", "T", "HfO2", "2Pr", 4.0, "u", "A 10 nm HfO2 film by ALD with TiN, cubic, capacitor")], "fact_id string, paper_id string, title string, material string, property_name string, value double, unit string, evidence_text string")
    c = facts.with_context(f)
    kinds = {r.type for r in graph.edges(c).collect()}
    assert {"REPORTS", "SUPPORTED_BY", "FROM_PAPER", "HAS_PHASE", "FABRICATED_BY", "USED_IN"} <= kinds
    n = graph.nodes(c)
    assert n.count() >= 9 and "graph" in graph.to_html(n, graph.edges(c))
    assert graph.nodes(facts.with_context(f.limit(0))).count() == 0


def test_range_stats_matches_plain_python(spark):
    rows = [("a", "Pr", 3.0, "uC/cm2"), ("b", "Pr", None, "uC/cm2"), ("c", "memory_window", 2.0, "V"), ("d", "memory_window", 1.0, "V"), ("e", "memory_window", 9.0, "s")]
    r = {x.property_name: x for x in facts.range_stats(spark.createDataFrame(rows, "fact_id string, property_name string, value double, unit string"), ["property_name"]).collect()}
    m = r["memory_window"]
    assert (m.n, m.n_candidates, m.n_excluded_unit, m.min_v, m.max_v, m.median_v, m.min_fact_id, m.max_fact_id) == (3, 3, 1, 1.0, 2.0, 1.5, "d", "c")


def test_anomalies(spark):
    rows = [("a", "remanent_polarization_Pr", 124.5, "Pr 124"), ("b", "remanent_polarization_Pr", 40.0, "2.Pr of 40"), ("c", "coercive_field_Ec", -1.0, ""), ("d", "coercive_field_Ec", 10.0, None)]
    r = sorted((x.fact_id, x.reason) for x in facts.anomalies(spark.createDataFrame(rows, "fact_id string, property_name string, value double, evidence_text string")).collect())
    assert r == [("a", "above_limit"), ("b", "evidence_mentions_2Pr"), ("c", "negative_value")]


def test_mentions_agree_with_patterns(spark):
    r = facts.mentions(spark.createDataFrame([("1", "HZO and HZO; amorphous FeFET"), ("2", None)], "id string, t string"), "id", "t").collect()
    assert sorted((x.kind, x.name) for x in r) == [("device", "FeFET"), ("material", "Hf0.5Zr0.5O2"), ("material", "Hf0.5Zr0.5O2"), ("phase", "amorphous")]


def test_model_extraction_routes_errors(spark):
    def call(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [json.dumps({"n": len(t)}) for t in texts]

    r = facts.with_model(spark.createDataFrame([("1", "good"), ("2", "bad")], "chunk_id string, text string"), call, batch=1).orderBy("chunk_id").collect()
    assert r[0].payload == '{"n": 4}' and r[1].payload is None and r[1].error == "no"
    assert spark.createDataFrame([('x {"a": 1} y',)], "t string").select(facts.json_object(F.col("t"))).first()[0] == '{"a": 1}'


UNITS = [
    ("f1", "coercive_field_Ec", 1200.0, "kV/cm", "", "1.20e+00"),
    ("f2", "coercive_field_Ec", 1.2, " MV cm−1.", "", None),
    ("f3", "double_remanent_polarization_2Pr", 0.4, "", "2Pr = 0.4 C/m2 (HZO, 5 nm)", "4.00e+01"),
    ("f4", "endurance_cycles", 5.29, None, "endurance of 5.29 10^3 cycles was", "5.29e+03"),
    ("f5", "leakage_current_density", 408.0, "see text", "We report 408 ×10⁻⁷ A/cm² for J", "4.08e-05"),
    ("f6", "band_gap", 9.43e-19, "-", "9.43×10^-19 J is found", "5.89e+00"),
    ("f7", "retention_time", 2.0, "years", "", "6.31e+07"),
    ("f8", "retention_time", 2.0, "K", "", None),
    ("f9", "memory_window", None, "mV", "", None),
    ("f10", "memory_window", 5.0, None, None, None),
    ("f11", "unknown_property", 5.0, "mV", "", None),
    ("f12", "coercive_field_Ec", -0.8, None, "-0.8 MV/m is", "-8.00e-03"),
]
PROPS = [("coercive_field_Ec", "MV/cm"), ("double_remanent_polarization_2Pr", "μC/cm²"), ("endurance_cycles", "cycles"), ("leakage_current_density", "A/cm²"), ("band_gap", "eV"), ("retention_time", "s"), ("memory_window", "V")]


def test_convert(spark):
    f = spark.createDataFrame([r[:5] for r in UNITS] + [UNITS[0][:5]], "fact_id string, property_name string, value double, unit string, evidence_text string").withColumn("canon", F.lit("clash"))
    p = spark.createDataFrame(PROPS, "property_name string, common_unit string")
    got = convert.converted(f, p).collect()
    assert {r.fact_id: r.common_value for r in got} == {r[0]: r[5] for r in UNITS if r[5]} and len(got) == len({r.fact_id for r in got})
    assert convert.with_units(f, p).count() == f.count() and "canon" in convert.with_units(f, p).columns
    assert convert.converted(f.limit(0), p).count() == 0


def test_literature_merge_prefers_first_service(spark):
    a = {"id": "W1", "doi": "https://doi.org/10.1/A", "title": "Ferroelectric HfO2 <i>films</i>", "publication_year": 2020, "authorships": [{"raw_author_name": "X Y"}], "abstract_inverted_index": {"late": [1], "Early": [0], "wins": [1]}}
    b = {"DOI": "10.1/a", "title": ["Ferroelectric HfO2 films"], "author": [{"given": "X", "family": "Y"}], "published-online": {"date-parts": [[2021, 2]]}, "link": [{"content-type": "application/pdf", "URL": "u"}]}
    raw = lambda x: spark.createDataFrame([("q", json.dumps(x)), ("q", "not json")], "query string, json string")
    oa, cr = literature.from_openalex(raw(a)), literature.from_crossref(raw(b))
    o, c = oa.first(), cr.first()
    assert (o.title, o.doi, o.abstract, o.authors) == ("Ferroelectric HfO2 films", "10.1/a", "Early wins", "X Y")
    assert (c.doi, c.year, c.pdf_url, c.authors) == ("10.1/a", 2021, "u", "X Y")
    assert [r.source for r in literature.merged(oa, cr).collect()] == ["openalex"]


def test_fetcher_uses_what_is_given():
    f = literature.Fetcher(lambda url: json.dumps({"results": [{"id": 1}]} if "openalex" in url else {"message": {"items": [{"DOI": "d"}]}}))
    assert f.openalex("q", "2020", "2021", 5) == ['{"id": 1}'] and f.crossref("q", "2020", "2021", 5) == ['{"DOI": "d"}']


def test_tfidf_finds_the_right_document(spark):
    d = spark.createDataFrame([(1, "hafnia film with high polarization"), (2, "silicon wafer"), (3, "")], "id int, t string")
    idx = retrieval.index(d, "id", "t")
    assert idx.groupBy("id").agg(F.round(F.sum(F.col("weight") ** 2), 6).alias("s")).where("s <> 1").count() == 0
    hits = retrieval.search(idx, d, spark.createDataFrame([(1, "polarization of hafnia")], "query_id int, query string"), "id", 3).collect()
    assert [h.id for h in hits] == [1]


def test_question_intent_and_answer(spark):
    q = {r.question_id: r for r in retrieval.questions(spark).collect()}
    assert q[1].want_property == "double_remanent_polarization_2Pr" and q[1].want_family == "HZO" and q[5].want_property is None
    assert "No accepted evidence" in retrieval.answer_text("q", None, [])
    assert "10.1/x" in retrieval.answer_text("q", {"facts": 1, "numeric": 1, "min_v": 1.0, "max_v": 2.0, "median_v": 1.5}, [{"doi": "10.1/x"}])


def test_logs(spark, tmp_path):
    logs.append(spark, str(tmp_path / "runs"), "step", "ok", {"n": 1})
    assert spark.read.parquet(str(tmp_path / "runs")).first().step_name == "step"
    lines = spark.createDataFrame([(1, "processed=5 candidates=2 llm_used=0 llm_failed=0 empty=1 errors=0"), (2, "noise")], "n int, line string")
    r = logs.progress(lines, "n", "line", 10).first()
    assert (r.processed, r.remaining, r.percent) == (5, 5, 50.0) and logs.duration(3661) == "1h 1m 1s"
    assert logs.progress(lines.where("n = 2"), "n", "line", 10).count() == 0


def test_ontology_is_sound_and_faults_are_named(spark):
    assert ontology.problems(spark).count() == 0
    bad = {"nodes": {"A": "k"}, "relations": [["R", "A", "B"]]}
    assert [tuple(r) for r in ontology.problems(spark, bad).collect()] == [("unknown_end", "R", "B")]
    assert ontology.checksum(bad) != ontology.checksum(ontology.default())


def test_csv_round_trip_and_report(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b", [1, 2], True)], "x string, l array<int>, f boolean")
    write_csv(df, str(tmp_path / "c"), ["x", "l", "f", "missing"], one_file=True)
    r = read_csv(spark, str(tmp_path / "c"), "x string, l string, f int, missing string").first()
    assert tuple(r) == ('a,"b', "[1,2]", 1, None)
    assert "| x |" in markdown("t", {"s": df.select("x")})


def test_vocabulary_lists_are_lower_case():
    assert all(w == w.lower() for w in V.HFO2_KEYWORDS + V.PROPERTY_KEYWORDS + V.PROCESS_KEYWORDS)
