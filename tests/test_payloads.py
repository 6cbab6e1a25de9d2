import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import chunks, convert, facts, files, graph, literature, numbering, ontology, payloads, titles

TEXT = "A 10 nm film of Hf0.5Zr0.5O2 was grown by ALD with TiN electrodes. The orthorhombic capacitor showed 2Pr of 40 μC/cm2 after anneal at 450 °C."


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


CHUNK = "chunk_id string, paper_id string, pdf_id string, page_number int, text string, is_high_value boolean"


def test_candidates_facts_and_empty_markers(spark):
    rows = [("c1", "p", "f", 2, TEXT, True), ("c2", "p", "f", 3, "Nothing of interest here.", True), ("c3", "p", "f", 3, None, True), ("c4", "p", "f", 3, TEXT, False)]
    c = frame(spark, rows, CHUNK)
    cand = payloads.candidates(payloads.pending(c, frame(spark, [], "chunk_id string, version string"), "v1"), "v1")
    got = {r.chunk_id: r for r in cand.collect()}
    assert set(got) == {"c1", "c2", "c3"} and got["c1"].status == "extracted" and {got[k].status for k in ("c2", "c3")} == {"empty_result"}
    assert got["c2"].candidate_id.startswith("cand_empty_") and got["c1"].payload.samples[0].film_thickness_nm == 10.0
    f = payloads.facts_of(cand).collect()
    assert [(r.chunk_id, r.property_name, r.value, r.material) for r in f] == [("c1", "double_remanent_polarization_2Pr", 40.0, "Hf0.5Zr0.5O2")] and "40" in f[0].evidence_text
    assert payloads.pending(c, cand, "v1").count() == 0 and payloads.pending(c, cand, "v2").count() == 3
    err = payloads.with_errors(cand, frame(spark, [("c2", "timeout"), ("c1", None)], "chunk_id string, error string")).collect()
    assert {r.chunk_id: r.status for r in err} == {"c1": "extracted", "c2": "extraction_error", "c3": "empty_result"}
    assert payloads.candidates(c.limit(0), "v1").count() == 0


def test_payload_of_other_keys_is_coerced(spark):
    answer = {
        "material_name": "x", "material": {"material_name": "La-doped HfO2", "thickness_nm": "about 12 nm", "top_electrode": "TiN"}, "phase": {"spacegroup": "Pca21"},
        "facts": [{"metric": "2Pr", "value": "38.5", "confidence": 3}, {"metric": "colour", "value": 1, "unit": "x"}, {"property_name": "band_gap", "value": 5}, "text"], "device": {"type": "FeFET"}, "notes": ["one", " "],
    }
    rows = [("a", TEXT, "Here:\n" + json.dumps(answer) + "\nbye"), ("b", TEXT, "no json"), ("c", None, "{}"), ("d", TEXT, None), ("e", TEXT, "{broken}")]
    got = {r.id: r.payload for r in payloads.coerce_payload(frame(spark, rows, "id string, text string, json string")).collect()}
    p = got["a"]
    assert (p.materials[0].family, p.materials[0].dopants, p.samples[0].film_thickness_nm, p.samples[0].top_electrode, p.phases[0].phase_name) == ("La:HfO2", ["La"], 12.0, "TiN", "orthorhombic")
    assert [(x.property_name, x.value, x.unit, x.confidence) for x in p.properties] == [("double_remanent_polarization_2Pr", 38.5, "μC/cm²", 1.0)]  # the band gap has a value without a unit
    assert "2Pr of 40" in p.properties[0].evidence and p.devices == ["FeFET"] and p.warnings == ["one"]
    for k in "bcde":
        assert got[k].materials == [] and got[k].properties == [] and got[k].material_ref == "HfO2"


def test_context_is_filled_not_overwritten(spark):
    sample = "struct<film_thickness_nm:double,deposition_method:string,annealing_temperature_c:double,top_electrode:string,bottom_electrode:string,substrate:string,device_stack:string,sample_form:string>"
    pay = f"struct<materials:array<struct<canonical_name:string,family:string,raw_name:string>>,samples:array<{sample}>,phases:array<struct<phase_name:string,space_group:string>>,devices:array<string>>"
    schema = f"fact_id string, material string, sample {sample}, phases array<struct<phase_name:string,space_group:string>>, devices array<string>, cand {pay}, chunk {pay}"
    s = lambda t=None, e=None: (t, None, None, e, None, None, None, None)
    cand = ([("HZO", "HZO", "HZO")], [s(9.0, "TiN")], [("cubic", None)], [])
    chunk = ([("HfO2", "HfO2", "x")], [s(5.0, "Pt")], [("cubic", None), ("amorphous", None)], ["FTJ"])
    rows = [("1", None, None, None, None, cand, chunk), ("2", "mine", s(3.0), [("tetragonal", None)], ["FeFET"], cand, chunk), ("3", "mine", s(3.0, "W"), [], [], None, None)]
    r = {x.fact_id: x for x in payloads.merge_context(frame(spark, rows, schema), "cand", "chunk").collect()}
    assert (r["1"].material, r["1"].sample.film_thickness_nm, [p.phase_name for p in r["1"].phases], r["1"].devices, r["1"].sources) == ("HZO", 9.0, ["cubic", "amorphous"], ["FTJ"], "candidate,chunk,fact")
    assert (r["2"].material, r["2"].sample.film_thickness_nm, r["2"].sample.top_electrode, [p.phase_name for p in r["2"].phases], r["2"].devices) == ("mine", 3.0, "TiN", ["tetragonal", "cubic", "amorphous"], ["FeFET", "FTJ"])
    assert (r["3"].sources, r["3"].phases, r["3"].devices) == ("fact", [], [])


def test_schema_problems(spark):
    rows = [("1", "p", "long enough text", "band_gap", 5.0, "eV", "HfO2", 0.5), ("2", None, "short", "mass", 1.0, None, "steel", 2.0), ("3", "p", "long enough text", "band_gap", None, None, None, None)]
    got = sorted(tuple(r) for r in payloads.schema_problems(frame(spark, rows, "fact_id string, paper_id string, evidence_text string, property_name string, value double, unit string, material_family string, confidence double")).collect())
    assert got == [("2", "confidence", "out_of_bounds"), ("2", "evidence_text", "too_short"), ("2", "material_family", "not_in_schema"), ("2", "paper_id", "missing"), ("2", "property_name", "not_in_schema"), ("2", "unit", "required_with_value")]


def test_title_tiers(spark):
    good = "Ferroelectric hafnium zirconium oxide thin films for memory devices"
    rows = [("doi", "bad", good, None, None, None, "x.pdf"), ("layout", "bad", None, good, 22.0, "Metadata title of hafnia memory thin films", "x.pdf"), ("meta", "bad", None, None, None, good, "x.pdf"), ("name", "bad", None, None, None, None, "2021_Adv_Mater_" + good.replace(" ", "_") + ".pdf"), ("none", good, None, None, None, None, "x.pdf"), ("kept", good, None, None, None, None, good.replace("memory", "logic") + ".pdf")]
    r = {x.k: x for x in titles.best(frame(spark, rows, "k string, title string, doi_title string, layout_title string, layout_size double, metadata_title string, file_name string")).collect()}
    assert [r[k].source for k in ("doi", "layout", "meta", "name", "none", "kept")] == ["doi", "layout", "metadata", "filename", "current", "filename"]
    assert all(r[k].new_title == good and r[k].changed for k in ("doi", "layout", "meta", "name")) and not r["none"].changed and not r["kept"].changed


def test_layout_joins_large_lines_of_the_upper_region(spark):
    rows = [("p", 10.0, 0.0, 22.0, "Ferroelectric hafnium oxide thin films", 800.0), ("p", 36.0, 0.0, 22.0, "for memory and logic devices", 800.0), ("p", 70.0, 0.0, 10.0, "small text", 800.0), ("p", 700.0, 0.0, 30.0, "Huge footer that names hafnium oxide memory", 800.0), ("q", 10.0, 0.0, 9.0, "small", 800.0), ("q", 20.0, 0.0, None, None, 800.0)]
    got = files.layout_titles(frame(spark, rows, "page_id string, y double, x double, size double, text string, height double")).collect()
    assert [(r.page_id, r.title) for r in got] == [("p", "Ferroelectric hafnium oxide thin films for memory and logic devices")]


def test_models_vote_with_confidence(spark):
    rows = [("ok", "p", 1, "HZO", "HZO", "double_remanent_polarization_2Pr", 40.0, "μC/cm2", "The film shows a 2Pr of 40 μC/cm2 in all runs.", "strong"), ("no", "p", 1, "steel", "steel", "remanent_polarization_Pr", 40.0, "μC/cm2", "As reported by others [3] the 2Pr was 40 μC/cm2.", "strong")]
    m = {(r.fact_id, r.model): r for r in facts.checks_long(frame(spark, rows, "fact_id string, paper_id string, page_number int, material string, material_family string, property_name string, value double, unit string, evidence_text string, context_quality string")).collect()}
    assert len(m) == 8 and m["ok", "ensemble"].verdict == "valid" and m["ok", "ensemble"].confidence == 0.933
    assert m["no", "range"].verdict == "reject" and m["no", "ensemble"].verdict == "reject" and m["no", "ensemble"].issues == "reject_family;secondary_source;two_pr"


# hot keys and broadcasts


def test_numbering_of_a_group_that_holds_most_rows(spark):
    rows = [("hot" if i % 3 else f"g{i}", i) for i in range(3_000)] + [(None, 1), (None, 2)]
    df = frame(spark, rows, "g string, v int").withColumn("n", F.lit("clash"))
    got = numbering.numbered(df, ["g"], ["v"], "at", "of").collect()
    hot = sorted((r.v, r.at) for r in got if r.g == "hot")
    assert [a for _, a in hot] == list(range(2_000)) and {r.of for r in got if r.g == "hot"} == {2_000} and sorted(r.at for r in got if r.g is None) == [0, 1]
    assert numbering.numbered(df.limit(0), ["g"], ["v"], "at").count() == 0
    with pytest.raises(ValueError, match="reserved"):
        numbering.numbered(df.withColumn("__num_x", F.lit(1)), ["g"], ["v"], "at")


def test_duplicates_where_half_of_all_rows_share_a_hash_or_have_none(spark):
    rows = [(f"f{i:04}", "same" if i % 2 else None, i % 5) for i in range(1_000)] + [("z", "other", 0)]
    new = frame(spark, rows, "pdf_id string, sha256 string, batch_no int")
    got = literature.first_with_hash(new, frame(spark, [("other",), (None,)], "sha256 string"), ["batch_no", "pdf_id"])
    r = {x.pdf_id: x.duplicate for x in got.collect()}
    assert len(r) == 1_001 and sum(r.values()) == 500 and not r["f0005"] and r["z"] and "Window" not in got._jdf.queryExecution().toString()
    ident = files.with_identity(new.withColumnRenamed("pdf_id", "file_path")).collect()
    assert sum(x.is_dup for x in ident) == 499 and len({x.new_pdf_id for x in ident if x.sha256 == "same"}) == 500 and all(x.new_pdf_id is None for x in ident if x.sha256 is None)


def test_facts_are_not_shuffled_by_their_property(spark, sf):
    from corpusmill.sources import read_table

    u = convert.with_units(read_table(spark, sf, "fact_hits"), read_table(spark, sf, "property_units"))
    plan = u._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(property_name") <= 1  # the ten rows' own deduplication


def test_source_default_unit(spark):
    f = frame(spark, [("1", "p", "coercive_field_Ec", 1.0, "kV/cm", ""), ("2", "p", "coercive_field_Ec", 2.0, "kV/cm", ""), ("3", "p", "coercive_field_Ec", 500.0, None, "none"), ("4", "q", "coercive_field_Ec", 5.0, None, "none"), ("5", None, "coercive_field_Ec", 5.0, "MV/cm", "")], "fact_id string, paper_id string, property_name string, value double, unit string, evidence_text string")
    r = {x.fact_id: (x.unit_from, x.common_number) for x in convert.with_defaults(f, frame(spark, [("coercive_field_Ec", "MV/cm")], "property_name string, common_unit string")).collect()}
    assert r["3"] == ("default", pytest.approx(0.5)) and r["4"] == (None, None) and r["1"][0] == "field" and r["5"] == ("field", 5.0)


def test_drawing_keeps_edges_between_drawn_nodes(spark):
    node = frame(spark, [(f"n{i}", "Paper", f"n{i}", 1000 - i) for i in range(60)], "id string, type string, label string, n_facts long")
    edge = frame(spark, [(f"n{40 + i % 20}", f"n{50 + i % 10}", f"t{i}") for i in range(400)] + [("n0", "n1", "REPORTS")], "source string, target string, type string")
    html = graph.to_html(node, edge, most=5)
    assert '"source": "n0"' in html and '"n45"' not in html


# files


def test_pages_by_an_injected_reader(spark):
    def reader(path):
        if path.endswith("bad"):
            raise ValueError("broken file")
        return ["first page " * 20, None, ""]

    p = files.read_pages(frame(spark, [("a", "x.good"), ("b", "x.bad")], "pdf_id string, file_path string"), reader)
    rows = sorted(map(tuple, p.collect()), key=str)
    assert len(rows) == 4 and ("b", None, None, "broken file") in rows
    assert dict(map(tuple, files.page_counts(p).collect())) == {"a": 3, "b": 0}
    m = frame(spark, [("a", None, "pending", None), ("c", 7, "pending", "old")], "pdf_id string, page_count int, parse_status string, error_message string").selectExpr("*", "0 as text_page_count", "0 as blank_page_count", "0.0D as parse_quality_score")
    r = {x.pdf_id: x for x in files.with_parse_result(m, files.page_quality(p.where("page_number is not null"))).collect()}
    assert (r["a"].page_count, r["a"].text_page_count, r["a"].parse_status) == (3, 1, "parsed") and (r["c"].parse_status, r["c"].error_message) == ("pending", "old")


def test_tables_are_replaced_by_file_and_chunked_behind_the_text(spark, tmp_path):
    cells = [["Material", " 2Pr\n(μC/cm2) "], ["", None], ["HfO2 annealed", "40"]]
    t = frame(spark, [("x1", "p", "f", 3, cells), ("x2", "p", "f", 3, [["", " "]]), ("x0", "p", "f", 1, [["a"]])], "k string, paper_id string, pdf_id string, page_number int, cells array<array<string>>")
    rows = files.table_rows(t, ["k"])
    c = {r.chunk_id: r for r in chunks.table_chunks(rows, frame(spark, [("f", 4)], "pdf_id string, n int")).collect()}
    assert sorted((k, r.chunk_index) for k, r in c.items()) == [("f_table_p0001_001", 4), ("f_table_p0003_001", 5)]
    r = c["f_table_p0003_001"]
    assert r.text == "Table 1 on page 3\nMaterial | 2Pr (μC/cm2)\nHfO2 annealed | 40" and r.is_high_value and r.contains_table
    path = str(tmp_path / "tables")
    for n in (2, 1):
        files.replace_partitions(rows.limit(n).select("table_id", "pdf_id"), path)
    files.replace_partitions(frame(spark, [("g1", "g")], "table_id string, pdf_id string"), path)
    assert sorted(r.pdf_id for r in spark.read.parquet(path).collect()) == ["f", "g"]


def test_ontology_bundle_is_written_once(tmp_path):
    o = ontology.default()
    assert ontology.write_bundle(o, "1", str(tmp_path)) and not ontology.write_bundle(o, "2", str(tmp_path))
    assert json.loads((tmp_path / "version.json").read_text())["checksum"] == ontology.checksum(o)


# catalog, logs, answers


def test_root_settings_paths_and_catalog(spark, sf, tmp_path):
    from corpusmill.sources import Catalog, Settings, doi_url, find_root, inside

    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert find_root(tmp_path / "a" / "b") == tmp_path.resolve() and inside(tmp_path, "a/x.txt") == (tmp_path / "a" / "x.txt").resolve()
    with pytest.raises(ValueError, match="leads out"):
        inside(tmp_path, "../../etc/passwd")
    assert Settings.load({"CORPUSMILL_USE_MODEL": "yes", "CORPUSMILL_MODEL_TIMEOUT_S": "5", "CORPUSMILL_DATA": " "}) == Settings(use_model=True, model_timeout_s=5)
    assert doi_url(" 10.1/a b ") == "https://doi.org/10.1/a%20b"
    c = Catalog(spark, sf)
    assert "papers" in c.names() and c.table("papers", "paper_id").columns == ["paper_id"]
    with pytest.raises(KeyError, match="no table nothing"):
        c.table("nothing")


def test_newest_log_rate_and_state(spark, tmp_path):
    import os

    from corpusmill.operators import logs

    assert logs.newest(spark, str(tmp_path)) is None
    for i, n in enumerate(("b.log", "a.log", "c.txt")):
        (tmp_path / n).write_text("x")
        os.utime(tmp_path / n, (1_000 + i, 1_000 + i))
    assert logs.newest(spark, str(tmp_path)).endswith("a.log")
    p = frame(spark, [(50, 0, 50), (0, 0, 100), (100, 1, 0), (3, 3, 97)], "processed long, errors long, remaining long")
    assert [(r.per_minute, r.seconds_left, r.state) for r in logs.with_rate(p, 60.0).orderBy("remaining").collect()] == [(100.0, 0.0, "finished"), (50.0, 60.0, "running"), (3.0, 1940.0, "failed"), (None, None, "waiting")]


def test_answers_by_model_and_without(spark):
    from corpusmill.operators import retrieval

    ev, st = [{"title": "T", "evidence_text": "2Pr of 40", "page_number": 3}], {"facts": 1, "numeric": 1, "min_v": 1.0, "max_v": 2.0, "median_v": 1.5}
    seen = []
    assert retrieval.model_answer("q?", st, ev, lambda p: seen.append(p) or "It is 40 [1].") == {"answer": "It is 40 [1].", "by": "model", "error": None} and "[1] T" in seen[0]
    assert retrieval.model_answer("q?", st, ev, lambda p: 1 / 0)["by"] == "rules" and retrieval.model_answer("q?", st, ev, lambda p: " ")["error"] == "empty answer"
    assert retrieval.model_answer("q?", None, [], lambda p: "made up")["answer"].startswith("No accepted evidence")
    f = frame(spark, [("1", " HfO2 ", "band_gap", 5.5, "eV", "T", 3, "a  b\n c"), ("2", None, "band_gap", None, None, None, None, None)], "fact_id string, material string, property_name string, value double, unit string, title string, page_number int, evidence_text string")
    assert [tuple(r) for r in retrieval.fact_record(f).orderBy("fact_id").collect()] == [("1", "HfO2 band_gap", "5.500 eV", "T, p. 3", "a b c"), ("2", "band_gap", None, "", "")]


def test_titles_by_doi_are_looked_up_once(spark):
    def lookup(doi):
        if doi == "bad":
            raise OSError("offline")
        return f"title of {doi}"

    got = literature.titles_by_doi(frame(spark, [("a",), ("a",), ("bad",), (None,)], "doi string"), lookup).collect()
    assert sorted(map(tuple, got), key=str) == [("a", "title of a"), ("bad", None)]


def test_edges_carry_their_ends(spark):
    node = frame(spark, [("a", "Paper", "La"), ("b", "Device", "FTJ")], "id string, type string, label string")
    edge = frame(spark, [("a", "b", "R"), ("a", "gone", "R")], "source string, target string, type string")
    got = {r.target: r for r in graph.with_attributes(edge, node).collect()}
    assert (got["b"].source_label, got["b"].target_type, got["gone"].target_type) == ("La", "Device", None)
    assert [tuple(r) for r in graph.search(node, edge, "FTJ", ["Device"]).collect()] == [("b", "Device", "FTJ", 1)]


def test_a_model_as_validator(spark):
    f = frame(spark, [("1", "HfO2", "band_gap", 5.0, "eV", "text"), ("2", None, "band_gap", None, None, "fail"), ("3", None, None, None, None, "odd")], "fact_id string, material string, property_name string, value double, unit string, evidence_text string")

    def call(prompt):
        if '"fail"' in prompt:
            raise TimeoutError("late")
        return "no JSON" if '"odd"' in prompt else 'Sure: {"verdict": "valid", "confidence": 7, "issues": ["a", "b"]}'

    assert [tuple(r) for r in facts.model_verdicts(f, call).orderBy("fact_id").collect()] == [("1", "valid", 1.0, "a;b"), ("2", "needs_check", 0.0, "late"), ("3", "needs_check", 0.0, "unreadable answer")]
    assert {r.issues for r in facts.model_verdicts(f).collect()} == {"no model is configured"}
    assert "band_gap" in payloads.extraction_prompt("some text") and payloads.extraction_prompt("some text").endswith("some text")


def test_exports_and_reports(spark, sf, tmp_path):
    from corpusmill.plans import pipeline

    names = pipeline.export(spark, sf, str(tmp_path))
    assert {"nodes.csv", "validation.md", "title_repair.csv"} <= set(names) and all((tmp_path / n).exists() for n in names)
    head = next((tmp_path / "nodes.csv").glob("part-*")).read_text().splitlines()[0]
    assert head == "id,type,label,n_facts" and "ensemble" in (tmp_path / "validation.md").read_text()


def test_broadcast_only_within_the_counted_size(spark):
    from corpusmill.session import broadcast_if_small

    df = frame(spark, [(i, [i] * 100) for i in range(20)], "k int, xs array<int>")
    hinted = lambda x: "ResolvedHint" in x._jdf.queryExecution().analyzed().toString() or "broadcast" in x._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(df, 10, 200)) and not hinted(broadcast_if_small(df, 10, 190))
    assert hinted(broadcast_if_small(df, F.size("xs"), 2_000)) and not hinted(broadcast_if_small(df, F.size("xs"), 1_999))
    assert hinted(broadcast_if_small(df.limit(0), F.size("xs"), 0))
