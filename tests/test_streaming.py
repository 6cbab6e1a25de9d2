from pyspark.sql import functions as F

from corpusmill.plans import pipeline
from corpusmill.sources import read_table
from corpusmill.streaming import ingest


def test_pages_become_chunks_once(spark, sf, tmp_path):
    pages = read_table(spark, sf, "parsed_pages")
    src, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    pages.where("page_number <= 2").coalesce(1).write.parquet(src)
    stream = lambda: ingest.page_stream(spark, src, pages.schema)
    ingest.run(stream(), ingest.chunk_sink(out), cp).awaitTermination()
    n = spark.read.parquet(out).count()
    assert n > 0
    ingest.run(stream(), ingest.chunk_sink(out), cp).awaitTermination()
    assert spark.read.parquet(out).count() == n
    pages.where("page_number > 2").coalesce(1).write.mode("append").parquet(src)
    ingest.run(stream(), ingest.chunk_sink(out), cp).awaitTermination()
    assert spark.read.parquet(out).count() > n


def test_extraction_leaves_markers(spark, sf, tmp_path):
    c = spark.createDataFrame([("c1", "2Pr of 40 uC/cm2"), ("c2", "nothing here")], "chunk_id string, text string")
    ingest.extraction_sink(str(tmp_path / "o"), "v1")(c, 0)
    r = {x.chunk_id: x.status for x in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert r == {"c1": "extracted", "c2": "empty_result"}


def test_rates_agree_with_batch(spark, sf, tmp_path):
    e = read_table(spark, sf, "events")
    src = str(tmp_path / "e")
    e.write.parquet(src)
    want = ingest.rates(e).agg(F.sum("n")).first()[0]
    q = ingest.rates(spark.readStream.schema(e.schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from rates").first()[0] == want == e.count()


def test_pipeline_builds_all_stages(spark, sf, tmp_path):
    n = pipeline.build(spark, sf, str(tmp_path / "build"))
    assert n["chunks"] > 0 and n["quality"] > 0 and set(n) >= {"facts", "nodes", "edges", "index"}
    assert "ranges" in pipeline.report(spark, sf)


def test_pipeline_facts_carry_their_own_sentence(spark, tmp_path):
    """Facts past the chunk's first 700 characters, with context elsewhere in the chunk; the Pr reads like a part of the 2Pr before it."""
    fill = "Filler words without any meaning stand here to move the rest on. " * 13
    text = f"A 2Pr of 12 μC/cm2 was seen first in this long sentence. {fill}The HZO film with Pr of 12 μC/cm2 was deposited by ALD on TiN. The memory window of 1.5 V was reached on the FeFET device. It was annealed at 500 °C."
    src = str(tmp_path / "in")
    spark.createDataFrame([("g1", "a1", "f1", 1, text)], "page_id string, paper_id string, pdf_id string, page_number int, text string").write.parquet(f"{src}/parsed_pages.parquet")
    pipeline.build(spark, src, str(tmp_path / "out"))
    got = {r.property_name: r for r in spark.read.parquet(str(tmp_path / "out/facts")).collect()}
    assert got["memory_window"].evidence_text == "The memory window of 1.5 V was reached on the FeFET device."
    assert got["remanent_polarization_Pr"].evidence_text == "The HZO film with Pr of 12 μC/cm2 was deposited by ALD on TiN."
    assert got["remanent_polarization_Pr"].devices == ["FeFET"] and got["memory_window"].sample.deposition_method == "ALD"
