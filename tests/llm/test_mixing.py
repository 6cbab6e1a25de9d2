import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import mixing


def data(spark):
    rows = [(i, f"steel beam number {i} carries load " * 3, "Works-A", "en") for i in range(60)] + [(100 + i, f"poem about the moon, verse {i} " * 3, " works_b", "en") for i in range(30)] + [(200 + i, "steel beam carries load " * 3, None, "en") for i in range(4)] + [(300, None, "works-a", None), (301, "", "works-b", None), (302, "stray text", "elsewhere", "de"), (0, "steel beam number 0 carries load " * 3, "works-a", "en")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("tokens", F.lit("clash"))


def test_shares_are_met_within_repeats(spark):
    targets = spark.createDataFrame([("works-a", 0.4, 3), ("works-b", 0.6, 4)], "source string, target_share double, max_repeats int")
    m = mixing.mixed(data(spark), targets).cache()
    used = {r.source: r for r in mixing.shares(data(spark), targets).collect() if r.target_share is not None}
    assert used["works-a"].reached_share == pytest.approx(0.4, abs=0.04) and used["works-b"].reached_share == pytest.approx(0.6, abs=0.04)
    assert m.where("source = 'works-a'").agg(F.max("times_used")).first()[0] <= 3 and m.where("source = 'elsewhere'").first().times_used == 0
    assert m.count() == data(spark).count() and {r.source for r in m.where("doc_id between 200 and 203").collect()} == {"works-a"}


def test_a_short_source_stays_at_its_bound(spark):
    targets = spark.createDataFrame([("works-a", 0.1, 1), ("works-b", 0.9, 1), (None, 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mixed(data(spark), targets)
    b = m.where("source = 'works-b' and tokens > 0").agg(F.min("times_used"), F.max("times_used")).first()
    assert tuple(b) == (1, 1)


def test_no_targets_and_no_documents(spark):
    t = spark.createDataFrame([], "source string, target_share double, max_repeats int")
    assert mixing.mixed(data(spark), t).agg(F.sum("times_used")).first()[0] == 0
    full = spark.createDataFrame([("works-a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mixed(data(spark).limit(0), full).count() == 0


def test_rates_project():
    r = mixing.rate_of(np.array([[1.0, 0.0], [0.5, 0.5]]), np.array([2.0, 1.0]), np.array([[5.0, 0.0], [-9.0, 0.0]]))
    assert r.tolist() == [0.0, 0.0] and mixing.rate_of(np.eye(2), np.array([0.0, 3.0]), np.zeros((0, 2))).tolist() == [0.0, 1.0]


def test_long_texts_are_sampled_whole_and_too_many_sources_refused(spark, monkeypatch):
    long_a, long_b = "steel beam carries load " * 2_000, "poem about the moon " * 2_000
    rows = [(i, long_a if i % 2 else long_b, "works-a" if i % 2 else "works-b") for i in range(12)] + [(100, "a beam of steel", None), (101, "the moon, a poem", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("works-a", 0.5, 2), ("works-b", 0.5, 2)], "source string, target_share double, max_repeats int")
    assert {r.doc_id: r.source for r in mixing.mixed(docs, targets).where("doc_id >= 100").collect()} == {100: "works-a", 101: "works-b"}
    monkeypatch.setattr(mixing, "MAX_SOURCES", 1)
    with pytest.raises(ValueError, match="more than 1"):
        mixing.mixed(docs, targets)
