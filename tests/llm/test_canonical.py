import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import canonical

ROWS = [
    ("c3", "A Title: one", "10.1234/AB-1"),
    ("c1", "a title one!", "https://doi.example/10.1234/ab-1"),
    ("c2", "10.1234/ab–1", "A TITLE, one"),
    ("c4", "A Title: one", None),
    ("c5", "a_title one", "  "),
    ("c6", "A Title: two", "doi: 10.1234/ab-1"),
    ("c7", None, None),
    ("c8", "", " "),
    ("c9", "A Title: one", "n/a"),
    ("c1", "a title one!", "https://doi.example/10.1234/ab-1"),
    ("d1", "doi", None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "candidate_id string, title string, doi string").withColumn("record_key", F.lit("clash")).withColumn("copies", F.lit(9))


def brute(rows):
    def k(v):
        v = (v or "").lower()
        v = re.sub(r"^(https?://[^/]+/|doi[^a-z0-9]*)+(?=10\.\d{4})", "", v)
        return re.sub(r"[\W_]+", "", v)

    groups = defaultdict(list)
    for i, a, b in rows:
        groups[tuple(sorted((k(a), k(b))))].append(i)
    return groups


@pytest.mark.parametrize("threshold", [1, 2, 10_000])
def test_members_and_counts_agree_with_brute_force(spark, threshold):
    want = {(min(g), i) for g in brute(ROWS).values() for i in g if i != min(g)}
    got = canonical.members(frame(spark), threshold=threshold, salts=3).collect()
    assert {tuple(r) for r in got} == want
    counts = canonical.collapse(frame(spark), threshold=threshold, salts=3).collect()
    assert sorted((r.kept_id, r.copies) for r in counts) == sorted((min(g), len(g)) for g in brute(ROWS).values())


def test_a_key_with_a_third_of_all_rows(spark):
    df = spark.range(9_000).select(F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("candidate_id"), F.when(F.col("id") % 3 == 0, "Hot Title").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("title"), F.lit(None).cast("string").alias("doi"))
    r = canonical.collapse(df, threshold=500)
    assert r.count() == 6_001 and r.agg(F.max("copies")).first()[0] == 3_000
    assert canonical.members(df, threshold=500).count() == 2_999


def test_empty_table_and_reserved_names(spark):
    assert canonical.members(frame(spark, ROWS[:1]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        canonical.collapse(frame(spark).withColumn("__canon_x", F.lit(1)))
