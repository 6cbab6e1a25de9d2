import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import splitting


def cut(spark, text, limit=60, overlap=10):
    return spark.createDataFrame([(text,)], "t string").select(splitting.pieces(F.col("t"), limit, overlap).alias("p")).first().p


def rebuilt(p, overlap):
    out = p[0]
    for x in p[1:]:
        k = min(overlap, len(out))
        assert x[:k] == out[-k:]
        out += x[k:]
    return out


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab. \n\r。é𝒜", max_size=400))
def test_pieces_rebuild_the_text(spark, text):
    p = cut(spark, text)
    assert all(len(x) <= 60 for x in p)
    assert rebuilt(p, 10) == text if len(text) > 60 else p == [text]


def test_boundaries_by_strength(spark):
    text = "First sentence is here. And the second.\n\n" + "word " * 30
    p = cut(spark, text, 60, 0)
    assert p[0].endswith("\n\n")
    assert cut(spark, "x" * 130, 60, 10)[0] == "x" * 50


def test_very_long_text_is_cut_whole(spark):
    text = "A sentence of some length, number one. " * 20_000
    p = cut(spark, text, 1800, 260)
    assert rebuilt(p, 260) == text and max(map(len, p)) <= 1800


def test_split_numbers_anew_for_any_group(spark):
    rows = [("c1", "p", 2, 5, "y" * 100), ("c0", "p", 1, 5, "x" * 100), ("c2", "p", None, None, ""), ("c3", "q", 1, 0, None), ("c4", None, 1, 0, "z"), ("c4", None, 1, 0, "z")]
    df = spark.createDataFrame(rows, "chunk_id string, pdf_id string, page_number int, chunk_index int, text string").withColumn("char_count", F.lit(-1)).withColumn("extra", F.lit("e"))
    got = splitting.split(df, limit=60, overlap=10).collect()
    p = sorted((r.chunk_index, r.chunk_id, r.piece_no, r.char_count) for r in got if r.pdf_id == "p")
    assert [x[0] for x in p] == list(range(5)) and p[0][1] == "c2" and [x[1] for x in p[1:]] == ["c0", "c0", "c1", "c1"]
    assert sorted(r.chunk_index for r in got if r.pdf_id is None) == [0, 1] and {r.extra for r in got} == {"e"}
    assert splitting.split(df.limit(0)).count() == 0


def test_oversized_is_exactly_the_long_ones(spark):
    df = spark.createDataFrame([("a", "x" * 1800), ("b", "x" * 1801), ("c", None)], "chunk_id string, text string")
    assert [r.chunk_id for r in splitting.oversized(df).collect()] == ["b"]


def test_overlap_must_be_smaller_than_the_limit():
    with pytest.raises(ValueError):
        splitting.cut_pattern(10, 10)
