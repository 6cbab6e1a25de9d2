import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import text as T


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("fn", "value", "want"),
    [
        (T.clean_text, "a\x00 \t b\n\n\n\nc ", "a b\n\nc"),
        (T.clean_text, "", ""),
        (T.clean_text, None, None),
        (T.dehyphenate, "cut-\n word and - dash", "cutword and - dash"),
        (T.parser_doi, " 10.1000/ABC.12). ", "10.1000/abc.12"),
        (T.parser_doi, "  ", None),
        (T.resolver_doi, "https://dx.doi.org/10.1/X ", "10.1/x"),
        (T.first_doi, "see doi 10.1000/xyz.3, and", "10.1000/xyz.3"),
        (T.first_year, "in 1999 and 2014", 2014),
        (T.file_title, "2021_Some_long__name.PDF", "Some long name"),
        (T.file_year, "2021_Some.pdf", 2021),
        (T.section, "2. Experimental methods", "method"),
        (T.section, "Fig. 3 shows", "figure_caption"),
        (T.section, "", "unknown"),
        (T.word_count, "", 1),
        (T.word_count, "a  b\nc", 3),
        (T.html_clean, "<p>a&amp;b</p>\n", "a&b"),
        (T.clean_title, "Ferroelectric Hf<sub>0.5</sub>Zr on HfO 2 ﬁlms .", "Ferroelectric Hf0.5Zr on HfO2 films"),
        (T.title_score, "Received: 3 May 2020 by the editors of it", 0.0),
        (T.title_score, None, 0.0),
    ],
)
def test_function(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_page_title_skips_journal_lines_and_falls_back(spark):
    f = lambda c: T.page_title(c, F.lit("fallback"))
    assert one(spark, "Journal of things, vol. 3 (2020)\nA title that is long enough to count\nbody", f) == "A title that is long enough to count"
    assert one(spark, "short", f) == "fallback"


def test_keyword_flag_is_a_substring_test(spark):
    assert one(spark, "a second thought", lambda c: T.keyword_flag(c, ["ec"])) is True
    assert one(spark, "pr", lambda c: T.keyword_flag(c, [" pr "])) is True


def test_tokens_are_distinct_and_longer_than_one(spark):
    assert one(spark, "HZO hzo a 2Pr μC/cm² 铪锆", T.tokens) == ["hzo", "2pr", "μc/cm²", "铪锆"]


def test_uuid5(spark):
    import uuid

    assert one(spark, "chunk-1", T.uuid5) == uuid.uuid5(uuid.NAMESPACE_URL, "chunk-1").hex[:16]


def test_safe_filename(spark):
    df = spark.createDataFrame([("A / title", "10.1/a:b", 2020), ("??", None, None)], "t string, d string, y int")
    assert [r[0] for r in df.select(T.safe_filename(F.col("t"), F.col("d"), F.col("y"))).collect()] == ["2020_10.1_a_b.pdf", "open_access_paper.pdf"]


@settings(max_examples=15, deadline=None)
@given(st.text(alphabet="ab-\n \t.", max_size=60))
def test_clean_text_is_idempotent(spark, s):
    once = one(spark, s, T.clean_text)
    assert one(spark, once, T.clean_text) == once
    assert "\n\n\n" not in once
