import os

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = ["clean_text", "page_quality", "range_stats", "kg_edges", "p5_found", "rag_retrieve", "lit_upsert"]


def views(folder):
    c = duckdb.connect()
    for n in os.listdir(folder):
        c.execute(f"create view {n[:-8]} as select * from '{folder}/{n}'")
    return c


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SMALL)
def test_query_and_sql_agree_on_columns_and_rows(spark, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = views(sf).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)


def test_core_does_not_import_the_subpackage():
    root = os.path.join(os.path.dirname(entry.__file__), "corpusmill")
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                text = open(os.path.join(folder, n)).read()
                assert "corpusmill.llm" not in text and "from .llm" not in text and "from ..llm" not in text
