import re
from collections import defaultdict

from pyspark.sql import functions as F

from corpusmill.llm import lines

NOTICE = "All rights reserved, including text and data mining {n}."


def data(spark):
    papers = [(f"a{i}", ["Pub One", "PUB  one", " pub_one"][i % 3], "J") for i in range(10)] + [("b0", None, "j "), ("b1", None, "Other Journal"), ("c0", None, None)]
    pages = []
    for i in range(10):
        pages += [(f"p{i}_{k}", f"f{i}", f"a{i}", f"Unique body text of page number {chr(97 + i)}{chr(97 + k)} here\n{NOTICE.format(n=i).upper() if i % 2 else NOTICE.format(n=i)}\r\nshort") for k in range(2)]
    pages += [("q0", "g0", "b0", NOTICE.format(n="")), ("q1", "g1", "b1", NOTICE.format(n="")), ("q2", "g2", None, None), ("q3", None, "c0", ""), ("p0_0", "f0", "a0", pages[0][3])]
    return spark.createDataFrame(pages, "page_id string, pdf_id string, paper_id string, text string").withColumn("line", F.lit(1)), spark.createDataFrame(papers, "paper_id string, publisher string, journal string")


def test_found_lines_agree_with_brute_force(spark):
    pages, papers = data(spark)
    src = {p: "pub one" for p in [f"a{i}" for i in range(10)] + ["b0"]} | {"b1": "other journal"}
    files, pdfs = defaultdict(set), defaultdict(set)
    rows = [(r.page_id, r.pdf_id, src.get(r.paper_id, ""), r.text) for r in pages.collect()]
    letters = lambda x: re.sub("[^a-z]", "", x.lower())
    for _, f, s, t in rows:
        if f:
            pdfs[s].add(f)
            for x in (t or "").split("\n"):
                files[s, letters(x)].add(f)
    want = sorted((p, i + 1) for p, _, s, t in rows if t is not None for i, x in enumerate(t.split("\n")) if len(letters(x)) >= 25 and len(files[s, letters(x)]) >= max(4, 0.08 * len(pdfs[s])))
    assert sorted(map(tuple, lines.repeated(pages, papers).collect())) == want and len(want) == 22


def test_pages_are_rebuilt_without_them(spark):
    pages, papers = data(spark)
    r = {x.page_id: x for x in lines.cleaned_pages(pages, papers).collect()}
    assert "rights" not in r["p1_0"].text.lower() and r["p1_0"].removed == 1 and r["p1_0"].text.count("\n") == 1
    assert r["q1"].removed == 0 and r["q2"].text is None and r["q3"].text == ""
    assert lines.repeated(pages.limit(0), papers).count() == 0
