import numpy as np
import pytest

from corpusmill.llm import scans, skipgram

COMMON = "the residual stress of films grown by annealing modern memory cells within hydrogen thickness-dependent switching remains stable under field cycling and the crystallization".split()


@pytest.fixture(scope="module")
def lex():
    counts = {w: 500 for w in COMMON} | {"fluctuation": 90, "residuai": 1, "thickness": 100, "dependent": 100}
    vocab = {w: i for i, w in enumerate(dict.fromkeys(COMMON))}
    g = np.random.default_rng(0)
    return scans.Lexicon(counts, (g.normal(size=(len(vocab), 4)).astype("f"), g.normal(size=(len(vocab), 4)).astype("f")), vocab)


@pytest.mark.parametrize(("bad", "good"), [("rnodern", "modern"), ("annea1ing", "annealing"), ("witliin", "within"), ("hydrogeri", "hydrogen"), ("fluctua†ion", "fluctuation"), ("residuai", "residual"), ("mernory", "memory")])
def test_glyph_edits_are_undone(lex, bad, good):
    assert lex.right(bad, []) == good
    assert scans.skeleton(bad) == scans.skeleton(good)


def test_known_and_foreign_words_stand(lex):
    assert lex.right("memory", []) is None and lex.right("zebra", []) is None


def test_page_is_repaired(lex):
    page = "Some Title Of The\n671\nthe residual str-\ness of films with thickness-\ndependent rnemory\n\nremains stable"
    text, cases = scans.repair(page, "Some title of the paper", "A. Author, B. Other", None, lex)
    assert text == "the residual stress of films with thickness-dependent memory\n\nremains stable"
    assert set(cases) == {("header", ""), ("page_no", ""), ("hyphen", "stress"), ("misread", "memory")}


def test_a_misreading_is_undone_however_often_it_recurs():
    """Counts grow with the corpus, a misreading's too; only ratios may decide."""
    for k in (1, 10, 1_000):
        counts = {"memory": 900 * k, "mcmory": 13 * k, "cells": 700 * k}
        x, y = np.array([[1.0], [-1.0], [0.0]], "f"), np.ones((3, 1), "f")
        lx = scans.Lexicon(counts, (x, y), {"memory": 0, "mcmory": 1, "cells": 2})
        assert scans.repair("mcmory cells", None, None, None, lx) == ("memory cells", [("misread", "memory")])
        assert lx.candidates("rncmory") == ["memory"]


@pytest.mark.parametrize(("line", "want"), [("671", True), ("- 2 -", True), ("Page l2", True), ("3 / 8", True), ("[798]", True), ("iv", True), ("", False), ("12.5", False), ("film", False), ("at 30 s.", False)])
def test_page_numbers(line, want):
    assert scans.is_page_no(line) is want


def test_headers_name_title_or_author():
    h = scans.Headers("Effect of annealing on hafnia films", "Author, A.; Other, B.")
    assert h.names("EFFECT OF ANNEALING ON", True) and h.names("A. Author et al.", False) and h.names("A. Auth0r e† al.: Effect of annealing", True)
    assert not h.names("Effect of cooling on hafnia films", True) and not h.names("", True)
    assert not scans.Headers(None, None).names("Some line of text", True)


def test_skipgram_brings_words_of_like_company_together(spark):
    texts = [(" ".join(["red" if i % 2 else "blue", "paint", "dries", "slowly"]) + " " + " ".join(["dog" if i % 3 else "cat", "eats", "meat", "daily"]),) for i in range(200)] + [(None,), ("",)]
    vocab = {w: i for i, w in enumerate("red blue paint dries slowly dog cat eats meat daily".split())}
    pairs = skipgram.pair_counts(spark.createDataFrame(texts, "text string"), "text", vocab, scans.words).toPandas()
    x, _ = skipgram.fit(pairs, len(vocab), rounds=150)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = lambda a, b: float(x[vocab[a]] @ x[vocab[b]])
    assert cos("red", "blue") > cos("red", "dog") and cos("dog", "cat") > cos("cat", "blue")


def test_nulls_blanks_and_empty_tables(spark):
    pages = spark.createDataFrame([("p1", "f1", "a1", None), ("p2", "f1", None, ""), ("p3", "f2", "a1", "plain text")], "page_id string, pdf_id string, paper_id string, text string")
    files = spark.createDataFrame([("f1", None), ("f2", False)], "pdf_id string, ocr_needed boolean")
    papers = spark.createDataFrame([("a1", "T", None, None, None)], "paper_id string, title string, authors string, publisher string, journal string")
    r = {x.page_id: x for x in scans.repaired(pages, files, papers).collect()}
    assert set(r) == {"p1", "p2"} and r["p1"].text is None and r["p2"].text == ""
    assert scans.found(pages.limit(0), files, papers).count() == 0


def test_context_weighs_against_the_ratio_of_counts():
    """A form that is 12 times rarer stands where the words around speak against the frequent one, and falls where they speak for it."""
    counts = {"modern": 1200, "modem": 100, "cells": 900, "cable": 900}
    x, y = np.array([[3.0], [0.0], [0.0]], "f"), np.array([[0.0], [2.0], [-2.0]], "f")
    lx = scans.Lexicon(counts, (x, y), {"modern": 0, "cells": 1, "cable": 2})
    assert lx.right("modem", [1]) == "modern" and lx.right("modem", [2]) is None


def test_a_word_beyond_the_lexicon_counts_as_its_last():
    counts = {"car": 50, "then": 700}
    assert scans.Lexicon(counts, beyond=6).candidates("cat") == [] and scans.Lexicon(counts, beyond=5).candidates("cat") == ["car"]


def test_learned_vectors_leave_out_misreadings_that_recur(spark):
    text = "the memory cells keep the charge within the memory window of the cells and lose the charge beyond it"
    rows = [(text.replace("memory", "mcmory") if i % 25 == 0 else text,) for i in range(300)]
    lx = scans.learn(spark.createDataFrame(rows, "text string"))
    assert "mcmory" in lx.counts and "mcmory" not in lx.vocab and "memory" in lx.vocab
    assert scans.repair("mcmory cells keep the charge", None, None, None, lx)[1] == [("misread", "memory")]


def test_words_beyond_the_lexicon_and_the_vectors_are_known_by_page(spark, monkeypatch):
    """With a lexicon of few words and vectors of fewer, what lies beyond is looked up: counts, right forms, cut words and vectors."""
    line = "the memory cells keep the charge within the window of the cells and lose it beyond the hydrogen barrier"
    rows = [(f"p{i}", "f1", None, line.replace("memory", "mcmory") if i % 150 == 0 else line) for i in range(300)] + [("q", "f1", None, "the hydrogeri barrier and the hydro-\ngen wind0w of the ceiis")]
    pages = spark.createDataFrame(rows, "page_id string, pdf_id string, paper_id string, text string")
    files = spark.createDataFrame([("f1", True)], "pdf_id string, ocr_needed boolean")
    papers = spark.createDataFrame([], "paper_id string, title string, authors string, publisher string, journal string")
    got = lambda: {tuple(r) for r in scans.found(pages, files, papers).collect()}
    want = got()
    assert {("q", "misread", "hydrogen"), ("q", "misread", "window"), ("q", "hyphen", "hydrogen"), ("p150", "misread", "memory")} <= want
    monkeypatch.setattr(scans, "LEXICON", 4)
    monkeypatch.setattr(skipgram, "VECTORS", 3)
    lx = scans.learn(pages)
    assert len(lx.counts) == 4 and len(lx.vocab) == 4 and {r.word for r in spark.read.parquet(lx.rest).where("x is not null").collect()} >= {"memory", "hydrogen"}
    assert got() == want


def test_furniture_outside_the_running_text_at_any_depth(lex):
    notes = [f"Notice {i}: All Rights Reserved, Series {i}" for i in range(7)]
    body = ["the residual stress of films grown by annealing modern memory", "cells within hydrogen remains stable under field cycling and the"]
    page = "\n".join([*notes, "Author", "- 12 -", *notes, *body, *notes, "671", *notes])
    assert {("header", ""), ("page_no", "")} <= set(scans.repair(page, "Some title", "A. Author", None, lex)[1])
    inner = "\n".join([*body * 3, "671", *body * 3])
    assert ("page_no", "") not in scans.repair(inner, "Some title", "A. Author", None, lex)[1]
