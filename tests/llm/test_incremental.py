import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.llm import components, incremental, scans
from corpusmill.session import shared_dir

VOCAB = ["".join(random.Random(i).choice("abfgkmnopqsuvwxyz") for _ in range(7)) for i in range(400)]


def text(seed, n=150):
    rng = random.Random(seed)
    return [rng.choice(VOCAB) for _ in range(n)]


def noisy(w, seed, share=0.02):
    rng = random.Random(seed)
    return [rng.choice(VOCAB) if rng.random() < share else x for x in w]


def corpus(spark):
    files, pages, papers = [], [], []

    def add(pid, batch, sha, doi, w):
        files.append((pid, sha, f"paper_{pid}", batch))
        papers.append((f"paper_{pid}", doi))
        if w is not None:
            pages.extend((pid, " ".join(w[i : i + 60])) for i in range(0, len(w), 60))

    h = "ab" * 32
    add("a1", 1, h, None, text(1))
    add("a2", 2, f"SHA256:{h.upper()} ", None, None)
    add("b1", 1, None, "10.1234/x", text(2))
    add("b2", 3, "broken", "https://doi.example/10.1234/X.", text(20))
    add("c1", 2, None, "n/a", text(3))
    add("c2", 3, None, "n/a", noisy(text(3), 5))
    add("c3", 3, None, "10.1234/y", noisy(text(3), 6))
    add("d1", 1, None, "10.1234/Y", None)
    add("e1", 2, None, None, ["tiny", "text"])
    add("e2", 3, None, None, ["tiny", "text"])
    for i in range(30):
        add(f"z{i:02}", 1 + i % 3, None, None, text(100 + i, 100 + 5 * i))
    pages.append(("b1", None))
    pages.append(("nobody", "page without file"))
    return (spark.createDataFrame(files, "pdf_id string, sha256 string, paper_id string, batch_no int"), spark.createDataFrame(pages, "pdf_id string, text string"), spark.createDataFrame(papers, "paper_id string, doi string"))


def test_links_by_hash_doi_text_and_third_files(spark):
    got = {tuple(r) for r in incremental.pairs(*corpus(spark)).collect()}
    assert got == {("a1", "a2"), ("b1", "b2"), ("c1", "d1"), ("c2", "d1"), ("c3", "d1")}


def test_empty_tables(spark):
    f, p, a = corpus(spark)
    assert incremental.pairs(f.limit(0), p.limit(0), a.limit(0)).count() == 0
    assert incremental.pairs(f, p.limit(0), a).count() == 3


def brute(docs, least=incremental.SIMILARITY):
    sh = {k: {tuple(scans.skeleton(x).strip("0123456789") for x in w[i : i + 5]) for i in range(len(w) - 4)} for k, w in docs.items()}
    return {(a, b) for a in sh for b in sh if a < b and len(sh[a] & sh[b]) >= least * len(sh[a] | sh[b])}


def word_docs(spark, docs, batches):
    files = spark.createDataFrame([(k, None, None, batches[k]) for k in docs], "pdf_id string, sha256 string, paper_id string, batch_no int")
    return files, spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "pdf_id string, text string"), spark.createDataFrame([], "paper_id string, doi string")


def closed(pairs):
    """The pairs (first of its group, other)."""
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {(find(x), x) for p in pairs for x in p if find(x) != x}


def test_repeats_are_found_at_every_noise(spark):
    """Against brute force over shingles: copies with pages missing, of lengths far apart, and with edits."""
    base = [text(s, 500) for s in range(500, 530)]
    docs = {f"a{i:02}": w for i, w in enumerate(base)} | {f"b{i:02}": noisy(w[: 200 + 10 * i], i, 0.002 * i) for i, w in enumerate(base)}
    want = brute(docs, 0.35)
    got = {tuple(r) for r in incremental.pairs(*word_docs(spark, docs, {k: 1 + (k[0] == "b") for k in docs})).collect()}
    assert len(want) >= 20 and want <= got <= brute(docs, incremental.SIMILARITY)


def test_a_store_is_taken_up_and_gets_one_batch_more(spark, tmp_path):
    base = [text(s, 120) for s in range(900, 960)]
    docs = {f"d{i:03}": w for i, w in enumerate(base)} | {f"e{i:03}": noisy(w, i, 0.01) for i, w in enumerate(base)}
    batches = {k: 1 + i % 20 for i, k in enumerate(sorted(docs))}
    files, pages, papers = word_docs(spark, docs, batches)
    whole = {tuple(r) for r in incremental.pairs(files, pages, papers).collect()}
    folder = str(tmp_path / "store")
    incremental.works(files.where("batch_no < 20"), pages, papers, folder)
    store = incremental.Store.open(spark, folder)
    assert store.accepted() == set(range(1, 20)) and store.loads() == [1, 2]
    before = store.links().count()
    store.close()
    # the texts of the history are gone: only the store may be read
    late = pages.join(files.where("batch_no = 20"), "pdf_id", "left_semi")
    assert {tuple(r) for r in incremental.pairs(files.where("batch_no = 20"), late, papers, folder).collect()} == whole == closed(brute(docs))
    store = incremental.Store.open(spark, folder)
    links = store.links().where("load = 3").collect()
    met = {r.a for r in links}
    assert store.loads() == [1, 2, 3] and store.links().count() == before + len(links) and len(met) <= 6 == sum(b == 20 for b in batches.values())
    with pytest.raises(ValueError, match="accepted"):
        store.ingest([20], None, None)
    store.close()


def test_history_is_not_shuffled(spark, tmp_path):
    """The store's tables stand in their joins without an exchange; small sizes mustn't hide it behind a broadcast."""
    docs = {f"d{i}": text(i, 120) for i in range(6)}
    folder = str(tmp_path / "store")
    incremental.works(*word_docs(spark, docs, {k: 1 for k in docs}), folder)
    store = incremental.Store.open(spark, folder)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probes = spark.createDataFrame([(1, 2, 3)], "cell long, b long, own long")
        filed = spark.createDataFrame([(9, [1] * 64, 9)], "no long, vec array<int>, class long")
        for df, shuffled in ((store._in_history(probes), "cell"), (store._new_cells(filed), "cell")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            scan = plan.index("FileScan")
            join = plan.index("SortMergeJoin")
            side = plan[plan.rindex("Sort [", 0, scan) : scan] if "Sort [" in plan[:scan] else plan[join:scan]
            assert "Bucketed: true" in plan and "Exchange" not in side and shuffled in plan
        keys = spark.createDataFrame([("x", "hash", "k")], "file string, kind string, key string")
        links, _ = store._key_links(keys)
        assert links.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        store.close()


def test_leftovers_of_a_lost_load_are_passed_over(spark, tmp_path):
    docs = {f"d{i}": text(i, 120) for i in range(6)} | {f"e{i}": text(i, 120) + ["end"] for i in range(6)}
    args = word_docs(spark, docs, {k: 1 + (k[0] == "e") for k in docs})
    folder = str(tmp_path / "store")
    incremental.works(*args, folder)
    shutil.rmtree(f"{folder}/done/load=2")
    got = {tuple(r) for r in incremental.pairs(*args, folder).collect()}
    assert got == {(f"d{i}", f"e{i}") for i in range(6)}


def test_near_copies_that_hold_most_rows_make_no_long_lists(spark, tmp_path, monkeypatch):
    """40 distinct copies of one text in one batch, then one more: linked to a few members, listed once a cell and class."""
    monkeypatch.setattr(incremental, "LONG", 1)
    one = text(77, 300)
    docs = {f"n{i:02}": noisy(one, i, 0.01) for i in range(41)} | {f"z{i}": text(200 + i, 200) for i in range(10)}
    args = word_docs(spark, docs, {k: 2 if k == "n40" else 1 for k in docs})
    folder = str(tmp_path / "store")
    assert {tuple(r) for r in incremental.pairs(*args, folder).collect()} == {("n00", f"n{i:02}") for i in range(1, 41)}
    store = incremental.Store.open(spark, folder)
    cells = store._table("cells").join(store.files(store.loads()).where(F.split("file", "\\|")[1].startswith("n")).select("no"), "no")
    assert cells.groupBy("cell", "class").count().agg(F.max("count")).first()[0] == 1
    assert store.links().where("kind = 'near'").count() < 41 * 40 / 4
    store.close()


def test_members_behind_the_one_listed_are_reached(spark, tmp_path):
    """c is like b only, whose class is listed by a in the cells that all three share."""
    head, mid, tail = text(1, 200), text(2, 130), text(3, 200)
    docs = {"a": head + mid, "b": mid + head[:60] + tail, "c": tail + mid[:40]}
    want = closed(brute(docs))
    got = {tuple(r) for r in incremental.pairs(*word_docs(spark, docs, {"a": 1, "b": 2, "c": 3})).collect()}
    assert got == want and want


def test_a_load_leaves_nothing_but_the_store(spark, tmp_path):
    """Shingle sets are on disk once, and what a load needs for a while goes with it."""
    docs = {f"d{i}": text(i, 120) for i in range(6)} | {f"e{i}": text(i, 120) + ["end"] for i in range(6)}
    shared = Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/"))
    held = {p.name for p in shared.iterdir()}
    incremental.works(*word_docs(spark, docs, {k: 1 + (k[0] == "e") for k in docs}), str(tmp_path / "store"))
    assert not {p.name for p in shared.iterdir() if not p.name.startswith("rdd-")} - held
    assert {p.name for p in (tmp_path / "store").iterdir()} == {"meta", "cells", "keys", "files", "vectors", "links", "done"}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_a_run_asks_few_jobs_of_the_driver(spark):
    """A job's plan, closures and broadcasts are the driver's memory: history is joined once for names and classes, and stars end the search for components."""
    docs = {f"d{i}": text(i, 120) for i in range(12)} | {f"e{i}": noisy(text(i, 120), i, 0.01) for i in range(12)} | {f"f{i}": noisy(text(i, 120), 50 + i, 0.01) for i in range(12)}
    args = word_docs(spark, docs, {k: 1 + "def".index(k[0]) for k in docs})
    made = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    before = made()
    got = {tuple(r) for r in incremental.pairs(*args).collect()}
    assert got == closed(brute(docs)) and len(got) == 24
    assert made() - before <= 140


def test_a_new_file_has_the_class_of_the_history_it_is_linked_to(spark, tmp_path):
    docs = {f"d{i}": text(i, 120) for i in range(6)} | {f"e{i}": noisy(text(i, 120), i, 0.01) for i in range(6)} | {f"f{i}": noisy(text(i, 120), 50 + i, 0.01) for i in range(4)} | {"f9": text(99, 120)}
    files, pages, papers = word_docs(spark, docs, {k: 1 + "def".index(k[0]) for k in docs})
    folder = str(tmp_path / "store")
    for b in (1, 2, 3):
        incremental.works(files.where(f"batch_no <= {b}"), pages, papers, folder)
    store = incremental.Store.open(spark, folder)
    rows = {r.file.rpartition("|")[2]: r for r in store.files(store.loads()).collect()}
    store.close()
    assert {k: r["class"] for k, r in rows.items()} == {k: rows["f9" if k == "f9" else "d" + k[1:]].no for k in rows} and len(rows) >= 12


def test_a_file_is_the_same_however_its_pages_are_dealt_out(spark):
    """Pages of a file that stand together are signed as one row; vector and text key don't depend on which do."""
    docs = {f"d{i}": text(i, 400) for i in range(8)}
    files = spark.createDataFrame([(k, 1) for k in docs], "pdf_id string, batch_no int")
    pages = spark.createDataFrame([(k, " ".join(w[i : i + 50])) for k, w in docs.items() for i in range(0, 400, 50)], "pdf_id string, text string")
    one, many = (incremental.signatures(files, p.coalesce(1)) for p in (pages.orderBy("pdf_id"), pages)), incremental.signatures(files, pages.repartition(16))
    got = [sorted(tuple(map(str, r)) for r in incremental.file_vectors(x).collect()) for x in (*one, many)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 8 and len({r[2] for r in got[0]}) == 8


def test_components_of_chains_and_stars(spark):
    edges = [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("s0", f"s{i}") for i in range(1, 300)] + [("q", "q"), (None, "q"), ("n000", "n001")]
    r = {x.u: x.root for x in components.roots(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert {r[f"n{i:03}"] for i in range(1, 41)} == {"n000"} and {r[f"s{i}"] for i in range(1, 300)} == {"s0"} and "q" not in r
    assert components.roots(spark.createDataFrame([], "u string, v string")).count() == 0
