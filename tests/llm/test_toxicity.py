import numpy as np
import pytest

from corpusmill.llm import toxicity as X


def test_tokens_undo_disguise():
    assert X.tokens("You 1d10t, i d i o t! m@n idiooooot T56 12.5") == ["you", "idiot", "idiot", "man", "idiot", "t#", "#.#"]
    assert X.tokens("") == [] and X.tokens("滚出 lab") == ["滚", "出", "lab"]


def test_windows_cover_every_word():
    for n in (0, 1, 19, 20, 21, 33, 100):
        seen = {i for s in X.windows(n) for i in range(s, min(n, s + X.WINDOW))}
        assert seen == set(range(n))


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    net = X.Net(0)
    table = X.TokenTable({f"w{i}": i + 2 for i in range(10)})
    win = X.cut([table.get(f"w{rng.integers(12)}") for _ in range(30)])
    y, w = np.zeros((len(win), 3), np.float32), np.ones((len(win), 3), np.float32)
    y[0, 1] = 1
    arrays = table.arrays()

    def loss():
        p = X._sigmoid(net.forward(net.project(net.token_vectors(*arrays)), win))
        return -(w * (y * np.log(p + 1e-6) + (1 - y) * np.log(1 - p + 1e-6))).sum() / len(win)

    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(arrays, win, y, w, 0.0)
    grads = {k: m / 0.1 for k, m in net.m.items()}
    for k in ("u", "wx", "wa", "va", "wo", "ew", "ec", "b"):
        flat = before[k].reshape(-1)
        for at in rng.choice(flat.size, 3, replace=False):
            if k in ("ew", "ec") and grads[k].reshape(-1)[at] == 0:
                continue
            old, h = flat[at], 1e-4
            net.p = {q: v.copy() for q, v in before.items()}
            net.p[k].reshape(-1)[at] = old + h
            up = loss()
            net.p[k].reshape(-1)[at] = old - h
            down = loss()
            assert grads[k].reshape(-1)[at] == pytest.approx((up - down) / (2 * h), abs=5e-3)
            net.p = before


def test_long_words_are_read_whole():
    a, b = "x" * 45 + "idiot", "x" * 45 + "flower"
    assert X.gram_ids(a) != X.gram_ids(b) and len(X.gram_ids("q" * 60)) == 61 + 60 + 59
    one, two = set(X.gram_ids("disgusting")), set(X.gram_ids("disgussting"))
    assert len(one & two) / len(one | two) > 0.6
    table = X.TokenTable({})
    ids = [table.get(x) for x in (a, b, "film")]
    net = X.Net(0)
    vec = net.token_vectors(*table.arrays())
    assert np.allclose(net.token_vectors(*X._some(table.arrays(), np.array(ids))), vec[ids]) and not np.allclose(vec[ids[0]], vec[ids[1]])
    assert np.allclose(vec[1], np.hstack([net.p["ew"][1], net.p["ec"][X.gram_ids(a)].mean(0)]), atol=1e-5)


def test_parts_score_like_the_whole():
    texts = ["the film holds", None, "", "oxide " * 50, "the oxide film"]
    net = X.Net(3)
    s = X.Scorer(net.p, {"film": 2})
    whole = s.score(texts)
    again = X.Scorer(net.p, {"film": 2})
    assert np.allclose(whole, np.vstack([again.score([t]) for t in texts]), atol=1e-5) and not whole[1].any() and not whole[2].any()


def corpus():
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice("film oxide field layer stack cycle phase grain pulse device".split(), 60)) + "." for _ in range(160)]
    bad = {"abusive": "you worthless idiot get lost", "hateful": "those people are vermin lock them up", "sexual": "send naked photos to my bed"}
    docs, labels = [], []
    for i, t in enumerate(clean):
        kind = [None, None, *bad][i % 5]
        w = t.split()
        docs.append((i, None if i == 0 else " ".join(w[:30]) + f" {bad[kind]} " + " ".join(w[30:]) if kind else t, ["Src A", "src_a", None][i % 3]))
        labels.append((i, kind or "clean"))
    return docs, labels


def test_held_out_accuracy_and_edge_cases(spark):
    docs, labels = corpus()
    train = spark.createDataFrame([x for x in labels if x[0] < 120] + [(999, "clean"), (None, "clean")], "doc_id long, label string")
    df = spark.createDataFrame(docs + [(500, "", None), (501, None, None)], "doc_id long, text string, source string")
    got = {(r.doc_id, r.kind) for r in X.found(df, train).collect()}
    want = {(i, k) for i, k in labels if k != "clean"}
    held = {x for x in want if x[0] >= 120}
    assert len(got & held) >= 0.9 * len(held) and len(got - want) <= 2 and not {500, 501} & {d for d, _ in got}
    r = X.rates(df, train).collect()
    assert {x.source for x in r} == {"src-a", "unknown"} and sum(x.docs for x in r) == df.count()


def test_without_labels_nothing_is_found(spark):
    docs, _ = corpus()
    df = spark.createDataFrame(docs[:10], "doc_id long, text string, source string")
    assert X.found(df, spark.createDataFrame([], "doc_id long, label string")).count() == 0
