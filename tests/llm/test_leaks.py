import random
import re

from corpusmill.llm import leaks


def words(t):
    return re.findall(r"[^\W_]+", re.sub(r"<[^>]+>", " ", t or "").lower())


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = words(t)
        for i, x, *_ in items:
            y = words(x)
            n = min(20, len(y))
            if n and any(w[a : a + n] == y[b : b + n] for b in range(len(y) - n + 1) for a in range(len(w) - n + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = ["film", "oxide", "state", "field", "10", "nm", "Ärmel", "x1"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n)), "D") for i, n in enumerate([5, 19, 20, 21, 40, 60])] + [(9, None, "D"), (10, "...", None), (11, "film oxide state field nm", "D")]
    docs = []
    for d in range(60):
        base = [rng.choice(vocab) for _ in range(30)]
        src = words(items[d % 6][1])
        k = rng.choice([4, 10, 19, 20, 25])
        a = rng.randrange(max(1, len(src) - k + 1))
        part = src[a : a + k]
        docs.append((d, rng.choice([" ", "\n", " - ", "</b> <i>"]).join(base[:15] + part + base[15:]).upper() if d % 2 else " ".join(base[:7] + part + base[7:])))
    docs += [(100, None), (101, ""), (102, items[5][1]), (102, items[5][1])]
    got = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, answer string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    text = dict(docs)
    for r in got:
        inside = words(text[r.doc_id][r.start : r.end])
        assert len(inside) >= min(20, len(words(dict((i, x) for i, x, _ in items)[r.item_id])))


def test_blocks_keep_every_item(spark):
    items = [(i, f"word{i} " * 25, None) for i in range(30)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in items], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string, answer string")
    for most in (leaks.MAX_PATTERN_WORDS, 10_000):
        assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, table, most=most).collect()} == {(i, i) for i in range(30)}
    assert leaks.leaks(docs, table.limit(0)).count() == 0


def test_long_tags_and_short_answers(spark):
    """A tag of any length is no text; a short answer counts behind its question's words, and alone says nothing."""
    q = " ".join(f"q{i}" for i in range(30))
    items = spark.createDataFrame([(1, q, "42 volts"), (2, " ".join(f"r{i}" for i in range(22)), None)], "item_id long, text string, answer string")
    tag = "<a title='" + "x " * 900 + "'>"
    rows = [(1, " ".join(f"q{i}" for i in range(12, 30)) + ": 42 Volts."), (2, " ".join(f"q{i}" for i in range(13, 30)) + ": 42 Volts."), (3, "42 volts"), (4, " ".join(f"r{i}" for i in range(11)) + tag + " ".join(f"r{i}" for i in range(11, 22)))]
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()} == {(1, 1), (4, 2)}


def test_long_answers_are_passages(spark):
    items = spark.createDataFrame([(1, "a question that nobody copied", "the answer has exactly these nine words in it")], "item_id long, text string, answer string")
    docs = spark.createDataFrame([(1, "so The answer has exactly these NINE words in it!")], "doc_id long, text string")
    assert leaks.leaks(docs, items).count() == 1
