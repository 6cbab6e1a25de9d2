"""Skip-gram vectors with negative sampling, learned from exact co-occurrence counts.

The skip-gram objective with negative sampling depends on the corpus only through the counts of word pairs (Levy and Goldberg, 2014). The counts
are gathered over all texts in Spark; the vectors are then fitted to the expected objective with full-batch Adam in numpy.
The vocabulary is bounded, so the pair table on the driver has at most VECTORS squared entries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VECTORS, SPAN, DIM, NEGATIVE, ROUNDS = 2_048, 4, 32, 5, 60


def pair_counts(texts: DataFrame, column: str, vocab: dict[str, int], split, core: int | None = None) -> DataFrame:
    """a, b, n: pairs of vocabulary words at most SPAN words apart (a before b), summed per task before the shuffle. core: one of the two is among the first so many."""
    size = len(vocab)
    core = size if core is None else core

    def count(batches):
        for b in batches:
            keys = []
            for t in b[column]:
                ids = np.array([vocab.get(w, -1) for w in split(t)] if t else [], dtype=np.int64)
                for d in range(1, SPAN + 1):
                    x, y = ids[:-d], ids[d:]
                    ok = (x >= 0) & (y >= 0) & (np.minimum(x, y) < core)
                    keys.append(x[ok] * size + y[ok])
            k, n = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            yield pd.DataFrame({"a": (k // max(1, size)).astype(np.int32), "b": (k % max(1, size)).astype(np.int32), "n": n.astype(np.int64)})

    return texts.select(column).mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def fit(pairs: pd.DataFrame, size: int, dim: int = DIM, rounds: int = ROUNDS, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors (size, dim)."""
    n = np.zeros((size, size), np.float32)
    n[pairs["a"].to_numpy(), pairs["b"].to_numpy()] = pairs["n"].to_numpy()
    n += n.T
    total = max(float(n.sum()), 1.0)
    row = n.sum(1)
    q = row**0.75
    q /= max(q.sum(), 1e-9)
    pos = n / total
    neg = (NEGATIVE / total) * row[:, None] * q[None, :]
    g = np.random.default_rng(seed)
    x, y = (g.normal(0, 0.1, (size, dim)).astype(np.float32) for _ in range(2))
    both = (pos + neg).astype(np.float32)
    m = [np.zeros_like(x) for _ in range(4)]
    for t in range(1, rounds + 1):
        s = 1 / (1 + np.exp(-np.clip(x @ y.T, -15, 15)))
        d = (both * s - pos) * size  # gradient of the negative log likelihood, scaled
        gx, gy = d @ y, d.T @ x
        for k, (p, gr) in enumerate(((x, gx), (y, gy))):
            m[k] = 0.9 * m[k] + 0.1 * gr
            m[2 + k] = 0.99 * m[2 + k] + 0.01 * gr * gr
            p -= 0.08 * (m[k] / (1 - 0.9**t)) / (np.sqrt(m[2 + k] / (1 - 0.99**t)) + 1e-8)
    return x, y


def outer_pairs(texts: DataFrame, column: str, core: dict[str, int], split, holds) -> DataFrame:
    """word, j, n: words outside the core for which `holds`, with the core words at most SPAN words away."""

    def count(batches):
        for b in batches:
            got: dict[tuple[str, int], int] = {}
            for t in b[column]:
                ws = split(t) if t else []
                ids = [core.get(w, -1) for w in ws]
                for i, w in enumerate(ws):
                    if ids[i] < 0 and holds(w):
                        for j in ids[max(0, i - SPAN) : i] + ids[i + 1 : i + 1 + SPAN]:
                            if j >= 0:
                                got[w, j] = got.get((w, j), 0) + 1
            yield pd.DataFrame({"word": [k[0] for k in got], "j": np.array([k[1] for k in got], np.int32), "n": np.array(list(got.values()), np.int64)})

    return texts.select(column).mapInPandas(count, "word string, j int, n long").groupBy("word", "j").agg(F.sum("n").alias("n"))


def _descend(n: np.ndarray, neg: np.ndarray, fixed: np.ndarray, rounds: int) -> np.ndarray:
    v, m, u = (np.zeros((len(n), fixed.shape[1]), np.float32) for _ in range(3))
    for t in range(1, rounds + 1):
        g = ((n + neg) / (1 + np.exp(-np.clip(v @ fixed.T, -15, 15))) - n) @ fixed
        m, u = 0.9 * m + 0.1 * g, 0.99 * u + 0.01 * g * g
        v = v - 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(u / (1 - 0.99**t)) + 1e-8)
    return v.astype(np.float32)


def folded(pairs: DataFrame, words: int, x: np.ndarray, y: np.ndarray, row: np.ndarray) -> DataFrame:
    """word, x, y: vectors of words outside the core under the same objective, each by itself, the core's vectors (x, y, with their pair counts by row) held. pairs: word, j, n."""

    def fit_block(b: pd.DataFrame) -> pd.DataFrame:
        names, at = np.unique(b["word"].to_numpy(), return_inverse=True)
        n = np.zeros((len(names), len(x)), np.float32)
        np.add.at(n, (at, b["j"].to_numpy()), b["n"].to_numpy())
        own, total = n.sum(1, keepdims=True), (row**0.75).sum()
        px = _descend(n / own, np.broadcast_to(NEGATIVE * row**0.75 / total, n.shape), y, ROUNDS)
        py = _descend(n / own, NEGATIVE * row[None, :] * (own**0.75 / total) / own, x, ROUNDS)
        return pd.DataFrame({"word": names, "x": list(px), "y": list(py)})

    block = F.pmod(F.xxhash64("word"), F.lit(max(1, words // 64)))
    return pairs.groupBy(block).applyInPandas(fit_block, "word string, x array<float>, y array<float>")
