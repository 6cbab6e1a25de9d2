"""Abusive, hateful or sexual content: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Input per word: a word vector and the mean of hashed character n-gram vectors, so that disguised words are read by their characters (look-alike
signs are undone, letters set apart are joined, long runs shortened). Every text is cut into overlapping windows
of WINDOW words, STRIDE apart, and all windows are scored; a document's score for a kind is that of its worst window.

Labels belong to documents, so training is by multiple instances: word odds choose the first suspicious window of each labelled document, the
network then chooses anew. A document labelled with one kind says nothing about the others; clean documents are negative for all kinds.
The classifier is fitted on a bounded sample of labelled rows: at most MAX_PER_KIND documents of each kind and MAX_CLEAN clean ones, by hash order.

Defined cases: null and empty texts score 0; a text shorter than a window is one window; a document labelled twice counts once per label; without
any positive label of a kind, nothing is found for that kind; repeated document ids are scored row by row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import spread

from .models import fitted

KINDS = ("abusive", "hateful", "sexual")
WINDOW, STRIDE = 20, 10
MAX_PER_KIND, MAX_CLEAN = 900, 2_600
MIN_STEPS = 60
#: Labelled texts longer than this aren't drawn into the training sample, whose texts are whole and go to the driver.
SAMPLE_CHARS = 20_000
VOCAB, BUCKETS = 4_000, 1_024
D_WORD, D_CHAR, HIDDEN, ATT = 24, 16, 24, 16
THRESHOLD = 0.6
OTHER_KINDS, HARD, STRONG = 0.7, 1.5, 0.7

# Signs that stand for letters.
LOOKALIKE = str.maketrans({"@": "a", "0": "o", "1": "i", "3": "e", "$": "s", "4": "a", "5": "s", "7": "t", "!": "i"})
_TOKEN = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\s぀-ヿ㐀-鿿가-힯，。、；：？！「」『』（）]+")
_EDGE = ".,;:!?()[]{}<>\"'“”‘’«»…|/\\-–—_#"
_RUN = re.compile(r"(\w)\1{2,}")


@lru_cache(200_000)
def _normal(raw: str) -> tuple[str, bool]:
    """The word's normal form ('' if only marks), and whether it's a single letter that may belong to a word set apart."""
    t = raw.strip(_EDGE)
    if not t:
        return "", False
    if len(t) == 1 and (t.isascii() and t.isalpha() or t in "@$013"):
        return t.translate(LOOKALIKE) if not t.isalpha() else t, True
    if any(c in "@$" for c in t) or re.fullmatch(r"[a-z013457'-]*[a-z][013457]+[a-z][a-z013457'-]*", t) or re.fullmatch(r"[013457][a-z]{2}[a-z013457]*[a-z]", t):
        t = t.translate(LOOKALIKE)
    else:
        t = re.sub(r"\d+", "#", t)
    return _RUN.sub(r"\1", t), False


def tokens(text: str) -> list[str]:
    """Normalised words; digits become #, unless they stand for letters inside a word; CJK characters are words."""
    out: list[str] = []
    single: list[str] = []

    def flush() -> None:
        if len(single) >= 4:
            out.append("".join(single))
        else:
            out.extend(single)
        single.clear()

    for raw in _TOKEN.findall(text.lower()):
        t, apart = _normal(raw)
        if apart:
            single.append(t)
        elif t:
            if single:
                flush()
            out.append(t)
    if single:
        flush()
    return out


def windows(n: int) -> list[int]:
    """Starts of the overlapping windows over n words; together they cover all words."""
    if n <= WINDOW:
        return [0] if n else []
    starts = list(range(0, n - WINDOW, STRIDE))
    return [*starts, n - WINDOW]


def gram_ids(token: str) -> list[int]:
    """Buckets of all n-grams of two to four characters of the whole token."""
    s = f"<{token}>"
    return [zlib.crc32(s[i : i + k].encode()) % BUCKETS for k in (2, 3, 4) for i in range(len(s) - k + 1)]


class TokenTable:
    """Ids of distinct tokens with their word ids and n-gram ids, the latter one after the other with their number for each token."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab, self.ids = vocab, {"": 0}
        self.word, self.grams, self.n_grams = [0], [BUCKETS], [1]

    def get(self, t: str) -> int:
        i = self.ids.get(t)
        if i is None:
            i = self.ids[t] = len(self.word)
            self.word.append(self.vocab.get(t, 1))
            g = gram_ids(t)
            self.grams.extend(g)
            self.n_grams.append(len(g))
        return i

    def arrays(self, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, n-gram ids in one row, n-grams of each token; of the tokens from `start` on."""
        n = np.array(self.n_grams, np.int64)
        return np.array(self.word[start:]), np.array(self.grams[int(n[:start].sum()) :], np.int64), n[start:]


def _some(table: tuple[np.ndarray, np.ndarray, np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The arrays of the tokens in `used`."""
    word, grams, n = table
    starts, m = (np.cumsum(n) - n)[used], n[used]
    return word[used], grams[np.repeat(starts - (np.cumsum(m) - m), m) + np.arange(m.sum())], m


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _sums(at: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """(size, columns): the rows summed by their place."""
    out = np.zeros((size, rows.shape[1]), rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        places, starts = np.unique(at[order], return_index=True)
        out[places] = np.add.reduceat(rows[order], starts)
    return out


class Net:
    """Bidirectional GRU with attention pooling; both directions run as one stacked array."""

    def __init__(self, seed: int = 1):
        g = np.random.default_rng(seed)
        d = D_WORD + D_CHAR
        u = lambda *s, f: g.normal(0, f, s).astype(np.float32)
        self.p = {
            "ew": u(VOCAB + 2, D_WORD, f=0.1), "ec": u(BUCKETS + 1, D_CHAR, f=0.3), "wx": u(2, d, 3 * HIDDEN, f=d**-0.5), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "u": u(2, HIDDEN, 3 * HIDDEN, f=HIDDEN**-0.5), "wa": u(2 * HIDDEN, ATT, f=(2 * HIDDEN) ** -0.5), "va": u(ATT, f=0.3), "wo": u(2 * HIDDEN, len(KINDS), f=0.2), "bo": np.full(len(KINDS), -1.5, np.float32),
        }
        self.p["ec"][BUCKETS] = 0
        self.m = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.v = {k: np.zeros_like(v) for k, v in self.p.items()}
        self.t = 0

    def token_vectors(self, word: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.p["ec"][grams], np.cumsum(n) - n) if len(n) else np.zeros((0, D_CHAR), np.float32)
        return np.hstack([self.p["ew"][word], sums / n[:, None]]).astype(np.float32)

    def forward(self, proj: np.ndarray, win: np.ndarray, keep: bool = False):
        """proj: (2, tokens, 3H) projected token vectors; win: (n, WINDOW) token places, -1 for none."""
        p, n, h = self.p, len(win), np.zeros((2, len(win), HIDDEN), np.float32)
        order = np.stack([np.arange(WINDOW), np.arange(WINDOW)[::-1]])
        mask = (win >= 0).astype(np.float32)
        at = np.maximum(win, 0)
        states = np.zeros((2, WINDOW, n, HIDDEN), np.float32)
        tape = []
        for s in range(WINDOW):
            x = np.stack([proj[0][at[:, order[0, s]]], proj[1][at[:, order[1, s]]]])
            mk = np.stack([mask[:, order[0, s]], mask[:, order[1, s]]])[:, :, None]
            g = h @ p["u"]
            zr = _sigmoid(x[:, :, : 2 * HIDDEN] + g[:, :, : 2 * HIDDEN])
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            hc = g[:, :, 2 * HIDDEN :]
            c = np.tanh(x[:, :, 2 * HIDDEN :] + r * hc)
            new = c + z * (h - c)
            if keep:
                tape.append((h, z, r, hc, c, mk))
            h = h + mk * (new - h)
            states[0, order[0, s]] = h[0]
            states[1, order[1, s]] = h[1]
        hs = np.concatenate([states[0], states[1]], axis=2).transpose(1, 0, 2)  # n, T, 2H
        e = np.tanh(hs @ p["wa"])
        a = e @ p["va"] + (mask - 1) * 1e4
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        pooled = (a[:, :, None] * hs).sum(1)
        logit = pooled @ p["wo"] + p["bo"]
        return (logit, (hs, e, a, pooled, tape, order, at)) if keep else logit

    def project(self, vec: np.ndarray) -> np.ndarray:
        return np.stack([vec @ self.p["wx"][0], vec @ self.p["wx"][1]]) + self.p["b"]

    def step(self, table: tuple, win: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> float:
        """One Adam step on windows with targets y and weights (n, kinds)."""
        p = self.p
        used, local = np.unique(np.maximum(win, 0), return_inverse=True)
        local = np.where(win >= 0, local.reshape(win.shape), -1)
        word, grams, ng = _some(table, used)
        vec = self.token_vectors(word, grams, ng)
        proj = self.project(vec)
        logit, (hs, e, a, pooled, tape, order, at) = self.forward(proj, local, True)
        prob = _sigmoid(logit)
        loss = -(weight * (y * np.log(prob + 1e-6) + (1 - y) * np.log(1 - prob + 1e-6))).sum() / len(win)
        dl = weight * (prob - y) / len(win)
        g = {"wo": pooled.T @ dl, "bo": dl.sum(0)}
        dp = dl @ p["wo"].T
        da = (dp[:, None, :] * hs).sum(2)
        dhs = a[:, :, None] * dp[:, None, :]
        ds = a * (da - (a * da).sum(1, keepdims=True))
        g["va"] = ds.reshape(-1) @ e.reshape(-1, ATT)
        de = ds[:, :, None] * p["va"] * (1 - e * e)
        g["wa"] = hs.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, ATT)
        dhs = dhs + de @ p["wa"].T
        dst = np.stack([dhs[:, :, :HIDDEN], dhs[:, :, HIDDEN:]])  # 2, n, T, H
        dh = np.zeros_like(tape[0][0])
        g["u"] = np.zeros_like(p["u"])
        dxs = np.zeros((2, WINDOW, len(win), 3 * HIDDEN), proj.dtype)  # in the order of the text
        for s in range(WINDOW - 1, -1, -1):
            h, z, r, hc, c, mk = tape[s]
            dh = dh + np.stack([dst[0][:, order[0, s]], dst[1][:, order[1, s]]])
            dn = dh * mk
            dac = dn * (1 - z) * (1 - c * c)
            daz = dn * (h - c) * z * (1 - z)
            dar = dac * hc * r * (1 - r)
            dg = np.concatenate([daz, dar, dac * r], axis=2)
            dx = np.concatenate([daz, dar, dac], axis=2)
            g["u"] += h.transpose(0, 2, 1) @ dg
            for k in (0, 1):
                dxs[k, order[k, s]] = dx[k]
            dh = dh * (1 - mk) + dn * z + dg @ p["u"].transpose(0, 2, 1)
        dproj = np.stack([_sums(at.T.reshape(-1), dxs[k].reshape(-1, 3 * HIDDEN), proj.shape[1]) for k in (0, 1)])
        g["b"] = dproj.sum(1, keepdims=True)
        g["wx"] = np.stack([vec.T @ dproj[0], vec.T @ dproj[1]])
        dvec = dproj[0] @ p["wx"][0].T + dproj[1] @ p["wx"][1].T
        g["ew"] = _sums(word, dvec[:, :D_WORD], len(p["ew"]))
        g["ec"] = _sums(grams, np.repeat(dvec[:, D_WORD:] / ng[:, None], ng, axis=0), len(p["ec"]))
        g["ec"][BUCKETS] = 0
        self.t += 1
        for k, d in g.items():
            d = d + (1e-5 * p[k] if k in ("ew", "ec") else 0)
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            p[k] -= (rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-7)).astype(np.float32)
        return float(loss)

    def score(self, table: tuple, win: np.ndarray, block: int = 2_048) -> np.ndarray:
        return self.score_projected(self.project(self.token_vectors(*table)), win, block)

    def score_projected(self, proj: np.ndarray, win: np.ndarray, block: int = 2_048) -> np.ndarray:
        out = [_sigmoid(self.forward(proj, win[s : s + block])) for s in range(0, len(win), block)]
        return np.vstack(out) if out else np.zeros((0, len(KINDS)), np.float32)


def cut(ids: list[int]) -> np.ndarray:
    w = np.full((len(windows(len(ids))), WINDOW), -1, np.int64)
    for k, s in enumerate(windows(len(ids))):
        part = ids[s : s + WINDOW]
        w[k, : len(part)] = part
    return w


def train(texts: list[str], labels: list[str], seed: int = 1, rounds: int = 6, epochs: int = 3) -> tuple[Net, dict[str, int]]:
    """The network and its vocabulary, from texts with one label each."""
    rng = np.random.default_rng(seed)
    if not texts or not set(labels) & set(KINDS):
        net = Net(seed)
        net.p["wo"][:] = 0
        net.p["bo"][:] = -20
        return net, {}
    toks = [tokens(t) for t in texts]
    df = Counter(w for t in toks for w in set(t))
    vocab = {w: i + 2 for i, (w, _) in enumerate(sorted(((w, n) for w, n in df.items() if n > 1), key=lambda x: (-x[1], x[0]))[:VOCAB])}
    table = TokenTable(vocab)
    ids = [[table.get(w) for w in t] for t in toks]
    kind = np.array([KINDS.index(x) if x in KINDS else -1 for x in labels])
    wins, doc = [], []
    for i, x in enumerate(ids):
        w = cut(x)
        wins.append(w)
        doc.append(np.full(len(w), i))
    win, doc = np.vstack(wins), np.concatenate(doc)
    arrays = table.arrays()
    n_tok = len(arrays[0])
    clean = kind == -1
    has = np.zeros((n_tok, len(KINDS) + 1))
    for i, x in enumerate(ids):
        has[np.unique(x).astype(int) if len(x) else [], kind[i]] += 1  # kind -1 is the last column
    total = [max(1, (kind == k).sum()) for k in range(len(KINDS))] + [max(1, clean.sum())]
    rate = (has + 0.5) / (np.array(total) + 1)
    odds = np.log(rate[:, : len(KINDS)] / rate[:, -1:])
    odds[0] = 0
    odds[has[:, : len(KINDS)] < min(3, 1 + len(texts) // 400)] = 0  # a word of one or two documents says nothing about a kind
    prior = np.stack([np.where(win >= 0, np.maximum(odds[np.maximum(win, 0), k], 0), 0).sum(1) for k in range(len(KINDS))], axis=1)
    net = Net(seed)
    score = prior
    wk = kind[doc]
    starts = np.searchsorted(doc, np.arange(len(ids)))
    ends = np.searchsorted(doc, np.arange(len(ids)), side="right")
    # what the worst windows of clean documents reach by word odds: a labelled document that stays below is taken for a wrong label
    worst = np.array([prior[starts[i] : ends[i]].max(0) for i in np.flatnonzero(clean) if ends[i] > starts[i]])
    floor = np.quantile(worst, 0.98, axis=0) if len(worst) else np.zeros(len(KINDS))
    for r in range(rounds):
        pos, target, own_weight = [], [], []
        for i in np.flatnonzero(~clean):
            s, e = starts[i], ends[i]
            if e > s:
                own = score[s:e, kind[i]]
                best = own.max()
                if best <= (floor[kind[i]] if r == 0 else 0.5):
                    continue  # no window looks like its label
                pick = np.flatnonzero(own >= (best - 1e-6 if r == 0 else best - 0.05))
                beside = {j + d for j in pick[:4] for d in (-1, 1) if 0 <= j + d < e - s} - set(pick.tolist())
                for j, weight in [(j, 1.5) for j in pick[:4]] + [(j, 0.0) for j in sorted(beside)]:  # neighbours tell of the other kinds only
                    pos.append(s + j)
                    target.append(kind[i])
                    own_weight.append(weight)
        picked = [np.array([p for p, k, o in zip(pos, target, own_weight) if k == x and o > 0], int) for x in range(len(KINDS))]
        strong = np.array([STRONG * np.median(prior[p, x]) if len(p) else np.inf for x, p in enumerate(picked)])
        base = sum(o > 0 for o in own_weight)
        cw = np.flatnonzero(wk == -1)
        if not len(pos) or not len(cw):
            break
        hard = cw[np.argsort(-(score[cw] / (1 if r else np.maximum(floor, 1e-6))).max(1), kind="stable")[: 3 * base // 2]]
        enough = -(-MIN_STEPS * 192 // max(1, len(pos) + 3 * base + base // 2))  # few labels take more epochs
        for _ in range(max(epochs, enough)):
            neg = np.concatenate([rng.choice(cw, min(len(cw), 2 * base), replace=False), hard])
            idx = np.concatenate([pos, neg])
            y = np.zeros((len(idx), len(KINDS)), np.float32)
            at = np.arange(len(pos))
            y[at, target] = np.array(own_weight) > 0
            w = np.ones_like(y)
            w[len(pos) + len(neg) - len(hard) :] = HARD
            w[: len(pos)] = np.where(prior[pos] <= strong, OTHER_KINDS, 0)  # a window seldom holds two kinds, unless its words say so
            w[at, target] = own_weight
            order = rng.permutation(len(idx))
            for s in range(0, len(order), 192):
                o = order[s : s + 192]
                net.step(arrays, win[idx[o]], y[o], w[o], 0.006 if r < rounds - 1 else 0.003)
        score = net.score(arrays, win)
    for k in range(len(KINDS)):
        if not (kind == k).any():
            net.p["wo"][:, k] = 0
            net.p["bo"][k] = -20
    return net, vocab


def labelled_sample(docs: DataFrame, labels: DataFrame, per_kind: int = MAX_PER_KIND, clean: int = MAX_CLEAN) -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts, by hash order; the bounds are counted before texts are fetched."""
    most = {k: per_kind for k in KINDS} | {"clean": clean}
    lab = labels.where(F.col("label").isin(*most) & F.col("doc_id").isNotNull()).select("doc_id", "label").distinct()
    parts = [lab.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in most.items()]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    rows = docs.select("doc_id", "text").where(F.char_length("text") <= SAMPLE_CHARS).join(F.broadcast(chosen), "doc_id").orderBy("doc_id", "label").collect()
    return [r["text"] for r in rows], [r["label"] for r in rows]


class Scorer:
    """Scores texts in parts; the projected vectors of tokens met before are kept."""

    def __init__(self, weights: dict[str, np.ndarray], vocab: dict[str, int]):
        self.net = Net.__new__(Net)
        self.net.p, self.vocab = weights, vocab
        self.table, self.proj = TokenTable(vocab), np.zeros((2, 0, 3 * HIDDEN), np.float32)
        self.known = 0

    def _projected(self) -> np.ndarray:
        n = len(self.table.word)
        if n > self.known:
            new = self.net.project(self.net.token_vectors(*self.table.arrays(self.known)))
            if n > self.proj.shape[1]:
                more = np.zeros((2, 2 * n - self.proj.shape[1], 3 * HIDDEN), np.float32)
                self.proj = np.concatenate([self.proj, more], axis=1)
            self.proj[:, self.known : n] = new
            self.known = n
        return self.proj

    def score(self, texts: list[str | None]) -> np.ndarray:
        """(texts, kinds): the score of each text's worst window."""
        if len(self.table.word) > 100_000:
            self.table, self.known = TokenTable(self.vocab), 0
        cuts = [cut([self.table.get(w) for w in tokens(t)]) if t else np.zeros((0, WINDOW), np.int64) for t in texts]
        sc = self.net.score_projected(self._projected(), np.vstack(cuts) if cuts else np.zeros((0, WINDOW), np.int64))
        out, at = np.zeros((len(texts), len(KINDS)), np.float32), 0
        for i, c in enumerate(cuts):
            if len(c):
                out[i] = sc[at : at + len(c)].max(0)
            at += len(c)
        return out


def scored(docs: DataFrame, labels: DataFrame, fresh: bool = True) -> DataFrame:
    """doc_id, source, abusive, hateful, sexual: scores from 0 to 1; all windows of all whole texts are scored."""

    def fit() -> tuple[dict[str, np.ndarray], dict[str, int]]:
        net, vocab = train(*labelled_sample(docs, labels))
        return net.p, vocab

    weights, vocab = fitted("content", [docs.select("doc_id", "text"), labels], fit, fresh=fresh)

    def run(batches):
        scorer = Scorer(weights, vocab)
        for b in batches:
            for s in range(0, len(b), 256):
                part = b.iloc[s : s + 256]
                out = scorer.score(list(part["text"]))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "source": part["source"].to_numpy(), **{k: out[:, j] for j, k in enumerate(KINDS)}})

    return spread(docs.select("doc_id", "source", "text")).mapInPandas(run, "doc_id long, source string, abusive float, hateful float, sexual float")


def found(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    s = scored(docs, labels)
    kinds = F.array(*[F.when(F.col(k) >= threshold, F.lit(k)) for k in KINDS])
    return s.select("doc_id", F.explode(F.array_compact(kinds)).alias("kind")).distinct()


def rates(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fresh: bool = True) -> DataFrame:
    """Per tidied source: documents, and the share with each kind of content."""
    from .lines import tidy_name

    s = scored(docs, labels, fresh).withColumn("source", F.coalesce(F.regexp_replace(tidy_name(F.col("source")), "[ _]", "-"), F.lit("unknown")))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), *[F.avg((F.col(k) >= threshold).cast("double")).alias(f"{k}_rate") for k in KINDS])
