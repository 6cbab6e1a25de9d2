"""Mixing sources to target weights: how often each document is used, so that sources reach their shares of the tokens.

1. Tokens are counted with a public tokenizer, whose file is a parameter.
2. Documents with a known source belong to it wholly; for the others a classifier fitted on the labelled table (documents with a known source; a
   bounded sample of PER_SOURCE a source) gives the posterior of each source: a soft membership.
3. Nonnegative rates per document, at most the source's max_repeats, are fitted by projected gradient descent so that the expected tokens of each source match
   target share times corpus size. A round sums expected tokens per source over all documents in Spark (a row per source reaches the driver); a document's rate
   follows from its membership and the gradients so far, so no state per document is kept between rounds.
4. Rates become whole numbers of uses: the whole part, and one more for the documents whose hash falls under a cut, which is set per source from
   token sums per hash bucket so that the total meets the expected one.

A source whose documents can't reach its share even at max_repeats stays at its bound; the shares reached are reported beside the targets.

Defined cases: null and empty texts have no tokens and are used as others of their source; sources outside the targets, or with share 0, are used 0 times; names written
unevenly count as one source; a repeated doc_id is one document per row; without any target nothing is used.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import spread, through_table

from .lines import tidy_name
from .models import fitted

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public byte-level BPE's split pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most sources of a target table: one row each reaches the driver, and a document's membership has one number a source.
MAX_SOURCES = 10_000
PER_SOURCE, FEATURES, ROUNDS, TOLERANCE, GAIN, CUTS = 150, 4_096, 30, 1e-4, 0.01, 4_096


def source_name(c: Column) -> Column:
    return F.regexp_replace(tidy_name(c), "[ _]+", "-")


def token_counter(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text)) if text else 0


def features(text: str, extra: tuple[str | None, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words (each once) and the further fields, as places and weights."""
    w = {*re.findall(r"[^\W\d_]{2,}", (text or "").lower()), *(f"{i}={x}" for i, x in enumerate(extra) if x)}
    at = np.unique([zlib.crc32(x.encode()) % FEATURES for x in w] or [0])
    return at, np.full(len(at), 1 / np.sqrt(len(at)), np.float32)


def fit_sources(rows: list[tuple[np.ndarray, int]], k: int, rounds: int = 60) -> np.ndarray:
    """Multinomial logistic regression, (FEATURES + 1, k); full-batch gradient steps with momentum."""
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    y = np.zeros((len(rows), k), np.float32)
    for i, (at, label) in enumerate(rows):
        x[i, at] = 1 / np.sqrt(len(at))
        x[i, -1] = 1
        y[i, label] = 1
    w = np.zeros((FEATURES + 1, k), np.float32)
    m = np.zeros_like(w)
    for _ in range(rounds):
        z = x @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        m = 0.9 * m + x.T @ (p - y) / max(1, len(rows)) + 1e-4 * w
        w -= 2.0 * m
    return w


def rate_of(member: np.ndarray, cap: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Rates after the steps: each adds the membership-weighted step and projects to [0, cap]. All documents begin at min(1, cap)."""
    r = np.minimum(1.0, cap)
    for s in steps:
        r = np.clip(r + member @ s, 0, cap)
    return r


def _prepared(docs: DataFrame, targets: list[tuple[str, float, int]], tokenizer: str, fresh: bool = True) -> DataFrame:
    """doc_id, source (null if unknown), tokens, text kept only where the source is unknown."""
    extra = [c for c in ("lang", "doc_type") if c in docs.columns]
    known = {s: i for i, (s, _, _) in enumerate(targets)}
    d = docs.select("doc_id", source_name(F.col("source")).alias("source"), "text", *extra)
    k = len(targets)

    def fit() -> np.ndarray:
        rows = []
        if known:
            of_known = d.where(F.col("source").isin(list(known)))
            sizes = {s: n for s, n in of_known.groupBy("source").agg(F.count(F.lit(1))).collect()}  # one row per target source
            share = F.create_map(*[F.lit(x) for s, n in sizes.items() for x in (s, int(min(1.0, 3 * PER_SOURCE / n) * 1_000_000) + 1)]) if sizes else None
            if sizes:
                # one pass: a hash keeps about three times the bound of each source, a window over these few takes the first by hash
                few = of_known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("source")])
                first = few.withColumn("__r", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("doc_id"), "doc_id"))).where(F.col("__r") <= PER_SOURCE)

                def places(batches):  # whole texts become at most FEATURES places on the executors
                    for b in batches:
                        yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"], "at": [features(t, x)[0].astype(np.int32) for t, x in zip(b["text"], zip(*[b[c] for c in extra]) if extra else [()] * len(b))]})

                got = first.select("doc_id", "source", "text", *extra).mapInPandas(places, "doc_id long, source string, at array<int>").orderBy("doc_id").toPandas()
                rows = [(np.asarray(at), known[x]) for x, at in zip(got["source"], got["at"])]
        return fit_sources(rows, k) if rows else np.zeros((FEATURES + 1, max(1, k)), np.float32)

    w = fitted("sources", [docs], fit, sorted(known), fresh=fresh)
    caps = np.array([c for _, _, c in targets], np.float64)

    def run(batches):
        count = token_counter(tokenizer)
        for b in batches:
            member = np.zeros((len(b), k), np.float32)
            for i, (s, t) in enumerate(zip(b["source"], b["text"])):
                if s in known:
                    member[i, known[s]] = 1
                elif s is None and k:
                    at, v = features(t or "", tuple(b[c].iloc[i] for c in extra))
                    z = v @ w[at] + w[-1]
                    p = np.exp(z - z.max())
                    member[i] = p / p.sum()
            top = np.where(member.sum(1) > 0, member.argmax(1), -1) if k else np.full(len(b), -1)
            cap = np.where(top >= 0, caps[np.maximum(top, 0)], 0.0) if k else np.zeros(len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "source": [s for s in b["source"]], "tokens": [count(t) for t in b["text"]], "member": list(member), "cap": cap, "top": top.astype(np.int32)})

    return spread(d).mapInPandas(run, "doc_id long, source string, tokens long, member array<float>, cap double, top int")


def fit_rates(table: DataFrame, shares: np.ndarray, total: float) -> np.ndarray:
    """The gradient steps (rounds, sources) of the projected descent; every round is one distributed sum over all documents."""
    k = len(shares)
    want = shares * total
    steps = np.zeros((0, k))
    size, last = None, np.inf
    for _ in range(ROUNDS):

        def add(batches, steps=steps):
            e, a, free = np.zeros(k), np.zeros(k), np.zeros(k)
            for b in batches:
                if not len(b):
                    continue
                m = np.stack(b["member"].to_numpy()).astype(np.float64)
                t, cap = b["tokens"].to_numpy(np.float64), b["cap"].to_numpy()
                e += (t * rate_of(m, cap, steps)) @ m
                a += t @ m
            yield pd.DataFrame({"s": np.arange(k), "e": e, "a": a})

        got = table.select("member", "tokens", "cap").mapInPandas(add, "s int, e double, a double").groupBy("s").agg(F.sum("e").alias("e"), F.sum("a").alias("a")).toPandas().set_index("s").reindex(range(k)).fillna(0)
        e, size = got["e"].to_numpy(), np.maximum(got["a"].to_numpy(), 1.0)
        loss = float((((want - e) / max(total, 1)) ** 2).sum())
        if loss > last * (1 - GAIN) or np.abs(want - e).max() < TOLERANCE * max(total, 1):
            break  # no further gain worth a pass over all documents
        last = loss
        step = (want - e) / size  # least squares in the metric of the sources' sizes
        steps = np.vstack([steps, step])
    return steps


def mixed(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, fresh: bool = True) -> DataFrame:
    """doc_id, source (the known one or the likeliest), tokens, times_used."""
    goal = targets.where("source is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share"), F.max("max_repeats")).orderBy("source").limit(MAX_SOURCES + 1)
    rows = [(r[0], float(r[1] or 0), int(r[2] or 0)) for r in goal.collect()]  # one row per source of the target table
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    table = through_table(_prepared(docs, rows, tokenizer, fresh), "mix")
    k = len(rows)
    if not k:
        return table.select("doc_id", "source", "tokens", F.lit(0).alias("times_used"))
    total = float(table.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    steps = fit_rates(table, np.array([s for _, s, _ in rows]), total)

    @F.pandas_udf("double")
    def rate(member: pd.Series, cap: pd.Series) -> pd.Series:
        if not len(member):
            return pd.Series([], dtype=float)
        return pd.Series(rate_of(np.stack(member.to_numpy()).astype(np.float64), cap.to_numpy(), steps))

    r = table.withColumn("rate", rate("member", "cap")).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole")).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(CUTS)).cast("int"))
    sums = r.where("top >= 0 and part > 1e-9").groupBy("top", "bucket").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("part")).alias("want")).toPandas()  # sources times buckets
    cuts = np.zeros(k, int)
    for s, g in sums.groupby("top"):
        g = g.sort_values("bucket")
        cum = np.concatenate([[0.0], g["t"].cumsum().to_numpy(float)])
        best = int(np.abs(cum - g["want"].sum()).argmin())
        cuts[int(s)] = int(g["bucket"].iloc[best - 1]) + 1 if best else 0
    cut = F.element_at(F.array(*[F.lit(int(c)) for c in cuts]), F.col("top") + 1)
    names = F.array(*[F.lit(s) for s, _, _ in rows])
    used = F.when(F.col("top") < 0, F.lit(0)).otherwise(F.col("whole") + F.when((F.col("part") > 1e-9) & (F.col("bucket") < cut), 1).otherwise(0))
    return r.select("doc_id", F.coalesce("source", F.when(F.col("top") >= 0, F.element_at(names, F.col("top") + 1))).alias("source"), "tokens", used.cast("int").alias("times_used"))


def shares(docs: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, fresh: bool = True) -> DataFrame:
    """source, target_share, max_repeats, docs, tokens, used_tokens, reached_share, most_used."""
    m = mixed(docs, targets, tokenizer, fresh)
    s = m.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("times_used")).alias("used_tokens"), F.max("times_used").alias("most_used"))
    goal = targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    j = goal.join(s, "source", "full").withColumn("all_used", F.sum("used_tokens").over(Window.partitionBy(F.lit(1))))  # one row a source
    return j.select("source", "target_share", "max_repeats", "docs", "tokens", "used_tokens", (F.col("used_tokens") / F.nullif(F.col("all_used"), F.lit(0))).alias("reached_share"), "most_used")
