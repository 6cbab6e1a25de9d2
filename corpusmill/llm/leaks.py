"""Evaluation texts leaking into training text.

Test items are reduced to words (runs of letters and digits, lower case). Every run of 20 consecutive words of an item, or the whole item
if it is shorter, is a pattern of one Aho-Corasick automaton; each text is scanned once, and a hit's place in the words is mapped to the
place in the text as stored. An answer goes on from its question, so the runs of 20 words pass from the one into the other: a letter or a number is searched behind its question's last
words. An answer of at least MIN_ANSWER_WORDS words is a passage of its own too.

The automaton runs over numbers that stand for words (0 for words of no pattern), so its size is the patterns' words, not their characters. It holds the evaluation set only, whose size is
summed before anything is collected: a set within MAX_PATTERN_WORDS is one automaton and one scan; a larger one is taken in blocks of whole items by hash, each within the bound,
collected and scanned one after the other.

Defined cases: null or empty texts and items have no hits; an item whose text has no letters or digits matches nothing; repeated items
are reported each under its own id; ties have no meaning here, a document has one row per item.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import spread

MIN_WORDS = 20
MIN_ANSWER_WORDS = 8
#: Words in an automaton's patterns; each is a node of some 100 bytes in every Python worker.
MAX_PATTERN_WORDS = 4_000_000

#: Markup between words: tags, entities.
MARKUP = re.compile(r"</?[A-Za-z!][^<>]*>|&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,10});")
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Lower-case words with their starts and ends in the text as stored."""
    blank = MARKUP.sub(lambda m: " " * (m.end() - m.start()), text)
    w, s, e = [], [], []
    for m in WORD.finditer(blank):
        w.append(m.group().lower())
        s.append(m.start())
        e.append(m.end())
    return w, s, e


def patterns(items: list[tuple[int, str, str | None]], n: int = MIN_WORDS) -> dict[tuple[str, ...], list[int]]:
    """Runs of words -> items that they are of."""
    out: dict[tuple[str, ...], list[int]] = {}
    for item, text, answer in items:
        q, a = words(text or "")[0], words(answer or "")[0]
        passages = [q, *([q + a] if q and a and len(q) + len(a) >= n else []), *([a] if len(a) >= MIN_ANSWER_WORDS else [])]
        for w in passages:
            for i in range(max(1, len(w) - n + 1) if w else 0):
                ids = out.setdefault(tuple(w[i : i + n]), [])
                if item not in ids:
                    ids.append(item)
    return out


def _scanner(table: dict[tuple[str, ...], list[int]], id_col: str, text_col: str):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        number: dict[str, int] = {}
        auto = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, ids in table.items():
            auto.add_word(tuple(number.setdefault(w, len(number) + 1) for w in p), (len(p), ids))
        auto.make_automaton()
        for b in batches:
            rows = []
            for doc, text in zip(b[id_col], b[text_col]):
                if not text:
                    continue
                w, s, e = words(text)
                seq = tuple(number.get(x, 0) for x in w)
                if not any(seq):
                    continue
                found: dict[int, list[int]] = {}
                for end, (length, ids) in auto.iter(seq):
                    for i in ids:
                        a = end - length + 1
                        span = found.setdefault(i, [a, end, 0])
                        span[1] = max(span[1], end)
                        span[0] = min(span[0], a)
                        span[2] += 1
                rows.extend((doc, i, s[a], e[z], n) for i, (a, z, n) in found.items())
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "hits"])

    return scan


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", most: int = MAX_PATTERN_WORDS) -> DataFrame:
    """doc_id, item_id, start, end (code points of the stored text), hits: one row per document and item it leaks."""
    answer = F.col("answer") if "answer" in items.columns else F.lit(None).cast("string")
    i = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"), answer.alias("a"))
    # a text has a word for two characters at most, each word starts at most three patterns
    need = i.agg(F.sum((F.coalesce(F.char_length("t"), F.lit(0)) + F.coalesce(F.char_length("a"), F.lit(0)) + 2) / 2 * MIN_WORDS)).first()[0] or 0
    blocks = max(1, -(-int(need) // most))
    out = None
    schema = "doc_id long, item_id long, start int, end int, hits int"
    for n in range(blocks):
        part = i if blocks == 1 else i.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == n)
        table = patterns([(int(r[0]), r[1], r[2]) for r in part.collect()])  # within the bound
        if not table:
            continue
        hits = spread(docs.select(id_col, text_col)).mapInPandas(_scanner(table, id_col, text_col), schema)
        out = hits if out is None else out.unionByName(hits)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
