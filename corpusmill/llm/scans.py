"""Noise in text from scanned pages: misread characters, cut words, running headers, page numbers.

1. Words are counted over all pages. A skeleton maps characters that scanners confuse to the same string (m and rn, d and cl, e and c ...), so that two
   words with one skeleton differ by plausible glyph edits only.
2. Skip-gram vectors are learned for the frequent words from co-occurrences over all pages; words that have a far more frequent word of
   the same skeleton get none, as a misreading that recurs would fit its own contexts best.
3. On each scanned page, furniture (a source's repeated lines, headers naming the paper, page numbers) is set aside; rare words are linked to
   frequent words of the same skeleton, and the candidate of the highest score (logarithm of the ratio of counts, plus how well its vector fits the surrounding
   words) replaces them if that score reaches the logarithm of RATIO; words cut at line ends are
   joined if the whole word is known better than the compound; lines flow together into paragraphs.

Counts decide by their ratios only, so the result doesn't depend on the corpus's size. The lexicon that goes to the tasks is bounded (LEXICON most frequent words,
counted over everything). Words beyond it stand in a table with their counts and vectors; pages are joined with what their repair asks of it, until none asks for more. Vectors are fitted
jointly for VECTORS words, and for all others each by itself against these.

Defined cases: null text comes out null with no cases; a blank page as ''; a page without a paper has no header; a page whose text is
all furniture comes out ''; very long texts are processed whole, in linear time.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, scratch, spread, through_table

from . import skipgram
from .lines import with_source
from .models import fitted

LEXICON = 200_000
#: A word is rare against another if that occurs this many times as often.
RATIO = 10
#: Most that the surrounding words may add to a candidate's log ratio of counts, or take from it.
CONTEXT = 2.0
MIN_COUNT = 3
#: Lines at a page's ends that may be furniture whatever stands beyond them; further ones only outside the running text.
MARGIN = 4
MIN_LINE_SKELETON, MIN_DOCS, MIN_SHARE = 25, 4, 0.04

# Characters that scanners confuse, each with the string that stands for it.
ONE = {"@": "a", "e": "c", "9": "g", "l": "i", "1": "i", "!": "i", "|": "i", "0": "o", "t": "r", "†": "r", "5": "s", "$": "s"}
MANY = {"d": "ci", "h": "ii", "u": "ii", "m": "rri", "n": "ri", "w": "vv"}
HYPHENS = "-‐­¬"

_SKEL = str.maketrans({**ONE, **MANY})


def skeleton(word: str) -> str:
    return word.lower().translate(_SKEL)


def line_skeleton(c: Column) -> Column:
    """Skeleton of a line's letters and look-alike signs, in JVM expressions."""
    s = F.regexp_replace(F.lower(c), "[^a-z@!|$†]+", "")
    s = F.translate(s, "".join(ONE), "".join(ONE.values()))
    for a, b in MANY.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


_WORD = re.compile(r"\S+")
_STRIP = ".,;:?()[]{}\"'“”‘’«»*…"
_RIGHT = re.compile(r"[a-z]+(?:-[a-z]+)*")
_LOWER = re.compile(r"(?<!\S)[a-z]{2,}(?!\S)")


def is_right(w: str) -> bool:
    """Whether a word may be the right form of others."""
    return len(w) >= 3 and len(set(w)) > 1 and bool(_RIGHT.fullmatch(w)) and not _ROMAN.match(w)


def words(text: str) -> list[str]:
    """Lower-case words of a page, marks around them removed."""
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over all pages, for words that hold a letter. Marks are taken off after a first count, once for each distinct form."""
    marks = r"[.,;:?()\[\]{}\"'“”‘’«»*…]+"
    raw = pages.where("text is not null").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("form")).groupBy("form").agg(F.count(F.lit(1)).alias("n"))
    return raw.select(F.regexp_replace(F.regexp_replace("form", "^" + marks, ""), marks + "$", "").alias("word"), "n").where(F.col("word").rlike("[a-z]")).groupBy("word").agg(F.sum("n").alias("n"))


_NUM = r"[0-9lIiOoSB|]{1,5}"
_PAGE_NO = re.compile(rf"^(?:(?:p[a@].{{1,2}}[ec]|p\.?|pp\.?|seite|s\.)\s*{_NUM}(?:\s*(?:of|/)\s*{_NUM})?|[-–—]\s*{_NUM}\s*[-–—]|\[\s*{_NUM}\s*\]|{_NUM}\s*/\s*{_NUM}|\(\s*{_NUM}\s*\)|{_NUM})$", re.I)
_ROMAN = re.compile(r"^(?:[-\[(]\s*)?(?=[ivxl])x{0,3}(?:ix|iv|v?i{0,3})(?:\s*[-\])])?$", re.I)


class Lexicon:
    """Counts, skeletons and vectors of the frequent words. `beyond` is the count of words that the lexicon doesn't hold. rest: where the table of the further words is, if there are any."""

    def __init__(self, counts: dict[str, int], vectors: tuple[np.ndarray, np.ndarray] | None = None, vocab: dict[str, int] | None = None, beyond: int = 1, rest: str | None = None):
        self.rest = rest
        self.give([], [])
        self.counts, self.vocab, self.beyond = counts, vocab or {}, max(1, beyond)
        self.x, self.y = vectors if vectors else (np.zeros((0, 1), np.float32),) * 2
        self.by: dict[str, list[str]] = {}
        for w in counts:
            if is_right(w):
                self.by.setdefault(skeleton(w), []).append(w)
        self.cache: dict[str, list[str]] = {}

    def give(self, keys: list[str], rows: list[dict]) -> None:
        """What the table of further words holds under these keys (words, and skeletons after a line end), for one page; `asked` gathers what else the page needs."""
        self.keys, self.asked = set(keys), set()
        self.more = {r["word"]: r["n"] for r in rows}
        self.more_by: dict[str, list[str]] = {}
        for w in self.more:
            if is_right(w):
                self.more_by.setdefault(skeleton(w), []).append(w)
        self.more_x = {r["word"]: r["x"] for r in rows if r["x"] is not None}
        own = {r["word"]: r["y"] for r in rows if r["y"] is not None}
        self.more_at, self.more_y = {w: i for i, w in enumerate(own)}, list(own.values())

    def _beyond(self, w: str) -> bool:
        """Whether the word may be one of the table's; it's asked for unless it was given."""
        if self.rest is None or w in self.counts:
            return False
        self.asked.update({w, "\n" + skeleton(w)} - self.keys)
        return True

    def count(self, w: str) -> int:
        return self.more.get(w, 0) if self._beyond(w) else self.counts.get(w, 0)

    def place(self, w: str) -> int:
        """The word's number among the vectors of surrounding words, -1 if it has none."""
        return self.vocab.get(w, -1) if not self._beyond(w) else len(self.y) + self.more_at[w] if w in self.more_at else -1

    def own(self, token: str) -> int:
        return max(1, self.count(token) or self.beyond)

    def candidates(self, token: str) -> list[str]:
        """Known words with the token's skeleton that occur at least RATIO times as often and aren't rare against one another."""
        wide = self._beyond(token)
        c = None if wide else self.cache.get(token)
        if c is None:
            own, s = self.own(token), skeleton(token)
            n = {w: self.counts[w] for w in self.by.get(s, ())} | ({w: self.more[w] for w in self.more_by.get(s, ())} if wide else {})
            c = [w for w in n if w != token and n[w] >= RATIO * own]
            most = max((n[w] for w in c), default=0)
            c = [w for w in c if n[w] * RATIO > most]  # a misreading that recurs is no right form
            if wide:
                return c
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[token] = c
        return c

    def fit(self, word: str, around: list[int]) -> float:
        """Mean pointwise mutual information of the word with the words around by its vectors, within CONTEXT; 0 for words without a vector."""
        i = self.vocab.get(word)
        own = self.x[i] if i is not None else self.more_x.get(word)
        if own is None or not around:
            return 0.0
        y = self.y[around] if max(around) < len(self.y) else np.array([self.y[j] if j < len(self.y) else self.more_y[j - len(self.y)] for j in around])
        return float(np.clip((y @ own).mean() + np.log(skipgram.NEGATIVE), -CONTEXT, CONTEXT))

    def right(self, token: str, around: list[int]) -> str | None:
        """The right form of a misread token, or null if it stands."""
        for form in dict.fromkeys((token, token.strip("!†@|$"))):
            c = self.candidates(form) if len(form) >= 3 else []
            if c:
                score, win = max((float(np.log(self.count(w) / self.own(form))) + self.fit(w, around), w) for w in c)
                return win if score >= np.log(RATIO) else None
        return None


def is_page_no(s: str) -> bool:
    s = s.strip()
    if _ROMAN.match(s):
        return True
    if not _PAGE_NO.match(s):
        return False
    core = re.sub(r"^p[a@].{1,2}[ec]|of", "", s, flags=re.I)
    return bool(re.search(r"[0-9]", core)) or bool(re.fullmatch(r"[\[\](\-–—\s]*[lI|O]{1,4}[\])\-–—\s]*", core)) or bool(re.fullmatch(r"\s*[lI|O]{1,3}\s*(?:/\s*[lI|O]{1,3})?\s*", core))


def _alnum(s: str) -> str:
    return re.sub(r"[^a-z0-9@!|$†]", "", s.lower())


def surname_of(authors: str | None) -> str:
    first = re.split(r"[;]|,(?!\s*[A-Z]\.)|\band\b|&", authors or "")[0].strip()
    parts = [x for x in re.split(r"[\s,]+", first) if len(x.strip(".")) > 1]
    return parts[-1].strip(".") if parts else ""


class Headers:
    """Decides whether a part of a line names the paper."""

    def __init__(self, title: str | None, authors: str | None):
        self.title = skeleton(_alnum(title or ""))
        name = surname_of(authors)
        self.author = skeleton(_alnum(name)) if len(name) >= 3 else ""

    def names(self, part: str, edge: bool) -> bool:
        raw = re.sub(r"\s+", " ", part.strip())
        if not raw:
            return False
        s = skeleton(_alnum(raw))
        m = re.match(r"(.{3,40}?)\s+[eco][t†]\s+[a@][l1iI!|]\.?(?:\s*:\s*(.*))?$", raw, re.I)
        if m and len(m[1].split()) <= 4:
            rest = skeleton(_alnum(m[2] or ""))
            if self.author and skeleton(_alnum(m[1])).endswith(self.author) or len(rest) >= 8 and self.title.startswith(rest) or edge and re.match(r"[A-Z]\.", raw):
                return True
        if self.author and edge and s == self.author:
            return True
        many = len(raw.split()) >= (2 if edge else 3)
        return many and len(s) >= 8 and self.title.startswith(s) and (s != self.title or not raw.endswith(".") or edge)


def outside(lines: list[str]) -> set[int]:
    """Places of the lines at a page's ends: MARGIN lines on either side, and all beyond them before the first or after the last line of running text.

    A page without running text has its margins only."""
    full = [k for k, x in enumerate(lines) if x.strip()]
    run = [k for k in full if len(_LOWER.findall(lines[k])) >= 6]
    ends = {*full[:MARGIN], *full[-MARGIN:]}
    return ends | {k for k in full if k < run[0] or k > run[-1]} if run else ends


def parts_of(line: str) -> list[str]:
    return [p for p in re.split(r"\s{3,}|\t+|\s+\|\s+", line.strip()) if p.strip()]


def repair(text: str, title: str | None, authors: str | None, often: set[int] | None, lex: Lexicon, line_keys: list[int] | None = None) -> tuple[str, list[tuple[str, str]]]:
    """The clean text and its cases (kind, word). often: keys of the source's repeated lines, line_keys: keys of this page's lines."""
    lines = text.split("\n")
    head = Headers(title, authors)
    cases: list[tuple[str, str]] = []
    body: list[str | None] = []  # None ends a paragraph
    known = [bool(often) and line_keys is not None and line_keys[k] in often for k in range(len(lines))]
    ends = outside(["" if f else x for f, x in zip(known, lines)]) | outside(lines)
    for k, raw in enumerate(lines):
        line = raw.strip()
        if not line:
            if body and body[-1] is not None:
                body.append(None)
            continue
        if known[k]:
            continue
        edge = k in ends
        parts = parts_of(raw)
        marks = ["page_no" if edge and is_page_no(p) else "header" if head.names(p, edge) else "" for p in parts]
        if any(marks):
            cases.extend((m, "") for m in dict.fromkeys(marks) if m)
            rest = [p for p, m in zip(parts, marks) if not m]
            if rest:
                body.append(" ".join(rest))
            continue
        body.append(raw.rstrip("\r"))
    paragraphs: list[str] = []
    out: list[str] = []
    cut: list[tuple[str, str]] = []
    carry: str | None = None
    flat = [x for x in body]
    for i, line in enumerate(flat):
        if line is None:
            if carry is not None:
                out.append(carry)
                carry = None
            if out:
                paragraphs.append(" ".join(out))
                out = []
            continue
        toks = line.split()
        if carry is not None and toks:
            toks[0], joined = _join(carry, toks[0], lex)
            if joined:
                cut.append((joined, toks[0]))
            carry = None
        nxt = flat[i + 1] if i + 1 < len(flat) else None
        if toks and len(toks[-1]) > 1 and toks[-1][-1] in HYPHENS and toks[-1][-2].isalnum() and nxt is not None:
            carry = toks.pop()
        out.extend(toks)
    if carry is not None:
        out.append(carry)
    if out:
        paragraphs.append(" ".join(out))
    clean: list[str] = []
    cut_words = {w for w, _ in cut}
    for p in paragraphs:
        toks = p.split()
        low = [t.lower().strip(_STRIP) for t in toks]
        ids = [lex.place(t) for t in low]
        for i, t in enumerate(low):
            if len(t) < 3 or t in cut_words:
                continue
            if not re.search(r"[a-z]", t) or re.search(r"[\[\]{}/\\^=<>#%&+_~:.]", t):
                continue
            around = [j for j in ids[max(0, i - skipgram.SPAN) : i] + ids[i + 1 : i + 1 + skipgram.SPAN] if j >= 0]
            r = lex.right(t, around)
            if r:
                cases.append(("misread", r))
                toks[i] = _replace(toks[i], t, r)
        clean.append(" ".join(toks))
    for w, shown in cut:
        cases.append(("hyphen", lex.right(w, []) or w))
    return "\n\n".join(clean), list(dict.fromkeys(cases))


def _replace(shown: str, low: str, right: str) -> str:
    at = shown.lower().find(low)
    core = shown[at : at + len(low)] if at >= 0 else shown
    new = right.upper() if core.isupper() and len(core) > 1 else right.capitalize() if core[:1].isupper() else right
    return shown[:at] + new + shown[at + len(low) :] if at >= 0 else new


def _join(left: str, right: str, lex: Lexicon) -> tuple[str, str | None]:
    """The joined token, and the whole word in lower case if it's one cut word (without a hyphen of its own)."""
    hy = left[-1]
    a, b = left[:-1].lower().lstrip(_STRIP), right.lower()
    b = b.rstrip(_STRIP)
    whole, compound = a + b, f"{a}-{b}"
    n_whole = max([lex.count(whole), *[lex.count(w) for w in lex.candidates(whole)]])
    n_comp = max([lex.count(compound), *[lex.count(w) for w in lex.candidates(compound)]])
    if n_whole == 0 and n_comp == 0 and hy == "-":
        known = lex.count(a) >= MIN_COUNT and lex.count(b) >= MIN_COUNT
        n_comp = 1 if known else 0
    if n_comp > n_whole or not re.match(r"[a-z0-9@!|$†]", b):
        return left + right, None
    own = "-" in whole or not re.fullmatch(r"[^\W\d_]+(?:[^\W_@!|$†]|[@!|$†\d])*", whole)
    return left[:-1] + right, None if own else whole


def frequent_keys(keyed: DataFrame) -> DataFrame:
    """source, often: keys of the lines that return in the source's files, by skeleton so that misread copies count too. keyed: source, pdf_id, line_keys."""
    lines = keyed.select("source", "pdf_id", F.explode("line_keys").alias("h")).where("h <> 0").distinct()
    totals = keyed.select("source", "pdf_id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    n = lines.groupBy("source", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_DOCS)
    return n.join(totals, "source").where(F.col("n") >= MIN_SHARE * F.col("total")).groupBy("source").agg(F.collect_set("h").alias("often"))


def learn(pages: DataFrame) -> Lexicon:
    """Lexicon and vectors from all pages. LEXICON words reach the driver; the further ones are written to a table."""
    known = through_table(word_counts(pages).where(F.col("n") >= 2), "words")
    top = known.orderBy(F.desc("n"), "word").limit(LEXICON)
    counts = {w: n for w, n in top.toPandas().itertuples(index=False)}
    alone = Lexicon(counts)
    vocab = {w: i for i, w in enumerate([w for w in counts if _RIGHT.fullmatch(w) and not alone.candidates(w)])}
    core = {w: i for w, i in vocab.items() if i < skipgram.VECTORS}
    x, y, row = np.zeros((0, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32)
    if vocab:
        pairs = skipgram.pair_counts(pages, "text", vocab, words, len(core))
        if len(vocab) > len(core):
            pairs = through_table(pairs, "pairs")
        own = pairs.where(F.greatest("a", "b") < len(core)).toPandas()
        x, y = skipgram.fit(own, len(core))
        row = np.bincount(own["a"], own["n"], len(core)).astype(np.float32) + np.bincount(own["b"], own["n"], len(core)).astype(np.float32)
        if len(vocab) > len(core):
            name = list(vocab)
            outer = pairs.where(F.greatest("a", "b") >= len(core)).groupBy(F.greatest("a", "b").cast("string").alias("word"), F.least("a", "b").alias("j")).agg(F.sum("n").alias("n"))
            got = skipgram.folded(outer, len(vocab) - len(core), x, y, row).toPandas()
            got = got.assign(word=[name[int(i)] for i in got["word"]]).sort_values("word")
            vocab = core | {w: len(core) + i for i, w in enumerate(got["word"])}  # a word that never stands near one of the core has no context to be judged by
            x, y = (np.vstack([v, *got[c]]).astype(np.float32) for v, c in ((x, "x"), (y, "y")))
    rest = None
    if len(counts) == LEXICON and (last := list(counts.items())[-1]) and not (far := known.where((F.col("n") < last[1]) | (F.col("n") == last[1]) & (F.col("word") > last[0]))).isEmpty():
        rest = _further(pages, known, far, core, x[: len(core)], y[: len(core)], row)
    return Lexicon(counts, (x, y) if vocab else None, vocab, rest=rest)


def _further(pages: DataFrame, known: DataFrame, far: DataFrame, core: dict[str, int], x: np.ndarray, y: np.ndarray, row: np.ndarray) -> str:
    """Folder of the table of words beyond the lexicon: key (the word, or its skeleton after a line end if it may be a right form), word, n, x, y."""
    skel = F.pandas_udf(lambda c: c.map(skeleton), "string")
    right = F.pandas_udf(lambda c: c.map(is_right), "boolean")
    best = known.where(right("word")).groupBy(skel("word").alias("skel")).agg(F.max("n").alias("best"))
    far = far.withColumn("skel", skel("word")).join(best, "skel", "left")
    if core:
        plain = far.where(F.coalesce("best", F.lit(0)) < RATIO * F.col("n")).select("word")
        outer = skipgram.outer_pairs(pages, "text", core, words, lambda w: bool(_RIGHT.fullmatch(w))).join(plain, "word", "left_semi")
        far = far.join(skipgram.folded(outer, plain.count(), x, y, row), "word", "left")
    else:
        far = far.withColumn("x", F.lit(None).cast("array<float>")).withColumn("y", F.col("x"))
    keys = F.when(right("word"), F.array("word", F.concat(F.lit("\n"), "skel"))).otherwise(F.array("word"))
    place = scratch(pages.sparkSession, "further")
    through_table(far.select(F.explode(keys).alias("key"), "word", "n", "x", "y"), "further", place)
    return place


_FURTHER = "struct<word:string,n:bigint,x:array<float>,y:array<float>>"


def _given(todo: DataFrame, lexicon) -> DataFrame:
    """todo with `keys` and `further`: what the repair of each page asks of the words beyond the lexicon. A joined word may ask for more, so pages ask until none does."""
    path = lexicon().rest
    base = todo.withColumn("keys", F.array().cast("array<string>")).withColumn("further", F.array().cast(f"array<{_FURTHER}>"))
    if path is None:
        return base
    table = todo.sparkSession.read.schema("key string, word string, n bigint, x array<float>, y array<float>").parquet(path)

    def ask(batches):
        lx = lexicon()
        for b in batches:
            out = []
            for page, t, title, authors, k, o, keys, rows in zip(*(b[c] for c in ("page_id", "text", "title", "authors", "line_keys", "often", "keys", "further"))):
                if t is not None:
                    lx.give(list(keys), list(rows))
                    repair(t, title, authors, set(o) if o is not None else None, lx, list(k))
                    out.extend((page, key) for key in sorted(lx.asked))
            yield pd.DataFrame(out, columns=["page_id", "key"])

    asked, now = None, base
    while True:
        more = through_table(now.mapInPandas(ask, "page_id string, key string").distinct(), "asked")
        if more.isEmpty():
            return now
        asked = more if asked is None else asked.unionByName(more)
        keys = asked.groupBy("page_id").agg(F.collect_set("key").alias("keys"))
        rows = asked.join(table, "key").groupBy("page_id").agg(F.collect_set(F.struct("word", "n", "x", "y")).alias("further"))
        none = F.array()
        now = todo.join(keys, "page_id", "left").join(rows, "page_id", "left").withColumn("keys", F.coalesce("keys", none.cast("array<string>"))).withColumn("further", F.coalesce("further", none.cast(f"array<{_FURTHER}>")))


def repaired(pages: DataFrame, files: DataFrame, papers: DataFrame, fresh: bool = True) -> DataFrame:
    """page_id, text (clean), cases: array of (kind, word), for pages of files that need it (ocr_needed true or null).

    Lines are keyed once for all pages and written with the texts to be repaired; the lines that return and the repair both read that table."""
    texts = pages.select("text")
    lex = fitted("scans", [texts], lambda: learn(spread(texts)), fresh=fresh)
    sourced = with_source(pages.select("page_id", "pdf_id", "paper_id", "text"), papers.select("paper_id", "publisher", "journal"))
    ocr = files.where(F.coalesce("ocr_needed", F.lit(True))).select("pdf_id").distinct().withColumn("__ocr", F.lit(True))
    keys = F.transform(F.transform(F.split("text", "\n"), line_skeleton), lambda s: F.when(F.length(s) >= MIN_LINE_SKELETON, F.xxhash64(s)).otherwise(0))  # 0, not null: nulls would turn the keys into floats in pandas
    todo = sourced.join(ocr, "pdf_id", "left").join(papers.select("paper_id", "title", "authors").dropDuplicates(["paper_id"]), "paper_id", "left")
    todo = through_table(todo.select("page_id", "pdf_id", "source", "title", "authors", F.coalesce("__ocr", F.lit(False)).alias("ocr"), F.when(F.col("__ocr"), F.col("text")).alias("text"), keys.alias("line_keys")), "lines")
    often = through_table(frequent_keys(todo.select("source", "pdf_id", "line_keys")), "often")  # counted before it is broadcast, so made once
    todo = todo.where("ocr").join(broadcast_if_small(often, F.size("often") * 16 + 64), "source", "left")
    todo = todo.select("page_id", "title", "authors", "text", "line_keys", F.array_intersect("line_keys", "often").alias("often"))
    counts, vocab, x, y, rest = lex.counts, lex.vocab, lex.x, lex.y, lex.rest

    def lexicon() -> Lexicon:
        return Lexicon(counts, (x, y), vocab, rest=rest)

    def run(batches):
        lx = lexicon()
        for b in batches:
            out, cases = [], []
            for t, title, authors, k, o, keys, rows in zip(*(b[c] for c in ("text", "title", "authors", "line_keys", "often", "keys", "further"))):
                if t is None:
                    out.append(None)
                    cases.append([])
                    continue
                if rest:
                    lx.give(list(keys), list(rows))
                c, got = repair(t, title, authors, set(o) if o is not None else None, lx, list(k))
                out.append(c)
                cases.append([{"kind": kind, "word": w} for kind, w in got])
            yield pd.DataFrame({"page_id": b["page_id"].to_numpy(), "text": out, "cases": cases})

    return spread(_given(todo, lexicon), pages).mapInPandas(run, "page_id string, text string, cases array<struct<kind:string,word:string>>")


def found(pages: DataFrame, files: DataFrame, papers: DataFrame) -> DataFrame:
    r = repaired(pages, files, papers).select("page_id", F.explode("cases").alias("c"))
    return r.select("page_id", "c.kind", "c.word").distinct()
