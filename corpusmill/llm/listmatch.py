"""Mapping free-entered values to a canonical list.

A BK-tree holds every accepted spelling of every entry under the Levenshtein distance, a true metric, so that the triangle inequality
prunes subtrees and the search returns every spelling within the threshold. Spellings come from the reference list by rule (names,
formulas written the other way round, dopant phrases, percentages). A value is first stripped of decorations (thickness, "thin
film", remarks); numbers in value and spelling must agree; ties go to the row's family, then to the likelier typing error, then to the smaller id.

The tree is shipped to the tasks only while its spellings stay under SHARD_SPELLINGS (counted before anything is collected); then values are answered where they are, with a
cache per task process, so that no value is shuffled, however often it occurs. A larger list is divided into shards of entries: each distinct value
is answered by every shard, one tree to a task, and the winners merge by their whole rank (distance, family, typing error, identifier). What depends on the whole list (a canonical name
as it stands, the entry that a family names, whether any entry is near) is decided once, so that the answer is the same however the list is divided.

Defined cases: null and blank values have no result; a value equal to a canonical name needs no mapping (reported with that id in `mapped`, left out of
`found`); a value that fits no entry gets 0; values may have any length; a canonical name that several entries share stands for the largest identifier.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import through_table

SHARD_SPELLINGS = 100_000
#: Spellings that the rules give an entry, about.
PER_ENTRY = 40
#: Distinct values that one task of a shard answers at a time.
VALUE_BLOCKS = 8

# Elements that occur as dopants, with their names.
ELEMENTS = {"si": "silicon", "al": "aluminum", "la": "lanthanum", "y": "yttrium", "gd": "gadolinium", "sr": "strontium", "ce": "cerium", "sc": "scandium", "mg": "magnesium", "ge": "germanium", "ti": "titanium", "n": "nitrogen", "yb": "ytterbium", "nd": "neodymium", "ta": "tantalum", "lu": "lutetium", "er": "erbium", "zr": "zirconium", "hf": "hafnium"}
BASES = ("hfo2", "hafnia", "hafnium oxide", "hafnium dioxide", "hfox")
OPEN = tuple(f"doped {b}" for b in BASES)


def levenshtein(a: str, b: str) -> int:
    """Bit-parallel Levenshtein distance."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | (1 << i)
    mask, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    pv, mv, score = mask, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph = ((ph << 1) | 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
    return score


class BKTree:
    """Spellings under a metric; search returns all within the threshold."""

    def __init__(self, spellings: list[str]):
        self.root: list | None = None
        for s in spellings:
            self.add(s)

    def add(self, s: str) -> None:
        if self.root is None:
            self.root = [s, {}]
            return
        node = self.root
        while True:
            d = levenshtein(s, node[0])
            if d == 0:
                return
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = [s, {}]
                return
            node = nxt

    def within(self, q: str, r: int) -> list[tuple[int, str]]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            s, kids = stack.pop()
            d = levenshtein(q, s)
            if d <= r:
                out.append((d, s))
            stack.extend(k for e, k in kids.items() if d - r <= e <= d + r)
        return sorted(out)


def fold(s: str) -> str:
    """Compatibility form, lower case, plain minus signs and single blanks."""
    s = unicodedata.normalize("NFKC", s).lower().replace("−", "-").replace("–", "-").replace("‐", "-")
    return re.sub(r"\s+", " ", s).strip()


_DECOR = (
    (r"\((?:this|present) (?:work|study)\)|\[\d+\]", " "),
    (r"^[~≈]?\d+(?:[.,]\d+)?\s*nm[ -](?:thick )?", ""),
    (r"\b(?:ultra)?(?:thin[ -])?(?:films?|layers?)\b", " "),
    (r"^\d+(?:[.,]\d+)?\s*(?:mol|at|wt)?\.?\s*%\s*(?=[a-z]{1,2}\s*[:-])", ""),
    (r"^(?:undoped|pure|pristine|stoichiometric)\s+", ""),
    (r"\((\d+(?:\.\d+)?)\s*(?:mol|at)?\.?\s*%\s*(?!zr)([a-z]{1,2})\)$", r"(\2)"),
    (r"\bnl$", "nanolaminate"),
    (r"\bsl$", "superlattice"),
)


def strip_value(s: str) -> str:
    """The value without decorations, numbers in one form."""
    s = fold(s)
    for rx, to in _DECOR:
        s = re.sub(rx, to, s).strip()
    s = re.sub(r"(\d),(\d)", r"\1.\2", s)
    s = re.sub(r"(?<![\d.])\.(\d)", r"0.\1", s)
    s = re.sub(r"(\d+\.\d*?[1-9])0+(?!\d)", r"\1", s)
    s = re.sub(r"[-_]", " ", s) if re.search(r"[a-z]{5}", s) and not re.search(r"1 ?- ?x", s) else s
    return re.sub(r"\s+", " ", s).strip(" .,;*").strip()


def key(s: str) -> str:
    """What the tree holds: the stripped value without blanks and marks, but for dots in numbers and slashes."""
    return re.sub(r"[^a-z0-9./%]+", "", s)


def _percent(x: float) -> str:
    return f"{x:g}"


def spellings(entries: list[tuple[int, str, str | None, str | None]]) -> dict[str, list[int]]:
    """key -> entry ids, for every spelling that the rules give."""
    out: dict[str, list[int]] = {}

    def add(entry: int, *forms: str | None) -> None:
        for f in forms:
            if f and (k := key(strip_value(f))):
                ids = out.setdefault(k, [])
                if entry not in ids:
                    ids.append(entry)

    for entry, canon, short, long in entries:
        add(entry, canon, short, long)
        c = fold(canon)
        if m := re.fullmatch(r"([a-z]{1,2}):hfo2", c):
            el = m[1]
            names = [ELEMENTS.get(el, el)] + (["aluminium"] if el == "al" else [])
            add(entry, f"hfo2:{el}", f"{el}-hfo2", f"hf{el}o", f"{el}:hfox", f"hf{el}ox", f"hfo2 ({el})", f"{el}-hfox")
            for b in BASES:
                add(entry, f"{el}-doped {b}", *[f"{n}-doped {b}" for n in names], *[f"{b} doped with {n}" for n in names], f"{b} doped with {el}", f"{el}:{b}")
        elif c in ("hfo2", "zro2"):
            metal = "hafnium" if c == "hfo2" else "zirconium"
            add(entry, f"{metal} dioxide", f"{metal}(iv) oxide", f"{c[:2]}ox")
        elif c == "hf1-xzrxo2":
            add(entry, "(hf,zr)o2", "hfzrox", "hfzro", "hfzro2", "hfzro4", "hf(1-x)zr(x)o2", "zrxhf1-xo2", "zirconium hafnium oxide", "hafnium zirconate", "hafnia zirconia")
            for b in BASES:
                add(entry, f"zr-doped {b}", f"zirconium-doped {b}", f"{b} doped with zirconium", f"zr:{b}")
        elif m := re.fullmatch(r"hf(0?\.\d+)zr(0?\.\d+)o2", c):
            h, z = float(m[1]), float(m[2])
            ph, pz = _percent(h * 100), _percent(z * 100)
            add(entry, f"zr{z:g}hf{h:g}o2", f"(hf{h:g},zr{z:g})o2", f"(zr{z:g},hf{h:g})o2", f"hzo {ph}:{pz} (hf:zr)", f"hzo {pz}:{ph} (zr:hf)", f"hzo ({pz} % zr)", f"hzo with {pz} % zr", f"hzo {pz} % zr", f"hzo ({pz} % zirconium)", f"hafnium zirconium oxide, {pz} % zirconium", f"hafnium zirconium oxide ({pz} % zr)")
        elif m := re.fullmatch(r"([a-z0-9]+)/([a-z0-9]+) (superlattice|nanolaminate)", c):
            add(entry, f"{m[1]}-{m[2]} {m[3]}", f"{m[1]}/{m[2]} {m[3][:1]}l", f"{m[2]}/{m[1]} {m[3]}", f"{m[1]}/{m[2]}")
        elif m := re.fullmatch(r"p\((.+)\)", c):
            add(entry, f"p{m[1]}")
    return out


def _digits(s: str) -> list[str]:
    return re.findall(r"\d+(?:\.\d+)?", s)


def _typo(q: str, s: str) -> int:
    """0 for what typing produces by itself (a letter left out, doubled, swapped with its neighbour), 1 for any other change."""
    if len(q) == len(s) - 1 and any(s[:i] + s[i + 1 :] == q for i in range(len(s))):
        return 0
    if len(q) == len(s) + 1 and any(q[:i] + q[i + 1 :] == s and q[i] in (q[i - 1 : i], q[i + 1 : i + 2]) for i in range(len(q))):
        return 0
    if len(q) == len(s) and any(q[:i] + q[i + 1] + q[i] + q[i + 2 :] == s for i in range(len(q) - 1)):
        return 0
    return 1


def _threshold(k: str) -> int:
    """Formulas must agree; names may differ by up to two edits, short ones only by a swap or one edit."""
    return 2 if len(re.sub(r"[^a-z]", "", k)) >= 6 and re.search(r"[a-z]{6}", k) else 0


def family_key(family: str | None) -> str:
    return key(re.sub(r"\s+family$", "", fold(family or "")))


def dopant_key(family: str | None) -> str | None:
    """The spelling of the doped base that a family names by a dopant; null if it names none."""
    m = re.fullmatch(r"([a-z]{1,2}|[a-z]{5,})[ :_-]*(?:doped)?[ :_-]*(?:hfo2|hafnia|hafnium oxide)?", re.sub(r"\s+family$", "", fold(family or "")))
    return key(strip_value(f"{m[1]}-doped hfo2")) if m else None


def _near(tree: BKTree, k: str) -> list[tuple[int, str]]:
    found = tree.within(k, _threshold(k))
    found = [(d, w) for d, w in found if _digits(w) == _digits(k) and (d < 2 or len(k) >= 10 or _typo(k, w) == 0)]
    return [(1 if d == 2 and _typo(k, w) == 0 else d, w) for d, w in found]  # a swap is one slip


_OPEN_KEYS = {key(strip_value(o)) for o in OPEN}
_OPEN_TREE = BKTree(sorted(_OPEN_KEYS))


class Tree:
    """The spellings of some entries (id, canonical, short, long, family) and their best answer to a value."""

    def __init__(self, entries: list[tuple[int, str, str | None, str | None, str | None]]):
        self.spell = spellings([e[:4] for e in entries])
        self.tree = BKTree(sorted(self.spell))
        self.family = {e[0]: key(fold(e[4] or "")) for e in entries}

    def best(self, k: str, own: str) -> tuple[int, bool, int, int] | None:
        """Rank of the nearest entry: distance, whether its family differs, typing error, identifier; null if none is near."""
        return min(((d, self.family[e] != own, _typo(k, w), e) for d, w in _near(self.tree, k) for e in self.spell[w]), default=None)


def decide(k: str, best: tuple | None, canonical: int | None, of_family: int) -> tuple[int, int]:
    """(entry or 0, distance) from what the whole list says: the nearest entry, the entry of that very name, the entry that the family names."""
    if canonical is not None:
        return canonical, 0
    if not k:
        return 0, 99
    if k in _OPEN_KEYS or (best is None and _threshold(k) and _near(_OPEN_TREE, k)):
        return of_family, 0
    return (best[3], best[0]) if best else (0, 99)


class Matcher:
    """Answers from the whole list in one tree."""

    def __init__(self, entries: list[tuple[int, str, str | None, str | None, str | None]]):
        self.tree = Tree(entries)
        self.canon: dict[str, int] = {}
        self.by_family: dict[str, list[int]] = {}
        for e in entries:
            self.canon[e[1]] = max(e[0], self.canon.get(e[1], e[0]))
            self.by_family.setdefault(key(fold(e[4] or "")), []).append(e[0])
        self.cache: dict[tuple[str, str | None], tuple[int, int]] = {}

    def of_family(self, family: str | None) -> int:
        """The one entry that a family names: by its name, or by a dopant it names; 0 if it names none or several."""
        ids = self.by_family.get(family_key(family), [])
        if not ids and (k := dopant_key(family)):
            ids = self.tree.spell.get(k, [])
        return ids[0] if len(ids) == 1 else 0

    def match(self, value: str | None, family: str | None) -> tuple[int, int]:
        at = (value or "", family)
        got = self.cache.get(at)
        if got is None:
            k = key(strip_value(at[0]))
            got = decide(k, self.tree.best(k, family_key(family)) if k else None, self.canon.get(at[0]), self.of_family(family))
            if len(self.cache) > 200_000:
                self.cache.clear()
            if len(at[0]) <= 1_000:
                self.cache[at] = got
        return got


_ENTRY = ("material_id", "canonical_name", "short_name", "long_name", "material_family")


def _in_one_tree(rows: DataFrame, entries: list[tuple]) -> DataFrame:
    @F.pandas_udf("material_id int, distance int")
    def answer(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = Matcher(entries)
        for values, families in batches:
            yield pd.DataFrame([m.match(v, f) for v, f in zip(values, families)], columns=["material_id", "distance"])

    return rows.withColumn("__b", answer("material", "material_family")).select("fact_id", "material", "material_family", "__b.material_id", "__b.distance")


def _spelled(batches):
    for b in batches:
        rows = [(k, e[0]) for e in b[list(_ENTRY)].itertuples(index=False) for k in spellings([tuple(None if x != x else x for x in e[:4])])]
        yield pd.DataFrame(rows, columns=["k", "id"])


def _by_shards(rows: DataFrame, reference: DataFrame, shards: int) -> DataFrame:
    """The same answers with one tree a shard and task; distinct values only are answered, and joined back."""
    ref = reference.select(*_ENTRY)
    values = through_table(rows.groupBy("material", "material_family").agg(F.count(F.lit(1)).alias("n")).drop("n"), "values")

    @F.pandas_udf("k string, own string, dopant string")
    def keys(material: pd.Series, family: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(key(strip_value(m)), family_key(f), dopant_key(f)) for m, f in zip(material, family)], columns=["k", "own", "dopant"])

    values = through_table(values.withColumn("v", keys("material", "material_family")).select("material", "material_family", "v.*"), "keyed")
    asked = values.select("k", "own").distinct().withColumn("block", F.pmod(F.xxhash64("k", "own"), F.lit(VALUE_BLOCKS)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    held = ref.withColumn("shard", F.pmod(F.xxhash64("material_id"), F.lit(shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(VALUE_BLOCKS - 1))))

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tree = Tree([tuple(None if x is None or x != x else x for x in e) for e in right[list(_ENTRY)].itertuples(index=False)])
        got = [(k, own, tree.best(k, own)) for k, own in zip(left["k"], left["own"])]
        return pd.DataFrame([(k, own, b[0], int(b[1]), b[2], int(b[3])) for k, own, b in got if b], columns=["k", "own", "d", "other", "typo", "id"])

    by = ["shard", "block"]
    won = asked.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(answer, "k string, own string, d int, other int, typo int, id int")
    best = won.groupBy("k", "own").agg(F.min(F.struct("d", "other", "typo", "id")).alias("best"))
    canon = ref.groupBy(F.col("canonical_name").alias("material")).agg(F.max("material_id").alias("canonical"))

    @F.pandas_udf("string")
    def family_of(family: pd.Series) -> pd.Series:
        return family.map(lambda f: key(fold(f or "")))

    one = lambda n, i: F.when(n == 1, i).when(n > 1, 0)
    families = ref.groupBy(family_of(F.coalesce("material_family", F.lit(""))).alias("own")).agg(F.count(F.lit(1)).alias("n"), F.min("material_id").alias("i")).select("own", one(F.col("n"), F.col("i")).alias("by_name"))
    doped = ref.mapInPandas(_spelled, "k string, id int").distinct().groupBy(F.col("k").alias("dopant")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("i")).select("dopant", one(F.col("n"), F.col("i")).alias("by_dopant"))
    j = values.join(best, ["k", "own"], "left").join(canon, "material", "left").join(families, "own", "left").join(doped, "dopant", "left")

    @F.pandas_udf("material_id int, distance int")
    def settle(k: pd.Series, d: pd.Series, i: pd.Series, canonical: pd.Series, family: pd.Series) -> pd.DataFrame:
        none = lambda x: None if x is None or x != x else int(x)
        return pd.DataFrame([decide(a, None if none(x) is None else (int(x), False, 0, int(y)), none(c), int(f)) for a, x, y, c, f in zip(k, d, i, canonical, family)], columns=["material_id", "distance"])

    done = through_table(j.withColumn("__b", settle("k", "best.d", "best.id", "canonical", F.coalesce("by_name", "by_dopant", F.lit(0)))).select("material", "material_family", "__b.material_id", "__b.distance"), "answers")
    on = rows["material"].eqNullSafe(done["material"]) & rows["material_family"].eqNullSafe(done["material_family"])
    return rows.join(done, on).select(rows["fact_id"], rows["material"], rows["material_family"], "material_id", "distance")


def mapped(facts: DataFrame, reference: DataFrame, most: int = SHARD_SPELLINGS) -> DataFrame:
    """fact_id, material, material_family, material_id (0: fits no entry), distance; rows with a null or blank material left out."""
    rows = facts.select("fact_id", "material", "material_family").where(F.trim("material") != "")
    ref = reference.select(*_ENTRY).where("material_id is not null and canonical_name is not null").dropDuplicates(["material_id"])
    n = ref.count()
    if n * PER_ENTRY <= most:
        return _in_one_tree(rows, [tuple(r) for r in ref.orderBy("material_id").collect()])  # at most SHARD_SPELLINGS / PER_ENTRY rows
    return _by_shards(rows, ref, -(-n * PER_ENTRY // most))


def found(facts: DataFrame, reference: DataFrame) -> DataFrame:
    """fact_id, material_id of values that aren't exactly a canonical name; no repeated rows."""
    names = [r[0] for r in reference.select("canonical_name").where("canonical_name is not null").distinct().limit(1001).collect()]
    if len(names) <= 1000:  # a constant set in the filter; beyond it an anti-join
        rest = facts.where(~F.col("material").isin(names))
    else:
        rest = facts.join(reference.select(F.col("canonical_name").alias("material")).distinct(), "material", "left_anti")
    return mapped(rest, reference).select("fact_id", "material_id").distinct()
