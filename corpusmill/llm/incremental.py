"""Deduplicating new batches against all history, with persisted inverted-file vector cells.

Vectors. A file's page texts are reduced to words (cut words joined, characters that scanners confuse mapped to one string, marks and digits out). Its vector has
PLACES coordinates: the least hash of the WIDE-word shingles that fall to each place. The distance of two vectors is the number of coordinates in which
they differ (Hamming), about PLACES (1 - J) for Jaccard similarity J of their wide shingles. Beside it the file's whole set of five-word shingles is kept.

Cells. The inverted file has one cell for each coordinate value: cell (i, v) lists the vectors whose coordinate i is v. A query probes the cells of its own
coordinates. A vector met in none of the probed cells differs in every one of them, so once t cells are probed it is at least t away: after all PLACES cells no
unseen vector can be nearer than PLACES, and what was met in n cells is exactly PLACES - n away. A match must be within PLACES - AGREE, so it's met in at least AGREE - SKIP cells
even if a query leaves out SKIP of its cells: it leaves out those that list most (of the HOT_CELLS longest that list HOT or more), and nothing is lost. What was met often enough is reranked exactly by the
Jaccard similarity of the five-word sets, read for the candidates only; TESTDATA's repeats differ by scattered edits and scan noise in both copies,
which lowers the similarity of true repeats to 0.4, while different files stay under 0.2, so SIMILARITY stands between and isn't 0.8.

Classes. A file belongs to the class of the least file it was linked to on arrival, and a cell lists each class once, by its first member there. So a group of near copies
that holds a third of all files doesn't make its cells long, and a query is compared with at most PLACES members of a class. If none of these is near enough
although the class agrees in AGREE places, all its members that agree in AGREE places are compared: the exact way for the rest. Within a batch whose cells are long, the first
of each cell is tried before all others, which gives the classes. Files of equal text are linked by a text key and not listed again.

Exact keys (content hash, DOI, text) have one owner each, its first file; new keys are looked up there. Links of all kinds are closed over third files by
connected components; the first file of a work is the smallest by batch and identifier.

The store is a folder: meta.json; cells and keys (bucketed by cell and by key, so that history is never shuffled); files/load=N; vectors/load=N/part=P (a load reads
the parts that hold its candidates); links/load=N; done/load=N. `Store.open` takes up a store in any later session, `ingest` checks and then appends a load (one batch, or
several that waited) and rewrites nothing. A load counts as accepted once done/load=N is written; what a load that was lost half-way left behind is passed over.

Defined cases: files without pages, or of fewer than MIN_WORDS words, are compared by keys only; null or malformed hashes and placeholder
DOIs are no keys; a null batch counts as batch 0; ties in order don't occur, identifiers being unique; a batch that was accepted before is refused, and `works` passes it over.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, drop_folders, scratch, shuffles_removed, spread, through_table

from .canonical import alnum_key
from .components import roots
from .scans import skeleton

PLACES, WIDE, AGREE, SKIP = 64, 14, 6, 3
#: Cells that may be left out: those that list HOT or more, at most HOT_CELLS of them (the longest), which go to the tasks.
HOT, HOT_CELLS = 16, 100_000
SHINGLE = 5
MIN_WORDS = 30
SIMILARITY = 0.27
#: Folders of a batch's shingle sets; pairs of one batch per posting above which the first of each cell is tried first.
PARTS, LONG = 4, 50
_EMPTY = (1 << 31) - 1


def hash_key(c: Column) -> Column:
    """64 hex digits of a SHA-256 however written; null for anything else."""
    k = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s*sha-?256\s*[:=]?\s*", ""), "[^0-9a-f]", "")
    return F.when(F.length(k) == 64, k)


def doi_key(c: Column) -> Column:
    """Letters and digits of a DOI; null for placeholders, which don't begin as a DOI does."""
    k = alnum_key(c)
    return F.when(k.rlike(r"^10\d{4}") & (F.length(k) > 6), k)


_CUT = re.compile(r"[-‐­¬]\s*\n\s*")
_NO_LETTER = re.compile(r"[^a-z]+")


def _word_ids(text: str, cache: dict[str, int]) -> np.ndarray:
    out = []
    for w in _NO_LETTER.split(skeleton(_CUT.sub("", text))):
        if not w:
            continue
        h = cache.get(w)
        if h is None:
            if len(cache) > 500_000:
                cache.clear()
            h = cache[w] = zlib.crc32(w.encode())
        out.append(h)
    return np.array(out, dtype=np.uint64)


def _shingles(ids: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(ids) - width + 1)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            h = (h ^ ids[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def page_signature(text: str, cache: dict[str, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """Least hashes of the wide shingles by place, the set of five-word shingles (32-bit hashes), the number of words."""
    ids = _word_ids(text, cache)
    low = np.full(PLACES, _EMPTY, np.int64)
    wide = _shingles(ids, WIDE)
    np.minimum.at(low, (wide % np.uint64(PLACES)).astype(np.int64), np.minimum((wide >> np.uint64(33)).astype(np.int64), _EMPTY - 1))
    return low.astype(np.int32), np.unique((_shingles(ids, SHINGLE) >> np.uint64(32)).astype(np.uint32)).view(np.int32), len(ids)


_MARKS = ("h1", "l1", "h2", "l2")
_SIGNED = "low array<int>, shingles array<int>, words long, n long, " + ", ".join(f"{m} long" for m in _MARKS)


def _signatures(batches):
    """Pages of a file that stand together are one row: the least of their coordinates, the union of their sets, and sums."""
    cache: dict[str, int] = {}
    for b in (whole.iloc[i : i + 1_000] for whole in batches for i in range(0, len(whole), 1_000)):
        rows: dict[tuple[str, int], list] = {}
        for f, batch, t in zip(b["pdf_id"], b["batch_no"], b["text"]):
            low, own, words = page_signature(t, cache)
            r = rows.setdefault((f, batch), [low, [], 0, 0, np.zeros(4, np.int64)])
            r[0] = np.minimum(r[0], low)
            r[2] += words
            if len(own):
                m = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                r[1].append(own)
                r[3] += 1
                r[4] += np.array([m[0] >> 32, m[0] & 0xFFFFFFFF, m[1] >> 32, m[1] & 0xFFFFFFFF], np.int64)  # halves, whose sums stay in 64 bits
        marks = np.array([r[4] for r in rows.values()], np.int64).reshape(-1, 4)
        sets = [r[1][0] if len(r[1]) == 1 else np.unique(np.concatenate(r[1])) if r[1] else np.zeros(0, np.int32) for r in rows.values()]
        yield pd.DataFrame({"pdf_id": [k[0] for k in rows], "batch_no": [k[1] for k in rows], "low": [r[0] for r in rows.values()], "shingles": sets, "words": [r[2] for r in rows.values()], "n": [r[3] for r in rows.values()], **{m: marks[:, i] for i, m in enumerate(_MARKS)}})


def signatures(files: DataFrame, pages: DataFrame) -> DataFrame:
    """pdf_id, batch_no and _SIGNED: a row or several for each file, made where its pages are read."""
    p = pages.select("pdf_id", "text").where("text is not null").join(files.select("pdf_id", "batch_no"), "pdf_id")
    return spread(p, pages).mapInPandas(_signatures, "pdf_id string, batch_no int, " + _SIGNED)


def file_vectors(signed: DataFrame, key: str = "pdf_id") -> DataFrame:
    """key, vec (PLACES coordinates), text_key (equal for files whose pages have the same shingles): one row for each file of at least MIN_WORDS words."""
    whole = lambda h, l: F.sum(h).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.sum(l).cast("decimal(20,0)")  # noqa: E731, E741
    g = signed.groupBy(key).agg(F.collect_list("low").alias("lows"), F.sum("words").alias("words"), F.sum("n").alias("n"), whole("h1", "l1").alias("m1"), whole("h2", "l2").alias("m2")).where(F.col("words") >= MIN_WORDS)
    vec = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.coalesce(F.array_min(F.transform("lows", lambda x: F.get(x, i))), F.lit(_EMPTY)))
    return g.select(key, vec.alias("vec"), F.when(F.col("n") > 0, F.concat_ws(":", F.col("m1").cast("string"), F.col("m2").cast("string"), F.col("n").cast("string"))).alias("text_key"))


def file_keys(files: DataFrame, papers: DataFrame) -> DataFrame:
    """pdf_id, batch_no, kind, key: the content hash, and the DOI of the file's paper."""
    h = files.select("pdf_id", "batch_no", F.lit("hash").alias("kind"), hash_key(F.col("sha256")).alias("key"))
    d = files.where("paper_id is not null").join(papers.select("paper_id", doi_key(F.col("doi")).alias("key")).where("key is not null"), "paper_id").select("pdf_id", "batch_no", F.lit("doi").alias("kind"), "key")
    return h.unionByName(d).where("key is not null")


def _part(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


#: no: a file's number in the store, in the order of loads and, within a load, in any order. Cells hold numbers, which shuffle in a fifth of the bytes of names.
_FILES = "no long, file string, vec array<int>, class long, load int"
#: A link of near text with the names of its files; root: the class of a if it is of history, else a.
_NEAR = "a long, b long, file_a string, file_b string, root long"


def _postings(files: DataFrame, *more: str) -> DataFrame:
    """cell, no and further columns: a row for each filled coordinate."""
    p = files.select("no", *more, F.posexplode("vec").alias("place", "value")).where(F.col("value") < _EMPTY)
    return p.select((F.col("place").cast("long") * (1 << 31) + F.col("value")).alias("cell"), "no", *more)


class Store:
    """Accepted files: cells of vectors, shingle sets, keys, links. `open` gives a store that may hold batches already."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.name = "ivf_" + hashlib.sha1(self.folder.encode()).hexdigest()[:16]
        self.leftover: list[int] = []
        self.passing: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Store:
        """The store in the folder, a new one if there is none. Its settings were fixed when it was made."""
        folder = folder.rstrip("/")
        mine = {"places": PLACES, "wide": WIDE, "agree": AGREE, "shingle": SHINGLE, "parts": PARTS, "buckets": 2 * spark.sparkContext.defaultParallelism}
        try:
            meta = json.loads(spark.read.text(f"{folder}/meta").first()[0])
        except AnalysisException:
            meta = mine
            spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{folder}/meta")
        if {k: v for k, v in meta.items() if k != "buckets"} != {k: v for k, v in mine.items() if k != "buckets"}:
            raise ValueError(f"the store in {folder} was made with other settings: {meta}")
        self = cls(spark, folder, meta["buckets"])
        for table, columns, key in (("cells", "cell long, class long, no long, load int", "cell"), ("keys", "key string, file string, load int", "key")):
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_{table} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{folder}/{table}'")
        return self

    def close(self) -> None:
        """Forget the session's names for the store's tables; the files stay."""
        for table in ("cells", "keys"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{table}")

    def _passed(self, df: DataFrame, name: str) -> DataFrame:
        """A table in the shared folder that the load needs for a while; `_dropped` removes it."""
        self.passing.append(scratch(self.spark, name))
        return through_table(df, name, self.passing[-1])

    def _dropped(self, *names: str) -> None:
        """Remove the load's passing tables of these names, all if none is given."""
        gone = [p for p in self.passing if not names or p.rpartition("/")[2].rpartition("-")[0] in names]
        self.passing = [p for p in self.passing if p not in gone]
        drop_folders(self.spark, *gone)

    def _loads_in(self, name: str) -> list[int]:
        """Loads whose folder of that name is written to its end."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        places = [x.getPath() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(p.getName().split("=")[1]) for p in places if p.getName().startswith("load=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def loads(self) -> list[int]:
        """Loads that were accepted, each of one batch or several."""
        return self._loads_in("done")

    def accepted(self) -> set[int]:
        """The batches of the accepted loads."""
        return {b for n in self.loads() for r in self.spark.read.text(f"{self.folder}/done/load={n}").collect() for b in json.loads(r[0])}  # a row a load

    def _table(self, name: str) -> DataFrame:
        """Cells or keys of the accepted loads; leftovers of one that was lost half-way are passed over."""
        t = self.spark.table(f"{self.name}_{name}")
        return t.where(~F.col("load").isin(self.leftover)) if self.leftover else t

    def _append(self, df: DataFrame, name: str, key: str) -> None:
        df.repartition(self.buckets, key).write.mode("append").format("parquet").bucketBy(self.buckets, key).option("path", f"{self.folder}/{name}").saveAsTable(f"{self.name}_{name}")

    def _loaded(self, name: str, schema: str, loads: list[int]) -> DataFrame:
        if not loads:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*[f"{self.folder}/{name}/load={n}" for n in loads])

    def files(self, loads: list[int]) -> DataFrame:
        return self._loaded("files", _FILES, loads)

    def links(self) -> DataFrame:
        """a (the lesser name), b, kind (hash, doi, text, near) of all accepted loads; files by the names given to `ingest`."""
        return self._loaded("links", "a string, b string, kind string, load int", self.loads())

    def _key_links(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(links to the owners, new owners): one owner a key, of history or the least new file that has the key. keys: file, kind, key, load."""
        keys = keys.select("file", "kind", F.concat_ws(":", "kind", "key").alias("key"))  # one column, by which the table is bucketed
        first = keys.groupBy("key").agg(F.min("file").alias("file"))
        known = self._table("keys").select("key", F.col("file").alias("owner"))
        owners = self._passed(first.join(known, "key", "left").select("key", F.coalesce("owner", "file").alias("owner"), F.col("owner").isNull().alias("new")), "owners")
        links = keys.join(owners, "key").where("owner <> file").select(F.col("owner").alias("a"), F.col("file").alias("b"), "kind")
        return links, owners.where("new").select("key", F.col("owner").alias("file"))

    def _verify(self, pairs: DataFrame, load: int) -> DataFrame:
        """_NEAR: the pairs (a, b, load_a, class of a, file_a, file_b; b of the load, a of it or of history; a written table) whose five-word sets have the similarity; only the parts that hold a candidate are read."""
        files = pairs.select(F.col("file_a").alias("file"), F.coalesce("load_a", F.lit(load)).alias("load")).union(pairs.select("file_b", F.lit(load))).distinct().withColumn("part", _part("file"))
        places = files.groupBy("load", "part").agg(F.count(F.lit(1)).alias("files")).collect()  # at most loads times PARTS
        if not places:
            return self.spark.createDataFrame([], _NEAR)
        pages = self.spark.read.schema("file string, shingles array<int>").parquet(*sorted(f"{self.folder}/vectors/load={n}/part={p}" for n, p, _ in places))
        # sets of files that are no candidates are left out before the shuffle, by a hash of the name; a collision falls out in the joins by name
        few = broadcast_if_small(files.select(F.xxhash64("file").alias("h")), 24, rows=sum(r[2] for r in places))
        sets = pages.join(few, F.xxhash64("file") == F.col("h"), "left_semi").groupBy("file").agg(F.array_distinct(F.flatten(F.collect_list("shingles"))).alias("s"))
        left = sets.select(F.col("file").alias("file_a"), F.col("s").alias("sa")).join(pairs.select("a", "b", "file_a", "file_b", F.when(F.col("load_a").isNull(), F.col("a")).otherwise(F.col("class")).alias("root")).distinct(), "file_a")
        both = left.join(sets.select(F.col("file").alias("file_b"), F.col("s").alias("sb")), "file_b").withColumn("n", F.size(F.array_intersect("sa", "sb")))
        return both.where(F.col("n") >= SIMILARITY * (F.size("sa") + F.size("sb") - F.col("n"))).select("a", "b", "file_a", "file_b", "root")

    def _probes(self, fresh: DataFrame, counts: DataFrame) -> DataFrame:
        """cell, no: the cells that each new file probes: all of its own but the SKIP longest of the hot ones."""
        hot = counts.where(F.col("n") >= HOT).orderBy(F.desc("n"), "cell").limit(HOT_CELLS).collect()
        if not hot:
            return _postings(fresh)
        length = {c: n for c, n in hot}

        @F.pandas_udf("array<long>")
        def probed(vec: pd.Series) -> pd.Series:
            out = []
            for v in vec:
                own = [(i << 31) + int(x) for i, x in enumerate(v) if x < _EMPTY]
                left_out = set(sorted((c for c in own if c in length), key=lambda c: (-length[c], c))[:SKIP])
                out.append([c for c in own if c not in left_out])
            return pd.Series(out, dtype=object)

        return fresh.select("no", F.explode(probed("vec")).alias("cell")).select("cell", "no")

    def _near(self, fresh: DataFrame, load: int, old: list[int]) -> tuple[DataFrame, DataFrame]:
        """(_NEAR: links of near text; the new files with their class). fresh: a written table of no, file, vec."""
        mine = _postings(fresh)
        here = self._passed(mine.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "cells")
        pairs = here.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
        counts = here.unionByName(self._table("cells").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")).groupBy("cell").agg(F.sum("n").alias("n"))
        probes = self._probes(fresh, counts)  # made from the vectors wherever it is read: as a table it would hold a row for each coordinate
        none = F.lit(None).cast("int").alias("load_a")
        links, classes = None, fresh.select("no", F.col("no").alias("class"))
        turns = ("first", "all") if pairs > LONG and pairs > LONG * probes.count() else ("all",)
        for turn in turns:
            if turn == "first":  # one file a cell, so that a group of near copies is one class before all classes are compared
                lists = mine.groupBy("cell").agg(F.min("no").alias("a")).select("cell", F.col("a").alias("class"), "a", none)
            else:
                # a cell that one new file has alone can't bring two of the load together, so it isn't listed
                shared = mine.join(here.select("cell"), "cell")
                listed = shared.withColumn("class", F.col("no")) if links is None else shared.join(classes, "no")
                lists = listed.groupBy("cell", "class").agg(F.min("no").alias("a")).select("cell", "class", "a", none)
            q = probes.withColumn("own", F.col("no")) if links is None else probes.join(classes.withColumnRenamed("class", "own"), "no")
            q = q.select("cell", F.col("no").alias("b"), "own")
            met = q.join(lists, "cell").where("class <> own and a < b")
            if turn == "all" and old:  # a first load's probes needn't be shuffled for an empty history
                met = met.unionByName(self._in_history(q))
            # the members of a class that were met, and in how many cells the class was (a cell lists it once): at least as many as any member agrees in
            agreed = met.groupBy("b", "class", "a", "load_a").agg(F.count(F.lit(1)).alias("n")).groupBy("b", "class").agg(F.sum("n").alias("n"), F.collect_list(F.struct("a", "load_a")).alias("as")).where(F.col("n") >= AGREE - SKIP)
            cand = self._passed(self._named(agreed.select("b", "class", F.explode("as").alias("x")).select("b", "class", "x.a", "x.load_a"), fresh, old), "met")
            found = self._passed(self._verify(cand, load), "near")
            if turn == "all":
                further = self._members(cand, found, fresh, classes, load, old)
                found = found if further is None else found.unionByName(self._passed(further, "further"))  # read for the classes and for the links
            links = found if links is None else links.unionByName(found).distinct()
            classes = self._classes(fresh, links)
            if turn == "first":
                classes = self._passed(classes.select("no", "class"), "classes")
        return links, classes

    def _in_history(self, q: DataFrame) -> DataFrame:
        """The probes (cell, b, own) with what history lists in their cells. Only the probes are shuffled: the table is bucketed by cell, and stands in the join alone."""
        history = self._table("cells").select("cell", "class", F.col("no").alias("a"), F.col("load").alias("load_a"))
        return q.join(history, "cell").where("class <> own").select("cell", "b", "own", "class", "a", "load_a")

    def _new_cells(self, filed: DataFrame) -> DataFrame:
        """cell, class, no: the listings that the store doesn't have yet. Cells are the only join key, as for the table's buckets; the class is compared as a range."""
        mine = _postings(filed, "class").groupBy("cell", "class").agg(F.min("no").alias("no"))
        held = self._table("cells").select(F.col("cell").alias("__cell"), F.col("class").alias("__class"))
        return mine.join(held, (F.col("cell") == F.col("__cell")) & (F.col("class") >= F.col("__class")) & (F.col("class") <= F.col("__class")), "left_anti")

    def _named(self, pairs: DataFrame, fresh: DataFrame, old: list[int]) -> DataFrame:
        """The pairs a, b with the names of their files."""
        names = fresh.select("no", "file").unionByName(self.files(old).select("no", "file"))
        return pairs.join(names.select(F.col("no").alias("a"), F.col("file").alias("file_a")), "a").join(fresh.select(F.col("no").alias("b"), F.col("file").alias("file_b")), "b")

    def _members(self, cand: DataFrame, found: DataFrame, fresh: DataFrame, classes: DataFrame, load: int, old: list[int]) -> DataFrame | None:
        """Links to further members of the classes that agree with a file although no member met is near it; null if there is no such class."""
        filed = classes.select("no", "class", F.lit(None).cast("int").alias("load")).unionByName(self.files(old).select("no", "class", "load"))
        near = cand.join(found, ["a", "b"], "left_semi").select("b", "class").distinct()
        open_ = cand.select("b", "class").distinct().join(near, ["b", "class"], "left_anti").join(filed.where("no <> class").select("class").distinct(), "class", "left_semi")
        if open_.isEmpty():
            return None
        m = filed.select(F.col("no").alias("a"), "class", F.col("load").alias("load_a")).join(open_, "class").where("load_a is not null or a < b").join(cand.select("a", "b"), ["a", "b"], "left_anti")
        vecs = fresh.select("no", "vec").unionByName(self.files(old).select("no", "vec"))
        m = m.join(vecs.select(F.col("no").alias("a"), F.col("vec").alias("va")), "a").join(fresh.select(F.col("no").alias("b"), F.col("vec").alias("vb")), "b")
        same = F.aggregate(F.zip_with("va", "vb", lambda x, y: F.when((x == y) & (x < _EMPTY), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
        return self._verify(self._passed(self._named(m.where(same >= AGREE).select("a", "b", "class", "load_a").distinct(), fresh, old), "members"), load)

    def _classes(self, fresh: DataFrame, links: DataFrame) -> DataFrame:
        """The new files with their class: the least class of what one is linked to (numbers of history are less than the load's), else its own number."""
        to = links.groupBy(F.col("b").alias("no")).agg(F.min("root").alias("class"))
        return fresh.join(to, "no", "left").withColumn("class", F.coalesce("class", "no"))

    def arrive(self, signed: DataFrame) -> str:
        """Write signatures (file, step, columns of `signatures`) into a folder of the store's, of which `ingest` takes over a step each: the sets are written once."""
        place = f"{self.folder}/arrived-{uuid.uuid4().hex}"
        signed.withColumn("part", _part("file")).write.partitionBy("step", "part").parquet(place)
        return place

    def _take(self, arrived: str, load: int) -> None:
        """Make the arrived folder the load's vectors, by renaming it. What a lost load of that number left is removed."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        src, to = path(arrived), path(f"{self.folder}/vectors/load={load}")
        fs = to.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(to, True)
        fs.mkdirs(to.getParent() if fs.exists(src) else to)
        if fs.exists(src) and not fs.rename(src, to):
            raise OSError(f"{arrived} can't be renamed to {to}")
        fs.create(path(to, "_SUCCESS")).close()

    def ingest(self, batches: list[int], arrived: str, keys: DataFrame) -> None:
        """Check a load (a batch, or several that waited) against everything accepted, then append it.

        arrived: the step's folder below what `arrive` gave, which the store takes over; keys: file, kind, key. `file` is the file's name in the store."""
        again = self.accepted() & set(batches)
        if again:
            raise ValueError(f"batches {sorted(again)} are accepted already")
        old = self.loads()
        load = max(old, default=0) + 1
        self.leftover = [n for n in self._loads_in("vectors") if n not in old]
        now = F.lit(load).alias("load")
        self._take(arrived, load)
        signed = self.spark.read.schema("file string, " + _SIGNED).parquet(f"{self.folder}/vectors/load={load}")
        files = self._passed(file_vectors(signed, "file").withColumn("no", F.lit(load).cast("long") * (1 << 50) + F.monotonically_increasing_id()), "vecs")  # written, so the numbers stay
        keys = self._passed(keys.select("file", "kind", "key").unionByName(files.where("text_key is not null").select("file", F.lit("text").alias("kind"), F.col("text_key").alias("key"))).distinct(), "keys")
        exact, owners = self._key_links(keys)
        fresh = files.select("no", "file", "vec").join(exact.where("kind = 'text'").select(F.col("b").alias("file")), "file", "left_anti")
        fresh = self._passed(fresh, "fresh")  # read many times
        self._dropped("vecs")
        near, classes = self._near(fresh, load, old)
        classes.select("no", "file", "vec", "class").write.mode("overwrite").parquet(f"{self.folder}/files/load={load}")
        filed = self._loaded("files", _FILES, [load])
        self._dropped("cells")
        cells = self._new_cells(filed)
        links = exact.select("a", "b", "kind").unionByName(near.select(F.least("file_a", "file_b").alias("a"), F.greatest("file_a", "file_b").alias("b"), F.lit("near").alias("kind")))
        self._append(cells.select("cell", "class", "no", now), "cells", "cell")
        self._append(owners.select("key", "file", now), "keys", "key")
        links.write.mode("overwrite").parquet(f"{self.folder}/links/load={load}")
        self.spark.createDataFrame([(json.dumps(sorted(batches)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/done/load={load}")
        self._dropped()


def works(files: DataFrame, pages: DataFrame, papers: DataFrame, folder: str | None = None) -> DataFrame:
    """pdf_id, batch_no, first_pdf_id: every file that repeats an earlier one, with its work's first file.

    Files are signed as they arrive, each once. Of the batches that the store in the folder (a new one if none is given) hasn't accepted, all but the newest are a backlog,
    ingested in one load; then the newest is checked against the store."""
    spark = files.sparkSession
    files = files.select("pdf_id", "sha256", "paper_id", F.coalesce("batch_no", F.lit(0)).alias("batch_no"))
    store = Store.open(spark, folder or scratch(spark, "ivf"))
    done = store.accepted()
    waiting = sorted(r[0] for r in files.select("batch_no").distinct().collect() if r[0] not in done)  # one row a batch
    if waiting:
        new = files.where(F.col("batch_no").isin(waiting))
        name = F.concat(F.format_string("%010d", "batch_no"), F.lit("|"), "pdf_id").alias("file")
        steps = [waiting[:-1], waiting[-1:]] if len(waiting) > 1 else [waiting]
        step = F.when(F.col("batch_no") == waiting[-1], len(steps)).otherwise(1).alias("step")
        with shuffles_removed(spark):
            keyed = scratch(spark, "keyed")
            file_keys(new, papers).write.partitionBy("batch_no").parquet(keyed)
            arrived = store.arrive(signatures(new, pages).select(name, step, *[c.split()[0] for c in _SIGNED.split(", ")]))
            keys = spark.read.schema("pdf_id string, kind string, key string, batch_no int").parquet(keyed)
            for k, own in enumerate(steps, 1):
                store.ingest(own, f"{arrived}/step={k}", keys.where(F.col("batch_no").isin(own)).select(name, "*"))
            drop_folders(spark, keyed, arrived)
    links = store.links().select(F.col("a").alias("u"), F.col("b").alias("v"))
    store.close()
    r = roots(links)
    return r.select(F.substring("u", 12, 1 << 20).alias("pdf_id"), F.substring("u", 1, 10).cast("int").alias("batch_no"), F.substring("root", 12, 1 << 20).alias("first_pdf_id"))


def pairs(files: DataFrame, pages: DataFrame, papers: DataFrame, folder: str | None = None) -> DataFrame:
    """pdf_id_a, pdf_id_b: a work's first file with every other, the smaller identifier first."""
    w = works(files, pages, papers, folder)
    return w.select(F.least("pdf_id", "first_pdf_id").alias("pdf_id_a"), F.greatest("pdf_id", "first_pdf_id").alias("pdf_id_b"))
