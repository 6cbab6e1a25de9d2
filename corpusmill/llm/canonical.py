"""Duplicates hidden by formatting differences: one record per canonical key, with the number of its copies.

Key: title and DOI reduced to their letters and digits in lower case, a resolver address or the word "doi" before a DOI left
out; the two in sorted order, as they may have been entered in each other's column.

Plan: an exact count per key (partial counts before the shuffle) names the hot keys; rows of hot keys are salted and
reduced in two levels; all others take one shuffle on the key. The representative is the smallest identifier.

Defined cases: a null title or DOI equals a blank one; rows with both blank form one record; a null identifier sorts before
none (it never represents a record that has an identifier) and its row counts as a copy; exactly repeated rows count as copies.
Other columns may have any name: internal columns carry a prefix that is refused in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, through_table

#: Rows of one key from which the key counts as hot.
HOT_ROWS = 10_000
SALTS = 64
_P = "__canon_"

DOI_PREFIX = r"^[^\p{L}\p{N}]*(?:(?:https?\s*:\s*/+\s*)?[a-z0-9-]+(?:\.[a-z0-9-]+)+\s*/+\s*|doi[^\p{L}\p{N}]*)+(?=10\s*\.\s*\d{4})"
NOT_ALNUM = r"[^\p{L}\p{N}]+"


def alnum_key(value: Column) -> Column:
    """Letters and digits of the value in lower case; '' for null."""
    low = F.lower(F.coalesce(value, F.lit("")))
    return F.regexp_replace(F.regexp_replace(low, DOI_PREFIX, ""), NOT_ALNUM, "")


def canonical_key(*fields: Column) -> Column:
    """SHA-256 of the sorted canonical forms of the fields; a unit separator keeps the fields apart."""
    return F.sha2(F.array_join(F.array_sort(F.array(*[alnum_key(f) for f in fields])), "\u001f"), 256)


def hot_keys(keyed: DataFrame, key: str, threshold: int = HOT_ROWS) -> DataFrame:
    """Keys with more rows than the threshold: exact counts, combined on the map side. At most rows/threshold keys."""
    return keyed.groupBy(key).agg(F.count(F.lit(1)).alias(f"{_P}n")).where(F.col(f"{_P}n") > threshold).select(key)


def _guard(df: DataFrame) -> None:
    bad = [c for c in df.columns if c.lower().startswith(_P)]
    if bad:
        raise ValueError(f"reserved column names: {bad}")


def _split(df: DataFrame, id_col: str, fields: list[str], threshold: int, extra: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Narrow rows (key, identifier), with whether their key is hot."""
    _guard(df)
    # the expressions are costly and the rows narrow, so keys are made once and kept as 32 bytes beside the identifier
    keyed = through_table(df.select(F.unhex(canonical_key(*[F.col(f"`{c}`").cast("string") for c in fields])).alias(f"{_P}key"), F.col(f"`{id_col}`").alias(f"{_P}id")), "canon")
    hot = broadcast_if_small(through_table(hot_keys(keyed, f"{_P}key", threshold), "hot"), row_bytes=96)
    return keyed, hot


def collapse(df: DataFrame, id_col: str = "candidate_id", fields: tuple[str, ...] = ("title", "doi"), threshold: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """One row per record: record_key, kept_id, copies."""
    keyed, hot = _split(df, id_col, list(fields), threshold)
    k, i = f"{_P}key", f"{_P}id"
    marked = keyed.join(hot.withColumn(f"{_P}hot", F.lit(True)), k, "left")
    salt = F.when(F.col(f"{_P}hot"), F.pmod(F.xxhash64(i), F.lit(salts))).otherwise(F.lit(0))
    first = marked.where(F.col(f"{_P}hot")).groupBy(k, salt.alias(f"{_P}salt")).agg(F.min(i).alias(i), F.count(F.lit(1)).alias("copies"))
    two = first.groupBy(k).agg(F.min(i).alias("kept_id"), F.sum("copies").alias("copies"))
    one = marked.where(F.col(f"{_P}hot").isNull()).groupBy(k).agg(F.min(i).alias("kept_id"), F.count(F.lit(1)).alias("copies"))
    return one.unionByName(two).select(F.hex(k).alias("record_key"), "kept_id", "copies")


def members(df: DataFrame, id_col: str = "candidate_id", fields: tuple[str, ...] = ("title", "doi"), threshold: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Every other copy with its record's representative: kept_id, and the copy's identifier under id_col.

    Keys that aren't hot take one shuffle, in which a window over at most `threshold` rows names the representative;
    hot keys are reduced in two levels and their representatives, few by construction, are joined back without a shuffle.
    """
    keyed, hot = _split(df, id_col, list(fields), threshold)
    k, i = f"{_P}key", f"{_P}id"
    cold = keyed.join(hot, k, "left_anti")
    w = Window.partitionBy(k)
    a = cold.withColumn("kept_id", F.min(i).over(w))
    warm = keyed.join(hot, k, "left_semi")
    salted = warm.groupBy(k, F.pmod(F.xxhash64(i), F.lit(salts)).alias(f"{_P}salt")).agg(F.min(i).alias("m"))
    reps = salted.groupBy(k).agg(F.min("m").alias("kept_id"))
    b = warm.join(broadcast_if_small(through_table(reps, "reps"), row_bytes=160), k)
    both = a.select(i, "kept_id").unionByName(b.select(i, "kept_id"))
    return both.where(F.col(i) != F.col("kept_id")).select("kept_id", F.col(i).alias(id_col))
