"""Numbering the rows of groups of any size, without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

_P = "__num_"


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, total: str | None = None) -> DataFrame:
    """The rows with their 0-based position in their group (and the group's size, if `total` names a column for it).

    The rows are range-partitioned by group and order and kept (checkpoint); a row's place in the whole is its place in
    its partition plus the sizes of the partitions before (one number per partition reaches the driver), and its position in the group is this less the
    group's first place, which partial aggregation gives. Nulls sort first and form a group of their own; rows equal in group and order are numbered in any order.
    """
    for c in df.columns:
        if c.startswith(_P):
            raise ValueError(f"reserved column name {c}")
    kept = cut_lineage(df.repartitionByRange(*[F.col(c) for c in group + order]).sortWithinPartitions(*group, *order).withColumn(f"{_P}m", F.monotonically_increasing_id()))
    part, pos = F.shiftright(f"{_P}m", 33), F.col(f"{_P}m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, at = [], 0
    for p, n in sorted((r[0], r[1]) for r in sizes):
        starts.append((p, at))
        at += n
    offs = df.sparkSession.createDataFrame(starts or [(0, 0)], f"{_P}p int, {_P}start long")
    placed = kept.withColumn(f"{_P}p", part.cast("int")).join(F.broadcast(offs), f"{_P}p").withColumn(f"{_P}at", pos + F.col(f"{_P}start"))
    placed = placed.withColumn(f"{_P}g", F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in group]))
    first = placed.groupBy(f"{_P}g").agg(F.min(f"{_P}at").alias(f"{_P}first"), F.count(F.lit(1)).alias(f"{_P}n"))
    done = placed.join(first, f"{_P}g").withColumn(out, F.col(f"{_P}at") - F.col(f"{_P}first"))
    if total:
        done = done.withColumn(total, F.col(f"{_P}n"))
    return done.drop(*[f"{_P}{x}" for x in ("m", "p", "start", "at", "g", "first", "n")])
