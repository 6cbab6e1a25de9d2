"""Run logs: append, newest entries, progress out of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the form of a progress line.
PROGRESS = r"processed=(\d+)\s+candidates=(\d+)\s+llm_used=\d+\s+llm_failed=\d+\s+empty=(\d+)\s+(?:empty_recorded=\d+\s+)?errors=(\d+)"


def append(spark: SparkSession, path: str, step: str, status: str, stats: dict, message: str = "") -> None:
    import json

    row = spark.createDataFrame([(step, status, json.dumps(stats, sort_keys=True), message)], "step_name string, status string, stats_json string, message string")
    row.withColumn("run_id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def recent(df: DataFrame, at: str, id_col: str, n: int) -> DataFrame:
    """The n newest rows (ties by larger id): a top-n, without a full sort."""
    return df.orderBy(F.desc(at), F.desc(id_col)).limit(n)


def progress(lines: DataFrame, order: str, line: str, total: int) -> DataFrame:
    """One row from the last line that reports progress; none if no line does."""
    m = lines.where(F.col(line).rlike(PROGRESS))
    last = m.agg(F.max_by(line, order).alias("l")).where("l is not null")
    names = ["processed", "candidates", "empty", "errors"]
    got = last.select(*[F.regexp_extract("l", PROGRESS, i + 1).cast("long").alias(n) for i, n in enumerate(names)])
    return got.withColumn("remaining", F.greatest(F.lit(0).cast("long"), F.lit(total) - F.col("processed"))).withColumn("percent", F.least(F.lit(100.0), F.round(F.col("processed") / total * 100, 1)))


def newest(spark: SparkSession, folder: str, pattern: str = "*.log") -> str | None:
    """Path of the file changed last (ties to the larger path); null if there is none. Only names and times are read."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime")
    r = f.agg(F.max_by("path", F.struct("modificationTime", "path"))).first()
    return r[0]


def with_rate(p: DataFrame, seconds: float) -> DataFrame:
    """Progress with rate a minute, seconds left (null without any progress) and state: failed beats finished beats running beats waiting."""
    rate = F.when(F.lit(seconds > 0) & (F.col("processed") > 0), F.col("processed") / F.lit(max(seconds, 1e-9)) * 60)
    state = F.when((F.col("errors") > 0) & (F.col("errors") == F.col("processed")), "failed").when(F.col("remaining") == 0, "finished").when(F.col("processed") > 0, "running").otherwise("waiting")
    return p.withColumn("per_minute", F.round(rate, 2)).withColumn("seconds_left", F.round(F.col("remaining") / rate * 60, 0)).withColumn("state", state)


def duration(seconds: float | None) -> str:
    if seconds is None:
        return "unknown"
    m, s = divmod(int(max(0, seconds)), 60)
    h, m = divmod(m, 60)
    return f"{h}h {m}m {s}s" if h else f"{m}m {s}s" if m else f"{s}s"
