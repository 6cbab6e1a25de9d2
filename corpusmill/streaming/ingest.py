"""Incremental ingestion as streams: files that arrive in a folder are processed once, in micro-batches, into snapshot-safe tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from corpusmill.operators import chunks, facts


def page_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch goes to the sink exactly once per batch id; `once` processes what is there and ends."""
    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def chunk_sink(out: str) -> Callable[[DataFrame, int], None]:
    """Pages to chunks, one directory per batch, overwritten if the batch is replayed: idempotent without a lakehouse format.

    A file's pages arrive together (a file is written whole), so chunk indexes run within the batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks.chunk_pages(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def extraction_sink(out: str, version: str) -> Callable[[DataFrame, int], None]:
    """Chunks to facts, with a marker for chunks without any, so that a later run with the same version skips them."""

    def write(batch: DataFrame, batch_id: int) -> None:
        f = batch.select("chunk_id", facts.properties(F.col("text")).alias("p")).withColumn("version", F.lit(version))
        rows = f.select("chunk_id", "version", F.posexplode_outer("p").alias("place", "fact")).select("chunk_id", "version", "place", "fact.*", F.when(F.col("fact").isNull(), "empty_result").otherwise("extracted").alias("status"))
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write


def rates(events: DataFrame, at: str = "ts", late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Events per type and window, with a watermark for late ones; works on streams and tables alike."""
    e = events.withColumn("__t", F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("__t", late)
    return e.groupBy(F.window("__t", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
