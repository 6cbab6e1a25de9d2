"""The batch build end to end: files and pages to chunks, facts, graph, index and reports, each stage a table in the output folder."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import chunks, facts, files, graph, payloads, retrieval
from corpusmill.sources import markdown, read_table, write_csv, write_parquet


def build(spark: SparkSession, folder: str, out: str, incremental: bool = False, version: str = "rules-1") -> dict[str, int]:
    """Row counts by stage. `incremental` chunks only files that have none yet in the folder's document_chunks, and extracts only from chunks without a
    candidate of this version in its extraction_candidates."""
    pages = read_table(spark, folder, "parsed_pages", "page_id", "paper_id", "pdf_id", "page_number", "text")
    if incremental:
        pages = chunks.not_yet(pages, read_table(spark, folder, "document_chunks", "pdf_id"), ["pdf_id"])
    stages = {"chunks": chunks.chunk_pages(pages), "quality": files.page_quality(pages)}
    counts = {}
    for name, df in stages.items():
        write_parquet(df, f"{out}/{name}")
        counts[name] = spark.read.parquet(f"{out}/{name}").count()
    c = spark.read.parquet(f"{out}/chunks")
    high = c.where("is_high_value")
    todo = high
    if incremental:
        todo = payloads.pending(high, read_table(spark, folder, "extraction_candidates", "chunk_id", "version"), version)
    write_parquet(payloads.candidates(todo, version), f"{out}/candidates")
    cand = spark.read.parquet(f"{out}/candidates")
    for status in ("extracted", "empty_result"):
        counts[status] = cand.where(F.col("status") == status).count()
    fact = payloads.facts_of(cand).join(high.select("chunk_id", "text"), "chunk_id").withColumn("title", F.lit(None).cast("string")).withColumn("material", F.coalesce("material", F.lit("HfO2"))).drop("sample", "phases", "devices")
    write_parquet(facts.with_context(fact, "text").drop("text"), f"{out}/facts")
    ctx = spark.read.parquet(f"{out}/facts")
    for name_, df in (("nodes", graph.nodes(ctx)), ("edges", graph.edges(ctx)), ("index", retrieval.index(high, "chunk_id", "text"))):
        write_parquet(df, f"{out}/{name_}")
        counts[name_] = spark.read.parquet(f"{out}/{name_}").count()
    counts["facts"] = ctx.count()
    return counts


def validation_report(spark: SparkSession, folder: str) -> str:
    """The validators' summary, their most frequent issues and the schema's problems as a small report."""
    from . import fact_queries, payload_queries

    problems = payload_queries.schema_validate(spark, folder).groupBy("field", "reason").count().orderBy("field", "reason")
    return markdown("Validation", {"models": fact_queries.mv_summary(spark, folder).orderBy("model"), "issues": fact_queries.mv_top_issues(spark, folder).orderBy("model", "rank"), "schema": problems})


def report(spark: SparkSession, folder: str) -> str:
    from . import fact_queries, text_queries

    return markdown("Corpus", {"tables": text_queries.table_counts(spark, folder), "years": text_queries.corpus_summary(spark, folder).where("dimension = 'year'").orderBy("value"), "ranges": fact_queries.range_stats(spark, folder), "anomalies": fact_queries.domain_anomalies(spark, folder).groupBy("reason").count()})


def export(spark: SparkSession, folder: str, out: str) -> list[str]:
    """Write the graph, triples, title repairs and validators' tables as CSV folders and the two reports as Markdown files; their names."""
    from pathlib import Path

    from . import fact_queries, payload_queries

    tables = {
        "nodes": fact_queries.kg_nodes, "edges": fact_queries.kg_edges, "triples": fact_queries.kg_triples, "title_repair": payload_queries.title_best, "model_details": fact_queries.mv_details,
        "model_summary": fact_queries.mv_summary, "schema_problems": payload_queries.schema_validate,
    }
    for name, query in tables.items():
        write_csv(query(spark, folder), f"{out}/{name}.csv")
    texts = {"corpus.md": report(spark, folder), "validation.md": validation_report(spark, folder)}
    Path(out).mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        (Path(out) / name).write_text(text, encoding="utf-8")
    return sorted([f"{n}.csv" for n in tables] + list(texts))
