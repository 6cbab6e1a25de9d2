"""Queries of the training-data operators: (spark, folder) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.sources import read_table as t

from . import canonical, incremental, leaks, lines, listmatch, mixing, scans, splitting, toxicity


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.members(t(spark, d, "literature_candidates", "candidate_id", "title", "doi"))


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    return canonical.collapse(t(spark, d, "literature_candidates", "candidate_id", "title", "doi")).select("kept_id", "copies")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.oversized(t(spark, d, "document_chunks", "chunk_id", "text")).select("chunk_id")


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split(t(spark, d, "document_chunks", "chunk_id", "pdf_id", "page_number", "chunk_index", "text"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(*_scan_tables(spark, d))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(*_scan_tables(spark, d), fresh=False).select("page_id", "text")


def _scan_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return t(spark, d, "parsed_pages", "page_id", "pdf_id", "paper_id", "text"), t(spark, d, "pdf_files", "pdf_id", "ocr_needed"), t(spark, d, "papers", "paper_id", "title", "authors", "publisher", "journal")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.pairs(t(spark, d, "pdf_files", "pdf_id", "sha256", "paper_id", "batch_no"), t(spark, d, "parsed_pages", "pdf_id", "text"), t(spark, d, "papers", "paper_id", "doi"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return listmatch.found(t(spark, d, "fact_hits", "fact_id", "material", "material_family"), t(spark, d, "material_reference"))


def p6_unmatched(spark: SparkSession, d: str) -> DataFrame:
    m = listmatch.mapped(t(spark, d, "fact_hits", "fact_id", "material", "material_family"), t(spark, d, "material_reference"))
    return m.where("material_id = 0").groupBy("material").count().withColumnRenamed("count", "n")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated(t(spark, d, "parsed_pages"), t(spark, d, "papers", "paper_id", "publisher", "journal"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return lines.cleaned_pages(t(spark, d, "parsed_pages"), t(spark, d, "papers", "paper_id", "publisher", "journal"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_spans(spark, d).select("doc_id", "item_id")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(t(spark, d, "documents", "doc_id", "text"), t(spark, d, "eval_items"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(t(spark, d, "documents", "doc_id", "text", "source", "lang", "doc_type"), t(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(t(spark, d, "documents", "doc_id", "text", "source", "lang", "doc_type"), t(spark, d, "mix_targets"), fresh=False)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.found(t(spark, d, "documents", "doc_id", "source", "text"), t(spark, d, "content_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(t(spark, d, "documents", "doc_id", "source", "text"), t(spark, d, "content_labels"), fresh=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}
