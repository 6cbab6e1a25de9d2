"""Pages to chunks: sentence and paragraph packing with overlap, running indexes, keyword flags, incremental selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions import vocab as V
from corpusmill.session import spread

from .numbering import numbered

MIN_CHARS, MAX_CHARS, OVERLAP = 900, 1800, 260


def split_text(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Array of chunks: paragraphs (at blank lines and sentence ends) packed while the chunk is short or the next one fits; each flush carries the
    chunk's tail over. One fold over the array of paragraphs, no Python. Empty text gives an empty array."""
    parts = F.filter(F.transform(F.split(T.dehyphenate(text), r"\n\s*\n|(?<=\.)\s+(?=[A-Z])"), lambda x: T.strip(x)), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def step(acc: Column, p: Column) -> Column:
        cur = acc["cur"]
        fits = (F.char_length(cur) < least) | (F.char_length(cur) + F.char_length(p) <= most)
        tail = T.strip(F.substring(cur, -overlap, overlap)) if overlap else F.lit("")
        flushed = F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n"), p))
        return F.struct(
            F.when((cur == "") | fits, acc["done"]).otherwise(F.array_append(acc["done"], cur)).alias("done"),
            F.when(cur == "", p).when(fits, F.concat(cur, F.lit("\n"), p)).otherwise(flushed).alias("cur"),
        )

    return F.aggregate(parts, state, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.array_append(a["done"], a["cur"])))


def flags(df: DataFrame, text: str = "text") -> DataFrame:
    c = F.col(text)
    out = df.withColumn("contains_formula", T.formula_flag(c))
    for name, words in (("hfo2", V.HFO2_KEYWORDS), ("process", V.PROCESS_KEYWORDS), ("property", V.PROPERTY_KEYWORDS)):
        out = out.withColumn(f"contains_{name}_keyword", T.keyword_flag(c, words))
    return out.withColumn("is_high_value", (F.col("contains_hfo2_keyword") | F.col("contains_formula")) & (F.col("contains_process_keyword") | F.col("contains_property_keyword")))


def chunk_pages(pages: DataFrame, least: int = MIN_CHARS, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of all pages, reference sections left out before numbering; chunk_index runs through the pages of a file.

    The index is the page's offset (a running sum over per-page counts, one row a page) plus the place in the page, so the texts themselves
    are never shuffled for numbering other than by the join on page_id."""
    cut = spread(pages).select("page_id", "paper_id", "pdf_id", "page_number", F.filter(split_text(F.col("text"), least, most, overlap), lambda c: T.section(c) != "references").alias("parts"))
    w = Window.partitionBy("pdf_id").orderBy("page_number", "page_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.select("page_id", "pdf_id", "page_number", F.size("parts").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(w), F.lit(0))).select("page_id", "offset")
    flat = cut.join(offsets, "page_id").select("paper_id", "pdf_id", "page_number", "offset", F.posexplode("parts").alias("pos", "text"))
    flat = flat.withColumn("chunk_index", (F.col("offset") + F.col("pos")).cast("int"))
    flat = flat.select(F.format_string("%s_c%05d", "pdf_id", "chunk_index").alias("chunk_id"), "paper_id", "pdf_id", "page_number", T.section(F.col("text")).alias("section"), "chunk_index", "text", F.char_length("text").alias("char_count"), T.word_count(F.col("text")).cast("int").alias("token_count"))
    return flags(flat)


def table_chunk(tables: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Tables (pdf_id, page_number, table_index, cells: rows of cells) as text chunks: cells tidied, blank rows dropped, one line a row."""
    rows = F.filter(F.transform("cells", lambda r: F.transform(r, lambda x: T.strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))), lambda r: F.exists(r, lambda x: x != ""))
    t = tables.withColumn("rows", rows)
    return t.select("pdf_id", "page_number", "table_index", *keep, F.size("rows").alias("row_count"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)).alias("col_count"), F.array_join(F.transform("rows", lambda r: F.array_join(r, " | ")), "\n").alias("table_text"))


def table_chunks(tables: DataFrame, text_chunks: DataFrame) -> DataFrame:
    """Chunks of tables (`files.table_rows`): a header line and the table's text, numbered on behind the file's text chunks. text_chunks: pdf_id, n."""
    t = tables.withColumn("text", F.concat(F.format_string("Table %d on page %d\n", "table_index", "page_number"), F.col("table_text")))
    t = numbered(t.select("table_id", "paper_id", "pdf_id", "page_number", "table_index", "text"), ["pdf_id"], ["page_number", "table_index"], "place").join(text_chunks.select("pdf_id", "n"), "pdf_id", "left")
    c = t.select(
        F.col("table_id").alias("chunk_id"), "paper_id", "pdf_id", "page_number", F.lit("table").alias("section"), (F.coalesce("n", F.lit(0)) + F.col("place")).cast("int").alias("chunk_index"), "text", F.char_length("text").alias("char_count"),
        T.word_count(F.col("text")).cast("int").alias("token_count"), F.lit(True).alias("contains_table"),
    )
    return flags(c)


def not_yet(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Incremental selection: rows whose keys have no counterpart yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")
