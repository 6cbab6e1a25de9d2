"""Lines repeated across one source's documents: found per source by document share, and taken out of each page.

Two lines are the same if their letters a-z are. Lines are hashed; distinct documents are counted per source and hash, in two steps that
both combine before they shuffle (source, hash, document, then source, hash), so that one source may hold most rows.

Defined cases: null text has no lines; a null document id counts as no document; a null source forms a source of its own;
equal pages count once per document, but every occurrence is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import broadcast_if_small, through_table

MIN_LETTERS, MIN_DOCS, MIN_SHARE = 25, 4, 0.08


def tidy_name(c: Column) -> Column:
    """Names written unevenly made equal: case, blanks around and within; null if nothing is left."""
    t = F.trim(F.regexp_replace(F.lower(c), r"[\s_]+", " "))
    return F.when(t != "", t)


def source_of(papers: DataFrame) -> DataFrame:
    """paper_id, source: the tidied publisher, else the one that the journal's other papers name most often, else the journal."""
    p = papers.select("paper_id", tidy_name(F.col("publisher")).alias("pub"), tidy_name(F.col("journal")).alias("jou"))
    votes = p.where("pub is not null and jou is not null").groupBy("jou", "pub").agg(F.count(F.lit(1)).alias("n"))
    of = votes.groupBy("jou").agg(F.max_by("pub", F.struct("n", "pub")).alias("jpub"))
    return p.join(of, "jou", "left").select("paper_id", F.coalesce("pub", "jpub", "jou").alias("source"))


def page_lines(pages: DataFrame) -> DataFrame:
    """page_id, pdf_id, source, line_no (from 1), h: hash of the letters of each line that has enough letters."""
    exploded = pages.select("page_id", "pdf_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    letters = F.regexp_replace(F.lower("line"), "[^a-z]+", "")
    return exploded.select("page_id", "pdf_id", "source", (F.col("pos") + 1).cast("int").alias("line_no"), letters.alias("letters")).where(F.length("letters") >= MIN_LETTERS).select("page_id", "pdf_id", "source", "line_no", F.xxhash64("letters").alias("h"), F.crc32(F.encode("letters", "UTF-8")).alias("h2"))


def with_source(pages: DataFrame, papers: DataFrame) -> DataFrame:
    return pages.join(source_of(papers), "paper_id", "left").withColumn("source", F.coalesce("source", F.lit("")))


def frequent_lines(lines: DataFrame, pages: DataFrame, min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """source, h, h2, n_docs, share: lines in at least min_docs documents and min_share of the source's documents with pages."""
    totals = pages.where(F.col("pdf_id").isNotNull()).select("source", "pdf_id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    counts = lines.where(F.col("pdf_id").isNotNull()).select("source", "h", "h2", "pdf_id").distinct().groupBy("source", "h", "h2").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    return counts.join(totals, "source").where(F.col("n_docs") >= F.lit(min_share) * F.col("total")).select("source", "h", "h2", "n_docs", (F.col("n_docs") / F.col("total")).alias("share"))


def repeated(pages: DataFrame, papers: DataFrame) -> DataFrame:
    """page_id, line_no of every occurrence of a repeated line in its source's pages."""
    p = with_source(pages.select("page_id", "pdf_id", "paper_id", "text"), papers)
    lines = page_lines(p)
    often = broadcast_if_small(through_table(frequent_lines(lines, p).select("source", "h", "h2"), "often"), row_bytes=96)
    return lines.join(often, ["source", "h", "h2"]).select("page_id", "line_no")


def cleaned_pages(pages: DataFrame, papers: DataFrame) -> DataFrame:
    """page_id, text without the repeated lines, char_count, removed: each page rebuilt in its own row, without a shuffle of texts.

    The hashes of a page's lines are looked up in its source's repeated lines; the sources' line lists are small by construction
    (a source has at most its mean number of lines per document divided by the share), and are joined by source.
    """
    p = with_source(pages.select("page_id", "pdf_id", "paper_id", "text"), papers)
    often = through_table(frequent_lines(page_lines(p), p).groupBy("source").agg(F.collect_set(F.struct("h", "h2")).alias("often")), "often")
    j = p.join(broadcast_if_small(often, F.size("often") * 32 + 64), "source", "left")
    letters = lambda x: F.regexp_replace(F.lower(x), "[^a-z]+", "")
    is_often = lambda x: F.coalesce(F.array_contains("often", F.struct(F.xxhash64(letters(x)).alias("h"), F.crc32(F.encode(letters(x), "UTF-8")).alias("h2"))), F.lit(False)) & (F.length(letters(x)) >= MIN_LETTERS)
    kept = F.filter(F.split("text", "\n"), lambda x: ~is_often(x))
    out = j.select("page_id", F.array_join(kept, "\n").alias("text"), (F.size(F.split("text", "\n")) - F.size(kept)).alias("removed"))
    return out.select("page_id", "text", F.char_length("text").alias("char_count"), F.coalesce("removed", F.lit(0)).alias("removed"))
