"""Splitting oversized items at natural boundaries, with overlap.

One bounded-quantifier regular expression cuts the text into bodies: its alternatives stand in the order of the boundaries'
strength (rest of the text, paragraph, sentence, line, blank, character), each consuming up to the limit. A body has at
most limit - overlap characters (code points), so that a piece, the overlap and the body, stays within the limit. The overlap
of a piece is looked up in the bodies before it with array functions; no offsets into the text are kept, so that the work is
linear in the text's length.

Defined cases: null text gives no piece row in `pieces`, one row with null text in `split`; an empty text and a text within
the limit stay one piece, unchanged; a text without any boundary is cut at the limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.numbering import numbered

LIMIT, OVERLAP = 1800, 260
#: A body before the last has at least a tenth of the overlap, so ten bodies back always hold the overlap.
_BACK = 10
_P = "__split_"

#: Ends after which a text may be cut, strongest first, as lookbehinds.
BOUNDARIES = (
    r"(?<=\n[ \t\r]{0,8}\n)",
    r"(?<=[.!?…][\"'”’»)\]]{0,2}\s)|(?<=[。！？])",
    r"(?<=[\n\r])(?<!\r(?=\n))",
)
BLANK = r"(?<=\s)"


def cut_pattern(limit: int = LIMIT, overlap: int = OVERLAP) -> str:
    """The pattern for regexp_extract_all."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than the limit")
    body = limit - overlap
    least = max(1, -(-overlap // _BACK))
    half = max(least, body // 2)
    upper = [rf".{{{half},{body}}}(?:{b})" for b in BOUNDARIES]
    lower = [rf".{{{least},{max(least, half - 1)}}}(?:{b})" for b in BOUNDARIES]
    blank = [rf".{{{half},{body}}}{BLANK}"]
    return "(?s)" + "|".join([rf".{{1,{body}}}\z", *upper, *lower, *blank, rf".{{1,{body}}}(?<![\uD800-\uDBFF])"])


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """Array of the text's pieces, each with up to `overlap` characters of the one before; the text itself if it fits."""
    bodies = F.regexp_extract_all(text, F.lit(cut_pattern(limit, overlap)), F.lit(0))

    def with_overlap(b: Column, i: Column, all_: Column) -> Column:
        back = F.array_join(F.slice(all_, F.greatest(i - (_BACK - 1), F.lit(1)), F.least(i, F.lit(_BACK))), "")
        return F.when(i == 0, b).otherwise(F.concat(F.substring(back, -overlap, overlap) if overlap else F.lit(""), b))

    many = F.aggregate(F.array(bodies), F.array().cast("array<string>"), lambda acc, a: F.transform(a, lambda b, i: with_overlap(b, i, a)))
    return F.when(F.char_length(text) > limit, many).otherwise(F.array(text))


def oversized(df: DataFrame, text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """The rows that the operator cuts, with their pieces in `pieces`: those of more than one piece."""
    return df.where(F.char_length(text) > limit).withColumn("pieces", pieces(F.col(text), limit, overlap)).where(F.size("pieces") > 1)


def split(df: DataFrame, id_col: str = "chunk_id", doc: str = "pdf_id", order: tuple[str, ...] = ("page_number", "chunk_index"), text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """All items as pieces: the item's columns with text, char_count and chunk_index set anew, and piece_no (from 0), n_pieces.

    chunk_index counts from 0 through the document in the order given, then by identifier and piece. A null identifier or
    order value sorts first.
    """
    for c in df.columns:
        if c.startswith(_P):
            raise ValueError(f"reserved column name {c}")
    arr = df.withColumn(f"{_P}a", pieces(F.col(text), limit, overlap))
    flat = arr.select(*[c for c in df.columns if c not in (text, "char_count")], F.size(f"{_P}a").alias("n_pieces"), F.posexplode(f"{_P}a").alias("piece_no", text))
    flat = flat.withColumn("char_count", F.char_length(text))
    kept = flat.withColumnRenamed("chunk_index", f"{_P}old") if "chunk_index" in flat.columns else flat
    cols = [f"{_P}old" if c == "chunk_index" else c for c in order]
    return numbered(kept, [doc], [*cols, id_col, "piece_no"], "chunk_index").withColumn("chunk_index", F.col("chunk_index").cast("int")).drop(f"{_P}old")
