"""The best title of a paper out of several sources, by tiers of score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Words of source abbreviations that file names begin with, and what each source adds to its title's score and needs at least.
SOURCE_TOKENS = ["acs", "adv", "advanced", "aelm", "appl", "applied", "composites", "commun", "communications", "computational", "electron", "electronics", "funct", "functional", "hal", "ieee", "iedm", "int", "iranica", "j", "journal", "lett", "mater", "materials", "mrs", "nano", "nanolett", "nat", "nature", "npj", "phys", "scientia", "proceedings", "sci", "science", "small", "solid", "state"]
BONUS = {"doi": 25.0, "metadata": 5.0, "filename": -8.0}
LEAST, STRONG_LAYOUT, GAIN = 45.0, 60.0, 8.0


def from_filename(name: Column) -> Column:
    """A file name's words without years and without the source abbreviations that lead it."""
    words = F.filter(F.split(F.regexp_replace(name, r"\.[^.]*$", ""), r"[_\s]+"), lambda w: (w != "") & ~w.rlike(r"^20[12]\d$"))
    plain = F.transform(words, lambda w: F.when(F.lower(w).isin(SOURCE_TOKENS), 0).otherwise(1))
    first = F.array_position(plain, 1)
    return T.clean_title(F.when(first > 0, F.array_join(F.slice(words, first.cast("int"), F.greatest(F.size(words), F.lit(1))), " ")).otherwise(""))


def best(rows: DataFrame) -> DataFrame:
    """The rows with new_title, source, score, changed.

    rows: title (the present one), doi_title, layout_title, layout_size (mean type size), metadata_title, file_name; any of them may be null or absent, but title and file_name.
    A DOI's title comes first, then a strong layout, the metadata, a fair layout, the file name; without any the present title stays. A title is replaced if it's useless, if the
    new one is the DOI's, or if that scores GAIN more; a file name replaces useless titles only."""
    have = lambda c: F.col(c) if c in rows.columns else F.lit(None)
    clean = {"doi": T.clean_title(have("doi_title").cast("string")), "layout": T.clean_title(have("layout_title").cast("string")), "metadata": T.clean_title(have("metadata_title").cast("string")), "filename": from_filename(F.col("file_name"))}
    r = rows.withColumn("__old", T.title_score(F.col("title"))).withColumn("__clean_old", F.coalesce(T.clean_title(F.col("title")), F.lit("")))
    for k, c in clean.items():
        r = r.withColumn(f"__{k}", c)
    for k in clean:
        raw = T.title_score(F.col(f"__{k}"))
        bonus = have("layout_size").cast("double") if k == "layout" else F.lit(BONUS[k])
        r = r.withColumn(f"__{k}_s", F.when(raw > 0, raw + bonus))
    s = {k: F.col(f"__{k}_s") for k in clean}
    source = F.when(s["doi"] >= LEAST, "doi").when(s["layout"] >= STRONG_LAYOUT, "layout").when(s["metadata"] >= LEAST, "metadata").when(s["layout"] >= LEAST, "layout").when(s["filename"].isNotNull(), "filename").otherwise("current")
    r = r.withColumn("source", source)
    take = lambda f, other: F.coalesce(*[F.when(F.col("source") == k, f(k)) for k in clean], other)
    r = r.withColumn("new_title", take(lambda k: F.col(f"__{k}"), F.col("__clean_old"))).withColumn("__score", take(lambda k: s[k], F.col("__old")))
    changed = (F.col("source") != "current") & (F.coalesce("title", F.lit("")) != F.col("new_title")) & ((F.col("source") != "filename") | (F.col("__old") == 0)) & (F.col("__score") >= LEAST) & ((F.col("__old") == 0) | (F.col("source") == "doi") | (F.col("__score") >= F.col("__old") + GAIN))
    return r.select(*rows.columns, "new_title", "source", F.round("__score", 2).alias("score"), changed.alias("changed"))
