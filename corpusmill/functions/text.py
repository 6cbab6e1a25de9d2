"""Column functions on text: all are built-in expressions, so they stay inside generated code. Null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab as V

WS = " \t\r\n\u000b\u000c"


def strip(c: Column, chars: str = WS) -> Column:
    return F.btrim(c, F.lit(chars))


def clean_text(c: Column) -> Column:
    """NUL to blank, runs of blanks to one, three or more newlines to two, ends stripped."""
    t = F.translate(c, "\u0000", " ")
    return strip(F.regexp_replace(F.regexp_replace(t, "[ \t]+", " "), "\n{3,}", "\n\n"))


def dehyphenate(c: Column) -> Column:
    """Words cut at line ends joined, blanks before newlines dropped, three or more newlines to two."""
    t = F.regexp_replace(c, r"(?U)(?<=\w)-\s*\n\s*(?=\w)", "")
    return strip(F.regexp_replace(F.regexp_replace(t, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def parser_doi(c: Column) -> Column:
    """A DOI as a page prints it: stripped, closing marks dropped, lower case."""
    return nonempty(F.lower(F.regexp_replace(strip(c), r"[.,;)\]}]+$", "")))


def resolver_doi(c: Column) -> Column:
    """A DOI as a service gives it: without a resolver's address."""
    return nonempty(strip(F.regexp_replace(F.lower(strip(c)), r"^https?://(dx\.)?doi\.org/", "")))


def first_doi(c: Column) -> Column:
    return parser_doi(nonempty(F.regexp_extract(c, V.DOI, 0)))


def first_year(c: Column) -> Column:
    return nonempty(F.regexp_extract(c, V.YEAR, 1)).cast("int")


def file_title(name: Column) -> Column:
    """A title from a file's name: leading year off, underscores to blanks."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    t = strip(F.regexp_replace(F.translate(F.regexp_replace(stem, r"^20[12]\d[_\-\s]+", ""), "_", " "), r"\s+", " "))
    return F.when(t == "", stem).otherwise(t)


def file_year(name: Column) -> Column:
    return nonempty(F.regexp_extract(name, V.FILE_YEAR, 1)).cast("int")


def page_title(text: Column, fallback: Column) -> Column:
    """The first of the first 12 lines over 8 characters that has 20 to 220 characters and names no journal, DOI or copyright."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: strip(x)), lambda x: F.char_length(x) > 8)
    ok = F.filter(F.slice(lines, 1, 12), lambda x: F.char_length(x).between(20, 220) & ~F.lower(x).rlike("journal|doi|copyright"))
    return F.coalesce(F.get(ok, F.lit(0)), fallback)


def paper_type(title: Column, name: Column) -> Column:
    t = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(name, F.lit("")))
    return F.when(t.rlike(V.COMPUTATIONAL), "computational").when(t.rlike(V.THEORETICAL), "theoretical").when(t.rlike(V.REVIEW_HINT), "review").otherwise("experimental")


def any_of(text: Column, words: list[str]) -> Column:
    """Substring test of any word; the alternatives are one expression of plain searches."""
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def keyword_flag(text: Column, words: list[str]) -> Column:
    return any_of(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), words)


def formula_flag(text: Column) -> Column:
    return text.rlike(V.FORMULA)


def section(text: Column) -> Column:
    head = F.lower(F.substring(text, 1, 160))
    out = None
    for name, words in V.SECTIONS:
        hit = any_of(head, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(head.startswith("fig.") | F.substring(head, 1, 40).contains("figure"), "figure_caption").otherwise("unknown")


def word_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")))


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens of more than one character."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit(V.TOKEN), F.lit(0)), F.lower), lambda x: F.char_length(x) > 1))


def unescape(c: Column) -> Column:
    for a, b in V.ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_clean(c: Column) -> Column:
    t = unescape(F.regexp_replace(c, "<[^>]+>", " "))
    return nonempty(strip(F.regexp_replace(t, r"\s+", " ")))


def clean_title(c: Column) -> Column:
    c = unescape(c)
    for pattern, to in V.TITLE_REWRITES:
        c = F.regexp_replace(c, pattern, to)
    return strip(c, " .,\t\n\r")


def title_score(c: Column) -> Column:
    """0 for unusable titles, else by length, words and keywords; never negative."""
    t = clean_title(c)
    n = F.char_length(t)
    low = F.lower(t)
    words = F.size(F.regexp_extract_all(t, F.lit("[A-Za-z][A-Za-z0-9-]*"), F.lit(0)))
    score = F.least(n, F.lit(180)) / 3 + F.least(words, F.lit(24)) * 2
    for k in V.TITLE_KEYWORDS:
        score = score + F.when(low.contains(k), 8).otherwise(0)
    score = score - F.when(low.rlike(V.TITLE_NOISE), 25).otherwise(0) - F.when(t.rlike(r"\d{4}") & (n < 80), 20).otherwise(0)
    bad = ~n.between(18, 260) | t.rlike(V.BAD_TITLE) | t.rlike(r"^\p{Ll}") | t.rlike(V.DANGLING) | (words < 4)
    return F.when(c.isNull() | bad, F.lit(0.0)).otherwise(F.greatest(score, F.lit(0.0)))


def domain_score(title: Column, abstract: Column) -> Column:
    t = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))
    hits = sum((F.when(t.contains(k), 1).otherwise(0) for k in V.DOMAIN_KEYWORDS), F.lit(0))
    s = F.least(F.lit(1.0), hits / 6)
    s = s * F.when(t.contains("ferroelectric"), 1.0).otherwise(0.6) * F.when(any_of(t, V.DOMAIN_MATERIALS), 1.0).otherwise(0.5)
    return F.round(s, 3)


def safe_filename(title: Column, doi: Column, year: Column) -> Column:
    """A file name from DOI or title: safe characters only, at most 120, after the year."""
    base = F.regexp_replace(F.regexp_replace(strip(F.coalesce(nonempty(doi), title)), "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    base = F.substring(F.btrim(base, F.lit("._-")), 1, 120)
    return F.concat(F.coalesce(F.concat(nonempty(year.cast("string")), F.lit("_")), F.lit("")), F.coalesce(nonempty(base), F.lit("open_access_paper")), F.lit(".pdf"))


def uuid5(name: Column) -> Column:
    """First 16 hex digits of the name-based UUID (version 5) in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3))


def node_id(kind: str, value: Column) -> Column:
    """Kind:value with blanks and slashes as underscores, the value cut to 80 characters."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.translate(value, " /", "__"), 1, 80))
