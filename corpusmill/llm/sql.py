"""SQL of the training-data queries that SQL can express, for an independent engine. The others are tested against brute force (tests/llm)."""

from __future__ import annotations

from .canonical import DOI_PREFIX, NOT_ALNUM
from .leaks import MARKUP, MIN_ANSWER_WORDS, MIN_WORDS
from .lines import MIN_DOCS, MIN_LETTERS, MIN_SHARE
from .splitting import LIMIT

_q = lambda s: "'" + s.replace("'", "''") + "'"
_PREFIX = DOI_PREFIX.replace(r"(?=10\s*\.\s*\d{4})", r"(10\s*\.\s*\d{4})")


def _key(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), {_q(_PREFIX)}, '\\1'), {_q(NOT_ALNUM)}, '', 'g')"


_KEYED = f"k AS (SELECT candidate_id, {_key('title')} AS a, {_key('doi')} AS b FROM literature_candidates), g AS (SELECT candidate_id, least(a, b) AS x, greatest(a, b) AS y FROM k)"
_name = lambda c: f"nullif(trim(regexp_replace(lower({c}), '[\\s_]+', ' ', 'g')), '')"
_SRC = f"""p AS (SELECT paper_id, {_name('publisher')} AS pub, {_name('journal')} AS jou FROM papers), v AS (SELECT jou, pub, count(*) AS n FROM p WHERE pub IS NOT NULL AND jou IS NOT NULL GROUP BY 1, 2), o AS (SELECT jou, arg_max(pub, {{'n': n, 'p': pub}}) AS jpub FROM v GROUP BY 1),
s AS (SELECT paper_id, coalesce(pub, jpub, p.jou) AS source FROM p LEFT JOIN o ON o.jou = p.jou), g AS (SELECT page_id, pdf_id, text, coalesce(source, '') AS source FROM parsed_pages LEFT JOIN s USING (paper_id)),
l AS (SELECT page_id, pdf_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM g), h AS (SELECT *, regexp_replace(lower(line), '[^a-z]+', '', 'g') AS a FROM l),
t AS (SELECT source, count(DISTINCT pdf_id) AS total FROM g GROUP BY 1), f AS (SELECT source, a, count(DISTINCT pdf_id) AS n FROM h WHERE length(a) >= {MIN_LETTERS} GROUP BY 1, 2), r AS (SELECT f.source, a FROM f JOIN t USING (source) WHERE n >= {MIN_DOCS} AND n >= {MIN_SHARE} * total)"""


_words = lambda c: f"regexp_extract_all(lower(regexp_replace(coalesce({c}, ''), {_q(MARKUP.pattern)}, ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"
_LEAKS = f"""i AS (SELECT item_id, {_words('text')} AS qw, {_words('answer')} AS aw FROM eval_items WHERE item_id IS NOT NULL), p AS (SELECT item_id, qw AS w FROM i WHERE len(qw) > 0 UNION ALL SELECT item_id, list_concat(qw, aw) FROM i WHERE len(qw) > 0 AND len(aw) > 0 AND len(qw) + len(aw) >= {MIN_WORDS} UNION ALL SELECT item_id, aw FROM i WHERE len(aw) >= {MIN_ANSWER_WORDS}),
x AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {MIN_WORDS - 1}, 1) + 1)) AS pos FROM p), k AS (SELECT DISTINCT item_id, least(len(w), {MIN_WORDS}) AS n, array_to_string(w[pos:pos + {MIN_WORDS - 1}], ' ') AS run FROM x),
d AS (SELECT doc_id, {_words('text')} AS w FROM documents), n AS (SELECT DISTINCT n FROM k), z AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, n WHERE len(w) >= n), r AS (SELECT DISTINCT doc_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS run FROM z)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_KEYED}, m AS (SELECT *, min(candidate_id) OVER (PARTITION BY x, y) AS kept_id FROM g) SELECT kept_id, candidate_id FROM m WHERE candidate_id <> kept_id",
        "p1_records": f"WITH {_KEYED} SELECT min(candidate_id) AS kept_id, count(*) AS copies FROM g GROUP BY x, y",
        "p2_found": f"SELECT chunk_id FROM document_chunks WHERE length(text) > {LIMIT}",
        "p7_found": f"WITH {_SRC} SELECT page_id, CAST(line_no AS INT) AS line_no FROM h JOIN r USING (source, a)",
        "p8_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, item_id FROM r JOIN k USING (n, run)",
        "p7_clean": f"WITH {_SRC}, c AS (SELECT page_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (r.a IS NULL) AS text, count(r.a) AS removed FROM h LEFT JOIN r USING (source, a) GROUP BY 1) SELECT page_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS char_count, removed FROM c",
    }
