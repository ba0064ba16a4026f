"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm.ann import op10_nearest_neighbours
from lodeframe.llm.decontaminate import op3_decontaminate
from lodeframe.llm.language_id import op5_language_id
from lodeframe.llm.ngram_join import op2_ngram_jaccard_join
from lodeframe.llm.pack import op7_pack
from lodeframe.llm.pii import op6_pii
from lodeframe.llm.quality import op8_quality
from lodeframe.llm.substring_dedup import op1_substring_dedup
from lodeframe.llm.token_count import op4_token_count
from lodeframe.llm.url_filter import LISTED, PATTERNS, op9_url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_decontaminate": op3_decontaminate,
    "op4_token_count": op4_token_count,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_pack": op7_pack,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_nearest_neighbours": op10_nearest_neighbours,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _folded(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


#: Shingle sets, pairs that share enough of them, and what each document reaches over such pairs.
NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
  l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
  r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id)
SELECT s.doc_id, CAST(len(any_value(s.s)) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id"""

#: Windows of ten words (or an item's fewer) of both sides, joined; hit words are counted by position.
_ITEM_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{_ITEM_WORDS}') AS w FROM documents),
  i AS (SELECT CAST(item_id AS STRING) AS item, regexp_extract_all({_folded('text')}, '{_ITEM_WORDS}') AS w FROM benchmark),
  iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda j: array_to_string(w[j:j + 9], ' '))) AS x FROM i WHERE len(w) > 0),
  dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda j: {{'pos': j, 'x': array_to_string(w[j:j + n - 1], ' ')}})) AS y FROM d, (SELECT DISTINCT n FROM iw)),
  hits AS (SELECT doc_id, dw.n, y['pos'] AS pos, item FROM dw JOIN iw ON iw.n = dw.n AND iw.x = y['x']),
  words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) FROM hits) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _url_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    listed = sorted((r for r in LISTED), key=lambda r: -len(r.name))
    # The checking database's patterns have neither \\A nor look-behind; hosts have no line breaks.
    plain = lambda p: p.replace(r"\A[^/]*(?<![a-z0-9])", "^([^/]*[^/a-z0-9])?").replace("(?![a-z0-9])", "([^a-z0-9]|$)").replace(r"\A(?:[^/]*\.)?", r"^([^/]*\.)?")
    rule = "CASE " + " ".join(f"WHEN regexp_matches(host || path, {quote(plain(r.pattern))}) THEN {quote(r.name)}" for r in listed) + " END"
    verdicts = "CASE rule " + " ".join(f"WHEN {quote(r.name)} THEN {quote(r.verdict)}" for r in listed) + " END"
    blocked = " OR ".join(f"regexp_matches(host || path, {quote(plain(r.pattern))})" for r in PATTERNS)
    return rf"""WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS place FROM pages),
  b AS (SELECT page_id, translate(regexp_extract(place, '^[^/]*'), '{UPPER}', '{LOWER}') AS host, substr(place, length(regexp_extract(place, '^[^/]*')) + 1) AS path FROM a),
  c AS (SELECT *, {rule} AS rule FROM b)
SELECT page_id, host, path, rule, coalesce({verdicts}, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict FROM c"""


#: The others learn, tokenize or search in ways that SQL can't express; they are tested against brute force and held-out rows.
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": NEAR_DUPLICATES, "op3_decontaminate": CONTAMINATION, "op9_url_filter": _url_sql()}
