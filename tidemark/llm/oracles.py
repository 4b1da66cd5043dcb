"""DuckDB SQL for the queries that SQL can express.

The others hash by XXH64, encode by a tokenizer, or have a trained model or a
test battery in their result; tests/llm holds them against plain versions.
"""

from __future__ import annotations

_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Blanks between words; all characters that a line's pieces are stripped of.
_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SEPARATOR = r"\||»|›|·|•|::| > | / "


def _quality() -> str:
    """The quality rules on lines and texts, from the rules' own patterns."""
    from .quality import _BOILERPLATE, _LINE_SYMBOLS, _MARKS, MAX_LOST, MAX_REPEAT_PERCENT, MIN_WORDS

    boilerplate = _BOILERPLATE.pattern.replace("'", "''")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w FROM d),
runs AS (SELECT r, k, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, k, w[k:k + 7] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS k FROM w))),
again AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(k, k + 8)) AS p FROM runs WHERE n > 1) GROUP BY r),
l AS (SELECT r, x, len(regexp_extract_all(x, '{_WORD}')) AS n, length(x) - length(replace(x, ' ', '')) AS spaces,
  length(regexp_replace(x, '{_LINE_SYMBOLS.pattern.replace("[", "[^", 1)}', '', 'g')) AS symbols,
  len(regexp_extract_all(x, '{_SEPARATOR}')) AS cuts,
  len(list_filter(regexp_split_to_array(x, '{_SEPARATOR}'), lambda y: regexp_matches(y, '[^{_SPACE}]'))) AS pieces,
  len(list_filter(regexp_extract_all(replace(x, ',', ''), '[^{_SPACE}]+'), lambda y: right(y, 1) IN ('!', '?'))) AS emphatic,
  regexp_matches(x, '{_MARKS.pattern}') AS marked, regexp_matches(x, '(?i){boilerplate}') AS boiler
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)),
f AS (SELECT r, x, n, n > 0 AND CASE WHEN NOT marked THEN n <= 25 AND boiler
  WHEN symbols > CAST(0.15 AS DOUBLE) * (length(x) - spaces) THEN TRUE
  WHEN cuts >= 3 AND n - cuts <= 3 * (cuts + 1) THEN TRUE
  WHEN n >= 3 AND emphatic > CAST(0.4 AS DOUBLE) * n THEN TRUE
  ELSE n <= 25 AND boiler END AS fails FROM l),
lines AS (SELECT r, count(*) AS n_lines, count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(n) FILTER (fails), 0) AS n_lost_words,
  count(*) FILTER (n > 0) - count(DISTINCT x) FILTER (n > 0) AS n_dup_lines FROM f GROUP BY r),
c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_failed_lines AS BIGINT) AS n_failed_lines,
  CAST(n_lost_words AS BIGINT) AS n_lost_words FROM w JOIN lines USING (r) LEFT JOIN again USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND n_lost_words <= CAST({MAX_LOST} AS DOUBLE) * n_words AS kept FROM c"""


SQL: dict[str, str] = {
    "op8_quality": _quality(),
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to FROM q""",
    "op10_decontamination": f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
i AS (SELECT item_id, {_FOLDED} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, w[k:k + n - 1] AS g FROM
  (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, n, w[k:k + n - 1] AS g FROM
  (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw))),
m AS (SELECT DISTINCT dw.doc_id, dw.k, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.doc_id = hits.doc_id LEFT JOIN its ON d.doc_id = its.doc_id""",
}
