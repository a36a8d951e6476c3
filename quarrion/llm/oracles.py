"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op2_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM sizes
), weighed AS (
  SELECT *, ([5, 2, 1])[((n - 1) % 3 + 1)::INT]::BIGINT AS w, 2 * source_size AS most FROM ranked
), filled AS (
  SELECT *, most / w AS fill, sum(source_size) OVER () * 1.5::DOUBLE AS whole, sum(w) OVER () AS all_w FROM weighed
), levels AS (
  SELECT *, (whole - coalesce(sum(most) OVER before, 0)) / (all_w - coalesce(sum(w) OVER before, 0)) AS level
  FROM filled WINDOW before AS (ORDER BY fill, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT *, level > fill AS is_full, first_value(level) OVER (ORDER BY level > fill, fill, n) AS open_level FROM levels
), goals AS (
  SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE open_level * w END AS target FROM opened
), drawn AS (
  SELECT d.doc_id, d.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM drawn
"""

#: Measures of each document, the proposed cutoffs and the certified excess of its language, and the verdict.
QUALITY_CTES = r"""
split AS (
  SELECT row_number() OVER () AS rid, *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM split)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), measured AS (
  SELECT s.*, len(w)::BIGINT AS n_words, length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    len(regexp_extract_all(coalesce(text, ''), '\p{Lu}')) AS n_upper, len(regexp_extract_all(coalesce(text, ''), '!')) AS n_bang
  FROM split s LEFT JOIN covered c USING (rid)
), judged AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    list_transform([[n_symbols, word_chars], [n_upper, word_chars], [n_bang, word_chars], [n_dup_lines, n_lines], [n_repeat_words, n_words]],
      lambda x: CASE WHEN x[2] > 0 THEN least(1000 * x[1] // x[2], 1000) ELSE 0 END) AS rate FROM measured
), known AS (
  SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)
), held AS (
  SELECT lang, rate, good, substr(md5('half:' || j.doc_id::VARCHAR), 1, 1) >= '8' AS second
  FROM judged j JOIN known k ON j.doc_id = k.doc_id WHERE NOT base_failed
), counted AS (
  SELECT lang, m, rate[m] AS r, count(*) FILTER (good) AS g, count(*) FILTER (NOT good) AS b
  FROM held, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE NOT second GROUP BY ALL
), scored AS (
  SELECT *, sum(g) OVER every AS all_good, sum(b) OVER every AS all_bad, coalesce(sum(g) OVER above, 0) AS lost, coalesce(sum(b) OVER above, 0) AS caught
  FROM counted WINDOW every AS (PARTITION BY lang, m), above AS (PARTITION BY lang, m ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), best AS (
  SELECT lang, m, r FROM scored WHERE lost * 5 <= 0.03::DOUBLE * all_good AND caught * all_good > lost * all_bad AND r < 1000
  QUALIFY row_number() OVER (PARTITION BY lang, m ORDER BY caught * all_good - lost * all_bad DESC, r DESC) = 1
), proposed AS (
  SELECT lang, list_transform([max(r) FILTER (m = 1), max(r) FILTER (m = 2), max(r) FILTER (m = 3), max(r) FILTER (m = 4), max(r) FILTER (m = 5)],
    lambda x: coalesce(x, 1001)) AS cuts FROM best GROUP BY lang
), last_half AS (
  SELECT h.lang, coalesce(list_max(list_transform(range(1, 6), lambda k: CASE WHEN rate[k] > cuts[k] THEN ceil(10000 * (rate[k] - cuts[k]) / (1000 - cuts[k])) ELSE 0 END)), 0)::BIGINT AS excess
  FROM held h LEFT JOIN proposed p ON h.lang IS NOT DISTINCT FROM p.lang WHERE second AND good
), tested AS (
  SELECT lang, n, count(*) OVER () AS m FROM (SELECT lang, count(*) AS n FROM last_half GROUP BY lang) WHERE pow(0.97::DOUBLE, n) <= 0.05
), tails AS (
  SELECT lang, m, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.03::DOUBLE) + (n - k) * ln(0.97::DOUBLE))) OVER (PARTITION BY lang ORDER BY k) AS tail
  FROM (SELECT *, unnest(range(ceil(0.03::DOUBLE * n)::BIGINT + 1)) AS k FROM tested)
), allowed AS (
  SELECT lang, max(k) AS k FROM tails WHERE tail <= 0.05 / m GROUP BY lang
), steps AS (
  SELECT lang, excess, sum(n) OVER (PARTITION BY lang ORDER BY excess DESC) - n AS lost
  FROM (SELECT lang, excess, sum(n) AS n FROM (SELECT lang, excess, 1 AS n FROM last_half UNION ALL SELECT DISTINCT lang, 0, 0 FROM last_half) GROUP BY ALL)
), certified AS (
  SELECT s.lang, min(excess) AS most FROM steps s JOIN allowed a ON s.lang IS NOT DISTINCT FROM a.lang WHERE lost <= k GROUP BY s.lang
), fitted AS (
  SELECT p.lang, cuts, most FROM proposed p JOIN certified c ON p.lang IS NOT DISTINCT FROM c.lang
), verdicts AS (
  SELECT j.*, NOT base_failed AND NOT coalesce(list_max(list_transform(range(1, 6),
    lambda k: CASE WHEN rate[k] > cuts[k] THEN ceil(10000 * (rate[k] - cuts[k]) / (1000 - cuts[k])) ELSE 0 END)) > most, false) AS kept
  FROM judged j LEFT JOIN fitted f ON j.lang IS NOT DISTINCT FROM f.lang
)"""

SQL["op9_quality_rules"] = f"""
WITH {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM verdicts
"""
