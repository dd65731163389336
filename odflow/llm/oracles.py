"""SQL for DuckDB with the same results as the queries."""

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 12) AS BIGINT) + 0.5::DOUBLE)
      / 281474976710656.0::DOUBLE AS u
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS weight
  FROM sized GROUP BY source),
capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ceiling FROM sizes),
levels AS (
  SELECT *,
    ((SELECT sum(source_size) FROM capped) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY ceiling, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ceiling, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped),
targets AS (
  SELECT source, source_size,
    CASE WHEN ceiling <= max(level) OVER () THEN cap ELSE max(level) OVER () * weight END AS target
  FROM levels),
classes AS (SELECT source, length(bin(greatest(size, 1))) - 1 AS k, sum(size) AS mass FROM sized GROUP BY source, k),
weighed AS (
  SELECT c.source, k, mass, target, source_size, sqrt(pow(2.0::DOUBLE, k)) AS weight
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
shared AS (
  SELECT *, CASE WHEN sum(weight * mass) OVER onward > 0 THEN
    (target - coalesce(sum(mass * 2.0::DOUBLE) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight * mass) OVER onward END AS level
  FROM weighed WINDOW onward AS (PARTITION BY source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
copied AS (SELECT *, coalesce(least(2.0::DOUBLE, max(level) OVER (PARTITION BY source) * weight), 0) AS copies FROM shared),
plan AS (
  SELECT *, CAST(floor(copies) AS BIGINT) AS whole, copies - floor(copies) AS p,
    target - sum(floor(copies) * mass) OVER (PARTITION BY source) AS wanted
  FROM copied),
odds AS (
  SELECT doc_id, s.source, size, source_size, target, whole, p, wanted, (u / (1 - u)) / (p / (1 - p)) AS q
  FROM sized s JOIN plan ON s.source IS NOT DISTINCT FROM plan.source AND k = length(bin(greatest(size, 1))) - 1),
ranked AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY p = 0, q / (1 + q), doc_id NULLS FIRST, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM odds)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(size * (whole + CASE WHEN p > 0 AND wanted > 0 AND run - size + run < 2 * wanted THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""

LEXICAL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
kept AS (SELECT r, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS documents_in, CAST(sum(n) AS BIGINT) AS terms_in FROM kept),
items AS (
  SELECT row_number() OVER () AS item, item_id, list_distinct(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (SELECT item, item_id, unnest(terms) AS term FROM items),
held AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(terms) AS term FROM kept)
  WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weighed AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * documents_in + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM held, totals GROUP BY term, documents_in),
summed AS (
  SELECT item, item_id, r, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * documents_in) // terms_in)))) AS BIGINT) AS score
  FROM wanted JOIN held USING (term) JOIN weighed USING (term) JOIN kept USING (r), totals
  GROUP BY item, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM summed WHERE score > 0)
WHERE rank <= 10
"""

SEARCH = """
WITH whole AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e : floor(1024 * CAST(e AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda e : e IS NULL OR NOT isfinite(e))) = 0),
pairs AS (
  SELECT q.r AS query, q.vec_id AS query_id, w.r, w.vec_id, CAST(list_inner_product(q.v, w.v) AS BIGINT) AS score
  FROM whole q JOIN whole w ON q.r <> w.r AND len(q.v) = len(w.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, r) AS INTEGER) AS rank FROM pairs)
WHERE rank <= 10
"""

JACCARD = r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS words
  FROM documents),
sets AS (
  SELECT r, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i : array_to_string(words[i:i + 4], ' '))
                               WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS grams
  FROM worded),
grams AS (SELECT r, len(grams) AS n, unnest(grams) AS gram FROM sets),
links AS (
  SELECT a.r AS x, b.r AS y FROM grams a JOIN grams b ON a.gram = b.gram AND a.r <> b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING CAST(count(*) AS DOUBLE) / (a.n + b.n - count(*)) >= 0.8),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
heads AS (SELECT x, min(d.doc_id) AS least FROM reach JOIN worded d ON d.r = y GROUP BY x),
counts AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT doc_id, CASE WHEN heads.x IS NULL THEN doc_id ELSE least END AS class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM worded LEFT JOIN heads ON r = heads.x LEFT JOIN counts ON r = counts.x
"""
