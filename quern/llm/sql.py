"""DuckDB SQL for the queries that SQL can express, over the same Parquet tables."""

#: crc32 of the UTF-8 bytes, with the table of its usual reflected polynomial.
_CRC_TABLE = "(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"

SHARDING = f"""
WITH slim AS (
  SELECT doc_id, source, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size, {_CRC}::BIGINT AS text_crc32,
         md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || size) AS h, coalesce('=' || source, '') AS s
  FROM documents, {_CRC_TABLE}
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, doc_id NULLS FIRST, text_crc32, size) AS r, count(*) OVER (PARTITION BY s) AS n,
         (('0x' || substr(md5('17:' || s), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM slim
), placed AS (
  SELECT *, row_number() OVER (ORDER BY (r - u) / n, s, h, doc_id NULLS FIRST, text_crc32, size) - 1 AS p, count(*) OVER () AS total FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 16 // total)::INTEGER AS shard,
       (p - ((p * 16 // total) * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
FROM placed
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark WHERE text IS NOT NULL),
win AS MATERIALIZED (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
place AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS MATERIALIZED (SELECT r, p, n, item FROM place JOIN win USING (n, g)),
words AS (SELECT r, count(DISTINCT k) AS n_hit, max(k) AS k FROM (SELECT r, unnest(range(p, p + n)) AS k FROM (SELECT DISTINCT r, p, n FROM hit)) GROUP BY r),
runs AS (SELECT r, max(c) AS longest FROM (SELECT r, count(*) AS c FROM (SELECT r, k - row_number() OVER (PARTITION BY r ORDER BY k) AS run FROM (SELECT DISTINCT r, unnest(range(p, p + n)) AS k FROM hit)) GROUP BY r, run) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest
FROM d LEFT JOIN words USING (r) LEFT JOIN runs USING (r) LEFT JOIN names USING (r)
"""

JACCARD = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WS} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)
"""
