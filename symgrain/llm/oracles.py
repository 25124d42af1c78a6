"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from symgrain.llm import url_filter

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _url_filter() -> str:
    rules = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)
    terms = ", ".join(f"('{t}', {w})" for t, w in url_filter.VOCABULARY.items())
    return f"""
WITH rules(rule, rhost, rpath, verdict) AS (VALUES {rules}), terms(term, weight) AS (VALUES {terms}),
r AS (SELECT page_id, {_LOWER.format("coalesce(url, '')")} AS u, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, u, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
fits AS (SELECT page_id, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, length(rhost) DESC) AS k
  FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
bad AS (SELECT page_id, sum(weight) AS weight FROM p JOIN terms ON regexp_matches(u, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY page_id)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN coalesce(bad.weight, 0) >= {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON f.page_id = p.page_id LEFT JOIN bad ON bad.page_id = p.page_id"""


_WORDS = "[x for x in regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') if x <> '']"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (win)),
cover AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS NULL OR page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""

EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings),
good AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(m, v.vec_id)) AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) x ON x.a = v.vec_id LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) y ON y.a = v.vec_id"""


def _crc(text):
    """CRC-32 of a text's bytes, by the table that byte_crc holds."""
    return f"xor(list_reduce(list_prepend(4294967295, [CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT) for i in range(octet_length(encode({text})))]), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295)"


#: A pair's checksum is put together from its words' where the second has up to 40 bytes: ``later`` says what each byte of a checksum becomes once n more bytes follow.
RESAMPLING = f"""
WITH RECURSIVE byte_crc AS MATERIALIZED (SELECT [list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) for b in range(256)] AS crc),
later(n, k, byte, v) AS (SELECT CAST(0 AS BIGINT), k, b, CAST(b << (8 * k) AS BIGINT) FROM range(4) s(k), range(256) t(b) UNION ALL SELECT n + 1, k, byte, CAST(xor(v >> 8, crc[(v & 255) + 1]) AS BIGINT) FROM later, byte_crc WHERE n <= 40),
raw AS (SELECT row_number() OVER () AS id, * FROM (SELECT 0 AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 1, item_id, coalesce(text, '') FROM benchmark)),
w AS MATERIALIZED (SELECT id, side, doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM raw),
word AS MATERIALIZED (SELECT x, octet_length(encode(x)) AS bytes, {_crc("x")} AS one, {_crc("' ' || x")} AS spaced FROM (SELECT DISTINCT unnest(w) AS x FROM w), byte_crc),
pair AS MATERIALIZED (SELECT id, side, x, y, count(*) AS n FROM (SELECT id, side, unnest(w[:-2]) AS x, unnest(w[2:]) AS y FROM w WHERE len(w) > 1) GROUP BY ALL),
seen AS MATERIALIZED (SELECT x, y, o.one, q.bytes, q.spaced FROM (SELECT DISTINCT x, y FROM pair) p JOIN word o USING (x) JOIN (SELECT x AS y, bytes, spaced FROM word) q USING (y)),
keyed AS MATERIALIZED (SELECT (n * 4 + k) * 256 + byte AS key, v FROM later),
hashed AS MATERIALIZED (SELECT x, y, xor(xor(xor(a.v, b.v), xor(c.v, d.v)), spaced) % 10000 AS bucket FROM (SELECT *, bytes * 1024 + 1024 AS base FROM seen WHERE bytes <= 40)
  JOIN keyed a ON a.key = base + (one & 255) JOIN keyed b ON b.key = base + 256 + ((one >> 8) & 255) JOIN keyed c ON c.key = base + 512 + ((one >> 16) & 255) JOIN keyed d ON d.key = base + 768 + ((one >> 24) & 255)
  UNION ALL SELECT x, y, {_crc("x || ' ' || y")} % 10000 FROM seen, byte_crc WHERE bytes > 40),
f AS MATERIALIZED (SELECT id, side, bucket, sum(n) AS n FROM (SELECT id, side, one % 10000 AS bucket, 1 AS n FROM (SELECT id, side, unnest(w) AS x FROM w) JOIN word USING (x) UNION ALL SELECT id, side, bucket, n FROM pair JOIN hashed USING (x, y)) GROUP BY ALL),
sums AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM f GROUP BY bucket),
gain AS (SELECT k AS bucket, CAST(floor(1000 * ln(CAST(coalesce(t, 0) + 1 AS DOUBLE) * (all_s + 10000) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS gain
  FROM range(10000) r(k) LEFT JOIN sums ON bucket = k, (SELECT CAST(coalesce(sum(n) FILTER (side = 0), 0) AS DOUBLE) AS all_s, CAST(coalesce(sum(n) FILTER (side = 1), 0) AS DOUBLE) AS all_t FROM f)),
scored AS (SELECT w.id, doc_id, len(w) AS words, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_features, CAST(coalesce(floor(CAST(sum(n * gain) AS DOUBLE) / sum(n)), 0) AS BIGINT) AS weight
  FROM w LEFT JOIN f ON f.id = w.id LEFT JOIN gain USING (bucket) WHERE w.side = 0 GROUP BY w.id, doc_id, len(w)),
noised AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS most FROM noised WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * most // 100 THEN rank END AS rank FROM noised LEFT JOIN ranked USING (id)"""

ORACLES = {"op2_warc": WARC, "op3_embedding_dedup": EMBEDDINGS, "op9_url_filter": _url_filter(), "op10_decontamination": DECONTAMINATION, "op12_resampling": RESAMPLING}
