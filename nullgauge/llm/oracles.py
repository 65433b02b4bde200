"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP5 = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), g AS (SELECT h, payload_bytes, min(page_id) AS first_id FROM p GROUP BY ALL)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 10 * (j // 8) AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (j % 8) AS BIGINT)) & 31) AS INT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN g USING (h, payload_bytes)
"""

OP8 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5('mix-1:' || doc_id) AS turn FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM d GROUP BY source
), f(round, share, weights, n) AS (
  SELECT 0, CAST(sum(source_size) AS HUGEINT), CAST(sum(weight) AS HUGEINT), CAST(0 AS BIGINT) FROM s
  UNION ALL
  SELECT round + 1, (SELECT sum(source_size) FROM s) - x.held, x.free, x.n FROM f, LATERAL (
    SELECT CAST(coalesce(sum(3 * source_size) FILTER (weight * share > 3 * source_size * weights), 0) AS HUGEINT) AS held,
      CAST(coalesce(sum(weight) FILTER (weight * share <= 3 * source_size * weights), 0) AS HUGEINT) AS free,
      count(*) FILTER (weight * share > 3 * source_size * weights) AS n FROM s) x
  WHERE x.n > f.n AND x.free > 0
), l AS (SELECT share, weights FROM f ORDER BY round DESC LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN weight * share > 3 * source_size * weights THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * share AS DOUBLE) / CAST(weights AS DOUBLE) END AS target FROM s, l
), w AS (
  SELECT *, CAST(round(target) AS BIGINT) // greatest(source_size, 1) AS whole, CAST(round(target) AS BIGINT) % greatest(source_size, 1) AS rest FROM t
), r AS (
  SELECT d.*, source_size, target, whole, rest, sum(size) OVER (PARTITION BY d.source ORDER BY turn, size ROWS UNBOUNDED PRECEDING) AS until
  FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - (until - size))) AS BIGINT) AS taken FROM r
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w
), n AS (SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY 1
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, seen) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT doc_id, n AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n
"""

OP11 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT d, unnest(w) AS t FROM w WHERE len(w) > 0
), c AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM w
), m AS (SELECT d, doc_id, 100 - 75 + (75 * len(w) * docs) // terms AS m FROM w, c WHERE len(w) > 0
), f AS (SELECT d, t, count(*) AS tf FROM t GROUP BY ALL
), v AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS v FROM f, c GROUP BY t, docs
), i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), s AS (SELECT item_id, doc_id, d, CAST(sum(v * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN v USING (t) JOIN f USING (t) JOIN m USING (d) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

OP12 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents
), r AS (
  SELECT *, len(u) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN [0, 1, 2, 3]] AS x FROM d
), c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 100 THEN 'plain' WHEN x[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM r
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form != 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form != 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""

OP13 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id != b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
), r(vec_id, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.seen
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, min(seen) AS component_id, vec_id = min(seen) AS kept FROM r LEFT JOIN n ON a = vec_id GROUP BY vec_id, n
"""

ORACLES = {"op2_bbit_minhash": OP2, "op5_warc_revisits": OP5, "op8_capped_mixing": OP8, "op11_ball_tree_search": OP11, "op12_fill_in_middle": OP12, "op13_pigeonhole_join": OP13}
