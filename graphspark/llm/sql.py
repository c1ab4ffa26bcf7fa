"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH RECURSIVE rules(verdict, rule) AS (
  VALUES ('allow', 'org/'), ('block', 'example.org/es/'), ('block', 'example.org/en/1'), ('allow', 'com/fr/'), ('block', 'com/de/')
), parsed AS (
  SELECT page_id, url, html,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    regexp_replace(url, '#.*$', '', 's') AS k
  FROM pages
), tags AS (
  SELECT url, path, k,
    regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'i'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'i') AS t
  FROM parsed WHERE contains(url, '://')
  UNION ALL
  SELECT url, path, k,
    regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'i'), '\burl\s*=\s*["'']?([^"''\s>;]+)', 1, 'i') AS t
  FROM parsed WHERE contains(url, '://')
), edges AS (
  SELECT k AS a, regexp_replace(CASE
    WHEN contains(t, '://') THEN t
    WHEN starts_with(t, '//') THEN regexp_extract(url, '^(.*?)://', 1, 's') || ':' || t
    WHEN starts_with(t, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || t
    ELSE regexp_extract(url, '^(.*?://[^/?#]*)', 1, 's') || coalesce(nullif(regexp_extract(path, '^(.*/)', 1, 's'), ''), '/') || t
  END, '#.*$', '', 's') AS b
  FROM tags WHERE t <> ''
), sym AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach(k, other) AS (
  SELECT a, a FROM sym UNION SELECT r.k, s.b FROM reach r JOIN sym s ON r.other = s.a
), urls AS (
  SELECT k, host, path FROM parsed WHERE k IS NOT NULL
  UNION
  SELECT other,
    translate(regexp_extract(other, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    regexp_extract(other, '^.*?://[^/?#]*([^?#]*)', 1, 's')
  FROM reach
), fits AS (
  SELECT u.k, u.host, u.path, r.rule, r.verdict,
    row_number() OVER (PARTITION BY u.k, u.host, u.path ORDER BY length(r.rule) DESC) AS n
  FROM urls u JOIN rules r
    ON (u.host = split_part(r.rule, '/', 1) OR ends_with(u.host, '.' || split_part(r.rule, '/', 1)))
   AND starts_with(u.path, substr(r.rule, length(split_part(r.rule, '/', 1)) + 1))
), judged AS (
  SELECT k, host, path, rule, verdict FROM fits WHERE n = 1
), alias AS (
  SELECT r.k, min(j.verdict) AS verdict FROM reach r JOIN judged j ON r.other = j.k GROUP BY r.k
)
SELECT p.page_id, p.host, p.path, j.rule, coalesce(j.verdict, a.verdict, 'allow') AS verdict
FROM parsed p
LEFT JOIN judged j ON p.k = j.k AND p.host = j.host AND p.path = j.path
LEFT JOIN alias a ON p.k = a.k
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n_links FROM links GROUP BY a
)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, low.component_id, v.vec_id = low.component_id AS kept
FROM v JOIN low ON low.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

#: The places of the base phrases among a text's words; -1 for none.
LICENSE_BASE = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, len(w) AS n,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS a,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS b,
    list_filter(range(1, len(w) + 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS c FROM t
)
SELECT doc_id, n AS n_words, len(a) + len(b) + len(c) AS n_base, coalesce(list_min(list_concat(a, b, c)) - 1, -1) AS first_word, coalesce(list_max(list_concat(a, b, c)) - 1, -1) AS last_word,
  array_to_string(list_filter([CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END], lambda x: x IS NOT NULL), ',') AS base_labels FROM p
"""

PII_COUNTS = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS e, regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS i,
    list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([ -]?[0-9])+'), lambda m: regexp_extract_all(m, '[0-9]')) AS c,
    list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][ ().0-9-]+[0-9]'), lambda m: len(regexp_extract_all(m, '[0-9]'))) AS p FROM documents
)
SELECT doc_id, len(e) AS n_email, len(list_filter(i, lambda m: list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255)) AS n_ip,
  len(list_filter(c, lambda d: len(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(d) + 1), lambda k: CASE WHEN (len(d) - k) % 2 = 0 THEN CAST(d[k] AS INTEGER)
    ELSE (2 * CAST(d[k] AS INTEGER)) // 10 + (2 * CAST(d[k] AS INTEGER)) % 10 END)) % 10 = 0)) AS n_card,
  len(list_filter(p, lambda k: k BETWEEN 9 AND 15)) AS n_phone FROM t
"""

OP13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), k AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(h, i, 8) AS UBIGINT)) AS g FROM t
), c AS (
  SELECT doc_id, text, w, CAST(len(w) AS BIGINT) AS n, least(g[1] % (len(w) + 1), g[2] % (len(w) + 1)) AS lo, greatest(g[1] % (len(w) + 1), g[2] % (len(w) + 1)) AS hi,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(w[1:lo], ''), '') AS a, coalesce(array_to_string(w[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(w[hi + 1:n], ''), '') AS z FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || m ELSE '<S>' || z || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

WHITENING_BASE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * c::DOUBLE) AS HUGEINT) + 1000000) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), e AS (
  SELECT row_number() OVER () AS r, vec_id, x FROM v
), u AS (
  SELECT r, vec_id, unnest(x) AS x, unnest(range(len(x))) AS i FROM e
), s AS (
  SELECT i, sum(x) AS s, count(*) AS n FROM u GROUP BY i
)
SELECT any_value(u.vec_id) AS vec_id, CAST(any_value(s.n) AS BIGINT) AS n, CAST(sum((s.n * u.x - s.s) * (s.n * u.x - s.s)) AS BIGINT) AS deviation
FROM u JOIN s USING (i) GROUP BY u.r
"""
