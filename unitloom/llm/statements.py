"""SQL statements for the queries that need more than a line or two."""

# Components of `links(a, b)` over `nodes(id)`, as `comp(id, component_id)`.
COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT id, id FROM nodes UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0
), links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_sum(list_transform(list_zip(p.x, q.x), lambda z: z[1] * z[2]))
    / sqrt(list_sum(list_transform(p.x, lambda c: c * c)) * list_sum(list_transform(q.x, lambda c: c * c))) >= 0.93
), nodes AS (SELECT DISTINCT vec_id AS id FROM embeddings), {COMPONENTS},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, comp.component_id, e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp ON e.vec_id = comp.id LEFT JOIN n ON e.vec_id = n.a
"""

# Candidates share one of the rarest shingles that a set cannot do without at this similarity.
NEAR_DOCUMENTS = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 1 THEN [ws[1]] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh FROM w
  )
), f AS (SELECT sh, count(*) AS df FROM s GROUP BY sh),
r AS (
  SELECT doc_id, s.sh, row_number() OVER (PARTITION BY doc_id ORDER BY df, s.sh) AS place, count(*) OVER (PARTITION BY doc_id) AS n
  FROM s JOIN f ON s.sh = f.sh
), p AS (SELECT * FROM r WHERE place <= n - (4 * n + 4) // 5 + 1),
c AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.sh = y.sh AND x.doc_id < y.doc_id),
i AS (
  SELECT a, b, any_value(na) AS na, any_value(nb) AS nb, count(*) AS k
  FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.sh = x.sh GROUP BY a, b
), links AS (SELECT a, b FROM i WHERE 100 * k >= 80 * (na + nb - k)),
nodes AS (SELECT doc_id AS id FROM documents), {COMPONENTS},
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
SELECT comp.id AS doc_id, coalesce(z.n, 0) AS n_shingles, component_id, comp.id = component_id AS kept
FROM comp LEFT JOIN z ON z.doc_id = comp.id
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(len(h) // 2)) AS i FROM d WHERE len(h) > 0),
win AS (
  SELECT doc_id, i, CASE WHEN len(h) // 2 - i >= 100 THEN md5(substr(h, 2 * i + 1, 200)) END AS s, substr(h, 2 * i + 1, 2) AS byte FROM b
), late AS (
  SELECT doc_id, i, byte, CASE WHEN s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS late FROM win
), gone AS (
  SELECT doc_id, i, byte, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM late
), edge AS (SELECT *, lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM gone),
g AS (
  SELECT doc_id, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) FILTER (gone = 1 AND before = 0) AS n_spans,
    coalesce(string_agg(byte, '' ORDER BY i) FILTER (gone = 0), '') AS kept
  FROM edge GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

FILTER_AUDIT = """
WITH RECURSIVE orders(o) AS (
  SELECT '' UNION ALL SELECT o || x FROM orders, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o, CAST(step AS INTEGER) AS step, substr(o, 1, step - 1) AS before, substr(o, step, 1) AS f
  FROM (SELECT o, unnest(range(1, 6)) AS step FROM orders WHERE length(o) = 5)
), d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), m AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
f AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN least < d.doc_id THEN 'E' ELSE '' END AS fails,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN m ON d.t = m.t LEFT JOIN l ON d.doc_id = l.doc_id
), g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
s AS (
  SELECT part, o, step, f, sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM g, steps GROUP BY part, o, step, f
)
SELECT part, o AS filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM s
"""


def vector_codes(parts, entries, rounds):
    """Plain Lloyd rounds over all entries; doubles hold the integers exactly."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""c{k} AS MATERIALIZED (
  SELECT vec_id, p.part, arg_min(entry, (xx - 2 * list_dot_product(x, y) + yy, entry)) AS entry, min(xx - 2 * list_dot_product(x, y) + yy) AS gap
  FROM p JOIN b{k} b ON p.part = b.part GROUP BY vec_id, p.part
)""")
        if k < rounds:
            steps.append(f"""m{k} AS MATERIALIZED (
  SELECT part, entry, list(v ORDER BY i) AS y FROM (
    SELECT part, entry, i, floor(sum(v) / count(*)) AS v
    FROM (SELECT c.part, c.entry, unnest(range(len(x))) AS i, unnest(x) AS v FROM c{k} c JOIN p ON c.vec_id = p.vec_id AND c.part = p.part)
    GROUP BY part, entry, i
  ) GROUP BY part, entry
), b{k + 1} AS MATERIALIZED (
  SELECT part, entry, y, list_dot_product(y, y) AS yy FROM (
    SELECT b.part, b.entry, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry
  )
)""")
    return f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * CAST(c AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), p AS MATERIALIZED (
  SELECT *, list_dot_product(x, x) AS xx FROM (
    SELECT vec_id, k AS part, q[k * len(q) // {parts} + 1 : (k + 1) * len(q) // {parts}] AS x FROM (SELECT vec_id, q, unnest(range({parts})) AS k FROM v)
  )
), b0 AS MATERIALIZED (
  SELECT part, entry, x AS y, xx AS yy FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries}
), {", ".join(steps)},
e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(gap) AS BIGINT) AS error FROM c{rounds} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(y, lambda c: CAST(CAST(c AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS h FROM b{rounds})
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM e JOIN v ON e.vec_id = v.vec_id, s
"""


WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT t, max(page_id) AS first FROM p GROUP BY t)
SELECT page_id, CAST(strlen(p.t) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, (i // 8) * 10 + 1, 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p JOIN g ON p.t = g.t
"""
