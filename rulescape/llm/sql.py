"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .spotsigs import ANCHORS

OP5 = r"""
WITH RECURSIVE sized AS MATERIALIZED (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE concat('0', source) END AS k,
         md5(concat('0:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS draw,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
src AS MATERIALIZED (
  SELECT k, sum(size)::HUGEINT AS s, 2 * sum(size)::HUGEINT AS cap,
         ([5, 2, 1])[CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS BIGINT)]::HUGEINT AS w FROM sized GROUP BY k),
-- every round clamps the sources above their cap and shares the rest again
rounds(i, held) AS (
  SELECT 0, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT i + 1, list_concat(held, (
      SELECT list(k ORDER BY k) FROM src WHERE NOT list_contains(held, k)
        AND cap * 2 * (SELECT sum(w) FROM src WHERE NOT list_contains(held, k))
            <= (3 * (SELECT sum(s) FROM src) - 2 * coalesce((SELECT sum(cap) FROM src WHERE list_contains(held, k)), 0)) * w))
  FROM rounds
  WHERE i < 1000 AND EXISTS (
      SELECT 1 FROM src WHERE NOT list_contains(held, k)
        AND cap * 2 * (SELECT sum(w) FROM src WHERE NOT list_contains(held, k))
            <= (3 * (SELECT sum(s) FROM src) - 2 * coalesce((SELECT sum(cap) FROM src WHERE list_contains(held, k)), 0)) * w)),
final AS (SELECT held FROM rounds ORDER BY i DESC LIMIT 1),
goal AS MATERIALIZED (
  SELECT k, s, CASE WHEN list_contains((SELECT held FROM final), k) THEN cap::DOUBLE
    ELSE ((3 * (SELECT sum(s) FROM src)
           - 2 * coalesce((SELECT sum(cap) FROM src WHERE list_contains((SELECT held FROM final), k)), 0)) * w)::DOUBLE
         / (2 * (SELECT sum(w) FROM src WHERE NOT list_contains((SELECT held FROM final), k)))::DOUBLE END AS target FROM src),
plan AS (SELECT *, floor(target)::HUGEINT AS words, CASE WHEN s > 0 THEN floor(target)::HUGEINT // s ELSE 0 END AS whole FROM goal),
drawn AS (
  SELECT d.*, p.s, p.target, p.whole, p.words - p.whole * p.s AS rest,
         sum(size) OVER (PARTITION BY d.k ORDER BY draw) AS upto,
         sum(size) OVER (PARTITION BY d.k, draw) AS unit
  FROM sized d JOIN plan p ON p.k = d.k)
SELECT doc_id, size, s::BIGINT AS source_size, target,
       (whole * size + CASE WHEN upto <= rest THEN size WHEN upto - unit >= rest THEN 0
          ELSE size::HUGEINT * (rest - (upto - unit))::HUGEINT // unit::HUGEINT END)::BIGINT AS taken
FROM drawn
"""

OP9 = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
         embedding IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
         AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x : x <> 0)) > 0 AS usable FROM embeddings),
link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.usable AND b.usable AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.a = v.vec_id) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp USING (vec_id)
"""

_OP3 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')) DESC) AS r, doc_id, coalesce(text, '') AS text FROM documents),
e AS MATERIALIZED (
  SELECT a.r, a.doc_id, a.text, length(a.text) AS n,
         concat(substr(a.text, 1, length(a.text) - length(a.text) // 3), substr(b.text, 1, length(a.text) // 3)) AS edited
  FROM d a JOIN d b ON b.r = a.r % (SELECT max(r) FROM d) + 1),
texts AS MATERIALIZED (SELECT r, 0 AS kind, text AS t FROM e UNION ALL SELECT r, 1, edited FROM e),
word AS MATERIALIZED (
  SELECT r, kind, i, w, w IN (ANCHORS) AS common
  FROM (SELECT r, kind, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
        FROM (SELECT r, kind, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS ws FROM texts))),
-- the content words at or after each place, by counting those before it
counted AS MATERIALIZED (
  SELECT *, count(*) FILTER (NOT common) OVER (PARTITION BY r, kind ORDER BY i) AS c FROM word),
content AS MATERIALIZED (SELECT r, kind, c, w FROM counted WHERE NOT common),
sig AS (
  SELECT DISTINCT a.r, a.kind, substr(md5(concat(a.w, ':', x.w, ':', y.w)), 1, 8) AS s
  FROM counted a JOIN content x ON x.r = a.r AND x.kind = a.kind AND x.c = a.c + 1
  JOIN content y ON y.r = a.r AND y.kind = a.kind AND y.c = a.c + 2 WHERE a.common),
sets AS MATERIALIZED (
  SELECT t.r, t.kind, CASE WHEN t.t = '' THEN CAST([] AS VARCHAR[]) ELSE coalesce(g.s, [substr(md5(t.t), 1, 8)]) END AS s
  FROM texts t LEFT JOIN (SELECT r, kind, list(s ORDER BY s) AS s FROM sig GROUP BY ALL) g ON g.r = t.r AND g.kind = t.kind),
trio AS (
  SELECT e.*, a.s AS own, b.s AS changed, c.s AS following FROM e
  JOIN sets a ON a.r = e.r AND a.kind = 0 JOIN sets b ON b.r = e.r AND b.kind = 1
  JOIN sets c ON c.r = e.r % (SELECT max(r) FROM d) + 1 AND c.kind = 0)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, array_to_string(own, '') AS fingerprint,
  array_to_string(changed, '') AS edited_fingerprint,
  CASE WHEN len(own) = 0 AND len(changed) = 0 THEN 1.0::DOUBLE WHEN len(own) = 0 OR len(changed) = 0 THEN 0.0::DOUBLE
    ELSE len(list_intersect(own, changed))::DOUBLE / (len(own) + len(changed) - len(list_intersect(own, changed))) END AS near_edited,
  CASE WHEN len(own) = 0 AND len(following) = 0 THEN 1.0::DOUBLE WHEN len(own) = 0 OR len(following) = 0 THEN 0.0::DOUBLE
    ELSE len(list_intersect(own, following))::DOUBLE / (len(own) + len(following) - len(list_intersect(own, following))) END AS near_next
FROM trio
"""
OP3 = _OP3.replace("ANCHORS", ", ".join(f"'{w}'" for w in ANCHORS))



def _op11(k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2) -> str:
    """Every round spelled out: distances to all centroids, then floored means."""
    parts = [f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x : CAST(floor({scale} * x) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dim}
    AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY draw, x) - 1 AS c, x FROM (
    SELECT sha256(concat('{seed}:', coalesce(CAST(vec_id AS VARCHAR), 'null'))) AS draw, x FROM v ORDER BY draw, x LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, best.c AS c, best.d AS d FROM (
    SELECT v.r, min({{'d': CAST(list_sum(list_transform(list_zip(v.x, c{i}.x), lambda p : (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), 'c': c{i}.c}}) AS best
    FROM v CROSS JOIN c{i} GROUP BY v.r))""")
        if i < rounds:
            parts.append(f"""
m{i} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT c, i, sum(e) AS s, count(*) AS n FROM (
      SELECT a{i}.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM a{i} JOIN v ON v.r = a{i}.r) GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return ",".join(parts) + f"""
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c
"""


OP11 = _op11()

OP13 = r"""
WITH RECURSIVE run AS MATERIALIZED (
  SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  GROUP BY ALL),
-- crc32 bit by bit over the UTF-8 bytes of id:run
hashed AS MATERIALIZED (
  SELECT run, times, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(flatten(list_transform(
      string_split(concat(id, ':', run), ''),
      lambda c : CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END)), lambda b : b::BIGINT)),
    lambda h, b : list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z : CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))
    AS h FROM run),
word AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, times FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
gap AS MATERIALIZED (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word AS a, b.word AS b FROM gap a JOIN gap b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT g.word, w.word FROM gap g JOIN word w ON w.word = g.rest
  UNION SELECT w.word, g.word FROM gap g JOIN word w ON w.word = g.rest),
ranked AS (
  SELECT a, count(*) OVER (PARTITION BY a) AS n_near, b, w.n AS n,
         row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS place FROM near JOIN word w ON w.word = b),
told AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.b END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM word w LEFT JOIN ranked r ON r.a = w.word AND r.place = 1),
chain(word, reached, form) AS (
  SELECT word, word, form FROM told UNION ALL SELECT c.word, t.word, t.form FROM chain c JOIN told t ON t.word = c.form)
SELECT t.word, t.form, c.reached AS root, t.n, t.n_near, t.form_n FROM told t JOIN chain c ON c.word = t.word AND c.form IS NULL
"""

ORACLES = {"op3_spotsigs": OP3, "op5_mixing": OP5, "op9_vector_dedup": OP9, "op11_centroids": OP11, "op13_variants": OP13}
