"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

OP8 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sums),
limited AS (SELECT *, CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS lim FROM weighed),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM limited WINDOW b AS (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN lim >= level THEN max(CASE WHEN lim >= level THEN level END) OVER () * CAST(weight AS DOUBLE)
              ELSE CAST(3 * source_size AS DOUBLE) END AS target
  FROM levels),
plan AS (
  SELECT *, floor(r) AS certain, greatest(1e-9::DOUBLE, least(1::DOUBLE - 1e-9::DOUBLE, r - floor(r))) AS p,
         target - floor(r) * source_size AS need
  FROM (SELECT *, CASE WHEN source_size = 0 THEN 0::DOUBLE ELSE target / source_size END AS r FROM targets)),
odds AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target, t.certain, t.need, (s.u / (1 - s.u)) / (t.p / (1 - t.p)) AS q
  FROM sized s JOIN plan t ON s.source IS NOT DISTINCT FROM t.source),
ranked AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id NULLS FIRST, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed
  FROM odds),
drawn AS (SELECT *, CASE WHEN source_size > 0 AND passed + size <= need THEN 1 ELSE 0 END AS extra FROM ranked),
r0 AS (SELECT *, need - sum(size * extra) OVER (PARTITION BY source) AS gap FROM drawn),
{rounds}
SELECT doc_id, size, source_size, target, CAST(certain AS INTEGER) + extra AS copies,
       CAST((CAST(certain AS INTEGER) + extra) * size AS BIGINT) AS taken
FROM r3
"""
#: In each round the untaken document of a source whose size is closest to the gap is taken.
ROUND = """
k{n} AS (SELECT *, CASE WHEN extra = 0 AND size > 0 AND size < 2 * gap AND 1 = row_number() OVER (
           PARTITION BY source, extra = 0 AND size > 0 AND size < 2 * gap ORDER BY abs(size - gap), q, doc_id NULLS FIRST)
         THEN 1 ELSE 0 END AS pick FROM r{m}),
r{n} AS (SELECT * EXCLUDE (extra, gap, pick), extra + pick AS extra, gap - sum(size * pick) OVER (PARTITION BY source) AS gap FROM k{n})"""
OP8 = OP8.replace("{rounds}", ",".join(ROUND.replace("{n}", str(n)).replace("{m}", str(n - 1)) for n in (1, 2, 3)))

ORACLE = {"op8_mixing": OP8}

OP11 = """
WITH k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, v, list_dot_product(v, v) AS vv
  FROM (SELECT vec_id, label, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS v FROM k, (SELECT unnest([0, 1, 2, 3]) AS part))),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c
  FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT 256)),
{rounds}
a4 AS MATERIALIZED ({assign4}),
coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM a4 GROUP BY vec_id, label),
book AS (SELECT string_agg(CAST(CAST(u AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i) AS t
         FROM (SELECT part, entry, unnest(c) AS u, generate_subscripts(c, 1) AS i FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha256(t) AS codebooks_sha256 FROM coded, book
"""
ASSIGN = """
  SELECT p.vec_id, p.label, p.part, any_value(p.v) AS v, min(d * 256 + entry) % 256 AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.label, p.part, p.v, b.entry, CAST(p.vv - 2 * list_dot_product(p.v, b.c) + list_dot_product(b.c, b.c) AS BIGINT) AS d
        FROM p JOIN b{n} b ON p.part = b.part) p
  GROUP BY p.vec_id, p.label, p.part"""
MOVE = """
a{m} AS MATERIALIZED ({assign}),
s{m} AS (SELECT part, entry, i, floor(sum(u) / count(*)) AS mean
         FROM (SELECT part, entry, unnest(v) AS u, generate_subscripts(v, 1) AS i FROM a{m}) GROUP BY part, entry, i),
b{n} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(s.c, b.c) AS c
  FROM b{m} b LEFT JOIN (SELECT part, entry, list(mean ORDER BY i) AS c FROM s{m} GROUP BY part, entry) s ON b.part = s.part AND b.entry = s.entry),"""
ROUNDS11 = "".join(MOVE.replace("{assign}", ASSIGN.replace("{n}", str(m))).replace("{n}", str(m + 1)).replace("{m}", str(m)) for m in range(4))
OP11 = OP11.replace("{rounds}", ROUNDS11).replace("{assign4}", ASSIGN.replace("{n}", "4"))
ORACLE["op11_vector_codes"] = OP11

OP13 = r"""
WITH words AS (
  SELECT doc_id, place AS d, w FROM (
    SELECT doc_id, row_number() OVER () AS place,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents)),
lengths AS (SELECT d, count(*) AS n FROM words GROUP BY d),
total AS (SELECT count(*) AS every, CAST(sum(n) AS BIGINT) AS L FROM lengths),
tfs AS (SELECT any_value(doc_id) AS doc_id, d, w, count(*) AS tf FROM words GROUP BY d, w),
dfs AS (SELECT w, count(*) AS df FROM tfs GROUP BY w),
asked AS (
  SELECT DISTINCT k, item_id, w FROM (
    SELECT item_id, row_number() OVER () AS k,
           unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark)),
weighed AS (SELECT a.k, a.item_id, a.w, CAST(floor(1000 * ln(CAST(2 * every + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM asked a JOIN dfs USING (w), total),
scored AS (
  SELECT k, any_value(item_id) AS item_id, d, any_value(doc_id) AS doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * every) // L)))) AS BIGINT) AS score
  FROM weighed JOIN tfs USING (w) JOIN lengths USING (d), total GROUP BY k, d),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
ORACLE["op13_ranked_search"] = OP13

OP12 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
f AS (SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (
        SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS fresh FROM f)),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT d.r, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed,
               string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
        FROM gaps JOIN d USING (r) GROUP BY d.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""
ORACLE["op12_suffix_dedup"] = OP12
