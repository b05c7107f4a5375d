"""DuckDB twins of the operators on vectors and phrases."""

#: Whole cosine self-join of equal labels, and reachability over its links.
OP11_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id, vec_id AS low FROM embeddings UNION SELECT p.u, r.low FROM r JOIN p ON p.v = r.vec_id
), c AS (SELECT vec_id, min(low) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM p GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n ON n.u = e.vec_id
"""


def _round(k: int) -> str:
    """Assignment of every part to the codebook of round k, and what the entries become by it."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT x.vec_id, x.part, min({{'d': list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}}) AS best
  FROM x JOIN b{k} b ON b.part = x.part GROUP BY x.vec_id, x.part
), s{k} AS (
  SELECT part, entry, list(((s - ((s % n) + n) % n) // n) ORDER BY i) AS c FROM (
    SELECT x.part, a.best.e AS entry, i, sum(x.x[i]) AS s, count(*) AS n FROM a{k} a JOIN x USING (vec_id, part), generate_series(1, len(x.x)) g(i) GROUP BY ALL
  ) GROUP BY part, entry
), b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(s.c, b.c) AS c FROM b{k} b LEFT JOIN s{k} s USING (part, entry)),"""


OP12_SQL = (
    """
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM k, range(4) g(part)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM x QUALIFY entry < 256
),"""
    + "".join(map(_round, range(4)))
    + """
a4 AS MATERIALIZED (
  SELECT x.vec_id, x.part, min({'d': list_sum(list_transform(list_zip(x.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.entry}) AS best
  FROM x JOIN b4 b ON b.part = x.part GROUP BY x.vec_id, x.part
), o AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT k.vec_id, o.code, o.error, CAST(sum(o.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN o USING (vec_id), h
"""
)

OP13_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents
), g AS (
  SELECT lang, w[i : i + size - 1] AS ws FROM p, range(1, 5) s(size), generate_series(1, len(w) - size + 1) t(i)
), f AS MATERIALIZED (SELECT lang, len(ws) AS size, ws, array_to_string(ws, ' ') AS phrase, count(*) AS a FROM g GROUP BY lang, ws),
t AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE size > 1 AND a >= 30),
cut AS (
  SELECT c.lang, c.ws, c.phrase, c.a, min({'score': CAST((2000000 * CAST(c.a AS HUGEINT)) // (h.a + r.a) AS BIGINT), 'k': k, 'l': h.a, 'r': r.a}) AS b
  FROM c, generate_series(1, c.size - 1) s(k) JOIN f h ON h.lang = c.lang AND h.ws = c.ws[1 : k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1 : c.size]
  GROUP BY c.lang, c.ws, c.phrase, c.a
), sub AS (
  SELECT c.lang, c.ws[i : i + m - 1] AS ws, max(c.a) AS whole FROM c, range(2, 4) s(m), generate_series(1, c.size - m + 1) t(i) WHERE m < c.size GROUP BY ALL
), kept AS (
  SELECT cut.* FROM cut LEFT JOIN sub USING (lang, ws) WHERE sub.whole IS NULL OR 100 * sub.whole < 80 * cut.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score
FROM kept JOIN t USING (lang) QUALIFY rank <= 2000
"""
