"""DuckDB twins of the link-graph stage: levels by recursion, ranks by unrolled rounds."""

from __future__ import annotations

#: Rounds of PageRank that are unrolled; the first that moves less than the tolerance is chosen, the last if none does.
ROUNDS = 24


def ranks(rounds: int = ROUNDS) -> str:
    """CTEs up to ``f(node, r)`` over ``n(node)`` and ``e(s, t)``, distinct edges between nodes without loops."""
    steps = ["d AS MATERIALIZED (SELECT s, count(*) AS d FROM e GROUP BY s), c AS (SELECT count(*) AS c FROM n), w AS MATERIALIZED (SELECT e.s, e.t, 1.0::DOUBLE / d.d AS w FROM e JOIN d ON d.s = e.s), p0 AS (SELECT node, 1.0::DOUBLE / c AS r FROM n, c)"]
    for k in range(rounds):
        steps.append(
            f"p{k + 1} AS MATERIALIZED (SELECT n.node, 0.15 / c + 0.85 * (coalesce(g.x, 0) + (SELECT coalesce(sum(r), 0) FROM p{k} WHERE node NOT IN (SELECT s FROM d)) / c) AS r FROM n CROSS JOIN c LEFT JOIN (SELECT w.t AS node, sum(p.r * w.w) AS x FROM w JOIN p{k} p ON p.node = w.s GROUP BY w.t) g ON g.node = n.node)"
        )
    steps.append("u AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k + 1} AS k, node, p{k + 1}.r AS r, abs(p{k + 1}.r - p{k}.r) AS moved FROM p{k + 1} JOIN p{k} USING (node)" for k in range(rounds)) + ")")
    steps.append(f"f AS MATERIALIZED (SELECT node, r FROM u WHERE k = coalesce((SELECT min(k) FROM (SELECT k, sum(moved) AS m FROM u GROUP BY k) WHERE m < 1e-6), {rounds}))")
    return ", ".join(steps)


SCORE = "round((r - (SELECT min(r) FROM f)) / coalesce(nullif((SELECT max(r) - min(r) FROM f), 0), 1) * 100, 2)"


def captured(pages: str, links: str, most: int = 60, rounds: int = ROUNDS) -> str:
    """url, depth, score and unique_inlinks of the distinct URLs of ``pages`` (page_id, url), linked by ``links`` (source_url, target_url, is_internal)."""
    host, path = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))", "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"
    return f"""WITH RECURSIVE n AS MATERIALIZED (SELECT DISTINCT url AS node FROM {pages}),
e AS MATERIALIZED (SELECT DISTINCT source_url AS s, target_url AS t FROM {links} WHERE is_internal AND source_url <> target_url AND target_url IN (SELECT node FROM n) AND source_url IN (SELECT node FROM n)),
first AS (SELECT arg_min(url, {{'deep': {path} NOT IN ('', '/'), 'id': page_id}}) AS node FROM {pages} GROUP BY {host}),
levels AS (SELECT node, 0 AS depth FROM first UNION SELECT e.t, depth + 1 FROM levels JOIN e ON e.s = levels.node WHERE depth < {most}),
least AS (SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM levels GROUP BY node), {ranks(rounds)}
SELECT f.node AS url, least.depth, {SCORE} AS score, (SELECT count(*) FROM e WHERE e.t = f.node) AS unique_inlinks, NOT EXISTS (SELECT 1 FROM e WHERE e.t = f.node) AND NOT EXISTS (SELECT 1 FROM first WHERE first.node = f.node) AS is_orphan FROM f LEFT JOIN least USING (node)"""
