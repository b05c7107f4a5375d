"""Connected components of an edge table: the smallest node reachable from each node.

Alternates two star steps until no edge changes. A step sends every node's neighbours to the smallest of them,
so the number of rounds grows with the logarithm of the longest chain. Minima are aggregated, written and
joined back from the table, so both sides of the join are plain exchanges and AQE can split the edges of a node with
very many neighbours; each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.materialize import drop_materialized, materialize

def _stats(edges: DataFrame) -> tuple:
    """Changes with any changed edge: the count, and two sums over digests of the edges."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    r = edges.agg(F.count("*").alias("n"), F.sum(h).alias("s"), F.bit_xor(F.xxhash64("v", "u")).alias("x")).first()
    return r.n, r.s, r.x


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges`` has long columns u and v. Returns node and component, for nodes that have an edge to another.

    Loops, repeated and reversed edges, and nulls (which link nothing) are allowed; no edges give no rows. ``rows`` is about how many edges there are at most, if that is known.
    """
    now = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v").distinct()
    now = materialize(now, "edges", rows)
    last = _stats(now)
    rows = last[0]
    if not rows:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # Large star: each node sends its larger neighbours to the smallest of its neighbourhood.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low", rows)
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large", rows)
        # Small star: each node and its smaller neighbours go to the smallest of them.
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low", rows)
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = materialize(small.where("u <> v").distinct(), "small", rows)
        stats = _stats(new)
        for used in (now, large, low, least):
            drop_materialized(used)
        now = new
        if stats == last or not stats[0]:
            break
        last = stats
    named = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return named.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
