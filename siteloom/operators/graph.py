"""Iterative link-graph operators. Loops run on the driver, rows stay in Spark; lineage is cut through shared storage."""

from __future__ import annotations

import functools
import itertools
import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.materialize import discard, drop_materialized, materialize, shared_dir


def internal_edges(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges s, t between known nodes, without loops."""
    e = links.select("s", "t").where("s <> t").distinct()
    return e.join(nodes.select(F.col("node").alias("s")), "s", "left_semi").join(nodes.select(F.col("node").alias("t")), "t", "left_semi")


def bucketed(edges: DataFrame, column: str, label: str) -> tuple[DataFrame, str]:
    """``edges`` written once in buckets of ``column``, so that no round shuffles them; the frame and the name of its table."""
    spark = edges.sparkSession
    name, count = f"siteloom_{label}_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{shared_dir(spark)}/{name}"
    edges.repartition(count, column).write.bucketBy(count, column).option("path", path).saveAsTable(name)
    return spark.table(name), name


class EdgeTable:
    """Distinct edges s, t between known nodes with the weight 1 / outgoing edges, in buckets of s; several operators can share it until it is dropped.

    ``rows`` also has an edge of each node to itself, without a weight; ``frame`` has the others.
    """

    def __init__(self, nodes: DataFrame, links: DataFrame):
        self.spark = nodes.sparkSession
        nodes = nodes.select("node").distinct()
        edges = internal_edges(links, nodes)
        self.degree = edges.groupBy("s").agg(F.count("*").alias("d"))
        own = nodes.where("node is not null").select(F.col("node").alias("s"), F.col("node").alias("t"), F.lit(None).cast("double").alias("w"))
        self.rows, self.name = bucketed(edges.join(self.degree, "s").select("s", "t", (1.0 / F.col("d")).alias("w")).unionByName(own), "s", "edges")
        self.frame = self.rows.where("s <> t")
        self.degree = self.frame.groupBy("s").agg(F.count("*").alias("d"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        discard(self.spark, f"{shared_dir(self.spark)}/{self.name}")


def url_dictionary(urls: DataFrame, column: str = "url") -> DataFrame:
    """url and id: dense ids from 0 in the order of the distinct URLs. Tasks number their own range; only the sizes of ranges come to the driver."""
    ordered = urls.select(F.col(column).alias("url")).where("url is not null").distinct().repartitionByRange("url").sortWithinPartitions("url")
    placed = materialize(ordered.withColumn("place", F.monotonically_increasing_id()), "urls")
    starts, at = [], 0
    for r in placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        starts.append((r["part"], at))
        at += r["n"]
    starts = placed.sparkSession.createDataFrame(starts, "part long, start long")  # a row for each partition
    numbered = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(starts), "part")
    return numbered.select("url", (F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("id"))


#: Rounds of PageRank between two looks at what they moved.
BLOCK = 6


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, table: EdgeTable | None = None, digits: int = 2) -> DataFrame:
    """node, rank (sums to 1) and score (scaled to 0..100 and rounded to ``digits``).

    ``nodes`` has node, ``links`` s and t. The mass of nodes without outgoing edges is spread evenly. Stops after ``rounds`` or,
    with a tolerance, after the first round in which ranks change by less in sum. Edges are written once with their weight in buckets of their source. What a node gets evenly is
    one number a round, so a block of rounds only sends ranks along the edges, one join and one shuffle each and one written table for all; their even parts are added afterwards, as multiples of what
    ones sent along the edges come to. A node's edge to itself carries what it had in the rounds before.
    """
    nodes = nodes.select("node").distinct()
    shared, table = table is not None, table or EdgeTable(nodes, links)
    degree = table.degree
    state = materialize(nodes.join(degree.select(F.col("s").alias("node"), F.lit(False).alias("dangling")), "node", "left").withColumn("dangling", F.coalesce("dangling", F.lit(True))), "nodes")
    begun = state.agg(F.count("*").alias("n"), F.count_if("dangling").alias("lost")).first()
    n = begun["n"]
    if not n:
        if not shared:
            table.drop()
        return state.select("node", F.lit(0.0).alias("rank"), F.lit(0.0).alias("score"))
    # ones[j]: what ones come to after j rounds along the edges; idle[j]: its sum over nodes without outgoing edges.
    held, rank, ones, idle, lost, done = state, F.lit(1.0 / n), [F.lit(1.0)], [float(begun["lost"])], begun["lost"] / n, 0
    sums = {"lo": 1.0 / n, "hi": 1.0 / n}
    while done < rounds:
        size, at = min(BLOCK, rounds - done), held.select(F.col("node").alias("s"), rank.alias("y0"))
        for j in range(size):
            own = [F.sum(F.when(F.col("s") == F.col("t"), F.col(f"y{i}"))).alias(f"y{i}") for i in range(j + 1)]
            got = F.coalesce(F.sum(F.when(F.col("s") != F.col("t"), F.col(f"y{j}") * F.col("w"))) * damping, F.lit(0.0)).alias(f"y{j + 1}")
            at = table.rows.join(at, "s").groupBy("t").agg(*own, got).withColumnRenamed("t", "s")
        by_node = at.withColumnRenamed("s", "node")
        first, kept = held is state, [f"v{j}" for j in range(1, len(ones))]
        wide = held.select("node", "dangling", *kept).join(by_node, "node")
        if first:
            kept = [f"v{j}" for j in range(1, size)]
            wide = wide.select("*", *[(F.col(f"y{j}") * n).alias(f"v{j}") for j in range(1, size)])
        wide = materialize(wide, "ranks", n)
        drop_materialized(held)
        mass = wide.where("dangling").agg(*[F.sum(c).alias(c) for c in (*kept, *[f"y{j}" for j in range(1, size)], "y0")]).first()
        if first:
            ones += [F.col(c) for c in kept]
            idle += [mass[c] or 0.0 for c in kept]
        even, after = [], [F.col("y0")]
        for j in range(size):
            lost = (mass[f"y{j}"] or 0.0) + sum(c * idle[j - 1 - i] for i, c in enumerate(even))
            even.append((1 - damping + damping * lost) / n)
            after.append(functools.reduce(Column.__add__, [F.col(f"y{j + 1}"), *[F.lit(c) * ones[j - i] for i, c in enumerate(even)]]))
        moved = wide.agg(*[f(x).alias(f"{name}{j}") for j in range(1, size + 1) for name, f, x in (("moved", F.sum, F.abs(after[j] - after[j - 1])), ("lo", F.min, after[j]), ("hi", F.max, after[j]))]).first()
        last = next((j for j in range(1, size + 1) if tolerance is not None and moved[f"moved{j}"] < tolerance), 0)
        held, rank, done, sums = wide, after[last or size], done + size, {k: moved[f"{k}{last or size}"] for k in ("lo", "hi")}
        if last:
            break
    if not shared:
        table.drop()
    ranks = held.select("node", rank.alias("rank"))
    if rounds < 1:
        return ranks.select("node", "rank", F.lit(0.0).alias("score"))
    spread = (sums["hi"] - sums["lo"]) or 1.0
    return ranks.select("node", "rank", F.round((F.col("rank") - sums["lo"]) / spread * 100, digits).alias("score"))


def click_depth(nodes: DataFrame, links: DataFrame, seeds: DataFrame, most: int | None = None, unreached: int | None = None, table: EdgeTable | None = None) -> DataFrame:
    """node and depth: the fewest links from a seed; ``unreached`` where none leads, or none of up to ``most`` links.

    Without a seed among the nodes the one with the most links to it is the seed, the smallest of equals. Edges are written once in
    buckets of their source; each level is one join and one small written table. Levels so far are folded into one table now and then, so
    that a long chain grows neither the plan nor the number of scans.
    """
    nodes = nodes.select("node").distinct()
    shared, table = table is not None, table or EdgeTable(nodes, links)
    edges = table.frame.select("s", "t")
    seen = materialize(seeds.select("node").distinct().join(nodes, "node", "left_semi").withColumn("depth", F.lit(0)), "seen", 1)
    if seen.isEmpty():
        best = edges.groupBy("t").agg(F.count("*").alias("n")).agg(F.max_by("t", F.struct("n", -F.col("t")) if dict(edges.dtypes)["t"] != "string" else F.struct("n")).alias("node"))
        seen = materialize(best.where("node is not null").withColumn("depth", F.lit(0)), "seen", 1)
    frontier, parts = seen, [seen]
    for _ in itertools.count(1) if most is None else range(most):
        # The level comes from the rows, not from a number in the plan, so that every level is the same compiled code.
        step = edges.join(frontier.select(F.col("node").alias("s"), (F.col("depth") + 1).alias("depth")), "s").select(F.col("t").alias("node"), "depth").distinct()
        frontier = materialize(step.join(seen, "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = seen.unionByName(frontier)
        if len(parts) > 16:
            seen = materialize(seen, "seen")
            for used in parts[:-1]:
                drop_materialized(used)
            parts = [seen, frontier]
    if not shared:
        table.drop()
    out = nodes.join(seen, "node", "left")
    return out if unreached is None else out.withColumn("depth", F.coalesce("depth", F.lit(unreached)))


def redirect_chains(hops: DataFrame, most: int = 10) -> DataFrame:
    """url, path (array of up to ``most`` URLs from the start), hops and is_loop, by following ``hops`` (url, target)."""
    hops = materialize(hops.where("target is not null").groupBy("url").agg(F.min("target").alias("target")), "hops")
    step = hops.select(F.col("url").alias("_at"), F.col("target").alias("_to"))
    now = hops.select("url", F.array("url", "target").alias("path"), (F.col("url") == F.col("target")).alias("is_loop"))
    for _ in range(most - 2):
        at = F.element_at("path", -1)
        moved = now.withColumn("_at", F.when(~F.col("is_loop"), at)).join(step, "_at", "left")
        seen = F.array_contains("path", F.col("_to"))
        now = moved.select("url", F.when(F.col("_to").isNotNull(), F.concat("path", F.array("_to"))).otherwise(F.col("path")).alias("path"), (F.col("is_loop") | F.coalesce(seen, F.lit(False))).alias("is_loop"))
    return now.withColumn("hops", F.size("path") - 1)
