"""Near-duplicates by simhash: the theta join on Hamming distance in tiles of two parts of the hashes, compared by blocks of bits."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import similarity


def members(hashes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, simhash and representative: the smallest key with the same hash. Zero hashes are left out."""
    rows = hashes.where("simhash is not null and simhash <> '0000000000000000'")
    return rows.join(rows.groupBy("simhash").agg(F.min(key).alias("representative"), F.count("*").alias("copies")), "simhash").select(key, "simhash", "representative", "copies")


#: Hashes of a part at most; a task holds two parts. Pairs compared at once, and rows of a batch of found ones.
PART, COMPARED, FOUND = 1 << 18, 1 << 21, 1 << 16
#: Hashes of a part that agree on a key: so many are compared with each other faster than under more keys.
DENSE = 4096


def parts_for(n: int, cores: int) -> int:
    """So few parts that each fits a task, and so many that their pairs keep the cores busy."""
    parts = max(1, -(-n // PART))
    while parts * (parts + 1) < 6 * cores and parts * 1024 < n:
        parts += 1
    return parts


def blocks_for(n: int, most: int = 6) -> int:
    """How many blocks must agree so that a key has about as many values as there are hashes."""
    agree = 1
    while agree < most and agree * 64 // (most + agree) < max(n, 2).bit_length():
        agree += 1
    return agree


def near_in_tile(x, y, most: int, agree: int):
    """Arrays i, j, distance of all x[i], y[j] within ``most`` bits, in bounded pieces.

    The 64 bits are cut into ``most + agree`` blocks, of which near hashes agree on ``agree`` at least: what agrees on so many is compared, and a pair counts under its lowest agreeing blocks.
    """
    import numpy as np

    count = most + agree
    width = [64 // count + (k < 64 % count) for k in range(count)]
    masks = [((1 << w) - 1) << sum(width[:k]) for k, w in enumerate(width)]
    for chosen in combinations(range(count), agree):
        mask, passed = np.uint64(sum(masks[k] for k in chosen)), [np.uint64(masks[k]) for k in range(chosen[-1]) if k not in chosen]
        vx, vy = x & mask, y & mask
        ox, oy = np.argsort(vx, kind="stable"), np.argsort(vy, kind="stable")
        vx, vy = vx[ox], vy[oy]
        values = np.intersect1d(vx, vy)
        edges = [np.searchsorted(v, values, side) for v in (vx, vy) for side in ("left", "right")]
        for x0, x1, y0, y1 in zip(*(e.tolist() for e in edges)):
            for y2 in range(y0, y1, COMPARED):
                at = oy[y2 : min(y1, y2 + COMPARED)]
                right, step = y[at], max(1, COMPARED // len(at))
                for x2 in range(x0, x1, step):
                    of = ox[x2 : min(x1, x2 + step)]
                    differ = x[of][:, None] ^ right[None, :]
                    i, j = np.nonzero(np.bitwise_count(differ) <= most)
                    differ = differ[i, j]
                    first = np.ones(len(i), bool)
                    for block in passed:
                        first &= (differ & block) != 0
                    yield of[i[first]], at[j[first]], np.bitwise_count(differ[first])


def simhash_pairs(hashes: DataFrame, key: str = "doc_id", most: int = 6, agree: int | None = None, parts: int | None = None) -> DataFrame:
    """Pairs a < b of representatives of different hashes with a Hamming distance of ``most`` or less, and how many rows each stands for.

    Hashes are dealt into ``parts``, and each pair of parts is a tile that one task compares in memory by blocks of bits (``near_in_tile``), so that a hash is shuffled once for
    each part and pairs, of which there can be far more than hashes, not at all. The result is the same for every number of parts and of blocks that must ``agree``. Equal hashes are one node with a count, so copies make no pairs.
    """
    rows = hashes.where("simhash is not null and simhash <> '0000000000000000'")
    nodes = rows.groupBy("simhash").agg(F.min(key).alias("id"), F.count("*").alias("copies")).select("id", "copies", F.conv("simhash", 16, -10).cast("bigint").alias("h"))
    cores = hashes.sparkSession.sparkContext.defaultParallelism
    distinct = rows.agg(F.count_distinct("simhash")).first()[0]
    n = parts or parts_for(distinct, cores)
    agree = agree or blocks_for(distinct // n // DENSE, most)
    part = F.pmod(F.xxhash64("h"), F.lit(n)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = nodes.withColumn("part", part).withColumn("other", other)
    low, high = F.least("part", "other"), F.greatest("part", "other")
    # A tile's number by its place in the upper triangle.
    dealt = dealt.select((F.floor(high * (high + 1) / 2).cast("int") + low).alias("tile"), (F.col("part") == low).alias("left"), (F.col("part") == high).alias("right"), "id", "copies", "h")
    kind = dict(dealt.dtypes)["id"]
    tiles = dealt.repartitionById(n * (n + 1) // 2, "tile").sortWithinPartitions("tile")

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        def found(rows: pa.Table):
            sides = [rows.filter(rows[s]) for s in ("left", "right")]
            ids, copies = ([s[c].combine_chunks() for s in sides] for c in ("id", "copies"))
            x, y = (np.ascontiguousarray(s["h"].to_numpy()).view(np.uint64) for s in sides)
            same = bool(len(x)) and rows["left"][0].as_py() and rows["right"][0].as_py()
            for i, j, distance in near_in_tile(x, y, most, agree):
                if same:  # both sides are one list
                    once = i < j
                    i, j, distance = i[once], j[once], distance[once]
                for at in range(0, len(i), FOUND):
                    p, q = i[at : at + FOUND], j[at : at + FOUND]
                    columns = [ids[0].take(p), ids[1].take(q), copies[0].take(p), copies[1].take(q), pa.array(distance[at : at + FOUND].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, ["x_id", "y_id", "x_copies", "y_copies", "distance"])

        held, tile = [], None
        for batch in batches:
            numbers = batch["tile"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if tile is not None and numbers[a] != tile:
                        yield from found(pa.Table.from_batches(held))
                        held = []
                    tile = numbers[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from found(pa.Table.from_batches(held))

    near = tiles.mapInArrow(compare, f"x_id {kind}, y_id {kind}, x_copies bigint, y_copies bigint, distance int")
    first = F.col("x_id") < F.col("y_id")
    return near.select(
        F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), "distance", similarity(F.col("distance")).alias("similarity"),
        F.when(first, F.col("x_copies")).otherwise(F.col("y_copies")).alias("copies_a"), F.when(first, F.col("y_copies")).otherwise(F.col("x_copies")).alias("copies_b"),
    )


def closest(hashes: DataFrame, pairs: DataFrame, key: str = "doc_id", most: int = 6) -> DataFrame:
    """For each document that has one its most similar partner, and its number of partners.

    A copy's partner is the representative of its hash (the representative's: the smallest other copy), any other document's the representative of the
    nearest hash, the smallest of equals.
    """
    sides = F.array(F.struct("a", "b", "distance", F.col("copies_b").alias("n")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "distance", F.col("copies_a").alias("n")))
    both = pairs.select(F.explode(sides).alias("s")).select("s.*")
    # The smallest partner by distance: plain minima, so that pairs are summed up where they are found.
    least = [F.min(F.when(F.col("distance") == d, F.col("b"))) for d in range(most + 1)]
    near = both.groupBy(F.col("a").alias("representative")).agg(F.coalesce(*least).alias("near"), similarity(F.min("distance")).alias("near_similarity"), F.sum("n").alias("others"))
    rows = members(hashes, key)
    second = rows.where(f"{key} <> representative").groupBy("representative").agg(F.min(key).alias("second"))
    all_of = rows.join(near, "representative", "left").join(second, "representative", "left")
    partner = F.when(F.col("copies") > 1, F.when(F.col(key) == F.col("representative"), F.coalesce("second", "representative")).otherwise(F.col("representative"))).otherwise(F.col("near"))
    return all_of.select(key, partner.alias("closest"), F.when(F.col("copies") > 1, 1.0).otherwise(F.col("near_similarity")).alias("similarity"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("partners")).where("closest is not null")
