"""MinHash near-duplicates by min-max hashing.

Each permutation keeps the minimum and the maximum of a document's hashed shingles: two signature values for one
evaluation, both unbiased for the Jaccard similarity. ``ROWS`` values make a band; documents that share a band
are candidates. With 48 bands of 6 values a pair at similarity 0.75 misses every band with probability 8e-5, a pair
at 0.2 shares one with 0.3 %.

Equal shingle sets are one node from the start. Candidates are verified inside their buckets, on full sets:

1. Stars. Each bucket has a pivot, the node with the smallest number, and every member is compared with it. A pivot with many
   members is sent to as many tasks as they need. Work and rows are linear in the members; a group of near copies becomes
   one class here, however large it is.
2. Leftovers. Only buckets whose members besides the pivot still stand in two classes or more hold pairs that were not compared.
   Their members meet in tiles as sketches (one byte of each signature value); pairs of different classes whose sketches agree
   in ``PLAUSIBLE`` of the values join classes to families, which no chance collision of a band can do.
3. Families are cut into blocks bounded by documents and by bytes, and pairs of blocks that aren't of one class are compared on full sets by a
   product of incidence matrices.

Every step returns a forest of links, never pairs. Connected components of the links give the classes.

Defined results: a null or empty text, or one without words, has an empty set and is a class of its own; rows with equal ids
are one document and share a class, whatever their texts; a row with a null id can be in a class but never names it; the class id is
the smallest id, and rows with that id are kept; an empty table gives no rows. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.materialize import materialize, release, written
from .batches import map_groups, map_rows
from .components import connected_components
from .kernels import lower_utf8, mix, seeded, shingle_set

SHINGLE_WORDS = 5
#: Links have ``100 * intersection >= LINK_PERCENT * union``.
LINK_PERCENT = 75
BANDS, ROWS = 48, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Members of a star in one task; documents of a block of sketches.
STAR, SKETCHES = 4096, 512
#: Share of equal signature values from which a pair is compared: a pair at 0.75 falls below with probability 1e-8.
PLAUSIBLE = 0.6
#: Documents, and bytes of packed sets, of a block on average; a tile holds two blocks.
BLOCK, BLOCK_BYTES = 192, 4 << 20
#: Shingles whose incidence is held at once in a tile.
COLUMNS_AT_ONCE = 8192
_U = np.uint64
_XOR, _MUL, _ROW = seeded(PERMUTATIONS, 101), seeded(PERMUTATIONS, 211) | _U(1), seeded(ROWS, 307) | _U(1)


def min_max(shingles: np.ndarray) -> np.ndarray:
    """The minimum and maximum under each permutation, as rows."""
    low, high = np.full(PERMUTATIONS, ~_U(0)), np.zeros(PERMUTATIONS, dtype=_U)
    for at in range(0, len(shingles), 1024):
        h = (shingles[None, at : at + 1024] ^ _XOR[:, None]) * _MUL[:, None]
        np.minimum(low, h.min(axis=1), out=low)
        np.maximum(high, h.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    rows = min_max(shingles).reshape(BANDS, ROWS)
    return mix((rows * _ROW).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U) * _ROW[0]).view(np.int64)


def sketch(packed: bytes) -> bytes:
    """One byte of each signature value."""
    return (mix(min_max(np.frombuffer(packed, dtype=_U)).ravel()) & _U(255)).astype(np.uint8).tobytes()


def digest_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, n_shingles, a digest of the set and its band keys (both null for an empty set)."""
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(part: pa.RecordBatch) -> dict:
        sizes, digests, keys = [], [], []
        for text in part.column("text").to_pylist():
            s = shingle_set(lower_utf8(text), SHINGLE_WORDS)
            sizes.append(len(s))
            digests.append(digest_of(s) if len(s) else None)
            keys.append(band_keys(s) if len(s) else None)
        return {"doc": part.column("doc"), "n_shingles": sizes, "digest": digests, "keys": keys}

    return map_rows(df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")), run, schema)


class Forest:
    """Union-find over 0..n-1, some of which may be joined from the start by equal labels."""

    def __init__(self, labels: list):
        first: dict = {}
        self.parent = [first.setdefault(x, k) for k, x in enumerate(labels)]

    def top(self, k: int) -> int:
        parent = self.parent
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        self.parent[b] = a
        return a != b


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets are linked. Intersections of all pairs come from products of incidence matrices over the shingles
    that two sets or more hold."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), dtype=bool)
    new[1:] = every[1:] != every[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((n, n), dtype=np.float64)
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
        for at in range(0, int(column[-1]) + 1, COLUMNS_AT_ONCE):
            lo, hi = np.searchsorted(column, [at, at + COLUMNS_AT_ONCE])
            x = np.zeros((n, min(COLUMNS_AT_ONCE, int(column[-1]) + 1 - at)), dtype=np.float32)
            x[owner[lo:hi], column[lo:hi] - at] = 1
            common += x @ x.T
    return np.triu((common > 0) & (100 * common >= LINK_PERCENT * (size[:, None] + size[None, :] - common)), 1)


def plausible(sketches: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs a < b of sketches that agree in ``PLAUSIBLE`` of their values."""
    least = int(PLAUSIBLE * sketches.shape[1])
    for a in range(len(sketches) - 1):
        for b in (np.flatnonzero((sketches[a + 1 :] == sketches[a]).sum(axis=1) >= least) + a + 1).tolist():
            yield a, b


SENT = T.StructType([T.StructField("group", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()), T.StructField("side", T.IntegerType()), T.StructField("node", T.LongType()), T.StructField("label", T.LongType()), T.StructField("packed", T.BinaryType())])
LINKS = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def packed_sets(df: DataFrame, nodes: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """node and packed set of the nodes in ``wanted``: the only time that texts are shuffled."""
    texts = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("packed", T.BinaryType())])

    def run(parts):
        for part in parts:
            for text, node, digest in zip(*(part.column(c).to_pylist() for c in ("text", "node", "digest"))):
                s = shingle_set(lower_utf8(text), SHINGLE_WORDS)
                if digest_of(s) == digest:  # else another text with the same id
                    yield node, s.tobytes()

    chosen = nodes.select("node", "doc", "digest").join(wanted, "node", "left_semi")
    return map_groups(texts.join(chosen, "doc").select("text", "node", "digest"), run, schema, 2 << 20, lambda row: len(row[1]) + 16)


def send(sets: DataFrame, places: DataFrame, packing=None) -> DataFrame:
    """A row of ``SENT`` with the packed set for each place of a node.

    ``places`` has node and to, an array of structs (group, blocks, side, label, skip, behind). A place with ``blocks`` of 0 gives one row, lo being
    its side; else the node is sent to the tile of its block (side) with every block that isn't in skip..behind-1. Rows are made as they are sent.
    """

    def run(parts):
        for part in parts:
            for node, packed, to in zip(*(part.column(c).to_pylist() for c in ("node", "packed", "to"))):
                packed = packing(packed) if packing else packed
                for p in to:
                    if not p["blocks"]:
                        yield p["group"], p["side"], 0, int(p["label"] != node), node, p["label"], packed
                        continue
                    for other in range(p["blocks"]):
                        if not p["skip"] <= other < p["behind"]:
                            yield p["group"], min(p["side"], other), max(p["side"], other), p["side"], node, p["label"], packed

    return map_groups(sets.join(places, "node").select("node", "packed", "to"), run, SENT, 2 << 20, lambda row: len(row[-1]) + 48)


def grouped(sent: DataFrame, solve) -> DataFrame:
    """Links found by ``solve`` in each group of (group, lo, hi), whose rows come as (side, node, label, packed)."""
    schema = LINKS

    def run(parts):
        key, held = None, {}
        for part in parts:
            for group, lo, hi, side, node, label, packed in zip(*(part.column(c).to_pylist() for c in SENT.names)):
                if (group, lo, hi) != key:
                    yield from solve(key, held)
                    key, held = (group, lo, hi), {}
                held[node] = (side, label, packed)
        yield from solve(key, held)

    return map_groups(sent.repartition("group", "lo", "hi").sortWithinPartitions("group", "lo", "hi"), run, schema)


def against_pivot(sent: DataFrame) -> DataFrame:
    """Links of star members with their pivot; a task holds one pivot's set and streams the members'."""

    def run(parts):
        key = pivot = None
        for part in parts:
            for group, lo, side, node, packed in zip(*(part.column(c).to_pylist() for c in ("group", "lo", "side", "node", "packed"))):
                s = np.frombuffer(packed, dtype=_U)
                if side == 0:
                    key, pivot = (group, lo), s
                elif key == (group, lo):
                    small, large = (s, pivot) if len(s) <= len(pivot) else (pivot, s)
                    common = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
                    if common and 100 * common >= LINK_PERCENT * (len(s) + len(pivot) - common):
                        yield node, group

    return map_groups(sent.repartition("group", "lo").sortWithinPartitions("group", "lo", "side"), run, LINKS)


def _tile_pairs(pairs_of):
    """A solver of tiles: links between nodes of different labels, no more than join the labels to each other."""

    def solve(key, held):
        if len(held) < 2:
            return
        nodes = sorted(held)
        labels = [held[n][1] for n in nodes]
        if len(set(labels)) < 2:
            return
        forest = Forest(labels)
        for a, b in pairs_of([held[n][2] for n in nodes]):
            if forest.join(a, b):
                yield nodes[a], nodes[b]

    return solve


def _set_pairs(packed: list[bytes]) -> list:
    return np.argwhere(linked([np.frombuffer(p, dtype=_U) for p in packed])).tolist()


def _sketch_pairs(packed: list[bytes]) -> Iterator[tuple[int, int]]:
    return plausible(np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1))


def place(group, blocks, side, label, skip=0, behind=0):
    value = lambda x, kind: (x if isinstance(x, F.Column) else F.col(x) if isinstance(x, str) else F.lit(x)).cast(kind)
    return F.struct(value(group, "long").alias("group"), value(blocks, "int").alias("blocks"), value(side, "int").alias("side"), value(label, "long").alias("label"), value(skip, "int").alias("skip"), value(behind, "int").alias("behind"))


def star_places(stars: DataFrame, about: int) -> DataFrame:
    """Where nodes are sent to be compared with pivots: members to one part of the star, pivots to all parts.

    Counts by pivot are written, here and below, so that both sides of the join with them are plain exchanges and AQE can split a hot pivot's rows.
    """
    parts = materialize(stars.groupBy("first").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts")), "parts", about)
    members = stars.join(parts, "first").select("node", place("first", 0, F.pmod(F.xxhash64("node"), F.col("parts")), "first").alias("p"))
    pivots = parts.select("first", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("first").alias("node"), place("first", 0, "part", "first").alias("p"))
    return members.unionByName(pivots).groupBy("node").agg(F.collect_list("p").alias("to"))


def tile_places(members: DataFrame, block: int, block_bytes: int, about: int) -> DataFrame:
    """Where the nodes of each group are sent: to the tiles of their block with others. ``members`` has group, node, label and bytes.

    A label with half a block of nodes or more has blocks of its own, which are not compared with each other; so a group of one large class and a
    few strangers costs a tile for each block of the class, not for each pair of blocks. The other labels share blocks by hash.
    """
    full = lambda n, size: F.greatest(F.ceil(n / F.lit(block)), F.ceil(size / F.lit(block_bytes))).cast("int")
    labels = materialize(members.groupBy("group", "label").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")), "sizes", about)
    large = labels.where(f"2 * n >= {block}").select("group", "label", full(F.col("n"), F.col("size")).alias("own"))
    # Rows here are large labels of one group: at most its nodes over half a block.
    large = materialize(large.withColumn("behind", F.sum("own").over(Window.partitionBy("group").orderBy("label"))), "large", about)
    shared = labels.groupBy("group").agg(full(F.coalesce(F.sum(F.when(2 * F.col("n") < block, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(2 * F.col("n") < block, F.col("size"))), F.lit(0))).alias("shared"))
    sizes = shared.join(large.groupBy("group").agg(F.max("behind").alias("large")), "group", "left").select("group", "shared", (F.col("shared") + F.coalesce("large", F.lit(0))).alias("blocks"))
    sizes = materialize(sizes, "groups", about)
    dealt = members.join(sizes, "group").join(large, ["group", "label"], "left")
    h = F.xxhash64("node")
    first = F.col("shared") + F.col("behind") - F.col("own")
    side = F.when(F.col("own").isNull(), F.pmod(h, F.col("shared"))).otherwise(first + F.pmod(h, F.col("own")))
    skip, behind = F.when(F.col("own").isNull(), 0).otherwise(first), F.when(F.col("own").isNull(), 0).otherwise(F.col("shared") + F.col("behind"))
    return dealt.select("node", place("group", "blocks", side, "label", skip, behind).alias("p")).groupBy("node").agg(F.collect_list("p").alias("to"))


def leftovers(met: DataFrame, labels: DataFrame, about: int) -> DataFrame:
    """key, node, label and n of the members of buckets that hold pairs not yet compared, pivots left out."""
    rest = met.where("size > 2 and node <> first").select("key", "node", "n").join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("label"))
    mixed = materialize(rest.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key"), "mixed", about)
    return rest.join(mixed, "key", "left_semi")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc, n_shingles, component (the smallest linked id) and kept."""
    before = written(df.sparkSession)
    sig = materialize(signatures(df, id_col, text_col), "signatures")
    kept = written(df.sparkSession)[-1]
    named = sig.where("digest is not null and doc is not null")
    first = named.groupBy("digest").agg(F.min(F.struct("doc", "n_shingles", "keys")).alias("first"), F.count("*").alias("copies"))
    # Numbers are fixed once the table is written.
    nodes = materialize(first.select(F.monotonically_increasing_id().alias("node"), "digest", "first.doc", F.col("first.n_shingles").alias("n"), "first.keys", "copies"), "nodes", sig.count())
    total = nodes.count()
    buckets = nodes.select("node", "n", F.explode("keys").alias("key"))
    shared = materialize(buckets.groupBy("key").agg(F.min(F.struct("node", "n")).alias("p"), F.count("*").alias("size")).where("size > 1").select("key", F.col("p.node").alias("first"), F.col("p.n").alias("first_n"), "size"), "bands", BANDS * total // 2)
    met = materialize(buckets.join(shared, "key"), "buckets", BANDS * total)
    stars = materialize(met.where(f"node <> first and 100 * least(n, first_n) >= {LINK_PERCENT} * greatest(n, first_n)").select("node", "first").distinct(), "stars", BANDS * total)
    wanted = stars.select(F.explode(F.array("node", "first")).alias("node")).unionByName(met.where("size > 2").select("node")).distinct()
    sets = materialize(packed_sets(df, nodes, wanted, id_col, text_col), "sets", 40 * total)
    links = materialize(against_pivot(send(sets, star_places(stars, total))), "links", BANDS * total)
    # Rows with one id and several sets are one document.
    twice = named.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc", "a")
    number = nodes.select("digest", F.col("node"))
    alike = named.join(twice, "doc").select("digest", "a").distinct().join(number, "digest").select(F.col("node").alias("u"), "a").join(number.select(F.col("digest").alias("a"), F.col("node").alias("v")), "a").select("u", "v")
    labels = materialize(connected_components(links.unionByName(alike), BANDS * total), "labels", total)
    rest = materialize(leftovers(met, labels, total), "leftovers", BANDS * total)
    if not rest.isEmpty():
        tiles = rest.select(F.col("key").alias("group"), "node", "label", F.lit(BANDS * ROWS).alias("bytes"))
        label = labels.select("node", "component")
        classes = lambda e: e.join(label.toDF("u", "cu"), "u", "left").join(label.toDF("v", "cv"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
        near = grouped(send(sets, tile_places(tiles, SKETCHES, 1 << 40, total), sketch), _tile_pairs(_sketch_pairs))
        families = materialize(connected_components(classes(near), total), "families", total)
        if not families.isEmpty():
            members = rest.select("node", "label", "n").distinct().join(families.select(F.col("node").alias("label"), F.col("component").alias("group")), "label").select("group", "node", "label", (8 * F.col("n")).alias("bytes"))
            found = grouped(send(sets, tile_places(members, BLOCK, BLOCK_BYTES, total)), _tile_pairs(_set_pairs))
            joined = materialize(connected_components(classes(found), total), "joined", total)
            labels_new = labels.join(joined.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left").select("node", F.coalesce("further", "component").alias("component"))
            alone = joined.join(labels, "node", "left_anti")
            labels = materialize(labels_new.unionByName(alone), "labels", total)
    own = nodes.select("node", "digest", "doc", "copies").join(labels, "node", "left")
    smallest = materialize(own.where("component is not null").groupBy("component").agg(F.min("doc").alias("low")), "smallest", total)
    classes = materialize(own.where("copies > 1 or component is not null").join(smallest, "component", "left").select("digest", F.coalesce("low", "doc").alias("component")), "classes", total)
    release(df.sparkSession, [x for x in written(df.sparkSession)[:-1] if x != kept and x not in before])
    out = sig.select("doc", "n_shingles", "digest").join(classes, "digest", "left")
    out = out.select("doc", "n_shingles", F.coalesce("component", "doc").alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component"), F.col("component").isNull()))
