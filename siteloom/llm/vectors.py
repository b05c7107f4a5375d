"""Near-duplicate embeddings by product quantisation: coarse inverted lists, residual codes, table look-ups, exact cosine.

Vectors are compared when their labels are equal. Equal vectors of one label are one node with a count. A model is fitted on a bounded sample:
unit centroids of coarse lists, and for every four components a codebook of residuals. Every node is indexed: its home list is that of the nearest
centroid, its code names the nearest entry for each part of the residual, and the error of the code is kept beside it.

* Probes. A node also visits the lists in which a vector linked with it may live. If x at an angle of at most t lives in list i, while y's
  nearest centroid is b, then ``y.b - y.i <= tan(t) * |projection of i - b|`` times the cosine of a random direction; ``Z`` standard deviations of
  that cosine in the sample's effective dimension are allowed for. A pair is met if either of the two visits the other's list. With
  ``z=None`` the bound is the worst case and no pair can be missed, at the price of many more visits.
* Look-ups. The distance of a visitor to a code is summed from a table of its distances to the codebook entries. By the triangle inequality it differs from the
  true one by the code's error at most, so the candidates lose no link; their cosines are computed in double precision.
* Tiles. A list with more than ``BLOCK`` members is cut into blocks by hash, and each pair of blocks is a tile of its own, so a hot list or a group of near copies is
  spread over tasks. A tile returns a count for each node and a forest of links, never its pairs. The cosines of a group in which all are linked are computed all the
  same, since ``n_links`` asks for their number.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose label is null, links with nothing and stands alone, with its
own id as class; vectors of different lengths aren't linked; rows with one id are one node of a class, and each of them counts as a vector; a row with a null id
is counted and can be in a class, but never names it; an empty table gives no rows. Columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.materialize import materialize, release, written
from .batches import map_groups, map_rows
from .components import connected_components

#: Links have a cosine of at least this.
COSINE = 0.93
#: The sample on which the model is fitted: vectors, and bytes of its components as doubles.
SAMPLE, SAMPLE_BYTES = 65_536, 64 << 20
#: Bytes of the coarse centroids, of which a vector of 64 components allows 32,768; vectors (of all labels) for a list; components and entries of a part.
MODEL_BYTES, LIST_ROWS, PART, ENTRIES = 8 << 20, 512, 4, 16
#: Standard deviations of a neighbour's direction that probes allow for.
Z = 2.0
#: Members of a block; a tile holds two blocks.
BLOCK = 1024
#: Added to distances, against rounding in single precision.
SLACK = 1e-4
_L, _B, _I = T.LongType(), T.BinaryType(), T.IntegerType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def doubles(vec: bytes, single: bool) -> np.ndarray:
    return np.frombuffer(vec, dtype="<f4" if single else "<f8").astype(np.float64)


def unit(v: np.ndarray) -> np.ndarray:
    """The direction of a vector; scaled before it is squared, so that no component overflows or vanishes."""
    v = v / np.abs(v).max()
    return v / math.sqrt(float(v @ v))


# Fitting, on the sample


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, in slices of rows."""
    half = 0.5 * (centres * centres).sum(1)
    step = max(1, (4 << 20) // len(centres))
    return np.concatenate([np.argmax(x[k : k + step] @ centres.T - half, axis=1) for k in range(0, len(x), step)])


def k_means(x: np.ndarray, k: int, rounds: int, spherical: bool = False) -> np.ndarray:
    """Centres that start as evenly spaced rows; an empty cluster keeps its centre."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, centres)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        full = n > 0
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0)
        centres[full] = sums / n[full, None]
        if spherical:
            size = np.sqrt((centres * centres).sum(1))
            centres[size > 0] /= size[size > 0, None]
    return centres


@dataclass
class Model:
    """Coarse centroids (lists x dim), residual codebooks (parts x entries x PART) and the share of the worst case that probes allow for."""

    lists: np.ndarray
    books: np.ndarray
    spread: float

    @property
    def dim(self) -> int:
        return self.lists.shape[1]

    def head(self, u: np.ndarray) -> tuple[np.ndarray, float]:
        """The components that are quantised, padded with zeros, and the squared length of the others."""
        out = np.zeros(self.dim)
        out[: min(len(u), self.dim)] = u[: self.dim]
        return out, float((u[self.dim :] ** 2).sum())

    def parts(self, residuals: np.ndarray) -> np.ndarray:
        pad = -residuals.shape[1] % PART
        r = np.pad(residuals, ((0, 0), (0, pad))) if pad else residuals
        return r.reshape(len(r), -1, PART)

    def table(self, residuals: np.ndarray) -> np.ndarray:
        """Squared distances of each part of each row to the entries: rows x parts x entries."""
        r = self.parts(residuals)
        cross = np.einsum("rpk,pek->rpe", r, self.books, optimize=True)
        return (r * r).sum(2)[:, :, None] - 2 * cross + (self.books * self.books).sum(2)[None]

    def encode(self, heads: np.ndarray, tails: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the distance of each vector from what its code stands for."""
        table = self.table(heads - self.lists[homes])
        codes = table.argmin(2).astype(np.uint8)
        left = np.take_along_axis(table, codes[:, :, None].astype(np.int64), 2)[:, :, 0].sum(1)
        return codes, np.sqrt(np.maximum(left + tails, 0))

    def visits(self, heads: np.ndarray, tan: float) -> tuple[np.ndarray, np.ndarray]:
        """The home list of each row, and which other lists it probes (rows x lists)."""
        s = heads @ self.lists.T
        home = s.argmax(1)
        gap = s[np.arange(len(s)), home][:, None] - s
        own = self.lists[home]
        apart = 2 - 2 * own @ self.lists.T  # centroids are unit vectors
        probes = gap <= tan * self.spread * np.sqrt(np.maximum(apart - gap * gap, 0)) + SLACK
        probes[np.arange(len(s)), home] = False
        return home, probes


def fit(units: list[np.ndarray], total: int, z: float | None = Z) -> Model:
    """The model from sampled unit vectors. Components are counted by the sample's most frequent length; ``total`` is how many vectors will be indexed."""
    lengths = np.bincount([len(u) for u in units])
    x = np.stack([u for u in units if len(u) == lengths.argmax()])
    dim = x.shape[1]
    # Lists of the same size for any number of vectors, as far as the sample and the bytes carry; beyond that lists grow and are cut into more tiles.
    k = int(max(1, min(total // LIST_ROWS, len(x) // 8, MODEL_BYTES // (4 * dim))))
    lists = k_means(x, k, 10, spherical=True)
    size = np.sqrt((lists * lists).sum(1))
    lists[size == 0] = x[0]
    lists /= np.sqrt((lists * lists).sum(1))[:, None]
    model = Model(lists, np.zeros((-(-dim // PART), ENTRIES, PART)), 1.0)
    residuals = model.parts(x - lists[(x @ lists.T).argmax(1)])
    model.books = np.stack([k_means(residuals[:, p], ENTRIES, 6) for p in range(residuals.shape[1])])
    if z is not None:
        c = np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim)
        effective = np.trace(c) ** 2 / max(float((c * c).sum()), 1e-300)
        model.spread = min(1.0, z / math.sqrt(max(effective, 1.0)))
    return model


# Nodes and index


def _rows(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, bool]:
    """doc, label, digest and vec of every row; the last three are null where the vector links with nothing. Whether components are single floats."""
    kind = df.schema[vec_col].dataType.elementType
    single = isinstance(kind, T.FloatType)
    x = F.col(vec_col).cast("array<float>" if single else "array<double>")
    good = F.col(label_col).isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    sent = df.select(F.col(id_col).cast("long").alias("doc"), F.when(good, F.col(label_col).cast("string")).alias("label"), F.when(good, x).alias("vec"))

    def run(part: pa.RecordBatch) -> dict:
        labels, vecs = part.column("label").to_pylist(), part.column("vec")
        flat, ends = vecs.flatten().to_numpy(zero_copy_only=False), vecs.value_lengths().fill_null(0).to_numpy().cumsum()
        flat = (flat + 0.0).astype("<f4" if single else "<f8")  # minus zero is zero
        packed = [None if label is None else flat[b - n : b].tobytes() for label, b, n in zip(labels, ends, vecs.value_lengths().fill_null(0).to_pylist())]
        return {"doc": part.column("doc"), "label": labels, "vec": packed, "digest": [None if v is None else hashlib.blake2b(label.encode() + b"\0" + v, digest_size=16).digest() for label, v in zip(labels, packed)]}

    return map_rows(sent, run, _schema(doc=_L, label=T.StringType(), digest=_B, vec=_B)), single


def _sample(nodes: DataFrame, single: bool, longest: int) -> list[np.ndarray]:
    """Unit vectors of the bounded sample: those whose digests sort first."""
    rows = int(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(longest, 1)))))
    return [unit(doubles(r.vec, single)) for r in nodes.orderBy("digest").limit(rows).select("vec").toLocalIterator()]


INDEX = _schema(node=_L, label=T.StringType(), dim=_I, copies=_L, vec=_B, home=_I, probes=T.ArrayType(_I), code=_B, error=T.DoubleType())


def index(nodes: DataFrame, model: Model, single: bool, cosine: float = COSINE) -> DataFrame:
    """Home list, probed lists, code and error of every node."""
    tan = math.sqrt(1 - cosine * cosine) / cosine

    def run(part: pa.RecordBatch) -> dict:
        units = [unit(doubles(v, single)) for v in part.column("vec").to_pylist()]
        pairs = [model.head(u) for u in units]
        heads, tails = np.stack([h for h, _ in pairs]), np.array([t for _, t in pairs])
        home, probes = model.visits(heads, tan)
        codes, errors = model.encode(heads, tails, home)
        return {c: part.column(c) for c in ("node", "label", "copies", "vec")} | {
            "dim": [len(u) for u in units], "home": home, "probes": [np.flatnonzero(p).tolist() for p in probes], "code": [c.tobytes() for c in codes], "error": errors,
        }

    return map_rows(nodes, run, INDEX, 1 << 20)


# Tiles


@dataclass
class Tile:
    """Members of one list: of one block, or of two whose pairs across are to be compared."""

    rows: list[tuple]
    model: Model
    single: bool
    at: int
    cosine: float

    def __post_init__(self) -> None:
        self.node = np.array([r[0] for r in self.rows], dtype=np.int64)
        self.copies = np.array([r[1] for r in self.rows], dtype=np.int64)
        v = doubles(b"".join(r[2] for r in self.rows), self.single).reshape(len(self.rows), -1)  # of one length
        v = v / np.abs(v).max(1)[:, None]
        self.units = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
        self.home = np.array([r[3] for r in self.rows])
        self.probes = np.zeros((len(self.rows), len(self.model.lists)), dtype=bool)
        for k, r in enumerate(self.rows):
            self.probes[k, r[4]] = True
        self.codes = np.frombuffer(b"".join(r[5] for r in self.rows), dtype=np.uint8).reshape(len(self.rows), -1).astype(np.int64)
        self.errors = np.array([r[6] for r in self.rows])
        self.side = np.array([r[7] for r in self.rows])
        width = min(v.shape[1], self.model.dim)
        self.residuals = np.pad(self.units[:, :width], ((0, 0), (0, self.model.dim - width))) - self.model.lists[self.at]
        self.tails = (self.units[:, width:] ** 2).sum(1)

    def candidates(self, asking: np.ndarray, coded: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (asking, coded) whose look-up distance leaves room for a link."""
        reach = (math.sqrt(2 - 2 * self.cosine) + self.errors[coded] + SLACK) ** 2
        for k in range(0, len(asking), 64):
            some = asking[k : k + 64]
            table, codes = self.model.table(self.residuals[some]).astype(np.float32), self.codes[coded]
            found = np.repeat(self.tails[some][:, None].astype(np.float32), len(coded), axis=1)
            for p in range(codes.shape[1]):
                found += table[:, p, codes[:, p]]
            a, b = np.nonzero(found <= reach)
            yield some[a], coded[b]

    def linked(self, asking: np.ndarray, coded: np.ndarray, keep) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if len(asking) and len(coded):
            for a, b in self.candidates(asking, coded):
                fit = keep(a, b)
                a, b = a[fit], b[fit]
                for k in range(0, len(a), 8192):
                    i, j = a[k : k + 8192], b[k : k + 8192]
                    near = np.einsum("ij,ij->i", self.units[i], self.units[j]) >= self.cosine
                    yield i[near], j[near]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every linked pair that this tile is to count: those of two visitors are met elsewhere, and those of a visitor whose own list is visited, in the list of the smaller node."""
        lives = self.home == self.at
        once = lambda a, b: ~self.probes[b, self.home[a]] | (self.node[a] > self.node[b])
        low, high = self.side.min(), self.side.max()
        both = lambda a, b: np.ones(len(a), dtype=bool)
        if low == high:
            yield from self.linked(np.flatnonzero(lives), np.flatnonzero(lives), lambda a, b: a < b)
            yield from self.linked(np.flatnonzero(~lives), np.flatnonzero(lives), once)
        else:
            first, second = self.side == low, self.side == high
            yield from self.linked(np.flatnonzero(first & lives), np.flatnonzero(second & lives), both)
            yield from self.linked(np.flatnonzero(first & ~lives), np.flatnonzero(second & lives), once)
            yield from self.linked(np.flatnonzero(second & ~lives), np.flatnonzero(first & lives), once)

    def result(self) -> Iterator[tuple]:
        """(node, null, links) for nodes with links, and (node, node, null) for a forest of them."""
        n = len(self.rows)
        count, label = np.zeros(n, dtype=np.int64), np.arange(n)
        for a, b in self.pairs():
            np.add.at(count, a, self.copies[b])
            np.add.at(count, b, self.copies[a])
            while (label[a] != label[b]).any():  # the smaller label wins at both ends and at their roots
                low = np.minimum(label[a], label[b])
                for end in (a, b):
                    np.minimum.at(label, label[end], low)
                    np.minimum.at(label, end, low)
                label = label[label]
        while (label != label[label]).any():
            label = label[label]
        for k in np.flatnonzero(count):
            yield int(self.node[k]), None, int(count[k])
        for k in np.flatnonzero(label != np.arange(n)):
            yield int(self.node[k]), int(self.node[label[k]]), None


def compare(indexed: DataFrame, model: Model, single: bool, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """u, v and n: link counts of nodes (v null), possibly several for a node, and forests of links (n null)."""
    # Only ids are sent while the lists are counted. A list has a row for each label and length: few beside the vectors.
    members = indexed.select("node", "label", "dim", F.explode(F.concat(F.array("home"), "probes")).alias("list"), "home")
    sizes = materialize(members.groupBy("label", "dim", "list").agg(F.count("*").alias("n"), F.count_if(F.col("home") == F.col("list")).alias("homes")).where("n > 1 and homes > 0"), "lists")
    placed = members.join(sizes, ["label", "dim", "list"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    places = placed.groupBy("node").agg(F.collect_list(F.struct("list", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("side"))).alias("to"))
    sent = indexed.join(places, "node").withColumn("p", F.explode("to")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
    tile = ["label", "dim", "list", "lo", "hi"]
    sent = sent.select("node", "copies", "vec", "home", "probes", "code", "error", F.col("p.side").cast("int").alias("side"), "label", "dim", F.col("p.list").alias("list"), F.least("p.side", "other").alias("lo"), F.greatest("p.side", "other").alias("hi"))

    names = sent.columns

    def run(parts):
        key, held = None, []
        for part in parts:
            for *row, label, dim, at, lo, hi in zip(*(part.column(c).to_pylist() for c in names)):
                if (label, dim, at, lo, hi) != key:
                    if len(held) > 1:
                        yield from Tile(held, model, single, key[2], cosine).result()
                    key, held = (label, dim, at, lo, hi), []
                held.append(row)
        if len(held) > 1:
            yield from Tile(held, model, single, key[2], cosine).result()

    return map_groups(sent.repartition(*tile).sortWithinPartitions(*tile), run, _schema(u=_L, v=_L, n=_L), 1 << 20)


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, z: float | None = Z, block: int = BLOCK) -> DataFrame:
    """One row for each input row: doc, n_links, component (the smallest linked id) and kept."""
    spark = df.sparkSession
    before = written(spark)
    made, single = _rows(df, id_col, vec_col, label_col)
    rows = materialize(made, "vectors")
    kept = written(spark)[-1]
    named = rows.where("digest is not null")
    grouped = named.groupBy("digest").agg(F.min("doc").alias("doc"), F.count("*").alias("copies"), F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))
    # Numbers are fixed once the table is written.
    nodes = materialize(grouped.select(F.monotonically_increasing_id().alias("node"), "*"), "nodes")
    found = nodes.agg(F.count("*").alias("n"), F.max(F.length("vec")).alias("longest")).first()
    if not found.n:
        return rows.select("doc", F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("component"), F.col("doc").isNotNull().alias("kept"))
    model = fit(_sample(nodes, single, found.longest // (4 if single else 8)), found.n, z)
    indexed = materialize(index(nodes.select("node", "label", "copies", "vec"), model, single, cosine), "index")
    links = materialize(compare(indexed, model, single, cosine, block), "links", 4 * found.n)
    # Rows with one id and several vectors are one node of a class.
    number = nodes.select("digest", "node")
    ids = named.where("doc is not null").select("doc", "digest").distinct().join(number, "digest")
    twice = ids.groupBy("doc").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v <> w").select("doc", "v")
    alike = ids.join(twice, "doc").select(F.col("node").alias("u"), "v")
    classes = connected_components(links.where("v is not null").select("u", "v").unionByName(alike), found.n)
    counts = links.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    own = nodes.select("node", "digest", "doc", "copies").join(classes, "node", "left").join(counts, "node", "left")
    smallest = materialize(own.where("component is not null").groupBy("component").agg(F.min("doc").alias("low")), "smallest", found.n)
    judged = own.join(smallest, "component", "left").select("digest", F.coalesce("low", "doc").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    judged = materialize(judged, "judged", found.n)
    release(spark, [x for x in written(spark)[:-1] if x != kept and x not in before])
    out = rows.select("doc", "digest").join(judged, "digest", "left").select("doc", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "doc").alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("doc") == F.col("component"), F.lit(False)))
