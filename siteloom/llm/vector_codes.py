"""Product codes of vectors in exact integers: codebooks by rounds of assignment and averaging, nearest entries by annular norm pruning.

Components become ``floor(1024 * x)``. A vector is cut into four equal parts; each part position has a codebook of 256 entries, which starts as that
part of the vectors with the smallest ids. A round assigns every part of every vector in tasks, which return sums and counts for each entry only; the driver holds the
codebooks (256 times the components of a vector) and nothing that grows with the vectors.

Nearest entry: the entries are sorted by norm. An entry whose norm differs from the part's by more than the best distance so far can't be nearer, so a binary search gives the annulus of entries
that can; they are evaluated outwards from the part's own norm, in steps behind each of which the annulus is narrowed. It includes its borders, so the lowest index among equally near entries wins.

Defined results: vectors that are null or hold null or non-finite components are dropped; so are those that can't be cut like the others (empty, not a multiple of four components, or of another length than the
first vector in order that can be), and those with a component so large (2^28 steps at 64 components) that squared distances wouldn't fit 64 bits. Rows are taken in the order of id, then of components; null ids come last. Rows with
one id are vectors of their own. With fewer than 256 vectors the codebooks are shorter. An empty table gives no rows. Columns other than the three named are not read.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.materialize import drop_materialized, materialize
from .batches import bound_batches, map_rows, release, slices

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries that are evaluated at a step on each side; components of a partial sum that share a row.
STEP, SUMS = 16, 16
#: Parts whose nearest entries are sought together.
PARTS_AT_ONCE = 2048


def largest_step(dim: int) -> int:
    """Bound of a component's magnitude, from which the squared distance of two vectors stays below 2^62."""
    return int(math.sqrt(2.0**62 / dim) / 2)


@dataclass
class Book:
    """One part position's entries (entries x components), and their order by norm."""

    entries: np.ndarray

    def __post_init__(self) -> None:
        norms = np.sqrt((self.entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], self.entries[self.order]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part; the lowest index where several are equally near."""
        found = [self._nearest(parts[k : k + PARTS_AT_ONCE]) for k in range(0, len(parts), PARTS_AT_ONCE)]
        return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (np.zeros(0, np.int64),) * 2

    def _nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, size = len(parts), len(self.order)
        norm = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        left = np.searchsorted(self.norms, norm)  # evaluated: entries left..right-1
        right = left.copy()
        best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, size)
        low, high = np.zeros(n, np.int64), np.full(n, size)
        offsets = np.arange(STEP)
        active = np.arange(n)
        while len(active):
            at = np.concatenate([left[active, None] - 1 - offsets, right[active, None] + offsets], axis=1)
            inside = (at >= low[active, None]) & (at < high[active, None])
            row, column = np.nonzero(inside)
            entry = at[row, column]
            diff = parts[active[row]] - self.sorted[entry]
            d = np.full(at.shape, np.iinfo(np.int64).max)
            d[row, column] = np.einsum("ij,ij->i", diff, diff)
            name = np.full(at.shape, size)
            name[row, column] = self.order[entry]
            least = d.min(1)
            first = np.where(d == least[:, None], name, size).min(1)
            nearer = (least < best[active]) | ((least == best[active]) & (first < index[active]))
            best[active[nearer]], index[active[nearer]] = least[nearer], first[nearer]
            left[active], right[active] = left[active] - STEP, right[active] + STEP
            # The annulus of the best distance; wider by rounding errors, never narrower.
            reach = np.sqrt(best[active].astype(np.float64))
            slack = 1e-9 * (norm[active] + reach) + 1e-9
            low[active] = np.searchsorted(self.norms, norm[active] - reach - slack, side="left")
            high[active] = np.searchsorted(self.norms, norm[active] + reach + slack, side="right")
            active = active[(left[active] > low[active]) | (right[active] < high[active])]
        return index, best


@dataclass
class Codebooks:
    """All part positions' entries: parts x entries x components."""

    entries: np.ndarray

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entries (vectors x parts) and their squared distances."""
        cut = vectors.reshape(len(vectors), len(self.entries), -1)
        found = [Book(e).nearest(cut[:, p]) for p, e in enumerate(self.entries)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _ints(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dim).astype(np.int64)


def integers(df: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """doc, label, dim and ints (packed 32-bit integers) of the rows that can be cut."""
    x = F.col(vec_col).cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & (F.size(x) > 0) & (F.size(x) % PARTS == 0)
    sent = df.select(F.col(id_col).alias("doc"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec")).where(whole)
    sent = sent.withColumn("vec", F.transform(F.col("vec").cast("array<double>"), lambda v: F.least(F.greatest(F.lit(float(SCALE)) * v, F.lit(-2.0**31)), F.lit(2.0**31 - 1))))
    schema = T.StructType([sent.schema["doc"], sent.schema["label"], T.StructField("dim", T.IntegerType()), T.StructField("ints", T.BinaryType())])

    def run(part: pa.RecordBatch) -> dict:
        vecs = part.column("vec")
        sizes = vecs.value_lengths().to_numpy()
        ends = sizes.cumsum()
        flat = np.floor(vecs.flatten().to_numpy()).astype(np.int64)
        fits = [int(np.abs(flat[b - n : b]).max()) <= largest_step(n) for n, b in zip(sizes.tolist(), ends.tolist())]
        flat = flat.astype("<i4")
        keep = pa.array(fits)
        packed = [flat[b - n : b].tobytes() for n, b, f in zip(sizes.tolist(), ends.tolist(), fits) if f]
        return {"doc": part.column("doc").filter(keep), "label": part.column("label").filter(keep), "dim": sizes[np.array(fits, dtype=bool)], "ints": packed}

    return map_rows(sent, run, schema)


def _sums(vectors: DataFrame, books: Codebooks) -> list:
    """Count and sums of the parts assigned to each entry: rows of part, entry, slice, n and s0 to s15."""
    schema = T.StructType([T.StructField(c, T.IntegerType()) for c in ("part", "entry", "slice")] + [T.StructField("n", T.LongType())] + [T.StructField(f"s{k}", T.LongType()) for k in range(SUMS)])
    parts, entries, width = books.entries.shape
    bound_batches(vectors)

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, -(-width // SUMS) * SUMS), np.int64)
        for part in slices(batches):
            v = _ints(part.column("ints"), books.dim)
            at, _ = books.assign(v)
            cut = v.reshape(len(v), parts, -1)
            for p in range(parts):
                count[p] += np.bincount(at[:, p], minlength=entries)
                order = np.argsort(at[:, p], kind="stable")
                used, first = np.unique(at[order, p], return_index=True)
                if len(used):
                    total[p, used, :width] += np.add.reduceat(cut[order, p], first, axis=0)
        p, e = np.nonzero(count)
        for k in range(total.shape[2] // SUMS):
            each = total[p, e, k * SUMS : (k + 1) * SUMS]
            columns = [p, e, np.full(len(p), k), count[p, e], *each.T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), type=pa.int32() if i < 3 else pa.int64()) for i, c in enumerate(columns)], names=schema.names)
        release()

    partial = vectors.select("ints").mapInArrow(run, schema)
    return partial.groupBy("part", "entry", "slice").agg(F.sum("n").alias("n"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(SUMS)]).collect()


def fit(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks | None:
    """Codebooks over all rows of ``integers``, which have one length; null if there are none."""
    first = vectors.orderBy(F.col("doc").asc_nulls_last(), "ints").limit(entries).select("ints", "dim").collect()
    if not first:
        return None
    start = np.stack([np.frombuffer(r.ints, dtype="<i4") for r in first]).astype(np.int64)
    books = Codebooks(np.ascontiguousarray(start.reshape(len(start), PARTS, -1).swapaxes(0, 1)))
    for _ in range(rounds):
        new = books.entries.copy()
        width = new.shape[2]
        for r in _sums(vectors, books):
            at = r.slice * SUMS
            new[r.part, r.entry, at : at + SUMS] = [r[f"s{k}"] // r.n for k in range(min(SUMS, width - at))]
        books = Codebooks(new)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """doc, label, code (two hex digits a part) and error (squared distance) of every row of ``integers``."""
    schema = T.StructType([vectors.schema["doc"], vectors.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(part: pa.RecordBatch) -> dict:
        at, distance = books.assign(_ints(part.column("ints"), books.dim))
        return {"doc": part.column("doc"), "label": part.column("label"), "code": [c.tobytes().hex() for c in at.astype(np.uint8)], "error": distance.sum(1)}

    return map_rows(vectors.select("doc", "label", "ints"), run, schema)


def quantise(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """doc, code, error, label_error (sum over equal labels, nulls together) and codebooks_sha256."""
    every = materialize(integers(df, id_col, vec_col, label_col), "integers")
    first = every.orderBy(F.col("doc").asc_nulls_last(), "ints").select("dim").first()
    vectors = every.where(F.col("dim") == (first.dim if first else 0))
    books = fit(vectors, rounds)
    kind = every.schema["doc"].dataType
    if books is None:
        return every.limit(0).select("doc", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256")).withColumn("doc", F.col("doc").cast(kind))
    coded = materialize(encode(vectors, books), "coded")
    drop_materialized(every)
    # One row for each label: written, so that a hot label's rows can be split from plain exchanges.
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return joined.select("doc", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
