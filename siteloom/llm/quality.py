"""Quality rules: text statistics and zstandard compression bands.

A text's compression ratio is its compressed size over its size in UTF-8. Repetitive text falls below the
band of its length, incompressible text (random letters, encoded data) rises above it; short texts compress
badly by nature, so the limits depend on length. The same is asked of fixed chunks, which catches a long
text that is only in part junk: it is rejected when half of its chunks or more lie outside the chunk band.

Good text of one length lies in a narrow range of ratios, which differs by language and source, so limits are fitted: ``fit_limits`` takes all
texts that are labelled good and sets each half-octave of lengths to the range of their ratios with a margin. Lengths with too
few labelled texts, and corpora without labels, have the wide default bands, which reject what is plainly repetitive or random.

Defined results: a null or empty text has zero counts, no ratio and fails the base rules; texts are judged
whole, however long; each row is judged by itself, so repeated rows have equal verdicts and an empty table
gives an empty result; other columns pass through, and clashing names are refused with ``ValueError``.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.materialize import drop_materialized, materialize
from .batches import map_rows
from .kernels import window_digests, span_digests, words


class Band(NamedTuple):
    """Limits of the ratio for texts of at least ``size`` bytes."""

    size: int
    low: float
    high: float


#: By length. Under 256 bytes a ratio says little, so nothing is rejected for it there.
DOCUMENT_BANDS = (Band(0, 0.0, 9.0), Band(256, 0.30, 1.00), Band(512, 0.27, 0.80), Band(1024, 0.25, 0.72), Band(2048, 0.22, 0.68), Band(8192, 0.18, 0.66), Band(65536, 0.14, 0.66))
#: Of chunks of CHUNK bytes; a last chunk under half of that is judged with the whole text only.
CHUNK, CHUNK_BAND, CHUNK_SHARE, LEVEL = 4096, Band(2048, 0.22, 0.70), 0.5, 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled texts of one length at least; the share of them that may lie outside, and the margin in standard deviations.
MIN_LABELLED, OUTSIDE, MARGIN = 60, 0.001, (0.5, 1.0)
#: Lengths from which a band is fitted: half-octaves and those of the default bands.
EDGES = sorted({b.size for b in DOCUMENT_BANDS} | {int(256 * 2 ** (k / 2)) for k in range(24)})
#: Limits are fitted on ratios in whole steps, whose sums are exact in any order; so many steps make a bin of the first count.
STEPS, BIN = 1 << 20, 1 << 10
SYMBOLS = b"#*$%&|<>"
WHITE = " \t\n\v\f\r"

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[list(SYMBOLS)] = True

COLUMNS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("word_chars", T.LongType()),
        T.StructField("n_symbols", T.LongType()),
        T.StructField("n_dup_lines", T.LongType()),
        T.StructField("n_repeat_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("zstd_ratio", T.DoubleType()),
        T.StructField("bad_chunks", T.LongType()),
        T.StructField("n_chunks", T.LongType()),
        T.StructField("reason", T.StringType()),
        T.StructField("kept", T.BooleanType()),
    ]
)


def repeated_words(digests: np.ndarray, n: int = 3) -> int:
    """How many words lie in an n-word window that is found twice or more."""
    if len(digests) < n + 1:
        return 0
    w = window_digests(digests, n)
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    twice = np.zeros(len(digests), dtype=bool)
    for at in (order[1:][same], order[:-1][same]):
        for k in range(n):
            twice[at + k] = True
    return int(np.count_nonzero(twice))


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    met: set[str] = set()
    found = 0
    for line in text.split("\n"):
        if line in met:
            found += 1
        elif line.strip(WHITE):
            met.add(line)
    return found


def band_of(size: int, bands: tuple[Band, ...]) -> Band:
    return max((b for b in bands if b.size <= size), key=lambda b: b.size)


class Limits(NamedTuple):
    documents: tuple[Band, ...] = DOCUMENT_BANDS
    chunk: Band = CHUNK_BAND


def ratios(raw: bytes, compress) -> tuple[float | None, list[float]]:
    """The ratio of a text and those of its chunks; a text that is one chunk has its own."""
    if not raw:
        return None, []
    whole = len(compress(raw)) / len(raw)
    chunks = [raw[at : at + CHUNK] for at in range(0, len(raw), CHUNK)]
    return whole, [whole if len(c) == len(raw) else len(compress(c)) / len(c) for c in chunks if len(c) >= CHUNK_BAND.size]


def base(raw: bytes) -> tuple:
    """The words of a text, how many are repeated, and whether it fails the base rules."""
    w = words(raw)
    n = len(w.start)
    repeat = repeated_words(span_digests(w.data, w.start, w.end))
    return w, repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n


def judge(text: str, compress, limits: Limits = Limits()) -> tuple:
    raw = text.encode("utf-8", "surrogatepass")
    w, repeat, failed = base(raw)
    n = len(w.start)
    points = int(np.count_nonzero((w.data & 0xC0) != 0x80))
    ratio, each = ratios(raw, compress)
    bad, reason = sum(not limits.chunk.low <= r <= limits.chunk.high for r in each), None
    if raw:
        band = band_of(len(raw), limits.documents)
        reason = "repetitive" if ratio < band.low else "incompressible" if ratio > band.high else "chunks" if each and bad >= CHUNK_SHARE * len(each) else None
    reason = "base" if failed else reason
    return n, points - w.separators, int(np.count_nonzero(_IS_SYMBOL[w.data])), dup_lines(text), repeat, failed, ratio, bad, len(each), reason, reason is None


def _limits(range_of: Callable[[int], tuple[float, float] | None]) -> Limits:
    """Limits from the range of each edge's lengths, and of chunks behind the last edge; None where too few texts are labelled."""
    bands = []
    for k, low in enumerate(EDGES):
        band = band_of(low, DOCUMENT_BANDS)._replace(size=low)
        if low >= 256 and (found := range_of(k)):
            band = Band(low, max(band.low, found[0]), min(band.high, found[1]))
        bands.append(band)
    a, b = range_of(len(EDGES)) or (0.0, 9.0)
    return Limits(tuple(bands), Band(CHUNK_BAND.size, max(CHUNK_BAND.low, a), min(CHUNK_BAND.high, b)))


def _range(low: float, high: float, spread: float) -> tuple[float, float]:
    """Where nearly all values lie, with a margin: narrow below, wide above, where good text ends less sharply."""
    return low - MARGIN[0] * spread, high + MARGIN[1] * spread


def limits_of(sizes: np.ndarray, whole: np.ndarray, chunks: np.ndarray) -> Limits:
    """Limits from the sizes and ratios of good texts and the ratios of their chunks, all in memory."""

    def range_of(k: int) -> tuple[float, float] | None:
        here = whole[(sizes >= EDGES[k]) & (sizes < [*EDGES, 1 << 62][k + 1])] if k < len(EDGES) else chunks
        return _range(float(np.quantile(here, OUTSIDE)), float(np.quantile(here, 1 - OUTSIDE)), float(here.std())) if len(here) >= MIN_LABELLED else None

    return _limits(range_of)


def fit_limits(docs: DataFrame, labels: DataFrame, good: F.Column, id_col: str = "doc_id", text: str = "text") -> Limits:
    """Limits from all documents whose label is ``good``; texts that fail the base rules are left out.

    Of several documents with one id the one with the smallest ratio counts; null ids and labels count for nothing.
    Texts aren't shuffled: tasks turn all of them into ratios, those of labelled ones are counted by band and ratio. The driver gets counts of bins,
    then those of the single ratios in the bins where a quantile lies, so many at most by ``STEPS``, ``BIN`` and the number of bands.
    """
    marked = labels.where(good).select(F.col(id_col).cast("long").alias("doc"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("ratio", T.LongType()), T.StructField("band", T.IntegerType()), T.StructField("chunks", T.ArrayType(T.LongType()))])

    def run(part: pa.RecordBatch) -> dict:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        out = {"doc": [], "ratio": [], "band": [], "chunks": []}
        for doc, t in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()):
            raw = (t or "").encode("utf-8", "surrogatepass")
            if raw and not base(raw)[2]:
                whole, each = ratios(raw, compress)
                for name, value in zip(out, (doc, round(whole * STEPS), bisect_right(EDGES, len(raw)) - 1, [round(r * STEPS) for r in each])):
                    out[name].append(value)
        return out

    fitted = map_rows(rows, run, schema).join(marked.hint("merge"), "doc", "left_semi").groupBy("doc").agg(F.min(F.struct("ratio", "band", "chunks")).alias("r"))
    one = lambda band, ratio: F.struct(band.alias("band"), ratio.alias("ratio"))
    every = F.concat(F.array(one(F.col("r.band"), F.col("r.ratio"))), F.transform("r.chunks", lambda c: one(F.lit(len(EDGES)), c)))
    counts = materialize(fitted.select(F.inline(every)).groupBy("band", "ratio").agg(F.count("*").alias("n")), "ratios")
    limits = _limits(_ranges(counts).get)
    drop_materialized(counts)
    return limits


def _ranges(counts: DataFrame) -> dict[int, tuple[float, float]]:
    """The range of each band with enough texts, from the counts of ``band`` and ``ratio``: quantiles as numpy's, between two neighbours."""
    r, n = F.col("ratio").cast("decimal(19,0)"), F.col("n").cast("decimal(19,0)")
    bin_of = F.floor(F.col("ratio") / BIN)
    bins: dict[int, list] = {}
    for x in counts.groupBy("band", bin_of.alias("bin")).agg(F.sum("n").alias("n"), F.sum(n * r).alias("s"), F.sum((n * r).cast("decimal(19,0)") * r).alias("q")).orderBy("band", "bin").collect():
        bins.setdefault(x["band"], []).append(x)
    bins = {band: found for band, found in bins.items() if sum(x["n"] for x in found) >= MIN_LABELLED}
    wanted: dict[int, list[tuple[int, int, float]]] = {}
    for band, found in bins.items():
        ends = np.cumsum([x["n"] for x in found])
        for share in (OUTSIDE, 1 - OUTSIDE):
            at = (int(ends[-1]) - 1) * share
            for place, weight in ((int(at), 1 - at % 1), (min(int(at) + 1, int(ends[-1]) - 1), at % 1)):
                k = int(np.searchsorted(ends, place, side="right"))
                wanted.setdefault(band, []).append((found[k]["bin"], place - int(ends[k] - found[k]["n"]), weight))
    keys = sorted({(band << 32) + k for band, places in wanted.items() for k, _, _ in places})
    single: dict[tuple[int, int], list] = {}
    for x in counts.where(((F.col("band").cast("long") * (1 << 32)) + bin_of).isin(keys)).orderBy("band", "ratio").collect():
        single.setdefault((x["band"], x["ratio"] // BIN), []).append(x)
    out = {}
    for band, places in wanted.items():
        values = []
        for k, place, weight in places:
            ends = np.cumsum([x["n"] for x in single[band, k]])
            values.append(weight * single[band, k][int(np.searchsorted(ends, place, side="right"))]["ratio"] / STEPS)
        n, s, q = (sum(int(x[c]) for x in bins[band]) for c in ("n", "s", "q"))
        out[band] = _range(values[0] + values[1], values[2] + values[3], (n * q - s * s) ** 0.5 / n / STEPS)
    return out


def assess(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Add the statistics, the reason for a rejection and ``kept`` to every row."""
    if taken := {n.lower() for n in COLUMNS.names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} exist already")
    if not any(b.size == 0 for b in limits.documents):
        limits = limits._replace(documents=(Band(0, 0.0, 9.0), *limits.documents))

    def run(part: pa.RecordBatch) -> dict:
        import zstandard

        compress = zstandard.ZstdCompressor(level=LEVEL).compress
        rows = [judge(t or "", compress, limits) for t in part.column(text).to_pylist()]
        return {n: part.column(n) for n in part.schema.names} | dict(zip(COLUMNS.names, map(list, zip(*rows)) if rows else [[]] * len(COLUMNS)))

    return map_rows(df, run, T.StructType([*df.schema.fields, *COLUMNS.fields]))


def keep_good(df: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows that the rules keep, with their own columns only."""
    names = df.columns
    return assess(df.toDF(*[f"_{k}" for k in range(len(names))]), f"_{names.index(text)}", limits).where("kept").select(*[F.col(f"_{k}").alias(n) for k, n in enumerate(names)])
