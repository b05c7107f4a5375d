"""Substring deduplication by line and paragraph hashing.

Units are lines and paragraphs (lines up to an empty one, whatever they are wrapped at). They are normalised (A-Z lower-cased, white space
collapsed), their digests are grouped over all documents, the occurrence in the document with the smallest id, first in it, is kept,
and each later one of ``MIN_WORDS`` words or more is removed. What is removed keeps its offsets in the original text.

Passages that stand inside lines, in the middle of other words, equal no line. For these there is a third kind of unit, hashed, grouped and kept like
the others: windows over all words, whatever lines they stand in. Texts are cut at content-defined words (before a word where the
digest of it and the word ahead says so), and a window runs from each cut over two pieces and ``WINDOW_WORDS`` words
at least, so that a passage has the same inner windows wherever it stands and however it is wrapped. A run of windows that were met before is
removed when it spans ``MIN_WORDS`` words. Windows next to each other share a piece, so a run holds only words whose
order was met too, be it in one document or in several; each part of it is a span with the document that it was first met
in. Words before the first cut of a passage and behind its last may stay.

A document sends each of its digests once, and digests are counted with partial aggregation, so a line that stands in
a third of all documents costs one row for each task. Flags go back by a join that AQE can split.

Defined results: a null or empty text has no units and stays as it is; rows with a null id are compared with
themselves only, and what they repeat has a null ``kept_doc``; rows with equal ids count as one document; ties go to the smallest id; an empty table
gives no rows; other columns pass through; clashing names raise ``ValueError``.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.materialize import drop_materialized, files_for, materialize
from .batches import map_rows
from .kernels import char_offsets, lower_utf8, mix, run_digests, seeded, span_digests, words

#: Words of what is removed at least, and of a window.
MIN_WORDS, WINDOW_WORDS = 20, 6
#: Documents of a task that rewrites texts, on average.
TASK_DOCS = 20_000
#: Stands for a null id.
NO_DOC = -(1 << 63)
#: One word in CUT begins a window.
CUT = 4
_U = np.uint64
_PIECE = seeded(WINDOW_WORDS, 31) | _U(1)

SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("kept_doc", T.LongType()),
    ]
)


class Runs(NamedTuple):
    """Units of one kind: first word, word behind the last, digest and whether they count."""

    first: np.ndarray
    end: np.ndarray
    digest: np.ndarray
    used: np.ndarray


class Units:
    """The units of a text: word spans, lines, paragraphs of several lines, windows."""

    def __init__(self, text: str | None):
        w = words(lower_utf8(text))
        self.data, self.start, self.end = w.data, w.start, w.end
        n = len(w.start)
        d = span_digests(w.data, w.start, w.end)
        line = np.searchsorted(np.flatnonzero(w.data == 10), w.start) if n else np.zeros(0, dtype=np.int64)
        step = np.diff(line, prepend=-2)
        first = np.flatnonzero(step > 0)
        size = np.diff(first, append=n)
        self.lines = Runs(first, first + size, run_digests(d, first, 1), size >= MIN_WORDS)
        first = np.flatnonzero(step > 1)
        size = np.diff(first, append=n)
        several = line[first + size - 1] > line[first] if n else np.zeros(0, dtype=bool)
        self.paragraphs = Runs(first, first + size, run_digests(d, first, 2), (size >= MIN_WORDS) & several)
        cut = np.zeros(n, dtype=bool)
        if n:
            cut[0] = True
            with np.errstate(over="ignore"):
                cut[1:] |= mix(d[:-1] * _U(3) + d[1:]) % _U(CUT) == 0
        piece = np.flatnonzero(cut)
        digest = run_digests(d, piece, 2)
        bound = np.append(piece, n)
        # A window ends at the first cut that leaves it two pieces and WINDOW_WORDS words.
        behind = np.maximum(np.arange(len(piece)) + 2, np.searchsorted(bound, piece + WINDOW_WORDS))
        whole = int(np.searchsorted(behind, len(piece), side="right"))
        size = behind[:whole] - np.arange(whole)
        windows = size.astype(_U) + _U(3)
        with np.errstate(over="ignore"):
            for k in range(int(size.max(initial=0))):
                at = np.flatnonzero(size > k)
                windows[at] += digest[at + k] * _PIECE[k]
            windows = mix(windows)
        self.windows = Runs(piece[:whole], bound[behind[:whole]], windows, np.ones(whole, dtype=bool))

    def digests(self) -> np.ndarray:
        """The distinct digests of the units that count."""
        return np.unique(np.concatenate([r.digest[r.used] for r in (self.lines, self.paragraphs, self.windows)])).view(np.int64)


def _repeats(runs: Runs, known: np.ndarray, source: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Which units were met before, in another document or earlier in this one, and the document they were met in."""
    digest, used = runs.digest, runs.used
    flag, origin = np.zeros(len(digest), dtype=bool), np.full(len(digest), own, dtype=np.int64)
    if len(known) and len(digest):
        at = np.minimum(np.searchsorted(known, digest.view(np.int64)), len(known) - 1)
        hit = used & (known[at] == digest.view(np.int64))
        flag |= hit
        origin[hit] = source[at[hit]]
    # In this document the kept occurrence ends before the next one begins.
    at = np.flatnonzero(used)
    _, kept, which = np.unique(digest[at], return_index=True, return_inverse=True)
    flag[at] |= runs.first[at] >= runs.end[at[kept]][which]
    return flag, origin


def removals(u: Units, known: np.ndarray, source: np.ndarray, own: int) -> list[tuple[str, int, int, int, int]]:
    """kind, first word, word behind the last, number of words and source document of what is removed, in order."""
    n = len(u.start)
    if not n:
        return []
    out, taken = [], np.zeros(n, dtype=bool)
    for kind, runs in (("paragraph", u.paragraphs), ("line", u.lines)):
        flag, origin = _repeats(runs, known, source, own)
        for k in np.flatnonzero(flag).tolist():
            a, b = int(runs.first[k]), int(runs.end[k])
            if not taken[a]:  # else its paragraph is out already
                out.append((kind, a, b, b - a, int(origin[k])))
                taken[a:b] = True
    flag, origin = _repeats(u.windows, known, source, own)
    met = np.flatnonzero(flag)
    if len(met):
        cut, from_doc, done = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), 0
        for run in np.split(met, np.flatnonzero(np.diff(met) > 1) + 1):
            lo, hi = int(u.windows.first[run[0]]), int(u.windows.end[run[-1]])
            if hi - lo >= MIN_WORDS:
                begin = max(lo, done)
                from_doc[begin:hi] = np.repeat(origin[run], np.diff(u.windows.first[run], append=hi))[begin - lo :]
                cut[begin:hi] = True
                done = hi
        cut &= ~taken
        first = cut.copy()
        first[1:] &= ~cut[:-1] | (from_doc[1:] != from_doc[:-1])
        last = cut.copy()
        last[:-1] &= ~cut[1:] | (from_doc[1:] != from_doc[:-1])
        out += [("passage", a, b + 1, b + 1 - a, int(from_doc[a])) for a, b in zip(np.flatnonzero(first).tolist(), np.flatnonzero(last).tolist())]
    return sorted(out, key=lambda x: x[1])


def cut(u: Units, text: str, removed: list[tuple[str, int, int, int, int]]) -> tuple[str, list[tuple]]:
    """The text without what is removed, and the spans in code points of the original."""
    if not removed:
        return text, []
    at = char_offsets(u.data)
    newline = np.flatnonzero(u.data == 10)
    kept, spans, done = [], [], 0
    for kind, first, behind, n, source in removed:
        lo, hi = int(u.start[first]), int(u.end[behind - 1])
        if kind != "passage":  # whole lines, with their ends
            k = int(np.searchsorted(newline, lo))
            lo = int(newline[k - 1]) + 1 if k else 0
            k = int(np.searchsorted(newline, hi))
            hi = int(newline[k]) + 1 if k < len(newline) else len(u.data)
        elif behind < len(u.start):
            rest = int(u.start[behind])
            k = int(np.searchsorted(newline, hi))
            hi = rest if k == len(newline) or newline[k] >= rest else int(newline[k])
        a, b = int(at[lo]), int(at[hi])
        kept.append(text[done:a])
        spans.append({"kind": kind, "start": a, "end": b, "n_words": n, "kept_doc": source if source != NO_DOC else None})
        done = b
    kept.append(text[done:])
    return "".join(kept), spans


def repeated_units(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """The number of documents, and doc and an array of digest and first document, for each document that holds units first met in another one or repeats its own.

    Only these have to be read again.
    """
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("own", T.BooleanType()), T.StructField("units", T.ArrayType(T.LongType()))])
    none = np.zeros(0, dtype=np.int64)

    def run(part: pa.RecordBatch) -> dict:
        found = [Units(t) for t in part.column("text").to_pylist()]
        return {"doc": part.column("doc"), "own": [bool(removals(u, none, none, 0)) for u in found], "units": [u.digests() for u in found]}

    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null")
    units = materialize(map_rows(docs, run, schema), "units")
    count = units.count()
    about = 64 * count
    sent = units.select("doc", F.explode("units").alias("digest"))
    shared = sent.groupBy("digest").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc <> last_doc").select("digest", "first_doc")
    shared = materialize(shared, "shared", about)
    met = sent.join(shared, "digest").where("doc <> first_doc").select("doc", F.struct("digest", "first_doc").alias("unit"))
    own = units.where("own").select("doc", F.lit(None).cast(met.schema["unit"].dataType).alias("unit"))
    found = materialize(met.unionByName(own).groupBy("doc").agg(F.collect_list("unit").alias("met")), "met", about)
    for used in (units, shared):
        drop_materialized(used)
    return found, count


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans: str = "removed") -> DataFrame:
    """The rows with ``text_col`` without its repeated units, and ``spans``: what was removed, with original offsets."""
    if spans.lower() in {c.lower() for c in df.columns} or "_met" in df.columns or "_doc" in df.columns:
        raise ValueError(f"column {spans} exists already")
    met, count = repeated_units(df, id_col, text_col)
    joined = df.withColumn("_doc", F.col(id_col).cast("long")).join(met.select(F.col("doc").alias("_doc"), F.col("met").alias("_met")), "_doc", "left").select("_doc", *df.columns, "_met")
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(spans, T.ArrayType(SPAN))])

    def run(part: pa.RecordBatch) -> dict:
        texts, found = [], []
        for doc, text, seen in zip(part.column("_doc").to_pylist(), part.column(text_col).to_pylist(), part.column("_met")):
            if not text or not seen.is_valid and doc is not None:
                texts.append(text)
                found.append([])
                continue
            digest = source = np.zeros(0, dtype=np.int64)
            if seen.is_valid and len(seen):
                digest, source = (seen.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                order = np.argsort(digest)
                digest, source = digest[order], source[order]
            u = Units(text)
            own = doc if doc is not None else NO_DOC
            new, cuts = cut(u, text, removals(u, digest, source, own))
            texts.append(new)
            found.append(cuts)
        return {n: part.column(n) for n in names} | {text_col: texts, spans: found}

    return map_rows(joined.coalesce(files_for(df.sparkSession, count, TASK_DOCS)), run, schema)


def removed_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each removed span."""
    out = dedup(df.select(id_col, text_col), id_col, text_col).select(id_col, F.explode("removed").alias("r"))
    return out.select(id_col, "r.kind", "r.start", "r.end", "r.n_words", F.col("r.kept_doc").alias(f"kept_{id_col}"))
