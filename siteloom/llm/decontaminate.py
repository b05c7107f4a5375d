"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage.

Items are the indexed documents. Their BM25 weights are divided by the item's own total, so that a passage holding all
words of an item scores 1 for it, and one threshold serves all items. A passage is the bag of distinct words of two
adjacent halves of ``MIN_HALF`` words or, for longer items, twice that and so on: each class of lengths has an index and
halves of its own, so that an item lies whole in one passage wherever it stands, however long it is.

Retrieval is block-max WAND with blocks of adjacent items. A passage whose words' upper bounds sum below the threshold
is left at once; then the words' block maxima are summed for each block, and only blocks that can reach the threshold
are searched with WAND's pivots. All items at or above the threshold are retrieved, none is cut off.

A retrieved item counts as leaked when ``MIN_OVERLAP`` of the five-word shingles of its text and, where there is a column of
answers, of its answer stand in the passage. The overlap of an answer that is not given is null.

The index is broadcast only in shards of bounded size: items are dealt to as many shards as their measured bytes need,
each of which is one pass over the documents.

Defined results: null or empty texts and items match nothing; items without five words in a part are compared as one
shingle; equal items are all reported; rows with equal ids are searched each, so repeated rows have repeated results; of equally good passages of a
document the first is reported; other columns are not read; equal names of the two ids, or of an id and a result, raise ``ValueError``; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import map_rows
from .kernels import SEPARATOR, char_offsets, lower_utf8, span_digests, window_digests, words

K1, B, THRESHOLD, MIN_OVERLAP, SHINGLE_WORDS = 1.2, 0.75, 0.5, 0.5, 5
#: Items in a block; the shortest passage half in words; bytes of item texts in one broadcast index.
BLOCK, MIN_HALF, SHARD_BYTES = 4, 64, 16 << 20
_U = np.uint64

#: Words end at white space and ASCII punctuation, so that marks beside a word don't hide it.
_CUT = SEPARATOR.copy()
_CUT[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _digests(text: str | None) -> tuple[np.ndarray, object]:
    w = words(lower_utf8(text), _CUT)
    return span_digests(w.data, w.start, w.end), w


class Index:
    """Postings by term in item order, with item-normalised weights, term maxima and block maxima."""

    def __init__(self, items: list[tuple], df: Counter | None = None, n: int | None = None, mean: float | None = None):
        parsed = []
        for item, text, answer in items:
            d, _ = _digests(text)
            if len(d):
                parsed.append((item, d, _digests(answer)[0]))
        self.items = [p[0] for p in parsed]
        self.question = [window_digests(p[1], SHINGLE_WORDS) for p in parsed]
        self.answer = [window_digests(p[2], SHINGLE_WORDS) for p in parsed]
        self.windows = [(min(SHINGLE_WORDS, len(p[1])), min(SHINGLE_WORDS, len(p[2]))) for p in parsed]
        bags = [Counter(p[1].tolist()) for p in parsed]
        df = df if df is not None else Counter(t for b in bags for t in b)
        n, mean = n or max(1, len(bags)), mean or max(1.0, float(np.mean([len(p[1]) for p in parsed]))) if parsed else 1.0
        self.half = max([MIN_HALF, *(len(p[1]) + len(p[2]) for p in parsed)])
        postings: dict[int, list[tuple[int, float]]] = {}
        for k, bag in enumerate(bags):
            size = sum(bag.values())
            weight = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in bag.items()}
            total = sum(weight.values())
            for t, w in weight.items():
                postings.setdefault(t, []).append((k, w / total))
        self.vocabulary = np.array(sorted(postings), dtype=_U)
        lists = [postings[t] for t in self.vocabulary.tolist()]
        self.at = np.cumsum([0, *map(len, lists)])
        self.doc = np.array([k for p in lists for k, _ in p], dtype=np.int64)
        self.weight = np.array([w for p in lists for _, w in p])
        self.term_max = np.array([max(w for _, w in p) for p in lists]) if lists else np.zeros(0)
        blocks = []
        for p in lists:
            top: dict[int, float] = {}
            for k, w in p:
                top[k // BLOCK] = max(top.get(k // BLOCK, 0.0), w)
            blocks.append(sorted(top.items()))
        self.block_at = np.cumsum([0, *map(len, blocks)])
        self.block = np.array([b for p in blocks for b, _ in p], dtype=np.int64)
        self.block_max = np.array([w for p in blocks for _, w in p])
        # Where each block's postings of a term begin and end.
        block_of = self.doc // BLOCK
        starts = np.flatnonzero(np.concatenate([[True], (block_of[1:] != block_of[:-1])])) if len(block_of) else np.zeros(0, dtype=np.int64)
        self.post_at = np.unique(np.concatenate([starts, self.at[:-1], self.at[-1:]])) if len(block_of) else np.zeros(1, dtype=np.int64)
        self.docs, self.weights = self.doc.tolist(), self.weight.tolist()
        self.n_blocks = (len(self.items) + BLOCK - 1) // BLOCK

    def wand(self, entries: list[int], threshold: float) -> list[tuple[int, float]]:
        """All items of a block with a score of ``threshold`` or more, by pivots over cursors into its postings.

        ``entries`` are the block's posting runs of the passage's words; each run's maximum is its upper bound.
        """
        docs, weights, post_at = self.docs, self.weights, self.post_at
        cursors = [[docs[a := int(post_at[e])], a, int(post_at[e + 1]), float(self.block_max[e])] for e in entries]
        found = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound >= threshold - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    score += weights[c[1]]
                if score >= threshold - 1e-9:
                    found.append((pivot, score))
                past = pivot + 1
            else:
                past = pivot
            left = []
            for c in cursors:
                if c[0] < past:
                    at, end = c[1] + 1, c[2]
                    while at < end and docs[at] < past:
                        at += 1
                    if at == end:
                        continue
                    c[0], c[1] = docs[at], at
                left.append(c)
            cursors = left
        return found

    def retrieve(self, d: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """Passage number, item and score of all that reach the threshold."""
        if not len(d) or not len(self.vocabulary):
            return []
        term = np.minimum(np.searchsorted(self.vocabulary, d), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[term] == d)
        if not len(at):
            return []
        term, chunk = term[at], at // self.half
        last = (len(d) - 1) // self.half
        size = len(self.vocabulary)
        # Passage p is the halves p and p + 1; a text of one half is one passage.
        count = max(1, last)
        pairs = np.unique(np.concatenate([c[ok] * size + term[ok] for c, ok in ((chunk, chunk < count), (chunk - 1, chunk > 0))]))
        passage, term = pairs // size, pairs % size
        total = np.bincount(passage, weights=self.term_max[term], minlength=count)
        live = total[passage] >= threshold - 1e-9
        passage, term = passage[live], term[live]
        if not len(passage):
            return []
        spans = self.block_at[term + 1] - self.block_at[term]
        first = np.cumsum(spans) - spans
        where = np.arange(int(spans.sum())) - np.repeat(first, spans) + np.repeat(self.block_at[term], spans)
        key = np.repeat(passage, spans) * self.n_blocks + self.block[where]
        low = int(key.min())
        bound = np.bincount(key - low, weights=self.block_max[where])
        live = bound[key - low] >= threshold - 1e-9
        key, where = key[live], where[live]
        order = np.argsort(key, kind="stable")
        key, where = key[order], where[order]
        cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1)).tolist() if len(key) else []
        out = []
        for a, b in zip(cuts, cuts[1:]):
            out += [(int(key[a]) // self.n_blocks, item, score) for item, score in self.wand(where[a:b].tolist(), threshold)]
        return out

    def leaks(self, d: np.ndarray) -> list[tuple]:
        """item id, first word and word behind the passage, score, question and answer overlap: the best passage of each leaked item."""
        best: dict[int, tuple] = {}
        for p, item, score in self.retrieve(d):
            lo, hi = p * self.half, min(len(d), (p + 2) * self.half)
            overlap = [float(np.isin(x, window_digests(d[lo:hi], n)).mean()) for x, n in zip((self.question[item], self.answer[item]), self.windows[item]) if len(x)]
            if min(overlap) >= MIN_OVERLAP and (sum(overlap), score, -p) > best.get(item, ((-1, 0, 0), 0))[0]:
                best[item] = ((sum(overlap), score, -p), (lo, hi, score, overlap[0], overlap[1] if len(overlap) > 1 else None))
        return [(self.items[k], *hit) for k, (_, hit) in sorted(best.items())]


class Indexes:
    """An index for each class of item lengths (question and answer; up to MIN_HALF words, twice that and so on), with the statistics of all."""

    def __init__(self, items: list[tuple], df: Counter | None = None, n: int | None = None, mean: float | None = None):
        classes: dict[int, list[tuple]] = {}
        sizes, counts = [], Counter()
        for row in items:
            d = _digests(row[1])[0]
            if len(d):
                sizes.append(len(d))
                counts.update(set(d.tolist()))
                long = max(0, -(-(len(d) + len(_digests(row[2])[0])) // MIN_HALF) - 1).bit_length()
                classes.setdefault(long, []).append(row)
        df, n, mean = (df, n, mean) if df is not None else (counts, len(sizes), float(np.mean(sizes)) if sizes else 1.0)
        self.parts = [Index(rows, df, n, mean) for _, rows in sorted(classes.items())]

    def leaks(self, text: str | None) -> list[tuple]:
        """item id, first and last character of the passage, score, question and answer overlap: the best passage of each leaked item."""
        d, w = _digests(text)
        found = [hit for part in self.parts for hit in part.leaks(d)]
        if not found:
            return []
        at = char_offsets(w.data)
        return [(item, int(at[w.start[lo]]), int(at[w.end[hi - 1]]), *rest) for item, lo, hi, *rest in found]


def shards(items: DataFrame, id_col: str, text_col: str, answer_col: str | None = None):
    """Indexes over all items, each over texts of at most about ``SHARD_BYTES``; statistics are those of all items."""
    answer = F.col(answer_col) if answer_col else F.lit(None).cast("string")
    rows = items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text"), answer.alias("answer"))
    sizes = rows.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0))), F.lit(0)).alias("bytes")).first()
    count = int(sizes["bytes"] // SHARD_BYTES) + 1
    if count == 1:
        yield Indexes([tuple(r) for r in rows.collect()])
        return
    # Document frequencies of all items, for the words of one shard at a time.
    schema = T.StructType([T.StructField("term", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("size", T.LongType())])
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("text", F.col("item").cast("string")), F.lit(count)).cast("int"))

    def run(part: pa.RecordBatch) -> dict:
        out = {"term": [], "shard": [], "size": []}
        for text, shard in zip(part.column("text").to_pylist(), part.column("shard").to_pylist()):
            d, _ = _digests(text)
            each = np.unique(d).view(np.int64).tolist()
            out["term"] += each
            out["shard"] += [shard] * len(each)
            out["size"] += [len(d) if k == 0 else 0 for k in range(len(each))]
        return out

    terms = map_rows(dealt.select("text", "shard"), run, schema)
    whole = terms.agg(F.sum("size").alias("words"), F.sum(F.when(F.col("size") > 0, 1)).alias("n")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("n"))
    for k in range(count):
        own = terms.where(F.col("shard") == k).select("term").distinct()
        counts = Counter({int(np.int64(r["term"]).view(_U)): r["n"] for r in df.join(own, "term").toLocalIterator()})
        yield Indexes([(r["item"], r["text"], r["answer"]) for r in dealt.where(F.col("shard") == k).collect()], counts, whole["n"], whole["words"] / max(1, whole["n"]))


def leaked(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """A row for each document and test item that it holds: ids, the passage's offsets, BM25 score and overlaps."""
    spark = docs.sparkSession
    doc_type, item_type = docs.schema[doc_col].dataType, items.schema[item_col].dataType
    names = ("passage_start", "passage_end", "bm25", "question_overlap", "answer_overlap")
    if doc_col == item_col or {doc_col, item_col} & set(names):
        raise ValueError(f"the result can't name {doc_col} and {item_col} beside {names}")
    types = (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([T.StructField("doc", doc_type), T.StructField("item", item_type), *map(T.StructField, names, types)])
    out = None
    for index in shards(items, item_col, item_text, answer_col):
        shared = spark.sparkContext.broadcast(index)

        def run(part: pa.RecordBatch, shared=shared) -> dict | None:
            found = [(doc, *hit) for doc, text in zip(part.column("doc").to_pylist(), part.column("text").to_pylist()) for hit in shared.value.leaks(text)]
            return dict(zip(schema.names, map(list, zip(*found)))) if found else None

        rows = map_rows(docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")), run, schema)
        out = rows if out is None else out.unionByName(rows)
    return out.select(F.col("doc").alias(doc_col), F.col("item").alias(item_col), *names)


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None) -> DataFrame:
    """The rows whose text holds no test item, in one pass for each shard of the index and without a shuffle."""
    names, schema = docs.columns, docs.schema
    for index in shards(items, item_col, item_text, answer_col):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(part: pa.RecordBatch, shared=shared) -> dict:
            clean = pa.array([not shared.value.leaks(t) for t in part.column(text_col).to_pylist()], type=pa.bool_())
            kept = part.filter(clean)
            return {n: kept.column(n) for n in names}

        docs = map_rows(docs, run, schema)
    return docs
