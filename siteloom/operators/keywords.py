"""Keywords: n-gram frequencies of a page and over all pages.

All n-grams of a page are counted within its row, so no single word is ever shuffled. Rows are pages: repeated rows are counted each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import STOP_WORDS, plain_words, text_batches

TOP = {1: 10, 2: 10, 3: 5}
_STOP = frozenset(STOP_WORDS)


def counted(text: str, sizes: tuple[int, ...], top: dict[int, int] | None = None) -> Iterator[tuple]:
    """ngram_size, keyword, frequency, first position, density in percent of the kept words and rank by frequency, then first position."""
    words = [w for w in plain_words(text, 2) if w not in _STOP]
    for n in sizes:
        grams = words if n == 1 else list(map(" ".join, zip(*(words[k:] for k in range(n)))))
        first: dict[str, int] = {}
        for at, g in enumerate(grams):
            first.setdefault(g, at)
        # Counter keeps the order of first occurrence and sorts stably, so ties go to the first.
        for rank, (g, count) in enumerate(Counter(grams).most_common(top[n] if top else None), 1):
            yield n, g, count, first[g], count, len(words), rank


def _rows(df: DataFrame, key: str, text: str, sizes: tuple[int, ...], top: dict[int, int] | None) -> DataFrame:
    shape = [("ngram_size", T.IntegerType()), ("keyword", T.StringType()), ("frequency", T.LongType()), ("first_position", T.IntegerType()), ("_f", T.LongType()), ("_n", T.LongType()), ("rank", T.IntegerType())]
    schema = T.StructType([df.schema[key], *[T.StructField(n, t) for n, t in shape]])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for part in text_batches(batches, 1 << 20):
            rows = [(k, *x) for k, t in zip(part.column(key).to_pylist(), part.column(text).to_pylist()) for x in counted(t or "", sizes, top)]
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[at : at + 50_000]), target)], schema=target)

    return df.select(key, text).mapInArrow(run, schema).select(key, "ngram_size", "keyword", "frequency", "first_position", F.round(100.0 * F.col("_f") / F.col("_n"), 2).alias("density"), "rank")


def page_ngrams(df: DataFrame, key: str = "doc_id", text: str = "text", sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """All n-grams of each page: key, ngram_size, keyword, frequency, first_position, density and rank."""
    return _rows(df, key, text, sizes, None)


def top_ngrams(df: DataFrame, key: str = "doc_id", text: str = "text", top: dict[int, int] | None = None) -> DataFrame:
    """The most frequent n-grams of each page and size, by first occurrence among equals."""
    top = top or TOP
    return _rows(df, key, text, tuple(sorted(top)), top)


def target_keywords(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The page's most frequent single word."""
    return _rows(df, key, text, (1,), {1: 1}).select(key, F.col("keyword").alias("target"), "frequency")


def cannibalised(targets: DataFrame, key: str = "doc_id") -> DataFrame:
    return targets.groupBy("target").agg(F.count("*").alias("pages"), F.min(key).alias("first_page")).where("pages > 1")
