"""Phrases that occur together more often than their parts would: n-gram counts over packed word ids, then scores of cuts.

1. Texts are read once. In a task, texts of a language are joined to chunks of about ``CHUNK_BYTES`` and cut into pieces and words; a chunk keeps its distinct
   words with their counts and its stream of local word numbers, zero standing for the end of a piece.
2. Words that occur ``LEAST`` times or more get dense 32-bit ids (one numbering for all languages, so an id names its language). All others break pieces: no phrase that occurs so often
   holds them. Each chunk gets the ids of its own words only, so the dictionary is never in one place.
3. Runs of ids are packed into fixed-width binary keys, sorted and run-length counted within the chunk and dealt by a hash into buckets, whose number grows with the words. A chunk sends
   one row to each bucket, its keys and counts as bytes; a task merges the rows of a bucket. A key counts once for each chunk at most, so a hot phrase makes no large bucket.
4. Pairs come first. The merge also names the chunks that hold each frequent pair, and phrases of three and four words are only packed where all their pairs are frequent.
5. Cuts, scores, containment and ranks are joins and aggregates over the frequent phrases.

Defined results: a null text is empty; a null language is ``und`` and one with rows of that name; words differ by bytes after A-Z are lower-cased; scores are floors of exact quotients; an
empty table gives no rows. Texts longer than a chunk are cut at ends of pieces; a single piece is never cut. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..plans.materialize import drop_materialized, materialize, release as free, written
from .batches import SLICE_BYTES, bound_batches, map_groups, release, slices

#: A phrase occurs so often at least; words of the longest; the share of a phrase's occurrences from which a longer one replaces it; phrases a language lists.
LEAST, WORDS, PERCENT, TOP = 30, 4, 80, 2000
SCORE = 2_000_000
#: Text of a chunk, and of all languages that a task holds before the largest goes.
CHUNK_BYTES, HELD_BYTES = 6 << 20, 18 << 20
#: Keys of all chunks in a bucket, about.
PLACES = 1 << 20
#: Groups in which a language's best phrases are sought before they meet.
SALTS = 64
_L, _B, _I, _S = T.LongType(), T.BinaryType(), T.IntegerType(), T.StringType()
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# Chunks


def word_stream(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, their counts, and the stream of word numbers (from 1) with zeros between pieces. ``raw`` is folded: pieces end at newlines."""
    data = np.frombuffer(raw, dtype=np.uint8)
    sep = (data == 32) | (data == 10)
    edge = np.diff(sep.view(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~sep])]).dictionary_encode()
    local = found.indices.to_numpy().astype(np.int64) + 1
    ends = np.searchsorted(np.flatnonzero(data == 10), start)
    breaks = np.flatnonzero(ends[1:] != ends[:-1]) + 1
    return found.dictionary.cast(pa.string()), np.bincount(local, minlength=len(found.dictionary) + 1)[1:], np.insert(local, breaks, 0)


def cut(raw: bytes, most: int) -> Iterator[bytes]:
    """Folded text in parts of about ``most`` bytes that end where a piece does."""
    at = 0
    while at < len(raw):
        end = at + most
        if end < len(raw):
            here = raw.rfind(b"\n", at, end)
            end = here if here > at else raw.find(b"\n", end)
        yield raw[at : end if end >= 0 else len(raw)]
        at = end + 1 if end >= 0 else len(raw)


CHUNKS = _schema(chunk=_L, lang=_S, words=T.ArrayType(_S), counts=T.ArrayType(_L), stream=_B)


def _packed(local: np.ndarray, words: int) -> bytes:
    return local.astype("<u2" if words < 65536 else "<u4").tobytes()


def chunks(df: DataFrame, text_col: str, lang_col: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of texts of one language: distinct words, their counts, and the stream of word numbers."""
    sent = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    bound_batches(sent)

    def run(batches):
        held, size, made = {}, {}, 0

        def flush(lang):
            nonlocal made
            size.pop(lang)
            for raw in cut(b"\n".join(held.pop(lang)), chunk_bytes):
                words, counts, local = word_stream(raw)
                if len(words):
                    number = (TaskContext.get().partitionId() << 32) + made
                    made += 1
                    columns = [[number], [lang], pa.ListArray.from_arrays([0, len(words)], words), pa.ListArray.from_arrays([0, len(words)], pa.array(counts)), [_packed(local, len(words))]]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.string(), None, None, pa.binary()))], names=CHUNKS.names)

        for part in slices(batches):
            for text, lang in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("lang").to_pylist()):
                held.setdefault(lang, []).append(text.translate(_FOLD))
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= chunk_bytes:
                    yield from flush(lang)
            while sum(size.values()) > max(HELD_BYTES, chunk_bytes):
                yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)
        release()

    return sent.mapInArrow(run, CHUNKS)


# Dictionary


def dictionary(words: DataFrame, least: int) -> DataFrame:
    """lang, word, id and a of the frequent words; ids are dense from 1. ``words`` has lang, word and n, several rows for a word."""
    often = words.groupBy("lang", "word").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    often = materialize(often.withColumn("place", F.monotonically_increasing_id()), "words")
    parts = often.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition
    offset, starts = 1, []
    for p in parts:
        starts.append((p.part, offset))
        offset += p.n
    if offset >= 1 << 32:
        raise ValueError("more than 2^32 frequent words")
    starts = often.sparkSession.createDataFrame(starts, "part long, start long")
    numbered = often.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(starts), "part")
    return numbered.select("lang", "word", (F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("id"), "a")


def id_streams(cut_up: DataFrame, ids: DataFrame) -> DataFrame:
    """chunk and stream: the chunk's words as 32-bit ids, zeros where a piece ends or a rare word stands, no two of them together."""
    each = cut_up.select("chunk", "lang", F.posexplode("words").alias("pos", "word")).join(ids.select("lang", "word", "id"), ["lang", "word"])
    own = each.groupBy("chunk").agg(F.collect_list(F.struct("pos", "id")).alias("ids"))
    both = cut_up.select("chunk", F.size("words").alias("words"), "stream").join(own, "chunk")

    def run(parts):
        for part in parts:
            for chunk, words, stream, pairs in zip(part.column("chunk").to_pylist(), part.column("words").to_pylist(), part.column("stream").to_pylist(), part.column("ids")):
                table = np.zeros(words + 1, dtype=np.uint32)
                pairs = pairs.values
                table[pairs.field("pos").to_numpy() + 1] = pairs.field("id").to_numpy()
                g = table[np.frombuffer(stream, dtype="<u2" if words < 65536 else "<u4")]
                keep = np.ones(len(g), dtype=bool)
                keep[1:] = (g[1:] > 0) | (g[:-1] > 0)
                yield chunk, g[keep].astype("<u4").tobytes()

    return map_groups(both, run, _schema(chunk=_L, stream=_B), weight=lambda row: len(row[1]))


# Keys


def pair_keys(g: np.ndarray) -> np.ndarray:
    """Each two neighbours as one 64-bit key; zero where one of them is a break."""
    key = (g[:-1].astype(np.uint64) << np.uint64(32)) | g[1:]
    key[(g[:-1] == 0) | (g[1:] == 0)] = 0
    return key


def run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys))


def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive values as an Arrow column of bytes; a row goes up to its end."""
    offsets = np.append(0, ends).astype(np.int32) * np.int32(values.itemsize * (values.shape[1] if values.ndim > 1 else 1))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


COUNTED = _schema(bucket=_I, chunk=_L, key=_B, n=_B)


def buckets_for(words: int) -> int:
    """Buckets of about ``PLACES`` keys for a stream of so many words."""
    return min(max(1, -(-words // PLACES)), 1 << 16)


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key, a row of 64-bit numbers, by a hash."""
    mixed = np.zeros(len(keys), dtype=np.uint64)
    for column in keys.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (((mixed >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint16)


def _counted(chunk: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket with its keys (big-endian) and their counts (32 bits, little-endian)."""
    bucket = buckets_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    keys, counts, size = keys[order].astype(">u8"), counts[order].astype("<u4"), np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(size)
    for some in np.array_split(np.flatnonzero(size), 1 + keys.nbytes // SLICE_BYTES):
        if len(some):
            a, b = ends[some[0]] - size[some[0]], ends[some[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), chunk)), binary(keys[a:b], ends[some] - a), binary(counts[a:b], ends[some] - a)], names=COUNTED.names)


def pairs_in_chunks(streams: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, key and n: the counted pairs of each chunk."""
    bound_batches(streams)

    def run(batches):
        for part in batches:
            for chunk, stream in zip(part.column("chunk").to_pylist(), part.column("stream").to_pylist()):
                key = pair_keys(np.frombuffer(stream, dtype="<u4"))
                keys, counts = run_lengths(key[key > 0])
                yield from _counted(chunk, keys[:, None], counts, buckets)
        release()

    return streams.mapInArrow(run, COUNTED)


def longer_in_chunks(streams: DataFrame, pairs: DataFrame, buckets: int) -> DataFrame:
    """bucket, chunk, key and n: phrases of three and four words whose pairs are frequent. ``pairs`` has chunk and pairs, several rows for a chunk."""
    own = pairs.groupBy("chunk").agg(F.collect_list("pairs").alias("pairs"))
    both = streams.join(own, "chunk").select("chunk", "stream", "pairs")
    bound_batches(both)

    def run(batches):
        half, last = np.uint64(32), np.uint64(0xFFFFFFFF)
        for part in batches:
            for chunk, stream, often in zip(part.column("chunk").to_pylist(), part.column("stream").to_pylist(), part.column("pairs")):
                key, often = pair_keys(np.frombuffer(stream, dtype="<u4")), np.sort(np.frombuffer(b"".join(often.as_py()), dtype="<u8"))
                at = np.minimum(np.searchsorted(often, key), len(often) - 1).astype(np.uint64)
                good = often[at] == key
                three = np.flatnonzero(good[:-1] & good[1:])
                four = three[:-1][np.diff(three) == 1] if len(three) else three
                # Numbers of the first and the last pair name a phrase in 64 bits.
                threes, n3 = run_lengths((at[three] << half) | at[three + 1])
                fours, n4 = run_lengths((at[four] << half) | at[four + 2])
                low = np.concatenate([often[threes & last] << half, often[fours & last]])
                yield from _counted(chunk, np.stack([often[np.concatenate([threes, fours]) >> half], low], axis=1), np.concatenate([n3, n4]), buckets)
        release()

    return both.mapInArrow(run, COUNTED)


def frequent(counted: DataFrame, least: int, chunks_too: bool) -> DataFrame:
    """Keys that sum up to ``least`` or more: i1 to i4 and a (one row a key); with ``chunks_too`` also rows of chunk and pairs (packed 64-bit keys) for the chunks that hold them.

    ``counted`` has rows of ``COUNTED``, or a key and its count (long) in each and no bucket. A task merges one bucket after the other.
    """
    schema = _schema(i1=_L, i2=_L, i3=_L, i4=_L, a=_L, chunk=_L, pairs=_B)
    if "bucket" not in counted.columns:
        counted = counted.select(F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int").alias("bucket"), "chunk", "key", "n")
    bound_batches(counted)
    dealt = counted.repartition("bucket").sortWithinPartitions("bucket")

    def merged(rows: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        if not rows:
            return
        n = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u4").astype(np.int64)
        keys = np.frombuffer(b"".join(r[1] for r in rows), dtype=">u8").reshape(len(n), -1).astype(np.uint64)
        order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
        ranked = keys[order]
        first = np.flatnonzero(np.append(True, (ranked[1:] != ranked[:-1]).any(1)))
        sums = np.add.reduceat(n[order], first)
        often = sums >= least
        if not often.any():
            return
        words = np.zeros((often.sum(), WORDS), dtype=np.int64)
        packed = ranked[first[often]].astype(">u8").view(">u4")
        words[:, : packed.shape[1]] = packed
        yield pa.RecordBatch.from_arrays([*[pa.array(words[:, k]) for k in range(WORDS)], pa.array(sums[often]), pa.nulls(len(words), pa.int64()), pa.nulls(len(words), pa.binary())], names=schema.names)
        if chunks_too:
            told = np.empty(len(n), dtype=bool)
            told[order] = np.repeat(often, np.diff(first, append=len(n)))
            ends = np.cumsum([len(r[2]) // 4 for r in rows])
            ends = np.append(0, np.cumsum(told))[ends]
            some = np.flatnonzero(np.diff(ends, prepend=0))
            chunk = np.array([r[0] for r in rows])[some]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(some), pa.int64())] * 5, pa.array(chunk), binary(keys[told, 0].astype("<u8"), ends[some])], names=schema.names)

    def run(batches):
        held, now = [], None  # rows of the bucket that may go on
        for part in batches:
            for bucket, chunk, key, n in zip(*[part.column(c).to_pylist() for c in COUNTED.names]):
                if bucket != now:
                    yield from merged(held)
                    held, now = [], bucket
                held.append((chunk, key, n if isinstance(n, bytes) else n.to_bytes(4, "little")))
        yield from merged(held)
        release()

    return dealt.mapInArrow(run, schema)


# Phrases

IDS = ["i1", "i2", "i3", "i4"]


def _part(first: int, count: int):
    """The ids of ``count`` words from position ``first`` on, padded with zeros."""
    return F.struct(*[(F.col(IDS[first + k]) if k < count else F.lit(0).cast("long")).alias(IDS[k]) for k in range(WORDS)])


def _size():
    return sum((F.col(c) > 0).cast("int") for c in IDS)


def scored(phrases: DataFrame, ids: DataFrame) -> DataFrame:
    """Phrases of two words or more with l, r and score of their lowest cut. ``phrases`` has i1 to i4 and a, ``ids`` the words."""
    counts = phrases.select(*IDS, "a").unionByName(ids.select(F.col("id").alias("i1"), *[F.lit(0).cast("long").alias(c) for c in IDS[1:]], "a"))
    counts = materialize(counts, "counts")
    cuts = [F.when(F.lit(size) == _size(), F.array(*[F.struct(F.lit(k).alias("k"), _part(0, k).alias("head"), _part(k, size - k).alias("rest")) for k in range(1, size)])) for size in range(2, WORDS + 1)]
    each = phrases.select(*IDS, "a", F.explode(F.coalesce(*cuts)).alias("c")).select(*IDS, "a", "c.*")
    named = lambda by, to: counts.select(F.struct(*IDS).alias(by), F.col("a").alias(to))
    each = each.join(named("head", "l"), "head").join(named("rest", "r"), "rest")
    wide = lambda x: x.cast("decimal(38,0)")
    each = each.withColumn("parts", wide(F.col("l")) + wide(F.col("r"))).withColumn("times", (F.lit(SCORE).cast("decimal(10,0)") * F.col("a").cast("decimal(20,0)")).cast("decimal(38,0)"))
    each = each.withColumn("score", F.expr("times div parts"))
    best = each.groupBy(*IDS, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select(*IDS, "a", "b.l", "b.r", "b.score")


def contained(phrases: DataFrame, percent: int = PERCENT) -> DataFrame:
    """i1 to i4 of the phrases that stand inside a longer one which occurs nearly as often."""
    inside = [F.when(F.lit(size) == _size(), F.array(*[_part(at, n) for n in range(2, size) for at in range(size - n + 1)])) for size in range(3, WORDS + 1)]
    subs = phrases.where(_size() > 2).select(F.col("a").alias("whole"), F.explode(F.coalesce(*inside)).alias("s")).groupBy("s").agg(F.max("whole").alias("whole"))
    found = phrases.join(subs.select("s.*", "whole"), IDS)
    return found.where(F.lit(100) * F.col("whole").cast("decimal(20,0)") >= F.lit(percent) * F.col("a").cast("decimal(20,0)")).select(*IDS)


def spelled(phrases: DataFrame, ids: DataFrame) -> DataFrame:
    """lang and phrase in place of i1 to i4."""
    keyed = phrases.withColumn("w", F.explode(F.filter(F.array(*[F.struct(F.lit(k).alias("at"), F.col(c).alias("id")) for k, c in enumerate(IDS)]), lambda x: x["id"] > 0)))
    words = keyed.select("*", F.col("w.id").alias("id")).join(ids.select("id", "lang", "word"), "id")
    rest = [c for c in phrases.columns if c not in IDS]
    whole = words.groupBy(*IDS, *rest).agg(F.any_value("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("w.at", "word"))).alias("words"))
    return whole.select("lang", F.array_join(F.col("words.word"), " ").alias("phrase"), *rest)


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each lang; each of ``SALTS`` groups finds its own first, so that a hot language isn't sorted in one task."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = phrases.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top).drop("salt")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, percent: int = PERCENT, top: int = TOP, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    spark = df.sparkSession
    before = written(spark)
    cut_up = materialize(chunks(df, text_col, lang_col, chunk_bytes), "chunks")
    each = cut_up.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    totals = materialize(cut_up.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")), "totals")
    kept_tables = written(spark)[-1:]
    ids = materialize(dictionary(each, least), "dictionary")
    streams = materialize(id_streams(cut_up, ids), "streams")
    drop_materialized(cut_up)
    buckets = buckets_for(totals.agg(F.sum("n")).first()[0] or 0)
    pairs = materialize(frequent(pairs_in_chunks(streams, buckets), least, True), "pairs")
    longer = frequent(longer_in_chunks(streams, pairs.where("chunk is not null").select("chunk", "pairs"), buckets), least, False)
    phrases = materialize(pairs.where("a is not null").select(*IDS, "a").unionByName(longer.select(*IDS, "a")), "phrases")
    drop_materialized(streams)
    drop_materialized(pairs)
    kept = scored(phrases, ids).join(contained(phrases, percent), IDS, "left_anti")
    best = materialize(ranked(spelled(kept, ids), top), "ranked")
    kept_tables += written(spark)[-1:]
    free(spark, [t for t in written(spark) if t not in before and t not in kept_tables])
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
