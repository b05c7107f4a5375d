"""Byte-level BPE encoding and decoding with a contiguous rank array.

A pre-token (what the vocabulary's pattern cuts) is merged in place: an array of part boundaries lies beside
an array with the rank of each adjacent pair. The smallest rank is found by scanning, its boundary is deleted
and only the two neighbouring ranks are looked up again. Short pre-tokens of equal length are merged together,
a row each of one contiguous matrix, so that scan, deletion and refresh are single numpy operations. Scanning is
quadratic, so pre-tokens over ``SHORT`` bytes keep the same boundaries in a linked list with a heap of ranks.

Text is cut at single spaces first. Where no space meets other white space, a piece with the space before it is cut by the
pattern alike in any context, so its ids can be kept; a text where spaces meet is cut as a whole. Each Python
worker keeps pieces and pre-tokens that it has met in a young and an old dictionary; when the young one reaches
its limit, in entries or in bytes, it replaces the old. Pieces longer than ``KEPT_BYTES`` are dropped behind their batch. So memory is
bounded whatever the corpus holds: by the limits and one batch.

Defined results: a null or empty text has no ids and decodes to the empty text; whole texts are encoded,
however long; equal texts have equal ids; tables without rows give none; other columns are passed through,
and clashing names are refused with ``ValueError``.
"""

from __future__ import annotations

import heapq
import json
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

SHORT = 100
#: Pieces, and pre-tokens, that the young dictionary of a worker holds at most.
PIECES, PRE_TOKENS = 220_000, 50_000
#: Characters and bytes of ids that the young dictionary of a worker holds at most, and of one entry that is kept.
YOUNG_BYTES, KEPT_BYTES = 8 << 20, 1024
NO_RANK = 1 << 40
#: Texts of one call, in bytes.
BATCH_BYTES = 512 << 10
#: The pattern that byte-level vocabularies of this family cut text with (a fixed value of the format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Kept:
    """A dictionary of bounded size that keeps what was met lately."""

    def __init__(self, most: int, most_bytes: int = YOUNG_BYTES):
        self.most, self.most_bytes, self.young, self.old, self.size = most, most_bytes, {}, {}, 0
        self.long: list[str] = []

    def absent(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that aren't kept; the others are in ``young`` after the call."""
        for k in self.long:
            self.young.pop(k, None)
        missing = keys.difference(self.young)
        more = 2 * sum(map(len, missing))
        if len(self.young) + len(missing) > self.most or self.size + more > self.most_bytes:
            self.young, self.old, self.size, missing = {}, self.young, 0, keys
            more = 2 * sum(map(len, missing))
        self.size += more
        young, old, out = self.young, self.old.get, []
        for k in missing:
            v = old(k)
            if v is None:
                out.append(k)
            else:
                young[k] = v
        self.long = [k for k in missing if len(k) > KEPT_BYTES] if more > KEPT_BYTES else []
        return out


class Codec:
    """Encoder and decoder of one vocabulary file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: only byte-level BPE without normaliser and prefix space is supported")
        to_byte = byte_characters()
        as_bytes = lambda token: bytes(to_byte[c] for c in token)
        vocab = {as_bytes(t): i for t, i in model["vocab"].items()}
        #: rank of a pair of token ids (first << 20 | second), and the id that each rank makes
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank[vocab[a] << 20 | vocab[b]] = rank
            self.made.append(vocab[a + b])
        self.of_byte = [vocab[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.cut = regex.compile(PATTERN).findall
        self.meet = regex.compile(r"^\s| \s").search
        self.apart = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        order = np.argsort(keys := np.fromiter(self.rank, dtype=np.int64, count=len(self.rank)))
        self.keys = np.append(keys[order], np.int64(1 << 62))
        self.ranks = np.append(np.fromiter(self.rank.values(), dtype=np.int64, count=len(self.rank))[order], NO_RANK)
        self.made_array = np.array(self.made, dtype=np.int64)
        self.of_byte_array = np.array(self.of_byte, dtype=np.int64)
        self.pieces, self.words = Kept(PIECES), Kept(PRE_TOKENS)

    def rank_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        key = first << 20 | second
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_short(self, words: np.ndarray) -> list[bytes]:
        """Packed ids of words of one length, given as a matrix of bytes.

        Each round scans every row's contiguous ranks for the minimum (the leftmost of equals), deletes that
        boundary and refreshes the ranks beside it; rows without a pair that merges are done and leave.
        """
        ids = self.of_byte_array[words]
        ranks = self.rank_of(ids[:, :-1], ids[:, 1:])
        rows = np.arange(len(ids))
        out: list[bytes] = [b""] * len(ids)
        while len(rows):
            width = ids.shape[1]
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(len(rows), dtype=np.int64)
            best = ranks[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), NO_RANK)
            if (done := best == NO_RANK).any():
                packed, size = ids[done].astype("<u4").tobytes(), 4 * width
                for k, row in enumerate(rows[done].tolist()):
                    out[row] = packed[k * size : (k + 1) * size]
                ids, ranks, rows, at, best = ids[~done], ranks[~done], rows[~done], at[~done], best[~done]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            ids[each, at] = self.made_array[best]
            keep = np.ones(ids.shape, dtype=bool)
            keep[each, at + 1] = False
            ids = ids[keep].reshape(len(rows), width - 1)
            ranks = ranks[keep[:, 1:] if width > 1 else keep].reshape(len(rows), width - 2)
            if width > 2:
                left = at > 0
                e, k = each[left], at[left]
                ranks[e, k - 1] = self.rank_of(ids[e, k - 1], ids[e, k])
                right = at < width - 2
                e, k = each[right], at[right]
                ranks[e, k] = self.rank_of(ids[e, k], ids[e, k + 1])
        return out

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges for long pre-tokens: a heap instead of scans, neighbours by index."""
        n, rank = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 20 | ids[i + 1], NO_RANK)) != NO_RANK]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, _ = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(new << 20 | ids[k], NO_RANK)) != NO_RANK:
                    heapq.heappush(heap, (r, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 20 | new, NO_RANK)) != NO_RANK:
                heapq.heappush(heap, (r, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of pre-tokens."""
        out: dict[str, bytes] = {}
        by_size: dict[int, list[str]] = {}
        raw = [w.encode("utf-8") for w in words]
        for w, b in zip(words, raw):
            if len(b) <= SHORT:
                by_size.setdefault(len(b), []).append((w, b))
            else:
                ids = self.merge_long([self.of_byte[x] for x in b])
                out[w] = struct.pack(f"<{len(ids)}I", *ids)
        for size, group in by_size.items():
            matrix = np.frombuffer(b"".join([b for _, b in group]), dtype=np.uint8).reshape(-1, size)
            out.update(zip([w for w, _ in group], self.merge_short(matrix)))
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        whole: list[tuple[int, list]] = []  # parts of texts that are cut as a whole
        apart: list[tuple[int, list[str]]] = []  # pieces of the others
        for k, text in enumerate(texts):
            if text:
                if text[-1] == " " or self.meet(text) or any(t in text for t in self.special):
                    whole.append((k, [p if i % 2 else self.cut(p) for i, p in enumerate(self.apart(text) if self.apart else [text])]))
                else:
                    apart.append((k, text.split(" ")))
        heads = {k: self.cut(pieces[0]) for k, pieces in apart}
        met: set[str] = set()
        for _, pieces in apart:
            met.update(pieces[1:])
        fresh = {p: self.cut(" " + p) for p in self.pieces.absent(met)}
        # Most pieces are one pre-token, which is kept as the piece only.
        single = self.learn([words[0] for words in fresh.values() if len(words) == 1])
        met = set()
        for words in (*(words for words in fresh.values() if len(words) > 1), *heads.values(), *(words for _, parts in whole for words in parts[::2])):
            met.update(words)
        learnt = self.learn(self.words.absent(met))  # which may begin a new young dictionary
        self.words.young.update(learnt)
        word, piece = self.words.young.__getitem__, self.pieces.young
        for p, words in fresh.items():
            piece[p] = single[words[0]] if len(words) == 1 else b"".join(map(word, words))
        for k, pieces in apart:
            out[k] = b"".join([*map(word, heads[k]), *map(piece.__getitem__, pieces[1:])])
        for k, parts in whole:
            out[k] = b"".join([struct.pack("<I", self.special[p]) if i % 2 else b"".join(map(word, p)) for i, p in enumerate(parts)])
        return out

    def encode_packed(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_packed(self, packed: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(packed, dtype="<u4").tolist()]).decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decode_packed(np.asarray(ids, dtype="<u4").tobytes())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    from .batches import release

    made = Codec(path)
    release()  # what the vocabulary's file took
    return made


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _fresh(df: DataFrame, *names: str) -> None:
    if taken := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(taken)} exist already")


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``ids``: the text's token ids, packed as little-endian unsigned 32-bit integers in a binary column.

    ``path`` names the vocabulary file on each executor; the default is the installed 50k byte-level one.
    ``unpack`` turns the packed ids into an array.
    """
    _fresh(df, ids)

    @F.pandas_udf(T.BinaryType())
    def run(column):
        import pandas as pd

        c = codec(path or default_path())
        return pd.Series(c.encode_batch(column.tolist()))

    return df.withColumn(ids, run(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, ids: str = "ids", text: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``text``: the decoded packed ids, special tokens included; null ids give the empty text."""
    _fresh(df, text)

    @F.pandas_udf(T.StringType())
    def run(column):
        c = codec(path or default_path())
        return column.map(lambda b: c.decode_packed(b or b""))

    return df.withColumn(text, run(F.coalesce(F.col(ids), F.lit(b""))))


def unpack(ids: str = "ids"):
    """The packed ids as ``array<long>``."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(column):
        return column.map(lambda b: np.frombuffer(b or b"", dtype="<u4").astype("int64"))

    return run(F.col(ids))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """Encode and decode: adds ``ids`` (packed) and ``decoded`` in one pass of the Python workers.

    Rows flow in slices of bounded bytes, and each worker holds one slice and its results.
    """
    from .batches import map_rows

    _fresh(df, "ids", "decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(part: pa.RecordBatch) -> dict:
        c = codec(path or default_path())
        packed = c.encode_batch([t or "" for t in part.column(text).to_pylist()])
        return {n: part.column(n) for n in part.schema.names} | {"ids": packed, "decoded": [c.decode_packed(p) for p in packed]}

    return map_rows(df, run, schema, BATCH_BYTES)


def digests(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_tokens, ids_sha256 and decoded_sha256 of a frame from ``round_trip``."""
    return df.select(
        *keep,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
