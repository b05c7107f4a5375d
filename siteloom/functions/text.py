"""Text scalars and simhash from builtins: they stay in whole-stage code generation."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Widths of Arial at 20 and 14 pixels by character, from U+0020 to U+007E in order.
WIDTHS_20 = (6, 7, 9, 12, 12, 19, 15, 5, 7, 7, 9, 13, 6, 7, 6, 6, 12, 12, 12, 12, 12, 12, 12, 12, 12, 12, 6, 6, 13, 13, 13, 12, 22, 15, 15, 16, 16, 15, 13, 17, 16, 6, 11, 15, 12, 19, 16, 17, 15, 17, 16, 15, 13, 16, 15, 21, 15, 15, 13, 6, 6, 6, 10, 12, 7, 12, 12, 11, 12, 12, 6, 12, 12, 5, 5, 11, 5, 18, 12, 12, 12, 12, 7, 11, 6, 12, 11, 16, 11, 11, 11, 7, 6, 7, 13)
WIDTHS_14 = (4, 5, 6, 8, 8, 13, 11, 3, 5, 5, 6, 9, 4, 5, 4, 4, 8, 8, 8, 8, 8, 8, 8, 8, 8, 8, 4, 4, 9, 9, 9, 8, 15, 10, 10, 11, 11, 10, 9, 12, 11, 4, 8, 10, 8, 13, 11, 12, 10, 12, 11, 10, 9, 11, 10, 15, 10, 10, 9, 4, 4, 4, 7, 8, 5, 8, 8, 8, 8, 8, 4, 8, 8, 3, 3, 8, 3, 13, 8, 8, 8, 8, 5, 8, 4, 8, 8, 11, 8, 8, 8, 5, 4, 5, 9)
#: English words that keywords leave out.
STOP_WORDS = tuple(
    """a about above after again against all am an and any are aren't as at be because been before being below between both but by can't cannot could
    couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd he'll he's
    her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's me more most mustn't
    my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll she's should shouldn't
    so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've this those through to too
    under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's
    with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves""".split()
)


def pixel_width(text: Column, font: int = 20) -> Column:
    """The sum of character widths: counted by width class, so no array of characters is built."""
    widths, default = (WIDTHS_20, 12) if font >= 18 else (WIDTHS_14, 8)
    out = F.length(text) * default
    by_width: dict[int, str] = {}
    for k, w in enumerate(widths):
        by_width.setdefault(w, "")
        by_width[w] += chr(32 + k)
    for w, chars in sorted(by_width.items()):
        if w != default:
            out = out + (w - default) * (F.length(text) - F.length(F.translate(text, chars, "")))
    return F.coalesce(out, F.lit(0))


def white_words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(white_words(text)), F.lit(0))


def sentence_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, "[.!?]+"), lambda s: F.length(F.trim(s)) > 3)), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.md5(F.array_join(white_words(text), " ").cast("binary"))


def syllables(word: Column) -> Column:
    """Vowel groups less a silent e or ed; one at least."""
    w = F.lower(F.trim(word))
    bare = F.regexp_replace(w, "[^a-z]", "")
    groups = F.size(F.regexp_extract_all(bare, F.lit("[aeiouy]+"), F.lit(0)))
    less = F.when(bare.endswith("e") & ~bare.endswith("le"), 1).when(bare.endswith("ed") & ~bare.endswith("ted") & ~bare.endswith("ded"), 1).otherwise(0)
    return F.when(F.length(w) <= 3, 1).otherwise(F.greatest(groups - less, F.lit(1)))


VOWELS, NOT_LETTER = re.compile("[aeiouy]+"), re.compile("[^a-z]")
WHITE = re.compile(r"[ \t\n\x0B\f\r]+")
LETTER_WORD = re.compile(r"\w+")


@lru_cache(maxsize=100_000)
def word_syllables(word: str) -> int:
    """``syllables`` of one word for batch functions."""
    w = word.lower()
    if len(w) <= 3:
        return 1
    bare = NOT_LETTER.sub("", w)
    less = bare.endswith("e") and not bare.endswith("le") or bare.endswith("ed") and not bare.endswith(("ted", "ded"))
    return max(1, len(VOWELS.findall(bare)) - less)


def text_syllables(text: str) -> int:
    """The syllables of all words of a text; each distinct word is split once."""
    return sum(n * word_syllables(w) for w, n in Counter(WHITE.split(text)).items() if w)


def plain_words(text: str, least: int) -> list[str]:
    """``letters`` of one text for batch functions."""
    return [w for w in LETTER_WORD.findall(text.lower()) if len(w) >= least and w.isascii() and w.isalpha()]


@lru_cache(maxsize=100_000)
def _word_hash(word: str) -> bytes:
    return hashlib.md5(word.encode()).digest()[:8]


def simhash_of(text: str) -> str:
    counts = Counter(plain_words(text, 3))
    if not counts:
        return "0" * 16
    bits = np.unpackbits(np.frombuffer(b"".join(map(_word_hash, counts)), dtype=np.uint8).reshape(-1, 8), axis=1)
    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    return np.packbits(2 * (n @ bits) > n.sum()).tobytes().hex()


def per_text(df: DataFrame, key: str, text: str, fn: Callable[[str], object], kind: T.DataType, out: str) -> DataFrame:
    """key and ``fn`` of each row's text, in Arrow batches cut by bytes; a null text counts as empty."""
    schema = T.StructType([df.schema[key], T.StructField(out, kind)])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for part in text_batches(batches):
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array([fn(t or "") for t in part.column(text).to_pylist()], type=target.field(out).type)], schema=target)

    return df.select(key, text).mapInArrow(run, schema)


def text_batches(batches, most: int = 4 << 20):
    """Slices of Arrow batches of about ``most`` bytes; a longer row is a slice of its own."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            step = min(1024, batch.num_rows - at)
            while step > 1 and batch.slice(at, step).nbytes > most:
                step //= 2
            yield batch.slice(at, step)
            at += step


def estimate_syllables(n_words: Column, *samples: Column) -> Column:
    """Syllables of a text of which only the number of words is known, by the ratio of sample texts (title, description, heading); 1.5 a word without samples."""
    words = white_words(F.concat_ws(" ", *[F.coalesce(s, F.lit("")) for s in samples]))
    total = F.aggregate(F.transform(words, syllables), F.lit(0), lambda a, x: a + x)
    ratio = F.when(F.size(words) > 0, total / F.size(words)).otherwise(1.5)
    return F.floor(F.coalesce(n_words, F.lit(0)) * ratio).cast("bigint")


def flesch(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    score = 206.835 - 1.015 * (n_words / n_sentences) - 84.6 * (n_syllables / n_words)
    return F.when((n_words > 0) & (n_sentences > 0), F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)), 1)).otherwise(0.0)


def readability(score: Column) -> Column:
    return F.when(score >= 90, "Very Easy").when(score >= 80, "Easy").when(score >= 60, "Standard").when(score >= 30, "Difficult").otherwise("Very Difficult")


def letters(text: Column, least: int) -> Column:
    """Words of a-z with at least ``least`` letters, bounded by anything that is no letter, digit or underscore."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(f"^[a-z]{{{least},}}$"))


def keywords(text: Column) -> Column:
    return F.filter(letters(text, 2), lambda w: ~w.isin(*STOP_WORDS))


def ngrams(words: Column, n: int) -> Column:
    """All n adjacent words joined by a space; none where there are fewer."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def simhash(df: DataFrame, key: str, text: str, out: str = "simhash") -> DataFrame:
    """A row with key and a 16-digit hex simhash for each row: +1 or -1 by each bit of the MD5 prefix of each word, summed over the text.

    All votes belong to one row, so nothing is shuffled: a batch function hashes the distinct words and adds up their bits. A null text,
    or one without a word of three letters, has the hash 0.
    """
    return per_text(df, key, text, simhash_of, T.StringType(), out)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes."""
    signed = lambda x: F.conv(x, 16, -10).cast("bigint")
    return F.bit_count(signed(a).bitwiseXOR(signed(b)))


def similarity(distance: Column) -> Column:
    return F.round(1 - distance / 64, 3)


def is_pattern(text: str) -> bool:
    """Whether a text is a regular expression both here and for the JVM, which runs it."""
    try:
        re.compile(text)
    except re.error:
        return False
    session = SparkSession.getActiveSession()
    if session is None:
        return True
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(text)
    except (Py4JJavaError, CapturedException):
        return False
    return True


def short_label(text: Column, most: int = 36) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, 18), F.lit("..."), F.right(text, F.lit(15)))).otherwise(text)


def preview(items: Column, shown: int = 4) -> Column:
    more = F.size(items) - shown
    return F.concat(F.array_join(F.slice(items, 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(""))


def emails(text: Column) -> Column:
    """Distinct addresses in order, without names of image or script files."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0)))
    return F.filter(found, lambda e: ~F.lower(e).rlike(r"\.(png|jpg|jpeg|gif|svg|webp|css|js)$"))


def text_ratio(text_size: Column, html_size: Column) -> Column:
    return F.when(html_size > 0, F.round(100.0 * text_size / html_size, 2)).otherwise(0.0)
