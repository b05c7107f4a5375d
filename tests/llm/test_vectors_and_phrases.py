"""Embedding near-duplicates, vector codes and collocations against brute force and their twins."""

import collections
import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest

from siteloom.llm import collocations, queries, twins, vector_codes, vectors

VECS = "vec_id long, embedding array<float>, label int"


def near(rng, base, cosine):
    noise = rng.normal(size=len(base))
    noise -= (noise @ base) * base
    return cosine * base + math.sqrt(1 - cosine * cosine) * noise / np.linalg.norm(noise)


def direction(rng, dim=32):
    v = rng.normal(size=dim)
    return v / np.linalg.norm(v)


def brute_links(rows, cosine=vectors.COSINE):
    """n_links of each row, and the smallest id reachable from it."""
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links = collections.Counter()
    low = {r[0]: r[0] for r in rows}
    pairs = []
    for i, a in enumerate(ok):
        for b in ok[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = (np.array(v[1], dtype=np.float32).astype(np.float64) for v in (a, b))
                if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                    links[id(a)] += 1
                    links[id(b)] += 1
                    pairs.append((a[0], b[0]))
    for _ in rows:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return sorted((r[0], links[id(r)], low[r[0]], r[0] == low[r[0]]) for r in rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def planted(seed=3):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (1, 2):
        bases = [direction(rng) for _ in range(40)]
        for b in bases:
            rows.append((n := n + 1, (3 * b).tolist(), label))
        for b in bases[:15]:
            for c in (0.9305, 0.931, 0.95, 0.929, 0.92):
                rows.append((n := n + 1, near(rng, b, c).tolist(), label))
        for _ in range(60):
            rows.append((n := n + 1, near(rng, bases[20], 0.97).tolist(), label))
        chain = bases[30]
        for _ in range(8):
            chain = near(rng, chain, 0.94)
            rows.append((n := n + 1, chain.tolist(), label))
    rows += [(1000 + k, rows[0][1], 1) for k in range(50)]  # exact copies
    rng.shuffle(rows)
    return [(int(a), [float(x) for x in b], int(c)) for a, b, c in rows]


@pytest.mark.parametrize("block", [8, 1024])
def test_vectors_equal_brute_force(spark, block, monkeypatch):
    """Pairs at the threshold, chains, dense groups and exact copies; several lists, and blocks of a list in several tiles."""
    monkeypatch.setattr(vectors, "LIST_ROWS", 40)
    rows = planted()
    out = vectors.near_vectors(spark.createDataFrame(rows, VECS), block=block)
    assert rows_of(out) == brute_links(rows)


def test_probes_without_a_guess_miss_nothing():
    """With the worst case as bound, whatever is linked shares a list that one of the two visits."""
    rng = np.random.default_rng(7)
    units = [direction(rng, 8) for _ in range(1200)]
    model = vectors.fit(units, 400_000, None)
    assert len(model.lists) > 50 and model.spread == 1.0
    tan = math.sqrt(1 - vectors.COSINE**2) / vectors.COSINE
    home, probes = model.visits(np.stack(units), tan)
    a, b = np.nonzero(np.triu(np.stack(units) @ np.stack(units).T >= vectors.COSINE, 1))
    assert len(a) >= 50
    assert ((home[a] == home[b]) | probes[a, home[b]] | probes[b, home[a]]).all()


def test_codes_bound_distances():
    """The table look-up differs from the true distance by the code's error at most, also for components that are not quantised."""
    rng = np.random.default_rng(8)
    units = [direction(rng, 10) for _ in range(300)] + [direction(rng, 13) for _ in range(20)]
    model = vectors.fit(units, 300)
    longer = [u for u in units if len(u) == 13]
    heads, tails = (np.array(x) for x in zip(*map(model.head, longer)))
    home, _ = model.visits(heads, 0.4)
    codes, errors = model.encode(heads, tails, home)
    for i in range(20):
        for j in range(20):
            table = model.table((heads[i] - model.lists[home[j]])[None])[0]
            looked = math.sqrt(sum(table[p, c] for p, c in enumerate(codes[j])) + tails[i])
            assert abs(looked - np.linalg.norm(longer[i] - longer[j])) <= errors[j] + 1e-9


def test_vectors_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, -0.0], 1), (7, [1.0, nan], 1), (8, [inf, 0.0], 1), (9, [1.0, None], 1), (10, [], 1)]
    rows += [(11, [1.0, 0.0, 0.0], 1), (12, [1e30, 0.0], 1), (13, [1e-30, 0.0], 1), (14, [-1.0, 0.0], 1), (15, [1.0, -0.0], 2)]
    df = spark.createDataFrame(rows, VECS).selectExpr("*", "1 AS node", "2 AS n_links")
    assert rows_of(vectors.near_vectors(df)) == brute_links(rows)
    # One id with two vectors is one node of a class; null ids are counted.
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (7, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (None, None, 1)], VECS)
    assert {tuple(r) for r in vectors.near_vectors(twice).collect()} == {(1, 1, 1, True), (5, 1, 1, False), (5, 2, 1, False), (7, 2, 1, False), (None, 2, 1, False), (None, 0, None, False)}
    assert vectors.near_vectors(spark.createDataFrame([], VECS)).count() == 0
    assert vectors.near_vectors(spark.createDataFrame([(1, None, 1)], VECS)).collect()[0][1:] == (0, 1, True)


# 12


def brute_codes(rows, rounds=4):
    rows = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0])
    cut = [[[math.floor(1024 * float(np.float32(x))) for x in r[1][p * (len(r[1]) // 4) : (p + 1) * (len(r[1]) // 4)]] for p in range(4)] for r in rows]
    books = [[c[p] for c in cut[:256]] for p in range(4)]
    nearest = lambda x, p: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[nearest(c[p], p)[1] for c in cut] for p in range(4)]
        for p in range(4):
            members = collections.defaultdict(list)
            for c, k in zip(cut, at[p]):
                members[k].append(c[p])
            books[p] = [[sum(col) // len(members[k]) for col in zip(*members[k])] if k in members else e for k, e in enumerate(books[p])]
    best = [[nearest(c[p], p) for p in range(4)] for c in cut]
    error = [sum(d for d, _ in b) for b in best]
    of = collections.Counter()
    for r, e in zip(rows, error):
        of[r[2]] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{k:02x}" for _, k in b), e, of[r[2]], digest) for r, b, e in zip(rows, best, error))


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=8) * rng.choice([0.1, 1, 50])).round(2).tolist(), rng.choice([1, 2, None])) for k in range(700)]
    rows += [(k, rows[k % 5][1], 3) for k in range(700, 760)]  # ties
    rows = [(k, v, None if c is None else int(c)) for k, v, c in rows]
    rows[10], rows[20], rows[30] = (10, None, 1), (20, [float("nan")] * 8, 1), (30, [None] + [1.0] * 7, 2)
    assert rows_of(vector_codes.quantise(spark.createDataFrame(rows, VECS))) == brute_codes(rows)


def test_annulus_is_whole():
    """The nearest entry, the lowest of equals, whatever the norms: crowded, far apart, all alike, very large."""
    rng = np.random.default_rng(5)
    for scale in (1, 3, 1000, 1 << 26):
        for entries in (1, 2, 37, 256):
            book = rng.integers(-scale, scale + 1, size=(entries, 4))
            parts = np.concatenate([rng.integers(-scale, scale + 1, size=(300, 4)), book[rng.integers(0, entries, 50)], np.zeros((1, 4), dtype=np.int64)])
            d = ((parts[:, None] - book[None]) ** 2).sum(2)
            index, best = vector_codes.Book(book).nearest(parts)
            assert (index == d.argmin(1)).all() and (best == d.min(1)).all()


def test_codes_edges(spark):
    rows = [(3, [1.0, 2.0, 3.0, 4.0], 1), (1, [0.5, -0.5, 0.0009, -0.0009], None), (2, [1.0] * 8, 1), (4, [], 1), (5, [1.0] * 3, 1), (6, [1e30] * 4, 1), (1, [9.0, 9.0, 9.0, 9.0], None), (None, [9.0, 9.0, 9.0, 9.0], 2)]
    out = vector_codes.quantise(spark.createDataFrame(rows, VECS).selectExpr("*", "'x' AS code", "1 AS dim"))
    assert sorted((r.doc is None, r.doc or 0, r.error) for r in out.collect()) == [(False, 1, 0), (False, 1, 0), (False, 3, 0), (True, 0, 0)]
    assert {r.label_error for r in out.collect()} == {0}
    empty = vector_codes.quantise(spark.createDataFrame([], VECS))
    assert empty.count() == 0 and empty.columns == out.columns


# 13


def brute_phrases(rows, least, percent=80, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f.update((lang, *w[i : i + size]) for i in range(len(w) - size + 1))
    often = {k: v for k, v in f.items() if len(k) > 2 and v >= least}
    inside = collections.Counter()
    for (lang, *w), a in often.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inside[(lang, *w[i : i + size])] = max(inside[(lang, *w[i : i + size])], a)
    found = collections.defaultdict(list)
    for key, a in often.items():
        lang, *w = key
        if 100 * inside[key] < percent * a:
            score, _, l, r = min((2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, rank + 1, p.decode(), -a, l, r, n[lang], -s) for lang, each in found.items() for rank, (s, a, p, l, r) in enumerate(sorted(each)[:top]))


def corpus(seed=6):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcÉéXyz_\x01", k=rng.randint(1, 3))) for _ in range(60)]
    fixed = [" ".join(rng.choices(vocabulary, k=rng.randint(2, 6))) for _ in range(12)]
    rows = []
    for k in range(400):
        text = ""
        for _ in range(rng.randint(0, 25)):
            text += rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary[: rng.choice([3, 60])])
            text += rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", ";", " \x85 "])
        rows.append((text, rng.choice(["en", "de", None, "und", "ünd"])))
    return rows + [(None, "en"), ("", None), (" .\n", "de"), ("ab " * 500, "fr"), ("one", "es")]


@pytest.mark.parametrize(("least", "chunk", "top"), [(30, 8 << 20, 2000), (5, 300, 2000), (3, 2000, 7)])
def test_phrases_equal_brute_force(spark, least, chunk, top):
    """Many small chunks make keys whose runs cross them, batches and partitions."""
    rows = corpus()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3).selectExpr("*", "1 AS chunk", "2 AS a")
    assert rows_of(collocations.collocations(df, least=least, chunk_bytes=chunk, top=top)) == brute_phrases(rows, least, top=top)


@pytest.mark.parametrize("places", [1, 10, 1 << 20])
def test_runs_cross_batches(spark, monkeypatch, places):
    """A key in every chunk, seen through batches of a few rows; places are packed now and then."""
    monkeypatch.setattr(collocations, "PLACES", places)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(b"%08d" % (k // 7), k % 7, 1 + k % 3) for k in range(140)] + [(b"00000099", k, 1) for k in range(29)] + [(b"00000098", k, 1) for k in range(31)]
        out = collocations.frequent(spark.createDataFrame(rows, "key binary, chunk long, n long"), 13, True).collect()
        sums = collections.Counter()
        for key, _, n in rows:
            sums[key] += n
        key = lambda a, b: a.to_bytes(4) + b.to_bytes(4)
        assert {key(r.i1, r.i2): r.a for r in out if r.a is not None} == {k: v for k, v in sums.items() if v >= 13}
        told = sorted((int(p).to_bytes(8), r.chunk) for r in out if r.a is None for p in np.frombuffer(r.pairs, dtype="<u8"))
        assert told == sorted((k, c) for k, c, _ in rows if sums[k] >= 13)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_chunks_send_a_row_to_each_bucket(spark):
    """Counted pairs leave a chunk packed by bucket, not in a row each; a pair of several chunks has one bucket."""
    rng = np.random.default_rng(7)
    streams = {k: rng.integers(0, 60, size=4000).astype("<u4") for k in range(5)}
    out = collocations.pairs_in_chunks(spark.createDataFrame([(k, s.tobytes()) for k, s in streams.items()], "chunk long, stream binary").repartition(3), 9).collect()
    assert len(out) == 5 * 9 and {r.bucket for r in out} == set(range(9))
    found, places = collections.Counter(), collections.defaultdict(set)
    for r in out:
        for key, n in zip(np.frombuffer(r.key, dtype=">u4").reshape(-1, 2).tolist(), np.frombuffer(r.n, dtype="<u4").tolist()):
            found[r.chunk, *key] += n
            places[tuple(key)].add(r.bucket)
    assert found == collections.Counter((k, a, b) for k, s in streams.items() for a, b in zip(s[:-1].tolist(), s[1:].tolist()) if a and b)
    assert all(len(x) == 1 for x in places.values())


@pytest.mark.parametrize(("least", "chunk", "places"), [(30, 8 << 20, 500), (5, 300, 40)])
def test_phrases_in_many_buckets(spark, monkeypatch, least, chunk, places):
    monkeypatch.setattr(collocations, "PLACES", places)
    rows = corpus(8)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert rows_of(collocations.collocations(df, least=least, chunk_bytes=chunk)) == brute_phrases(rows, least)


def test_scores_pass_64_bits(spark):
    """Counts of 10^13 make products beyond a long."""
    words = spark.createDataFrame([("en", "a", 1, 9 * 10**12), ("en", "b", 2, 8 * 10**12)], "lang string, word string, id long, a long")
    phrases = spark.createDataFrame([(1, 2, 0, 0, 7 * 10**12 + 1)], "i1 long, i2 long, i3 long, i4 long, a long")
    r = collocations.scored(phrases, words).first()
    assert r.score == 2_000_000 * (7 * 10**12 + 1) // (17 * 10**12) and (r.l, r.r) == (9 * 10**12, 8 * 10**12)


def test_no_phrases(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([("a b", "en")], "text string, lang string")).count() == 0


@pytest.mark.parametrize("name", ["op11_vectors", "op12_codes", "op13_phrases"])
def test_twins(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute({"op11_vectors": twins.OP11_SQL, "op12_codes": twins.OP12_SQL, "op13_phrases": twins.OP13_SQL}[name])
    names = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, sf_dir)
    assert sorted(names) == sorted(df.columns)
    assert sorted(cur.fetchall(), key=str) == sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


def test_vector_twin_on_planted_links(spark, tmp_path):
    """The given small tables hold no links, so the twin is also compared where there are many."""
    spark.createDataFrame(planted(), VECS).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = con.execute(twins.OP11_SQL)
    names = [d[0] for d in cur.description]
    assert sorted(cur.fetchall()) == sorted(tuple(r[c] for c in names) for r in queries.QUERIES["op11_vectors"](spark, str(tmp_path)).collect())
