"""The pipeline against the stages' brute-force versions on a small corpus with planted cases."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from siteloom.llm import bpe, decontaminate, queries


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(n))


def test_planted(spark, tmp_path):
    rng = random.Random(1)
    clean = {k: words(rng, 120) for k in range(12)}
    item, passage = words(rng, 30), words(rng, 70)
    rows = [(k, t) for k, t in clean.items()]
    near = clean[2].split()
    near[5] = "changed"
    rows += [(20, clean[1]), (21, " ".join(near)), (22, f"{words(rng, 80)} {item} {words(rng, 60)}"), (23, "spam " * 300), (24, "too short"), (25, None)]
    rows += [(30, f"{words(rng, 90)} {passage} {words(rng, 90)}"), (31, f"{words(rng, 90)} {passage} {words(rng, 90)}")]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {*clean, 30, 31}
    codec = bpe.Codec(bpe.default_path())
    for k, t in [*clean.items(), (30, dict(rows)[30])]:
        assert out[k].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert out[k].n_tokens == len(codec.encode(t)) == len(np.frombuffer(bytes(out[k].ids), dtype="<u4"))
    assert out[31].n_tokens < out[30].n_tokens - 40


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = docs.cache()
        assert 0 < docs.count() <= 200
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontaminate.leaked(docs, items).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def stored(spark, path, rows, items=(), schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, None, 1), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_repeated_and_null_ids(spark, tmp_path):
    """One row of equal ids stays, rows without an id are never a copy of another, columns that stages use themselves do no harm."""
    rng = random.Random(2)
    a, b, c = (words(rng, 120) for _ in range(3))
    rows = [(1, a), (1, a), (2, b), (2, c), (2, None), (None, a), (None, words(rng, 90)), (3, a), (3, a)]
    path = stored(spark, tmp_path, [(k, t, "en", "s", 1, "x", True, 5) for k, t in rows], [(None, None), (1, "")], DOCS + ", removed string, kept boolean, component long")
    out = corpus_pipeline.run(spark, path).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 0, 1, 2]
    want = hashlib.sha256(min(b, c).encode()).hexdigest()
    assert next(r for r in out if r.doc_id == 2).decoded_sha256 == want


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path / "a", [])).count() == 0
    only = stored(spark, tmp_path / "b", [(1, None, None, None, None), (2, "", "", "", 0)])
    assert corpus_pipeline.run(spark, only).count() == 0


def test_run_frees_its_tables(spark, sf_dir):
    from siteloom.plans.materialize import release, written

    before = written(spark)
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    left = [t for t in written(spark) if t not in before]
    assert len(left) == 1
    release(spark, left)
    assert written(spark) == before


def test_pipeline_equals_stages_by_brute_force(spark, sf_dir):
    """Which documents stay: quality verdicts, brute-force near-duplicate classes and items' shingles, each over what was left before."""
    import re
    import string

    import zstandard

    from siteloom.llm import quality, substring

    press = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    labels = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality == 1}
    fitted = [t for k, t in sorted(rows.items()) if k in labels and t and not quality.judge(t, press)[5]]
    pairs = [quality.ratios(t.encode(), press) for t in fitted]
    limits = quality.limits_of(np.array([len(t.encode()) for t in fitted]), np.array([w for w, _ in pairs]), np.array([c for _, each in pairs for c in each]))
    good = {k: t for k, t in rows.items() if quality.judge(t, press, limits)[-1]}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in good.items() for w in [word.findall(t.translate(lower))]}
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b) > 0
    top = {k: k for k in good}
    for a in sorted(good):
        for b in sorted(good):
            if a < b and near(sets[a], sets[b]):
                x, y = top[a], top[b]
                top = {k: min(x, y) if v in (x, y) else v for k, v in top.items()}
    once = {k for k in good if top[k] == k}
    frame = spark.createDataFrame([(k, good[k]) for k in once], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in substring.dedup(frame).collect()}
    mark = re.compile(r"[^\x09-\x0d\x20!-/:-@\[-`{-~]+")
    tests = [mark.findall((r.text or "").translate(lower)) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    tests = [grams(w) for w in tests if w]
    stay = {k for k, t in cut.items() if word.search(t) and not any(len(x & (g := grams(mark.findall(t.translate(lower))))) >= 0.5 * len(x) for x in tests)}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == stay


def test_registered():
    assert [n for n in queries.QUERIES] == ["op1_bpe", "op2_quality", "op3_url_filter", "op4_minhash", "op5_html_text", "op6_decontaminate", "op7_substring", "op8_hilbert_shards", "op9_toxicity", "op10_chat", "op11_vectors", "op12_codes", "op13_phrases"]
    assert len(corpus_pipeline.STAGES) == 5
