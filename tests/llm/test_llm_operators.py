"""The training-data operators against brute force, libraries and edge cases."""

import collections
import hashlib
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import bpe, chat, components, decontaminate, html_text, kernels, minhash, quality, sharding, substring, toxicity, urls

DOCS = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
LONG = "word " * 60_000


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


# 1


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.default_path())


def test_bpe_equals_library(library):
    lib, own = library
    rng = random.Random(1)
    texts = ["", " ", "a", "a ", " a", "a  b", "<|endoftext|>", "a<|endoftext|> b", "it's 123½ don't", "日本語 テキスト", "👩‍👩‍👧 ok", "x" * 5000, "\r\n \r\n\t", "foo \xa0 \xa0bar", "\x00\x1c\x85 z", LONG[:4000]]
    texts += ["".join(rng.choice("ab'st \n\t é1½<|>\xa0") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text, packed in zip(texts, own.encode_batch(texts)):
        expected = lib.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(packed, dtype="<u4").tolist() == expected
        assert own.decode_packed(packed) == lib.decode(expected, skip_special_tokens=False) == text


def test_bpe_long_and_short_merges_agree(library):
    _, own = library
    rng = random.Random(2)
    for n in (1, 2, 3, 50, 99):
        word = bytes(rng.choice(b"abcdetinors") for _ in range(n))
        short = own.merge_short(np.frombuffer(word, dtype=np.uint8).reshape(1, n))[0]
        assert np.frombuffer(short, dtype="<u4").tolist() == own.merge_long([own.of_byte[b] for b in word])


def test_bpe_dictionaries_are_bounded(library, monkeypatch):
    """Very long pieces and many short ones roll the dictionaries over, and ids stay those of the library."""
    lib, _ = library
    monkeypatch.setattr(bpe, "YOUNG_BYTES", 20_000)
    own = bpe.Codec(bpe.default_path())
    own.pieces, own.words = bpe.Kept(500, 20_000), bpe.Kept(300, 20_000)
    rng = random.Random(17)
    seen = 0
    for k in range(40):
        texts = [sentence(rng, 60), "".join(rng.choices("abcdefgh", k=rng.choice([50, 3000, 200_000]))), "tie " * 30, sentence(rng, 60)]
        seen += sum(map(len, texts))
        for text, packed in zip(texts, own.encode_batch(texts)):
            assert np.frombuffer(packed, dtype="<u4").tolist() == lib.encode(text, add_special_tokens=False).ids
        largest = sum(map(len, texts))
        for kept in (own.pieces, own.words):
            assert sum(map(len, kept.young)) <= 20_000 + largest and sum(map(len, kept.old)) <= 20_000 + largest
            own.pieces.absent(set()), own.words.absent(set())
            assert max(map(len, kept.young), default=0) <= bpe.KEPT_BYTES and len(kept.young) <= kept.most
    assert seen > 500_000


def test_bpe_rows(spark):
    rows = [(1, "Hello there"), (2, None), (3, ""), (4, "Hello there"), (None, "x")]
    out = {r.doc_id: r for r in bpe.digests(bpe.round_trip(frame(spark, rows)), ["doc_id"]).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (out[2].n_tokens, out[2].ids_sha256, out[2].decoded_sha256) == (0, empty, empty) == (out[3].n_tokens, out[3].ids_sha256, out[3].decoded_sha256)
    assert out[1][1:] == out[4][1:] and len(out) == 5
    both = bpe.decode(bpe.encode(frame(spark, rows)))
    assert both.where("coalesce(text, '') <> decoded").count() == 0
    assert both.select(F.size(bpe.unpack("ids")).alias("n")).agg(F.sum("n")).first()[0] > 0
    assert bpe.round_trip(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(frame(spark, rows).withColumn("ids", F.lit(1)))


# 2


def brute_quality(text):
    w = WORDS.findall(text)
    windows = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if windows[t] > 1 for k in range(3)}
    lines, met, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in met
            met.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality_counts(spark, sf_dir):
    extra = [(-1, None), (-2, ""), (-3, "a b a b a b"), (-4, "é#\n\né#\nx"), (-5, LONG), (-6, " \n \n\t")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(frame(spark, extra))
    got = {r.doc_id: r for r in quality.assess(docs).collect()}
    for doc, text in [(r.doc_id, r.text or "") for r in docs.collect()]:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(text)
        assert not (r.base_failed and r.kept)
    assert not got[-5].kept and not got[-1].kept


def test_quality_bands():
    import base64
    import zstandard

    press = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rng = random.Random(3)
    kept = lambda t: quality.judge(t, press)[-1]
    common = [sentence(rng, 1) for _ in range(300)]
    clean = " ".join(rng.choices(common, k=400))
    assert kept(clean) and kept(" ".join(rng.choices(common, k=70)))
    assert quality.judge("\n".join(clean[:300] + str(k) for k in range(30)), press)[-2] in ("base", "repetitive")
    noise = base64.b64encode(rng.randbytes(9000)).decode()
    assert quality.judge(" ".join(noise[i : i + 40] for i in range(0, len(noise), 40)), press)[-2] == "incompressible"
    half = clean + " " + " ".join(noise[i : i + 40] for i in range(0, 2 * len(clean), 40))
    assert quality.judge(half, press)[-2] in ("chunks", "incompressible")
    assert quality.judge("", press)[-1] is False


def test_quality_limits_held_out(spark, sf_dir):
    """Limits fitted on half of the labelled texts: of the others of 50 words or more, good ones stay and most low ones go."""
    sf = sf_dir.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    limits = quality.fit_limits(docs, labels.where("xxhash64(doc_id) % 2 = 0"), F.col("quality") == 1)
    held = docs.join(labels.where("xxhash64(doc_id) % 2 <> 0"), "doc_id").select("doc_id", "text", "quality")
    n = {(r.quality, r.kept): r["count"] for r in quality.assess(held, limits=limits).where("not base_failed").groupBy("quality", "kept").count().collect()}
    good, low = n.get((1, False), 0) / (n.get((1, True), 0) + n.get((1, False), 0)), n.get((0, False), 0) / (n.get((0, True), 0) + n.get((0, False), 0))
    print("good rejected", good, "low rejected", low)
    assert good <= 0.02 and low >= 0.5


def test_quality_limits_edges(spark):
    """No labels, null labels and ids, unlabelled ids: the default limits; repeated ids and rows count once."""
    rows = [(k, sentence(random.Random(k), 150)) for k in range(100)]
    docs = frame(spark, rows + rows[:40] + [(None, "x " * 80), (500, None)])
    marks = lambda r: spark.createDataFrame(r, "doc_id long, quality int")
    none = quality.fit_limits(docs, marks([(None, 1), (1, None), (2, 0), (999, 1), (500, 1)]), F.col("quality") == 1)
    assert {(b.low, b.high) for b in none.documents} == {(b.low, b.high) for b in quality.DOCUMENT_BANDS} and none.chunk == quality.CHUNK_BAND
    once, twice = (quality.fit_limits(d, marks([(k, 1) for k in range(100)] * n), F.col("quality") == 1) for d, n in ((frame(spark, rows), 1), (docs, 2)))
    assert once == twice != none
    assert quality.assess(docs, limits=once).where("doc_id < 100 and not kept").count() == 0


def test_quality_limits_of_all_labels(spark):
    """Every labelled text counts, however many there are: the limits equal those of all texts in memory, which a part of them doesn't give."""
    import zstandard

    press = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rng = random.Random(5)
    rows = [(k, " ".join(f"{rng.randrange(9 ** (2 + k % 5))}" for _ in range(52 + k % 40))) for k in range(9000)] + [(9000 + k, sentence(rng, 3000)) for k in range(40)]
    good = [t for k, t in rows if k % 7 and not quality.judge(t, press)[5]]
    pairs = [quality.ratios(t.encode(), press) for t in good]
    assert len(good) > 7000
    limits = lambda n: quality.limits_of(np.array([len(t.encode()) for t in good[:n]]), np.array([w for w, _ in pairs[:n]]), np.array([c for _, each in pairs[:n] for c in each]))
    marks = spark.createDataFrame([(k, int(k % 7 > 0)) for k, _ in rows], "doc_id long, quality int")
    got, expected = quality.fit_limits(frame(spark, rows).repartition(5), marks, F.col("quality") == 1), limits(len(good))
    gap = lambda a, b: max(max(abs(x.low - y.low), abs(x.high - y.high)) for x, y in zip((*a.documents, a.chunk), (*b.documents, b.chunk), strict=True))
    assert [b.size for b in got.documents] == [b.size for b in expected.documents]
    assert gap(got, expected) < 4 / quality.STEPS < gap(limits(6000), expected)


def test_quality_clashing_columns(spark):
    d = frame(spark, [(1, "a b c " * 30, 5)], "doc_id long, text string, kept int")
    with pytest.raises(ValueError):
        quality.assess(d)
    assert quality.keep_good(d).columns == ["doc_id", "text", "kept"]
    assert quality.assess(frame(spark, [])).count() == 0


# 3


def test_urls(spark):
    rules = (*(urls.site_rule(s, v) for v, s in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))), *urls.METHOD_RULES)
    rows = [
        (1, "http://A.Example.COM/en/70?x", "a.example.com", "/en/70", "example.com/en/7", "allow"), (2, "https://example.com/en/8", "example.com", "/en/8", "com/en/", "block"), (3, None, "", "", None, "allow"), (4, "no scheme", "", "", None, "allow"),
        (5, "x://notcom/en/1", "notcom", "/en/1", None, "allow"), (6, "http://b.example.net/de/81#f", "b.example.net", "/de/81", "example.net/de/8", "block"), (7, "http://www.cheap-pills.example.org/fr/1", "www.cheap-pills.example.org", "/fr/1", "^cheap-pills^", "block"),
        (8, "http://example.com/EN/7", "example.com", "/EN/7", None, "allow"), (9, "http://org", "org", "", None, "allow"), (10, "", "", "", None, "allow"), (11, "http://z.net/de/://x.com/en/", "z.net", "/de/://x.com/en/", "net/de/", "allow"),
    ]
    got = urls.judge(spark.createDataFrame([(k, u) for k, u, *_ in rows], "page_id long, url string"), rules)
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {(k, *rest) for k, _, *rest in rows}
    assert urls.judge(spark.createDataFrame([], "url string"), rules).count() == 0
    with pytest.raises(ValueError):
        urls.judge(spark.createDataFrame([], "url string, host string"), rules)


def every_rule(rules, url, place):
    low = url.translate(LOWER)
    fits = [x for x in rules if re.search(x.pattern, place if x.place else low, re.S)]
    return min(fits, key=lambda x: (x.tier, -x.weight, x.name)).name if fits else None


def test_url_index_equals_every_rule(spark, sf_dir, monkeypatch):
    """Thousands of rules of every kind, in one part and in several, against running all of them."""
    rng = random.Random(31)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    words = sorted({t for r in pages.collect() for t in re.findall("[a-z0-9]+", r.url.lower())})
    extra = ["http://x.org/ca\u017fino", "http://A.B-casino.net/x.EXE", "HTTPS://ADSERVER.a.com", "ftp://u@poker.de:80/?q=anti-spam&a=spam", "casino", "", "http://", "http://a.b/" + "casino/" * 30000, "x://spam\n/casino"]
    pages = pages.unionByName(spark.createDataFrame([(-k, u) for k, u in enumerate(extra, 1)], "page_id long, url string"))
    lines = list(urls.METHOD_LINES) + ["! comment", "", "/[0-9]{3}\\.html$/", "@@|http://thther.", ".html|", "*", "||com^", "||org/e*/4"][:-3]
    for _ in range(3000):
        a, b = rng.choice(words), rng.choice(words)
        lines.append(rng.choice(["", "", "", "@@"]) + rng.choice([f"||{a}.{b}^", f"^{a}^{b}^", f"{a[:3]}*{b}", f"/{a}/*.{b}", f"||{a}^", f"{a}.{b}|", f"|http://{a}", f"^{a}-", f"{a}^*={b}"]))
    rules = urls.parse_list(lines)
    assert len(rules) > 2000 and urls.parse_rule("! x") is None and urls.parse_rule("^a*b^c").tokens == () and urls.parse_rule("||a.b^c|").tokens == ("a", "b", "c")
    whole = [(r.page_id, r.rule, r.url, r.host + r.path) for r in urls.judge(pages, rules).collect()]
    for _, rule, url, place in whole:
        assert rule == (every_rule(rules, url, place) if "://" in url else None)
    assert sum(rule is not None for _, rule, _, _ in whole) > 10
    monkeypatch.setattr(urls, "PART_RULES", 500)
    assert sorted((r.page_id, r.rule or "") for r in urls.judge(pages, rules).collect()) == sorted((k, rule or "") for k, rule, _, _ in whole)


def test_url_exceptions():
    rules = urls.parse_list(["||bad.org^", "@@||good.bad.org^", "^ads^", "/x[0-9]+y/"])
    judge = urls.Judge(rules, {})
    for url, name in (("http://bad.org/", "||bad.org^"), ("http://a.bad.org", "||bad.org^"), ("http://good.bad.org/ads/", "@@||good.bad.org^"), ("http://notbad.org/", None), ("http://q/x12y", "/x[0-9]+y/"), ("http://q/?u=bad.org", None), ("http://q/ads", "^ads^"), ("http://q/loads", None)):
        assert (found := judge.best(url, "")) is None if name is None else judge.best(url, "").name == name


# 4


def brute_classes(rows):
    sets = {}
    for d, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def test_minhash_equals_brute_force(spark, sf_dir):
    rng = random.Random(4)
    base = sentence(rng, 150).split()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "one two three")]
    for k in range(500):  # a family that fills several blocks
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = sentence(rng, 1)
        rows.append((2000 + k, " ".join(w)))
    rows += [(3000 + k, rows[-1][1]) for k in range(40)]
    got = {r.doc: (r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_minhash_edges(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "alone here")]
    got = sorted((r.doc or 0, r.component or 0, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (7, 5, False)]


def test_minhash_equal_ids_link(spark):
    """Rows with one id are one document, whatever their texts: 7 and 8 are near different texts of 5, and 3 is near a text of 8."""
    rng = random.Random(18)
    a, b, c = (sentence(rng, 60) for _ in range(3))
    near = lambda t, w: " ".join([*t.split()[:-1], w])
    rows = [(5, a), (5, b), (7, near(a, "x")), (8, near(b, "y")), (8, c), (8, c), (3, near(c, "z")), (9, sentence(rng, 60))]
    got = sorted((r.doc, r.component, r.kept) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 3, False), (8, 3, False), (8, 3, False), (9, 9, True)]


def edited(rng, words, share):
    """A copy with so many words replaced that about ``share`` of all five-word shingles are equal."""
    w = list(words)
    for _ in range(100 * len(w)):
        at = rng.randrange(len(w))
        w[at] = sentence(rng, 1)
        same = len(set(zip(w, w[1:], w[2:], w[3:], w[4:])) & set(zip(words, words[1:], words[2:], words[3:], words[4:])))
        if same / (2 * (len(w) - 4) - same) <= share:
            break
    return w


def test_minhash_many_half_alike(spark, monkeypatch):
    """Many texts at similarity 0.4 to 0.8 of one another: bands chain nearly all of them, links do not. Small blocks, so that stars, sketches
    and tiles are all cut."""
    rng = random.Random(20)
    rows, base = [], sentence(rng, 120).split()
    for k in range(60):
        half = edited(rng, base, rng.choice([0.5, 0.65, 0.75]))
        rows += [(10 * k + j, " ".join(edited(rng, half, rng.choice([0.7, 0.76, 0.8, 0.9])))) for j in range(rng.randint(1, 4))]
    rows += [(5000 + k, " ".join(edited(rng, base, rng.uniform(0.8, 0.95)))) for k in range(60)]
    for name, value in (("STAR", 16), ("SKETCHES", 12), ("BLOCK", 8)):
        monkeypatch.setattr(minhash, name, value)
    got = {r.doc: (r.n_shingles, r.component, r.kept) for r in minhash.near_duplicates(frame(spark, rows).repartition(4)).collect()}
    assert got == brute_classes(rows)
    assert 20 < len({c for _, c, _ in got.values()}) < len(rows) - 50


def test_minhash_long_and_clashing(spark):
    """Very long texts, other columns whose names the operator uses itself, ties of ids."""
    rng = random.Random(22)
    long = sentence(rng, 120_000)
    rows = [(2, long), (1, long + " end"), (3, LONG), (4, "word"), (6, "word word")]
    d = frame(spark, rows).selectExpr("doc_id", "text", "doc_id as doc", "1 as node", "'x' as key", "text as component", "2 as kept", "3 as digest")
    got = sorted((r.doc, r.component, r.kept) for r in minhash.near_duplicates(d).collect())
    assert got == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (6, 6, True)]


def test_min_max_is_unbiased():
    rng = np.random.default_rng(5)
    a = kernels.mix(rng.integers(0, 2**62, 400).astype(np.uint64))
    x, y = np.unique(a[:350]), np.unique(a[50:])
    same = (minhash.min_max(x) == minhash.min_max(y)).mean()
    assert abs(same - 300 / 400) < 0.12


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (9, 8), (5, 5), (2, 1), (None, 3), *[(k, k + 1) for k in range(100, 160)]], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{k: 100 for k in range(100, 161)}}
    assert components.connected_components(edges.limit(0)).count() == 0


# 5


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu words</nav><div class='cookie-notice'>we use</div><article><h1>T &amp; x</h1><p>a <b>b</b>c<!-- z --> d<script>x</p></script><p>e&nbsp;f<br>g<div class=comments><p>no</div><aside>s</aside><form>f<input></form></article><footer>end</footer>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "http://g/1", "just <p>text"), (5, "http://h/3", page.replace("article", "section")), (6, "http://h/4", "<article>" + "<p>long text</p>" * 20000)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[5] == "T & x a bc d e f g" and got[2] == got[3] == "" and got[4] == "just text" and got[6] == " ".join(["long text"] * 20000)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    with pytest.raises(ValueError):
        html_text.extract(spark.createDataFrame([], "url string, html string, text string"))


def test_html_consensus(spark):
    """A page whose comments are longer than its article follows its host."""
    body = lambda a, b: f"<body><div class='story-1'><p>{a}</p></div><div class='talk'><p>{b}</p></div>"
    rows = [(k, "http://h/x", body("article text " * 30, "chat")) for k in range(6)] + [(9, "http://h/y", body("short story", "much longer talk " * 9))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short story"


def test_html_body_inside_article(spark):
    """The heading, lead and last words around the longest part of an article stay."""
    page = lambda tag, inner: f"<body><nav>menu</nav><div><{tag}><h1>Title</h1><p>lead</p><{inner} class='body'>{'<p>long text</p>' * 40}</{inner}><div class='share'>no</div><p>end</p></{tag}></div><div>other</div>"
    cases = [(t, i) for t in ("article", "main") for i in ("div", "section", "table><tr><td")]
    rows = [(10 * k + j, f"http://h{k}/x", page(t, i)) for k, (t, i) in enumerate(cases) for j in range(3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 18 and {r.text for r in got} == {f"Title lead {' '.join(['long text'] * 40)} end"}


def test_html_pages(spark, sf_dir):
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages.select("page_id", "url", "html")).collect()}
    for r in pages.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        assert got[r.page_id] == " ".join(unescape(re.sub(r"<[^>]+>", " ", inner)).split())


# 6


def test_wand_equals_every_score():
    rng = random.Random(6)
    common = [sentence(rng, 1) for _ in range(60)]
    items = [(k, " ".join(rng.choices(common, k=rng.randint(8, 40))), None) for k in range(50)]
    index = decontaminate.Index(items)
    dense = np.zeros((len(index.vocabulary), len(index.items)))
    for t in range(len(index.vocabulary)):
        dense[t, index.doc[index.at[t] : index.at[t + 1]]] = index.weight[index.at[t] : index.at[t + 1]]
    assert np.allclose(dense.sum(axis=0), 1)
    for n in (1, 30, 64, 65, 300):
        d, _ = decontaminate._digests(" ".join(rng.choices(common, k=n)))
        count = max(1, (n - 1) // index.half)
        for threshold in (0.3, 0.5, 0.8):
            expected = set()
            for p in range(count):
                at = np.searchsorted(index.vocabulary, np.unique(d[p * index.half : (p + 2) * index.half]))
                expected |= {(p, k) for k in np.flatnonzero(dense[at].sum(axis=0) >= threshold - 1e-9).tolist()}
            assert {(p, k) for p, k, _ in index.retrieve(d, threshold)} == expected


def test_leaks(spark):
    rng = random.Random(7)
    items = [(k, sentence(rng, 30)) for k in range(20)] + [(50, None), (51, ""), (52, "one two")]
    text = sentence(rng, 500)
    rows = [(1, text), (2, text[:700] + " " + items[3][1].upper() + ". " + text[700:]), (3, items[5][1][: len(items[5][1]) // 2]), (4, None), (5, ""), (6, f"{items[7][1]} {sentence(rng, 300)} {items[8][1]}")]
    docs, tests = frame(spark, rows), frame(spark, items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked(docs, tests).collect()}
    assert got == {(2, 3), (6, 7), (6, 8)}
    span = decontaminate.leaked(docs, tests).where("doc_id = 2").first()
    assert items[3][1].upper() in rows[1][1][span.passage_start : span.passage_end]
    assert {r.doc_id for r in decontaminate.keep_clean(docs, tests).collect()} == {1, 3, 4, 5}
    assert decontaminate.leaked(docs, tests.limit(0)).count() == 0 and decontaminate.leaked(docs.limit(0), tests).count() == 0


def test_leaks_ties_and_names(spark):
    """Equal items, an item that stands twice in a document, repeated rows, items of one word, clashing names."""
    rng = random.Random(26)
    item, gap = sentence(rng, 30), sentence(rng, 400)
    docs = frame(spark, [(1, f"{item} {gap} {item}"), (1, f"{item} {gap} {item}"), (2, gap), (None, item)]).selectExpr("*", "'x' as item", "2 as doc", "3 as bm25")
    tests = frame(spark, [(7, item), (8, item), (9, "single")], "item_id long, text string").selectExpr("*", "1 as term", "2 as shard")
    got = sorted((r.doc_id or 0, r.item_id, r.passage_start) for r in decontaminate.leaked(docs, tests).collect())
    assert got == [(0, 7, 0), (0, 8, 0), (1, 7, 0), (1, 7, 0), (1, 8, 0), (1, 8, 0)]
    assert decontaminate.keep_clean(docs, tests).collect() == docs.where("doc_id = 2").collect()
    for a, b in (("item_id", "item_id"), ("bm25", "item_id")):
        with pytest.raises(ValueError):
            decontaminate.leaked(docs.withColumn("item_id", F.lit(1)), tests, doc_col=a, item_col=b)


def test_leaks_in_shards(spark, monkeypatch):
    rng = random.Random(8)
    items = frame(spark, [(k, sentence(rng, 25)) for k in range(30)], "item_id long, text string")
    docs = items.select((F.col("item_id") + 100).alias("doc_id"), "text")
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 1500)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaked(docs, items).collect()}
    assert got == {(k + 100, k) for k in range(30)}


def test_leaks_of_edited_items(spark):
    """Without a column of answers an edit near the end, or a missing end, hides nothing; a given answer must stand in the passage."""
    rng = random.Random(15)
    items = [(k, sentence(rng, n)) for k, n in enumerate((20, 38, 59))]
    a, b, c = (t.split() for _, t in items)
    rows = [(1, " ".join([*a[:17], "edited", *a[18:]])), (2, " ".join([*b[:33], "edited", *b[34:]])), (3, " ".join(c[:41]))]
    docs, tests = frame(spark, [(k, f"{sentence(rng, 90)} {t} {sentence(rng, 90)}") for k, t in rows]), frame(spark, items, "item_id long, text string")
    got = decontaminate.leaked(docs, tests).collect()
    assert {(r.doc_id, r.item_id, r.answer_overlap) for r in got} == {(1, 0, None), (2, 1, None), (3, 2, None)}
    assert decontaminate.keep_clean(docs, tests).count() == 0
    given = tests.withColumn("answer", F.when(F.col("item_id") == 0, F.lit("never said in any text")).otherwise(F.lit(" ".join(b[:9]))))
    assert {(r.doc_id, r.item_id, r.answer_overlap) for r in decontaminate.leaked(docs, given, answer_col="answer").collect()} == {(2, 1, 1.0)}


def test_leaks_of_long_items(spark):
    """Items of any length are found wherever they stand, next to short ones."""
    rng = random.Random(16)
    items = [(k, sentence(rng, n)) for k, n in enumerate((30, 500, 700, 1100, 3000))]
    rows = [(10 * k + j, f"{sentence(rng, n)} {t} {sentence(rng, 40)}") for k, t in items for j, n in enumerate((1, 130, 257, 700))]
    docs, tests = frame(spark, rows), frame(spark, items, "item_id long, text string")
    got = decontaminate.leaked(docs, tests).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(10 * k + j, k) for k in range(5) for j in range(4)]
    assert all(r.question_overlap == 1 and items[r.item_id][1] in dict(rows)[r.doc_id][r.passage_start : r.passage_end] for r in got)
    given = tests.select("item_id", F.substring_index("text", " ", 15).alias("text"), F.expr("substring(text, length(substring_index(text, ' ', 15)) + 2)").alias("answer"))
    assert {r.item_id for r in decontaminate.leaked(docs, given, answer_col="answer").collect()} == set(range(5))


# 7


def test_substring(spark):
    rng = random.Random(9)
    passage, line = sentence(rng, 60), sentence(rng, 22)
    text = {k: sentence(rng, 150) for k in range(6)}
    rows = [(1, f"{text[1][:200]} {passage} {text[1][200:]}"), (2, f"{text[2][:300]} {passage} {text[2][300:]}\n{line}\nshort one"), (3, f"{line.upper()}\n{text[3]}\nshort one"), (4, None), (5, ""), (6, f"{text[5]}\n{line}x\n{line}x\n"), (7, text[4])]
    out = {r.doc_id: r for r in substring.dedup(frame(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and not out[1].removed and out[7].text == text[4]
    assert passage not in out[2].text and len(out[2].text) > len(text[2]) and out[2].removed[0].kept_doc == 1
    assert out[3].text == f"{text[3]}\nshort one" and out[3].removed[0].kept_doc == 2
    assert (out[4].text, out[5].text, out[6].text) == (None, "", f"{text[5]}\n{line}x\n")
    for r in out.values():
        whole, at, kept = dict(rows)[r.doc_id] or "", 0, []
        for s in r.removed:
            kept.append(whole[at : s.start])
            at = s.end
        assert "".join(kept) + whole[at:] == (r.text or "")
    spans = substring.removed_spans(frame(spark, rows)).collect()
    assert {(s.doc_id, s.kept_doc_id) for s in spans} == {(2, 1), (3, 2), (6, 6)}
    assert substring.removed_spans(frame(spark, [])).count() == 0


def test_substring_null_ids_and_copies(spark):
    rng = random.Random(10)
    t = sentence(rng, 40)
    rows = [(None, t), (3, t), (3, t), (9, t), (9, LONG)]
    got = sorted((r.doc_id or 0, r.text == t, r.text) for r in substring.dedup(frame(spark, rows)).collect())
    assert [g[:2] for g in got if g[1]] == [(0, True), (3, True), (3, True)]
    with pytest.raises(ValueError):
        substring.dedup(frame(spark, rows).withColumn("removed", F.lit(1)))


def test_substring_grown_quotes(spark):
    """A quote that grew: its parts were first met in two documents, and both go from the third."""
    rng = random.Random(12)
    for _ in range(3):
        p, q = sentence(rng, 55), sentence(rng, 55)
        own = [sentence(rng, 60) for _ in range(6)]
        rows = [(1, f"{own[0]} {p} {own[1]}"), (2, f"{own[2]} {p} {q} {own[3]}"), (3, f"{own[4]} {p} {q} {own[5]}")]
        got = {r.doc_id: r for r in substring.dedup(frame(spark, rows)).collect()}
        assert got[1].text == rows[0][1] and {s.kept_doc for s in got[2].removed} == {1} and {s.kept_doc for s in got[3].removed} == {1, 2}
        assert len(got[2].text.split()) < 120 + 55 + 25 and len(got[3].text.split()) < 120 + 30
        assert got[3].text.startswith(own[4]) and got[3].text.endswith(own[5])


def test_substring_needs_order():
    """Windows met apart from each other are no repeated passage, unless one alone has the words."""
    rng = random.Random(13)
    u = substring.Units(sentence(rng, 400))
    w = u.windows
    odd = np.argsort(d := w.digest[::2].view(np.int64))
    alone = [("passage", a, b, b - a, 0) for a, b in zip(w.first[::2].tolist(), w.end[::2].tolist()) if b - a >= substring.MIN_WORDS]
    assert substring.removals(u, d[odd], np.zeros(len(d), dtype=np.int64), 5) == alone
    every = np.sort(w.digest.view(np.int64))
    assert substring.removals(u, every, np.zeros(len(every), dtype=np.int64), 5) == [("passage", 0, int(w.end[-1]), int(w.end[-1]), 0)]


def test_substring_lines_and_paragraphs_equal_brute_force(spark, sf_dir):
    """Which lines and paragraphs go, by a plain pass over all documents in order of id."""
    rng = random.Random(24)
    para = lambda: "\n".join(sentence(rng, rng.choice([5, 9, 25])) for _ in range(rng.randint(2, 5)))
    pool = [para() for _ in range(12)] + [sentence(rng, n) for n in (5, 19, 20, 21, 40)]
    rows = [(k, "\n\n".join(rng.choice(pool) if rng.random() < 0.4 else para() for _ in range(6))) for k in range(60)]
    rows += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    met, expected = {}, {}
    for doc, text in sorted(rows):
        words_of = lambda t: tuple(WORDS.findall((t or "").translate(LOWER)))
        own, gone = {}, []
        for kind, units in (("paragraph", re.split(r"\n(?:[\x20\t\x0b-\r]*\n)+", text or "")), ("line", (text or "").split("\n"))):
            for unit in units:
                w = words_of(unit)
                if len(w) >= substring.MIN_WORDS and (kind == "line" or "\n" in unit.strip(" \t\n\v\f\r")):
                    if (kind, w) in met or (kind, w) in own:
                        gone.append((kind, met.get((kind, w), doc), w))
                    own.setdefault((kind, w), doc)
        expected[doc] = collections.Counter(gone)
        met = own | met
    for r in substring.dedup(frame(spark, rows)).collect():
        text, want = dict(rows)[r.doc_id], expected[r.doc_id]
        got = collections.Counter((s.kind, s.kept_doc, tuple(WORDS.findall(text[s.start : s.end].translate(LOWER)))) for s in r.removed if s.kind != "passage")
        assert not got - want
        # What is missing are lines inside paragraphs that are out.
        inside = [w for (kind, _, w), _ in got.items() if kind == "paragraph"]
        assert all(kind == "line" and any(any(p[i : i + len(w)] == w for i in range(len(p))) for p in inside) for kind, _, w in want - got)


def test_substring_passages_against_brute_force(spark, sf_dir):
    """Sound: all six words in a row of a removed passage were met before. Complete: of what repeats 50 words in a row, nearly all goes."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text)
    out = {r.doc_id: r.removed for r in substring.dedup(frame(spark, rows)).collect()}
    grams = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    met6, met50, repeats, gone = set(), set(), 0, 0
    for doc, text in rows:
        at = [(m.start(), m.end(), m.group().translate(LOWER)) for m in WORDS.finditer(text)]
        w = [x for _, _, x in at]
        removed = [any(s.start <= a and b <= s.end for s in out[doc]) for a, b, _ in at]
        twice = {g for g, n in collections.Counter(tuple(w[i : i + 6]) for i in range(len(w) - 5)).items() if n > 1}
        for s in out[doc]:
            inner = [x for a, b, x in at if s.start <= a and b <= s.end]
            assert s.kind != "passage" or all(g in met6 or g in twice for g in grams(inner, 6))
        covered = [False] * len(w)
        for i in range(len(w) - 49):
            if tuple(w[i : i + 50]) in met50:
                covered[i : i + 50] = [True] * 50
        repeats += sum(covered)
        gone += sum(c and g for c, g in zip(covered, removed))
        met6 |= grams(w, 6)
        met50 |= grams(w, 50)
    assert repeats > 1000 and gone >= 0.95 * repeats


def test_substring_clean_documents_stay(spark):
    """Documents that share short lines and formulas only stay as they are; null ids are compared with themselves and name no document."""
    rng = random.Random(25)
    short = [sentence(rng, n) for n in (3, 8, 15)]
    rows = [(k, "\n".join(x for line in short for x in (sentence(rng, 40), line, sentence(rng, 9)))) for k in range(20)]
    twice = sentence(rng, 30)
    out = substring.dedup(frame(spark, rows + [(None, f"{twice}\n{twice}")])).collect()
    assert all(r.text == dict(rows)[r.doc_id] and not r.removed for r in out if r.doc_id is not None)
    alone = next(r for r in out if r.doc_id is None)
    assert alone.text == twice + "\n" and [(s.kind, s.kept_doc) for s in alone.removed] == [("line", None)]


def test_substring_ignores_newlines(spark):
    """Passages in short lines, and wrapped otherwise in each document."""
    rng = random.Random(14)
    verse, prose = sentence(rng, 70).split(), sentence(rng, 70).split()
    wrap = lambda w, n: "\n".join(" ".join(w[k : k + n]) for k in range(0, len(w), n))
    own = [sentence(rng, 60) for _ in range(6)]
    rows = [(1, f"{own[0]}\n{wrap(verse, 4)}\n{own[1]} {' '.join(prose)}"), (2, f"{own[2]}\n{wrap(verse, 4)}\n{own[3]}"), (3, f"{own[4]}\n{wrap(prose, 12)}\n{own[5]}")]
    got = {r.doc_id: r for r in substring.dedup(frame(spark, rows)).collect()}
    assert got[1].text == rows[0][1]
    for k in (2, 3):
        assert len(got[k].text.split()) < 120 + 25 and {s.kept_doc for s in got[k].removed} == {1}
        assert got[k].text.startswith(own[2 * k - 2]) and got[k].text.endswith(own[2 * k - 1])


# 8


def test_hilbert():
    axes = np.array(np.meshgrid(*[np.arange(16)] * 3)).reshape(3, -1)
    h = sharding.hilbert_index(axes)
    assert sorted(h) == list(range(4096))
    assert np.abs(np.diff(axes[:, np.argsort(h)], axis=1)).sum(axis=0).max() == 1


def test_shards(spark):
    rows = [(k, "x" * (k % 50), "src", "en") for k in range(333)] + [(400, None, None, None), (401, "é", "a", "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = sharding.assign(d).collect()
    counts = collections.Counter(r.shard for r in got)
    assert len(got) == 335 and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(16))
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    import zlib

    by = {r.doc_id: r for r in got}
    assert (by[400]["size"], by[400].text_crc32, by[401]["size"], by[401].text_crc32) == (1, 0, 3, zlib.crc32("é".encode()))
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in got)
    assert sharding.assign(d.limit(0)).count() == 0 and sharding.assign(d.limit(3)).count() == 3


def test_shards_equal_a_plain_sort(spark):
    """The whole order against a sort in Python; null and repeated ids, repeated rows, null metadata and other columns."""
    import zlib

    rng = random.Random(23)
    rows = [(rng.choice([None, *range(200)]), "w" * rng.choice([0, 5, 90, 3000]) if rng.random() < 0.9 else None, rng.choice(["a", "b", "c.org", "d", None]), rng.choice(["en", "de", "fr"]), "x", 1) for _ in range(400)]
    rows += rows[:30]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard string, size int")
    got = sharding.assign(d).collect()
    cell = lambda values: {v: k * 16 // len(values) for k, v in enumerate(sorted(values))}
    source, lang = cell({r[2] or "" for r in rows}), cell({r[3] for r in rows})
    keys = []
    for doc, text, s, g, *_ in rows:
        raw = (text or "").encode()
        axes = np.array([[min(15, max(0, (len(raw) + 1).bit_length() - 4))], [source[s or ""]], [lang[g]]])
        keys.append((int(sharding.hilbert_index(axes)[0]), zlib.crc32(raw), -1 if doc is None else doc, len(raw) + 1))
    order = sorted(keys)
    assert [(r.curve, r.text_crc32, -1 if r.doc_id is None else r.doc_id, r["size"]) for r in sorted(got, key=lambda r: (r.shard, r.slot))] == order
    assert [r.shard for r in sorted(got, key=lambda r: (r.shard, r.slot))] == [k * 16 // len(rows) for k in range(len(rows))]


def test_shard_ranges_prune(spark, sf_dir):
    """A reader that looks for one value of any dimension opens clearly fewer shards by their minima and maxima than of shards in order of id."""
    docs = spark.read.parquet(sf_dir.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text", "source", "lang")
    got = {r.doc_id: r for r in sharding.assign(docs).collect()}
    rows = [(r.source or "", r.lang or "", len((r.text or "").encode()), got[r.doc_id].shard, r.doc_id) for r in docs.collect()]

    def opened(shard_of):
        total = [0, 0, 0]
        for k in range(3):
            limits = {}
            for r in rows:
                lo, hi = limits.get(shard_of(r), (r[k], r[k]))
                limits[shard_of(r)] = (min(lo, r[k]), max(hi, r[k]))
            values = sorted({r[k] for r in rows}) if k < 2 else [0, 300, 1500, 6000, 50000]
            total[k] = sum(lo <= v <= hi for v in values for lo, hi in limits.values()) / len(values)
        return total

    ours, plain = opened(lambda r: r[3]), opened(lambda r: r[4] % 16)
    assert all(a <= 0.75 * b for a, b in zip(ours, plain)) and sum(ours) < 0.6 * sum(plain), (ours, plain)


def test_write_shards(spark, tmp_path):
    rows = [(k, "t" * k, "s", "en") for k in range(40)] * 2 + [(None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    sharding.write_shards(d, sharding.assign(d), str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.groupBy("shard").count().count() == 16
    assert sorted(map(tuple, back.select(*d.columns).collect()), key=str) == sorted(rows, key=str)


# 9


def test_toxicity_edges(spark):
    """Repeated ids and labels train once, the bound of bytes holds, equal texts have equal results, clashing names are refused."""
    rng = random.Random(19)
    rows = [(k, f"{sentence(rng, 30)} {'vileword' if k % 2 else 'kindword'}") for k in range(120)]
    marks = spark.createDataFrame([(k, k % 2) for k in range(120)] * 2, "doc_id long, toxic int")
    docs = frame(spark, rows * 3 + [(k, "another text with this id") for k in range(5)])
    chain = toxicity.fit_chain(docs, marks, {"toxic": F.col("toxic")})
    once = toxicity.fit_chain(frame(spark, rows + [(k, "another text with this id") for k in range(5)]), marks.distinct(), {"toxic": F.col("toxic")})
    assert np.array_equal(chain.models[0].weights, once.models[0].weights) and chain.cuts == once.cuts
    got = toxicity.classify(docs, chain).collect()
    assert len(got) == 365 and len({(r.text, r.p_toxic, r.toxic) for r in got}) == len({r.text for r in got})
    assert sum(r.toxic == bool(r.doc_id % 2) for r in got if "word" in r.text[-9:]) >= 350
    few = toxicity.fit_chain(docs, marks, {"toxic": F.col("toxic")}, most_bytes=0)
    assert toxicity.classify(docs, few).where("toxic").count() == 0
    with pytest.raises(ValueError):
        toxicity.classify(docs.withColumn("toxic", F.lit(1)), chain)


def brute_chain(texts, chain):
    """Probabilities from the models by plain Python sums."""
    import math

    weight = [dict(zip(chain.used.tolist(), m.weights.tolist())) for m in chain.models]
    out = []
    for t in texts:
        p = []
        for m, w in zip(chain.models, weight):
            z = m.bias + sum(w.get(f, 0.0) for f in toxicity.features(t).tolist())
            z += sum(c * math.log(min(max(q, 1e-4), 1 - 1e-4) / (1 - min(max(q, 1e-4), 1 - 1e-4))) for c, q in zip(m.chain, p))
            p.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        out.append(p)
    return out


def test_toxicity_query_equals_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit_chain(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    got = toxicity.classify(docs, chain).collect()
    for r, p in zip(got, brute_chain([r.text for r in got], chain)):
        assert abs(r.p_low_quality - p[0]) < 1e-6 and abs(r.p_toxic - p[1]) < 1e-6 and r.toxic == (r.p_toxic >= chain.cuts[1])


def test_toxicity(spark):
    rng = random.Random(11)
    common = [sentence(rng, 1) for _ in range(200)]
    bad = ["vileword", "nastyword", "foulword"]
    rows, marks = [], []
    for k in range(600):
        w, toxic, low = rng.choices(common, k=60), k % 5 == 0, k % 3 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(bad)
        if low:
            w += ["spamspam"]
        rows.append((k, " ".join(w)))
        marks.append((k, int(not low), int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, LONG)]
    marks += [(None, 1, 1), (2000, None, 1), (1, None, None)]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels.where("doc_id % 2 = 0 or doc_id is null"), {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")})
    got = {r.doc_id: r for r in toxicity.classify(docs, chain).collect()}
    held = [k for k in range(600) if k % 2]
    assert sum(got[k].toxic == (k % 5 == 0) for k in held) / len(held) > 0.97
    assert sum(got[k].low_quality == (k % 3 == 0) for k in held) / len(held) > 0.97
    assert len(chain.models[1].chain) == 1 and got[1000].p_toxic == got[1001].p_toxic
    none = toxicity.fit_chain(docs, labels.limit(0), {"toxic": F.col("toxic")})
    assert toxicity.classify(docs, none).where("toxic or p_toxic > 0.01").count() == 0
    assert toxicity.classify(docs.limit(0), chain).count() == 0


# 10


def test_chat(spark):
    rows = [
        (1, 0, "system", "Be <<SYS>> [INST] \\ brief"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]\\"), (2, 0, "assistant", "first"), (2, 1, None, None), (2, 2, "to\nol<|turn|>", "out <|/turn|> \\n"),
        (7, 0, "r" * 30000 + "\\\n\\n\\\\" * 3000, "x"), (7, 1, "\\", "a\\\nb"), (7, 2, "\n", ""), (7, 3, "<s>\n[/INST]\\n", "<|turn|>"), (7, 4, "", "z"),
        (3, 1, "user", None), (3, 0, "user", "twice"), (4, 0, "user", ""), (4, 1, "assistant", ""), (None, 0, "user", "no id"), (5, 0, "user", "<<s>s> \\<s> [[INST]"), (5, 0, "user", "<<s>s> \\<s> [[INST]"), (6, None, "user", LONG[:50000]),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat.format_chat(d)
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        g = got[conv]
        assert (g.n_turns, g.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].valid and got[1].state == "answered" and got[2].state == "broken" and not got[3].valid and got[None].state == "asked"
    formatted = {r.conv_id: r.formatted for r in chats.collect()}
    assert formatted[4] == "<s>[INST]  [/INST]  </s>"
    assert chat.format_chat(d.limit(0)).count() == 0


def test_chat_needs_no_python(spark):
    d = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_chat(d))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
