"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from weftline.llm import decontaminate, html, language, mixing, neardup, quality, sharding, tokens, toxicity, vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(11)
WORDS = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(60)]


def prose(n, seed=None):
    r = np.random.default_rng(seed) if seed is not None else RNG
    return " ".join(WORDS[i] for i in r.integers(0, len(WORDS), n))


BASE = prose(300, 1)
TEXTS = [
    None, "", " \n\t ", "one", "one two three", BASE, BASE, BASE.replace("W5 ", "x5 ", 1), BASE.lower(), prose(12, 2), prose(12, 2) + " tail",
    "word " * 20000, prose(5000, 3), prose(40, 4) + " " + prose(30, 9) + " end", "!!! ***", "été ÉTÉ", prose(200, 5), prose(200, 5) + " a b c",
]
DOCS = [(i, t, ["en", "fr", None][i % 3], ["s0", "s0", "s1", None][i % 4], i) for i, t in enumerate(TEXTS)] + [(5, BASE, "en", "s0", 0), (None, BASE, "en", "s0", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_hit long"
ITEMS = [(1, prose(30, 9)), (2, "one two"), (3, None), (4, "!!"), (None, "one"), (5, prose(12, 2)), (10, prose(12, 2))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_decontaminate(spark, docs, nothing):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: pattern.findall((t or "").translate(LOWER))
    wins = {}
    for item, text in ITEMS:
        w = split(text)
        if item is not None and w:
            for k in range(max(len(w) - 9, 1)):
                wins.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    expected = []
    for row in DOCS:
        w, hit, items, near = split(row[1]), set(), set(), 0
        for win, own in wins.items():
            need, wide = Counter(win), len(win) + decontaminate.SLACK
            near += set(win) <= set(w) and any(not need - Counter(w[k : k + wide]) for k in range(max(len(w) - wide + 1, 1)))
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    items |= own
        expected.append((row[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit), near))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = [tuple(r) for r in decontaminate.query(docs, items).collect()]
    assert sorted(out, key=str) == sorted(expected, key=str)
    assert decontaminate.query(nothing, items).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.query(docs, items.limit(0)).collect())
    assert decontaminate.clean(docs, items).count() == sum(not e[-2] for e in expected)


def test_decontaminate_finds_what_is_near(spark):
    item = "a b c d e f g h i rare"
    texts = {
        "rare a b c d e f g h i": 1, "a x b x c x d x e x f g h i rare": 1, "a x b x c x d x e x f x g h i rare": 0, "rare": 0, "x rare x": 0,
        "a b c d e f g h i": 0, "rare rare a b c d e f g h": 0, item: 1, "x " * 40 + "i h g f e d c b a rare" + " y" * 40: 1, "a b c d e f g h i " + "x " * 6 + "rare": 0,
    }
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for own in (item, "a a b rare"):
        items = spark.createDataFrame([(1, own)], "item_id long, text string")
        out = {r["doc_id"]: r for r in decontaminate.query(docs, items).collect()}
        for k, text in enumerate(texts):
            w, need = text.split(), Counter(own.split())
            wide = len(own.split()) + decontaminate.SLACK
            assert out[k]["n_near"] == any(not need - Counter(w[i : i + wide]) for i in range(max(len(w) - wide + 1, 1)))
            assert own != item or out[k]["n_near"] == texts[text]
            assert out[k]["contaminated"] == (f" {own} " in f" {text} ")


def expected_groups(rows):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    out = []
    for a, row in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None]
        own = min(ids) if row[0] is not None else None
        out.append((row[0], len(sets[a]), own, row[0] is None or row[0] == own))
    return sorted(out, key=str)


def test_neardup(spark, docs, nothing):
    assert sorted((tuple(r) for r in neardup.query(docs).collect()), key=str) == expected_groups(DOCS)
    assert neardup.query(nothing).count() == 0
    kept = [r["doc_id"] for r in neardup.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) and None in kept


@pytest.mark.parametrize("region", [16, 512])
def test_neardup_star_and_chain(spark, monkeypatch, region):
    """Copies near a base but not near each other, over several blocks, and a chain: no link between components is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PAIR_BLOCK", 16)
    monkeypatch.setattr(neardup, "REGION", region)
    r = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for k in range(70):
        w = list(base)
        for p in r.choice(200, 4, replace=False):
            w[p] = f"x{k}_{p}"
        rows.append((100 + k, " ".join(w)))
    rows.append((900, " ".join(base)))
    chain = [f"c{i}" for i in range(260)]
    rows += [(1000 + s, " ".join(chain[s * 4 : s * 4 + 200])) for s in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(x) for x in neardup.query(df).collect()), key=str) == expected_groups(rows)


def test_sharding(docs, nothing):
    out = sharding.query(docs).toPandas()
    assert sorted(out["size"]) == sorted(len((d[1] or "").encode()) + 1 for d in DOCS)
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert sharding.query(nothing).count() == 0
    assert set(sharding.shard(docs).columns) == {*docs.columns, "size", "shard", "slot"}


def test_sharding_columns_against_plain_python(docs):
    out = sharding.query(docs)
    plain = sorted(((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in DOCS), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in out.collect()), key=str) == plain
    assert {(r["law"], r["grown_shard"]) for r in out.collect()} == {("bytes", None)}


@pytest.mark.parametrize("repeated", [False, True])
def test_sharding_splits_frequent_texts(spark, monkeypatch, repeated):
    """A third of all rows has one text, or one text and id: it is numbered in many cells, gaplessly."""
    monkeypatch.setattr(sharding, "CELL_BYTES", 500)
    rows = [(7 if repeated else i, "same" * 10) for i in range(1500)] + [(2000 + i, prose(8)) for i in range(3000)]
    out = sharding.query(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert len(out) == 4500 and sorted(out.doc_id) == sorted(r[0] for r in rows)
    sizes = out.groupby("shard")["size"].sum()
    if not repeated:
        assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * 90 + 0.002 * sizes.mean()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_sharding_is_even_and_keeps_copies_together(spark):
    rows = [(i, "same" * 40) for i in range(1500)] + [(1500 + i, prose(20)) for i in range(3000)]
    out = sharding.query(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * 161 + 0.002 * sizes.mean()
    copies = out[out.doc_id < 1500]
    assert copies.shard.nunique() <= -(-copies["size"].sum() // int(sizes.mean())) + 1  # side by side, no more shards than they fill


def test_mixing(spark, docs, nothing):
    out = mixing.mix_sources(docs).toPandas()
    assert {"copy", "rate", "n_copies", "mix_key", "text"} <= set(out.columns)
    assert mixing.mix_sources(nothing).count() == 0
    rows = spark.range(20000).selectExpr("id AS doc_id", "'0123456789' AS text", "IF(id % 10 < 8, 'hot', 'rare') AS source")
    weights = spark.createDataFrame([("hot", 1.0), ("rare", 1.0)], "source string, weight double")
    n = dict(mixing.mix_sources(rows, weights).groupBy("source").count().collect())
    assert abs(n["hot"] - 10000) < 400 and abs(n["rare"] - 10000) < 400
    assert mixing.mix_sources(rows, weights.where("source = 'rare'")).where("source = 'hot'").count() == 0


@pytest.mark.parametrize(("rate", "n"), [(0.01, 3000), (1.0, 2000), (50.0, 500), (800.0, 200), (2000.0, 100), (1e5, 12)])
def test_mixing_draws_the_quantiles_of_any_rate(spark, rate, n):
    """Each count is the least k whose distribution function, summed exactly, reaches the document's uniform number."""
    import math

    low = max(0, int(rate - 12 * rate**0.5 - 40))
    p = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(low, int(rate + 12 * rate**0.5 + 41))]
    cdf = np.cumsum(p) / math.fsum(p)
    rows = spark.range(n).selectExpr("id AS doc_id", "'0123456789' AS text", "'a' AS source").union(spark.sql("SELECT 1000000L, '0123456789', 'b'"))
    weights = spark.createDataFrame([("a", n * rate), ("b", 1.0)], "source string, weight double")
    out = mixing.mix_sources(rows, weights, epochs=(n * rate + 1.0) / (n + 1)).where("source = 'a' AND copy = n_copies - 1")
    got = {r["doc_id"]: (r["n_copies"], r["rate"]) for r in out.select("doc_id", "n_copies", "rate").collect()}
    for k in range(n):
        u = (int(hashlib.md5(f"mix:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        assert got.get(k, (0, rate)) == (low + int(np.searchsorted(cdf, u)), pytest.approx(rate))
    if rate >= 50:
        drawn = np.array([v[0] for v in got.values()])
        assert abs(drawn.mean() - rate) < 5 * (rate / n) ** 0.5


NAMES = ["_s", "_cdf", "_u", "_t", "_d", "_k1", "_k2", "_size", "_cell", "_at", "_low", "_doc", "_hash", "_text", "copy", "cell", "low", "k", "_value", "_order", "held", "_before", "key", "component"]


def test_columns_of_any_name_pass_through(spark, docs):
    """Extra columns that are called like temporary ones come out as they went in, and change no decision."""
    from pyspark.sql import functions as F

    wide = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id"), F.lit(-1))) for c in NAMES})
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for run in (lambda d: mixing.mix_sources(d), lambda d: sharding.shard(d), lambda d: decontaminate.clean(d, items), lambda d: language.keep_identified(d), lambda d: neardup.keep_one(d), lambda d: language.identify(d, language.train(d))):
        out = run(wide)
        kept = [c for c in NAMES if c not in mixing.ADDED or "mix_key" not in out.columns]
        assert set(kept) <= set(out.columns)
        rows = out.select("doc_id", *kept).collect()
        assert all(r[c] == f"{c}:{-1 if r['doc_id'] is None else r['doc_id']}" for r in rows for c in kept)
        assert sorted((r["doc_id"] for r in rows), key=str) == sorted((r["doc_id"] for r in run(docs).select("doc_id").collect()), key=str)


def test_shared_folder(spark, monkeypatch):
    """On a cluster without a named folder nothing is written to a folder of this machine."""
    from types import SimpleNamespace

    from weftline.llm import common

    nothing = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nothing)))
    with pytest.raises(RuntimeError):
        common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
    assert common.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: "hdfs://x/y/"))) == "hdfs://x/y"


def test_language(spark, docs, nothing):
    own = {"en": "the house and the river of stone with that word", "fr": "la maison et la rivière été avec que des mots"}
    rows = [(i, " ".join(np.random.default_rng(i).permutation(own[lang].split())), lang) for i in range(200) for lang in (["en", "fr"][i % 2],)]
    rows += [(500, None, "en"), (501, "", "fr"), (502, "12 345 !!", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.query(df).collect()}
    assert all(out[i]["lang_pred"] == lang for i, _, lang in rows[:200])
    assert [(out[i]["lang_pred"], out[i]["score"]) for i in (500, 501, 502)] == [("und", 0.0)] * 3
    assert out[0]["held_out"] == (zlib.crc32(b"0") % 4 == 2)
    assert language.keep_identified(df).columns == df.columns and language.keep_identified(df).count() == 200
    assert language.query(docs).count() == len(DOCS) and language.query(nothing).count() == 0


def test_language_kernel_is_exact_for_any_alphabet():
    """Scores by the lookup tables, by sorting, and by Python sets are the same; an alphabet of 200 letters keeps its letters apart."""
    wide = [chr(0x4E00 + k) for k in range(200)]
    make = lambda r, a: " ".join("".join(a[i] for i in r.integers(0, len(a), r.integers(1, 7))) for _ in range(30))
    texts = [make(np.random.default_rng(k), "abcdefgh" if k % 2 else wide[:100]) for k in range(40)] + [make(np.random.default_rng(k), wide[100:]) for k in range(40, 60)]
    labels = [("aa" if k % 2 else "zz") for k in range(40)] + ["yy"] * 20

    def grams(text):
        c = re.sub(" +", " ", "".join(x if x.isalpha() else " " for x in f" {text.lower()} "))
        return {c[k : k + n] for n in (2, 3) for k in range(len(c) - n + 1)} | set(c.strip())

    for some, names in ((texts, labels), (texts[1:40:2] + ["xyz uvw"] * 4, ["aa"] * 20 + ["bb"] * 4)):
        model = language.fit(some, names)
        marks = [next(t for t in some if model.presence(t)[0][model.landmarks[:, k] > 0].all() and model.presence(t)[0].sum() == (model.landmarks[:, k] > 0).sum()) for k in range(model.landmarks.shape[1])]
        test = [texts[1], texts[2], texts[50], "Abc 12 def é", "zzz"]
        plain = [[len(grams(t) & grams(m)) / (len(grams(t)) * len(grams(m))) ** 0.5 for m in marks] for t in test]
        assert np.allclose(model.kernel([model.presence(t) for t in test]), plain, atol=1e-5)
        assert model.scores(some)[0] == names
    assert len(model.places) == 3 and not language.fit(texts, labels).places


def test_tokens_round_trip(docs, nothing, tmp_path):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    out = sorted(tokens.query(docs).toPandas().itertuples(index=False), key=lambda r: r.start)
    at = 0
    for r in out:
        texts = [d[1] for d in DOCS if d[0] == r.doc_id or (d[0] is None and r.doc_id != r.doc_id)]
        ids = [*tok.encode(texts[0] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(out) == len(DOCS) and tokens.query(nothing).count() == 0
    written = tokens.write_tokens(docs, f"file://{tmp_path}", path, length=16)
    with pa.memory_map(f"{tmp_path}/{written[0][0]}.ids.arrow") as f:
        ids, mask = tokens.sequence(f, 0)
        assert len(ids) == len(mask) == 16
    mixed = ["İ, Été. don't <|endoftext|> ﬁ... \xa0x", "á, ΑΣ."]
    encoded = lambda texts: (lambda ids, n: [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])])(*tokens.Pieces(path).encode(texts))
    assert encoded(mixed) == [e.ids for e in tok.encode_batch(mixed, add_special_tokens=False)]
    parts = [" ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "\u2028", "a", "B", "É", "e\u0301", "\u0301", "İ", "ẞ", "Σ", "1", "½", "'s", "'T", ".", "!?", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "_", "日", "😀", "ﬁ"]
    mixed = ["".join(parts[i] for i in RNG.integers(0, len(parts), n)) for n in RNG.integers(0, 14, 5000)]
    assert encoded(mixed) == [e.ids for e in tok.encode_batch(mixed, add_special_tokens=False)]


PAGE = (
    '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><a href="/">menu</a></nav><div class="ad">buy</div>'
    "<article><header><h1>Head &amp; {k}</h1></header><p>First\n  text <b>{k}</b> &lt;here<br>then<!-- no --><p>More &copy;<div class='comments'>nice!</div>"
    "<form>mail</form><aside>side</aside><ul><li>point {k}</li></ul></article><footer>foot</footer></body></html>"
)


def test_html(spark):
    rows = [(k, f"http://a.example/{k}", PAGE.replace("{k}", f"v{k}")) for k in range(6)]
    rows += [(10, None, None), (11, "http://b.example/x", ""), (12, "http://c.example", "<p>plain text<p>two"), (13, "http://d.example", PAGE[: PAGE.index("More")]), (0, "http://a.example/0", PAGE.replace("{k}", "v0"))]
    out = html.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in out}
    assert len(out) == len(rows) and text[10] == "" and text[11] == ""
    assert text[3] == "Head & v3\nFirst text v3 <here\nthen\nMore ©\npoint v3"
    assert text[12] == "plain text\ntwo" and text[13].startswith("Head & {k}\nFirst")
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_html_pages_outside_the_sample_keep_their_text(spark):
    wide = "<html><body><div class='{c}'>text {k}</div></body></html>"
    rows = [(k, "http://a.example/", f"<html><body class='page-{k}'><article id=post-{k} class='post-{k} t{k}'><p>text {k}</p></article></body></html>") for k in range(300)]
    rows += [(k, "http://b.example/", f"<html><body><div id=post-{k}><p>text {k}</p></div></body></html>") for k in range(300, 600)]
    rows += [(k, "http://c.example/", wide.format(c="content", k=k)) for k in range(600, 690)] + [(k, "http://c.example/", wide.format(c="content-wide", k=k)) for k in range(690, 700)]
    rows += [(k, "http://d.example/", f"<html><body><div id='{'abcdefghij'[k % 10] * (k - 699)}'><p>text {k}</p></div></body></html>") for k in range(700, 800)]
    out = html.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 800 and all(r["text"] == f"text {r['page_id']}" for r in out)
    assert html.main_text(wide.format(c="content-wide", k=1), [">html>body>div.content"], []) == "text 1"


def test_html_template_texts_are_those_of_nearly_all_pages(spark):
    page = "<html><body><article><div class=author>{a}</div><p>text {k}</p><div class=legal>All rights</div></article></body></html>"
    rows = [(k, "http://a.example/", page.format(k=k, a="Staff" if k % 20 else f"Writer {k}")) for k in range(400)]
    rows += [(k, "http://b.example/", page.format(k=k, a="Staff" if k % 4 else f"Writer {k}")) for k in range(400, 800)]
    out = {r["page_id"]: r["text"].split("\n") for r in html.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[k] == ([f"Writer {k}"] if k % 20 == 0 else []) + [f"text {k}"] for k in range(400))
    assert all(out[k] == [f"Writer {k}" if k % 4 == 0 else "Staff", f"text {k}"] for k in range(400, 800))


@pytest.mark.parametrize(
    ("inner", "expected"),
    [
        ('<p>one <svg class="i"/> two</p><p>three</p>', "one two\nthree"),
        ("<p>one <svg viewBox='0'><title/><path d='m'/></svg>two</p><p>three</p>", "one two\nthree"),
        ("<p>one <svg><path><p>two</p>", "one\ntwo"),
        ("<svg><foreignObject><div>label</div></foreignObject></svg><p>one</p>", "one"),
        ("<p>one <button>press</p><p>two</p>", "one\ntwo"),
        ("<ul><li>one <select><option>a<li>two</ul><p>three</p>", "one\ntwo\nthree"),
        ("<section>one<template><p>no</section><p>two</p><iframe/><noscript/>", "one\ntwo"),
        ("<button><div>no</div>no</button>one<script src='a'/></script><p>two</p><iframe src=http://x.example/>no</iframe>", "one\ntwo"),
    ],
)
def test_html_widgets_swallow_nothing(inner, expected):
    assert html.main_text(f"<html><body><article>{inner}</article></body></html>", [], []) == expected


@pytest.mark.parametrize(
    ("inner", "expected"),
    [
        ('<p>one</p><article class="comment"><p>nice</p></article><p>two</p>', "one\ntwo"),
        ('<p>one</p><p class="ad">Buy<br>now</p><p>two</p><h3 class="related-posts">More</h3>three', "one\ntwo\nthree"),
        ('<p>one</p><ul><li class="share">Share<li>two</ul><p class=lead>three</p>', "one\ntwo\nthree"),
        ('<div class="side-effects">one</div><div class="search-results">two</div><div class="share-price">three</div>', "one\ntwo\nthree"),
        ('<div class="side">no</div><div class="search-box">no</div><div class="share-buttons">no</div><div class="alert alert-info">no</div><div id="site-search">no</div>one', "one"),
        ('<div class="has-sidebar"><p>one</p><div class="sidebar-left">no</div></div><div data-id="ads">two</div>', "one\ntwo"),
        ('<table><tr><td class="search">one</td><td>two</td></tr></table>', "one\ntwo"),
    ],
)
def test_html_leaves_out_parts_by_whole_names(inner, expected):
    for name in ("article", "main"):
        assert html.main_text(f"<html><body><{name}>{inner}</{name}></body></html>", [], []) == expected


def test_html_without_article_keeps_paragraphs_around_the_longest_container(spark):
    page = "<html><body><p>Welcome</p><div id=b><p>two {k}</p><section><p>deep text of page {k}, the longest part</p></section></div><div id=foot>Made by us</div></body></html>"
    rows = [(k, "http://a.example/", page.replace("{k}", str(k))) for k in range(40)] + [(99, "http://b.example/", page.replace("{k}", "99"))]
    out = html.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r["text"] == "two {0}\ndeep text of page {0}, the longest part".format(r["page_id"]) for r in out)
    assert html.main_text(page.replace("{k}", "7"), [], []) == "two 7\ndeep text of page 7, the longest part"


@pytest.mark.parametrize("d", [24, 64, 128])
def test_vectors(spark, d):
    """Links and components of every row against brute force, with copies and a repeated id."""
    r = np.random.default_rng(5)
    centres = r.standard_normal((6, d))
    x = [(c + 0.2 * r.standard_normal(d)).astype(np.float32) for c in centres for _ in range(60)]
    x += [x[3]] * 40
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    rows += [rows[0], (1, x[100].tolist(), 0)]  # an id twice: the same vector, another vector
    vecs = np.array([v for _, v, _ in rows], dtype=float)
    rows += [(900, None, 0), (901, [0.0] * d, 0), (902, x[0].tolist(), None), (903, [float("nan")] * d, 0), (904, [None] * d, 0), (905, [1.0, 2.0], 0), (None, x[0].tolist(), 0)]
    schema = "vec_id long, embedding array<float>, label int"
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    label = np.array([y for _, _, y in rows[: len(vecs)]])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    least = np.array([i for i, _, _ in rows[: len(vecs)]])
    for _ in range(len(vecs)):
        step = np.minimum(least, np.where(near, least[None, :], 10**6).min(1))
        if (step == least).all():
            break
        least = step
    expected = [(i, int(n), int(c), i == c) for (i, _, _), n, c in zip(rows, near.sum(1), least, strict=False)]
    expected += [(i, 0, i, True) for i in range(900, 906)] + [(None, 0, None, True)]
    out = [tuple(o) for o in vectors.query(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(out, key=str) == sorted(expected, key=str)
    assert vectors.query(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize(("n", "common"), [(600, 0.8), (3000, 0.8), (600, 0.96)])
def test_vectors_with_a_common_direction(spark, n, common):
    r = np.random.default_rng(7)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    centre = unit(r.standard_normal((1, 64)))
    x = unit(np.sqrt(common) * centre + np.sqrt(1 - common) * unit(r.standard_normal((n, 64))))
    u = r.standard_normal(x.shape)
    u = unit(u - (u * x).sum(1, keepdims=True) * x)
    x = np.concatenate([x, 0.94 * x + np.sqrt(1 - 0.94**2) * u])
    near = int(np.triu(x @ x.T >= 0.93, 1).sum()) * 2
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    found = sum(o["n_links"] for o in vectors.query(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert near >= 2 * n and 0.998 * near <= found <= near


def labelled(spark, n=400):
    rows, labels = [], []
    for i in range(n):
        r = np.random.default_rng(i)
        bad, junk = i % 4 == 0, i % 3 == 0
        w = [f"{'abcdefgh'[a]}{'aeiou'[b]}{'klmnrst'[c]}" for a, b, c in zip(r.integers(0, 8, 80), r.integers(0, 5, 80), r.integers(0, 7, 80), strict=True)]
        if bad:
            w[r.integers(0, 80)] = "zzvileword"
        if junk:
            w = [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w), "en"))
        labels.append((i, int(not junk), int(bad)))
    rows += [(9000, None, "en"), (9001, "", "en"), rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame([*labels, (9000, None, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "column", "mod", "rest"), [(toxicity, "toxic", 4, 2), (quality, "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, module, column, mod, rest):
    docs, labels = labelled(spark)
    out = module.query(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    truth = {r["doc_id"]: r[column] for r in labels.collect()}
    held = out[out.held_out & (out.doc_id < 9000)]
    assert all(held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % mod == rest))
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.9
    assert module.query(docs.limit(0), labels).count() == 0
    assert module.query(docs, labels.limit(0)).toPandas().score.eq(0).all()


def test_quality_keeps_all_shapes_of_a_text(monkeypatch):
    many = " ".join(f"{chr(0x4E00 + k)}a{chr(0x4E00 + k // 7)}" for k in range(300))
    plain = [prose(40, k) for k in range(20)]
    texts, y = [*plain, *[p.upper() + " !!" for p in plain]], [0] * 20 + [1] * 20
    expected = quality.fit(texts, y).score(many)
    monkeypatch.setattr(quality, "SHAPES_HELD", 50)
    model = quality.fit(texts, y)
    assert [model.score(t) for t in (many, texts[0], many)] == [expected, model.score(texts[0]), expected]
