"""Small cases of every operator: nulls, empty and repeated rows, ties, clashing columns, empty tables."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import bpe, exact_dedup, html_text, language_id, license_scan, mixing, ngram_join, sharding, topk_search, toxicity
from logweave.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node int, score double"


def documents(spark, texts):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 1, 0.5) for i, t in texts], SCHEMA)


LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [(3, "a  b\tc"), (1, "a b c"), (2, None), (4, ""), (5, LONG), (6, LONG + " end"), (7, LONG.replace("w30", "zz")),
         (5, LONG), (None, "a b c"), (None, None), (8, "x" * 300_000), (9, "one two")]


def test_exact_dedup(spark):
    got = {(r.doc_id, r.kept): r for r in exact_dedup.dedup(documents(spark, TEXTS)).collect()}
    assert got[1, True].keep_id == 1 and got[1, True].group_size == 3 and got[3, False].keep_id == 1
    assert got[None, False].text_sha256 is not None and got[2, True].group_size == 3 and got[4, False].keep_id == 2
    assert got[1, True].text_sha256 == hashlib.sha256(b"a b c").hexdigest()
    kept = exact_dedup.keep_first(documents(spark, TEXTS))
    assert kept.columns == SCHEMA.replace(",", "").split()[::2] and sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 6, 7, 8, 9]
    assert exact_dedup.dedup(documents(spark, [])).count() == 0


def test_cuckoo_index_survives_growth_and_deletes():
    index, keys = exact_dedup.CuckooIndex(2), [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for k in keys:
        assert index.find(k) is None
        index.insert(k, 1)
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.find(k) is not None for k in keys] == [i % 2 == 1 for i in range(5000)] and len(index) == 2500
    index.insert(keys[0], 2)
    assert index.find(keys[0]) is not None


def test_index_changes(spark):
    rows = lambda *ks: spark.createDataFrame([(bytearray(k),) for k in ks], "digest binary")
    index = spark.createDataFrame([(bytearray(b"a" * 32), 2), (bytearray(b"b" * 32), 1)], "digest binary, live long")
    got = {(bytes(r.digest)[:1], r.kind): (r.hit, r.live) for r in exact_dedup.apply_changes(index, rows(b"a" * 32, b"c" * 32), rows(b"b" * 32, b"d" * 32)).collect()}
    assert got[b"a", "insert"] == (False, 1) and got[b"c", "insert"] == (True, 1) and got[b"b", "delete"][0] and not got[b"d", "delete"][0]
    assert got[b"a", "live"][1] == 3 and (b"b", "live") not in got


def brute_components(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_ngram_join_small(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(documents(spark, TEXTS)).collect()}
    want = brute_components([t for t in TEXTS if t[0] is not None])
    assert {k: v for k, v in got.items() if k is not None} == want and got[None][1] is None
    assert want[6] == (57, 5) and sorted(r.doc_id for r in ngram_join.keep_first(documents(spark, [t for t in TEXTS if t[0]])).collect()) == [1, 2, 4, 5, 5, 8, 9]
    assert ngram_join.near_components(documents(spark, [])).count() == 0


def test_ngram_join_random(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "TILE", 3)
    r = np.random.default_rng(3)
    base = [[f"t{r.integers(50)}" for _ in range(r.integers(3, 60))] for _ in range(6)]
    texts = []
    for i in range(90):
        w = list(base[r.integers(6)])
        for _ in range(r.integers(0, 4)):
            w[r.integers(len(w))] = f"n{r.integers(400)}"
        texts.append((i, " ".join(w).upper() if i % 2 else "\n".join(w)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_components(documents(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_bpe_matches_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = [*TEXTS, (20, "It's <|endoftext|>5²  ÀÉ Σς İ \x1c x\x85y 日本 😀 aaaa'LL ﬁ"), (21, "ab" * 400)]
    tok = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = bpe.decode(bpe.encode(documents(spark, texts), tokenizer_path()), tokenizer_path()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = tok.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == want and r.decoded == tok.decode(want, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.round_trip(documents(spark, texts), tokenizer_path()).collect()}
    ids = tok.encode(texts[-2][1], add_special_tokens=False).ids
    assert got[20].n_tokens == len(ids) and got[20].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert bpe.round_trip(documents(spark, []), tokenizer_path()).count() == 0


def test_toxicity_small(spark):
    docs = documents(spark, [(i, f"plain words number {i} " + ("vilest " if i % 3 == 0 else "kind ") + "here") for i in range(300)] + [(900, None), (901, "")])
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(300)] + [(1, 1, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    wrong = [i for i in range(300) if rows[i].held_out and rows[i].predicted != int(i % 3 == 0)]
    assert len(rows) == 302 and not wrong and rows[900].score == rows[901].score and 0 <= rows[900].score <= 1
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns and clean.where("doc_id % 3 = 0 and doc_id < 300").count() == 0
    assert toxicity.toxicity(docs, labels.limit(0)).agg(F.max("score")).first()[0] == 0


def test_html(spark):
    page = ('<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Accept</div>'
            '<article><h1>Head &amp; &lt;b&gt;</h1><p>One <b>two<br>three<p>Four&nbsp;five <a href="x">six</a>.<aside>Side</aside><form><p>Mail</form>'
            '<section id="comments"><p>First!</section></article><div class="ad">Buy</div><footer>F</footer><script>var a="</p>";</script></body></html>')
    plain = "<body><div class=x9>Same on all</div><div class=body><p>Text number {0} of the site</p><p>{0} more</p></div>"
    rows = [(1, "http://a.b/x", page, "z"), (2, None, None, "z"), (3, "u", "", "z"), (3, "u", "<p>a<p>b", "z")] + [(10 + i, "http://s.t/", plain.format(i), "z") for i in range(6)]
    got = {}
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    want = "Head & <b> One two three Four five six."
    assert got[1] == [(want, len(want))] and got[2] == [("", 0)] and sorted(got[3]) == [("", 0), ("a b", 3)]
    assert all(got[10 + i][0][0].endswith(f"Text number {i} of the site {i} more") for i in range(6))
    assert got[10][0][0].startswith("Text number"), "the branch that all pages of a host repeat goes"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_large_host_keeps_unique_text(spark):
    """Many pages, all texts different, few layouts: the undeclared main branch stays; repeated text goes."""
    share = np.floor(200_000 * np.cumsum(0.85 ** np.arange(30)) / np.sum(0.85 ** np.arange(30)))
    kind = F.size(F.filter(F.array(*[F.lit(float(x)) for x in share]), lambda x: x <= F.col("id"))).cast("long")
    branch = lambda node, feature, shape: F.struct(F.lit(node).cast("long").alias("node"), feature.cast("long").alias("feature"), shape.alias("shape"), F.lit(False).alias("suspect"))
    rows = spark.range(200_000).select(F.lit("h").alias("host"), F.col("id").alias("copy"),
                                      F.array(branch(1, F.col("id"), kind), branch(2, F.lit(5), F.lit(0).cast("long"))).alias("branches"))
    got = {r.node: r.importance for r in html_text.importance(rows).collect()}
    assert got[1] >= html_text.LOW > got[2]


def test_html_words_alone_remove_nothing_unique(spark):
    """Class and id words: declared articles and unique text stay, notices in them and what repeats goes, a lone page is not emptied."""
    lone = {1: "<div id='content' class='no-sidebar'><article class='post comments-open'><h2 id='related-work'>Related work</h2>"
               "<section id='search-methods'><p>Methods</p></section><p class='notice'>Note</p></article></div>",
            2: "<div class='content-sidebar-wrap'><p>All of the text</p></div>",
            3: "<div class='ad'>Buy</div><div>Text <span class='share'>Share</span></div>"}
    rows = [(i, f"http://h{i}.org/", t) for i, t in lone.items()]
    rows += [(10 + i, "http://many.org/", f"<div class='promo'>Buy this</div><div class='share-wrap'><p>Story {i} a</p><p>More {i}</p></div><div id='comments'>Say</div>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "Related work Methods" and got[2] == "All of the text" and got[3] == "Text"
    assert all(got[10 + i] == f"Story {i} a More {i}" for i in range(8))


def test_html_repeated_text_without_words_goes(spark):
    """Elements without class or id, in and out of an article, are in the style tree; copies of an article stay."""
    rows = [(i, "http://a.org/", f"<article><h1>Title {i}</h1><p>Story {i} of <b>ours</b></p><p>Read us daily</p>Thanks<br>all</article><footer>F</footer>") for i in range(8)]
    rows += [(20 + i, "http://b.org/", f"<body><p>Read us daily</p><p>Story {i} of ours</p></body>") for i in range(8)]
    rows += [(40 + i, "http://c.org/", "<article><p>One story</p><p>Read us daily</p></article>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} Story {i} of ours" and got[20 + i] == f"Story {i} of ours" for i in range(8))
    assert all(got[40 + i] == "One story Read us daily" for i in range(8))


def test_language(spark):
    words = {"en": "the house and the garden are here with us", "de": "das haus und der garten sind hier bei uns", "fr": "la maison et le jardin sont ici avec nous"}
    docs = spark.createDataFrame([(i, t + f" {i}", k) for i, (k, t) in enumerate(list(words.items()) * 8)], "doc_id long, text string, lang string")
    rows = [(i, f"http://{k}.site.org/p", f'<html lang="{k}"><p>{t}</p>') for i, (k, t) in enumerate(list(words.items()) * 4)]
    rows += [(50, "http://x.org/", f'<html lang="en"><p>{words["de"]} {words["de"]}</p>'), (51, None, None), (52, "http://fr.site.org/q", "<html lang=fr>")]
    got = {r.page_id: r.lang for r in language_id.identify(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert [got[i] for i in range(12)] == list(words) * 4 and got[50] == "de" and got[51] in words and got[52] == "fr"


def test_mixing(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en" if i % 4 else None, "big" if i % 3 else "small", 0) for i in range(3000)] + [(None, None, None, None, 0)],
                                 "doc_id long, text string, lang string, source string, probability int")
    goal = spark.createDataFrame([("big", 0.5), ("small", 0.5)], "value string, share double")
    rows = mixing.mix(docs, {"source": goal}, 0.3).toPandas()
    mass = (rows.n_tokens * rows.probability).groupby(rows.source).sum()
    assert abs(mass["big"] - mass["small"]) < 5 and abs(mass.sum() - 0.3 * 30_000) < 5
    assert abs(rows.kept.sum() - 900) < 120 and len(rows) == 3001
    assert mixing.draw(docs).columns == docs.columns and mixing.mix(docs.limit(0)).count() == 0


def test_sharding(spark):
    docs = documents(spark, [(i, "copy" if i % 3 == 0 else f"pair {i % 40}" if i % 3 == 1 else f"own {i}") for i in range(1003)] + [(None, None), (5, "é")])
    rows = sharding.shard(docs).toPandas()
    sizes = rows.groupby("shard").size()
    assert len(rows) == 1005 and sizes.max() - sizes.min() <= 1 and len(sizes) == 8
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard")) and set(rows.law) == {"rows"}
    assert rows[(rows.doc_id == 5) & (rows["size"] == 3)].shape[0] == 1
    small = rows[rows.doc_id % 3 == 1].groupby("text_crc32").shard.nunique()
    assert small.mean() < 2.6, "8 copies of a text gather (a hash would leave them in 5 shards)"
    assert sharding.shard(documents(spark, [])).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in np.round(r.normal(size=8), 1) * (1 + i % 5)], 0) for i in range(200)]
    vectors += [(200, None, 0), (201, [float("nan")] * 8, 0), (202, [1.0, None], 0), (None, [1.0] * 8, 0), (7, vectors[7][1], 0)] + [(300 + i, [0.5] * 8, 0) for i in range(60)]
    got = topk_search.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, score int")).collect()
    own = {i: np.floor(64 * np.array(np.float32(v), np.float64)).astype(int) for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in own if i % 20 == 0):
        best = sorted((-int(own[q] @ own[c]), c) for c in own if c != q)[:20]
        assert [(r.vec_id, r.score) for r in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == [(c, -s) for s, c in best]
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_license(spark):
    filler = "lorem ipsum " * 200
    docs = documents(spark, [(1, filler + "Released under the\nMIT license!"), (2, "license"), (3, None), (4, ""), (5, filler),
                             (6, "Permission is hereby granted, FREE of charge, to any person obtaining a copy of this software and associated documents " + filler)])
    got = {(r.doc_id, r.license): r.containment for r in license_scan.scan(docs).collect()}
    assert set(got) == {(1, "mit"), (6, "mit-grant")} and got[1, "mit"] == 1 and 0.75 <= got[6, "mit-grant"] < 1
    assert license_scan.scan(documents(spark, [])).count() == 0


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    left = toxicity.keep_clean(docs, labels).collect()
    first = {}
    for r in sorted(left, key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
    texts = [(r.doc_id, r.text) for r in left if r.doc_id in set(first.values())]
    near = brute_components(texts)
    stay = [i for i, _ in texts if near[i][1] == i]
    drawn = mixing.mix(docs.where(F.col("doc_id").isin(stay))).where("kept")
    assert sorted(r.doc_id for r in out.select("doc_id").collect()) == sorted(r.doc_id for r in drawn.collect())


def test_toxicity_on_held_out_documents(spark):
    """Real labelled rows that the fit never sees."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.toxicity(docs, labels).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert len(rows) > 50 and sum(r.predicted == truth[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_toxicity_odd_rows(spark):
    docs = documents(spark, [(1, "vile " * 60_000), (1, "vile " * 60_000), (2, None), (None, "kind words")])
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 4 and len({r.score for r in rows if r.doc_id == 1}) == 1 and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_top_k_with_fewer_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.5]), (20, [0.5, 1.0]), (21, [0.5, 1.0]), (22, None)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in topk_search.top_k(df).collect())
    assert got == [(0, 1, 20), (0, 2, 21), (20, 1, 21), (20, 2, 0)]


def test_pipeline_odd_documents(spark, tmp_path):
    """Nulls, repeated rows, long texts, clashing columns and an empty table."""
    import corpus_pipeline
    rows = [(i, f"plain words number {i} and more of them here", "en", "s1", 1, "x", 7) for i in range(40)]
    rows += [(3, "plain words number 3 and more of them here", "en", "s1", 1, "x", 7), (None, None, None, None, None, None, None), (50, "", "fr", None, 0, "", 0),
             (51, "long " * 60_000, None, "s2", 5, "x", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, node int"
    spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, kept in (("a", rows), ("b", [])):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "labels.parquet").symlink_to(tmp_path / "labels.parquet")
        spark.createDataFrame(kept, schema).write.parquet(str(folder / "documents.parquet"))
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, str(folder))
            if k < 4:
                assert out.columns == docs.columns
                out.write.parquet(str(folder / f"stage{k}"))
                docs = spark.read.schema(out.schema).parquet(str(folder / f"stage{k}"))
        got = out.collect()
        assert bool(got) == bool(kept) and all(r.n_tokens >= 0 for r in got)
