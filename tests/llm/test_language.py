"""Operator 2: the fusion against brute force, held-out documents, wrong declarations, odd rows."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from logweave.llm import language_id as li

PAGES = "page_id long, url string, html string, host string, text string, p0 int"


def brute(rows, langs):
    """Language of each evidence row by the stated sums, in Python."""
    post = {}
    for r in rows:
        e = [math.exp(x) for x in r.text]
        post[r.page_id] = [x / sum(e) for x in e]
    every = [sum(p[k] for p in post.values()) for k in range(len(langs))]
    values = [*langs, "other", "none"]
    by = {c: defaultdict(lambda: [0.0] * len(langs)) for c in ("declared", "suggested", "host", "domain")}
    for r in rows:
        for c in by:
            key = (r.domain, r.host) if c == "host" else r[c]
            by[c][key] = [a + b for a, b in zip(by[c][key], post[r.page_id])]
    out = {}
    for r in rows:
        p, m, d = post[r.page_id], by["host"][r.domain, r.host], by["domain"][r.domain]
        score = []
        for k, lang in enumerate(langs):
            total = r.text[k]
            for c in ("declared", "suggested"):
                total += math.log((by[c][r[c]][k] + li.TRUST * (r[c] == lang) + 0.1) / (every[k] + li.TRUST + 0.1 * len(values)))
            base = (every[k] + 1) / (sum(every) + len(langs))
            domain = (max(0, d[k] - p[k]) + li.SMOOTH * base) / (max(0, sum(d) - 1) + li.SMOOTH)
            score.append(total + math.log((max(0, m[k] - p[k]) + li.SMOOTH * domain) / (max(0, sum(m) - 1) + li.SMOOTH)))
        best = max(range(len(langs)), key=lambda k: score[k])
        out[r.page_id] = (langs[best], round(1 / sum(math.exp(x - score[best]) for x in score), 5))
    return out


def held_out(spark):
    """Documents outside the training sample, as pages; a tenth declares a wrong language."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null and length(text) > 0")
    train, test = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    wrong = F.when(F.col("doc_id") % 20 == 1, F.when(F.col("lang") == "en", "fr").otherwise("en")).otherwise(F.col("lang"))
    html = F.concat(F.lit("<html lang='"), wrong, F.lit("'><p>"), F.col("text"), F.lit("</p>"))
    pages = test.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h"), F.col("doc_id") % 7, F.lit(".org/")).alias("url"), html.alias("html"))
    return train, pages, {r.doc_id: r.lang for r in test.collect()}


def test_fusion_against_brute_force(spark):
    train, pages, _ = held_out(spark)
    pages = pages.where("page_id % 3 = 1")
    model = li.fit(train)
    want = brute(li.evidence(pages, model).collect(), model.langs)
    got = {r.page_id: (r.lang, round(r.confidence, 5)) for r in li.identify(pages, train).collect()}
    assert got.keys() == want.keys() and all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-5 for i in want)


def test_held_out_documents(spark):
    train, pages, lang = held_out(spark)
    got = {r.page_id: r.lang for r in li.identify(pages, train).collect()}
    assert sum(got[i] == lang[i] for i in got) >= 0.98 * len(got)
    wrong = [i for i in got if i % 20 == 1]
    assert sum(got[i] == lang[i] for i in wrong) >= 0.9 * len(wrong), "texts outweigh a wrong declaration"
    assert li.fit(train).weight in li.WEIGHTS


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t * 3 + str(i), k) for i, (t, k) in enumerate([("the house and garden ", "en"), ("das haus und der garten ", "de")] * 9)],
                                 "doc_id long, text string, lang string")
    rows = [(1, "http://a.de/", "<p>" + "the house and garden " * 20_000), (2, None, None), (2, None, None), (3, "x", ""), (None, "http://a.de/", "<html lang=de>")]
    pages = spark.createDataFrame([(*r, "h", "t", 1) for r in rows], PAGES)
    got = li.identify(pages, docs).collect()
    assert len(got) == 5 and {r.lang for r in got} <= {"en", "de"} and next(r for r in got if r.page_id == 1).lang == "en"
    assert li.identify(pages.limit(0), docs).count() == 0
    none = li.identify(pages, docs.where("false")).collect()
    assert len(none) == 5 and all(r.lang is None for r in none)
