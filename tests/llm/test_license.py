"""Operator 10: whole notices, changed words, odd rows; the SQL finds the same."""

import duckdb

from logweave.llm import license_scan as ls

SCHEMA = "doc_id long, text string, words string, band int, width int"


def found(spark, rows, templates=None):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    return {(r.doc_id, r.license): (r.containment, r.first_word) for r in ls.scan(docs, templates).collect()}


def test_every_notice_is_found_whole_and_with_a_changed_word(spark):
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = []
    for k, (name, text) in enumerate(ls.TEMPLATES.items()):
        words = text.split()
        rows.append((10 * k, f"{filler} {text} {filler}"))
        rows.append((10 * k + 1, text.upper()))
        if len(ls.template_shingles(text)) >= 24:
            words[len(words) // 2] = "changed"
            rows.append((10 * k + 2, filler + " " + " ".join(words)))
    got = found(spark, rows)
    for k, (name, text) in enumerate(ls.TEMPLATES.items()):
        assert got[10 * k, name][0] == 1.0 and got[10 * k + 1, name] == (1.0, 0)
        if len(ls.template_shingles(text)) >= 24:
            assert 0.75 <= got[10 * k + 2, name][0] < 1.0


def test_odd_rows_and_sql(spark):
    mit = ls.TEMPLATES["mit-text"]
    rows = [(1, None), (2, ""), (3, "license"), (4, mit), (4, mit), (None, mit), (5, ("long text " * 40_000) + mit), (6, f"{mit} {mit}"), (7, "software " * 500)]
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)
    got = sorted(str(tuple(r)) for r in ls.scan(docs).collect())
    assert sum("'mit-text'" in r for r in got) == 5
    docs = docs.where("doc_id is null or doc_id <> 5")  # the SQL copies a text's words for each of them
    got = sorted(str(tuple(r)) for r in ls.scan(docs).collect())
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        assert got == sorted(map(str, db.sql(ls.oracle_sql()).fetchall()))
    assert found(spark, rows, {}) == {} and found(spark, []) == {}
