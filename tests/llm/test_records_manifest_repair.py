"""Operators 11 to 13 against the library, brute force and damaged files."""

import glob
import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from logweave.llm import conversation_repair, merkle, token_records
from logweave.llm.queries import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, g string, pos long, start long, part int"
LONG = " ".join(f"w{i}é" for i in range(30_000))
TEXTS = [(3, "a  b\tc", "en"), (1, "A b c", "en"), (2, None, None), (4, "", "é"), (5, LONG, "en"), (5, LONG, "en"), (None, "x<|endoftext|> y", "en"),
         (None, None, "fr"), (8, "x" * 50_000, "en"), (9, "a\x1c. \x1f!  \n b c d  ", ""), (-7, "\n\n", "en"), (10, "it's  'S", "z")]


def documents(spark, texts):
    """Documents with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}" if i != 4 else None, len(t or ""), "x", 1, 2, 3) for i, t, lang in texts], DOCS)


# -- 11 -------------------------------------------------------------------------------
def encoded(texts, end_id=2):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return [[*e.ids, end_id] for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_records_equal_the_library(spark):
    got = [tuple(r) for r in token_records.round_trip(documents(spark, TEXTS), tokenizer_path("byte_bpe_50k.json")).orderBy("start").collect()]
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for (doc_id, text, _), ids in zip(order, encoded([t for _, t, _ in order]), strict=True):
        want.setdefault(doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[0] for r in got] == [r[0] for r in order]
    start = 0
    for doc_id, at, n, crc in got:
        assert at == start and (n, crc) in want[doc_id]
        want[doc_id].remove((n, crc))
        start += n
    assert token_records.round_trip(documents(spark, []), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_records_in_small_files_shuffled_and_damaged(spark, tmp_path):
    docs = spark.range(500).selectExpr("id * 3 as doc_id", "concat_ws(' ', array_repeat(concat('word', id % 7), cast(id % 40 as int))) as text")
    path = str(tmp_path / "set")
    token_records.write(docs, path, tokenizer_path("byte_bpe_50k.json"), file_bytes=1000)
    files = sorted(glob.glob(f"{path}/records/*.rec"))
    assert len(files) > 20
    rows = {r.doc_id: (r.start, list(r.ids)) for r in token_records.read(spark, path).collect()}
    mixed = [(r.doc_id, r.start, list(r.ids)) for r in token_records.read(spark, path, seed=5).collect()]
    assert {d: (s, i) for d, s, i in mixed} == rows and len(mixed) == 500
    again, other = ([r.doc_id for r in token_records.read(spark, path, seed=s).collect()] for s in (5, 6))
    assert again == [m[0] for m in mixed] != other and again != sorted(again)
    assert rows[9][1] == encoded(["word3 word3 word3"])[0][:-1] and rows[0] == (0, [])
    # a file of a lost attempt is not read; a changed byte is found
    with open(f"{path}/records/part-000000-0000-lost.rec", "wb") as f:
        f.write(token_records.frame(b"stray"))
    assert token_records.read(spark, path).count() == 500
    data = bytearray(open(files[3], "rb").read())
    data[len(data) // 2] ^= 1
    with open(files[3], "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="damaged"):
        token_records.read(spark, path).collect()


def test_frame():
    payload = b"123456789"
    data = token_records.frame(payload)
    assert bytes(token_records.unframe(memoryview(data))) == payload and len(data) == 25
    assert zlib.crc32(payload) == 0xCBF43926  # check value of CRC-32
    assert token_records.masked(payload) == (((0xCBF43926 >> 15) | (0xCBF43926 << 17)) + token_records.MASK) % 2**32
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 64
        with pytest.raises(ValueError):
            token_records.unframe(memoryview(bytes(broken)))


# -- 12 -------------------------------------------------------------------------------
def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i:i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def way(tree, i):
    out = []
    for level in tree[:-1]:
        a = i // 8 * 8
        run = level[a:a + 8]
        out.append((run[:i - a], run[i - a + 1:]))
        i //= 8
    return out


def brute_manifest(rows):
    def leaf(*values):
        return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        h = other = leaf(doc_id, source, lang, n_chars, text)
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            other = leaf(doc_id, source, lang, n_chars, re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups[lang].append((doc_id is not None, doc_id or 0, h, other, doc_id))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([r[2] for r in sorted(groups[x])]) for x in langs}
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, _, h, other, doc_id) in enumerate(sorted(groups[x], key=lambda r: r[:3])):
            path = way(trees[x], i) + way(top, k)
            for left, right in path:
                other = digest(*left, other, *right)
            out.append((doc_id, h, trees[x][-1][0], top[-1][0], digest(*(s for p in path for q in p for s in q)), other, other == top[-1][0]))
    return sorted(out, key=str)


def manifest(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)


def fields(docs):
    return [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]


@pytest.mark.parametrize("n", [0, 1, 8, 9, 65, 513, 4100])
def test_manifest_of_one_language(spark, n):
    docs = spark.range(n).selectExpr("id * 7 as doc_id", "'en' as lang", "'s' as source", "id as n_chars", "concat('Text ', id) as text")
    assert manifest(docs) == (brute_manifest(fields(docs)) if n else [])


def test_manifest_of_odd_rows_and_many_languages(spark):
    docs = documents(spark, TEXTS + [(100 + i, f"T{i}", f"l{i % 23}") for i in range(200)])
    got = manifest(docs)
    assert got == brute_manifest(fields(docs)) and {r[6] for r in got} == {True, False}


def test_manifest_sql(spark):
    docs = documents(spark, TEXTS + [(100 + i, f"T{i}", "en") for i in range(100)])
    with duckdb.connect() as db:
        db.register("documents", docs.toArrow())
        got = sorted(db.sql(merkle.oracle_sql()).fetchall(), key=str)
    assert got == manifest(docs)


# -- 13 -------------------------------------------------------------------------------
def brute_repair(rows):
    """Forward search over (rows, last initial) that keeps the least (cost, audit)."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return sorted((brute_conversation(conv, rows) for conv, rows in convs.items()), key=str)


def brute_conversation(conv, rows):
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in rows if r[0] is not None]
    seen, faults = set(), []
    for _, role, text in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", ())}

    def put(to, state, option):
        if state not in to or option[:2] < to[state][:2]:
            to[state] = option

    def insertions():
        for _ in range(4):
            for state, (cost, audit, said) in list(best.items()):
                new = "a" if state == "u" else "u"
                put(best, new, (cost + 3, audit + "I", (*said, (new, None, ""))))

    for (_, role, text), fault in zip(rows, faults, strict=True):
        insertions()
        after = {}
        for state, (cost, audit, said) in best.items():
            put(after, state, (cost + 4, audit + "D", said))
            if fault in ("b", "d"):
                continue
            more, new, first = 3 * (fault == "t"), "a" if state == "u" else "u", role[:1]
            put(after, new, (cost + 3 + more, audit + "R", (*said, (new, None, text))))
            if (first, state) in (("s", ""), ("a", "u")) or (first == "u" and state != "u"):
                put(after, first, (cost + more, audit + "K", (*said, (first, role, text))))
        best = after
    insertions()
    cost, audit, said = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    text = "\n".join(f"{role or {'u': 'user', 'a': 'assistant'}[s]}:{t}" for s, role, t in said)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in "bdt"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


CONV = "conv_id long, turn long, role string, text string, m long, seg long, fault string"


def conversations(seed=1):
    rng, rows = random.Random(seed), []
    for conv in (None, *range(60)):
        for _ in range(rng.choice([1, 2, 5, 9, 30])):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]),
                         rng.choice(["Hi.", "ok", "Yes!", "", None, " \t", "a? ", "é.\n", "b. ", "c!", "x\x0b", "z" * 70_000 + "."])))
    return rows


def run_repair(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CONV)
    return sorted((tuple(r) for r in conversation_repair.repair(df).collect()), key=str)


def test_repair_against_brute_force(spark):
    rows = conversations()
    assert run_repair(spark, rows) == brute_repair(rows)
    assert run_repair(spark, []) == []


def test_repair_of_a_hot_conversation(spark):
    """One conversation over many batches, partitions and segments, with long runs of one symbol."""
    rng = random.Random(3)
    rows = [(5, i, "user" if i % 5000 < 2500 else rng.choice(["user", "assistant"]), f"t{i}" + rng.choice([".", "", "!"])) for i in range(15_000)]
    rows += [(c, i, ("user", "assistant")[i % 2], f"q{i}.") for c in range(10, 900) for i in range(4)]
    assert run_repair(spark, rows) == brute_repair(rows)


def test_runs_by_powers_equal_steps():
    rng = random.Random(4)
    symbols = [x for _ in range(200) for x in [rng.choice(["x", "s", "u", "a", "-", "ut", "at", "-t", "st"])] * rng.choice([1, 2, 7, 64])]
    v = conversation_repair.END
    for s in reversed(symbols):
        v = conversation_repair.apply(conversation_repair.power(s, 0), v)
    assert conversation_repair.apply(conversation_repair.matrix(symbols), conversation_repair.END) == v


def test_repair_sql(spark):
    rows = [r for r in conversations(2) if len(r[3] or "") < 100]
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        got = sorted(db.sql(conversation_repair.oracle_sql()).fetchall(), key=str)
    assert got == brute_repair(rows)
