"""Work done once: the analysis under the auto filter, the search of blocks, the lines of streamed files."""

import random
import re

from pyspark.sql import functions as F

from logweave import rules
from logweave.operators import detect, incidents
from logweave.plans import pipeline
from logweave.sources import blocks as bl
from logweave.sources.files import assemble_files
from logweave.streaming import ingest as st


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_auto_event_analyses_once(spark, files_df):
    files = files_df({1: "ERROR connection refused\nkubectl pod", 2: "", 3: "all quiet", 4: "panic: out of memory"})
    resolved = pipeline.settled(pipeline.resolve_files(files), "file_id", "text", "source")
    results = incidents.analyze_incidents(incidents.auto_analyze_payloads(resolved))
    auto, every = incidents.ai_event(results, auto=True), incidents.ai_event(results)
    assert plan(auto).count("runbook") <= plan(every).count("runbook")  # the filter doesn't repeat the router
    same = lambda df: sorted(tuple(r)[::2] for r in df.collect())
    assert same(auto) == same(every) and len(same(auto)) == 3


def test_auto_event_skips_rows_with_nothing_to_say(spark):
    results = spark.createDataFrame([(1, "s", []), (2, None, []), (3, "", ["r"]), (4, "", [])], "incident_id long, summary string, recommendations array<string>")
    assert sorted(r.incident_id for r in incidents.ai_event(results, auto=True).collect()) == [1, 3]


def test_blocks_are_searched_once(spark):
    lines = spark.range(200).selectExpr("id div 100 as file_id", "cast(id % 100 as int) as line_no", "(id % 100) * 31 as start",
                                        "rpad(if(id % 3 = 0, 'connection refused', 'nothing'), 30, 'x') as line")
    blocks = bl.file_blocks(lines, block_chars=1000, overlap=500)
    found = bl.block_findings(blocks, bl.block_sources(blocks))
    assert plan(found).count("MapInArrow") <= 1
    whole = pipeline.pipeline_findings(lines.groupBy("file_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text")))
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.select(*found.columns).collect())) and found.count() > 5


def test_first_character_test_keeps_every_match(spark):
    patterns = [r.pattern for r in rules.DETECTION_RULES] + [p for _, p in rules.SOURCE_RULES]
    assert sum(rules.first_tested(p) != p for p in patterns) == len(patterns)
    for p in ("a?b|c", "(x|y)z", "^a|b", "a*|b", "a{0}b", "[ab]c", r"\bx", "", ".a"):
        assert rules.first_tested(p) == p
    assert rules.alternatives(r"a\|b|[|(]c|(d|e)f") == [r"a\|b", "[|(]c", "(d|e)f"]
    rng = random.Random(3)
    words = [w for p in patterns for w in re.split(r"[|()]", re.sub(r"\\d\+?|\\d\{\d,?\}", "77", p).replace("\\", ""))] + ["\t", "\n", " ", "É", "ſ", "K", "500 ", '" ']
    texts = ["".join(rng.choice([str.upper, str.lower, str])(rng.choice(words)) for _ in range(30)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    cols = []
    for i, p in enumerate(patterns):
        cols += [F.count_if(F.regexp_count("t", F.lit(rules.ci(p))) != F.regexp_count("t", F.lit(rules.ci(rules.first_tested(p))))).alias(f"a{i}"),
                 F.count_if(F.col("t").rlike(rules.ci(p))).alias(f"n{i}")]
    for i, (_, ps) in enumerate(rules.PARSER_PATTERNS):
        cols.append(F.count_if(F.col("t").rlike(rules.ci(detect.any_pattern(ps))) != F.col("t").rlike(rules.ci(detect.any_tested(ps)))).alias(f"a_{i}"))
    r = df.agg(*cols).first().asDict()
    assert all(v == 0 for k, v in r.items() if k[0] == "a")
    assert sum(v > 0 for k, v in r.items() if k[0] == "n") > 20


def test_newest_files_in_one_shuffle(spark):
    rows = [(1, 0, "a", 0), (1, 0, "b", 2), (1, 0, "c", 1), (1, 1, None, 3), (1, 1, "gone", 2), (1, 2, "z", 0), (1, 2, "z", 0),
            (1, None, "n", 0), (1, None, "m", 1), (2, 5, "only", 4), (None, 1, "x", 1), (None, 1, "y", 2), (3, 0, None, 0)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "file_id long, line_no int, line string, batch_id long, bucket int").repartition(3)
    got = st.newest_files(df)
    want = assemble_files(st.newest_lines(df)).select("file_id", "text")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert plan(got).count("Aggregate") == 1
