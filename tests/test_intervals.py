"""The interval join against all pairs, times and cues against plain code."""

import random

import pytest
from pyspark.sql import functions as F

from passages.operators import chunk as C
from passages.operators import match as M
from passages.operators.intervals import interval_join


def test_pairs_are_those_of_a_loop(spark):
    draw = random.Random(1)
    points = [(draw.choice("ab"), i, draw.randint(-50, 3000)) for i in range(300)] + [(None, 900, 5), ("a", 901, None)]
    spans = [(draw.choice("abc"), i, a, a + draw.choice([0, 1, 2, 7, 64, 65, 900, 3000])) for i in range(120) for a in [draw.randint(-60, 2500)]]
    spans += [("a", 901, 5, 3), (None, 902, 0, 10), ("b", 903, None, 4)]
    p = spark.createDataFrame(points, "k string, p_id int, at long")
    s = spark.createDataFrame(spans, "k string, s_id int, a long, b long")
    got = sorted((r["p_id"], r["s_id"]) for r in interval_join(p, s, ["k"], "at", "a", "b").collect())
    want = [(i, j) for k, i, x in points for m, j, a, b in spans if k and k == m and None not in (x, a, b) and a <= x < b]
    assert got == sorted(want) and len(want) > 1000
    assert interval_join(p, s.limit(0), ["k"], "at", "a", "b").count() == 0


def test_no_nested_loop_in_the_plan(spark):
    p, s = spark.range(10).selectExpr("id as k", "id as at"), spark.range(10).selectExpr("id as k", "id as a", "id + 3 as b")
    plan = interval_join(p, s, ["k"], "at", "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("block_rows", [100_000, 3])
def test_times_letter_by_letter(spark, block_rows):
    draw = random.Random(2)
    segments = [(d, i, "x" * draw.choice([0, 1, 5, 40]), 10.0 * i, 10.0 * i + draw.choice([4.0, 10.0])) for d in range(4) for i in range(draw.randint(1, 12))]
    points = [(d, x) for d in range(5) for x in range(0, 200, 7)] + [(0, 0)]
    got = C.pos_to_time(
        spark.createDataFrame(points, "doc_id int, point int"), spark.createDataFrame(segments, "doc_id int, pos long, text string, start double, end double"), block_rows=block_rows
    ).collect()
    assert len(got) == len(points)
    for r in got:
        own = [s for s in segments if s[0] == r["doc_id"]]
        at, want = 0, own[-1][4] if own else 0.0
        for _, _, text, a, b in own:
            if at <= r["point"] < at + len(text):
                want = a + (r["point"] - at) / len(text) * (b - a)
            at += len(text) + 1
        assert r["seconds"] == pytest.approx(want)


def test_cues_of_hits_as_tables_and_as_arrays(spark):
    draw = random.Random(3)
    kinds = ["intro_marker", "closing_marker", "shloka_marker"]
    rows = []
    for d in range(12):
        places = sorted(draw.sample(range(6000), draw.randint(0, 25)))
        rows.append((d, [(x, d) for x in sorted(draw.sample(range(6000), 6))], [(p, p + 1, draw.choice(kinds)) for p in places]))
    df = spark.createDataFrame(rows, "doc_id int, hits array<struct<start:int,label:int>>, cues array<struct<pos:int,end:int,type:string>>")
    want = df.select("doc_id", F.inline(M.near_cues())).select("doc_id", "start", "cues", "section")
    hits = df.select("doc_id", F.inline("hits")).select("doc_id", "start")
    cues = df.select("doc_id", F.inline("cues"))
    assert sorted(map(tuple, M.hits_near_cues(hits, cues, ["doc_id"]).collect())) == sorted(map(tuple, want.collect()))
