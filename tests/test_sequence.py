"""Sequence operators against their definitions, on short and on cut sequences."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from passages.operators import sequence as S
from passages.operators.scan import Running, neighbours, ordinal, running

SCHEMA = "seq long, pos long, unit long, anchors array<int>, gate array<int>, gold array<int>"


def expected(rows, max_gap=None, monotonic=False, gate=False, resume=False):
    """One sequence by definition: an item holds the labels of the last anchor that counts, unless it is too far
    away or a gate since then was closed. An anchor counts if it is not under the labels of the item before it."""
    rows = sorted(rows, key=lambda r: r[1])
    counted = {}

    def active(p):
        at = max((q for q in counted if q <= p), default=None)
        if at is None or (max_gap is not None and p - at > max_gap):
            return []
        stays = lambda v: resume or not gate or all(v in rows[q][4] for q in range(at + 1, p + 1))
        return [v for v in counted[at] if stays(v)]

    out = {}
    for p, r in enumerate(rows):
        floor = max(active(p - 1), default=None) if monotonic and p else None
        enough = [v for v in r[3] if floor is None or v >= floor]
        if enough:
            counted[p] = enough
        withheld = gate and resume and not enough
        out[r[2]] = [v for v in active(p) if not withheld or v in r[4]]
    return out


def make(n_seq, longest, seed):
    rnd = random.Random(seed)
    rows, unit = [], 0
    for s in range(n_seq):
        for p in range(rnd.randint(1, longest)):
            pick = lambda share: rnd.sample(range(6), rnd.randint(1, 2)) if rnd.random() < share else []
            rows.append((s, p, unit, pick(0.25), rnd.sample(range(6), 4), pick(0.6)))
            unit += 1
    return rows


def held(df):
    return {r["unit"]: list(r["held"]) for r in df.select("unit", "held").collect()}


OPTIONS = [
    gap | order | gate
    for gap in ({}, {"max_gap": 0}, {"max_gap": 2})
    for order in ({}, {"monotonic": True})
    for gate in ({}, {"gate": True}, {"gate": True, "resume": True})
]


@pytest.mark.parametrize("block", [4, 100_000])
@pytest.mark.parametrize("options", OPTIONS, ids=str)
def test_carry_follows_its_definition(spark, block, options):
    rows = make(5, 30, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    if block > 30:
        df = ordinal(df.withColumnRenamed("pos", "p"), ["seq"], ["p"])
    want = {}
    for s in range(5):
        want |= expected([r for r in rows if r[0] == s], **options)
    args = options | ({"gate": "gate"} if options.get("gate") else {})
    assert held(S.carry(df, block_rows=block, **args)) == want


def test_the_floor_falls_with_the_labels(spark):
    df = one(spark, {0: [5], 2: [3]}, {1: [3], 3: [3]}, n=4)
    got = held(S.carry(df, monotonic=True, gate="gate"))
    assert [got[p] for p in range(4)] == [[5], [], [3], [3]]


def one(spark, anchors, gates=None, n=8):
    rows = [(0, p, p, anchors.get(p, []), (gates or {}).get(p, [0, 1, 2, 3, 4, 5, 7]), []) for p in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_gap_expires_and_does_not_come_back(spark):
    got = held(S.carry(one(spark, {1: [3], 6: [4]}), max_gap=2))
    assert [got[p] for p in range(8)] == [[], [3], [3], [3], [], [], [4], [4]]


def test_labels_of_a_run_die_one_by_one(spark):
    df = one(spark, {0: [1, 2]}, {2: [2], 4: [1]}, n=6)
    drop, resume = held(S.carry(df, gate="gate")), held(S.carry(df, gate="gate", resume=True))
    assert [drop[p] for p in range(6)] == [[1, 2], [1, 2], [2], [2], [], []]
    assert [resume[p] for p in range(6)] == [[1, 2], [1, 2], [2], [1, 2], [1], [1, 2]]


def test_monotonic_ignores_an_earlier_label(spark):
    got = held(S.carry(one(spark, {0: [5], 1: [3], 2: [7]}, n=3), monotonic=True))
    assert [got[p] for p in range(3)] == [[5], [5], [7]]


def test_positions_of_a_hot_sequence(spark):
    rnd = random.Random(3)
    rows = [(0 if i % 3 else i, rnd.randint(0, 10**6), i) for i in range(600)]
    df = spark.createDataFrame(rows, "seq long, t long, unit long")
    got = {r["unit"]: r["pos"] for r in ordinal(df, ["seq"], ["t", "unit"], block_rows=20).collect()}
    for s in {r[0] for r in rows}:
        order = sorted((r[1], r[2]) for r in rows if r[0] == s)
        assert [got[u] for _, u in order] == list(range(len(order)))


def test_positions_by_text_and_by_shared_values(spark):
    rows = [(i % 2, f"name {i * 37 % 101:03d}", 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, name string, same long, unit long")
    for order in (["name", "unit"], ["same", "unit"]):
        short, long = (ordinal(df, ["seq"], order, block_rows=n) for n in (20, 1000))
        assert sorted(map(tuple, short.select("unit", "pos").collect())) == sorted(map(tuple, long.select("unit", "pos").collect()))


def test_position_knows_the_longest_sequence(spark):
    df = spark.createDataFrame([(0, i) for i in range(9)] + [(1, 0)], "seq long, t long")
    assert ordinal(df, ["seq"], ["t"]).schema["pos"].metadata == {"longest": 9}


def test_a_whole_table_can_be_one_sequence(spark):
    df = spark.createDataFrame([(float(i * 7 % 101), i) for i in range(101)], "v double, unit long")
    placed = ordinal(df, [], ["v"], block_rows=10)
    rows = running(placed, [], "pos", [Running("total", F.col("v"), "sum")], block_rows=10).collect()
    assert all(r["pos"] == r["v"] and r["total"] == r["v"] * (r["v"] + 1) / 2 for r in rows)


@pytest.mark.parametrize("how", ["sum", "max", "min", "last", "next"])
@pytest.mark.parametrize("strict", [False, True])
def test_running_equals_one_window(spark, how, strict):
    df = spark.createDataFrame(make(4, 25, 5), SCHEMA)
    value = F.when(F.size("anchors") > 0, F.col("unit"))
    w = Window.partitionBy("seq").orderBy("pos")
    e = 1 if strict else 0
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -e), w.rowsBetween(e, Window.unboundedFollowing)
    plain = {
        "sum": F.sum(value).over(back),
        "max": F.max(value).over(back),
        "min": F.min(value).over(back),
        "last": F.last(value, True).over(back),
        "next": F.first(value, True).over(ahead),
    }[how]
    want = {r["unit"]: r["x"] for r in df.select("unit", plain.alias("x")).collect()}
    got = running(df, ["seq"], "pos", [Running("x", value, how, strict)], block_rows=3)
    assert {r["unit"]: r["x"] for r in got.collect()} == want


def test_neighbours_cross_block_edges(spark):
    df = spark.createDataFrame(make(4, 25, 6), SCHEMA)
    cols = lambda w: {"a": F.lag("unit", 2).over(w), "m": F.avg("unit").over(w.rowsBetween(-1, 1))}
    want = df.withColumns(cols(Window.partitionBy("seq").orderBy("pos"))).select("unit", "a", "m")
    got = neighbours(df, ["seq"], "pos", cols, 2, 1, block_rows=3).select("unit", "a", "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("block", [60, 100_000])
def test_survival_and_carry_precision(spark, block):
    rows = make(4, 70, 8)
    df = spark.createDataFrame(rows, SCHEMA)
    seqs = {s: sorted(r for r in rows if r[0] == s) for s in range(4)}
    alive, right = {}, {}
    for k in S.SURVIVAL_STEPS:
        a, c = [0, 0], [0, 0]
        for us in seqs.values():
            for i, r in enumerate(us):
                if i + k >= len(us):
                    continue
                a[0] += sum(v in us[i + k][5] for v in r[5])
                a[1] += len(r[5])
                if not any(us[m][3] for m in range(i + 1, i + k + 1)):
                    c[0] += sum(v in us[i + k][5] for v in r[3])
                    c[1] += len(r[3])
        alive[k], right[k] = tuple(a), tuple(c)
    got = S.survival(df, block_rows=block).collect()
    assert {r["k"]: (r["kept"], r["total"]) for r in got} == alive
    got = S.carry_precision(df, block_rows=block).collect()
    assert {r["k"]: (r["kept"], r["total"]) for r in got} == right


@pytest.mark.parametrize("block", [3, 100_000])
def test_segments_cover_the_sequence(spark, block):
    rows = [(0, i, i, v, 0.5, 2) for i, v in enumerate(["A", "A", "OFF", "OFF", "B"])]
    df = spark.createDataFrame(rows, "seq long, pos long, unit long, primary string, p_primary double, n_words int")
    got = S.segments(df, block_rows=block).orderBy("run").collect()
    assert [(r["primary"], r["dwell"], r["first_unit"], r["last_unit"]) for r in got] == [
        ("A", 2, 0, 1), ("OFF", 2, 2, 3), ("B", 1, 4, 4),
    ]
    assert [(r["pos_start"], r["pos_end"]) for r in got] == [(0.0, 0.4), (0.4, 0.8), (0.8, 1.0)]


@pytest.mark.parametrize("block", [3, 100_000])
def test_label_runs(spark, block):
    gold = [[1], [1, 2], [2], [], [], [2]]
    df = spark.createDataFrame([(0, i, i, [], [], g) for i, g in enumerate(gold)], SCHEMA)
    got = sorted((r["label"], r["first_pos"], r["length"], r["follows"]) for r in S.label_runs(df, block_rows=block).collect())
    assert got == [(1, 0, 2, "another label"), (2, 1, 2, "empty item"), (2, 5, 1, "sequence ends")]
    stretches = S.empty_stretches(df, block_rows=block).collect()
    assert [(r["first_pos"], r["length"]) for r in stretches] == [(3, 2)]


def test_no_adaptation_keeps_the_counts(spark):
    rows = make(3, 20, 9)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("p_off", F.lit(0.3))
    counts = S.transition_counts(df.withColumn("state", S.state_of("gold", 6)), 6)
    plain = counts.first()
    for r in S.adapt_counts(df, counts, None).collect():
        assert [r[c] for c in S.STEP_BUCKETS] == [float(plain[c]) for c in S.STEP_BUCKETS]
    strong = S.adapt_counts(df, counts, 1e12).first()
    assert abs(strong["stay"] - plain["stay"]) < 1e-3
