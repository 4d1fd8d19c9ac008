"""Retrieval against brute force, streams against the batch operators."""

import numpy as np
import pytest

from passages.operators import annotations as A
from passages.operators import profiles as P
from passages.operators import retrieve as R
from passages.sources import tables as S
from passages.streaming import streams as K


def unit(rnd, n, dim=8):
    v = rnd.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def index(spark):
    rnd = np.random.default_rng(0)
    v = unit(rnd, 120)
    v[7] = v[3]
    rows = [(i, i % 6 - 1, float(rnd.random()), [float(x) for x in v[i]]) for i in range(120)]
    return v, rows, spark.createDataFrame(rows, "item long, primary int, p double, vector array<double>").repartition(5)


@pytest.fixture(scope="module")
def queries(spark):
    q = unit(np.random.default_rng(1), 9)
    return q, spark.createDataFrame([(i, [float(x) for x in q[i]]) for i in range(9)], "query long, vector array<double>")


@pytest.mark.parametrize("slice_rows", [2, 4096])
def test_topk_is_exact(index, queries, slice_rows):
    v, _, items = index
    q, asked = queries
    got = R.topk_cosine(asked, items, 5, slice_rows=slice_rows).collect()
    sims = np.round(q @ v.T, 10)
    for i in range(9):
        want = sorted(range(120), key=lambda j: (-sims[i, j], j))[:5]
        assert [r["item"] for r in sorted((r for r in got if r["query"] == i), key=lambda r: r["rank"])] == want


def test_topk_per_group_with_weight(index, queries):
    v, rows, items = index
    q, asked = queries
    got = {}
    for r in R.topk_cosine(asked, items, 3, group="primary", weight="p").collect():
        got.setdefault((r["query"], r["primary"]), {})[r["rank"]] = r["item"]
    for i in range(9):
        for g in range(-1, 5):
            own = [r for r in rows if r[1] == g]
            want = sorted(own, key=lambda r: (-round(float(round(q[i] @ v[r[0]], 10)) * r[2], 10), r[0]))[:3]
            assert [got[i, g][k] for k in (1, 2, 3)] == [r[0] for r in want]


@pytest.mark.parametrize(("slice_rows", "weight"), [(3, "p"), (4096, "p"), (4096, None)])
def test_labels_first_gives_the_wanted_rows_of_the_search_by_group(spark, index, queries, slice_rows, weight):
    _, _, items = index
    _, asked = queries
    wanted = spark.createDataFrame([(i, j % 7 - 1) for i in range(9) for j in (i, i + 2, i + 2)], "query long, label int")
    got = R.topk_of_labels(asked, items, wanted, 3, weight, slice_rows=slice_rows)
    every = R.topk_cosine(asked, items, 3, group="primary", weight=weight).withColumnRenamed("primary", "label")
    want = every.join(wanted.distinct(), ["query", "label"])
    columns = ["query", "label", "item", "rank", "score"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert R.topk_of_labels(asked, items, wanted.limit(0), 3).count() == 0


@pytest.mark.parametrize("slice_rows", [2, 100])
def test_vector_match_in_slices(spark, index, slice_rows):
    v, _, items = index
    e = unit(np.random.default_rng(2), 10)
    entries = spark.createDataFrame([(i // 2, [float(x) for x in e[i]]) for i in range(10)], "label int, vector array<double>")
    got = {}
    for r in R.vector_match(items, entries, 0.1, 2, slice_rows=slice_rows).collect():
        got.setdefault(r["item"], {})[r["rank"]] = r["label"]
    best = np.round((v @ e.T).reshape(120, 5, 2).max(axis=2), 10)
    for i in range(120):
        want = [j for j in sorted(range(5), key=lambda j: (-best[i, j], j))[:2] if best[i, j] >= 0.1]
        assert [got.get(i, {})[k + 1] for k in range(len(want))] == want


@pytest.mark.parametrize("block", [4, 1000])
def test_meaning_scores_leave_the_own_sequence_out(spark, block):
    rnd = np.random.default_rng(3)
    v = unit(rnd, 30)
    anchors = [[int(rnd.integers(3))] if rnd.random() < 0.4 else [] for _ in range(30)]
    rows = [(i // 10, i % 10, anchors[i], [float(x) for x in v[i]]) for i in range(30)]
    items = spark.createDataFrame(rows, "seq long, pos long, anchors array<int>, vector array<double>")
    t, fb = unit(rnd, 3), unit(rnd, 3)
    texts = spark.createDataFrame([(k, t[k].tolist(), fb[k].tolist()) for k in range(3)], "label int, text_vector array<double>, fallback array<double>")
    got = P.meaning_scores(items, P.profile_sums(items), texts, block_rows=block).collect()
    for r in got:
        total, n = np.zeros((3, 8)), np.zeros(3)
        for i in range(30):
            if i // 10 != r["seq"]:
                for k in anchors[i]:
                    for j in range(i, min(i + 3, (i // 10 + 1) * 10)):
                        total[k] += v[j]
                        n[k] += 1
        base = np.where((n > 0)[:, None], total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-30), fb)
        mu = 0.5 * base + 0.5 * t
        mu /= np.linalg.norm(mu, axis=1, keepdims=True)
        assert np.allclose(r["cos"], mu @ v[r["seq"] * 10 + r["pos"]])


def test_zero_spread_gives_zero(spark):
    df = spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0)], "query int, label int, a double")
    assert [r["combined"] for r in R.z_fusion(df, ["a"]).collect()] == [0.0, 0.0]


def test_late_rows_are_dropped_and_counted(spark):
    source, out, state = (S.scratch(spark, n) for n in ("src", "out", "state"))
    schema = "seq long, `order` long, unit long, anchors array<int>"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        K.run_to_folder(K.stream_carry(stream, max_gap=2), out, state)

    feed([(1, 2, 12, []), (1, 0, 10, [5]), (1, 1, 11, []), (2, 0, 20, [])])
    feed([(1, 1, 99, [7]), (1, 3, 13, []), (1, 4, 14, [6]), (2, 1, 21, [3])])
    got = {r["unit"]: (list(r["held"]), r["dropped"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        10: ([5], 0), 11: ([5], 0), 12: ([5], 0), 13: ([], 1), 14: ([6], 1), 20: ([], 0), 21: ([3], 0),
    }


def test_streamed_carry_over_triggers_is_the_batch_carry(spark):
    from passages.operators import sequence as Q

    rnd = np.random.default_rng(8)
    schema = "seq long, order long, unit long, anchors array<int>, gate array<int>"
    pick = lambda n: [int(v) for v in rnd.permutation(6)[:n]]
    rows = [(i % 3, i, i, pick(2) if rnd.random() < 0.3 else [], pick(4)) for i in range(60)]
    whole = spark.createDataFrame([(s, i // 3, *r) for s, i, *r in rows], schema.replace("order", "pos"))
    for options in ({"max_gap": 2}, {"resume": False}, {"monotonic": True, "resume": False, "max_gap": 3}):
        source, out, state = (S.scratch(spark, n) for n in ("src", "out", "state"))
        for part in (rows[:25], rows[25:31], rows[31:]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        K.run_to_folder(K.stream_carry(stream, **options), out, state)
        want = Q.carry(whole, gate="gate", **{"resume": True, **options})
        got = spark.read.parquet(out)
        assert got.select("batch").distinct().count() == 3
        assert sorted((r["unit"], list(r["held"])) for r in got.collect()) == sorted((r["unit"], list(r["held"])) for r in want.collect())


def test_late_rows_are_counted_without_others(spark):
    source, out, state = (S.scratch(spark, n) for n in ("src", "out", "state"))
    schema = "seq long, order long, unit long, anchors array<int>"
    for rows in ([(1, 5, 1, [2])], [(1, 3, 2, [4])]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        K.run_to_folder(K.stream_carry(spark.readStream.schema(schema).parquet(source)), out, state)
    assert sorted((r["unit"] or 0, r["dropped"]) for r in spark.read.parquet(out).collect()) == [(0, 1), (1, 0)]


def test_streamed_log_equals_the_batch_view(spark):
    source, out, state = (S.scratch(spark, n) for n in ("src", "out", "state"))
    rnd = np.random.default_rng(5)
    labels = ["L1", "L2", "NONE", "RESET"]
    rows = [
        (int(rnd.integers(6)), "ab"[rnd.integers(2)], labels[rnd.integers(4)], f"T{rnd.integers(1, 6)}", int(rnd.integers(20)), i)
        for i in range(120)
    ]
    schema = "item long, annotator string, label string, tier string, created_at long, row_no long"
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        K.stream_latest_view(spark.readStream.schema(schema).parquet(source), out, state)
    want = A.latest_view(A.after_reset(spark.createDataFrame(rows, schema)))
    columns = want.columns
    assert sorted(map(tuple, K.latest_view_of(spark, out).select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_upsert_and_incremental(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, version int")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (1, "x", 0)], "id int, v string, version int")
    assert sorted((r["id"], r["v"]) for r in S.upsert(old, new, ["id"], "version").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["id"] for r in S.incremental(new, old, ["id"]).collect()] == [3]
    assert S.completeness(new, old, ["id"]).first()["ok"] is False
