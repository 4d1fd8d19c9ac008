"""Decoders against plain dynamic programmes, for whole and for cut sequences."""

import itertools

import numpy as np
import pytest

from passages.operators import decode as D
from passages.operators.scan import ordinal

N = 4


def model(seed):
    rnd = np.random.default_rng(seed)
    a = rnd.random((N + 1, N + 1)) + 0.1
    return np.log(a / a.sum(1, keepdims=True))


def items(spark, lengths, seed):
    rnd = np.random.default_rng(seed)
    rows = []
    for s, n in enumerate(lengths):
        for p in range(n):
            rows.append((s, p, [float(x) for x in np.log(rnd.random(N + 1) + 0.01)], [int(rnd.integers(N))] if rnd.random() < 0.3 else []))
    return rows, spark.createDataFrame(rows, "seq long, pos long, emit array<double>, anchors array<int>")


def best_path(emit, steps, start):
    best, path = -np.inf, None
    for p in itertools.product(range(len(start)), repeat=len(emit)):
        score = start[p[0]] + emit[0][p[0]] + sum(steps[t][p[t - 1], p[t]] + emit[t][p[t]] for t in range(1, len(emit)))
        if score > best:
            best, path = score, p
    return list(path)


def paths(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["seq"], r["pos"])):
        out.setdefault(r["seq"], []).append(r["state"])
    return out


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_viterbi_finds_the_best_path(spark, block):
    a = model(0)
    rows, df = items(spark, [1, 4, 6], 1)
    got = paths(D.viterbi(df, D.Model.plain(a), gamma=0.7, block_rows=block))
    for s in range(3):
        emit = [r[2] for r in rows if r[0] == s]
        assert got[s] == best_path(emit, [0.7 * a] * len(emit), np.zeros(N + 1))


@pytest.mark.parametrize("block", [2, 1000])
def test_unanchored_steps_cost(spark, block):
    a = model(2)
    rows, df = items(spark, [6], 3)
    got = paths(D.viterbi(df, D.Model.plain(a), delta=1.5, anchors="anchors", block_rows=block))[0]
    steps = []
    for r in rows:
        m = a.copy()
        for x in range(N):
            for y in (x + 1, x + 2):
                if y < N and y not in r[3]:
                    m[x, y] -= 1.5
        steps.append(m)
    assert got == best_path([r[2] for r in rows], steps, np.zeros(N + 1))


@pytest.mark.parametrize("block", [2, 1000])
def test_resume_states(spark, block):
    rnd = np.random.default_rng(5)
    s = 2 * N + 1
    a = np.log(rnd.random((s, s)) * (rnd.random((s, s)) < 0.7) + 1e-300)
    m = D.Model.resume(a, N)
    rows, df = items(spark, [4], 6)
    got = paths(D.viterbi(df, m, block_rows=block))[0]
    emit = [np.asarray(r[2])[m.columns] for r in rows]
    assert got == [x if x < N else N for x in best_path(emit, [a] * 4, m.start)]


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_posteriors_add_up(spark, block):
    a = model(7)
    rows, df = items(spark, [5, 2], 8)
    got = D.forward_backward(df, D.Model.plain(a), block_rows=block).collect()
    for s in (0, 1):
        emit = [r[2] for r in rows if r[0] == s]
        weight = np.zeros((len(emit), N + 1))
        for p in itertools.product(range(N + 1), repeat=len(emit)):
            w = np.exp(emit[0][p[0]] + sum(a[p[t - 1], p[t]] + emit[t][p[t]] for t in range(1, len(emit))))
            for t, x in enumerate(p):
                weight[t, x] += w
        want = weight / weight.sum(1, keepdims=True)
        mine = np.array([r["posterior"] for r in sorted((r for r in got if r["seq"] == s), key=lambda r: r["pos"])])
        assert np.allclose(mine, want)


def test_long_sequences_agree_with_short_blocks(spark):
    a = model(9)
    _, df = items(spark, [300, 40, 1], 10)
    whole = paths(D.viterbi(df, D.Model.plain(a)))
    assert paths(D.viterbi(df, D.Model.plain(a), block_rows=17)) == whole


def short_items(spark, seed):
    """Sequences known to be short, with a null and a text key and columns that come along."""
    rnd = np.random.default_rng(seed)
    rows = [
        (s, lang, p, [float(x) for x in np.log(rnd.random(N + 1) + 0.01)], [int(rnd.integers(N))] if rnd.random() < 0.3 else [], float(g), f"{s}-{p}")
        for s, lang, n, g in [(1, "a", 3, 0.5), (1, None, 5, 1.0), (2, "a", 1, 0.0), (None, "b", 4, 0.5), (2, "b", 6, 1.0)]
        for p in range(n)
    ]
    df = spark.createDataFrame(rows, "seq long, lang string, p long, emit array<double>, anchors array<int>, g double, note string")
    return rows, ordinal(df, ["seq", "lang"], ["p"])


@pytest.mark.parametrize(("batch", "side"), [(4, 1), (7, 2), (20_000, 1_000)])
def test_short_sequences_are_decoded_side_by_side(spark, monkeypatch, batch, side):
    monkeypatch.setattr(D, "BATCH_ROWS", batch)
    monkeypatch.setattr(D, "SIDE_BY_SIDE", side)
    a = model(5)
    rows, df = short_items(spark, 6)
    got = D.viterbi(df, D.Model.plain(a), "g", 0.4, anchors="anchors", keys=["seq", "lang"], keep=["note"]).collect()
    assert sorted(r["note"] for r in got) == sorted(r[-1] for r in rows)
    smooth = D.forward_backward(df, D.Model.plain(a), keys=["seq", "lang"], keep=["note"]).collect()
    for key in {(r[0], r[1]) for r in rows}:
        own = [r for r in rows if (r[0], r[1]) == key]
        emit = [np.array(r[3]) for r in own]
        steps = [D._steps(a, r[5], 0.4, [r[4]], N)(0) for r in own]
        found = [r["state"] for r in sorted(got, key=lambda r: r["pos"]) if (r["seq"], r["lang"]) == key]
        assert found == best_path(emit, steps, np.zeros(N + 1))
        weights = {}
        for p in itertools.product(range(N + 1), repeat=len(own)):
            weights[p] = np.exp(emit[0][p[0]] + sum(a[p[t - 1], p[t]] + emit[t][p[t]] for t in range(1, len(own))))
        total = sum(weights.values())
        for r in smooth:
            if (r["seq"], r["lang"]) == key:
                want = [sum(w for p, w in weights.items() if p[r["pos"]] == s) / total for s in range(N + 1)]
                assert r["posterior"] == pytest.approx(want)


def test_scores_far_apart_are_added_by_their_logs():
    x, step = np.array([[0.0, -900.0], [-1.0, -2.0]]), np.array([[-np.inf, 0.0], [0.0, -np.inf]])
    got = D._folded(x, step, np.exp(step), D.LOWEST)
    assert got == pytest.approx(np.array([[-900.0, 0.0], [-2.0, -1.0]]))


@pytest.mark.parametrize("low", [-4.0, -500.0, -np.inf])
def test_sums_of_a_pack_are_those_of_its_posteriors(low):
    rng = np.random.default_rng(2)
    sizes, log_a = np.array([7, 4, 4, 1]), np.log(rng.dirichlet(np.ones(3), 3))
    log_a[0, 1] = low
    kinds = np.array([[0, 1, 3], [1, 2, 3], [2, 2, 4]], np.uint8)
    scores = rng.normal(size=(5, 3))
    scores[2, 1] = max(low, -900.0)
    codes = rng.integers(0, 3, sizes.sum())
    first, last = np.cumsum(sizes) - sizes, sizes.max()
    rows = np.concatenate([first[sizes > t] + t for t in range(last)])
    start = np.full(3, -np.log(3))
    got = D._expected(sizes, codes[rows].astype(np.int32), kinds, scores, log_a, start)
    want = np.zeros(5)
    for a, n in zip(first, sizes, strict=True):
        of = kinds[codes[a : a + n]]
        g = D._smoothed(np.array([n]), scores[of, np.arange(3)], log_a, start)
        np.add.at(want, of, g)
    assert got == pytest.approx(want) and got.sum() == pytest.approx(sizes.sum())
