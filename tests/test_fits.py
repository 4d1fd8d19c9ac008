"""Many fits in one go against one fit at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.operators import fits
from passages.operators import learn as L
from passages.operators.fits import Fit, fit_many

X = ["u", "v", "k"]


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(3)
    n = 400
    u, v = draw.normal(5, 2, n), draw.normal(-1, 0.1, n)
    y = (u + 10 * v + draw.normal(0, 2, n) > -5).astype(int)
    p = np.clip(0.2 + 0.6 * y + draw.normal(0, 0.1, n), 0.01, 0.99)
    data = [(i, int(i % 4) if i % 50 else None, float(u[i]), float(v[i]), 1.0, int(y[i]), float(p[i]), float(1 + i % 3)) for i in range(n)]
    return spark.createDataFrame(data, "unit long, g int, u double, v double, k double, y int, p double, w double").cache()


def close(a, b, names=X):
    (i, x), (j, z) = a.raw(), b.raw()
    # the constant column has no say: only its sum with the intercept does
    one = i + x.pop("k", 0.0), [x[c] for c in names if c in x]
    two = j + z.pop("k", 0.0), [z[c] for c in names if c in z]
    assert one[0] == pytest.approx(two[0], abs=1e-5) and one[1] == pytest.approx(two[1], abs=1e-6)


def test_equal_to_single_fits(rows):
    everything = frozenset(range(4))
    fits = [Fit(everything - {g}, c) for g in range(4) for c in (1e-3, 1.0, 100.0)] + [Fit(frozenset({2}), 1.0, ("u",))]
    models = fit_many(rows, X, "g", fits, "y", "w")
    for fit, model in zip(fits, models):
        train = rows.filter(F.col("g").isin(*fit.groups))
        close(model, L.fit_scorer(train, fit.columns or X, "y", fit.c, "w"))


def test_soft_labels_equal_copies_with_weights(rows):
    (model,) = fit_many(rows, ["u", "v"], "g", [Fit(frozenset(range(4)), 0.5)], "p")
    close(model, L.soft_label_fit(rows.filter("g IS NOT NULL"), ["u", "v"], "p", 0.5))


def test_left_out_scores(rows):
    got = {r["unit"]: r["p2"] for r in L.leave_one_group_out(rows, "g", ["u", "v"], name="p2").collect()}
    assert len(got) == rows.filter("g IS NOT NULL").count()
    for g in range(4):
        model = L.fit_scorer(rows.filter(F.col("g") != g), ["u", "v"])
        want = {r["unit"]: r["s"] for r in rows.filter(F.col("g") == g).select("unit", model.probability().alias("s")).collect()}
        assert {k: got[k] for k in want} == pytest.approx(want, abs=1e-6)


def test_c_of_each_fold_is_that_of_the_others(rows):
    known = rows.filter("g IS NOT NULL")
    cs = [1e-4, 1e-2, 1.0]
    out, chosen = L.nested_out_of_fold(known, ["u", "v"], "p", "g", cs)
    assert chosen == {g: L.choose_c(known.filter(F.col("g") != g), ["u", "v"], "p", "g", cs)[0] for g in range(4)}
    model = L.soft_label_fit(known.filter("g <> 1"), ["u", "v"], "p", chosen[1])
    want = {r["unit"]: r["s"] for r in known.filter("g = 1").select("unit", model.probability().alias("s")).collect()}
    assert {r["unit"]: r["oof"] for r in out.filter("g = 1").collect()} == pytest.approx(want, abs=1e-6)


def test_stacker_is_a_fit_on_the_views(rows):
    out = L.stacker(rows, {"a": ["u"], "b": ["v"]}, "p", "g", [0.1, 1.0]).cache()
    assert out.columns == [*rows.columns, "a", "b", "stacked"]
    model = L.soft_label_fit(out.filter("g <> 0"), ["a", "b"], "p")
    want = {r["unit"]: r["s"] for r in out.filter("g = 0").select("unit", model.probability().alias("s")).collect()}
    assert {r["unit"]: r["stacked"] for r in out.filter("g = 0").collect()} == pytest.approx(want, abs=1e-6)


def test_jobs_do_not_grow_with_the_fits(spark, rows):
    def jobs(n):
        spark.sparkContext.setJobGroup(f"fits{n}", "")
        fit_many(rows, ["u", "v"], "g", [Fit(frozenset(range(4)) - {g % 4}, 1.0 + g) for g in range(n)])
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fits{n}"))

    assert jobs(40) <= jobs(2) + 6
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_equal_fits_are_done_once_and_groups_meet_their_own_fits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = [(i, i % 4, float(a), float(b), float(p)) for i, (a, b, p) in enumerate(rng.random((80, 3)))]
    rows = spark.createDataFrame(data, "unit int, g int, u double, v double, p double")
    seen, sums = [], fits._sums

    def spy(members, params):
        seen.append(len(params))
        return sums(members, params)

    monkeypatch.setattr(fits, "_sums", spy)
    L.nested_out_of_fold(rows, ["u", "v"], "p", "g", [0.1, 1.0])[0].collect()
    assert seen[0] == 2 * (6 + 4)  # per C: the pairs of folds left out, whichever is the outer one, and the folds
    asked = [fits.Fit(frozenset({0, 1})), fits.Fit(frozenset({2, 3})), fits.Fit(frozenset({0, 1}))]
    one, two, again = fits.fit_many(rows, ["u", "v"], "g", asked, "p")
    alone = fits.fit_many(rows.filter("g > 1"), ["u", "v"], "g", [asked[1]], "p")[0]
    assert one == again and np.allclose(two.weight, alone.weight, atol=1e-7)


def test_a_null_leaves_no_fit_a_loss(spark):
    rows = spark.createDataFrame([(0, 0.1, 0.2), (0, None, 0.9), (1, 0.5, 0.4), (1, 0.7, 0.6)], "g int, u double, p double")
    found = fits.fit_many(rows, ["u"], "g", [fits.Fit(frozenset({0})), fits.Fit(frozenset({1}))], "p")
    assert [s.weight for s in found] == [(0.0,), (0.0,)]
