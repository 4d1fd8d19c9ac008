"""Many logistic fits in the same passes over the data.

A fit is a set of groups, a penalty and a choice of columns. Every Newton step of all fits is one aggregation: a task adds up loss,
gradient and curvature of each fit over its own groups' rows as matrix products, Spark adds the tasks' sums, and the driver
solves the small systems. Jobs grow with the steps (about eight), not with folds times values times draws.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.session import checkpoint_dir

CHUNK = 4096
STEPS = 60
TOLERANCE = 1e-9


@dataclass(frozen=True)
class Scorer:
    """Logistic regression on standardised columns; applied as one SQL expression."""

    columns: tuple[str, ...]
    mean: tuple[float, ...]
    std: tuple[float, ...]
    weight: tuple[float, ...]
    intercept: float

    def logit(self) -> Column:
        out = F.lit(self.intercept)
        for c, m, s, w in zip(self.columns, self.mean, self.std, self.weight, strict=True):
            out = out + (F.col(c) - m) / s * w
        return out

    def probability(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))

    def raw(self) -> tuple[float, dict[str, float]]:
        """Intercept and weights for the columns as they are."""
        weights = {c: w / s for c, s, w in zip(self.columns, self.std, self.weight, strict=True)}
        return self.intercept - sum(weights[c] * m for c, m in zip(self.columns, self.mean, strict=True)), weights


@dataclass(frozen=True)
class Fit:
    """What one fit sees: the groups its rows are of, C, and its columns (all if None)."""

    groups: frozenset
    c: float = 1.0
    columns: tuple[str, ...] | None = None


def _sums(members: np.ndarray, params: np.ndarray) -> Callable:
    """Sums of (group, x, y, w) batches per fit: loss, gradient, upper half of the curvature, in one row of numbers each.

    The rows of a group meet only the fits it belongs to. A null anywhere leaves every fit without a loss."""
    d = params.shape[1]
    i, j = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(params), 1 + d + len(i)))
        for batch in batches:
            group = np.asarray(batch.column("group"))
            y, w = np.asarray(batch.column("y")), np.asarray(batch.column("w"))
            x = np.asarray(batch.column("x").flatten()).reshape(len(group), d - 1) if len(group) else np.zeros((0, d - 1))
            if not all(np.isfinite(v).all() for v in (x, y, w)):
                total[:, 0] = np.nan
                continue
            order = np.argsort(group, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
                fits = np.flatnonzero(members[:, group[own[0]]]) if len(own) else []
                for a in range(0, len(own) if len(fits) else 0, CHUNK):
                    part = own[a : a + CHUNK]
                    rows, weight = np.c_[np.ones(len(part)), x[part]], w[part]
                    z = rows @ params[fits].T
                    small = np.exp(-np.abs(z))
                    p = np.where(z >= 0, 1.0, small) / (1 + small)
                    total[fits, 0] += weight @ (np.maximum(z, 0) + np.log1p(small) - y[part, None] * z)
                    total[fits, 1 : 1 + d] += (weight[:, None] * (p - y[part, None])).T @ rows
                    total[fits, 1 + d :] += (weight[:, None] * p * (1 - p)).T @ (rows[:, i] * rows[:, j])
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total.ravel())], ["fit", "at", "v"])

    return run


def fit_many(rows: DataFrame, columns: Sequence[str], group: str, fits: Sequence[Fit], y: str = "y", weight: str | None = None) -> list[Scorer]:
    """One scorer per fit: columns standardised over the fit's rows (population deviation), penalty 1 / C on the weights.

    ``y`` may be a probability: a row then stands for a positive with weight y and a negative with weight 1 - y. Rows whose group
    no fit has, a null one too, are left out. Equal fits are one fit."""
    asked, fits = fits, list(dict.fromkeys(fits))
    columns, d = list(columns), len(columns) + 1
    names = sorted(set().union(*(f.groups for f in fits)))
    place = F.create_map(*[F.lit(v) for i, g in enumerate(names) for v in (g, i)])
    value = [F.col(c).cast("double") for c in columns]
    coded = rows.withColumn("__group", F.try_element_at(place, F.col(group))).filter("__group IS NOT NULL")
    stats = coded.groupBy("__group").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(v) for v in value]).alias("mean"), F.array(*[F.var_pop(v) for v in value]).alias("var")
    ).collect()
    n, mean, var = np.zeros(len(names)), np.zeros((len(names), d - 1)), np.zeros((len(names), d - 1))
    for r in stats:
        n[r["__group"]], mean[r["__group"]], var[r["__group"]] = r["n"], r["mean"], r["var"]

    def moments(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = (n * own / max(1.0, (n * own).sum()))[:, None]
        m = (share * mean).sum(0)
        s = np.sqrt((share * (var + (mean - m) ** 2)).sum(0))
        return m, np.where(s > 0, s, 1.0)

    members = np.array([[g in f.groups for g in names] for f in fits], float)
    centre, scale = moments(np.ones(len(names)))
    x = F.array(*[(v - float(m)) / float(s) for v, m, s in zip(value, centre, scale)])
    checkpoint_dir(rows.sparkSession)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    table = coded.select(F.col("__group").cast("int").alias("group"), x.alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")).checkpoint()

    own = [moments(m) for m in members]
    used = np.array([[True] + [f.columns is None or c in f.columns for c in columns] for f in fits])
    # from a fit's standardised columns to the ones of the table
    change = np.zeros((len(fits), d, d))
    for k, (m, s) in enumerate(own):
        change[k] = np.diag(np.r_[1.0, scale / s])
        change[k][0, 1:] = -(m - centre) / s
    ridge = np.array([np.r_[0.0, np.full(d - 1, 1 / f.c)] for f in fits])
    i, j = np.triu_indices(d)
    best, trial = np.zeros((len(fits), d)), np.zeros((len(fits), d))
    least = np.full(len(fits), np.inf)
    open_ = np.arange(len(fits))
    for _ in range(STEPS):
        params = np.einsum("kij,kj->ki", change[open_], trial[open_])
        out = table.mapInArrow(_sums(members[open_], params), "fit int, at int, v double").groupBy("fit", "at").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros((len(open_), 1 + d + len(i)))
        for r in out:
            sums[r["fit"], r["at"]] = r["v"]
        going = []
        for row, k in zip(sums, open_):
            loss = row[0] + (ridge[k] * trial[k] ** 2).sum() / 2
            if not loss <= least[k] + 1e-12 * abs(least[k]):
                trial[k] = (trial[k] + best[k]) / 2  # too far: half the way
                if np.abs(trial[k] - best[k]).max() > TOLERANCE:
                    going.append(k)
                continue
            best[k], least[k] = trial[k], loss
            curve = np.zeros((d, d))
            curve[i, j] = curve[j, i] = row[1 + d :]
            slope = change[k].T @ row[1 : 1 + d] + ridge[k] * best[k]
            curve = change[k].T @ curve @ change[k] + np.diag(ridge[k] + 1e-12)
            keep = np.flatnonzero(used[k])
            step = np.zeros(d)
            step[keep] = np.linalg.lstsq(curve[np.ix_(keep, keep)], slope[keep], rcond=None)[0]
            if np.abs(step).max() > TOLERANCE:
                trial[k] = best[k] - step
                going.append(k)
        open_ = np.array(going, int)
        if not len(open_):
            break
    scorers = []
    for k, (m, s) in enumerate(own):
        keep = np.flatnonzero(used[k][1:])
        scorers.append(Scorer(tuple(columns[c] for c in keep), tuple(m[keep].tolist()), tuple(s[keep].tolist()), tuple(best[k][1 + keep].tolist()), float(best[k][0])))
    at = {f: k for k, f in enumerate(fits)}
    return [scorers[at[f]] for f in asked]


def probabilities(rows: DataFrame, key: str, scorers: Sequence[tuple], columns: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``rows`` joined with the scorers of their value of ``key``, one row per scorer: ``scorers`` has (value, one value per name, scorer),
    the new columns are ``names`` and ``__p``. The scorers go in as a small table."""
    table = []
    for value, *labels, scorer in scorers:
        intercept, weights = scorer.raw()
        table.append((value, *labels, intercept, [weights.get(c, 0.0) for c in columns]))
    kinds = [rows.schema[key].dataType.simpleString(), *["double" if isinstance(v, float) else "int" if isinstance(v, int) else "string" for v in table[0][1 : 1 + len(names)]]]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip([key, *names], kinds)) + ", __b double, __w array<double>"
    joined = rows.join(rows.sparkSession.createDataFrame(table, schema), key)
    logit = F.col("__b")
    for at, c in enumerate(columns):
        logit = logit + F.col(c) * F.get("__w", F.lit(at))
    return joined.withColumn("__p", 1 / (1 + F.exp(-logit))).drop("__b", "__w")
