"""Scoring models, thresholds and settings, fitted on Spark."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions.text import md5_draw
from passages.operators import decode as D
from passages.operators import evaluate as E
from passages.operators import sequence as S
from passages.operators.fits import Fit, Scorer, fit_many, probabilities
from passages.operators.scan import BLOCK_ROWS, Running, neighbours, one_block, ordinal, running

MAX_GROUPS = 200


def fit_scorer(rows: DataFrame, columns: Sequence[str], y: str = "y", c: float = 1.0, weight: str | None = None) -> Scorer:
    """Standardise (population deviation) and fit with penalty 1 / C, no class weights."""
    w = F.col(weight) if weight else F.lit(1.0)
    stats = rows.agg(
        F.sum(w).alias("w"),
        *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(columns)],
        *[F.stddev_pop(x).alias(f"s_{i}") for i, x in enumerate(columns)],
    ).first()
    mean = [float(stats[f"m_{i}"]) for i in range(len(columns))]
    std = [float(stats[f"s_{i}"]) or 1.0 for i in range(len(columns))]
    scaled = rows.select(
        *[((F.col(x) - m) / s).alias(f"x_{i}") for i, (x, m, s) in enumerate(zip(columns, mean, std, strict=True))],
        F.col(y).cast("double").alias("label"), w.cast("double").alias("w"),
    )
    vectors = VectorAssembler(inputCols=[f"x_{i}" for i in range(len(columns))], outputCol="features").transform(scaled)
    fitted = LogisticRegression(
        regParam=1.0 / (c * float(stats["w"])), elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-9,
        weightCol="w",
    ).fit(vectors.select("features", "label", "w"))
    return Scorer(
        tuple(columns), tuple(mean), tuple(std), tuple(float(v) for v in fitted.coefficients), float(fitted.intercept)
    )


def groups_of(rows: DataFrame, group: str) -> list:
    """The distinct groups, checked to be few: each adds a fit to every step. Deal larger numbers of
    groups into folds first."""
    found = [r[0] for r in rows.filter(F.col(group).isNotNull()).select(group).distinct().orderBy(group).limit(MAX_GROUPS + 1).collect()]
    if len(found) > MAX_GROUPS:
        raise ValueError("too many groups for one fit each; use a fold column")
    return found


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def leave_one_group_out(
    rows: DataFrame, group: str, columns: Sequence[str], y: str = "y", c: float = 1.0, weight: str | None = None, name: str = "p"
) -> DataFrame:
    """``rows`` plus the probability from a fit on all the other groups; all fits go through the same steps."""
    groups = groups_of(rows, group)
    models = fit_many(rows, columns, group, [Fit(frozenset(groups) - {g}, c) for g in groups], y, weight)
    out = probabilities(rows, group, list(zip(groups, models)), columns, [])
    return out.withColumn(name, F.col("__p")).select(*[x for x in rows.columns if x != name], name)


def soft_rows(rows: DataFrame, p: str = "p") -> DataFrame:
    """Each row as a positive with weight p and a negative with weight 1 - p."""
    copies = F.array(
        F.struct(F.lit(1).alias("y"), F.col(p).alias("w")), F.struct(F.lit(0).alias("y"), (1 - F.col(p)).alias("w"))
    )
    kept = [c for c in rows.columns if c not in ("y", "w")]
    return rows.select(*kept, F.inline(copies))


def soft_label_fit(rows: DataFrame, columns: Sequence[str], p: str = "p", c: float = 1.0) -> Scorer:
    return fit_scorer(soft_rows(rows, p), columns, "y", c, "w")


def _soft_loss(scored: DataFrame, p: str, by: Sequence[str]) -> DataFrame:
    return scored.groupBy(*by).agg(E.log_loss(F.col("__p"), F.col(p)).alias("loss"))


def choose_c(rows: DataFrame, columns: Sequence[str], p: str, group: str, cs: Sequence[float]) -> tuple[float, DataFrame]:
    """The C with the lowest mean soft log-loss over left-out groups, and the table (c, loss)."""
    groups = groups_of(rows, group)
    asked = [(g, float(c)) for c in cs for g in groups]
    models = fit_many(rows, columns, group, [Fit(frozenset(groups) - {g}, c) for g, c in asked], p)
    scored = probabilities(rows.drop("__c"), group, [(g, c, m) for (g, c), m in zip(asked, models)], columns, ["__c"])
    table = _soft_loss(scored, p, ["__c", group]).groupBy(F.col("__c").alias("c")).agg(F.avg("loss").alias("loss"))
    best = table.agg(F.min_by("c", F.struct("loss", "c"))).first()[0]
    return float(best), table


def out_of_fold(rows: DataFrame, columns: Sequence[str], p: str, fold: str, c: float = 1.0, name: str = "oof") -> DataFrame:
    """Soft-label scores of each fold from a fit on the others, for a stacker."""
    return leave_one_group_out(rows, fold, columns, p, c, None, name)


def nested_out_of_fold(
    rows: DataFrame, columns: Sequence[str], p: str, fold: str, cs: Sequence[float], name: str = "oof"
) -> tuple[DataFrame, dict]:
    """Out-of-fold scores where each fold's C is chosen on the other folds alone, and the C of each fold.

    The fits of all folds, inner folds and values of C go through the same steps."""
    folds = groups_of(rows, fold)
    inner = [(k, float(c), j) for k in folds for c in cs for j in folds if j != k]
    outer = [(k, float(c), None) for k in folds for c in cs]
    models = fit_many(rows, columns, fold, [Fit(frozenset(folds) - {k, j}, c) for k, c, j in inner + outer], p)
    at = {k: i for i, k in enumerate(folds)}
    scored = probabilities(rows.drop("__k", "__c"), fold, [(j, at[k], c, m) for (k, c, j), m in zip(inner, models)], columns, ["__k", "__c"])
    losses = _soft_loss(scored, p, ["__k", "__c", fold]).groupBy("__k", "__c").agg(F.avg("loss").alias("loss"))
    best = {folds[r["__k"]]: r["c"] for r in losses.groupBy("__k").agg(F.min_by("__c", F.struct("loss", "__c")).alias("c")).collect()}
    chosen = [(k, m) for (k, c, _), m in zip(outer, models[len(inner) :]) if best.get(k) == c]
    out = probabilities(rows, fold, chosen, columns, []).withColumn(name, F.col("__p"))
    return out.select(*[x for x in rows.columns if x != name], name), best


def stacker(rows: DataFrame, views: dict[str, Sequence[str]], p: str, fold: str, cs: Sequence[float], name: str = "stacked", c: float = 1.0) -> DataFrame:
    """``rows`` plus the out-of-fold score of each view (its columns, C by nested folds) and of a fit on these scores, out of fold too."""
    out = rows
    for view, columns in views.items():
        out, _ = nested_out_of_fold(out, columns, p, fold, cs, view)
    return out_of_fold(out, list(views), p, fold, c, name)


def platt(rows: DataFrame, logit: str = "logit", y: str = "y") -> Scorer:
    """Calibration of a logit, practically without penalty."""
    return fit_scorer(rows, [logit], y, 1e6)


def restrict_pairs(pairs: DataFrame, max_label: int) -> DataFrame:
    return pairs.filter(F.col("label") < max_label)


def restrict_items(items: DataFrame, max_label: int, gold: str = "gold") -> DataFrame:
    """Items whose gold names no label from ``max_label`` on."""
    return items.filter(~F.exists(gold, lambda v: v >= max_label))


def restricted_counts(
    items: DataFrame, max_label: int, off: int, state: str = "state", keys: Sequence[str] = ("seq",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Step counts of the sequences cut wherever a label from ``max_label`` on occurs."""
    out = (F.col(state) != off) & (F.col(state) >= max_label)
    cut = running(items, keys, "pos", [Running("__cut", out.cast("long"), "sum")], block_rows)
    rows = neighbours(
        cut, keys, "pos", lambda w: {"__a": F.lag(state).over(w), "__c": F.lag("__cut").over(w)}, 1, 0, block_rows
    )
    a, b = F.col("__a"), F.col(state)
    inside = a.isNotNull() & (F.col("__c") == F.col("__cut")) & ~((a != off) & (a >= max_label))
    bucket = (
        F.when((a == off) & (b == off), "stay_off")
        .when(a == off, "from_off")
        .when(b == off, "to_off")
        .when(a == b, "stay")
        .when((b - a).isin(1, 2), "next")
        .otherwise("jump")
    )
    steps = rows.filter(inside).select(bucket.alias("bucket"))
    return steps.agg(*[(F.count_if(F.col("bucket") == n) + 1).alias(n) for n in S.STEP_BUCKETS])


def learning_curve(
    rows: DataFrame, test: DataFrame, columns: Sequence[str], p: str, group: str, sizes: Sequence[int], draws: int, y: str = "y", c: float = 1.0
) -> DataFrame:
    """(n_groups, draw, auc) of soft-label fits on growing random sets of groups; all sets go through the same steps."""
    groups = rows.filter(F.col(group).isNotNull()).select(group).distinct()
    order: dict[int, list] = {}
    for draw in range(draws):
        shuffled = groups.withColumn("__h", md5_draw(F.concat_ws("-", F.lit(draw), group), 1 << 31)).orderBy("__h", group).limit(max(sizes))
        order[draw] = [r[group] for r in shuffled.select(group).collect()]
    asked = [(n, draw) for draw in range(draws) for n in sizes]
    models = fit_many(rows, columns, group, [Fit(frozenset(order[draw][:n]), c) for n, draw in asked], p)
    named = test.withColumn("__all", F.lit(0))
    scored = probabilities(named, "__all", [(0, n, draw, m) for (n, draw), m in zip(asked, models)], columns, ["n_groups", "draw"])
    return E.auc_ap(scored.select("n_groups", "draw", F.col("__p").alias("score"), F.col(y).alias("y")), by=["n_groups", "draw"]).select("n_groups", "draw", "auc")


def ablation(rows: DataFrame, group: str, columns: Sequence[str], y: str = "y", c: float = 1.0) -> DataFrame:
    """(dropped, auc, delta): the leave-one-group-out AUC without each column, against all."""
    groups = groups_of(rows, group)
    asked = [(g, dropped) for dropped in ["", *columns] for g in groups]
    fits = [Fit(frozenset(groups) - {g}, c, tuple(x for x in columns if x != dropped)) for g, dropped in asked]
    models = fit_many(rows, columns, group, fits, y)
    scored = probabilities(rows.drop("dropped"), group, [(g, dropped, m) for (g, dropped), m in zip(asked, models)], columns, ["dropped"])
    table = E.auc_ap(scored.select("dropped", F.col("__p").alias("score"), F.col(y).alias("y")), by=["dropped"]).select("dropped", "auc")
    full = table.filter("dropped = ''").select(F.col("auc").alias("__full"))
    return E.with_row(table, full).select("dropped", "auc", (F.col("auc") - F.col("__full")).alias("delta"))


# ---- thresholds and settings ---------------------------------------------------------


def sweep(items: DataFrame, thresholds: Sequence[float], stat: str, label: str, gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """Scores when an item gets its label if the statistic reaches the threshold: all the
    thresholds in one aggregation."""
    hit = F.array_contains(gold, F.col(label)).cast("long")
    aggs = []
    for i, t in enumerate(thresholds):
        fires = F.col(stat) >= float(t)
        aggs += [F.sum(F.when(fires, hit).otherwise(0)).alias(f"tp{i}"), F.count_if(fires).alias(f"n{i}")]
    one = items.groupBy(*by).agg(F.sum(F.size(gold)).alias("__gold"), *aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("tau"), F.col(f"tp{i}").alias("tp"), (F.col(f"n{i}") - F.col(f"tp{i}")).alias("fp"),
                (F.col("__gold") - F.col(f"tp{i}")).alias("fn"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    out = one.select(*by, F.inline(rows))
    return out.withColumns(E.prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def percentile_candidates(items: DataFrame, stat: str, label: str, gold: str = "gold", every: int = 2) -> DataFrame:
    """(i, tau, f1): every second percentile of the statistic as threshold."""
    marks = [i / 100 for i in range(0, 100, every)]
    cuts = [float(x) for x in items.agg(F.percentile(stat, F.array(*map(F.lit, marks)))).first()[0]]
    table = sweep(items, cuts, stat, label, gold)
    # equal percentiles give equal rows; the first of them is meant
    return table.groupBy("tau").agg(F.max("f1").alias("f1"))


def best_threshold(table: DataFrame) -> DataFrame:
    """One row: the lowest threshold with the highest F1."""
    return table.agg(F.max_by("tau", F.struct("f1", -F.col("tau"))).alias("tau"), F.max("f1").alias("f1"))


def balanced_threshold(rows: DataFrame, signals: Sequence[str], y: str = "answerable", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (signal, threshold, accuracy): the midpoint between neighbouring scores with
    the best balanced accuracy, the middle one of several; the first signal wins ties."""
    parts = []
    for i, s in enumerate(signals):
        per = rows.groupBy(F.col(s).alias("v")).agg(F.sum(y).alias("a"), F.sum(1 - F.col(y)).alias("u"))
        placed = ordinal(per, [], ["v"], "pos", block_rows)
        placed = running(placed, [], "pos", [Running("ca", F.col("a"), "sum"), Running("cu", F.col("u"), "sum")], block_rows)
        placed = neighbours(placed, [], "pos", lambda w: {"nv": F.lead("v").over(w)}, 0, 1, block_rows)
        total = per.agg(F.sum("a").alias("ta"), F.sum("u").alias("tu"))
        cands = E.with_row(placed.filter("nv IS NOT NULL"), total).select(
            ((F.col("v") + F.col("nv")) / 2).alias("t"),
            (((F.col("ta") - F.col("ca")) / F.col("ta") + F.col("cu") / F.col("tu")) / 2).alias("acc"),
        )
        top = cands.agg(F.max("acc").alias("best"))
        tied = E.with_row(cands, top).filter(F.col("acc") >= F.col("best") - 1e-12)
        tied = ordinal(tied, [], ["t"], "pos", block_rows)
        n = tied.agg(F.count(F.lit(1)).alias("n"))
        middle = E.with_row(tied, n).filter(F.col("pos") == F.floor(F.col("n") / 2))
        parts.append(middle.select(F.lit(i).alias("i"), F.lit(s).alias("signal"), F.col("t").alias("threshold"), F.col("acc").alias("accuracy")))
    best = F.max_by(F.struct("signal", "threshold", "accuracy"), F.struct(F.round("accuracy", 12), -F.col("i")))
    return _union(parts).agg(best.alias("b")).select("b.*")


def grid_choose(
    items: DataFrame, model: D.Model, off: int, gammas: Sequence[float], betas: Sequence[float], taus: Sequence[float],
    probs: str = "probs", p_off: str = "p_off", gold: str = "gold", language: str = "language", keys: Sequence[str] = ("seq",),
) -> tuple[DataFrame, DataFrame]:
    """Decode every sequence with every (gamma, beta), add labels from tau on, and score:
    the table (setting, gamma, beta, tau, macro_f1) and its first best row."""
    settings = [(g, b) for g in gammas for b in betas]
    grid = F.array(
        *[F.struct(F.lit(i).alias("setting"), F.lit(float(g)).alias("gamma"), F.lit(float(b)).alias("beta")) for i, (g, b) in enumerate(settings)]
    )
    rows = items.select("*", F.inline(grid))
    raw = S.emissions(probs, p_off)
    rows = rows.withColumn("__emit", F.transform(raw, lambda e, i: F.when(i == off, e + F.col("beta")).otherwise(e)))
    by = ["setting", *keys]
    known = rows.dropna(subset=[*keys, "pos"])
    decoded = D.viterbi(known, model, "gamma", 0.0, "__emit", None, by, keep=["gamma", "beta", probs, gold, language])
    tried = decoded.select(
        "*", F.inline(F.array(*[F.struct(F.lit(j).alias("t"), F.lit(float(t)).alias("tau")) for j, t in enumerate(taus)]))
    )
    extra = F.filter(
        F.transform(probs, lambda p, i: F.when((p >= F.col("tau")) & (i != F.col("state")), i)), lambda v: v.isNotNull()
    )
    none = F.array().cast("array<int>")
    pred = F.when(F.col("state") == off, none).otherwise(F.concat(F.array("state"), extra))
    scored = E.prf(tried.withColumn("pred", pred), ["setting", "t", "gamma", "beta", "tau", language], gold, "pred")
    table = scored.groupBy("setting", "t", "gamma", "beta", "tau").agg(F.avg("f1").alias("macro_f1"))
    best = table.agg(
        F.max_by(F.struct("gamma", "beta", "tau", "macro_f1"), F.struct(F.round("macro_f1", 12), -F.col("setting"), -F.col("t"))).alias("b")
    ).select("b.*")
    return table, best


# ---- training data and annotator models ----------------------------------------------


def training_pairs(
    items: DataFrame, n_labels: int, gold: str = "gold", prior: str = "scores", sampled: int = 5, sampled_off: int = 8,
    best: int = 5, weight: Column | None = None, keys: Sequence[str] = ("seq",), block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(unit, label, y, w): gold labels as positives; as negatives the labels next to the
    first gold one, the best-scored ones and a digest-ordered sample; for an item without
    label the held label, the one after it and a larger sample."""
    held = Running("__held", F.get(gold, F.lit(0)), "last")
    rows = running(items, keys, "pos", [held], block_rows)
    labels = F.sequence(F.lit(0), F.lit(n_labels - 1))
    first = F.get(gold, F.lit(0))
    ranked = F.array_sort(F.transform(prior, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    near = F.array_union(
        F.transform(F.array(*[F.lit(x) for x in (-2, -1, 1, 2)]), lambda x: first + x),
        F.transform(F.slice(ranked, 1, best), lambda r: r["i"]),
    )
    after = F.when(F.col("__held").isNotNull(), F.array(F.col("__held"), F.col("__held") + 1)).otherwise(
        F.array().cast("array<int>")
    )
    on = F.size(gold) > 0
    fixed = F.filter(
        F.when(on, F.array_except(near, gold)).otherwise(after), lambda v: (v >= 0) & (v < n_labels)
    )
    rows = rows.withColumn("__fixed", fixed)
    pool = F.array_except(F.array_except(labels, "__fixed"), gold)
    drawn = F.array_sort(F.transform(pool, lambda v: F.struct(F.md5(F.concat_ws("-", "unit", v)).alias("h"), v.alias("v"))))
    size = F.when(on, sampled).otherwise(sampled_off)
    sample = F.transform(F.slice(drawn, F.lit(1), size), lambda r: r["v"])
    pairs = F.concat(
        F.transform(gold, lambda v: F.struct(v.alias("label"), F.lit(1).alias("y"))),
        F.transform(F.concat("__fixed", sample), lambda v: F.struct(v.alias("label"), F.lit(0).alias("y"))),
    )
    return rows.select("unit", F.inline(pairs), (F.lit(1.0) if weight is None else weight).alias("w"))


def target_grid(items: DataFrame, n_labels: int, gold: str = "gold") -> DataFrame:
    """(unit, label, y) for every label, in label order."""
    return items.select("unit", gold, F.explode(F.sequence(F.lit(0), F.lit(n_labels - 1))).alias("label")).select(
        "unit", "label", F.array_contains(gold, F.col("label")).cast("int").alias("y")
    )


def annotator_reliability(
    items: DataFrame, log_a: np.ndarray, n_labels: int, labels: str = "labels", keys: Sequence[str] = ("seq",),
    rounds: int = 200, tol: float = 1e-6, block_rows: int = D.BLOCK_ROWS,
) -> tuple[list[float], list[float], int]:
    """How an annotator errs, without gold: shares of correct / next to it / other / none on
    labelled items, and of none / some on the others, by expectation maximisation.

    The items are dealt to the tasks once, as packs that hold a number per item; those of sequences longer than a block as rows. Every
    round is a fresh plan with six numbers of the round before in it, so no lineage builds up."""
    off, keys = n_labels, list(keys)
    model = D.Model.plain(log_a)
    state = F.coalesce(F.array_min(labels), F.lit(off))

    def buckets(x: Column) -> Column:
        """Bucket of label state x for an item."""
        has = lambda v: F.array_contains(labels, v)
        return F.when(F.size(labels) == 0, 3).when(has(x), 0).when(has(x - 1) | has(x + 1), 1).otherwise(2)

    def shares(sums: Sequence[float]) -> tuple[list[float], list[float]]:
        on, none = [1 + x for x in sums[:4]], [1 + x for x in sums[4:6]]
        return [x / sum(on) for x in on], [x / sum(none) for x in none]

    def table(q: DataFrame) -> list[float]:
        """``q`` has (labels, posterior)."""
        cells = q.select(labels, F.posexplode("posterior").alias("s", "w"))
        b = F.when(F.col("s") < off, buckets(F.col("s")))
        r = cells.agg(
            *[F.sum(F.when(b == i, F.col("w")).otherwise(0.0)).alias(f"on{i}") for i in range(4)],
            F.sum(F.when((F.col("s") == off) & (F.size(labels) == 0), F.col("w")).otherwise(0.0)).alias("off0"),
            F.sum(F.when((F.col("s") == off) & (F.size(labels) > 0), F.col("w")).otherwise(0.0)).alias("off1"),
        ).first()
        return [r[c] or 0.0 for c in ("on0", "on1", "on2", "on3", "off0", "off1")]

    def loglik(s: int, share: Sequence[float]) -> list[float | None]:
        """Of an item of each bucket of state s."""
        sides = (s > 0) + (s < off - 1)
        size = [1, sides, off - 1 - sides, 1]
        return [float(np.log(p / n)) if n else None for p, n in zip(share, size)]

    def of_packs(packs: DataFrame) -> list[float]:
        scores = np.full((7, off + 1), np.nan)
        scores[:4, :off] = np.array([loglik(s, p_on) for s in range(off)], float).reshape(-1, 4).T
        scores[4:, off] = np.log(p_off[0]), np.log(p_off[1] / n_labels), np.log(p_off[1] / n_labels)
        return np.sum([r["sums"] for r in D.forward_backward(packs, model, keys=keys, scores=scores).collect()] or np.zeros((1, 7)), 0).tolist()

    def of_rows(rows: DataFrame) -> list[float]:
        of_off = F.when(F.size(labels) == 0, float(np.log(p_off[0]))).otherwise(float(np.log(p_off[1] / n_labels)))
        emitted = [F.get(F.array(*[F.lit(x).cast("double") for x in loglik(s, p_on)]), F.get("__buckets", F.lit(s))) for s in range(off)]
        post = D.forward_backward(rows.withColumn("__emit", F.array(*emitted, of_off)), model, "__emit", keys, block_rows, [labels], True)
        # what an item adds depends on its labels alone
        sums = post.groupBy(labels).agg(F.array(*[F.sum(F.get("posterior", F.lit(s))) for s in range(off + 1)]).alias("posterior"))
        return table(sums.select(labels, "posterior"))

    onehot = F.transform(F.sequence(F.lit(0), F.lit(off)), lambda s: (s == state).cast("double"))
    p_on, p_off = shares(table(items.select(labels, onehot.alias("posterior"))))
    known = items.dropna(subset=[*keys, "pos"])
    known = known.select(*keys, "pos", labels, F.transform(F.sequence(F.lit(0), F.lit(off - 1)), buckets).alias("__buckets"))
    parts = []
    if one_block(items, "pos", block_rows):
        short = known
    else:
        long = known.groupBy(*keys).agg(F.max("pos").alias("__last")).filter(F.col("__last") >= block_rows).select(*keys)
        rows = D.dealt(known.join(long, keys, "left_semi"), keys)
        parts += [] if rows.isEmpty() else [(of_rows, rows)]
        short = known.join(long, keys, "left_anti")
    # the values of an item and a state: the bucket, and for the off state 4 without labels, 5 with labels, 6 for no list of labels
    of_off = F.when(F.size(labels) == 0, 4).when(F.size(labels) > 0, 5).otherwise(6)
    values = F.transform(F.concat("__buckets", F.array(of_off)), lambda v: F.format_string("%02d", v))
    short = short.select(*keys, "pos", F.unhex(F.array_join(values, "")).alias("__kind"))
    parts.append((of_packs, D.packed(short, "__kind", keys)))
    for done in range(2, rounds + 1):
        new_on, new_off = shares(np.sum([of(part)[:6] for of, part in parts], 0).tolist())
        moved = max(abs(a - b) for a, b in zip([*p_on, *p_off], [*new_on, *new_off], strict=True))
        p_on, p_off = new_on, new_off
        if moved < tol:
            return p_on, p_off, done
    return p_on, p_off, rounds
