"""Scoring of labellings against gold.

A labelled item carries ``gold`` and ``pred`` as arrays of integer labels, so every count
is a row expression followed by one partial aggregation; nothing is exploded to be scored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.functions.text import md5_draw
from passages.operators.scan import BLOCK_ROWS, Running, neighbours, ordinal, running
from passages.session import checkpoint_dir

MIN_GROUPS_FOR_CI = 5


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def prf_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)}


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a single-row frame (a global aggregate) on every row."""
    return df.join(F.broadcast(one_row))


def common(a: str, b: str) -> Column:
    return F.size(F.array_intersect(a, b))


def missing(a: str, b: str) -> Column:
    return F.size(F.array_except(a, b))


def same(a: str, b: str) -> Column:
    """Equal as sets."""
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def strict_counts(gold: str = "gold", pred: str = "pred") -> list[Column]:
    return [
        F.sum(common(gold, pred)).alias("tp"),
        F.sum(missing(pred, gold)).alias("fp"),
        F.sum(missing(gold, pred)).alias("fn"),
    ]


def prf(items: DataFrame, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Micro-averaged scores over (item, label) pairs, items and items with a prediction."""
    counts = items.groupBy(*by).agg(
        *strict_counts(gold, pred), F.count(F.lit(1)).alias("items"), F.count_if(F.size(pred) > 0).alias("fired")
    )
    return counts.withColumns(prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def near_counts(k: int, gold: str = "gold", pred: str = "pred") -> list[Column]:
    def close(x: str, y: str) -> Column:
        return F.size(F.filter(x, lambda a: F.exists(y, lambda b: F.abs(a - b) <= k)))

    return [
        F.sum(close(pred, gold)).alias("pred_hits"),
        F.sum(F.size(pred)).alias("n_pred"),
        F.sum(close(gold, pred)).alias("gold_hits"),
        F.sum(F.size(gold)).alias("n_gold"),
    ]


def near_prf(items: DataFrame, k: int = 1, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """A label within k counts; predicted and gold hits are separate numerators."""
    counts = items.groupBy(*by).agg(*near_counts(k, gold, pred))
    p, r = ratio(F.col("pred_hits"), F.col("n_pred")), ratio(F.col("gold_hits"), F.col("n_gold"))
    return counts.withColumns({"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r)})


def themes_of(labels: str, themes: Sequence[int]) -> Column:
    """Distinct themes of the labels; labels without one are dropped."""
    table = F.array(*map(F.lit, themes))
    return F.array_distinct(F.array_compact(F.transform(labels, lambda v: F.get(table, v))))


def theme_prf(items: DataFrame, themes: Sequence[int], by: Sequence[str] = (), gold: str = "gold", pred: str = "pred"):
    mapped = items.withColumns({gold: themes_of(gold, themes), pred: themes_of(pred, themes)})
    return prf(mapped, by, gold, pred)


def tier_recall(items: DataFrame, tiers: str = "tiers", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """hit / n per tier with a pooled row (tier null); ``tiers`` is array<struct<label, tier>>."""
    pairs = items.select(*by, pred, F.explode(tiers).alias("g")).select(
        *by, F.col("g.tier").alias("tier"), F.array_contains(pred, F.col("g.label")).cast("int").alias("hit")
    )
    groups = [list(by) + ["tier"], list(by)]
    return (
        pairs.groupingSets(groups, *by, "tier")
        .agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n"), F.grouping("tier").alias("pooled"))
        .withColumn("recall", ratio(F.col("hits"), F.col("n")))
    )


def attractors(items: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """False positives per label."""
    wrong = items.select(F.explode(F.array_except(pred, gold)).alias("label"))
    return wrong.groupBy("label").agg(F.count(F.lit(1)).alias("false_positives"))


# ---- bootstrap over groups -----------------------------------------------------------


def replicates(per_group: DataFrame, order: str, counts: Sequence[str], n_boot: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, rep, summed counts): each replicate draws as many groups as there are, with
    replacement. The draw of slot s in replicate r is a digest of 'r-s', so it can be
    repeated anywhere."""
    by = list(by)
    spark = per_group.sparkSession
    checkpoint_dir(spark)
    placed = ordinal(per_group.select(*by, order, *counts), by, [order], "__idx").checkpoint()
    sizes = placed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    slots = placed.select(*by, F.col("__idx").alias("__slot"))
    slots = slots.join(sizes, by) if by else with_row(slots, sizes)
    # a slot is a few bytes but makes n_boot draws: by its size Spark would give them all to a task or two
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slots = slots.repartition(tasks, *by, "__slot")
    slots = slots.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    draw = md5_draw(F.concat_ws("-", "rep", "__slot"), F.col("__n"))
    # never null, so that the join adds no filter that makes every digest twice
    drawn = slots.select(*by, "rep", F.coalesce(draw, F.lit(-1)).alias("__idx"))
    return drawn.join(placed, [*by, "__idx"]).groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in counts])


def _pick(values: Column, n_boot: int) -> tuple[Column, Column]:
    """The 2.5 % and 97.5 % entries of the sorted draws, by index."""
    lo, hi = int(0.025 * n_boot), min(int(0.975 * n_boot), n_boot - 1)
    return F.get(values, F.lit(lo)), F.get(values, F.lit(hi))


def bootstrap_ci(per_group: DataFrame, order: str, n_boot: int = 1000) -> DataFrame:
    """One row: F1 of the summed tp / fp / fn and its interval over resampled groups
    (null under five groups)."""
    names = ("tp", "fp", "fn")
    draws = replicates(per_group, order, names, n_boot)
    f1 = prf_columns(*map(F.col, names))["f1"]
    ci = draws.agg(F.array_sort(F.collect_list(f1)).alias("__f"))
    point = per_group.agg(*[F.sum(c).alias(c) for c in names], F.count(F.lit(1)).alias("groups")).withColumn("f1", f1)
    enough = F.col("groups") >= MIN_GROUPS_FOR_CI
    lo, hi = _pick(F.col("__f"), n_boot)
    return with_row(point, ci).select(
        "groups", "f1", F.when(enough, lo).alias("f1_lo"), F.when(enough, hi).alias("f1_hi")
    )


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p-value, summed in logs."""
    n, k = wins + losses, F.least(wins, losses)
    start = F.struct(F.lit(0.0).alias("c"), (-n * F.ln(F.lit(2.0))).alias("l"), F.exp(-n * F.ln(F.lit(2.0))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        logp = acc["l"] + F.ln((n - i + 1) / i)
        return F.struct(acc["c"].alias("c"), logp.alias("l"), (acc["s"] + F.exp(logp)).alias("s"))

    ks = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(ks, start, step)["s"]))


def paired_bootstrap(per_group: DataFrame, order: str, n_boot: int = 1000) -> DataFrame:
    """One row for A against B, from per-group counts tp_a, fp_a, fn_a, tp_b, fp_b, fn_b:
    F1 difference, interval, share of replicates at or below 0, groups won / tied / lost,
    sign test."""
    names = [f"{c}_{s}" for s in "ab" for c in ("tp", "fp", "fn")]
    f1 = {s: prf_columns(*[F.col(f"{c}_{s}") for c in ("tp", "fp", "fn")])["f1"] for s in "ab"}
    diff = f1["a"] - f1["b"]
    draws = replicates(per_group, order, names, n_boot).agg(
        F.array_sort(F.collect_list(diff)).alias("__d"), F.avg((diff <= 0).cast("double")).alias("share_le_0")
    )
    point = per_group.agg(*[F.sum(c).alias(c) for c in names]).select(diff.alias("diff"))
    wtl = per_group.agg(
        F.count_if(diff > 1e-9).alias("wins"),
        F.count_if(F.abs(diff) <= 1e-9).alias("ties"),
        F.count_if(diff < -1e-9).alias("losses"),
    )
    lo, hi = _pick(F.col("__d"), n_boot)
    return with_row(with_row(point, draws), wtl).select(
        "diff", lo.alias("lo"), hi.alias("hi"), "share_le_0", "wins", "ties", "losses",
        sign_test(F.col("wins"), F.col("losses")).alias("p_value"),
    )


def rate_bootstrap(per_group: DataFrame, order: str, n_boot: int = 1000) -> DataFrame:
    """False-label rate on empty items, A against B (counts a, b of n per group): difference
    and ratio with interpolated percentiles; groups without empty items drop out."""
    kept = per_group.filter("n > 0")
    draws = replicates(kept, order, ["a", "b", "n"], n_boot)
    diff = (F.col("a") - F.col("b")) / F.col("n")
    rate = F.col("a") / F.greatest(F.col("b"), F.lit(1))
    marks = F.array(F.lit(0.025), F.lit(0.975))
    ci = draws.agg(F.percentile(diff, marks).alias("__d"), F.percentile(rate, marks).alias("__r"))
    point = kept.agg(*[F.sum(c).alias(c) for c in "abn"]).select(
        diff.alias("diff"), F.when(F.col("b") > 0, F.col("a") / F.col("b")).alias("ratio")
    )
    return with_row(point, ci).select(
        "diff", F.col("__d")[0].alias("diff_lo"), F.col("__d")[1].alias("diff_hi"),
        "ratio", F.col("__r")[0].alias("ratio_lo"), F.col("__r")[1].alias("ratio_hi"),
    )


def recall_ci(per_group: DataFrame, order: str, n_boot: int = 1000, small: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Recall of (hits, n), for every value of ``by``, with an interval over groups (null under five of them); ``few`` marks a thin sample."""
    by = list(by)
    checkpoint_dir(per_group.sparkSession)
    per_group = per_group.checkpoint()  # the items are read once, whatever is drawn from their groups
    draws = replicates(per_group, order, ["hits", "n"], n_boot, by)
    ci = draws.groupBy(*by).agg(F.array_sort(F.collect_list(ratio(F.col("hits"), F.col("n")))).alias("__r"))
    point = per_group.groupBy(*by).agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"))
    lo, hi = _pick(F.col("__r"), n_boot)
    enough = F.col("groups") >= MIN_GROUPS_FOR_CI
    return (point.join(ci, by) if by else with_row(point, ci)).select(
        *by, "hits", "n", ratio(F.col("hits"), F.col("n")).alias("recall"),
        F.when(enough, lo).alias("lo"), F.when(enough, hi).alias("hi"), (F.col("n") < small).alias("few"),
    )


def verdict(diff: Column, lo: Column, hi: Column, margin: float = 0.02) -> Column:
    return (
        F.when(lo > 0, "better")
        .when(hi < 0, "worse")
        .when(lo > -margin, "matches within margin")
        .otherwise("inconclusive")
    )


# ---- agreement -----------------------------------------------------------------------


def kappa(pairs: DataFrame, relation: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cohen's kappa of columns a, b where ``relation(x, y)`` lists the pairs of labels that
    agree; chance agreement uses the same relation."""
    by = list(by)
    rel = relation.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct().withColumn("__ok", F.lit(1))
    cells = pairs.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    agreed = cells.join(rel, ["a", "b"], "left").groupBy(*by).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("__ok")), F.lit(0)).alias("agreed")
    )
    na = cells.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    nb = cells.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    chance = na.join(rel, "a").join(nb, [*by, "b"]).groupBy(*by).agg(F.sum(F.col("na").cast("double") * F.col("nb")).alias("pe"))
    joined = agreed.join(chance, by, "left") if by else with_row(agreed, chance)
    po = F.col("agreed") / F.col("n")
    pe = F.coalesce("pe", F.lit(0.0)) / F.col("n") / F.col("n")
    return joined.select(*by, "n", po.alias("observed"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def relation_equal(labels: DataFrame) -> DataFrame:
    """``labels`` has one column x: every label agrees with itself."""
    return labels.select("x", F.col("x").alias("y"))


def relation_near(labels: DataFrame, k: int, off: int) -> DataFrame:
    """Labels within k agree; the off state only with itself."""
    steps = F.when(F.col("x") == off, F.array(F.lit(0))).otherwise(F.sequence(F.lit(-k), F.lit(k)))
    return labels.select("x", F.explode(F.transform(steps, lambda s: F.col("x") + s)).alias("y")).filter(
        (F.col("x") == off) | (F.col("y") != off)
    )


def relation_grouped(labels: DataFrame, group: Column) -> DataFrame:
    """Labels of one group agree; a label without a group only with itself."""
    marked = labels.select("x", F.coalesce(group.cast("string"), F.concat(F.lit("="), F.col("x"))).alias("g"))
    return marked.join(marked.withColumnRenamed("x", "y"), "g").select("x", "y")


def second_pass_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """(item, a, b) of the first and the second pass, without items an annotator labelled
    again; both sides are (item, annotator, label)."""
    f = first.select("item", F.col("annotator").alias("who"), F.col("label").alias("a"))
    return f.join(second.withColumnRenamed("label", "b"), "item").filter(F.col("who") != F.col("annotator")).select("item", "a", "b")


def confusion(pairs: DataFrame, labels: Sequence) -> DataFrame:
    """Rows a, one column per label of b."""
    return pairs.groupBy("a").pivot("b", list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def disagreements(pairs: DataFrame, key: Sequence[str], labels: Sequence | None = None) -> DataFrame:
    """The items two raters labelled differently: keys, a, b, how far apart the labels stand in ``labels`` (null for one that is not among them),
    and how often this pair of labels occurs, either way round. Items without both labels are left out."""
    both = pairs.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(*key, "a", "b")
    sides = F.least("a", "b").alias("__low"), F.greatest("a", "b").alias("__high")
    kinds = both.groupBy(*sides).agg(F.count(F.lit(1)).alias("n_alike"))
    rows = both.select("*", *sides).join(kinds, ["__low", "__high"])
    place = F.create_map(*[F.lit(x) for i, v in enumerate(labels or ()) for x in (v, i)]) if labels else None
    apart = F.abs(F.try_element_at(place, F.col("a")) - F.try_element_at(place, F.col("b"))) if labels else F.lit(None).cast("int")
    return rows.select(*key, "a", "b", apart.alias("apart"), "n_alike")


def set_overlap(items: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Items both raters labelled: identical sets and any label in common."""
    both = items.filter((F.size(a) > 0) & (F.size(b) > 0))
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(same(a, b)).alias("identical"),
        F.count_if(F.arrays_overlap(a, b)).alias("overlapping"),
    )


# ---- error analysis ------------------------------------------------------------------


def error_causes(items: DataFrame, by: Sequence[str] = (), gold="gold", pred="pred", anchors="anchors") -> DataFrame:
    """False positives: wrong anchor / carried into empty / carried past a switch; false
    negatives: none yet / stale / extra."""
    fp = F.transform(
        F.array_except(pred, gold),
        lambda v: F.when(F.array_contains(anchors, v), "wrong anchor")
        .when(F.size(gold) == 0, "carried into empty")
        .otherwise("carried past a switch"),
    )
    fn = F.transform(
        F.array_except(gold, pred),
        lambda v: F.when(F.size(pred) == 0, "none yet").when(F.arrays_overlap(pred, gold), "extra").otherwise("stale"),
    )
    causes = items.select(*by, F.explode(F.concat(fp, fn)).alias("cause"))
    return causes.groupBy(*by, "cause").agg(F.count(F.lit(1)).alias("n"))


def relation(gold: str = "gold", pred: str = "pred") -> Column:
    """How two label sets lie to each other, from their sizes, their common labels and how many predicted ones are next to a gold one."""
    g, p, both = (F.size(F.array_distinct(gold)), F.size(F.array_distinct(pred)), common(gold, pred))
    steps = F.transform(F.array_distinct(pred), lambda a: F.array_min(F.transform(gold, lambda b: F.abs(a - b))))
    beside = F.size(F.filter(steps, lambda d: d == 1))
    one_empty = F.when(p > 0, "invented").when(g > 0, "silent").otherwise("both empty")
    meeting = F.when(both < F.least(g, p), "crossing").when(g == p, "equal").when(p > g, "wider").otherwise("narrower")
    disjoint = F.when(beside == 0, "apart").when(beside == p, "beside").otherwise("partly beside")
    return F.when((g == 0) | (p == 0), one_empty).otherwise(F.when(both > 0, meeting).otherwise(disjoint))


#: what a relation is called by three reports: one that asks how far off, one that asks for any right label, one that tells extra from missed
OUTCOMES = {
    "both empty": ("right", "rest", "right"),
    "equal": ("right", "found", "right"),
    "invented": ("invented", "invented", "invented"),
    "silent": ("silent", "silent", "silent"),
    "wider": ("shared", "found", "too many"),
    "narrower": ("shared", "found", "too few"),
    "crossing": ("shared", "found", "shared"),
    "beside": ("neighbour", "near", "neighbour"),
    "partly beside": ("apart", "near", "neighbour"),
    "apart": ("apart", "apart", "apart"),
}


def _called(report: int, gold: str, pred: str) -> Column:
    names = F.create_map(*[F.lit(x) for name, calls in OUTCOMES.items() for x in (name, calls[report])])
    return F.element_at(names, relation(gold, pred))


def outcome_coarse(gold: str = "gold", pred: str = "pred") -> Column:
    return _called(0, gold, pred)


def outcome_hit(gold: str = "gold", pred: str = "pred") -> Column:
    return _called(1, gold, pred)


def outcome_fine(gold: str = "gold", pred: str = "pred") -> Column:
    return _called(2, gold, pred)


def outcome_transitions(items: DataFrame, a: str, b: str, by: Sequence[str] = (), gold: str = "gold") -> DataFrame:
    """How the outcome of an item changes from system a to system b."""
    return items.groupBy(*by, outcome_fine(gold, a).alias("from_outcome"), outcome_fine(gold, b).alias("to_outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def change(a: str, b: str, gold: str = "gold") -> Column:
    ra, rb = same(gold, a), same(gold, b)
    return (
        F.when(ra & rb, "both right").when(ra, "only a right").when(rb, "only b right").otherwise("both wrong")
    )


def f1_without_empty(items: DataFrame, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """F1, and what it would be without the false positives on empty items."""
    on_empty = F.sum(F.when(F.size(gold) == 0, missing(pred, gold)).otherwise(0)).alias("fp_empty")
    counts = items.groupBy(*by).agg(*strict_counts(gold, pred), on_empty)
    now = prf_columns(F.col("tp"), F.col("fp"), F.col("fn"))["f1"]
    then = prf_columns(F.col("tp"), F.col("fp") - F.col("fp_empty"), F.col("fn"))["f1"]
    return counts.withColumns({"f1": now, "f1_without_empty": then})


def pk_windowdiff(
    items: DataFrame, ref: str = "ref", hyp: str = "hyp", keys: Sequence[str] = ("seq",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pooled segmentation errors of single labels per item; the window is half the mean
    reference segment of each sequence (rounded half to even, at least 1)."""
    keys = list(keys)
    rows = neighbours(
        items, keys, "pos", lambda w: {"__r": F.lag(ref).over(w), "__h": F.lag(hyp).over(w)}, 1, 0, block_rows
    )
    new = lambda now, before: (F.col("pos") > 0) & (F.col(now) != F.col(before))
    rows = running(
        rows, keys, "pos",
        [Running("__rs", new(ref, "__r").cast("long"), "sum"), Running("__hs", new(hyp, "__h").cast("long"), "sum")],
        block_rows,
    ).select(*keys, "pos", "__rs", "__hs")
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("__rs").alias("bounds"))
    width = F.greatest(F.lit(1), F.bround(F.col("n") / (2 * (F.col("bounds") + 1)), 0)).cast("long")
    sizes = sizes.select(*keys, "n", width.alias("k"))
    start = rows.join(sizes, keys).filter(F.col("pos") + F.col("k") < F.col("n"))
    end = rows.select(*keys, (F.col("pos")).alias("__to"), F.col("__rs").alias("__rs2"), F.col("__hs").alias("__hs2"))
    pairs = start.withColumn("__to", F.col("pos") + F.col("k")).join(end, [*keys, "__to"])
    r, h = F.col("__rs2") - F.col("__rs"), F.col("__hs2") - F.col("__hs")
    return pairs.agg(
        F.count_if((r == 0) != (h == 0)).alias("pk_errors"),
        F.count_if(r != h).alias("wd_errors"),
        F.count(F.lit(1)).alias("windows"),
    ).withColumns(
        {"pk": ratio(F.col("pk_errors"), F.col("windows")), "windowdiff": ratio(F.col("wd_errors"), F.col("windows"))}
    )


# ---- ranking quality -----------------------------------------------------------------


def auc_ap(scores: DataFrame, score: str = "score", y: str = "y", by: Sequence[str] = (), block_rows: int = BLOCK_ROWS):
    """AUC (ties count half) and average precision of a score against 0 / 1, per group.

    Equal scores become one row first; the cumulative counts then run over blocks of
    distinct scores."""
    by = list(by)
    per = scores.groupBy(*by, score).agg(F.sum(y).alias("p"), F.count(F.lit(1)).alias("m")).withColumn("q", F.col("m") - F.col("p"))
    placed = ordinal(per, by, [score], "pos", block_rows)
    rows = running(
        placed, by, "pos", [Running("cp", F.col("p"), "sum"), Running("cq", F.col("q"), "sum")], block_rows
    )
    totals = per.groupBy(*by).agg(F.sum("p").alias("__p"), F.sum("q").alias("__q"))
    rows = rows.join(totals, by) if by else with_row(rows, totals)
    tp = F.col("__p") - F.col("cp") + F.col("p")
    fp = F.col("__q") - F.col("cq") + F.col("q")
    return rows.groupBy(*by).agg(
        ratio(F.sum(F.col("p") * (F.col("cq") - F.col("q") / 2)), F.max("__p") * F.max("__q")).alias("auc"),
        ratio(F.sum(F.col("p") * tp / (tp + fp)), F.max("__p")).alias("ap"),
        F.max("__p").alias("positives"),
        F.max("__q").alias("negatives"),
    )


def log_loss(p: Column, y: Column) -> Column:
    """Aggregate: mean soft log-loss."""
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q)))


def hit_p_r_at_k(answers: DataFrame, k: int = 5, mode: str = "mode") -> DataFrame:
    """Hit@k, P@k, R@k per mode and pooled (mode null) over queries with something
    relevant; ``answers`` has arrays ``retrieved`` and ``relevant``."""
    scored = answers.filter(F.size("relevant") > 0).withColumn("__got", F.slice("retrieved", 1, k))
    right = common("__got", "relevant")
    return scored.rollup(mode).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg((right > 0).cast("double")).alias("hit"),
        F.avg(right / k).alias("precision"),
        F.avg(right / F.size("relevant")).alias("recall"),
    )


def label_hits(answers: DataFrame, mode: str = "mode") -> DataFrame:
    """Label Hit@1 / Hit@3 of the answerable queries and how often was abstained, rightly
    (nothing expected) and wrongly, per mode and pooled."""
    can = F.size("expected") > 0
    top = lambda n: F.arrays_overlap(F.slice("ranked", 1, n), F.col("expected")).cast("double")
    return answers.rollup(mode).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.when(can, top(1))).alias("hit1"),
        F.avg(F.when(can, top(3))).alias("hit3"),
        F.avg(F.when(~can, F.col("abstained").cast("double"))).alias("abstained"),
        F.avg(F.when(can, F.col("abstained").cast("double"))).alias("wrongly_abstained"),
    )


def claim_precision(hits: DataFrame) -> DataFrame:
    """Of the retrieved items marked primary or passing for the answer's label, the share
    whose gold has it; ``hits`` has label, primary, secondary, gold."""
    kind = F.when(F.col("primary") == F.col("label"), "primary").when(
        F.array_contains("secondary", F.col("label")), "passing"
    )
    marked = hits.withColumn("kind", kind).filter("kind IS NOT NULL")
    right = F.array_contains("gold", F.col("label")).cast("int")
    return marked.groupBy("kind").agg(F.sum(right).alias("right"), F.count(F.lit(1)).alias("n")).withColumn(
        "precision", ratio(F.col("right"), F.col("n"))
    )


# ---- reports -------------------------------------------------------------------------


def coverage_report(items: DataFrame, view: DataFrame) -> DataFrame:
    """Per sequence: items, reviewed items, label mentions, and whether all is reviewed.
    ``items(item, seq)``, ``view(item, label)``."""
    per_item = view.groupBy("item").agg(F.count_if(~F.col("label").isin("", "NONE")).alias("mentions"))
    return (
        items.join(per_item, "item", "left")
        .groupBy("seq")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count("mentions").alias("reviewed"),
            F.coalesce(F.sum("mentions"), F.lit(0)).alias("mentions"),
        )
        .withColumn("complete", F.col("reviewed") >= F.col("items"))
    )


def projection(report: DataFrame, total: int) -> DataFrame:
    """Mentions to expect over ``total`` sequences, from the completed ones."""
    return report.filter("complete").agg(
        F.count(F.lit(1)).alias("done"),
        F.avg("mentions").alias("per_sequence"),
        (F.avg("mentions") * total).alias("projected"),
    )


def tier_distribution(view: DataFrame, tier: str = "tier") -> DataFrame:
    counts = view.filter(~F.col("label").isin("", "NONE")).groupBy(tier).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return with_row(counts, total).select(tier, "n", (F.col("n") / F.col("__all")).alias("share"))


def deal_folds(groups: DataFrame, k: int, group: str = "seq", stratum: str = "stratum", seed: str = "0") -> DataFrame:
    """Groups dealt to k folds like cards: shuffled by digest inside a stratum, the counter
    running on over the strata from the largest down; the calibration fold is the next one."""
    keyed = groups.withColumn("__h", md5_draw(F.concat_ws("-", F.lit(seed), group), 1 << 31))
    placed = ordinal(keyed, [stratum], ["__h", group], "__place")
    sizes = groups.groupBy(stratum).agg(F.count(F.lit(1)).alias("__n"))
    # one row per stratum: a small window
    before = Window.orderBy(F.desc("__n"), stratum).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("__s", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    fold = (F.col("__s") + F.col("__place")) % k
    return placed.join(starts, stratum).select(
        *groups.columns, fold.cast("int").alias("fold"), ((fold + 1) % k).cast("int").alias("calibration")
    )


def stratified_sample(items: DataFrame, sizes: dict, stratum: str, key: str, exclude: DataFrame, seed: str = "0") -> DataFrame:
    """``sizes[stratum]`` items per stratum in digest order, none of ``exclude``. The rank
    filter is applied before the shuffle too, so a large stratum sends few rows."""
    pool = items.join(exclude.select(key), key, "left_anti").withColumn("__h", F.md5(F.concat_ws("-", F.lit(seed), key)))
    quota = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n))])
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("__h", key))
    drawn = pool.withColumn("rank", rank).filter(F.col("rank") <= max(sizes.values()))
    return drawn.filter(F.col("rank") <= F.coalesce(F.try_element_at(quota, F.col(stratum)), F.lit(0))).drop("__h")


def second_raters(sample: DataFrame, raters: Sequence[str], first: str = "first_annotator", order: str = "rank") -> DataFrame:
    """A second rater for each item, round-robin over those who are not its first."""
    others = F.filter(F.array(*map(F.lit, sorted(raters))), lambda r: r != F.col(first))
    return sample.withColumn(
        "second_annotator", F.get(others, ((F.col(order) - 1) % F.size(others)).cast("int"))
    )


def cost_shares(usage: DataFrame, items: DataFrame, by: str = "system") -> DataFrame:
    """Tokens times price per group, shared out over the sequences by their item counts:
    ``usage(by, tokens_in, tokens_out, price_in, price_out)`` per million, ``items(by, seq, n)``."""
    priced = usage.withColumn(
        "cost", F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")
    )
    totals = items.groupBy(by).agg(F.sum("n").alias("__all"))
    return items.join(totals.join(priced, by), by).select(by, "seq", (F.col("cost") * F.col("n") / F.col("__all")).alias("cost"))


def groundedness(verdicts: DataFrame, answer: str = "answer", kind: str = "kind") -> DataFrame:
    """Per answer: mean claim weight (supported 1, partial 0.5, unsupported 0)."""
    weight = F.when(F.col("verdict") == "supported", 1.0).when(F.col("verdict") == "partial", 0.5).otherwise(0.0)
    return verdicts.groupBy(kind, answer).agg(
        F.avg(weight).alias("groundedness"),
        F.count(F.lit(1)).alias("claims"),
        F.count_if(F.col("verdict") == "unsupported").alias("unsupported"),
    )


def groundedness_by_kind(per_answer: DataFrame, kind: str = "kind") -> DataFrame:
    return per_answer.groupBy(kind).agg(
        F.count(F.lit(1)).alias("answers"),
        F.avg("groundedness").alias("groundedness"),
        F.count_if(F.col("groundedness") == 1.0).alias("fully_grounded"),
        F.count_if(F.col("unsupported") > 0).alias("with_unsupported"),
    )


def micro_macro(per_sequence: DataFrame) -> DataFrame:
    """Pooled and mean scores from per-sequence tp / fp / fn."""
    scored = per_sequence.withColumns(prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))
    one = scored.agg(
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")],
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
    )
    micro = prf_columns(F.col("tp"), F.col("fp"), F.col("fn"))
    return one.select(*[v.alias(f"micro_{k}") for k, v in micro.items()], "macro_precision", "macro_recall", "macro_f1")


def sequence_sets(items: DataFrame, gold: str = "gold", pred: str = "pred", keys: Sequence[str] = ("seq",)) -> DataFrame:
    """Per sequence: tp / fp / fn of the label sets found anywhere in it."""
    pairs = items.select(*keys, F.explode(F.array_distinct(gold)).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(
        items.select(*keys, F.explode(F.array_distinct(pred)).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"))
    )
    per = pairs.groupBy(*keys, "label").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return per.groupBy(*keys).agg(
        F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"),
        F.count_if((F.col("g") == 0) & (F.col("p") == 1)).alias("fp"),
        F.count_if((F.col("g") == 1) & (F.col("p") == 0)).alias("fn"),
    )


def teacher_stats(rows: DataFrame, by: Sequence[str] = (), y: str = "y", flag: str = "flag", score: str = "score") -> DataFrame:
    """Accuracy, recall, false-flag rate, kappa and AUC of a 0/1 flag with a score."""
    by = list(by)
    yes, no = F.col(y) == 1, F.col(y) == 0
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_off"), F.sum(flag).alias("n_flag"),
        F.avg((F.col(y) == F.col(flag)).cast("double")).alias("accuracy"),
        F.avg(F.when(yes, F.col(flag))).alias("recall"), F.avg(F.when(no, F.col(flag))).alias("false_flags"),
    )
    n = F.col("n").cast("double")
    pe = (F.col("n_off") * F.col("n_flag") + (n - F.col("n_off")) * (n - F.col("n_flag"))) / (n * n)
    counts = counts.withColumn("kappa", F.when(pe < 1, (F.col("accuracy") - pe) / (1 - pe)))
    quality = auc_ap(rows, score, y, by).select(*by, "auc")
    return (counts.join(quality, by) if by else with_row(counts, quality)).drop("n_flag")


def layer_report(
    items: DataFrame, layer: str = "layer", tier: str = "tier", out: str = "out", fallback: str = "fallback", gold: str = "gold", by: Sequence[str] = ()
) -> DataFrame:
    """Per layer and tier, and pooled (null): items decided and their share of all items of the group, right ones, right ones had the fallback
    decided, and strict F1 of what was decided and of the fallback on the same items. ``by`` names groups, such as the language."""
    sides = {"": out, "fallback_": fallback}
    counts = [c.alias(f"__{side}{n}") for side, pred in sides.items() for c, n in zip(strict_counts(gold, pred), ("tp", "fp", "fn"), strict=True)]
    sets = [[*by, layer, tier], [*by, layer], [*by, tier], list(by)]
    rows = items.groupingSets(sets, *by, layer, tier).agg(
        F.count(F.lit(1)).alias("accepted"), F.count_if(same(out, gold)).alias("right"), F.count_if(same(fallback, gold)).alias("fallback_right"), *counts,
        F.grouping(layer).cast("int").alias("all_layers"), F.grouping(tier).cast("int").alias("all_tiers"),
    )
    whole = rows.filter("all_layers = 1 AND all_tiers = 1").select(*by, F.col("accepted").alias("__all"))
    rows = rows.join(whole, list(by)) if by else with_row(rows, whole)
    f1 = {f"{side}f1": prf_columns(*[F.col(f"__{side}{n}") for n in ("tp", "fp", "fn")])["f1"] for side in sides}
    rows = rows.withColumns({"share": ratio(F.col("accepted"), F.col("__all")), **f1})
    return rows.select(*by, layer, tier, "all_layers", "all_tiers", "accepted", "share", "right", "fallback_right", "f1", "fallback_f1")


def unseen_label_score(items: DataFrame, split_at: int, by: Sequence[str] = (), gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Scores on the items whose gold has a label above ``split_at``."""
    return prf(items.filter(F.exists(gold, lambda v: v > split_at)), by, gold, pred)


def off_report(items: DataFrame, group: str, gold: str = "gold", pred: str = "pred", cost: str = "cost", answered: str = "answered") -> DataFrame:
    """Per group and pooled (group null): empty items that got a label, labelled items left without, items without an answer
    (``answered`` false or null), answers that could not be read (answered, but ``pred`` null), and cost."""
    empty = F.size(gold) == 0
    got = F.coalesce(F.size(pred), F.lit(0)) > 0
    came = F.coalesce(F.col(answered), F.lit(False))
    return items.rollup(group).agg(
        F.count_if(empty).alias("empty_items"),
        F.count_if(empty & got).alias("false_labels"),
        F.count_if(~empty).alias("labelled_items"),
        F.count_if(~empty & ~got).alias("missed"),
        F.count_if(~came).alias("missing_answers"),
        F.count_if(came & F.col(pred).isNull()).alias("unparsed_answers"),
        F.sum(cost).alias("cost"),
    )
