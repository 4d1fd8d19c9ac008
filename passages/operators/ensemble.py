"""Combining the labels of several systems item by item."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.operators.evaluate import missing, prf_columns, same, strict_counts, with_row


@dataclass(frozen=True)
class Layer:
    """A system that decides the items where ``accepts`` holds, with the labels in ``labels``."""

    name: str
    accepts: Column
    labels: str


def override_cascade(items: DataFrame, layers: Sequence[Layer], fallback: str, rest: str = "fallback") -> DataFrame:
    """``layer`` and ``out``: the first layer that accepts decides, the fallback takes the rest."""
    layer, out = F.lit(rest), F.col(fallback)
    for one in reversed(layers):
        layer = F.when(one.accepts, F.lit(one.name)).otherwise(layer)
        out = F.when(one.accepts, F.col(one.labels)).otherwise(out)
    return items.withColumns({"layer": layer, "out": out})


def _advantage(layers: Sequence[Layer], fallback: str, gold: str) -> dict[tuple[int, tuple[int, ...]], Column]:
    """For each layer and each set of earlier layers that were kept: how many more items it
    gets right than the fallback, of those it would accept."""
    gain = [same(one.labels, gold).cast("long") - same(fallback, gold).cast("long") for one in layers]
    sums = {}
    for i, one in enumerate(layers):
        for r in range(i + 1):
            for kept in combinations(range(i), r):
                free = one.accepts
                for j in kept:
                    free = free & ~F.coalesce(layers[j].accepts, F.lit(False))
                sums[i, kept] = F.coalesce(F.sum(F.when(free, gain[i])), F.lit(0))
    return sums


def _name(i: int, kept: tuple[int, ...]) -> str:
    return f"__d{i}_" + "".join(map(str, kept))


def _decisions(layers: Sequence[Layer], value) -> list[Column]:
    """keep flag per layer, in order: at least as many right as the fallback, on what the
    kept layers before it leave; a layer that accepts nothing is kept."""
    keep: list[Column] = []
    for i in range(len(layers)):
        flag = F.lit(None).cast("boolean")
        for r in range(i + 1):
            for kept in combinations(range(i), r):
                state = F.lit(True)
                for j in range(i):
                    state = state & (keep[j] if j in kept else ~keep[j])
                flag = F.when(state, value(i, kept) >= 0).otherwise(flag)
        keep.append(flag)
    return keep


def keep_rule(items: DataFrame, layers: Sequence[Layer], fallback: str, gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """One keep flag per layer (and group), from a single aggregation."""
    sums = _advantage(layers, fallback, gold)
    counts = items.groupBy(*by).agg(*[c.alias(_name(*k)) for k, c in sums.items()])
    flags = _decisions(layers, lambda i, kept: F.col(_name(i, kept)))
    return counts.select(*by, *[f.alias(one.name) for f, one in zip(flags, layers, strict=True)])


def keep_rule_cv(items: DataFrame, layers: Sequence[Layer], fallback: str, group: str, gold: str = "gold") -> DataFrame:
    """The keep flags for each group decided on all the others (total less own sums)."""
    sums = _advantage(layers, fallback, gold)
    own = items.groupBy(group).agg(*[c.alias(_name(*k)) for k, c in sums.items()])
    total = own.agg(*[F.sum(_name(*k)).alias("__t" + _name(*k)) for k in sums])
    rows = with_row(own, total)
    flags = _decisions(layers, lambda i, kept: F.col("__t" + _name(i, kept)) - F.col(_name(i, kept)))
    return rows.select(group, *[f.alias(one.name) for f, one in zip(flags, layers, strict=True)])


def design_shares(flags: DataFrame, layers: Sequence[str]) -> DataFrame:
    """How many folds keep each set of layers."""
    counts = flags.groupBy(*layers).agg(F.count(F.lit(1)).alias("folds"))
    total = counts.agg(F.sum("folds").alias("__all"))
    return with_row(counts, total).select(*layers, "folds", (F.col("folds") / F.col("__all")).alias("share"))


def veto_fill(own: str, external: str, p_off: str, conf: str, veto: float = 0.95, fill: float = 0.5) -> dict[str, Column]:
    """The external labels, filled with the own ones where they are empty and the own model
    is confident, emptied where the own model is sure there is no label."""
    empty = F.array().cast("array<int>")
    vetoed = (F.size(own) == 0) & (F.col(p_off) >= veto)
    filled = (F.size(external) == 0) & (F.size(own) > 0) & (F.col(conf) >= fill)
    return {
        "out": F.when(vetoed, empty).when(filled, F.col(own)).otherwise(F.col(external)),
        "layer": F.when(vetoed, "veto").when(filled, "fill").otherwise("external"),
    }


def confidence(labels: str, probs: str, p_off: str) -> Column:
    """Probability the model gives to its own first label, or to there being none."""
    total = F.aggregate(probs, F.lit(0.0), lambda s, p: s + p)
    on = (1 - F.col(p_off)) * F.get(F.col(probs), F.get(labels, F.lit(0))) / total
    return F.when(F.size(labels) == 0, F.col(p_off)).otherwise(on)


def hard_rule(own: str, votes: str, applies: Column) -> Column:
    """Where it applies: no own label stays none, otherwise the vote's labels if it has any."""
    use = applies & (F.size(own) > 0) & (F.coalesce(F.size(votes), F.lit(0)) > 0)
    return F.when(use, F.col(votes)).otherwise(F.col(own))


def bonus_share(probs: str, votes: str, weight: float) -> Column:
    """Scores of the voted labels multiplied by e^weight."""
    return F.transform(
        probs, lambda p, i: p * F.when(F.array_contains(votes, i), F.exp(F.lit(float(weight)))).otherwise(F.lit(1.0))
    )


def oracle_arbitration(systems: Sequence[str], gold: str = "gold") -> Column:
    """Name of the system with the fewest errors on the item, the first on ties."""
    errors = [missing(s, gold) + missing(gold, s) for s in systems]
    best = F.least(*errors) if len(errors) > 1 else errors[0]
    pick = F.lit(None).cast("string")
    for s, e in reversed(list(zip(systems, errors, strict=True))):
        pick = F.when(e == best, s).otherwise(pick)
    return pick


def self_consistency(items: DataFrame, a: str, b: str, own: str, conf: str, threshold: float = 0.9, gold: str = "gold") -> DataFrame:
    """Per agreement of two runs: items, rights of each, and of the rule 'the run where they
    agree, else the confident own label, else the run'."""
    agree = same(a, b)
    rule = F.when(~agree & (F.col(conf) >= threshold), F.col(own)).otherwise(F.col(a))
    rows = items.withColumns({"agree": agree, "__rule": rule})
    return rows.groupBy("agree").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(same(a, gold)).alias("a_right"),
        F.count_if(same(b, gold)).alias("b_right"),
        F.count_if(same(own, gold)).alias("own_right"),
        F.count_if(same("__rule", gold)).alias("rule_right"),
        F.count_if(F.col(conf) >= threshold).alias("confident"),
    )


def disagreement_table(items: DataFrame, signal: str, a: str, b: str, gold: str = "gold") -> DataFrame:
    """Items where a and b differ: per signal x type (and their totals, null) how many, and
    who is right."""
    kind = F.when(F.size(a) == 0, "a none").when(F.size(b) == 0, "b none").otherwise("both label")
    differ = items.filter(~same(a, b)).withColumn("kind", kind)
    ra, rb = same(a, gold), same(b, gold)
    return differ.cube(signal, "kind").agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(ra).alias("a_right"),
        F.count_if(rb).alias("b_right"),
        F.count_if(~ra & ~rb).alias("both_wrong"),
    )


def adopt_per_language(items: DataFrame, a: str, b: str, language: str, sequence: str, gold: str = "gold") -> DataFrame:
    """Per language: adopt b if its F1 is at least a's and it is worse on at most half of
    the sequences."""
    names = [f"{c}_{s}" for s in "ab" for c in ("tp", "fp", "fn")]
    counts = strict_counts(gold, a) + strict_counts(gold, b)
    per = items.groupBy(language, sequence).agg(*[c.alias(n) for c, n in zip(counts, names, strict=True)])
    f1 = {s: prf_columns(*[F.col(f"{c}_{s}") for c in ("tp", "fp", "fn")])["f1"] for s in "ab"}
    worse = (f1["b"] < f1["a"]).cast("int")
    pooled = per.withColumn("__worse", worse).groupBy(language).agg(
        *[F.sum(n).alias(n) for n in names], F.sum("__worse").alias("worse"), F.count(F.lit(1)).alias("sequences")
    )
    return pooled.select(
        language, f1["a"].alias("f1_a"), f1["b"].alias("f1_b"), "worse", "sequences",
        ((f1["b"] >= f1["a"]) & (F.col("worse") <= F.col("sequences") / 2)).alias("adopt"),
    )


def neutralise_weak(p: str, confidence_level: str, weak_side: Column, full: int = 5) -> Column:
    """Evidence of one class below full confidence says nothing: 0.5."""
    return F.when(weak_side & (F.col(confidence_level) < full), F.lit(0.5)).otherwise(F.col(p))
