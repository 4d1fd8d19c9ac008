"""Append-only annotation logs: the current view, gold labels, adjudication, merging.

A log row is (item, annotator, label, tier, created_at, row_no): ``row_no`` is the row's
place in the log, label 'NONE' says the item has no label, 'RESET' starts over.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tiers from the most to the least faithful mention.
TIERS = ("T1", "T2", "T3", "T4", "T5")


def fidelity(tier: Column) -> Column:
    """Rank of a tier, 0 is the most faithful; NONE 5, anything unknown 9."""
    ranks = F.create_map(*[x for i, t in enumerate((*TIERS, "NONE")) for x in (F.lit(t), F.lit(i))])
    return F.coalesce(F.try_element_at(ranks, F.upper(F.trim(tier))), F.lit(9))


def latest_view(log: DataFrame) -> DataFrame:
    """The log as it stands: per (item, annotator, label) the newest row, the earlier one
    on equal times; NONE and real labels of one annotator exclude each other, NONE wins
    only if it is strictly newer."""
    others = [c for c in log.columns if c not in ("item", "annotator", "label")]
    newest = (
        log.withColumn("label", F.trim("label"))
        .groupBy("item", "annotator", "label")
        .agg(F.max_by(F.struct(*others), F.struct("created_at", -F.col("row_no"))).alias("r"))
        .select("item", "annotator", "label", "r.*")
    )
    # one row per label is left, so a window per (item, annotator) stays small
    own = Window.partitionBy("item", "annotator")
    is_none = F.col("label") == "NONE"
    none_at = F.max(F.when(is_none, F.col("created_at"))).over(own)
    real_at = F.max(F.when(~is_none, F.col("created_at"))).over(own)
    view = newest.withColumns({"__none": none_at, "__real": real_at})
    both = F.col("__none").isNotNull() & F.col("__real").isNotNull()
    keep = ~both | (is_none == (F.col("__none") > F.col("__real")))
    return view.filter(keep).drop("__none", "__real")


def gold(view: DataFrame) -> DataFrame:
    """One row per reviewed item: ``labels`` array<struct<label, tier>> with the most
    faithful tier of each label, empty for a reviewed item without one."""
    rank = fidelity(F.col("tier"))
    best = view.groupBy("item", "label").agg(
        F.min_by(F.upper(F.trim("tier")), F.struct(rank, "created_at", "row_no")).alias("tier")
    )
    real = F.when(~F.col("label").isin("", "NONE"), F.struct("label", "tier"))
    return best.groupBy("item").agg(F.array_sort(F.collect_list(real)).alias("labels"))


def malformed_tiers(view: DataFrame) -> DataFrame:
    """Rows whose tier is not one of the known ones: counted overall, in no tier."""
    return view.filter(~F.col("label").isin("", "NONE") & ~F.upper(F.trim("tier")).isin(*TIERS))


def after_reset(log: DataFrame) -> DataFrame:
    """Rows after the item's last RESET; rows at its time are gone too."""
    reset = log.filter(F.col("label") == "RESET").groupBy("item").agg(F.max("created_at").alias("__reset"))
    kept = log.filter(F.col("label") != "RESET").join(reset, "item", "left")
    return kept.filter(F.col("__reset").isNull() | (F.col("created_at") > F.col("__reset"))).drop("__reset")


def adjudicate(gold_items: DataFrame, log: DataFrame) -> DataFrame:
    """Gold where the expert's decisions replace those items' labels."""
    decided = gold(latest_view(after_reset(log))).withColumnRenamed("labels", "__decided")
    joined = gold_items.join(decided, "item", "left")
    return joined.select(
        "item", F.coalesce("__decided", "labels").alias("labels"), F.col("__decided").isNotNull().alias("adjudicated")
    )


def merge_logs(master: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` that ``master`` lacks (exact on ``key``, nulls equal), once each."""
    once = new.dropDuplicates(list(key))
    condition = F.lit(True)
    left, right = once.alias("n"), master.select(*key).alias("m")
    for c in key:
        condition = condition & F.col(f"n.{c}").eqNullSafe(F.col(f"m.{c}"))
    return left.join(right, condition, "left_anti")


def merge_report(master: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: rows offered, added and duplicate, and items with two or more annotators."""
    added = merge_logs(master, new, key)
    combined = master.select("item", "annotator").unionByName(added.select("item", "annotator"))
    shared = (
        combined.distinct().groupBy("item").agg(F.count(F.lit(1)).alias("n")).agg(
            F.count_if(F.col("n") > 1).alias("shared_items")
        )
    )
    offered = new.agg(F.count(F.lit(1)).alias("offered"))
    return (
        offered.join(F.broadcast(added.agg(F.count(F.lit(1)).alias("added"))))
        .join(F.broadcast(shared))
        .withColumn("duplicates", F.col("offered") - F.col("added"))
    )
