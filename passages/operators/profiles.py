"""Meaning profiles of labels and the scores of items against them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.functions import vectors as V
from passages.operators.scan import BLOCK_ROWS, block_of, neighbours

KEYS = ("seq",)
MAX_ENTRIES = 20_000


def vector_sum(v: str) -> Column:
    """Aggregate: element-wise sum, with map-side partial sums."""
    return vector_to_array(Summarizer.sum(F.col(v)))


def profile_sums(
    items: DataFrame, anchors: str = "anchors", vector: str = "vector", follow: int = 2, stop: bool = False,
    keys: Sequence[str] = KEYS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(keys, label, total, n): sum and count of the vectors of each anchor item and the
    ``follow`` items after it. ``stop`` ends that stretch at another label's anchor."""
    none = F.array().cast("array<int>")
    earlier = [f"__a{k}" for k in range(1, follow + 1)]
    rows = neighbours(
        items, keys, "pos",
        lambda w: {c: F.lag(anchors, k + 1).over(w) for k, c in enumerate(earlier)}, follow, 0, block_rows,
    )
    own = [F.col(anchors)]
    for k, c in enumerate(earlier, start=1):
        labels = F.coalesce(c, none)
        if stop:
            between = [anchors, *earlier[: k - 1]]
            clear = lambda v: sum(
                (F.size(F.array_except(F.coalesce(x, none), F.array(v))) for x in between), F.lit(0)
            )
            labels = F.filter(labels, lambda v: clear(v) == 0)
        own.append(labels)
    pairs = rows.select(*keys, F.explode(F.concat(*own)).alias("label"), array_to_vector(V.doubles(vector)).alias("__v"))
    return pairs.groupBy(*keys, "label").agg(vector_sum("__v").alias("total"), F.count(F.lit(1)).alias("n"))


def corpus_totals(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, total, n) over all sequences."""
    v = sums.withColumn("__v", array_to_vector("total"))
    return v.groupBy(*by, "label").agg(vector_sum("__v").alias("total"), F.sum("n").alias("n"))


def minus(a: Column, b: Column) -> Column:
    return F.when(b.isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x - y))


def loo_profiles(
    sums: DataFrame, texts: DataFrame, alpha: float = 0.5, keys: Sequence[str] = KEYS, by: Sequence[str] = ()
) -> DataFrame:
    """(keys, label, profile) for the sequences that have anchors of the label: the corpus
    sum without the sequence's own part, mixed with the entry's ``text_vector``; the
    ``fallback`` vector stands in where nothing is left. ``by`` pools within groups (a
    language) that are columns of ``sums``."""
    total = corpus_totals(sums, by).withColumnsRenamed({"total": "__all", "n": "__n"})
    rows = sums.join(total, [*by, "label"]).join(texts, "label")
    return rows.select(
        *keys, *by, "label", mixed(minus(F.col("__all"), F.col("total")), F.col("__n") - F.col("n"), alpha).alias("profile")
    )


def mixed(total: Column, n: Column, alpha: float) -> Column:
    base = F.when(n > 0, V.l2_normalise(total)).otherwise(V.doubles("fallback"))
    return V.l2_normalise(F.zip_with(base, V.doubles("text_vector"), lambda c, t: (1 - alpha) * c + alpha * t))


def label_profiles(sums: DataFrame, texts: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(label, profile) over all sequences, for every entry of the catalogue."""
    total = corpus_totals(sums)
    rows = texts.join(total, "label", "left")
    zero = F.transform(V.doubles("text_vector"), lambda x: x * 0)
    rows = rows.withColumn("total", F.coalesce("total", zero)).withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("label", mixed(F.col("total"), F.col("n"), alpha).alias("profile"))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=-1, keepdims=True)
    return m / np.where(n > 0, n, 1)


def meaning_scores(
    items: DataFrame, sums: DataFrame, texts: DataFrame, alpha: float = 0.5, vector: str = "vector",
    keys: Sequence[str] = KEYS, block_rows: int = 20_000,
) -> DataFrame:
    """(keys, pos, cos, z, gain): arrays over the catalogue's labels in order, each item
    against the profiles that leave its own sequence out.

    The catalogue (labels x dimensions) is checked to be small and goes to the tasks; a
    sequence's own sums meet its items block by block, so a long sequence stays split."""
    keys = list(keys)
    catalogue = texts.join(corpus_totals(sums), "label", "left").limit(MAX_ENTRIES + 1).toPandas()
    if len(catalogue) > MAX_ENTRIES:
        raise ValueError("the label catalogue is too large to send to the tasks")
    catalogue = catalogue.sort_values("label")
    dim = len(catalogue["text_vector"].iloc[0])
    labels = {int(v): i for i, v in enumerate(catalogue["label"])}
    stack = lambda c: np.stack([np.asarray(x, dtype=float) for x in catalogue[c]])
    text, fallback = stack("text_vector"), stack("fallback")
    total = np.stack([np.zeros(dim) if x is None or np.ndim(x) == 0 else np.asarray(x) for x in catalogue["total"]])
    count = catalogue["n"].fillna(0).to_numpy()

    blocks = items.select(*keys, "pos", F.col(vector).alias("__v"), block_of("pos", block_rows).alias("__block"))
    extent = blocks.groupBy(*keys).agg(F.max("__block").alias("__last"))
    mine_keys = [f"__{k}" for k in keys]
    own = sums.join(extent, keys).select(
        *[F.col(k).alias(f"__{k}") for k in keys], "label", "total", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__last"))).alias("__block")
    )

    def score(pdf: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        t, n = total.copy(), count.copy()
        for label, v, k in zip(mine["label"], mine["total"], mine["n"], strict=True):
            t[labels[int(label)]] -= np.asarray(v)
            n[labels[int(label)]] -= k
        base = np.where((n > 0)[:, None], _unit(t), fallback)
        mu = _unit((1 - alpha) * base + alpha * text)
        cos = np.stack([np.asarray(v, dtype=float) for v in pdf["__v"]]) @ mu.T
        std = cos.std(axis=1, keepdims=True)
        z = np.where(std > 0, (cos - cos.mean(axis=1, keepdims=True)) / np.where(std > 0, std, 1), 0.0)
        out = pdf[keys + ["pos"]].copy()
        out["cos"], out["z"] = list(cos), list(z)
        out["gain"] = list(np.diff(cos, axis=1, prepend=cos[:, :1]))
        return out

    arrays = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("cos", "z", "gain")]
    schema = T.StructType([items.schema[k] for k in keys] + [items.schema["pos"], *arrays])
    return blocks.groupBy(*keys, "__block").cogroup(own.groupBy(*mine_keys, "__block")).applyInPandas(score, schema)


def adjacent_cosine(
    items: DataFrame, vector: str = "vector", keys: Sequence[str] = KEYS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """``adjacent``: cosine to the item before, 1 for the first."""
    rows = neighbours(items, keys, "pos", lambda w: {"__before": F.lag(vector).over(w)}, 1, 0, block_rows)
    return rows.withColumn("adjacent", F.coalesce(V.dot(vector, "__before"), F.lit(1.0))).drop("__before")


def window_concat(
    items: DataFrame, dim: int, vector: str = "vector", around: int = 2, keys: Sequence[str] = KEYS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``window``: the vectors of the items around, zeros outside the sequence, then one
    flag per neighbour that is missing."""
    steps = [k for k in range(-around, around + 1) if k]
    name = lambda k: f"__n{k + around}"
    rows = neighbours(
        items, keys, "pos",
        lambda w: {name(k): (F.lag(vector, -k) if k < 0 else F.lead(vector, k)).over(w) for k in steps}, around, around, block_rows,
    )
    zeros = F.array_repeat(F.lit(0.0), dim)
    parts = [V.doubles(vector) if k == 0 else F.coalesce(V.doubles(name(k)), zeros) for k in range(-around, around + 1)]
    flags = F.array(*[F.col(name(k)).isNull().cast("double") for k in steps])
    return rows.withColumn("window", F.concat(*parts, flags)).drop(*[name(k) for k in steps])


def pair_features(items: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per (item, label) from equally long array columns, label = array index."""
    return items.select(*keep, F.posexplode(F.arrays_zip(*columns)).alias("label", "__z")).select(
        *keep, "label", *[F.col(f"__z.{c}").alias(c) for c in columns]
    )


def item_features(string: str, cos: str, recency: str, anchors: str) -> dict[str, Column]:
    """Signals for 'this item has no label'."""
    return {
        "max_string": F.array_max(string),
        "max_cos": F.array_max(cos),
        "max_recency": F.array_max(recency),
        "any_anchor": (F.size(anchors) > 0).cast("int"),
    }


def abstention_statistics(scores: str) -> dict[str, Column]:
    """Top score, lead over the second, and its distance from the mean in deviations."""
    ranked = F.sort_array(scores, asc=False)
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    s = V.std_of(scores)
    return {
        "abs": top,
        "margin": top - second,
        "z": F.when(s > 0, (top - V.mean_of(scores)) / s).otherwise(F.lit(0.0)),
    }
