"""Vector expressions on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def each(v: Column, stats: dict[str, Column], entry: Callable[[Column, Column], Column]) -> Column:
    """Transform the entries of ``v`` with values that are worked out once per array: a
    lambda would work them out again for each entry."""
    bound = F.array(F.struct(v.alias("v"), *[c.alias(n) for n, c in stats.items()]))
    return F.get(F.transform(bound, lambda b: F.transform(b["v"], lambda x: entry(x, b))), F.lit(0))


def l2_normalise(v: Column | str) -> Column:
    """Unit length; a zero vector stays zero."""
    return each(doubles(v), {"n": norm(v)}, lambda x, b: F.when(b["n"] > 0, x / b["n"]).otherwise(F.lit(0.0)))


def mean_of(v: Column | str) -> Column:
    return F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x) / F.size(v)


def std_of(v: Column | str) -> Column:
    """Population standard deviation of an array."""
    squares = each(doubles(v), {"m": mean_of(v)}, lambda x, b: (x - b["m"]) * (x - b["m"]))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(v))


def z_scores(v: Column | str, guard: float = 0.0) -> Column:
    """(x - mean) / std per entry, 0 where the entries are all equal; ``guard`` is added to
    the deviation."""
    return each(
        doubles(v),
        {"m": mean_of(v), "s": std_of(v) + guard},
        lambda x, b: F.when(b["s"] > 0, (x - b["m"]) / b["s"]).otherwise(F.lit(0.0)),
    )


def gains(v: str) -> Column:
    """Each entry less the one before it, 0 for the first."""
    return F.transform(v, lambda x, i: F.when(i == 0, F.lit(0.0)).otherwise(x - F.get(F.col(v), i - 1)))
