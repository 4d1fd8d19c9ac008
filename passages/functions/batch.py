"""Arrow-batched Python functions that are evaluated once per row."""

from __future__ import annotations

from collections.abc import Callable
from inspect import signature
from typing import Iterator, Tuple

import pandas as pd
from pyspark.sql import functions as F

FEW_ROWS = 200


def batch_udf(returns: str, rows: int | None = None) -> Callable:
    """``pandas_udf`` that the optimiser neither repeats nor moves.

    A filter on the result, or the 'array is not empty' filter Spark infers for an explode,
    would otherwise be pushed below and call the function a second time. Arguments should
    be columns or fields, not expressions with lambdas. With ``rows``, the function gets so many
    rows at a time, and its results leave before the next ones are made: for results as large as the texts."""

    def wrap(fn: Callable):
        if rows is None:
            return F.pandas_udf(fn, returns).asNondeterministic()

        def part(s: pd.Series, at: int) -> pd.Series:
            return s.iloc[at : at + rows].reset_index(drop=True)

        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                for at in range(0, len(s), rows):
                    yield fn(part(s, at))

        def several(batches: Iterator[Tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                for at in range(0, len(columns[0]), rows):
                    yield fn(*[part(s, at) for s in columns])

        return F.pandas_udf(one if len(signature(fn).parameters) == 1 else several, returns).asNondeterministic()

    return wrap
