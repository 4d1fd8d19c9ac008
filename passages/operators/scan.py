"""Running values, neighbours and positions for sequences of any length.

A window over a whole sequence puts the sequence into one task, and one sequence may hold
a third of all rows. Everything here therefore cuts a sequence into blocks of bounded
length by position, works inside the blocks, and passes only a block's summary on:

* ``ordinal``    dense 0-based positions from any order key;
* ``running``    prefix sums, running maxima, last / next non-null value;
* ``neighbours`` window expressions over a few rows either side (lag, lead, moving mean).

``pos`` columns are dense: 0, 1, 2, ... inside each sequence, as ``ordinal`` makes them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from passages.session import checkpoint_dir

BLOCK_ROWS = 100_000
LONGEST = "longest"
_BLOCK = "__block"


@dataclass(frozen=True)
class Running:
    """One running value: ``how`` is sum, max, min, last (non-null so far) or next
    (first non-null from here on); ``strict`` leaves the current row out."""

    name: str
    value: Column
    how: str
    strict: bool = False


def block_of(pos: str, block_rows: int) -> Column:
    return F.floor(F.col(pos) / F.lit(block_rows)).cast("long")


def one_block(df: DataFrame, pos: str, block_rows: int) -> bool:
    """Whether the position column is known to stay inside the first block."""
    return df.schema[pos].metadata.get(LONGEST, block_rows + 1) <= block_rows


def _whole(keys: Sequence[str], pos: str) -> WindowSpec:
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(pos)


def _local(agg: Running, tmp: str, window: WindowSpec) -> Column:
    edge = 1 if agg.strict else 0
    value = F.col(tmp)
    if agg.how == "next":
        return F.first(value, ignorenulls=True).over(window.rowsBetween(edge, Window.unboundedFollowing))
    frame = window.rowsBetween(Window.unboundedPreceding, -edge)
    if agg.how == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min}[agg.how](value).over(frame)


def _summary(agg: Running, tmp: str, pos: str) -> Column:
    value = F.col(tmp)
    if agg.how == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.col(pos)))
    if agg.how == "next":
        return F.min_by(value, F.when(value.isNotNull(), F.col(pos)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[agg.how](value)


def _carried(agg: Running, tmp: str, window: WindowSpec) -> Column:
    value = F.col(tmp)
    if agg.how == "next":
        return F.first(value, ignorenulls=True).over(window.rowsBetween(1, Window.unboundedFollowing))
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    if agg.how == "last":
        return F.last(value, ignorenulls=True).over(frame)
    return {"sum": F.sum, "max": F.max, "min": F.min}[agg.how](value).over(frame)


def _combine(agg: Running, here: Column, carried: Column) -> Column:
    if agg.how == "sum":
        return F.when(here.isNull(), carried).when(carried.isNull(), here).otherwise(here + carried)
    if agg.how == "max":
        return F.greatest(here, carried)
    if agg.how == "min":
        return F.least(here, carried)
    return F.coalesce(here, carried)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    aggs: Sequence[Running],
    block_rows: int = BLOCK_ROWS,
    block: Column | None = None,
) -> DataFrame:
    """``df`` plus one column per running value, in ``pos`` order inside ``keys``.

    Where all sequences fit one block, this is a window per sequence, and several such
    calls share one shuffle. Otherwise rows shuffle once by (keys, block); the second shuffle carries one row per block. A
    block is ``pos div block_rows`` unless the caller names another one that grows with
    ``pos``. ``keys`` may be empty: then the whole table is one sequence.
    """
    keys = list(keys)
    if block is None and one_block(df, pos, block_rows):
        whole = _whole(keys, pos)
        tmp = {agg.name: f"__v{i}" for i, agg in enumerate(aggs)}
        rows = df.withColumns({tmp[agg.name]: agg.value for agg in aggs})
        return rows.withColumns({agg.name: _local(agg, tmp[agg.name], whole) for agg in aggs}).drop(*tmp.values())
    tmp = {agg.name: f"__v{i}" for i, agg in enumerate(aggs)}
    rows = df.withColumns(
        {_BLOCK: block_of(pos, block_rows) if block is None else block}
        | {tmp[agg.name]: agg.value for agg in aggs}
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(pos)
    across = Window.partitionBy(*keys).orderBy(_BLOCK)
    local = rows.withColumns({f"__l{i}": _local(agg, tmp[agg.name], inside) for i, agg in enumerate(aggs)})
    summary = rows.groupBy(*keys, _BLOCK).agg(
        *[_summary(agg, tmp[agg.name], pos).alias(tmp[agg.name]) for agg in aggs]
    )
    carried = summary.select(
        *keys, _BLOCK, *[_carried(agg, tmp[agg.name], across).alias(f"__c{i}") for i, agg in enumerate(aggs)]
    )
    # a sequence that fits one block carries nothing, and drops out of the join's small side
    something = F.lit(False)
    for i in range(len(aggs)):
        something = something | F.col(f"__c{i}").isNotNull()
    carried = carried.filter(something)
    joined = local.join(carried, [*keys, _BLOCK], "left")
    return joined.select(
        *df.columns,
        *[
            _combine(agg, F.col(f"__l{i}"), F.col(f"__c{i}")).alias(agg.name)
            for i, agg in enumerate(aggs)
        ],
    )


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df`` plus window columns that look at most ``before`` / ``after`` rows away.

    Rows near a block edge are also sent to the adjacent block, so one shuffle by
    (keys, block) is enough however long a sequence is.
    """
    if before >= block_rows or after >= block_rows:
        raise ValueError("a block must be longer than the neighbourhood")
    if one_block(df, pos, block_rows):
        return df.withColumns(columns(_whole(keys, pos)))
    own = block_of(pos, block_rows)
    offset = F.col(pos) % block_rows
    copies = F.array(
        own,
        F.when(offset >= block_rows - before, own + 1) if before else F.lit(None).cast("long"),
        F.when(offset < after, own - 1) if after else F.lit(None).cast("long"),
    )
    spread = df.withColumn(_BLOCK, F.explode(F.array_compact(copies)))
    window = Window.partitionBy(*keys, _BLOCK).orderBy(pos)
    return spread.withColumns(columns(window)).filter(F.col(_BLOCK) == own).drop(_BLOCK)


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "pos",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Dense 0-based position of each row in its sequence, in the order of ``order``.

    The sequences are counted first (one pass over the keys). If all fit a block, one window
    does it. Otherwise the table is dealt in the order of the keys and all order columns, of
    any type, into parts of about a block, and numbered part by part; which part a row is in
    comes from a sample, so it is written to the checkpoint folder. The length of the longest
    sequence goes along as metadata of the position column, and spares ``running`` and
    ``neighbours`` their blocks where there is only one.
    """
    if not keys:
        return ordinal(df.withColumn("__all", F.lit(0)), ["__all"], order, name, block_rows).drop("__all")
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    longest = int(sizes.agg(F.max("__n")).first()[0] or 0)
    if longest <= block_rows:
        position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
        return df.withColumn(name, position.cast("long").alias(name, metadata={LONGEST: longest}))

    spark = df.sparkSession
    checkpoint_dir(spark)
    total = int(sizes.agg(F.sum("__n")).first()[0])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // block_rows))
    dealt = df.repartitionByRange(parts, *keys, *order)
    blocked = dealt.withColumn(_BLOCK, F.spark_partition_id().cast("long")).checkpoint()
    counts = blocked.groupBy(*keys, _BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        counts.withColumn("__start", F.sum("__n").over(before)).filter(F.col("__start").isNotNull()).drop("__n")
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(*order)
    position = F.coalesce(F.col("__start"), F.lit(0)) + F.col("__r") - 1
    placed = (
        blocked.withColumn("__r", F.row_number().over(inside))
        .join(starts, [*keys, _BLOCK], "left")
        .withColumn(name, position.cast("long").alias(name, metadata={LONGEST: longest}))
        .drop(_BLOCK, "__r", "__start")
    )
    # what follows reads long sequences twice per running value: from here, not from the source
    return placed.checkpoint()
