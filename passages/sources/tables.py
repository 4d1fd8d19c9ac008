"""Reading, checking and updating the tables: explicit schemas, no inference."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from passages.session import checkpoint_dir

SEGMENT_SCHEMA = "text string, full_transcript string, segments array<struct<start:double,end:double,text:string>>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """For work that is heavy per row: rows of a few files over all cores. An input that
    has a task per core already is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


# ---- scans ---------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str | Sequence[str], schema: str, **options) -> DataFrame:
    """CSV with a header and a given schema; several paths or a glob are one table. ``multiLine=True`` is for texts with
    line breaks in quotes, whose files are not split."""
    reader = spark.read.schema(schema).options(**({"header": True, "multiLine": False, "escape": '"'} | options))
    return reader.csv(path if isinstance(path, str) else list(path))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row per text file, named after the file without extension."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(F.url_decode(name).alias("file"), F.col("value").alias("text"))


def read_segment_json(spark: SparkSession, path: str, multiline: bool = True, keys: str = "") -> DataFrame:
    """Transcripts as JSON: ``text``, else ``full_transcript``, else the joined segments.
    ``keys`` is a schema for further columns."""
    schema = f"{keys}, {SEGMENT_SCHEMA}" if keys else SEGMENT_SCHEMA
    rows = spark.read.schema(schema).json(path, multiLine=multiline)
    joined = F.array_join(F.transform("segments", lambda s: F.trim(s["text"])), " ")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.withColumn("text", F.coalesce(blank("text"), blank("full_transcript"), joined)).drop("full_transcript")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def expected_labels(column: str) -> Column:
    """'a, b' or 'NONE' as an array of labels."""
    parts = F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: (x != "") & (F.upper(x) != "NONE"))
    return F.coalesce(F.array_distinct(parts), F.array().cast("array<string>"))


def read_questions(spark: SparkSession, path: str, schema: str, expected: str, layout: str = "json") -> DataFrame:
    """Questions with their expected labels as a set, from JSON lines or CSV; a question may have several lines."""
    rows = spark.read.schema(schema).json(path) if layout == "json" else read_table(spark, path, schema, multiLine=True)
    return rows.withColumn("expected", expected_labels(expected)).drop(*([expected] if expected != "expected" else []))


def union_tables(tables: Sequence[DataFrame], key: Sequence[str] | None = None) -> DataFrame:
    """Tables of one schema under each other; with ``key`` exact repeats of it once."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out.dropDuplicates(list(key)) if key else out


# ---- sinks ---------------------------------------------------------------------------


def write_by_key(df: DataFrame, path: str, key: str, max_records: int = 1_000_000, source: str = "parquet") -> None:
    """One folder per key; a frequent key is spread over files of bounded size."""
    df.write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy(key).format(source).save(path)


def upsert(current: DataFrame, new: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """The newest row per key of both, by ``version``; the new row on ties."""
    others = [c for c in current.columns if c not in key]
    both = current.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = both.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(version, "__new")).alias("r"))
    return newest.select(*key, "r.*").select(*current.columns)


def delete_where(current: DataFrame, condition: Column) -> DataFrame:
    """Rows the condition does not hold for (null counts as not holding)."""
    return current.filter(~F.coalesce(condition, F.lit(False)))


def replace_slice(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Index a slice again: all rows of the keys in ``new`` go, its rows come."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def incremental(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What has no saved answer yet."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")


def completeness(todo: DataFrame, done: DataFrame, key: Sequence[str], allowed: float = 0.02) -> DataFrame:
    """One row: how many are missing, and whether that is within the allowed share."""
    have = done.select(*key).distinct().withColumn("__done", F.lit(1))
    return todo.join(have, list(key), "left").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("__done").isNull()).alias("missing")
    ).withColumn("ok", F.col("missing") <= F.col("total") * allowed)


class Incomplete(ValueError):
    """Too many rows are without an answer."""


def write_complete(rows: DataFrame, path: str, answered: Column, allowed: float = 0.02) -> tuple[int, int]:
    """Write ``rows`` and count, while they are written, all rows and those without an answer: (total, missing).

    The counts come from the write itself, so nothing is read or computed twice. More than the allowed share missing raises
    ``Incomplete``; what was written stays, so that a later run can start from what there is. An empty table is complete."""
    seen = Observation()
    missing = F.count_if(~F.coalesce(answered, F.lit(False)))
    rows.observe(seen, F.count(F.lit(1)).alias("total"), missing.alias("missing")).write.mode("overwrite").parquet(path)
    total, lacking = int(seen.get["total"]), int(seen.get["missing"])
    if lacking > total * allowed:
        raise Incomplete(f"{lacking} of {total} rows have no answer, more than {allowed:.0%}")
    return total, lacking


# ---- checks --------------------------------------------------------------------------


def grid_diff(old: DataFrame, new: DataFrame, protected: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, change, labelled): rows that changed, vanished or appeared; a changed or
    vanished row that is already labelled must not be accepted."""
    digest = lambda side: F.struct(*[F.col(c) for c in columns]).alias(side)
    joined = old.select(key, digest("o")).join(new.select(key, digest("n")), key, "full_outer")
    change = (
        F.when(F.col("n").isNull(), "vanished")
        .when(F.col("o").isNull(), "new")
        .when(F.to_json("o") != F.to_json("n"), "changed")
    )
    diff = joined.select(key, change.alias("change")).filter("change IS NOT NULL")
    marked = diff.join(protected.select(key).distinct().withColumn("__p", F.lit(True)), key, "left")
    return marked.select(key, "change", (F.coalesce("__p", F.lit(False)) & (F.col("change") != "new")).alias("labelled"))


def validate(
    df: DataFrame, required: Sequence[str] = (), enums: dict[str, Sequence] | None = None,
    ranges: dict[str, tuple] | None = None, group: str | None = None, order: str | None = None, constant: Sequence[str] = (),
) -> DataFrame:
    """(rule, column, violations): missing values, values outside an enum or a range, groups
    with gaps in the order column, groups where a column changes. Two aggregations."""
    checks = {f"required:{c}": F.col(c).isNull() | (F.col(c).cast("string") == "") for c in required}
    checks |= {f"enum:{c}": ~F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in (enums or {}).items()}
    checks |= {f"range:{c}": ~F.coalesce(F.col(c).between(lo, hi), F.lit(False)) for c, (lo, hi) in (ranges or {}).items()}

    def table(one: DataFrame, names: Sequence[str]) -> DataFrame:
        rows = F.array(
            *[F.struct(F.lit(n.split(":")[0]).alias("rule"), F.lit(n.split(":")[1]).alias("column"), F.col(f"`{n}`").alias("violations")) for n in names]
        )
        return one.select(F.inline(rows))

    out = table(df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()]), list(checks)) if checks else None
    if group:
        aggs, tests = [], {}
        if order:
            aggs += [F.min(order).alias("__lo"), F.max(order).alias("__hi"), F.count(F.lit(1)).alias("__n"), F.count_distinct(order).alias("__d")]
            tests[f"no gaps:{order}"] = (F.col("__hi") - F.col("__lo") + 1 != F.col("__n")) | (F.col("__d") != F.col("__n"))
        for i, c in enumerate(constant):
            aggs += [F.min(c).alias(f"__min{i}"), F.max(c).alias(f"__max{i}")]
            tests[f"constant:{c}"] = ~F.col(f"__min{i}").eqNullSafe(F.col(f"__max{i}"))
        per = df.groupBy(group).agg(*aggs)
        grouped = table(per.agg(*[F.count_if(t).alias(n) for n, t in tests.items()]), list(tests))
        out = grouped if out is None else out.unionByName(grouped)
    return out


def catalogue_complete(entries: DataFrame, label: str, n: int) -> DataFrame:
    """Labels 1..n that the catalogue has not exactly once, and how often it has them."""
    wanted = entries.sparkSession.range(1, n + 1).select(F.col("id").alias(label))
    counts = entries.groupBy(F.col(label).cast("long").alias(label)).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, label, "full_outer").fillna(0, ["n"]).filter(
        (F.col("n") != 1) | ~F.col(label).between(1, n)
    )


def answers_complete(answers: DataFrame, ids: DataFrame, sequence: str, item: str) -> DataFrame:
    """(sequence, expected, answered, complete): a sequence is accepted only if each of its
    items was answered exactly once and nothing else was."""
    got = answers.groupBy(sequence, item).agg(F.count(F.lit(1)).alias("__n"))
    joined = ids.select(sequence, item).withColumn("__want", F.lit(1)).join(got, [sequence, item], "full_outer")
    ok = F.col("__want").isNotNull() & (F.col("__n") == 1)
    return joined.groupBy(sequence).agg(
        F.count("__want").alias("expected"),
        F.count("__n").alias("answered"),
        F.coalesce(F.min(F.coalesce(ok, F.lit(False))), F.lit(False)).alias("complete"),
    )
