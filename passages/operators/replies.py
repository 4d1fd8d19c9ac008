"""Labels out of the line-by-line replies of an external labeller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_answer_lines(replies: DataFrame, ids: DataFrame, last: int = 72) -> tuple[DataFrame, DataFrame]:
    """``replies(reply_id, text)`` and the expected ``ids(reply_id, item)``.

    Returns the labels, one row per expected item (``labels`` null if it was not answered,
    empty for NONE), and per reply the counts of unparsed lines, unanswered items and
    labels out of range. The first line of an item counts."""
    line = F.regexp_replace(F.col("line"), r"^[\s`]+|[\s`]+$", "")
    pattern = r"^(P\d{3,})[\t |:]+(.+)$"
    lines = (
        replies.select("reply_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
        .withColumn("line", line)
        .filter("line <> ''")
        .withColumn("item", F.nullif(F.regexp_extract("line", pattern, 1), F.lit("")))
        .withColumn("body", F.trim(F.regexp_extract("line", pattern, 2)))
    )
    matched = lines.join(ids.withColumn("expected", F.lit(True)), ["reply_id", "item"], "left")
    unparsed = matched.filter("expected IS NULL").groupBy("reply_id").agg(F.count(F.lit(1)).alias("unparsed"))
    first = (
        matched.filter("expected").groupBy("reply_id", "item").agg(F.min_by("body", "no").alias("body"))
    )
    tokens = F.filter(F.split("body", r"[;,\s]+"), lambda x: (x != "") & (F.upper(x) != "NONE"))
    numbers = F.transform("tokens", lambda x: F.regexp_extract(x, r"^2\.(\d+)$", 1).try_cast("int"))
    parsed = (
        first.withColumn("tokens", tokens)
        .withColumn("labels", F.filter(numbers, lambda n: (n >= 1) & (n <= last)))
        .withColumn("outside", F.size("tokens") - F.size("labels"))
    )
    labels = ids.join(parsed.select("reply_id", "item", "labels", "outside"), ["reply_id", "item"], "left")
    problems = (
        labels.groupBy("reply_id")
        .agg(
            F.count_if(F.col("labels").isNull()).alias("missing"),
            F.coalesce(F.sum("outside"), F.lit(0)).alias("outside"),
        )
        .join(unparsed, "reply_id", "left")
        .fillna(0, ["unparsed"])
    )
    return labels.select("reply_id", "item", "labels"), problems
