"""Faults that the queries' own SQL could not see."""

from pyspark.sql import functions as F

from passages.operators.learn import target_grid
from passages.operators.match import position_weight
from passages.operators.replies import parse_answer_lines
from passages.operators.sequence import masked_sequence


def test_masked_ids_are_read_back(spark):
    items = spark.range(1200).select(F.lit("s").alias("seq"), F.col("id").alias("pos"), F.lit(False).alias("skip"), F.lit("2.7").alias("text"))
    body = masked_sequence(items, "skip", part_rows=1200, keys=["seq"])
    replies = body.select(F.col("seq").alias("reply_id"), F.regexp_replace("body", "\n\n", "\n").alias("text"))
    ids = spark.range(1, 1201).select(F.lit("s").alias("reply_id"), F.format_string("P%03d", "id").alias("item"))
    labels, problems = parse_answer_lines(replies, ids)
    assert labels.filter("labels = array(7)").count() == 1200
    assert problems.select("missing", "outside", "unparsed").collect() == [(0, 0, 0)]


def test_labels_of_three_digits(spark):
    replies = spark.createDataFrame([("r", "P001: 2.150; 2.7")], "reply_id string, text string")
    ids = spark.createDataFrame([("r", "P001")], "reply_id string, item string")
    labels = {last: parse_answer_lines(replies, ids, last=last)[0].collect()[0]["labels"] for last in (72, 200)}
    assert labels == {72: [7], 200: [150, 7]}


def test_position_weight_counts_whole_sequences(spark):
    hits = spark.createDataFrame([("a", 5, 1, 1.0), ("a", 90, 2, 1.0), ("a", 95, 3, 1.0)], "seq string, pos int, label int, score double")
    sizes = spark.createDataFrame([("a", 100)], "seq string, items long")
    stop = spark.createDataFrame([(3,)], "label int")
    got = {r["pos"]: r["score"] for r in position_weight(hits, sizes, stop).collect()}
    assert got == {5: 0.9, 90: 1.0}


def test_target_grid_takes_the_named_column(spark):
    items = spark.createDataFrame([("u", [2])], "unit string, mine array<int>")
    assert [r["y"] for r in target_grid(items, 4, gold="mine").orderBy("label").collect()] == [0, 0, 1, 0]
