"""Table functions against the DataFrame operators, the counting write, and ranked BM25."""

import pytest
from pyspark.sql import functions as F

from passages.functions import text as T
from passages.operators import chunk as C
from passages.operators import retrieve as R
from passages.operators.table_functions import register
from passages.sources import tables as S


@pytest.fixture(scope="module")
def docs(spark, sf):
    extra = spark.createDataFrame([(9001, None), (9002, ""), (9003, "  ..? verse 3. A?? some words between, fourteenth verse of b "), (9004, "word " * 450)], "doc_id long, text string")
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(extra).cache()
    rows.createOrReplaceTempView("fn_docs")
    assert register(spark) == ["sentence_passages", "segment_passages", "label_mentions"]
    return rows


def test_sentences(spark, docs):
    got = spark.sql("SELECT d.doc_id, p.* FROM fn_docs d, LATERAL sentence_passages(d.text, 100) p").collect()
    want = C.pack_sentences(docs).select("doc_id", "pos", "char_start", "char_end", "n_words", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 300


def test_segments(spark, docs):
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x, i: F.struct((i * 20.0).alias("start"), (i * 20.0 + 20).alias("end"), x.alias("text")))
    timed = docs.select("doc_id", lines.alias("segments"))
    timed.createOrReplaceTempView("fn_timed")
    got = spark.sql("SELECT d.doc_id, p.* FROM fn_timed d, LATERAL segment_passages(d.segments, 100) p").collect()
    want = C.pack_segments(timed).select("doc_id", "pos", "char_start", "char_end", "time_start", "time_end", "n_words", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 100


def test_mentions(spark, docs):
    got = spark.sql("SELECT d.doc_id, m.* FROM fn_docs d, LATERAL label_mentions(d.text) m").collect()
    want = docs.select("doc_id", F.inline(T.mentions(F.col("text")))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {(9003, 3), (9003, 14)} <= {(r["doc_id"], r["label"]) for r in got}


def test_write_counts_once_and_fails_past_the_share(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") >= 3, "x").alias("answer"))
    with pytest.raises(S.Incomplete):
        S.write_complete(rows, f"{tmp_path}/a", F.col("answer").isNotNull())
    assert spark.read.parquet(f"{tmp_path}/a").count() == 100
    assert S.write_complete(rows, f"{tmp_path}/b", F.col("answer") == "x", 0.03) == (100, 3)
    assert S.write_complete(rows.limit(0), f"{tmp_path}/c", F.col("answer") == "x") == (0, 0)


def test_best_labels_of_a_query(spark):
    docs = spark.createDataFrame([(i, ["a", "b", f"t{i}"]) for i in range(6)], "label int, tokens array<string>")
    asked = spark.createDataFrame([(0, ["a", "t4"]), (1, ["b"]), (2, ["z"])], "query long, tokens array<string>")
    every = {(r["query"], r["label"]): r["score"] for r in R.bm25(asked, docs).collect()}
    got = {(r["query"], r["rank"]): r["label"] for r in R.bm25(asked, docs, k=2).collect()}
    assert got == {(0, 1): 4, (0, 2): 0, (1, 1): 0, (1, 2): 1} and len(every) == 12
