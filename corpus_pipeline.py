"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.llm import language, vocabulary
from passages.llm.decontaminate import decontaminate
from passages.llm.jaccard import jaccard_classes
from passages.llm.pieces import encode
from passages.llm.scoring_queries import MODEL
from passages.llm.substrings import remove_repeats
from passages.session import checkpoint_dir

SURE = 0.3


def _aside(docs: DataFrame) -> tuple[DataFrame, list]:
    """``docs`` with its other columns under names no operator uses, and the columns that give the names back."""
    names = {c: c if c in ("doc_id", "text") else f"__{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()]


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised; without letters or with a score under SURE they go."""
    model = language.train(docs.filter(~language.held_out(F.col("doc_id"), 5, 0)))
    rows, back = _aside(docs)
    seen = language.identify(rows, model)
    return seen.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select(*back)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every class of near copies."""
    classes = jaccard_classes(docs.select("doc_id", "text"))
    copies = classes.filter("component_id < doc_id").select("doc_id")
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out that an earlier document has; a document left without words goes."""
    rows, back = _aside(docs)
    cut = remove_repeats(rows, 13)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = cut.filter("n_removed = 0 OR n_removed < n_words").withColumn("text", text).select(*back)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their piece ids, and whether these decode to the text."""
    return encode(docs, vocabulary.read(MODEL))


STAGES = [
    ("language", languages),
    ("near_copies", near_copies),
    ("passages", passages),
    ("benchmark", benchmark_items),
    ("tokens", tokens),
]

#: the language stage is a trained network, which SQL cannot express; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    checkpoint_dir(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
