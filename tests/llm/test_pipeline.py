"""The pipeline against a plain version of its stages, on the smallest tables."""

import re

import pytest

import corpus_pipeline
from passages.llm import pieces, vocabulary
from passages.llm.scoring_queries import MODEL
from tests.llm.test_overlap import WORD, classes, cut, shingle_set


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(docs.collect())
        stage(spark, docs, sf).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return [*out, docs.collect()], spark.read.parquet(f"{sf}/documents.parquet").columns


def test_columns(stages):
    rows, columns = stages
    assert all(list(r[0].asDict()) == columns for r in rows[:-1]) and list(rows[-1][0].asDict()) == [*columns, "ids", "lossless"]


def test_each_stage_is_the_plain_one(stages, spark, sf):
    (start, known, single, cleaned, safe, coded), _ = stages
    assert len(known) >= 0.97 * len([r for r in start if r["text"] and any(map(str.isalpha, r["text"]))])
    label = classes([(r["doc_id"], r["text"]) for r in known])
    assert {r["doc_id"] for r in single} == {d for d, (_, c) in label.items() if c == d}
    wanted = cut([(r["doc_id"], r["text"]) for r in single])
    kept = {r["doc_id"]: len(WORD.findall(r["text"])) for r in cleaned}
    assert kept == {d: n - gone for d, (n, gone, _) in wanted.items() if gone == 0 or gone < n}
    items = [shingle_set(r["text"].lower()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r["doc_id"] for r in cleaned for q in items if 100 * len(shingle_set(re.sub(r"\s+", " ", r["text"].lower())) & q) >= 80 * len(q)}
    assert {r["doc_id"] for r in safe} == {r["doc_id"] for r in cleaned} - hit
    v = vocabulary.Vocabulary(vocabulary.read(MODEL))
    assert all(r["lossless"] and pieces.decode_ids(r["ids"], v) == r["text"] for r in coded) and len(coded) == len(safe)
