"""Stages and operators on nulls, empty tables, repeated rows and columns with clashing names; the lexicon against a plain count."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from passages.llm import language, pieces, quality, token_counts, toxicity, vocabulary
from passages.llm.scoring_queries import MODEL

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, n_words long, kept string, spans string, kept_sha256 string, n_removed long, marks string, component_id long"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 42.0, "mine", -1, "k", "sp", "sha", -2, "m", -3) for i, t, lang in rows], EXTRA)


def backwards(rows, at):
    """A new text of 150 words that an English one has."""
    english = [r[1] for r in rows if r[2] == "en" and r[1] and len(r[1].split()) > 200]
    return " ".join(english[at].split()[::-1][:150])


@pytest.fixture(scope="module")
def awkward(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    passage = " ".join(f"word{i}" for i in range(60))
    rows += [(10_001, None, "en"), (10_002, "", None), (10_003, " \n\t", "en"), (10_004, "12 34 !!", "en"), (None, rows[0][1], "en"), (None, None, None)]
    rows += [rows[1], (10_005, f"{backwards(rows, 2)} {passage}", "en"), (10_006, f"{passage} {backwards(rows, 3)}", "en")]
    return wide(spark, rows).repartition(3)


def test_stages_keep_the_columns_of_the_caller(spark, sf, awkward, tmp_path):
    docs = awkward
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.columns[: len(awkward.columns)] == awkward.columns, name
        assert [r for r in out.select("score", "lang_pred", "n_words", "kept", "spans", "n_removed", "marks", "component_id").distinct().collect()] == [(42.0, "mine", -1, "k", "sp", -2, "m", -3)], name
        docs = out
    ids = {r["doc_id"] for r in docs.collect()}
    assert {10_005, 10_006} <= ids and not ids & {10_001, 10_002, 10_003, 10_004}
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id > 10000").collect()}
    assert "word30" in texts[10_005] and "word30" not in texts[10_006]


def test_stages_of_an_empty_table(spark, sf, awkward):
    docs = awkward.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0 and out.columns[: len(docs.columns)] == docs.columns, name


def test_scorers_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, label int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == 0
    assert language.identify(docs, language.train(docs)).count() == 0
    assert pieces.encode(docs, vocabulary.read(MODEL)).count() == 0 and token_counts.count_tokens(docs, vocabulary.read(MODEL)).count() == 0


def test_site_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, f"some words here {i}.", "a" if i % 2 else None, f"p{i % 3}") for i in range(40)], "doc_id long, text string, n string, good string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 > 0).cast("int").alias("label"))
    got = quality.score(docs, docs.join(labels, "doc_id"), quality.train(docs, labels), "n", "good").collect()
    renamed = docs.toDF("doc_id", "text", "host", "path")
    want = quality.score(renamed, renamed.join(labels, "doc_id"), quality.train(renamed, labels), "host", "path").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 40


def plain_terms(rows, support=5, precision=0.7):
    n, toxic = Counter(), Counter()
    for text, label in rows:
        words = toxicity.LetterWords(toxicity.pa.array([text]))
        data = words.data.tobytes()
        seen = {data[s:e].decode("utf-8", "replace") for s, e in zip(words.start, words.end) if e - s <= 40}
        terms = {(w, False) for w in seen} | {(w[:k], True) for w in seen for k in range(4, min(len(w), 9) + 1)}
        n.update(terms)
        if label:
            toxic.update(terms)
    return {t for t in n if n[t] >= support and toxic[t] >= precision * (n[t] + support / 2)}


def test_lexicon_is_that_of_all_labelled_texts(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", F.col("toxic").cast("int").alias("label")).filter("label IS NOT NULL")
    rows = docs.join(labels, "doc_id").select("text", "label")
    want = plain_terms([(r["text"], r["label"]) for r in rows.collect() if r["text"] is not None])
    stems = {t for t, stem in want if stem or len(t) < 5}
    stems = {t for t in stems if not any(t[:k] in stems for k in range(1, len(t)))}
    for sample in (rows.limit(0), rows):
        found = toxicity.learn_lexicon(docs, labels, sample)
        assert set(found.words) == {t for t, stem in want if not stem and len(t) >= 5} and set(found.stems) == stems
    assert found.words
