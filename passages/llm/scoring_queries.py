"""Queries that score, encode or convert every row of a table."""

from pyspark.sql import functions as F

from passages.llm import language, pieces, quality, token_counts, toxicity, vocabulary, warc
from passages.llm.registry import query, table

#: where the public piece model is; a parameter of the operators
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language.held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").filter("toxic IS NOT NULL").filter(~held).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_warc")
def op3_warc(spark, sf_dir):
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


@query("op6_quality")
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("path"))
    labels = table(spark, sf_dir, "labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))
    known = docs.select("doc_id", "source", "path").join(labels, "doc_id")
    return quality.score(docs, known, quality.train(docs, labels), "source", "path")


@query("op7_language")
def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), 5, 0)
    model = language.train(docs.filter(~held))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op8_sentencepiece")
def op8_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, vocabulary.read(MODEL))
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "lossless")


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocabulary.read(MODEL)).select("doc_id", "n_pretokens", "n_tokens")
