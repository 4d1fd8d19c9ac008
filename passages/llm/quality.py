"""Quality scores by hierarchical empirical Bayes: a document's own evidence, its path, its host and the whole collection.

A logistic model gives the evidence of the text. Labelled documents give the share of good ones by host and by path;
a path is shrunk towards its host and a host towards the collection, as far as the spread between them says (the
prior strength is fitted by the method of moments). The posterior odds are the odds of the path times the evidence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.samples import Logistic, labelled
from passages.llm.words import Words, mix, slices

COLUMNS = ("log_words", "word_length", "distinct", "distinct_pairs", "same_as_last", "symbols", "capitals", "digits", "stops", "lines", "long_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = True
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[list(b".?!,;:")] = True
LINE = np.zeros(256, bool)
LINE[10] = True


def features(texts: pa.Array) -> np.ndarray:
    """One row of COLUMNS per text; zeros for texts without words."""
    words = Words(texts)
    n, row = words.counts(), words.rows()
    size = np.maximum(1, np.diff(words.offsets))
    h = words.hashes()

    def share(table: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(table[words.data])]
        return (total[words.offsets[1:]] - total[words.offsets[:-1]]) / size

    def distinct(codes: np.ndarray, rows: np.ndarray, count: np.ndarray) -> np.ndarray:
        _, one = np.unique(mix(codes ^ (rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
        return np.bincount(rows[one], minlength=len(words)) / np.maximum(1, count)

    same_row = row[1:] == row[:-1]
    pairs = (h[1:] * np.uint64(31) + h[:-1])[same_row]
    again = np.bincount(row[1:][same_row & (h[1:] == h[:-1])], minlength=len(words)) / np.maximum(1, n)
    length = words.end - words.start
    mean = np.bincount(row, length, minlength=len(words)) / np.maximum(1, n)
    long_words = np.bincount(row[length > 20], minlength=len(words)) / np.maximum(1, n)
    out = np.stack(
        [np.log1p(n), mean, distinct(h, row, n), distinct(pairs, row[1:][same_row], n), again, share(SYMBOL), share(CAPITAL), share(DIGIT), share(STOP), share(LINE), long_words],
        axis=1,
    )
    out = np.c_[out, out[:, 2:9] ** 2]
    out[n == 0] = 0
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Logistic | None:
    """Evidence model from about ``sample`` rows of ``labels`` (doc_id, label 0 or 1); None if labels do not differ."""
    rows = labelled(docs, labels, sample)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    data = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "label int, x array<double>").collect()
    y = np.array([r["label"] for r in data], float)
    return Logistic(np.array([r["x"] for r in data]), y) if len(set(y)) > 1 else None


def evidence(docs: DataFrame, model: Logistic | None, prior: float, column: str = "text") -> DataFrame:
    """``docs`` with ``evidence``: log-odds of the text against the share of good ones the model was fitted on."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = float(np.log(prior / (1 - prior)))
    docs = docs.drop("evidence")

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                x = features(part.column(column))
                logit = np.zeros(len(x)) if shared.value is None else np.clip(shared.value.logit(x), -15, 15) - base
                logit[x[:, 0] == 0] = -base if shared.value is None else -15 - base
                yield part.append_column("evidence", pa.array(logit))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, evidence double")


def _strength(rates: DataFrame, good: str, n: str, prior: Column) -> float:
    """Prior strength by moments: spread between groups beyond what their sizes explain."""
    p = prior
    noise = p * (1 - p) / F.col(n)
    spread = F.sum(F.col(n) * ((F.col(good) / F.col(n) - p) ** 2 - noise)) / F.sum(n)
    row = rates.filter(F.col(n) > 1).agg(spread.alias("spread"), (F.sum(F.col(n) * p * (1 - p)) / F.sum(n)).alias("inner")).first()
    if not row["inner"] or row["spread"] is None:
        return 1000.0
    return float(min(1000.0, max(1.0, row["inner"] / max(row["spread"], 1e-9) - 1)))


def site_posteriors(known: DataFrame, host: str, path: str) -> tuple[float, DataFrame, DataFrame]:
    """(share of good ones, host -> host_posterior, (host, path) -> path_posterior) by grouped sums of ``label``.

    Sums are made before the shuffle, so a host with a third of all rows is one row per task."""
    y = F.col("label").cast("double")
    rows = known.filter("label IS NOT NULL").select(F.col(host).alias("_host"), F.col(path).alias("_path"), y.alias("_y"))
    paths = rows.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("_y").alias("_good")).checkpoint()
    total = paths.agg(F.sum("_n").alias("n"), F.sum("_good").alias("good")).first()
    prior = ((total["good"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    hosts = paths.groupBy("_host").agg(F.sum("_n").alias("_n"), F.sum("_good").alias("_good"))
    s = _strength(hosts, "_good", "_n", F.lit(prior))
    hosts = hosts.select("_host", ((F.col("_good") + s * prior) / (F.col("_n") + s)).alias("host_posterior"))
    joined = paths.join(hosts.withColumnRenamed("_host", "_own"), F.col("_host").eqNullSafe(F.col("_own"))).drop("_own")
    t = _strength(joined, "_good", "_n", F.col("host_posterior"))
    joined = joined.select("_host", "_path", ((F.col("_good") + t * F.col("host_posterior")) / (F.col("_n") + t)).alias("path_posterior"))
    return float(prior), hosts.toDF(host, "host_posterior"), joined.toDF(host, path, "path_posterior")


def score(docs: DataFrame, known: DataFrame, model: Logistic | None, host: str, path: str, threshold: float = 0.3) -> DataFrame:
    """(doc_id, evidence, host_posterior, path_posterior, score, keep) for every row of ``docs``.

    ``docs`` has doc_id, text and the columns ``host`` and ``path`` (null is a site of its own); ``known`` has these two
    and ``label`` (1 good). A host without labels has the share of the collection, a path without labels that of its host.
    Texts without words get the lowest evidence. ``keep`` is score >= threshold."""
    prior, hosts, paths = site_posteriors(known, host, path)
    rows = evidence(docs.select("doc_id", "text", F.col(host).alias("host"), F.col(path).alias("path")), model, prior).drop("text")
    hosts, paths = hosts.toDF("h", "host_posterior"), paths.toDF("ph", "pp", "path_posterior")
    rows = rows.join(hosts, F.col("host").eqNullSafe(F.col("h")), "left")
    rows = rows.join(paths, F.col("host").eqNullSafe(F.col("ph")) & F.col("path").eqNullSafe(F.col("pp")), "left")
    top = F.coalesce("host_posterior", F.lit(prior))
    low = F.coalesce("path_posterior", top)
    odds = F.log(low / (1 - low)) + F.col("evidence")
    final = 1 / (1 + F.exp(-odds))
    return rows.select("doc_id", "evidence", top.alias("host_posterior"), low.alias("path_posterior"), final.alias("score"), (final >= threshold).alias("keep"))
