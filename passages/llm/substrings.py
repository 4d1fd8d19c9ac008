"""Removal of word passages that an earlier document has too, by a hash join of their windows.

A passage is a window of ``length`` words, compared by a 64-bit hash; no suffixes are sorted and no tree is built. Three
steps, each with its own bound on memory:

* **Anchors.** Every window of ``length`` words names one of its inner ``INNER``-grams, the one with the smallest hash.
  Equal windows name equal anchors, so a window whose anchor occurs in one document only has no second occurrence.
  About one anchor for five words is shuffled instead of every window.
* **Prefix groups.** The windows left are dealt by a prefix: their first ``INNER`` words, or all
  ``length`` words where its anchor is frequent (by a table of counts with 65,536 cells). Groups are packed into as many
  partitions as the counted windows need at ``GROUP_ROWS`` each.
* **Groups of equal windows.** Within a partition, sorted hashes put equal windows next to each other; a window of several
  documents is a repeat, and the smallest doc_id is the one that keeps it.

Before both shuffles a task settles what it can see alone: of the documents in one slice that share an anchor or a
window only one asks the others, so a passage that a third of all documents have is asked for once per slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.batches import small_batches
from passages.llm.words import Words, distinct, mix, ngrams, signed, slices
from passages.session import checkpoint_dir

INNER = 5
GROUP_ROWS = 2_000_000
FREQUENT = GROUP_ROWS // 64
CELL_BITS = 16


def _windows(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes and anchors of the windows that start at each word; the last ``length - 1`` starts have none."""
    inner = ngrams(hashes, min(INNER, length))
    size = max(0, len(hashes) - length + 1)
    anchors = inner[:size].copy()
    for k in range(1, length - min(INNER, length) + 1):
        np.minimum(anchors, inner[k : k + size], out=anchors)
    return inner[:size], anchors


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (key, doc), the run each belongs to, and whether it is the first of its run."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
    key, doc = key[keep], doc[keep]
    head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    return key, doc, np.cumsum(head) - 1, head


def _dealt(key, doc, known, at):
    return pa.RecordBatch.from_arrays(
        [pa.array((at >> np.uint64(40)).astype(np.int32)), pa.array(signed(key)), pa.array(doc), pa.array(known)],
        ["at", "key", "doc_id", "known"],
    )


DEALT = "at int, key long, doc_id long, known boolean"


def _ask_anchors(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                h, first = words.hashes(), words.first
                ids = part.column("doc_id").to_numpy()
                keys, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                every = _windows(h, length)[1]
                for i in np.flatnonzero(words.counts() >= length):
                    anchors = distinct(every[first[i] : first[i + 1] - length + 1])
                    keys.append(anchors)
                    docs.append(np.full(len(anchors), ids[i], np.int64))
                key, doc, run_, head = _distinct(np.concatenate(keys), np.concatenate(docs))
                several = np.bincount(run_)[run_] > 1 if len(key) else np.zeros(0, bool)
                # shared within the slice: known at once, and one row asks on behalf of the others
                yield _dealt(key[several], doc[several], np.ones(several.sum(), bool), mix(doc[several].view(np.uint64)))
                yield _dealt(key[head], doc[head], np.zeros(head.sum(), bool), key[head])

    return run


def _gathered(batches) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(list(batches))
    return table.column("key").to_numpy().view(np.uint64), table.column("doc_id").to_numpy(), table.column("known").to_numpy()


def _answer_anchors(batches):
    """(doc_id, key) for the anchors that several documents have."""
    first = next(batches, None)
    if first is None:
        return

    def chain():
        yield first
        yield from batches

    key, doc, known = _gathered(chain())
    yield _marks(key[known], doc[known])
    key, doc, run, _ = _distinct(key[~known], doc[~known])
    many = np.bincount(run)[run] > 1 if len(key) else np.zeros(0, bool)
    yield _marks(key[many], doc[many])


def _marks(key, doc):
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(signed(key))], ["doc_id", "key"])


def _listed(part: pa.RecordBatch, column: str) -> Iterator[np.ndarray]:
    values = part.column(column)
    flat, ends = values.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(values).fill_null(0).to_numpy())]
    for a, b in zip(ends[:-1], ends[1:]):
        yield flat[a:b].view(np.uint64)


def _ask_windows(length: int, frequent: np.ndarray):
    """``frequent`` says of each cell of anchors whether their suffixes are dealt by all their words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                h, first = words.hashes(), words.first
                ids = part.column("doc_id").to_numpy()
                keys, docs, ats = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                prefixes, anchors = _windows(h, length)
                wholes = ngrams(h, length)
                for i, shared in enumerate(_listed(part, "anchors")):
                    if first[i + 1] - first[i] < length:
                        continue
                    at = np.arange(first[i], first[i + 1] - length + 1)
                    at = at[np.isin(anchors[at], shared)]
                    often = frequent[(anchors[at] >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    keys.append(wholes[at])
                    docs.append(np.full(len(at), ids[i], np.int64))
                    ats.append(np.where(often, mix(wholes[at]), prefixes[at]))
                key, doc, at = np.concatenate(keys), np.concatenate(docs), np.concatenate(ats)
                order = np.lexsort((doc, key))
                key, doc, at = key[order], doc[order], at[order]
                keep = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])] if len(key) else np.zeros(0, bool)
                key, doc, at = key[keep], doc[keep], at[keep]
                head = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
                # the smallest doc_id of the slice asks; the others have an earlier document already
                yield _dealt(key[~head], doc[~head], np.ones((~head).sum(), bool), mix(doc[~head].view(np.uint64)))
                yield _dealt(key[head], doc[head], np.zeros(head.sum(), bool), at[head])

    return run


def _answer_windows(batches):
    """(doc_id, key) for every window that a document with a smaller doc_id has."""
    first = next(batches, None)
    if first is None:
        return

    def chain():
        yield first
        yield from batches

    key, doc, known = _gathered(chain())
    yield _marks(key[known], doc[known])
    key, doc, _, head = _distinct(key[~known], doc[~known])
    yield _marks(key[~head], doc[~head])


def _cut(length: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                wholes, first = ngrams(words.hashes(), length), words.first
                total, gone, kept, digest, spans = [], [], [], [], []
                for i, marks in enumerate(_listed(part, "marks")):
                    a, b = first[i], first[i + 1]
                    edge = np.zeros(b - a + 1, np.int32)
                    if len(marks) and b - a >= length:
                        hit = np.flatnonzero(np.isin(wholes[a : b - length + 1], marks))
                        np.add.at(edge, hit, 1)
                        np.add.at(edge, hit + length, -1)
                    covered = np.cumsum(edge[:-1]) > 0
                    text = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes().split()
                    if covered.any():
                        text = list(compress(text, (~covered).tolist()))
                    text = b" ".join(text)
                    total.append(b - a)
                    gone.append(int(covered.sum()))
                    kept.append(text)
                    digest.append(hashlib.sha256(text).hexdigest())
                    step = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(step[::2], step[1::2])])
                out = part.drop_columns(["marks"])
                for name, values, kind in (
                    ("n_words", total, pa.int64()),
                    ("n_removed", gone, pa.int64()),
                    ("kept", kept, pa.string()),
                    ("kept_sha256", digest, pa.string()),
                    ("spans", spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ):
                    out = out.append_column(name, pa.array(values, kind))
                yield out

    return run


def remove_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """``docs`` with the words gone that lie in a passage an earlier document has.

    ``docs`` has doc_id (integer) and text; other columns are kept, except that a clashing n_words, n_removed, kept,
    kept_sha256 or spans is replaced. A passage is ``length`` consecutive words of one document; it is repeated if a
    document with a smaller doc_id has the same words anywhere. New columns: n_words, n_removed, kept (the words left,
    joined by one space), kept_sha256, spans (array of maximal removed runs [start, end) in words). Null text counts
    as no words; rows with a null doc_id neither lose words nor make others lose any; rows that repeat a doc_id are parts of
    one document. An empty table gives an empty result."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    docs = docs.drop("n_words", "n_removed", "kept", "kept_sha256", "spans", "marks")
    if dict(docs.dtypes)["doc_id"] != "bigint":
        # only then: a renamed column would keep Spark from seeing that both joins below shuffle the same rows
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = docs.filter("doc_id IS NOT NULL").select("doc_id", "text")
    anchors = texts.mapInArrow(_ask_anchors(length), DEALT).repartition("at").mapInArrow(_answer_anchors, "doc_id long, key long")
    with small_batches(spark):
        wanted = anchors.groupBy("doc_id").agg(F.collect_set("key").alias("anchors")).checkpoint()
    cells = wanted.select(F.explode_outer("anchors").alias("key")).groupBy(F.shiftrightunsigned("key", 64 - CELL_BITS).alias("cell")).count().collect()
    frequent = np.zeros(1 << CELL_BITS, bool)
    frequent[[r["cell"] for r in cells if r["count"] > FREQUENT]] = True
    suffixes = INNER * sum(r["count"] for r in cells)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-suffixes // GROUP_ROWS))
    asked = texts.join(wanted, "doc_id").mapInArrow(_ask_windows(length, frequent), DEALT)
    found = asked.repartition(groups, "at").mapInArrow(_answer_windows, "doc_id long, key long")
    marks = found.groupBy("doc_id").agg(F.collect_list("key").alias("marks"))
    # rows without an id have nothing to join
    joined = docs.filter("doc_id IS NOT NULL").join(marks, "doc_id", "left")
    joined = joined.unionByName(docs.filter("doc_id IS NULL").withColumn("marks", F.lit(None).cast("array<long>")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("marks").schema)
    new = "n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return joined.mapInArrow(_cut(length), f"{kinds}, {new}")
