"""The append-driven parts as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from passages.operators import annotations as A
from passages.operators import chunk as C
from passages.operators import match as M
from passages.operators.sequence import spans_of_anchors
from passages.sources.tables import spread


def stream_carry(
    items: DataFrame, max_gap: int | None = None, resume: bool = True, monotonic: bool = False
) -> DataFrame:
    """``carry`` on a stream of (seq, order, unit, anchors[, gate]); ``order`` is a number that
    grows inside a sequence.

    The state per sequence is the last anchor that counts with the labels still in force, how
    many items there were, and the last order value. Rows that come after a later one has been
    handled are left out; ``dropped`` counts them so far, in a row without ``unit`` where a
    trigger brings a sequence nothing else. The rows of a sequence in one trigger are one
    group: bound them with ``maxFilesPerTrigger``."""
    gated = "gate" in items.columns

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, labels, count, last, late = state.get if state.exists else (None, [], 0, None, 0)
        # the rows of one trigger may come in any order
        rows = pd.concat(list(batches)).sort_values(["order", "unit"], kind="stable")
        fresh = rows if last is None else rows[rows["order"] >= last]
        late += len(rows) - len(fresh)
        if fresh.empty:
            state.update((at, labels, count, last, late))
            yield pd.DataFrame({"seq": [key[0]], "order": [None], "unit": [None], "held": [None], "dropped": [late]})
            return
        gates = [() if g is None else list(g) for g in fresh["gate"]] if gated else None
        set_at, held, (at, labels) = spans_of_anchors(
            fresh["anchors"].map(list).tolist(), count, (at, list(labels)), max_gap, monotonic, None if resume else gates
        )
        if gated and resume:
            # an anchor's own item shows its labels whatever the gate says
            own = [a == count + i for i, a in enumerate(set_at)]
            held = [h if o else [v for v in h if v in g] for h, o, g in zip(held, own, gates, strict=True)]
        state.update((at, labels, count + len(fresh), int(fresh["order"].iloc[-1]), late))
        yield pd.DataFrame({"seq": key[0], "order": fresh["order"].array, "unit": fresh["unit"].array, "held": held, "dropped": late})

    return items.groupBy("seq").applyInPandasWithState(
        step,
        outputStructType="seq long, order long, unit long, held array<int>, dropped int",
        stateStructType="at long, labels array<int>, count long, last long, dropped int",
        outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout,
    )


def run_to_folder(
    stream: DataFrame, out: str, checkpoint: str, batch: Callable[[DataFrame], DataFrame] = lambda df: df, done: Callable[[], None] = lambda: None
) -> None:
    """Process what is there, one folder per micro-batch. A batch that is run again after a
    failure overwrites its own folder, so nothing is written twice. ``done`` is called after each write."""

    def write(df: DataFrame, number: int) -> None:
        try:
            batch(df).write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            done()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_latest_view(log: DataFrame, out: str, checkpoint: str) -> None:
    """Keep an annotation log compact: of each micro-batch only the newest row per (item,
    annotator, label) is stored. ``latest_view_of`` reads the result."""

    def newest(df: DataFrame) -> DataFrame:
        others = [c for c in df.columns if c not in ("item", "annotator", "label")]
        best = df.groupBy("item", "annotator", "label").agg(
            F.max_by(F.struct(*others), F.struct("created_at", -F.col("row_no"))).alias("r")
        )
        return best.select("item", "annotator", "label", "r.*")

    run_to_folder(log, out, checkpoint, newest)


def latest_view_of(spark: SparkSession, out: str) -> DataFrame:
    """The view over all batches so far; decisions before an item's last RESET are gone."""
    return A.latest_view(A.after_reset(spark.read.parquet(out).drop("batch")))


def stream_ingest(
    transcripts: DataFrame, catalogue: DataFrame, out: str, checkpoint: str, target: int = 100, n: int = 5, threshold: float = 0.9
) -> None:
    """New transcripts (doc_id, text) to passages with their best catalogue label; files seen
    before are skipped by the stream's checkpoint."""

    held: list[DataFrame] = []

    def passages(df: DataFrame) -> DataFrame:
        cut = C.pack_sentences(spread(df.select("doc_id", "text"), "doc_id"), target=target)
        cut = cut.withColumn("passage", F.concat_ws("-", "doc_id", "pos"))
        # used twice: the texts are read and cut once
        held.append(cut.persist(StorageLevel.DISK_ONLY))
        label = M.best_anchor(M.ngram_match(cut, catalogue, "passage", n, threshold), "passage")
        return cut.join(label, "passage", "left")

    def done() -> None:
        while held:
            held.pop().unpersist()

    run_to_folder(transcripts, out, checkpoint, passages, done)
