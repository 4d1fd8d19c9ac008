"""Sequence decoding: best path and state posteriors of a hidden Markov model.

The recursions are products in a semiring (max, + or logsumexp, +), and such products can
be grouped freely. A sequence longer than a block is therefore decoded in three steps:
each block's transfer matrix on its own, the chain of matrices (one small row per block),
then every block on its own again with its entry scores known. Short sequences need the
last step only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.operators.scan import block_of, one_block
from passages.session import checkpoint_dir

BLOCK_ROWS = 20_000
BATCH_ROWS = 20_000
SIDE_BY_SIDE = 1_000
PACK_ROWS = 100_000
LOWEST = -600.0
NEG = -np.inf


@dataclass(frozen=True)
class Model:
    """Log transitions, the log score a sequence may start with in each state, and how the
    emission columns (labels 0..n-1, then off) spread over the states."""

    log_a: np.ndarray
    start: np.ndarray
    columns: np.ndarray
    out: np.ndarray

    @staticmethod
    def plain(log_a: np.ndarray) -> Model:
        s = len(log_a)
        return Model(log_a, np.zeros(s), np.arange(s), np.arange(s))

    @staticmethod
    def resume(log_a: np.ndarray, n_labels: int) -> Model:
        """n labels, PRE and one HOLD state per label; a sequence starts in a label or PRE."""
        columns = np.concatenate([np.arange(n_labels), np.full(n_labels + 1, n_labels)])
        start = np.where(np.arange(2 * n_labels + 1) > n_labels, NEG, 0.0)
        return Model(log_a, start, columns, columns)


def matrix_of(table: DataFrame, n_states: int) -> np.ndarray:
    """A (a, b, log_p) table of a fixed number of states as an array on the driver."""
    log_a = np.full((n_states, n_states), NEG)
    for r in table.select("a", "b", "log_p").collect():
        log_a[r["a"], r["b"]] = NEG if r["log_p"] is None else r["log_p"]
    return log_a


def _steps(log_a, gamma, delta, anchors, n_labels):
    """Transition scores into each item; an unanchored step to one of the next two labels
    costs ``delta``."""
    base = gamma * log_a if gamma != 0 else np.where(np.isfinite(log_a), 0.0, NEG)
    if not delta:
        return lambda t: base
    a, b = np.indices(base.shape)
    forward = ((b - a == 1) | (b - a == 2)) & (a < n_labels) & (b < n_labels)

    def at(t):
        silent = np.ones(base.shape[0])
        hit = [v for v in anchors[t] if v < n_labels]
        silent[hit] = 0
        return base - delta * forward * silent[None, :]

    return at


def _logsum(x, axis):
    m = x.max(axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - m).sum(axis=axis)) + np.squeeze(m, axis)


def _reduce(best: bool):
    return (lambda x, axis: x.max(axis=axis)) if best else _logsum


def _transfer(emit, step, best):
    """score[i, j]: from state i before the block to state j at its end."""
    fold = _reduce(best)
    m = step(0) + emit[0][None, :]
    for t in range(1, len(emit)):
        m = fold(m[:, :, None] + step(t)[None, :, :], 1) + emit[t][None, :]
    return m


def _stepped(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """For sequences that lie behind each other: their order, longest first, the row each of these begins at, and how many have
    a row t."""
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    return order, begins, np.searchsorted(-sizes[order], -np.arange(sizes.max()), "left").tolist()


def _folded(x: np.ndarray, step: np.ndarray, weight: np.ndarray, lowest: float) -> np.ndarray:
    """Logsumexp of x[:, a] + step[a, b] over a, as a matrix product; ``weight`` is exp(step). Rows that reach too far down for
    that are added up by their logs."""
    m = x.max(1, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    low = np.where(np.isfinite(x), x - m, 0.0).min(1) < lowest
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - m) @ weight) + m
    if low.any():
        out[low] = _logsum(x[low][:, :, None] + step, 1)
    return out


def _smoothed(sizes, e, step, start, entry=None, behind=None) -> np.ndarray:
    """Posteriors of sequences that lie behind each other, all of them a step at a time."""
    _, begins, n = _stepped(sizes)
    weight = np.exp(step)
    finite = step[np.isfinite(step)]
    lowest = LOWEST - (min(0.0, finite.min()) if len(finite) else 0.0)
    la, lb = np.empty_like(e), np.empty_like(e)
    before = start if entry is None else _logsum(entry[:, None] + step, 0)
    la[begins] = row = before + e[begins]
    for t in range(1, len(n)):
        at = begins[: n[t]] + t
        la[at] = row = _folded(row[: n[t]], step, weight, lowest) + e[at]
    lb[np.cumsum(sizes) - 1] = 0.0 if behind is None else behind
    for t in range(len(n) - 2, -1, -1):
        at = begins[: n[t + 1]] + t
        lb[at] = _folded(e[at + 1] + lb[at + 1], step.T, weight.T, lowest)
    g = la + lb
    return np.exp(g - _logsum(g, 1)[:, None])


def _expected(sizes, codes, kinds, scores, step, start) -> np.ndarray:
    """Posteriors of a pack's sequences, summed by the values that ``kinds`` has for an item and a state. ``scores`` has the emission of a
    value in a state. The rows of a step lie together, longest sequence first, so a step is one product of matrices; its rows are kept in
    proportion, not as logs, where no state can fall too far behind the others for that."""
    e = scores[kinds, np.arange(kinds.shape[1])]
    behind = np.append(np.searchsorted(-sizes, -np.arange(sizes[0]), "left"), 0)  # how many have a row t
    ends = np.cumsum(behind)
    spread = (np.ptp(e, 1).max() if np.isfinite(e).all() else np.inf) + (np.ptp(step) if np.isfinite(step).all() else np.inf)
    if not spread < -LOWEST / 2:
        first = np.cumsum(sizes) - sizes
        rows = np.concatenate([first[:n] + t for t, n in enumerate(behind[:-1])])
        turned = np.empty_like(codes)
        turned[rows] = codes
        g = _smoothed(sizes, e[turned], step, start)
        return np.bincount(kinds[turned].ravel(), g.ravel(), len(scores))
    weight, w = np.exp(step - step.max()), np.exp(e - e.max(1, keepdims=True))
    share = np.take(w, codes, 0)
    g = np.empty_like(share)
    row = share[: ends[0]] * np.exp(start - start.max())
    g[: ends[0]] = row = row / row.sum(1, keepdims=True)
    for t in range(1, int(sizes[0])):
        row = np.matmul(row[: behind[t]], weight)
        row *= share[ends[t - 1] : ends[t]]
        row /= row.sum(1, keepdims=True)
        g[ends[t - 1] : ends[t]] = row
    for t in range(int(sizes[0]) - 2, -1, -1):
        n = behind[t + 1]
        share[ends[t] : ends[t] + behind[t + 2]] *= row[: behind[t + 2]]
        row = np.matmul(share[ends[t] : ends[t + 1]], weight.T)
        row /= row.sum(1, keepdims=True)
        g[ends[t] - behind[t] : ends[t] - behind[t] + n] *= row
    g /= g.sum(1, keepdims=True)
    return np.bincount(np.take(kinds, codes, 0).ravel(), g.ravel(), len(scores))


def _best_path(sizes, e, log_a, gamma, delta, anchors, n_labels, start, entry=None, last=None) -> np.ndarray:
    """Best states of sequences that lie behind each other, all of them a step at a time; gamma and delta by sequence."""
    order, begins, n = _stepped(sizes)
    scales, kind = np.unique(gamma[order], return_inverse=True)
    bases = np.stack([_steps(log_a, g, 0.0, None, n_labels)(0) for g in scales])
    forward = silent = None
    if delta.any():
        a, b = np.indices(log_a.shape)
        forward = ((b - a == 1) | (b - a == 2)) & (a < n_labels) & (b < n_labels)
        forward = delta[order][:, None, None] * forward
        silent = np.ones(e.shape)
        for row, hit in enumerate(anchors):
            silent[row, [v for v in hit if v < n_labels]] = 0

    def step(k, at):
        base = bases if len(bases) == 1 else bases[kind[:k]]
        return base if forward is None else base - forward[:k] * silent[at][:, None, :]

    back = np.zeros(e.shape, dtype=np.int32)
    scores = np.empty_like(e)
    if entry is None:
        scores[begins] = score = start + e[begins]
    else:
        scores[begins] = score = (entry[None, :, None] + step(1, begins)).max(1) + e[begins]
    for t in range(1, len(n)):
        at = begins[: n[t]] + t
        cand = score[: n[t], :, None] + step(n[t], at)
        back[at] = cand.argmax(1)
        scores[at] = score = cand.max(1) + e[at]
    ends = np.cumsum(sizes) - 1
    states = np.empty(len(e), dtype=np.int64)
    states[ends] = scores[ends].argmax(1) if last is None else last
    for t in range(len(n) - 1, 0, -1):
        at = begins[: n[t]] + t
        states[at - 1] = back[at, states[at]]
    return states


def _blocks(items, model, keys, emit, gamma, delta, anchors, best, block_rows, keep=(), dealt=False):
    """Rows ready to group by block, and per block of a long sequence its entry scores and
    what lies behind it."""
    keys = list(keys)
    n_states = len(model.log_a)
    n_labels = int(model.columns.max())
    number = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    rows = items.select(
        *keys, "pos", block_of("pos", block_rows).alias("__block"), F.col(emit).alias("__emit"),
        number(gamma).alias("__gamma"), number(delta).alias("__delta"),
        (F.col(anchors) if anchors else F.array().cast("array<int>")).alias("__anchors"), *keep,
    )
    if one_block(items, "pos", block_rows):
        return rows if dealt else _dealt(rows, keys), None, None
    rows = rows.drop(*keep)

    def prepare(pdf):
        pdf = pdf.sort_values("pos")
        e = np.stack([np.asarray(x, dtype=float) for x in pdf["__emit"]])[:, model.columns]
        step = _steps(
            model.log_a, float(pdf["__gamma"].iloc[0]), float(pdf["__delta"].iloc[0]),
            [list(a) for a in pdf["__anchors"]], n_labels,
        )
        return pdf, e, step

    key_fields = [items.schema[k] for k in keys]
    block_field = T.StructField("__block", T.LongType())
    doubles = T.ArrayType(T.DoubleType())

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, e, step = prepare(pdf)
        if pdf["__block"].iloc[0] == 0:
            row = model.start + e[0]
            fold = _reduce(best)
            for t in range(1, len(e)):
                row = fold(row[:, None] + step(t), 0) + e[t]
            m = np.tile(row, (n_states, 1))
        else:
            m = _transfer(e, step, best)
        out = pdf[keys + ["__block"]].iloc[:1].copy()
        out["__m"] = [m.ravel()]
        return out

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        mats = [np.asarray(m).reshape(n_states, n_states) for m in pdf["__m"]]
        fold = _reduce(best)
        entry = [None, mats[0][0]]
        for m in mats[1:]:
            entry.append(fold(entry[-1][:, None] + m, 0))
        out = pdf[keys + ["__block"]].copy()
        out["__entry"] = [np.zeros(0) if v is None else v for v in entry[:-1]]
        if best:
            ends = [int(entry[-1].argmax())]
            for b in range(len(mats) - 1, 0, -1):
                ends.append(int((entry[b] + mats[b][:, ends[-1]]).argmax()))
            out["__behind"] = [np.array([float(x)]) for x in ends[::-1]]
        else:
            behind = [np.zeros(n_states)]
            for m in mats[:0:-1]:
                behind.append(fold(m + behind[-1][None, :], 1))
            out["__behind"] = behind[::-1]
        return out

    # Python work per group is heavy and its rows are small: keep as many tasks as the session
    # has shuffle partitions, where coalescing by bytes would leave a few
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *keys, "__block")
    long_ones = rows.filter("__block > 0").select(*keys).distinct()
    mats = rows.join(long_ones, keys, "left_semi").groupBy(*keys, "__block").applyInPandas(
        transfer, T.StructType([*key_fields, block_field, T.StructField("__m", doubles)])
    )
    edges = mats.groupBy(*keys).applyInPandas(
        chain,
        T.StructType(
            [*key_fields, block_field, T.StructField("__entry", doubles), T.StructField("__behind", doubles)]
        ),
    )
    return rows, edges, prepare


def _dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "pos")


def dealt(items: DataFrame, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """``items`` with whole sequences in a task, in order, written to the checkpoint folder: for work that reads them in many rounds."""
    checkpoint_dir(items.sparkSession)
    return _dealt(items, keys).checkpoint()


def packed(items: DataFrame, kind: str, keys: Sequence[str] = ("seq",), pack_rows: int = PACK_ROWS) -> DataFrame:
    """(sizes, codes, kinds): ``items`` as packs of whole sequences, on the checkpoint folder, for work that reads them in many rounds and
    needs sums only. ``kind`` is a binary column, a byte per state; an item is a number that says which of its pack's different kinds it has."""
    keys = list(keys)
    checkpoint_dir(items.sparkSession)

    def pack(table: pa.Table, begins: np.ndarray) -> list[bytes]:
        sizes = np.diff(np.append(begins, table.num_rows))
        order, first, n = _stepped(sizes)
        found = table[kind].combine_chunks().dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        codes = codes[np.concatenate([first[:k] + t for t, k in enumerate(n)])]
        return [sizes[order].astype(np.int64).tobytes(), codes.tobytes(), b"".join(found.dictionary.to_pylist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _in_whole_sequences(batches, keys, pack_rows):
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in pack(table, begins)], ["sizes", "codes", "kinds"])

    rows = _dealt(items.select(*keys, "pos", kind), keys)
    packs = rows.mapInArrow(run, "sizes binary, codes binary, kinds binary").checkpoint()
    return packs.coalesce(items.sparkSession.sparkContext.defaultParallelism)


def _begins(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """The rows a sequence begins at; nulls are a value like others."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for k in keys:
        codes = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def _in_whole_sequences(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A task's rows in tables of whole sequences of about ``most`` rows, with the rows a sequence begins at."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begins = _begins(table, keys)
        if len(begins) > 1:  # the last sequence may go on
            yield table.slice(0, begins[-1]), begins[:-1]
            held = table.slice(begins[-1]).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _begins(table, keys)


def _whole_sequences(keys: Sequence[str], out: Sequence[str], name: str, kind: pa.DataType, solve: Callable) -> Callable:
    """A task's rows in batches of whole sequences of about ``BATCH_ROWS``; ``solve(rows, sizes)`` has a batch's new column."""

    def solved(table: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.append(begins, table.num_rows)
        for i in range(0, len(begins), SIDE_BY_SIDE):
            part = edges[i : i + SIDE_BY_SIDE + 1]
            rows = table.slice(part[0], part[-1] - part[0])
            yield from rows.select(out).append_column(name, solve(rows, np.diff(part)).cast(kind)).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begins in _in_whole_sequences(batches, keys, BATCH_ROWS):
            yield from solved(table, begins)

    return run


def _emitted(rows: pa.Table, model: Model) -> np.ndarray:
    column = rows["__emit"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)[:, model.columns]


def _finish(items, rows, edges, keys, keep, name, kind, solve, fn):
    """(keys, pos, keep, name): short sequences many at a time, blocks of long ones with their edges one by one."""
    out = [*keys, "pos", *keep]
    added = T.StructField(name, kind)
    if edges is None:
        arrow = pa.int32() if isinstance(kind, T.IntegerType) else pa.list_(pa.float64())
        run = _whole_sequences(keys, out, name, arrow, solve)
        return rows.mapInArrow(run, T.StructType([*[items.schema[c] for c in out], added]))
    schema = T.StructType([*[items.schema[c] for c in [*keys, "pos"]], added])
    found = rows.groupBy(*keys, "__block").cogroup(edges.groupBy(*keys, "__block")).applyInPandas(fn, schema)
    if not keep:
        return found
    return items.select(*out).join(found, [*keys, "pos"]).select(*out, name)


def viterbi(
    items: DataFrame, model: Model, gamma: float | str = 1.0, delta: float | str = 0.0, emit: str = "emit",
    anchors: str | None = None, keys: Sequence[str] = ("seq",), block_rows: int = BLOCK_ROWS, keep: Sequence[str] = (),
) -> DataFrame:
    """(keys, pos, keep, state): the best state path; ties go to the lowest state. ``gamma``
    scales the log transitions and ``delta`` penalises unanchored forward steps; both may
    name a column that is constant per sequence. ``keep`` names columns that come along."""
    keys = list(keys)
    rows, edges, prepare = _blocks(items, model, keys, emit, gamma, delta, anchors, True, block_rows, keep)
    n_labels = int(model.columns.max())

    def solve(rows: pa.Table, sizes: np.ndarray) -> pa.Array:
        first = np.cumsum(sizes) - sizes
        scale, cost = (rows[c].to_numpy()[first] for c in ("__gamma", "__delta"))
        hits = rows["__anchors"].to_pylist() if cost.any() else None
        path = _best_path(sizes, _emitted(rows, model), model.log_a, scale, cost, hits, n_labels, model.start)
        return pa.array(model.out[path].astype(np.int32))

    def decode(pdf: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        pdf, e, _ = prepare(pdf)
        entry = np.asarray(edge["__entry"].iloc[0]) if len(edge) else np.zeros(0)
        path = _best_path(
            np.array([len(e)]), e, model.log_a, pdf["__gamma"].to_numpy()[:1], pdf["__delta"].to_numpy()[:1], [list(a) for a in pdf["__anchors"]],
            n_labels, model.start, entry if len(entry) else None, int(edge["__behind"].iloc[0][0]) if len(edge) else None,
        )
        out = pdf[keys + ["pos"]].copy()
        out["state"] = model.out[path].astype(np.int32)
        return out

    return _finish(items, rows, edges, keys, list(keep), "state", T.IntegerType(), solve, decode)


def forward_backward(
    items: DataFrame, model: Model, emit: str = "emit", keys: Sequence[str] = ("seq",), block_rows: int = BLOCK_ROWS,
    keep: Sequence[str] = (), dealt: bool = False, scores: np.ndarray | None = None,
) -> DataFrame:
    """(keys, pos, keep, posterior): state probabilities of every item, uniform start. ``keep`` names columns that come
    along; ``dealt`` says that the rows lie as ``dealt`` leaves them. With ``scores``, the emission of every value of a kind in every
    state, ``items`` are what ``packed`` makes, and the result is (sums) per task: the posteriors summed by value."""
    keys = list(keys)
    n = len(model.log_a)
    uniform = Model(model.log_a, model.start - np.log(n), model.columns, model.out)
    if scores is not None:

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(scores))
            for batch in batches:
                for sizes, codes, kinds in zip(*(batch[c] for c in ("sizes", "codes", "kinds")), strict=True):
                    of = [np.frombuffer(x.as_buffer(), t) for x, t in ((sizes, np.int64), (codes, np.int32), (kinds, np.uint8))]
                    total += _expected(*of[:2], of[2].reshape(-1, n), scores, uniform.log_a, uniform.start)
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["sums"])

        return items.select("sizes", "codes", "kinds").mapInArrow(summed, "sums array<double>")
    rows, edges, prepare = _blocks(items, uniform, keys, emit, 1.0, 0.0, None, False, block_rows, keep, dealt)

    def solve(rows: pa.Table, sizes: np.ndarray) -> pa.Array:
        g = _smoothed(sizes, _emitted(rows, uniform), uniform.log_a, uniform.start)
        return pa.ListArray.from_arrays(np.arange(0, g.size + 1, n, dtype=np.int32), g.ravel())

    def smooth(pdf: pd.DataFrame, edge: pd.DataFrame) -> pd.DataFrame:
        pdf, e, _ = prepare(pdf)
        entry = np.asarray(edge["__entry"].iloc[0]) if len(edge) else np.zeros(0)
        behind = np.asarray(edge["__behind"].iloc[0]) if len(edge) else None
        g = _smoothed(np.array([len(e)]), e, uniform.log_a, uniform.start, entry if len(entry) else None, behind)
        out = pdf[keys + ["pos"]].copy()
        out["posterior"] = list(g)
        return out

    return _finish(items, rows, edges, keys, list(keep), "posterior", T.ArrayType(T.DoubleType()), solve, smooth)


def decode(
    items: DataFrame, model: Model, probs: str, p_off: str, off: int, tau: float = 1.01, beta: float = 0.0,
    gamma: float = 1.0, delta: float = 0.0, anchors: str | None = None, keys: Sequence[str] = ("seq",),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``items`` plus state, extra labels with a probability of at least ``tau``, the state's
    own probability and p_off."""
    from passages.operators.sequence import emissions

    scored = items.withColumn("__emit", emissions(probs, p_off, beta))
    path = viterbi(scored, model, gamma, delta, "__emit", anchors, keys, block_rows)
    rows = items.join(path, [*keys, "pos"])
    total = F.aggregate(probs, F.lit(0.0), lambda s, p: s + p)
    extra = F.filter(
        F.transform(probs, lambda p, i: F.when((p >= tau) & (i != F.col("state")), i)), lambda v: v.isNotNull()
    )
    on = (1 - F.col(p_off)) * F.get(F.col(probs), F.col("state")) / total
    return rows.select(
        *items.columns, "state", extra.cast("array<int>").alias("extra"),
        F.when(F.col("state") == off, F.col(p_off)).otherwise(on).alias("p_state"),
    )
