"""N-gram Jaccard self-join by a token-group matrix, and the classes its links form.

Sets of word shingles are put into groups of similar sets; the matrix holds the union of the tokens of each group. A
set is compared with a group only if enough of its tokens are in the union, and with the members of a group only after
the group has qualified. All steps are exact: the bounds lose no pair that reaches the threshold.

* Tokens have one global order: rare ones first (by a fixed-size histogram of all tokens), then by hash. Two linked sets
  of n >= m tokens share at least ``need = ceil(t (n + m) / (1 + t))``, which is no less than ``t n`` and ``2 t m / (1 + t)``.
  The larger shows its first ``n - ceil(t n) + extra`` tokens, the smaller puts its first ``m - ceil(2 t m / (1 + t)) +
  extra`` into the matrix, with ``extra = 1 + size // 32``. Shared tokens in either part are the first shared ones in the
  order, so the parts have at least ``need`` minus the larger unseen rest in common; ``1 + ceil(t n) // 32`` at least.
* Classes come first: sets that share one of a few minimum hashes are compared with the smallest set of that hash, and
  what is linked is one class. Most near copies meet here, with one comparison each.
* Groups are families of classes: a class joins the smallest set that agrees with one of its sets in some minimum hashes, linked or
  not. Inside a family all sets of different classes are compared in tiles of a bounded number of rows and tokens, which give links only.
* The matrix then only matters between families. A set's own family is done; another qualifies by its hits, and its
  members are compared with the set through the tokens they share, unless their sizes rule a link out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.batches import small_batches
from passages.llm.graph import components
from passages.llm.words import Words, lists, mix, shingles, signed, slices
from passages.session import checkpoint_dir

CELL_BITS = 20
PARTS = 16
PER_EXTRA = 32
BINS = 16
BANDS = 8
ALIKE = 9
KIN = 7
TILE_ROWS = 512
TILE_TOKENS = 1 << 20
COLUMNS = 4096


def _cells(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with the sorted shingle hashes of each row."""
    for part in slices(batch):
        yield part, shingles(Words(part.column("text"), fold=True), width)


def set_ids(rows: list[np.ndarray]) -> pa.Array:
    """A 64-bit name of each set that depends on its tokens alone."""
    total = np.array([mix(t).sum(dtype=np.uint64) for t in rows], np.uint64)
    return pa.array(signed(mix(total ^ np.array([len(t) for t in rows], np.uint64))))


def signature(tokens: np.ndarray) -> np.ndarray:
    """BINS minimum hashes from one: the first token in each of BINS equal ranges of hashes, or after it."""
    if not len(tokens):
        return np.zeros(BINS, np.int32)
    edges = np.arange(BINS, dtype=np.uint64) << np.uint64(60)
    return (tokens[np.searchsorted(tokens, edges) % len(tokens)] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def shown(tokens: np.ndarray, rank: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    need = -(-percent * n // 100)
    take = min(n, n - need + 1 + n // PER_EXTRA)
    order = np.lexsort((tokens, rank[_cells(tokens)]))
    return tokens[order[:take]]


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """One pass: a row (doc_id, n, sid) per document, and per task PARTS rows of token counts by cell."""

    def run(batches):
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            for part, rows in sets(batch, width):
                n = np.array([len(t) for t in rows], np.int64)
                if n.sum():
                    cells += np.bincount(_cells(np.concatenate(rows)), minlength=1 << CELL_BITS).astype(np.uint32)
                none = pa.nulls(len(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), set_ids(rows), none.cast(pa.int32()), none.cast(pa.binary())],
                    ["doc_id", "n", "sid", "part", "cells"],
                )
        if cells.any():
            none = pa.nulls(PARTS).cast(pa.int64())
            blobs = [pa.compress(c.tobytes(), "zstd", asbytes=True) for c in np.split(np.minimum(cells, 65535).astype("<u2"), PARTS)]
            yield pa.RecordBatch.from_arrays(
                [none, none, none, pa.array(range(PARTS), pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "n", "sid", "part", "cells"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n long, sid long, part int, cells binary"
    )


def _summed(kind: str, width: int):
    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("cells")):
                raw = pa.decompress(blob.as_py(), width * (1 << CELL_BITS) // PARTS, "zstd", asbytes=True)
                counts = np.frombuffer(raw, kind).astype(np.uint64)
                total[part] = total[part] + counts if part in total else counts
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([pa.compress(t.astype("<u8").tobytes(), "zstd", asbytes=True) for t in total.values()], pa.binary())], ["part", "cells"]
        )

    return run


def token_ranks(profile: DataFrame) -> np.ndarray:
    """Class of each of the 2^20 cells: the bits of its count. Summed in two steps; the result has a fixed size of 1 MB."""
    rows = profile.filter("part IS NOT NULL").select("part", "cells", (F.spark_partition_id() % 32).alias("salt"))
    once = rows.repartition("part", "salt").select("part", "cells").mapInArrow(_summed("<u2", 2), "part int, cells binary")
    total = once.repartition("part").mapInArrow(_summed("<u8", 8), "part int, cells binary").collect()
    ranks = np.zeros(1 << CELL_BITS, np.uint8)
    size = (1 << CELL_BITS) // PARTS
    for row in total:
        counts = np.frombuffer(pa.decompress(bytes(row["cells"]), 8 * size, "zstd", asbytes=True), "<u8")
        ranks[row["part"] * size :][:size] = np.ceil(np.log2(counts + 1.0)).astype(np.uint8)
    return ranks


def _shown_tokens(docs: DataFrame, ranks: np.ndarray, width: int, percent: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        for batch in batches:
            for part, rows in sets(batch, width):
                take = [shown(t, shared.value, percent) for t in rows]
                n = np.array([len(t) for t in rows], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n.astype(np.int32)),
                        set_ids(rows),
                        pa.array([signature(t) for t in rows], pa.list_(pa.int32())),
                        lists(signed(np.concatenate([*take, np.zeros(0, np.uint64)])), [len(t) for t in take], pa.int64()),
                    ],
                    ["doc_id", "n", "sid", "sig", "tokens"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n int, sid long, sig array<int>, tokens array<long>"
    )


def _meetings(batches, percent):
    """Rows sorted by token in; (set, other group, hits) out, added up over the tokens of a stretch of rows.

    A group is met where one of its sets may be the smaller one of a link: no larger than the set, and ``percent`` of it at least."""

    def count(token, sid, group, size):
        # the matrix: groups by token, with the smallest and the largest set that shows the token early
        early = np.flatnonzero(size > 0)
        early = early[np.lexsort((size[early], group[early], token[early]))]
        first = np.flatnonzero(np.r_[True, (token[early][1:] != token[early][:-1]) | (group[early][1:] != group[early][:-1])]) if len(early) else early
        at = early[first]
        cell_token, cell_group, cell_low = token[at], group[at], size[at]
        cell_high = np.maximum.reduceat(size[early], first) if len(early) else cell_low
        cell_first = np.searchsorted(cell_token, token, "left")
        cells = np.searchsorted(cell_token, token, "right") - cell_first
        out, rows = [], 0
        # one cell per row and step, so that the arrays stay as long as the rows
        for k in range(int(cells.max(initial=0))):
            some = np.flatnonzero(cells > k)
            cell = cell_first[some] + k
            n = np.abs(size[some]).astype(np.int64)
            keep = (cell_group[cell] != group[some]) & (cell_low[cell] <= n) & (cell_high[cell].astype(np.int64) * 100 >= percent * n)
            out.append(np.stack([sid[some[keep]], cell_group[cell[keep]]]))
            rows += keep.sum()
            if rows > 1 << 20:
                yield added(out)
                out, rows = [], 0
        if rows:
            yield added(out)

    def added(out):
        sid, group = np.concatenate(out, axis=1)
        order = np.lexsort((group, sid))
        sid, group = sid[order], group[order]
        at = np.flatnonzero(np.r_[True, (sid[1:] != sid[:-1]) | (group[1:] != group[:-1])])
        hits = np.diff(np.r_[at, len(sid)])
        return pa.RecordBatch.from_arrays([pa.array(sid[at]), pa.array(group[at]), pa.array(hits.astype(np.int64))], ["id", "grp", "hits"])

    held, rows, enough = [], 0, 200_000
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held)
        tokens = table.column("token").to_numpy()
        cut = int(np.searchsorted(tokens, tokens[-1], "left"))
        if cut:
            done = table.slice(0, cut)
            yield from count(*(done.column(c).to_numpy() for c in ("token", "id", "grp", "size")))
            held = table.slice(cut).combine_chunks().to_batches()
            rows = sum(b.num_rows for b in held)
        enough = max(200_000, 2 * rows)
    if rows:
        table = pa.Table.from_batches(held)
        yield from count(*(table.column(c).to_numpy() for c in ("token", "id", "grp", "size")))


def _id_filter(ids: DataFrame, column: str, bits: int = 22) -> np.ndarray:
    """A bit table of fixed size (512 KB) over hashed ids; it lets some others pass."""
    cell = F.pmod(F.xxhash64(column), F.lit(1 << bits))
    words = ids.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))).alias("m"))
    table = np.zeros(1 << (bits - 6), np.int64)
    for r in words.toLocalIterator():
        table[r["w"]] = r["m"]
    return table


def _filtered(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """The rows whose id may be in the table; the bits travel as one broadcast of fixed size."""
    bits = docs.sparkSession.sparkContext.broadcast(table)
    size = len(table) * 64

    def run(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            keep = (bits.value[cell >> 6] >> (cell & 63)) & 1
            yield batch.filter(pa.array(keep.astype(bool))).select(["doc_id", "text"])

    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(size)).alias("cell")
    )
    return hashed.mapInArrow(run, "doc_id long, text string")


def _tokens_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, tokens) of the named sets (id, s), read from the texts anew."""

    def run(batches):
        for batch in batches:
            for part, rows in sets(batch, width):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), set_ids(rows), pa.array([t.tobytes() for t in rows], pa.binary())], ["id", "sid", "tokens"]
                )

    read = _filtered(docs, _id_filter(ids, "id")).mapInArrow(run, "id long, sid long, tokens binary")
    return read.join(ids, "id").filter("sid = s").select("id", "tokens")


def _verified(docs: DataFrame, table: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the threshold, with both sizes compared exactly."""

    def run(batches):
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a, b = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    pairs = pairs.select("a", "b").distinct().checkpoint()
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    ids = ids.join(table.select("id", F.col("sid").alias("s")).distinct(), "id").checkpoint()
    tokens = _tokens_of(docs, ids, width)
    joined = pairs.join(tokens.toDF("a", "left"), "a").join(tokens.toDF("b", "right"), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long").checkpoint()


def _families(label: DataFrame, near: DataFrame) -> DataFrame:
    """``label`` with the family of each class: the class of the smallest set that one of its sets is near to, and that one's in turn."""
    of = label.select("id", "grp")
    up = near.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("a")).join(of, "id").join(of.toDF("a", "to"), "a")
    up = up.filter("to < grp").groupBy("grp").agg(F.min("to").alias("to")).checkpoint()
    top = up.join(up.toDF("to", "further"), "to", "left").select("grp", F.coalesce("further", "to").alias("family"))
    return label.join(top, "grp", "left").select("id", "n", "grp", F.coalesce("family", "grp").alias("family")).checkpoint()


def _tiles(label: DataFrame, rows: int | None = None, tokens: int | None = None) -> DataFrame:
    """(tile, side, id, grp): the sets of each family with several classes dealt to blocks, and every two blocks side by side once.

    A block has about ``rows`` sets and ``tokens`` tokens. Small classes share blocks; a large one has blocks of its own, which
    are not compared with each other. A small block beside itself is one side."""
    rows, tokens = rows or TILE_ROWS, tokens or TILE_TOKENS
    classes = label.groupBy("family", "grp").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens"))
    mixed = classes.groupBy("family").agg(F.count("*").alias("classes")).filter("classes > 1").select("family")
    large = (F.col("sets") * 2 > rows) | (F.col("tokens") * 2 > tokens)
    classes = classes.join(mixed, "family").withColumn("large", large).withColumn("own", F.when(large, F.col("grp")).otherwise(F.lit(0))).checkpoint()
    slots = F.ceil(F.greatest(F.sum("sets") / rows, F.sum("tokens") / tokens))
    dealt = classes.groupBy("family", "large", "own").agg(slots.alias("slots"))
    spread = F.when(F.col("large"), F.xxhash64("id")).otherwise(F.xxhash64("grp"))
    sets = label.join(classes.select("family", "grp", "large", "own"), ["family", "grp"]).join(dealt, ["family", "large", "own"])
    sets = sets.select("id", "grp", "family", F.struct("large", "own", F.pmod(spread, F.col("slots")).alias("slot")).alias("block")).checkpoint()
    blocks = sets.select("family", "block").distinct()
    pairs = blocks.join(blocks.withColumnRenamed("block", "other"), "family").filter("block <= other")
    pairs = pairs.filter("NOT (block.large AND other.large AND block.own = other.own)")
    pairs = pairs.withColumn("tile", F.monotonically_increasing_id()).checkpoint()
    left = pairs.select("family", "block", "tile", F.lit(0).alias("side"))
    right = pairs.filter("block < other").select("family", F.col("other").alias("block"), "tile", F.lit(1).alias("side"))
    return sets.join(left.unionByName(right), ["family", "block"]).select("tile", "side", "id", "grp")


def shared_tokens(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of the left shares with each of the right: a product over the columns both have, a few at a time.

    Columns with few entries add one to each of their pairs instead, which costs less."""
    shape = len(left), len(right)
    both = np.zeros(shape, np.int64)
    tokens = [np.concatenate([*x, np.zeros(0, np.uint64)]) for x in (left, right)]
    common = np.intersect1d(*tokens)
    if not len(common):
        return both
    entries = []
    for x, flat in zip((left, right), tokens):
        row = np.repeat(np.arange(len(x)), [len(t) for t in x])
        column = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        keep = common[column] == flat
        row, column = row[keep], column[keep]
        order = np.argsort(column, kind="stable")
        entries.append((row[order], column[order]))
    (lrow, lcol), (rrow, rcol) = entries
    start = np.searchsorted(rcol, np.arange(len(common) + 1))
    pairs = np.bincount(lcol, minlength=len(common)) * np.diff(start)
    rare = 100 * pairs <= shape[0] * shape[1]
    some = np.flatnonzero(rare[lcol])
    times = np.diff(start)[lcol[some]]
    part = np.cumsum(times) // (1 << 20)
    for k in np.unique(part):
        at, n = some[part == k], times[part == k]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[lcol[at]], n)
        both += np.bincount(np.repeat(lrow[at], n) * shape[1] + rrow[place], minlength=both.size).reshape(shape)
    number = np.cumsum(~rare) - 1
    for a in range(0, int((~rare).sum()), COLUMNS):
        sides = []
        for n, row, col in ((shape[0], lrow, lcol), (shape[1], rrow, rcol)):
            here = ~rare[col] & (number[col] >= a) & (number[col] < a + COLUMNS)
            side = np.zeros((n, COLUMNS), np.float32)
            side[row[here], number[col[here]] - a] = 1
            sides.append(side)
        both += (sides[0] @ sides[1].T).astype(np.int64)
    return both


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places of pairs of classes that are enough to join what all of them join."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    _, first = np.unique(np.stack([a, b]), axis=1, return_index=True)
    for k in first.tolist():
        x, y = root(int(a[k])), root(int(b[k]))
        if x != y:
            parent[x] = y
            out.append(k)
    return out


def _tile_links(percent: int):
    """Rows sorted by tile in; links (a, b) between sets of different classes out, as many as join what the tile's links join."""

    def links(side, ids, grp, tokens):
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left
        both = shared_tokens([tokens[i] for i in left], [tokens[i] for i in right])
        n = np.array([len(t) for t in tokens], np.int64)
        linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
        x, y = np.nonzero(linked & (grp[left][:, None] != grp[right][None, :]))
        x, y = left[x], right[y]
        some = _forest(grp[x], grp[y])
        a, b = ids[x[some]], ids[y[some]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held: list[tuple] = []
        now = None

        def done():
            side, ids, grp = (np.concatenate([h[k] for h in held]) for k in range(3))
            return links(side, ids, grp, [t for h in held for t in h[3]])

        for batch in batches:
            tile = batch.column("tile").to_numpy()
            side, ids, grp = (batch.column(c).to_numpy() for c in ("side", "id", "grp"))
            edges = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True]) if len(tile) else np.zeros(0, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if held and tile[a] != now:
                    yield done()
                    held = []
                now = tile[a]
                held.append((side[a:b], ids[a:b], grp[a:b], [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens").slice(a, b - a)]))
        if held:
            yield done()

    return run


def _within(docs: DataFrame, table: DataFrame, label: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the classes of each family, with both sets compared whole."""
    dealt = _tiles(label).checkpoint()
    ids = dealt.select("id").distinct().join(table.select("id", F.col("sid").alias("s")), "id").checkpoint()
    rows = dealt.join(_tokens_of(docs, ids, width), "id").select("tile", "side", "id", "grp", "tokens")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_links(percent), "a long, b long").checkpoint()


def jaccard_classes(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents whose shingle sets are linked: (doc_id, n_shingles, component_id).

    ``docs`` has doc_id and text; other columns are ignored. A-Z are lower-cased; a document's set is its distinct
    shingles of ``width`` words, its whole word sequence if it has fewer words, and empty (linked with nothing) without
    any. Null texts count as empty, rows with a null doc_id are left out, and of rows that repeat a doc_id the one with
    the largest set counts. Sets with the same tokens are one set from the start, so copies cost nothing later. An empty table gives
    an empty result."""
    checkpoint_dir(docs.sparkSession)
    with small_batches(docs.sparkSession):
        return _classes(docs.filter("doc_id IS NOT NULL"), width, percent)


def _classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    profile = _profile(docs, width).checkpoint()
    ranks = token_ranks(profile)
    sizes = profile.filter("part IS NULL").groupBy("doc_id").agg(F.max(F.struct("n", "sid")).alias("s")).select("doc_id", "s.n", "s.sid")
    first = sizes.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("id"))
    kept = first.select(F.col("id").alias("doc_id"), F.col("sid").alias("s"))
    seen = _shown_tokens(docs, ranks, width, percent).join(kept, "doc_id").filter("sid = s")
    table = seen.select(F.col("doc_id").alias("id"), "n", "sid", "sig", "tokens").dropDuplicates(["id"]).checkpoint()
    near = _near(table).checkpoint()
    links = _verified(docs, table, _alike(near, percent), width, percent)
    label = table.select("id", "n").join(components(links).toDF("id", "grp"), "id", "left").withColumn("grp", F.coalesce("grp", "id")).checkpoint()
    label = _families(label, near)
    links = links.unionByName(_within(docs, table, label, width, percent))
    label = label.select("id", "n", F.col("family").alias("grp"))
    flat = table.select("id", "n", "tokens").join(label.select("id", "grp"), "id")
    flat = flat.select("id", "grp", "n", F.posexplode_outer("tokens").alias("pos", "token"))
    flat = flat.select("id", "grp", F.when(F.col("pos") < _early("n", percent), F.col("n")).otherwise(-F.col("n")).cast("int").alias("size"), "token")
    hits = flat.repartition("token").sortWithinPartitions("token").mapInArrow(lambda batches: _meetings(batches, percent), "id long, grp long, hits long")
    need = F.ceil(F.col("n") * percent / F.lit(100))
    met = hits.groupBy("id", "grp").agg(F.sum("hits").alias("hits")).join(label.select("id", "n"), "id")
    fits = met.filter(F.col("hits") >= 1 + F.floor(need / PER_EXTRA)).select("id", "n", "grp").checkpoint()
    links = links.unionByName(_verified(docs, table, _between(table, label, fits, percent), width, percent))
    joined = components(links)
    classes = first.join(joined.toDF("id", "component_id"), "id", "left").select("sid", F.coalesce("component_id", "id").alias("component_id"))
    return (
        sizes.join(classes, "sid", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def _sizes(n: str, m: str, percent: int):
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _shown(n: str, percent: int):
    """How many tokens a set shows: enough to meet every smaller set it links with."""
    return F.least(F.col(n), F.col(n) - F.ceil(F.col(n) * percent / F.lit(100)) + 1 + F.floor(F.col(n) / PER_EXTRA))


def _early(n: str, percent: int):
    """How many of them the matrix holds: enough to meet every larger set it links with."""
    return F.least(F.col(n), F.col(n) - F.ceil(F.col(n) * 2 * percent / F.lit(100 + percent)) + 1 + F.floor(F.col(n) / PER_EXTRA))


def _near(table: DataFrame) -> DataFrame:
    """(a, m, b, n, agree): each set b and the smallest one with the same minimum hash, if KIN of BINS hashes agree."""
    bands = F.array([F.get("sig", F.lit(k * BINS // BANDS)) for k in range(BANDS)])
    keyed = table.select("id", "n", "sig", F.posexplode(bands).alias("band", "key"))
    pivots = keyed.groupBy("band", "key").agg(F.min(F.struct("id", "n", "sig")).alias("p"), F.count("*").alias("size")).filter("size > 1")
    near = keyed.join(pivots.select("band", "key", F.col("p.id").alias("a"), F.col("p.n").alias("m"), F.col("p.sig").alias("other")), ["band", "key"])
    agree = F.size(F.filter(F.zip_with("sig", "other", lambda x, y: x == y), lambda same: same))
    return near.filter("id <> a").select("a", "m", F.col("id").alias("b"), "n", agree.alias("agree")).filter(F.col("agree") >= KIN).distinct()


def _alike(near: DataFrame, percent: int) -> DataFrame:
    """Pairs of near sets (a, b) of which ALIKE hashes agree and whose sizes allow a link."""
    return near.filter(_sizes("n", "m", percent)).filter(F.col("agree") >= ALIKE).select("a", "b")


def _between(table: DataFrame, label: DataFrame, fits: DataFrame, percent: int) -> DataFrame:
    """Pairs of a set and a member of a qualified group that share enough shown tokens and differ little in size."""
    kinds = label.groupBy("grp").agg(F.max("n").alias("top"), F.min("n").alias("low"))
    sized = (F.col("top") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("low") * percent)
    open_ = fits.join(kinds, "grp").filter(sized).select("id", "n", "grp").checkpoint()
    wanted = label.join(open_.select("grp").distinct(), "grp", "left_semi").select("id", "grp")
    ids = wanted.select("id").union(open_.select("id")).distinct()
    part = table.join(ids, "id", "left_semi").select("id", "n", "tokens").checkpoint()
    early = F.slice("tokens", F.lit(1), _early("n", percent).cast("int"))
    left = part.select("id", "tokens").join(open_, "id").select("id", "n", "grp", F.explode_outer("tokens").alias("token"))
    right = part.join(wanted, "id").select(F.col("id").alias("other"), F.col("n").alias("m"), "grp", F.explode_outer(early).alias("token"))
    met = left.join(right, ["token", "grp"]).filter(F.col("m") <= F.col("n")).filter(_sizes("n", "m", percent))
    both = F.ceil((F.col("n") + F.col("m")) * percent / F.lit(100 + percent))
    unseen = F.greatest(F.col("n") - _shown("n", percent), F.col("m") - _early("m", percent))
    shared = met.groupBy("id", "n", "other", "m").agg(F.count("*").alias("hits")).filter(F.col("hits") >= F.greatest(F.lit(1), both - unseen))
    return shared.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
