"""Local image descriptors: cropped, resized, turned or otherwise edited copies by corners, binary tests and a consensus.

Images are columns of grey values with a width and a height. Corners are found at several scales by the smaller eigenvalue of the
structure tensor; around each, pairs of smoothed pixels are compared along the direction of its intensity centroid (a 128-bit
string). Strings are cut into five parts and joined through ten tables, one for every two parts: strings that agree in two parts
meet, which covers every pair within Hamming distance 3, and a meeting counts if the whole strings differ in at most ``APART``
bits. Scales meet each other. A meeting votes for a change of size, a turn and an offset, and images in which enough distinct corners
agree on all three match. Equal images are one class from the start.

Only corners that share a key with some query leave the index side: the queries' keys go to the tasks as a table of bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.llm.phrases import Bits
from passages.llm.words import mix
from passages.session import checkpoint_dir

SIDE = 64
CORNERS = 24
SCALES = (1, 2)
BITS = 128
PARTS = (26, 26, 26, 25, 25)
PAIRS = [(i, j) for i in range(5) for j in range(i)]
APART = 20
EVERY = 20
TURNS = 12
REACH = 6
CELL = 3
EDITS = ("crop", "half", "turn", "dark")


def _tests() -> np.ndarray:
    """BITS pairs of points (x1, y1, x2, y2) within REACH of the centre, the same on every machine."""
    draw = np.random.default_rng(11)
    points = np.clip(draw.normal(0, REACH / 2, (BITS, 4)), -REACH + 1, REACH - 1)
    return points


TESTS = _tests()


def draw_images(vectors: np.ndarray, side: int = SIDE) -> np.ndarray:
    """Grey images of vectors: every component weighs a smooth random pattern of its own, the same on every machine.

    Different vectors give different textures, near ones near textures. Values are bytes."""
    d = vectors.shape[1]
    noise = np.random.default_rng(5).normal(0, 1, (d, side, side)).astype(np.float32)
    pattern = _box(noise, 1).reshape(d, -1) / 3
    scaled = vectors / (np.sqrt((vectors**2).sum(1, keepdims=True)) + 1e-9)
    return np.clip(np.round(128 + 45 * (scaled.astype(np.float32) @ pattern)), 0, 255).astype(np.uint8).reshape(-1, side, side)


def edited(image: np.ndarray, key: int, kind: str) -> np.ndarray:
    """A copy of an image: three quarters of it at a place that follows from the key and a little darker, half its size, a quarter
    turn, or much darker."""
    h, w = image.shape
    if kind == "crop":
        a, b = h * 3 // 4, w * 3 // 4
        y, x = (key * 11) % (h - a + 1), (key * 7) % (w - b + 1)
        return np.round(image[y : y + a, x : x + b] * 0.85 + 8).astype(np.uint8)
    if kind == "half":
        even = image[: h // 2 * 2, : w // 2 * 2].astype(np.float32)
        return np.round(even.reshape(h // 2, 2, w // 2, 2).mean((1, 3))).astype(np.uint8)
    if kind == "turn":
        return np.ascontiguousarray(np.rot90(image))
    return np.round(image * 0.7 + 20).astype(np.uint8)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sum over the (2r + 1)-square around every pixel, zero outside."""
    padded = np.pad(a, ((0, 0), (r + 1, r), (r + 1, r)))
    s = padded.cumsum(1).cumsum(2)
    k = 2 * r + 1
    return s[:, k:, k:] - s[:, :-k, k:] - s[:, k:, :-k] + s[:, :-k, :-k]


def describe(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """(image, scale, x, y, turn, bits[BITS]) of the strongest corners of each of some images of one size, at each scale.

    Places are those of the whole image in half pixels, corners of equal strength go by place."""
    out = []
    for scale in SCALES:
        a = images.astype(np.float32)
        if scale > 1:
            n, h, w = a.shape
            a = a[:, : h // scale * scale, : w // scale * scale].reshape(n, h // scale, scale, w // scale, scale).mean((2, 4))
        n, h, w = a.shape
        if min(h, w) < 4 * REACH:
            continue
        gx, gy = np.zeros_like(a), np.zeros_like(a)
        gx[:, :, 1:-1], gy[:, 1:-1, :] = a[:, :, 2:] - a[:, :, :-2], a[:, 2:, :] - a[:, :-2, :]
        xx, yy, xy = _box(gx * gx, 1), _box(gy * gy, 1), _box(gx * gy, 1)
        strength = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
        border = np.zeros((h, w), bool)
        border[REACH + 2 : h - REACH - 2, REACH + 2 : w - REACH - 2] = True
        peak = strength.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dx or dy:
                    np.maximum(peak, np.roll(strength, (dy, dx), (1, 2)), out=peak)
        strength[~((strength >= peak) & border & (strength > 50))] = 0
        flat = strength.reshape(n, -1)
        top = np.argsort(-flat, axis=1, kind="stable")[:, : CORNERS // scale]
        image, rank = np.nonzero(np.take_along_axis(flat, top, 1) > 0)
        y, x = np.divmod(top[image, rank], w)
        smooth = _box(a, 1)
        grid = np.arange(-REACH, REACH + 1)
        patch = smooth[image[:, None, None], y[:, None, None] + grid[None, :, None], x[:, None, None] + grid[None, None, :]]
        angle = np.arctan2((patch * grid[None, :, None]).sum((1, 2)), (patch * grid[None, None, :]).sum((1, 2)))
        turn = np.round(angle / (2 * np.pi / TURNS)).astype(int) % TURNS
        angle = turn * (2 * np.pi / TURNS)
        c, s = np.cos(angle)[:, None], np.sin(angle)[:, None]

        def value(px, py):
            u = np.clip(np.round(c * px - s * py).astype(int), -REACH, REACH) + REACH
            v = np.clip(np.round(s * px + c * py).astype(int), -REACH, REACH) + REACH
            return patch[np.arange(len(patch))[:, None], v, u]

        bits = value(TESTS[:, 0], TESTS[:, 1]) < value(TESTS[:, 2], TESTS[:, 3])
        out.append((image, np.full(len(image), scale), (2 * x + 1) * scale, (2 * y + 1) * scale, turn, bits))
    if not out:
        return tuple(np.zeros(0, int) for _ in range(5)) + (np.zeros((0, BITS), bool),)
    return tuple(np.concatenate(parts) for parts in zip(*out))


def keys_of(bits: np.ndarray) -> np.ndarray:
    """(corners, tables) keys: the table and the two parts it looks at, spread over 64 bits."""
    parts, at = [], 0
    for size in PARTS:
        weights = np.uint64(1) << np.arange(size, dtype=np.uint64)
        parts.append((bits[:, at : at + size] * weights).sum(1, dtype=np.uint64))
        at += size
    return np.stack([mix((np.uint64(t) << np.uint64(58)) ^ (parts[i] << np.uint64(28)) ^ parts[j] ^ np.uint64(0x9E3779B9)) for t, (i, j) in enumerate(PAIRS)], 1)


KINDS = {"id": pa.int64(), **dict.fromkeys(("scale", "x", "y", "turn"), pa.int32()), **dict.fromkeys(("high", "low", "key"), pa.int64()), "table": pa.int32()}


def _corners(rows: DataFrame, edit: bool, wanted: Bits | None) -> DataFrame:
    """(id, scale, x, y, turn, high, low, key, table): a row per corner and table; with ``wanted`` only those whose key it has."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                by_size: dict[tuple, tuple[list, list]] = {}
                for key, data, h, w in zip(*(batch.slice(a, 256).column(c).to_pylist() for c in ("id", "image", "height", "width"))):
                    image = np.frombuffer(data, np.uint8).reshape(h, w)
                    if edit:
                        image = edited(image, key, EDITS[key // EVERY % len(EDITS)])
                    some = by_size.setdefault(image.shape, ([], []))
                    some[0].append(key)
                    some[1].append(image)
                for ids, images in by_size.values():
                    image, scale, x, y, turn, bits = describe(np.stack(images))
                    keys = keys_of(bits)
                    halves = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
                    keep = np.ones(keys.shape, bool) if shared.value is None else shared.value.has(keys.ravel()).reshape(keys.shape)
                    at, table = np.nonzero(keep)
                    own = np.array(ids, np.int64)[image[at]]
                    columns = [own, scale[at], x[at], y[at], turn[at], halves[at, 0], halves[at, 1], keys[at, table].view(np.int64), table]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS.values())], list(KINDS))

    return rows.select("id", "image", "height", "width").mapInArrow(run, ", ".join(f"{c} {'int' if t == pa.int32() else 'long'}" for c, t in KINDS.items()))


def rendered(vectors: DataFrame) -> DataFrame:
    """(id, image, width, height) of (vec_id, embedding): the vectors drawn as SIDE x SIDE grey pictures; null ones, empty ones and
    those with a null in them give a null image."""

    def run(batches):
        for batch in batches:
            by_size: dict[int, list] = {}
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                by_size.setdefault(len(v) if v and None not in v else 0, []).append((i, v))
            for size, some in by_size.items():
                images = [x.tobytes() for x in draw_images(np.array([v for _, v in some], np.float32))] if size else [None] * len(some)
                side = pa.array([SIDE if size else None] * len(some), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array(images, pa.binary()), side, side], ["id", "image", "width", "height"])

    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.mapInArrow(run, "id long, image binary, width int, height int")


def _same_part(parts: list[Column], i: int) -> Column:
    """Whether part i of two strings is equal, by the differing bits (high, low) of both."""
    start, end = sum(PARTS[:i]), sum(PARTS[: i + 1])
    out = F.lit(True)
    for half, value in enumerate(parts):
        a, b = max(start, 64 * half) - 64 * half, min(end, 64 * half + 64) - 64 * half
        if a < b:
            mask = ((1 << (b - a)) - 1) << (64 - b)
            out = out & (value.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)) == 0)
    return out


def meetings(asked: DataFrame, index: DataFrame) -> DataFrame:
    """Corners of queries and images that agree in two parts and differ in at most APART bits, each pair once: in the first table
    where it meets. (query, id, corner, ratio, turn, dx, dy)"""
    q = asked.select("key", "table", F.col("id").alias("query"), *[F.col(c).alias(f"q_{c}") for c in ("scale", "x", "y", "turn", "high", "low")])
    differ = [F.col(f"q_{c}").bitwiseXOR(F.col(c)) for c in ("high", "low")]
    near = F.bit_count(differ[0]) + F.bit_count(differ[1]) <= APART
    first = F.lit(len(PAIRS))
    for t in reversed(range(len(PAIRS))):
        i, j = PAIRS[t]
        first = F.when(_same_part(differ, i) & _same_part(differ, j), t).otherwise(first)
    index = index.withColumnRenamed("key", "own").withColumnRenamed("table", "own_table")
    met = q.join(index, (F.col("key") == F.col("own")) & (first == F.col("table")) & near)
    ratio, turn = F.col("scale") / F.col("q_scale"), F.pmod(F.col("turn") - F.col("q_turn"), F.lit(TURNS))
    angle = turn * (2 * np.pi / TURNS)
    x = ratio * (F.col("q_x") * F.cos(angle) - F.col("q_y") * F.sin(angle))
    y = ratio * (F.col("q_x") * F.sin(angle) + F.col("q_y") * F.cos(angle))
    cell = [F.floor((F.col(a) - b) / (2 * CELL * F.greatest(ratio, F.lit(1.0)))).alias(c) for a, b, c in (("x", x, "dx"), ("y", y, "dy"))]
    corner = F.struct("q_x", "q_y", "q_scale").alias("corner")
    return met.select("query", "id", corner, ratio.alias("ratio"), turn.alias("turn"), *cell)


def agreeing(met: DataFrame, votes: int) -> DataFrame:
    """(query, id, votes): the most distinct corners of a query that agree on one change of size, turn and offset."""
    met = met.groupBy("query", "id").agg(F.collect_set(F.struct("corner", "ratio", "turn", "dx", "dy")).alias("met"))
    met = met.filter(F.size("met") >= votes).select("query", "id", F.inline("met"))
    # the offset of a match lies in one cell or in up to four neighbours: a corner of the query counts once in every block of 2 x 2 cells
    blocks = F.array(*(F.struct((F.col("dx") - i).alias("bx"), (F.col("dy") - j).alias("by")) for i in (0, 1) for j in (0, 1)))
    agreed = met.select("query", "id", "corner", "ratio", "turn", F.inline(blocks))
    agreed = agreed.groupBy("query", "id", "ratio", "turn", "bx", "by").agg(F.size(F.collect_set("corner")).cast("long").alias("n"))
    return agreed.groupBy("query", "id").agg(F.max("n").alias("votes")).filter(F.col("votes") >= votes)


def copies(images: DataFrame, every: int = EVERY, votes: int = 5) -> DataFrame:
    """Search edited copies of some images in all: (id, class_id, is_query, matches), one row per row of ``images``.

    ``images`` has id, image (width x height bytes), width and height; other columns are ignored. class_id is the smallest id with the
    same pixels and size. Queries are the classes with an id divisible by ``every``; ``matches`` lists, in the order of
    class_id, the classes that agree with the edited copy in ``votes`` corners, [] if none and null for others. The kind of edit goes
    by id through EDITS. A null image, or one that has not width x height bytes, is in no class (null), no query and found by none."""
    checkpoint_dir(images.sparkSession)
    images = images.select("id", "image", "width", "height")
    fits = (F.length("image") == F.col("width") * F.col("height")) & (F.col("width") > 0) & F.col("id").isNotNull()
    images = images.withColumn("pixels", F.when(F.coalesce(fits, F.lit(False)), F.sha2(F.concat(F.col("width").cast("string").cast("binary"), F.lit(b":"), F.col("image")), 256)))
    whole = images.filter("pixels IS NOT NULL")
    classes = whole.groupBy("pixels").agg(F.min("id").alias("class_id"), F.max(F.col("id") % every == 0).alias("is_query"))
    firsts = whole.join(classes.select("pixels", F.col("class_id").alias("id"), "is_query"), ["pixels", "id"]).dropDuplicates(["id"])
    asked = _corners(firsts.filter("is_query"), True, None).checkpoint()
    wanted = Bits(asked.count()).filled(asked.select("key"))
    found = agreeing(meetings(asked, _corners(firsts, False, wanted)), votes)
    lists = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("class_id"), "votes"))).alias("matches"))
    none = F.array().cast("array<struct<class_id:bigint,votes:bigint>>")
    classes = classes.join(lists, F.col("class_id") == F.col("query"), "left")
    classes = classes.select("pixels", "class_id", "is_query", F.when(F.col("is_query"), F.coalesce("matches", none)).alias("matches"))
    out = images.select("id", "pixels").join(classes, "pixels", "left")
    return out.select("id", "class_id", F.coalesce("is_query", F.lit(False)).alias("is_query"), "matches")
