"""Copies of images: recall by kind of edit, precision, the join against all pairs, votes, and awkward rows."""

import numpy as np
import pytest

from passages.llm import images

SCHEMA = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def found(spark):
    draw = np.random.default_rng(1)
    vectors = [(i, draw.normal(size=24).tolist()) for i in range(400)] + [(1000 + i, [1.0, -1.0] * 12) for i in range(40)]
    vectors += [(2000, None), (2001, []), (2002, [1.0, None]), (None, [1.0])]
    rows = images.copies(images.rendered(spark.createDataFrame(vectors, SCHEMA).repartition(3)), every=5).collect()
    assert len(rows) == 443
    return {r["id"]: r for r in rows}


@pytest.mark.parametrize("kind", images.EDITS)
def test_recall_of_each_edit(found, kind):
    asked = [r for i, r in found.items() if r["is_query"] and i < 400 and images.EDITS[i // images.EVERY % 4] == kind]
    assert len(asked) == 20
    assert np.mean([any(m["class_id"] == r["class_id"] for m in r["matches"]) for r in asked]) >= 0.9


def test_unrelated_images_do_not_match(found):
    assert all(m["class_id"] == r["class_id"] for r in found.values() for m in r["matches"] or ())


def test_every_image_has_a_row(found):
    assert {found[1000 + i]["class_id"] for i in range(40)} == {1000}
    for i in (2000, 2001, 2002):
        assert found[i]["class_id"] is None and not found[i]["is_query"] and found[i]["matches"] is None


def corners(spark, bits, ids):
    keys, halves = images.keys_of(bits), np.packbits(bits, axis=1).view(">i8").astype(np.int64)
    rows = [(int(i), 1, 10 * n, 10 * n, 0, int(h[0]), int(h[1]), int(k), t) for n, (i, h, ks) in enumerate(zip(ids, halves, keys)) for t, k in enumerate(ks.view(np.int64).tolist())]
    return spark.createDataFrame(rows, "id long, scale int, x int, y int, turn int, high long, low long, key long, table int")


def test_meetings_are_those_of_all_pairs(spark):
    draw = np.random.default_rng(2)
    a = draw.random((40, images.BITS)) < 0.5
    flips = [0, 1, 2, 3, 3, 4, 6, 10, 25, 40]
    b = np.concatenate([a[i : i + 1] for i in range(40) for _ in flips])
    for row, n in zip(b, flips * 40):
        row[draw.choice(images.BITS, n, replace=False)] ^= True
    edges = np.cumsum([0, *images.PARTS])
    want, near = set(), set()
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            differ = x != y
            same = sum(not differ[s:e].any() for s, e in zip(edges[:-1], edges[1:]))
            if same >= 2 and differ.sum() <= images.APART:
                want.add((i, j))
            if differ.sum() <= 3:
                near.add((i, j))
    met = images.meetings(corners(spark, a, range(40)), corners(spark, b, range(len(b)))).select("query", "id").collect()
    assert len(met) == len(want) and {tuple(r) for r in met} == want and near <= want and len(near) >= 200


def test_votes_ask_for_one_size_turn_and_offset(spark):
    """Image 1 agrees in x alone, 2 in one corner met many times, 3 in one offset across cells, 4 in no one turn, 5 in half the size."""
    rows = [(0, 1, (k, k, 1), 1.0, 0, 0, k) for k in range(6)]
    rows += [(0, 2, (0, 0, 1), 1.0, 0, k, 0) for k in range(9)]
    rows += [(0, 3, (k, k, 1), 1.0, 0, 4 + k % 2, 7 - k % 2) for k in range(6)]
    rows += [(0, 4, (k, k, 1), 1.0, k, 0, 0) for k in range(6)]
    rows += [(0, 5, (k, k, 1), 0.5, 3, 1, 1) for k in range(5)] + [(0, 5, (9, 9, 1), 2.0, 3, 1, 1)]
    met = spark.createDataFrame(rows, "query long, id long, corner struct<q_x:int,q_y:int,q_scale:int>, ratio double, turn int, dx long, dy long")
    assert sorted(tuple(r) for r in images.agreeing(met, 5).collect()) == [(0, 3, 6), (0, 5, 5)]


def test_sizes_nulls_repeats_and_clashing_columns(spark):
    draw = np.random.default_rng(4)
    made = images.draw_images(draw.normal(size=(2, 24)).astype(np.float32), 96)
    whole, other = made
    part = np.ascontiguousarray(whole[10:80, 5:90])
    rows = [(0, whole.tobytes(), 96, 96), (1, part.tobytes(), 85, 70), (2, other.tobytes(), 96, 96), (3, whole.tobytes(), 96, 95), (4, None, 96, 96), (5, b"", 0, 0)]
    rows += [(6, b"abc", None, 1), (7, b"abc", 3, 1), (None, whole.tobytes(), 96, 96), (0, whole.tobytes(), 96, 96)]
    df = spark.createDataFrame([(i, None if x is None else bytearray(x), w, h, "k", 1) for i, x, w, h in rows], "id long, image binary, width int, height int, pixels string, table int")
    got = images.copies(df).collect()
    assert len(got) == len(rows)
    first = next(r for r in got if r["id"] == 0)
    assert first["is_query"] and [m["class_id"] for m in first["matches"]] == [0, 1]
    assert {r["id"]: r["class_id"] for r in got if r["id"] != 0} == {1: 1, 2: 2, 3: None, 4: None, 5: None, 6: None, 7: 7, None: None}
    assert images.copies(df.limit(0)).count() == 0
