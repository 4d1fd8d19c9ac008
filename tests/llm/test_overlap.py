"""Near copies, repeated passages and benchmark items against brute force, with the awkward rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passages.llm import jaccard
from passages.llm.decontaminate import contained_items, decontaminate
from passages.llm.graph import components
from passages.llm.jaccard import jaccard_classes
from passages.llm.substrings import remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(rows):
    sets = {d: shingle_set(t) for d, t in rows}
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                x, y = sets[a], sets[b]
                if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def cut(rows, length=13):
    words = {d: WORD.findall(t or "") for d, t in rows}
    owner = {}
    for d in sorted(words):
        for i in range(len(words[d]) - length + 1):
            owner.setdefault(tuple(words[d][i : i + length]), d)
    out = {}
    for d, w in words.items():
        gone = {i + k for i in range(len(w) - length + 1) if owner[tuple(w[i : i + length])] < d for k in range(length)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def corpus():
    """Chains of near copies, shared passages, a large group of copies, hot words, empty and null texts, odd white space."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocabulary) for _ in range(60)]
    rows, base = [], None
    for i in range(160):
        w = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        if i % 4 == 1:
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
        if i % 7 == 3:
            at = rnd.randint(0, len(w))
            w[at:at] = passage[rnd.randint(0, 30) :]
        base = w
        rows.append((i * 3, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(1000 + i, "The " * 40 + "end") for i in range(30)]
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "one"), (2004, "ONE"), (2005, "a b c d"), (2006, "  x y"), (2007, "z " * 30_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_classes(spark, corpus):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(frame(spark, corpus)).collect()}
    assert got == classes(corpus)


def test_large_group_of_near_copies(spark):
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rnd.randint(1, 3)):
            w[rnd.randrange(100)] = f"x{rnd.randint(0, 50)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(frame(spark, rows)).collect()}
    assert got == classes(rows)


def family(size):
    """Texts of one family, most pairs of them just under the threshold."""
    rnd = random.Random(6)
    base, rows = [f"b{i}" for i in range(120)], []
    for i in range(size):
        w = list(base)
        for k in rnd.sample(range(120), 2 if i % 5 else 1):
            w[k] = f"x{rnd.randint(0, 40)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows_of_a_tile", [6, 512])
def test_family_just_under_the_threshold(spark, monkeypatch, rows_of_a_tile):
    monkeypatch.setattr(jaccard, "TILE_ROWS", rows_of_a_tile)
    rows = family(90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_classes(frame(spark, rows)).collect()}
    assert got == classes(rows) and len({c for _, c in got.values()}) > 1


def test_meetings_do_not_grow_with_the_square_of_a_family(spark, monkeypatch):
    made, real = spark.sparkContext.accumulator(0), jaccard._meetings

    def counted(batches, percent):
        for batch in real(batches, percent):
            made.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(jaccard, "_meetings", counted)
    rows = [*family(150), (150, "one two three four five six " + family(1)[0][1][:60])]
    jaccard_classes(frame(spark, rows)).collect()
    assert made.value < 10 * len(rows)


def test_a_group_is_met_only_where_sizes_allow_a_link():
    """Sets of 100, 79, 80 and 101 tokens, each a group of its own, show one token; a last group has sets of 50 and 100."""
    rows = [(7, 1, 1, 100), (7, 2, 2, 79), (7, 3, 3, 80), (7, 4, 4, 101), (7, 5, 5, 50), (7, 6, 5, 100)]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
    made = [tuple(r.values()) for b in jaccard._meetings([pa.RecordBatch.from_arrays(columns, ["token", "id", "grp", "size"])], 80) for r in b.to_pylist()]
    assert sorted(made) == [(1, 3, 1), (1, 5, 1), (2, 5, 1), (3, 2, 1), (3, 5, 1), (4, 1, 1), (4, 5, 1), (6, 1, 1), (6, 3, 1)]


def test_shared_tokens_are_those_of_a_plain_count():
    draw = np.random.default_rng(3)
    some = [np.unique(draw.integers(0, 40 if i % 3 else 4000, draw.integers(0, 60))).astype(np.uint64) for i in range(50)]
    want = [[len(np.intersect1d(x, y)) for y in some] for x in some[:30]]
    assert jaccard.shared_tokens(some[:30], some).tolist() == want
    assert jaccard.shared_tokens([some[0]], [some[0][:0]]).tolist() == [[0]]


def test_repeats(spark, corpus):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(frame(spark, corpus)).collect()}
    assert got == cut(corpus)


def test_repeats_keep_other_columns(spark):
    rows = [(1, " ".join(map(str, range(20))), "x", 7), (None, " ".join(map(str, range(20))), "y", 8), (2, " ".join(map(str, range(15))), None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd name` string, n_words long")
    got = {r["doc_id"]: r for r in remove_repeats(df).collect()}
    assert [got[k]["n_removed"] for k in (1, 2, None)] == [0, 15, 0]
    assert got[2]["spans"] == [(0, 15)] and got[1]["odd name"] == "x" and got[1]["n_words"] == 20


def test_contained(spark, corpus):
    rnd = random.Random(9)
    items = []
    for k in range(25):
        d, t = corpus[rnd.randrange(150)]
        w = WORD.findall(t)
        a = rnd.randint(0, max(0, len(w) - 10))
        w = w[a : a + rnd.randint(3, 40)]
        if k % 3 == 0 and len(w) > 12:
            w[rnd.randrange(len(w))] = "changed"
        items.append((k, " ".join(w).upper()))
    items += [(90, None), (91, ""), (92, "one"), (93, "the " * 12), (None, "w1 w2")]
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_shingles"]) for r in contained_items(frame(spark, corpus), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in corpus:
        for k, q in items:
            x, y = shingle_set(t), shingle_set(q)
            if k is not None and y and 100 * len(x & y) >= 80 * len(y):
                want[d, k] = (len(x & y), len(y))
    assert got == want and want


def test_decontaminate_keeps_columns_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", 5), (None, "a b c d e f g", 6), (2, None, 7)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert sorted(r["item_id"] for r in decontaminate(df, items).collect()) == [6, 7]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert jaccard_classes(none).collect() == [] and remove_repeats(none).collect() == []
    assert contained_items(none, items).collect() == [] and contained_items(full, items).collect() == []


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(None, 3), (100, 90)], "a long, b long"))
    got = {r["node"]: r["component"] for r in components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 90, 90: 90}
