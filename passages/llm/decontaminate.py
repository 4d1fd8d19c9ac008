"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

An item is contained in a document if at least ``percent`` of its distinct word shingles occur in it, however long the
document is. The MinHash sketch of an item is the smallest hashes among its shingles. Items are partitioned by the size
of their set (powers of two), and the sketch of a partition has ``slack + 1 + slack // 2 + 1`` hashes, where ``slack`` is
the number of shingles the largest item of the partition may miss. A document that contains an item misses at
most ``floor((100 - percent) n / 100)`` hashes of its sketch, so it shows all but that many: the search loses nothing, and
what it finds is counted shingle by shingle. A document smaller than the shingles an item needs is not looked at.

Documents meet the sketches through a bit table of fixed size, so that only shingles that may belong to an item leave
the document; the rest is joined, never broadcast. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.session import checkpoint_dir

TABLE_BITS = 21
WIDTH = 5


def _words(text: Column) -> Column:
    """Lower-cased words; the empty ends a split leaves go."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _positions(words: Column, width: int) -> Column:
    """Where a shingle starts: a text with fewer words is one shingle, one without words has none."""
    n = F.size(words)
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - width, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _pair(codes: Column, i: Column) -> Column:
    return F.xxhash64(F.get(codes, i), F.get(codes, i + 1))


def _whole(codes: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(codes, i + k) for k in range(width)])


def _coded(rows: DataFrame, key: str) -> DataFrame:
    words = rows.select(key, _words(F.col("text").cast("string")).alias("words"))
    return words.select(key, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("codes"))


def _shingle(i: Column, width: int) -> Column:
    return F.array_join(F.slice(F.col("words"), i + 1, width), " ")


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_id, shingle, pair, h, n): the distinct shingles of every item, their hashes and their number."""
    rows = _coded(items.filter("item_id IS NOT NULL"), "item_id")
    flat = rows.select("item_id", "words", "codes", F.explode(_positions(F.col("words"), width)).alias("i"))
    i = F.col("i")
    flat = flat.select("item_id", _shingle(i, width).alias("shingle"), _pair(F.col("codes"), i).alias("pair"), _whole(F.col("codes"), i, width).alias("h"))
    flat = flat.distinct()
    return flat.join(flat.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")


def sketches(shingles: DataFrame, percent: int = 80) -> DataFrame:
    """The shingles of each item's sketch, with its length ``k``: (item_id, shingle, n, k)."""
    top = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.col("n").cast("double"))).cast("int"))
    slack = F.floor(top * (100 - percent) / 100)
    sized = shingles.withColumn("k", F.least(F.col("n"), slack + 2 + F.floor(slack / 2)))
    # the window is as small as one benchmark text
    ranked = sized.withColumn("r", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle")))
    return ranked.filter("r <= k").select("item_id", "shingle", "n", "k")


def _table(hashes: DataFrame) -> Column:
    """The hashes as a literal table of 2^TABLE_BITS bits (256 KB), whatever their number."""
    words = hashes.toDF("h").groupBy(F.pmod(F.shiftright("h", 6), F.lit(1 << (TABLE_BITS - 6))).alias("w"))
    words = words.agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("h", F.lit(64)).cast("int"))).alias("bits"))
    table = [0] * (1 << (TABLE_BITS - 6))
    for row in words.toLocalIterator():
        table[row["w"]] = row["bits"]
    return F.from_json(F.lit(str(table)), "array<long>")


def _may_occur(table: Column, h: Column) -> Column:
    word = F.get(table, F.pmod(F.shiftright(h, 6), F.lit(1 << (TABLE_BITS - 6))).cast("int"))
    return F.getbit(word, F.pmod(h, F.lit(64)).cast("int")) == 1


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles) for every item of which a document has ``percent`` of the shingles.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Texts are lower-cased and split
    at white space. A text with fewer than ``width`` words is one shingle, so a short item is only found in a
    document that is equal to it; a null or empty text has no shingles and no matches. Rows with a null key are left
    out, and rows that repeat a key are taken together. Empty tables give an empty result."""
    checkpoint_dir(docs.sparkSession)
    shingles = item_shingles(items, width).checkpoint()
    pairs, wholes = _table(shingles.select("pair")), _table(shingles.select("h"))
    rows = _coded(docs.filter("doc_id IS NOT NULL"), "doc_id")
    places = _positions(F.col("words"), width)
    near = F.filter(places, lambda i: _may_occur(pairs, _pair(F.col("codes"), i)) & _may_occur(wholes, _whole(F.col("codes"), i, width)))
    seen = rows.select("doc_id", F.size(places).alias("places"), F.transform(near, lambda i: _shingle(i, width)).alias("seen"))
    hits = seen.select("doc_id", "places", F.explode_outer("seen").alias("shingle")).filter("shingle IS NOT NULL")
    hits = hits.groupBy("doc_id", "shingle").agg(F.max("places").alias("places")).checkpoint()

    least = F.ceil(F.col("n") * percent / 100)
    found = hits.join(sketches(shingles, percent), "shingle").filter(F.col("places") >= least)
    found = found.groupBy("doc_id", "item_id", "n", "k").agg(F.count("*").alias("hits"))
    candidates = found.filter(F.col("hits") >= F.col("k") - (F.col("n") - least)).select("doc_id", "item_id")
    exact = candidates.join(hits.select("doc_id", "shingle"), "doc_id").join(shingles.select("item_id", "shingle", "n"), ["item_id", "shingle"])
    counted = exact.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"), F.first("n").alias("n_shingles"))
    return counted.filter(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).select("doc_id", "item_id", "n_shared", "n_shingles")


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = 80, width: int = WIDTH) -> DataFrame:
    """``docs`` without the documents that contain an item; rows with a null doc_id stay, all columns stay."""
    hit = contained_items(docs.select("doc_id", "text"), items, percent, width).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
