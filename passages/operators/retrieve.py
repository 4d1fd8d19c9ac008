"""Batches of queries against an index of labelled items.

An index row is (item, seq, pos, vector, primary label or OFF = -1, p, secondary labels);
a query row is (query, vector, text). The vectors of a batch of queries are checked to be
small and go to the tasks; each task keeps the best k of its rows per query, so what is
shuffled does not grow with the items. Larger batches run in slices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passages.functions import text as text_functions
from passages.functions.batch import batch_udf

OFF = -1
SLICE_ROWS = 4096
MAX_ENTRIES = 20_000


def _slices(queries: DataFrame, slice_rows: int) -> Iterator[pd.DataFrame]:
    """The queries in parts of about ``slice_rows``; a batch that fits comes in one job."""
    rows = queries.select("query", "vector")
    whole = rows.limit(slice_rows + 1).toPandas()
    if len(whole) <= slice_rows:
        yield whole
        return
    n = ceil(rows.count() / slice_rows)
    for i in range(n):
        yield rows.filter(F.pmod(F.xxhash64("query"), F.lit(n)) == i).toPandas()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column])


def topk_cosine(
    queries: DataFrame, items: DataFrame, k: int = 5, group: str | None = None, weight: str | None = None,
    min_sim: float | None = None, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """(query, [group,] item, sim, score, rank): exact top k per query, or per query and
    group. Vectors have unit length; score is the similarity times ``weight``."""
    by = [group] if group else []
    columns = ["item", "vector", *by, *([weight] if weight else [])]
    fields = [
        queries.schema["query"], *[items.schema[g] for g in by], items.schema["item"],
        T.StructField("sim", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ]
    found = None
    for part in _slices(queries, slice_rows):
        if part.empty:
            continue
        ids, q = part["query"].to_numpy(), _matrix(part["vector"])

        def best(batches: Iterator[pd.DataFrame], ids=ids, q=q) -> Iterator[pd.DataFrame]:
            kept = None
            for pdf in batches:
                if pdf.empty:
                    continue
                for _, rows in pdf.groupby(group, sort=False) if group else [(None, pdf)]:
                    # rounded, so that equal vectors tie whatever the order of summation
                    sim = np.round(q @ _matrix(rows["vector"]).T, 10)
                    score = np.round(sim * rows[weight].to_numpy(dtype=float)[None, :], 10) if weight else sim
                    usable = np.ones_like(sim, dtype=bool) if min_sim is None else sim >= min_sim
                    if sim.shape[1] > k:
                        cut = np.partition(np.where(usable, score, -np.inf), -k, axis=1)[:, -k]
                        usable &= score >= cut[:, None]
                    i, j = np.nonzero(usable)
                    new = pd.DataFrame({"query": ids[i], "item": rows["item"].to_numpy()[j], "sim": sim[i, j], "score": score[i, j]})
                    if group:
                        new[group] = rows[group].to_numpy()[j]
                    kept = new if kept is None else pd.concat([kept, new])
                    kept = kept.sort_values(["score", "item"], ascending=[False, True])
                    kept = kept.groupby(["query", *by], sort=False).head(k)
            if kept is not None:
                yield kept[[f.name for f in fields]]

        one = items.select(*columns).mapInPandas(best, T.StructType(fields))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return queries.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("rank", T.IntegerType())]))
    rank = F.row_number().over(Window.partitionBy("query", *by).orderBy(F.desc("score"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def topk_of_labels(
    queries: DataFrame, items: DataFrame, wanted: DataFrame, k: int, weight: str | None = None, label: str = "primary", slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """(query, label, item, sim, score, rank): the top k items of the labels each query asks for, ``wanted(query, label)``.

    The labels come first, so an item is compared with the queries that want its label alone, and a task keeps k rows per query
    and label asked for. Equal to the rows of ``topk_cosine`` by group that are wanted."""
    asks = queries.select("query", "vector").join(wanted.select("query", F.col("label").alias("__ask")).distinct(), "query")
    asks = asks.select(F.struct("query", "__ask").alias("query"), "vector")
    kind = wanted.schema["label"].dataType
    fields = [queries.schema["query"], T.StructField("label", kind), items.schema["item"], T.StructField("sim", T.DoubleType()), T.StructField("score", T.DoubleType())]
    found = None
    for part in _slices(asks, slice_rows):
        if part.empty:
            continue
        of: dict = {}
        for row, vector in zip(part["query"], part["vector"]):
            ids, vectors = of.setdefault(row["__ask"], ([], []))
            ids.append(row["query"])
            vectors.append(np.asarray(vector, dtype=float))
        of = {name: (np.array(ids), np.stack(vectors)) for name, (ids, vectors) in of.items()}
        one = items.select("item", "vector", label, *([weight] if weight else [])).mapInPandas(_best_of_labels(of, k, label, weight), T.StructType(fields))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return queries.sparkSession.createDataFrame([], T.StructType([*fields, T.StructField("rank", T.IntegerType())]))
    rank = F.row_number().over(Window.partitionBy("query", "label").orderBy(F.desc("score"), "item"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best_of_labels(of: dict, k: int, label: str, weight: str | None) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict = {}
        for pdf in batches:
            for name, rows in pdf.groupby(label, sort=False):
                if name not in of:
                    continue
                ids, q = of[name]
                sim = np.round(q @ _matrix(rows["vector"]).T, 10)
                score = np.round(sim * rows[weight].to_numpy(dtype=float)[None, :], 10) if weight else sim
                usable = np.ones_like(sim, dtype=bool)
                if sim.shape[1] > k:
                    usable = score >= np.partition(score, -k, axis=1)[:, -k][:, None]
                i, j = np.nonzero(usable)
                new = pd.DataFrame({"query": ids[i], "label": name, "item": rows["item"].to_numpy()[j], "sim": sim[i, j], "score": score[i, j]})
                both = new if name not in kept else pd.concat([kept[name], new])
                both = both.sort_values(["score", "item"], ascending=[False, True])
                kept[name] = both.groupby("query", sort=False).head(k)
        if kept:
            yield pd.concat(kept.values())

    return run


def entry_matrix(entries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Labels and vectors of a catalogue of at most ``MAX_ENTRIES`` vectors."""
    table = entries.select("label", "vector").limit(MAX_ENTRIES + 1).toPandas().sort_values("label", kind="stable")
    if len(table) > MAX_ENTRIES:
        raise ValueError("the label catalogue is too large to send to the tasks; match it in slices")
    return table["label"].to_numpy(), _matrix(table["vector"]) if len(table) else np.zeros((0, 0))


def label_scores(
    rows: DataFrame, entries: DataFrame, vector: str = "vector", name: str = "scores"
) -> tuple[DataFrame, list[int]]:
    """``rows`` plus the best similarity to each label's entry vectors, and the labels in the
    order of that array; ``entries(label, vector)`` may hold several vectors per label."""
    labels, m = entry_matrix(entries)
    names, starts = np.unique(labels, return_index=True)

    @batch_udf("array<double>")
    def score(vs: pd.Series) -> pd.Series:
        sims = _matrix(vs) @ m.T
        return pd.Series(list(np.maximum.reduceat(sims, starts, axis=1)))

    return rows.withColumn(name, score(vector)), [int(v) for v in names]


def _best_labels(vectors: Column, labels: np.ndarray, m: np.ndarray, threshold: float, k: int) -> Column:
    names, starts = np.unique(labels, return_index=True)

    @batch_udf("array<struct<label:int,score:double>>")
    def best(vs: pd.Series) -> pd.Series:
        sims = np.round(np.maximum.reduceat(_matrix(vs) @ m.T, starts, axis=1), 10)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        return pd.Series(
            [[(int(names[j]), float(s[j])) for j in o if s[j] >= threshold] for s, o in zip(sims, order, strict=True)]
        )

    return best(vectors)


def vector_match(
    rows: DataFrame, entries: DataFrame, threshold: float, k: int, key: str = "item", vector: str = "vector",
    slice_rows: int = 10_000,
) -> DataFrame:
    """(key, label, score, rank): the best labels of an item at or above the threshold.

    The labels go through in slices that fit the tasks; each slice keeps its best k per
    item, so the result is that of the whole catalogue."""
    n = max(1, ceil(entries.count() / slice_rows))
    found = None
    for i in range(n):
        part = entries if n == 1 else entries.filter(F.pmod(F.xxhash64("label"), F.lit(n)) == i)
        labels, m = entry_matrix(part)
        if not len(labels):
            continue
        one = rows.select(key, F.inline(_best_labels(F.col(vector), labels, m, threshold, k)))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("the catalogue is empty")
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "label"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


# ---- text ranking --------------------------------------------------------------------


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, salts: int = 16, k: int | None = None) -> DataFrame:
    """(query, label, score) for the pairs that share a term; both sides have ``tokens``
    with repeats, and a repeated query term counts again. With ``k`` only the best k labels of a query, with their
    rank; equal scores (to ten places) go by label.

    Query terms are counted per query first. The document side has one row per (term,
    label) and is small for a catalogue; should it be shuffled, the query rows of each
    term are spread over ``salts`` parts, so that a frequent term is not one task."""
    terms = docs.select("label", F.explode_outer("tokens").alias("term")).groupBy("label", "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    lengths = docs.select("label", F.size("tokens").alias("len"))
    corpus = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = terms.join(df, "term").join(lengths, "label").join(F.broadcast(corpus))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg")))
    postings = weighted.select("term", "label", (idf * tf).alias("w")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    asked = (
        queries.select("query", F.explode_outer("tokens").alias("term"))
        .groupBy("query", "term")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("salt", F.pmod(F.xxhash64("query"), F.lit(salts)).cast("int"))
    )
    scored = asked.join(postings, ["term", "salt"]).groupBy("query", "label").agg(F.sum(F.col("times") * F.col("w")).alias("score"))
    if k is None:
        return scored
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("score", 10)), "label"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def vote(queries: DataFrame, index: DataFrame, k: int = 5) -> DataFrame:
    """(query, label, score): the top k items vote for their primary label with cosine x p."""
    top = topk_cosine(queries, index, k)
    voters = top.join(index.select("item", "primary", "p"), "item").filter(F.col("primary") != OFF)
    return voters.groupBy("query", F.col("primary").alias("label")).agg(F.sum(F.col("sim") * F.col("p")).alias("score"))


def z_fusion(scores: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``combined``: sum of the columns' z-scores over the labels of each query, 0 for a
    column without spread. One window partition is the labels of one query."""
    w = Window.partitionBy("query")

    def z(c: str) -> Column:
        s = F.stddev_pop(c).over(w)
        return F.when(s > 0, (F.col(c) - F.avg(c).over(w)) / s).otherwise(F.lit(0.0))

    return scores.withColumn("combined", sum((z(c) for c in columns[1:]), z(columns[0])))


# ---- labels of a query ---------------------------------------------------------------


def rank_labels(
    queries: DataFrame, profiles: DataFrame, matches: DataFrame, patterns=text_functions.REF_PATTERNS,
    min_letters: int = 15, first: int = 1, last: int = 72,
) -> DataFrame:
    """(query, label, how, rank) over all labels: references in the text, then text
    matches, then profile similarity. Labels without a profile are left out.

    ``matches(query, label, score)`` come from a text matcher; a query that has fewer than
    ``min_letters`` letters beside its references is not matched."""
    refs = queries.select(
        "query", F.posexplode(text_functions.explicit_refs(F.col("text"), patterns, last)).alias("ord", "label")
    ).select("query", "label", F.lit(0).alias("source"), F.col("ord").cast("double").alias("ord"))
    rest = F.col("text")
    for p in patterns:
        rest = F.regexp_replace(rest, p, " ")
    letters = F.regexp_count(rest, F.lit(r"\p{L}"))
    long_enough = queries.filter(letters >= min_letters).select("query")
    matched = matches.join(long_enough, "query", "left_semi").select(
        "query", "label", F.lit(1).alias("source"), (-F.col("score")).alias("ord")
    )
    scored, labels = label_scores(queries.select("query", "vector"), profiles.withColumnRenamed("profile", "vector"))
    table = F.array(*map(F.lit, labels))
    by_profile = scored.select("query", F.posexplode("scores").alias("i", "s")).select(
        "query", F.get(table, F.col("i")).alias("label"), F.lit(2).alias("source"), (-F.round("s", 10)).alias("ord")
    )
    known = F.col("label").isin(*labels)
    every = refs.unionByName(matched).filter(known).unionByName(by_profile)
    best = every.groupBy("query", "label").agg(F.min(F.struct("source", "ord")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("b.source", "b.ord", "label"))
    how = F.when(F.col("b.source") == 0, "reference").when(F.col("b.source") == 1, "match").otherwise("profile")
    return best.select("query", "label", how.alias("how"), rank.alias("rank"), (-F.col("b.ord")).alias("score"))


def covered_labels(index: DataFrame) -> DataFrame:
    """Labels that some item has as its primary one."""
    return index.filter(F.col("primary") != OFF).select(F.col("primary").alias("label")).distinct()


def _merge(sources: Sequence[DataFrame], k: int) -> DataFrame:
    """First k distinct items per query, source by source; each has (query, item, rank)."""
    union = None
    for i, s in enumerate(sources):
        part = s.select("query", "item", F.lit(i).alias("source"), F.col("rank").cast("long").alias("r"))
        union = part if union is None else union.unionByName(part)
    once = union.groupBy("query", "item").agg(F.min(F.struct("source", "r")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("b.source", "b.r"))
    return once.select("query", "item", F.col("b.source").alias("source"), rank.alias("rank")).filter(F.col("rank") <= k)


def items_by_label(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(query, primary, item, rank): the top k items of each label by cosine x p."""
    return topk_cosine(queries, index.filter(F.col("primary") != OFF), k, group="primary", weight="p")


def hybrid_topk(queries: DataFrame, index: DataFrame, ranked: DataFrame, k: int = 5, plain: int = 2) -> tuple[DataFrame, DataFrame]:
    """Top items: ``plain`` by cosine, then the best of the first ranked label that has
    items, then by cosine again. Returns (query, item, source, rank) and (query, label)."""
    top = ranked.join(covered_labels(index), "label").groupBy("query").agg(F.min_by("label", "rank").alias("label"))
    cosine = topk_cosine(queries, index, k)
    own = topk_of_labels(queries, index, top, k, "p").select("query", "item", "rank")
    return _merge([cosine.filter(F.col("rank") <= plain), own, cosine], k), top


def split_topk(queries: DataFrame, index: DataFrame, ranked: DataFrame, n1: int = 3, n2: int = 2, k: int = 5) -> DataFrame:
    """n1 items of the best label that has items, n2 of the next one, the rest by cosine."""
    order = F.row_number().over(Window.partitionBy("query").orderBy("rank"))
    two = ranked.join(covered_labels(index), "label").select("query", "label", order.alias("place")).filter("place <= 2")
    picked = topk_of_labels(queries, index, two, max(n1, n2), "p").join(two, ["query", "label"])
    first = picked.filter((F.col("place") == 1) & (F.col("rank") <= n1))
    second = picked.filter((F.col("place") == 2) & (F.col("rank") <= n2))
    return _merge([first, second, topk_cosine(queries, index, k)], k)


def abstain(ranked: DataFrame, threshold: float, signal: DataFrame | None = None) -> DataFrame:
    """(query, abstained): the best score is under the threshold and the text neither names
    nor matches a label. ``signal(query, score)`` replaces the profile similarity."""
    per = ranked.groupBy("query").agg(
        F.max((F.col("how") != "profile").cast("int")).alias("named"), F.max("score").alias("best")
    )
    if signal is not None:
        per = per.drop("best").join(signal.groupBy("query").agg(F.max("score").alias("best")), "query", "left")
    return per.select("query", ((F.col("named") == 0) & (F.col("best") < threshold)).alias("abstained"))


def answer(queries: DataFrame, index: DataFrame, ranked: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """One row per query: the label the answer is about, a note and its items.

    note: abstained / not covered / reference / other label / empty. A label named or matched
    in the text is never replaced by another one."""
    covered = covered_labels(index).withColumn("has", F.lit(True))
    first = (
        ranked.filter("rank = 1").select("query", F.col("label").alias("first"), "how")
        .join(covered.withColumnRenamed("label", "first"), "first", "left")
    )
    mixed, top = hybrid_topk(queries, index, ranked, k)
    by_p = index.filter(F.col("primary") != OFF).withColumn(
        "rank", F.row_number().over(Window.partitionBy("primary").orderBy(F.desc("p"), "item"))
    ).filter(F.col("rank") <= k).select(F.col("primary").alias("first"), "item", "rank")
    case = first.join(abstain(ranked, threshold), "query").join(top, "query", "left").withColumn(
        "note",
        F.when(F.col("abstained"), "abstained")
        .when((F.col("how") != "profile") & F.col("has").isNull(), "not covered")
        .when(F.col("how") == "reference", "reference")
        .when(F.col("label") != F.col("first"), "other label")
        .otherwise(""),
    )
    chosen = F.when(F.col("note").isin("abstained", "not covered"), F.lit(None)).when(F.col("note") == "reference", F.col("first"))
    case = case.select("query", "first", "note", chosen.otherwise(F.col("label")).alias("label"))
    referred = case.filter("note = 'reference'").join(by_p, "first").select("query", "item", "rank")
    found = case.filter("note IN ('', 'other label')").select("query").join(mixed, "query").select("query", "item", "rank")
    listed = referred.unionByName(found).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("r"))
    return case.join(listed, "query", "left").select(
        "query", "label", "note", F.transform("r", lambda x: x["item"]).alias("items")
    )


def route_then_search(queries: DataFrame, index: DataFrame, routes: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Items of the routed labels by cosine, filled by plain search; and per query how many
    routed labels have no item. ``routes(query, label)``."""
    cosine = topk_cosine(queries, index, k)
    routed = topk_of_labels(queries, index, routes.filter(F.col("label") != OFF), k)
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item"))
    routed = routed.withColumn("rank", order).filter(F.col("rank") <= k)
    missing = routes.join(covered_labels(index), "label", "left_anti").groupBy("query").agg(
        F.count(F.lit(1)).alias("not_indexed")
    )
    counts = queries.select("query").join(missing, "query", "left").fillna(0, ["not_indexed"])
    return _merge([routed, cosine], k), counts


def extractive(retrieved: DataFrame, queries: DataFrame, embed, n: int = 3, min_words: int = 5) -> DataFrame:
    """(query, item, sentence, score, rank): the sentences of the retrieved items closest to
    the query; ``embed`` turns a text column into unit vectors. ``retrieved`` has text."""
    from passages.functions.vectors import dot

    sentences = retrieved.select("query", "item", F.posexplode(text_functions.sentences(F.col("text"), min_words)).alias("no", "sentence"))
    scored = sentences.join(queries.select("query", "vector"), "query").withColumn(
        "score", F.round(dot(embed(F.col("sentence")), "vector"), 10)
    )
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "item", "no"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= n).drop("vector")


# ---- reports on the index ------------------------------------------------------------


def related(index: DataFrame) -> DataFrame:
    """(label, other, n): how often two labels stand on the same item, one of them primary."""
    pairs = index.select("primary", F.explode("secondary").alias("second")).filter(F.col("primary") != OFF)
    both = pairs.select(F.col("primary").alias("label"), F.col("second").alias("other")).unionByName(
        pairs.select(F.col("second").alias("label"), F.col("primary").alias("other"))
    )
    return both.groupBy("label", "other").agg(F.count(F.lit(1)).alias("n"))


def coverage(index: DataFrame, segments: DataFrame, by: Sequence[str] = ("speaker", "tradition")) -> DataFrame:
    """Per label and group: segments, their items, the deepest effective dwell, and passing
    mentions on items that are about something else (off items too)."""
    by = list(by)
    deep = segments.filter(F.col("primary") != OFF).groupBy(F.col("primary").alias("label"), *by).agg(
        F.count(F.lit(1)).alias("segments"), F.sum("dwell").alias("items"), F.max("effective_dwell").alias("deepest")
    )
    passing = (
        index.select(*by, "primary", F.explode("secondary").alias("label"))
        .filter(F.col("primary") != F.col("label"))
        .groupBy("label", *by)
        .agg(F.count(F.lit(1)).alias("passing"))
    )
    return deep.join(passing, ["label", *by], "full_outer").fillna(0, ["segments", "items", "passing"])


def ordered_coverage(
    cover: DataFrame, order: Sequence[str], keep: Sequence[str] | None = None, group: str = "tradition", speaker: str = "speaker"
) -> DataFrame:
    """Coverage for display: groups in a fixed order, unknown ones after them by name, and in
    a group the speaker with the deepest segment first. ``keep`` only hides groups."""
    names = F.array(*map(F.lit, order))
    place = F.when(F.array_contains(names, F.col(group)), F.array_position(names, F.col(group))).otherwise(len(order) + 1)
    shown = cover if keep is None else cover.filter(F.col(group).isin(*keep))
    placed = shown.withColumn("place", place.cast("int"))
    return placed.orderBy("label", "place", group, F.desc(F.coalesce("deepest", F.lit(0.0))), speaker)


def segment_items(index: DataFrame, segments: DataFrame) -> DataFrame:
    """Items of each segment, by the run number both sides carry."""
    return index.select("seq", "run", "pos", "item").join(segments.select("seq", "run", "first_unit", "dwell"), ["seq", "run"])


def browse(index: DataFrame, themes: DataFrame) -> DataFrame:
    """(theme, label, sequences): labels by theme and how many sequences explain each."""
    n = index.filter(F.col("primary") != OFF).groupBy(F.col("primary").alias("label")).agg(
        F.count_distinct("seq").alias("sequences")
    )
    return themes.join(n, "label", "left").fillna(0, ["sequences"])


def speaker_alias(sequences: DataFrame) -> DataFrame:
    """(speaker, name) where every sequence of a placeholder speaker has the same known name."""
    name = F.coalesce(F.trim("name"), F.lit(""))
    per = sequences.groupBy("speaker").agg(F.count_distinct(name).alias("n"), F.max(name).alias("name"))
    return per.filter((F.col("n") == 1) & (F.col("name") != "")).select("speaker", "name")


def ground_time(hits: DataFrame, timestamps: DataFrame, n: int = 3) -> DataFrame:
    """The best hits with a known time: (seq, label) looked up, top n per query."""
    joined = hits.join(timestamps, ["seq", "label"])
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "item"))
    return joined.withColumn("citation", rank).filter(F.col("citation") <= n)


def sources(index: DataFrame, by: Sequence[str]) -> DataFrame:
    return index.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("seq").alias("sequences"))


def hit_labels(hits: DataFrame, refs: str = "refs") -> DataFrame:
    """Distinct labels of the hits of a query, comma lists taken apart."""
    one = hits.select("query", F.explode(F.split(refs, ",")).alias("label")).withColumn("label", F.trim("label"))
    return one.filter("label <> ''").distinct()
