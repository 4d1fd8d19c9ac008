"""Matching items against a label catalogue, by text and by detection rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from passages.functions import text as T
from passages.functions.batch import batch_udf
from passages.functions.likeness import may_reach, ratios, ratios_from, ratios_of_pairs
from passages.operators.chunk import density_windows
from passages.operators.intervals import interval_join

MAX_ENTRY_CHARS = 20_000_000
SLICE_CHARS = 1_000_000
USUAL_CHARS = 10_000
PAIRS_AT_ONCE = 10_000


# ---- shared word n-grams -------------------------------------------------------------


def word_ngrams(s: Column, n: int) -> Column:
    """Distinct n-grams of the folded words."""
    words = F.filter(F.split(T.fold_text(s), " "), lambda w: w != "")

    def grams(ws: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(ws) - (n - 1)), lambda i: F.array_join(F.slice(ws, i, n), " "))
        return F.when(F.size(ws) >= n, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    # bound by an outer transform: named in the inner lambda, the words would be split again for each n-gram
    return F.get(F.transform(F.array(words), grams), F.lit(0))


def shared_ngrams(items: DataFrame, catalogue: DataFrame, key: str, n: int) -> DataFrame:
    """(key, label, shared, size): distinct n-grams an item and an entry have in common.

    Each item lists a gram once, so a gram that a third of all items contain is still one
    row per item. Spark sends the entries' grams to all tasks if they are small and joins
    by shuffle, splitting frequent grams, if they are not."""
    entry = catalogue.select("label", F.explode_outer(word_ngrams(F.col("text"), n)).alias("gram"))
    sizes = entry.groupBy("label").agg(F.count("gram").alias("size"))
    # outer, because a plain explode adds a filter on the array and works it out twice; the join drops the nulls
    grams = items.select(key, F.explode_outer(word_ngrams(F.col("text"), n)).alias("gram"))
    shared = grams.join(entry, "gram").groupBy(key, "label").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(sizes, "label").select(key, "label", "shared", "size")


def ngram_match(
    items: DataFrame, catalogue: DataFrame, key: str = "doc_id", n: int = 5, threshold: float = 0.9
) -> DataFrame:
    """(key, label, score): share of an entry's word n-grams found in the item."""
    score = F.col("shared") / F.col("size")
    return shared_ngrams(items, catalogue, key, n).select(key, "label", score.alias("score")).filter(
        F.col("score") >= threshold
    )


# ---- fuzzy scores --------------------------------------------------------------------


def _lcs(masks: dict[str, int], m: int, text: str) -> int:
    """Length of the longest common subsequence, one bit per character of the pattern."""
    full = (1 << m) - 1
    s = full
    for ch in text:
        u = s & masks.get(ch, 0)
        s = ((s + u) | (s - u)) & full
    return m - s.bit_count()


def _best_window(short: str, long: str, cutoff: float) -> float:
    """Best 2 * lcs / (lengths) of ``short`` against the windows of ``long``; windows are
    tried from the best letter-count bound down, until no bound can win."""
    m, n = len(short), len(long)
    letters, need = np.unique(np.frombuffer(short.encode("utf-32-le"), dtype=np.uint32), return_counts=True)
    codes = np.frombuffer(long.encode("utf-32-le"), dtype=np.uint32)
    # windows may stick out at either end, where they are shorter
    first = np.clip(np.arange(1 - m, n), 0, n)
    last = np.clip(np.arange(1 - m, n) + m, 0, n)
    overlap = np.zeros(len(first), dtype=np.int64)
    for c, k in zip(letters, need, strict=True):
        seen = np.concatenate([[0], np.cumsum(codes == c)])
        overlap += np.minimum(seen[last] - seen[first], k)
    bound = 2 * overlap / (m + last - first)
    masks: dict[str, int] = {}
    for i, ch in enumerate(short):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    best = 0.0
    for w in np.argsort(-bound, kind="stable"):
        if bound[w] <= best or bound[w] < cutoff:
            break
        piece = long[first[w] : last[w]]
        best = max(best, 2 * _lcs(masks, m, piece) / (m + len(piece)))
    return best


def partial_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """Similarity 0..1 of the shorter text to the best window of the longer one; values
    under ``cutoff`` may come out as anything under it."""
    if not a or not b:
        return float(not a and not b)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if short in long:
        return 1.0
    best = _best_window(short, long, cutoff)
    return max(best, _best_window(long, short, cutoff)) if len(a) == len(b) else best


class Scorer:
    """``partial_ratio`` of texts with each of many entries, for the scores of at least ``threshold``.

    Every pair is covered. A pair is scored only where the upper bounds of ``may_reach`` allow it."""

    def __init__(self, entries: Sequence[tuple[int, str]], threshold: float):
        self.threshold = threshold
        self.labels, self.entries = [label for label, t in entries if t], [t for _, t in entries if t]

    def scored(self, texts: Sequence[str | None]) -> list[list[tuple[int, float]]]:
        """Of each text the labels and scores: the pairs of all the texts that the bounds allow go through ``ratios_of_pairs`` together."""
        met = may_reach([t or "" for t in texts], self.entries, self.threshold)
        pairs = [(k, self.labels[i], self.entries[i]) for k, i in zip(*(x.tolist() for x in met), strict=True)]
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        long = [len(entry) + len(texts[k]) > USUAL_CHARS for k, _, entry in pairs]
        rare, usual = [p for p, x in zip(pairs, long) if x], [p for p, x in zip(pairs, long) if not x]
        scores = [partial_ratio(entry, texts[k], self.threshold) for k, _, entry in rare]
        for a in range(0, len(usual), PAIRS_AT_ONCE):
            some = usual[a : a + PAIRS_AT_ONCE]
            scores += ratios_of_pairs([entry for _, _, entry in some], [texts[k] for k, _, _ in some]).tolist()
        for (k, label, _), score in zip([*rare, *usual], scores, strict=True):
            if score >= self.threshold:
                out[k].append((label, score))
        return out

    def __call__(self, text: str | None) -> list[tuple[int, float]]:
        return self.scored([text])[0]


def fuzzy_candidates(
    items: DataFrame, catalogue: DataFrame, key: str, threshold: float, by: str | None = None,
    spellings: Sequence[Callable[[Column], Column]] = (T.fold_text,),
) -> DataFrame:
    """(key, label, score) for all pairs that score ``threshold`` or more; of several
    ``spellings`` of the texts the best one counts. ``by`` names a column of both tables, such
    as the language: an item is compared with the entries of its own value only.

    The catalogue goes to the tasks, after a size check; ``Scorer`` keeps the costly part off
    unrelated pairs, and the texts are spread over all tasks, however few bytes they are. Texts without letters match nothing."""
    own = (F.lit("") if by is None else F.col(by).cast("string")).alias("__by")
    keyed = [f(F.col("text")).alias(f"__text{i}") for i, f in enumerate(spellings)]
    check_entries(catalogue)
    groups: dict[str, list] = {}
    for r in catalogue.select("label", own, *keyed).orderBy("label").collect():
        groups.setdefault(r["__by"], []).append(r)
    scorers = {
        (value, i): Scorer([(int(r["label"]), r[f"__text{i}"]) for r in rows], threshold)
        for value, rows in groups.items()
        for i in range(len(spellings))
    }

    @batch_udf("array<struct<label:int,score:double>>")
    def score(value: pd.Series, texts: pd.Series) -> pd.Series:
        found: list[dict[int, float]] = [{} for _ in texts]
        for (own_value, i), scorer in scorers.items():
            at = [k for k, v in enumerate(value) if v == own_value or (v is None and own_value is None)]
            for k, scores in zip(at, scorer.scored([texts.iat[k][i] for k in at]), strict=True):
                for label, x in scores:
                    found[k][label] = max(x, found[k].get(label, 0.0))
        return pd.Series([sorted(f.items()) for f in found])

    spark = items.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = items.select(key, own, F.array(*keyed).alias("__texts")).repartition(tasks)
    return rows.select(key, F.inline(score("__by", "__texts")))


def check_entries(catalogue: DataFrame) -> None:
    if (catalogue.agg(F.sum(F.length("text"))).first()[0] or 0) > MAX_ENTRY_CHARS:
        raise ValueError("the catalogue is too large to send to the tasks")


def entry_slices(catalogue: DataFrame, columns: Sequence[str], most: int = SLICE_CHARS) -> Iterator[list[Row]]:
    """The catalogue in label order, in parts of about ``most`` letters of its last column, so that none is large."""
    part, chars = [], 0
    for r in catalogue.select(*columns).orderBy("label").toLocalIterator():
        part.append(r)
        chars += len(r[columns[-1]] or "")
        if chars >= most:
            yield part
            part, chars = [], 0
    if part:
        yield part


def _matrix_scorer(entries: dict[str, list[str]], n: int) -> Callable:
    @batch_udf("array<double>")
    def scores(own: pd.Series, hay: pd.Series) -> pd.Series:
        result = np.zeros((len(hay), n))
        for c, texts in entries.items():
            at = np.flatnonzero((own == c) & hay.notna() & (hay != ""))
            if len(at):
                distinct, back = np.unique(hay.to_numpy(dtype=object)[at].astype(str), return_inverse=True)
                result[at] = ratios(distinct.tolist(), texts)[back]
        return pd.Series(list(result))

    return scores


def fuzzy_matrix(
    items: DataFrame, catalogue: DataFrame, text: str = "text", name: str = "string", by: str | None = None,
    spelling: Callable[[Column], Column] = lambda s: s, names: Sequence[str] | None = None,
) -> DataFrame:
    """``items`` plus an array with the score of every entry, in label order: the exhaustive form.

    With ``by``, a column of ``items`` with values out of ``names`` (the language, say), the catalogue has one column of texts
    per name, and an item is compared with the column of its own value: that column is the second half of its key
    pair, ``spelling`` of both texts the first. Null texts score 0 and values without a column a row of zeros."""
    columns = ["text"] if by is None else list(names or ())
    spelt = catalogue.select("label", *[spelling(F.col(c)).alias(c) for c in columns])
    value = F.lit("text") if by is None else F.col(by).cast("string")
    out = items.withColumn("__hay", spelling(F.col(text)))
    parts = []
    for k, rows in enumerate(entry_slices(spelt, ["label", *columns])):
        entries = {c: [r[c] or "" for r in rows] for c in columns}
        out = out.withColumn(f"__part{k}", _matrix_scorer(entries, len(rows))(value, F.col("__hay")))
        parts.append(F.col(f"__part{k}"))
    every = F.concat(*parts) if parts else F.array().cast("array<double>")
    return out.withColumn(name, every).drop("__hay", *[f"__part{k}" for k in range(len(parts))])


def best_anchor(anchors: DataFrame, key: str = "doc_id") -> DataFrame:
    """The label with the top score per item, the lowest one on ties."""
    return anchors.groupBy(key).agg(
        F.max_by("label", F.struct("score", -F.col("label"))).alias("label"), F.max("score").alias("score")
    )


def _best_entry(texts: list[str], labels: list[int], first: dict[str, int], threshold: float) -> Callable:
    """The entry a piece is taken for: (0 to 2, -score, label) by one of its first three words, (3, -score, label) as the best."""

    @batch_udf("struct<rank:int,worse:double,label:int>")
    def best(opening: pd.Series, spelt: pd.Series) -> pd.DataFrame:
        distinct, back = np.unique(spelt.to_numpy(dtype=object).astype(str), return_inverse=True)
        scores = ratios_from(distinct.tolist(), texts, threshold)
        top = scores.argmax(1)
        out = []
        for words, row in zip(opening, back, strict=True):
            ways = [(n, first[w]) for n, w in enumerate(words) if w in first and scores[row, first[w]] >= threshold]
            rank, i = ways[0] if ways else (3, int(top[row]))
            out.append((rank, -scores[row, i], labels[i]) if scores[row, i] >= threshold else (None, None, None))
        return pd.DataFrame(out, columns=["rank", "worse", "label"])

    return best


def _pair_ratio(piece: pd.Series, entry: pd.Series) -> pd.Series:
    return pd.Series(ratios_of_pairs(piece.tolist(), entry.tolist()))


GRID = 20
WORD = r"[^ \t\n\x0B\f\r]+"


def _cells(text: Column) -> Column:
    """The text in cells of ``GRID`` letters: pieces are cut out of a few cells, not out of a long text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{GRID}}})"), F.lit(1))


def _cut(cells: Column, start: Column, size: Column) -> Column:
    first = F.floor(start / GRID).cast("int")
    near = F.array_join(F.slice(cells, first + 1, F.ceil(size / GRID).cast("int") + 1), "")
    return near.substr(start - first * GRID + 1, size)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def candidate_spans(docs: DataFrame, key: str, text: str, density: Callable[[Column], Column], min_density: float) -> DataFrame:
    """(key, turn, start, end, density, method, piece): the stretches of a text that are dense enough, with some letters around
    them; of those over 200 letters, pieces of 150 every 40. ``turn`` counts them in text order."""
    size = F.length("__text")
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__dense", density_windows(F.col("__text"), density, threshold=min_density))
    rows = rows.withColumn("__cells", _cells(F.col("__text")))

    def span(start: Column, end: Column, dense: Column, method: str) -> Column:
        return F.struct(start.alias("start"), end.alias("end"), dense.alias("density"), F.lit(method).alias("method"))

    def spans(s: Column) -> Column:
        scanned = F.sequence(s["start"], s["end"] - 61, F.lit(40))
        parts = F.transform(scanned, lambda a: span(a, F.least(a + 150, size), s["density"], "subscan"))
        whole = span(F.greatest(F.lit(0), s["start"] - 20), F.least(size, s["end"] + 40), s["density"], "stretch")
        return F.when(s["end"] - s["start"] > 200, parts).otherwise(F.array(whole))

    rows = rows.withColumn("__spans", F.flatten(F.transform("__dense", spans)))

    def with_piece(s: Column) -> Column:
        return s.withField("piece", _cut(F.col("__cells"), s["start"], s["end"] - s["start"]))

    rows = rows.select(key, F.posexplode(F.transform("__spans", with_piece)).alias("turn", "__span"))
    return rows.select(key, "turn", "__span.*")


def two_pass_anchors(
    docs: DataFrame, catalogue: DataFrame, density: Callable[[Column], Column], min_density: float = 0.12, threshold: float = 0.55,
    spelling: Callable[[Column], Column] = lambda s: F.regexp_replace(s, r"\s+", ""), text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """``docs`` plus ``hits``: dense stretches matched against the catalogue, then the places where an entry's first word
    stands; one hit per label and text, the earliest of the first pass or else of the second.

    Candidates are rows. A stretch takes the entry whose first word is among its first three words, if that scores ``threshold``, or else
    the best one (the first of equals); a first-word place is compared with its own entry, which a join on the word finds. The
    catalogue is read in parts, whose results are merged, so it may be of any size. ``key`` names the texts; a null or
    empty text has no hits."""
    entries = catalogue.select("label", F.coalesce("text", F.lit("")).alias("text"))
    entries = entries.select("label", F.get(_words(F.col("text")), F.lit(0)).alias("head"), spelling(F.col("text")).alias("entry"))
    heads = entries.filter("head IS NOT NULL").groupBy("head").agg(F.max("label").alias("owner"))

    spans = candidate_spans(docs, key, text, density, min_density)
    opening = F.slice(_words(F.col("piece")), 1, 3)
    spans = spans.select(key, "turn", "start", "end", "density", "method", opening.alias("opening"), spelling(F.col("piece")).alias("spelt"))
    # the scorer is the costly part: one long text's pieces are spread over tasks, however few bytes they are
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spans = spans.repartition(tasks, key, "turn")
    owned = entries.join(heads.withColumnRenamed("owner", "label"), ["label", "head"], "left_semi")
    owned = entries.join(owned.select("label", F.lit(True).alias("owns")), "label", "left")
    found = []
    for k, rows in enumerate(entry_slices(owned, ["label", "owns", "head", "entry"])):
        texts = [r["entry"] for r in rows]
        labels = [int(r["label"]) for r in rows]
        first = {r["head"]: i for i, r in enumerate(rows) if r["owns"]}
        spans = spans.withColumn(f"__found{k}", _best_entry(texts, labels, first, threshold)("opening", "spelt"))
        found.append(F.when(F.col(f"__found{k}.rank").isNotNull(), F.col(f"__found{k}")))
    kind = "array<struct<label:int,start:int,end:int,score:double,density:double,confidence:double,method:string>>"
    if not found:
        return docs.withColumn("hits", F.array().cast(kind))
    hit = F.least(*found) if len(found) > 1 else found[0]
    dense = spans.withColumn("__hit", hit).filter("__hit IS NOT NULL").withColumn("score", -F.col("__hit.worse"))
    dense = dense.select(key, F.col("__hit.label").alias("label"), F.lit(1).alias("run"), F.col("turn").alias("at"), "start", "end", "score", "density",
                         F.least(F.lit(1.0), F.col("score") * 0.7 + F.col("density") * 0.3).alias("confidence"), "method")

    words = docs.select(key, F.explode(T.positions(F.col(text), WORD)).alias("w")).select(key, F.col("w.pos").alias("pos"), F.col("w.match").alias("head"))
    starts = words.join(heads, "head").groupBy(key).agg(F.collect_list(F.struct("pos", "owner")).alias("__starts"))
    places = docs.select(key, _cells(F.col(text)).alias("__cells")).join(starts, key)
    pieces = F.transform("__starts", lambda x: x.withField("piece", _cut(F.col("__cells"), x["pos"], F.lit(150))))
    places = places.select(key, F.explode(pieces).alias("p")).select(key, "p.*")
    places = places.join(entries.select(F.col("label").alias("owner"), "entry"), "owner")

    places = places.withColumn("spelt", spelling(F.col("piece"))).withColumn("score", batch_udf("double")(_pair_ratio)("spelt", "entry")).filter(F.col("score") >= threshold)
    sparse = places.select(key, F.col("owner").cast("int").alias("label"), F.lit(2).alias("run"), F.col("pos").alias("at"), F.col("pos").alias("start"),
                           (F.col("pos") + F.length("piece")).alias("end"), "score", F.lit(0.0).alias("density"),
                           F.least(F.lit(1.0), F.col("score") * 0.6 + 0.2).alias("confidence"), F.lit("first word").alias("method"))
    order = F.struct("run", "at", "start", "end", "score", "density", "confidence", "method")
    hits = dense.unionByName(sparse).groupBy(key, "label").agg(F.min(order).alias("h"))
    one = F.struct(F.col("label").cast("int").alias("label"), "h.start", "h.end", "h.score", "h.density", "h.confidence", "h.method")
    sorted_hits = F.array_sort(F.collect_list(F.struct(F.col("h.start").alias("a"), F.col("label").alias("b"), one.alias("hit"))))
    hits = hits.groupBy(key).agg(F.transform(sorted_hits, lambda x: x["hit"]).cast(kind).alias("hits"))
    joined = docs.join(hits, key, "left")
    return joined.withColumn("hits", F.coalesce("hits", F.array().cast(kind))).select(*docs.columns, "hits")


def near_cues(hits: str = "hits", cues: str = "cues", within: int = 500) -> Column:
    """``hits`` with the types of the cues near each and the section it stands in: arrays
    of struct<start, ...> and struct<pos, end, type> in text order."""
    cue = F.col(cues)

    def section(start: Column) -> Column:
        intro = F.filter(cue, lambda c: (c["type"] == "intro_marker") & (c["pos"] < start))
        closing = F.filter(cue, lambda c: (c["type"] == "closing_marker") & (c["pos"] > start))
        since = start - F.get(intro, F.size(intro) - 1)["pos"]
        until = F.get(closing, F.lit(0))["pos"] - start
        return (
            F.when(since < 1000, "near_introduction").when(until < 500, "near_closing").otherwise("explanation_body")
        )

    return F.transform(
        hits,
        lambda h: F.struct(
            h["start"].alias("start"),
            h["label"].alias("label"),
            F.transform(F.filter(cue, lambda c: F.abs(c["pos"] - h["start"]) < within), lambda c: c["type"]).alias("cues"),
            section(h["start"]).alias("section"),
        ),
    )


def hits_near_cues(hits: DataFrame, cues: DataFrame, keys: Sequence[str], within: int = 500, after_intro: int = 1000, before_closing: int = 500) -> DataFrame:
    """``near_cues`` for tables: ``hits`` (keys, start, ...) with the types of the cues (keys, pos, type) near each, in text order,
    and the section it stands in. Hits and cues of a text meet through ``interval_join``, not as two arrays on its row."""
    reach = max(within, after_intro), max(within, before_closing)
    spans = hits.select(*keys, "start").distinct().select(*keys, "start", (F.col("start") - reach[0] + 1).alias("__a"), (F.col("start") + reach[1]).alias("__b"))
    met = interval_join(cues.select(*keys, F.col("pos").alias("__pos"), F.col("type").alias("__type")), spans, keys, "__pos", "__a", "__b")
    apart = F.col("__pos") - F.col("start")
    near = F.when(F.abs(apart) < within, F.struct(F.col("__pos"), F.col("__type")))
    intro = F.max(F.coalesce((F.col("__type") == "intro_marker") & (apart < 0) & (-apart < after_intro), F.lit(False)))
    closing = F.max(F.coalesce((F.col("__type") == "closing_marker") & (apart > 0) & (apart < before_closing), F.lit(False)))
    found = met.groupBy(*keys, "start").agg(F.array_sort(F.collect_list(near)).alias("__near"), intro.alias("__intro"), closing.alias("__closing"))
    out = hits.join(found, [*keys, "start"], "left")
    types = F.transform(F.coalesce("__near", F.array().cast("array<struct<__pos:int,__type:string>>")), lambda c: c["__type"])
    section = F.when(F.col("__intro"), "near_introduction").when(F.col("__closing"), "near_closing").otherwise("explanation_body")
    return out.withColumns({"cues": types, "section": section}).drop("__near", "__intro", "__closing")


# ---- rules on detections -------------------------------------------------------------


def domain_density(items: DataFrame, vocab: DataFrame, key: str = "doc_id") -> DataFrame:
    """Share of an item's ``tokens`` that occur in ``vocab.word``.

    Tokens are counted per item before they meet the vocabulary, so a word repeated a
    million times is one row, and a join on a frequent word can be split by Spark."""
    counted = (
        items.select(key, F.explode_outer("tokens").alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    )
    known = counted.join(vocab, "word", "left_semi").groupBy(key).agg(F.sum("n").alias("known"))
    return items.join(known, key, "left").select(
        key, (F.coalesce("known", F.lit(0)) / F.greatest(F.size("tokens"), F.lit(1))).alias("density")
    )


def vote_filter(detections: DataFrame, min_votes: int = 2, keys: Sequence[str] = ("seq",)) -> DataFrame:
    """Labels found in at least ``min_votes`` segments of a sequence."""
    votes = detections.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("votes"))
    return votes.filter(F.col("votes") >= min_votes)


def position_weight(
    hits: DataFrame, sizes: DataFrame, stop: DataFrame, early: float = 0.2, weight: float = 0.9, threshold: float = 0.0
) -> DataFrame:
    """Scores in the first part of a sequence count less; then the threshold, and labels
    that attract wrong matches go. ``sizes(seq, items)`` has the length of every whole sequence."""
    share = F.col("pos") / F.col("__n")
    rows = hits.join(sizes.select("seq", F.col("items").alias("__n")), "seq").withColumn(
        "score", F.col("score") * F.when(share < early, F.lit(weight)).otherwise(F.lit(1.0))
    )
    return rows.filter(F.col("score") >= threshold).join(stop, "label", "left_anti").select(*hits.columns)


