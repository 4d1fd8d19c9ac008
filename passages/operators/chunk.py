"""One text row in, many ordered passages out. A text is one row, so no chunker shuffles."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passages.functions import text as T
from passages.functions.batch import FEW_ROWS, batch_udf
from passages.operators.intervals import interval_join
from passages.operators.scan import BLOCK_ROWS, Running, running

_SPANS = "array<struct<char_start:int,char_end:int,n_words:int>>"


def _sentence_spans(text: str, limit: int, pack: int) -> list[tuple[int, int, int]]:
    """(start, end, words) of the sentences; one over ``limit`` words becomes ``pack``-word pieces."""
    spans = []
    for m in re.finditer(r"[^.?]+[.?]?", text):
        tokens = [(t.start() + m.start(), t.end() + m.start()) for t in re.finditer(r"\S+", m.group())]
        if not tokens:
            continue
        size = pack if len(tokens) > limit else len(tokens)
        for i in range(0, len(tokens), size):
            piece = tokens[i : i + size]
            spans.append((piece[0][0], piece[-1][1], len(piece)))
    return spans


def _pack(weights: list[int], target: int) -> list[tuple[int, int]]:
    """Greedy groups (first, last + 1): closed as soon as the weight reaches the target."""
    groups, first, total = [], 0, 0
    for i, w in enumerate(weights):
        total += w
        if total >= target:
            groups.append((first, i + 1))
            first, total = i + 1, 0
    if first < len(weights):
        groups.append((first, len(weights)))
    return groups


def sentence_groups(text: str | None, target: int = 100, longest: int = 200) -> list[tuple[int, int, int]]:
    """(start, end, words) of the passages of one trimmed text; see ``pack_sentences``."""
    sentences = _sentence_spans(text or "", longest, target)
    return [(sentences[a][0], sentences[b - 1][1], sum(s[2] for s in sentences[a:b])) for a, b in _pack([s[2] for s in sentences], target)]


def pack_sentences(
    docs: DataFrame, text: str = "text", target: int = 100, longest: int = 200
) -> DataFrame:
    """Whole sentences packed into passages of at least ``target`` words, the rest kept as
    a last passage; sentences over ``longest`` words are cut hard. Offsets refer to the
    trimmed text."""

    @batch_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sentence_groups(t, target, longest))

    trimmed = docs.withColumn(text, F.regexp_replace(text, r"^\s+|\s+$", ""))
    return (
        trimmed.withColumn("__spans", spans(text))
        .select("*", F.posexplode("__spans").alias("pos", "__s"))
        .withColumns(
            {
                "char_start": F.col("__s.char_start"),
                "char_end": F.col("__s.char_end"),
                "n_words": F.col("__s.n_words"),
                text: F.substring(text, F.col("__s.char_start") + 1, F.col("__s.char_end") - F.col("__s.char_start")),
            }
        )
        .drop("__spans", "__s")
    )


def _spoken(segments: Column) -> Column:
    """Trimmed texts of the segments that have one, joined."""
    texts = F.filter(F.transform(segments, lambda s: F.trim(s["text"])), lambda t: t != "")
    return F.array_join(texts, " ")


def segment_groups(texts, target: int = 100) -> list[tuple[int, int, int, int, int]]:
    """(first, last, start, end, words) of the passages of one list of segment texts; see ``pack_segments``."""
    kept = [(i, t.strip()) for i, t in enumerate([] if texts is None else texts) if t and t.strip()]
    weights = [len(t.split()) for _, t in kept]
    starts = np.cumsum([0] + [len(t) + 1 for _, t in kept])
    return [(kept[a][0], kept[b - 1][0], int(starts[a]), int(starts[b]) - 1, sum(weights[a:b])) for a, b in _pack(weights, target)]


def pack_segments(docs: DataFrame, segments: str = "segments", target: int = 100) -> DataFrame:
    """The same packing over timed segments: first start, last end, offsets in the joined text.
    Blank segments do not count."""

    @batch_udf("array<struct<first:int,last:int,char_start:int,char_end:int,n_words:int>>")
    def groups(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: segment_groups(ts, target))

    rows = docs.withColumn("__groups", groups(F.col(segments)["text"]))
    out = rows.select("*", F.posexplode("__groups").alias("pos", "__g"))
    part = F.slice(segments, F.col("__g.first") + 1, F.col("__g.last") - F.col("__g.first") + 1)
    return out.withColumns(
        {
            "text": _spoken(part),
            "char_start": F.col("__g.char_start"),
            "char_end": F.col("__g.char_end"),
            "time_start": F.get(part, F.lit(0))["start"],
            "time_end": F.get(part, F.size(part) - 1)["end"],
            "n_words": F.col("__g.n_words"),
        }
    ).drop("__groups", "__g", segments)


def word_windows(
    docs: DataFrame, size: int, overlap: int = 0, min_tail: int = 1, text: str = "text"
) -> DataFrame:
    """Windows of ``size`` words every ``size - overlap`` words; short tails dropped."""
    step = size - overlap
    rows = docs.withColumn("__words", T.words(F.col(text))).filter(F.size("__words") >= min_tail)
    starts = F.sequence(F.lit(0), F.size("__words") - 1, F.lit(step))
    return (
        rows.select("*", F.posexplode(starts).alias("pos", "word_start"))
        .withColumn("__part", F.slice("__words", F.col("word_start") + 1, F.lit(size)))
        .filter(F.size("__part") >= min_tail)
        .withColumns({text: F.array_join("__part", " "), "n_words": F.size("__part")})
        .drop("__words", "__part")
    )


def char_windows(docs: DataFrame, size: int = 1200, overlap: int = 200, text: str = "text") -> DataFrame:
    """Windows of ``size`` characters, stripped, blank ones dropped."""
    step = max(size - overlap, 1)
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    return (
        docs.filter(F.length(text) > 0)
        .select("*", F.explode(starts).alias("char_start"))
        .withColumn(text, F.regexp_replace(F.substring(text, F.col("char_start") + 1, F.lit(size)), r"^\s+|\s+$", ""))
        .filter(F.col(text) != "")
    )


def time_merge(
    docs: DataFrame, segments: str = "segments", target: float = 90.0, shortest: float = 30.0
) -> DataFrame:
    """Timed segments joined until the next one would reach ``target`` seconds; a chunk
    under ``shortest`` seconds goes to the one before it. Blank segments do not count."""

    @batch_udf("array<struct<first:int,last:int>>", FEW_ROWS)
    def groups(starts: pd.Series, ends: pd.Series, texts: pd.Series) -> pd.Series:
        def one(ss, es, ts) -> list[tuple[int, int]]:
            kept = [i for i, t in enumerate([] if ts is None else ts) if t and t.strip()]
            chunks: list[tuple[int, int]] = []
            for i in kept:
                if chunks and es[i] - ss[chunks[-1][0]] < target:
                    chunks[-1] = (chunks[-1][0], i)
                else:
                    chunks.append((i, i))
            merged: list[tuple[int, int]] = []
            for a, b in chunks:
                if merged and es[b] - ss[a] < shortest:
                    merged[-1] = (merged[-1][0], b)
                else:
                    merged.append((a, b))
            return merged

        return pd.Series([one(*row) for row in zip(starts, ends, texts, strict=True)])

    s = F.col(segments)
    rows = docs.withColumn("__groups", groups(s["start"], s["end"], s["text"]))
    part = F.slice(segments, F.col("__g.first") + 1, F.col("__g.last") - F.col("__g.first") + 1)
    return (
        rows.select("*", F.posexplode("__groups").alias("pos", "__g"))
        .withColumns(
            {
                "start": F.get(part, F.lit(0))["start"],
                "end": F.get(part, F.size(part) - 1)["end"],
                "text": _spoken(part),
            }
        )
        .drop("__groups", "__g", segments)
    )


def boundary_chunks(
    docs: DataFrame,
    mentions: str = "mentions",
    text: str = "text",
    short: str = "merge",
    min_words: int = 100,
    max_words: int = 800,
    overlap: int = 100,
    fallback_words: int = 400,
    fallback_min: int = 50,
    intro_from: int = 200,
) -> DataFrame:
    """A chunk from every label mention up to the next one.

    Under ``min_words`` it joins the chunk before it (``short="merge"``) or is left out
    (``short="drop"``); over ``max_words`` it is split with ``overlap``. Text before the
    first mention is an introduction; a text without mentions is cut into fixed windows.
    ``mentions`` is an array<struct<pos, label>> in text order.
    """
    if short not in ("merge", "drop"):
        raise ValueError("short is 'merge' or 'drop'")

    def windows(words: list[str], size: int, step: int) -> list[str]:
        return [" ".join(words[i : i + size]) for i in range(0, len(words), step)]

    def one(t: str, marks: list[tuple[int, int]]) -> list[tuple]:
        if not marks:
            parts = windows(t.split(), fallback_words, fallback_words)
            return [("fixed", 0, i, [], p) for i, p in enumerate(parts) if len(p.split()) >= fallback_min]
        out = []
        first = marks[0][0]
        if first > intro_from and len(t[:first].split()) >= min_words:
            out.append(("intro", 0, 0, [], t[:first].strip()))
        ends = [m[0] for m in marks[1:]] + [len(t)]
        for (start, label), end in zip(marks, ends, strict=True):
            body = t[start:end].strip()
            words = body.split()
            if len(words) < min_words:
                if short == "merge" and out and out[-1][0] == "label":
                    kind, at, part, labels, before = out[-1]
                    more = labels if label in labels else [*labels, label]
                    out[-1] = (kind, at, part, more, f"{before} {body}")
            elif len(words) > max_words:
                parts = windows(words, max_words, max_words - overlap)
                out += [("label", start, i, [label], p) for i, p in enumerate(parts)]
            else:
                out.append(("label", start, 0, [label], body))
        return out

    @batch_udf("array<struct<kind:string,char_start:int,part:int,labels:array<int>,text:string>>", FEW_ROWS)
    def chunks(texts: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series(
            [one(t or "", [(m["pos"], m["label"]) for m in ms]) for t, ms in zip(texts, marks, strict=True)]
        )

    keep = [c for c in docs.columns if c not in (mentions, text)]
    return docs.select(*keep, F.explode(chunks(text, mentions)).alias("__c")).select(*keep, "__c.*")


def pos_to_time(points: DataFrame, segments: DataFrame, key: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``points`` (key, point) plus ``seconds`` at that character position of the segments (key, pos, text, start, end), which one
    space joins: linear inside a segment; between or after the segments the last end, 0 without segments."""
    sized = segments.select(key, "pos", F.length(F.coalesce("text", F.lit(""))).alias("__n"), F.col("start").alias("__s"), F.col("end").alias("__e"))
    placed = running(sized, [key], "pos", [Running("__a", F.col("__n") + 1, "sum", strict=True)], block_rows)
    placed = placed.withColumn("__a", F.coalesce("__a", F.lit(0)))
    placed = placed.select(key, "__a", (F.col("__a") + F.col("__n")).alias("__b"), "__n", "__s", "__e")
    once = points.select(key, "point").distinct()
    held = interval_join(once, placed, [key], "point", "__a", "__b")
    share = (F.col("point") - F.col("__a")) / F.col("__n")
    held = held.select(key, "point", (F.col("__s") + share * (F.col("__e") - F.col("__s"))).alias("__held"))
    last = segments.groupBy(key).agg(F.max_by("end", "pos").alias("__last"))
    out = points.join(held, [key, "point"], "left").join(last, key, "left")
    return out.withColumn("seconds", F.coalesce("__held", "__last", F.lit(0.0)).cast("double")).drop("__held", "__last")


def density_windows(
    s: Column, density: Callable[[Column], Column], size: int = 80, stride: int = 20, threshold: float = 0.12
) -> Column:
    """array<struct<start, end, density>>: sliding windows at or above the threshold,
    merged while they start within ``stride`` of the previous end, best density kept."""
    starts = F.when(
        F.length(s) > size, F.sequence(F.lit(0), F.length(s) - size - 1, F.lit(stride))
    ).otherwise(F.array().cast("array<int>"))

    def pieces(bound: Column) -> Column:
        """The windows' texts, each cut out once; strides make that linear in the text."""
        if size % stride:
            cut = lambda i: bound["text"].substr(i + 1, F.lit(size))
        else:
            cut = lambda i: F.array_join(
                F.slice(bound["strides"], (i / stride).cast("int") + 1, F.lit(size // stride)), ""
            )
        return F.transform(starts, lambda i: F.struct(i.alias("start"), cut(i).alias("piece")))

    strides = F.regexp_extract_all(s, F.lit(f"(?s)(.{{1,{stride}}})"), F.lit(1))
    windows = F.get(F.transform(F.array(F.struct(s.alias("text"), strides.alias("strides"))), pieces), F.lit(0))
    scored = F.transform(
        windows,
        lambda w: F.struct(
            w["start"].alias("start"), (w["start"] + size).alias("end"), density(w["piece"]).alias("density")
        ),
    )
    hits = F.filter(scored, lambda w: w["density"] >= threshold)
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,density:double>>")

    def merge(acc: Column, w: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        grown = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], w["end"]).alias("end"),
            F.greatest(last["density"], w["density"]).alias("density"),
        )
        joins = (F.size(acc) > 0) & (w["start"] <= F.get(acc, F.size(acc) - 1)["end"] + stride)
        return F.when(joins, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(
            F.concat(acc, F.array(w))
        )

    return F.aggregate(hits, empty, merge)


def detection_chunks(
    docs: DataFrame, hits: str = "hits", closings: str = "closings", text: str = "text",
    reach: int = 3000, intro_from: int = 100,
) -> DataFrame:
    """Introduction, one chunk per hit up to the next hit, and a closing part.

    ``hits`` is an array<struct<start, end, label>> in text order, ``closings`` an array of
    closing-cue positions in text order. The last hit ends at the first closing cue after
    it, or ``reach`` characters on.
    """
    x, n = F.col(hits), F.length(text)
    first_after = lambda p: F.get(F.filter(F.col(closings), lambda c: c > p), F.lit(0))
    spans = F.transform(
        x,
        lambda h, i: F.struct(
            F.lit("label").alias("kind"), h["label"].cast("int").alias("label"), h["start"].alias("start"),
            F.coalesce(F.get(x, i + 1)["start"], first_after(h["end"]), F.least(h["start"] + reach, n)).alias("end"),
        ),
    )
    none = F.lit(None).cast("int")
    intro = F.filter(
        F.array(F.struct(F.lit("intro").alias("kind"), none.alias("label"), F.lit(0).alias("start"), F.get(x, 0)["start"].alias("end"))),
        lambda c: c["end"] > intro_from,
    )
    close_at = first_after(F.get(x, F.size(x) - 1)["end"])
    closing = F.filter(
        F.array(F.struct(F.lit("closing").alias("kind"), none.alias("label"), close_at.alias("start"), n.alias("end"))),
        lambda c: c["start"].isNotNull(),
    )
    rows = docs.filter(F.size(x) > 0).select("*", F.inline(F.concat(intro, spans, closing)))
    return rows.withColumn(
        text, F.regexp_replace(F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start")), r"^\s+|\s+$", "")
    ).drop(hits, closings)


def key_pattern(key: Column) -> Column:
    """Regular expression for the first three words of a key, anything between them."""
    first = F.slice(T.words(key), 1, 3)
    return F.array_join(F.transform(first, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), ".*?")


def span_between(s: Column, key: Column, next_key: Column, skip: int = 100, reach: int = 2000) -> Column:
    """Text from where ``key`` begins to where ``next_key`` begins (searched from ``skip``
    characters on), else ``reach`` characters; null if the key does not occur."""
    start = F.regexp_instr(s, key_pattern(key))
    rest = F.substr(s, start + skip)
    step = F.when(T.n_words(next_key) > 0, F.regexp_instr(rest, key_pattern(next_key))).otherwise(F.lit(0))
    length = F.when(F.coalesce(step, F.lit(0)) > 0, step - 1 + skip).otherwise(F.lit(reach))
    return F.when((start > 0) & (T.n_words(key) > 0), F.regexp_replace(F.substr(s, start, length), r"^\s+|\s+$", ""))
