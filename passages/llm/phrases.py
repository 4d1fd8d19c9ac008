"""Phrase mining by Toivonen's method, per language.

A phrase is up to ``longest`` consecutive words of one piece of a text; it is frequent if it occurs at least ``support``
times in its language. A sample (every ``sample_parts``-th document by a hash of its key) proposes, with a lowered support, the
phrases to expect. A full pass then counts, exactly, the proposed phrases and their negative border: the phrases that were not
proposed although both phrases one word shorter inside them were (at one word, every word). A phrase of the border that turns
out to be frequent is a failure of the sample, and starts an expansion pass, which counts every phrase that holds a
failure, has frequent words only and was not counted yet. All parts of a frequent phrase are frequent; so one that
the full pass did not count holds a shorter one that it did count and that was not proposed, which is a failure. The
expansion therefore closes the border, whatever the sample was; without failures there is none.

Phrases meet by 64-bit hashes of their words and language (two different ones are taken for equal with a chance of 5e-20). The
expected phrases go to the tasks as a table of bits, sized from their number: a phrase that is let through by chance is only
counted without need. Counts are added up in a task before they are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passages.llm.batches import small_batches
from passages.llm.words import BASE, BASE_INVERSE, LOWER, mix, powers, signed, slices
from passages.session import checkpoint_dir

UNKNOWN = "und"
LONGEST = 4
FLUSH = 1 << 22
LEAST_BITS, MOST_BITS = 20, 30

GAP = np.zeros(256, bool)
GAP[[0x20, 0x09]] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".,;:!?"]] = True
STOP[0x0A:0x0E] = True


class Bits:
    """A set of 64-bit hashes that never forgets one and lets few others through."""

    def __init__(self, n: int):
        self.log = min(MOST_BITS, max(LEAST_BITS, int(np.ceil(np.log2(max(1, n)))) + 5))
        self.bits = np.zeros(1 << (self.log - 3), np.uint8)

    def add(self, place: np.ndarray, value: np.ndarray) -> None:
        self.bits[place] |= value.astype(np.uint8)

    def __contains__(self, h: int) -> bool:
        return bool(self.has(np.array([h], np.uint64))[0])

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.log)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def filled(self, keys: DataFrame) -> Bits:
        """A copy that has the hashes of ``keys`` as well. Spark joins them to bytes; at most the table itself comes here."""
        out = Bits.__new__(Bits)
        out.log, out.bits = self.log, self.bits.copy()
        at = F.shiftrightunsigned("key", 64 - self.log)
        value = F.call_function("shiftleft", F.lit(1), F.pmod(at, F.lit(8)).cast("int"))
        cells = keys.select(F.shiftright(at, 3).alias("place"), value.alias("value")).groupBy("place").agg(F.bit_or("value").alias("value"))
        held: list = []
        for row in cells.toLocalIterator():
            held.append((row["place"], row["value"]))
            if len(held) >= 1 << 16:
                out.add(*np.array(held, np.int64).T)
                held = []
        if held:
            out.add(*np.array(held, np.int64).T)
        return out


def hash_of(name: bytes) -> np.uint64:
    h = 1469598103934665603
    for b in name:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return np.uint64(h)


class Pieces:
    """The words of one slice of rows: bytes, hashes with the language in them, and where runs of n words stay inside a piece."""

    def __init__(self, texts: pa.Array, languages: list[str]):
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.data = LOWER[data]
        stop = STOP[self.data]
        inside = ~(stop | GAP[self.data])
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | cut[1:-1]
        end[:-1] &= ~inside[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self.piece = np.cumsum(stop)[self.start] + self.row if len(data) else self.start
        self.languages = languages
        known = {name: hash_of(name.encode()) for name in set(languages)}
        seed = np.array([known[name] for name in languages], np.uint64)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((self.data + np.uint64(1)) * powers(BASE, len(data)), dtype=np.uint64, out=total[1:])
        h = (total[self.end] - total[self.start]) * powers(BASE_INVERSE, len(data) + 1)[self.start]
        self.words = mix(h ^ (self.end - self.start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) ^ seed[self.row])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words, and which of them stay inside a piece."""
        size = max(0, len(self.words) - n + 1)
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(BASE) + self.words[k : k + size]
        return mix(h), self.piece[n - 1 :][:size] == self.piece[:size]

    def phrase(self, i: int, n: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[i : i + n], self.end[i : i + n])).decode()

    def language(self, i: int) -> str:
        return self.languages[self.row[i]]


def extended(pieces: Pieces, known: Bits, size: int, longest: int) -> list[np.ndarray]:
    """Hashes of the phrases of ``size`` to ``longest`` words all of whose parts of under ``size`` words are known."""
    out, here = [], None
    for n in range(1, longest + 1):
        h, fits = pieces.grams(n)
        here = fits if here is None else here[:-1] & here[1:] & fits
        if n < size:
            here[here] = known.has(h[here])
        else:
            out.append(h[here])
    return out


def bordered(pieces: Pieces, known: Bits, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes, which fit, which count) for every number of words: a phrase counts if both phrases one word shorter in it are known."""
    h, fits = pieces.grams(1)
    yield h, fits, fits
    here = known.has(h)
    for n in range(2, longest + 1):
        h, fits = pieces.grams(n)
        here = here[:-1] & here[1:] & fits
        yield h, fits, here.copy()
        here[here] = known.has(h[here])


def expanded(pieces: Pieces, known: Bits, failed: Bits, longest: int) -> list[np.ndarray]:
    """Hashes of the phrases that hold a failed one and have known or failed words only, but for those that ``bordered`` counts."""
    out, holds, words = [], None, None
    for h, fits, past in bordered(pieces, known, longest):
        fails = failed.has(h)
        if holds is None:
            holds, words = fails, fails | known.has(h)
            continue
        words = words[:-1] & words[1:] & fits
        within = holds[:-1] | holds[1:]
        out.append(h[words & within & ~past])
        holds = within | (fails & fits)
    return out


def _rows(docs: DataFrame, key: str) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN))
    return docs.select(F.xxhash64(F.col(key)).alias("draw"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def _added(pile: list[np.ndarray]) -> pa.RecordBatch:
    keys, n = np.unique(np.concatenate(pile), return_counts=True)
    return pa.record_batch([pa.array(signed(keys)), pa.array(n.astype(np.int64))], ["key", "f"])


def _pass(rows: DataFrame, phrases: Callable[[Pieces], list[np.ndarray]], support: int) -> DataFrame:
    """(key, f) of the phrases of one pass that occur ``support`` times or more, checkpointed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pile, held = [], 0
        for batch in batches:
            for part in slices(batch):
                found = phrases(Pieces(part.column("text"), part.column("lang").to_pylist()))
                pile += found
                held += sum(map(len, found))
                if held >= FLUSH:
                    yield _added(pile)
                    pile, held = [], 0
        if held:
            yield _added(pile)

    found = rows.select("text", "lang").mapInArrow(run, "key long, f long")
    return found.groupBy("key").agg(F.sum("f").alias("f")).filter(F.col("f") >= support).checkpoint()


def _proposed(rows: DataFrame, longest: int, support: int, sample_parts: int) -> tuple[DataFrame, Bits]:
    """The phrases the sample proposes, and their table."""
    sample = rows.filter(F.pmod(F.col("draw"), F.lit(sample_parts)) == 0)
    low = max(1, min(support, max(2, int(0.6 * support / sample_parts))))
    words = _pass(sample, lambda pieces: [pieces.grams(1)[0]], low)
    n = words.count()
    table = Bits(8 * n).filled(words)
    proposed = words.select("key")
    # pairs first: of longer phrases only those of frequent pairs are worth counting
    for size, most in ((2, 2), (3, longest)):
        if size <= longest:
            grown = _sampled(sample, table, size, most, low)
            proposed = proposed.unionByName(grown)
            table = table.filled(grown)
    return proposed, table


def _sampled(sample: DataFrame, table: Bits, size: int, longest: int, low: int) -> DataFrame:
    known = sample.sparkSession.sparkContext.broadcast(table)
    return _pass(sample, lambda pieces: extended(pieces, known.value, size, longest), low).select("key")


def frequent(docs: DataFrame, support: int = 30, longest: int = LONGEST, sample_parts: int = 8, key: str = "doc_id") -> tuple[DataFrame, int]:
    """(key, f) of every phrase of up to ``longest`` words with at least ``support`` occurrences, and the number of full passes."""
    checkpoint_dir(docs.sparkSession)
    rows = _rows(docs, key)
    share = docs.sparkSession.sparkContext.broadcast
    with small_batches(docs.sparkSession):
        expected, table = _proposed(rows, longest, support, sample_parts)
        known = share(table)
        found = _pass(rows, lambda pieces: [h[past] for h, _, past in bordered(pieces, known.value, longest)], support)
        failures = found.join(expected, "key", "left_anti").select("key").checkpoint()
        n = failures.count()
        if not n:
            return found, 1
        failed = share(Bits(n).filled(failures))
        grown = _pass(rows, lambda pieces: expanded(pieces, known.value, failed.value, longest), support)
        return found.unionByName(grown), 2


def named(docs: DataFrame, found: DataFrame, longest: int = LONGEST, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``found`` (key, f) with the phrases themselves (lang, phrase, n_words, f), and the words of every language (lang, n):
    one more pass over the texts. Two smaller ones over a few of them come first and name what is common, so that few phrases
    are told by more than a few tasks."""
    rows = _rows(docs, key)
    n = found.count()
    names, totals = None, None
    with small_batches(docs.sparkSession):
        for parts in (64, 8, 1):
            missing = found if names is None else found.join(names, "key", "left_anti")
            seen = rows if parts == 1 else rows.filter(F.pmod(F.col("draw"), F.lit(parts)) == 1)
            told = _told(seen, Bits(n).filled(missing), longest)
            new = told.filter("key IS NOT NULL").dropDuplicates(["key"]).join(found, "key", "left_semi")
            if names is not None:
                new = new.join(names, "key", "left_anti")
            names = new if names is None else names.unionByName(new)
            names = names.checkpoint()
            totals = told.filter("key IS NULL").groupBy("lang").agg(F.sum("n").alias("n"))
    named = names.join(found, "key")
    return named.select("lang", "phrase", F.col("n").cast("int").alias("n_words"), "f").checkpoint(), totals


def _told(rows: DataFrame, wanted: Bits, longest: int) -> DataFrame:
    """(key, lang, phrase, n) of the wanted phrases in ``rows``, about once per task, and (null, lang, null, words) of each language."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted)
    shape = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, told, totals = shared.value, set(), Counter()
        for batch in batches:
            for part in slices(batch):
                pieces = Pieces(part.column("text"), part.column("lang").to_pylist())
                for lang, n in zip(pieces.languages, np.bincount(pieces.row, minlength=part.num_rows).tolist()):
                    totals[lang] += n
                out = []
                for n in range(1, longest + 1):
                    h, fits = pieces.grams(n)
                    at = np.flatnonzero(fits & wanted.has(h))
                    keys, first = np.unique(h[at], return_index=True)
                    fresh = [(k, i) for k, i in zip(signed(keys).tolist(), at[first].tolist()) if k not in told]
                    out += [(k, pieces.language(i), pieces.phrase(i, n), n) for k, i in fresh]
                    told.update(k for k, _ in fresh)
                if len(told) > FLUSH:
                    told.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), shape)], schema=shape)
        if totals:
            yield pa.RecordBatch.from_pylist([{"key": None, "lang": k, "phrase": None, "n": n} for k, n in totals.items()], schema=shape)

    return rows.select("text", "lang").mapInArrow(run, "key long, lang string, phrase string, n long").checkpoint()


def _part(first: Column, size: Column) -> Column:
    return F.array_join(F.slice("words", first, size), " ")


def collocations(
    docs: DataFrame, support: int = 30, longest: int = LONGEST, top: int = 2000, covered_percent: int = 80, sample_parts: int = 8, key: str = "doc_id"
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score (long but for lang and phrase).

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line breaks and these into words at blanks and tabs. A phrase of 2
    to ``longest`` words with ``a >= support`` occurrences scores floor(2000000 a / (l + r)) for the cut into two parts with l and r
    occurrences where this is lowest (ties: the shortest first part). One that lies inside a longer candidate with at least
    ``covered_percent`` of its occurrences is dropped. Ranks go by score, occurrences (both falling) and phrase in
    byte order, so there are no ties; ``n`` is the number of words of the language.

    A null text counts as empty, a null lang as ``und``; rows that repeat a key and rows with a null key all count. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    found, _ = frequent(docs, support, longest, sample_parts, key)
    known, totals = named(docs, found, longest, key)
    words = F.split("phrase", " ")
    candidates = known.filter("n_words >= 2").select("lang", "phrase", "n_words", F.col("f").alias("a"), words.alias("words"))
    parts = known.select("lang", "phrase", "f")

    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = cuts.join(parts.toDF("lang", "left", "l"), ["lang", "left"]).join(parts.toDF("lang", "right", "r"), ["lang", "right"])
    score = F.expr("(cast(a as decimal(20, 0)) * 2000000) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    cuts = cuts.withColumn("score", score.cast("long"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))

    longer = candidates.filter("n_words > 2").select("lang", "n_words", "words", F.col("a").alias("f"), F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)).alias("size"))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
    longer = longer.select("lang", _part(F.col("at"), F.col("size")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    wide = "decimal(24, 0)"
    covered = F.col("f").cast(wide) * 100 >= F.col("a").cast(wide) * covered_percent
    left = best.join(longer, ["lang", "phrase"], "left").filter(F.col("f").isNull() | ~covered)

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
