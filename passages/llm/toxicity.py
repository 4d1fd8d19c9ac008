"""Toxicity scores: Levenshtein automata over a trie of learned terms, weighed by the words around each hit.

A lexicon of whole words and of word beginnings is learned from all labelled texts. For every distinct word of a batch the
trie of the whole words is intersected with the Levenshtein automaton of ``distance`` edits, as one table that all words
run through together; beginnings run through their plain trie. A hit counts as quoted if quotation marks enclose it
or a verb of saying stands just before it, and as addressed if a word for "you" is near. Counts by kind and context
go into a logistic model fitted on a bounded sample of labelled texts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.phrases import Bits
from passages.llm.samples import Logistic, labelled
from passages.llm.words import Words, slices

# fixed values: words of saying and of address in the four languages of the documents
SAYING = (
    "said says say saying called calls wrote writes quote quoted quotes reported states stated "
    "sagte sagt nannte schrieb zitat zitiert dit disait appelait citation cita dijo dice llamaba escribió"
)
ADDRESS = "you your yours youre u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta vous votre tú ti usted ustedes vosotros"
NEAR = 6
QUOTE_WORDS = 30
LONGEST_TERM = 40


class Lexicon:
    """Whole words and beginnings, each with a weight (log-odds of a toxic text)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], distance: int = 1):
        self.words, self.stems, self.distance = words, stems, distance
        self.longest = max([len(w.encode()) for w in words], default=0) + distance
        self.word_table, self.word_end = _automaton(list(words), distance)
        self.stem_table, self.stem_end = _automaton(list(stems), 0, beginnings=True)


def _automaton(terms: list[str], distance: int, beginnings: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(next state by state and byte, edits of the nearest term accepted in a state or -1).

    States are sets of (trie node, edits so far): the trie and the Levenshtein automaton run side by side, made
    deterministic. State 0 is the dead end, state 1 the start. Edits are byte edits. With ``beginnings`` an accepting
    state keeps accepting."""
    children: list[dict[int, int]] = [{}]
    final = [False]
    for term in terms:
        node = 0
        for byte in term.encode():
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                final.append(False)
            node = children[node][byte]
        final[node] = True

    def closed(states: dict[int, int]) -> frozenset[tuple[int, int]]:
        work = list(states.items())
        while work:
            node, edits = work.pop()
            if edits < distance:
                for child in children[node].values():  # a byte of the term is missing
                    if states.get(child, distance + 1) > edits + 1:
                        states[child] = edits + 1
                        work.append((child, edits + 1))
        return frozenset(states.items())

    def step(state: frozenset, byte: int | None) -> frozenset:
        out: dict[int, int] = {}

        def reach(node, edits):
            if edits <= distance and out.get(node, distance + 1) > edits:
                out[node] = edits

        for node, edits in state:
            for letter, child in children[node].items():
                reach(child, edits + (letter != byte))
            reach(node, edits + 1)
        return closed(out)

    alphabet = sorted({b for c in children for b in c})
    start = closed({0: 0})
    number = {frozenset(): 0, start: 1}
    rows, order = [np.zeros(256, np.int32)], [frozenset(), start]
    at = 1
    while at < len(order):
        state = order[at]
        at += 1
        row = np.zeros(256, np.int32)
        if beginnings and any(final[n] for n, _ in state):
            row[:] = at - 1
        else:
            for byte in [None, *alphabet]:
                reached = step(state, byte)
                if reached not in number:
                    number[reached] = len(order)
                    order.append(reached)
                if byte is None:
                    row[:] = number[reached]
                else:
                    row[byte] = number[reached]
        rows.append(row)
    ends = [min((e for n, e in s if final[n]), default=-1) for s in order]
    return np.array(rows), np.array(ends, np.int8)


def run_automaton(table: np.ndarray, ends: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Edits of the nearest accepted term for each word, -1 if none."""
    state = np.ones(len(start), np.int32)
    alive = np.arange(len(start))
    for k in range(int(length.max()) if len(length) else 0):
        alive = alive[(length[alive] > k) & (state[alive] > 0)]
        if not len(alive):
            break
        state[alive] = table[state[alive], data[start[alive] + k]]
    return ends[state]


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of words: letters, and multi-byte characters but for the punctuation of U+0080-U+00BF and U+2000-U+203F."""
    letters = (data >= 0x80) | ((data >= 97) & (data <= 122))
    for lead, size, second in ((0xC2, 2, None), (0xE2, 3, 0x80)):
        at = np.flatnonzero(data == lead)
        at = at[at + size <= len(data)]
        if second is not None:
            at = at[data[at + 1] == second]
        for k in range(size):
            letters[at + k] = False
    return letters


def _quotes(data: np.ndarray) -> np.ndarray:
    """1 at the last byte of a quotation mark."""
    mark = data == 34
    mark[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
    mark[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] >= 0x9C) & (data[2:] <= 0x9F)
    return mark


class LetterWords(Words):
    """Runs of letters, lower-cased (ASCII and Latin-1 letters)."""

    def __init__(self, texts: pa.Array):
        super().__init__(texts, fold=True)
        data = self.data
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[upper] += 32
        inside = _letters(data)
        cut = np.zeros(len(data) + 1, bool)
        cut[self.offsets] = True
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1] | cut[1:-1]
        end[:-1] &= ~inside[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, self.offsets)


def _hashes_of(words: str) -> np.ndarray:
    return LetterWords(pa.array([words])).hashes()


FEATURES = 12


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Counts of hits of each text by kind (word, misspelt word, beginning) and context, and their density."""
    words = LetterWords(texts)
    out = np.zeros((len(words), FEATURES))
    if not len(words.start):
        return out
    h = words.hashes()
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    start, length = words.start[one], (words.end - words.start)[one]
    kind = np.full(len(one), -1, np.int8)
    short = np.flatnonzero(length <= lexicon.longest)
    kind[short] = run_automaton(lexicon.word_table, lexicon.word_end, words.data, start[short], length[short])
    kind[(kind > 0)] = 1
    stem = run_automaton(lexicon.stem_table, lexicon.stem_end, words.data, start, length) >= 0
    kind[stem & (kind != 0)] = 2
    hits = np.flatnonzero(kind[which] >= 0)
    row = words.rows()
    if len(hits):
        marks = np.r_[0, np.cumsum(_quotes(words.data))]
        in_row, a, b = row[hits], words.first[row[hits]], words.first[row[hits] + 1]
        before = marks[words.start[hits]] - marks[words.offsets[in_row]]
        last = np.minimum(hits + QUOTE_WORDS, b)
        until = np.where(last < b, words.start[np.minimum(last, len(h) - 1)], words.offsets[in_row + 1])
        after = marks[until] - marks[words.end[hits]]
        saying = np.r_[0, np.cumsum(np.isin(h, _hashes_of(SAYING)))]
        address = np.r_[0, np.cumsum(np.isin(h, _hashes_of(ADDRESS)))]
        said = saying[hits] - saying[np.maximum(hits - NEAR, a)] > 0
        quoted = ((before % 2 == 1) & (after > 0)) | said
        to_you = address[np.minimum(hits + NEAR + 1, b)] - address[np.maximum(hits - NEAR, a)] > 0
        for k in range(3):
            mine = kind[which[hits]] == k
            out[:, 3 * k] = np.bincount(in_row[mine & ~quoted], minlength=len(out))
            out[:, 3 * k + 1] = np.bincount(in_row[mine & quoted], minlength=len(out))
            out[:, 3 * k + 2] = np.bincount(in_row[mine & to_you & ~quoted], minlength=len(out))
    plain = out[:, [0, 3, 6]].sum(1)
    out[:, 9] = plain / np.maximum(1, words.counts())
    out[:, :9] = np.log1p(out[:, :9])
    out[:, 10] = out[:, [0, 6]].max(1) > 0
    out[:, 11] = out[:, 3] > 0
    return out


def _term_counts(docs: DataFrame) -> DataFrame:
    """(term, stem, n, toxic): in how many of the texts a word or a beginning of words occurs, added up before the shuffle."""

    def run(batches):
        total, toxic = Counter(), Counter()

        def rows():
            terms = list(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _ in terms], pa.string()),
                    pa.array([s for _, s in terms], pa.bool_()),
                    pa.array([total[t] for t in terms], pa.int64()),
                    pa.array([toxic[t] for t in terms], pa.int64()),
                ],
                ["term", "stem", "n", "toxic"],
            )

        for batch in batches:
            for part in slices(batch):
                words = LetterWords(part.column("text"))
                data = words.data.tobytes()
                for i, label in enumerate(part.column("label").to_pylist()):
                    a, b = words.first[i], words.first[i + 1]
                    seen = {data[s:e].decode("utf-8", "replace") for s, e in zip(words.start[a:b], words.end[a:b]) if e - s <= LONGEST_TERM}
                    terms = {(w, False) for w in seen} | {(w[:k], True) for w in seen for k in range(4, min(len(w), 9) + 1)}
                    total.update(terms)
                    if label:
                        toxic.update(terms)
                if len(total) > 500_000:
                    yield from rows()
                    total.clear()
                    toxic.clear()
        yield from rows()

    rows = docs.select("text", "label").mapInArrow(run, "term string, stem boolean, n long, toxic long")
    return rows.groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def _present(docs: DataFrame, candidates: list[tuple[str, bool]]) -> DataFrame:
    """(doc_id, terms): the places of the candidates that occur in a text; texts without one give no row."""
    words = {t: i for i, (t, stem) in enumerate(candidates) if not stem}
    stems = {t: i for i, (t, stem) in enumerate(candidates) if stem}
    shared = docs.sparkSession.sparkContext.broadcast((words, stems))

    def run(batches):
        words, stems = shared.value
        for batch in batches:
            for part in slices(batch):
                found = LetterWords(part.column("text"))
                data = found.data.tobytes()
                _, first, same = np.unique(found.hashes(), return_index=True, return_inverse=True)
                terms: dict[int, set[int]] = {}
                for k, i in enumerate(first.tolist()):
                    s, e = found.start[i], found.end[i]
                    if e - s <= LONGEST_TERM:
                        w = data[s:e].decode("utf-8", "replace")
                        own = {words[w]} if w in words else set()
                        own.update(stems[w[:n]] for n in range(4, min(len(w), 9) + 1) if w[:n] in stems)
                        if own:
                            terms[k] = own
                hit = np.zeros(len(first), bool)
                hit[list(terms)] = True
                at = np.flatnonzero(hit[same])
                rows: dict[int, set[int]] = {}
                for row, k in zip(found.rows()[at].tolist(), same[at].tolist()):
                    rows.setdefault(row, set()).update(terms[k])
                ids = part.column("doc_id").take(pa.array(list(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([sorted(t) for t in rows.values()], pa.list_(pa.int32()))], ["doc_id", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, terms array<int>")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, and a few more: a table of bits goes to the tasks, no text is shuffled."""
    keys = ids.select(F.xxhash64(F.col("doc_id")).alias("key"))
    shared = docs.sparkSession.sparkContext.broadcast(Bits(ids.count()).filled(keys))

    def run(batches):
        wanted = shared.value
        for batch in batches:
            keys = np.asarray(batch.column("key"), np.int64).view(np.uint64)
            yield batch.filter(pa.array(wanted.has(keys))).drop_columns(["key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64(F.col("doc_id")).alias("key")).mapInArrow(run, f"doc_id {kind}, text string")


def candidate_terms(docs: DataFrame, known: DataFrame, sample: DataFrame, support: int, precision: float) -> list[tuple[str, bool, int]]:
    """(term, stem, toxic) of all terms that may qualify, and few others.

    A term that qualifies is in at least support / 2 * p / (1 - p) toxic texts, and the clean texts of any sample show it at
    most as often as all of them may. So only the toxic texts are counted here, and they alone are shuffled."""
    toxic = known.filter("label = 1").select("doc_id", F.lit(1).alias("label"))
    texts = _only(docs, toxic).join(toxic, "doc_id")
    least = max(1, math.ceil(support / 2 * precision / (1 - precision)))
    often = _term_counts(texts).filter(F.col("toxic") >= least).select("term", "stem", "toxic")
    clean = _term_counts(sample.filter("label = 0")).select("term", "stem", F.col("n").alias("clean"))
    both = often.join(clean, ["term", "stem"], "left").fillna(0, ["clean"])
    may = both.filter(F.col("toxic") >= precision * (F.col("toxic") + F.col("clean") + support / 2))
    return sorted((r["term"], r["stem"], r["toxic"]) for r in may.collect())


def learn_lexicon(docs: DataFrame, known: DataFrame, sample: DataFrame, support: int = 5, precision: float = 0.7) -> Lexicon:
    """All terms that occur in ``support`` labelled texts and, smoothed by half as many clean ones, are toxic with ``precision``.

    ``known`` has doc_id and label, ``sample`` the label and text of some labelled rows, which only save work. Repeated
    labels of a doc_id and repeated rows count each. A beginning is kept only without a shorter one that is kept; whole words of
    five letters and more may be misspelt. Terms are taken in order, so ties do not matter."""
    candidates = candidate_terms(docs, known, sample, support, precision)
    present = _present(docs, [(t, stem) for t, stem, _ in candidates]).join(known.select("doc_id"), "doc_id")
    counts = {r["term"]: r["n"] for r in present.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    odds: dict[tuple[str, bool], float] = {}
    for i, (t, stem, toxic) in enumerate(candidates):
        n = counts.get(i, 0)
        if n >= support and toxic >= precision * (n + support / 2):
            odds[t, stem] = float(np.log((toxic + 0.5) / (n - toxic + 0.5)))
    words = {t: w for (t, stem), w in odds.items() if not stem and len(t) >= 5}
    stems: dict[str, float] = {}
    for (t, stem), w in sorted(odds.items(), key=lambda x: len(x[0][0])):
        if (stem or len(t) < 5) and not any(t[:k] in stems for k in range(1, len(t))):
            stems[t] = w
    return Lexicon(words, stems)


class Model:
    def __init__(self, lexicon: Lexicon, logistic: Logistic | None):
        self.lexicon, self.logistic = lexicon, logistic

    def score(self, texts: pa.Array) -> np.ndarray:
        x = features(texts, self.lexicon)
        return np.zeros(len(x)) if self.logistic is None else self.logistic.score(x)


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> Model:
    """Learn the lexicon from all rows of ``labels`` (doc_id, label 0 or 1) and their texts, fit the weights on about ``sample`` of them.

    Labels without a doc_id, a value or a text are left out; repeated ones count each. Empty tables give a model that scores 0."""
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    rows = labelled(docs, labels, sample)
    lexicon = learn_lexicon(docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text"), known, rows)

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                x = features(part.column("text"), lexicon)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    data = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(run, "label int, x array<double>").collect()
    y = np.array([r["label"] for r in data], float)
    if len(set(y)) < 2:
        return Model(lexicon, None)
    return Model(lexicon, Logistic(np.array([r["x"] for r in data]), y))


def score(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """``docs`` with ``score``: the probability that the whole text is toxic; null and empty texts get that of no hits.

    A model from labels of one kind only scores everything 0. A clashing score column is replaced, the others stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score")

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                yield part.append_column("score", pa.array(shared.value.score(part.column(column)), pa.float64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, score double")
