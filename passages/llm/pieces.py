"""SentencePiece encoding and decoding by a streaming Viterbi search."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.vocabulary import Vocabulary
from passages.llm.words import lists, slices

CACHE = 40_000
SHORT = 64
TOGETHER = 5_000


class Stream:
    """Best segmentation of a stream of characters, committed as soon as it is certain.

    ``best[k]`` is the score of the best path to boundary ``done + k``, ``back[k]`` its last piece. Boundaries beyond the
    one being extended are at most ``longest`` ahead. All surviving paths end there; where their backpointers meet in
    one boundary, everything before it is committed and dropped. Equal scores prefer the longer last piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""
        self.at = 0
        self.mark = 4 * vocabulary.longest
        self.best: list[int | None] = [0]
        self.back: list[tuple[int, tuple[int, ...]] | None] = [None]

    def feed(self, text: str) -> Iterator[tuple[int, ...]]:
        self.text += text
        yield from self._extend(len(self.text) - self.v.longest)

    def finish(self) -> Iterator[tuple[int, ...]]:
        yield from self._extend(len(self.text))
        yield from self._commit(len(self.text))

    def _extend(self, stop: int) -> Iterator[tuple[int, ...]]:
        text, best, back, forward = self.text, self.best, self.back, self.v.forward
        i, size = self.at, len(text)
        while i < stop:
            score = best[i]
            if score is not None:
                node, j, single = forward, i, False
                while j < size:
                    node = node.get(text[j])
                    if node is None:
                        break
                    j += 1
                    piece = node.get(None)
                    if piece is not None:
                        self._reach(j, score + piece[1], i, piece[0])
                        single |= j == i + 1
                if not single:
                    ids = self.v.spelled(text[i])
                    self._reach(i + 1, score + self.v.byte_score * len(ids), i, ids)
            i += 1
            if i >= self.mark:
                self.at = i
                yield from self._commit(self._meeting(i))
                text, best, back, size = self.text, self.best, self.back, len(self.text)
                stop -= i - self.at
                i, self.mark = self.at, self.at + 4 * self.v.longest
        self.at = i

    def _reach(self, j: int, score: int, i: int, ids) -> None:
        best = self.best
        while len(best) <= j:
            best.append(None)
            self.back.append(None)
        known = best[j]
        if known is None or score > known:
            best[j] = score
            self.back[j] = (i, ids)

    def _meeting(self, at: int) -> int:
        """The last boundary that every path to a live boundary passes."""
        live = {k for k in range(at, len(self.best)) if self.best[k] is not None}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.back[top][0])
        return live.pop()

    def _commit(self, stop: int) -> Iterator[tuple[int, ...]]:
        out, k = [], stop
        while k > 0:
            k, ids = self.back[k]
            out.append(ids if isinstance(ids, tuple) else (ids,))
        self.text, self.at = self.text[stop:], self.at - stop
        self.best, self.back = self.best[stop:], [b and (b[0] - stop, b[1]) for b in self.back[stop:]]
        if self.back:
            self.back[0] = None
        yield tuple(chain.from_iterable(reversed(out)))


def encode_text(text: str, vocabulary: Vocabulary) -> list[int]:
    stream = Stream(vocabulary)
    out = []
    for stretch in vocabulary.stretches(text):
        for ids in stream.feed(stretch):
            out.extend(ids)
    for ids in stream.finish():
        out.extend(ids)
    return out


def decode_ids(ids: Iterable[int], vocabulary: Vocabulary) -> str:
    """The text of piece ids, without the space the encoder put in front; bytes that are no UTF-8 become U+FFFD."""
    return b"".join(map(vocabulary.spelling.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


class Table:
    """The trie of the pieces as sorted edges, and the search of ``Stream`` over many short texts at once.

    Every text is one window. Pieces are found for all places of all texts together, letter by letter; paths then grow by place
    and length, so that of equal scores the longer last piece stays."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        nodes, edges = [vocabulary.forward], []
        for at, node in enumerate(nodes):  # grows as it is read
            for c, below in node.items():
                if c is not None:
                    edges.append((at << 21 | ord(c), len(nodes)))
                    nodes.append(below)
        self.edge, self.below = np.array(sorted(edges), np.int64).T.copy()
        self.piece, self.worth = np.array([node.get(None, (-1, 0)) for node in nodes], np.int64).T.copy()

    def matches(self, letters: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, length, piece, score) of all pieces in the texts; letters that are no piece are spelled in bytes, with piece -1."""
        single = np.zeros(len(letters), bool)
        found, length = [], 0
        at, node = np.arange(len(letters)), np.zeros(len(letters), np.int64)
        while len(at):
            key = node << 21 | letters[at + length]
            edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[edge] == key
            at, node, length = at[hit], self.below[edge[hit]], length + 1
            some = np.flatnonzero(self.piece[node] >= 0)
            found.append((at[some], np.full(len(some), length), self.piece[node[some]], self.worth[node[some]]))
            if length == 1:
                single[at[some]] = True
            more = at + length < stop[at]
            at, node = at[more], node[more]
        rest = np.flatnonzero(~single)
        found.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), -1), self.v.byte_score * _n_bytes(letters[rest])))
        return tuple(np.concatenate(c) for c in zip(*found))

    def encode(self, texts: list[str]) -> list[tuple[int, ...]]:
        """The piece ids of each text; none may be empty."""
        letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.array([len(t) for t in texts], np.int64)
        end, number = np.cumsum(size), np.arange(len(texts))
        own = np.repeat(number, size)
        place, length, piece, worth = self.matches(letters, end[own])
        inside = place - (end - size)[own[place]]
        order = np.argsort(inside << 21 | length, kind="stable")
        place, length, piece, worth, inside = (a[order] for a in (place, length, piece, worth, inside))
        # a text has a boundary more than letters
        start = place + own[place]
        best = np.full(len(letters) + len(texts), np.iinfo(np.int64).min)
        back = np.zeros(len(best), np.int64)
        best[end - size + number] = 0
        step = np.flatnonzero(np.diff(inside << 21 | length)) + 1
        for a, b in zip([0, *step], [*step, len(start)]):
            to, score = start[a:b] + length[a], best[start[a:b]] + worth[a:b]
            better = np.flatnonzero(score > best[to])
            best[to[better]] = score[better]
            back[to[better]] = a + better
        passed = np.zeros(len(best), bool)
        at = end + number
        while len(at):
            passed[at] = True
            last = back[at]
            at = start[last][inside[last] > 0]
        last = back[passed]
        ids, first = piece[last], place[last]
        many = np.where(ids < 0, _n_bytes(letters[first]), 1)
        flat = np.repeat(ids, many)
        spelled = np.flatnonzero(ids < 0)
        for k, to in zip(spelled, (np.cumsum(many) - many)[spelled]):
            flat[to : to + many[k]] = self.v.spelled(chr(letters[first[k]]))
        stops = np.cumsum(np.bincount(own[first], many, len(texts)).astype(np.int64)).tolist()
        flat = flat.tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *stops], stops)]


def _n_bytes(letters: np.ndarray) -> np.ndarray:
    return 1 + (letters >= 0x80) + (letters >= 0x800) + (letters >= 0x10000).astype(np.int64)


class Encoder:
    """Encodes stretches between sure boundaries, each distinct one once while it is remembered."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.table = Table(self.v)

    def rows(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of some texts, null ones as empty; short stretches that are not remembered are searched together."""
        if len(self.known) >= CACHE:
            self.known, self.older = {}, self.known
        cut, new = [self.v.stretches(t) if t else [] for t in texts], []
        for s in dict.fromkeys(chain.from_iterable(cut)):
            if len(s) <= SHORT and s not in self.known:
                if s in self.older:
                    self.known[s] = self.older[s]
                else:
                    new.append(s)
        for a in range(0, len(new), TOGETHER):
            some = new[a : a + TOGETHER]
            self.known.update(zip(some, self.table.encode(some)))
        return [self.joined(c) for c in cut]

    def stretch(self, text: str) -> tuple[int, ...]:
        if len(text) > SHORT:
            stream = Stream(self.v)
            return tuple(chain(chain.from_iterable(stream.feed(text)), chain.from_iterable(stream.finish())))
        if len(self.known) >= CACHE:  # two generations: what is used again outlives the change
            self.known, self.older = {}, self.known
        ids = self.known[text] = self.older.get(text) or self.window(text)
        return ids

    def window(self, text: str) -> tuple[int, ...]:
        """The search of ``Stream`` over a text that is one window: nothing to commit before its end."""
        size, forward = len(text), self.v.forward
        best: list = [None] * (size + 1)
        back: list = [None] * size
        best[0] = 0
        for i in range(size):
            score = best[i]
            if score is None:
                continue
            node, single = forward, False
            for j in range(i, size):
                node = node.get(text[j])
                if node is None:
                    break
                piece = node.get(None)
                if piece is not None:
                    reached, known = score + piece[1], best[j + 1]
                    if known is None or reached > known:
                        best[j + 1] = reached
                        back[j] = (i, piece[0])
                    if j == i:
                        single = True
            if not single:
                ids = self.v.spelled(text[i])
                reached, known = score + self.v.byte_score * len(ids), best[i + 1]
                if known is None or reached > known:
                    best[i + 1] = reached
                    back[i] = (i, ids)
        out, k = [], size
        while k:
            k, ids = back[k - 1]
            out += ids[::-1] if isinstance(ids, tuple) else (ids,)
        return tuple(out[::-1])

    def row(self, text: str) -> list[int]:
        return self.joined(self.v.stretches(text))

    def joined(self, stretches: list[str]) -> list[int]:
        found = list(map(self.known.get, stretches))
        if not all(found):
            found = [ids or self.known.get(s) or self.stretch(s) for ids, s in zip(found, stretches)]
        return list(chain.from_iterable(found))


_process: dict[bytes, Encoder] = {}


def _process_encoder(model: bytes) -> Encoder:
    """One encoder per worker process and model, so that a reused worker need not read the pieces again."""
    if model not in _process:
        _process.clear()
        _process[model] = Encoder(model)
    return _process[model]


def encode(docs: DataFrame, model: bytes, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>) and ``lossless`` (whether decoding the ids gives the text back).

    Null texts get null in both; an empty text has no ids. Other columns stay, except a clashing ids or lossless."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("ids", "lossless")

    def run(batches):
        coder = _process_encoder(shared.value)
        v = coder.v
        for batch in batches:
            for part in slices(batch, column):
                texts = part.column(column).to_pylist()
                rows = coder.rows(texts)
                good = [None if t is None else decode_ids(r, v) == t for t, r in zip(texts, rows)]
                ids = lists(np.fromiter(chain.from_iterable(rows), np.int32), [len(r) for r in rows], pa.int32())
                if None in texts:
                    ids = pa.array([None if t is None else r for t, r in zip(texts, rows)], pa.list_(pa.int32()))
                yield part.append_column("ids", ids).append_column("lossless", pa.array(good, pa.bool_()))
        coder.known, coder.older = {}, {}  # the worker may do something else next

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, ids array<int>, lossless boolean")


def decode(rows: DataFrame, model: bytes, column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the text of the ids; null ids give null. A clashing decoded column is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    rows = rows.drop("decoded")

    def run(batches):
        v = _process_encoder(shared.value).v
        for batch in batches:
            out = [None if r is None else decode_ids(r, v) for r in batch.column(column).to_pylist()]
            yield batch.append_column("decoded", pa.array(out, pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, decoded string")
