"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The pre-tokens of a batch (the stretches of a text that no piece reaches over) are inserted in sorted order, so the
prefix two neighbours share is a path of the trie whose forward scores are there already: only the new nodes are
computed, each by walking back over the pieces that may end there. A terminal node stores the number of pieces of
its best segmentation; documents add up the numbers of their pre-tokens.
"""

from __future__ import annotations

from collections.abc import Iterable
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

from passages.llm.vocabulary import Vocabulary
from passages.llm.words import slices

CACHE = 150_000


class Trie:
    """Forward scores of the trie along the path to the last pre-token; its terminal counts in ``counts``.

    Sorted insertion visits the trie depth first, so nodes off the current path are never needed again and are not kept.
    Terminals are kept in two generations of about CACHE: those in use outlive a change, others are counted anew."""

    def __init__(self, model: bytes):
        self.v = Vocabulary(model, backward=True)
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def insert(self, words: Iterable[str]) -> None:
        words = set(words)
        if len(self.counts) > CACHE:
            self.counts, self.older = {}, self.counts
        missing = words - self.counts.keys()
        self.counts.update((w, self.older[w]) for w in missing & self.older.keys())
        new = sorted(missing - self.counts.keys())
        backward, byte_score = self.v.backward, self.v.byte_score
        best, pieces, last = [0], [0], ""
        for word in new:
            depth = len(commonprefix((last, word)))
            del best[depth + 1 :], pieces[depth + 1 :]
            for j in range(depth, len(word)):
                node, top, count, single = backward, None, 0, False
                for i in range(j, -1, -1):
                    node = node.get(word[i])
                    if node is None:
                        break
                    piece = node.get(None)
                    if piece is not None:
                        score = best[i] + piece[1]
                        if top is None or score >= top:  # equal scores: the longer last piece
                            top, count = score, pieces[i] + 1
                        single |= i == j
                if not single:
                    size = len(word[j].encode())
                    score = best[j] + byte_score * size
                    if top is None or score > top:
                        top, count = score, pieces[j] + size
                best.append(top)
                pieces.append(count)
            self.counts[word] = pieces[-1]
            last = word


_process: dict[bytes, Trie] = {}


def _process_trie(model: bytes) -> Trie:
    if model not in _process:
        _process.clear()
        _process[model] = Trie(model)
    return _process[model]


def count_tokens(docs: DataFrame, model: bytes, column: str = "text") -> DataFrame:
    """``docs`` with ``n_pretokens`` and ``n_tokens`` (long) of whole texts.

    Null texts get null in both, empty texts zero. Other columns stay, except clashing ones of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("n_pretokens", "n_tokens")

    def run(batches):
        trie = _process_trie(shared.value)
        for batch in batches:
            for part in slices(batch, column):
                rows = [None if t is None else trie.v.stretches(t) for t in part.column(column).to_pylist()]
                trie.insert({w for r in rows if r for w in r})
                count = trie.counts.__getitem__
                out = [None if r is None else sum(map(count, r)) for r in rows]
                sizes = pa.array([None if r is None else len(r) for r in rows], pa.int64())
                yield part.append_column("n_pretokens", sizes).append_column("n_tokens", pa.array(out, pa.int64()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, n_pretokens long, n_tokens long")
