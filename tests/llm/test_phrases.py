"""Phrase mining against a plain count, whatever the sample proposes, and awkward rows."""

import random
import re
from collections import Counter, defaultdict

import pytest

from passages.llm import phrases


def plain(rows, support, longest=4, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= support}
        scored = []
        for p, a in cand.items():
            cuts = [(2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def made(size, seed=3):
    draw = random.Random(seed)
    words = ["the", "of", "a", "New", "york", "city", "état", "x", "ß", "w1", "w2", "w3"]
    fixed = ["new york city hall", "the état of x", "w1 w2 w3"]
    rows = []
    for i in range(size):
        text = " ".join(draw.choice(fixed) if draw.random() < 0.3 else draw.choice(words) + draw.choice(["", "", ",", ".", "\n", "\t"]) for _ in range(draw.randint(0, 30)))
        rows.append((i, text, draw.choice(["en", "en", "en", "fr", None])))
    return [*rows, (None, "alone in its key " * 9, "en"), (5, None, "en"), (6, "", None), (6, " .,\n", "xx"), (7, "new york city hall", "en"), (7, "new york city hall", "en")]


@pytest.mark.parametrize(("support", "parts", "top"), [(5, 2, 2000), (5, 64, 2000), (8, 3, 20), (2, 1, 2000)])
def test_same_as_plain(spark, support, parts, top):
    rows = made(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = phrases.collocations(docs.repartition(3), support, top=top, sample_parts=parts)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, support, top=top)


def test_failures_of_the_sample_start_an_expansion(spark):
    rows = made(120, 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole, one = phrases.frequent(docs, 4, sample_parts=1)
    found, passes = phrases.frequent(docs, 4, sample_parts=1000)
    assert one == 1 and passes == 2
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, found.collect()))


def test_longer_than_a_slice(spark, monkeypatch):
    rows = [(i, "one two three four five " * (400 + i), "en") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    monkeypatch.setattr(phrases, "FLUSH", 50)
    got = phrases.collocations(docs, 30)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 30)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 3, "k", 2)], "doc_id long, text string, lang string, f int, key string, n int")
    assert phrases.collocations(docs, 1).collect()[0].asDict() == {"lang": "en", "rank": 1, "phrase": "a b", "a": 1, "l": 1, "r": 1, "n": 2, "score": 1000000}
    assert phrases.collocations(docs.limit(0)).count() == 0
