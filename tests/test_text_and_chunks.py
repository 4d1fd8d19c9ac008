"""Text expressions, chunkers and the fuzzy scorer on small hand-made inputs."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from passages.functions import text as T
from passages.functions.batch import batch_udf
from passages.functions.likeness import ratios, ratios_of_pairs
from passages.operators import chunk as C
from passages.operators import match as M


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "s string").select(column(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("column", "text", "want"),
    [
        (T.norm_key, " Part 1.TXT", "part_1"),
        (T.spelling_key, "ಅನ್ಕ ಽಃ", "ಅಂಕಹ"),
        (T.fold_text, "Été — ﬁn  ÑAÏVE 12!", "ete fin naive"),
        (T.loosen, "Kṛṣṇa śānti", "krishna shanti"),
        (T.script_of, "abc ಕ अ", "kn"),
        (T.script_of, "अ ಕ", "hi"),
        (T.script_of, "plain", "en"),
        (T.repair_ref, "bg2.25", "BG 2.25"),
        (T.label_reply, "2.22, 2.23", [22, 23]),
        (T.label_reply, "Verse 17", [17]),
        (T.label_reply, "17 or 99", [17]),
        (T.label_reply, "none (2.4)", []),
        (T.explicit_refs, "see 2.47, verse 12 and 2 : 47; 12.4 and 2.99", [47, 12]),
        (T.clean_text, " a\r\n\r\n\r\n\rb ", "a\n\nb"),
        (T.note_prefix, "SEE_ALSO: x", "SEE_ALSO"),
        (T.sentences, "One two three four five. No! And six seven eight nine ten?", ["One two three four five.", "And six seven eight nine ten?"]),
    ],
)
def test_expressions(spark, column, text, want):
    assert value(spark, text, column) == want


def test_label_number(spark):
    rows = spark.createDataFrame([("BG 2.47",), ("BG 3.4",), ("x",)], "s string")
    assert [r[0] for r in rows.select(T.label_number(F.col("s"))).collect()] == [47, None, None]


def test_time_formats(spark):
    row = spark.range(1).select(
        T.mmss(F.lit(65.4)).alias("a"), T.mmss(F.lit(3700.0)).alias("b"),
        T.position_label(F.lit(0.1), F.lit(0.5), F.lit(600.0), note=", guessed").alias("c"),
        T.position_label(F.lit(0.1), F.lit(0.5), F.lit(None).cast("double"), "at ", " of it").alias("d"),
        T.deep_link(F.lit("u/"), F.lit("x"), F.lit(0.5), F.lit(100.0)).alias("e"),
        T.deep_link(F.lit("u/"), F.lit("x"), F.lit(0.5), F.lit(None).cast("double")).alias("f"),
        T.deep_link(F.lit("u/"), F.lit(""), F.lit(0.5), F.lit(9.0)).alias("g"),
    ).first()
    assert tuple(row) == (
        "01:05", "1:01:40", "~01:00 – 05:00, guessed", "at 10%–50% of it", "u/x&t=50s", "u/x", "",
    )


def test_mentions_keep_their_distance(spark):
    text = "In verse 12 (the 12th verse) he says. Much later the fourteenth shloka, then chapter 2 verse 99."
    got = [(r["pos"], r["label"]) for r in value(spark, text, T.mentions)]
    assert got == [(text.index("verse 12"), 12), (text.index("fourteenth"), 14)]


def test_json_reply(spark):
    assert tuple(value(spark, 'ok {"label": "A", "probability": 0.25} bye', T.json_reply)) == ("A", 0.25)
    assert value(spark, "no json", T.json_reply) is None


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_packing_keeps_every_word(spark):
    rnd = random.Random(0)
    sentences = [" ".join(f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 40))) + rnd.choice(".?") for _ in range(60)]
    text = " ".join(sentences) + " " + " ".join(["long"] * 450)
    rows = C.pack_sentences(docs(spark, text)).orderBy("pos").collect()
    assert " ".join(r["text"] for r in rows).split() == text.split()
    assert all(r["text"] == text[r["char_start"] : r["char_end"]] for r in rows)
    assert all(r["n_words"] >= 100 for r in rows[:-1]) and all(r["n_words"] < 300 for r in rows)


def test_time_merge(spark):
    segments = [(i * 20.0, (i + 1) * 20.0, f"s{i}") for i in range(5)]
    df = spark.createDataFrame([(0, segments)], "doc_id long, segments array<struct<start:double,end:double,text:string>>")
    got = [(r["start"], r["end"], r["text"]) for r in C.time_merge(df).collect()]
    assert got == [(0.0, 100.0, "s0 s1 s2 s3 s4")]


def test_boundary_chunks(spark):
    body = lambda n, w: " ".join([w] * n)
    text = f"{body(120, 'intro')} verse 3 {body(150, 'a')} verse 4 {body(15, 'b')} verse 5 {body(900, 'c')}"
    df = docs(spark, text, "no label here " * 200).withColumn("mentions", T.mentions(F.col("text")))
    merge = C.boundary_chunks(df).collect()
    kinds = sorted((r["doc_id"], r["char_start"], r["part"], r["kind"], tuple(r["labels"])) for r in merge)
    assert [k[3:] for k in kinds] == [
        ("intro", ()), ("label", (3, 4)), ("label", (5,)), ("label", (5,)), ("fixed", ()), ("fixed", ()),
    ]
    assert any("a verse 4 b" in r["text"] for r in merge)
    drop = C.boundary_chunks(df, short="drop").collect()
    assert all("verse 4" not in r["text"] for r in drop)


def test_detection_chunks(spark):
    text = "x" * 150 + "HIT" + "y" * 4000
    df = docs(spark, text).withColumns(
        {
            "hits": F.expr("array(named_struct('start', 150, 'end', 153, 'label', 7))"),
            "closings": F.expr("array(200)"),
        }
    )
    got = [(r["kind"], r["label"], r["start"], r["end"]) for r in C.detection_chunks(df).orderBy("start").collect()]
    assert got == [("intro", None, 0, 150), ("label", 7, 150, 200), ("closing", None, 200, len(text))]


def brute_ratio(a, b):
    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            new = [0]
            for j, d in enumerate(y):
                new.append(row[j] + 1 if c == d else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    def one(s, t):
        windows = [t[max(0, i) : max(0, i) + len(s) + min(0, i)] for i in range(1 - len(s), len(t))]
        return max(2 * lcs(s, w) / (len(s) + len(w)) for w in windows if w)

    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return max(one(short, long), one(long, short)) if len(a) == len(b) else one(short, long)


def test_partial_ratio_is_the_best_window():
    rnd = random.Random(4)
    for _ in range(60):
        a = "".join(rnd.choices("abcd ", k=rnd.randint(1, 12)))
        b = "".join(rnd.choices("abcd ", k=rnd.randint(1, 25)))
        assert M.partial_ratio(a, b) == pytest.approx(brute_ratio(a, b))
    assert M.partial_ratio("abc", "xxabcxx") == 1.0


@pytest.mark.parametrize("threshold", [0.3, 0.65, 0.9])
def test_scorer_loses_no_pair(threshold):
    rnd = random.Random(5)
    for _ in range(80):
        letters = "abcdefgh "[: rnd.randint(2, 9)]
        entries = [(i, "".join(rnd.choices(letters, k=rnd.randint(0, 40)))) for i in range(10)]
        noisy = [rnd.choice(letters) if rnd.random() < 0.2 else ch for ch in entries[0][1]]
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 30))) + "".join(noisy) + "".join(rnd.choices(letters, k=rnd.randint(0, 30)))
        every = {label: M.partial_ratio(entry, text) for label, entry in entries if entry and text}
        got = dict(M.Scorer(entries, threshold)(text))
        assert got == pytest.approx({label: v for label, v in every.items() if v >= threshold})


def test_candidates_are_the_exhaustive_scores(spark):
    entries = spark.createDataFrame(
        [(1, "the quick brown fox jumps over the lazy dog"), (2, "a stitch in time saves nine they say"), (3, "")], "label int, text string"
    )
    # every other word misspelt: no two words in a row are left
    items = docs(spark, "the quikc brown fxo jumps ovre the lzay dog", "nothing of the kind", "in time saves nine they say a stitch", "", None)
    fast = {(r["doc_id"], r["label"]): r["score"] for r in M.fuzzy_candidates(items, entries, "doc_id", 0.6).collect()}
    full = M.fuzzy_matrix(items.withColumn("text", T.fold_text(F.col("text"))), entries.filter("label < 3")).collect()
    assert fast == pytest.approx({(r["doc_id"], i + 1): v for r in full for i, v in enumerate(r["string"]) if v >= 0.6})
    assert (0, 1) in fast


def test_candidates_keep_to_their_language(spark):
    schema = "label int, text string, lang string"
    entries = spark.createDataFrame([(1, "kuru kshetre", "xx"), (1, "field of kuru", "en"), (2, "field of kuru", "xx")], schema)
    items = spark.createDataFrame([(0, "on the field of kuru", "en"), (1, "on the field of kuru", "xx"), (2, "x", None)], "doc_id long, text string, lang string")
    plain = lambda c: F.lower(c)
    joined = lambda c: F.regexp_replace(F.lower(c), " ", "")
    got = M.fuzzy_candidates(items, entries, "doc_id", 0.9, "lang", [plain, joined]).collect()
    assert sorted((r["doc_id"], r["label"], r["score"]) for r in got) == [(0, 1, 1.0), (1, 2, 1.0)]


def test_ngram_match_counts_distinct_grams(spark):
    entries = spark.createDataFrame([(1, "a b c d e f"), (2, "x y z u v")], "label int, text string")
    items = docs(spark, "zero a b c d e f g", "x y z u v x y z u v", "x y z u")
    got = {(r["doc_id"], r["label"]): r["score"] for r in M.ngram_match(items, entries).collect()}
    assert got == {(0, 1): 1.0, (1, 2): 1.0}


def test_two_pass_anchors(spark):
    entries = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "omega psi chi phi upsilon")], "label int, text string")
    text = "w" * 100 + " #### alpha beta gamma delta #### " + "w" * 100 + " omega psi chi phi upsilon " + "w" * 50
    out = M.two_pass_anchors(docs(spark, text), entries, lambda s: F.regexp_count(s, F.lit("#")) / F.length(s), 0.04, 0.9)
    hits = out.first()["hits"]
    assert [(h["label"], h["method"]) for h in hits][-1] == (2, "first word")
    assert {h["label"] for h in hits} == {1, 2}


def letters(s):
    return "".join(s.split())


def plain_anchors(text, entries, threshold, least=0.04):
    """Hits of one text, place by place, with densities counted letter by letter."""
    stretches = []
    for i in range(0, len(text) - 80, 20):
        dense = text[i : i + 80].count("#") / 80
        if dense >= least:
            if stretches and i <= stretches[-1][1] + 20:
                stretches[-1][1:] = [max(stretches[-1][1], i + 80), max(stretches[-1][2], dense)]
            else:
                stretches.append([i, i + 80, dense])
    spans = []
    for a, b, dense in stretches:
        if b - a > 200:
            spans += [(x, min(x + 150, len(text)), dense, "subscan") for x in range(a, b - 60, 40)]
        else:
            spans.append((max(0, a - 20), min(len(text), b + 40), dense, "stretch"))
    heads = {t.split()[0]: label for label, t in entries if t.split()}
    score = {label: (lambda piece, t=t: M.partial_ratio(letters(piece), letters(t))) for label, t in entries}
    hits = {}
    for a, b, dense, method in spans:
        own = [heads[w] for w in text[a:b].split()[:3] if w in heads and score[heads[w]](text[a:b]) >= threshold]
        best = own[0] if own else max(score, key=lambda label: (score[label](text[a:b]), -label))
        if score[best](text[a:b]) >= threshold:
            s = score[best](text[a:b])
            hits.setdefault(best, (best, a, b, s, dense, min(1.0, 0.7 * s + 0.3 * dense), method))
    for m in re.finditer(r"\S+", text):
        label = heads.get(m.group())
        piece = text[m.start() : m.start() + 150]
        if label is not None and score[label](piece) >= threshold:
            s = score[label](piece)
            hits.setdefault(label, (label, m.start(), m.start() + len(piece), s, 0.0, min(1.0, 0.6 * s + 0.2), "first word"))
    return sorted(hits.values(), key=lambda h: (h[1], h[0]))


@pytest.mark.parametrize("slice_chars", [1_000_000, 30])
def test_two_pass_anchors_place_by_place(spark, monkeypatch, slice_chars):
    monkeypatch.setattr(M.entry_slices, "__defaults__", (slice_chars,))
    draw = random.Random(4)
    words = ["ka", "ba", "éla", "mo", "ta#", "##", "su", "ri"]
    entries = [(k, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30)))) for k in range(1, 9)]
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(0, 250))) for _ in range(12)] + ["", " \n", None]
    texts += [texts[0] + " " + entries[2][1] + " " + texts[1]]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    catalogue = spark.createDataFrame(entries, "label int, text string")
    out = M.two_pass_anchors(rows, catalogue, lambda s: F.regexp_count(s, F.lit("#")) / F.length(s), 0.04, 0.8)
    got = {r["doc_id"]: [tuple(h) for h in r["hits"]] for r in out.collect()}
    for i, text in enumerate(texts):
        want = plain_anchors(text or "", entries, 0.8)
        assert [(*h[:3], h[6]) for h in got[i]] == [(*h[:3], h[6]) for h in want]
        assert [h[3:6] for h in got[i]] == [pytest.approx(h[3:6]) for h in want]


def test_ratios_are_those_of_single_pairs():
    draw = random.Random(2)
    some = lambda n: ["".join(draw.choice("abcé ") for _ in range(draw.randint(0, 40))) for _ in range(n)]
    texts, entries = some(50), [*some(30), "abc" * 60]
    want = [[M.partial_ratio(t, e) for e in entries] for t in texts]
    assert ratios(texts, entries) == pytest.approx(np.array(want))
    assert ratios_of_pairs(texts[:31], entries) == pytest.approx(np.array([want[i][i] for i in range(31)]))
    assert ratios([], entries).shape == (0, 31) and ratios(texts, []).shape == (50, 0)


def test_matrix_takes_the_column_of_the_language(spark):
    catalogue = spark.createDataFrame([(1, "alpha beta", "ALFA"), (2, None, "om ega")], "label int, en string, fr string")
    items = spark.createDataFrame([(0, "the alpha beta", "en"), (1, "om ega", "fr"), (2, "alpha", None), (3, None, "en")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["string"] for r in M.fuzzy_matrix(items, catalogue, by="lang", names=["en", "fr"], spelling=lambda s: F.regexp_replace(s, " ", "")).collect()}
    assert got[0] == [1.0, 0.0] and got[1][1] == 1.0 and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]


@pytest.mark.parametrize("usual", [10_000, 0])
def test_pairs_of_a_batch_are_scored_together(monkeypatch, usual):
    monkeypatch.setattr(M, "USUAL_CHARS", usual)
    calls = []
    plain = M.ratios_of_pairs
    monkeypatch.setattr(M, "ratios_of_pairs", lambda a, b: (calls.append(len(a)), plain(a, b))[1])
    rnd = random.Random(8)
    entries = [(i, "".join(rnd.choices("abcd", k=30))) for i in range(6)]
    texts = ["".join(rnd.choices("abcd", k=n)) for n in (12, 30, 75)] + [entries[2][1], "", None, "zz" + entries[4][1]]
    got = M.Scorer(entries, 0.6).scored(texts)
    for text, found in zip(texts, got, strict=True):
        every = {label: M.partial_ratio(entry, text) for label, entry in entries} if text else {}
        assert dict(found) == pytest.approx({label: v for label, v in every.items() if v >= 0.6})
    assert len(calls) == (1 if usual else 0)


def test_functions_with_large_results_get_few_rows_at_a_time(spark):
    seen = batch_udf("int", rows=3)(lambda s: s.map(lambda _: len(s)))
    both = batch_udf("array<int>", rows=4)(lambda a, b: pd.Series([[x, y, len(a)] for x, y in zip(a, b, strict=True)]))
    got = spark.range(10, numPartitions=1).select("id", seen("id").alias("n"), both("id", F.col("id") * 2).alias("b")).collect()
    assert [r["id"] for r in got] == list(range(10)) and [r["n"] for r in got] == [3] * 9 + [1]
    assert [r["b"] for r in got] == [[i, 2 * i, 4 if i < 8 else 2] for i in range(10)]
    assert spark.range(0).select(seen("id")).collect() == []


def test_ratios_from_a_threshold_score_few_pairs(monkeypatch):
    import random

    from passages.functions import likeness

    rnd = random.Random(7)
    sizes = [0, 1, 7, 8, 9, 30, 62, 63, 64, 65, 100, 126, 127, 130, 200]
    made = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.choice(sizes)))
    for letters in ("ab", "abcdé", "abcdefghijklmnopqrst漢"):
        entries = [made(letters) for _ in range(30)]
        texts = [made(letters) for _ in range(30)] + ["x".join(e.split("a")) for e in entries] + ["".join(c for c in e if rnd.random() < 0.8) for e in entries]
        want = ratios(texts, entries)
        for threshold in (0.05, 0.4, 0.55, 0.8, 1.0):
            got = likeness.ratios_from(texts, entries, threshold)
            assert (np.where(got >= threshold, got, 0) == np.where(want >= threshold, want, 0)).all()
    assert likeness.ratios_from([], entries, 0.5).shape == (0, 30) and likeness.ratios_from(texts, [], 0.5).shape == (90, 0)
    scored = []
    plain = likeness._strands
    monkeypatch.setattr(likeness, "_strands", lambda a, b: (scored.append(np.broadcast_shapes(a.shape[1:], b.shape[1:])), plain(a, b))[1])
    letters = "abcdefghijklmnopqrst"
    entries = ["".join(rnd.choice(letters) for _ in range(150)) for _ in range(40)]
    pieces = [entries[0][10:140], *("".join(rnd.choice(letters) for _ in range(120)) for _ in range(99))]
    best = M._best_entry(entries, list(range(40)), {}, 0.55).func(pd.Series([[]] * 100), pd.Series(pieces))
    assert best["label"].dropna().tolist() == [0] and best["worse"][0] == -1.0
    assert 1 <= sum(int(np.prod(s)) for s in scored) <= 400  # of 4,000 pairs


@pytest.mark.parametrize("settings", [{}, {"STATES": 400, "LETTERS": 2_000, "SIDE_BY_SIDE": 7}, {"SHARES": (2,), "TRIED": 4}, {"SHARES": (9,), "TRIED": 4, "FEW": 0}, {"USUAL": 0.1}])
def test_pairs_that_reach_a_threshold_are_all_met(monkeypatch, settings):
    from passages.functions import likeness

    for name, value in settings.items():
        monkeypatch.setattr(likeness, name, value)
    rnd = random.Random(11)
    sizes = [1, 2, 5, 62, 63, 64, 65, 90, 126, 127, 128, 129, 190, 191, 300]
    letters = "abcdefgh é"
    entries = ["".join(rnd.choices(letters, k=n)) for n in sizes * 2] + ["", "aaaa" * 20]
    texts = ["".join(rnd.choices(letters, k=n)) for n in sizes] + ["", "zzz"]
    for e in entries[:30]:
        cut = rnd.randrange(len(e) + 1)
        worse = "".join("漢" if rnd.random() < 0.25 else c for c in e)
        texts += [worse, "".join(rnd.choices(letters, k=rnd.randrange(150))) + worse + "x" * rnd.randrange(40), worse[cut:] + "yx" * 40, "yx" * 40 + worse[:cut]]
    want = ratios(texts, entries)
    for threshold in (0.3, 0.55, 0.65, 0.9):
        met = set(zip(*(x.tolist() for x in likeness.may_reach(texts, entries, threshold)), strict=True))
        assert {(i, j) for i, j in zip(*np.nonzero(want >= threshold), strict=True) if texts[i]} <= met
    assert 0 < len(met) < 0.2 * want.size
    assert [len(x) for x in likeness.may_reach(texts, entries, 0.0)] == [(len(texts) - 1) * (len(entries) - 1)] * 2


def test_texts_of_a_batch_are_bounded_together_and_spread_over_tasks(spark, monkeypatch):
    from passages.functions import likeness

    steps = []
    plain = likeness._step
    monkeypatch.setattr(likeness, "_step", lambda s, u, x: (steps.append(s.size), plain(s, u, x)))
    rnd = random.Random(12)
    entries = [(i, "".join(rnd.choices("abcdefghijklmnopqrst ", k=150))) for i in range(20)]
    texts = ["".join(rnd.choices("abcdefghijklmnopqrst ", k=400)) for _ in range(400)]
    texts[7] = texts[7][:200] + entries[3][1] + texts[7][200:]
    found = M.Scorer(entries, 0.65).scored(texts)
    assert [(k, f) for k, f in enumerate(found) if f] == [(7, [(3, 1.0)])]
    assert sum(steps) > 1_000 * len(steps)  # many pairs move on at once
    items = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    out = M.fuzzy_candidates(items, spark.createDataFrame(entries, "label int, text string"), "doc_id", 0.65)
    assert [tuple(r) for r in out.collect()] == [(7, 3, 1.0)]
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()


def test_few_windows_of_entries_are_looked_at_by_themselves(monkeypatch):
    from passages.functions import likeness

    listed = []
    plain = likeness._in_cells
    monkeypatch.setattr(likeness, "_in_cells", lambda masks, short, *rest: (listed.append(len(short)), plain(masks, short, *rest))[1])
    rnd = random.Random(13)
    made = lambda n: "".join(rnd.choices("eationsrhldcu", range(26, 0, -2), k=n))
    entries, pieces = [made(rnd.randint(140, 300)) for _ in range(40)], [made(125) for _ in range(300)]
    pieces[5] = entries[7][-125:]
    found = likeness.ratios_from(pieces, entries, 0.54)
    assert found[5, 7] == 1.0 and (found >= 0.54).sum() == (ratios(pieces, entries) >= 0.54).sum()
    assert sum(listed) < 0.5 * found.size


def test_places_in_texts_leave_a_few_texts_at_a_time(spark, monkeypatch):
    asked = []
    plain = T.batch_udf
    monkeypatch.setattr(T, "batch_udf", lambda kind, rows=None: (asked.append(rows), plain(kind, rows))[1])
    texts = ["ab cd " * (i % 4) for i in range(450)] + [None]
    got = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1).select("doc_id", T.positions(F.col("text"), r"\S+").alias("p")).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["p"]] for r in got} == {i: [(m.start(), m.end(), m.group()) for m in re.finditer(r"\S+", t or "")] for i, t in enumerate(texts)}
    assert len(asked) == 1 and asked[0] <= 1_000  # a batch of 10,000 long texts has millions of places
