"""Operators on single texts, against brute force, round trips or held-out labels, with the awkward rows."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from passages.llm import language, pieces, quality, token_counts, toxicity, vocabulary, warc
from passages.llm.scoring_queries import MODEL

ODD = [(1, None), (2, ""), (3, "  two  spaces "), (4, "123 !!"), (5, "▁x ▁"), (6, "日本語\n\n\t😀"), (7, "a" * 70_000), (7, "a" * 70_000)]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", i) for i, t in ODD], "doc_id long, text string, lang string, score long")


@pytest.fixture(scope="module")
def model():
    return vocabulary.read(MODEL)


def best(text, v):
    """Every segmentation by plain dynamic programming."""
    t = " " + text if text else ""
    rows = [(0, [])] + [None] * len(t)
    pieces_ = {v.text[i]: i for i in v.score}
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - v.longest), j):
            if t[i:j] in pieces_:
                k = pieces_[t[i:j]]
                if rows[j] is None or rows[i][0] + v.score[k] > rows[j][0]:
                    rows[j] = (rows[i][0] + v.score[k], rows[i][1] + [k])
        if t[j - 1] not in pieces_:
            ids = list(v.spelled(t[j - 1]))
            if rows[j] is None or rows[j - 1][0] + v.byte_score * len(ids) > rows[j][0]:
                rows[j] = (rows[j - 1][0] + v.byte_score * len(ids), rows[j - 1][1] + ids)
    return rows[-1][1]


@pytest.mark.parametrize("cuts", [True, False])
def test_stream_is_the_best_path(model, sf, spark, cuts):
    v = vocabulary.Vocabulary(model)
    v.cuts = cuts
    texts = [r[0][:1500] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(12).collect()]
    for t in [*texts, *(t[:900] for _, t in ODD if t)]:
        assert pieces.encode_text(t, v) == best(t, v)
        assert pieces.decode_ids(best(t, v), v) == t


def test_stream_commits_within_a_window(model):
    v = vocabulary.Vocabulary(model)
    stream, longest = pieces.Stream(v), 0
    for c in "the quick brown fox " * 200:
        list(stream.feed(c))
        longest = max(longest, len(stream.text))
    assert longest < 8 * v.longest


def test_encode_and_decode(spark, model):
    rows = pieces.decode(pieces.encode(odd(spark), model), model).collect()
    for r in rows:
        assert r["decoded"] == r["text"] and r["lossless"] == (None if r["text"] is None else True) and r["score"] == r["doc_id"]


def test_token_counts_are_the_lengths_of_encodings(spark, model, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd(spark).select("doc_id", "text"))
    coded = pieces.encode(token_counts.count_tokens(docs, model), model)
    assert coded.filter("NOT (n_tokens <=> CASE WHEN ids IS NOT NULL THEN size(ids) END)").count() == 0
    assert coded.filter("text IS NULL AND n_tokens IS NULL").count() == 1


def test_trie_with_a_small_memory(model, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 3)
    trie, v = token_counts.Trie(model), vocabulary.Vocabulary(model)
    for words in ([" the", " then", " theology", " x"], [" the", " ab", " a"], [" theology", " then", "q"]):
        trie.insert(words)
        assert [trie.counts[w] for w in words] == [len(best(w[1:], v)) if w[0] == " " else len(best(w, v)) - 1 for w in words][: len(words)] or words[-1] == "q"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, last = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(last[j] + (x != y), last[j + 1] + 1, row[j] + 1))
    return row[-1]


@pytest.mark.parametrize("distance", [0, 1, 2])
def test_automaton_is_the_edit_distance(distance):
    rnd = np.random.default_rng(distance)
    terms = ["idiot", "trash", "loser", "trace"]
    words = ["".join(rnd.choice(list("idotrashlec"), rnd.integers(1, 8))) for _ in range(300)] + terms + ["idiots", "tras", "trahs", "xtrash", "losr"]
    table, ends = toxicity._automaton(terms, distance)
    data = np.frombuffer("".join(words).encode(), np.uint8)
    length = np.array([len(w) for w in words])
    got = toxicity.run_automaton(table, ends, data, np.r_[0, np.cumsum(length)[:-1]], length)
    for w, g in zip(words, got):
        near = min(edits(t, w) for t in terms)
        assert g == (near if near <= distance else -1), w


def test_context_separates_quotation_from_abuse():
    lexicon = toxicity.Lexicon({"moron": 5.0}, {"réeu": 4.0})
    texts = ["you moron", 'he said "moron" again', "a mor0n and a moroon", "RÉEUXMENT ici", None, "", "“moron”", "x" * 50]
    x = np.round(np.expm1(toxicity.features(pa.array(texts), lexicon)[:, :9])).astype(int)
    assert x[0].tolist() == [1, 0, 1, 0, 0, 0, 0, 0, 0] and x[1].tolist() == [0, 1, 0, 0, 0, 0, 0, 0, 0]
    assert x[2][3] == 1 and x[3][6] == 1 and not x[4].any() and not x[5].any() and x[6][1] == 1 and not x[7].any()


def test_toxicity_of_odd_rows(spark):
    model = toxicity.train(odd(spark), spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, label int"))
    rows = toxicity.score(odd(spark), model).collect()
    assert len(rows) == len(ODD) and {r["score"] for r in rows} == {0.0}


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    r = rows.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("found"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("wrong")).first()
    assert r["found"] > 0.8 and r["wrong"] < 0.02


def test_held_out_language(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["op7_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").filter("held_out")
    assert rows.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_language_of_odd_rows(spark, sf):
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 60"), per_language=20)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd(spark), model).collect()}
    assert [got[k][0] == "und" for k in (1, 2, 4, 7)] == [True, True, True, False] and got[4][1] == 0.0
    assert language.train(odd(spark).limit(0)) is None
    assert {r["lang_pred"] for r in language.identify(odd(spark), None).collect()} == {"und"}


def test_windows_cover_whole_texts():
    x, row = language.windows_of([b"", b"AbC" * 100, b"z" * 512])
    assert row.tolist() == [0, 1, 1, 2, 2] and bytes(x[1:3].reshape(-1)).rstrip(b"\0") == b"abc" * 100


def test_site_posteriors_shrink(spark):
    rows = [(f"h{h}", f"h{h}/p{p}", int(h < 5)) for h in range(10) for p in range(2) for _ in range(40)] + [("one", "one/x", 0), (None, None, 1)]
    prior, hosts, paths = quality.site_posteriors(spark.createDataFrame(rows, "s string, p string, label int"), "s", "p")
    got = {r["s"]: r["host_posterior"] for r in hosts.collect()}
    assert got["h0"] > 0.9 and got["h9"] < 0.1 and 0 < got["one"] < prior and prior < got[None] < 1
    assert paths.count() == 22


def test_quality_of_odd_rows(spark):
    known = spark.createDataFrame([("en", None, 1)], "lang string, path string, label int")
    docs = odd(spark).withColumn("path", F.lit(None).cast("string"))
    rows = quality.score(docs, known, None, "lang", "path").collect()
    assert len(rows) == len(ODD) and all(0 < r["score"] < 1 for r in rows)


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    rows = entry.queries()["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter(language.held_out(F.col("doc_id"), 4, 2))
    assert rows.agg(F.avg((F.col("keep").cast("int") == F.col("quality")).cast("int"))).first()[0] > 0.97


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><a href="/x?a=1&amp;b=2">Go <b>there</b></a></nav><!-- <p>gone</p> --><p>One<br>two  three</p><img src='i.png'></body></html>"""


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://h/é", PAGE), (2, None, None), (3, "u", "")], "page_id long, url string, html string")
    made = warc.responses(pages)
    rows = {(r["page_id"], r["kind"]): r for r in warc.derivatives(made).collect()}
    assert len(rows) == 6
    source = {r["page_id"]: next(warc.records(bytes(r["record"]))) for r in made.collect()}
    text, meta = rows[1, "conversion"], json.loads(rows[1, "metadata"]["text"])
    assert text["text"] == "Go there\nOne\ntwo three" and meta["html"]["title"] == "A & B"
    assert meta["html"]["links"] == [{"path": "A@/href", "text": "Go there", "url": "/x?a=1&b=2"}, {"path": "IMG@/src", "url": "i.png"}]
    for r in rows.values():
        headers, block = next(warc.records(bytes(r["record"])))
        assert headers["WARC-Refers-To"] == source[r["page_id"]][0]["WARC-Record-ID"] == r["refers_to"]
        assert headers["WARC-Block-Digest"] == warc.digest(block) and r["source_digest"] == source[r["page_id"]][0]["WARC-Payload-Digest"]
    assert json.loads(rows[3, "metadata"]["text"])["source"]["WARC-Target-URI"] == "u"
    again = spark.createDataFrame([(1, None), (2, b"WARC/1.0\r\nContent-Length: 9\r\n\r\nx"), (3, bytes(rows[1, "metadata"]["record"]))], "page_id long, record binary")
    assert warc.derivatives(again).collect() == []


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", PAGE) for i in range(4)], "page_id long, url string, html string")
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r["record"]) for r in warc.responses(pages).collect()))
    assert warc.derivatives(warc.read_warc(spark, str(tmp_path)), "path").count() == 8


def test_lexicon_is_learned_from_all_labels(spark):
    """One term in 0.6 % of the toxic texts, and 450 terms in six texts each, with weights from a small sample."""
    draw = np.random.default_rng(4)
    many = sorted({"".join(draw.choice(list("bcdfghjklmnpqrstvwz"), 7)) for _ in range(450)})
    texts = [("you idiot" + (" zorgleflux" if i < 6 else "") + (" " + " ".join(many) if i < 6 else ""), 1) for i in range(1000)] + [("you fine day", 0)] * 1000
    rows = [(i, t, y) for i, (t, y) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "label"), sample=200)
    assert {"idiot", "zorgleflux", *many} <= set(model.lexicon.words)
    assert model.score(pa.array(["you zorgleflux", "you fine"])).round().tolist() == [1, 0]


def test_quality_posteriors_know_every_label(spark, tmp_path):
    """A site whose only labels have ids that used to be held out."""
    held = [r["i"] for r in spark.range(2000).withColumnRenamed("id", "i").filter(language.held_out(F.col("i"), 4, 2)).limit(20).collect()]
    rows = [(i, f"text of number {i}", "rare" if i in held else f"s{i % 2}", "en", int(i in held or i % 2 == 0)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    docs.drop("quality").write.parquet(str(tmp_path / "documents.parquet"))
    docs.select("doc_id", "quality").write.parquet(str(tmp_path / "labels.parquet"))
    got = {r["doc_id"]: r["host_posterior"] for r in entry.queries()["op6_quality"](spark, str(tmp_path)).collect()}
    share = sum(r[4] for r in rows) / len(rows)
    assert len(got) == 120 and got[held[0]] > (1 + share) / 2 and got[1 if 1 not in held else 3] < share


def test_quality_of_texts_without_their_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("path"))
    every = spark.read.parquet(f"{sf}/labels.parquet").filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("label"))
    held = language.held_out(F.col("doc_id"), 4, 2)
    labels = every.filter(~held)
    known = docs.select("doc_id", "source", "path").join(labels, "doc_id")
    rows = quality.score(docs.filter(held), known, quality.train(docs, labels), "source", "path").join(every, "doc_id")
    assert rows.agg(F.avg((F.col("keep").cast("int") == F.col("label")).cast("int"))).first()[0] > 0.97


@pytest.mark.parametrize(
    "page, title, text, urls",
    [
        ('if a < b then <a href="/x">y</a>', "", "if a < b then y", ["/x"]),
        ("I <3 you<br>1<2, 2 <= 3 <", "", "I <3 you\n1<2, 2 <= 3 <", []),
        ("""<a title="a > b" href="/y">z</a><img alt='>' src=i.png>end""", "", "zend", ["/y", "i.png"]),
        ("""<a data-1="href='no'" href="/yes">it's</a><p title=it's>one's</p>""", "", "it's\none's", ["/yes"]),
        ("""<script data-a="x>y">var a = "<p>";</script>seen <!--> this <!-- not --!> too""", "", "seen this too", []),
        ("<!DOCTYPE html><title>T &amp; U<body>seen <b>all</b><p>more", "T & U", "seen all\nmore", []),
        ("<head><title>T<h1>Head</h1>rest", "T", "Head\nrest", []),
        ("<title>T</head>seen", "T", "seen", []),
        ("<?xml version='1.0'?></ >a<a href='/x", "", "a<a href='/x", []),
    ],
)
def test_visible_text_of_rough_pages(page, title, text, urls):
    got = warc.visible(page)
    assert (got[0], got[1], [x["url"] for x in got[2]]) == (title, text, urls)


def test_rough_pages_stay_linear():
    page = "<a b='" + "=\"x\" " * 20_000
    assert warc.visible(page)[2] == []
