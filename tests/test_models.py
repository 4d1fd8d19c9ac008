"""Fitted models, settings and the remaining operators without SQL, on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from passages.operators import chunk as C
from passages.operators import decode as D
from passages.operators import evaluate as E
from passages.operators import learn as L
from passages.operators import retrieve as R
from passages.operators import sequence as S
from passages.operators.scan import ordinal
from passages.sources import tables
from passages.streaming import streams as K


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(0)
    data = [(i, i % 3, rnd.gauss(0, 1), rnd.gauss(2, 3)) for i in range(120)]
    data = [(i, g, a, b, int(a + 0.2 * b + rnd.gauss(0, 1) > 0.4), 0.2 + 0.6 * rnd.random()) for i, g, a, b in data]
    return spark.createDataFrame(data, "unit long, fold int, a double, b double, y int, p double")


def test_left_out_groups_are_scored_by_the_others(rows):
    out = L.leave_one_group_out(rows.drop("p"), "fold", ["a", "b"]).filter("fold = 1")
    model = L.fit_scorer(rows.filter("fold <> 1"), ["a", "b"])
    want = rows.filter("fold = 1").select("unit", model.probability().alias("q"))
    assert out.join(want, "unit").filter(F.abs(F.col("p") - F.col("q")) > 1e-6).count() == 0
    assert out.count() == 40


def test_hard_soft_labels_are_an_ordinary_fit(rows):
    hard = rows.withColumn("p", F.col("y").cast("double"))
    a, b = L.soft_label_fit(hard, ["a", "b"]), L.fit_scorer(rows, ["a", "b"])
    assert [*a.weight, a.intercept] == pytest.approx([*b.weight, b.intercept], abs=1e-4)


def test_choose_c_takes_the_lowest_loss(rows):
    best, table = L.choose_c(rows, ["a", "b"], "p", "fold", [0.001, 1.0])
    losses = {r["c"]: r["loss"] for r in table.collect()}
    assert losses[best] == min(losses.values())


def sequences(spark):
    rnd = random.Random(1)
    data = []
    for s in range(6):
        state = rnd.randrange(4)
        for p in range(12):
            state = state if rnd.random() < 0.7 else rnd.randrange(4)
            probs = [0.05 + 0.3 * rnd.random() + (0.5 if v == state else 0) for v in range(3)]
            gold = [state] if state < 3 else []
            data.append((s, p, s % 2, probs, 0.7 if state == 3 else 0.1 + 0.2 * rnd.random(), gold))
    return spark.createDataFrame(data, "seq long, pos long, language int, probs array<double>, p_off double, gold array<int>")


def model_of(df):
    counts = S.transition_counts(df.withColumn("state", S.state_of("gold", 3)), 3)
    return D.Model.plain(D.matrix_of(S.transition_matrix(counts, 3), 4))


def test_grid_scores_each_setting_as_decoding_does(spark):
    df = sequences(spark)
    model = model_of(df)
    table, best = L.grid_choose(df, model, 3, [0.5, 1.0], [-1.0, 0.0], [0.5, 1.01])
    found = {(r["gamma"], r["beta"], r["tau"]): r["macro_f1"] for r in table.collect()}
    assert len(found) == 8 and best.first()["macro_f1"] == pytest.approx(max(found.values()))
    out = D.decode(df, model, "probs", "p_off", 3, tau=0.5, beta=-1.0, gamma=0.5)
    pred = F.when(F.col("state") == 3, S.none_of()).otherwise(F.concat(F.array("state"), "extra"))
    per = E.prf(out.withColumn("pred", pred), ["language"]).collect()
    assert found[0.5, -1.0, 0.5] == pytest.approx(sum(r["f1"] for r in per) / 2)


def test_decoded_probability_is_that_of_the_state(spark):
    df = sequences(spark)
    for r in D.decode(df, model_of(df), "probs", "p_off", 3).collect():
        on = (1 - r["p_off"]) * r["probs"][r["state"]] / sum(r["probs"]) if r["state"] < 3 else r["p_off"]
        assert r["p_state"] == pytest.approx(on)


def test_a_faithful_annotator_is_found_reliable(spark):
    df = sequences(spark).withColumn("labels", F.col("gold"))
    p_on, p_off, rounds = L.annotator_reliability(df.select("seq", "pos", "labels"), model_of(df).log_a, 3, rounds=5)
    assert sum(p_on) == pytest.approx(1) and sum(p_off) == pytest.approx(1)
    assert p_on[0] == max(p_on) and p_off[0] > 0.5 and 2 <= rounds <= 5


def reliability(data, log_a, n, rounds):
    """The shares after so many rounds, from {sequence: lists of labels}, item by item."""
    start = lambda labels: np.eye(n + 1)[n if not labels else min(labels)]
    post = {s: [start(x) for x in items] for s, items in data.items()}
    bucket = lambda x, v: 3 if x == [] else 2 if x is None else 0 if v in x else 1 if v - 1 in x or v + 1 in x else 2
    for r in range(rounds):
        if r:
            logs = []
            for v in range(n):
                sides = (v > 0) + (v < n - 1)
                logs.append([np.log(p / k) if k else np.nan for p, k in zip(on, [1, sides, n - 1 - sides, 1], strict=True)])
            for s, items in data.items():
                e = np.array([[logs[v][bucket(x, v)] for v in range(n)] + [np.log(off[0]) if x == [] else np.log(off[1] / n)] for x in items])
                a, w = np.exp(log_a), np.exp(e)
                f, b = [w[0] / (n + 1)], [np.ones(n + 1)]
                for t in range(1, len(items)):
                    f.append(f[-1] @ a * w[t])
                    b.insert(0, a @ (w[-t] * b[0]))
                post[s] = [x * y / (x @ y) for x, y in zip(f, b, strict=True)]
        on, off = np.ones(4), np.ones(2)
        for s, items in data.items():
            for x, p in zip(items, post[s], strict=True):
                for v in range(n):
                    on[bucket(x, v)] += p[v]
                if x is not None:
                    off[int(len(x) > 0)] += p[n]
        on, off = on / on.sum(), off / off.sum()
    return on, off


@pytest.mark.parametrize("block", [5, 100])
def test_annotators_are_summed_up_from_packs(spark, monkeypatch, block):
    rnd = random.Random(5)
    kinds = [[], [0], [1], [3], [0, 2], [3, 1], None]
    data = {s: [rnd.choice(kinds) for _ in range(n)] for s, n in enumerate([1, 3, 4, 4, 9, 14, 2, 1])}
    df = spark.createDataFrame([(s, p, x) for s, items in data.items() for p, x in enumerate(items)], "seq long, pos long, labels array<int>")
    log_a = np.log(np.random.default_rng(1).dirichlet(np.ones(5), 5))
    asked = []
    plain = D.forward_backward
    monkeypatch.setattr(D, "forward_backward", lambda rows, *a, **k: (asked.append(rows.columns), plain(rows, *a, **k))[1])
    p_on, p_off, _ = L.annotator_reliability(df, log_a, 4, rounds=4, tol=0.0, block_rows=block)
    on, off = reliability(data, log_a, 4, 4)
    assert [*p_on, *p_off] == pytest.approx([*on, *off], abs=1e-9)
    assert asked.count(["sizes", "codes", "kinds"]) == 3 and len(asked) == (6 if block == 5 else 3)


def test_segments_are_packed_with_their_times(spark):
    segments = [(float(i), i + 0.5, " " if i == 2 else " ".join(["w"] * 30)) for i in range(6)]
    df = spark.createDataFrame([(0, segments)], "doc_id long, segments array<struct<start:double,end:double,text:string>>")
    got = C.pack_segments(df, target=60).orderBy("pos").collect()
    assert [(r["time_start"], r["time_end"], r["n_words"]) for r in got] == [(0.0, 1.5, 60), (3.0, 4.5, 60), (5.0, 5.5, 30)]
    full = " ".join(s[2] for s in segments if s[2].strip())
    assert all(full[r["char_start"] : r["char_end"]] == r["text"] for r in got)


def test_closest_sentences(spark):
    embed = lambda s: F.when(F.contains(s, F.lit("cat")), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    texts = spark.createDataFrame([(1, 7, "A dog ran over the hill. The cat sat on the mat. No.")], "query int, item int, text string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query int, vector array<double>")
    got = R.extractive(texts, asked, embed, n=1).collect()
    assert [r["sentence"] for r in got] == ["The cat sat on the mat."]


def test_ingest_skips_what_it_has_seen(spark):
    source, out, state = (tables.scratch(spark, n) for n in ("src", "out", "state"))
    schema = "doc_id long, text string"
    catalogue = spark.createDataFrame([(4, "one two three four five six seven")], "label int, text string")
    for i, text in enumerate(["x one two three four five six seven y.", "nothing here at all."]):
        spark.createDataFrame([(i, text)], schema).coalesce(1).write.mode("append").parquet(source)
        K.stream_ingest(spark.readStream.schema(schema).parquet(source), catalogue, out, state)
    got = sorted((r["doc_id"], r["passage"], r["label"]) for r in spark.read.parquet(out).collect())
    assert got == [(0, "0-0", 4), (1, "1-0", None)]


def test_scores_of_a_scorer_are_probabilities(rows):
    model = L.platt(rows.withColumn("logit", F.ln(F.col("p") / (1 - F.col("p")))))
    assert len(model.weight) == 1 and np.isfinite(model.weight[0])


def test_rounds_on_an_annotator_do_not_shuffle_the_items_again(spark, monkeypatch):
    df = sequences(spark).withColumn("labels", F.col("gold")).select("seq", "pos", "labels")
    seen = []
    plain = D.forward_backward

    def watched(rows, *args, **options):
        out = plain(rows, *args, **options)
        seen.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(D, "forward_backward", watched)
    L.annotator_reliability(ordinal(df.withColumnRenamed("pos", "p"), ["seq"], ["p"]).drop("p"), model_of(sequences(spark)).log_a, 3, rounds=3)
    assert seen and not any("Exchange" in p or "Join" in p for p in seen)


def test_grid_takes_the_items_along_instead_of_joining_them(spark, monkeypatch):
    df = ordinal(sequences(spark).withColumnRenamed("pos", "p"), ["seq"], ["p"])
    plans = []
    plain = E.prf
    monkeypatch.setattr(E, "prf", lambda rows, *a, **k: (plans.append(rows._jdf.queryExecution().executedPlan().toString()), plain(rows, *a, **k))[1])
    table, _ = L.grid_choose(df, model_of(sequences(spark)), 3, [0.5, 1.0], [-1.0], [0.5])
    assert table.count() == 2 and len(plans) == 1 and "Join" not in plans[0]


def test_ingest_cuts_each_text_once(spark, tmp_path, monkeypatch):
    from passages.functions.batch import batch_udf

    made, cut = tmp_path / "made", K.C.pack_sentences

    def counted(docs, **options):
        @batch_udf("int")
        def note(words):
            with open(made, "a") as f:
                f.write("x" * len(words))
            return words

        return cut(docs, **options).withColumn("n_words", note("n_words"))

    monkeypatch.setattr(K.C, "pack_sentences", counted)
    docs = spark.createDataFrame([(i, f"One two three four five six {i}. Seven eight nine ten eleven {i}.") for i in range(30)], "doc_id long, text string")
    source, out, state = (str(tmp_path / n) for n in ("source", "out", "state"))
    docs.coalesce(1).write.parquet(source)
    catalogue = spark.createDataFrame([(7, "one two three four five six"), (8, "seven eight nine ten eleven 3")], "label int, text string")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    K.stream_ingest(spark.readStream.schema(docs.schema).parquet(source), catalogue, out, state)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 30 and sum(r["label"] == 7 for r in rows) == 30 - sum(r["label"] == 8 for r in rows)
    assert made.stat().st_size == 30
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
