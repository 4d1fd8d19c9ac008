"""Registered queries run their operators whole: no fewer rounds, draws or values, and no stricter limits, than these have."""

import time

import pytest

import __spark_entry__ as entry
from passages.plans import learning_queries, retrieval_queries


def asked(monkeypatch, spark, sf, module, operator, query, made):
    calls = []

    def spy(*args, **options):
        calls.append((args, options))
        return made

    monkeypatch.setattr(module, operator, spy)
    entry.queries()[query](spark, sf)
    return calls[0]


def test_reliability_runs_until_it_converges(monkeypatch, spark, sf):
    args, options = asked(monkeypatch, spark, sf, learning_queries.L, "annotator_reliability", "annotator_reliability", ([0.25] * 4, [0.5] * 2, 1))
    assert len(args) == 3 and not options


def test_two_pass_anchors_keep_the_limits_of_the_operator(monkeypatch, spark, sf):
    kind = "array<struct<label:int,start:int,end:int,score:double,confidence:double,method:string>>"
    made = spark.createDataFrame([], f"doc_id long, hits {kind}")
    args, options = asked(monkeypatch, spark, sf, retrieval_queries.M, "two_pass_anchors", "two_pass_anchors", made)
    assert len(args) == 3 and not options


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """The smallest tables with fewer documents and events, so that whole queries end soon."""
    folder = tmp_path_factory.mktemp("small")
    for name, rows in (("documents", 25), ("benchmark", 100), ("events", 400)):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        table.orderBy(table.columns[0]).limit(rows).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize(
    ("query", "rows"), [("two_pass_anchors", None), ("choose_c", 6), ("learning_curve", 15), ("leave_one_group_out", 400), ("stacker", 400), ("ablation", 3)]
)
def test_queries_end(spark, small, query, rows):
    start = time.monotonic()
    found = entry.queries()[query](spark, small).collect()
    assert time.monotonic() - start < 120 and found and (rows is None or len(found) == rows)


def test_all_values_of_c_and_all_draws(monkeypatch, spark, sf):
    args, _ = asked(monkeypatch, spark, sf, learning_queries.L, "choose_c", "choose_c", (1.0, spark.createDataFrame([], "c double, loss double")))
    assert args[4] == [1e-5, 1e-4, 1e-3, 1e-2, 0.1, 1.0]
    args, _ = asked(monkeypatch, spark, sf, learning_queries.L, "learning_curve", "learning_curve", spark.createDataFrame([], "n_groups int, draw int, auc double"))
    assert args[5][-1] == 20 and args[6] == 3
