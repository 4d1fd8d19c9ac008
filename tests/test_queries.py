"""The registered queries: names, flagship, and a cross-section compared with DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

SAMPLE = (
    "coverage_end_to_end", "explicit_refs", "mentions", "word_windows", "carry_gate_drop", "leftover_view", "survival_curve",
    "transition_matrix_resume", "viterbi", "profile_sums_stop", "cos_z_gain", "latest_view", "prf_near", "paired_bootstrap",
    "auc_ap", "keep_rule_cv", "bm25", "answer", "training_pairs", "stream_carry", "stream_gold", "validate",
)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "source", "segments", "items", "chars"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_same_result_as_sql(spark, duck, sf, name):
    df = entry.queries()[name](spark, sf)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(entry.oracle_sql()[name])
    assert got == canonical([c[0] for c in cur.description], cur.fetchall())
