"""Every registered query against its SQL twin, and a look at every plan.

By default a sample of queries runs; ``CORPUSGAUGE_FULL=1`` takes all of them
(``tools/check_queries.py`` does the same with a report).
"""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import TABLES, canonical

FULL = os.environ.get("CORPUSGAUGE_FULL") == "1"
QUERIES, SQL = queries(), oracle_sql()
# one or two per family
SAMPLE = [
    "a7_class_folders", "b1_basic_tokens", "b6_drop_dictionary", "b18_stratified_split", "c1_reports_side_by_side",
    "c3_drop_conflicting_texts", "d1_row_duplicates", "d3_conflict_examples", "d9_describe_text", "e3_compare_discrete",
    "e8_box_by_class", "e11_year_buckets", "f2_oov_rates", "f9_class_bigrams", "g4_pair_datetime", "h2_overall",
    "h7_metrics_by_quantile_bin", "h8_threshold_curve", "h15_small_classes_merged", "h17_class_without_share", "h5_categories_per_dataset", "i3_hash_tree", "j1_tfidf_terms",
    "j7_top_classes", "k1_normalise_label", "k8_similarity_gate", "k8_nearest_vector", "k8_covariance_gate", "k9_near_copies", "k10_closest_word",
    "a4_compare_report_files", "e7_density_curve",
]
NAMES = list(QUERIES) if FULL else SAMPLE
# the hook for user functions, names looked up in the row, pooled blocks
PYTHON_ALLOWED = {"b16_batches", "b6_drop_dictionary", "j6_isotonic_calibration"}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create table {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if name not in PYTHON_ALLOWED:
        assert "InPandas" not in plan and "EvalPython" not in plan
    got = df.toPandas()
    assert got.columns.is_unique
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() == 3
