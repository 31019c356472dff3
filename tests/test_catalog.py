"""Registered queries next to their SQL on the smallest tables (all of them: tools/check.py)."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check import TABLES, compare

CHECKED = [
    "subject_agreement", "reg_metrics", "auc_exact", "threshold_metrics", "covariate_join", "masked_update", "box", "fallback_lookup",
    "label_shuffle_within", "strat_group_fold", "impute_fold", "windows3", "pmi_vocab", "tfidf", "product_ensemble", "paired_t", "device_vs_model", "oof_linear",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, sf, con, name):
    ok, note, _ = compare(spark, con, name, queries()[name], oracle_sql()[name], sf)
    assert ok, note


def test_entry_and_registry(spark):
    assert entry(spark).columns[:2] == ["Model", "Label"]
    assert set(oracle_sql()) <= set(queries())
