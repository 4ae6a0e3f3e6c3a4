"""Every query with SQL against DuckDB on the smallest tables; every other one runs and gives rows of a stable schema."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from assayline.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"
#: Workflows of many fits: they run on cut tables.
SLOW = {"h11_false_positives", "k5_external_row", "k8_locked_test_grid", "k13_ablation_rows", "k14_fold_scores", "e2_cluster_ungrouped", "e11_random_vs_group_split", "h10_sampling_grid", "h11_imbalance_study", "i9_scenario_comparison", "k7_scenario_selection", "k9_learning_curve", "k10_leave_source_out_eval", "k12_nested_cv", "k13_ablation_study", "j1_fit_score_gbt", "j1_fit_score_rf", "j1_fit_score_ann", "h5_kmeans_medoid_sample", "h12_sampling_cv_eval", "j2_random_search", "k6_fn_augmentation"}


def plain(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return f"{x:.9g}"
    return str(x)


def rows(df: pd.DataFrame, cols: list[str]) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def cut_tables(tmp_path_factory):
    """The smallest tables with labelled documents alone, and the first words of these."""
    folder = tmp_path_factory.mktemp("cut")
    for t in TABLES:
        df = pd.read_parquet(f"{SF}/{t}.parquet")
        if t == "documents":
            df = df[df["doc_id"].isin(pd.read_parquet(f"{SF}/labels.parquet")["doc_id"])]
            df["text"] = df["text"].str.slice(0, 300)
        df.to_parquet(f"{folder}/{t}.parquet", index=False)
    return f"file://{folder}"


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_runs(spark, cut_tables, name):
    assert len(QUERIES[name](spark, cut_tables).collect()) >= (name != "h11_false_positives")


def test_entry(spark):
    assert entry.entry(spark).agg({"group_overlap": "max"}).first()[0] == 0
