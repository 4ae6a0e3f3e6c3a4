"""The rules of negative sampling, on both sides of where they change."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from assayline.operators import sampling

COLS = ["a", "b"]


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id long, label int, profile string, a double, b double")


def blobs(n_clusters, each, label=0, start=0, profile="x"):
    rng = random.Random(n_clusters)
    out = []
    for c in range(n_clusters):
        for _ in range(each):
            out.append((start + len(out), label, profile, 100.0 * (c % 9) + rng.random(), 100.0 * (c // 9) + rng.random()))
    return out


@pytest.mark.parametrize("n", [5, 49, 51, 80])
def test_as_many_clusters_as_rows_asked(spark, n):
    """Each of n well-parted blobs gives a row or, where seeds fell twice into one, nearly each; n rows always."""
    rows = blobs(n, 6)
    got = sampling.kmeans_medoid_sample(frame(spark, rows), COLS, n).collect()
    assert len(got) == n and len({r["record_id"] for r in got}) == n
    assert len({r["record_id"] // 6 for r in got}) >= 0.6 * n


def test_small_samples(spark):
    rows = frame(spark, blobs(2, 5))
    assert sampling.kmeans_medoid_sample(rows, COLS, 10).count() == 10 and sampling.kmeans_medoid_sample(rows, COLS, 11).count() == 10
    assert sampling.kmeans_medoid_sample(rows, COLS, 1).count() == 1 and sampling.kmeans_medoid_sample(rows, COLS, 0).count() == 0
    same = frame(spark, [(i, 0, "x", 1.0, 1.0) for i in range(30)])
    assert sampling.kmeans_medoid_sample(same, COLS, 7).count() == 7


def profiles(spark):
    """Positives: 6 of p, 3 of q, 1 of r; negatives: 40 of p, 2 of q, none of r, 30 of z."""
    pos = [(1000 + i, 1, p, float(i), 0.0) for i, p in enumerate("ppppppqqqr")]
    neg = [(i, 0, p, float(i % 7), float(i % 11)) for i, p in enumerate("p" * 40 + "qq" + "z" * 30)]
    return frame(spark, pos + neg)


def test_quotas_and_backfill(spark):
    df = profiles(spark)
    part = {r["profile"]: r["n"] for r in sampling.profile_draw(df, 20).groupBy("profile").agg(F.count("*").alias("n")).collect()}
    assert part == {"p": 12, "q": 2}  # round(0.6 * 20), and what there is of round(0.3 * 20)
    full = sampling.profile_stratified_sample(df, COLS, 20).collect()
    assert len(full) == 20 and len({r["record_id"] for r in full}) == 20 and all(r["label"] == 0 for r in full)
    assert [r["profile"] for r in full].count("q") == 2 and [r["profile"] for r in full].count("p") >= 12


def test_all_negatives_if_there_are_no_more(spark):
    df = profiles(spark)
    assert sampling.profile_stratified_sample(df, COLS, 72).count() == 72 and sampling.profile_stratified_sample(df, COLS, 100).count() == 72
    assert sampling.profile_stratified_sample(df, COLS, 71).count() == 71


def test_cut_at_n(spark):
    """Profiles of one positive each have a quota of 1; the sample is cut at n, by the profiles' names among equals."""
    pos = [(1000 + i, 1, f"p{i:02}", 0.0, 0.0) for i in range(30)]
    neg = [(i, 0, f"p{i % 30:02}", float(i), 0.0) for i in range(90)]
    got = sampling.profile_stratified_sample(frame(spark, pos + neg), COLS, 10).collect()
    assert sorted(r["profile"] for r in got) == [f"p{i:02}" for i in range(10)]


@pytest.mark.parametrize(("n", "w"), [(20, 0.5), (20, 0.0), (20, 1.0), (1, 0.5), (200, 0.5)])
def test_combined(spark, n, w):
    got = sampling.combined_sample(profiles(spark), COLS, n, w).collect()
    assert len(got) == len({r["record_id"] for r in got}) == min(n, 72)


def vectors(spark, n_pos, n_neg):
    return spark.createDataFrame([(i, [float(i), float(i % 3)], int(i < n_pos)) for i in range(n_pos + n_neg)], "record_id long, v array<double>, label int")


def test_resampling_falls_back(spark):
    """Too few rows for neighbours: as many of each class, drawn."""
    for pos, neg in ((2, 30), (5, 2)):
        got = sampling.near_miss(vectors(spark, pos, neg)).groupBy("label").count().collect()
        assert {r["label"]: r["count"] for r in got} == {0: min(pos, neg), 1: min(pos, neg)}
    got = sampling.smote_tomek(vectors(spark, 3, 20)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in got} == {0: 3, 1: 3}
    full = sampling.near_miss(vectors(spark, 6, 40)).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in full} == {0: 3, 1: 6}  # all positives have the same nearest negatives
