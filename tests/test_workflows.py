"""Workflows and what they are built of, against plain computations."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from assayline.operators import joins, labels, metrics, models, splits
from assayline.operators.clusters import ward
from assayline.plans import workflows as wf


def ward_brute(points, k):
    """The cheapest merge each time."""
    groups = [[i] for i in range(len(points))]
    x = np.array(points, float)
    mean, n = x.copy(), np.ones(len(x))
    alive = list(range(len(x)))
    while len(alive) > k:
        m, w = mean[alive], n[alive]
        cost = ((m[:, None] - m[None]) ** 2).sum(2) * w[:, None] * w[None] / (w[:, None] + w[None])
        np.fill_diagonal(cost, np.inf)
        i, j = divmod(int(cost.argmin()), len(alive))
        a, b = alive[i], alive[j]
        mean[a] = (mean[a] * n[a] + mean[b] * n[b]) / (n[a] + n[b])
        n[a] += n[b]
        groups[a] += groups[b]
        alive.remove(b)
    return {frozenset(groups[a]) for a in alive}


@pytest.mark.parametrize(("n", "k"), [(500, 20), (60, 2), (40, 40), (3, 1)])
def test_ward(n, k):
    rng = np.random.default_rng(n)
    points = rng.normal(size=(n, 3)) + rng.integers(0, 4, (n, 1)) * 3
    label = ward([1] * n, points.tolist(), k)
    got = {}
    for i, c in enumerate(label):
        got.setdefault(c, set()).add(i)
    assert {frozenset(g) for g in got.values()} == ward_brute(points, k) and label[0] == 0 and sorted(set(label)) == list(range(k))


def test_cluster_ungrouped(spark):
    """Pseudo-groups are those of brute-force Ward on the standardized rows; equal rows stay together; few rows stay as they are."""
    rng = random.Random(2)
    rows = [(i, "acyclic" if i % 4 else "cyclic", f"g{i}", float(rng.randint(0, 6)), rng.gauss(0, 1) if i % 3 else 0.5) for i in range(120)]
    df = spark.createDataFrame(rows, "record_id long, group_type string, group string, a double, b double")
    out = {r["record_id"]: r["group"] for r in wf.cluster_ungrouped(df, ["a", "b"], 8).collect()}
    free = [r for r in rows if r[1] == "acyclic"]
    x = np.array([r[3:] for r in free])
    x = (x - x.mean(0)) / x.std(0)
    want = {frozenset(free[i][0] for i in g) for g in ward_brute(x, 8)}
    got = {}
    for r in free:
        got.setdefault(out[r[0]], set()).add(r[0])
    assert {frozenset(g) for g in got.values()} == want and all(g.startswith("ACYC_C") for g in got)
    assert all(out[r[0]] == r[2] for r in rows if r[1] == "cyclic")
    assert {r["group"] for r in wf.cluster_ungrouped(df.filter("record_id < 8"), ["a", "b"], 8).collect()} == {f"g{i}" for i in range(8)}


def test_weights_as_copies(spark):
    """Rows are repeated in proportion to their weights, and a network learns the rare class."""
    df = models.balanced(spark.createDataFrame([(i, [float(i % 7), float(i)], int(i < 30)) for i in range(300)], "record_id long, v array<double>, label int").withColumn("features", array_to_vector("v")))
    n = {r["label"]: r["count"] for r in models.copied(df, "weight").groupBy("label").count().collect()}
    assert n[0] == 270 and 0.9 * 270 <= n[1] <= 1.1 * 270
    scored = models.fit(df.drop("weight"), "ann")(df)
    assert {r["p"] for r in scored.select((F.col("proba") >= 0.5).alias("p")).distinct().collect()} == {True, False}


def test_fractions_by_cuts(spark):
    """Each fold and fraction has the rows of the smallest draws, with ties of the cut's range in order, and `least` at the least."""
    from assayline.functions.columns import draw

    df = spark.range(3000).select(F.col("id").alias("record_id"), (F.col("id") % 3).cast("int").alias("fold")).unionByName(spark.range(5000, 5004).select(F.col("id").alias("record_id"), F.lit(9).alias("fold")))
    fractions = (0.01, 0.25, 1.0)
    got = {(r["fold"], r["fraction"], r["record_id"]) for r in splits.learning_fractions(df, fractions).collect()}
    want = set()
    for f in fractions:
        for r in df.withColumn("d", draw(42, F.lit(f).cast("string"), "record_id")).groupBy("fold").agg(F.array_sort(F.collect_list(F.struct("d", "record_id"))).alias("x")).collect():
            want |= {(r["fold"], f, x["record_id"]) for x in r["x"][: max(int(len(r["x"]) * f), 10)]}
    assert got == want


def test_similarity_is_kept_up_to_date(spark):
    """What rounds of augmentation keep equals comparing anew."""
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.random() < 0.5 - 0.3 * (i % 2)), rng.random()], sorted(rng.sample(range(60), 12))) for i in range(160)]
    df = spark.createDataFrame(rows, "record_id long, label int, v array<double>, bits array<long>").withColumn("features", array_to_vector("v")).drop("v")
    train, pool = df.filter("record_id < 40"), df.filter("record_id >= 40")
    got = wf.fn_augmentation(train, pool, rounds=3).collect()
    assert len(got) > 1
    for r in got:
        scored = wf.predicted(models.fit_score(train, pool, "logistic"))
        sims = joins.tanimoto_max(train, pool).agg(F.round(F.avg((F.col("max_sim") >= 0.3).cast("double")), 4), F.round(F.avg("max_sim"), 4)).first()
        assert (r["n_train"], r["n_pool"], r["ad_coverage"], r["ad_mean_sim"]) == (train.count(), pool.count(), *sims)
        missed = scored.filter("label = 1 and pred = 0").select(*train.columns)
        train = spark.createDataFrame(train.unionByName(missed).collect(), train.schema)
        pool = spark.createDataFrame(pool.join(missed.select("record_id"), "record_id", "left_anti").select(*train.columns).collect(), train.schema)


def test_external_rows(spark):
    df = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    for n, left in ((19, 0), (20, 20)):
        rows, counts = labels.external_rows(df([f"k{i}" for i in range(n)] + ["x", "y"]), df(["x", "y", "z"]))
        assert rows.count() == left and tuple(counts.first()) == (n + 2, 2, n, n >= 20)


def test_threshold_of_few_rows(spark):
    rows = [("few", i % 2, 0.9 * (i % 2)) for i in range(9)] + [("many", i % 2, 0.25 + 0.35 * (i % 2)) for i in range(40)]
    got = {r["e"]: r["threshold"] for r in metrics.oof_threshold(spark.createDataFrame(rows, "e string, label int, proba double"), ["e"]).collect()}
    assert got["few"] == 0.5 and 0.25 < got["many"] <= 0.6


def test_run_checklist(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    some = t([(1,)], "x int")
    rows = t([("a", "raw_all", "c", "m", 0.5, 0.4, 0.9, 0.1), ("a", "salt_stripped", "c", "m", 0.6, 0.4, None, 0.1)], "endpoint string, scenario string, feature_mode string, model string, mcc double, mcc_lo double, ad_coverage double, brier double")
    tables = {"splits": t([("a", 0), ("b", 0)], "endpoint string, group_overlap long"), "conflicts": t([("a",), ("b",)], "endpoint string"), "rows": rows} | dict.fromkeys(("domain", "held_out", "overlap", "cv", "mcnemar", "curves", "importances"), some)
    got = {r["check"]: r["passed"] for r in metrics.run_checklist(tables).collect()}
    assert len(got) == 13 and [k for k, v in got.items() if not v] == ["ad_computed"]
    tables |= {"splits": t([("a", 1), ("b", 0)], "endpoint string, group_overlap long"), "conflicts": t([("a",)], "endpoint string"), "cv": some.limit(0), "rows": rows.drop("mcc_lo", "ad_coverage").withColumn("mcc", F.lit(0.5))}
    del tables["mcnemar"]
    got = {r["check"] for r in metrics.run_checklist(tables).collect() if not r["passed"]}
    assert got == {"fixed_split", "conflicts", "cv_selection", "statistical_tests", "ad_computed", "bootstrap_ci", "salt_stripped_verified"}


def fitted_rows(spark, n=120):
    rng = random.Random(6)
    return spark.createDataFrame([(i, int(rng.random() < 0.4), "ab"[i % 2], f"g{i % 10}", ["train", "train", "test"][i % 3], rng.random(), rng.gauss(0, 1)) for i in range(n)], "record_id long, label int, endpoint string, grp string, split string, x double, y double").withColumn("x", F.col("x") + F.col("label"))


def test_locked_grid(spark):
    """Endpoints by scenarios by modes by models, each once, with intervals."""
    rows = wf.locked_test_grid(fitted_rows(spark), {"raw_all": F.lit(True), "no_metal": F.col("record_id") > 5}, {"compact": ["x"], "broad": ["x", "y"]}, ("logistic",), n_boot=20).collect()
    assert sorted((r["endpoint"], r["scenario"], r["feature_mode"], r["model"]) for r in rows) == sorted((e, s, m, "logistic") for e in "ab" for s in ("raw_all", "no_metal") for m in ("compact", "broad"))
    assert all(r["mcc_lo"] <= r["mcc_hi"] and r["threshold_default"] == 0.5 for r in rows)


def test_ablation(spark):
    rows, pivot = wf.ablation_study(fitted_rows(spark).withColumn("max_sim", F.lit(0.5)), {"one": ["x"], "two": ["x", "y"]}, ("logistic",), k=2, sim="max_sim", n_boot=20)
    got = rows.collect()
    assert {r["subset"] for r in got} == {"one", "two"} and all(r["ad_coverage"] == 1.0 and 0.1 <= r["threshold"] <= 0.9 and r["mcc_at_threshold"] is not None and r["brier_lo"] <= r["brier_hi"] for r in got)
    assert pivot.columns == ["model", "one", "two"] and pivot.first()["one"] == next(r["cv_mcc_mean"] for r in got if r["subset"] == "one")


def test_feature_table(spark, tmp_path):
    d = spark.createDataFrame([(1, "a b c", "train"), (2, "c d", "test"), (3, None, "train")], "record_id long, text string, split string")
    aux = spark.createDataFrame([(1, 1.0), (2, None)], "record_id long, d_len double")
    wide, audit = wf.build_feature_table(d, aux, blocks={"bits": "bits", "side": "d_"}, path=f"file://{tmp_path}/wide")
    assert {tuple(r) for r in audit.collect()} == {("train", 2, "bits", 1, 1), ("train", 2, "side", 1, 1), ("test", 1, "bits", 1, 0), ("test", 1, "side", 1, 1)}
    assert wide.filter("split = 'test'").inputFiles() and wide.count() == 3
