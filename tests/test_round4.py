"""What a reviewer found on larger tables."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from assayline.operators import joins, models, nearest, sampling
from assayline.plans import workflows as wf
from assayline.sources import tables


def test_fingerprint_of_a_large_group(spark):
    """Row hashes of 48 bits pass 2**63 from some 65,000 rows on."""
    n = 140_000
    total = sum(int(hashlib.sha256(str(i).encode()).hexdigest()[:12], 16) for i in range(n))
    assert total > 2**63
    got = tables.content_fingerprint(spark.range(n).withColumn("g", F.lit("a")), "g", ["id"]).first()
    assert (got["n"], got["fingerprint"]) == (n, hashlib.sha256(f"{total}|{n}".encode()).hexdigest()[:16])


def test_more_medoids_than_one_fit_has(spark, monkeypatch):
    """No fit has as many clusters as rows are asked; n rows come back, which lie nearer to all rows than as many drawn ones; copies of a row count once."""
    asked, fit = [], sampling.KMeans
    monkeypatch.setattr(sampling, "KMeans", lambda **x: asked.append(x["k"]) or fit(**x))
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(3000, 2)) * np.exp(rng.normal(size=(3000, 1))), np.full((600, 2), 1.5)])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "record_id long, a double, b double")
    got = sorted(r["record_id"] for r in sampling.kmeans_medoid_sample(df, ["a", "b"], 1500).collect())
    assert len(got) == len(set(got)) == 1500 and max(asked) <= 1000
    assert sum(i >= 3000 for i in got) == 1
    z = (x - x.mean(0)) / x.std(0)
    far = lambda ids: np.sqrt(((z[:, None] - z[ids][None]) ** 2).sum(2).min(1)).mean()
    assert far(got) < 0.7 * far(rng.choice(3000, 1500, replace=False))
    assert sampling.kmeans_medoid_sample(df, ["a", "b"], 3300).count() == 3300


def test_visits_are_not_written_out(spark, monkeypatch):
    """Where nothing can be ruled out, what is kept between rounds is a row a group of queries, not one a query and block."""
    rows = {}

    def kept(df, name, keep=nearest.keep):
        out = keep(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(nearest, "keep", kept)
    x = np.random.default_rng(6).normal(size=(900, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "record_id long, v array<double>")
    found, work = nearest.search(df, df, 2, nearest.Euclid(), block=32)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {(r["record_id"], r["nth"]): r["neighbour"] for r in found.collect()}
    assert got == {(i, n + 1): int(j) for i, row in enumerate(d) for n, j in enumerate(np.argsort(row)[:2])}
    assert work.first()["compared"] > 0.5 * 900 * 900 and rows["near-visits"] < 100


def test_pairs_of_a_large_group_are_spread(spark):
    """One group's pairs come from many tasks, each pair once; equal names and nulls make none."""
    rows = [("g", f"n{i % 1900:04d}" if i else None, float(i)) for i in range(2000)] + [("h", "b", 1.0), ("h", "a", 2.0), (None, "x", 1.0), (None, "y", 2.0)]
    out = joins.pair_experiments(spark.createDataFrame(rows, "g string, name string, score double"), "g", "name", "score")
    per = {r["p"]: r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()}
    names = [r[1] for r in rows if r[0] == "g" and r[1]]
    same = sum(names.count(x) * (names.count(x) - 1) // 2 for x in set(names))
    assert sum(per.values()) == len(names) * (len(names) - 1) // 2 - same + 1 and max(per.values()) < 0.8 * sum(per.values())
    assert out.filter("model_a >= model_b").count() == 0 and out.distinct().count() == out.count()
    assert [tuple(r) for r in out.filter("g = 'h'").collect()] == [("h", "a", 2.0, "b", 1.0)]


def test_rows_without_some_number_are_fitted(spark):
    """A text without words has no mean word: its number counts as 0, and its row stays in."""
    df = spark.createDataFrame([(i, i % 2, None if i % 10 == 0 else float(i % 2) + i / 100) for i in range(60)], "record_id long, label int, x double")
    v = wf.vectors(df, ["x"])
    assert v.columns == ["record_id", "label", "x", "features"] and v.filter("record_id = 0").first()["features"].tolist() == [0.0]
    assert models.fit_score(v, v, "logistic").count() == 60
