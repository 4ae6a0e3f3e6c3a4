"""Running sums, percentiles and what rests on them, against plain computations."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayline.functions.columns import student_p
from assayline.operators import features, metrics, ranks


def test_running(spark):
    """Groups of all sizes, a null group, and one that is spread over many ranges."""
    rng = random.Random(1)
    rows = [(g, float(i), rng.randint(0, 9)) for g, n in (("hot", 3000), ("b", 7), ("c", 1), (None, 40)) for i in rng.sample(range(10_000), n)]
    df = spark.createDataFrame(rows, "g string, v double, k int")
    got = {(r["g"], r["v"]): (r["upto"], r["all"]) for r in ranks.running(df, ["g"], [F.desc("v")], {"upto": "k"}, {"all": "k"}).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own, s = sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]), 0
        for r in own:
            s += r[2]
            want[g, r[1]] = (s, sum(x[2] for x in own))
    assert got == want
    assert ranks.in_ranges(df.filter("g = 'hot'"), ["g"], "v", parts=5).select("_part").distinct().count() > 1
    assert ranks.running(df.limit(0), ["g"], ["v"], {"upto": "k"}).count() == 0


def test_percentiles(spark):
    """As percentile(), per group and for all rows, with ties and nulls."""
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, rng.random(), float(rng.randint(0, 3))]), rng.gauss(0, 1)) for _ in range(500)] + [("d", 1.0, 2.0), ("e", None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    wanted = {"x50": ("x", 0.5), "x95": ("x", 0.95), "y10": ("y", 0.1), "y100": ("y", 1.0)}
    native = [F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()]
    for by in (["g"], []):
        got = sorted(map(tuple, ranks.percentiles(df, by, wanted).collect()), key=str)
        want = sorted(map(tuple, (df.groupBy(*by).agg(*native) if by else df.agg(*native)).collect()), key=str)
        assert got == want


def test_one_experiment_of_many_scores(spark):
    """A million distinct scores of one experiment: no task holds them all, and the area is that of all pairs."""
    n = 1_000_000
    df = spark.range(n, numPartitions=4).select(F.lit("x").alias("experiment"), ((F.col("id") * 7919) % n / F.lit(float(n))).alias("proba"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    r = metrics.ranked(metrics.score_counts(df, ["experiment"]), ["experiment"])
    assert r.count() == n
    got = metrics.roc_auc(df, ["experiment"]).first()["roc_auc"]
    ids = np.arange(n)
    score, y = (ids * 7919) % n, ids % 3 == 0
    p = int(y.sum())
    at = np.argsort(np.argsort(score))[y].sum()
    assert got == round((at - p * (p - 1) / 2) / (p * (n - p)), 4)
    parts = ranks.in_ranges(metrics.score_counts(df, ["experiment"]), ["experiment"], "score").groupBy("_part").count().collect()
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(parts) > 1 and max(x["count"] for x in parts) < 0.5 * n


def test_group_weights():
    """k equal rows together draw as k single ones: mean and variance k; large groups in pieces; the same draws again."""
    sizes = np.array([1] * 200 + [5] * 200 + [256, 257, 1000, 0])
    names = [f"g{i}" for i in range(len(sizes))]
    w = metrics.group_weights(names, sizes, 200)
    assert (w == metrics.group_weights(names, sizes, 200)).all() and w.shape == (404, 200) and (w[-1] == 0).all()
    assert (metrics.group_weights(names[:7], sizes[:7], 50) == w[:7, :50]).all()
    for part, k in ((w[:200], 1), (w[200:400], 5)):
        assert abs(part.mean() - k) < 0.05 * k and abs(part.var() - k) < 0.06 * k
    for row, k in zip(w[400:403], (256, 257, 1000), strict=True):
        assert abs(row.mean() - k) < 5 * math.sqrt(k / 200) and 0.7 * k < row.var() < 1.4 * k
    ones = metrics.group_weights([f"h{i}" for i in range(20_000)], np.ones(20_000, np.int64), 4)
    assert [round((ones == i).mean(), 2) for i in range(3)] == [0.37, 0.37, 0.18]


def test_bootstrap_sums(spark):
    """Replicates from ranges are those of weighted rows put together."""
    rng = random.Random(3)
    rows = [(i % 2, rng.randint(0, 1), round(rng.random(), 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "experiment int, label int, proba double")
    got = {(r["experiment"], r["b"]): r for r in metrics.bootstrap_replicates(df, ["experiment"], 20).collect()}
    for e in (0, 1):
        counts = {}
        for x, y, s in rows:
            if x == e:
                counts[s, y] = counts.get((s, y), 0) + 1
        keys = sorted(counts)
        w = metrics.group_weights([f"{y}|{e}|{math.floor(s * 2**40)}" for s, y in keys], np.array([counts[k] for k in keys]), 20)
        for b in range(20):
            weight = dict(zip(keys, w[:, b], strict=True))
            pos, neg = {s: k for (s, y), k in weight.items() if y}, {s: k for (s, y), k in weight.items() if not y}
            wins = sum(k * m * (1 if s > t else 0.5 if s == t else 0) for s, k in pos.items() for t, m in neg.items())
            r = got[e, b]
            assert math.isclose(r["roc_auc"], wins / (sum(pos.values()) * sum(neg.values())))
            assert r["tp"] == sum(k for s, k in pos.items() if s >= 0.5) and r["fn"] == sum(k for s, k in pos.items() if s < 0.5)
            assert r["fp"] == sum(k for s, k in neg.items() if s >= 0.5) and r["tn"] == sum(k for s, k in neg.items() if s < 0.5)
            assert math.isclose(r["brier"], (sum(k * (1 - s) ** 2 for s, k in pos.items()) + sum(k * s * s for s, k in neg.items())) / sum(weight.values()))


def test_signed_rank_p(spark):
    """Up to 12 pairs: all signs enumerated, ties and zeros included."""
    rng = random.Random(4)
    cases = {f"m{i}": [rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2, 3, 4.5]) for _ in range(n)] for i, n in enumerate((3, 5, 6, 8, 9, 11, 12, 12))}
    df = spark.createDataFrame([(m, float(d), 0.0) for m, ds in cases.items() for d in ds], "m string, a double, b double")
    got = {r["m"]: r for r in metrics.wilcoxon_signed_rank(df, ["m"], "a", "b", with_p=True).collect()}
    for m, ds in cases.items():
        d = sorted((x for x in ds if x), key=abs)
        rank = [sum((abs(y) < abs(x)) + (abs(y) == abs(x)) / 2 for y in d) + 0.5 for x in d]
        if len(d) < 5:
            assert got[m]["statistic"] is None and got[m]["p_value"] is None if m in got else not d
            continue
        stat = min(sum(r for r, x in zip(rank, d, strict=True) if x > 0), sum(r for r, x in zip(rank, d, strict=True) if x < 0))
        sums = [sum(r for r, s in zip(rank, signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=len(d))]
        assert got[m]["statistic"] == stat and math.isclose(got[m]["p_value"], min(1, 2 * sum(s <= stat for s in sums) / len(sums)))


def test_student_p(spark):
    """Against the integral of the density, and closed forms for 1 and 2 degrees of freedom."""
    rows = [(t, float(n)) for t in (0.0, 0.3, 1.0, 2.5, 12.0) for n in (1, 2, 5, 30, 400)]
    got = [r[0] for r in spark.createDataFrame(rows, "t double, n double").select(student_p("t", "n")).collect()]
    for (t, n), p in zip(rows, got, strict=True):
        if n == 1:
            want = 1 - 2 * math.atan(t) / math.pi
        elif n == 2:
            want = 1 - t / math.sqrt(2 + t * t)
        else:
            x = np.linspace(0, t, 200_001)
            f = np.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + x * x / n) ** (-(n + 1) / 2)
            want = 1 - 2 * float(((f[1:] + f[:-1]) / 2 * np.diff(x)).sum())
        assert abs(p - want) < 1e-8


def test_correlation_p(spark):
    rng = random.Random(5)
    rows = [(i % 2, rng.gauss(i % 2, 1), 1.0, float(i % 2)) for i in range(60)]
    got = {r["feature"]: r for r in features.label_correlation(spark.createDataFrame(rows, "label int, x double, flat double, same double"), ["x", "flat", "same"], with_p=True).collect()}
    r = got["x"]["rho"]
    t = abs(r) * math.sqrt(58 / (1 - r * r))
    assert got["same"]["p_value"] == 0.0 and got["flat"]["p_value"] is None
    assert got["x"]["p_value"] == pytest.approx(spark.createDataFrame([(t, 58.0)], "t double, n double").select(student_p("t", "n")).first()[0], rel=1e-3)
