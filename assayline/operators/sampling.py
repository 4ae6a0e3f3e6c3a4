"""Class weights, undersampling and negative sampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import draw
from assayline.operators.features import standardize
from assayline.operators.joins import knn, squared_distance
from assayline.operators.ranks import nth_by_draw, percentiles, running
from assayline.plans.shared import keep

#: Clusters that one fit has, whose centres the driver holds; and one within a task.
CENTRES, TASK_CENTRES = 1000, 128


def class_weight(df: DataFrame, by: str) -> DataFrame:
    """df with pos_weight (n_neg / max(n_pos, 1)) and balanced weights n / (2 * n of the row's class)."""
    g = df.groupBy(by).agg(F.count("*").alias("_n"), F.count_if(F.col("label") == 1).alias("_p"))
    own = F.when(F.col("label") == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    out = df.join(g, by)
    return out.withColumns({"pos_weight": (F.col("_n") - F.col("_p")) / F.greatest(F.col("_p"), F.lit(1)), "balanced_weight": F.col("_n") / (own * 2)}).drop("_n", "_p")


def random_undersample(df: DataFrame, by: list[str], seed: int = 42) -> DataFrame:
    """As many rows of each class as the smaller one has, by a hash of record_id."""
    n = df.groupBy(*by, "label").agg(F.count("*").alias("_k")).groupBy(*by).agg(F.min("_k").alias("_least"))
    return nth_by_draw(df, [*by, "label"], draw(seed, "record_id"), ["record_id"], "_nth").join(n, by).filter("_nth <= _least").drop("_nth", "_least")


def near_miss(df: DataFrame, m: int = 3, k: int = 3, seed: int = 42) -> DataFrame:
    """All positives, and as many negatives: those among each positive's m nearest negatives whose mean distance to their k nearest positives is largest, the smaller record_id of equals. Random undersampling if a class has too few rows for that."""
    pos, neg = df.filter("label = 1"), df.filter("label = 0")
    n = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    if n["p"] < k or n["n"] < m:
        return random_undersample(df.withColumn("_all", F.lit(1)), ["_all"], seed).drop("_all")
    near = keep(neg.join(knn(pos, neg, m).select(F.col("neighbour").alias("record_id")).distinct(), "record_id", "left_semi"), "near")
    far = knn(near, pos, k).groupBy("record_id").agg(F.round(F.avg("dist"), 12).alias("far")).withColumn("one", F.lit(1))
    chosen = running(far, [], [F.desc("far"), "record_id"], {"nth": "one"}).filter(F.col("nth") <= n["p"]).select("record_id")
    return pos.unionByName(neg.join(chosen, "record_id", "left_semi"))


def smote_tomek(df: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """Positives filled up to the number of negatives by points between a positive and one of its k nearest positives, then rows of Tomek links removed. Made rows have negative ids. Random undersampling if positives have too few rows for k neighbours."""
    pos = df.filter("label = 1")
    if pos.count() <= k:
        return random_undersample(df.withColumn("_all", F.lit(1)), ["_all"], seed).select("record_id", "v", "label")
    near = knn(pos, pos, k).select(F.col("record_id").alias("i"), F.col("neighbour").alias("j"))
    n = df.agg((F.count_if(F.col("label") == 0) - F.count_if(F.col("label") == 1)).alias("missing"), F.count_if(F.col("label") == 1).alias("p"))
    rounds = near.crossJoin(F.broadcast(n)).withColumn("times", F.ceil(F.col("missing") / F.greatest(F.col("p") * k, F.lit(1)))).filter("times > 0").withColumn("t", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    made = nth_by_draw(rounds, [], draw(seed, "i", "j", "t"), ["i", "j", "t"]).filter("nth <= missing").select("i", "j", "nth", (draw(seed, "nth") / F.lit(4294967296.0)).alias("u"))
    v = pos.select("record_id", "v")
    made = made.join(v.select(F.col("record_id").alias("i"), F.col("v").alias("vi")), "i").join(v.select(F.col("record_id").alias("j"), F.col("v").alias("vj")), "j")
    made = made.select((-F.col("nth")).cast("long").alias("record_id"), F.zip_with("vi", "vj", lambda a, b: a + F.col("u") * (b - a)).alias("v"), F.lit(1).alias("label"))
    both = df.select("record_id", "v", "label").unionByName(made)
    nn = knn(both, both).select(F.col("record_id").alias("i"), F.col("neighbour").alias("j"))
    mutual = nn.join(nn.select(F.col("i").alias("j"), F.col("j").alias("i2")), "j").filter("i = i2").select("i", "j")
    side = both.select("record_id", "label")
    tomek = mutual.join(side.select(F.col("record_id").alias("i"), F.col("label").alias("li")), "i").join(side.select(F.col("record_id").alias("j"), F.col("label").alias("lj")), "j").filter("li <> lj").select(F.col("i").alias("record_id"))
    return both.join(tomek, "record_id", "left_anti")


def drawn(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows, those of the smallest hashes of record_id; all if there are no more."""
    return nth_by_draw(df, [], draw(seed, "record_id"), ["record_id"], "_nth").filter(F.col("_nth") <= n).drop("_nth")


def _shares(sizes: np.ndarray, n: int) -> np.ndarray:
    """n shared out by sizes; at most the size where n isn't above their sum."""
    upto = np.cumsum(sizes, dtype=np.int64) * n // sizes.sum()
    return np.diff(upto, prepend=0)


def _lloyd(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each of the points x with weights w, and its squared distance to that cluster's centre: k-means++ seeds, then Lloyd's steps."""
    picked, gap = [int(rng.choice(len(x), p=w / w.sum()))], np.full(len(x), np.inf)
    while True:
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(1))
        if len(picked) == k or not gap.any():
            break
        picked.append(int(min(np.searchsorted(np.cumsum(gap * w), rng.random() * (gap @ w), "right"), len(x) - 1)))
    centres, own = x[picked], None
    squares = (x * x).sum(1)
    for _ in range(rounds):
        d = squares[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None, :]
        before, own = own, d.argmin(1)
        if before is not None and (own == before).all():
            break
        total = np.bincount(own, w, len(centres))
        means = np.stack([np.bincount(own, w * c, len(centres)) for c in x.T], 1)
        centres = np.where(total[:, None] > 0, means / np.maximum(total, 1)[:, None], centres)
    return own, ((x - centres[own]) ** 2).sum(1)


def _medoids(ids: np.ndarray, x: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """ids of the points nearest to the centres of k clusters of different points x, the smaller one of equals. More clusters than TASK_CENTRES are made in parts of x, which are clusters too."""
    if k >= len(x):
        return ids
    if k < 1:
        return ids[:0]
    rng = np.random.default_rng([seed, int(ids.min()) % (1 << 32), len(ids), k])
    parts = min(TASK_CENTRES // 4, -(-k // TASK_CENTRES))
    own, d = _lloyd(x, w, k if parts == 1 else parts, rng)
    if parts > 1:
        sizes = np.bincount(own)
        if sizes.max() == len(x):  # what rounding can't tell apart is cut by its order
            own = np.arange(len(x)) * parts // len(x)
            sizes = np.bincount(own)
        return np.concatenate([_medoids(ids[own == i], x[own == i], w[own == i], int(q), seed) for i, q in enumerate(_shares(sizes, k)) if sizes[i]])
    order = np.lexsort((ids, d, own))
    first = np.flatnonzero(np.r_[True, np.diff(own[order]) != 0])
    return ids[order[first]]


def _parted_medoids(x: DataFrame, n: int, seed: int) -> DataFrame:
    """(record_id) of the medoids of n clusters, which are made within the cells of a coarser clustering, in tasks; a cell has a part of n by its different points. x: (record_id, _x)."""
    points = x.groupBy(vector_to_array("_x").alias("v")).agg(F.min("record_id").alias("record_id"), F.count("*").cast("double").alias("w"))
    points = keep(points.withColumn("_x", array_to_vector("v")), "points")
    model = KMeans(k=min(CENTRES, max(2, -(-n // CENTRES))), seed=seed, initMode="k-means||", featuresCol="_x", predictionCol="cell", weightCol="w", maxIter=10).fit(points)
    placed = keep(model.transform(points).select("cell", "record_id", "v", "w"), "cells")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().orderBy("cell").collect()}  # at most CENTRES
    asked = dict(zip(sizes, _shares(np.array([*sizes.values()]), n).tolist(), strict=True))

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("record_id")
        return pd.DataFrame({"record_id": _medoids(rows["record_id"].to_numpy(), np.array(rows["v"].tolist(), float), rows["w"].to_numpy(), asked[key[0]], seed)})

    return placed.groupBy("cell").applyInPandas(run, "record_id long")


def kmeans_medoid_sample(df: DataFrame, cols: list[str], n: int, seed: int = 42) -> DataFrame:
    """n diverse rows, or all if there are no more: standardized columns in n clusters, of each the row nearest to its centre, the smaller record_id of equals.

    Seeds are those of k-means||, and assignment skips centres by the distances between them. Where rows coincide there are
    fewer clusters than n; what then misses is drawn from the rest by a hash. Up to CENTRES clusters are one fit, whose
    centres the driver holds; more are made within the cells of a coarser clustering (hierarchical k-means), so that time
    grows with rows and not with rows times n.
    """
    total = df.count()
    if total <= n:
        return df
    if n < 2:
        return drawn(df, n, seed)
    x = keep(VectorAssembler(inputCols=cols, outputCol="_x").transform(standardize(df, cols)).select("record_id", "_x"), "kmeans")
    if n > CENTRES:
        chosen = keep(_parted_medoids(x, n, seed), "medoids")
    else:
        model = KMeans(k=n, seed=seed, initMode="k-means||", featuresCol="_x", predictionCol="_c").fit(x)
        centres = df.sparkSession.createDataFrame([(i, [float(y) for y in c]) for i, c in enumerate(model.clusterCenters())], "_c int, _v array<double>")
        near = model.transform(x).join(centres, "_c").select("_c", "record_id", squared_distance(vector_to_array("_x"), F.col("_v")).alias("_d"))
        chosen = keep(near.groupBy("_c").agg(F.min_by("record_id", F.struct("_d", "record_id")).alias("record_id")).select("record_id"), "medoids")
    missing = n - chosen.count()
    if missing:
        rest = df.select("record_id").join(chosen, "record_id", "left_anti")
        chosen = chosen.unionByName(drawn(rest, missing, seed))
    return df.join(chosen, "record_id", "left_semi")


def profile_quotas(df: DataFrame, n: int, profile: str = "profile") -> DataFrame:
    """(profile, k, quota): n shared out by the k positives of each profile, 1 at the least."""
    pos = df.filter("label = 1").groupBy(profile).agg(F.count("*").alias("k"))
    total = pos.agg(F.sum("k").alias("t"))
    return pos.crossJoin(F.broadcast(total)).select(profile, "k", F.greatest(F.lit(1), F.round(F.col("k").cast("double") / F.col("t") * n)).cast("int").alias("quota"))


def profile_draw(df: DataFrame, n: int, profile: str = "profile", seed: int = 42) -> DataFrame:
    """At most n negatives, or all if there are no more than n: of each profile that positives have its quota, by a hash; profiles with more positives first (then by name), cut at n."""
    neg = df.filter("label = 0")
    if neg.count() <= n:
        return neg
    quotas = profile_quotas(df, n, profile).join(neg.groupBy(profile).agg(F.count("*").alias("_have")), profile)
    quotas = quotas.withColumn("_take", F.least(F.col("quota").cast("long"), "_have"))
    ahead = running(quotas, [], [F.desc("k"), profile], {"_upto": "_take"}).select(profile, "_take", (F.col("_upto") - F.col("_take")).alias("_ahead"))
    rows = nth_by_draw(neg, [profile], draw(seed, "record_id"), ["record_id"], "_nth").join(ahead, profile)
    return rows.filter((F.col("_nth") <= F.col("_take")) & (F.col("_ahead") + F.col("_nth") <= n)).select(*df.columns)


def profile_stratified_sample(df: DataFrame, cols: list[str], n: int, profile: str = "profile", seed: int = 42) -> DataFrame:
    """n negatives, or all if there are no more, whose profiles are distributed as those of positives; what quotas leave open is filled with diverse rows from the rest."""
    first = keep(profile_draw(df, n, profile, seed), "by-profile")
    missing = n - first.count()
    if missing <= 0:
        return first
    rest = df.filter("label = 0").join(first.select("record_id"), "record_id", "left_anti").select(*df.columns)
    return first.unionByName(kmeans_medoid_sample(rest, cols, missing, seed))


def combined_sample(df: DataFrame, cols: list[str], n: int, w: float = 0.5, profile: str = "profile", seed: int = 42) -> DataFrame:
    """n negatives, or all if there are no more: round(w * n) of them by profile, one at the least, the others diverse rows from the rest."""
    part = max(1, round(w * n))
    first = keep(profile_stratified_sample(df, cols, part, profile, seed), "by-profile")
    rest = df.filter("label = 0").join(first.select("record_id"), "record_id", "left_anti").select(*df.columns)
    return first.unionByName(kmeans_medoid_sample(rest, cols, n - part, seed)) if n > part else first


def sampling_coverage(everything: DataFrame, chosen: DataFrame, cols: list[str]) -> DataFrame:
    """Mean, median, 95th percentile and maximum of the distance from each row to the nearest chosen one, in scores standardized over all rows."""
    z = standardize(everything, cols).select("record_id", F.array(*cols).alias("v"))
    # A chosen row is at distance 0 from itself, which a neighbour search leaves out.
    d = z.join(chosen.select("record_id"), "record_id", "left_anti")
    d = keep(knn(d, z.join(chosen.select("record_id"), "record_id", "left_semi")).select(F.col("dist").alias("d")).unionAll(chosen.select(F.lit(0.0).alias("d"))), "coverage")
    s = d.agg(F.round(F.avg("d"), 4).alias("coverage_mean_dist"), F.round(F.max("d"), 4).alias("coverage_max_dist"))
    q = percentiles(d, [], {"coverage_median_dist": ("d", 0.5), "coverage_95th_dist": ("d", 0.95)})
    return s.crossJoin(F.broadcast(q.select(*[F.round(c, 4).alias(c) for c in q.columns])))  # one row each
