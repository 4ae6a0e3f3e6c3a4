"""Leaderboards and summary tables over result rows, one row per experiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PRIORITY = {"raw_all": 0, "no_metal": 1, "salt_stripped": 2}


def scenario_priority(c: str = "scenario") -> Column:
    out = F.lit(len(PRIORITY))
    for name, p in PRIORITY.items():
        out = F.when(F.col(c) == name, p).otherwise(out)
    return out


def best_per_group(rows: DataFrame, by: list[str], metric: str, *ties: Column | str) -> DataFrame:
    """rows with is_primary on the best row of each group."""
    nth = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(metric), *ties))
    return rows.withColumn("is_primary", nth == 1)


def top_k_per_group(rows: DataFrame, by: list[str], metric: str, k: int, *ties: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(metric), *ties))).filter(F.col("rank") <= k)


def leaderboard(rows: DataFrame, by: str, metric: str, cols: list[str]) -> DataFrame:
    """Completed rows in order, with the columns of cols that there are."""
    return rows.filter(F.col(metric).isNotNull()).orderBy(by, F.desc(metric)).select(*[c for c in cols if c in rows.columns])


def pivot_metric(rows: DataFrame, by: str, across: str, values: list[str], metric: str) -> DataFrame:
    """The best value per group and column; values are given, so that no job has to find them."""
    return rows.groupBy(by).pivot(across, values).agg(F.max(metric))


def delta_table(rows: DataFrame, pairs: dict[str, tuple[str, str]], keys: list[str]) -> DataFrame:
    """Differences of columns, null if either is."""
    return rows.select(*keys, *[F.round(F.col(a) - F.col(b), 4).alias(n) for n, (a, b) in pairs.items()])


def benchmark_compare(rows: DataFrame, published: DataFrame, by: str, metric: str) -> DataFrame:
    """Published values, and our best per group below them."""
    ours = rows.groupBy(by).agg(F.max(metric).alias(metric)).select(by, F.lit("ours").alias("source"), metric)
    return published.select(by, "source", metric).unionByName(ours)


def pairwise_models(rows: DataFrame, by: str, model: str, metric: str) -> DataFrame:
    """Best row per model, then all pairs: difference and the better one; a tie goes to the second."""
    best = rows.groupBy(by, model).agg(F.max(metric).alias("m"))
    a = best.select(by, F.col(model).alias("model_a"), F.col("m").alias("mcc_a"))
    b = best.select(by, F.col(model).alias("model_b"), F.col("m").alias("mcc_b"))
    p = a.join(b, by).filter("model_a < model_b")
    return p.withColumns({"diff": F.round(F.col("mcc_a") - F.col("mcc_b"), 4), "better": F.when(F.col("mcc_a") > F.col("mcc_b"), F.col("model_a")).otherwise(F.col("model_b"))})


def grid_summary(rows: DataFrame, by: str, across: list[str], metric: str) -> DataFrame:
    """(by, axis, level, mean, sd, n) over a grid, for each axis in one pass. The metric counts in ten-thousandths, so sums are exact, and halves round up."""
    long = rows.select(by, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("level")) for a in across])).alias("x"), metric)
    m = F.round(F.col(metric) * 10000).cast("long")
    sums = long.groupBy(by, "x.axis", "x.level").agg(F.sum(m).alias("s"), F.sum(m * m).alias("q"), F.count("*").alias("n"))
    half_up = lambda x: F.floor(x + F.lit(0.5)) / F.lit(10000.0)
    spread = (F.col("n") * F.col("q") - F.col("s") * F.col("s")).cast("double") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0)).cast("double")
    return sums.select(by, "axis", "level", half_up(F.col("s").cast("double") / F.col("n").cast("double")).alias("mean"), F.when(F.col("n") > 1, half_up(F.sqrt(spread))).alias("sd"), "n")


def scenario_deltas(rows: DataFrame, by: list[str], metric: str, base: str = "raw_all", scenario: str = "scenario") -> DataFrame:
    """Each scenario's metric minus the base scenario's of the same experiment."""
    b = rows.filter(F.col(scenario) == base).select(*by, F.col(metric).alias("_base"))
    return rows.filter(F.col(scenario) != base).join(b, by).select(*by, scenario, F.round(F.col(metric) - F.col("_base"), 4).alias("delta"))


def ad_coverage_summary(rows: DataFrame) -> DataFrame:
    return rows.select("endpoint", "scenario", "model", "coverage", "ad_mean_sim")


def importance_rollup(importances: DataFrame, rows: DataFrame, k: int = 20) -> DataFrame:
    """The k most important features of the best experiment of each endpoint. importances: experiment, feature, importance."""
    best = best_per_group(rows, ["endpoint"], "mcc", "experiment").filter("is_primary").select("endpoint", "experiment", "mcc")
    return top_k_per_group(importances.join(best, "experiment"), ["endpoint"], "importance", k, "feature")


def hyperparam_landscape(search: DataFrame, x: str, y: str, ys: list, score: str) -> DataFrame:
    return search.groupBy(x).pivot(y, ys).agg(F.round(F.avg(score), 4))


def importance_blocks(importances: DataFrame, by: str = "experiment") -> DataFrame:
    from assayline.sources.tables import block_of

    return importances.groupBy(by, block_of(F.col("feature")).alias("block")).agg(F.round(F.sum("importance"), 6).alias("importance"), F.count("*").alias("n_features"))
