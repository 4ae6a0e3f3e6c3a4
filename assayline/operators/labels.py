"""Label conflicts between records of one key, and set logic on keys. The first row of a key is the one with the smallest record_id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import ratio

STRATEGIES = ("conservative", "positive_priority", "majority_vote")


def label_conflicts(df: DataFrame, key: str = "key") -> DataFrame:
    """Keys with more than one label: key, n_labels, n, n_pos."""
    g = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count_distinct("label").alias("n_labels"), F.count("*").alias("n"), F.sum("label").alias("n_pos"))
    return g.filter("_lo < _hi").drop("_lo", "_hi")


def key_firsts(df: DataFrame, key: str = "key", by: str = "record_id") -> DataFrame:
    """One row per key: its first row, its first positive row, counts. All by one grouped aggregate, combined before the shuffle."""
    row = F.struct(*[c for c in df.columns if c != key])
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(row, by).alias("first"), F.min_by(F.when(F.col("label") == 1, row), F.when(F.col("label") == 1, F.col(by))).alias("first_pos"),
        F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("label").alias("n"), F.sum("label").alias("n_pos"),
    )


def resolve_conflicts(df: DataFrame, strategy: str, key: str = "key") -> DataFrame:
    """One row per key that survives; null keys go.

    conservative: conflicting keys go. positive_priority: such a key's first positive row stays. majority_vote: its first
    row stays, with the label of the majority; a tie drops the key.
    """
    g, clash = key_firsts(df, key), F.coalesce(F.col("lo") < F.col("hi"), F.lit(False))
    label = F.col("first.label")
    pick = F.col("first")
    if strategy == "conservative":
        g = g.filter(~clash)
    elif strategy == "positive_priority":
        pick = F.when(clash, F.col("first_pos")).otherwise(pick)
        label = F.when(clash, F.lit(1)).otherwise(label)
    elif strategy == "majority_vote":
        g = g.filter(~clash | (F.col("n_pos") * 2 != F.col("n")))
        label = F.when(clash, (F.col("n_pos") * 2 > F.col("n")).cast("int")).otherwise(label)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    g = g.select(key, pick.alias("_row"), label.cast("int").alias("_label"))
    return g.select(*[F.col(key) if c == key else F.col("_label").alias(c) if c == "label" else F.col(f"_row.{c}").alias(c) for c in df.columns])


def conflict_report(df: DataFrame, key: str = "key") -> DataFrame:
    """One row per strategy: sizes, conflicts, and the share of positives before (over all rows, null keys too) and after."""
    g = key_firsts(df, key)
    clash, tie = F.col("lo") < F.col("hi"), F.col("n_pos") * 2 == F.col("n")
    label = F.col("first.label")
    one = g.agg(
        F.count_if(clash).alias("n_conflicts"), F.count("*").alias("keys"), F.sum(F.when(~clash, label)).alias("pos0"), F.sum(F.when(clash, 1).otherwise(label)).alias("pos1"),
        F.count_if(~clash | ~tie).alias("n2"), F.sum(F.when(~clash, label).when(~tie, (F.col("n_pos") * 2 > F.col("n")).cast("int"))).alias("pos2"),
    ).crossJoin(df.agg(F.count("*").alias("n_original"), F.round(F.avg("label"), 4).alias("pos_rate_before")))
    kept = {"conservative": (F.col("keys") - F.col("n_conflicts"), "pos0"), "positive_priority": (F.col("keys"), "pos1"), "majority_vote": (F.col("n2"), "pos2")}
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), n.alias("n_after"), F.round(ratio(F.col(p), n), 4).alias("pos_rate_after")) for s, (n, p) in kept.items()])).alias("x")
    return one.select("n_original", "n_conflicts", "pos_rate_before", rows).select("x.strategy", "n_original", "n_conflicts", "x.n_after", "pos_rate_before", "x.pos_rate_after")


def conflict_rows(df: DataFrame, key: str = "key") -> DataFrame:
    return df.join(label_conflicts(df, key).select(key), key, "left_semi")


def dedupe_first(df: DataFrame, keys: list[str], by: str = "record_id") -> DataFrame:
    """The first row of each combination of keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), by).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def duplicate_flag(df: DataFrame, key: str = "key", name: str = "duplicate") -> DataFrame:
    """Mark all rows of a key that more than one row has; null keys are duplicates of each other."""
    n = df.groupBy(key).agg(F.count("*").alias("_n")).withColumnRenamed(key, "_key")
    return df.join(n, df[key].eqNullSafe(n["_key"])).withColumn(name, F.col("_n") > 1).drop("_n", "_key")


def rollup_studies(df: DataFrame, entity: str = "entity", most: int = 2) -> DataFrame:
    """Study rows (entity, source, score, label) to one label per entity.

    Rows with a score above `most` go. Of an entity's rows within a source those of the best score count, and positive wins
    among them; entities whose sources then disagree go.
    """
    ok = df.filter(F.col("score").isNull() | (F.col("score") <= most)).withColumn("_s", F.coalesce("score", F.lit(most + 1)))
    best = ok.groupBy(entity, "source").agg(F.min("_s").alias("_best"))
    per = ok.join(best, [entity, "source"]).filter("_s = _best").groupBy(entity, "source").agg(F.max("label").alias("label"))
    return per.groupBy(entity).agg(F.min("label").alias("label"), F.max("label").alias("_hi"), F.count("*").alias("n_sources")).filter("label = _hi").drop("_hi")


def external_rows(ext: DataFrame, train: DataFrame, key: str = "key", least: int = 20) -> tuple[DataFrame, DataFrame]:
    """External rows whose key isn't in train, none if fewer than `least` are left; and one row (n_given, n_removed, n_left, enough)."""
    left = remove_overlap(ext, train, key)
    n = ext.agg(F.count("*").alias("n_given")).crossJoin(F.broadcast(left.agg(F.count("*").alias("n_left"))))  # one row each
    n = n.select("n_given", (F.col("n_given") - F.col("n_left")).alias("n_removed"), "n_left", (F.col("n_left") >= least).alias("enough"))
    return left.crossJoin(F.broadcast(n.select(F.col("enough").alias("_enough")))).filter("_enough").drop("_enough"), n


def remove_overlap(ext: DataFrame, train: DataFrame, key: str = "key") -> DataFrame:
    return ext.join(train.select(key), key, "left_anti")


def dataset_overlap(df: DataFrame, name: str = "endpoint", key: str = "key") -> DataFrame:
    """All pairs of datasets: shared keys, their share of the second one's keys (%), agreement and Cohen's kappa. The last label of a key counts."""
    last = df.filter(F.col(key).isNotNull()).groupBy(name, key).agg(F.max_by("label", "record_id").alias("label"))
    size = last.groupBy(name).agg(F.count("*").alias("n2"))
    a = last.select(key, F.col(name).alias("ep1"), F.col("label").alias("l1"))
    b = last.select(key, F.col(name).alias("ep2"), F.col("label").alias("l2"))
    both = a.join(b, key).filter("ep1 < ep2").groupBy("ep1", "ep2").agg(F.count("*").alias("overlap"), F.count_if(F.col("l1") == F.col("l2")).alias("concordant"), F.sum("l1").alias("p1"), F.sum("l2").alias("p2"))
    out = both.join(size.withColumnRenamed(name, "ep2"), "ep2")
    n = F.col("overlap").cast("double")
    agree, chance = F.col("concordant") / n, (F.col("p1") * F.col("p2") + (n - F.col("p1")) * (n - F.col("p2"))) / (n * n)
    kappa = F.when(F.col("overlap") > 1, F.round((agree - chance) / F.nullif(1 - chance, F.lit(0.0)), 4))
    return out.select("ep1", "ep2", "overlap", F.round(F.lit(100.0) * n / F.col("n2"), 1).alias("overlap_pct"), "concordant", (F.col("overlap") - F.col("concordant")).alias("discordant"), kappa.alias("kappa"))


def concat_tables(frames: dict[str, DataFrame], tag: str = "source_table") -> DataFrame:
    """Tables one below the other, missing columns null, each row tagged with its table's name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn(tag, F.lit(n)) for n, f in frames.items()])
