"""Splits and folds that keep groups whole. Random order is a hash of seed and name, so it is the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.columns import draw
from assayline.operators.ranks import nth_by_draw
from assayline.plans.shared import keep


def assign_groups(df: DataFrame, key: str = "key", sep: str = "|") -> DataFrame:
    """group and group_type: what follows the separator; a key without one gets a group of its own; null is INVALID."""
    tail = F.substring_index(key, sep, -1)
    has = F.contains(F.col(key), F.lit(sep)) & (tail != "")
    kind = F.when(F.col(key).isNull(), "invalid").when(has, "cyclic").otherwise("acyclic")
    return df.withColumns({"group": F.when(F.col(key).isNull(), "INVALID").when(has, tail).otherwise(F.concat(F.lit("__UNQ_"), F.col("record_id").cast("string"))), "group_type": kind})


def group_split(df: DataFrame, group: str = "grp", ratio: float = 0.8, seed: int = 42) -> DataFrame:
    """df with split: groups by size, largest first, go to train if they still fit into ratio * n rows, else to test.

    Groups of one size are alike but for their order, so it is enough to know how many of each size are taken: a fold over
    the distinct sizes, of which there are few, in place of one over groups. Within a size, a hash gives the order.
    """
    groups = df.groupBy(group).agg(F.count("*").alias("size"))
    sizes = groups.groupBy("size").agg(F.count("*").alias("k"))
    room = F.floor(F.sum(F.col("size") * F.col("k")) * F.lit(ratio)).cast("long")
    folded = sizes.agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "k")))).alias("sizes"), room.alias("room"))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<struct<size: bigint, take: bigint>>").alias("out"))
    step = lambda s, x: F.struct((s["room"] - F.least(x["k"], F.floor(s["room"] / x["size"])) * x["size"]).alias("room"), F.concat(s["out"], F.array(F.struct(x["size"].alias("size"), F.least(x["k"], F.floor(s["room"] / x["size"])).alias("take")))).alias("out"))
    takes = folded.select(F.explode(F.aggregate("sizes", start, step)["out"]).alias("t")).select("t.size", "t.take")
    placed = nth_by_draw(groups, ["size"], draw(seed, group), [group]).join(takes, "size").select(F.col(group).alias("_g"), F.when(F.col("nth") <= F.col("take"), "train").otherwise("test").alias("split"))
    return df.join(placed, df[group].eqNullSafe(placed["_g"])).drop("_g")


def split_report(df: DataFrame, by: str = "endpoint", group: str = "grp") -> DataFrame:
    """Per endpoint: rows and positives of each side, their difference, groups on both sides (must be 0), groups."""
    per = df.groupBy(by, group).agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "test")], *[F.sum(F.when(F.col("split") == s, F.col("label"))).alias(f"p_{s}") for s in ("train", "test")])
    rate = lambda s: F.sum(f"p_{s}") / F.nullif(F.sum(f"n_{s}"), F.lit(0))
    return per.groupBy(by).agg(F.sum("n_train").alias("train_n"), F.sum("n_test").alias("test_n"), F.round(rate("train"), 4).alias("train_pos"), F.round(rate("test"), 4).alias("test_pos"), F.round(F.abs(rate("train") - rate("test")), 4).alias("diff"), F.count_if((F.col("n_train") > 0) & (F.col("n_test") > 0)).alias("group_overlap"), F.count("*").alias("n_groups"))


def leakage_check(df: DataFrame, name: str, side: str = "split") -> DataFrame:
    """Values of `name` on more than one side; empty if nothing leaks."""
    return df.groupBy(name).agg(F.count_distinct(side).alias("n_sides")).filter("n_sides > 1")


def repeated_group_folds(groups: DataFrame, group: str = "grp", k: int = 5, r: int = 5, seed: int = 42) -> DataFrame:
    """(rep, group, fold): in each repetition the distinct groups in a new order, dealt in turn."""
    g = groups.select(group).distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(r - 1))))
    g = nth_by_draw(g, ["rep"], draw(seed, "rep", group), [group])
    return g.select("rep", group, F.pmod(F.col("nth") - 1, F.lit(k)).cast("int").alias("fold"))


def fold_uniqueness(folds: DataFrame, group: str = "grp", first: int = 10) -> DataFrame:
    """How many different assignments the first groups, by name, have over repetitions."""
    few = folds.select(group).distinct().orderBy(group).limit(first)
    per = folds.join(few, group).groupBy("rep").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(group, "fold"))), lambda x: x["fold"].cast("string")), ",").alias("a"))
    return per.agg(F.count_distinct("a").alias("n_unique_folds"), F.count("*").alias("n_reps"))


def _lightest(loads: list[int], size: int, n: int) -> list[int]:
    """How many of n groups of one size each fold gets, if each goes to the lightest fold, ties to the first: those with the n smallest loads before them."""
    upto = lambda top: [max(0, (top - x) // size + 1) for x in loads]
    lo, hi = min(loads) - 1, max(loads) + size * n
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if sum(upto(mid)) >= n else (mid, hi)
    take, at_top = upto(lo), upto(hi)
    left = n - sum(take)
    for i in range(len(loads)):
        if left and at_top[i] > take[i]:
            take[i], left = take[i] + 1, left - 1
    return take


def group_kfold(df: DataFrame, k: int = 5, group: str = "grp", seed: int = 42) -> DataFrame:
    """(group, size, fold): the largest group left goes to the lightest fold; k is at most the number of groups.

    Groups of one size are alike, so only how many of each size a fold gets is worked out one after the other, over the
    distinct sizes, which the driver holds; within a size a hash says which.
    """
    groups = df.groupBy(group).agg(F.count("*").alias("size"))
    sizes = groups.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    folds = min(k, sum(r["n"] for r in sizes))
    loads, rows = [0] * folds, []
    for r in sizes:
        take, bounds = _lightest(loads, r["size"], r["n"]), [0]
        for i, t in enumerate(take):
            loads[i] += t * r["size"]
            bounds.append(bounds[-1] + t)
        rows.append((r["size"], bounds[1:-1]))
    plan = df.sparkSession.createDataFrame(rows, "size long, bounds array<long>")
    placed = nth_by_draw(groups, ["size"], draw(seed, group), [group]).join(plan, "size")
    return placed.select(group, "size", F.size(F.filter("bounds", lambda b: b < F.col("nth"))).alias("fold"))


def stratified_kfold(df: DataFrame, k: int = 5, seed: int = 42, label: str = "label", row: str = "record_id") -> DataFrame:
    return nth_by_draw(df, [label], draw(seed, row), [row], "_nth").withColumn("fold", F.pmod(F.col("_nth") - 1, F.lit(k)).cast("int")).drop("_nth")


def leave_source_out(df: DataFrame, source: str = "domain", least: int = 10) -> DataFrame:
    """(held_out, role, n, n_pos): rows and positives of each source as the test side, and of all others as the training side, by subtraction from the totals; sources with a side of under `least` rows or of one class are left out.

    Membership is a predicate (`role_of`), so rows are never copied once a source.
    """
    g = df.groupBy(source).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    total = g.agg(F.sum("n").alias("_n"), F.sum("p").alias("_p"))
    g = g.crossJoin(F.broadcast(total)).withColumns({"n_rest": F.col("_n") - F.col("n"), "p_rest": F.col("_p") - F.col("p")})  # one row
    fine = (F.col("n") >= least) & (F.col("n_rest") >= least) & (F.col("p") > 0) & (F.col("p") < F.col("n")) & (F.col("p_rest") > 0) & (F.col("p_rest") < F.col("n_rest")) & F.col(source).isNotNull()
    sides = F.explode(F.array(F.struct(F.lit("test").alias("role"), "n", F.col("p").alias("n_pos")), F.struct(F.lit("train").alias("role"), F.col("n_rest").alias("n"), F.col("p_rest").alias("n_pos"))))
    return g.filter(fine).select(F.col(source).alias("held_out"), sides.alias("s")).select("held_out", "s.*")


def role_of(source: str, held_out) -> Column:
    """train or test of a row while one source is held out; rows without a source train."""
    return F.when(F.col(source) == F.lit(held_out), "test").otherwise("train")


def learning_fractions(df: DataFrame, fractions: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5, 0.7, 1.0), fold: str = "fold", seed: int = 42, least: int = 10) -> DataFrame:
    """(fold, fraction, record_id): for each fold and fraction an own draw from its training rows, `least` rows at the least.

    A row is in if its draw isn't above the cut of its fold and fraction, so rows are drawn once and only members leave as
    rows of their own. Cuts come from counts of 4,096 ranges of draws; only the range in which a cut lies is put in order.
    """
    every = [F.struct(F.lit(f).alias("fraction"), draw(seed, F.lit(f).cast("string"), "record_id").alias("draw")) for f in fractions]
    rows = keep(df.select(F.col(fold).alias("fold"), "record_id", F.array(*every).alias("draws")), "draws")
    drawn = rows.select("fold", "record_id", F.explode("draws").alias("d")).select("fold", "record_id", "d.fraction", "d.draw", F.shiftright("d.draw", 20).cast("int").alias("slot"))
    per = W.partitionBy("fold", "fraction")
    slots = drawn.groupBy("fold", "fraction", "slot").agg(F.count("*").alias("k"))
    slots = slots.withColumns({"n": F.sum("k").over(per), "upto": F.sum("k").over(per.orderBy("slot"))})
    slots = slots.withColumn("want", F.least("n", F.greatest(F.floor(F.col("n") * F.col("fraction")), F.lit(least))))
    edge = slots.filter((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("k") < F.col("want")))
    near = drawn.join(F.broadcast(edge.select("fold", "fraction", "slot", (F.col("want") - F.col("upto") + F.col("k")).alias("rest"))), ["fold", "fraction", "slot"])  # one row a fold and fraction
    near = near.withColumn("nth", F.row_number().over(per.orderBy("draw", "record_id"))).filter("nth = rest")
    cuts = near.groupBy("fold").agg(F.collect_list(F.struct("fraction", "draw", "record_id")).alias("cuts"))
    below = lambda d, c: (d["fraction"] == c["fraction"]) & ((d["draw"] < c["draw"]) | ((d["draw"] == c["draw"]) & (F.col("record_id") <= c["record_id"])))
    kept = rows.join(F.broadcast(cuts), "fold").select("fold", "record_id", F.explode(F.filter("draws", lambda d: F.exists("cuts", lambda c: below(d, c)))).alias("d"))
    return kept.select(F.col("fold").alias(fold), "d.fraction", "record_id")
