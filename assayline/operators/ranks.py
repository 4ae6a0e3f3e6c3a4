"""Ranks, running sums and percentiles for groups of any size: rows are dealt to ranges, ranges to tasks, and what lies before a range is added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.plans.shared import keep


def nth_by_draw(df: DataFrame, by: list[str], order: Column, ties: list[str], name: str = "nth", bucket_rows: int = 20_000) -> DataFrame:
    """df with `name`, the number from 1 of each row in its group by (order, ties), order being a draw from [0, 2**32).

    The same as row_number over one window a group, but a group's draws are cut into ranges of about bucket_rows rows (4,096
    ranges at the most): rows are numbered within a range, and ranges by the counts of those before, so a hot group is spread
    over many tasks. One count of narrow slots gives the ranges and what lies before them. Null is a group like others.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0))
    rows = df.withColumns({"_key": key, "_draw": order}).withColumn("_slot", F.shiftright("_draw", 20).cast("int"))
    own = W.partitionBy("_key")
    slots = rows.groupBy("_key", "_slot").agg(F.count("*").alias("_k"))
    slots = slots.select("_key", "_slot", F.sum("_k").over(own).alias("_size"), (F.sum("_k").over(own.orderBy("_slot")) - F.col("_k")).alias("_ahead"))
    bits = F.least(F.lit(12), F.ceil(F.log2(F.ceil(F.col("_size") / F.lit(bucket_rows))))).cast("int")
    slots = slots.withColumn("_bits", bits).withColumn("_bucket", F.expr("shiftright(_slot, 12 - _bits)"))
    slots = slots.select("_key", "_slot", "_bucket", F.min("_ahead").over(W.partitionBy("_key", "_bucket")).alias("_ahead"))
    inside = F.row_number().over(W.partitionBy("_key", "_bucket").orderBy("_draw", *ties))
    rows = rows.join(slots, ["_key", "_slot"]).withColumn("_inside", inside)
    return rows.withColumn(name, (F.col("_inside") + F.col("_ahead")).cast("long")).drop("_key", "_draw", "_slot", "_bucket", "_inside", "_ahead")


def in_ranges(df: DataFrame, by: list[str], *order: Column | str, parts: int | None = None) -> DataFrame:
    """df with _key, its group, and _part, numbers of ranges that ascend in (group, order). Spark samples the cuts; the table is written, so that they stay.

    Without `parts` there are as many ranges as spark.sql.shuffle.partitions says, small ones put together up to
    spark.sql.adaptive.advisoryPartitionSizeInBytes.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0))
    rows = df.withColumn("_key", key)
    ranged = rows.repartitionByRange(parts, "_key", *order) if parts else rows.repartitionByRange("_key", *order)
    return keep(ranged.withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, by: list[str], order: list[Column | str], sums: dict[str, str], totals: dict[str, str] | None = None) -> DataFrame:
    """df with, for each (name, column) of sums, the sum of the column over the rows of the group up to this one, by order, which must tell rows apart; and for each of totals the sum over the group.

    As sums over one window a group, but no task holds more than a range of it: sums are taken within ranges, and ranges
    are offset by the sums of those before, of which there is one row each.
    """
    totals = totals or {}
    rows = in_ranges(df, by, *order)
    parts = rows.groupBy("_key", "_part").agg(*[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()], *[F.sum(c).alias(f"_t_{n}") for n, c in totals.items()])
    own = W.partitionBy("_key")
    before = own.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("_key", "_part", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums], *[F.sum(f"_t_{n}").over(own).alias(n) for n in totals])
    inside = W.partitionBy("_key", "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({f"_i_{n}": F.sum(c).over(inside) for n, c in sums.items()}).join(parts, ["_key", "_part"])
    return rows.withColumns({n: F.col(f"_i_{n}") + F.col(f"_o_{n}") for n in sums}).drop("_key", "_part", *[f"_{x}_{n}" for n in sums for x in "io"])


def percentiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(by, names): for each name of wanted the exact percentile (column, share) of its group, as percentile() gives it; nulls don't count.

    Distinct values are counted before anything is ordered, and what is kept for a group is the two values next to each
    rank, so memory doesn't grow with rows. A group without any value has no row.
    """
    columns = sorted({c for c, _ in wanted.values()})
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_v")) for c in columns])).alias("_x")).select(*by, "_x._c", "_x._v").filter("_v is not null")
    counts = long.groupBy(*by, "_c", "_v").agg(F.count("*").alias("_n"))
    ranked = running(counts, [*by, "_c"], ["_v"], {"_upto": "_n"}, {"_all": "_n"})
    out = []
    for name, (c, q) in wanted.items():
        at = F.lit(float(q)) * (F.col("_all") - 1)
        low, high = [F.min(F.when((F.col("_c") == c) & (F.col("_upto") > f(at)), F.col("_v"))).alias(f"_{n}_{name}") for n, f in (("low", F.floor), ("high", F.ceil))]
        out += [low, high, F.max(F.when(F.col("_c") == c, at)).alias(f"_at_{name}")]
    found = ranked.groupBy(*by).agg(*out)

    def between(name: str) -> Column:
        at, low, high = F.col(f"_at_{name}"), F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when((F.floor(at) == F.ceil(at)) | (low == high), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return found.select(*by, *[between(name) for name in wanted])
