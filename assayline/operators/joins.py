"""Joins: side tables, nearest neighbours by bits or distance, pairs of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators.nearest import Euclid, Jaccard, search


def join_left(df: DataFrame, aux: DataFrame, on: str = "record_id", suffix: str = "_aux") -> DataFrame:
    """Left join; aux columns that df has too get a suffix."""
    return df.join(aux.select(*[F.col(c).alias(c + suffix) if c in df.columns and c != on else F.col(c) for c in aux.columns]), on, "left")


def coalesce_join_columns(df: DataFrame, suffix: str = "_aux") -> DataFrame:
    """After join_left: df's own value wins over its twin's, and the twin goes; a twin without a base column takes its name."""
    for c in [c for c in df.columns if c.endswith(suffix)]:
        base = c.removesuffix(suffix)
        df = df.withColumn(base, F.coalesce(base, c)).drop(c) if base in df.columns else df.withColumnRenamed(c, base)
    return df


def merge_rate(df: DataFrame, cols: list[str]) -> DataFrame:
    """The share of rows in which any of cols isn't null."""
    return df.agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.coalesce(*cols).isNotNull(), 1.0).otherwise(0.0)), 4).alias("merge_rate"))


def tanimoto_max(train: DataFrame, test: DataFrame, bits: str = "bits") -> DataFrame:
    """(record_id, max_sim) of each test row: its largest |A and B| / |A or B| with a train row; 0 if no bit is shared, or without bits.

    One less this similarity is a metric, so the search is that of `nearest`; equal sets of train rows are one.
    """
    sets = train.filter(F.size(bits) > 0).select(F.array_sort(bits).alias("_bits")).distinct().select(F.xxhash64("_bits").alias("record_id"), "_bits")
    mine = test.filter(F.size(bits) > 0).select("record_id", F.col(bits).alias("_bits"))
    most = sets.select("_bits").unionAll(mine.select("_bits")).agg(F.max(F.array_max("_bits")).alias("most")).first()["most"]
    found, _ = search(mine, sets, 1, Jaccard(1 + int(most or 0)), "_bits", apart=False)
    found = found.select(F.col("record_id").alias("_id"), F.col("value").alias("_sim"))
    return test.select("record_id").join(found, F.col("record_id") == F.col("_id"), "left").select("record_id", F.coalesce("_sim", F.lit(0.0)).alias("max_sim"))


def squared_distance(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)


def knn(left: DataFrame, right: DataFrame, k: int = 1, v: str = "v") -> DataFrame:
    """(record_id, neighbour, dist, nth): of each left row its k nearest right rows other than itself, exactly; ties to the smaller id."""
    return search(left, right, k, Euclid(), v)[0].drop("value")


def euclid_nn(train: DataFrame, test: DataFrame, v: str = "v") -> DataFrame:
    """(record_id, nn_dist): distance of each test row to the nearest train row other than itself, all of which are looked at through pivots."""
    return knn(test, train, 1, v).select("record_id", F.col("dist").alias("nn_dist"))


def pair_experiments(rows: DataFrame, by: str, name: str, value: str, tile: int = 1024) -> DataFrame:
    """All pairs of a group's rows, in name order.

    Rows of a group are dealt to parts of about `tile` rows by a hash of the name, and two parts meet in a tile of their own,
    so that each pair is looked at once and a large group is spread over many tasks.
    """
    known = rows.select(by, F.col(name).alias("_n"), F.col(value).alias("_v")).filter(F.col(by).isNotNull() & F.col("_n").isNotNull())
    sizes = known.groupBy(by).agg(F.count("*").alias("_k"))
    n = sizes.agg(F.coalesce(F.sum(F.col("_k").cast("double") * F.col("_k") / 2), F.lit(0.0)).alias("pairs")).first()["pairs"]
    dealt = known.join(sizes.select(by, F.ceil(F.col("_k") / tile).alias("_parts")), by)
    part = F.pmod(F.xxhash64("_n"), F.col("_parts"))
    dealt = dealt.withColumn("_p", part).select(by, "_n", "_v", "_parts", "_p")
    first = dealt.select(by, F.col("_p").alias("_i"), F.explode(F.sequence("_p", F.col("_parts") - 1)).alias("_j"), F.col("_n").alias("_na"), F.col("_v").alias("_va"))
    second = dealt.select(by, F.explode(F.sequence(F.lit(0).cast("long"), "_p")).alias("_i"), F.col("_p").alias("_j"), F.col("_n").alias("_nb"), F.col("_v").alias("_vb"))
    if n > tile * tile:  # a fixed number of tasks, as rows are few for the pairs that they make
        tasks, keys = int(min(20_000, 8 + n // (4 * tile * tile))), [by, "_i", "_j"]
        first, second = first.repartition(tasks, *keys), second.repartition(tasks, *keys)
    met = first.join(second, [by, "_i", "_j"]).filter((F.col("_i") < F.col("_j")) | (F.col("_na") < F.col("_nb")))  # equal names are in one part
    least = F.col("_na") < F.col("_nb")
    pick = lambda a, b: F.when(least, F.col(a)).otherwise(F.col(b))
    return met.select(by, pick("_na", "_nb").alias("model_a"), pick("_va", "_vb").alias("value_a"), pick("_nb", "_na").alias("model_b"), pick("_vb", "_va").alias("value_b"))


def lookup_ref_row(rows: DataFrame, ref: DataFrame, on: list[str], order: str) -> DataFrame:
    """Attach the first reference row of the same keys."""
    rest = [c for c in ref.columns if c not in on]
    first = ref.groupBy(*on).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*on, *[F.col(f"_r.{c}").alias(f"ref_{c}") for c in rest])
    return rows.join(first, on, "left")
