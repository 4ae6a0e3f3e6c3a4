"""Input views over the given tables: labelled records, labelled documents, predictions, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions.columns import draw
from assayline.plans.shared import keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("record_id"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("key"), (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_orderpriority").alias("domain"), F.col("o_custkey").cast("string").alias("grp"), F.concat(F.lit("e"), (F.col("o_orderkey") % 3).cast("string")).alias("endpoint"), F.col("o_totalprice").alias("price"),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("label"))
    d = table(spark, sf_dir, "documents").join(marks, "doc_id", "left")
    return d.select(F.col("doc_id").alias("record_id"), "text", "label", F.col("lang").alias("domain"), F.col("source").alias("grp"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.round(F.col("l_discount") * 10, 1).alias("proba"), F.col("l_linestatus").alias("experiment"), F.col("l_suppkey").cast("string").alias("grp"), (F.col("l_quantity") / 50).alias("proba_b"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("record_id"), (F.col("event_type") == "purchase").cast("int").alias("label"), F.least(F.col("value") / 500, F.lit(1.0)).alias("proba"),
        F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("experiment"), (draw("event_id") / F.lit(4294967296.0)).alias("proba_b"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("record_id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("label") >= 5).cast("int").alias("label"), F.when(F.col("vec_id") % 5 != 0, "train").otherwise("test").alias("split"))


def bits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Train and test documents with the hashed bits of the words of their whole texts."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.array_distinct(F.transform(F.array_distinct(F.split("text", " ")), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("long"), F.lit(4096)))).alias("bits"))
    d = keep(d, "bits")  # hashed once; read several times
    return d.filter("record_id % 5 <> 0"), d.filter("record_id % 5 = 0")
