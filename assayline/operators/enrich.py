"""Association of flags and sources with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import fisher_exact_p, ratio


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a * d / (b * c); null if b * c is 0."""
    return ratio(a.cast("double") * d, b.cast("double") * c)


def recommendation(category: Column, er: Column) -> Column:
    """What to do about a category, by its enrichment of positives."""
    return F.when(er.isNull(), "no affected records").when(er > 1.5, F.concat(F.lit("keep "), category, F.lit(" as a feature: positives are enriched"))).when(er < 0.5, F.concat(F.lit("consider dropping "), category, F.lit(": positives are depleted"))).otherwise(F.lit("no action needed"))


def impact_stats(df: DataFrame, categories: dict[str, Column], with_p: bool = False) -> DataFrame:
    """Per category of rows: size and share, positives and negatives, rate, its ratio to the overall rate, odds ratio. A category without rows stays, with zeros.

    All categories are counted in one pass.
    """
    flags = F.array(*[F.struct(F.lit(n).alias("category"), F.coalesce(c, F.lit(False)).alias("flag")) for n, c in categories.items()])
    rows = df.select("label", F.explode(flags).alias("f")).groupBy("f.category").agg(
        F.count("*").alias("n"), F.count_if("f.flag").alias("n_affected"), F.count_if(F.col("f.flag") & (F.col("label") == 1)).alias("n_pos"), F.count_if(F.col("f.flag") & (F.col("label") == 0)).alias("n_neg"),
        F.count_if(F.col("label") == 1).alias("all_pos"), F.count_if(F.col("label") == 0).alias("all_neg"),
    )
    rate, overall = ratio(F.col("n_pos"), F.col("n_pos") + F.col("n_neg")), ratio(F.col("all_pos"), F.col("all_pos") + F.col("all_neg"))
    cells = (F.col("n_pos"), F.col("n_neg"), F.col("all_pos") - F.col("n_pos"), F.col("all_neg") - F.col("n_neg"))
    out = rows.select(
        "category", "n_affected", F.round(F.lit(100.0) * F.col("n_affected") / F.col("n"), 2).alias("pct_of_total"), "n_pos", "n_neg", F.round(F.coalesce(rate, F.lit(0.0)), 4).alias("pos_rate"),
        F.round(overall, 4).alias("overall_pos_rate"), F.round(F.coalesce(rate / F.nullif(overall, F.lit(0.0)), F.lit(0.0)), 3).alias("enrichment_ratio"), F.round(odds_ratio(*cells), 4).alias("odds_ratio"), *([fisher_exact_p(*cells).alias("fisher_p")] if with_p else []),
    )
    return out.withColumn("recommendation", recommendation(F.col("category"), F.when(F.col("n_affected") > 0, F.col("enrichment_ratio"))))


def element_distribution(df: DataFrame, hits: str = "vocab_hits") -> DataFrame:
    return df.select(F.explode(hits).alias("element")).groupBy("element").agg(F.count("*").alias("n"))


def vocab_detail(df: DataFrame) -> DataFrame:
    """Records with vocabulary hits, with their sizes."""
    return df.filter("has_vocab").select("record_id", F.array_join("vocab_hits", ",").alias("hits"), "size_raw", "size_after", "size_change")


def multipart_detail(df: DataFrame) -> DataFrame:
    return df.filter("has_parts").select("record_id", "n_fragments", "size_raw", "size_after", "size_change")


def source_rates(df: DataFrame, source: str = "domain") -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), F.round(F.avg("label"), 4).alias("pos_rate"))


def domain_confounding(df: DataFrame, source: str = "domain") -> DataFrame:
    """Sources, accuracy of each source's majority label, and the ratio of the largest to the smallest rate (of rounded rates)."""
    r = source_rates(df, source)
    return r.agg(F.count("*").alias("n_sources"), F.round(F.sum(F.when(F.col("pos_rate") > 0.5, F.col("n_pos")).otherwise(F.col("n") - F.col("n_pos"))) / F.sum("n"), 4).alias("source_only_accuracy"), F.round(F.max("pos_rate") / F.greatest(F.min("pos_rate"), F.lit(0.001)), 1).alias("enrichment"))


def naive_source_classifier(df: DataFrame, source: str = "domain") -> DataFrame:
    """Confusion counts, MCC and balanced accuracy of predicting a source's side of the overall rate."""
    from assayline.operators.metrics import score_columns

    r = df.groupBy(source).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    total = r.agg((F.sum("p") / F.sum("n")).alias("rate"))
    x = r.crossJoin(F.broadcast(total)).withColumn("up", F.col("p") / F.col("n") > F.col("rate"))
    neg = F.col("n") - F.col("p")
    cells = x.agg(F.sum(F.when(F.col("up"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("up"), neg).otherwise(0)).alias("fp"), F.sum(F.when(~F.col("up"), F.col("p")).otherwise(0)).alias("fn"), F.sum(F.when(~F.col("up"), neg).otherwise(0)).alias("tn"))
    return score_columns(cells).select("tp", "fp", "fn", "tn", "mcc", "bacc")
