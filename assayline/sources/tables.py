"""Reading, checking and writing tables of labelled records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS = T.StructType([T.StructField("record_id", T.LongType()), T.StructField("key", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("domain", T.StringType()), T.StructField("grp", T.StringType()), T.StructField("text", T.StringType())])
ALIASES = {"record_id": ["record_id", "No", "id"], "key": ["analysis_key", "key", "SMILES", "smiles"], "label": ["label", "Label", "y", "target"], "domain": ["domain", "source"], "grp": ["grp", "group", "scaffold"]}
#: Prefixes of column names, by block of features.
BLOCKS = {"fingerprint": ("fp_",), "alert": ("kz_", "iss_", "mn_", "bb_"), "functional_group": ("fg_",), "physchem": ("desc_", "mw"), "qm": ("qm_",)}
META = ("record_id", "no", "smiles", "key", "label", "domain", "source", "grp", "split", "text")


def load_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table by its ending: .csv (with header) or .parquet."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return (reader.schema(schema) if schema else reader).csv(path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    raise ValueError(f"neither .csv nor .parquet: {path}")


def coalesce_aliases(df: DataFrame, aliases: list[str], name: str) -> DataFrame:
    """The first non-null of the aliases that df has, in their order (names match whatever their case), as `name`; the others go."""
    have = {c.lower(): c for c in df.columns}
    found = list(dict.fromkeys(have[a.lower()] for a in aliases if a.lower() in have))
    if not found:
        raise ValueError(f"none of {aliases} in {df.columns}")
    return df.withColumn("_alias", F.coalesce(*[F.col(c) for c in found])).drop(*found).withColumnRenamed("_alias", name)


def normalize_schema(df: DataFrame, endpoint: str | None = None, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Names by alias, an integer label, no rows without key or label, and the endpoint's name."""
    for name, alias in (aliases or ALIASES).items():
        if any(a.lower() in map(str.lower, df.columns) for a in alias):
            df = coalesce_aliases(df, alias, name)
    df = df.withColumn("label", F.col("label").cast("string").try_cast("double").cast("int")).na.drop(subset=["key", "label"])
    return df if endpoint is None else df.withColumn("endpoint", F.lit(endpoint))


def write_table(df: DataFrame, path: str, form: str = "parquet", by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    writer = writer.partitionBy(*by) if by else writer
    (writer.option("header", True).option("escape", '"').csv if form == "csv" else writer.parquet)(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def scan_experiments(spark: SparkSession, run_dir: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The tables `name` of all experiments below run_dir, each row tagged with its experiment's folder."""
    form = "csv" if name.endswith(".csv") else "json" if name.endswith(".json") else "parquet"
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).format(form).load(f"{run_dir}/*/{name}")
    return df.withColumn("experiment", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/" + name.replace(".", r"\.") + r"(?:/[^/]*)?$", 1))


def content_fingerprint(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """A hash of the rows of each `by`, whatever their order: 16 hex digits of the sum and count of row hashes.

    Row hashes are 12 hex digits of sha256, added as whole numbers of up to 38 digits, so that rows are combined before a shuffle, no group is collected and no group is too large for its sum.
    """
    row = F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 12), 16, 10).cast("decimal(28,0)")
    total = F.sum(row).cast("string")
    return df.groupBy(by).agg(F.count("*").alias("n"), F.substring(F.sha2(F.concat_ws("|", total, F.count("*").cast("string")), 256), 1, 16).alias("fingerprint"))


def audit_dataset(df: DataFrame, by: str = "endpoint") -> DataFrame:
    """Per endpoint: rows, classes, share of positives, nulls of the key columns, groups and domains."""
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("key", "label", "grp")]
    rates = [F.round(F.lit(100.0) * F.count_if(F.col(c).isNull()) / F.count("*"), 2).alias(f"null_pct_{c}") for c in ("key", "label", "grp")]
    return df.groupBy(by).agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"), F.round(F.avg("label"), 4).alias("pos_rate"),
        *nulls, *rates, F.count_distinct("grp").alias("n_groups"), F.count_distinct("domain").alias("n_domains"), F.count_distinct("key").alias("n_keys"),
    )


def classify_columns(df: DataFrame, most: int = 100) -> DataFrame:
    """(column, role): meta by name; a string column with more than `most` values is excluded, one of numbers is a feature."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name.lower() not in META]
    aggs = [F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(texts)] + [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(f"b{i}") for i, c in enumerate(texts)]
    seen = df.agg(*aggs).first() if texts else None
    rows = []
    for f in df.schema:
        if f.name.lower() in META:
            role = "meta"
        elif f.name in texts:
            i = texts.index(f.name)
            role = "feature" if seen[f"b{i}"] == 0 else "excluded" if seen[f"d{i}"] > most else "meta"
        else:
            role = "feature" if isinstance(f.dataType, (T.NumericType, T.BooleanType)) else "excluded"
        rows.append((f.name, role))
    return df.sparkSession.createDataFrame(rows, "column string, role string")


def separate_num_cat(df: DataFrame, cols: list[str]) -> tuple[list[str], list[str]]:
    """Columns of numbers (by type, or texts that all are numbers) and the others."""
    texts = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    bad = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull()).alias(c) for c in texts]).first() if texts else {}
    num = [c for c in cols if (c in texts and bad[c] == 0) or isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]
    return num, [c for c in cols if c not in num]


def drop_high_cardinality(df: DataFrame, most: int = 50, keep: tuple[str, ...] = META) -> DataFrame:
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name.lower() not in keep]
    if not texts:
        return df
    seen = df.agg(*[F.count_distinct(c).alias(c) for c in texts]).first()
    return df.drop(*[c for c in texts if seen[c] > most])


def block_of(c) -> F.Column:
    """The block of a feature by its name."""
    out = F.lit("other")
    for block, prefixes in reversed(BLOCKS.items()):
        is_block = F.lit(False)
        for p in prefixes:
            is_block = is_block | F.startswith(c, F.lit(p))
        out = F.when(is_block, block).otherwise(out)
    return out


def feature_block_counts(long: DataFrame) -> DataFrame:
    """From (endpoint, feature, value): features and cells that aren't 0, by endpoint and block."""
    return long.groupBy("endpoint", block_of(F.col("feature")).alias("block")).agg(F.count_distinct("feature").alias("n_features"), F.count_if(F.col("value") != 0).alias("n_nonzero"))
