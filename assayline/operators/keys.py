"""Per-row flags of records, scenarios built from them, and the three versions of a key side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import largest_fragment, n_fragments, normalize_key, tokens, vocab_hits

VOCABULARY = ["and", "das", "de", "der", "die", "el", "la", "le", "les", "los", "of", "que", "the", "und"]
SCENARIOS = ("raw_all", "no_metal", "salt_stripped", "metal_as_feature")


def classify_record(df: DataFrame, text: str = "text", vocab: list[str] | None = None) -> DataFrame:
    """Flags of each record: validity, vocabulary hits, parts, stripped and normal forms, sizes, and the actions that follow."""
    vocab = vocab or VOCABULARY
    raw = F.col(text)
    stripped, normal = largest_fragment(text), normalize_key(text)
    df = df.select("record_id", raw.alias("key_raw"), normal.isNotNull().alias("valid"), vocab_hits(tokens(text), vocab).alias("vocab_hits"), F.coalesce(n_fragments(text), F.lit(0)).alias("n_fragments"), stripped.alias("key_stripped"), normal.alias("key_normal"))
    df = df.withColumns({"valid": F.coalesce("valid", F.lit(False)), "has_vocab": F.coalesce(F.size("vocab_hits") > 0, F.lit(False)), "has_parts": F.col("n_fragments") > 1, "needs_norm": F.coalesce(F.col("key_raw") != F.col("key_normal"), F.lit(False)), "size_raw": F.length("key_raw"), "size_after": F.length("key_stripped")})
    steps = [(~F.col("valid"), "drop_invalid"), (F.col("has_vocab"), "flag_vocab"), (F.col("has_parts"), "strip_parts"), (F.col("needs_norm"), "normalize")]
    actions = F.filter(F.array(*[F.when(c, F.lit(a)) for c, a in steps]), lambda x: x.isNotNull())
    return df.withColumns({"size_change": F.col("size_after") - F.col("size_raw"), "actions": F.when(F.size(actions) == 0, F.array(F.lit("none"))).otherwise(actions)})


def apply_scenario(df: DataFrame, scenario: str, flags: DataFrame, key: str = "key") -> DataFrame:
    """df (record_id, key, ...) as a scenario has it; flags: record_id, has_vocab, key_stripped. A record without flags counts as not flagged."""
    if scenario not in SCENARIOS:
        raise ValueError(f"unknown scenario {scenario!r}")
    df = df.join(flags.select("record_id", "has_vocab", "key_stripped"), "record_id", "left").withColumn("has_vocab", F.coalesce("has_vocab", F.lit(False)))
    if scenario == "no_metal":
        df = df.filter(~F.col("has_vocab"))
    if scenario == "salt_stripped":
        df = df.withColumn(key, F.coalesce("key_stripped", key))
    if scenario == "metal_as_feature":
        return df.withColumn("vocab_feature", F.col("has_vocab").cast("int")).drop("has_vocab", "key_stripped")
    return df.drop("has_vocab", "key_stripped")


def count_changed(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """How many records have another key after a scenario."""
    b = after.select("record_id", F.col(key).alias("_after"))
    return before.join(b, "record_id").agg(F.count_if(F.col(key) != F.col("_after")).alias("n_changed"))


def build_scenarios(df: DataFrame) -> DataFrame:
    """Five variants of classified records (with label) in one pass: record_id, label, scenario, key, vocab_feature, parts_feature."""
    one = lambda name, key, when: F.when(when, F.struct(F.lit(name).alias("scenario"), key.alias("key")))
    raw, stripped = F.col("key_raw"), F.coalesce("key_stripped", "key_raw")
    rows = F.array(
        one("raw_all", raw, F.lit(True)), one("no_metal", raw, ~F.col("has_vocab")), one("salt_stripped", stripped, F.lit(True)),
        one("full_preprocess", F.col("key_normal"), F.col("valid") & ~F.col("has_vocab")), one("metal_as_feature", raw, F.lit(True)),
    )
    out = df.select("record_id", "label", "has_vocab", "has_parts", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("s"))
    feature = lambda c: F.when(F.col("s.scenario") == "metal_as_feature", F.col(c).cast("int"))
    return out.select("record_id", "label", "s.scenario", "s.key", feature("has_vocab").alias("vocab_feature"), feature("has_parts").alias("parts_feature"))


def scenario_sizes(scenarios: DataFrame) -> DataFrame:
    return scenarios.groupBy("scenario").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))


def preprocessing_views(df: DataFrame, key: str = "key") -> DataFrame:
    """Raw, canonical and standardized keys, whether each is valid, repeated, and in conflict. Null keys are never either."""
    df = df.withColumns({"raw_key": F.col(key), "raw_valid": F.col(key).isNotNull(), "canonical_key": normalize_key(key)})
    df = df.withColumn("standardized_key", normalize_key(largest_fragment("canonical_key", "|")))
    for v in ("canonical", "standardized"):
        k = f"{v}_key"
        g = df.filter(F.col(k).isNotNull()).groupBy(k).agg((F.count("*") > 1).alias(f"{v}_dup"), (F.min("label") < F.max("label")).alias(f"{v}_label_conflict"))
        df = df.withColumn(f"{v}_valid", F.col(k).isNotNull()).join(g, k, "left").withColumns({f"{v}_dup": F.coalesce(f"{v}_dup", F.lit(False)), f"{v}_label_conflict": F.coalesce(f"{v}_label_conflict", F.lit(False))})
    return df


def training_view(views: DataFrame, version: str, *, drop_invalid: bool = True, drop_duplicates: bool = False, drop_conflicts: bool = False) -> DataFrame:
    """record_id, key, label of one version; duplicates go before conflicts do, and the first row of a key stays."""
    k = f"{version}_key"
    df = views
    if drop_invalid:
        df = df.filter(f"{version}_valid")
    if drop_duplicates:
        df = df.groupBy(F.struct(k).alias("_k")).agg(F.min_by(F.struct(*df.columns), "record_id").alias("_first")).select("_first.*")
    if drop_conflicts:
        df = df.filter(~F.col(f"{version}_label_conflict"))
    return df.select("record_id", F.col(k).alias("key"), "label").na.drop(subset=["key", "label"])


def summarize_views(views: DataFrame, dataset: str) -> DataFrame:
    """One row per dataset: totals, valid, unique and conflicting keys, share of positives."""
    return views.groupBy(F.col(dataset).alias("dataset")).agg(
        F.count("*").alias("n_total"), *[F.count_if(F.col(f"{v}_valid")).alias(f"{v}_valid_n") for v in ("raw", "canonical", "standardized")],
        *[F.count_distinct(f"{v}_key").alias(f"{v}_unique") for v in ("canonical", "standardized")], *[F.count_if(F.col(f"{v}_label_conflict")).alias(f"{v}_conflicts") for v in ("canonical", "standardized")],
        F.round(F.avg("label"), 4).alias("positive_ratio"),
    )
