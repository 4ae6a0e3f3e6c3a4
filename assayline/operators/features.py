"""Features: pattern counts, descriptors, hashed bits and their train-only selection, standard scores, correlations."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.functions.columns import col, ratio, student_p
from assayline.operators.ranks import running

#: name -> (family, pattern). Fixed values that Java's and RE2's dialects read alike.
PATTERNS = {
    "digits": ("num", "[0-9]+"), "money": ("num", "[$€]"), "email": ("mark", "@"), "url": ("mark", "https?://"), "quote": ("mark", '"'), "bar": ("mark", "[|]"), "junk": ("mark", "[%#*&$]{2,}"),
    "the": ("word", "(^|[^A-Za-z])[Tt]he([^A-Za-z]|$)"), "der": ("word", "(^|[^A-Za-z])[Dd]er([^A-Za-z]|$)"), "les": ("word", "(^|[^A-Za-z])[Ll]es([^A-Za-z]|$)"), "que": ("word", "(^|[^A-Za-z])[Qq]ue([^A-Za-z]|$)"), "caps": ("shape", "[A-Z]{3,}"),
}
#: endpoint (here: language) -> its alert patterns.
ALERTS = {"en": ["the", "email", "junk"], "de": ["der", "digits"], "fr": ["les", "bar"], "es": ["que", "junk"]}


def pattern_counts(df: DataFrame, text: str = "text", patterns: dict | None = None, keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """Per pattern how often it matches, and whether at all, twice, three times: <name>_count, _present, _ge2, _ge3."""
    out = [F.col(c) for c in keep]
    for name, (_, p) in (patterns or PATTERNS).items():
        n = F.coalesce(F.regexp_count(col(text), F.lit(p)), F.lit(0))
        out += [n.alias(f"{name}_count")]
    df = df.select(*out)
    extra = [(F.col(f"{n}_count") >= k).cast("int").alias(f"{n}_{s}") for n in (patterns or PATTERNS) for k, s in ((1, "present"), (2, "ge2"), (3, "ge3"))]
    return df.select("*", *extra)


def alert_aggregates(counts: DataFrame, endpoint: str, alerts: dict[str, list[str]] | None = None) -> DataFrame:
    """n_alerts (all matches of the endpoint's alerts), any_alert, alert_score (how many of them match)."""
    alerts = alerts or ALERTS
    total = score = F.lit(0)
    for e, names in alerts.items():
        here = F.col(endpoint) == e
        total = F.when(here, sum((F.col(f"{n}_count") for n in names), F.lit(0))).otherwise(total)
        score = F.when(here, sum((F.col(f"{n}_present") for n in names), F.lit(0))).otherwise(score)
    return counts.withColumns({"n_alerts": total, "any_alert": (total > 0).cast("int"), "alert_score": score})


def text_descriptors(df: DataFrame, text: str = "text") -> DataFrame:
    """Shape of a text in numbers; all null where the text is null."""
    t, words = F.col(text), F.filter(F.split(F.col(text), " "), lambda w: w != "")
    n = F.length(t)
    return df.select(
        "record_id", n.alias("length"), F.size(words).alias("tokens"), F.size(F.array_distinct(words)).alias("distinct_tokens"), F.regexp_count(t, F.lit("[0-9]")).alias("digits"), F.regexp_count(t, F.lit("[A-Z]")).alias("upper"),
        F.regexp_count(t, F.lit("[.,;:!?]")).alias("punct"), (F.regexp_count(t, F.lit("\n")) + 1).alias("lines"), F.round(ratio(n, F.size(words)), 6).alias("mean_token"), F.round(ratio(F.size(F.array_distinct(words)), F.size(words)), 6).alias("distinct_ratio"),
    )


def hashed_shingle_bits(df: DataFrame, text: str = "text", width: int = 2, n_bits: int = 1024) -> DataFrame:
    """(record_id, bits): positions of the bits that the hashes of word shingles up to `width` set, sorted."""
    df = df.withColumn("_g1", F.filter(F.split(F.lower(F.col(text)), " "), lambda w: w != ""))
    n = F.size("_g1")
    for k in range(2, width + 1):  # each width from the one below it and the words shifted, so a text is passed over once per width
        longer = F.zip_with(F.slice(f"_g{k - 1}", F.lit(1), n - k + 1), F.slice("_g1", F.lit(k), n - k + 1), lambda a, b: F.concat_ws(" ", a, b))
        df = df.withColumn(f"_g{k}", F.when(n >= k, longer).otherwise(F.array(F.array_join("_g1", " "))))
    grams = [F.col(f"_g{k}") for k in range(1, width + 1)]
    bit = lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long"), F.lit(n_bits)).cast("int")
    return df.withColumn("bits", F.array_sort(F.array_distinct(F.transform(F.array_distinct(F.concat(*grams)), bit)))).drop(*[f"_g{k}" for k in range(1, width + 1)])


def bit_counts(bits: DataFrame, label: str | None = None) -> DataFrame:
    """(bit, k, k1, n, n1): rows that have a bit, of them positive, and all rows and positives."""
    y = F.col(label) if label else F.lit(0)
    total = bits.agg(F.count("*").alias("n"), F.sum(y).alias("n1"))
    return bits.select(y.alias("y"), F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("k"), F.sum("y").alias("k1")).crossJoin(total)


def bit_prevalence_filter(bits: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Bits that between 1 % and 99 % of the rows have; pass training rows only."""
    return bit_counts(bits).withColumn("prevalence", F.col("k") / F.col("n")).filter((F.col("prevalence") >= low) & (F.col("prevalence") <= high)).select("bit", F.round("prevalence", 6).alias("prevalence"))


def select_bits_variance(bits: DataFrame, k: int) -> DataFrame:
    """The k bits of the largest sample variance, the smaller of equals."""
    p = F.col("k") / F.col("n")
    v = F.round(p * (1 - p) * F.col("n") / (F.col("n") - 1), 9)
    return bit_counts(bits).select("bit", v.alias("variance")).orderBy(F.desc("variance"), "bit").limit(k)


def select_bits_mi(bits: DataFrame, k: int, label: str = "label") -> DataFrame:
    """The k bits of the largest mutual information with the label, from their 2x2 counts. (Exact and discrete; a neighbour-based estimator gives other values.)"""
    n = F.col("n").cast("double")
    cells = [(F.col("k1"), F.col("k"), F.col("n1")), (F.col("k") - F.col("k1"), F.col("k"), F.col("n") - F.col("n1")), (F.col("n1") - F.col("k1"), F.col("n") - F.col("k"), F.col("n1")), (F.col("n") - F.col("k") - F.col("n1") + F.col("k1"), F.col("n") - F.col("k"), F.col("n") - F.col("n1"))]
    mi = sum((F.when(c > 0, c / n * F.log(c * n / (a.cast("double") * b))).otherwise(F.lit(0.0)) for c, a, b in cells), F.lit(0.0))
    return bit_counts(bits, label).select("bit", F.round(mi, 9).alias("mi")).orderBy(F.desc("mi"), "bit").limit(k)


def feature_modes(df: DataFrame, modes: dict[str, list[str]]) -> DataFrame:
    """A vector column per mode, named after it; missing numbers are 0."""
    used = list(dict.fromkeys(c for cols in modes.values() for c in cols))
    df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in used})
    for name, cols in modes.items():
        df = VectorAssembler(inputCols=cols, outputCol=name).transform(df)
    return df


def bit_modes(df: DataFrame, cols: list[str], sizes: tuple[int, ...] = (512, 1024, 2048), text: str = "text") -> DataFrame:
    """df with a vector column fp<n> for each size: the numbers of cols, missing ones 0, and n bits of word shingles after them. Vectors are sparse, so a mode costs what is set."""
    numbers = VectorAssembler(inputCols=cols, outputCol="_numbers")
    df = numbers.transform(df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}))
    for n in sizes:
        df = hashed_shingle_bits(df, text, n_bits=n)
        names = F.transform(F.coalesce("bits", F.array().cast("array<int>")), lambda b: b.cast("string"))
        flags = CountVectorizerModel.from_vocabulary([str(i) for i in range(n)], inputCol="_names", outputCol="_flags").setBinary(True)
        df = flags.transform(df.withColumn("_names", names))
        df = VectorAssembler(inputCols=["_numbers", "_flags"], outputCol=f"fp{n}").transform(df).drop("_names", "_flags", "bits")
    return df.drop("_numbers")


def standardize(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """z-scores with the population's standard deviation; 0 for null, and for a column that doesn't vary."""
    stats = df.agg(*[f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    df = df.crossJoin(F.broadcast(stats))  # one row
    z = {c: F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in cols}
    return df.withColumns(z).drop(*stats.columns)


def label_correlation(df: DataFrame, cols: list[str], label: str = "label", with_p: bool = False) -> DataFrame:
    """(feature, rho, n): Spearman's rank correlation with the label, ties at their mean rank, null for a constant; with_p adds the two-sided p of Student's t with n - 2 degrees of freedom.

    Ranks come from counts per distinct value, in ranges of values.
    """
    long = df.select(F.col(label).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])).alias("f")).select("y", "f.*").filter("x is not null and y is not null")
    c = long.groupBy("feature", "x", "y").agg(F.count("*").alias("k"))

    def mean_rank(v: str) -> DataFrame:
        g = c.groupBy("feature", v).agg(F.sum("k").alias("m"))
        return running(g, ["feature"], [v], {"upto": "m"}).select("feature", v, (F.col("upto") - F.col("m") + (F.col("m") + 1) / 2).alias(f"r{v}"))

    r = c.join(mean_rank("x"), ["feature", "x"]).join(mean_rank("y"), ["feature", "y"])
    w = F.col("k").cast("double")
    s = r.groupBy("feature").agg(F.sum(w).alias("n"), F.sum(w * F.col("rx")).alias("a"), F.sum(w * F.col("ry")).alias("b"), F.sum(w * F.col("rx") * F.col("ry")).alias("ab"), F.sum(w * F.col("rx") * F.col("rx")).alias("aa"), F.sum(w * F.col("ry") * F.col("ry")).alias("bb"))
    rho = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.nullif(F.sqrt((F.col("aa") - F.col("a") * F.col("a") / F.col("n")) * (F.col("bb") - F.col("b") * F.col("b") / F.col("n"))), F.lit(0.0))
    s = s.select("feature", rho.alias("r"), "n")
    out = [F.round("r", 6).alias("rho"), F.col("n").cast("long").alias("n")]
    if with_p:
        t = F.abs("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
        out.append(F.when(F.abs("r") >= 1, F.lit(0.0)).otherwise(student_p(t, F.col("n") - 2)).alias("p_value"))
    return s.select("feature", *out)


def vocab_summary(df: DataFrame, by: str) -> DataFrame:
    """Of classified records, per dataset: valid ones, those with vocabulary hits and with parts, rates, and the hits in order as 'word:count'."""
    base = df.groupBy(by).agg(F.count_if("valid").alias("n_valid"), F.count_if("has_vocab").alias("n_with_vocab"), F.round(F.avg(F.col("has_vocab").cast("double")), 4).alias("vocab_rate"), F.round(F.avg(F.col("has_parts").cast("double")), 4).alias("parts_rate"), F.round(F.avg(F.col("needs_norm").cast("double")), 4).alias("norm_rate"))
    hits = df.select(by, F.explode("vocab_hits").alias("hit")).groupBy(by, "hit").agg(F.count("*").alias("k"))
    top = hits.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("neg"), "hit"))), lambda x: F.concat(x["hit"], F.lit(":"), (-x["neg"]).cast("string"))), "; ").alias("top"))
    return base.join(top, by, "left")


def view_rates(df: DataFrame, by: str, flags: list[str]) -> DataFrame:
    return df.groupBy(by).agg(*[F.round(F.avg(F.col(f).cast("double")), 4).alias(f"{f}_rate") for f in flags])


def profile_key(names: list[str]) -> Column:
    """The names of present patterns, sorted, joined by '|'; none if there is none."""
    present = F.filter(F.array(*[F.when(F.col(f"{n}_present") == 1, F.lit(n)) for n in sorted(names)]), lambda x: x.isNotNull())
    return F.coalesce(F.nullif(F.array_join(present, "|"), F.lit("")), F.lit("none"))
