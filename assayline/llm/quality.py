"""Quality classification by hierarchical empirical Bayes: a document's own evidence, and posteriors of its site, level by level (host, path, deeper path)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import put, small_batches, table, unit

FEATURES = ["size", "letters", "upper", "digits", "stops", "marks", "bars", "high", "spaces", "word_length", "distinct_words", "distinct_lines", "line_words", "sentence_words"]
_KIND = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|", bytes(range(128, 256)), b" \t\r\n\x0b\x0c"), 1):
    _KIND[list(_chars)] = _i


def text_features(text: str | None) -> list[float]:
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kinds = np.bincount(_KIND, np.bincount(data, minlength=256), 9)
    n = max(len(data), 1)
    found, lines = (text or "").split(), [x for x in (text or "").split("\n") if x]
    share = [float(np.log(kinds[i] / n + 1e-3)) for i in range(1, 9)]
    stops = max((text or "").count("."), 1)
    return [
        float(np.log1p(len(data))), *share,
        float(np.log1p(sum(map(len, found)) / max(len(found), 1))), len(set(found)) / max(len(found), 1), len(set(lines)) / max(len(lines), 1),
        float(np.log1p(len(found) / max(len(lines), 1))), float(np.log1p(len(found) / stops)),
    ]


def features(text: Column) -> Column:
    """As a nondeterministic function, so that the optimizer doesn't run it a second time for a filter that it infers."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in s])

    return run.asNondeterministic()(text)


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(p / (1 - p))


def _strength(k: str, n: str) -> Column:
    """Prior strength by moments: how many documents a prior weighs, from the spread of site rates beyond chance."""
    mean = F.sum(k) / F.sum(n)
    spread = F.sum(F.col(n) * (F.col(k) / F.col(n)) * (F.col(k) / F.col(n))) / F.sum(n) - mean * mean
    chance = mean * (1 - mean) * F.count("*") / F.sum(n)
    return F.least(F.greatest(mean * (1 - mean) / F.greatest(spread - chance, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e6))


class SiteModel:
    """Coefficients of the document classifier; for each site its labelled counts on all levels; prior strengths of the levels; the global rate."""

    def __init__(self, weights: list[float], intercept: float, levels: tuple[str, ...], sites: DataFrame, strengths: list[float], rate: float) -> None:
        self.weights, self.intercept, self.levels, self.sites, self.strengths, self.rate = weights, intercept, levels, sites, strengths, rate

    def evidence(self, feats: str) -> Column:
        total = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            total = total + F.lit(float(w)) * F.col(feats)[i]
        return total


def _site(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(name).cast("string")), F.lit(""))


def url_levels(url: Column) -> list[Column]:
    """host, segment and rest of a URL, as levels of sites for tables that have one; null where there is none."""
    part = lambda i: F.nullif(F.regexp_extract(url, r"^\w+://(?:[^/@?#]*@)?([^/:?#]+)(?::[0-9]+)?(?:/([^/?#]*))?(?:/([^?#]*))?", i), F.lit(""))
    return [F.lower(part(1)).alias("host"), part(2).alias("segment"), part(3).alias("rest")]


def fit(rows: DataFrame, labels: DataFrame, *, levels: tuple[str, ...] = ("source", "lang"), sample: int = 20_000) -> SiteModel:
    """Fit on rows (doc_id, levels, f).

    The document classifier is a logistic regression on at most about `sample` labelled documents, chosen by a hash of
    doc_id. Sites are counted over all labelled documents: how many there are, and how many good ones, for each site of
    each level, by one grouped aggregation whose result the levels above sum up. Each level's prior strength is estimated
    from the spread of all its sites' rates.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    n = marks.count()
    chosen = marks.filter(unit("quality", "doc_id") < F.lit(min(1.0, sample / max(n, 1))))
    known = put(rows.join(chosen, "doc_id").select("label", array_to_vector("f").alias("features")), "quality-sample")
    ends = known.agg(F.min("label"), F.max("label")).first()
    if ends[0] is None or ends[0] == ends[1]:  # nothing to tell apart
        weights, intercept = [0.0] * len(FEATURES), 20.0 if ends[0] is None or ends[0] > 0 else -20.0
    else:
        model = LogisticRegression(regParam=1e-3, maxIter=100).fit(known)
        weights, intercept = model.coefficients.toArray().tolist(), float(model.intercept)
    keys = [f"l{i}" for i in range(len(levels))]
    named = rows.select("doc_id", *[_site(c).alias(k) for c, k in zip(levels, keys, strict=True)])
    counts = named.join(marks, "doc_id", "left").groupBy(*keys).agg(F.coalesce(F.sum("label"), F.lit(0.0)).alias("k"), F.count("label").alias("n"))
    sites = counts = put(counts, "quality-counts")
    strengths = []
    for i in range(len(levels)):
        level = counts.groupBy(*keys[: i + 1]).agg(F.sum("k").alias(f"k{i}"), F.sum("n").alias(f"n{i}"))
        strengths.append(float(level.filter(f"n{i} > 0").agg(_strength(f"k{i}", f"n{i}").alias("s")).first()["s"] or 1.0))
        sites = sites.join(level, keys[: i + 1])
    whole = counts.agg(F.sum("k") / F.nullif(F.sum("n"), F.lit(0))).first()[0]
    return SiteModel(weights, intercept, levels, put(sites.drop("k", "n"), "quality-sites"), strengths, 0.5 if whole is None else float(whole))


def judge(rows: DataFrame, model: SiteModel) -> DataFrame:
    """rows (with levels and f) and p_doc, p_host, p_path, p_good.

    A level's posterior is (good + strength * posterior above) / (labelled + strength), from the global rate down, so sparse
    sites stay near the level above; p_host is the first level's, p_path the last one's. p_good adds the log odds of p_path
    against the global rate to those of the document's own evidence.
    """
    keys = [f"l{i}" for i in range(len(model.levels))]
    rows = rows.withColumns({"_e": model.evidence("f"), "_site": F.struct(*[_site(c).alias(k) for c, k in zip(model.levels, keys, strict=True)])})
    sites = model.sites.select(F.struct(*keys).alias("_site"), F.struct(*[c for c in model.sites.columns if c not in keys]).alias("_n"))
    rows = rows.join(sites, "_site", "left")
    rate = p = F.lit(model.rate)
    posteriors = []
    for i, s in enumerate(model.strengths):
        p = (F.coalesce(F.col("_n")[f"k{i}"], F.lit(0.0)) + F.lit(s) * p) / (F.coalesce(F.col("_n")[f"n{i}"], F.lit(0)) + F.lit(s))
        posteriors.append(p)
    rows = rows.withColumns({"p_doc": 1 / (1 + F.exp(-F.col("_e"))), "p_host": posteriors[0], "p_path": posteriors[-1]})
    rows = rows.withColumn("p_good", 1 / (1 + F.exp(-(F.col("_e") + _logit(F.col("p_path")) - _logit(rate)))))
    return rows.drop("_e", "_site", "_n")


def evidence_table(docs: DataFrame, levels: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *levels, features(F.col("text")).alias("f"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_doc, p_host, p_path, p_good, keep for each document.

    The table has no URLs: the first level of sites is `source`, the second `lang` below it. Null levels: a site of their
    own. Null text counts as empty. No usable
    labels, or one class: every document gets that class's side. Null doc_id: judged, not learned from. Repeated rows are
    judged each; labels of one doc_id combine to the best. Empty tables: empty result. Further columns are ignored.
    """
    small_batches(spark)
    rows = put(evidence_table(table(spark, sf_dir, "documents")), "quality-features")
    model = fit(rows, table(spark, sf_dir, "labels"))
    return judge(rows, model).select("doc_id", "p_doc", "p_host", "p_path", "p_good", (F.col("p_good") >= 0.5).alias("keep"))


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects, all columns as they are, whatever their names. Texts are read twice and not shuffled, unless the site table is too large to broadcast.

    A document stays if its probability is at least 0.5, a tie included. Null text is judged as an empty one, a null doc_id
    without a label of its own, repeated rows each; very long texts by the shapes of the whole. Empty table: empty result.
    """
    small_batches(spark)
    model = fit(put(evidence_table(docs), "quality-features"), labels)
    rows = docs.select(F.struct(*docs.columns).alias("own")).select("own", F.col("own.source").alias("source"), F.col("own.lang").alias("lang"), features(F.col("own.text")).alias("f"))
    return judge(rows, model).filter("p_good >= 0.5").select("own.*")


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
SQL: dict[str, str] = {}
