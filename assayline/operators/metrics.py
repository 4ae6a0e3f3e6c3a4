"""Metrics, intervals, calibration, thresholds and paired tests as grouped aggregates over predictions (experiment, label, proba).

What needs an order of scores starts from counts per distinct score, which are dealt to ranges of scores: no task holds an
experiment's scores, only a range of them (`ranks.running`).
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.functions.columns import chi2_p, normal_p, ratio, signed_rank_p
from assayline.operators.ranks import in_ranges, running
from assayline.plans.shared import keep

#: 40 thresholds as arange(.1, .9, .02) gives them; the out-of-fold grid has one more.
STEP = (0.1 + 0.02) - 0.1
TUNE_GRID = [0.1 + i * STEP for i in range(40)]
OOF_GRID = [0.1 + i * STEP for i in range(41)]


def confusion(pred: DataFrame, by: list[str], pred_col: str = "pred", weight: str | None = None) -> DataFrame:
    w = F.col(weight) if weight else F.lit(1)
    cell = lambda y, p: F.sum(F.when((F.col("label") == y) & (F.col(pred_col) == p), w).otherwise(F.lit(0))).alias({(1, 1): "tp", (0, 1): "fp", (1, 0): "fn", (0, 0): "tn"}[y, p])
    return pred.groupBy(*by).agg(cell(1, 1), cell(0, 1), cell(1, 0), cell(0, 0))


def score_columns(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """mcc, bacc, f1, sens, spec from tp, fp, fn, tn; all 0 if the truth has one class, mcc 0 if its denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (tn + fp > 0)
    zero = lambda c: F.when(both, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    mcc = (tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0))
    out = {"mcc": mcc, "bacc": (sens + spec) / 2, "f1": ratio(2 * tp, 2 * tp + fp + fn), "sens": sens, "spec": spec}
    return df.withColumns({k: F.round(zero(v), digits) if digits is not None else zero(v) for k, v in out.items()})


def classification_metrics(pred: DataFrame, by: list[str], pred_col: str = "pred") -> DataFrame:
    return score_columns(confusion(pred, by, pred_col))


def score_counts(pred: DataFrame, by: list[str], score: str = "proba", weight: str | None = None) -> DataFrame:
    """Per distinct score: n0 and n1, the negatives and positives that have it."""
    w = F.col(weight) if weight else F.lit(1)
    return pred.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.when(F.col("label") == 0, w).otherwise(0)).alias("n0"), F.sum(F.when(F.col("label") == 1, w).otherwise(0)).alias("n1"))


def ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    """Counts with tp and fp at each score and above, and totals p and n."""
    return running(counts, by, [F.desc("score")], {"tp": "n1", "fp": "n0"}, {"p": "n1", "n": "n0"})


def roc_auc(pred: DataFrame, by: list[str], score: str = "proba", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0 if the truth has one class."""
    r = ranked(score_counts(pred, by, score, weight), by)
    wins = F.sum(F.col("n0").cast("double") * (F.col("tp") - F.col("n1")) + F.col("n0").cast("double") * F.col("n1") / 2)
    return r.groupBy(*by).agg(F.round(F.coalesce(ratio(wins, F.first("p").cast("double") * F.first("n")), F.lit(0.0)), 4).alias("roc_auc"))


def pr_auc(pred: DataFrame, by: list[str], score: str = "proba") -> DataFrame:
    """Average precision: over distinct scores, the recall gained times the precision there; 0 without positives."""
    r = ranked(score_counts(pred, by, score), by)
    return r.groupBy(*by).agg(F.round(F.coalesce(F.sum(ratio(F.col("n1"), F.col("p")) * ratio(F.col("tp"), F.col("tp") + F.col("fp"))), F.lit(0.0)), 4).alias("pr_auc"))


def curves(pred: DataFrame, by: list[str], score: str = "proba") -> DataFrame:
    """Points of the ROC and the precision-recall curve: threshold, fpr, tpr, precision."""
    r = ranked(score_counts(pred, by, score), by)
    return r.select(*by, F.col("score").alias("threshold"), F.round(ratio(F.col("fp"), F.col("n")), 6).alias("fpr"), F.round(ratio(F.col("tp"), F.col("p")), 6).alias("tpr"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"))


def brier(pred: DataFrame, by: list[str], score: str = "proba") -> DataFrame:
    return pred.groupBy(*by).agg(F.round(F.avg((F.col(score) - F.col("label")) * (F.col(score) - F.col("label"))), 6).alias("brier"))


def _bin(score: str, bins: int) -> Column:
    """Bin i holds [i * w, (i + 1) * w), with edges as products; null at 1 and above and below 0."""
    width = 1.0 / bins
    out = F.lit(None).cast("int")
    for i in reversed(range(bins)):
        out = F.when((F.col(score) >= i * width) & (F.col(score) < (i + 1) * width if i + 1 < bins else F.col(score) < 1.0), F.lit(i)).otherwise(out)
    return out


def ece(pred: DataFrame, by: list[str], score: str = "proba", bins: int = 10) -> DataFrame:
    """Expected calibration error. A score of exactly 1 is in no bin but counts in n."""
    b = pred.groupBy(*by, _bin(score, bins).alias("bin")).agg(F.count("*").alias("k"), F.avg("label").alias("y"), F.avg(score).alias("q"))
    gap = F.when(F.col("bin").isNotNull(), F.col("k") * F.abs(F.col("y") - F.col("q"))).otherwise(F.lit(0.0))
    return b.groupBy(*by).agg(F.round(F.sum(gap) / F.sum("k"), 4).alias("ece"))


def calibration_curve(pred: DataFrame, by: list[str], score: str = "proba", bins: int = 10) -> DataFrame:
    """Mean score and share of positives of each bin that isn't empty; here 1 is in the last bin."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return pred.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.round(F.avg("label"), 6).alias("fraction_pos"))


def threshold_table(pred: DataFrame, by: list[str], grid: list[float], score: str = "proba") -> DataFrame:
    """Confusion counts at each threshold of the grid (score >= threshold is positive), from counts by the number of thresholds that a score reaches."""
    grid = sorted(set(grid))
    reached = sum((F.coalesce((F.col(score) >= t).cast("int"), F.lit(0)) for t in grid[1:]), F.coalesce((F.col(score) >= grid[0]).cast("int"), F.lit(0)))
    c = score_counts(pred.withColumn("_reached", reached), by, "_reached")
    total = c.groupBy(*by).agg(F.sum("n1").alias("p"), F.sum("n0").alias("n"))
    hit = c.select(*by, "score", "n1", "n0", F.posexplode(F.array(*[F.lit(t) for t in grid])).alias("i", "t")).groupBy(*by, "t").agg(F.sum(F.when(F.col("score") > F.col("i"), F.col("n1")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("score") > F.col("i"), F.col("n0")).otherwise(0)).alias("fp"))
    out = hit.join(total, by) if by else hit.crossJoin(total)
    return out.withColumns({"fn": F.col("p") - F.col("tp"), "tn": F.col("n") - F.col("fp")}).withColumnRenamed("t", "threshold")


def tune_threshold(pred: DataFrame, by: list[str], score: str = "proba") -> DataFrame:
    """The threshold with the best MCC, the lowest of equals; 0.5 if no candidate predicts two classes."""
    t = score_columns(threshold_table(pred, by, TUNE_GRID, score), None)
    mcc = F.round("mcc", 10)
    ok = (F.col("tp") + F.col("fp") > 0) & (F.col("tn") + F.col("fn") > 0)
    best = t.groupBy(*by).agg(F.max(F.when(ok, F.struct(mcc.alias("mcc"), (-F.col("threshold")).alias("t")))).alias("b"))
    return best.select(*by, F.round(F.coalesce(-F.col("b.t"), F.lit(0.5)), 6).alias("threshold_tuned"), F.round(F.coalesce("b.mcc", F.lit(0.0)), 4).alias("mcc_tuned"))


def oof_threshold(pred: DataFrame, by: list[str], criterion: str = "mcc", score: str = "proba", least: int = 10) -> DataFrame:
    """(by, threshold): the best of the out-of-fold grid; 0.5 where fewer than `least` rows have a score and a label."""
    n = pred.groupBy(*by).agg(F.count(F.when(F.col("label").isNotNull(), F.col(score))).alias("_n"))
    best = oof_threshold_grid(pred, by, criterion, score).filter("best").select(*by, "threshold")
    out = n.join(best, by, "left") if by else n.crossJoin(best)
    return out.select(*by, F.when(F.col("_n") < least, F.lit(0.5)).otherwise(F.coalesce("threshold", F.lit(0.5))).alias("threshold"))


def oof_threshold_grid(pred: DataFrame, by: list[str], criterion: str = "mcc", score: str = "proba") -> DataFrame:
    """The whole grid with mcc, f1 and youden of each threshold, the best by the criterion marked (lowest of equals)."""
    t = score_columns(threshold_table(pred, by, OOF_GRID, score), None)
    t = t.withColumn("youden", F.col("sens") + F.col("spec") - 1)
    first = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.round(criterion, 10)), "threshold"))
    return t.select(*by, F.round("threshold", 6).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("mcc", "f1", "youden")], (first == 1).alias("best"))


def threshold_decomposition(pred: DataFrame, by: list[str], prevalence: float, score: str = "proba") -> DataFrame:
    """MCC at 0.5, at the training prevalence, and at the best threshold of the grid."""
    at = score_columns(threshold_table(pred, by, [0.5, prevalence], score), None)
    two = at.groupBy(*by).agg(F.round(F.max(F.when(F.col("threshold") == 0.5, F.col("mcc"))), 4).alias("mcc_default"), F.round(F.max(F.when(F.col("threshold") == prevalence, F.col("mcc"))), 4).alias("mcc_prevalence"))
    return two.join(tune_threshold(pred, by, score), by).select(*by, "mcc_default", "mcc_prevalence", F.col("mcc_tuned").alias("mcc_oracle"))


#: A group of equal scores and labels draws its weight in pieces of so many rows at the most; distinct scores of a range.
PIECE, RANGE = 256, 2048


@lru_cache(maxsize=PIECE)
def poisson_cdf(k: int) -> np.ndarray:
    """P(a Poisson number of mean k is at most 0, 1, ...), up to where a draw of 32 bits can't tell it from 1."""
    p = upto = math.exp(-k)
    out, i = [upto], 0
    while upto < 1 - 2.0**-33 and i < 4 * k + 40:
        i += 1
        p *= k / i
        upto += p
        out.append(upto)
    return np.array(out)


def group_weights(names: list[str], sizes: np.ndarray, n: int) -> np.ndarray:
    """(groups, n): how often replicates draw a group's rows. Each row counts as often as a Poisson(1) number says, so k equal rows as a Poisson(k) number, of which one draw is enough; larger groups draw for each PIECE rows.

    A draw is 32 bits of an md5 of the group's name, the piece and the replicate, four replicates to a digest.
    """
    group = np.repeat(np.arange(len(sizes)), -(-sizes // PIECE))
    piece = np.arange(len(group)) - np.repeat(np.cumsum(-(-sizes // PIECE)) - -(-sizes // PIECE), -(-sizes // PIECE))
    rows = np.minimum(sizes[group] - piece * PIECE, PIECE)
    tails = [b"|%d" % i for i in range(-(-n // 4))]
    out = np.zeros((len(sizes), n), np.int64)
    for k in np.unique(rows):
        for part in np.array_split(at := np.flatnonzero(rows == k), 1 + len(at) // 512):
            digests = []
            for i in part:
                base = hashlib.md5(f"{names[group[i]]}|{piece[i]}".encode())
                for t in tails:
                    h = base.copy()
                    h.update(t)
                    digests.append(h.digest())
            u = np.frombuffer(b"".join(digests), ">u4").reshape(len(part), -1)[:, :n] / 4294967296.0
            np.add.at(out, group[part], np.searchsorted(poisson_cdf(int(k)), u, "right"))
    return out


def bootstrap_replicates(pred: DataFrame, by: list[str], n: int = 500, score: str = "proba", threshold: float = 0.5) -> DataFrame:
    """Per replicate the metrics of a reweighted sample; replicates of one class are left out.

    Each row's weight is a Poisson(1) number, so a replicate has about, not exactly, as many rows. Weights are drawn for
    groups of equal score and label, in ranges of scores: what leaves a range is one row a replicate, so rows times
    replicates are never shuffled. Areas under curves add up over ranges, with the positives of the ranges above.
    """
    name = F.concat_ws("|", *[F.col(c).cast("string") for c in by], F.floor(F.col("score") * float(1 << 40)).cast("long").cast("string"))
    counts = keep(score_counts(pred, by, score), "scores")
    counts = in_ranges(counts, by, F.desc("score"), parts=1 + counts.count() // RANGE).select("_part", *by, "score", name.alias("name"), "n0", "n1")

    def draw(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("score", ascending=False)
        names, q = x["name"].tolist(), x["score"].to_numpy(float)
        k0, k1, above = x["n0"].to_numpy(np.int64), x["n1"].to_numpy(np.int64), q >= threshold
        out = {c: np.zeros(n) for c in ("a0", "a1", "wins", "fp", "tp", "sq")}
        rows = max(1, (1 << 21) // n)
        for i in range(0, len(x), rows):  # of so many scores at a time, whose weights take some tens of MB
            part = slice(i, i + rows)
            w0 = group_weights([f"0|{v}" for v in names[part]], k0[part], n)
            w1 = group_weights([f"1|{v}" for v in names[part]], k1[part], n)
            higher = out["a1"] + np.cumsum(w1, 0) - w1
            out["wins"] += (w0 * (higher + w1 / 2)).sum(0)
            out["a0"] += w0.sum(0)
            out["a1"] += w1.sum(0)
            out["fp"] += w0[above[part]].sum(0)
            out["tp"] += w1[above[part]].sum(0)
            out["sq"] += (w1 * ((1 - q[part]) ** 2)[:, None] + w0 * (q[part] ** 2)[:, None]).sum(0)
        return pd.DataFrame({c: x[c].iloc[0] for c in ("_part", *by)} | {"b": np.arange(n)} | out)

    types = dict(counts.dtypes)
    schema = ", ".join([f"_part {types['_part']}", *[f"`{c}` {types[c]}" for c in by], "b long", *[f"{c} double" for c in ("a0", "a1", "wins", "fp", "tp", "sq")]])
    parts = counts.groupBy(*by, "_part").applyInPandas(draw, schema)
    keys = [*by, "b"]
    before = F.coalesce(F.sum("a1").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.withColumn("wins", F.col("wins") + F.col("a0") * before)
    out = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("a0", "a1", "wins", "fp", "tp", "sq")]).filter("a1 > 0 and a0 > 0")
    return score_columns(out.select(*keys, "tp", "fp", (F.col("a1") - F.col("tp")).alias("fn"), (F.col("a0") - F.col("fp")).alias("tn"), ratio(F.col("wins"), F.col("a1") * F.col("a0")).alias("roc_auc"), (F.col("sq") / (F.col("a1") + F.col("a0"))).alias("brier")), None)


def bootstrap_ci(pred: DataFrame, by: list[str], n: int = 500, **how) -> DataFrame:
    """(by, metric, mean, lo, hi) over bootstrap replicates: the mean of replicates and their 2.5 and 97.5 percentiles."""
    names = ["mcc", "bacc", "sens", "spec", "brier", "roc_auc"]
    return interval(unpivot(bootstrap_replicates(pred, by, n, **how), by, names), by)


def unpivot(df: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    return df.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("x")).select(*by, "x.metric", "x.value")


def interval(long: DataFrame, by: list[str], digits: int = 4) -> DataFrame:
    return long.groupBy(*by, "metric").agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.percentile("value", F.lit(0.025)), digits).alias("lo"), F.round(F.percentile("value", F.lit(0.975)), digits).alias("hi"))


def fold_summary(long: DataFrame, by: list[str]) -> DataFrame:
    """From (by, metric, value) per fold: mean, sample standard deviation, percentiles, n."""
    return long.groupBy(*by, "metric").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"), F.round(F.percentile("value", F.lit(0.025)), 4).alias("lo"), F.round(F.percentile("value", F.lit(0.975)), 4).alias("hi"), F.count("value").alias("n"))


def mcnemar(a: DataFrame, b: DataFrame, by: list[str], with_p: bool = True) -> DataFrame:
    """Rows right in one model only, chi-square with continuity correction (0, and p 1, without such rows); a, b: record_id, label, pred."""
    right = a.join(b.select(*by, "record_id", F.col("pred").alias("_other")), [*by, "record_id"])
    ra, rb = F.col("pred") == F.col("label"), F.col("_other") == F.col("label")
    t = right.groupBy(*by).agg(F.count_if(ra & ~rb).alias("a_better"), F.count_if(~ra & rb).alias("b_better"))
    n = F.col("a_better") + F.col("b_better")
    gap = F.abs(F.col("a_better") - F.col("b_better")) - 1
    t = t.select(*by, "a_better", "b_better", n.alias("n_discordant"), F.round(F.coalesce(ratio(gap * gap, n), F.lit(0.0)), 4).alias("chi2"))
    return t.withColumn("p_value", F.when(F.col("n_discordant") == 0, F.lit(1.0)).otherwise(F.round(chi2_p("chi2"), 6))) if with_p else t


#: Up to so many pairs the signed-rank distribution is exact, above it is normal.
EXACT = 25


def wilcoxon_signed_rank(df: DataFrame, by: list[str], a: str, b: str, with_p: bool = False) -> DataFrame:
    """Statistic, n and mean difference of pairs; zero differences go, ties share their mean rank; null with under 5 pairs.

    with_p adds the two-sided p: of up to EXACT pairs from the distribution over all signs of their ranks, ties included,
    of more from a normal one whose variance allows for ties.
    """
    d = df.withColumn("d", F.col(a) - F.col(b))
    mean = d.groupBy(*by).agg(F.round(F.avg("d"), 6).alias("mean_diff"))
    c = d.filter("d <> 0").groupBy(*by, F.abs("d").alias("_m")).agg(F.count("*").alias("k"), F.count_if(F.col("d") > 0).alias("up"))
    c = running(c, by, ["_m"], {"_upto": "k"}, {"_n": "k"})
    rank = F.col("_upto") - F.col("k") + (F.col("k") + 1) / 2
    few = F.when(F.col("_n") <= EXACT, F.struct((rank * 2).cast("int").alias("rank2"), F.col("k").cast("int").alias("k")))
    s = c.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(rank * F.col("up")).alias("wp"), F.sum(rank * (F.col("k") - F.col("up"))).alias("wm"), F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("ties"), F.collect_list(few).alias("ranks"))
    s = s.join(mean, by) if by else s.crossJoin(mean)
    s = s.withColumn("statistic", F.when(F.col("n") >= 5, F.least("wp", "wm")))
    out = s.select(*by, "n", "statistic", "mean_diff")
    if with_p:
        n = F.col("n").cast("double")
        normal = normal_p((F.col("statistic") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48))
        exact = signed_rank_p("statistic", F.transform("ranks", lambda x: x["rank2"]), F.transform("ranks", lambda x: x["k"]))
        out = s.select(*by, "n", "statistic", "mean_diff", F.when(F.col("n") <= EXACT, exact).otherwise(normal).alias("p_value"))
    return out


def outcome_label(label: str = "label", pred: str = "pred") -> Column:
    return F.when((F.col(label) == 1) & (F.col(pred) == 1), "TP").when((F.col(label) == 1) & (F.col(pred) == 0), "FN").when((F.col(label) == 0) & (F.col(pred) == 0), "TN").when((F.col(label) == 0) & (F.col(pred) == 1), "FP")


def annotate(n_pos: Column, endpoint: Column, test: Column, cv: Column, n: Column) -> Column:
    """Warnings of a result row, joined by '; ', or OK."""
    notes = [(n_pos < 15, "few positives"), (F.contains(endpoint, F.lit("sampling")), "sampled endpoint"), (F.abs(test - cv) > 0.2, "test and CV differ"), ((test < 0.1) & (n > 50), "near chance")]
    return F.coalesce(F.nullif(F.concat_ws("; ", *[F.when(c, F.lit(t)) for c, t in notes]), F.lit("")), F.lit("OK"))


def fold_threshold(folds: DataFrame, by: list[str]) -> DataFrame:
    return folds.groupBy(*by).agg(F.percentile("threshold", F.lit(0.5)).alias("threshold"))


def experiment_row(pred: DataFrame, by: list[str], score: str = "proba", *, n_boot: int = 0, sim: str | None = None, near: float = 0.3, cv: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """A result row per experiment: sizes, metrics at 0.5, ranking, calibration and the tuned threshold, joined on the experiment.

    n_boot: adds _lo and _hi of each metric, the 2.5 and 97.5 percentiles of so many replicates. sim: a column of pred, the
    similarity to the training rows, of which ad_coverage (the share that is at least `near`) and ad_mean_sim are told. cv:
    (by, mcc) once a fold, for cv_mcc_mean and cv_mcc_std (population). sizes: (by, train_n, original_n), for train_n and
    coverage, the share of original test rows that were predicted.
    """
    p = pred.withColumn("pred", (F.col(score) >= 0.5).cast("int"))
    size = p.groupBy(*by).agg(F.count("*").alias("test_n"), F.sum("label").alias("test_n_pos"), F.round(F.avg("label"), 4).alias("test_pos_rate"))
    parts = [classification_metrics(p, by), roc_auc(p, by, score), pr_auc(p, by, score), brier(p, by, score), ece(p, by, score), tune_threshold(p, by, score)]
    if n_boot:
        ends = bootstrap_ci(p, by, n_boot, score=score).groupBy(*by)
        names = ("mcc", "bacc", "sens", "spec", "brier", "roc_auc")
        parts.append(ends.agg(*[F.max(F.when(F.col("metric") == m, F.col(end))).alias(f"{m}_{end}") for m in names for end in ("lo", "hi")]))
    if sim:
        parts.append(p.groupBy(*by).agg(F.round(F.avg((F.col(sim) >= near).cast("double")), 4).alias("ad_coverage"), F.round(F.avg(sim), 4).alias("ad_mean_sim")))
    if cv is not None:
        parts.append(cv.groupBy(*by).agg(F.round(F.avg("mcc"), 4).alias("cv_mcc_mean"), F.round(F.stddev_pop("mcc"), 4).alias("cv_mcc_std")))
    if sizes is not None:
        parts.append(sizes.select(*by, "train_n", "original_n"))
    out = size
    for part in parts:
        out = out.join(part, by, "left")
    out = out.withColumn("threshold_default", F.lit(0.5)) if n_boot or sim else out
    return out.withColumn("coverage", F.round(F.col("test_n") / F.col("original_n"), 4)).drop("original_n") if sizes is not None else out


def run_checklist(tables: dict[str, DataFrame]) -> DataFrame:
    """(check, passed): whether a run is complete, from its tables by name; a table that is absent or empty fails its checks.

    splits (endpoint, group_overlap), conflicts (endpoint), domain, held_out, overlap, cv, mcnemar, curves, importances, and
    rows, the result rows (endpoint, scenario, feature_mode, model, mcc, and mcc_lo, ad_coverage, brier where there are).
    """
    rows = tables.get("rows")
    has = lambda c: rows is not None and c in rows.columns
    filled = lambda df, ok=None: None if df is None else df.agg((F.count("*") > 0).alias("_n"), *([ok.alias("_ok")] if ok is not None else [])).select(F.coalesce(F.col("_n") & (F.col("_ok") if ok is not None else F.lit(True)), F.lit(False)).alias("passed"))
    full = lambda c: filled(rows, F.count(c) == F.count("*")) if has(c) else None
    splits, conflicts, salted = tables.get("splits"), tables.get("conflicts"), None
    if rows is not None and {"scenario", "feature_mode", "model", "endpoint"} <= set(rows.columns):
        keys = ["endpoint", "feature_mode", "model"]
        raw = rows.filter("scenario = 'raw_all'").groupBy(*keys).agg(F.max("mcc").alias("_raw"))
        other = rows.filter("scenario = 'salt_stripped'").join(raw, keys, "left")
        salted = other.agg(F.coalesce(F.bool_or(F.coalesce("mcc", F.lit(0.0)) != F.coalesce("_raw", F.lit(-1.0))), F.lit(False)).alias("passed"))
    checks = {
        "fixed_split": filled(splits, F.max("group_overlap") == 0),
        "conflicts": None if splits is None or conflicts is None else filled(splits.select("endpoint").distinct().join(conflicts.select("endpoint", F.lit(True).alias("_there")).distinct(), "endpoint", "left"), F.count("_there") == F.count("*")),
        "domain_diagnosed": filled(tables.get("domain")), "domain_ldo": filled(tables.get("held_out")), "cross_ep": filled(tables.get("overlap")), "cv_selection": filled(tables.get("cv")), "salt_stripped_verified": salted,
        "statistical_tests": filled(tables.get("mcnemar")), "learning_curves": filled(tables.get("curves")), "bootstrap_ci": filled(rows) if has("mcc_lo") else None,
        "ad_computed": full("ad_coverage"), "calibration": full("brier"), "shap_computed": filled(tables.get("importances")),
    }
    spark = next(iter(tables.values())).sparkSession
    out = spark.createDataFrame([(k, False) for k, v in checks.items() if v is None], "check string, passed boolean")
    for k, v in checks.items():
        out = out if v is None else out.unionByName(v.select(F.lit(k).alias("check"), "passed"))
    return out


def checklist(rows: DataFrame, pred: DataFrame) -> DataFrame:
    """(check, passed): completeness of result rows and predictions."""
    r = rows.agg(F.count("*").alias("n"), F.count_if(F.col("mcc").isNull()).alias("null_mcc"), F.count_if((F.col("mcc") < -1) | (F.col("mcc") > 1)).alias("bad_mcc"), F.count_if(F.col("test_n") <= 0).alias("empty"), F.count_if(F.col("roc_auc").between(0, 1)).alias("auc"))
    p = pred.agg(F.count_if(F.col("proba").between(0, 1)).alias("in01"), F.count("*").alias("m"), F.count_if(F.col("label").isin(0, 1)).alias("y"))
    x = r.crossJoin(p)
    checks = {"has_rows": F.col("n") > 0, "mcc_complete": F.col("null_mcc") == 0, "mcc_in_range": F.col("bad_mcc") == 0, "test_sets_filled": F.col("empty") == 0, "auc_in_range": F.col("auc") == F.col("n"), "probabilities_in_range": F.col("in01") == F.col("m"), "labels_binary": F.col("y") == F.col("m")}
    return x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), v.alias("passed")) for k, v in checks.items()])).alias("c")).select("c.*")
