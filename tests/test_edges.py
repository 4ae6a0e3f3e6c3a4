"""Small tables that pin the cases easy to get wrong: ties, empty classes, scores of exactly 1, null keys, order of rules."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from assayline.operators import enrich, joins, keys, labels, metrics, sampling, splits
from assayline.plans import q_curation, q_evaluation
from assayline.sources import tables


def records(spark, rows):
    return spark.createDataFrame([(i, k, y) for i, (k, y) in enumerate(rows)], "record_id long, key string, label int")


CONFLICT = [("a", 1), ("a", 0), ("a", 1), ("b", 0), ("b", 0), ("c", 1), ("c", 0), ("d", 1), (None, 1)]


@pytest.mark.parametrize(("strategy", "want"), [("conservative", {("b", 0, 3), ("d", 1, 7)}), ("positive_priority", {("a", 1, 0), ("b", 0, 3), ("c", 1, 5), ("d", 1, 7)}), ("majority_vote", {("a", 1, 0), ("b", 0, 3), ("d", 1, 7)})])
def test_conflicts(spark, strategy, want):
    got = labels.resolve_conflicts(records(spark, CONFLICT), strategy)
    assert {(r["key"], r["label"], r["record_id"]) for r in got.collect()} == want


def test_conflict_report(spark):
    got = {r["strategy"]: r for r in labels.conflict_report(records(spark, CONFLICT)).collect()}
    assert {r["pos_rate_before"] for r in got.values()} == {round(5 / 9, 4)} and got["majority_vote"]["n_after"] == 3 and got["conservative"]["n_conflicts"] == 2
    with pytest.raises(ValueError):
        labels.resolve_conflicts(records(spark, CONFLICT), "other")


def test_overlap_last_label_and_second_size(spark):
    rows = [("x", "k", 1, 0), ("x", "k", 0, 1), ("x", "m", 1, 2), ("y", "k", 0, 3), ("y", "m", 1, 4), ("y", "z", 1, 5), ("y", "w", 0, 6)]
    got = labels.dataset_overlap(spark.createDataFrame(rows, "endpoint string, key string, label int, record_id long")).first()
    assert (got["overlap"], got["overlap_pct"], got["concordant"], got["kappa"]) == (2, 50.0, 2, 1.0)


def skip_greedy(sizes, room):
    out = []
    for s in sizes:
        if s <= room:
            room -= s
            out.append(s)
    return sorted(out)


def test_group_split_skips(spark):
    """Sizes 5, 4, 3, 3, 2, 1 and room for 14: the second 3 doesn't fit, 2 does."""
    rows = [(i, f"g{g}", 1) for g, s in enumerate([5, 4, 3, 3, 2, 1]) for i in range(s)]
    got = splits.group_split(spark.createDataFrame(rows, "record_id long, grp string, label int"), ratio=0.8).filter("split = 'train'").groupBy("grp").count().collect()
    assert sorted(r["count"] for r in got) == [2, 3, 4, 5]
    rng = random.Random(4)
    for _ in range(3):
        sizes = [rng.randint(1, 6) for _ in range(12)]
        df = spark.createDataFrame([(i, f"g{g}", 1) for g, s in enumerate(sizes) for i in range(s)], "record_id long, grp string, label int")
        got = splits.group_split(df, ratio=0.7).filter("split = 'train'").groupBy("grp").count().collect()
        assert sorted(r["count"] for r in got) == skip_greedy(sorted(sizes, reverse=True), int(sum(sizes) * 0.7))


def test_group_kfold_is_balanced(spark):
    sizes = [7, 5, 4, 3, 1]
    df = spark.createDataFrame([(f"g{g}",) for g, s in enumerate(sizes) for _ in range(s)], "grp string")
    load = {r["fold"]: r["n"] for r in splits.group_kfold(df, 3).groupBy("fold").agg(F.sum("size").alias("n")).collect()}
    assert sorted(load.values()) == [6, 7, 7]
    assert splits.group_kfold(df, 9).agg(F.max("fold")).first()[0] == 4


def preds(spark, rows):
    return spark.createDataFrame([("x", y, p if p is None else float(p)) for y, p in rows], "experiment string, label int, proba double")


EDGES = [(0, 0.0), (1, 0.5), (0, 0.5), (1, 0.99), (1, 1.0)]


def test_score_of_one(spark):
    """In no bin of the calibration error, though it counts; in the curve's last bin."""
    p = preds(spark, EDGES)
    assert metrics.ece(p, ["experiment"]).first()["ece"] == round(0.01 / 5, 4)
    assert {r["bin"]: r["n"] for r in metrics.calibration_curve(p, ["experiment"]).collect()} == {0: 1, 5: 2, 9: 2}


def test_auc_ties(spark):
    assert metrics.roc_auc(preds(spark, EDGES), ["experiment"]).first()["roc_auc"] == round(5.5 / 6, 4)
    assert metrics.roc_auc(preds(spark, [(1, 0.2), (1, 0.8)]), ["experiment"]).first()["roc_auc"] == 0.0


def test_one_class_is_zero(spark):
    m = metrics.classification_metrics(preds(spark, [(1, 0.2), (1, 0.8)]).withColumn("pred", (F.col("proba") > 0.5).cast("int")), ["experiment"]).first()
    assert [m[c] for c in ("mcc", "bacc", "f1", "sens", "spec")] == [0.0] * 5


def test_threshold_counts(spark):
    rows = [(0, 0.2), (1, 0.5), (1, 0.7), (0, 0.9), (1, None), (1, 0.5)]
    got = {r["threshold"]: (r["tp"], r["fp"], r["fn"], r["tn"]) for r in metrics.threshold_table(preds(spark, rows), ["experiment"], [0.95, 0.5, 0.3, 0.5]).collect()}
    assert got == {t: (sum(y == 1 and s is not None and s >= t for y, s in rows), sum(y == 0 and s >= t for y, s in rows), sum(y == 1 and (s is None or s < t) for y, s in rows), sum(y == 0 and s < t for y, s in rows)) for t in (0.3, 0.5, 0.95)}


def test_lowest_threshold_wins(spark):
    got = metrics.tune_threshold(preds(spark, [(0, 0.2), (1, 0.7)]), ["experiment"]).first()
    assert (got["threshold_tuned"], got["mcc_tuned"]) == (0.22, 1.0)


def test_mcnemar_same(spark):
    a = spark.createDataFrame([("x", i, i % 2, 1) for i in range(6)], "experiment string, record_id long, label int, pred int")
    got = metrics.mcnemar(a, a, ["experiment"]).first()
    assert (got["chi2"], got["p_value"], got["n_discordant"]) == (0.0, 1.0, 0)


def test_wilcoxon(spark):
    rows = [("x", float(d), 0.0) for d in (1, -2, 3, 3, 0, 5, -1)] + [("y", 1.0, 0.0)]
    got = {r["m"]: r for r in metrics.wilcoxon_signed_rank(spark.createDataFrame(rows, "m string, a double, b double"), ["m"], "a", "b").collect()}
    assert (got["x"]["n"], got["x"]["statistic"]) == (6, 4.5) and got["y"]["statistic"] is None


def test_bootstrap_skips_one_class(spark):
    p = spark.createDataFrame([("x", 0, 1, 0.9), ("x", 1, 0, 0.1)], "experiment string, record_id long, label int, proba double")
    r = metrics.bootstrap_replicates(p, ["experiment"], 60).collect()
    assert 0 < len(r) < 60 and {x["roc_auc"] for x in r} == {1.0}


def test_tanimoto(spark):
    rows = lambda x: spark.createDataFrame(list(enumerate(x)), "record_id long, bits array<int>")
    got = {r["record_id"]: r["max_sim"] for r in joins.tanimoto_max(rows([[1, 2, 3], [7]]), rows([[2, 3, 4], [], [9], [7]])).collect()}
    assert got == {0: 0.5, 1: 0.0, 2: 0.0, 3: 1.0}


def test_fisher(spark):
    got = spark.createDataFrame([(3, 1, 1, 3), (0, 5, 5, 0), (2, 2, 2, 2)], "a long, b long, c long, d long").select(enrich.fisher_exact_p("a", "b", "c", "d").alias("p")).collect()
    assert [round(r["p"], 6) for r in got] == [0.485714, 0.007937, 1.0]


def test_scenarios(spark):
    df = spark.createDataFrame([(1, "the cat. a", 1), (2, "plain", 0), (3, "  ", 1)], "record_id long, text string, label int")
    flags = keys.classify_record(df)
    assert {r["record_id"]: r["actions"] for r in flags.collect()} == {1: ["flag_vocab", "strip_parts"], 2: ["none"], 3: ["drop_invalid"]}
    base = df.select("record_id", F.col("text").alias("key"), "label")
    assert {r["record_id"] for r in keys.apply_scenario(base, "no_metal", flags.filter("record_id <> 3")).collect()} == {2, 3}
    assert {r["key"] for r in keys.apply_scenario(base, "salt_stripped", flags.filter("record_id <> 3")).collect()} == {"the cat", "plain", "  "}


def test_dedupe_before_conflicts(spark):
    views = keys.preprocessing_views(records(spark, CONFLICT))
    got = keys.training_view(views, "canonical", drop_duplicates=True, drop_conflicts=True)
    assert {r["key"] for r in got.collect()} == {"b", "d"}


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x,\"y\"\nz", 1), (2, None, 0)], "record_id long, key string, label int")
    tables.write_table(df, f"{tmp_path}/r.csv", "csv")
    assert sorted(map(tuple, tables.load_records(spark, f"{tmp_path}/r.csv", df.schema).collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        tables.load_records(spark, "r.xlsx")
    got = tables.normalize_schema(spark.createDataFrame([("1", "C", "1.0"), ("2", None, "0"), ("3", "D", "n/a")], "No string, SMILES string, Label string"), "e")
    assert [tuple(r) for r in got.select("record_id", "key", "label", "endpoint").collect()] == [("1", "C", 1, "e")]


def test_undersample(spark):
    df = spark.createDataFrame([(i, "x", int(i % 5 == 0)) for i in range(50)], "record_id long, g string, label int")
    assert {r["label"]: r["count"] for r in sampling.random_undersample(df, ["g"]).groupBy("label").count().collect()} == {0: 10, 1: 10}


def test_leave_source_out_guards(spark):
    df = spark.createDataFrame([(i, d, int(i % 2)) for i in range(20) for d in ("a", "b")] + [(1, "tiny", 1)], "record_id long, domain string, label int")
    assert {r["held_out"] for r in splits.leave_source_out(df).select("held_out").distinct().collect()} == {"a", "b"}


def test_annotate(spark):
    one = spark.createDataFrame([(3, "sampling_x", 0.05, 0.5, 60), (30, "x", 0.5, 0.5, 60)], "p int, e string, t double, c double, n int")
    got = [r["w"] for r in one.select(metrics.annotate(*map(F.col, "petcn")).alias("w")).collect()]
    assert got == ["few positives; sampled endpoint; test and CV differ; near chance", "OK"]
    assert math.isclose(metrics.OOF_GRID[40], 0.9)


def test_tanimoto_max_reads_whole_texts(spark, tmp_path):
    rest = "alpha beta gamma"
    rows = [(1, "x " * 500_000 + rest), (5, rest), (10, "y " * 500_000 + rest)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["record_id"]: r["max_sim"] for r in q_curation.d4(spark, str(tmp_path)).collect()}
    # The bits of x, y and the three words; an empty last word isn't made, as the text doesn't end in a blank.
    assert got == {5: 3 / 4, 10: 3 / 5}


def test_ad_distance_reads_all_training_rows(spark, tmp_path):
    """500 training points on a line, 1 apart: each test point lies by its own training point, whichever 400 would have been drawn."""
    rows = [(i, [float(i if i % 5 else i - 1) + (0.0 if i % 5 else 0.25)], i % 10) for i in range(1, 626)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = q_evaluation.k2(spark, str(tmp_path)).first()
    assert (got["threshold"], got["n_ood"], got["train_median"], got["test_median"]) == (1.0, 0, 1.0, 0.25)


def test_samples_are_filled_up(spark):
    """One hot cluster and two far rows; no negative has the positives' profile, or each has one of its own."""
    rows = [(i, 0, "n", float(i % 10), float(i // 10)) for i in range(100)] + [(100, 0, "n", 900.0, 0.0), (101, 0, "n", 0.0, 900.0), (102, 1, "p", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "record_id long, label int, profile string, a double, b double")
    assert sampling.kmeans_medoid_sample(df.filter("label = 0"), ["a", "b"], 60).count() == 60
    assert sampling.combined_sample(df, ["a", "b"], 60).count() == 60
    many = df.unionByName(df.filter("label = 0").withColumns({"label": F.lit(1), "record_id": F.col("record_id") + 1000})).withColumn("profile", (F.col("record_id") % 1000).cast("string"))
    assert sampling.combined_sample(many, ["a", "b"], 60).select("record_id").distinct().count() == 60


def test_nth_by_draw(spark):
    """Numbers are those of one window a group, for a hot group, null groups and draws that tie, whatever the ranges."""
    from pyspark.sql import Window as W

    from assayline.operators.ranks import nth_by_draw

    df = spark.range(500).select("id", F.when(F.col("id") % 7 > 2, "hot").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("g"), (F.col("id") * 2654435761 % 97 * 44278013).alias("h"))
    want = df.withColumn("nth", F.row_number().over(W.partitionBy("g").orderBy("h", "id")).cast("long"))
    for rows in (3, 10_000):
        assert sorted(map(repr, nth_by_draw(df, ["g"], F.col("h"), ["id"], bucket_rows=rows).collect())) == sorted(map(repr, want.collect()))
    assert nth_by_draw(df, [], F.col("h"), ["id"], bucket_rows=9).agg({"nth": "max"}).first()[0] == 500 and nth_by_draw(df.limit(0), ["g"], F.col("h"), ["id"]).count() == 0


def test_group_kfold_loads(spark):
    """Loads of folds are those of putting one group after the other, largest first, on the lightest."""
    import random

    from assayline.operators import splits

    rng = random.Random(3)
    sizes = [rng.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(120)]
    df = spark.createDataFrame([(f"g{i}",) for i, s in enumerate(sizes) for _ in range(s)], "grp string")
    loads = [0] * 5
    for s in sorted(sizes, reverse=True):
        loads[loads.index(min(loads))] += s
    got = splits.group_kfold(df).groupBy("fold").agg(F.sum("size").alias("n")).orderBy("fold").collect()
    assert [r["n"] for r in got] == loads
    assert {r["fold"] for r in splits.group_kfold(df.filter("grp in ('g1', 'g2')")).collect()} == {0, 1} and splits.group_kfold(df.limit(0)).count() == 0


def test_tanimoto_blocks(spark):
    """Largest similarities against all pairs, in one block and in many, with equal, empty and null sets."""
    import random

    from assayline.operators import joins

    rng = random.Random(5)
    sets = [(i, rng.sample(range(200), rng.randint(1, 60))) for i in range(80)] + [(80, []), (81, None), (82, [199]), (83, [7]), (84, [7])]
    df = spark.createDataFrame(sets, "record_id long, bits array<long>")
    train, test = df.filter("record_id % 3 <> 0"), df.filter("record_id % 3 = 0")
    want = {}
    for i, x in sets:
        if i % 3 == 0:
            want[i] = max((len(set(x or ()) & set(y)) / len(set(x or ()) | set(y)) for j, y in sets if j % 3 and y), default=0.0)
    assert {r["record_id"]: r["max_sim"] for r in joins.tanimoto_max(train, test).collect()} == want
