"""Workflows: operators and model fits in a row. The driver loops over fits, of which there are few; rows stay in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayline.operators import domain, labels, metrics, models, sampling, splits
from assayline.operators.features import bit_prevalence_filter, hashed_shingle_bits, standardize
from assayline.plans.grid import run_cells
from assayline.plans.shared import keep


def vectors(df: DataFrame, cols: list[str]) -> DataFrame:
    """df with features: a vector of the given columns, missing numbers being 0 (a text without words has no mean word)."""
    from pyspark.ml.feature import VectorAssembler

    filled = df.withColumns({f"_f_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols})
    return VectorAssembler(inputCols=[f"_f_{c}" for c in cols], outputCol="features").transform(filled).drop(*[f"_f_{c}" for c in cols])


def bit_vectors(df: DataFrame, bits: list[int]) -> DataFrame:
    """df with features: a sparse vector that has 1 for each of the given bits that a row has."""
    from pyspark.ml.feature import CountVectorizerModel

    names = F.transform(F.coalesce("bits", F.array().cast("array<int>")), lambda b: b.cast("string"))
    model = CountVectorizerModel.from_vocabulary([str(b) for b in bits] or ["none"], inputCol="_names", outputCol="features").setBinary(True)
    return model.transform(df.withColumn("_names", names)).drop("_names")


def predicted(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("pred", (F.col("proba") >= threshold).cast("int"))


def cv_summary(df: DataFrame, model: str, k: int = 5, **params) -> DataFrame:
    """Mean and population deviation of metrics over folds."""
    m = models.cv_mcc(df, model, k=k, **params)
    return m.agg(*[F.round(F.avg(c), 4).alias(f"{c}_mean") for c in ("mcc", "bacc", "sens", "spec")], F.round(F.stddev_pop("mcc"), 4).alias("mcc_std"), F.count("*").alias("n_folds"))


def random_vs_group_split(df: DataFrame, model: str = "logistic", k: int = 5, r: int = 5, folder: str | None = None) -> DataFrame:
    """MCC under random and under group folds, r times k of each, and by how much random folds overestimate."""
    group = keep(splits.repeated_group_folds(df, k=k, r=r), "group-folds")

    def cell(kind: str, rep: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            folded = splits.stratified_kfold(df, k, 42 + rep) if kind == "random" else df.join(group.filter(F.col("rep") == rep).drop("rep"), "grp")
            return models.cv_mcc(keep(folded, "folds"), model, k=k).select(F.lit(kind).alias("kind"), F.lit(rep).alias("rep"), "fold", "mcc")

        return run

    out = run_cells(df.sparkSession, {f"{kind}-{rep}": cell(kind, rep) for kind in ("random", "group") for rep in range(r)}, folder)
    p = out.groupBy().pivot("kind", ["random", "group"]).agg(F.round(F.avg("mcc"), 4).alias("mean"), F.round(F.stddev_pop("mcc"), 4).alias("std"), F.count("mcc").alias("n"))
    gap = F.round(F.col("random_mean") - F.col("group_mean"), 4)
    return p.withColumns({"overestimation": gap, "overestimation_pct": F.round(F.lit(100.0) * gap / F.greatest(F.col("group_mean"), F.lit(0.01)), 2)})


def learning_curve(df: DataFrame, model: str = "logistic", k: int = 3, fractions: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5, 0.7, 1.0), folder: str | None = None) -> DataFrame:
    """Mean MCC over folds by the fraction of training rows used."""
    folded = keep(splits.stratified_kfold(df, k), "folds")
    drawn = [keep(splits.learning_fractions(folded.filter(F.col("fold") != i).withColumn("fold", F.lit(i)), fractions), "fractions") for i in range(k)]

    def cell(i: int, f: float) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            train = folded.join(drawn[i].filter(F.col("fraction") == f).select("record_id"), "record_id", "left_semi")
            scored = predicted(models.fit_score(train, folded.filter(F.col("fold") == i), model))
            return metrics.classification_metrics(scored, ["fold"]).select(F.lit(f).alias("fraction"), "mcc")

        return run

    out = run_cells(df.sparkSession, {f"fold-{i}-fraction-{f}": cell(i, f) for i in range(k) for f in fractions}, folder)
    n = df.count()
    return out.groupBy("fraction").agg(F.floor(F.lit(n) * F.col("fraction") * (k - 1) / k).alias("n_train"), F.round(F.avg("mcc"), 4).alias("mcc_mean"), F.round(F.stddev_pop("mcc"), 4).alias("mcc_std"), F.count("*").alias("n_folds"))


def leave_source_out_eval(df: DataFrame, names: tuple[str, ...] = ("logistic",), n_boot: int = 500, source: str = "domain", folder: str | None = None) -> DataFrame:
    """Each source predicted by models of the others, with bootstrap intervals; one table of predictions, one bootstrap. A source's rows are picked by a predicate."""
    df = keep(df, "sources")
    held = [r["held_out"] for r in splits.leave_source_out(df, source).select("held_out").distinct().orderBy("held_out").collect()]

    def cell(s: str, m: str) -> Callable[[], DataFrame]:
        role = splits.role_of(source, s)
        return lambda: models.fit_score(df.filter(role == "train"), df.filter(role == "test"), m).select("record_id", "label", "proba", F.lit(s).alias("held_out"), F.lit(m).alias("model"))

    scored = run_cells(df.sparkSession, {f"source-{i}-{m}": cell(s, m) for i, s in enumerate(held) for m in names}, folder)
    return metrics.bootstrap_ci(scored, ["held_out", "model"], n_boot)


def scenario_selection(scenarios: dict[str, DataFrame], model: str = "logistic", k: int = 3) -> DataFrame:
    """CV metrics of each scenario, the best MCC marked; the earlier of equals."""
    out = None
    for i, (name, df) in enumerate(scenarios.items()):
        m = cv_summary(keep(splits.stratified_kfold(df, k), "folds"), model, k).select(F.lit(name).alias("scenario"), F.lit(i).alias("nth"), "mcc_mean", "mcc_std", "n_folds")
        out = m if out is None else out.unionByName(m)
    from assayline.operators.report import best_per_group

    return best_per_group(out.withColumn("all", F.lit(1)), ["all"], "mcc_mean", "nth").select("scenario", "mcc_mean", "mcc_std", "n_folds", "is_primary")


def locked_test_grid(df: DataFrame, scenarios: dict[str, Column], modes: dict[str, list[str]], names: tuple[str, ...], split: str = "split", endpoint: str = "endpoint", n_boot: int = 0, folder: str | None = None) -> DataFrame:
    """All endpoints by scenarios by feature modes by models on the locked test rows, a scenario being a filter: predictions in one table, result rows from one grouped pass. Cells in which a side has one class only are left out."""
    df = keep(df, "grid")
    sides = [F.count_if((F.col(split) == s) & (F.col("label") == y) & c).alias(f"{n}|{s}|{y}") for n, c in scenarios.items() for s in ("train", "test") for y in (0, 1)]
    sizes = df.groupBy(endpoint).agg(*sides).collect()
    fine = [(r[endpoint], n) for r in sizes for n in scenarios if all(r[f"{n}|{s}|{y}"] for s in ("train", "test") for y in (0, 1))]
    ready = {mode: keep(vectors(df, cols), f"mode-{mode}") for mode, cols in modes.items()}

    def cell(e: str, scenario: str, mode: str, m: str) -> Callable[[], DataFrame]:
        x = ready[mode].filter((F.col(endpoint) == e) & scenarios[scenario])
        tags = {"endpoint": e, "scenario": scenario, "feature_mode": mode, "model": m}
        return lambda: models.fit_score(x.filter(F.col(split) == "train"), x.filter(F.col(split) == "test"), m).select("record_id", "label", "proba", *[F.lit(v).alias(k) for k, v in tags.items()])

    cells = {f"{e}_{n}_{mode}_{m}": cell(e, n, mode, m) for e, n in sorted(fine) for mode in modes for m in names}
    scored = run_cells(df.sparkSession, cells, folder)
    return metrics.experiment_row(scored, ["endpoint", "scenario", "feature_mode", "model"], n_boot=n_boot)


def nested_cv(df: DataFrame, model: str, resample: Callable[[DataFrame], DataFrame], k: int = 3, n_iter: int = 10, inner: int = 2, folder: str | None = None) -> DataFrame:
    """Per outer fold: resample the training rows, search inside them, choose the threshold on their inner scores, score the fold. Outer folds run side by side."""

    def cell(i: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            train, test = df.filter(F.col("fold") != i), df.filter(F.col("fold") == i)
            rows = keep(splits.stratified_kfold(resample(train.drop("fold")), inner, seed=i), "inner")
            _, params = models.random_search(rows, model, n_iter, inner, folder=f"{folder}/search-{i}" if folder else None)
            oof = models.oof_predictions(rows, model, k=inner, fit_fn=lambda t: models.fit(t, model, **params))
            t = metrics.tune_threshold(oof, []).first()["threshold_tuned"]
            return metrics.classification_metrics(predicted(models.fit(rows, model, **params)(test), t), ["fold"]).withColumns({"threshold": F.lit(float(t)), "params": F.lit(str(params))})

        return run

    return run_cells(df.sparkSession, {f"outer-{i}": cell(i) for i in range(k)}, folder, workers=2).drop("cell")


def ablation_study(df: DataFrame, subsets: dict[str, list[str]], names: tuple[str, ...], k: int = 3, split: str = "split", sim: str | None = None, n_boot: int = 500, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Feature subsets by models: CV on the training rows, a refit on all of them, and the test rows at the median of the folds' thresholds, with intervals, calibration and, if sim names a column, the domain. Returns the result rows and the pivot of CV MCC by subset."""
    df = keep(df, "ablation")
    ready = {}
    for s, cols in subsets.items():
        x = vectors(df, cols)
        ready[s] = keep(splits.stratified_kfold(x.filter(F.col(split) == "train"), k), "folds"), keep(x.filter(F.col(split) == "test"), "test")

    def cell(s: str, m: str) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            folds, test = ready[s]
            oof = keep(predicted(models.oof_predictions(folds, m, k=k)).select("fold", "label", "proba", "pred"), "oof")
            t = metrics.fold_threshold(metrics.oof_threshold(oof, ["fold"]), []).first()["threshold"]
            cv = metrics.classification_metrics(oof, ["fold"]).agg(F.round(F.avg("mcc"), 4).alias("cv_mcc_mean"), F.round(F.stddev_pop("mcc"), 4).alias("cv_mcc_std"))
            scored = models.fit_score(folds.drop("fold"), test, m).select("record_id", "label", "proba", *([sim] if sim else []), F.lit(s).alias("subset"), F.lit(m).alias("model"), F.lit(float(t)).alias("threshold"))
            return scored.crossJoin(F.broadcast(cv))  # one row

        return run

    by = ["subset", "model"]
    scored = run_cells(df.sparkSession, {f"{s}-{m}": cell(s, m) for s in subsets for m in names}, folder)
    at = scored.withColumn("pred", (F.col("proba") >= F.col("threshold")).cast("int"))
    fitted = metrics.classification_metrics(at, by).select(*by, F.col("mcc").alias("mcc_at_threshold"))
    known = scored.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("threshold", "cv_mcc_mean", "cv_mcc_std")])
    rows = keep(metrics.experiment_row(scored, by, n_boot=n_boot, sim=sim).join(known, by).join(fitted, by), "ablation-rows")
    return rows, rows.groupBy("model").pivot("subset", list(subsets)).agg(F.first("cv_mcc_mean"))


def imbalance_study(df: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]], model: str = "logistic", k: int = 3, endpoint: str = "endpoint", folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per endpoint, ways of resampling the training rows: CV in which only training folds are resampled, and test metrics; the best test MCC of an endpoint marked. Also the test rows' false positives by strategy: (endpoint, record_id, strategies, n)."""
    from assayline.operators.report import best_per_group

    df = keep(df, "imbalance")
    names = [r[0] for r in df.select(endpoint).distinct().orderBy(endpoint).collect()]

    def cell(e: str, s: str) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            x = df.filter(F.col(endpoint) == e)
            train = keep(splits.stratified_kfold(x.filter("split = 'train'"), k), "folds")
            fit_fn = lambda t: models.fit(keep(strategies[s](t.drop("fold")), "resampled"), model)
            cols = ["record_id", "label", "proba"]
            cv = models.oof_predictions(train, model, k=k, fit_fn=fit_fn).select(*cols, F.concat(F.lit("cv"), F.col("fold").cast("string")).alias("part"))
            test = fit_fn(train)(x.filter("split = 'test'")).select(*cols, F.lit("test").alias("part"))
            return cv.unionByName(test).withColumns({"endpoint": F.lit(e), "strategy": F.lit(s)})

        return run

    scored = predicted(run_cells(df.sparkSession, {f"{i}-{s}": cell(e, s) for i, e in enumerate(names) for s in strategies}, folder))
    by = ["endpoint", "strategy"]
    m = metrics.classification_metrics(scored, [*by, "part"])
    cv = m.filter("part <> 'test'").groupBy(*by).agg(F.round(F.avg("mcc"), 4).alias("cv_mcc_mean"), F.round(F.stddev_pop("mcc"), 4).alias("cv_mcc_std"))
    rows = best_per_group(m.filter("part = 'test'").drop("part").join(cv, by), ["endpoint"], "mcc", "strategy")
    wrong = scored.filter("part = 'test' and label = 0 and pred = 1").groupBy("endpoint", "record_id").agg(F.array_join(F.array_sort(F.collect_set("strategy")), "|").alias("strategies"), F.count_distinct("strategy").alias("n"))
    return rows, wrong


def sampling_cv_eval(df: DataFrame, model: str = "logistic", k: int = 3) -> DataFrame:
    """CV of one sample; chance values if it has one class or under 2k rows."""
    n = df.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    if n["n"] < 2 * k or not 0 < n["p"] < n["n"]:
        return df.sparkSession.createDataFrame([(0.0, 0.5, 0.0, 0.0, 0.0, 0)], "mcc_mean double, bacc_mean double, sens_mean double, spec_mean double, mcc_std double, n_folds long")
    return cv_summary(keep(splits.stratified_kfold(df, k), "folds"), model, k)


def sampling_grid(df: DataFrame, cols: list[str], ratios: tuple[int, ...] = (1, 2, 3, 5), model: str = "logistic", folder: str | None = None) -> DataFrame:
    """Ways to choose negatives by ratio, each scored by CV; best MCC, then best balanced accuracy, first. Ratios that the negatives don't suffice for are left out."""
    c = df.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")).first()
    ways = {"kmeans": lambda n: sampling.kmeans_medoid_sample(df.filter("label = 0"), cols, n), "profile": lambda n: sampling.profile_stratified_sample(df, cols, n), "combined": lambda n: sampling.combined_sample(df, cols, n)}

    def cell(way: str, r: int) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            sample = vectors(df.filter("label = 1").unionByName(ways[way](r * c["p"])), cols)
            return sampling_cv_eval(keep(sample, "sample"), model).select(F.lit(way).alias("method"), F.lit(r).alias("ratio"), "mcc_mean", "bacc_mean")

        return run

    fine = [r for r in ratios if r <= min(5, c["n"] // max(c["p"], 1))] or [1]
    out = run_cells(df.sparkSession, {f"{w}-{r}": cell(w, r) for r in fine for w in ways}, folder).drop("cell")
    return out.orderBy(F.desc("mcc_mean"), F.desc("bacc_mean"), "method", "ratio")


def external_validation(train: DataFrame, ext: DataFrame, model: str = "logistic", n_boot: int = 500, n_bits: int = 256) -> dict[str, DataFrame]:
    """Rows of ext whose text isn't in train, scored by a model of train on bits chosen on train alone.

    Returns zones (K3 at 0.5 and at the tuned threshold), domain (K1's summary), row (metrics, calibration and intervals,
    and MCC at both thresholds), outcomes (similarity by outcome) and counts (rows given, removed, left).
    """
    ext, counts = labels.external_rows(ext, train, "text")
    tr, te = hashed_shingle_bits(train, n_bits=n_bits), hashed_shingle_bits(ext, n_bits=n_bits)
    bits = [r["bit"] for r in bit_prevalence_filter(tr, 0.05, 0.95).orderBy("bit").collect()]  # at most n_bits
    tr, te = keep(bit_vectors(tr, bits), "train"), keep(bit_vectors(te, bits), "ext")
    scored = models.fit_score(tr, te, model)
    oof = metrics.tune_threshold(models.oof_predictions(splits.stratified_kfold(tr, 3), model, k=3), []).first()["threshold_tuned"]
    sims, near = domain.ad_similarity(tr, te)
    scored = keep(scored.select("record_id", "label", "proba").join(sims, "record_id").withColumn("experiment", F.lit("external")), "scored")
    zones = [domain.ad_stratified(predicted(scored, t), "max_sim").withColumn("threshold", F.lit(float(t))) for t in (0.5, oof)]
    fixed = metrics.classification_metrics(predicted(scored, float(oof)), ["experiment"]).select("experiment", F.lit(float(oof)).alias("threshold_oof"), F.col("mcc").alias("mcc_oof"))
    row = metrics.experiment_row(scored, ["experiment"], n_boot=n_boot, sim="max_sim").join(fixed, "experiment")
    return {"zones": zones[0].unionByName(zones[1]), "domain": near, "row": row, "outcomes": domain.outcome_similarity(predicted(scored), "max_sim"), "counts": counts}


def fn_augmentation(train: DataFrame, pool: DataFrame, model: str = "logistic", rounds: int = 3, near: float = 0.3) -> DataFrame:
    """Rounds of fitting, scoring the pool and moving its false negatives to the training rows; the last one only evaluates.

    Where rows have bits, each round tells how near the pool is to the training rows. The largest similarities are kept: a
    round compares the pool with the rows that were added alone, and takes the larger.
    """
    from assayline.operators.joins import tanimoto_max

    spark, out = train.sparkSession, []
    sims = keep(tanimoto_max(train, pool), "similarity") if "bits" in pool.columns else None
    for i in range(rounds):
        n = pool.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
        if n["n"] < 10 or not 0 < (n["p"] or 0) < n["n"]:
            break
        scored = keep(predicted(models.fit_score(train, pool, model)), "pool")
        m = metrics.classification_metrics(scored.withColumn("all", F.lit(1)), ["all"]).first()
        missed = keep(scored.filter("label = 1 and pred = 0").select(*train.columns), "missed")
        ad = sims.agg(F.round(F.avg((F.col("max_sim") >= near).cast("double")), 4), F.round(F.avg("max_sim"), 4)).first() if sims is not None else (None, None)
        out.append((i, train.count(), n["n"], int(m["fn"]), m["sens"], m["spec"], *ad))
        if i == rounds - 1 or m["fn"] == 0:
            break
        train = keep(train.unionByName(missed), "train")
        pool = keep(pool.join(missed.select("record_id"), "record_id", "left_anti"), "pool")
        if sims is not None:
            new = tanimoto_max(missed, pool).withColumnRenamed("max_sim", "_new")
            sims = keep(new.join(sims, "record_id").select("record_id", F.greatest("max_sim", "_new").alias("max_sim")), "similarity")
    return spark.createDataFrame(out, "round int, n_train long, n_pool long, n_fn int, sens double, spec double, ad_coverage double, ad_mean_sim double")


def fold_report(df: DataFrame, k: int = 3, resample: Callable[[DataFrame], DataFrame] | None = None, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Per fold: bits chosen on its training rows, how many of them all folds choose, rows before and after resampling, and with a model the fold's scores. And the manifest: (bit, folds, n_folds) of every bit that a fold chose."""
    folded = keep(splits.stratified_kfold(df, k), "folds")
    chosen = size = None
    for i in range(k):
        train = folded.filter(F.col("fold") != i)
        b = bit_prevalence_filter(train, 0.05, 0.95).select(F.lit(i).alias("fold"), "bit")
        s = train.agg(F.count("*").alias("n_train")).crossJoin((resample(train) if resample else train).agg(F.count("*").alias("n_resampled"))).withColumn("fold", F.lit(i))
        chosen, size = (b, s) if chosen is None else (chosen.unionByName(b), size.unionByName(s))
    chosen = keep(chosen, "bits")
    manifest = chosen.groupBy("bit").agg(F.array_sort(F.collect_list("fold")).alias("folds"), F.count("*").alias("n_folds"))  # at most k folds a bit
    per = chosen.join(manifest, "bit").groupBy("fold").agg(F.count("*").alias("n_bits"), F.count_if(F.col("n_folds") == k).alias("n_bits_all_folds")).join(size, "fold")
    if model:
        own = {r["fold"]: sorted(r["bits"]) for r in chosen.groupBy("fold").agg(F.collect_list("bit").alias("bits")).collect()}  # at most the number of bits

        def cell(i: int) -> Callable[[], DataFrame]:
            def run() -> DataFrame:
                x = bit_vectors(folded, own[i]).select("record_id", "fold", "label", "features", *([c for c in ("all",) if c in folded.columns]))
                train = x.filter(F.col("fold") != i)
                scored = predicted(models.fit_score(keep(resample(train) if resample else train, "resampled"), x.filter(F.col("fold") == i), model))
                return metrics.classification_metrics(scored, ["fold"]).select("fold", "mcc", "bacc", "sens", "spec")

            return run

        per = per.join(run_cells(df.sparkSession, {f"fold-{i}": cell(i) for i in own}).drop("cell"), "fold")
    return per, manifest


def build_feature_table(df: DataFrame, aux: DataFrame, on: str = "record_id", blocks: dict[str, str] | None = None, path: str | None = None, n_bits: int = 256) -> tuple[DataFrame, DataFrame]:
    """One wide table: names unified, side table joined, bits added, texts of too many values dropped, split tagged; written if there is a path, split by split. And its audit: columns of each block per split, with rows and nulls."""
    from assayline.operators.joins import coalesce_join_columns, join_left
    from assayline.sources.tables import drop_high_cardinality, write_table

    wide = coalesce_join_columns(join_left(df, aux, on))
    wide = drop_high_cardinality(hashed_shingle_bits(wide, n_bits=n_bits), 50)
    if "split" not in wide.columns:
        wide = wide.withColumn("split", F.lit("train"))
    if path:
        write_table(wide, path, by=["split"])
        wide = df.sparkSession.read.parquet(path)
    named = {b: [c for c in wide.columns if c == p or c.startswith(p)] for b, p in (blocks or {"bits": "bits"}).items()}
    stats = [F.struct(F.lit(b).alias("block"), F.lit(len(cols)).alias("n_columns"), F.sum(sum((F.col(c).isNull().cast("long") for c in cols), F.lit(0))).alias("n_null")) for b, cols in named.items() if cols]
    audit = wide.groupBy("split").agg(F.count("*").alias("n"), F.array(*stats).alias("b")).select("split", "n", F.explode("b").alias("b")).select("split", "n", "b.*")
    return wide, audit


def scenario_comparison(scenarios: dict[str, DataFrame], model: str = "logistic") -> DataFrame:
    """Sizes, positives, rates and test metrics per scenario on its group split; the best by MCC marked."""
    from assayline.operators.report import best_per_group

    def cell(name: str, df: DataFrame) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            x = keep(splits.group_split(df), "split")
            scored = predicted(models.fit_score(x.filter("split = 'train'"), x.filter("split = 'test'"), model)).withColumn("scenario", F.lit(name))
            sides = [f(s).alias(f"{s}_{n}") for s in ("train", "test") for n, f in (("n", lambda s: F.count_if(F.col("split") == s)), ("pos", lambda s: F.count_if((F.col("split") == s) & (F.col("label") == 1))))]
            size = x.agg(*sides, F.round(F.avg("label"), 4).alias("pos_rate"))
            rates = [F.round(F.col(f"{s}_pos") / F.nullif(F.col(f"{s}_n"), F.lit(0)), 4).alias(f"{s}_pos_rate") for s in ("train", "test")]
            return metrics.classification_metrics(scored, ["scenario"]).crossJoin(size.select("*", *rates))  # one row each

        return run

    out = run_cells(next(iter(scenarios.values())).sparkSession, {n: cell(n, df) for n, df in scenarios.items()}).drop("cell")
    return best_per_group(out.withColumn("all", F.lit(1)), ["all"], "mcc", "scenario").drop("all")


def cluster_ungrouped(df: DataFrame, cols: list[str], n_clusters: int = 50, seed: int = 42, most: int = 2000) -> DataFrame:
    """Rows without a group (group_type acyclic) get pseudo-groups by Ward's clustering, min(n_clusters, rows // 2) of them, if there are more rows than n_clusters.

    Rows are first summed up in micro-clusters (count and sum), which is all that Ward's merges need: each distinct point is
    one, up to `most` of them, beyond which k-means makes as many. The driver holds these; groups are numbered by their
    smallest record_id.
    """
    from assayline.operators.clusters import ward

    rest = keep(standardize(df.filter("group_type = 'acyclic'"), cols).select("record_id", F.array(*[F.col(c).cast("double") for c in cols]).alias("_v")), "ungrouped")
    n = rest.count()
    if n <= n_clusters:
        return df
    spots = rest.groupBy("_v").agg(F.count("*").alias("_n"), F.min("record_id").alias("_first"))
    if spots.count() <= most:
        micro = rest.withColumn("_m", F.xxhash64("_v"))
    else:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        x = rest.withColumn("features", array_to_vector("_v"))
        micro = keep(KMeans(k=most, seed=seed, featuresCol="features", predictionCol="_m").fit(x).transform(x).select("record_id", "_v", F.col("_m").cast("long")), "micro")
    sums = micro.groupBy("_m").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("_v")[i]) for i in range(len(cols))]).alias("s"), F.min("record_id").alias("first")).orderBy("first").collect()
    label = ward([r["n"] for r in sums], [r["s"] for r in sums], max(2, min(n_clusters, n // 2)))
    groups = df.sparkSession.createDataFrame([(r["_m"], f"ACYC_C{c}") for r, c in zip(sums, label, strict=True)], "_m long, _g string")
    return df.join(micro.join(groups, "_m").select("record_id", "_g"), "record_id", "left").withColumn("group", F.coalesce("_g", "group")).drop("_g")
