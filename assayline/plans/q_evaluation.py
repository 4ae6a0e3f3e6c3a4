"""Queries: metrics, intervals, thresholds, tests, domain, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayline.operators import domain, metrics, report
from assayline.plans import fixtures as fx
from assayline.plans.registry import draw_sql, query

ONE = "experiment"


def cells(by: str, src: str, pred: str = "(proba >= 0.5)::int") -> str:
    return f"select {by}, sum((label = 1 and {pred} = 1)::int)::bigint as tp, sum((label = 0 and {pred} = 1)::int)::bigint as fp, sum((label = 1 and {pred} = 0)::int)::bigint as fn, sum((label = 0 and {pred} = 0)::int)::bigint as tn from {src} group by {by}"


def scores(src: str, keep: str, digits: int = 4) -> str:
    d = "tp::double * tn - fp::double * fn"
    both = "tp + fn > 0 and tn + fp > 0"
    z = lambda x: f"round(case when {both} then coalesce({x}, 0) else 0 end, {digits})"
    return (
        f"select {keep}, {z(f'({d}) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0)')} as mcc, {z('(tp::double / nullif(tp + fn, 0) + tn::double / nullif(tn + fp, 0)) / 2')} as bacc, "
        f"{z('2 * tp::double / nullif(2 * tp + fp + fn, 0)')} as f1, {z('tp::double / nullif(tp + fn, 0)')} as sens, {z('tn::double / nullif(tn + fp, 0)')} as spec from ({src})"
    )


RANK = "c as (select experiment, proba as score, sum((label = 0)::int)::bigint as n0, sum((label = 1)::int)::bigint as n1 from {0} group by all), r as (select *, sum(n1) over (partition by experiment order by score desc) as tp, sum(n0) over (partition by experiment order by score desc) as fp, sum(n1) over (partition by experiment) as p, sum(n0) over (partition by experiment) as n from c)"
AUC = "select experiment, round(coalesce(sum(n0::double * (tp - n1) + n0::double * n1 / 2) / nullif(max(p)::double * max(n), 0), 0), 4) as roc_auc from r group by experiment"
PR = "select experiment, round(coalesce(sum(n1::double / nullif(p, 0) * (tp::double / nullif(tp + fp, 0))), 0), 4) as pr_auc from r group by experiment"
GRID = "(select 0.1::double + i * ((0.1::double + 0.02::double) - 0.1::double) as threshold from range({0}) t(i))"


def at_grid(src: str, n: int) -> str:
    return f"select experiment, threshold, sum((label = 1 and proba >= threshold)::int)::bigint as tp, sum((label = 0 and proba >= threshold)::int)::bigint as fp, sum((label = 1 and proba < threshold)::int)::bigint as fn, sum((label = 0 and proba < threshold)::int)::bigint as tn from {src}, {GRID.format(n)} group by all"


def tuned(src: str) -> str:
    ok = "tp + fp > 0 and tn + fn > 0"
    return f"select experiment, round(coalesce(arg_max(threshold, m) filter (ok), 0.5), 6) as threshold_tuned, round(coalesce(max(m.m) filter (ok), 0), 4) as mcc_tuned from (select experiment, threshold, {{'m': mcc, 't': -threshold}} as m, ok from ({scores(at_grid(src, 40), f'experiment, threshold, {ok} as ok', 10)})) group by experiment"


def _pred(spark, sf):
    p = fx.predictions(spark, sf)
    return p.withColumns({"pred": (F.col("proba") >= 0.5).cast("int"), "pred_b": (F.col("proba_b") >= 0.5).cast("int")})


def _events(spark, sf):
    return fx.events(spark, sf).withColumns({"pred": (F.col("proba") >= 0.5).cast("int"), "pred_b": (F.col("proba_b") >= 0.5).cast("int")})


@query("g1_classification_metrics", f"+ x as ({cells('experiment, grp', 'v_pred')}) {scores('select * from x', 'experiment, grp, tp, fp, fn, tn')}", "v_pred")
def g1(spark, sf):
    return metrics.classification_metrics(_pred(spark, sf), ["experiment", "grp"])


@query("g2_roc_auc", f"+ {RANK.format('v_events')} {AUC}", "v_events")
def g2(spark, sf):
    return metrics.roc_auc(_events(spark, sf), [ONE])


@query("g3_pr_auc", f"+ {RANK.format('v_events')} {PR}", "v_events")
def g3(spark, sf):
    return metrics.pr_auc(_events(spark, sf), [ONE])


BRIER = "select experiment, round(avg((proba - label) * (proba - label)), 6) as brier from {0} group by experiment"


@query("g4_brier", BRIER.format("v_pred"), "v_pred")
def g4(spark, sf):
    return metrics.brier(_pred(spark, sf), [ONE])


ECE = "select experiment, round(sum(case when bin is null then 0 else k * abs(y - q) end) / sum(k), 4) as ece from (select experiment, bin, count(*) as k, avg(label) as y, avg(proba) as q from (select x.*, (select max(i) from range(10) t(i) where x.proba >= i * 0.1::double and x.proba < 1) as bin from {0} x) group by all) group by experiment"


@query("g5_ece", ECE.format("v_pred"), "v_pred")
def g5(spark, sf):
    return metrics.ece(_pred(spark, sf), [ONE])


@query("g6_calibration_curve", "select experiment, least(floor(proba_b * 10), 9)::int as bin, count(*) as n, round(avg(proba_b), 6) as mean_score, round(avg(label), 6) as fraction_pos from v_pred group by all", "v_pred")
def g6(spark, sf):
    return metrics.calibration_curve(_pred(spark, sf), [ONE], "proba_b")


@query("g7_curves", f"+ {RANK.format('v_pred')} select experiment, score as threshold, round(fp::double / nullif(n, 0), 6) as fpr, round(tp::double / nullif(p, 0), 6) as tpr, round(tp::double / nullif(tp + fp, 0), 6) as precision from r", "v_pred")
def g7(spark, sf):
    return metrics.curves(_pred(spark, sf), [ONE])


BOOT = f"""g as (select experiment, label, proba, count(*) as k from v_events group by all), s as (select *, least(256, k - piece * 256) as m from (select *, unnest(range((k + 255) // 256)) as piece from g)),
 p as (select m, i, sum(exp(-m + i * ln(m) - lgamma(i + 1))) over (partition by m order by i) as c from (select distinct m from s), range(0, 1064) t(i) where i < 4 * m + 40), q0 as (select m, list(c order by i) as cdf from p where c <= 0.9999999999 or i = 0 group by m),
 u as (select experiment, label, proba, b, cdf, ('0x' || substr(md5(concat_ws('|', label, experiment, floor(proba * 1099511627776)::bigint, piece, b // 4)), 1 + 8 * (b % 4), 8))::bigint / 4294967296.0::double as u from s join q0 using (m), range({{n}}) t(b)),
 w as (select experiment, label, proba, b, len(list_filter(cdf, lambda c: u >= c)) as w from u),
 c as (select experiment, b, proba as score, sum(case when label = 0 then w else 0 end) as n0, sum(case when label = 1 then w else 0 end) as n1 from w where w > 0 group by all),
 r as (select *, sum(n1) over (partition by experiment, b order by score desc) as tp0, sum(n1) over (partition by experiment, b) as p, sum(n0) over (partition by experiment, b) as n from c),
 m as (select experiment, b, sum(case when score >= 0.5 then n1 else 0 end) as tp, sum(case when score >= 0.5 then n0 else 0 end) as fp, max(p) as p, max(n) as n, sum(n0::double * (tp0 - n1) + n0::double * n1 / 2) as wins, sum(n1 * (score - 1) * (score - 1) + n0 * score * score) as sq from r group by all having max(p) > 0 and max(n) > 0),
 q as ({scores("select *, p - tp as fn, n - fp as tn from m", "experiment, b, wins / (p::double * n) as roc_auc, sq / (p + n) as brier", 15)}),
 l as (unpivot q on mcc, bacc, sens, spec, brier, roc_auc into name metric value value)"""


@query("g8_bootstrap_ci", f"+ {BOOT.format(n=500)} select experiment, metric, round(avg(value), 4) as mean, round(quantile_cont(value, 0.025), 4) as lo, round(quantile_cont(value, 0.975), 4) as hi from l group by all", "v_events")
def g8(spark, sf):
    return metrics.bootstrap_ci(_events(spark, sf), [ONE])


@query("g9_fold_summary", f"+ x as ({cells('experiment, grp', 'v_pred')}), y as ({scores('select * from x', 'experiment, grp')}), l as (unpivot y on mcc, bacc, sens into name metric value value) select experiment, metric, round(avg(value), 4) as mean, round(stddev_samp(value), 4) as std, round(quantile_cont(value, 0.025), 4) as lo, round(quantile_cont(value, 0.975), 4) as hi, count(value) as n from l group by all", "v_pred")
def g9(spark, sf):
    m = metrics.classification_metrics(_pred(spark, sf), ["experiment", "grp"])
    return metrics.fold_summary(metrics.unpivot(m, ["experiment"], ["mcc", "bacc", "sens"]), ["experiment"])


@query("g10_tune_threshold", tuned("v_events"), "v_events")
def g10(spark, sf):
    return metrics.tune_threshold(_events(spark, sf), [ONE])


@query("g11_oof_threshold_grid", f"+ x as ({scores(at_grid('v_events', 41), 'experiment, threshold', 15)}) select experiment, round(threshold, 6) as threshold, round(mcc, 6) as mcc, round(f1, 6) as f1, round(sens + spec - 1, 6) as youden, row_number() over (partition by experiment order by round(mcc, 10) desc, threshold) = 1 as best from x", "v_events")
def g11(spark, sf):
    return metrics.oof_threshold_grid(_events(spark, sf), [ONE])


@query("g12_threshold_decomposition", f"+ t as (select experiment, threshold, sum((label = 1 and proba >= threshold)::int)::bigint as tp, sum((label = 0 and proba >= threshold)::int)::bigint as fp, sum((label = 1 and proba < threshold)::int)::bigint as fn, sum((label = 0 and proba < threshold)::int)::bigint as tn from v_events, (values (0.5::double), (0.2::double)) g(threshold) group by all), m as ({scores('select * from t', 'experiment, threshold')}), b as ({tuned('v_events')}) select m.experiment, max(mcc) filter (threshold = 0.5) as mcc_default, max(mcc) filter (threshold = 0.2) as mcc_prevalence, max(mcc_tuned) as mcc_oracle from m join b using (experiment) group by m.experiment", "v_events")
def g12(spark, sf):
    return metrics.threshold_decomposition(_events(spark, sf), [ONE], 0.2)


@query("g13_mcnemar", "select experiment, a_better, b_better, a_better + b_better as n_discordant, round(coalesce((abs(a_better - b_better) - 1)::double * (abs(a_better - b_better) - 1) / nullif(a_better + b_better, 0), 0), 4) as chi2 from (select experiment, count(*) filter ((proba >= 0.5)::int = label and (proba_b >= 0.5)::int <> label) as a_better, count(*) filter ((proba >= 0.5)::int <> label and (proba_b >= 0.5)::int = label) as b_better from v_events group by experiment)", "v_events")
def g13(spark, sf):
    e = _events(spark, sf)
    return metrics.mcnemar(e, e.select("record_id", "experiment", F.col("pred_b").alias("pred")), [ONE], with_p=False)


@query("g13_mcnemar_p")
def g13p(spark, sf):
    e = _events(spark, sf)
    return metrics.mcnemar(e, e.select("record_id", "experiment", F.col("pred_b").alias("pred")), [ONE])


@query("g14_wilcoxon_signed_rank", "+ d as (select experiment, floor(proba * 100) - floor(proba_b * 100) as d from v_events), c as (select experiment, abs(d) as m, count(*) as k, count(*) filter (d > 0) as up from d where d <> 0 group by all), r as (select *, coalesce(sum(k) over (partition by experiment order by m rows between unbounded preceding and 1 preceding), 0) + (k + 1) / 2.0::double as rank from c) select experiment, sum(k)::bigint as n, case when sum(k) >= 5 then least(sum(rank * up), sum(rank * (k - up))) end as statistic, (select round(avg(d), 6) from d where d.experiment = r.experiment) as mean_diff from r group by experiment", "v_events")
def g14(spark, sf):
    e = _events(spark, sf).withColumns({"a": F.floor(F.col("proba") * 100).cast("double"), "b": F.floor(F.col("proba_b") * 100).cast("double")})
    return metrics.wilcoxon_signed_rank(e, [ONE], "a", "b")


OUTCOME = "case when label = 1 and {0} = 1 then 'TP' when label = 1 and {0} = 0 then 'FN' when label = 0 and {0} = 0 then 'TN' when label = 0 and {0} = 1 then 'FP' end"


@query("g14_wilcoxon_p")
def g14p(spark, sf):
    e = _events(spark, sf).withColumn("few", F.col("record_id") < 20)  # groups of each kind: exact and normal
    d = e.withColumns({"a": F.floor(F.col("proba") * 100), "b": F.floor(F.col("proba_b") * 100)})
    return metrics.wilcoxon_signed_rank(d, [ONE, "few"], "a", "b", with_p=True)


@query("g16_outcome_label", f"select record_id, {OUTCOME.format('(proba >= 0.5)::int')} as outcome from v_events", "v_events")
def g16(spark, sf):
    return _events(spark, sf).select("record_id", metrics.outcome_label().alias("outcome"))


# Result rows: lineitem by line status, supplier and tax
ROWS_SQL = f"select endpoint, model, scenario, mcc, bacc, sens, spec, tp + fp + fn + tn as test_n, tp + fn as test_n_pos from ({scores(cells('endpoint, model, scenario', '''(select l_linestatus as endpoint, concat('m', l_suppkey % 6) as model, case when l_tax < 0.03 then 'raw_all' when l_tax < 0.06 then 'no_metal' else 'salt_stripped' end as scenario, (l_returnflag = 'R')::int as label, round(l_discount * 10, 1) as proba from lineitem)'''), 'endpoint, model, scenario, tp, fp, fn, tn')})"


def _rows(spark, sf):
    x = fx.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("endpoint"), F.concat(F.lit("m"), (F.col("l_suppkey") % 6).cast("string")).alias("model"), F.when(F.col("l_tax") < 0.03, "raw_all").when(F.col("l_tax") < 0.06, "no_metal").otherwise("salt_stripped").alias("scenario"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.round(F.col("l_discount") * 10, 1) >= 0.5).cast("int").alias("pred"),
    )
    m = metrics.classification_metrics(x, ["endpoint", "model", "scenario"])
    return m.select("endpoint", "model", "scenario", "mcc", "bacc", "sens", "spec", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("test_n"), (F.col("tp") + F.col("fn")).alias("test_n_pos"))


@query("g15_pairwise_models", f"with r as ({ROWS_SQL}), b as (select endpoint, model, max(mcc) as m from r group by all) select a.endpoint, a.model as model_a, a.m as mcc_a, b.model as model_b, b.m as mcc_b, round(a.m - b.m, 4) as diff, case when a.m > b.m then a.model else b.model end as better from b a join b on a.endpoint = b.endpoint and a.model < b.model")
def g15(spark, sf):
    return report.pairwise_models(_rows(spark, sf), "endpoint", "model", "mcc")


@query("g17_annotate", f"with r as ({ROWS_SQL}) select endpoint, model, scenario, coalesce(nullif(concat_ws('; ', case when test_n_pos < 15 then 'few positives' end, case when contains(endpoint, 'sampling') then 'sampled endpoint' end, case when abs(mcc - bacc) > 0.2 then 'test and CV differ' end, case when mcc < 0.1 and test_n > 50 then 'near chance' end), ''), 'OK') as warnings from r")
def g17(spark, sf):
    c = F.col
    return _rows(spark, sf).select("endpoint", "model", "scenario", metrics.annotate(c("test_n_pos"), c("endpoint"), c("mcc"), c("bacc"), c("test_n")).alias("warnings"))


@query("g18_checklist", 'with c as (select unnest([\'has_rows\', \'mcc_complete\', \'mcc_in_range\', \'test_sets_filled\', \'auc_in_range\', \'probabilities_in_range\', \'labels_binary\']) as "check") select "check", "check" <> \'probabilities_in_range\' or (select min(proba) >= 0 and max(proba) <= 1 from (select least(value / 500, 1.0) as proba from events)) as passed from c')
def g18(spark, sf):
    e = _events(spark, sf)
    return metrics.checklist(metrics.experiment_row(e, [ONE]), e)


@query("g19_experiment_row", f"""+ {RANK.format('v_events')}, x as ({cells('experiment', 'v_events')}), s as ({scores('select * from x', 'experiment, tp, fp, fn, tn')}), z as (select experiment, count(*) as test_n, sum(label)::bigint as test_n_pos, round(avg(label), 4) as test_pos_rate from v_events group by experiment),
 a as ({AUC}), p as ({PR}), b as ({BRIER.format('v_events')}), e as ({ECE.format('v_events')}), t as ({tuned('v_events')}) select * from z join s using (experiment) join a using (experiment) join p using (experiment) join b using (experiment) join e using (experiment) join t using (experiment)""", "v_events")  # fmt: skip
def g19(spark, sf):
    return metrics.experiment_row(_events(spark, sf), [ONE])


G19_FULL = f"""+ {BOOT.format(n=500)}, ci as (select experiment, name as metric, round(quantile_cont(value, 0.025), 4) as lo, round(quantile_cont(value, 0.975), 4) as hi from (select experiment, metric as name, value from l) group by all),
 wide as (select experiment, {", ".join(f"max({e}) filter (metric = '{m}') as {m}_{e}" for m in ("mcc", "bacc", "sens", "spec", "brier", "roc_auc") for e in ("lo", "hi"))} from ci group by experiment),
 xf as ({cells("experiment, record_id % 5", "v_events").replace("select experiment, record_id % 5,", "select experiment, record_id % 5 as fold,")}), sf as ({scores("select * from xf", "experiment, fold")}), cv as (select experiment, round(avg(mcc), 4) as cv_mcc_mean, round(stddev_pop(mcc), 4) as cv_mcc_std from sf group by experiment),
 ad as (select experiment, round(avg((proba_b >= 0.3)::int), 4) as ad_coverage, round(avg(proba_b), 4) as ad_mean_sim, count(*) filter (record_id % 5 <> 0) as train_n, 1.0::double as coverage, 0.5::double as threshold_default from v_events group by experiment)
 select * from wide join cv using (experiment) join ad using (experiment)"""


@query("g19_experiment_row_full", G19_FULL, "v_events")
def g19_full(spark, sf):
    """The columns that g19 doesn't have."""
    e = _events(spark, sf)
    cv = metrics.classification_metrics(e.withColumn("fold", F.col("record_id") % 5), [ONE, "fold"])
    sizes = e.groupBy(ONE).agg(F.count_if(F.col("record_id") % 5 != 0).alias("train_n"), F.count("*").alias("original_n"))
    row = metrics.experiment_row(e, [ONE], n_boot=500, sim="proba_b", cv=cv, sizes=sizes)
    ends = [f"{m}_{end}" for m in ("mcc", "bacc", "sens", "spec", "brier", "roc_auc") for end in ("lo", "hi")]
    return row.select(ONE, *ends, "cv_mcc_mean", "cv_mcc_std", "ad_coverage", "ad_mean_sim", "train_n", "coverage", "threshold_default")


@query("g18_run_checklist", f"""with r as ({ROWS_SQL}), c(k, v) as (values ('fixed_split', true), ('conflicts', (select count(distinct o_orderkey % 3) = 3 from orders)), ('domain_diagnosed', (select count(*) > 0 from orders)), ('domain_ldo', (select count(*) > 0 from orders)), ('cross_ep', (select count(distinct o_orderkey % 3) > 1 from orders)), ('cv_selection', (select count(*) > 0 from events)),
 ('salt_stripped_verified', (select coalesce(bool_or(a.mcc <> coalesce(b.mcc, -1)), false) from r a left join r b on a.endpoint = b.endpoint and a.model = b.model and b.scenario = 'raw_all' where a.scenario = 'salt_stripped')), ('statistical_tests', (select count(*) > 0 from events)), ('learning_curves', (select count(*) > 0 from events)), ('bootstrap_ci', false), ('ad_computed', (select count(spec) = count(*) from r)), ('calibration', (select count(bacc) = count(*) from r)), ('shap_computed', (select count(*) > 0 from documents)))
 select k as "check", v as passed from c""")
def g18_run(spark, sf):
    """The run's tables as other queries give them; its result rows have no intervals, so that one check fails."""
    from assayline.operators import enrich, labels, splits

    rec, e = fx.records(spark, sf), _events(spark, sf)
    held = splits.leave_source_out(rec)
    rows = _rows(spark, sf).withColumns({"feature_mode": F.lit("compact"), "ad_coverage": F.col("spec"), "brier": F.col("bacc")})
    conflicts = rec.groupBy("endpoint").agg(F.count("*").alias("n"))
    tables = {
        "splits": splits.split_report(splits.group_split(rec)), "conflicts": conflicts, "domain": enrich.domain_confounding(rec), "held_out": held, "overlap": labels.dataset_overlap(rec), "cv": metrics.fold_summary(metrics.unpivot(metrics.classification_metrics(e, [ONE]), [], ["mcc"]), []),
        "rows": rows, "mcnemar": metrics.mcnemar(e, e.withColumn("pred", F.col("pred_b")), [ONE], with_p=False), "curves": metrics.fold_summary(metrics.unpivot(metrics.classification_metrics(e, [ONE]), [], ["mcc"]), []), "importances": _importances(spark, sf),
    }
    return metrics.run_checklist(tables)


@query("g20_fold_threshold", f"+ f as (select *, concat(experiment, '_', record_id % 3) as e from v_events), t as ({tuned('(select label, proba, e as experiment from f)')}) select split_part(experiment, '_', 1) as experiment, quantile_cont(threshold_tuned, 0.5) as threshold from t group by 1", "v_events")
def g20(spark, sf):
    e = _events(spark, sf).withColumn("fold", F.col("record_id") % 3)
    return metrics.fold_threshold(metrics.tune_threshold(e, ["experiment", "fold"]).withColumnRenamed("threshold_tuned", "threshold"), ["experiment"])


# Domain


BITS = "select doc_id as record_id, list_distinct(list_transform(string_split(text, ' '), lambda w: ('0x' || substr(md5(w), 1, 6))::bigint % 4096)) as bits from documents"
SIMS = f"d as materialized ({BITS}), e as materialized (select record_id, len(bits) as n, unnest(bits) as b from d), p as (select a.record_id as t, a.n as na, b.n as nb, count(*) as k from e a join e b on a.b = b.b and a.record_id % 5 = 0 and b.record_id % 5 <> 0 group by a.record_id, b.record_id, a.n, b.n), s as (select t as record_id, max(k / (na + nb - k)::double) as max_sim from p group by t)"


@query("k1_ad_similarity", f"with {SIMS} select round(avg((max_sim >= 0.3)::int), 4) as coverage, count(*) filter (max_sim >= 0.3) as n_in, count(*) filter (max_sim < 0.3) as n_out, round(avg(max_sim), 4) as mean_sim, round(median(max_sim), 4) as median_sim from s")
def k1(spark, sf):
    return domain.ad_similarity(*fx.bits(spark, sf))[1]


@query("k2_ad_distance", """+ tr as (select * from v_vec where split = 'train'), nn as (select a.record_id, min(list_distance(a.v, b.v)) as d from tr a join tr b on a.record_id <> b.record_id group by 1),
 l as (select quantile_cont(d, 0.95) as threshold, median(d) as m from nn), te as (select a.record_id, min(list_distance(a.v, b.v)) as d from (select * from v_vec where split = 'test') a join tr b on a.record_id <> b.record_id group by 1)
 select round(max(threshold), 4) as threshold, count(*) filter (d > threshold) as n_ood, round(avg((d > threshold)::int), 4) as ood_fraction, round(max(m), 4) as train_median, round(median(d), 4) as test_median from te, l""", "v_vec")  # fmt: skip
def k2(spark, sf):
    v = fx.vectors(spark, sf)
    return domain.ad_distance(v.filter("split = 'train'"), v.filter("split = 'test'"), most=None)


@query("k3_ad_stratified", f"+ z as (select *, unnest(['all', case when proba_b >= 0.4 then 'in' else 'out' end]) as zone from v_events), x as ({cells('zone', 'z')}), m as ({scores('select * from x', 'zone, tp, fp, fn, tn')}), n as (select zone, count(*) as n, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg, round(median(proba_b), 4) as sim_median from z group by zone) select zone, n, n_pos, n_neg, tp, fp, fn, tn, sens, spec, mcc, sim_median from m join n using (zone)", "v_events")
def k3(spark, sf):
    return domain.ad_stratified(_events(spark, sf), "proba_b")


@query("k4_outcome_similarity", f"select {OUTCOME.format('(proba >= 0.5)::int')} as outcome, count(*) as n, round(avg(proba_b), 4) as mean, round(median(proba_b), 4) as median, round(quantile_cont(proba_b, 0.25), 4) as q25, round(quantile_cont(proba_b, 0.75), 4) as q75, round(100.0::double * avg((proba_b < 0.5)::int), 2) as pct_below_50, round(100.0::double * avg((proba_b < 0.4)::int), 2) as pct_below_40, round(100.0::double * avg((proba_b < 0.3)::int), 2) as pct_below_30 from v_events group by 1", "v_events")
def k4(spark, sf):
    return domain.outcome_similarity(_events(spark, sf), "proba_b")


# Reports
PRI = "case scenario when 'raw_all' then 0 when 'no_metal' then 1 else 2 end"


@query("l1_best_per_group", f"with r as ({ROWS_SQL}) select endpoint, model, scenario, mcc, row_number() over (partition by endpoint order by mcc desc, {PRI}, model) = 1 as is_primary from r")
def l1(spark, sf):
    return report.best_per_group(_rows(spark, sf), ["endpoint"], "mcc", report.scenario_priority(), "model").select("endpoint", "model", "scenario", "mcc", "is_primary")


@query("l2_top_k_per_group", f"with r as ({ROWS_SQL}) select * from (select endpoint, model, scenario, mcc, row_number() over (partition by endpoint order by mcc desc, model, scenario)::int as rank from r) where rank <= 2")
def l2(spark, sf):
    return report.top_k_per_group(_rows(spark, sf), ["endpoint"], "mcc", 2, "model", "scenario").select("endpoint", "model", "scenario", "mcc", "rank")


@query("l3_leaderboard", f"with r as ({ROWS_SQL}) select endpoint, model, scenario, mcc, bacc from r where mcc is not null order by endpoint, mcc desc")
def l3(spark, sf):
    return report.leaderboard(_rows(spark, sf), "endpoint", "mcc", ["endpoint", "model", "scenario", "mcc", "bacc", "no_such_column"])


@query("l4_pivot_metric", f"with r as ({ROWS_SQL}) select endpoint, max(mcc) filter (scenario = 'raw_all') as raw_all, max(mcc) filter (scenario = 'no_metal') as no_metal, max(mcc) filter (scenario = 'salt_stripped') as salt_stripped from r group by endpoint")
def l4(spark, sf):
    return report.pivot_metric(_rows(spark, sf), "endpoint", "scenario", list(report.PRIORITY), "mcc")


@query("l5_delta_table", f"with r as ({ROWS_SQL}) select endpoint, model, scenario, round(bacc - mcc, 4) as bacc_over_mcc, round(sens - spec, 4) as sens_over_spec from r")
def l5(spark, sf):
    return report.delta_table(_rows(spark, sf), {"bacc_over_mcc": ("bacc", "mcc"), "sens_over_spec": ("sens", "spec")}, ["endpoint", "model", "scenario"])


@query("l6_benchmark_compare", f"with r as ({ROWS_SQL}) select 'F' as endpoint, 'published' as source, 0.5::double as mcc union all select 'O', 'published', 0.4::double union all select endpoint, 'ours', max(mcc) from r group by endpoint")
def l6(spark, sf):
    published = spark.createDataFrame([("F", "published", 0.5), ("O", "published", 0.4)], "endpoint string, source string, mcc double")
    return report.benchmark_compare(_rows(spark, sf), published, "endpoint", "mcc")


def _importances(spark, sf):
    from assayline.operators.features import PATTERNS, pattern_counts

    d = pattern_counts(fx.docs(spark, sf), keep=("domain",))
    cells = F.explode(F.array(*[F.struct(F.lit(f"fg_{n}").alias("feature"), F.col(f"{n}_present").cast("double").alias("v")) for n in PATTERNS]))
    return d.select(F.col("domain").alias("experiment"), cells.alias("x")).groupBy("experiment", "x.feature").agg(F.round(F.avg("x.v"), 6).alias("importance"))


def importances_sql() -> str:
    from assayline.operators.features import PATTERNS

    cells = ", ".join(f"{{'f': 'fg_{n}', 'v': (len(regexp_extract_all(text, '{p}')) > 0)::int::double}}" for n, (_, p) in PATTERNS.items())
    return f"select domain as experiment, x.f as feature, round(avg(x.v), 6) as importance from (select domain, unnest([{cells}]) as x from v_docs) group by all"


@query("l7_importance_rollup", f"+ i as ({importances_sql()}), r as (select distinct domain as experiment, 'all' as endpoint, length(domain)::double as mcc from v_docs), b as (select * from r order by mcc desc, experiment limit 1) select * from (select i.experiment, feature, importance, endpoint, mcc, row_number() over (order by importance desc, feature)::int as rank from i join b using (experiment)) where rank <= 5", "v_docs")
def l7(spark, sf):
    rows = fx.docs(spark, sf).select(F.col("domain").alias("experiment"), F.lit("all").alias("endpoint"), F.length("domain").cast("double").alias("mcc")).distinct()
    return report.importance_rollup(_importances(spark, sf), rows, 5)


@query("l9_importance_blocks", f"+ i as ({importances_sql()}) select experiment, 'functional_group' as block, round(sum(importance), 6) as importance, count(*) as n_features from i group by experiment", "v_docs")
def l9(spark, sf):
    return report.importance_blocks(_importances(spark, sf))


@query("l10_hyperparam_landscape", "select l_linenumber as depth, round(avg(l_discount) filter (l_returnflag = 'A'), 4) as \"A\", round(avg(l_discount) filter (l_returnflag = 'N'), 4) as \"N\", round(avg(l_discount) filter (l_returnflag = 'R'), 4) as \"R\" from lineitem group by 1")
def l10(spark, sf):
    return report.hyperparam_landscape(fx.table(spark, sf, "lineitem").withColumnRenamed("l_linenumber", "depth"), "depth", "l_returnflag", ["A", "N", "R"], "l_discount")


@query("l11_grid_summary", f"with r as ({ROWS_SQL}), l as (select endpoint, unnest([{{'a': 'model', 'l': model}}, {{'a': 'scenario', 'l': scenario}}]) as x, mcc from r), s as (select endpoint, x.a as axis, x.l as level, sum(round(mcc * 10000)::bigint)::bigint as s, sum(round(mcc * 10000)::bigint * round(mcc * 10000)::bigint)::bigint as q, count(*) as n from l group by all) select endpoint, axis, level, floor(s::double / n + 0.5) / 10000 as mean, case when n > 1 then floor(sqrt((n * q - s * s)::double / (n * (n - 1))) + 0.5) / 10000 end as sd, n from s")
def l11(spark, sf):
    return report.grid_summary(_rows(spark, sf), "endpoint", ["model", "scenario"], "mcc")


@query("l11_scenario_deltas", f"with r as ({ROWS_SQL}) select a.endpoint, a.model, a.scenario, round(a.mcc - b.mcc, 4) as delta from r a join r b on a.endpoint = b.endpoint and a.model = b.model and b.scenario = 'raw_all' where a.scenario <> 'raw_all'")
def l11d(spark, sf):
    return report.scenario_deltas(_rows(spark, sf), ["endpoint", "model"], "mcc")


@query("l12_ad_coverage_summary", f"with r as ({ROWS_SQL}) select endpoint, scenario, model, sens as coverage, spec as ad_mean_sim from r")
def l12(spark, sf):
    return report.ad_coverage_summary(_rows(spark, sf).withColumns({"coverage": F.col("sens"), "ad_mean_sim": F.col("spec")}))
