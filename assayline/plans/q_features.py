"""Queries: features, sampling, enrichment, models and workflows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from assayline.functions.columns import fisher_exact_p
from assayline.operators import enrich, features, keys, metrics, models, sampling, splits
from assayline.plans import fixtures as fx
from assayline.plans import workflows as wf
from assayline.plans.q_curation import CLASSIFIED
from assayline.plans.registry import draw_sql, query
from assayline.plans.shared import keep, scratch

COUNTS = "select record_id, label, domain, " + ", ".join(f"len(regexp_extract_all(text, '{p}'))::int as {n}_count" for n, (_, p) in features.PATTERNS.items()) + " from v_docs"
PRESENT = ", ".join(f"({n}_count >= {k})::int as {n}_{s}" for n in features.PATTERNS for k, s in ((1, "present"), (2, "ge2"), (3, "ge3")))


def _counts(spark, sf):
    return features.pattern_counts(fx.docs(spark, sf), keep=("record_id", "label", "domain"))


@query("f1_pattern_counts", f"+ c as ({COUNTS}) select * exclude (label, domain), {PRESENT} from c", "v_docs")
def f1(spark, sf):
    return _counts(spark, sf).drop("label", "domain")


def _alerts(what: str) -> str:
    each = {e: " + ".join(f"{n}_count" if what == "n" else f"({n}_count > 0)::int" for n in names) for e, names in features.ALERTS.items()}
    return "case domain " + " ".join(f"when '{e}' then {x}" for e, x in each.items()) + " else 0 end"


@query("f2_alert_aggregates", f"+ c as ({COUNTS}) select record_id, {_alerts('n')} as n_alerts, ({_alerts('n')} > 0)::int as any_alert, {_alerts('s')} as alert_score from c", "v_docs")
def f2(spark, sf):
    return features.alert_aggregates(_counts(spark, sf), "domain").select("record_id", "n_alerts", "any_alert", "alert_score")


WORDS = "list_filter(string_split(text, ' '), lambda w: w <> '')"
DESCRIBED = f"""select record_id, length(text)::int as length, len({WORDS})::int as tokens, len(list_distinct({WORDS}))::int as distinct_tokens, len(regexp_extract_all(text, '[0-9]'))::int as digits, len(regexp_extract_all(text, '[A-Z]'))::int as upper,
 len(regexp_extract_all(text, '[.,;:!?]'))::int as punct, (len(regexp_extract_all(text, '\\n')) + 1)::int as lines, round(length(text)::double / nullif(len({WORDS}), 0), 6) as mean_token, round(len(list_distinct({WORDS}))::double / nullif(len({WORDS}), 0), 6) as distinct_ratio, label from v_docs"""


def _described(spark, sf):
    d = fx.docs(spark, sf)
    return features.text_descriptors(d).join(d.select("record_id", "label", "domain", "grp"), "record_id")


@query("f3_text_descriptors", f"select * exclude (label) from ({DESCRIBED})", "v_docs")
def f3(spark, sf):
    return features.text_descriptors(fx.docs(spark, sf))


LW = "list_filter(string_split(lower(text), ' '), lambda w: w <> '')"
SHINGLED = f"select record_id, label, list_sort(list_distinct(list_transform(list_concat(w, list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))), lambda g: (('0x' || substr(md5(g), 1, 8))::bigint % 1024)::int))) as bits from (select record_id, label, {LW} as w from v_docs)"


def _bits(spark, sf, train=False):
    d = features.hashed_shingle_bits(fx.docs(spark, sf))
    return d.filter("record_id % 5 <> 0 and label is not null") if train else d


@query("f4_hashed_shingle_bits", f"select record_id, len(bits)::int as n_bits, list_sum(bits)::bigint as sum_bits, array_to_string(bits, ',') as bits from ({SHINGLED})", "v_docs")
def f4(spark, sf):
    b = _bits(spark, sf)
    return b.select("record_id", F.size("bits").alias("n_bits"), F.aggregate("bits", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_bits"), F.array_join("bits", ",").alias("bits"))


TRAIN_BITS = f"t as (select * from ({SHINGLED}) where record_id % 5 <> 0 and label is not null), n as (select count(*) as n, sum(label)::bigint as n1 from t), k as (select bit, count(*) as k, sum(label)::bigint as k1 from (select label, unnest(bits) as bit from t) group by bit)"


@query("f5_bit_prevalence_filter", f"+ {TRAIN_BITS} select bit, round(k::double / n, 6) as prevalence from k, n where k::double / n between 0.01 and 0.99", "v_docs")
def f5(spark, sf):
    return features.bit_prevalence_filter(_bits(spark, sf, True))


@query("f6_select_bits_variance", f"+ {TRAIN_BITS} select bit, round(k::double / n * (1 - k::double / n) * n / (n - 1), 9) as variance from k, n order by variance desc, bit limit 64", "v_docs")
def f6(spark, sf):
    return features.select_bits_variance(_bits(spark, sf, True), 64)


def _mi(c: str, a: str, b: str) -> str:
    return f"case when {c} > 0 then ({c})::double / n * ln(({c})::double * n / (({a})::double * ({b}))) else 0 end"


@query("f7_select_bits_mi", f"+ {TRAIN_BITS} select bit, round({_mi('k1', 'k', 'n1')} + {_mi('k - k1', 'k', 'n - n1')} + {_mi('n1 - k1', 'n - k', 'n1')} + {_mi('n - k - n1 + k1', 'n - k', 'n - n1')}, 9) as mi from k, n order by mi desc, bit limit 64", "v_docs")
def f7(spark, sf):
    return features.select_bits_mi(_bits(spark, sf, True), 64)


NUMBERS = ["length", "tokens", "digits", "upper", "punct", "mean_token", "distinct_ratio"]


@query("f8_feature_modes", "select doc_id as record_id, 3 as compact, 7 as broad from documents")
def f8(spark, sf):
    d = _described(spark, sf)
    out = features.feature_modes(d, {"compact": NUMBERS[:3], "broad": NUMBERS})
    return out.select("record_id", *[F.size(vector_to_array(c)).alias(c) for c in ("compact", "broad")])


def _grams(n: int) -> str:
    return f"len(list_distinct(list_transform(list_concat(w, list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))), lambda g: ('0x' || substr(md5(g), 1, 8))::bigint % {n})))"


@query("f8_bit_modes", f"""+ w as (select record_id, {LW} as w, list_filter(string_split(text, ' '), lambda x: x <> '') as v, length(text) as n from v_docs)
 select record_id, {", ".join(f"{n + 2}::int as size_{n}, {_grams(n)}::int as set_{n}" for n in (512, 1024, 2048))}, round((n + len(v))::double, 6) as total from w where w is not null""", "v_docs")  # fmt: skip
def f8_bits(spark, sf):
    """Sizes of the modes' vectors, how many of their bits are set, and the sum of their numbers."""
    d = fx.docs(spark, sf).select("record_id", "text").join(_described(spark, sf).select("record_id", "length", "tokens"), "record_id").filter("text is not null")
    out = features.bit_modes(d, ["length", "tokens"])
    sums = lambda c: F.aggregate(F.slice(vector_to_array(c), 3, 4096), F.lit(0.0), lambda a, x: a + x).cast("int")
    return out.select("record_id", *[x for n in (512, 1024, 2048) for x in (F.size(vector_to_array(f"fp{n}")).alias(f"size_{n}"), sums(f"fp{n}").alias(f"set_{n}"))], F.round(F.col("length") + F.col("tokens"), 6).alias("total"))


@query("f10_standardize", "select p_partkey as record_id, round(coalesce((p_size - avg(p_size) over ()) / nullif(stddev_pop(p_size) over (), 0), 0), 6) as p_size, round(coalesce((p_retailprice - avg(p_retailprice) over ()) / nullif(stddev_pop(p_retailprice) over (), 0), 0), 6) as p_retailprice from part")
def f10(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"))
    return features.standardize(p, ["p_size", "p_retailprice"]).select("record_id", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))


CORR = ["length", "tokens", "punct"]
LONG = ", ".join(f"{{'f': '{c}', 'x': {c}::double}}" for c in CORR)


@query("f11_label_correlation", f"+ d as ({DESCRIBED}), l as (select label as y, unnest([{LONG}]) as u from d where label is not null), r as (select u.f as feature, rank() over (partition by u.f order by u.x) + (count(*) over (partition by u.f, u.x) - 1) / 2.0::double as rx, rank() over (partition by u.f order by y) + (count(*) over (partition by u.f, y) - 1) / 2.0::double as ry from l) select feature, round(corr(rx, ry), 6) as rho, count(*) as n from r group by feature", "v_docs")
def f11(spark, sf):
    return features.label_correlation(_described(spark, sf), CORR)


@query("f11_label_correlation_p")
def f11_p(spark, sf):
    return features.label_correlation(_described(spark, sf), CORR, with_p=True)


@query("f12_vocab_summary", f"with c as ({CLASSIFIED}), d as (select c.*, lang from c join documents on doc_id = record_id), h as (select lang, x, count(*) as k from (select lang, unnest(vocab_hits) as x from d) group by all), t as (select lang, string_agg(x || ':' || k, '; ' order by k desc, x) as top from h group by lang) select d.lang as domain, count(*) filter (valid) as n_valid, count(*) filter (len(vocab_hits) > 0) as n_with_vocab, round(avg((len(vocab_hits) > 0)::int), 4) as vocab_rate, round(avg((n_fragments > 1)::int), 4) as parts_rate, round(avg((key_raw <> key_normal)::int), 4) as norm_rate, any_value(top) as top from d left join t using (lang) group by d.lang")
def f12(spark, sf):
    d = fx.docs(spark, sf)
    return features.vocab_summary(keys.classify_record(d).join(d.select("record_id", "domain"), "record_id"), "domain")


@query("f13_view_rates", f"with c as ({CLASSIFIED}) select lang as domain, round(avg((len(vocab_hits) > 0)::int), 4) as has_vocab_rate, round(avg((n_fragments > 1)::int), 4) as has_parts_rate, round(avg((key_raw <> key_normal)::int), 4) as needs_norm_rate from c join documents on doc_id = record_id group by lang")
def f13(spark, sf):
    d = fx.docs(spark, sf)
    return features.view_rates(keys.classify_record(d).join(d.select("record_id", "domain"), "record_id"), "domain", ["has_vocab", "has_parts", "needs_norm"])


# Sampling


@query("h1_class_weight", "select record_id, (count(*) over (partition by endpoint) - sum(label) over (partition by endpoint))::double / greatest(sum(label) over (partition by endpoint), 1) as pos_weight, (count(*) over (partition by endpoint))::double / (2 * count(*) over (partition by endpoint, label)) as balanced_weight from v_records", "v_records")
def h1(spark, sf):
    return sampling.class_weight(fx.records(spark, sf), "endpoint").select("record_id", "pos_weight", "balanced_weight")


@query("h2_random_undersample", f"+ n as (select experiment, min(k) as least from (select experiment, label, count(*) as k from v_events group by all) group by 1), r as (select *, row_number() over (partition by experiment, label order by {draw_sql("'42'", 'record_id::varchar')}, record_id) as nth from v_events) select record_id, experiment, label from r join n using (experiment) where nth <= least", "v_events")
def h2(spark, sf):
    return sampling.random_undersample(fx.events(spark, sf), ["experiment"]).select("record_id", "experiment", "label")


def _vec(spark, sf):
    return fx.vectors(spark, sf).filter("split = 'train'").withColumn("label", (F.col("record_id") % 4 == 0).cast("int"))


@query("h3_near_miss", """+ x as (select *, (record_id % 4 = 0)::int as y from v_vec where split = 'train'), p as (select * from x where y = 1), n as (select * from x where y = 0), a as (select n.record_id, row_number() over (partition by p.record_id order by list_distance(p.v, n.v), n.record_id) as i from p, n), c as (select distinct record_id from a where i <= 3),
 f as (select n.record_id, list_distance(n.v, p.v) as d, row_number() over (partition by n.record_id order by list_distance(n.v, p.v), p.record_id) as i from n join c using (record_id), p), g as (select record_id, row_number() over (order by round(avg(d), 12) desc, record_id) as i from f where i <= 3 group by record_id)
 select record_id, 1 as label from p union all select record_id, 0 from g where i <= (select count(*) from p)""", "v_vec")  # fmt: skip
def h3(spark, sf):
    return sampling.near_miss(_vec(spark, sf)).select("record_id", "label")


@query("h4_smote_tomek")
def h4(spark, sf):
    return sampling.smote_tomek(_vec(spark, sf)).groupBy("label").agg(F.count("*").alias("n"), F.count_if(F.col("record_id") < 0).alias("n_made"))


def _negatives(spark, sf):
    d = fx.docs(spark, sf)
    p = features.pattern_counts(d).select("record_id", features.profile_key(list(features.PATTERNS)).alias("profile"))
    full = _described(spark, sf).join(p, "record_id").filter("label is not null")
    return keep(full.withColumns({"label": (1 - F.col("label")).cast("int")} | {c: F.col(c).cast("double") for c in NUMBERS}), "negatives")


PROFILE = "coalesce(nullif(concat_ws('|', " + ", ".join(f"case when {n}_count > 0 then '{n}' end" for n in sorted(features.PATTERNS)) + "), ''), 'none')"


@query("h5_kmeans_medoid_sample")
def h5(spark, sf):
    d = _negatives(spark, sf)
    return sampling.kmeans_medoid_sample(d.filter("label = 0"), NUMBERS, 40).select("record_id", "profile")


@query("h6_profile_key", f"+ c as ({COUNTS}) select record_id, {PROFILE} as profile from c", "v_docs")
def h6(spark, sf):
    return _counts(spark, sf).select("record_id", features.profile_key(list(features.PATTERNS)).alias("profile"))


@query("h7_profile_stratified_sample", f"""+ c as ({COUNTS}), p as (select record_id, 1 - label as label, {PROFILE} as profile from c where label is not null), q as (select profile, count(*) as k, greatest(1, round(count(*)::double / (select count(*) from p where label = 1) * 100))::int as quota from p where label = 1 group by profile),
 r as (select *, row_number() over (partition by profile order by {draw_sql("'42'", "record_id::varchar")}, record_id) as nth from p where label = 0), s as (select record_id, profile, row_number() over (order by k desc, profile, nth) as i from r join q using (profile) where nth <= quota)
 select record_id, profile from s where i <= 100 and (select count(*) from r) > 100 union all select record_id, profile from r where (select count(*) from r) <= 100""", "v_docs")  # fmt: skip
def h7(spark, sf):
    c = _counts(spark, sf).filter("label is not null").withColumn("label", 1 - F.col("label"))
    return sampling.profile_draw(c.select("record_id", "label", features.profile_key(list(features.PATTERNS)).alias("profile")), 100).select("record_id", "profile")


@query("h7_profile_stratified_filled")
def h7_filled(spark, sf):
    return sampling.profile_stratified_sample(_negatives(spark, sf), NUMBERS, 100).select("record_id", "profile")


@query("h8_combined_sample")
def h8(spark, sf):
    return sampling.combined_sample(_negatives(spark, sf), NUMBERS, 60).select("record_id", "profile")


@query("h9_sampling_coverage", "with z as (select p_partkey, (p_size - avg(p_size) over ()) / stddev_pop(p_size) over () as a, (p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over () as b from part), d as (select x.p_partkey, sqrt(min((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b))) as d from z x, z y where y.p_partkey % 97 = 0 group by 1) select round(avg(d), 4) as coverage_mean_dist, round(median(d), 4) as coverage_median_dist, round(quantile_cont(d, 0.95), 4) as coverage_95th_dist, round(max(d), 4) as coverage_max_dist from d")
def h9(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_size").cast("double").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return sampling.sampling_coverage(p, p.filter("record_id % 97 = 0"), ["p_size", "p_retailprice"])


@query("h10_sampling_grid")
def h10(spark, sf):
    return wf.sampling_grid(_negatives(spark, sf), NUMBERS)


def _imbalance(spark, sf):
    d = keep(splits.group_split(wf.vectors(_negatives(spark, sf), NUMBERS)).withColumn("endpoint", F.when(F.col("domain").isin("en", "de"), "germanic").otherwise("romance")), "split")
    v = lambda f: lambda x: x.join(f(x.select("record_id", "label", vector_to_array("features").alias("v"))).select("record_id"), "record_id", "left_semi")
    ways = {"none": lambda x: x, "undersample": lambda x: sampling.random_undersample(x, ["split"]), "near_miss": v(sampling.near_miss)}
    return wf.imbalance_study(d, ways)


@query("h11_imbalance_study")
def h11(spark, sf):
    return _imbalance(spark, sf)[0]


@query("h11_false_positives")
def h11_fp(spark, sf):
    return _imbalance(spark, sf)[1]


@query("h12_sampling_cv_eval")
def h12(spark, sf):
    return wf.sampling_cv_eval(wf.vectors(_negatives(spark, sf), NUMBERS))


# Enrichment

FLAGS = {"invalid": "not valid", "vocab": "len(vocab_hits) > 0", "multi_part": "n_fragments > 1", "normalized": "key_raw <> key_normal", "many_parts": "n_fragments > 40", "never": "false"}


@query("i1_impact_stats", f"""+ c as ({CLASSIFIED}), x as (select v.label, unnest([{", ".join(f"{{'c': '{n}', 'f': coalesce({e}, false)}}" for n, e in FLAGS.items())}]) as u from c join v_docs v using (record_id)),
 r as (select u.c as category, count(*) as n, count(*) filter (u.f) as n_affected, count(*) filter (u.f and label = 1) as n_pos, count(*) filter (u.f and label = 0) as n_neg, count(*) filter (label = 1) as ap, count(*) filter (label = 0) as an from x group by 1),
 s as (select category, n_affected, round(100.0::double * n_affected / n, 2) as pct_of_total, n_pos, n_neg, round(coalesce(n_pos::double / nullif(n_pos + n_neg, 0), 0), 4) as pos_rate, round(ap::double / (ap + an), 4) as overall_pos_rate, round(coalesce(n_pos::double / nullif(n_pos + n_neg, 0) / (ap::double / (ap + an)), 0), 3) as enrichment_ratio, round(n_pos::double * (an - n_neg) / nullif(n_neg::double * (ap - n_pos), 0), 4) as odds_ratio from r)
 select *, case when n_affected = 0 then 'no affected records' when enrichment_ratio > 1.5 then 'keep ' || category || ' as a feature: positives are enriched' when enrichment_ratio < 0.5 then 'consider dropping ' || category || ': positives are depleted' else 'no action needed' end as recommendation from s""", "v_docs")  # fmt: skip
def i1(spark, sf):
    return enrich.impact_stats(*_flagged(spark, sf))


def _flagged(spark, sf):
    d = fx.docs(spark, sf)
    c = keys.classify_record(d).join(d.select("record_id", "label"), "record_id")
    return c, {"invalid": ~F.col("valid"), "vocab": F.col("has_vocab"), "multi_part": F.col("has_parts"), "normalized": F.col("needs_norm"), "many_parts": F.col("n_fragments") > 40, "never": F.lit(False)}


TABLE = "select o_orderpriority as domain, count(*) filter (o_orderstatus = 'F' and o_totalprice > 150000) as a, count(*) filter (o_orderstatus = 'F' and o_totalprice <= 150000) as b, count(*) filter (o_orderstatus <> 'F' and o_totalprice > 150000) as c, count(*) filter (o_orderstatus <> 'F' and o_totalprice <= 150000) as d from orders group by 1"


def _cells(spark, sf):
    r, big = fx.records(spark, sf), F.col("price") > 150000
    pos = F.col("label") == 1
    return r.groupBy("domain").agg(F.count_if(pos & big).alias("a"), F.count_if(pos & ~big).alias("b"), F.count_if(~pos & big).alias("c"), F.count_if(~pos & ~big).alias("d"))


@query("i2_odds_ratio", f"select domain, round(a::double * d / nullif(b::double * c, 0), 6) as odds_ratio from ({TABLE})")
def i2(spark, sf):
    return _cells(spark, sf).select("domain", F.round(enrich.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 6).alias("odds_ratio"))


@query("i3_fisher_exact_p", f"""with t as ({TABLE}), x as (select *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) as x from t), p as (select domain, a, x, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) as lp from x),
 s as (select domain, lp as seen from p where x = a) select domain, round(least(1.0::double, sum(exp(lp)) filter (lp <= seen + 1e-7)), 6) as fisher_p from p join s using (domain) group by domain""")  # fmt: skip
def i3(spark, sf):
    return _cells(spark, sf).select("domain", F.round(fisher_exact_p("a", "b", "c", "d"), 6).alias("fisher_p"))


@query("i4_recommendation", f"with r as (select domain, round(a::double * d / nullif(b::double * c, 0), 3) as er from ({TABLE})) select domain, case when er is null then 'no affected records' when er > 1.5 then 'keep ' || domain || ' as a feature: positives are enriched' when er < 0.5 then 'consider dropping ' || domain || ': positives are depleted' else 'no action needed' end as recommendation from r")
def i4(spark, sf):
    er = F.round(enrich.odds_ratio(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 3)
    return _cells(spark, sf).select("domain", enrich.recommendation(F.col("domain"), er).alias("recommendation"))


@query("i5_element_distribution", f"select unnest(vocab_hits) as element, count(*) as n from ({CLASSIFIED}) group by 1")
def i5(spark, sf):
    return enrich.element_distribution(keys.classify_record(fx.docs(spark, sf)))


@query("i6_vocab_detail", f"select record_id, array_to_string(vocab_hits, ',') as hits, length(key_raw)::int as size_raw, length(key_stripped)::int as size_after, (length(key_stripped) - length(key_raw))::int as size_change from ({CLASSIFIED}) where len(vocab_hits) > 0")
def i6(spark, sf):
    return enrich.vocab_detail(keys.classify_record(fx.docs(spark, sf)))


@query("i6_multipart_detail", f"select record_id, n_fragments, length(key_raw)::int as size_raw, length(key_stripped)::int as size_after, (length(key_stripped) - length(key_raw))::int as size_change from ({CLASSIFIED}) where n_fragments > 1")
def i6m(spark, sf):
    return enrich.multipart_detail(keys.classify_record(fx.docs(spark, sf)))


RATES = "r as (select domain, count(*) as n, sum(label)::bigint as n_pos, round(avg(label), 4) as pos_rate from v_records group by domain)"


@query("i7_source_rates", f"+ {RATES} select * from r", "v_records")
def i7s(spark, sf):
    return enrich.source_rates(fx.records(spark, sf))


@query("i7_domain_confounding", f"+ {RATES} select count(*) as n_sources, round(sum(case when pos_rate > 0.5 then n_pos else n - n_pos end)::double / sum(n), 4) as source_only_accuracy, round(max(pos_rate) / greatest(min(pos_rate), 0.001), 1) as enrichment from r", "v_records")
def i7(spark, sf):
    return enrich.domain_confounding(fx.records(spark, sf))


@query("i8_naive_source_classifier", "+ r as (select domain, count(*) as n, sum(label)::bigint as p from v_records group by 1), t as (select sum(p)::double / sum(n) as rate from r), x as (select sum(case when p::double / n > rate then p else 0 end)::bigint as tp, sum(case when p::double / n > rate then n - p else 0 end)::bigint as fp, sum(case when p::double / n > rate then 0 else p end)::bigint as fn, sum(case when p::double / n > rate then 0 else n - p end)::bigint as tn from r, t) select tp, fp, fn, tn, round(coalesce((tp::double * tn - fp::double * fn) / nullif(sqrt((tp + fp)::double * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 4) as mcc, round((tp::double / (tp + fn) + tn::double / (tn + fp)) / 2, 4) as bacc from x", "v_records")
def i8(spark, sf):
    return enrich.naive_source_classifier(fx.records(spark, sf))


@query("i9_scenario_comparison")
def i9(spark, sf):
    d = _negatives(spark, sf)
    return wf.scenario_comparison({"raw_all": wf.vectors(d, NUMBERS), "no_metal": wf.vectors(d.filter("profile not like '%junk%'"), NUMBERS)})


# Models and workflows


def _train(spark, sf):
    return keep(splits.group_split(wf.vectors(_negatives(spark, sf), NUMBERS)), "train")


def _fit_query(name: str):
    @query(f"j1_fit_score_{name}")
    def run(spark, sf):
        d = _train(spark, sf)
        scored = wf.predicted(models.fit_score(d.filter("split = 'train'"), d.filter("split = 'test'"), name)).withColumn("experiment", F.lit(name))
        return metrics.experiment_row(scored, ["experiment"])

    return run


for _name in models.MODELS:
    _fit_query(_name)


def _group_folds(spark, sf, k: int):
    """Rows with folds that keep sources whole."""
    d = _train(spark, sf).drop("split")
    return keep(d.join(splits.group_kfold(d, k).select("grp", "fold"), "grp"), "folds")


@query("j2_random_search")
def j2(spark, sf):
    return models.random_search(_group_folds(spark, sf, 3), "logistic")[0]


@query("j3_feature_importance")
def j3(spark, sf):
    return models.feature_importance(models.fit(_train(spark, sf), "rf"), NUMBERS, spark)


@query("j4_linear_contribution", "select 'p_size' as feature, round(avg(abs(0.5::double * (p_size - m1))), 4) as contribution from part, (select avg(p_size) as m1 from part) group by 1 union all select 'p_retailprice', round(avg(abs(-0.25::double * (p_retailprice - m2))), 4) from part, (select avg(p_retailprice) as m2 from part)")
def j4(spark, sf):
    return models.linear_contribution(fx.table(spark, sf, "part"), ["p_size", "p_retailprice"], {"p_size": 0.5, "p_retailprice": -0.25})


@query("j5_final_refit")
def j5(spark, sf):
    d = _train(spark, sf)
    scorer = models.final_refit(d.filter("split = 'train'"), "logistic", {"regParam": 0.1}, lambda x: sampling.random_undersample(x, ["split"]))
    return wf.predicted(scorer(d.filter("split = 'test'"))).select("record_id", "label", F.round("proba", 6).alias("proba"), "pred")


@query("e2_cluster_ungrouped")
def e2(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_size").cast("double"), F.col("p_retailprice").cast("double"), F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("|", F.col("p_partkey").cast("string"), "p_brand")).otherwise(F.col("p_name")).alias("key"))
    return wf.cluster_ungrouped(splits.assign_groups(p), ["p_size", "p_retailprice"], 20).groupBy("group").agg(F.count("*").alias("n"))


@query("e11_random_vs_group_split")
def e11(spark, sf):
    return wf.random_vs_group_split(_train(spark, sf).drop("split"))


def _labelled(spark, sf):
    d = fx.docs(spark, sf).filter("label is not null").withColumn("label", (1 - F.col("label")).cast("int"))
    return d.filter("record_id % 3 <> 0"), d.filter("record_id % 3 = 0")


@query("k5_external_validation")
def k5(spark, sf):
    return wf.external_validation(*_labelled(spark, sf))["zones"]


@query("k5_external_row")
def k5_row(spark, sf):
    out = wf.external_validation(*_labelled(spark, sf))
    return out["row"].crossJoin(F.broadcast(out["domain"])).crossJoin(F.broadcast(out["counts"]))  # one row each


@query("k6_fn_augmentation")
def k6(spark, sf):
    d = wf.vectors(_negatives(spark, sf), NUMBERS).select("record_id", "label", "features")
    d = d.join(_bits(spark, sf).select("record_id", "bits"), "record_id")
    return wf.fn_augmentation(keep(d.filter("record_id % 3 <> 0"), "train"), keep(d.filter("record_id % 3 = 0"), "pool"))


@query("k7_scenario_selection")
def k7(spark, sf):
    d = _negatives(spark, sf)
    return wf.scenario_selection({"raw_all": wf.vectors(d, NUMBERS), "no_metal": wf.vectors(d.filter("profile not like '%junk%'"), NUMBERS)}, k=2)


SCENARIOS = {"raw_all": "true", "no_metal": "profile not like '%junk%'"}


@query("k8_locked_test_grid")
def k8(spark, sf):
    d = keep(splits.group_split(_negatives(spark, sf)).withColumn("endpoint", F.col("domain")), "grid")
    return wf.locked_test_grid(d, {n: F.expr(e) for n, e in SCENARIOS.items()}, {"compact": NUMBERS[:3], "broad": NUMBERS}, ("logistic", "rf"))


@query("k9_learning_curve")
def k9(spark, sf):
    return wf.learning_curve(_train(spark, sf).drop("split"), k=2)


@query("k10_leave_source_out_eval")
def k10(spark, sf):
    return wf.leave_source_out_eval(_train(spark, sf).drop("split"))


@query("k11_oof_predictions")
def k11(spark, sf):
    d = keep(splits.stratified_kfold(_train(spark, sf), 3), "folds")
    return models.oof_predictions(d, "logistic", k=3).select("record_id", "fold", "label", F.round("proba", 6).alias("proba"))


@query("k12_nested_cv")
def k12(spark, sf):
    return wf.nested_cv(_group_folds(spark, sf, 3), "logistic", lambda x: sampling.random_undersample(x.withColumn("all", F.lit(1)), ["all"]))


def _ablation(spark, sf):
    d = keep(splits.group_split(_negatives(spark, sf)), "ablation")
    return wf.ablation_study(d, {"compact": NUMBERS[:3], "tabular": NUMBERS}, ("logistic", "rf"), k=2)


@query("k13_ablation_study")
def k13(spark, sf):
    return _ablation(spark, sf)[1]


@query("k13_ablation_rows")
def k13_rows(spark, sf):
    return _ablation(spark, sf)[0]


@query("k14_fold_report")
def k14(spark, sf):
    return wf.fold_report(_bits(spark, sf, True).withColumn("all", F.lit(1)), resample=lambda x: sampling.random_undersample(x, ["all"]))[0]


@query("k14_fold_scores")
def k14_scores(spark, sf):
    d = _bits(spark, sf, True).filter("label is not null").withColumn("all", F.lit(1))
    return wf.fold_report(d, resample=lambda x: sampling.random_undersample(x, ["all"]), model="logistic")[0]


@query("k14_bit_manifest", f"""+ w as (select record_id, label, {LW} as w from v_docs where label is not null and record_id % 5 <> 0), b as (select record_id, label, list_distinct(list_transform(list_concat(w, list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))), lambda g: ('0x' || substr(md5(g), 1, 8))::bigint % 1024)) as bits from w),
 f as (select *, (row_number() over (partition by label order by {draw_sql("'42'", "record_id::varchar")}, record_id) - 1) % 3 as fold from b), n as (select k, count(*) as n from f, range(3) t(k) where fold <> k group by k),
 c as (select k, bit, count(*) as m from (select k, unnest(bits) as bit from f, range(3) t(k) where fold <> k) group by all), s as (select c.k, bit from c join n using (k) where m / n.n::double between 0.05 and 0.95)
 select bit::int as bit, array_to_string(list(k order by k), ',') as folds, count(*) as n_folds from s group by bit""", "v_docs")  # fmt: skip
def k14_manifest(spark, sf):
    d = _bits(spark, sf, True).filter("label is not null")
    return wf.fold_report(d)[1].withColumn("folds", F.array_join(F.transform("folds", lambda x: x.cast("string")), ","))


@query("k16_build_feature_table", f"select record_id, label, domain, grp, length(text)::int as length, len(bits)::int as n_bits from v_docs join (select record_id, list_distinct(list_transform(list_concat(w, list_transform(range(1, greatest(len(w) - 1, 1) + 1), lambda i: array_to_string(w[i:i + 1], ' '))), lambda g: ('0x' || substr(md5(g), 1, 8))::bigint % 256)) as bits from (select record_id, {LW} as w from v_docs)) using (record_id)", "v_docs")
def k16(spark, sf):
    d = fx.docs(spark, sf)
    wide, _ = wf.build_feature_table(d, features.text_descriptors(d).select("record_id", "length"))
    return wide.select("record_id", "label", "domain", "grp", "length", F.size("bits").alias("n_bits"))


@query("k16_block_audit", "select case when doc_id % 5 = 0 then 'test' else 'train' end as split, count(*) as n, unnest(['bits', 'descriptors']) as block, unnest([1, 2]) as n_columns, unnest([0, 0]) as n_null from documents group by 1")
def k16_audit(spark, sf):
    """The table is written split by split and read again before it is audited."""
    d = fx.docs(spark, sf).withColumn("split", F.when(F.col("record_id") % 5 == 0, "test").otherwise("train"))
    aux = features.text_descriptors(d).select("record_id", F.col("length").alias("d_length"), F.col("tokens").alias("d_tokens"))
    return wf.build_feature_table(d, aux, blocks={"bits": "bits", "descriptors": "d_"}, path=scratch(spark, "features"))[1].withColumn("n_columns", F.col("n_columns").cast("int"))
