"""Queries: sources, keys, labels, joins, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.functions import columns as C
from assayline.operators import joins, keys, labels, splits
from assayline.plans import fixtures as fx
from assayline.plans.registry import draw_sql, query
from assayline.sources import tables as tb

TOKENS = "string_split(lower(text), ' ')"
VOCAB = "['and','das','de','der','die','el','la','le','les','los','of','que','the','und']"
LARGEST = "list_sort(list_transform(string_split({0}, '{1}'), lambda s: {{'l': length(s), 's': s}}))[-1].s"
NORMAL = "case when trim({0}) <> '' then lower(regexp_replace(trim({0}), '\\s+', ' ', 'g')) end"

# Sources and schema


@query("a3_normalize_schema", "select o_orderkey as record_id, concat(o_custkey, '|', o_orderpriority) as key, (o_orderstatus = 'F')::int as label, 'orders' as endpoint from orders")
def a3(spark: SparkSession, sf: str) -> DataFrame:
    o = fx.table(spark, sf, "orders")
    raw = o.select(F.col("o_orderkey").alias("No"), F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("smiles"), (F.col("o_orderstatus") == "F").cast("int").cast("string").alias("Label"))
    return tb.normalize_schema(raw, "orders").select("record_id", "key", "label", "endpoint")


@query("a4_coalesce_aliases", "select p_partkey as record_id, coalesce(case when p_size > 25 then p_name end, p_brand) as name from part")
def a4(spark, sf):
    p = fx.table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("analysis_name"), F.col("p_brand").alias("Raw_Name"))
    return tb.coalesce_aliases(p, ["analysis_name", "raw_name", "title"], "name")


@query("a1_load_records_csv", "select c_custkey as record_id, c_name as key, c_nationkey::int as label, c_mktsegment as domain from customer")
def a1(spark, sf):
    """A5 and A1: written as CSV by endpoint, and loaded again with its schema."""
    from assayline.plans.shared import scratch

    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.col("c_name").alias("key"), F.col("c_nationkey").cast("int").alias("label"), F.col("c_mktsegment").alias("domain"))
    path = f"{scratch(spark, 'records')}.csv"
    tb.write_table(c, path, "csv")
    return tb.load_records(spark, path, c.schema)


@query("a5_write_table", "select o_orderkey as record_id, o_orderstatus as key, o_orderpriority as domain, o_totalprice as price from orders")
def a5(spark, sf):
    """CSV with a folder for each domain, read back."""
    from assayline.plans.shared import scratch

    o = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("domain"), F.col("o_totalprice").alias("price"))
    path = scratch(spark, "parts")
    tb.write_table(o, path, "csv", ["domain"])
    return spark.read.schema(o.schema).option("header", True).csv(path).select(o.columns)


@query("a6_write_json", "select s_suppkey as record_id, s_name as key, s_acctbal as price from supplier")
def a6(spark, sf):
    from assayline.plans.shared import scratch

    s = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("record_id"), F.col("s_name").alias("key"), F.col("s_acctbal").alias("price"))
    path = scratch(spark, "json")
    tb.write_json(s, path)
    return spark.read.schema(s.schema).json(path)


@query("a7_scan_experiments", "select concat('exp', event_id % 4) as experiment, count(*) as n, sum((event_type = 'purchase')::int)::bigint as n_pos from events group by 1")
def a7(spark, sf):
    from assayline.plans.shared import scratch

    root = scratch(spark, "runs")
    e = fx.events(spark, sf).select("record_id", "label", F.concat(F.lit("exp"), (F.col("record_id") % 4).cast("string")).alias("e"))
    for i in range(4):
        tb.write_table(e.filter(F.col("e") == f"exp{i}").drop("e"), f"{root}/exp{i}/test_predictions.csv", "csv")
    return tb.scan_experiments(spark, root, "test_predictions.csv", "record_id long, label int").groupBy("experiment").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"))


@query("a8_content_fingerprint", "select endpoint, count(*) as n, substr(sha256(concat_ws('|', sum(('0x' || substr(sha256(concat_ws('|', record_id::varchar, key, label::varchar)), 1, 12))::bigint)::varchar, count(*)::varchar)), 1, 16) as fingerprint from v_records group by endpoint", "v_records")
def a8(spark, sf):
    return tb.content_fingerprint(fx.records(spark, sf), "endpoint", ["record_id", "key", "label"])


@query("a9_audit_dataset", """select endpoint, count(*) as n_rows, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg, round(avg(label), 4) as pos_rate,
 count(*) filter (key is null) as null_key, count(*) filter (label is null) as null_label, count(*) filter (grp is null) as null_grp, 0.0::double as null_pct_key, 0.0::double as null_pct_label, 0.0::double as null_pct_grp,
 count(distinct grp) as n_groups, count(distinct domain) as n_domains, count(distinct key) as n_keys from v_records group by endpoint""", "v_records")  # fmt: skip
def a9(spark, sf):
    return tb.audit_dataset(fx.records(spark, sf))


@query("a10_classify_columns", """with n as (select count(distinct p_name) as name, count(distinct p_brand) as brand, count(distinct p_type) as type, 101 as size_text from part) select 'p_partkey' as "column", 'feature' as role union all select 'p_size', 'feature' union all select 'p_retailprice', 'feature' union all select 'label', 'meta' union all select 'size_text', 'feature'
 union all select 'p_name', case when name > 100 then 'excluded' else 'meta' end from n union all select 'p_brand', case when brand > 100 then 'excluded' else 'meta' end from n union all select 'p_type', case when type > 100 then 'excluded' else 'meta' end from n""")  # fmt: skip
def a10(spark, sf):
    return tb.classify_columns(fx.table(spark, sf, "part").withColumn("label", F.lit(1)).withColumn("size_text", F.col("p_size").cast("string")))


@query("a12_feature_block_counts", """select endpoint, case when starts_with(feature, 'fp_') then 'fingerprint' when starts_with(feature, 'fg_') then 'functional_group' when starts_with(feature, 'desc_') then 'physchem' else 'other' end as block,
 count(distinct feature) as n_features, count(*) filter (value <> 0) as n_nonzero from (select endpoint, x.f as feature, x.v as value from (select lang as endpoint, unnest([{'f': 'fp_' || (doc_id % 7), 'v': 1.0::double}, {'f': 'fg_the', 'v': (contains(lower(text), 'the'))::int::double}, {'f': 'desc_len', 'v': length(text)::double}, {'f': 'zzz', 'v': 0.0::double}]) as x from documents)) group by all""")  # fmt: skip
def a12(spark, sf):
    d = fx.table(spark, sf, "documents")
    cell = lambda f, v: F.struct(f.alias("feature"), v.cast("double").alias("value"))
    cells = F.array(cell(F.concat(F.lit("fp_"), (F.col("doc_id") % 7).cast("string")), F.lit(1)), cell(F.lit("fg_the"), F.contains(F.lower("text"), F.lit("the")).cast("int")), cell(F.lit("desc_len"), F.length("text")), cell(F.lit("zzz"), F.lit(0)))
    return tb.feature_block_counts(d.select(F.col("lang").alias("endpoint"), F.explode(cells).alias("x")).select("endpoint", "x.*"))


@query("a13_separate_num_cat", "select p_partkey, p_size, p_retailprice, p_size::varchar as size_text from part")
def a13(spark, sf):
    p = fx.table(spark, sf, "part").withColumn("size_text", F.col("p_size").cast("string"))
    return p.select(*tb.separate_num_cat(p, p.columns)[0])


@query("a14_drop_high_cardinality", "select p_partkey, p_brand, p_type, p_size, p_retailprice from part")
def a14(spark, sf):
    return tb.drop_high_cardinality(fx.table(spark, sf, "part"), 30).select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")


# Keys


@query("b1_normalize_key", f"select doc_id as record_id, md5({NORMAL.format('text')}) as key from documents")
def b1(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.md5(C.normalize_key("text")).alias("key"))


@query("b2_largest_fragment", f"select doc_id as record_id, {LARGEST.format('text', '.')} as fragment from documents")
def b2(spark, sf):
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), C.largest_fragment("text").alias("fragment"))


@query("b3_fragment_flags", "select page_id as record_id, contains(url, '.') as has_parts, len(string_split(url, '.'))::int as n_fragments from pages")
def b3(spark, sf):
    return fx.table(spark, sf, "pages").select(F.col("page_id").alias("record_id"), F.contains("url", F.lit(".")).alias("has_parts"), C.n_fragments("url").alias("n_fragments"))


@query("b4_vocab_flag", f"select doc_id as record_id, array_to_string(list_sort(list_distinct(list_intersect({TOKENS}, {VOCAB}))), ',') as hits, len(list_intersect({TOKENS}, {VOCAB})) > 0 as has_vocab, coalesce(map {{1: 'One', 2: 'Two'}}[doc_id % 4], 'Z' || (doc_id % 4)) as symbol from documents")
def b4(spark, sf):
    hits = C.vocab_hits(C.tokens("text"), keys.VOCABULARY)
    return fx.table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.array_join(hits, ",").alias("hits"), (F.size(hits) > 0).alias("has_vocab"), C.vocab_symbol((F.col("doc_id") % 4).cast("int"), {1: "One", 2: "Two"}).alias("symbol"))


CLASSIFIED = f"""select doc_id as record_id, text as key_raw, coalesce({NORMAL.format("text")} is not null, false) as valid, list_sort(list_distinct(list_intersect({TOKENS}, {VOCAB}))) as vocab_hits, len(string_split(text, '.'))::int as n_fragments,
 {LARGEST.format("text", ".")} as key_stripped, {NORMAL.format("text")} as key_normal from documents"""


@query("b5_classify_record", f"""select record_id, valid, array_to_string(vocab_hits, ',') as vocab_hits, n_fragments, length(key_raw)::int as size_raw, length(key_stripped)::int as size_after, (length(key_stripped) - length(key_raw))::int as size_change,
 coalesce(nullif(concat_ws(',', case when not valid then 'drop_invalid' end, case when len(vocab_hits) > 0 then 'flag_vocab' end, case when n_fragments > 1 then 'strip_parts' end, case when key_raw <> key_normal then 'normalize' end), ''), 'none') as actions from ({CLASSIFIED})""")  # fmt: skip
def b5(spark, sf):
    c = keys.classify_record(fx.docs(spark, sf))
    return c.select("record_id", "valid", F.array_join("vocab_hits", ",").alias("vocab_hits"), "n_fragments", "size_raw", "size_after", "size_change", F.array_join("actions", ",").alias("actions"))


def _scenario(spark, sf, name):
    d = fx.docs(spark, sf)
    return keys.apply_scenario(d.select("record_id", F.col("text").alias("key"), "label"), name, keys.classify_record(d))


@query("b6_apply_scenario", f"select 'no_metal' as scenario, count(*) filter (len(vocab_hits) = 0) as n, sum(case when len(vocab_hits) = 0 then length(key_raw) end)::bigint as chars, 0::bigint as features from ({CLASSIFIED}) union all select 'salt_stripped', count(*), sum(length(key_stripped))::bigint, 0 from ({CLASSIFIED}) union all select 'metal_as_feature', count(*), sum(length(key_raw))::bigint, count(*) filter (len(vocab_hits) > 0) from ({CLASSIFIED})")
def b6(spark, sf):
    out = [_scenario(spark, sf, s).withColumn("scenario", F.lit(s)) for s in ("no_metal", "salt_stripped", "metal_as_feature")]
    rows = out[0].unionByName(out[1]).unionByName(out[2], allowMissingColumns=True)
    return rows.groupBy("scenario").agg(F.count("*").alias("n"), F.sum(F.length("key")).alias("chars"), F.sum(F.coalesce(F.col("vocab_feature"), F.lit(0))).alias("features"))


@query("b7_count_changed", f"select count(*) filter (key_raw <> key_stripped) as n_changed from ({CLASSIFIED})")
def b7(spark, sf):
    d = fx.docs(spark, sf).select("record_id", F.col("text").alias("key"))
    return keys.count_changed(d, _scenario(spark, sf, "salt_stripped"))


@query("b8_build_scenarios", f"""select s.scenario, count(*) as n, count(*) filter (label = 1) as n_pos, count(*) filter (label = 0) as n_neg from (select c.*, v.label, unnest(list_filter(['raw_all', case when len(vocab_hits) = 0 then 'no_metal' end, 'salt_stripped', case when valid and len(vocab_hits) = 0 then 'full_preprocess' end, 'metal_as_feature'], lambda x: x is not null)) as scenario from ({CLASSIFIED}) c join v_docs v using (record_id)) s group by s.scenario""", "v_docs")
def b8(spark, sf):
    d = fx.docs(spark, sf)
    return keys.scenario_sizes(keys.build_scenarios(keys.classify_record(d).join(d.select("record_id", "label"), "record_id")))


@query("b9_safe_bool", "select s_suppkey as record_id, coalesce(lower(trim(f)) in ('true', '1', 'yes', 'valid', 't'), false) as flag from (select *, [' True', 'no', '1 ', 'VALID', 'x'][(s_suppkey % 5 + 1)::int] as f from supplier)")
def b9(spark, sf):
    words = F.array(*[F.lit(x) for x in (" True", "no", "1 ", "VALID", "x")])
    return fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("record_id"), C.safe_bool(F.element_at(words, (F.col("s_suppkey") % 5 + 1).cast("int"))).alias("flag"))


@query("b10_normalize_merge_key", "select c_custkey as record_id, trim('  ' || c_custkey || ' ') as merge_key from customer")
def b10(spark, sf):
    return fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), C.normalize_merge_key(F.concat(F.lit("  "), F.col("c_custkey").cast("string"), F.lit(" "))).alias("merge_key"))


def _customers(spark, sf):
    c = fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("record_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("name"), "c_nationkey")
    aux = c.filter("record_id % 2 = 0").select("record_id", F.concat(F.lit("aux"), F.col("record_id").cast("string")).alias("name"), (F.col("c_nationkey") * 2).alias("score"))
    return c, aux


JOINED = "select c_custkey as record_id, case when c_custkey % 3 <> 0 then c_name end as name, c_nationkey, case when c_custkey % 2 = 0 then 'aux' || c_custkey end as name_aux, case when c_custkey % 2 = 0 then c_nationkey * 2 end as score from customer"


@query("c9_external_rows", "+ l as (select count(*) as n from v_records where endpoint = 'e1' and key not in (select key from v_records where endpoint = 'e0')) select count(*) as n_given, count(*) - any_value(l.n) as n_removed, any_value(l.n) as n_left, any_value(l.n) >= 20 as enough from v_records, l where endpoint = 'e1'", "v_records")
def c9_rows(spark, sf):
    r = fx.records(spark, sf)
    return labels.external_rows(r.filter("endpoint = 'e1'"), r.filter("endpoint = 'e0'"))[1]


@query("d1_join_left", JOINED)
def d1(spark, sf):
    return joins.join_left(*_customers(spark, sf))


@query("b11_coalesce_join_columns", f"select record_id, coalesce(name, name_aux) as name, c_nationkey, score from ({JOINED})")
def b11(spark, sf):
    return joins.coalesce_join_columns(joins.join_left(*_customers(spark, sf)))


@query("d2_merge_rate", f"select count(*) as n, round(avg(case when score is not null then 1.0::double else 0.0::double end), 4) as merge_rate from ({JOINED})")
def d2(spark, sf):
    return joins.merge_rate(joins.join_left(*_customers(spark, sf)), ["score"])


@query("d3_semi_anti", "select (exists (select 1 from orders where o_custkey = c_custkey)) as has_orders, count(*) as n from customer group by 1")
def d3(spark, sf):
    c, o = fx.table(spark, sf, "customer"), fx.table(spark, sf, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    parts = [c.join(o, on, how).agg(F.count("*").alias("n")).select(F.lit(flag).alias("has_orders"), "n") for how, flag in (("left_semi", True), ("left_anti", False))]
    return parts[0].union(parts[1]).filter("n > 0")


VERSIONS = """v as materialized (select *, lower(regexp_replace(trim(key), '\\s+', ' ', 'g')) as canonical_key from v_records),
w as materialized (select *, list_sort(list_transform(string_split(canonical_key, '|'), lambda s: {'l': length(s), 's': s}))[-1].s as standardized_key from v),
x as materialized (select *, count(*) over (partition by canonical_key) > 1 as canonical_dup, min(label) over (partition by canonical_key) < max(label) over (partition by canonical_key) as canonical_label_conflict,
 count(*) over (partition by standardized_key) > 1 as standardized_dup, min(label) over (partition by standardized_key) < max(label) over (partition by standardized_key) as standardized_label_conflict from w)"""


@query("b12_preprocessing_views", f"+{VERSIONS} select record_id, canonical_key, standardized_key, true as canonical_valid, canonical_dup, canonical_label_conflict, standardized_dup, standardized_label_conflict from x", "v_records")
def b12(spark, sf):
    return keys.preprocessing_views(fx.records(spark, sf)).select("record_id", "canonical_key", "standardized_key", "canonical_valid", "canonical_dup", "canonical_label_conflict", "standardized_dup", "standardized_label_conflict")


@query("b13_training_view", f"+{VERSIONS} select record_id, canonical_key as key, label from (select *, row_number() over (partition by canonical_key order by record_id) as n from x) where n = 1 and not canonical_label_conflict", "v_records")
def b13(spark, sf):
    return keys.training_view(keys.preprocessing_views(fx.records(spark, sf)), "canonical", drop_duplicates=True, drop_conflicts=True)


@query("b14_to_numeric_fill", "select event_id as record_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 0.0) as k, coalesce(try_cast(event_type as double), 0.0) as t from events")
def b14(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("event_id").alias("record_id"), C.to_number(F.get_json_object("props", "$.k")).alias("k"), C.to_number("event_type").alias("t"))


# Labels

CLASHES = "g as (select key, count(distinct label) as n_labels, count(*) as n, sum(label)::bigint as n_pos from v_records where key is not null group by key having min(label) < max(label))"
FIRST = "f as (select *, row_number() over (partition by key order by record_id) as nth from v_records where key is not null)"


@query("c1_label_conflicts", f"+{CLASHES} select * from g", "v_records")
def c1(spark, sf):
    return labels.label_conflicts(fx.records(spark, sf))


@query("c2_conflict_conservative", f"+{CLASHES}, {FIRST} select f.* exclude (nth) from f where nth = 1 and key not in (select key from g)", "v_records")
def c2(spark, sf):
    return labels.resolve_conflicts(fx.records(spark, sf), "conservative")


@query("c3_conflict_positive_priority", f"+{CLASHES}, {FIRST}, p as (select *, row_number() over (partition by key order by label desc, record_id) as k from f) select p.* exclude (nth, k) from p where case when key in (select key from g) then k = 1 else nth = 1 end", "v_records")
def c3(spark, sf):
    return labels.resolve_conflicts(fx.records(spark, sf), "positive_priority")


@query("c4_conflict_majority_vote", f"+{CLASHES}, {FIRST} select f.* exclude (nth, label), case when g.key is null then f.label else (g.n_pos * 2 > g.n)::int end as label from f left join g using (key) where nth = 1 and (g.key is null or g.n_pos * 2 <> g.n)", "v_records")
def c4(spark, sf):
    return labels.resolve_conflicts(fx.records(spark, sf), "majority_vote")


@query("c5_conflict_report", f"""+{CLASHES}, {FIRST}, a as (select f.key, f.label, g.n, g.n_pos, g.key is not null as clash from f left join g using (key) where nth = 1),
 t as (select count(*) as n_original, round(avg(label), 4) as pos_rate_before from v_records)
 select strategy, n_original, (select count(*) from g) as n_conflicts, n_after, pos_rate_before, round(pos::double / n_after, 4) as pos_rate_after from t, (
  select 'conservative' as strategy, count(*) as n_after, sum(label)::bigint as pos from a where not clash union all
  select 'positive_priority', count(*), sum(case when clash then 1 else label end)::bigint from a union all
  select 'majority_vote', count(*), sum(case when clash then (n_pos * 2 > n)::int else label end)::bigint from a where not clash or n_pos * 2 <> n)""", "v_records")  # fmt: skip
def c5(spark, sf):
    return labels.conflict_report(fx.records(spark, sf))


@query("c6_conflict_rows", f"+{CLASHES} select v.* from v_records v where key in (select key from g)", "v_records")
def c6(spark, sf):
    return labels.conflict_rows(fx.records(spark, sf))


@query("c7_dedupe_first", "select * exclude (n) from (select *, row_number() over (partition by grp, domain order by record_id) as n from v_records) where n = 1", "v_records")
def c7(spark, sf):
    return labels.dedupe_first(fx.records(spark, sf), ["grp", "domain"])


@query("c8_rollup_studies", """select entity, min(label) as label, count(*) as n_sources from (select entity, source, max(label) as label from (select *, min(s) over (partition by entity, source) as best from
 (select l_partkey as entity, l_returnflag as source, case when l_linenumber % 4 = 0 then null else l_linenumber % 4 end as score, coalesce(score, 3) as s, (l_linestatus = 'F')::int as label from lineitem) where score is null or score <= 2)
 where s = best group by entity, source) group by entity having min(label) = max(label)""")  # fmt: skip
def c8(spark, sf):
    x = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_returnflag").alias("source"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_linenumber") % 4).alias("score"), (F.col("l_linestatus") == "F").cast("int").alias("label"))
    return labels.rollup_studies(x)


@query("c9_remove_overlap", "select * from v_records where endpoint = 'e1' and key not in (select key from v_records where endpoint = 'e0')", "v_records")
def c9(spark, sf):
    r = fx.records(spark, sf)
    return labels.remove_overlap(r.filter("endpoint = 'e1'"), r.filter("endpoint = 'e0'"))


@query("c10_dataset_overlap", """+ l as (select endpoint, grp, arg_max(label, record_id) as label from v_records group by all), s as (select endpoint, count(*) as n2 from l group by 1),
 b as (select a.endpoint as ep1, b.endpoint as ep2, count(*) as overlap, count(*) filter (a.label = b.label) as concordant, sum(a.label)::double as p1, sum(b.label)::double as p2 from l a join l b on a.grp = b.grp and a.endpoint < b.endpoint group by all)
 select ep1, ep2, overlap, round(100.0::double * overlap / n2, 1) as overlap_pct, concordant, overlap - concordant as discordant,
 case when overlap > 1 then round((concordant / overlap::double - (p1 * p2 + (overlap - p1) * (overlap - p2)) / (overlap::double * overlap)) / nullif(1 - (p1 * p2 + (overlap - p1) * (overlap - p2)) / (overlap::double * overlap), 0), 4) end as kappa from b join s on s.endpoint = ep2""", "v_records")  # fmt: skip
def c10(spark, sf):
    return labels.dataset_overlap(fx.records(spark, sf), key="grp")


@query("c11_concat_tables", "select n_name as name, n_regionkey as region, null::double as balance, 'nation' as source_table from nation union all select s_name, null, s_acctbal, 'supplier' from supplier")
def c11(spark, sf):
    n = fx.table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    s = fx.table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return labels.concat_tables({"nation": n, "supplier": s})


@query("c12_summarize_views", f"""+{VERSIONS} select endpoint as dataset, count(*) as n_total, count(*) as raw_valid_n, count(*) as canonical_valid_n, count(*) as standardized_valid_n, count(distinct canonical_key) as canonical_unique, count(distinct standardized_key) as standardized_unique,
 count(*) filter (canonical_label_conflict) as canonical_conflicts, count(*) filter (standardized_label_conflict) as standardized_conflicts, round(avg(label), 4) as positive_ratio from x group by 1""", "v_records")  # fmt: skip
def c12(spark, sf):
    return keys.summarize_views(keys.preprocessing_views(fx.records(spark, sf)), "endpoint")


@query("l8_duplicate_flag", "select record_id, key, count(*) over (partition by key) > 1 as duplicate from v_records", "v_records")
def l8(spark, sf):
    return labels.duplicate_flag(fx.records(spark, sf)).select("record_id", "key", "duplicate")


# Joins


BITS = "select doc_id as record_id, list_distinct(list_transform(string_split(text, ' '), lambda w: ('0x' || substr(md5(w), 1, 6))::bigint % 4096)) as bits from documents"


@query("d4_tanimoto_max", f"with d as materialized ({BITS}), e as materialized (select record_id, len(bits) as n, unnest(bits) as b from d), p as (select a.record_id as t, a.n as na, b.n as nb, count(*) as k from e a join e b on a.b = b.b and a.record_id % 5 = 0 and b.record_id % 5 <> 0 group by a.record_id, b.record_id, a.n, b.n) select t as record_id, max(k / (na + nb - k)::double) as max_sim from p group by t")
def d4(spark, sf):
    return joins.tanimoto_max(*fx.bits(spark, sf))


@query("d5_euclid_nn", "select t.record_id, round(min(list_distance(t.v, r.v)), 6) as nn_dist from v_vec t join v_vec r on t.split = 'test' and r.split = 'train' group by t.record_id", "v_vec")
def d5(spark, sf):
    v = fx.vectors(spark, sf)
    return joins.euclid_nn(v.filter("split = 'train'"), v.filter("split = 'test'")).withColumn("nn_dist", F.round("nn_dist", 6))


@query("d6_pair_experiments", "with r as (select s_nationkey as g, s_name as model, s_acctbal as score from supplier) select a.g, a.model as model_a, a.score as value_a, b.model as model_b, b.score as value_b from r a join r b on a.g = b.g and a.model < b.model")
def d6(spark, sf):
    s = fx.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_name").alias("model"), F.col("s_acctbal").alias("score"))
    return joins.pair_experiments(s, "g", "model", "score")


@query("d7_lookup_ref_row", "select o_orderkey, o_custkey, arg_min(o_totalprice, o_orderkey) over (partition by o_custkey, o_orderpriority) as ref_price, o_orderpriority from orders")
def d7(spark, sf):
    o = fx.table(spark, sf, "orders")
    ref = o.select("o_custkey", "o_orderpriority", F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("nth"))
    return joins.lookup_ref_row(o.select("o_orderkey", "o_custkey", "o_orderpriority"), ref, ["o_custkey", "o_orderpriority"], "nth").drop("ref_nth")


# Splits

SIZES = "g as (select grp, count(*) as size from v_records group by grp), z as (select size, count(*) as k, row_number() over (order by size desc) as i from g group by size)"
SPLIT = f"""{SIZES}, t as (select 0::bigint as i, (select floor(sum(size * k) * 0.8)::bigint from z) as room, 0::bigint as size, 0::bigint as take union all
 select z.i, t.room - least(z.k, t.room // z.size) * z.size, z.size, least(z.k, t.room // z.size) from t join z on z.i = t.i + 1),
 n as (select grp, size, row_number() over (partition by size order by {draw_sql("'42'", "grp")}, grp) as nth from g), s as (select n.grp, case when n.nth <= t.take then 'train' else 'test' end as split from n join t on n.size = t.size)"""


@query("e1_assign_groups", "select record_id, case when domain in ('1-URGENT', '2-HIGH') then domain else '__UNQ_' || record_id end as \"group\", case when domain in ('1-URGENT', '2-HIGH') then 'cyclic' else 'acyclic' end as group_type from v_records", "v_records")
def e1(spark, sf):
    r = fx.records(spark, sf).withColumn("key", F.when(F.col("domain").isin("1-URGENT", "2-HIGH"), F.col("key")).otherwise(F.col("grp")))
    return splits.assign_groups(r).select("record_id", "group", "group_type")


@query("e3_group_split", f"with recursive v_records as (select o_orderkey as record_id, o_custkey::varchar as grp, (o_orderstatus = 'F')::int as label from orders), {SPLIT} select v.record_id, v.grp, s.split from v_records v join s using (grp)")
def e3(spark, sf):
    return splits.group_split(fx.records(spark, sf)).select("record_id", "grp", "split")


@query("e4_split_report", f"""with recursive v_records as (select o_orderkey as record_id, o_custkey::varchar as grp, (o_orderstatus = 'F')::int as label, concat('e', o_orderkey % 3) as endpoint from orders), {SPLIT},
 p as (select endpoint, grp, count(*) filter (split = 'train') as a, count(*) filter (split = 'test') as b, sum(label) filter (split = 'train') as pa, sum(label) filter (split = 'test') as pb from v_records join s using (grp) group by all)
 select endpoint, sum(a)::bigint as train_n, sum(b)::bigint as test_n, round(sum(pa)::double / sum(a), 4) as train_pos, round(sum(pb)::double / sum(b), 4) as test_pos, round(abs(sum(pa)::double / sum(a) - sum(pb)::double / sum(b)), 4) as diff, count(*) filter (a > 0 and b > 0) as group_overlap, count(*) as n_groups from p group by endpoint""")  # fmt: skip
def e4(spark, sf):
    return splits.split_report(splits.group_split(fx.records(spark, sf)))


FOLDS = f"select rep, grp, ((row_number() over (partition by rep order by {draw_sql("'42'", 'rep::varchar', 'grp')}, grp) - 1) % 5)::int as fold from (select distinct grp from v_records), (select unnest(range(5))::int as rep)"


@query("e5_repeated_group_folds", FOLDS, "v_records")
def e5(spark, sf):
    return splits.repeated_group_folds(fx.records(spark, sf))


@query("e6_fold_uniqueness", f"+ f as ({FOLDS}), p as (select rep, string_agg(fold::varchar, ',' order by grp) as a from f where grp in (select distinct grp from v_records order by grp limit 10) group by rep) select count(distinct a) as n_unique_folds, count(*) as n_reps from p", "v_records")
def e6(spark, sf):
    return splits.fold_uniqueness(splits.repeated_group_folds(fx.records(spark, sf)))


@query("e7_group_kfold", f"""with recursive v_records as (select o_custkey::varchar as grp from orders), g as (select grp, count(*) as size from v_records group by grp), s as (select size, row_number() over (order by size desc) as i from g),
 t as (select 0::bigint as i, [0, 0, 0, 0, 0]::bigint[] as loads, 0::bigint as fold, 0::bigint as size union all select s.i, list_transform(loads, lambda x, j: case when j = list_position(loads, list_min(loads)) then x + s.size else x end), list_position(loads, list_min(loads)) - 1, s.size from t join s on s.i = t.i + 1),
 c as (select size, fold, count(*) as n from t where i > 0 group by all), b as (select size, fold, sum(n) over (partition by size order by fold) as upto from c), n as (select grp, size, row_number() over (partition by size order by {draw_sql("'42'", "grp")}, grp) as nth from g)
 select n.grp, n.size, min(b.fold)::int as fold from n join b on b.size = n.size and b.upto >= n.nth group by all""")  # fmt: skip
def e7(spark, sf):
    return splits.group_kfold(fx.records(spark, sf))


@query("e8_stratified_kfold", f"select record_id, label, ((row_number() over (partition by label order by {draw_sql("'42'", 'record_id::varchar')}, record_id) - 1) % 5)::int as fold from v_events", "v_events")
def e8(spark, sf):
    return splits.stratified_kfold(fx.events(spark, sf)).select("record_id", "label", "fold")


@query("e9_leave_source_out", "select h.domain as held_out, case when v.domain = h.domain then 'test' else 'train' end as role, count(*) as n, sum(v.label)::bigint as n_pos from v_records v, (select distinct domain from v_records) h group by all", "v_records")
def e9(spark, sf):
    return splits.leave_source_out(fx.records(spark, sf))


@query("e10_learning_fractions", f"""+ f as (select record_id, ((row_number() over (partition by label order by {draw_sql("'42'", "record_id::varchar")}, record_id) - 1) % 5)::int as fold from v_events), x as (select *, unnest([0.1::double, 0.2, 0.3, 0.5, 0.7, 1.0]) as fraction from f),
 r as (select *, row_number() over (partition by fold, fraction order by {draw_sql("'42'", "fraction::varchar", "record_id::varchar")}, record_id) as nth, count(*) over (partition by fold, fraction) as n from x) select fold, fraction, record_id from r where nth <= greatest(floor(n * fraction), 10)""", "v_events")  # fmt: skip
def e10(spark, sf):
    return splits.learning_fractions(splits.stratified_kfold(fx.events(spark, sf))).select("fold", "fraction", "record_id")


@query("k15_leakage_check", "select grp, count(distinct endpoint) as n_sides from v_records group by grp having count(distinct endpoint) > 1", "v_records")
def k15(spark, sf):
    return splits.leakage_check(fx.records(spark, sf), "grp", "endpoint")
