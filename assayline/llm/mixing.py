"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.common import WORD, cut, put, table, unit

SEED = "mix"


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): 2 for good documents, 0.5 for bad ones, in between for mixed labels; unlabelled ones weigh 1 later."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.lit(0.5) + F.lit(1.5) * F.avg("quality")).alias("weight"))


def word_count() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sampling_key(seed: str) -> Column:
    """Exponential, the smaller the larger the weight."""
    return -F.log(unit(seed, "doc_id")) / F.coalesce("weight", F.lit(1.0))


def source_key() -> Column:
    """The source as a text that is never null, as null matches nothing in a join."""
    return F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets of each source of sizes (source, size): share * all words, dealt by weight, none above most * its own.

    A source that would get more than its bound is held there and the rest is dealt again. That ends at a level: with the
    sources ordered by bound / weight, the first one whose share of what the earlier ones leave is within its bound sets
    it. One sorted pass over the per-source rows finds it.
    """
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    src = src.withColumn("w", F.element_at(F.array([F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    src = src.withColumn("bound", F.col("source_size") * F.lit(float(most)))
    order = W.orderBy(F.col("bound") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("bound").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    src = src.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / rest).withColumn("at", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("bound") / F.col("w"), F.struct("at", "level"))
    src = src.withColumn("level", F.min(fits).over(everything)["level"])
    target = F.coalesce(F.least("bound", F.col("w") * F.col("level")), F.col("bound"))
    goal = F.round(target).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return src.select("source", "source_size", "n", target.alias("target"), epochs.alias("epochs"), (goal - epochs * F.col("source_size")).alias("part"))


def mix(docs: DataFrame, quality: DataFrame | None = None, *, weight: Column | None = None, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = SEED, bucket_rows: int = 2_000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, epochs, taken, copies, key.

    Quality weights come from a table (doc_id, weight), or from the document itself as a column of `text` and `size`.

    Every document is taken `epochs` times, the same for its whole source; what then misses to the target, less than one
    epoch, is filled in the order of exponential keys -ln(u) / weight, u from a hash of doc_id, so that reruns agree. The
    document at the end of the budget gives the words that still miss, so a source's taken words are its rounded target;
    `copies` rounds that document to a whole one.

    Prefix sums: keys fall into buckets of about bucket_rows documents per source, as 1 - exp(-key) is nearly uniform;
    sums inside a bucket are a window over it, sums before it a window over the buckets of a source. So a hot source is
    spread over many tasks.

    Null text: size 0. Null source: a source of its own, last. Null doc_id: an id like another. Repeated rows are
    documents like others. Empty table: empty result. Further columns are ignored.
    """
    sized = docs.select("doc_id", "source", "text", word_count().alias("size"))
    if quality is not None:
        sized = sized.drop("text").join(quality, "doc_id", "left")
    else:
        sized = sized.withColumn("weight", F.lit(None).cast("double") if weight is None else weight)
    sized = cut(sized.select("doc_id", "source", "size", sampling_key(seed).alias("key"), source_key().alias("src")))
    targets = put(source_targets(sized, weights, share, most), "mix-targets")
    targets = targets.withColumn("src", source_key()).drop("source")
    n = F.ceil(F.col("n") / F.lit(bucket_rows))
    rows = sized.join(targets, "src").withColumn("bucket", F.least(F.floor((F.lit(1.0) - F.exp(-F.col("key"))) * n), n - 1).cast("long"))
    sums = rows.groupBy("src", "bucket").agg(F.sum("size").alias("sum"))
    ahead = F.sum("sum").over(W.partitionBy("src").orderBy("bucket")) - F.col("sum")
    sums = sums.select(F.col("src").alias("b_src"), F.col("bucket").alias("b_bucket"), ahead.alias("ahead"))
    inside = F.sum("size").over(W.partitionBy("src", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    rows = rows.withColumn("inside", inside).join(sums, (F.col("src") == F.col("b_src")) & (F.col("bucket") == F.col("b_bucket")))
    left = F.col("part") - F.col("ahead") - F.col("inside")
    some = F.greatest(F.lit(0), F.least("size", left))
    taken = F.col("epochs") * F.col("size") + some
    copies = F.col("epochs") + ((left > 0) & (some * 2 >= F.col("size"))).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"), copies.alias("copies"), "key")


def mix_rows(docs: DataFrame, quality: DataFrame | None = None, *, seed: str = SEED, **how) -> DataFrame:
    """docs with each row as often as `mix` takes the whole document: its epochs, and once more if at least half of it is taken then.

    Those taken once more are the ones up to the last such key of their source, so each row is decided by its weight and a
    table of one row per source. Rows alike in doc_id and size at that place are taken alike. Weights are joined to the
    documents, whose texts are shuffled once for that, at every size of the tables.

    Null text has size 0 and is taken as its key says, with no words; null source is a source, the last; null doc_id has the
    weight of unlabelled documents. Texts may be of any length: of them only the size is ranked. Empty table: empty result.
    All columns stay as they are, whatever their names.
    """
    quality = None if quality is None else put(quality.select("doc_id", "weight"), "mix-weights")
    plan = mix(docs, quality, seed=seed, **how)
    place = F.struct("key", "doc_id", "size")
    ends = plan.groupBy("source").agg(F.first("epochs").alias("_epochs"), F.max(F.when(F.col("copies") > F.col("epochs"), place)).alias("_end"))
    ends = put(ends.select(source_key().alias("_src"), "_epochs", "_end"), "mix-ends")
    rows = docs.withColumns({"_row": F.struct(*docs.columns), "size": word_count()}).select("_row", "doc_id", "source", "size")
    # No bound is known for the weights, so they aren't to be broadcast at any size.
    rows = rows.withColumn("weight", F.lit(None).cast("double")) if quality is None else rows.join(quality.hint("merge"), "doc_id", "left")
    rows = rows.withColumns({"key": sampling_key(seed), "_at": source_key()}).join(ends, F.col("_at") == F.col("_src"))
    copies = (F.col("_epochs") + F.coalesce(place <= F.col("_end"), F.lit(False)).cast("long")).cast("int")
    return rows.withColumn("_nth", F.explode(F.array_repeat(F.lit(1), copies))).select("_row.*")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
with q as (select doc_id, 0.5 + 1.5 * avg(quality) as weight from labels where doc_id is not null and quality is not null group by doc_id),
d as (select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
        -ln((('0x' || substr(md5('mix:' || d.doc_id::varchar), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / coalesce(q.weight, 1.0) as key
      from documents d left join q using (doc_id)),
s0 as (select source, sum(size)::bigint as source_size from d group by source),
s1 as (select *, [3.0, 1.0, 2.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w, source_size * 2.0::double as bound from s0),
s2 as (select *, ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(bound) over (order by bound / w, source nulls last rows between unbounded preceding and 1 preceding), 0.0))
        / sum(w) over (order by bound / w, source nulls last rows between current row and unbounded following) as lv,
        row_number() over (order by bound / w, source nulls last) as nth from s1),
l as (select arg_min(lv, nth) as level from s2 where lv <= bound / w),
s3 as (select source, source_size, coalesce(least(bound, w * level), bound) as target from s2, l),
s as (select *, case when source_size > 0 then round(target)::bigint // source_size else 0 end as epochs from s3),
r as (select d.doc_id, d.size, s.source_size, s.target, s.epochs, round(s.target)::bigint - s.epochs * s.source_size as part,
        coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as ahead
      from d join s on d.source is not distinct from s.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, part - ahead)))::bigint as taken from r
"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
SQL = {"op4_mix_sources": OP4_SQL}
