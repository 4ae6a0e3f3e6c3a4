"""Set-similarity join on word n-grams: rare-first prefixes, then length, positional and suffix filters, then one exact check per pair."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import components, cut, put, shingle_sets, slices, small_batches, table

WIDTH, PERCENT = 4, 85
#: log2 of the number of counters of the frequency sketch; 4 MB as it is broadcast, whatever the input.
SKETCH_BITS = 22
CHUNK = 1 << 14
_LOW = np.uint64((1 << 56) - 1)


def least(n, percent: int):
    """Smallest overlap with anything that a set of n must have."""
    return -(-percent * n // 100)


def frequency_classes(docs: DataFrame, width: int = WIDTH, bits: int = SKETCH_BITS) -> np.ndarray:
    """For each of 2**bits hash buckets about 8 * log2 of how many shingles of the corpus fall into it, as bytes.

    It orders shingles from rare to frequent. Any fixed order gives the same links; this one keeps passages that many
    documents share out of prefixes. Each task counts its own shingles and sends its counters compressed, in chunks that
    are added up one after the other.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            texts = b["text"].tolist()
            for s in slices(texts):
                at, k = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts[s], width)]) >> np.uint64(64 - bits), return_counts=True)
                total[at] += k.astype(np.uint32)
        for i in range(0, len(total), CHUNK):
            if (part := total[i : i + CHUNK]).any():
                yield pd.DataFrame({"chunk": [i // CHUNK], "counts": [zlib.compress(part.tobytes(), 1)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b["chunk"], b["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
                sums[chunk] = sums[chunk] + part if chunk in sums else part
        for chunk, x in sums.items():
            level = np.minimum(255, np.round(8 * np.log2(x.astype(float) + 1))).astype(np.uint8)
            yield pd.DataFrame({"chunk": [chunk], "levels": [level.tobytes()]})

    parts = docs.select("text").mapInPandas(count, "chunk int, counts binary").repartition("chunk").mapInPandas(add, "chunk int, levels binary")
    out = np.zeros(1 << bits, np.uint8)
    for r in parts.collect():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(bytes(r["levels"]), np.uint8)
    return out


def ordered_sets(texts: list, width: int, levels: np.ndarray) -> Iterator[np.ndarray]:
    """Per text its shingles as sorted uint64: the frequency class in the top byte, 56 bits of hash below."""
    shift = np.uint64(64 - int(len(levels)).bit_length() + 1)
    return shingle_sets(texts, width, lambda h: (levels[h >> shift].astype(np.uint64) << np.uint64(56)) | (h & _LOW))


def signatures(docs: DataFrame, levels: Broadcast, width: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the whole set, and its prefix: the rarest shingles, one more than a partner may miss."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, n, digest, prefix = b["text"].tolist(), [], [], []
            for s in slices(texts):
                for x in ordered_sets(texts[s], width, levels.value):
                    n.append(len(x))
                    digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                    prefix.append(x[: len(x) - least(len(x), percent) + 1].view(np.int64) if len(x) else x.view(np.int64))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n": n, "digest": digest, "prefix": prefix})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, n long, digest binary, prefix array<long>")


def suffix_bound(x: np.ndarray, y: np.ndarray, most: int, depth: int = 3) -> int:
    """A lower bound of how many elements only one of two sorted sets has, by halving both at the middle of y; stops above most."""
    gap = abs(len(x) - len(y))
    if not depth or gap > most or not len(x) or not len(y):
        return gap
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    same = at < len(x) and x[at] == y[mid]
    left, right = (x[:at], y[:mid]), (x[at + same :], y[mid + 1 :])
    rest = abs(len(right[0]) - len(right[1])) + (not same)
    low = suffix_bound(*left, most - rest, depth - 1)
    if low + rest > most:
        return low + rest
    return low + (not same) + suffix_bound(*right, most - low - (not same), depth - 1)


def verify(docs: DataFrame, pairs: DataFrame, levels: Broadcast, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. Only the sets of documents in pairs are made; pairs must be distinct."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            sets = [x.tobytes() for s in slices(texts) for x in ordered_sets(texts[s], width, levels.value)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "digest": [hashlib.blake2b(x, digest_size=16).digest() for x in sets], "members": sets}).loc[[len(x) > 0 for x in sets]]

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for p, q in zip(b["x"], b["y"], strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                most = len(x) + len(y) - 2 * need
                if suffix_bound(x, y, most) > most:
                    keep.append(False)
                    continue
                same = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield b.loc[keep, ["a", "b"]]

    ids = put(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "join-ids")
    used = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi")
    sets = put(used.mapInPandas(make, "doc_id long, digest binary, members binary"), "join-sets").groupBy("doc_id").agg(F.min_by("members", "digest").alias("members"))
    joined = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a")
    return joined.select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def similar(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest doc_id that links lead to.

    Documents link when 100 * shared >= percent * all of their two shingle sets. Equal sets are one class and their
    smallest doc_id stands for them. Two sets that link share one of their rarest shingles (the prefix); a pair that meets
    there is dropped if the sizes differ too much or if what comes after the meeting place cannot suffice, and is checked
    once.

    No group gives all its pairs. First each member of a prefix shingle's group is paired with two pivots of it: the one
    with the fewest rarer shingles, likely the text that the others were copied from, and one by hash. Pairs that link are
    merged. After that only pairs from different components are left to test, and in each group all of these are: every
    member outside the group's largest component with every member of other components. So no link between components is
    lost, and members of one component need no further pairs.

    Null or empty text, or text without words: n_shingles 0, its own component. Null doc_id: component_id null, no part
    in links. Rows that repeat a doc_id are one document; if their texts differ, the one whose set has
    the smallest digest stands for it. Empty table: empty result. Further columns are
    ignored, whatever their names. Shingles are known by 56 bits of a hash, so that links rest on these.
    """
    spark = docs.sparkSession
    small_batches(spark)
    levels = spark.sparkContext.broadcast(frequency_classes(docs, width, bits))
    sig = put(signatures(docs, levels, width, percent), "join-signatures")
    named = sig.filter("n > 0 and doc_id is not null")
    twice = put(named.groupBy("doc_id").agg(F.min("digest").alias("only"), F.max("digest").alias("other")).filter("only <> other").select(F.col("doc_id").alias("twice"), "only"), "join-twice")
    if not twice.isEmpty():
        sig = sig.join(twice, F.col("doc_id") == F.col("twice"), "left")
        named = sig.filter("n > 0 and doc_id is not null and (only is null or only = digest)")
        sig = sig.withColumn("digest", F.coalesce("only", "digest"))
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    index = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "tok"))
    # Most shingles are in one set only. Counts alone are shuffled to find the others; pivots are for what is left.
    groups = index.groupBy("tok").agg(F.count("*").alias("c")).filter("c > 1").select("tok")
    shared = put(index.join(groups, "tok"), "join-shared")
    by_pos = F.shiftleft(F.col("pos").cast("long"), 32) + F.pmod(F.xxhash64("rep"), F.lit(1 << 32))
    by_hash = F.xxhash64("rep", F.col("tok") % 2)
    pivots = shared.groupBy("tok").agg(F.min_by("rep", by_pos).alias("p1"), F.min_by("n", by_pos).alias("n1"), F.min("pos").alias("pos1"), F.min_by("rep", by_hash).alias("p2"), F.min_by("n", by_hash).alias("n2"))

    def fits(n, m, pos_n=None, pos_m=None):
        small, large = F.least(F.col(n), F.col(m)), F.greatest(F.col(n), F.col(m))
        ok = small * 100 >= large * percent
        if pos_m is not None:
            most = F.least(F.col(n) - F.col(pos_n), F.col(m) - F.col(pos_m))
            ok = ok & (most * (100 + percent) >= (F.col(n) + F.col(m)) * percent)
        return ok

    def ordered(x, y):
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    one = F.when(fits("n", "n1", "pos", "pos1") & (F.col("rep") != F.col("p1")), F.struct(*ordered("rep", "p1")))
    two = F.when(fits("n", "n2") & (F.col("rep") != F.col("p2")), F.struct(*ordered("rep", "p2")))
    stars = shared.join(pivots, "tok").select(F.explode(F.array_distinct(F.filter(F.array(one, two), lambda x: x.isNotNull()))).alias("x"))
    stars = cut(stars.select("x.a", "x.b").distinct())
    links = cut(verify(docs, stars, levels, width, percent))

    roots = components(links)
    label = F.coalesce("root", "rep").alias("label")
    rows = shared.select("tok", "rep", "n", "pos").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("tok", "rep", "n", "pos", label)
    largest = rows.groupBy("tok", "label").agg(F.count("*").alias("k")).groupBy("tok").agg(F.count("*").alias("labels"), F.max_by("label", "k").alias("major")).filter("labels > 1").drop("labels")
    rows = cut(rows.join(largest, "tok"))
    left = rows.filter("label <> major")
    right = rows.select("tok", F.col("rep").alias("rep2"), F.col("n").alias("m"), F.col("pos").alias("pos2"), F.col("label").alias("label2"))
    met = left.join(right, "tok").filter((F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("major")) | (F.col("rep") < F.col("rep2"))) & fits("n", "m", "pos", "pos2"))
    rest = cut(met.select(*ordered("rep", "rep2")).distinct().join(stars, ["a", "b"], "left_anti"))
    links = links.union(cut(verify(docs, rest, levels, width, percent)))

    roots = components(links)
    reps = classes.select("digest", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("component"))
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = sig.select("doc_id", "n", "digest").join(reps, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def drop_similar(docs: DataFrame, **how) -> DataFrame:
    """docs with one document, the one of the smallest doc_id, of each component; documents without an id stay."""
    gone = put(similar(docs, **how).filter("doc_id <> component_id").select("doc_id").distinct(), "join-dropped")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] for i in range(1, len(w) - 2)]) end as g from w),
u as materialized (select doc_id, len(g) as n, unnest(g) as x from s),
p as materialized (select a.doc_id as a, b.doc_id as b, a.n as n, b.n as m, count(*) as k from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by all),
l as materialized (select a, b from p where 100 * k >= 85 * (n + m - k)),
e as materialized (select a, b from l union select b, a from l),
r as (select doc_id as node, doc_id as root from s union select e.b, r.root from r join e on r.node = e.a)
select s.doc_id, len(s.g)::bigint as n_shingles, min(r.root) as component_id from s join r on r.node = s.doc_id group by s.doc_id, len(s.g)
"""

QUERIES = {"op9_ngram_jaccard_join": op9_ngram_jaccard_join}
SQL = {"op9_ngram_jaccard_join": OP9_SQL}
