"""A Merkle manifest of a table: one tree a language, one over languages, and for each row a proof, folded and compared.

Trees are cut into superblocks of 2**LEVELS neighbouring nodes. Going up, each superblock is reduced to its top, and tops
are the nodes of the next tier, until a tree has one. Going down, a tier's nodes and the outer nodes that its superblocks
need (the siblings above their tops) are cogrouped by superblock, which gives the next tier's outer nodes; over the leaves
the same cogroup reduces the superblock, joins the proofs and folds them.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.common import put, table

#: A superblock has at most 2**LEVELS nodes; a group of a task is one superblock.
LEVELS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(n_chars: Column) -> Column:
    """The digest of a row's fields, each `-` if null, else its length in bytes, a colon, and its value."""
    values = [n_chars if c == "n_chars" else F.col(c) for c in FIELDS]
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, leaf, other): a language's tree by a name that sorts as the language does, null first; other is the leaf after tampering, null without."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("n_chars")).alias("leaf"), F.when(tampered, leaf_digest(F.col("n_chars") + 1)).alias("other"))


def placed(rows: DataFrame, order: list[str], part_rows: int = 20_000) -> DataFrame:
    """rows (tree, *order and no more) with pos, the place from 0 in its tree by `order`, and size, the tree's rows.

    Rows are ranged by Spark, numbered within a range and offset by the counts of the ranges before, so a tree of any size
    is spread over many tasks. Equal rows travel as one with their number, and are dealt out last.
    """
    n = rows.count()
    alike = rows.groupBy("tree", *order).agg(F.count("*").alias("copies"))
    ranged = put(alike.repartitionByRange(1 + n // part_rows, "tree", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = ranged.groupBy("tree", "part").agg(F.sum("copies").alias("k"))
    own = W.partitionBy("tree")
    counts = counts.select("tree", "part", (F.sum("k").over(own.orderBy("part")) - F.col("k")).alias("ahead"), F.sum("k").over(own).alias("size"))
    inside = F.sum("copies").over(W.partitionBy("tree", "part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col("copies")
    out = ranged.withColumn("inside", inside).join(counts, ["tree", "part"])
    first = F.col("ahead") + F.col("inside")
    return out.withColumn("pos", F.explode(F.sequence(first, first + F.col("copies") - 1))).select("tree", *order, "pos", "size")


def local_depth(size: int, levels: int = LEVELS) -> int:
    """How many levels of a tier of `size` nodes lie within a superblock."""
    return min(levels, (int(size) - 1).bit_length())


def reduced(nodes: list[str], depth: int) -> list[list[str]]:
    """All levels of a superblock, its nodes first: each two consecutive nodes, or the last one alone, become one."""
    out = [nodes]
    for _ in range(depth):
        out.append([sha("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(levels: list[list[str]], at: int) -> list[str]:
    """For each level below the top the sibling of the node above leaf `at`, with L or R for its side; an empty text where there is none."""
    out = []
    for nodes in levels[:-1]:
        other = at ^ 1
        out.append((("L" if other < at else "R") + nodes[other]) if other < len(nodes) else "")
        at >>= 1
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    for s in path:
        leaf = sha(s[1:] + leaf if s[:1] == "L" else leaf + s[1:])
    return leaf


def _with_block(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("pos", levels))


def climb(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """From nodes (tree, hash, pos, size): the tiers, leaves first, and (tree, hash) of each tree's root."""

    def top(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("pos")
        return pd.DataFrame({"tree": x["tree"].iloc[:1], "hash": [reduced(x["hash"].tolist(), local_depth(x["size"].iloc[0], levels))[-1][0]], "pos": x["block"].iloc[:1], "size": [-(-int(x["size"].iloc[0]) >> levels)]})

    tiers, most = [nodes], nodes.agg(F.max("size")).first()[0] or 0
    while True:
        up = put(_with_block(tiers[-1], levels).groupBy("tree", "block").applyInPandas(top, "tree string, hash string, pos long, size long"), "merkle-tops")
        if most <= 1 << levels:
            return tiers, up.select("tree", "hash")
        tiers, most = [*tiers, up], -(-most >> levels)


def descend(tiers: list[DataFrame], outer: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Outer nodes of the leaves' superblocks: (tree, block, path, subroot, root), given those of each tree as a whole."""

    def step(x: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("pos")
        tree, rest = reduced(x["hash"].tolist(), local_depth(x["size"].iloc[0], levels)), list(above["path"].iloc[0])
        paths = [siblings(tree, i) + rest for i in range(len(x))]
        return pd.DataFrame({"tree": x["tree"], "block": x["pos"], "path": paths, "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    for nodes in reversed(tiers[1:]):
        outer = put(_with_block(nodes, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(step, OUTER), "merkle-outer")
    return outer


OUTER = "tree string, block long, path array<string>, subroot string, root string"


def manifest(docs: DataFrame, tampered: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """One row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a language ascend by doc_id, null first; rows that share a doc_id by their leaves; repeated rows are leaves of
    their own, side by side. Null fields are told from empty ones; null lang is a language, the first. `tampered` marks rows
    whose n_chars was raised by 1 after the manifest was made (null n_chars stays): their folded_root is another, and
    verified false. Long texts are hashed where they are read and go no further. Empty table: empty result. Further
    columns are ignored, whatever their names.
    """
    rows = put(leaves(docs.select(*FIELDS), F.lit(False) if tampered is None else tampered), "merkle-leaves")
    rows = put(placed(rows, ["doc_id", "leaf", "other"]), "merkle-placed")
    tiers, subroots = climb(rows.select("tree", F.col("leaf").alias("hash"), "pos", "size"), levels)
    subroots = put(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "hash"), ["key", "hash"]), "merkle-subroots")
    over, root = climb(subroots, levels)
    whole = root.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("hash").alias("root"))
    outer = descend([over[0], *over], whole, levels)  # its leaves are nodes to the trees below them
    outer = outer.select(F.col("block").alias("pos"), "path", "root").join(subroots, "pos").select(F.col("key").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("hash").alias("subroot"), "root")
    outer = descend(tiers, put(outer, "merkle-whole"), levels)

    def finish(x: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("pos")
        tree, rest = reduced(x["leaf"].tolist(), local_depth(x["size"].iloc[0], levels)), list(above["path"].iloc[0])
        root, proofs, folded = above["root"].iloc[0], [], []
        for i, (leaf, other) in enumerate(zip(x["leaf"], x["other"], strict=True)):
            path = siblings(tree, i) + rest
            proofs.append(sha("".join(s[1:] for s in path)))
            folded.append(fold(other or leaf, path))
        return pd.DataFrame({"doc_id": x["doc_id"].astype("Int64"), "leaf": x["leaf"], "subroot": above["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _with_block(rows, levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(finish, schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


OP13_SQL = """
with recursive crc as materialized (select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
d as materialized (select *, xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 7 = 0 as bad from documents, crc),
e as materialized (select doc_id, lang, bad, [coalesce(strlen(v) || ':' || v, '-') for v in [doc_id::varchar, source, lang]] as a, n_chars, coalesce(strlen(text) || ':' || text, '-') as z from d),
f as materialized (select doc_id, coalesce('=' || lang, '') as tree, sha256(array_to_string(a, '') || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || z) as leaf, sha256(array_to_string(a, '') || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || z) as other, bad from e),
l as materialized (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from f),
nodes as (select tree, 0 as level, pos, leaf as h, n from l union all select tree, level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from nodes where n > 1 group by tree, level, pos // 2, n),
s as materialized (select tree, h as subroot, max(level) over () as most, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1),
over_ as (select 0 as level, pos, subroot as h, n from s union all select level + 1, pos // 2, sha256(string_agg(h, '' order by pos)), (n + 1) // 2 from over_ where n > 1 group by level, pos // 2, n),
root as (select h as root from over_ where n = 1),
steps as (select distinct tree, level, n from nodes where n > 1),
low as (select l.tree, l.pos, steps.level, coalesce(case when x.pos < l.pos >> steps.level then 'L' else 'R' end || x.h, '') as sib from l join steps using (tree) left join nodes x on x.tree = l.tree and x.level = steps.level and x.pos = xor(l.pos >> steps.level, 1)),
low2 as (select tree, pos, list(sib order by level) as sibs from low group by all),
high as (select s.tree, o.level, coalesce(case when x.pos < s.pos >> o.level then 'L' else 'R' end || x.h, '') as sib from s join (select distinct level from over_ where n > 1) o on true left join over_ x on x.level = o.level and x.pos = xor(s.pos >> o.level, 1)),
high2 as (select tree, list(sib order by level) as sibs from high group by all),
p as (select l.doc_id, l.leaf, s.subroot, root.root, coalesce(low2.sibs, []) || coalesce(high2.sibs, []) as path, case when l.bad then l.other else l.leaf end as now
    from l join s using (tree) cross join root left join low2 on low2.tree = l.tree and low2.pos = l.pos left join high2 on high2.tree = l.tree),
q as (select *, list_reduce([now] || path, lambda h, x: case when x[1] = 'L' then sha256(x[2:] || h) else sha256(h || x[2:]) end) as folded_root from p)
select doc_id, leaf, subroot, root, sha256(array_to_string([x[2:] for x in path], '')) as proof_sha256, folded_root, folded_root = root as verified from q
"""

QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}
SQL = {"op13_merkle_manifest": OP13_SQL}
