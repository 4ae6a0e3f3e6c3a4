"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked within a Hamming distance through vantage-point trees.

A pair within `radius` bits of each other is within a quarter of that on one quarter of the bits. So there are four trees,
one a quarter: their nodes split fingerprints by the distance to a vantage point, on that quarter (bound radius // 4) or on
all bits (bound radius), whichever parts a sample of the node better. What lies beyond the cut goes to one branch; by the
triangle bound only fingerprints that lie no more than the bound beyond it can link with the other branch, and these go
there too. So each linking pair meets in a shard of a tree, and no other branch is visited. On random fingerprints a cut on
a quarter sends about a sixth to both branches, a cut on all bits a third.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import components, cut, put, small_batches, table

WIDTH, RADIUS, SEED = 4, 4, 42
#: A shard of more fingerprints than SHARD is parted, by a tree of at most 2**DEPTH leaves, fitted on about SAMPLE of them; leaves that want more levels go on in the next round.
SHARD, DEPTH, SAMPLE, ROUNDS = 4096, 8, 4096, 7
#: Rows of a shard that one task routes at a time; bytes of a text whose shingles are held at a time.
ROUTED, BLOCK = 50_000, 1 << 19
ALL = np.uint64((1 << 64) - 1)
QUARTERS = tuple(np.uint64(0xFFFF << 16 * i) for i in range(4))
#: Added to the number of a leaf that wants more levels.
OPEN = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str | None, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of a text, in blocks; of the whole sequence, if it is shorter than a shingle."""
    data, at, kept, whole = (text or "").encode("utf-8", "surrogatepass"), 0, [], True
    while at < len(data):
        end = _GAP.search(data, min(len(data), at + BLOCK))
        end = end.start() if end else len(data)
        words, at = kept + data[at:end].translate(_LOWER).split(), end + 1
        if len(words) >= width:
            stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            start = np.concatenate([[0], stop[:-1] + 1])
            joined = b" ".join(words)
            spans = zip(start[: len(words) - width + 1].tolist(), stop[width - 1 :].tolist(), strict=True)
            yield np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - width + 1)
            whole = False
        kept = words[-(width - 1) :] if width > 1 else []
    if whole and kept:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(kept), SEED)], np.uint64)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Bit i is 1 if it is in more than half of the shingles' hashes; 0 for a text without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        for k in range(0, len(h), 8192):
            part = h[k : k + 8192]
            ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of each row, fp as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fp long")


def distance(x: np.ndarray, y, mask=ALL) -> np.ndarray:
    return np.bitwise_count((x ^ y) & mask)


def grow(sample: np.ndarray, total: int, mask: np.uint64, radius: int = RADIUS, shard: int = SHARD, depth: int = DEPTH) -> np.ndarray:
    """A tree over a sample of `total` fingerprints: rows (vantage point, bits compared, cut, bound, inner, outer), the last two a row's number or, below 0, -1 - a leaf's, with OPEN added if only the depth ended it.

    Of a few vantage points, both measures and all cuts, a node takes the one that leaves the fewest pairs to compare, and
    none if that isn't a fifth fewer. No rows: the tree is one leaf.
    """
    nodes: list[list[int]] = []
    leaves = 0

    def best(s: np.ndarray) -> tuple | None:
        found, least = None, 0.88 * len(s) ** 2
        for v in s[:: max(1, len(s) // 8)][:8]:
            for bits, bound in ((mask, radius // len(QUARTERS)), (ALL, radius)):
                upto = np.cumsum(np.bincount(distance(s, v, bits), minlength=65))
                inner, outer = upto[np.minimum(np.arange(65) + bound, 64)], len(s) - upto
                cost = inner.astype(float) ** 2 + outer.astype(float) ** 2
                cost[outer == 0] = np.inf
                c = int(np.argmin(cost))
                if cost[c] < least:
                    found, least = (v, bits, c, bound), cost[c]
        return found

    def make(s: np.ndarray, left: int) -> int:
        nonlocal leaves
        large = len(s) > 1 and total * len(s) > shard * len(sample)
        split = best(s) if left and large else None
        if split is None:
            leaves += 1
            return -leaves - (OPEN if large and not left else 0)
        v, bits, c, bound = split
        at, d = len(nodes), distance(s, v, bits)
        nodes.append([int(v.view(np.int64)), int(bits.view(np.int64)), c, bound, 0, 0])
        nodes[at][4:] = make(s[d <= c + bound], left - 1), make(s[d > c], left - 1)
        return at

    make(np.sort(sample), depth)
    return np.array(nodes, np.int64).reshape(-1, 6)


def route(tree: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, row): the leaves to which each of x goes, the overlaps of cuts included."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        at, rows = todo.pop()
        if at < 0:
            out.append((np.full(len(rows), -1 - at), rows))
            continue
        v, bits, c, bound, inner, outer = tree[at]
        d = distance(x[rows], v.view(np.uint64), bits.view(np.uint64))
        todo += [(inner, rows[d <= c + bound]), (outer, rows[d > c])]
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def forest(x: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold together what links within `radius` hold together among distinct x: at most len(x) - 1, whatever the number of links."""
    linked = np.zeros(len(x), bool)
    for i in range(0, len(x), 64):
        near = distance(x[i : i + 64, None], x[None, i:]) <= radius
        k = np.arange(len(near))
        near[k, k] = False
        linked[i : i + 64] |= near.any(1)
        linked[i:] |= near.any(0)
    rest, a, b = x[linked], [], []
    while len(rest):
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            near = distance(front[:64, None], rest[None, :]) <= radius
            hit = near.any(0)
            a.append(front[:64][near.argmax(0)[hit]])
            b.append(rest[hit])
            front, rest = np.concatenate([front[64:], rest[hit]]), rest[~hit]
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def sharded(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(shard, fp): the distinct fingerprints dealt to the shards of all trees, so that each pair within `radius` is in a shard together.

    Trees grow by rounds. In each, a shard that is still open gives a sample to one task, which fits its next levels; its
    fingerprints, in runs of bounded size, are routed through these. A leaf that is small enough, or that no vantage point
    parts, is closed.
    """

    def fit(x: pd.DataFrame) -> pd.DataFrame:
        tree = grow(x["fp"].to_numpy(np.int64).view(np.uint64), int(x["n"].iloc[0]), QUARTERS[x["part"].iloc[0]], radius, shard)
        return pd.DataFrame({"shard": x["shard"].iloc[:1], "n": x["n"].iloc[:1], "tree": [tree.ravel()]}).iloc[: len(tree)]

    def deal(x: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"shard": [], "part": [], "fp": [], "open": []}).astype({"shard": "int64", "part": "int32", "fp": "int64", "open": bool})
        leaf, row = route(np.asarray(trees["tree"].iloc[0], np.int64).reshape(-1, 6), x["fp"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"shard": (x["shard"].iloc[0] << DEPTH) + leaf % OPEN, "part": x["part"].iloc[0], "fp": x["fp"].to_numpy()[row], "open": leaf >= OPEN})

    part = F.explode(F.array(*[F.lit(i) for i in range(len(QUARTERS))]))
    now = put(points.select("fp", part.alias("part")).select((F.col("part") + 1).cast("long").alias("shard"), "part", "fp"), "simhash-members")
    done = []
    for i in range(ROUNDS):
        sizes = put(now.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > shard), "simhash-sizes")
        drawn = now.join(sizes, "shard").filter(F.pmod(F.xxhash64("fp", F.lit(i)), F.ceil(F.col("n") / SAMPLE)) == 0)
        trees = put(drawn.groupBy("shard").applyInPandas(fit, "shard long, n long, tree array<long>"), "simhash-trees")
        if trees.isEmpty():
            break
        runs = F.ceil(F.col("n") / ROUTED)
        marked = now.join(trees.select("shard", "n"), "shard", "left")
        done.append(marked.filter("n is null").select("shard", "fp"))
        members = marked.filter("n is not null").withColumn("run", F.pmod(F.xxhash64("fp"), runs))
        wanted = trees.select("shard", "tree", F.explode(F.sequence(F.lit(0).cast("long"), runs - 1)).alias("run"))
        dealt = put(members.groupBy("shard", "run").cogroup(wanted.groupBy("shard", "run")).applyInPandas(deal, "shard long, part int, fp long, open boolean"), "simhash-members")
        done.append(dealt.filter("not open").select("shard", "fp"))
        now = dealt.filter("open").drop("open")
    return reduce(DataFrame.unionByName, done, now.select("shard", "fp"))


def links(points: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(a, b): pairs of fingerprints within `radius` bits that hold together all that such pairs hold together; points: fp, distinct.

    A shard gives a spanning forest of its links, not all of its pairs. A shard that no tree could part is compared in pairs
    of blocks.
    """

    def linked(x: pd.DataFrame) -> pd.DataFrame:
        a, b = forest(np.unique(x["fp"].to_numpy(np.int64)).view(np.uint64), radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    members = put(sharded(points, radius, shard), "simhash-shards")
    sizes = members.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / (2 * shard))
    block, other = F.pmod(F.xxhash64("fp", F.lit(-1)), F.col("blocks")), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    parts = members.join(sizes, "shard").withColumn("blocks", blocks).withColumn("block", block).withColumn("other", other)
    parts = parts.select("shard", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
    return parts.groupBy("shard", "i", "j").applyInPandas(linked, "a long, b long")


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id that links lead to.

    Rows link when their fingerprints differ in at most `radius` bits. Equal fingerprints are one point. Null or empty text,
    or text without words: fingerprint zero, linked like any other. Null doc_id: component_id null, no part in links. Rows
    that repeat a doc_id are points of their own. Texts may be of any length. Empty table: empty result. Further columns
    are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = put(fingerprints(docs, width), "simhash-rows")
    points = put(rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-points")
    roots = components(cut(links(points.select("fp"), radius, shard)))
    placed = put(points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    first = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    found = put(placed.join(first, "root").select("fp", "component_id"), "simhash-components")
    own = F.when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return rows.join(found, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), own.alias("component_id"))


def op11_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op11_simhash_near_dedup": op11_simhash_near_dedup}
SQL: dict[str, str] = {}
