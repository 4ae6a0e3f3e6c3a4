"""Nearest neighbours through a hierarchical k-means tree, searched best bin first, with leaf visits widened to a calibrated recall."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.common import cut, put, table, unit


class Tree:
    """Centres by node; children of a node are a run of nodes. Leaves are numbered in node order."""

    def __init__(self, dim: int) -> None:
        self.centres = np.zeros((1, dim))
        self.first, self.count = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from the root to the nearest child, down."""
        node = np.zeros(len(x), np.int64)
        while True:
            inner = np.unique(node[self.count[node] > 0])
            if not len(inner):
                return node
            for i in inner:
                rows = np.flatnonzero(node == i)
                node[rows] = self.nearest_child(i, x[rows])

    def nearest_child(self, i: int, x: np.ndarray) -> np.ndarray:
        c = self.centres[self.first[i] : self.first[i] + self.count[i]]
        return self.first[i] + np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)

    def best_first(self, q: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a priority queue of unexpanded branches, by distance of their centres."""
        queue = [(0.0, 0)]
        while queue:
            _, i = heapq.heappop(queue)
            if not self.count[i]:
                yield i
                continue
            lo, hi = self.first[i], self.first[i] + self.count[i]
            for k, d in zip(range(lo, hi), ((self.centres[lo:hi] - q) ** 2).sum(1).tolist(), strict=True):
                heapq.heappush(queue, (d, k))


def matrix(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), float).reshape(len(s), -1)


def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of vectors and counts by (node, k), of rows that a task holds together."""
    total: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
    for b in batches:
        for node, k, s, m in zip(b["node"], b["k"], b["s"], b["m"], strict=True):
            t, n = total.get((node, k), (0.0, 0))
            total[node, k] = t + s, n + m
    yield pd.DataFrame([(node, k, s.tolist(), m) for (node, k), (s, m) in total.items()], columns=["node", "k", "s", "m"])


def grow(spark: SparkSession, sample: DataFrame, n: int, dim: int, *, leaf_rows: int, branch: int, rounds: int, sample_rows: int) -> Tree:
    """Fit the tree on sample (v), level by level: all nodes of a level take Lloyd steps at once, each a grouped sum of vectors.

    The driver holds the centres, whose number is bounded by n / leaf_rows and by sample_rows / 8.
    """
    tree = Tree(dim)
    depth = max(0, round(math.log(max(min(n / leaf_rows, sample_rows / 8), 1), branch)))
    for _ in range(depth):
        shared = spark.sparkContext.broadcast(tree)

        def spread(batches: Iterator[pd.DataFrame], shared: Broadcast = shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"node": shared.value.route(matrix(b["v"])), "v": b["v"], "k": b["k"]})

        routed = cut(sample.mapInPandas(spread, "node long, v array<double>, k long"))
        seeds = routed.withColumn("nth", F.row_number().over(W.partitionBy("node").orderBy("k"))).filter(F.col("nth") <= branch).collect()
        centres: dict[int, np.ndarray] = {}
        for r in seeds:
            centres.setdefault(r["node"], []).append(r["v"])
        centres = {k: np.array(v) for k, v in centres.items()}
        for _ in range(rounds):
            held = spark.sparkContext.broadcast(centres)

            def sums(batches: Iterator[pd.DataFrame], held: Broadcast = held) -> Iterator[pd.DataFrame]:
                total: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
                for b in batches:
                    for node, g in b.groupby("node"):
                        x, c = matrix(g["v"]), held.value[node]
                        at = np.argmin((c * c).sum(1) - 2 * (x @ c.T), axis=1)
                        for k in np.unique(at):
                            s, m = total.get((node, k), (0.0, 0))
                            total[node, k] = s + x[at == k].sum(0), m + int((at == k).sum())
                rows = [(node, k, s.tolist(), m) for (node, k), (s, m) in total.items()]
                yield pd.DataFrame(rows, columns=["node", "k", "s", "m"])

            # Whole vectors are summed, the rows of a node one after the other.
            part = routed.mapInPandas(sums, "node long, k int, s array<double>, m long").repartition("node")
            got = part.mapInPandas(add, "node long, k int, s array<double>, m long")
            moved: dict[int, list[np.ndarray]] = {}
            for r in got.orderBy("node", "k").collect():
                moved.setdefault(r["node"], []).append(np.array(r["s"]) / r["m"])
            centres = {k: np.array(v) for k, v in moved.items()}
        for node, c in sorted(centres.items()):
            if len(c) > 1:
                tree.first[node], tree.count[node] = len(tree.centres), len(c)
                tree.centres = np.concatenate([tree.centres, c])
                tree.first, tree.count = np.concatenate([tree.first, np.zeros(len(c), np.int64)]), np.concatenate([tree.count, np.zeros(len(c), np.int64)])
    return tree


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, asks): vectors of finite components, not all zero, in double precision."""
    v = F.col("embedding").cast("array<double>")
    fine = F.size(v) > 0
    fine = fine & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"), "asks")


class Nearest:
    """The k nearest points of each of some queries, kept as points pass by in blocks: by distance, then by the points' tags.

    A product of matrices bounds the squared distances; those that may still count are computed exactly.
    """

    def __init__(self, q: np.ndarray, k: int, most: int = 1 << 20) -> None:
        self.q, self.k, self.most = q, k, most
        self.qq = (q * q).sum(1)
        self.low = np.full((len(q), k), np.inf)
        self.kept = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def add(self, x: np.ndarray, tags: np.ndarray, at: np.ndarray, who: np.ndarray) -> None:
        """Points x, with tags and places of their own, for the queries numbered who."""
        found = [self.kept]
        for i in range(0, len(x), 4096):
            for j in range(0, len(who), 256):
                found.append(self._block(x[i : i + 4096], tags[i : i + 4096], at[i : i + 4096], who[j : j + 256]))
        self.kept = [np.concatenate(c) for c in zip(*found, strict=True)]
        if len(self.kept[0]) > self.most:
            self._sort()

    def _block(self, x: np.ndarray, tags: np.ndarray, at: np.ndarray, who: np.ndarray) -> list[np.ndarray]:
        xx = (x * x).sum(1)
        with np.errstate(invalid="ignore", over="ignore"):
            d = self.qq[who, None] + xx - 2 * (self.q[who] @ x.T)
            d[np.isnan(d)] = np.inf
            low = np.partition(np.concatenate([self.low[who], d], axis=1), self.k - 1, axis=1)[:, : self.k]
            self.low[who] = low
            # What rounding may hide is far below this share of the terms.
            i, j = np.nonzero(d <= (low.max(1) + 1e-9 * (self.qq[who] + xx.max()))[:, None])
            near = np.concatenate([np.sqrt(((x[j[n : n + 8192]] - self.q[who[i[n : n + 8192]]]) ** 2).sum(1)) for n in range(0, len(i), 8192)] or [np.zeros(0)])
        return [who[i], near, tags[j], at[j]]

    def _sort(self) -> None:
        q, d, tags, at = self.kept
        order = np.lexsort((tags, d, q))
        q, d, tags, at = q[order], d[order], tags[order], at[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        self.kept = [c[nth < self.k] for c in (q, d, tags, at)]
        self.most = max(self.most, 2 * len(self.kept[0]))

    def pairs(self, ids: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, distance, id): the k nearest ids of each query, ties to the smaller; ids: by place, tags being their smallest."""
        self._sort()
        q, d, _, at = self.kept
        n = np.array([len(ids[i]) for i in at], np.int64)
        q, d = np.repeat(q, n), np.repeat(d, n)
        i = np.concatenate([np.asarray(ids[i], np.int64) for i in at] or [np.zeros(0, np.int64)])
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        return q[nth < self.k], d[nth < self.k], i[nth < self.k]


def cells(counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """By leaf its first cell and how many it has: leaves in a row share a cell of at most `most` points; one with more has as many cells of its own as it needs."""
    out, cell, used = {}, 0, 0
    for leaf in sorted(counts):
        n = counts[leaf]
        if used and used + n > most:
            cell, used = cell + 1, 0
        blocks = -(-n // most)
        out[leaf] = cell, max(blocks, 1)
        if blocks > 1:
            cell, used = cell + blocks, 0
        else:
            used += n
    return out


def neighbours(vectors: DataFrame, queries: F.Column, *, k: int = 10, leaf_rows: int = 200, branch: int = 8, rounds: int = 4, sample_rows: int = 50_000, recall: float = 0.95, probes: int = 400, cell_values: int = 1 << 22, part_rows: int = 4096) -> DataFrame:
    """For each vector that `queries` selects its k nearest others: query_id, rank, vec_id, score (Euclidean distance), recall.

    Equal vectors are one point that carries its k + 1 smallest ids, more of which can't be in any answer. A point goes to
    one leaf of the tree, however many points that leaf gets. The tree is fitted on a sample of about sample_rows points,
    by hash.

    How many leaves a query visits, best bin first, is calibrated: `probes` points, by hash, are compared with all
    points, and of their true neighbours' leaves the place in that order is noted. For half of the probes visits widen until
    the share of neighbours within them reaches `recall`; the column `recall` is that share for the other half, null if
    there is none. A query goes on past that number until its leaves hold k others.

    A task owns a run of leaves: as many points as make the runs of the number of shuffle partitions, and no more than
    cell_values numbers. A query goes once to each run that holds leaves it visits, and k + 1 rows come back from there, so
    the rows are in proportion to queries times runs, not leaves. Queries of a run beyond part_rows go to further tasks.

    Vectors null, zero, ragged (not of the most frequent length), or with null or non-finite components take no part, as
    rows without an id. Fewer than k others: all of them. A row is a candidate for every other row, so rows that repeat an
    id are neighbours of each other, and each gets an answer. Ties between equal distances go to smaller ids everywhere,
    in the calibration too. Empty table: empty result. Further columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, recall double"
    rows = usable(vectors.select("vec_id", "embedding", queries.alias("asks")))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["n"]
    rows = cut(rows.filter(F.size("v") == dim))
    # WindowGroupLimit keeps the smallest ids of a vector in each task before it shuffles.
    first = rows.select("vec_id", "v", F.row_number().over(W.partitionBy("v").orderBy("vec_id")).alias("nth")).filter(F.col("nth") <= k + 1)
    points = cut(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids"))
    n = points.count()
    share = min(1.0, sample_rows / max(n, 1))
    sample = points.filter(unit("tree", "rep") < share).select("v", F.xxhash64("rep").alias("k"))
    tree = grow(spark, sample, n, dim, leaf_rows=leaf_rows, branch=branch, rounds=rounds, sample_rows=sample_rows)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(leaf=shared.value.route(matrix(b["v"])))

    indexed = cut(points.mapInPandas(route, "rep long, v array<double>, ids array<long>, leaf long"))
    # An id may stand for several vectors, so each vector gets a number, which the checkpoint keeps.
    asked = cut(rows.filter("asks").groupBy("v").agg(F.min("vec_id").alias("id")).select(F.monotonically_increasing_id().alias("q"), "id", "v"))
    # As many rows as the tree has leaves.
    sizes = indexed.groupBy("leaf").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()
    held_ids = {r["leaf"]: r["ids"] for r in sizes}
    places, measured = probed(indexed, n, tree, k, probes)
    leaves = len(tree.leaves())
    visits = 1
    while visits < leaves and places and np.mean([x < visits for x in places]) < recall:
        visits += 1
    found_share = float(np.mean([x < visits for x in measured])) if measured else None

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = cells({r["leaf"]: r["n"] for r in sizes}, min(-(-n // tasks), max(1024, cell_values // max(dim, 1))))
    plan = spark.sparkContext.broadcast((where, held_ids))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, ids = plan.value
        for b in batches:
            out = []
            for q, v in zip(b["q"], b["v"], strict=True):
                seen, own = 0, {}
                for nth, leaf in enumerate(shared.value.best_first(np.array(v))):
                    if nth >= visits and seen > k:
                        break
                    seen += ids.get(leaf, 0)
                    if leaf in where:
                        cell, blocks = where[leaf]
                        for c in range(cell, cell + blocks):
                            own.setdefault(c, []).append(leaf)
                out += [(q, v, c, own[c]) for c in own]
            yield pd.DataFrame(out, columns=["q", "qv", "cell", "leaves"])

    visiting = cut(asked.select("q", "v").mapInPandas(visit, "q long, qv array<double>, cell int, leaves array<long>"))
    loads = visiting.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(part_rows)).cast("int").alias("parts"))
    grid = put(loads, "ann-grid")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [plan.value[0][leaf] for leaf in b["leaf"]]
            yield b.assign(cell=[c + h % m for (c, m), h in zip(at, b["h"], strict=True)]).drop(columns="h")

    points_in = indexed.withColumn("h", F.pmod(F.xxhash64("rep"), F.lit(1 << 30))).mapInPandas(place, "rep long, v array<double>, ids array<long>, leaf long, cell int")
    points_in = points_in.join(grid, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    queries_in = visiting.join(grid, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["q", "d", "vec_id"]).astype({"q": "int64", "d": float, "vec_id": "int64"})
        x, tags, leaf = matrix(left["v"]), left["rep"].to_numpy(), left["leaf"].to_numpy()
        best, who = Nearest(matrix(right["qv"]), k + 1), {}
        for i, own in enumerate(right["leaves"]):
            for f in own:
                who.setdefault(int(f), []).append(i)
        for f in np.unique(leaf):
            if int(f) in who:
                at = np.flatnonzero(leaf == f)
                best.add(x[at], tags[at], at, np.array(who[int(f)]))
        q, d, ids = best.pairs(left["ids"].tolist())
        return pd.DataFrame({"q": right["q"].to_numpy()[q], "d": d, "vec_id": ids})

    pairs = points_in.select("cell", "part", "rep", "v", "ids", "leaf").groupBy("cell", "part").cogroup(queries_in.select("cell", "part", "q", "qv", "leaves").groupBy("cell", "part")).applyInPandas(search, "q long, d double, vec_id long")
    # k + 1 of them, as one may be the query's own row.
    near = pairs.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy("d", "vec_id"))).filter(F.col("nth") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("d", "vec_id"))).alias("near"))
    each = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "v").join(asked.drop("id"), "v").select("query_id", "q").join(near, "q")
    own = F.array_position(F.transform("near", lambda x: x["vec_id"]), F.col("query_id"))
    others = F.slice(F.filter("near", lambda x, i: i + 1 != own), 1, k)
    out = each.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.d").alias("score"), F.lit(found_share).cast("double").alias("recall"))


def probed(indexed: DataFrame, n: int, tree: Tree, k: int, probes: int) -> tuple[list[int], list[int]]:
    """Of the k true neighbours of some points the places of their leaves in the best-first order: for the half of these points that calibrates, and for the other. About `probes` of the n points by hash, however few queries there are, against all points, in blocks; a task sends k + 1 rows of each."""
    few = indexed.filter(unit("probe", "rep") < F.lit(probes) / F.lit(float(max(n, 1)))).select(F.col("rep").alias("id"), "v").orderBy("id").collect()
    if not few:
        return [], []
    held = indexed.sparkSession.sparkContext.broadcast(np.array([r["v"] for r in few], float))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best, ids, leaf = Nearest(held.value, k + 1), [], []
        for b in batches:
            best.add(matrix(b["v"]), b["rep"].to_numpy(), np.arange(len(ids), len(ids) + len(b)), np.arange(len(held.value)))
            ids += b["ids"].tolist()
            leaf += b["leaf"].tolist()
        best._sort()
        q, d, _, at = best.kept
        yield pd.DataFrame({"q": q, "d": d, "ids": [ids[i] for i in at], "leaf": [leaf[i] for i in at]})

    true = indexed.mapInPandas(exact, "q int, d double, ids array<long>, leaf long").select("q", "d", F.explode("ids").alias("id"), "leaf")
    true = true.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy("d", "id"))).filter(F.col("nth") <= k + 1)
    near: dict[int, list[tuple]] = {}
    for r in true.collect():
        near.setdefault(r["q"], []).append((r["d"], r["id"], r["leaf"]))
    halves: tuple[list[int], list[int]] = [], []
    for i, r in enumerate(few):
        order = {leaf: nth for nth, leaf in enumerate(tree.best_first(np.array(r["v"])))}
        found = sorted(near.get(i, ()))
        own = next((j for j, x in enumerate(found) if x[1] == r["id"]), len(found))
        halves[i % 2].extend(order[leaf] for _, _, leaf in (found[:own] + found[own + 1 :])[:k])
    return halves


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {"op2_nearest_neighbours": op2_nearest_neighbours}
SQL: dict[str, str] = {}
