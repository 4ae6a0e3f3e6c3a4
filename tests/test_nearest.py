"""The metric index against comparing all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from assayline.operators import joins, nearest


def frame(spark, rows):
    return spark.createDataFrame([(int(i), None if v is None else [float(z) for z in v]) for i, v in rows], "record_id long, v array<double>")


def brute(left, right, k, apart=True):
    right = [(i, v) for i, v in right if v is not None]
    ids, w, out = np.array([i for i, _ in right]), np.array([v for _, v in right], float), []
    for i, v in left:
        if v is not None:
            d = np.sqrt(((w - np.array(v, float)) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if not (apart and ids[j] == i)][:k]
            out += [(i, int(ids[j]), float(d[j]), n + 1) for n, j in enumerate(order)]
    return sorted(out)


def got(found):
    return sorted((r["record_id"], r["neighbour"], r["dist"], r["nth"]) for r in found.collect())


def clustered(rng, n, dims=8, clusters=24):
    centres = rng.normal(size=(clusters, dims)) * 20
    return [(i, centres[rng.integers(clusters)] + rng.normal(size=dims)) for i in range(n)]


def test_clusters_are_skipped(spark):
    """Exactly the neighbours of all pairs, from under a tenth of them."""
    rows = clustered(np.random.default_rng(0), 3000)
    left = rows[:400]
    found, work = nearest.search(frame(spark, left), frame(spark, rows), 3, nearest.Euclid(), block=64)
    assert got(found) == brute(left, rows, 3)
    assert work.first()["compared"] < 0.1 * len(left) * len(rows)


@pytest.mark.parametrize("case", ["random", "ties", "one value", "few", "far from zero"])
def test_any_rows(spark, case):
    rng = np.random.default_rng(1)
    rows = {
        "random": [(i, rng.normal(size=32)) for i in range(300)],
        "ties": [(i, np.round(rng.normal(size=2))) for i in range(400)],
        "one value": [(i, [1.0, 2.0]) for i in range(200)],
        "few": [(1, [0.0]), (2, [1.0]), (3, None), (4, [3.0])],
        "far from zero": [(i, 1e6 + rng.normal(size=3)) for i in range(300)],
    }[case]
    found, _ = nearest.search(frame(spark, rows), frame(spark, rows), 4, nearest.Euclid(), block=32)
    assert got(found) == brute(rows, rows, 4)


def test_empty_sides(spark):
    rows, none = frame(spark, [(1, [0.0]), (2, [1.0])]), frame(spark, [])
    assert joins.knn(rows, none).collect() == [] and joins.knn(none, rows).collect() == []


def test_groups_of_queries():
    """Every cell has a group of its own or shares one, no group's numbers overlap, and large cells are dealt to several."""
    pivots = np.array([[float(i)] for i in range(6)])
    q = nearest.QUERIES
    rows = nearest.grouped_cells(pivots, {0: 10, 1: 20, 3: 2 * q + 800, 4: 5, 5: q}, nearest.Euclid())
    assert sorted(r[0] for r in rows) == [0, 1, 3, 4, 5]
    assert {r[0]: r[2] for r in rows}[3] == 3
    used = {}
    for cell, first, pieces in rows:
        for g in range(first, first + pieces):
            used.setdefault(g, []).append(cell)
    assert max(len(c) for c in used.values()) == 2 and all(3 not in c or len(c) == 1 for c in used.values())


def test_largest_similarity(spark):
    rng = np.random.default_rng(2)
    sets = [sorted(set(rng.integers(0, 200, rng.integers(0, 40)).tolist())) for _ in range(500)]
    sets += [s[:-1] for s in sets[:50] if len(s) > 1] + [[], [199]]
    rows = list(enumerate(sets))
    train, test = [r for r in rows if r[0] % 4], [r for r in rows if r[0] % 4 == 0]
    df = lambda x: spark.createDataFrame(x, "record_id long, bits array<long>")
    out = {r["record_id"]: r["max_sim"] for r in joins.tanimoto_max(df(train), df(test)).collect()}
    best = lambda a: max((len(set(a) & set(b)) / len(set(a) | set(b)) for _, b in train if a and b), default=0.0)
    assert out == {i: best(s) for i, s in test}
    assert [r["max_sim"] for r in joins.tanimoto_max(df([]), df(test[:3])).collect()] == [0.0] * 3
