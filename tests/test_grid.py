"""Grids: cells side by side, and going on after an interruption."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from assayline.plans.grid import finished, run_cells


def test_goes_on_where_it_ended(spark, tmp_path):
    """A cell that fails leaves the others' results; the next run makes only what is missing."""
    ran, broken = [], [True]

    def cell(name):
        def make():
            ran.append(name)
            if name == "c" and broken[0]:
                raise RuntimeError("lost")
            return spark.range(len(name) + 1).select(F.lit(name).alias("name"), "id")

        return make

    cells, folder = {n: cell(n) for n in ("a", "b", "c", "dd")}, f"file://{tmp_path}/grid"
    with pytest.raises(RuntimeError, match="lost"):
        run_cells(spark, cells, folder)
    assert sorted(ran) == ["a", "b", "c", "dd"] and finished(spark, folder) == {"a", "b", "dd"}
    ran.clear()
    broken[0] = False
    out = run_cells(spark, cells, folder)
    assert ran == ["c"]
    assert sorted((r["cell"], r["name"], r["id"]) for r in out.collect()) == sorted((n, n, i) for n in cells for i in range(len(n) + 1))


def test_results_without_manifest_are_made_again(spark, tmp_path):
    """A result whose row in the manifest is missing, as after a kill while writing, isn't taken for whole."""
    folder = f"file://{tmp_path}/grid"
    spark.range(3).write.parquet(f"{folder}/results/cell=x")
    out = run_cells(spark, {"x": lambda: spark.range(5)}, folder)
    assert out.count() == 5 and set(out.columns) == {"id", "cell"}


def test_side_by_side_and_bounded(spark):
    now, most, lock = [0], [0], threading.Lock()

    def make():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.4)
        with lock:
            now[0] -= 1
        return spark.range(1)

    assert run_cells(spark, {f"c{i}": make for i in range(7)}, workers=3).count() == 7
    assert most[0] == 3
