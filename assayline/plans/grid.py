"""Cells of a grid, such as model fits, that run side by side and from which an interrupted run goes on."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.plans.shared import scratch

#: Cells that run at a time.
WORKERS = 4


def finished(spark: SparkSession, folder: str) -> set[str]:
    """Names of cells whose results are whole: those in the folder's manifest."""
    try:
        return {r["cell"] for r in spark.read.schema("cell string").parquet(f"{folder}/manifest/*").collect()}
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return set()
        raise


def run_cells(spark: SparkSession, cells: dict[str, Callable[[], DataFrame]], folder: str | None = None, workers: int = WORKERS) -> DataFrame:
    """The results of all cells, which must share a schema, as one table with the column cell.

    A bounded pool of driver threads runs them, each in a scheduler pool of its own, so that small jobs fill the cluster
    together. A cell writes its result below `folder` and then a row of the manifest; a run with the same folder leaves out
    the cells named there. Names are folder names. If a cell fails, the others still end, and its error is raised.
    """
    folder = folder or scratch(spark, "cells")
    done = finished(spark, folder)

    def one(name: str, cell: Callable[[], DataFrame], nth: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"cells-{nth % workers}")
        cell().write.mode("overwrite").parquet(f"{folder}/results/cell={name}")
        spark.createDataFrame([(name,)], "cell string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/{name}")

    errors = []
    with ThreadPoolExecutor(workers) as pool:
        todo = [(n, f, i) for i, (n, f) in enumerate(cells.items()) if n not in done]
        for f in as_completed([pool.submit(inheritable_thread_target(spark)(one), *x) for x in todo]):
            if f.exception():
                errors.append(f.exception())
    if errors:
        raise errors[0]
    out = spark.read.parquet(*[f"{folder}/results/cell={n}" for n in cells]) if len(cells) > 1 else spark.read.parquet(f"{folder}/results/cell={next(iter(cells))}")
    return out.withColumn("cell", F.regexp_extract(F.col("_metadata.file_path"), "/cell=([^/]+)/", 1))
