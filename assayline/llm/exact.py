"""Exact deduplication as a stateful stream."""

from __future__ import annotations

import contextlib
import posixpath
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import put, scratch

STORE = "spark.sql.streaming.stateStore"
#: State on disk, with bounded memory for all stores of an executor, and no disk set aside ahead of need (4 MB a store).
#: Stores of a run that has ended are closed within seconds, not a minute.
STREAM = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.allowFAllocate": "false",
    f"{STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{STORE}.rocksdb.maxMemoryUsageMB": "128",
    f"{STORE}.rocksdb.writeBufferSizeMB": "4",
    f"{STORE}.maintenanceInterval": "3s",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def keyed_state(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, *, checkpoint: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Run the stream over what is new below `path` and return the state: digest, keep (doc_id, file, row), n.

    The state is kept on disk (RocksDB), keyed by digest, and never expires: of each text it holds the digest, the largest
    doc_id so far and that row's place (file and row in it), and how many rows had it. With the same `checkpoint` a later
    run goes on where the last one ended. Rows are combined before they are shuffled, so a text with very many copies
    sends one row from each task.
    """
    checkpoint = checkpoint or scratch(spark, "dedup-stream")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # As a pattern, since the source takes one file only so.
    rows = reader.parquet(f"{path[:-1]}[{path[-1]}]").select(*located(), digest(F.coalesce("text", F.lit(""))).alias("digest"))
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    out = f"{checkpoint}/updates"

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    before = {k: spark.conf.get(k, None) for k in STREAM}
    for k, v in STREAM.items():
        spark.conf.set(k, v)
    try:
        run = state.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
        run.awaitTermination()
        batches = 1 + max((p.batchId for p in run.recentProgress), default=-1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    if not batches:
        return spark.createDataFrame([], state.schema)
    updates = spark.read.schema(f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in state.schema)}, batch long").parquet(out)
    if batches == 1:
        return updates.drop("batch")
    return updates.groupBy("digest").agg(F.max_by(F.struct("keep", "n"), "batch").alias("x")).select("digest", "x.keep", "x.n")


def located() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]


def dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256, **stream) -> DataFrame:
    """One row per row of the Parquet table at `path`: doc_id, keep_id, group_size, kept, text_sha256, file, row.

    Equal digests are hits, and on hits the full bytes are compared with those of the kept row, fetched by its place. Rows
    that differ (a collision) form groups of their own, by their whole text. Texts of other rows are not shuffled: the
    digests with hits are put down as a table of 8-byte keys, which the planner broadcasts if it is small enough, or joins
    otherwise.

    Null text counts as empty. Of rows with equal text and doc_id, the last by file and row stays. A null doc_id is below
    all others. Empty table: empty result. Further columns are ignored.
    """
    state = keyed_state(spark, path, digest, **stream)
    text = F.coalesce("text", F.lit(""))
    rows = spark.read.parquet(path).select(*located(), text.alias("text"), digest(text).alias("digest"))
    hits = state.filter("n > 1")
    keys = put(hits.select(F.xxhash64("digest").alias("key")), "dedup-keys")
    found = rows.withColumn("key", F.xxhash64("digest")).join(keys, "key", "left_semi").drop("key")
    found = put(found.join(hits.select("digest", "keep"), "digest"), "dedup-hits")
    of_kept = (F.col("file") == F.col("keep.file")) & (F.col("row") == F.col("keep.row"))
    kept = found.filter(of_kept).select("digest", F.col("text").alias("kept_text"))
    other = put(found.filter(~of_kept).join(kept, "digest").filter("text <> kept_text").drop("kept_text", "keep"), "dedup-collisions")

    named = F.lower(F.hex("digest")) if digest is sha256 else F.sha2("text", 256)
    rows = rows.select("doc_id", "file", "row", "digest", named.alias("text_sha256")).join(state, "digest")
    if not other.isEmpty():
        own = other.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("own_keep"), F.count("*").alias("own_n"))
        own = other.join(own, ["digest", "text"]).select("file", "row", "own_keep", "own_n")
        fewer = other.groupBy("digest").agg(F.count("*").alias("fewer"))
        rows = rows.join(own, ["file", "row"], "left").join(fewer, "digest", "left")
        n = F.coalesce("own_n", F.col("n") - F.coalesce("fewer", F.lit(0)))
        rows = rows.withColumns({"keep": F.coalesce("own_keep", "keep"), "n": n})
    return rows.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), of_kept.alias("kept"), "text_sha256", "file", "row")


def home(docs: DataFrame) -> str | None:
    """The one folder whose files docs reads, if docs is a plain scan of it: all its files, all rows and all columns as they are."""
    files = docs.inputFiles()
    folders = {posixpath.dirname(f) for f in files}
    if len(folders) != 1:
        return None
    path = folders.pop()
    # A local folder read without its scheme counts as another table than the same folder with it.
    for at in dict.fromkeys((path, path.removeprefix("file://"))):
        with contextlib.suppress(AnalysisException):  # no such folder in the default file system
            whole = docs.sparkSession.read.parquet(at)
            if docs.sameSemantics(whole) and set(files) == set(whole.inputFiles()):
                return at
    return None


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the rows that `dedup` drops. Anything but a Parquet folder as read is written down first, so rows are compared with rows of docs alone.

    Null text counts as empty, and of empty texts one row stays. A null doc_id is the smallest; among rows alike in doc_id
    and text one stays. Texts of any length are compared whole. Empty table: empty result. All columns stay as they are,
    whatever their names.
    """
    path = home(docs)
    if path is None:
        docs = put(docs, "dedup-docs")
        path = home(docs)
        if path is None:  # no rows
            return docs
    gone = put(dedup(spark, path).filter(~F.col("kept")).select(F.struct("file", "row").alias("place")), "dedup-dropped")
    rows = docs.select(F.struct(*docs.columns).alias("own"), F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))
    return rows.join(gone, "place", "left_anti").select("own.*")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark, f"{sf_dir}/documents.parquet").drop("file", "row")


OP5_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
  row_number() over (partition by coalesce(text, '') order by doc_id desc nulls last) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))
"""

QUERIES = {"op5_exact_dedup": op5_exact_dedup}
SQL = {"op5_exact_dedup": OP5_SQL}
