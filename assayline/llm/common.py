"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that setting is unset and all runs on one machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.sparkContext.getCheckpointDir()
        if path is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            path = "file://" + tempfile.mkdtemp(prefix="assayline-")
            spark.sparkContext.setCheckpointDir(path)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def put(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, an executor may be lost, and its size is known to the planner, which so broadcasts it only below spark.sql.autoBroadcastJoinThreshold."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small_batches(spark: SparkSession) -> None:
    """Long texts: a bound in bytes on an Arrow batch, so that a Python worker holds a few MB of them. It holds from here on, as plans run later than they are built; it changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))


def unit(seed: str, *cols) -> F.Column:
    """A number in (0, 1) from md5, the same in Spark and in DuckDB: 52 bits and a half."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): rows (node, root), root the smallest node reached.

    Alternating large-star and small-star steps: each is a grouped minimum and a join, the number of rows never grows, and
    a star is reached after about log(n) rounds. Nodes without links are not returned. Links may repeat and may be loops.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        e = cut(small)
        mark = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark


_A = np.uint64(0x9E3779B97F4A7C15)
_LUT = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _LUT.copy()
_LOWER[65:91] = _LUT[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


#: Bytes hashed at a time: what is held for each byte meanwhile is about 35 bytes.
BLOCK = 1 << 16


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z lower-cased, and for each text where its words end in that array.

    In blocks of the joined UTF-8 bytes that end between words: a running sum of b**i * value(byte i), whose differences at
    the bounds of words, shifted back by b**-start, are the words' hashes.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts])
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    start, stop = edge[0::2], edge[1::2]
    h, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(stop, start[i] + BLOCK, "right")))
        lo, hi = int(start[i]), int(stop[j - 1])
        power, back = _powers(hi - lo + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LOWER[data[lo:hi]] * power[: hi - lo], dtype=np.uint64, out=total[1:])
        at, to = start[i:j] - lo, stop[i:j] - lo
        h[i:j] = mix64((total[to] - total[at]) * back[at] + (to - at).astype(np.uint64) * _A)
        i = j
    return h, np.searchsorted(start, ends, "left")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept for blocks; those for a longer word are not."""
    return _block_powers() if n <= BLOCK + 1 else _make_powers(n)


def _make_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    inv = pow(base, -1, 1 << 64)
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]), dtype=np.uint64) for b in (base, inv))


@lru_cache(maxsize=1)
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return _make_powers(BLOCK + 1)


def shingle_sets(texts: list[str | None], width: int, key=lambda x: x) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes, through `key`, of its `width`-word shingles; with fewer words one, of the whole sequence; without words none."""
    h, ends = word_hashes(texts)
    rolled = np.zeros(max(len(h) - width + 1, 0), np.uint64)
    for i in range(width):
        rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + h[i : i + len(rolled)]
    rolled = key(mix64(rolled + np.uint64(width)))
    lo = 0
    for hi in ends:
        n = int(hi) - lo
        if n >= width:
            yield np.unique(rolled[lo : hi - width + 1])
        elif n:
            x = np.uint64(n)
            for w in h[lo:hi]:
                x = np.uint64((int(x) * 0xD6E8FEB86659FD93 + int(w)) % (1 << 64))
            yield key(mix64(np.array([x], np.uint64)))
        else:
            yield np.zeros(0, np.uint64)
        lo = int(hi)


def slices(texts: list, most: int = 200_000) -> Iterator[slice]:
    """Runs of texts of about `most` characters at most (one text may be longer)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > at and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))
