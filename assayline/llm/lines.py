"""Line deduplication by pairwise alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import WORD, put, small_batches, table


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of equal elements, rising in both: elements unique in both are matched along their longest rising run, and the parts between in the same way, with equal ends taken as they are."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        seen_a, seen_b = _once(a, i, j), _once(b, k, m)
        common = sorted((x, seen_b[v]) for v, x in seen_a.items() if v in seen_b and x >= 0 and seen_b[v] >= 0)
        chain = _rising(common)
        for x, y in chain:
            todo.append((i, x, k, y))
            out.append((x, y))
            i, k = x + 1, y + 1
        if chain:
            todo.append((i, j, k, m))
    return sorted(out)


def _once(x: list, lo: int, hi: int) -> dict:
    """Place of each element that occurs once in x[lo:hi]; -1 for others."""
    place: dict = {}
    for i in range(lo, hi):
        place[x[i]] = -1 if x[i] in place else i
    return place


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back.append(at[k - 1] if k else -1)
        tops[k : k + 1], at[k : k + 1] = [y], [n]
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def common_blocks(own: list[tuple[int, bytes, int]], other: list[tuple[int, bytes]], least: int) -> list[int]:
    """Line numbers of own (number, hash, words) in aligned blocks of at least `least` words; a block's lines follow one another in both."""
    pairs = patience([h for _, h, _ in own], [h for _, h in other])
    out: list[int] = []
    block: list[int] = []
    words, last = 0, None
    for x, y in [*pairs, (None, None)]:
        here = None if x is None else (own[x][0], other[y][0])
        if last is None or here is None or here[0] != last[0] + 1 or here[1] != last[1] + 1:
            if words >= least:
                out += block
            block, words = [], 0
        if here is not None:
            block.append(here[0])
            words += own[x][2]
        last = here
    return out


def line_runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """(first, past) of the shortest runs of lines with at least `least` words, from each line on and up to each line. They cover any longer run with so many words."""

    def up_to(words: list[int]) -> Iterator[tuple[int, int]]:
        lo, total = 0, 0
        for hi, w in enumerate(words):
            total += w
            while lo < hi and total - words[lo] >= least:
                total -= words[lo]
                lo += 1
            if total >= least:
                yield lo, hi + 1

    n = len(words)
    return sorted({*up_to(words), *((n - b, n - a) for a, b in up_to(words[::-1]))})


def deletions(docs: DataFrame, *, line_words: int = 3, block_words: int = 10) -> DataFrame:
    """(doc_id, version, gone, aligned): numbers of the lines to delete from each document, and those of them that lie in aligned blocks; version is a hash of its text.

    Lines of at least line_words words are compared, trimmed; other lines neither count nor break a block. A document is a
    doc_id and a text, so an id that stands for two texts is two documents; they are in order of doc_id, then version. Each
    shortest run of compared lines with at least block_words words has a first holder, a grouped minimum that is exact for
    any number of holders. Every later document is aligned with the first holder of each of its runs, so n holders give
    n - 1 pairs, not n * n, and aligned blocks of at least block_words words go from the later document. What no alignment
    in order can hold, blocks that moved or repeat, goes by the runs themselves: lines that are gone but not aligned. Long
    texts take time in proportion to their lines, but for lines that repeat within a text.
    """
    small_batches(docs.sparkSession)
    line = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("pos"), F.regexp_count(x, F.lit(WORD)).alias("words"), F.unhex(F.md5(F.trim(x))).alias("h")))
    name = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"))
    texts = docs.filter("doc_id is not null and text is not null").select(name.alias("doc"), F.filter(line, lambda x: x["words"] >= line_words).alias("lines"))
    texts = put(texts.filter(F.size("lines") > 0), "lines-texts")
    kind = "struct<doc_id: long, version: long>"

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, pos, words, h in zip(b["doc"], b["pos"], b["words"], b["h"], strict=True):
                for lo, hi in line_runs(words.tolist(), block_words):
                    out.append((key, bytes(h[lo]) if hi == lo + 1 else md5(b"".join(h[lo:hi])).digest(), pos[lo:hi]))
            yield pd.DataFrame(out, columns=["doc", "run", "at"])

    runs = put(texts.select("doc", "lines.pos", "lines.words", "lines.h").mapInPandas(find, f"doc {kind}, run binary, at array<int>"), "lines-runs")
    shared = runs.groupBy("run").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").drop("last")
    held = put(runs.join(shared, "run").filter("first < doc").drop("run"), "lines-shared")
    pairs = put(held.select("doc", "first").distinct(), "lines-pairs")
    ids = pairs.select("doc").union(pairs.select("first")).distinct()
    # Repeated rows of a document are one; no bound is known for these tables, so they aren't to be broadcast at any size.
    texts = put(texts.join(ids.hint("merge"), "doc", "left_semi").groupBy("doc").agg(F.first("lines").alias("lines")), "lines-aligned")
    pairs = pairs.hint("merge").join(texts.select(F.col("doc").alias("first"), F.col("lines.h").alias("other")), "first")
    pairs = pairs.hint("merge").join(texts.select("doc", "lines.pos", "lines.words", "lines.h"), "doc")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, pos, words, own, other in zip(b["doc"], b["pos"], b["words"], b["h"], b["other"], strict=True):
                mine = [(i, bytes(h), w) for i, (h, w) in enumerate(zip(own, words, strict=True))]
                gone = common_blocks(mine, [(i, bytes(h)) for i, h in enumerate(other)], block_words)
                if gone:
                    out.append((key, [pos[i] for i in gone]))
            yield pd.DataFrame(out, columns=["doc", "at"])

    aligned = pairs.select("doc", "pos", "words", "h", "other").mapInPandas(align, f"doc {kind}, at array<int>")
    gone = aligned.withColumn("how", F.lit(True)).union(held.select("doc", "at", F.lit(False))).select("doc", "how", F.explode("at").alias("pos"))
    sets = [F.array_sort(F.collect_set(x)).alias(n) for n, x in (("gone", F.col("pos")), ("aligned", F.when(F.col("how"), F.col("pos"))))]
    return gone.groupBy("doc").agg(*sets).select("doc.doc_id", "doc.version", "gone", "aligned")


def dedup_lines(docs: DataFrame, *, with_aligned: bool = False, **how) -> DataFrame:
    """docs, with text without its deleted lines, and n_lines, n_deleted, deleted_lines (numbers from 0, comma-joined); with_aligned adds n_aligned, how many of them lie in aligned blocks (the others moved or repeat).

    A document whose lines all go keeps an empty text. Null text: stays null, 0 lines. Null doc_id: left as it is. Rows
    that repeat a doc_id with an equal text are one document, and all its rows are changed alike; those of one doc_id with
    other texts are documents of their own. Empty table: empty result. Columns named like the new ones are replaced;
    all others stay, whatever their names.
    """
    gone = put(deletions(docs, **how).select(F.struct("doc_id", "version").alias("doc"), "gone", F.size("aligned").alias("aligned")), "lines-gone")
    docs = docs.drop("n_lines", "n_deleted", "deleted_lines", *(["n_aligned"] if with_aligned else []))
    # No bound is known for this table, so it isn't to be broadcast at any size.
    rows = docs.select(F.struct(*docs.columns).alias("own"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version")).alias("doc")).join(gone.hint("merge"), "doc", "left")
    lines = F.split("own.text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))  # by a set, so in time in proportion to the lines
    left = F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n")
    rows = rows.withColumn("_lines", F.when(F.col("gone").isNotNull(), lines))
    text = F.when(F.col("gone").isNull(), F.col("own.text")).otherwise(left)
    new = {"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_deleted": F.coalesce(F.size("gone"), F.lit(0)), "deleted_lines": F.coalesce(F.array_join("gone", ","), F.lit(""))}
    new |= {"n_aligned": F.coalesce("aligned", F.lit(0))} if with_aligned else {}
    return rows.select(*[text.alias(c) if c == "text" else F.col("own")[c].alias(c) for c in docs.columns], *[x.alias(c) for c, x in new.items()])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), with_aligned=True)


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL: dict[str, str] = {}
