"""Packing token sequences: Martello-Toth dominance reduction, then best fit, both on the histogram of lengths."""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayline.llm.common import put, small_batches, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 0
CAPACITY = 2048
# The steps before the model in the file of this tokenizer; they drop case and white space.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_UNITS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _UNITS}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Letters of one code point in both cases; and what is neither these, digits, blanks, line ends nor stops.
_LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARKED = re.compile(f"([{_LETTER}]+)([!-&(-/:-@\\[-`{{-~]+)")  # a word and marks after it, but for apostrophes
_PLAIN, _OTHER = re.compile(f"[{_LETTER}]+"), re.compile(f"[^{_LETTER}0-9 \n.,]")


class ChunkTokenizer(dict):
    """Token ids of texts as bytes (little-endian uint32), from the ids of their space-separated chunks.

    That holds for tokenizers whose file has the steps stated above; with any other file whole texts are encoded.

    This vocabulary's tokenizer drops white space and never joins across it, so a text's ids are those of its chunks in a
    row. Chunks repeat, so each is tokenized once and kept, up to about `keep` bytes of them in two generations: once the
    newer one takes half of that, it becomes the older one, and what was the older one goes; a chunk found there moves to
    the newer one, so that frequent chunks stay. A chunk of more than a hundredth of `keep` is not kept.
    """

    def __init__(self, path: str, keep: int = 48_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.keep, self.held, self.older, self.tokenizer = keep, 0, {}, Tokenizer.from_file(path)
        self.model = self.tokenizer.model.tokenize
        spec = json.loads(self.tokenizer.to_str())
        self.plain = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        spell = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.bytes_of = str.maketrans({chr(i): spell(chr(i))[0][0] for i in range(0xC0, 0x100)})

    def __missing__(self, chunk: str) -> bytes:
        """A plain word is one unit for the model, in lower case, so it goes there directly."""
        if (ids := self.older.get(chunk)) is not None:
            pass
        elif _PLAIN.fullmatch(chunk):
            word = chunk.lower()
            ids = self._ids([t.id for t in self.model(word if word.isascii() else word.translate(self.bytes_of))])
        elif m := _MARKED.fullmatch(chunk):
            ids = self[m[1]] + self[m[2]]
        else:
            ids = self._ids(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        size = len(chunk) + len(ids)
        if size * 100 <= self.keep:
            # An entry's objects and its place in the table take about 200 bytes.
            self.held += size + 200
            if 2 * self.held > self.keep:
                self.older, self.held = dict(self), size + 200
                self.clear()
            self[chunk] = ids
        return ids

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.plain:
            return self._ids(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not (_OTHER.search(text) or ".." in text or ",," in text or ".," in text or ",." in text):
            # Case is dropped and a single stop is a unit of its own, so plain prose can be cut into fewer different chunks.
            text = text.lower().replace(".", " .").replace(",", " ,")
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(maxsize=1)
def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """One for all tasks of a worker process, so that later tasks find the chunks of earlier ones."""
    return ChunkTokenizer(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut every `capacity` ids.

    Null text counts as empty and gives one piece, the end id alone. Long texts are read whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, step, end = chunk_tokenizer(tokenizer_path), 4 * capacity, np.array([END_ID], "<u4").tobytes()
        for b in batches:
            out = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                ids = (tok.encode(text) if isinstance(text, str) else b"") + end
                out += [(key, i // step, i // 4, min(step, len(ids) - i) // 4, zlib.crc32(ids[i : i + step])) for i in range(0, len(ids), step)]
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield frame.astype({"doc_id": "Int64", "piece": "int32"})

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = tuple[tuple[int, int], ...]


def _dominant(counts: dict[int, int], sizes: list[int], j: int, cap: int) -> Pattern | None:
    """Items that may go with one of size j for good, as every other filling of its bin is dominated; None if none is proven.

    A filling is dominated if it can be cut into parts that each fit in the place of another item of the chosen one.
    """
    have = lambda s: counts[s] - (s == j)
    room = cap - j
    fit = [s for s in sizes[: bisect_right(sizes, room)] if have(s) > 0]
    if not fit:
        return ((j, 1),)
    top, low = fit[-1], [s for s in fit[:3] for _ in range(min(3, have(s)))][:3]
    pair = ((j, 1), (top, 1)) if j != top else ((j, 2),)
    if top == room or len(low) < 2 or low[0] + low[1] > room:
        return pair  # every filling's sum, or its one item, is at most `top`
    if len(low) == 3 and sum(low) <= room:
        return None  # three more items could fit: not decided here
    best = high_low = 0  # largest sum of two, largest smaller item of two
    hi = len(fit) - 1
    for lo, s in enumerate(fit):
        while hi >= lo and s + fit[hi] > room:
            hi -= 1
        if hi < lo or (hi == lo and have(s) < 2):
            break
        best, high_low = max(best, s + fit[hi]), s
    if best <= top:
        return pair
    mate = next((s for s in reversed(fit[: bisect_right(fit, room - top)]) if s != top or have(s) > 1), 0)
    if mate and mate >= high_low:
        run: dict[int, int] = {}
        for s in (j, top, mate):
            run[s] = run.get(s, 0) + 1
        return tuple(run.items())
    return None


def reduce_dominated(counts: dict[int, int], cap: int) -> list[tuple[Pattern, int]]:
    """Martello-Toth: fix dominating fillings, largest items first, taking them out of counts; equal items go in bulk."""
    fixed, sizes = [], sorted(s for s, n in counts.items() if n)
    for j in sorted(counts, reverse=True):
        while counts[j] > 0 and (p := _dominant(counts, sizes, j, cap)):
            times = min(counts[s] // n for s, n in p)
            fixed.append((p, times))
            for s, n in p:
                counts[s] -= n * times
                if not counts[s]:
                    sizes.remove(s)
    return fixed


def best_fit(counts: dict[int, int], cap: int) -> list[tuple[Pattern, int]]:
    """Best fit in decreasing order over counts of equal items: bins with equal room and content move together."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def add(room: int, p: Pattern, n: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((p, n))

    for s in sorted((s for s, n in counts.items() if n), reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(rooms, s)
            room = rooms[at] if at < len(rooms) else cap
            p, n = bins[room].pop() if at < len(rooms) else ((), left)
            if at < len(rooms) and not bins[room]:
                del bins[room], rooms[at]
            each = min(room // s, left)
            full = min(n, left // each)
            if n > full and p:
                add(room, p, n - full)
            add(room - each * s, (*p, (s, each)), full)
            left -= full * each
    return [x for group in bins.values() for x in group]


def slots(plan: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """Where the k-th item of a size goes: rows (size, first, bins, sequence, offset) for runs of equal places."""
    rows, used, base = [], {}, 0
    for p, times in plan:
        at = 0
        for s, n in p:
            rows.append((s, used.get(s, 0), times, base, at))
            used[s] = used.get(s, 0) + n * times
            at += s * n
        base += times
    return pd.DataFrame(rows, columns=["size", "first", "bins", "sequence", "offset"], dtype="int64").sort_values(["size", "first"])


def pack(parts: DataFrame, capacity: int = CAPACITY, *, bucket_rows: int = 2_000) -> DataFrame:
    """Add sequence_id and offset to parts (doc_id, piece, length, ...): sequences of at most `capacity`, without gaps.

    The plan needs only how often each length occurs, at most `capacity` numbers whatever the input, and is worked out on
    the driver. It is a list of fillings with multiplicities, whose size depends on `capacity` alone. A piece finds its
    place by its number among the pieces of its length: windows over hashed buckets of a length, so that a frequent length
    is spread, plus the counts of the buckets before.

    parts are read twice: pass a written table. Lengths must be 1 to capacity. Empty table: empty result. Repeated rows
    get places of their own.
    """
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}
    buckets = 1 + max(counts.values(), default=0) // bucket_rows
    plan = reduce_dominated(counts, capacity)
    where = slots(plan + best_fit(counts, capacity))
    shared = parts.sparkSession.sparkContext.broadcast({c: where[c].to_numpy() for c in where})

    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    rows = parts.withColumn("bucket", bucket)
    sums = rows.groupBy("length", "bucket").count()
    sums = sums.withColumn("ahead", F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count")).drop("count")
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    rows = rows.join(sums, ["length", "bucket"]).withColumn("nth", F.col("nth") + F.col("ahead")).drop("bucket", "ahead")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = shared.value
        wide = 1 << 44
        keys = s["size"] * wide + s["first"]
        for b in batches:
            at = np.searchsorted(keys, b["length"].to_numpy() * wide + b["nth"].to_numpy(), "right") - 1
            k = b["nth"].to_numpy() - s["first"][at]
            yield b.drop(columns="nth").assign(sequence_id=s["sequence"][at] + k % s["bins"][at], offset=s["offset"][at] + k // s["bins"][at] * s["size"][at])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("nth").schema)
    return rows.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize and pack whole documents; the pieces are kept in the shared folder, so each text is tokenized once.

    Null and empty text: one piece, the end id alone. Null doc_id and repeated rows are packed like others, each for itself.
    Longer texts are cut, however long. Empty table: empty result. Columns but doc_id and text, whatever their names, don't
    come along.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    packed = pack(put(pieces(docs, str(tokenizer_path), capacity), "pieces"), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op3_best_fit_packing": op3_best_fit_packing}
SQL: dict[str, str] = {}
