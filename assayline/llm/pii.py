"""Personal data: fixed patterns, and candidates of further formats that gradient-boosted trees select by their shape and context."""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import put, small_batches, table

# The base kinds in their order; what the trees add comes after them.
KINDS = ("email", "ip", "card", "phone", "like_email", "like_ip", "like_number")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits starts a match only at its first digit: if that fails, so do all later starts in the run.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# High-recall generators: (family, what a text must hold, pattern); 0 like an email, 1 like an address of a machine, 2 like a number of a person. Proposals of one family may overlap.
_MARK = r"\s?[\[({<]\s?%s\s?[\])}>]\s?"
_HEX = "[0-9A-Fa-f]"
GENERATORS = [(family, re.compile(need, re.IGNORECASE), re.compile(pattern, re.IGNORECASE)) for family, need, pattern in (
    (0, "@", r"(?<![^\s@<(\[\"',;:])[^\s@<>()\[\]\"',;:]+@[^\s@<>()\[\]\"',;:]+"),
    (0, "@", r"(?<![^\s@])[^\s@]+@[^\s@]+"),
    (0, _MARK % "at", r"(?<![\w.+-])[\w.+-]+" + _MARK % "at" + r"[\w-]+(?:(?:" + _MARK % "dot" + r"|\.)\w+)+"),
    (0, r"\sat\s+[\w-]+\s+dot\s", r"(?<![\w.+-])[\w.+-]+\s+at\s+[\w-]+(?:\s+dot\s+\w+)+"),
    (1, r"[0-9]\.[0-9]", r"(?<![0-9.])[0-9]+(?:\.[0-9]+){3}(?![0-9])"),
    (1, r"[0-9]\s?[\[(]\s?(?:\.|dot)", r"(?<![0-9.])[0-9]+(?:\s?[\[(]\s?(?:\.|dot)\s?[\])]\s?[0-9]+){3}(?![0-9])"),
    (1, _HEX + ":+" + _HEX, rf"(?<![0-9A-Za-z:])(?:{_HEX}{{1,4}}:+){{2,7}}{_HEX}{{1,4}}(?![0-9A-Za-z:])"),
    (2, "[0-9]", r"(?<![0-9A-Za-z.])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}(?![0-9A-Za-z])"),
    (2, "[0-9]", r"(?<![0-9A-Za-z.\-])[+(]?[0-9](?:[().\-/]{0,2}[0-9]){6,}(?![0-9A-Za-z])"),
    (2, "[A-Z]{2}[0-9]{2}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
)]
_CONTEXT = [re.compile(x, re.IGNORECASE) for x in ("mail|contact|write to|reach", "tel|phone|call|mobile|fax|whatsapp|dial|ring", "card|visa|iban|account|pay|credit", r"\bip\b|server|host|address|login|client|peer", "ssn|passport|social|birth|licen[cs]e")]
_OTHER = re.compile(r"order|invoice|isbn|version|release|\bv\.?\s*$|page|total|price|year|chapter|section|figure|ticket|tracking|parcel|serial|build|\bpart\b|item|sku", re.IGNORECASE)
#: 40 characters before a candidate and 20 after it are its context.
BEFORE, AFTER = 40, 20

# The steps of each feature of `describe`, in its order. The trees ask whether a value reaches a step, so like candidates are counted together and no sample is needed to find where to cut.
_COUNT = (*range(1, 25), 28, 32, 40, 48, 64, 96, 128, 256, 1024)
_SHARE = tuple(i / 20 for i in range(1, 21))
STEPS = ((1, 2), _COUNT, _COUNT, _SHARE, *[_COUNT] * 3, _COUNT[:10], *[_COUNT] * 5, *[(1,)] * 11)
#: Rows of counted candidates in a task of a fit; a row is about 400 numbers there.
FIT_ROWS = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), kind an index into KINDS, in that order and then by start."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


def describe(text: str, family: int, start: int, end: int) -> list[float]:
    """Format and context of a candidate. What the base rules go by (plus sign, at sign, check digit, ranges) and the words that make a negative are not among the features."""
    word, before, after = text[start:end].lstrip("+"), text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    word = re.sub(r"@|[\[({<]\s?at\s?[\])}>]|\sat\s", "@", re.sub(r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s+dot\s+", ".", word, flags=re.IGNORECASE), flags=re.IGNORECASE)
    groups = re.findall(r"[^\W_]+", word) or [""]
    digits, letters = sum(map(str.isdigit, word)), sum(map(str.isalpha, word))
    return [
        float(family), len(word), digits, letters / max(len(word), 1), len(groups), max(map(len, groups)), min(map(len, groups)), len({c for c in word if c.isdigit()}),
        word.count("."), word.count("-"), word.count(" "), word.count("("), word.count(":"), word[:1].isalnum(), word[-1:].isalnum(),
        before[-1:].isspace() or not before, not after[:1].isalnum(), *[bool(c.search(before)) for c in _CONTEXT], *[bool(c.search(after)) for c in _CONTEXT[:2]],
    ]


def judged(word: str, family: int) -> bool:
    """Whether the base rules have a say on a string of this format: what they don't take then isn't one."""
    if family == 0:
        return "@" in word
    if family == 1:
        return ":" not in word and "[" not in word and "(" not in word
    return word.startswith("+") or (16 <= sum(map(str.isdigit, word)) <= 19 and not set(word) - set("0123456789 -"))


def touching(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether any of some sorted spans, none of which overlap, overlaps this one."""
    i = bisect_left(spans, (end,))
    return i > 0 and spans[i - 1][1] > start


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple]:
    """(family, start, end, label, features) of each proposal; proposals may overlap.

    Label 1: overlaps a base span of its family. 0: the base rules judge its format and don't take it, or a word of
    another kind of number (order, version, page) stands before it and no personal one. -1: unknown; only these can be
    added. Proposals that only overlap a base span of another family are left out.
    """
    out, seen = [], set()
    kinds = [[(s, e) for k, s, e in base if k == kind] for kind in range(4)]
    for family, need, pattern in GENERATORS:
        if not need.search(text):
            continue
        own = kinds[2:] if family == 2 else [kinds[family]]
        for m in pattern.finditer(text):
            start, end = m.span()
            if (family, start, end) in seen:
                continue
            seen.add((family, start, end))
            before = text[max(0, start - BEFORE) : start]
            if any(touching(x, start, end) for x in own):
                label = 1
            elif any(touching(x, start, end) for x in kinds):
                continue
            else:
                label = 0 if judged(m.group(), family) or (_OTHER.search(before) and not any(c.search(before) for c in _CONTEXT)) else -1
            out.append((family, start, end, label, [float(x) for x in describe(text, family, start, end)]))
    return out


def steps_reached(features: list[float]) -> list[int]:
    """How many steps of each feature its value reaches."""
    return [bisect_right(s, x) for s, x in zip(STEPS, features, strict=True)]


def marks_of(steps: str) -> F.Column:
    """The features of the trees: for each step of each feature 1 if it is reached, else 0, declared as of two values, which Spark's trees cut without drawing rows."""
    reached = F.zip_with(steps, F.array(*[F.lit(len(s)) for s in STEPS]), lambda n, m: F.transform(F.sequence(F.lit(1), m), lambda i: (i <= n).cast("double")))
    size = sum(map(len, STEPS))
    return array_to_vector(F.flatten(reached)).alias("features", metadata={"ml_attr": {"attrs": {"binary": [{"idx": i} for i in range(size)]}, "num_attrs": size}})


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def extract(docs: DataFrame) -> DataFrame:
    """One row per document with a number of its own (uid), its base spans and its candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid = TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for key, text in zip(b["doc_id"], b["text"], strict=True):
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                # What a candidate is judged by puts it into a fold, so copies share theirs.
                out.append((uid, key, base, [(f, s, e, label, zlib.crc32(text[max(0, s - BEFORE) : e + AFTER].encode("utf-8", "replace")) & 1, steps_reached(x)) for f, s, e, label, x in candidates(text, base)]))
                uid += 1
            frame = pd.DataFrame(out, columns=["uid", "doc_id", "base", "cands"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"), base=[[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in frame["base"]], cands=[[dict(zip(("family", "start", "end", "label", "fold", "steps"), c, strict=True)) for c in x] for x in frame["cands"]])

    span = "array<struct<kind: int, start: int, end: int>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, f"uid long, doc_id long, base {span}, cands array<struct<family: int, start: int, end: int, label: int, fold: int, steps: array<tinyint>>>")


def select_more(rows: DataFrame, *, precision: float = 0.99) -> DataFrame | None:
    """(uid, more): candidates of unknown label that the trees select; None if there is nothing to learn from.

    Trees are boosted on all labelled candidates, equal ones counted as one with a weight. For the bounds, trees of either
    half score the other half, so each labelled candidate has a score, to four digits, of trees that didn't see it. From
    these comes, per family, the lowest score from which on `precision` of the labelled candidates are positives, halfway
    to the next lower one and 0.5 at the least; a family of few such positives (under 5) takes
    the bound of all families together, one of none gets no additions. If one half has labels of one kind only, the other
    goes unscored. What is added has a format that the base rules don't know, and looks by shape and context like what they
    do.
    """
    each = rows.select("uid", F.explode("cands").alias("c")).select("uid", "c.*")
    known = put(each.filter("label >= 0").groupBy("family", "fold", "steps", F.col("label").cast("double").alias("label")).agg(F.count("*").cast("double").alias("n")), "pii-known")
    parts = known.groupBy("fold", "label").count().collect()
    kinds = {k: {r["label"] for r in parts if r["fold"] == k} for k in (0, 1)}
    if not any(len(x) == 2 for x in kinds.values()):
        return None
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-sum(r["count"] for r in parts) // FIT_ROWS))
    known = known.repartition(tasks).select("family", "fold", "label", "n", marks_of("steps"))
    trees, score = GBTClassifier(weightCol="n", maxIter=12, maxDepth=3, seed=1), F.round(vector_to_array(F.col("probability"))[1], 4).alias("p")
    scored = [trees.fit(known.filter(F.col("fold") == k)).transform(known.filter(F.col("fold") != k)).select("family", "label", "n", score) for k in (0, 1) if len(kinds[k]) == 2]
    # One row per family and score, so at most 10,001 a family.
    marks = reduce(DataFrame.union, scored).groupBy("family", "p").agg(F.sum(F.col("label") * F.col("n")).alias("sum"), F.sum("n").alias("count")).toPandas()

    def bound(g: pd.DataFrame) -> float | None:
        g = g.groupby("p")[["sum", "count"]].sum().sort_index(ascending=False).cumsum()
        good = g.index[(g["sum"] >= precision * g["count"]) & (g["sum"] >= 1)]
        if not len(good):
            return None
        lower = g.index[g.index < good.min()]
        return max(0.5, (float(good.min()) + float(lower.max() if len(lower) else 0)) / 2)

    common, least = bound(marks), {}
    for family, g in marks.groupby("family"):
        own = bound(g) if g["sum"].sum() >= 5 else common if g["sum"].sum() else None
        if own is not None:
            least[int(family)] = own
    if not least:
        return None
    limit = F.create_map(*[F.lit(x) for kv in least.items() for x in kv])
    more = trees.fit(known).transform(each.filter("label < 0").select("uid", "family", "start", "end", marks_of("steps"))).select("uid", "family", "start", "end", score)
    more = more.filter(F.col("p") >= limit[F.col("family")])
    return more.groupBy("uid").agg(F.collect_list(F.struct("p", "family", "start", "end")).alias("more"))


def best_apart(more: list) -> list[tuple[int, int, int]]:
    """(kind, start, end) of additions: of overlapping ones the better score, to one digit, stays, then the longer, then the earlier; sorted by kind and start."""
    spans: list[tuple[int, int]] = []
    out = []
    for x in sorted(more, key=lambda x: (-round(x["p"], 1), x["start"] - x["end"], x["start"], x["family"])):
        if not touching(spans, x["start"], x["end"]):
            insort(spans, (x["start"], x["end"]))
            out.append((4 + x["family"], x["start"], x["end"]))
    return sorted(out)


def find(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, n_more, base_sha256, spans.

    Whole texts are read once. Of overlapping additions the better score stays; none overlaps a base span. Null text
    counts as empty: no spans. Null doc_id and repeated rows are searched like others. Very long texts are searched in time
    in proportion to their length. Empty table: empty result. Further columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    rows = put(extract(docs), "pii-spans")
    more = select_more(rows, **how)
    base = rows.select("uid", "doc_id", "base")
    if more is None:
        base = base.withColumn("more", F.lit(None).cast("array<struct<p: double, family: int, start: int, end: int>>"))
    else:
        base = base.join(put(more, "pii-more"), "uid", "left")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, base, more in zip(b["doc_id"], b["base"], b["more"], strict=True):
                base = [(x["kind"], x["start"], x["end"]) for x in base]
                added = best_apart(more if more is not None else [])
                n = np.bincount([k for k, _, _ in base], minlength=4)
                out.append((key, *n[:4].tolist(), len(added), hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + added)))
            frame = pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_more", "base_sha256", "spans"])
            yield frame.assign(doc_id=frame["doc_id"].astype("Int64"))

    return base.drop("uid").mapInPandas(finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_more long, base_sha256 string, spans string")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))


QUERIES = {"op7_personal_data": op7_personal_data}
SQL: dict[str, str] = {}
