r"""Spelling variants: frequent words, the words one edit away from each, and the form that each is taken to stand for.

Near words are found by asymmetric q-chunks. Of two words the shorter (or either of equals) is cut into two disjoint
chunks that cover it; one edit leaves a chunk whole, and it stands in the other word shifted by no more than the
difference of their lengths, which is one at the most. So the other word need only give those of its positional grams that
are as long as a chunk and within that shift of its place, and the two meet by an equality of (length, place, text).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.common import put, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, FEWEST, STEP, NOISE = 6, 5, 5, 199
#: Pairs that one key may give; keys with more are cut further.
HOT = 500


def counted_words(docs: DataFrame, noise: int | None = NOISE) -> DataFrame:
    """(word, n): lower-cased runs of letters, at least SHORTEST long, that occur FEWEST times or more. With `noise`, of one in so many runs, by a hash of it and doc_id, a letter is left out first."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    runs = docs.select(F.col("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(rf"[a-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    word = F.col("run")
    if noise is not None:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % noise == 0, F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length("run")))).otherwise(word)
    words = runs.select(word.alias("word")).filter(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= FEWEST)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with the key of what lies outside [i, j) of the chunked word: there it must be equal, within it lies the edit."""
    end = F.col("j") + F.col("shift")
    return rows.withColumn("key", F.xxhash64("size", "i", "j", F.col("word").substr(F.lit(1), F.col("i")), F.col("word").substr(end + 1, F.length("word"))))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, by the chunk that is whole: the edit is in the right half of [i, j), or in the left."""
    mid = ((F.col("i") + F.col("j")) / 2).cast("int")
    part = F.explode(F.array(F.struct(mid.alias("i"), F.col("j").alias("j")), F.struct(F.col("i").alias("i"), mid.alias("j"))))
    rest = [c for c in rows.columns if c not in ("i", "j", "key")]
    return _keyed(rows.select(*rest, part.alias("part")).select(*rest, "part.i", "part.j"))


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, n_a, b, n_b): each pair of words one inserted, deleted or replaced code point apart, once; words: word, n, distinct.

    A word stands for itself as the one that is cut (shift 0, as both sides of a pair of equal length) and as the longer
    partner of words one shorter (shift 1). A key that would give more than `hot` pairs is cut again: the half that may
    hold the edit is itself cut into two chunks, one of which is whole. That ends when one code point is left, so no
    key's group is larger than the alphabet allows, and none is dropped.
    """
    size = F.length("word") - F.col("shift")
    rows = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")).withColumn("size", size).filter(F.col("size") >= F.least(F.lit(SHORTEST), F.length("word")))
    rows = put(_halved(rows.withColumns({"i": F.lit(0), "j": F.col("size")})), "variants-keys")
    found = []
    while True:
        x, y = F.col("x"), F.col("y")
        keys = rows.groupBy("key").agg(F.count_if(F.col("shift") == 0).alias("x"), F.count_if(F.col("shift") == 1).alias("y"), F.max(F.col("j") - F.col("i")).alias("open"))
        keys = put(keys.withColumn("pairs", x * (x - 1) / 2 + x * y).filter("pairs > 0").select("key", ((F.col("pairs") > hot) & (F.col("open") > 1)).alias("more")), "variants-groups")
        met = put(rows.join(keys, "key"), "variants-met")
        found.append(met.filter("not more"))
        if keys.filter("more").isEmpty():
            break
        rows = put(_halved(met.filter("more").drop("more")), "variants-keys")
    met = reduce(DataFrame.unionByName, found)
    a = met.filter("shift = 0").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = met.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "shift")
    apart = F.levenshtein("a", "b", 1) == 1
    return a.join(b, "key").filter(((F.col("shift") == 1) | (F.col("a") < F.col("b"))) & apart).select("a", "n_a", "b", "n_b").distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Forms grow in number at each step, so there is no circle; each round doubles the steps."""
    roots = put(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = put(roots.select("word", "root").join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        if roots.filter("moved").isEmpty():
            return roots.select("word", "root")


def grouped(words: DataFrame, step: int = STEP) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root. The form is the near word of largest n (ties: smallest by code points), if that is at least step times the word's own; else null."""
    words = put(words, "variants-words")
    pairs = put(near_words(words), "variants-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    near = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("b"))).alias("best"))
    fits = -F.col("best.less") >= F.col("n") * step
    out = put(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.b")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n")), "variants-forms")
    roots = last_forms(out.filter("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, noise: int | None = NOISE) -> DataFrame:
    """Words of docs (doc_id, text), grouped by spelling.

    Null or empty text has no words; null doc_id counts as an empty one where it is hashed; repeated rows count as often as
    they are there. Texts and words may be of any length. Empty table, or no word that occurs often enough: empty result.
    Further columns are ignored, whatever their names.
    """
    return grouped(counted_words(docs.select("doc_id", "text"), noise))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
with recursive crc as materialized (select list(list_reduce([i] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
r as materialized (select doc_id, run, count(*) as k from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) as run from documents) group by all),
b as (select *, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [(192 + (unicode(x) >> 6))::bigint, (128 + (unicode(x) & 63))::bigint] end)) as bytes from r),
h as (select run, k, xor(4294967295, list_reduce([4294967295] || bytes, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) as h from b, crc),
d as (select case when h % 199 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, k from h),
w as materialized (select word, sum(k)::bigint as n from d where length(word) >= 6 group by word having sum(k) >= 5),
abc as materialized (select string_agg(chr((192 + i)::int), '' order by i) as wide, string_agg(chr((33 + i)::int), '' order by i) as narrow from range(64) r(i)),
v as materialized (select word, n, translate(word, wide, narrow) as bytes from w, abc),  -- levenshtein counts bytes
p as materialized (select a.word as word, a.n as n, b.word as other, b.n as m from v a join v b on abs(length(a.word) - length(b.word)) <= 1 and a.word <> b.word and levenshtein(a.bytes, b.bytes) = 1),
f as materialized (select w.word, w.n, count(p.other) as n_near, first(p.other order by p.m desc, p.other) as best, max(p.m) as most from w left join p on p.word = w.word group by w.word, w.n),
g as materialized (select word, n, n_near, case when most >= 5 * n then best end as form, case when most >= 5 * n then most end as form_n from f),
s as (select word, word as at, 0 as depth from g union all select s.word, g.form, depth + 1 from s join g on g.word = s.at where g.form is not null)
select g.word, g.form, z.root, g.n, g.n_near, g.form_n from g join (select word, max_by("at", depth) as root from s group by word) z on z.word = g.word
"""

QUERIES = {"op12_spelling_variants": op12_spelling_variants}
SQL = {"op12_spelling_variants": OP12_SQL}
