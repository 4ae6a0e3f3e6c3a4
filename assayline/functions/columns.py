"""Column functions: keys, draws, ratios, and p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw(*parts: str | Column | int) -> Column:
    """A whole number in [0, 2**32) from md5 of the parts joined by '|', the same in Spark and in DuckDB; it stands for random order."""
    texts = [F.lit(str(p)) if isinstance(p, int) else col(p).cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts)), 1, 8), 16, 10).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles; null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def normalize_key(c: str | Column) -> Column:
    """Trimmed, inner white space to one blank, lower case; null for null and blank."""
    c = F.trim(col(c))
    return F.when(c != "", F.lower(F.regexp_replace(c, r"\s+", " ")))


def normalize_merge_key(c: str | Column) -> Column:
    return F.trim(col(c).cast("string"))


def largest_fragment(c: str | Column, sep: str = ".") -> Column:
    """The longest part between separators; of equally long ones the largest string; the key's normal form if there is none."""
    parts = F.split(col(c), "\\" + sep)
    return F.coalesce(F.array_max(F.transform(parts, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"], normalize_key(c))


def n_fragments(c: str | Column, sep: str = ".") -> Column:
    return F.size(F.split(col(c), "\\" + sep))


def safe_bool(c: str | Column) -> Column:
    return F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "valid", "t")


def to_number(c: str | Column) -> Column:
    """As a double; 0 for null and for what isn't a number."""
    return F.coalesce(F.try_cast(col(c), "double") if hasattr(F, "try_cast") else col(c).try_cast("double"), F.lit(0.0))


def vocab_hits(tokens: Column, vocab: list[str]) -> Column:
    """The tokens that are in the vocabulary, each once, sorted."""
    return F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(v) for v in vocab])))


def vocab_symbol(code: Column, names: dict[int, str]) -> Column:
    """A code's name; Z and the code if it has none."""
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(known, code), F.concat(F.lit("Z"), code.cast("string")))


def tokens(c: str | Column) -> Column:
    return F.split(F.lower(col(c)), " ")


@F.pandas_udf(T.DoubleType())
def fisher_exact_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided p of a 2x2 table; for the few rows of an aggregate."""

    def one(a: int, b: int, c: int, d: int) -> float:
        def log_p(x: int) -> float:
            y, z, w = a + b - x, a + c - x, d - a + x
            return sum(math.lgamma(v + 1) for v in (a + b, c + d, a + c, b + d)) - sum(math.lgamma(v + 1) for v in (a + b + c + d, x, y, z, w))

        seen = log_p(a)
        lo, hi = max(0, a - d), min(a + b, a + c)
        return min(1.0, sum(math.exp(p) for x in range(lo, hi + 1) if (p := log_p(x)) <= seen + 1e-7))

    return pd.Series([one(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def chi2_p(chi2: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution with one degree of freedom."""
    return chi2.map(lambda x: math.erfc(math.sqrt(x / 2)))


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail of the normal distribution."""
    return z.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))


@F.pandas_udf(T.DoubleType())
def signed_rank_p(statistic: pd.Series, ranks2: pd.Series, counts: pd.Series) -> pd.Series:
    """Two-sided exact p of a signed-rank statistic; ranks2: twice the ranks (whole numbers, with ties), each as often as counts says.

    The number of ways to reach each sum of twice the positive ranks is built up rank by rank.
    """

    def one(stat: float, ranks: list[int], ks: list[int]) -> float | None:
        if stat is None or math.isnan(stat):
            return None
        ways = [1]
        for r, k in zip(ranks, ks, strict=True):
            for _ in range(k):
                ways = [(ways[i] if i < len(ways) else 0) + (ways[i - r] if i >= r else 0) for i in range(len(ways) + r)]
        return min(1.0, 2 * sum(ways[: int(round(2 * stat)) + 1]) / sum(ways))

    return pd.Series([one(s, [int(x) for x in r], [int(x) for x in k]) for s, r, k in zip(statistic, ranks2, counts, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t with df degrees of freedom: the regularised incomplete beta function at df / (df + t * t)."""

    def beta(a: float, b: float, x: float) -> float:
        """By its continued fraction (modified Lentz), on the side where that converges fast."""
        if x <= 0 or x >= 1:
            return float(x >= 1)
        if x > (a + 1) / (a + b + 2):
            return 1 - beta(b, a, 1 - x)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
        tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
        f = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / ((1 + num * d) or tiny)
                c = (1 + num / c) or tiny
                f *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return front * f

    return pd.Series([None if x is None or n is None or math.isnan(x) or math.isnan(n) or n <= 0 else beta(n / 2, 0.5, n / (n + x * x)) for x, n in zip(t, df, strict=True)], dtype=float)
