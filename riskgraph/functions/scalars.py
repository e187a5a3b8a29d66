"""Scalar expressions: tokens, ids, rates, spreads, numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_PRIOR = -1.0
#: Fixed pattern of a number in a text.
NUMBER = r"(?<![A-Za-z0-9_.])-?\d[\d,]*\.?\d*(?![A-Za-z0-9_])"


def norm_token(c: Column) -> Column:
    """Lower case, no version numbers, single spaces; nothing left: 'NA'."""
    x = F.regexp_replace(F.lower(c.cast("string")), r"\d+(?:[._]\d+)*", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(x, r"\s+", " ")), F.lit("")), F.lit("NA"))


def id_string(c: Column) -> Column:
    """A numeric id as text, rounded half to even; null: 'NA'."""
    return F.coalesce(F.bround(c.cast("double"), 0).cast("bigint").cast("string"), F.lit("NA"))


def smoothed_rate(hits: Column, n: Column, prior: Column | float, strength: float) -> Column:
    prior = prior if isinstance(prior, Column) else F.lit(prior)
    return (hits + strength * prior) / (n + F.lit(strength))


def variation(n: Column, total: Column, squares: Column) -> Column:
    """Population coefficient of variation; -1 with fewer than two values or no positive mean."""
    mean = total / n
    return F.when((n >= 2) & (total > 0), F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))) / mean).otherwise(F.lit(NO_PRIOR))


def fano(m: Column, total: Column, squares: Column) -> Column:
    """Variance over mean of m intervals; -1 with fewer than two or no positive mean."""
    mean = total / m
    return F.when((m >= 2) & (total > 0), (squares / m - mean * mean) / mean).otherwise(F.lit(NO_PRIOR))


def entropy(counts: list[Column], n: Column) -> Column:
    """Base-2 entropy of counts that sum to n; -1 below two."""
    parts = [F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0) for c in counts]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(n >= 2, F.log2(n.cast("double")) - total / n).otherwise(F.lit(NO_PRIOR))


def numbers_in(text: Column) -> Column:
    """The numbers that a text states, as doubles."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.round(F.regexp_replace(x, ",", "").try_cast("double"), 6))


def noisy_or(p: Column) -> Column:
    """1 - prod(1 - p) over a group, in logs; any p >= 1 gives 1."""
    return F.when(F.max(p) >= 1.0, 1.0).otherwise(F.coalesce(-F.expm1(F.sum(F.log1p(-p))), F.lit(0.0)))
