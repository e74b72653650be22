"""Statistics of arrays and counts as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import PUNCTUATION, STOPWORDS


def clamp01(x: Column) -> Column:
    """Into [0, 1]; NaN stays."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def safe_div(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def array_sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def array_mean(x: Column) -> Column:
    return safe_div(array_sum(x), F.size(x))


def sample_variance(x: Column) -> Column:
    """With n - 1; 0 for fewer than two values."""
    mean = array_mean(x)
    spread = F.aggregate(F.transform(x, lambda v: v - mean), F.lit(0.0), lambda a, v: a + v * v)
    return F.when(F.size(x) < 2, F.lit(0.0)).otherwise(spread / (F.size(x) - 1))


def entropy_of_counts(counts: list[Column]) -> Column:
    """Base-2 entropy; 0 without counts."""
    total = reduce(lambda a, b: a + b, counts)
    parts = reduce(lambda a, b: a + b, [F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0) for c in counts])
    return F.when(total == 0, F.lit(0.0)).otherwise(F.log2(total.cast("double")) - parts / total)


def punctuation_entropy(t: Column) -> Column:
    """Entropy of the fixed punctuation marks: one count each, no lists."""
    return entropy_of_counts([F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in PUNCTUATION])


def stopword_ratio(tokens: Column) -> Column:
    return safe_div(F.size(F.filter(tokens, lambda w: w.isin(STOPWORDS))).cast("double"), F.size(tokens))
