"""Mathematics of logits as column expressions over arrays of doubles. Entropies here are in nats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_partition(logits: Column) -> Column:
    """log of the sum of exponentials, kept in range by the largest."""
    top = F.array_max(logits)
    return top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def label_logit(logits: Column, label: Column) -> Column:
    return F.get(logits, label.cast("int"))


def true_log_prob(logits: Column, label: Column, log_z: Column) -> Column:
    return label_logit(logits, label) - log_z


def token_entropy(logits: Column, log_z: Column) -> Column:
    """-sum p log p = log Z - sum p * logit."""
    return log_z - F.aggregate(logits, F.lit(0.0), lambda a, v: a + F.exp(v - log_z) * v)


def top1_prob(logits: Column, log_z: Column) -> Column:
    return F.exp(F.array_max(logits) - log_z)


def top1_margin(logits: Column) -> Column:
    """Gap between the two largest logits."""
    ordered = F.sort_array(logits, asc=False)
    return F.get(ordered, F.lit(0)) - F.get(ordered, F.lit(1))


def in_top(logits: Column, label: Column, k: int = 10) -> Column:
    """Whether fewer than k logits exceed the label's; ties count for the label."""
    own = label_logit(logits, label)
    return F.size(F.filter(logits, lambda v: v > own)) < k


def cross_entropy(p_logits: Column, q_logits: Column, p_log_z: Column, q_log_z: Column) -> Column:
    """-sum p log q of two distributions given by logits."""
    return -F.aggregate(F.zip_with(p_logits, q_logits, lambda p, q: F.exp(p - p_log_z) * (q - q_log_z)), F.lit(0.0), lambda a, v: a + v)


def scaled(logits: Column, temperature: float) -> Column:
    return F.transform(logits, lambda v: v.cast("double") / temperature)
