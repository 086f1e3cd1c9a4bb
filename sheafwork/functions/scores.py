"""Row-level scoring expressions over logits, targets and overlap counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(logits: Column) -> Column:
    """Zero-based index of the first maximum. NaN sorts highest; a null row stays null."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def binarize(logits: Column, threshold: float = 0.5) -> Column:
    """Sigmoid, then ``>= threshold``."""
    return F.transform(logits, lambda x: ((1 / (1 + F.exp(-x.cast("double")))) >= threshold).cast("int"))


def targets_to_int(targets: Column) -> Column:
    return F.transform(targets, lambda t: t.cast("int"))


def log_sum_exp(logits: Column) -> Column:
    """One pass that rescales the running sum whenever a new maximum appears."""
    lowest = F.lit(float("-inf"))
    start = F.struct(lowest.alias("top"), F.lit(0.0).alias("total"))

    def step(acc: Column, raw: Column) -> Column:
        x = raw.cast("double")
        rescaled = F.struct(x.alias("top"), (acc["total"] * F.exp(acc["top"] - x) + 1.0).alias("total"))
        added = F.struct(acc["top"].alias("top"), (acc["total"] + F.exp(x - acc["top"])).alias("total"))
        return F.when(x == lowest, acc).when(x > acc["top"], rescaled).otherwise(added)

    return F.aggregate(logits, start, step, lambda acc: acc["top"] + F.log(acc["total"]))


def cross_entropy(logits: Column, label: Column) -> Column:
    return log_sum_exp(logits) - F.get(logits, label).cast("double")


def bce_cell(logit: Column, target: Column) -> Column:
    """Stable binary cross-entropy of one logit: no exponential of a positive number."""
    x, t = logit.cast("double"), target.cast("double")
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def bce_sum(logits: Column, targets: Column) -> Column:
    return F.aggregate(F.zip_with(logits, targets, bce_cell), F.lit(0.0), lambda a, x: a + x)


def precision_recall_f1(hits: Column, n_pred: Column, n_ref: Column) -> Column:
    """struct(precision, recall, fmeasure); all zero without hits or with an empty side."""
    found = (hits > 0) & (n_pred > 0) & (n_ref > 0)
    zero = F.lit(0.0)
    # 2PR/(P+R) with P = h/p and R = h/r is 2h/(p+r)
    return F.struct(
        F.when(found, hits / n_pred).otherwise(zero).alias("precision"),
        F.when(found, hits / n_ref).otherwise(zero).alias("recall"),
        F.when(found, 2 * hits / (n_pred + n_ref)).otherwise(zero).alias("fmeasure"),
    )
