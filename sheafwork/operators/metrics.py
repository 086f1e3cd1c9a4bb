"""Classification and language-model metrics over prediction tables.

Every metric is one aggregation whose per-task state is a few numbers or one row per
class, so a class that holds most of the rows is combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import arrays, scores


def join_predictions(preds: DataFrame, targets: DataFrame, key: Sequence[str] = ("example_id",)) -> DataFrame:
    return preds.join(targets, list(key), "inner")


def unmatched_rows(preds: DataFrame, targets: DataFrame, key: Sequence[str] = ("example_id",)) -> DataFrame:
    """Keys that only one side has, with the side they are missing from."""
    left, right = preds.select(*key), targets.select(*key)
    no_target = left.join(right, list(key), "left_anti").withColumn("missing_from", F.lit("targets"))
    no_pred = right.join(left, list(key), "left_anti").withColumn("missing_from", F.lit("preds"))
    return no_target.unionByName(no_pred)


def accuracy(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    hit = (F.col("pred") == F.col("label")).cast("double")
    return df.groupBy(*groups).agg(F.avg(hit).alias("accuracy"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "pred").agg(F.count("*").alias("n"))


def class_counts_of(confusion: DataFrame) -> DataFrame:
    """tp, fp, fn and support per class, from the (label, pred) counts."""
    cell = F.col("n")
    hit = F.col("label") == F.col("pred")
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.when(hit, cell).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(hit, 0).otherwise(cell).alias("fn"),
                 cell.alias("support")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(hit, 0).otherwise(cell).alias("fp"), F.lit(0).cast("bigint").alias("fn"),
                 F.lit(0).cast("bigint").alias("support")),
    )
    cells = confusion.select(F.inline(sides))
    return cells.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "support")])


def class_counts(df: DataFrame) -> DataFrame:
    return class_counts_of(confusion_matrix(df))


def macro_f1_of_counts(counts: DataFrame, num_classes: int, absent: str = "skip") -> DataFrame:
    """Mean F1 over classes. ``absent`` decides on classes without any tp, fp or fn."""
    if absent not in ("skip", "zero"):
        raise ValueError(f"absent must be 'skip' or 'zero', not {absent!r}")
    span = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(span > 0, 2 * F.col("tp") / span)
    seen = counts.where(F.col("class").between(0, num_classes - 1)).select(f1.alias("f1"))
    if absent == "skip":
        return seen.agg(F.avg("f1").alias("macro_f1"))
    # an absent class adds nothing to the sum but still counts in the mean
    return seen.agg((F.coalesce(F.sum("f1"), F.lit(0.0)) / num_classes).alias("macro_f1"))


def macro_f1(df: DataFrame, num_classes: int, absent: str = "skip") -> DataFrame:
    return macro_f1_of_counts(class_counts(df), num_classes, absent)


def label_cells(df: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """One (class, pred, target) row per label position."""
    return df.select(F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(target).alias("t"))).alias("class", "c")).select(
        "class", F.col("c.p").alias("pred"), F.col("c.t").alias("target")
    )


def multilabel_counts(df: DataFrame) -> DataFrame:
    p, t = F.col("pred") == 1, F.col("target") == 1
    return (
        label_cells(df)
        .groupBy("class")
        .agg(
            F.count_if(p & t).alias("tp"),
            F.count_if(p & ~t).alias("fp"),
            F.count_if(~p & t).alias("fn"),
            F.count("*").alias("cells"),
        )
    )


def multilabel_accuracy(df: DataFrame) -> DataFrame:
    """Share of (row, label) cells that agree."""
    wrong = F.sum(F.col("fp") + F.col("fn"))
    return multilabel_counts(df).agg((1 - wrong / F.sum("cells")).alias("accuracy"))


def multilabel_macro_f1(df: DataFrame, num_classes: int, absent: str = "skip") -> DataFrame:
    return macro_f1_of_counts(multilabel_counts(df), num_classes, absent)


def cross_entropy(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    loss = scores.cross_entropy(F.col("logits"), F.col("label"))
    return df.groupBy(*groups).agg(F.avg(loss).alias("cross_entropy"))


def bce_with_logits(df: DataFrame, reduction: str = "mean") -> DataFrame:
    if reduction not in ("mean", "sum"):
        raise ValueError(f"reduction must be 'mean' or 'sum', not {reduction!r}")
    rows = df.select(scores.bce_sum(F.col("logits"), F.col("targets")).alias("s"), F.size("logits").alias("n"))
    total = F.sum("s")
    return rows.agg((F.try_divide(total, F.sum("n")) if reduction == "mean" else total).alias("bce"))


def token_targets(labels: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, pos, target): what each position should predict; ignored targets are gone."""
    shifted = labels.select(key, F.posexplode(arrays.shift_targets(F.col("labels"))).alias("pos", "target"))
    return shifted.where(F.col("target") != arrays.IGNORE)


def token_losses(token_logits: DataFrame, labels: DataFrame, key: str = "example_id") -> DataFrame:
    """Loss per predicted token; ignored targets are gone.

    Joined on example and position, so the rows of a long sequence, each as wide as the vocabulary,
    are spread over all tasks. ``labels`` has one array of labels per example, or the rows of
    :func:`token_targets`; where those and the logits are stored in buckets by both columns, they
    meet without a shuffle.
    """
    targets = labels if "target" in labels.columns else token_targets(labels, key)
    joined = token_logits.join(targets, [key, "pos"])
    return joined.select(key, "pos", "target", scores.cross_entropy(F.col("logits"), F.col("target")).alias("loss"))


def lm_cross_entropy(token_logits: DataFrame, labels: DataFrame, key: str = "example_id") -> DataFrame:
    return token_losses(token_logits, labels, key).agg(F.avg("loss").alias("cross_entropy"))


def long_form(scores_row: DataFrame, mode: str) -> DataFrame:
    """(mode, metric, value) rows of a one-row table of scores."""
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in scores_row.columns])
    return scores_row.select(F.lit(mode).alias("mode"), F.inline(cells))


def eval_union(*evaluators: DataFrame) -> DataFrame:
    """Several evaluators' rows side by side."""
    first, *rest = evaluators
    for other in rest:
        first = first.unionByName(other)
    return first
