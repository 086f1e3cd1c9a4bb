"""Metrics as running state: each micro-batch of predictions updates them.

The state of a metric is what its batch form aggregates - one row per (label, pred) - so
it does not grow with the stream. Row-level builders need nothing here: with a bounded
vocabulary they are projections and run on a stream as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafwork.operators import metrics


def running_confusion(preds: DataFrame) -> DataFrame:
    """(label, pred, n) so far; write it in complete mode."""
    return metrics.confusion_matrix(preds)


def start_running_confusion(preds: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts of all predictions seen so far in the in-memory table ``name``."""
    return (
        running_confusion(preds)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compute(confusion: DataFrame, num_classes: int, absent: str = "skip") -> DataFrame:
    """(metric, value) rows of the counts at this moment: accuracy and macro-F1."""
    hits = F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0))
    accuracy = confusion.agg((hits / F.sum("n")).alias("accuracy"))
    macro_f1 = metrics.macro_f1_of_counts(metrics.class_counts_of(confusion), num_classes, absent)
    return metrics.eval_union(metrics.long_form(accuracy, "stream"), metrics.long_form(macro_f1, "stream"))
