"""Label ids to names and back, over the fixed label catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.sources.catalog import TASK_LABELS, label_catalog


def label_names(df: DataFrame, task: str, label: str = "label", out: str = "label_name") -> DataFrame:
    """Add the class name of a label id; an id outside the catalog gives null."""
    names = (
        label_catalog(df.sparkSession)
        .where(F.col("task") == task)
        .select(F.col("label_id").alias(label), F.col("label_name").alias(out))
    )
    return df.join(F.broadcast(names), label, "left")


def label_ids(df: DataFrame, task: str, name: str = "label_name", out: str = "label_id") -> DataFrame:
    """Add the label id of a class name; an unknown name gives null."""
    ids = (
        label_catalog(df.sparkSession)
        .where(F.col("task") == task)
        .select(F.col("label_name").alias(name), F.col("label_id").alias(out))
    )
    return df.join(F.broadcast(ids), name, "left")


def label_list_names(df: DataFrame, task: str, labels: str = "targets", out: str = "label_names") -> DataFrame:
    """Names of a list of label ids in list order, in place: a task has at most 100 names."""
    names = F.array(*[F.lit(name) for name in TASK_LABELS[task]])
    return df.withColumn(out, F.transform(F.col(labels), lambda i: F.get(names, i)))


def num_labels(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("task").agg(F.count("*").alias("num_labels"))
