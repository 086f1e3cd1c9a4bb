"""Scans of split-addressed example tables, and where shared files go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# One explicit schema per example type.
SCHEMAS = {
    "multi_class": "example_id bigint, text string, label int",
    "multi_label": "example_id bigint, text string, labels array<int>",
    "multiple_choice_qa": "example_id bigint, context string, endings array<string>, label int",
    "summarization": "example_id bigint, title string, text string, summary string",
}


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet scan; an explicit schema skips inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_split(table: DataFrame, task: str, split: str, task_col: str = "task", split_col: str = "split") -> DataFrame:
    """One split of one task.

    With ``task`` and ``split`` as partition folders this prunes to their files; as plain
    columns the two predicates are pushed to the Parquet reader.
    """
    return table.where((F.col(task_col) == task) & (F.col(split_col) == split))


def scan_listed(table: DataFrame, listed: DataFrame, task_col: str = "task", split_col: str = "split") -> DataFrame:
    """The rows of every (task, split) that ``listed`` names; repeats in it add nothing.

    Where task and split are folders (:func:`sheafwork.sources.features.write_features` with both in
    ``partition_by``) and ``listed`` is filtered, Spark prunes the folders while the query runs. A
    null task or split is never named.
    """
    return table.join(listed.select(task_col, split_col), [task_col, split_col], "left_semi")


def normalize_split(split: Column, summarization: Column) -> Column:
    """Summarization knows only train and test; the others keep their split."""
    return F.when(~summarization | (split == "train"), split).otherwise(F.lit("test"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and written tables.

    ``spark.checkpoint.dir`` names it. Only a session without one (a local run) gets a
    new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="sheafwork-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Rows written once to the shared folder and read back, for a step that would make them more than once."""
    path = f"{shared_dir(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
