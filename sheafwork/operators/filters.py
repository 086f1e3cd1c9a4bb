"""Projections, filters and checks that add no shuffle of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.sources.catalog import EXAMPLE_COLUMNS, TASK_TYPES

# Fixed value: source columns dropped after a feature table is built.
INPUT_COLUMNS = {
    "multi_class": ("text",),
    "multi_label": ("text", "targets"),
    "multiple_choice_qa": ("context", "endings"),
    "summarization": ("title", "text", "summary"),
}


def rename_labels(df: DataFrame) -> DataFrame:
    """Free the name ``labels`` for the dense vector; the sparse list becomes ``targets``."""
    return df.withColumnRenamed("labels", "targets")


def drop_inputs(df: DataFrame, example_type: str) -> DataFrame:
    return df.drop(*INPUT_COLUMNS[example_type])


def batched_map(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
    batch_size: int = 1000,
) -> DataFrame:
    """Run a user function over column batches of at most ``batch_size`` rows.

    The function may return fewer or more rows than it got. Filter before this call:
    predicates are not pushed through it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                yield fn(batch.iloc[start : start + batch_size].reset_index(drop=True))

    return df.mapInPandas(run, schema)


def tag_eval_mode(df: DataFrame, mode: str) -> DataFrame:
    if mode not in ("clm", "seq2seq"):
        raise ValueError(f"mode must be 'clm' or 'seq2seq', not {mode!r}")
    return df.withColumn("eval_mode", F.lit(mode))


def select_text_column(df: DataFrame, task: str, out: str = "text") -> DataFrame:
    """The text column of the task's example type, under one common name."""
    return df.withColumn(out, F.col(EXAMPLE_COLUMNS[TASK_TYPES[task]][1]))


def drop_incomplete_pairs(df: DataFrame, text: str = "text", summary: str = "summary") -> DataFrame:
    """Keep rows with a non-empty text and summary; a null compares false and goes too."""
    return df.where((F.col(text) != "") & (F.col(summary) != ""))


def drop_overlong(df: DataFrame, max_len: int, doc: str = "doc_ids", summary: str = "sum_ids") -> DataFrame:
    return df.where(F.size(doc) + F.size(summary) <= max_len)


def char_band(df: DataFrame, lo: int = 5000, hi: int = 20000, text: str = "text") -> DataFrame:
    return df.where(F.length(text).between(lo, hi))


def unknown_tasks(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose task is not allowed; ``allowed`` is the fixed catalog, so it is broadcast."""
    return df.join(F.broadcast(allowed), "task", "left_anti")


def length_alignment(df: DataFrame, multiple: int, ids: str = "input_ids") -> DataFrame:
    return df.withColumn("aligned", F.size(ids) % multiple == 0)


def alignment_report(df: DataFrame, *multiples: int, ids: str = "input_ids") -> DataFrame:
    """Rows aligned and not aligned to each multiple, from one reading of the table.

    The table is grouped by all multiples together, at most 2 to their number groups, which are then told apart.
    """
    flags = [(F.size(ids) % m == 0).alias(f"by{k}") for k, m in enumerate(multiples)]
    groups = df.select(*flags).groupBy(*[f"by{k}" for k in range(len(multiples))]).agg(F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(m).alias("multiple"), F.col(f"by{k}").alias("aligned")) for k, m in enumerate(multiples)])
    told = groups.select("n", F.inline(each))
    return told.groupBy("multiple", "aligned").agg(F.sum("n").alias("n_rows"))
