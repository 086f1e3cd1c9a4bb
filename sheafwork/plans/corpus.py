"""The given tables as the example types of this library.

Each function reads whole tables; ids are ``example_id`` throughout. A document's first
line is its summary, the rest its text, and its source its title.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.functions.text import after_first_line, first_line
from sheafwork.operators.encoding import build_vocab
from sheafwork.sources.catalog import TASK_TYPES
from sheafwork.sources.tables import read_table

# How the given columns stand in for tasks, splits, classes and tokenizers.
TASK_OF_SOURCE = {f"src{i}": task for i, task in enumerate(TASK_TYPES)}
SPLIT_OF_LANG = {"en": "train", "fr": "validation", "de": "test", "es": "holdout"}
CLASS_OF_LANG = {"de": 0, "en": 1, "es": 2, "fr": 3}
TOKENIZER_OF_LANG = {"en": "gpt2", "fr": "google/mt5-small", "de": "t5-large", "es": "bigscience/T0_3B"}
VOCAB_SIZE = 52_000
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def pick(column: Column, values: dict, otherwise: Column | None = None) -> Column:
    """CASE column WHEN key THEN value ... END."""
    chain = None
    for key, value in values.items():
        hit = column == key
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain if otherwise is None else chain.otherwise(otherwise)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", DOCUMENTS if name == "documents" else None)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work on their texts."""
    return table(spark, sf_dir, "documents")


def addressed(docs: DataFrame) -> DataFrame:
    """Documents with a task (some outside the catalog), a split and a tokenizer name."""
    return docs.select(
        F.col("doc_id").alias("example_id"),
        pick(F.col("source"), TASK_OF_SOURCE, F.col("source")).alias("task"),
        pick(F.col("lang"), SPLIT_OF_LANG).alias("split"),
        pick(F.col("lang"), TOKENIZER_OF_LANG).alias("tokenizer"),
        "text",
    )


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """example_id, title, text, summary; a one-line document has an empty text."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"),
        F.col("source").alias("title"),
        after_first_line(F.col("text")).alias("text"),
        first_line(F.col("text")).alias("summary"),
    )


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body as the prediction of the first line; empty bodies stay in."""
    return summaries(spark, sf_dir).select("example_id", F.col("text").alias("pred"), F.col("summary").alias("ref"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("example_id"), "text", pick(F.col("lang"), CLASS_OF_LANG).alias("label")
    )


def multi_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality and toxic as labels 0 and 1, the language as 2 to 5."""
    marks = F.array(
        F.when(F.col("quality") == 1, F.lit(0)),
        F.when(F.col("toxic") == 1, F.lit(1)),
        pick(F.col("lang"), CLASS_OF_LANG) + 2,
    )
    return (
        documents(spark, sf_dir)
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .select(F.col("doc_id").alias("example_id"), "text", F.array_compact(marks).alias("labels"))
    )


def choice_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body, the summaries of it and its four successors in hashed order, and which is its own."""
    rows = summaries(spark, sf_dir)
    offered = rows.select(
        F.explode(F.sequence(F.col("example_id") - 4, F.col("example_id"))).alias("example_id"),
        F.struct(
            F.md5(F.col("example_id").cast("string")).alias("at"), F.col("example_id").alias("of"), "summary"
        ).alias("offer"),
    )
    endings = offered.groupBy("example_id").agg(F.array_sort(F.collect_list("offer")).alias("offers"))
    return rows.join(endings, "example_id").select(
        "example_id",
        F.col("text").alias("context"),
        F.col("offers")["summary"].alias("endings"),
        (F.array_position(F.col("offers")["of"], F.col("example_id")) - 1).cast("int").alias("label"),
    )


def class_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding component is the logit of one class."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("example_id"), F.col("embedding").alias("logits"), "label"
    )


NUM_CLASSES = 64


def multilabel_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: the vector's own label, plus 10 and 11 for quality and toxic marks."""
    marks = F.array(
        F.col("label"), F.when(F.col("quality") == 1, F.lit(10)), F.when(F.col("toxic") == 1, F.lit(11))
    )
    marked = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "vec_id")
    return (
        table(spark, sf_dir, "embeddings")
        .join(marked, "vec_id", "left")
        .select(
            F.col("vec_id").alias("example_id"),
            F.col("embedding").alias("logits"),
            F.array_compact(marks).alias("target_ids"),
        )
    )


def token_preds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five consecutive vectors as one sequence: (example_id, pos, logits) and its labels."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id div 5").alias("example_id"),
        F.pmod("vec_id", F.lit(5)).cast("int").alias("pos"),
        F.col("embedding").alias("logits"),
        "label",
    )
    labels = rows.groupBy("example_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "label")))["label"].alias("labels")
    )
    return rows.drop("label"), labels


def multi_ref_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The opening turn as the prediction of each assistant turn of its conversation."""
    turns = table(spark, sf_dir, "conversations")
    opening = turns.where(F.col("turn") == 0).select("conv_id", F.col("text").alias("pred"))
    replies = turns.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("ref_id"), F.col("text").alias("ref")
    )
    return replies.join(opening, "conv_id").withColumnRenamed("conv_id", "example_id")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents."""
    return build_vocab(documents(spark, sf_dir), ["text"])
