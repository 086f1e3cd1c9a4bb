"""A training corpus from the table ``documents``, in five stages that each take the last one's rows.

Every stage but the last returns the columns of ``documents``; the last adds token ids and what they
decode to. Further columns stay as they are, whatever their names, but for those that the last stage adds. Texts
are read whole, a null text counts as empty, and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafwork.llm import bpe, conv, exact_dedup, mixing, near_dedup
from sheafwork.llm.common import keep, new_folder
from sheafwork.llm.queries import WORD_BPE, toxicity_network
from sheafwork.session import prepare


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below their language's calibrated threshold, or one half where none was calibrated.

    A null language has no threshold of its own; a score equal to the threshold is rejected. Equal texts in one
    language are kept or rejected together. Null and empty texts have the score of a text without words.
    """
    prepare(spark)
    net = toxicity_network(spark, sf_dir)
    score, limit = f"score_{uuid.uuid4().hex}", conv.threshold_of(net, F.col("lang"))
    return conv.scored(docs, net, out=score).where(F.col(score) < limit).drop(score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each normalised text, the one with the smallest id; a null id comes after all others.

    Of repeated rows one stays. Null and empty texts are equal.
    """
    prepare(spark)
    return exact_dedup.drop_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    prepare(spark)
    return near_dedup.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, none more than twice.

    A null source is a source of its own, the last. Repeated ids and rows are documents of their own.
    """
    prepare(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and the text that they decode to; an empty text has none.

    Columns named ``ids``, ``decoded`` or ``n_tokens`` are replaced.
    """
    prepare(spark)
    path = public_tokenizers.path(WORD_BPE)
    return bpe.round_trip(docs, path).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mix", mix),
    ("encode", encode),
]

#: A trained network and whole-copy rounding have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    folder = new_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), folder, name)
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
