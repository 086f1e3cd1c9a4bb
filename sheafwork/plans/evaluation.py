"""Evaluation jobs that join several operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import arrays
from sheafwork.operators import encoding, metrics, rouge
from sheafwork.operators.encoding import Codec


def text_pairs_from_ids(
    df: DataFrame, vocab: DataFrame | Codec, preds: str = "preds", labels: str = "labels", key: Sequence[str] = ("example_id",)
) -> DataFrame:
    """Decoded (pred, ref) texts; ignored labels count as pads and vanish with them."""
    unmasked = df.withColumn(labels, arrays.unmask_labels(F.col(labels), encoding.PAD))
    return encoding.decode(unmasked, vocab, {preds: "pred", labels: "ref"}).select(*key, "pred", "ref")


def rouge_from_ids(df: DataFrame, vocab: DataFrame | Codec, keys: Sequence[str] = rouge.KEYS, **options) -> DataFrame:
    return rouge.rouge_report(text_pairs_from_ids(df, vocab), keys, **options)


def evaluate_by_mode(
    clm_logits: DataFrame, clm_labels: DataFrame, seq2seq_pairs: DataFrame, keys: Sequence[str] = rouge.KEYS
) -> DataFrame:
    """(mode, metric, value): cross-entropy of the clm rows, ROUGE of the seq2seq rows."""
    clm = metrics.long_form(metrics.lm_cross_entropy(clm_logits, clm_labels), "clm")
    seq2seq = metrics.long_form(rouge.rouge_report(seq2seq_pairs, keys), "seq2seq")
    return metrics.eval_union(clm, seq2seq)
