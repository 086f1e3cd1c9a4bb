"""Multiple choice: one row per (context, ending), and back to one row per example."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafwork.functions import arrays, scores
from sheafwork.operators.encoding import BOS, EOS, PAD, SEP

FEATURES = ("input_ids", "attention_mask", "token_type_ids")


def explode_choices(df: DataFrame, endings: str = "endings") -> DataFrame:
    """One row per choice; ``choice`` is the position of the ending."""
    others = [c for c in df.columns if c != endings]
    return df.select(*others, F.posexplode(endings).alias("choice", "ending"))


def pair_features(
    context_ids: Column,
    ending_ids: Column,
    n_context: Column,
    n_ending: Column,
    max_len: int,
    seps: int = 1,
    type_ids: bool = True,
    side: str = "right",
) -> Column:
    """struct of padded ids, mask and type ids for begin context sep ending end.

    Both sides come cut already, with their lengths, so that no cut is worked out twice.
    """
    first, second = n_context + 1 + seps, n_ending + 1
    ids = arrays.add_pair_special_tokens(context_ids, ending_ids, BOS, SEP, EOS, seps)
    pads = F.lit(max_len) - first - second
    fields = [
        arrays.pad_by(ids, pads, PAD, side).alias("input_ids"),
        arrays.attention_mask(first + second, max_len, side).alias("attention_mask"),
    ]
    if type_ids:
        fields.append(arrays.token_type_ids(first, second, max_len).alias("token_type_ids"))
    return F.struct(*fields)


def encode_choices(
    df: DataFrame, max_len: int, context: str = "context_ids", ending: str = "ending_ids", seps: int = 1
) -> DataFrame:
    """Pair features of exploded rows whose two sides are encoded already."""
    keep = arrays.pair_cuts(F.size(context), F.size(ending), max_len - 2 - seps)
    a, b = F.col("__keep")["a"], F.col("__keep")["b"]
    pair = pair_features(F.slice(context, F.lit(1), a), F.slice(ending, F.lit(1), b), a, b, max_len, seps)
    out = df.withColumn("__keep", keep).withColumn("__pair", pair)
    return out.withColumns({f: F.col("__pair")[f] for f in FEATURES}).drop("__keep", "__pair", context, ending)


def regroup_choices(df: DataFrame, key: str = "example_id", carry: Sequence[str] = ("label",)) -> DataFrame:
    """One row per example with arrays in choice order; a group is one example's choices."""
    grouped = df.groupBy(key, *carry).agg(
        F.array_sort(F.collect_list(F.struct("choice", *FEATURES))).alias("__choices")
    )
    return grouped.select(key, *[F.col("__choices")[f].alias(f) for f in FEATURES], *carry)


def choose(df: DataFrame, key: str = "example_id", score: str = "score", label: str = "label") -> DataFrame:
    """Best choice per example (ties to the lowest) and the cross-entropy over its choices."""
    best = F.max_by("choice", F.struct(F.col(score), -F.col("choice")))
    in_order = F.array_sort(F.collect_list(F.struct("choice", F.col(score).alias("score"))))
    grouped = df.groupBy(key).agg(
        best.cast("int").alias("pred"), F.max(label).alias(label), in_order.alias("__scores")
    )
    loss = scores.cross_entropy(F.col("__scores")["score"], F.col(label))
    return grouped.withColumn("loss", loss).drop("__scores")
