"""Global row positions, and the shards and batches cut from them.

A row number over a whole table would sort it in one task. Here the key column alone is
cut into buckets, the buckets are counted (one row each), their running totals are
broadcast, and keys are numbered inside their bucket only. Other columns never enter that
sort: they are joined to the finished positions by key.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096  # bounds the broadcast totals; 16**HASH_DIGITS for the md5 order
HASH_DIGITS = 3


def id_bucketed(df: DataFrame, key: str, out: str = "__bucket", buckets: int = BUCKETS) -> DataFrame:
    """Add an order-preserving bucket of a numeric key, cut at its approximate quantiles.

    The cuts are a fixed number of values, read by one aggregate over the key column. They
    only balance the buckets, also for ids that lie in clusters: positions are exact
    wherever the cuts fall.
    """
    if not isinstance(df.schema[key].dataType, T.NumericType):
        raise TypeError(f"{key!r} must be a number to be numbered by its order")
    shares = F.split(F.lit(",".join(str(i / buckets) for i in range(1, buckets))), ",").cast("array<double>")
    quantiles = df.select(F.percentile_approx(key, shares, 4 * buckets).alias("q")).first()["q"] or []
    cuts = sorted({float(q) for q in quantiles})
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    splits = [float("-inf"), *cuts, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="__cut_by", outputCol=out)
    return cut.transform(df.withColumn("__cut_by", F.col(key).cast("double"))).drop("__cut_by")


def running_offsets(df: DataFrame, bucket: str, amount: Column) -> DataFrame:
    """(bucket, offset, total): what lies in earlier buckets, and in all of them.

    The window has no partition key, but runs over one row per bucket.
    """
    sizes = df.groupBy(bucket).agg(F.sum(amount).alias("amount"))
    earlier = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.select(
        bucket,
        F.coalesce(F.sum("amount").over(earlier), F.lit(0)).alias("offset"),
        F.sum("amount").over(everything).alias("total"),
    )


def running_start(narrow: DataFrame, order: str, amount: Column, bucket: str = "__bucket") -> DataFrame:
    """Add ``start``, the sum of ``amount`` over all rows before this one, and ``total``."""
    offsets = running_offsets(narrow, bucket, amount)
    earlier = Window.partitionBy(bucket).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(amount).over(earlier), F.lit(0))
    placed = narrow.join(F.broadcast(offsets), bucket).withColumn("start", (F.col("offset") + inside).cast("bigint"))
    return placed.drop(bucket, "offset")


def _positions(df: DataFrame, narrow: DataFrame, key: str, order: str, out: str, total: str | None) -> DataFrame:
    placed = running_start(narrow, order, F.lit(1))
    named = [F.col("start").alias(out)] + ([F.col("total").alias(total)] if total else [])
    ranked = placed.select(key, *named)
    return ranked if df.columns == [key] else df.join(ranked, key)


def position_by_id(
    df: DataFrame, key: str = "example_id", out: str = "position", total: str | None = None, buckets: int = BUCKETS
) -> DataFrame:
    """Zero-based rank of each row by ``key``, which must identify a row; ``total`` adds the row count."""
    return _positions(df, id_bucketed(df.select(key), key, buckets=buckets), key, key, out, total)


def shuffle(
    df: DataFrame, seed: int, key: str = "example_id", out: str = "position", total: str | None = None
) -> DataFrame:
    """Reproducible permutation: rank by the md5 of seed and id, whose prefix is an even bucket."""
    hashed = df.select(key, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))).alias("__hash"))
    narrow = hashed.withColumn("__bucket", F.substring("__hash", 1, HASH_DIGITS))
    return _positions(df, narrow, key, "__hash", out, total)


def assign_shard(df: DataFrame, world: int, position: str = "position") -> DataFrame:
    return df.withColumns(
        {
            "shard_id": F.pmod(F.col(position), F.lit(world)).cast("int"),
            "local_position": F.floor(F.col(position) / world).cast("bigint"),
        }
    )


def even_shards(df: DataFrame, world: int, drop_last: bool, position: str = "position", total: str = "n_rows") -> DataFrame:
    """Make the row count a multiple of ``world``.

    Keep: the first rows follow once more at the end, cycling if there are fewer rows than
    needed. Drop: the tail is cut. ``total`` is the row count that the position step adds.
    """
    rows, pos = F.col(total), F.col(position)
    if drop_last:
        return df.where(pos < F.floor(rows / world) * world)
    # a row at p also stands at p + rows, p + 2 rows, ... below the rounded-up count
    end = F.ceil(rows / world) * world
    places = F.sequence(pos.cast("bigint"), (end - 1).cast("bigint"), rows.cast("bigint"))
    return df.withColumn(position, F.explode(places))


def assign_batch(df: DataFrame, batch_size: int, local_position: str = "local_position") -> DataFrame:
    """Batches of a shard; the last one may be short."""
    return df.withColumn("batch_id", F.floor(F.col(local_position) / batch_size).cast("bigint"))


def device_batch_size(train: Column, evaluation: Column, world: Column) -> Column:
    """struct(train, eval) batch size per device; eval falls back to the train size."""
    return F.struct(
        F.floor(train / world).cast("bigint").alias("train"),
        F.floor(F.coalesce(evaluation, train) / world).cast("bigint").alias("eval"),
    )


def first_batches(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` batches of each shard; a negative ``n`` keeps all."""
    return df if n < 0 else df.where(F.col("batch_id") < n)


def preview(df: DataFrame, n: int = 2, key: str = "example_id", arrays: tuple[str, ...] = ("input_ids",)) -> DataFrame:
    """The first rows with the shapes of their arrays; sort and limit are one top-k."""
    return df.withColumns({f"{a}_shape": F.size(a) for a in arrays}).orderBy(key).limit(n)


def lookup(df: DataFrame, i: int, key: str = "example_id") -> DataFrame:
    return df.where(F.col(key) == i)
