"""Concatenate rows and cut the stream of ids into equal blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.operators.sampling import id_bucketed, running_start


def _cut_blocks(df: DataFrame, block_size: int, groups: Sequence[str], order: str, ids: str, offset: str) -> DataFrame:
    """Blocks from rows that know their start in the stream.

    A row is cut into one slice per block it touches, so ids travel as arrays and never as
    one row per id. A group is one block: at most ``block_size`` ids.
    """
    start, size = F.col(offset), F.size(ids)
    first = F.floor(start / block_size)
    last = F.floor((start + size - 1) / block_size)
    slices = df.where(size > 0).select(
        *groups, order, offset, ids, F.explode(F.sequence(first, last)).alias("block_id")
    )
    begin = F.greatest(F.col("block_id") * block_size, start)
    end = F.least((F.col("block_id") + 1) * block_size, start + size)
    piece = F.slice(ids, (begin - start + 1).cast("int"), (end - begin).cast("int"))
    blocks = (
        slices.select(*groups, "block_id", F.struct(begin.alias("at"), piece.alias("ids")).alias("piece"))
        .groupBy(*groups, "block_id")
        .agg(F.flatten(F.array_sort(F.collect_list("piece"))["ids"]).alias("input_ids"))
    )
    # a short block is the tail, unless it is all that its batch holds
    return blocks.where((F.size("input_ids") == block_size) | (F.col("block_id") == 0)).withColumn(
        "labels", F.col("input_ids")
    )


def pack_blocks(
    df: DataFrame, block_size: int, batch: str = "batch_id", order: str = "example_id", ids: str = "input_ids"
) -> DataFrame:
    """Blocks within each map batch, which is bounded by its number of rows.

    The batch window and the regroup share one shuffle.
    """
    earlier = Window.partitionBy(batch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.select(batch, order, ids).withColumn(
        "__offset", F.coalesce(F.sum(F.size(ids)).over(earlier), F.lit(0)).cast("bigint")
    )
    return _cut_blocks(placed, block_size, [batch], order, ids, "__offset")


def pack_blocks_global(
    df: DataFrame, block_size: int, order: str = "example_id", ids: str = "input_ids", length: Column | None = None
) -> DataFrame:
    """Blocks over the whole table as one stream, by the running total of row lengths.

    Only (``order``, length) is sorted; the arrays join the finished offsets. ``length``
    may give the number of ids without making them, so that they are made once.
    """
    size = F.size(ids) if length is None else length
    narrow = id_bucketed(df.select(order, size.alias("__size")), order)
    offsets = running_start(narrow, order, F.col("__size")).select(order, F.col("start").alias("__offset"))
    return _cut_blocks(df.select(order, ids).join(offsets, order), block_size, [], order, ids, "__offset")
