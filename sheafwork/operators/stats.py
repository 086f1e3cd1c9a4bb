"""Length statistics of a corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reported percentiles.
PERCENTILES = (10, 50, 80, 90, 95, 97, 98, 99)


def _report(row: DataFrame, groups: Sequence[str], percentiles: Sequence[int]) -> DataFrame:
    """Long form (statistic, value) of one aggregate row per group."""
    names = ["shortest", *[f"p{p}" for p in percentiles], "longest"]
    values = F.concat(F.array("lo"), F.col("ps"), F.array("hi"))
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("statistic"), values.alias("value"))
    return row.select(*groups, F.inline(pairs).alias("statistic", "value"))


def length_percentiles(
    df: DataFrame, n: str = "n", percentiles: Sequence[int] = PERCENTILES, groups: Sequence[str] = ()
) -> DataFrame:
    """Shortest, interpolated percentiles to one decimal (half to even), longest.

    ``percentile`` keeps a count per distinct length, so its state is bounded by the
    longest row and merges map-side.
    """
    shares = F.array(*[F.lit(p / 100) for p in percentiles])
    row = df.groupBy(*groups).agg(
        F.min(n).cast("double").alias("lo"),
        F.transform(F.percentile(n, shares), lambda v: F.bround(v, 1)).alias("ps"),
        F.max(n).cast("double").alias("hi"),
    )
    return _report(row, groups, percentiles)


def length_percentiles_approx(
    df: DataFrame,
    n: str = "n",
    percentiles: Sequence[int] = PERCENTILES,
    groups: Sequence[str] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """The same report from a sketch of fixed size; percentiles are observed lengths."""
    row = df.groupBy(*groups).agg(
        F.min(n).cast("double").alias("lo"),
        F.percentile_approx(n, [p / 100 for p in percentiles], accuracy).cast("array<double>").alias("ps"),
        F.max(n).cast("double").alias("hi"),
    )
    return _report(row, groups, percentiles)


#: Sketches hold a group's lengths exactly up to so many rows; beyond, ranks are off by a few parts in this number.
SKETCH_SIZE = 4096


def length_sketches(df: DataFrame, n: str = "n", groups: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """``groups`` and ``sketch``: a quantile sketch (KLL) of each group's lengths, to be stored and merged later.

    Its bytes are bounded by ``size`` and the logarithm of the rows, so a group that holds a third of
    all rows is combined before the shuffle like any other.
    """
    return df.groupBy(*groups).agg(F.kll_sketch_agg_bigint(F.col(n).cast("long"), F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, groups: Sequence[str] = (), size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of parts (days, shards, sources) as one for each group, without reading the corpus again."""
    return sketches.groupBy(*groups).agg(F.kll_merge_agg_bigint("sketch", F.lit(size)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, percentiles: Sequence[int] = PERCENTILES, groups: Sequence[str] = ()) -> DataFrame:
    """Shortest, percentiles and longest of each sketch; percentiles are observed lengths, null lengths don't count.

    The ends are exact always, the percentiles while a group has no more rows than the sketch's size.
    A sketch without rows gives no row.
    """
    ranks = [0.0, *[p / 100 for p in percentiles], 1.0]
    filled = sketches.where(F.kll_sketch_get_n_bigint("sketch") > 0)
    values = F.kll_sketch_get_quantile_bigint("sketch", F.array(*map(F.lit, ranks))).cast("array<double>")
    row = filled.select(*groups, values.alias("v")).select(
        *groups, F.get("v", F.lit(0)).alias("lo"), F.slice("v", 2, len(percentiles)).alias("ps"), F.element_at("v", -1).alias("hi")
    )
    return _report(row, groups, percentiles)


def share_below(df: DataFrame, limit: int, n: str = "n", groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg((F.col(n) < limit).cast("double")).alias("share"))


def row_count(df: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(F.count("*").alias("n_rows"))


def truncation_loss(df: DataFrame, max_len: int, n: str = "n", groups: Sequence[str] = ()) -> DataFrame:
    """Share of rows, and of ids, that a length limit cuts; a group without ids loses none."""
    over: Column = F.greatest(F.col(n) - max_len, F.lit(0))
    return df.groupBy(*groups).agg(
        F.avg((F.col(n) > max_len).cast("double")).alias("rows_cut"),
        F.coalesce(F.try_divide(F.sum(over), F.sum(n)), F.lit(0.0)).alias("ids_cut"),
    )
