"""Running sums along a total order, overall and within groups, without one task for the whole table or a group."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafwork.llm.common import keep


def running(df: DataFrame, group: str, order: Sequence[str], weight: Column, folder: str, name: str) -> DataFrame:
    """Add ``before``, ``inside`` and ``total``: sums of ``weight`` ahead of a row in its group, and of its whole group.

    ``before`` is the sum over all smaller groups and the earlier rows of the own one, ``inside`` the part
    of it within the group. Rows are cut into ranges of (``group``, ``order``), nulls first; each range is
    summed by one task, and ranges and groups are put together from one row for each range and group
    that meet. A group of any size spreads over ranges. Rows that tie in ``order`` follow each other in
    no fixed sequence, so whatever tells rows apart belongs into it.
    """
    mark = uuid.uuid4().hex[:8]
    part, own, ahead = f"part_{mark}", f"own_{mark}", f"ahead_{mark}"
    keys = [group, *order]
    ranged = keep(df.withColumn(own, weight.cast("long")).repartitionByRange(*keys).withColumn(part, F.spark_partition_id()), folder, name)
    earlier = Window.partitionBy(part).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn(ahead, F.coalesce(F.sum(own).over(earlier), F.lit(0)))
    # One row for each group in a range; where a range starts comes from one row for each range.
    meets = ranged.groupBy(part, group).agg(F.sum(own).alias("sum"))
    ranges = meets.groupBy(part).agg(F.sum("sum").alias("sum"))
    start = F.coalesce(F.sum("sum").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.select(part, start.alias("start"))
    in_range = Window.partitionBy(part).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    meets = meets.withColumn("inner", F.coalesce(F.sum("sum").over(in_range), F.lit(0))).join(starts, part)
    of_group = Window.partitionBy(group)
    meets = meets.select(
        part,
        F.col(group).alias(f"group_{mark}"),
        F.col("start").alias(f"start_{mark}"),
        F.min(F.col("start") + F.col("inner")).over(of_group).alias(f"first_{mark}"),
        F.sum("sum").over(of_group).alias(f"total_{mark}"),
    )
    meets = keep(meets.withColumnRenamed(part, f"of_{mark}"), folder, f"{name}-groups")
    same = (F.col(part) == F.col(f"of_{mark}")) & F.col(group).eqNullSafe(F.col(f"group_{mark}"))
    before = F.col(f"start_{mark}") + F.col(ahead)
    return summed.join(meets, same).select(
        *df.columns, before.alias("before"), (before - F.col(f"first_{mark}")).alias("inside"), F.col(f"total_{mark}").alias("total")
    )
