"""Row order: positions, earlier rows and running sums without a one-task window.

A DataFrame has no order, so every order-sensitive call names a unique key. ``with_order`` sorts by ranges and numbers the
rows from 0 with one small table of counts a partition; the sorted rows are checkpointed in the shared folder, so that numbering
and later steps see one and the same partitioning even if an executor is lost. Windows then run within chunks of ``chunk_rows``
positions: rows that a chunk needs from the one before come with it as copies, and sums carry the totals of the chunks before,
which are summed in two levels, so that no window sees more than a 4096th of a 4096th of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colform.session import checkpointed

CHUNK_ROWS = 4096
#: Chunks that make one of the second level.
CHUNKS = 4096


def with_order(df: DataFrame, keys: list[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds _rn (position from 0 by ``keys``) and _chunk."""
    ordered = checkpointed(df.orderBy(*keys).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    # One row a partition: bounded by the number of partitions.
    numbered = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    rn = (F.col("_off") + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")
    return numbered.withColumn("_rn", rn).withColumn("_chunk", F.floor(F.col("_rn") / chunk_rows).cast("long")).drop("_mid", "_part", "_off")


def with_lags(ordered: DataFrame, columns: list[str], depth: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds <column>_lag1.. of the rows before in the whole order."""
    tail = F.pmod(F.col("_rn"), F.lit(chunk_rows)) >= chunk_rows - depth
    own = ordered.withColumn("_own", F.lit(True))
    halo = ordered.where(tail).withColumn("_chunk", F.col("_chunk") + 1).withColumn("_own", F.lit(False))
    w = Window.partitionBy("_chunk").orderBy("_rn")
    lags = {f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in range(1, depth + 1)}
    return own.unionByName(halo).withColumns(lags).where("_own").drop("_own")


def running_sum(ordered: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one."""
    valued = ordered.withColumn("_value", value)
    totals = valued.groupBy("_chunk").agg(F.sum("_value").alias("_total"))
    carried = before_each(totals, "_chunk", "_total", "_carried")
    w = Window.partitionBy("_chunk").orderBy("_rn").rowsBetween(Window.unboundedPreceding, 0)
    return valued.join(carried, "_chunk").withColumn(name, F.sum("_value").over(w) + F.col("_carried")).drop("_value", "_carried")


def before_each(totals: DataFrame, position: str, value: str, name: str) -> DataFrame:
    """(position, sum of the values at smaller positions), in two levels: the positions of a group, and the groups."""
    group = F.floor(F.col(position) / CHUNKS).cast("long")
    grouped = totals.select(position, value).withColumn("_group", group)
    groups = grouped.groupBy("_group").agg(F.sum(value).alias("_whole"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.coalesce(F.sum("_whole").over(earlier(Window.orderBy("_group"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum(value).over(earlier(Window.partitionBy("_group").orderBy(position))), F.lit(0))
    return grouped.withColumn("_inside", inside).join(groups, "_group").select(position, (F.col("_inside") + F.col("_before")).alias(name))


def last_before_each(lasts: DataFrame, position: str, value: str, name: str) -> DataFrame:
    """(position, largest value at smaller positions, or null), for values that rise with the position; in two levels."""
    group = F.floor(F.col(position) / CHUNKS).cast("long")
    grouped = lasts.select(position, value).withColumn("_group", group)
    groups = grouped.groupBy("_group").agg(F.max(value).alias("_whole"))
    groups = groups.select("_group", F.lag("_whole").over(Window.orderBy("_group")).alias("_before"))
    inside = F.lag(value).over(Window.partitionBy("_group").orderBy(position))
    return grouped.withColumn("_inside", inside).join(groups, "_group").select(position, F.coalesce("_inside", "_before").alias(name))
