"""Running totals and latest-value lookups that do not put a whole group into one task.

A group is cut into blocks of positions.  Each block is scanned on its own and
what the blocks before contribute comes from a table with one row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65_536


def _blocked(df: DataFrame, position: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(position) / F.lit(block)).cast("bigint"))


def running_total(df: DataFrame, by: list[str], position: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group before this one."""
    rows = _blocked(df, position, block)
    inside = Window.partitionBy(*by, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.select(*by, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    local = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return (
        rows.withColumn("_local", local)
        .join(blocks, [*by, "_block"])
        .select(*df.columns, (F.col("_local") + F.col("_before")).cast("bigint").alias(out))
    )


def latest_before(
    df: DataFrame, by: list[str], position: str, value: str, tie: str, block: int = BLOCK
) -> DataFrame:
    """Replaces ``value`` by the latest one that is not null and comes earlier in (position, tie)."""
    rows = _blocked(df, position, block)
    inside = Window.partitionBy(*by, "_block").orderBy(position, tie).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    given = F.col(value).isNotNull()
    blocks = rows.groupBy(*by, "_block").agg(
        F.max_by(F.when(given, F.col(value)), F.when(given, F.struct(position, tie))).alias("_last")
    )
    blocks = blocks.select(*by, "_block", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    return (
        rows.withColumn("_local", F.last(value, ignorenulls=True).over(inside))
        .join(blocks, [*by, "_block"])
        .select(
            *[c for c in df.columns if c != value], F.coalesce("_local", "_before").alias(value)
        )
    )
