"""Random draws as column expressions.

A *raw* column holds an integer in ``[0, 2^31)``; every distribution is integer
arithmetic on it, so a draw depends on ids and seed only, not on partitioning,
and a lost task repeats the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evwarden.sinks.scratch import stored

RAW_RANGE = 1 << 31
_ZIPF_SCALE = 1_000_000_000


def hashed_raw(seed: int, *parts: Column | str) -> Column:
    """Raw draw from a seed and the ids of a row."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(RAW_RANGE)).cast("bigint")


def lcg_raw(id: Column | str) -> Column:
    """Raw draw by one step of a linear congruential generator."""
    col = F.col(id) if isinstance(id, str) else id
    return F.pmod(F.pmod(col.cast("bigint"), F.lit(RAW_RANGE)) * F.lit(1103515245) + F.lit(12345), F.lit(RAW_RANGE))


def uniform_int(raw: Column, low: int | None = None, high: int | None = None) -> Column:
    """Integer in ``[low, high)``; without both bounds in ``[0, 2^31 - 1)``."""
    if low is None or high is None:
        low, high = 0, RAW_RANGE - 1
    if high <= low:
        return F.lit(low).cast("bigint")
    width = F.lit(high - low).cast("bigint")
    # raw * width stays below 2^62 for any 32-bit bounds
    return F.floor(F.shiftright(raw * width, 31)).cast("bigint") + F.lit(low)


def sample(raw: Column, space: Sequence[str]) -> Column:
    """One of a fixed list of strings."""
    values = F.array(*[F.lit(v) for v in space])
    return F.element_at(values, (F.pmod(raw, F.lit(len(space))) + 1).cast("int"))


def guid(*parts: Column | str) -> Column:
    """Reproducible UUID-shaped text from the ids of a row."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    digest = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def dense_counter(df: DataFrame, id: str, out: str, start: int = 0) -> DataFrame:
    """Adds ``out`` = start, start + 1, … without gaps, in the order of a unique ``id``.

    Rows are dealt by range of ``id``, sorted and written with their place in their
    range; a place is shifted by the sizes of the ranges before, one row for each range.
    """
    order = df.repartitionByRange(id).sortWithinPartitions(id).withColumn("_place", F.monotonically_increasing_id())
    placed = stored(order, "counter").withColumn("_range", F.shiftright("_place", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")
    offsets = sizes.select("_range", before.alias("_before"))
    number = F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + F.lit(start)
    # a row for each task that sorted
    return placed.join(F.broadcast(offsets), "_range").withColumn(out, number).drop("_range", "_before", "_place")


def zipf_table(spark: SparkSession, ranks: int, exponent: float = 1.0) -> DataFrame:
    """``rank, low, high``: rank r owns the weights ``[low, high)``."""
    weight = F.floor(F.lit(_ZIPF_SCALE) / F.pow(F.col("rank").cast("double"), F.lit(exponent))).cast("bigint")
    weighted = (
        spark.range(1, ranks + 1)
        .select(F.col("id").alias("rank"), F.shiftright(F.col("id") - 1, 12).alias("block"))
        .withColumn("weight", weight)
    )
    running = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    # Running sum in two levels: inside blocks of 4096 ranks, then over the block sums.
    sums = weighted.groupBy("block").agg(F.sum("weight").alias("size"))
    before = F.sum("size").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    inside = F.sum("weight").over(running.partitionBy("block"))
    high = F.col("before") + F.col("inside")
    return (
        weighted.withColumn("inside", inside)
        .join(sums.select("block", before.alias("before")), "block")
        .select("rank", (high - F.col("weight")).alias("low"), high.alias("high"))
    )


def zipf(df: DataFrame, raw: str, ranks: int, out: str, exponent: float = 1.0) -> DataFrame:
    """Adds ``out``: a rank in ``1..ranks`` drawn with probability proportional to ``1 / rank^exponent``.

    The weight axis is cut into equal slots, each listing the ranks that touch
    it; a draw looks up its slot by an equi-join and keeps the one rank whose
    range holds it.  Draws spread evenly over slots, so no slot is hot.
    """
    slots = max(ranks, 64)
    table = zipf_table(df.sparkSession, ranks, exponent)
    total = table.agg(F.max("high")).scalar()

    def slot(at: Column) -> Column:
        return F.floor(at * F.lit(slots) / total).cast("bigint")

    side = table.select(
        F.col("rank").alias(out),
        F.col("low").alias("_low"),
        F.col("high").alias("_high"),
        F.explode(F.sequence(slot(F.col("low")), slot(F.col("high") - 1))).alias("_slot"),
    )
    # raw * total / 2^31 from the two halves of the total: exact, and no product passes 2^63
    halves = F.shiftright(total, 31), total.bitwiseAND(F.lit(RAW_RANGE - 1))
    at = F.col(raw) * halves[0] + F.shiftright(F.col(raw) * halves[1], 31)
    drawn = df.withColumn("_at", at).withColumn("_slot", slot(F.col("_at")))
    inside = (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))
    return drawn.join(side, "_slot").filter(inside).select(*df.columns, out)
