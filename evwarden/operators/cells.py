"""Splitting hot keys into time-ordered cells.

Matching orders the events of one key.  A key that holds a large part of the
data must not become one task, so its events are cut into consecutive cells of
about ``cell_rows`` events.  Keys below that size stay in one piece and cost
nothing extra; whether there are larger ones is found out by a count with
map-side combine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.sinks.scratch import stored

COLD = -1
_NULL_KEY_SALTS = 1024
# Hot keys number at most total_rows / cell_rows; beyond this many the hint is left out.
_BROADCAST_HOT_KEYS = 100_000


@dataclass(frozen=True)
class CellOptions:
    """``cell_rows``: events per cell.  ``grain_us``: events closer than this stay in one cell.

    ``enabled=False`` skips the check for inputs known to have no hot key.
    """

    cell_rows: int = 1_000_000
    grain_us: int = 1_000_000
    enabled: bool = True


def _cold(keys: list[str]) -> Column:
    """Cell of a row whose key is not hot.  Rows without a key never meet another event: spread them."""
    if not keys:
        return F.lit(COLD).cast("long")
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return F.when(missing, F.lit(COLD - 1) - F.pmod(F.xxhash64("us", "seq"), F.lit(_NULL_KEY_SALTS))).otherwise(
        F.lit(COLD)
    ).cast("long")


# Added to slices of time so that none is negative, whatever the era.
_ERA = 1 << 40
_SLICES_PER_LIMIT = 1024


def time_slices(ev: DataFrame, within_us: int | None, opts: CellOptions) -> DataFrame:
    """Adds ``cell`` for patterns without a key: slices of time, a thousandth of the limit wide, not counted first."""
    width = max(opts.grain_us, (within_us or 3_600_000_000) // _SLICES_PER_LIMIT)
    return ev.withColumn("cell", F.floor(F.col("us") / F.lit(width)).cast("long") + F.lit(_ERA))


def assign_cells(
    ev: DataFrame, keys: list[str], opts: CellOptions, within_us: int | None = None
) -> tuple[DataFrame, bool]:
    """Adds ``cell``: -1 for ordinary keys, 0, 1, … in time order for hot ones; slices of time if there is no key."""
    if not keys and opts.enabled:
        return time_slices(ev, within_us, opts), True
    hot, n_hot = _hot_keys(ev, keys, opts)
    if not n_hot:
        return ev.withColumn("cell", _cold(keys)), False
    cells = _cells(ev, keys, hot, n_hot, opts).select(*keys, "grain", "cell")
    hot_rows, cold_rows = _split(ev, keys, hot, n_hot, opts)
    return hot_rows.join(cells, [*keys, "grain"]).drop("grain").unionByName(cold_rows), True


def assign_cells_with_halo(
    ev: DataFrame, keys: list[str], within_us: int | None, opts: CellOptions
) -> tuple[DataFrame, bool]:
    """As :func:`assign_cells`, but every cell also receives the later events its own starts may need.

    ``own`` tells the events of the cell from those lent to it.
    """
    hot, n_hot = _hot_keys(ev, keys, opts)
    if not n_hot:
        return ev.withColumn("cell", _cold(keys)).withColumn("own", F.lit(True)), False
    cells = _cells(ev, keys, hot, n_hot, opts)
    bounds = cells.groupBy(*keys, "cell").agg(F.min("grain").alias("lo"), F.max("grain").alias("hi"))
    if within_us is None:
        first = bounds.select(*keys, "cell", F.lit(0).cast("long").alias("first"))
    else:
        # A cell is past once its last possible start has timed out.  Counting the past
        # cells at the begin of each cell gives the first cell that still needs it.
        marks = bounds.select(
            *keys, "cell", ((F.col("hi") + 1) * opts.grain_us + within_us).alias("at"), F.lit(0).alias("is_begin")
        ).unionByName(bounds.select(*keys, "cell", (F.col("lo") * opts.grain_us).alias("at"), F.lit(1).alias("is_begin")))
        w = Window.partitionBy(*keys).orderBy("at", "is_begin", "cell").rowsBetween(Window.unboundedPreceding, 0)
        first = (
            marks.withColumn("first", F.sum((F.col("is_begin") == 0).cast("long")).over(w))
            .filter("is_begin = 1")
            .select(*keys, "cell", F.least("first", "cell").alias("first"))
        )
    spread = cells.select(*keys, "grain", "cell").join(first, [*keys, "cell"]) if keys else cells.select(
        "grain", "cell"
    ).join(first, ["cell"])
    hot_rows, cold_rows = _split(ev, keys, hot, n_hot, opts)
    lent = (
        hot_rows.join(spread.withColumnRenamed("cell", "home"), [*keys, "grain"])
        .withColumn("cell", F.explode(F.sequence("first", "home")))
        .withColumn("own", F.col("cell") == F.col("home"))
        .drop("grain", "home", "first")
    )
    return lent.unionByName(cold_rows.withColumn("own", F.lit(True))), True


def _hot_keys(ev: DataFrame, keys: list[str], opts: CellOptions) -> tuple[DataFrame | None, int]:
    """Keys above ``cell_rows``; kept as a small table, because several joins read it."""
    if not opts.enabled:
        return None, 0
    present = ev.select(*keys).dropna(how="any") if keys else ev.select()
    hot = present.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > opts.cell_rows).drop("n")
    n_hot = hot.count()
    return (stored(hot, "hot-keys") if n_hot and keys else hot), n_hot


def _grain(opts: CellOptions) -> Column:
    return F.floor(F.col("us") / F.lit(opts.grain_us)).cast("long")


def _split(
    ev: DataFrame, keys: list[str], hot: DataFrame, n_hot: int, opts: CellOptions
) -> tuple[DataFrame, DataFrame]:
    if not keys:
        return ev.withColumn("grain", _grain(opts)), ev.withColumn("cell", _cold(keys)).filter(F.lit(False))
    side = F.broadcast(hot) if n_hot <= _BROADCAST_HOT_KEYS else hot
    hot_rows = ev.join(side, keys, "left_semi").withColumn("grain", _grain(opts))
    return hot_rows, ev.join(side, keys, "left_anti").withColumn("cell", _cold(keys))


def _cells(ev: DataFrame, keys: list[str], hot: DataFrame, n_hot: int, opts: CellOptions) -> DataFrame:
    """``keys, grain, cell`` for the hot keys: grains in time order, cut at multiples of ``cell_rows``."""
    rows, _ = _split(ev, keys, hot, n_hot, opts)
    grains = rows.groupBy(*keys, "grain").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("grain")
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    cut = grains.withColumn("cut", F.floor(before / opts.cell_rows))
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("cut")) - 1
    return stored(cut.select(*keys, "grain", rank.cast("long").alias("cell")), "cells")
