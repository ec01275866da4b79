"""Windowed counts, and sources that run at different pace."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_POLICY = "spark.sql.streaming.multipleWatermarkPolicy"


def windowed_counts(events: DataFrame, by: str, width: str = "5 seconds", lateness: str | None = "5 seconds") -> DataFrame:
    """Count per tumbling window and value of ``by``; a window appears once the watermark has passed its end.

    ``lateness=None`` takes the watermark that ``events`` already have.
    """
    stamped = events if lateness is None else events.withWatermark("ts", lateness)
    return (
        stamped.groupBy(F.window("ts", width).alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")
    )


def sources_together(sources: Sequence[DataFrame], lateness: str | Sequence[str] = "5 seconds") -> DataFrame:
    """Streams with a watermark each, as one. Started under :func:`latest_watermark`, the one furthest ahead decides and idle ones hold nothing back."""
    bounds = [lateness] * len(sources) if isinstance(lateness, str) else list(lateness)
    return reduce(DataFrame.unionByName, [s.withWatermark("ts", b) for s, b in zip(sources, bounds, strict=True)])


def use_latest_watermark(spark: SparkSession) -> None:
    """With several sources, follow the one furthest ahead, so an idle source does not hold back the rest."""
    spark.conf.set(_POLICY, "max")


@contextmanager
def latest_watermark(spark: SparkSession) -> Iterator[None]:
    """Queries started inside follow the source furthest ahead; a checkpoint keeps the policy that it began with."""
    before = spark.conf.get(_POLICY, "min")
    use_latest_watermark(spark)
    try:
        yield
    finally:
        spark.conf.set(_POLICY, before)
