"""The supplied tables as DataFrames and as events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evwarden.model import Alias
from evwarden.sources.events import table_events

Query = Callable[[SparkSession, str], DataFrame]

MEMBERS = {"user_id": "number", "value": "number"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # the Parquet times carry no zone; all of them are read as UTC
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def user_events(spark: SparkSession, sf: str) -> DataFrame:
    return table_events(table(spark, sf, "events"), "event_type", "ts", "event_id", ["user_id", "value"])


def json_events(spark: SparkSession, sf: str) -> DataFrame:
    """The same events with their content as JSON text."""
    df = table(spark, sf, "events")
    return df.select(
        F.col("event_type").alias("type"),
        F.col("props").alias("content"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def user_aliases(**types: str) -> dict[str, Alias]:
    return {name: Alias(t, MEMBERS) for name, t in types.items()}


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))
