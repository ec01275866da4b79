"""Where violations go: Kafka, log records, console, memory."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

DEFAULT_TOPIC = "violations"


def kafka_records(found: DataFrame) -> DataFrame:
    """``key`` = invariant name, ``value`` = the violation as JSON, for ``format("kafka")``."""
    return found.select(F.col("invariant").alias("key"), F.to_json(F.struct("*")).alias("value"))


def to_kafka(found: DataFrame, options: Mapping[str, str], checkpoint: str, topic: str = DEFAULT_TOPIC) -> DataStreamWriter:
    """Writer for a violation stream; delivery is at least once."""
    return (
        kafka_records(found)
        .writeStream.format("kafka")
        .options(**{k: v for k, v in options.items() if k.startswith("kafka.")})
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def full_matches(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'full'")


def timed_out(found: DataFrame) -> DataFrame:
    """The side output: violations of prefix clauses."""
    return found.filter("kind = 'timeout'")


def log_records(found: DataFrame, template: str = "Invariant {InvariantName} violated: {Match}") -> DataFrame:
    """Compact log events: ``{"@t": …, "@mt": …, "@l": "Information", arguments…}`` in column ``value``."""
    stamp = F.date_format(F.coalesce("end_ts", "start_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return found.select(
        F.to_json(
            F.struct(
                stamp.alias("@t"),
                F.lit(template).alias("@mt"),
                F.lit("Information").alias("@l"),
                F.coalesce("invariant", F.lit("")).alias("InvariantName"),
                F.col("kind").alias("Kind"),
                F.coalesce("match", F.lit("")).alias("Match"),
            )
        ).alias("value")
    )


def to_files(found: DataFrame, path: str, checkpoint: str, format: str = "parquet") -> DataStreamWriter:
    """File sink; with its checkpoint every violation is written once."""
    return (
        found.writeStream.format(format)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def to_console(found: DataFrame) -> DataStreamWriter:
    return found.writeStream.format("console").option("truncate", False).outputMode("append")


def to_memory(found: DataFrame, name: str, mode: str = "append") -> DataStreamWriter:
    return found.writeStream.format("memory").queryName(name).outputMode(mode)
