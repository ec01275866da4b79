"""Event sources.  Every reader yields ``type, content, ts, seq``."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evwarden.functions.members import members, require_event_time

_EVENT_DDL = "type string, content string, ts timestamp, seq bigint"
# A record's position inside its partition takes the low 48 bits of ``seq``.
_PARTITION_SHIFT = 1 << 48


def table_events(df: DataFrame, type: Column | str, ts: Column | str, seq: Column | str, columns: Sequence[str]) -> DataFrame:
    """A typed table as events.  ``content`` is a struct, so only the members in use are read."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(
        as_col(type).alias("type"),
        F.struct(*columns).alias("content"),
        as_col(ts).cast("timestamp").alias("ts"),
        as_col(seq).cast("bigint").alias("seq"),
    )


def memory_events(spark: SparkSession, rows: Iterable[tuple[str, str, Any]]) -> DataFrame:
    """Literal ``(type, content JSON, ts)`` rows in arrival order."""
    data = [(t, content, ts, n) for n, (t, content, ts) in enumerate(rows)]
    return spark.createDataFrame(data, _EVENT_DDL)


def json_file_events(spark: SparkSession, path: str, time_member: str | Mapping[str, str]) -> DataFrame:
    """Files that hold one JSON array of ``{"Type": …, "Content": {…}}`` objects.

    ``seq`` counts the objects in the order of file paths and, inside a file, of the array, however the files are dealt to tasks.
    """
    raw = spark.read.schema("Type string, Content string").json(path, multiLine=True)
    # a file is read by one task, so its objects have consecutive numbers
    raw = raw.select(
        F.col("Type").alias("type"), F.col("Content").alias("content"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")
    )
    files = raw.groupBy("file").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    files = files.select("file", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    return _decoded(raw, time_member).join(files, "file").select("type", "content", "ts", (F.col("place") + F.col("shift")).alias("seq"))


def kafka_options(
    broker: str,
    topics: Sequence[str],
    group_id: str | None = None,
    username: str | None = None,
    password: str | None = None,
    starting_offsets: str | None = None,
) -> dict[str, str]:
    """Options of ``format("kafka")``: SASL_SSL/PLAIN and the latest offsets with a user, else plain and the earliest."""
    opts = {"kafka.bootstrap.servers": broker, "subscribe": ",".join(dict.fromkeys(topics))}
    if group_id:
        opts["kafka.group.id"] = group_id
    if username is not None:
        quoted = [v.replace("\\", "\\\\").replace('"', '\\"') for v in (username, password or "")]
        opts |= {
            "kafka.security.protocol": "SASL_SSL",
            "kafka.sasl.mechanism": "PLAIN",
            "kafka.sasl.jaas.config": (
                "org.apache.kafka.common.security.plain.PlainLoginModule required "
                f'username="{quoted[0]}" password="{quoted[1]}";'
            ),
        }
    opts["startingOffsets"] = starting_offsets or ("earliest" if username is None else "latest")
    return opts


def kafka_events(spark: SparkSession, options: Mapping[str, str], time_member: str | Mapping[str, str]) -> DataFrame:
    """Streaming events from Kafka: record key = type, value = JSON content."""
    return decode_records(spark.readStream.format("kafka").options(**options).load(), time_member)


def decode_records(records: DataFrame, time_member: str | Mapping[str, str]) -> DataFrame:
    """Kafka-shaped rows ``(key, value, partition, offset)`` → events."""
    raw = records.select(
        F.col("key").cast("string").alias("type"),
        F.col("value").cast("string").alias("content"),
        (F.col("partition").cast("bigint") * F.lit(_PARTITION_SHIFT) + F.col("offset")).alias("seq"),
    )
    return _decoded(raw, time_member).select("type", "content", "ts", "seq")


def _decoded(raw: DataFrame, time_member: str | Mapping[str, str]) -> DataFrame:
    """Event time from the content; the member may differ per type."""
    if isinstance(time_member, str):
        text = F.get_json_object("content", "$." + time_member)
    else:
        picks = [
            F.when(F.col("type") == t, F.get_json_object("content", "$." + m)) for t, m in time_member.items()
        ]
        text = F.coalesce(*picks)
    return raw.withColumn("ts", require_event_time(text))


def time_members(aliases: Mapping[str, Any]) -> dict[str, str]:
    """Per event type, the member declared as ``timestamp``."""
    out: dict[str, str] = {}
    for alias in aliases.values():
        for member, kind in alias.schema.items():
            if kind == "timestamp":
                out.setdefault(alias.type, member)
    return out


def union_events(*parts: DataFrame) -> DataFrame:
    """Events of several topics or files as one stream."""
    return reduce(DataFrame.unionByName, parts)


def alias_view(events: DataFrame, type: str, schema: Mapping[str, str]) -> DataFrame:
    """The events of one type with their declared members as typed columns."""
    cols = members(F.col("content"), events.schema["content"].dataType, schema.items())
    return events.filter(F.col("type") == type).select(
        "ts", "seq", *[c.alias(path.replace(".", "_")) for (path, _), c in cols.items()]
    )
