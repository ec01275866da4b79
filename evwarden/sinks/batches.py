"""Delivery of a stream into folders, each batch once, and late rows beside those in time.

Every attempt at a batch writes a folder of its own.  A row of the manifest, added when the folder is complete, makes it
visible; of several attempts at one batch the last one counts.  Nothing is ever replaced in place, so a reader sees a batch whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from evwarden.model import duration_us

_MANIFEST = "batch bigint, attempt string, at timestamp, rows bigint, latest_us bigint"


def to_batches(found: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch of ``found`` in a folder below ``path``; a batch that runs again replaces itself."""
    return found.writeStream.foreachBatch(lambda batch, n: write_batch(batch, n, path)).option("checkpointLocation", checkpoint)


def write_batch(batch: DataFrame, n: int, path: str) -> None:
    """One attempt at batch ``n``: its rows first, then its line in the manifest."""
    attempt = uuid.uuid4().hex
    batch.write.parquet(f"{path}/data/batch={n}/attempt={attempt}")
    _enter(batch.sparkSession, path, n, attempt, F.lit(None))


def _enter(spark: SparkSession, path: str, n: int, attempt: str, latest_us) -> None:
    written = _data(spark, f"{path}/data/batch={n}/attempt={attempt}", None)
    line = written.agg(F.count("*").alias("rows"), F.max(latest_us).cast("bigint").alias("latest_us"))
    line = line.select(F.lit(n).cast("bigint").alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("at"), "rows", "latest_us")
    line.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def _data(spark: SparkSession, path: str, schema) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(batch, attempt, at, rows, latest_us): the attempt that counts of each batch."""
    lines = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    last = F.max_by(F.struct("attempt", "at", "rows", "latest_us"), F.struct("at", "attempt")).alias("last")
    return lines.groupBy("batch").agg(last).select("batch", "last.*")


def read_batches(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of all complete batches below ``path``, each once; ``schema`` is that of the stream."""
    known = manifest(spark, path).select("batch", "attempt")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = _data(spark, f"{path}/data", f"{columns}, batch bigint, attempt string")
    return rows.join(known, ["batch", "attempt"], "left_semi").select(*[f.name for f in schema.fields])


def split_late(events: DataFrame, lateness: str, path: str, checkpoint: str) -> DataStreamWriter:
    """Each batch of ``events(…, ts, …)`` in folders below ``path``, with ``late``: behind the watermark when its batch began.

    The watermark is that of Spark's stateful operators: the latest time of the batches before, in milliseconds, less ``lateness``.
    Rows in time and late ones together are the input; :func:`in_time` and :func:`late_rows` read them.
    """
    behind_us = duration_us(lateness)

    def write(batch: DataFrame, n: int) -> None:
        spark, attempt = batch.sparkSession, uuid.uuid4().hex
        late = F.lit(False)
        if n > 0:
            passed = manifest(spark, path).where(F.col("batch") < n).agg(F.max("latest_us")).first()[0]
            if passed is not None:
                late = F.coalesce(F.unix_micros("ts") <= F.lit(passed // 1000 * 1000 - behind_us), F.lit(False))
        batch.withColumn("late", late).write.parquet(f"{path}/data/batch={n}/attempt={attempt}")
        _enter(spark, path, n, attempt, F.unix_micros("ts"))

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def _split(spark: SparkSession, path: str, schema, late: bool) -> DataFrame:
    rows = read_batches(spark, path, type(schema)([*schema.fields]).add("late", "boolean"))
    return rows.where(F.col("late") == late).drop("late")


def in_time(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows that were not behind the watermark."""
    return _split(spark, path, schema, False)


def late_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """The side output: rows behind the watermark, which stateful operators drop."""
    return _split(spark, path, schema, True)
