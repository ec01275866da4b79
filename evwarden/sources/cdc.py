"""Change-data-capture envelopes as events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ENVELOPE = (
    "payload struct<before: string, after: string, op: string, ts_ms: bigint, "
    "source: struct<db: string, collection: string, `table`: string>>"
)


def cdc_events(records: DataFrame, value: str = "value", seq: str = "seq") -> DataFrame:
    """``{"payload": {"after": "…", "op": "c", "ts_ms": …}}`` → ``type, content, ts, seq``.

    The type is ``collection.operation``; a delete carries the row it removed.
    The ``after`` document is JSON inside a string and is passed on as content.
    """
    p = F.from_json(F.col(value).cast("string"), _ENVELOPE)["payload"]
    return records.select(p.alias("p"), F.col(seq).cast("bigint").alias("seq")).select(
        F.concat_ws(".", F.coalesce("p.source.collection", "p.source.table"), "p.op").alias("type"),
        F.coalesce("p.after", "p.before").alias("content"),
        F.timestamp_millis("p.ts_ms").alias("ts"),
        "seq",
    ).filter(F.col("content").isNotNull())
