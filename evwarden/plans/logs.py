"""Counts over execution and violation logs.

``logs(ts, message, event_type, invariant, transaction_template)``; each
function needs only the columns it names.  The same functions run on batch and
streaming frames (add a watermark for the latter).
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.operators.running import BLOCK, running_total

# Fixed messages of the log records.
STARTED = "Starting to execute transaction"
TRANSACTION_FINISHED = "%Transaction finished%"
INVARIANT_VIOLATED = "%Invariant%"


def message_like(*patterns: str) -> Column:
    out = F.col("message").like(patterns[0])
    for p in patterns[1:]:
        out = out | F.col("message").like(p)
    return out


def count_per_window(logs: DataFrame, by: str, width: str = "5 seconds", patterns: Sequence[str] = ()) -> DataFrame:
    """Events per value of ``by`` and tumbling window."""
    rows = logs.filter(message_like(*patterns)) if patterns else logs
    return (
        rows.groupBy(F.window("ts", width).alias("w"), by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")
    )


def first_rows(counts: DataFrame, by: str, limit: int | None) -> DataFrame:
    """The LIMIT of a window report, in a fixed order; all rows, in no order, without one."""
    return counts if limit is None else counts.orderBy("window_start", by).limit(limit)


def violations_per_window(logs: DataFrame, width: str = "5 seconds", limit: int | None = None) -> DataFrame:
    return first_rows(count_per_window(logs, "invariant", width, ["%invariant%", INVARIANT_VIOLATED]), "invariant", limit)


def types_per_window(logs: DataFrame, width: str = "5 seconds", limit: int | None = None) -> DataFrame:
    counts = count_per_window(logs, "event_type", width, [TRANSACTION_FINISHED, INVARIANT_VIOLATED])
    return first_rows(counts, "event_type", limit)


def count_by(logs: DataFrame, column: str, *patterns: str) -> DataFrame:
    rows = logs.filter(message_like(*patterns)) if patterns else logs
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def count_by_message(logs: DataFrame) -> DataFrame:
    return count_by(logs, "message", TRANSACTION_FINISHED, INVARIANT_VIOLATED)


def started_by_template(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("message") == STARTED).groupBy("transaction_template").agg(F.count("*").alias("n"))


def violations_by_invariant(logs: DataFrame) -> DataFrame:
    return count_by(logs, "invariant", INVARIANT_VIOLATED)


def share_by_type(logs: DataFrame) -> DataFrame:
    """Count and share per event type; the window runs over one row per type."""
    counts = count_by(logs, "event_type", TRANSACTION_FINISHED, INVARIANT_VIOLATED)
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def elapsed(logs: DataFrame, percentiles: Sequence[float] = (0.5, 0.95, 0.99), block: int = BLOCK) -> DataFrame:
    """Duration figures per kind from ``<Kind> finished in N milliseconds``.

    Percentiles are exact: the least duration that at least this share of the durations does not exceed. Durations are counted by value,
    and running counts over blocks of values show which value holds a rank, so no kind is sorted in one task.
    """
    pattern = r"^(Operation|Transaction) finished in (\d+) milliseconds$"
    rows = logs.select(
        F.regexp_extract("message", pattern, 1).alias("kind"),
        F.regexp_extract("message", pattern, 2).try_cast("bigint").alias("ms"),
    ).filter("ms is not null")
    counts = rows.groupBy("kind", "ms").agg(F.count("*").alias("rows"))
    figures = [F.sum("rows").alias("n"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"), F.sum(F.col("ms") * F.col("rows")).alias("sum_ms")]
    totals = counts.groupBy("kind").agg(*figures)
    ranked = running_total(counts, ["kind"], "ms", "rows", "before", block).join(totals, "kind")
    picked = []
    for p in percentiles:
        rank = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(Decimal(str(p)))))
        here = (F.col("before") < rank) & (rank <= F.col("before") + F.col("rows"))
        picked.append(F.max(F.when(here, F.col("ms"))).alias(f"p{round(p * 100)}_ms"))
    return ranked.groupBy("kind", "n", "min_ms", "max_ms", "sum_ms").agg(*picked)
