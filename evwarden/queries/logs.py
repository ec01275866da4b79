"""Log analytics on log rows derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evwarden.operators import check_all
from evwarden.plans import logs as L
from evwarden.queries.sequences import CHECKED, purchase_after_signup, timely_purchase
from evwarden.queries.tables import table, user_events
from evwarden.sinks.violations import log_records


def event_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Every event as a log record of the kind its type stands for."""
    df = table(spark, sf, "events")
    kind, ms = F.col("event_type"), F.floor(F.col("value") * 10).cast("bigint").cast("string")
    name = F.concat(F.lit("inv_"), F.pmod("user_id", F.lit(7)).cast("string"))
    message = (
        F.when(kind == "click", L.STARTED)
        .when(kind == "view", F.concat(F.lit("Operation finished in "), ms, F.lit(" milliseconds")))
        .when(kind == "purchase", F.concat(F.lit("Transaction finished in "), ms, F.lit(" milliseconds")))
        .when(kind == "error", F.concat(F.lit("Invariant "), name, F.lit(" violated")))
        .otherwise(F.lit("Finished executing transaction"))
    )
    return df.select(
        F.col("ts").cast("timestamp").alias("ts"), message.alias("message"), kind.alias("event_type"),
        F.when(kind == "error", name).alias("invariant"),
        F.concat(F.lit("tx_"), F.pmod("user_id", F.lit(5)).cast("string")).alias("transaction_template"),
    )


def checked_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The log records of the violations that checking ``events`` finds, as the log analytics read them."""
    events = user_events(spark, sf)
    found = log_records(check_all(events, [purchase_after_signup(), timely_purchase()]))
    record = found.select(F.from_json("value", "`@t` timestamp, `@mt` string, InvariantName string").alias("r")).select("r.*")
    message = F.replace("@mt", F.lit("{InvariantName}"), "InvariantName")
    return record.select(F.col("@t").alias("ts"), message.alias("message"), F.col("InvariantName").alias("invariant"))


#: Rows of the two dashboard reports that have a limit.
_REPORT = 10_000


def _window(df: DataFrame, by: str) -> DataFrame:
    return df.select(F.unix_micros("window_start").alias("start_us"), by, "n")


QUERIES = {
    "violations_5s": lambda s, d: _window(L.violations_per_window(event_logs(s, d), limit=_REPORT), "invariant"),
    "types_5s": lambda s, d: _window(L.types_per_window(event_logs(s, d), limit=_REPORT), "event_type"),
    "violations_5s_all": lambda s, d: _window(L.violations_per_window(event_logs(s, d)), "invariant"),
    "types_5s_all": lambda s, d: _window(L.types_per_window(event_logs(s, d)), "event_type"),
    "checked_violations_5s": lambda s, d: _window(L.violations_per_window(checked_logs(s, d)), "invariant"),
    "checked_by_invariant": lambda s, d: L.violations_by_invariant(checked_logs(s, d)),
    "types_per_day": lambda s, d: _window(L.count_per_window(event_logs(s, d), "event_type", "1 day"), "event_type"),
    "count_by_message": lambda s, d: L.count_by_message(event_logs(s, d)),
    "started_by_template": lambda s, d: L.started_by_template(event_logs(s, d)),
    "violations_by_invariant": lambda s, d: L.violations_by_invariant(event_logs(s, d)),
    "share_by_type": lambda s, d: L.share_by_type(event_logs(s, d)),
    "elapsed_ms": lambda s, d: L.elapsed(event_logs(s, d), (0.5, 0.95)),
}

_MS = "CAST(CAST(floor(value * 10) AS BIGINT) AS VARCHAR)"
_L = (
    "l AS (SELECT epoch_us(ts) AS us, event_type, CASE event_type WHEN 'click' THEN 'Starting to execute transaction' "
    f"WHEN 'view' THEN 'Operation finished in ' || {_MS} || ' milliseconds' "
    f"WHEN 'purchase' THEN 'Transaction finished in ' || {_MS} || ' milliseconds' "
    "WHEN 'error' THEN 'Invariant inv_' || CAST(user_id % 7 AS VARCHAR) || ' violated' "
    "ELSE 'Finished executing transaction' END AS message, "
    "CASE WHEN event_type = 'error' THEN 'inv_' || CAST(user_id % 7 AS VARCHAR) END AS invariant, "
    "'tx_' || CAST(user_id % 5 AS VARCHAR) AS transaction_template FROM events)"
)
_FOUND = "(message LIKE '%Transaction finished%' OR message LIKE '%Invariant%')"


def _windowed(by: str, where: str, us: int, limit: str = "") -> str:
    return f"WITH {_L} SELECT us - us % {us} AS start_us, {by}, count(*) AS n FROM l WHERE {where} GROUP BY 1, 2 {limit}"


ORACLES = {
    "violations_5s": _windowed("invariant", "message LIKE '%Invariant%'", 5_000_000, "ORDER BY 1, 2 LIMIT 10000"),
    "types_5s": _windowed("event_type", _FOUND, 5_000_000, "ORDER BY 1, 2 LIMIT 10000"),
    "violations_5s_all": _windowed("invariant", "message LIKE '%Invariant%'", 5_000_000),
    "types_5s_all": _windowed("event_type", _FOUND, 5_000_000),
    "checked_violations_5s": f"{CHECKED} SELECT us - us % 5000000 AS start_us, invariant, count(*) AS n FROM found GROUP BY 1, 2",
    "checked_by_invariant": f"{CHECKED} SELECT invariant, count(*) AS n FROM found GROUP BY 1",
    "types_per_day": _windowed("event_type", "true", 86_400_000_000),
    "count_by_message": f"WITH {_L} SELECT message, count(*) AS n FROM l WHERE {_FOUND} GROUP BY 1",
    "started_by_template": f"WITH {_L} SELECT transaction_template, count(*) AS n FROM l WHERE message = 'Starting to execute transaction' GROUP BY 1",
    "violations_by_invariant": f"WITH {_L} SELECT invariant, count(*) AS n FROM l WHERE message LIKE '%Invariant%' GROUP BY 1",
    "share_by_type": f"WITH {_L}, c AS (SELECT event_type, count(*) AS n FROM l WHERE {_FOUND} GROUP BY 1) SELECT event_type, n, n / (SELECT sum(n) FROM c) AS share FROM c",
    "elapsed_ms": (
        f"WITH {_L}, p AS (SELECT regexp_extract(message, '^(Operation|Transaction) finished', 1) AS kind, "
        "CAST(regexp_extract(message, 'in ([0-9]+) milliseconds', 1) AS BIGINT) AS ms FROM l WHERE message LIKE '% finished in %') "
        "SELECT kind, count(*) AS n, min(ms) AS min_ms, max(ms) AS max_ms, CAST(sum(ms) AS BIGINT) AS sum_ms, "
        "quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms FROM p GROUP BY kind"
    ),
}
