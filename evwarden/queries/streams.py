"""Structured Streaming runs over the ``events`` file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evwarden.model import DEFAULT, Invariant, Not
from evwarden.predicates import attr
from evwarden.queries.sequences import _H, _SLICE, purchase_after_signup, same_user
from evwarden.queries.tables import micros, table, user_aliases
from evwarden.sinks.batches import in_time, late_rows, manifest, read_batches, split_late, to_batches, write_batch
from evwarden.sinks.scratch import scratch_dir
from evwarden.sinks.violations import to_files
from evwarden.sources.events import table_events
from evwarden.streaming import check_stream, check_streams, latest_watermark, sources_together, use_rocksdb, windowed_counts


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return table_events(files, "event_type", "ts", "event_id", ["user_id", "value"])


def run(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Everything available now goes through the stream into a Parquet table, which is read back."""
    use_rocksdb(spark)
    base = scratch_dir(spark, name)
    query = to_files(stream, f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_window_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = windowed_counts(event_stream(spark, sf), "type", "1 hour", "10 minutes")
    return run(spark, counts, "windows").select(F.unix_micros("window_start").alias("start_us"), "type", "n")


def stream_full_matches(spark: SparkSession, sf: str) -> DataFrame:
    found = check_stream(event_stream(spark, sf), purchase_after_signup(), "5 seconds")
    return run(spark, found, "matches").select("start_id", "end_id", F.col("p.value").alias("value"))


def stream_timeouts(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "timely_purchase", user_aliases(s="signup", p="purchase"), ["s", "p"], within="24 hours",
        where=same_user("s", "p"), on_prefix_match={DEFAULT: False},
    )
    found = check_stream(event_stream(spark, sf), inv, "5 seconds", salts=2)
    return run(spark, found, "timeouts").select("start_id", "kind", micros("end_ts").alias("end_us"))


def stream_single(spark: SparkSession, sf: str) -> DataFrame:
    return run(spark, check_stream(event_stream(spark, sf), _small_purchase()), "single").select("start_id")


def stream_many(spark: SparkSession, sf: str) -> DataFrame:
    trailing = Invariant(
        "no_purchase", user_aliases(s="signup", p="purchase"), ["s", Not("p")], within="24 hours",
        where=same_user("s", "p"), on_full_match=False,
    )
    found = check_streams(event_stream(spark, sf), [purchase_after_signup(), trailing], "5 seconds")
    return run(spark, found, "many").select("invariant", "kind", "start_id")


def stream_idle_source(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over two sources of which one falls silent after three days; the other one closes the windows."""
    first = table(spark, sf, "events").agg(F.min("ts")).scalar().cast("timestamp")
    signup = F.col("type") == "signup"
    silent = event_stream(spark, sf).filter(signup & (F.col("ts") < first + F.expr("INTERVAL 3 DAYS")))
    both = sources_together([event_stream(spark, sf).filter(~signup), silent], "10 minutes")
    with latest_watermark(spark):
        counts = run(spark, windowed_counts(both, "type", "6 hours", None), "idle")
    return counts.select(F.unix_micros("window_start").alias("start_us"), "type", "n")


def _arriving(spark: SparkSession, sf: str, slice_of: Column, base: str) -> tuple[str, list[int], Callable[[int], None]]:
    """A folder for files of events, the slices that they make up, and what writes the file of one slice."""
    df = table(spark, sf, "events").withColumn("_slice", slice_of.cast("bigint"))
    slices = sorted(r[0] for r in df.select("_slice").distinct().collect())  # a few slices of time
    folder = f"{base}/in"
    return folder, slices, lambda k: df.filter(F.col("_slice") == k).drop("_slice").coalesce(1).write.mode("append").parquet(folder)


def _file_stream(spark: SparkSession, sf: str, folder: str) -> DataFrame:
    files = spark.readStream.schema(table(spark, sf, "events").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return table_events(files, "event_type", "ts", "event_id", ["user_id", "value"])


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Events that come in files of eight days, one in fifty a file too late: which of them are behind the watermark."""
    base = scratch_dir(spark, "late")
    eight_days = F.floor(micros("ts") / F.lit(8 * 24 * _H)) + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)
    folder, slices, put = _arriving(spark, sf, eight_days, base)
    for k in slices:
        put(k)
    events = _file_stream(spark, sf, folder).select(F.col("seq").alias("event_id"), "ts")
    split_late(events, "1 hour", f"{base}/out", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    parts = [f(spark, f"{base}/out", events.schema).select("event_id", F.lit(late).alias("late")) for f, late in ((in_time, False), (late_rows, True))]
    return parts[0].unionByName(parts[1])


def stream_redelivered(spark: SparkSession, sf: str) -> DataFrame:
    """Small purchases of a stream that stops, delivers its last batch once more and goes on when further files are there."""
    base = scratch_dir(spark, "redelivered")
    folder, slices, put = _arriving(spark, sf, F.floor(micros("ts") / F.lit(8 * 24 * _H)), base)
    out, half = f"{base}/out", (len(slices) + 1) // 2
    for part in (slices[:half], slices[half:]):
        for k in part:
            put(k)
        found = check_stream(_file_stream(spark, sf, folder), _small_purchase()).select("start_id")
        to_batches(found, out, f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        last = manifest(spark, out).agg(F.max(F.struct("batch", "attempt")).alias("last")).first()["last"]
        write_batch(spark.read.parquet(f"{out}/data/batch={last.batch}/attempt={last.attempt}"), last.batch, out)  # as after a stop before the commit
    return read_batches(spark, out, found.schema)


def _small_purchase() -> Invariant:
    return Invariant("small_purchase", user_aliases(p="purchase"), ["p"], on_full_match=attr("p.value") < 150)


QUERIES = {
    f.__name__: f
    for f in (
        stream_many, stream_window_counts, stream_full_matches, stream_timeouts, stream_single, stream_idle_source, stream_late_rows, stream_redelivered,
    )
}

_WATERMARK = "(SELECT (max(epoch_us(ts)) // 1000) * 1000 FROM events)"

ORACLES = {
    "stream_window_counts": (
        "WITH l AS (SELECT epoch_us(ts) AS us, event_type AS type FROM events) SELECT us - us % 3600000000 AS start_us, type, count(*) AS n "
        f"FROM l WHERE us - us % 3600000000 + 3600000000 <= {_WATERMARK} - 600000000 GROUP BY 1, 2"
    ),
    "stream_full_matches": (
        f"{_SLICE} SELECT id AS start_id, nid AS end_id, nv AS value FROM f WHERE NOT nv < 100 AND nus < {_WATERMARK} - 5000000"
    ),
    "stream_timeouts": (
        f"{_SLICE} SELECT id AS start_id, 'timeout' AS kind, us + {24 * _H} AS end_us FROM e WHERE t = 'signup' "
        f"AND id NOT IN (SELECT id FROM m) AND us + {24 * _H} <= {_WATERMARK} - 5000000"
    ),
    "stream_many": (
        f"{_SLICE} SELECT 'purchase_after_signup' AS invariant, 'full' AS kind, id AS start_id FROM f WHERE NOT nv < 100 AND nus < {_WATERMARK} - 5000000 "
        f"UNION ALL SELECT 'no_purchase', 'full', id FROM e WHERE t = 'signup' AND id NOT IN (SELECT id FROM m) AND us + {24 * _H} <= {_WATERMARK} - 5000000"
    ),
    "stream_single": "SELECT event_id AS start_id FROM events WHERE event_type = 'purchase' AND NOT value < 150",
    "stream_redelivered": "SELECT event_id AS start_id FROM events WHERE event_type = 'purchase' AND NOT value < 150",
    "stream_idle_source": (
        "WITH l AS (SELECT epoch_us(ts) AS us, event_type AS type, (SELECT min(epoch_us(ts)) FROM events) AS first FROM events) "
        f"SELECT us - us % {6 * _H} AS start_us, type, count(*) AS n FROM l WHERE (type <> 'signup' OR us < first + {72 * _H}) AND us - us % {6 * _H} + {6 * _H} <= "
        "(SELECT max(us) // 1000 * 1000 FROM l WHERE type <> 'signup') - 600000000 GROUP BY 1, 2"
    ),
    "stream_late_rows": (
        f"WITH s AS (SELECT event_id, epoch_us(ts) AS us, epoch_us(ts) // {8 * 24 * _H} + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS k FROM events), "
        "m AS (SELECT k, max(us) AS top FROM s GROUP BY k), "
        "w AS (SELECT k, max(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed FROM m) "
        f"SELECT event_id, coalesce(us <= passed // 1000 * 1000 - {_H}, false) AS late FROM s JOIN w USING (k)"
    ),
}
