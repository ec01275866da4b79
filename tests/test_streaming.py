"""Streams give the rows of the batch run for every start that is decided."""

import time

import pytest
from pyspark.sql import functions as F

from evwarden import DEFAULT, Alias, Invariant, Not, Plus, Star, attr, find_matches
from evwarden.queries.streams import run
from evwarden.queries.tables import MEMBERS, table
from evwarden.sources.events import table_events
from evwarden.sinks.batches import in_time, late_rows, manifest, read_batches, split_late, write_batch
from evwarden.sinks.violations import to_files
from evwarden.streaming import (
    check_stream, check_streams, latest_watermark, match_stream, sources_together, use_latest_watermark, use_rocksdb, windowed_counts,
)

AL = {n: Alias(t, MEMBERS) for n, t in (("s", "signup"), ("e", "error"), ("p", "purchase"), ("c", "click"))}


def same(*names):
    return [attr("s.user_id") == attr(f"{n}.user_id") for n in names]


SPECS = {
    "negation": (dict(seq=["s", Not("e"), "p"], where=same("e", "p")), 1),
    "salted_loop": (dict(seq=["s", Plus("c"), "p"], where=[*same("c", "p"), attr("c.value") > 5]), 3),
    "unkeyed_theta": (dict(seq=["s", Star("c"), "p"], where=[attr("p.value") > attr("s.value")], within="6 hours"), 2),
    "trailing": (dict(seq=["s", Not("p")], where=same("p")), 1),
}


@pytest.fixture(scope="module")
def parts(spark, sf, tmp_path_factory):
    """The events as files that arrive one after the other, slightly out of order."""
    folder = tmp_path_factory.mktemp("stream") / "in"
    df = table(spark, sf, "events")
    n = df.count()
    for i in range(4):
        part = df.filter((F.col("event_id") >= i * n // 4) & (F.col("event_id") < (i + 1) * n // 4))
        part.orderBy(F.desc("event_id")).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return str(folder)


def as_events(df):
    return table_events(df, "event_type", "ts", "event_id", ["user_id", "value"])


def rows(df):
    return {(r.kind, r.start_id, r.end_id, r.bound, r.n) for r in df.collect()}


@pytest.mark.parametrize("name", SPECS)
def test_stream_equals_batch(spark, sf, parts, name):
    spec, salts = SPECS[name]
    inv = Invariant(name, AL, on_full_match=False, on_prefix_match={} if name == "trailing" else {DEFAULT: False},
                    **{"within": "24 hours", **spec})
    loop = F.size("c") if any(s.loop for s in inv.steps) else F.lit(0)
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    got = rows(run(spark, match_stream(as_events(stream), inv, "5 seconds", salts), name).withColumn("n", loop))
    every = find_matches(as_events(batch), inv).withColumn("n", loop)
    # decided: what ends before the last watermark
    mark = batch.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] // 1000 * 1000 - 5_000_000
    end = F.unix_micros("end_ts")
    decided = every.filter(F.when(F.col("end_id").isNull(), end <= mark).otherwise(end < mark))
    assert got == rows(decided) and got


def test_joins_keep_their_state_in_spark(spark, sf, parts):
    """A start with a closing event or an absence needs neither a state operator nor Python, and only the kinds that clauses judge are joined."""
    schema = table(spark, sf, "events").schema
    stream = lambda: as_events(spark.readStream.schema(schema).parquet(parts))
    pair = Invariant("pair", AL, ["s", Not("e"), "p"], within="24 hours", where=same("e", "p"), on_full_match=False, on_prefix_match={DEFAULT: False})
    trailing = Invariant("trailing", AL, ["s", Not("p")], within="24 hours", where=same("p"), on_full_match=False)
    for inv in (pair, trailing):
        plan = check_stream(stream(), inv)._jdf.queryExecution().analyzed().toString()
        assert "TransformWithState" not in plan and "Python" not in plan and "Join" in plan
    full = Invariant("full", AL, ["s", "p"], within="24 hours", where=same("p"), on_full_match=False)
    assert "LeftOuter" not in check_stream(stream(), full)._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        match_stream(stream(), Invariant("loop", AL, ["s", Plus("c"), "p"], within="24 hours", where=same("c", "p")), strategy="joins")


@pytest.mark.parametrize("strategy", ["joins", "state"])
def test_strategies_of_streams_agree(spark, sf, parts, strategy):
    inv = Invariant("both", AL, ["s", Not("e"), "p"], within="24 hours", where=[*same("e", "p"), attr("s.value") > 10], on_prefix_match={DEFAULT: False})
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    got = [(r.kind, r.start_id, r.end_id or -1) for r in run(spark, match_stream(as_events(stream), inv, strategy=strategy, salts=2), strategy).collect()]
    mark = batch.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] // 1000 * 1000 - 5_000_000
    end = F.unix_micros("end_ts")
    decided = find_matches(as_events(batch), inv).filter(F.when(F.col("end_id").isNull(), end <= mark).otherwise(end < mark))
    assert sorted(got) == sorted((r.kind, r.start_id, r.end_id or -1) for r in decided.collect()) and len({g[0] for g in got}) == 2


def put_file(spark, folder, *events):
    data = [(t, s, n, 1, 1.0) for t, s, n in events]
    df = spark.createDataFrame(data, "event_type string, s long, event_id long, user_id long, value double")
    df.select("event_type", F.timestamp_seconds("s").alias("ts"), "event_id", "user_id", "value").coalesce(1).write.mode("append").parquet(folder)
    time.sleep(1.1)


FILE = "event_type string, ts timestamp, event_id long, user_id long, value double"


def test_late_rows_are_an_output(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    put_file(spark, folder, ("signup", 100, 1), ("view", 200, 2), ("view", 90, 3))
    put_file(spark, folder, ("purchase", 150, 4), ("view", 400, 5), ("view", 195, 6), ("view", 196, 7))
    put_file(spark, folder, ("view", 401, 8), ("view", 395, 9), ("view", 10, 10))
    stream = lambda: spark.readStream.schema(FILE).option("maxFilesPerTrigger", 1).parquet(folder)
    split_late(stream(), "5 seconds", out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    put_file(spark, folder, ("view", 396, 11), ("view", 500, 12), ("view", 300, 13))
    split_late(stream(), "5 seconds", out, checkpoint).trigger(availableNow=True).start().awaitTermination()  # a restart goes on with the same mark
    schema = stream().schema
    ids = lambda df: sorted(r.event_id for r in df.collect())
    assert ids(late_rows(spark, out, schema)) == [4, 6, 9, 10, 11, 13]
    assert ids(in_time(spark, out, schema)) == [1, 2, 3, 5, 7, 8, 12]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    write_batch(rows(1, 2), 0, path)
    write_batch(rows(3), 1, path)
    write_batch(rows(3, 4), 1, path)
    (tmp_path / "out/data/batch=2/attempt=x").mkdir(parents=True)
    rows(9).write.mode("overwrite").parquet(f"{path}/data/batch=2/attempt=x")  # an attempt that never reached the manifest
    assert sorted(r.id for r in read_batches(spark, path, rows().schema).collect()) == [1, 2, 3, 4]
    assert sorted((r.batch, r.rows) for r in manifest(spark, path).collect()) == [(0, 2), (1, 2)]


def test_an_idle_source_holds_nothing_back(spark, tmp_path):
    busy, idle = str(tmp_path / "busy"), str(tmp_path / "idle")
    put_file(spark, busy, ("view", 100, 1), ("view", 700, 2))
    put_file(spark, busy, ("view", 1300, 3))
    put_file(spark, idle, ("signup", 110, 4))
    both = sources_together([as_events(spark.readStream.schema(FILE).parquet(p)) for p in (busy, idle)], "5 seconds")
    counts = windowed_counts(both, "type", "10 minutes", None)
    with latest_watermark(spark):
        got = run(spark, counts, "latest")
    assert sorted((r.window_start.timestamp(), r.type, r.n) for r in got.collect()) == [(0, "signup", 1), (0, "view", 1), (600, "view", 1)]
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "min")
    assert run(spark, counts, "least").count() == 0


def test_restart_loses_and_repeats_nothing(spark, sf, tmp_path):
    """Two runs on one checkpoint give what is decided by then, each match once."""
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    use_rocksdb(spark)
    inv = Invariant("restarted", AL, ["s", Not("e"), "p"], within="24 hours", where=same("e", "p"), on_full_match=False, on_prefix_match={DEFAULT: False})
    df = table(spark, sf, "events")
    half = df.agg(F.percentile("event_id", 0.5)).first()[0]
    for part in (df.filter(F.col("event_id") < half), df.filter(F.col("event_id") >= half)):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).parquet(folder)
        found = match_stream(as_events(stream), inv, "5 seconds")
        to_files(found, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = [(r.kind, r.start_id, r.end_id) for r in spark.read.schema(found.schema).parquet(out).collect()]
    mark = df.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] // 1000 * 1000 - 5_000_000
    end = F.unix_micros("end_ts")
    every = find_matches(as_events(df), inv)
    decided = every.filter(F.when(F.col("end_id").isNull(), end <= mark).otherwise(end < mark))
    assert sorted(map(str, got)) == sorted(str((r.kind, r.start_id, r.end_id)) for r in decided.collect()) and got


def test_invariants_that_share_a_state(spark, sf, parts):
    """Together they give what each gives alone, from one stateful operator."""
    invs = [
        Invariant("a", AL, ["s", Not("e"), "p"], within="24 hours", where=same("e", "p"), on_full_match=attr("p.value") < 60, on_prefix_match={DEFAULT: False}),
        Invariant("b", AL, ["s", Not("p")], within="12 hours", where=same("p"), on_full_match=False),
        Invariant("c", AL, ["s", Plus("c"), "p"], within="48 hours", where=same("c", "p"), on_full_match=attr("c.value") < 50),
    ]
    schema = table(spark, sf, "events").schema
    stream = lambda: as_events(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(parts))
    together = check_streams(stream(), invs)
    assert together._jdf.queryExecution().analyzed().toString().count("TransformWithState") == 1
    record = lambda r: (r.invariant, r.kind, r.start_id, r.end_id or -1)
    got = sorted(record(r) for r in run(spark, together, "together").collect())
    alone = [record(r) for inv in invs for r in run(spark, check_stream(stream(), inv), inv.name).collect()]
    assert got == sorted(alone) and len({g[0] for g in got}) == 3


def test_late_events_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "late")
    schema = "event_type string, ts timestamp, event_id long, user_id long, value double"

    def put(*events):
        data = [(t, s, n, 1, 1.0) for t, s, n in events]
        df = spark.createDataFrame(data, "event_type string, s long, event_id long, user_id long, value double")
        df.select("event_type", F.timestamp_seconds("s").alias("ts"), "event_id", "user_id", "value").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)

    put(("signup", 100, 1), ("view", 200, 2))
    put(("purchase", 150, 3), ("view", 400, 4))
    put(("view", 401, 5))
    inv = Invariant("late", AL, ["s", "p"], within="60 sec", where=same("p"), on_full_match=False, on_prefix_match={DEFAULT: False})
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    found = run(spark, match_stream(as_events(stream), inv, "5 seconds"), "late").collect()
    assert [(r.kind, r.start_id) for r in found] == [("timeout", 1)]


def test_window_counts(spark, sf, parts):
    use_latest_watermark(spark)
    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(parts)
    counts = run(spark, windowed_counts(as_events(stream), "type", "1 hour", "1 minute"), "counts")
    want = as_events(batch).groupBy(F.window("ts", "1 hour").alias("w"), "type").count()
    want = want.select(F.col("w.start").alias("window_start"), "type", F.col("count").alias("n"))
    # closed: windows that end at or before the last watermark
    mark = batch.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0] // 1000 * 1000 - 60_000_000
    closed = want.filter(F.unix_micros("window_start") + 3_600_000_000 <= mark)
    assert sorted(map(tuple, counts.select("window_start", "type", "n").collect())) == sorted(map(tuple, closed.collect()))
