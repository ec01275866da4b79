"""Event sources, member access, event time and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from evwarden import Alias, Invariant, attr, check, check_all
from evwarden.functions.members import bool_member, event_time, members, number_member
from evwarden.sinks import violations as K
from evwarden.sources.events import alias_view, decode_records, json_file_events, kafka_options, memory_events, time_members, union_events


def test_json_file(spark, tmp_path):
    docs = [{"Type": "A", "Content": {"id": 1, "at": "2024-02-29T06:30:15.1234567Z", "deep": {"x": {"y": 5}}}},
            {"Type": "B", "Content": {"id": "1", "when": 1709190016789}}]
    path = tmp_path / "events.json"
    path.write_text(json.dumps(docs, indent=1))
    aliases = {"a": Alias("A", {"id": "number", "at": "timestamp", "deep.x.y": "number"}), "b": Alias("B", {"id": "number", "when": "timestamp"})}
    events = json_file_events(spark, str(path), time_members(aliases))
    assert {(r.type, r.us) for r in events.select("type", F.unix_micros("ts").alias("us")).collect()} == {
        ("A", 1709188215123456), ("B", 1709190016789000)}
    inv = Invariant("i", aliases, ["a", "b"], within="500 hours", where=[attr("a.id") == attr("b.id")], on_full_match=attr("a.deep.x.y") > 5)
    assert check(events, inv).count() == 1


def test_event_time_forms(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:01.1234567Z",), ("1000",), ("2024-01-01T01:00:00+01:00",), ("soon",), (None,)], "t string")
    got = [r.us for r in df.select(F.unix_micros(event_time(F.col("t"))).alias("us")).collect()]
    assert got == [1704067201123456, 1_000_000, 1704067200000000, None, None]
    records = spark.createDataFrame([(b"A", b'{"at": "soon"}', 0, 1)], "key binary, value binary, partition int, offset long")
    with pytest.raises(Exception, match="cannot read an event time"):
        decode_records(records, "at").collect()


def test_record_positions_are_unique(spark):
    records = spark.range(100).select(
        F.lit(b"A").alias("key"), F.lit('{"at": 5}').cast("binary").alias("value"), (F.col("id") % 4).cast("int").alias("partition"),
        F.floor(F.col("id") / 4).alias("offset"))
    events = decode_records(records, "at")
    assert events.select("seq").distinct().count() == 100
    assert union_events(events, events).count() == 200


def test_coercion(spark):
    df = spark.createDataFrame([("42",), ("x",), ("true",), ("false",), ("0",), ("2.5",), (None,)], "t string")
    got = [(r.n, r.b) for r in df.select(number_member(F.col("t")).alias("n"), bool_member(F.col("t")).alias("b")).collect()]
    assert got == [(42.0, True), (0.0, False), (1.0, True), (0.0, False), (0.0, False), (2.5, True), (None, None)]


def test_members_of_text_and_struct(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}, "n": null}',)], "content string")
    wanted = [("a", "number"), ("b.c", "string"), ("n", "number"), ("z", "bool")]
    text = members(F.col("content"), df.schema["content"].dataType, wanted)
    assert list(df.select(*text.values()).first()) == [1.0, "x", None, None]
    typed = df.select(F.expr("named_struct('a', 1, 'b', named_struct('c', 'x'), 'n', cast(null as double))").alias("content"))
    struct = members(F.col("content"), typed.schema["content"].dataType, wanted)
    assert list(typed.select(*struct.values()).first()) == [1.0, "x", None, None]


def test_alias_view(spark):
    events = memory_events(spark, [("A", '{"p": "7"}', None), ("B", "{}", None), ("A", '{"q": 1}', None)])
    assert [(r.seq, r.p) for r in alias_view(events, "A", {"p": "number"}).orderBy("seq").collect()] == [(0, 7.0), (2, None)]


def test_kafka_options():
    plain = kafka_options("b:9092", ["t1", "t2", "t1"], "g")
    assert plain["subscribe"] == "t1,t2" and plain["startingOffsets"] == "earliest" and plain["kafka.group.id"] == "g"
    secured = kafka_options("b:9092", ["t"], username="u", password='p"w')
    assert secured["kafka.security.protocol"] == "SASL_SSL" and secured["startingOffsets"] == "latest"
    assert 'password="p\\"w";' in secured["kafka.sasl.jaas.config"]


def test_records_of_violations(spark):
    events = memory_events(spark, [("A", '{"v": 1}', None), ("A", '{"v": 9}', None)]).withColumn("ts", F.timestamp_millis("seq"))
    inv = Invariant("small", {"a": Alias("A", {"v": "number"})}, ["a"], on_full_match=attr("a.v") < 5)
    found = check_all(events, [inv])
    record = K.kafka_records(found).first()
    assert record.key == "small" and json.loads(json.loads(record.value)["match"])["a"]["v"] == 9
    log = json.loads(K.log_records(found).first().value)
    assert log["@t"] == "1970-01-01T00:00:00.001000Z" and log["@l"] == "Information" and log["InvariantName"] == "small"
    assert K.full_matches(found).count() == 1 and K.timed_out(found).count() == 0


def test_json_files_keep_their_order(spark, tmp_path):
    """``seq`` counts by file name and place in the array, at any number of partitions."""
    places = {}
    for name, n in (("b", 40), ("a", 7), ("d", 25), ("c", 1)):
        rows = [{"Type": f"{name}{i}", "Content": {"at": f"2024-01-01T00:00:{i:02d}Z", "pad": "x" * (i % 5) * 40}} for i in range(n)]
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
        places[name] = n
    want = [f"{name}{i}" for name in "abcd" for i in range(places[name])]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    counts = set()
    for cost in ("4194304", "1", "1073741824"):
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        events = json_file_events(spark, str(tmp_path), "at")
        counts.add(events.rdd.getNumPartitions() if cost != "1" else -1)
        rows = sorted((r.seq, r.type) for r in events.collect())
        assert [t for _, t in rows] == want and [s for s, _ in rows] == list(range(len(want)))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_exact_percentiles_of_many_durations(spark):
    from evwarden.plans.logs import elapsed

    df = spark.range(60_000).select(
        F.concat(F.when(F.col("id") % 3 == 0, "Operation").otherwise("Transaction"), F.lit(" finished in "), (F.pmod(F.col("id") * 7919, F.lit(40_009)) * 5).cast("string"), F.lit(" milliseconds")).alias("message")
    )
    values = {"Operation": [], "Transaction": []}
    for i in range(60_000):
        values["Operation" if i % 3 == 0 else "Transaction"].append(i * 7919 % 40_009 * 5)
    for r in elapsed(df, (0.001, 0.5, 0.95, 1.0), block=1_000).collect():
        mine = sorted(values[r.kind])
        at = lambda p: mine[max(1, -(-len(mine) * p // 1000)) - 1]
        assert (r.n, r.min_ms, r.max_ms, r.sum_ms) == (len(mine), mine[0], mine[-1], sum(mine))
        assert (r.p0_ms, r.p50_ms, r.p95_ms, r.p100_ms) == (at(1), at(500), at(950), at(1000))
