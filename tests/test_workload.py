"""Draws, templates, definitions and the request table."""

import json
from bisect import bisect_right
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from evwarden.functions import draws as D
from evwarden.functions import templates as T
from evwarden.plans import workload as W
from evwarden.sources import definitions as S
from evwarden.sources.cdc import cdc_events

OPERATIONS = {
    "add": {
        "templateId": "add", "type": "http", "httpMethod": "post", "url": "http://shop/{{user}}/@@item.id@@",
        "arguments": [{"name": "user", "type": "string"}, {"name": "n", "type": "number"}],
        "dynamicVariables": [{"name": "g", "type": "guid"}],
        "headers": [{"key": "h", "value": "v-{{user}}"}],
        "queryParameters": [{"key": "a b", "value": "c&d"}],
        "requestPayload": {"type": "json", "content": {"item": {"id": "{{n}}"}, "who": "{{user}}", "g": "{{g}}"}},
    },
    "nap": {"templateId": "nap", "type": "sleep", "duration": "1.5", "units": "seconds"},
}
WORKLOAD = {
    "templateId": "w",
    "generators": [
        {"id": "u", "type": "string", "sampleSpace": ["a", 'b"q', "c"], "distribution": "zipfian"},
        {"id": "c", "type": "counter", "start": 5},
    ],
    "transactions": [
        {"id": "x1", "transactionReferenceId": "t", "count": 4, "data": [
            {"name": "user", "generatorReferenceId": "u"}, {"name": "n", "generatorReferenceId": "c"}]},
        {"id": "x2", "transactionReferenceId": "t", "count": 3, "data": [{"name": "n", "generatorReferenceId": "c"}]},
    ],
}
TRANSACTION = {"templateId": "t", "operations": [{"operationReferenceId": "nap", "id": "o1"}, {"operationReferenceId": "add", "id": "o2"}]}


@pytest.fixture()
def folder(tmp_path):
    def write(name, doc):
        target = tmp_path / "deep" / "er" if name.startswith("op") else tmp_path
        target.mkdir(parents=True, exist_ok=True)
        (target / f"{name}.json").write_text(json.dumps(doc))

    for name, doc in OPERATIONS.items():
        write(f"op_{name}", doc)
    write("tx_t", TRANSACTION)
    write("workload_w", WORKLOAD)
    write("notes", {"templateId": "ignored"})
    return write, str(tmp_path)


def parsed(spark, path):
    docs = S.read_definitions(spark, path)
    return S.parse(docs, "op"), S.parse(docs, "tx"), S.parse(docs, "workload")


def test_binding_from_the_table_of_definitions(spark):
    """Joined definitions bind what the document of each workload binds: every kind of generator, counters over transactions, skewed draws."""
    docs = []
    for name, start in (("w1", 3), ("w2", 50)):
        gens = [
            {"id": "u", "type": "string", "sampleSpace": ["a", "b", "c"]}, {"id": "c", "type": "counter", "start": start}, {"id": "c2", "type": "Counter"},
            {"id": "i", "type": "unsignedInt", "min": 5, "max": 9}, {"id": "f", "type": "signedInt"}, {"id": "g", "type": "guid"}, {"id": "s", "type": "string"},
            {"id": "k", "type": "constant", "constant": "x" + name}, {"id": "z", "type": "unsignedInt", "distribution": "zipfian", "min": 10, "max": 40},
            {"id": "y", "type": "string", "distribution": "Zipfian", "sampleSpace": ["p", "q"], "exponent": 2.0},
        ]
        refs = lambda *pairs: [{"name": n, "generatorReferenceId": g} for n, g in pairs]
        txs = [
            {"id": "x1", "transactionReferenceId": "t", "count": 40, "data": refs(("a", "u"), ("n", "c"), ("m", "c"), ("z", "z"), ("i", "i"), ("o", "c2"))},
            {"id": "x2", "transactionReferenceId": "t", "count": 30, "data": refs(("n", "c"), ("g", "g"), ("h", "g"), ("s", "s"), ("k", "k"), ("f", "f"), ("y", "y"), ("z2", "z"))},
            {"id": "x3", "transactionReferenceId": "t", "count": 2, "data": []}, {"id": "x4", "transactionReferenceId": "t", "count": 5, "data": refs(("n", "c"))},
        ]
        docs.append({"templateId": name, "generators": gens, "transactions": txs})
    texts = [(f"workload_{d['templateId']}.json", json.dumps(d), "workload") for d in docs]
    workloads = S.parse(spark.createDataFrame(texts, "file string, text string, kind string"), "workload")
    rows = W.expand_counts(W.transactions_of(workloads), "count", chunk=16)
    key = lambda r: (r.workload, r.tx_ref, r.ordinal)
    got = {key(r): r["values"] for r in W.bind_all(rows, workloads, seed=4).collect()}
    want = {key(r): r["values"] for d in docs for r in W.bind(rows.filter(rows.workload == d["templateId"]), d, seed=4).collect()}
    assert got == want and len(got) == 2 * 77 and {len(v) for v in got.values()} == {0, 1, 6, 8}


def test_request_table(spark, folder):
    ops, txs, wls = parsed(spark, folder[1])
    assert S.definition_errors(ops, txs, wls).count() == 0
    rows = W.schedule(W.expand_counts(W.transactions_of(wls), "count", chunk=2), seed=7)
    assert rows.count() == 7 and rows.select("transaction_id").distinct().count() == 7
    assert all(0 <= r.worker < 10 for r in rows.collect())
    bound = W.bind(rows, WORKLOAD, seed=7)
    drawn = [r["values"] for r in bound.collect()]
    assert sorted(int(v["n"]) for v in drawn) == list(range(5, 12))
    assert {v["user"] for v in drawn if "user" in v} <= {"a", 'b"q', "c"}
    table = W.requests(bound, txs, ops, seed=7).collect()
    assert len(table) == 14
    for r in table:
        if r.operation_ref == "o1":
            assert (r.type, r.sleep_us, r.offset_us, r.body) == ("sleep", 1_500_000, 0, None)
        elif r.tx_ref == "x1":
            body = json.loads(r.body)
            assert isinstance(body["item"]["id"], int) and len(body["g"]) == 36
            assert r.request_url == f"http://shop/{body['who']}/{body['item']['id']}"
            assert (r.method, r.query, r.offset_us, r.missing) == ("POST", "a+b=c%26d", 1_500_000, [])
            assert r.request_headers[0].value == f"v-{body['who']}"
        else:
            assert r.missing == ["user"] and r.body is None and r.request_url is None
    again = W.requests(W.bind(rows, WORKLOAD, seed=7), txs, ops, seed=7)
    assert sorted(map(str, again.collect())) == sorted(map(str, table))


def test_definitions_are_made_ready_once(spark, folder):
    """No row cuts a template or looks up declared names again, and rows are not dealt out by their few transactions."""
    ops, txs, _ = parsed(spark, folder[1])
    ids = [F.lit("w").alias("workload"), F.lit("x").alias("tx_ref"), F.lit("t").alias("transaction"), F.col("id").alias("ordinal")]
    bound = spark.range(3).select(*ids, F.create_map(F.lit("user"), F.lit("a"), F.lit("n"), F.lit("1")).alias("values"))
    out = W.requests(bound, txs, ops, seed=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "dynamicVariables" not in plan
    # the one cut for each row is that of a filled URL, at its references to the payload
    assert plan.count("regexp_extract_all") == 1
    assert {(r.ordinal, r.op_index): (r.request_url, r.sleep_us) for r in out.collect()} == {
        (i, op): part for i in range(3) for op, part in ((0, (None, 1_500_000)), (1, ("http://shop/a/1", None)))}


def test_names_of_bindings_are_looked_up_once(spark):
    """The last of bindings with one name is found on the table of definitions, not again for each row."""
    data = [{"name": "n", "generatorReferenceId": g} for g in ("k", "c")]
    doc = {"templateId": "w", "generators": [{"id": "k", "type": "constant", "constant": "x"}, {"id": "c", "type": "counter", "start": 5}],
           "transactions": [{"id": "x1", "transactionReferenceId": "t", "count": 2, "data": data}]}
    workloads = S.parse(spark.createDataFrame([("f", json.dumps(doc), "workload")], "file string, text string, kind string"), "workload")
    rows = spark.range(2).select(F.lit("w").alias("workload"), F.lit("x1").alias("tx_ref"), F.col("id").alias("ordinal"))
    bound = W.bind_all(rows, workloads, seed=1)
    assert "array_contains" not in bound._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.ordinal, r["values"]) for r in bound.collect()) == [(0, {"n": "5"}), (1, {"n": "6"})]


def test_texts_cut_before_they_are_filled(spark):
    """Placeholders side by side and at both ends, none, unknown ones, pauses drawn for a row, references that a value brings."""
    values = F.create_map(*[F.lit(x) for x in ("a", "1", "b", "", "ref", "@@k.x@@", "odd", "{{a}}", "s", "2.5")])
    cases = {
        "{{a}}{{b}}{{a}}": "11", "-{{a}}": "-1", "{{odd}}+{{a}}": "{{a}}+1", "": "", "plain": "plain", "{{a}} {{gone}}": None, None: None,
        "{{ref}}/{{a}}": "@@k.x@@/1", "@@k.{{gone}}@@": None,
    }
    in_payload = {**cases, "{{ref}}/{{a}}": "seven/1", "@@k.y@@": None, "@@k.x@@@@k.x@@": "sevenseven", "@@": "@@"}
    payload = F.lit('{"k": {"x": "seven"}}')
    df = spark.createDataFrame([(t,) for t in in_payload], "t string").repartition(2)
    rows = df.select("t", T.render_text(F.col("t"), values).alias("text"), T.render_url(F.col("t"), values, payload).alias("url")).collect()
    assert {r.t: r.text for r in rows if r.t in cases} == cases and {r.t: r.url for r in rows} == in_payload
    ops = S.parse(spark.createDataFrame([(json.dumps({"templateId": n, "type": "sleep", "duration": d, "units": "seconds"}), "op", n) for n, d in
                                         (("p", "{{s}}"), ("q", "4"), ("r", "long"), ("u", "{{gone}}"))], "text string, kind string, file string"), "op")
    steps = [{"operationReferenceId": n, "id": n} for n in "pqrup"]
    txs = S.parse(spark.createDataFrame([(json.dumps({"templateId": "t", "operations": steps}), "tx", "t")], "text string, kind string, file string"), "tx")
    bound = spark.range(1).select(F.lit("w").alias("workload"), F.lit("x").alias("tx_ref"), F.lit("t").alias("transaction"), F.col("id").alias("ordinal"), values.alias("values"))
    got = {r.op_index: (r.sleep_us, r.offset_us) for r in W.requests(bound, txs, ops, seed=1).collect()}
    assert got == {0: (2_500_000, 0), 1: (4_000_000, 2_500_000), 2: (None, 6_500_000), 3: (None, 6_500_000), 4: (2_500_000, 6_500_000)}


FAULTS = {
    "op_1": ({**OPERATIONS["add"], "templateId": ""}, "templateId is empty"),
    "op_2": ({"templateId": "o", "type": "non-http"}, "unknown operation type"),
    "op_3": ({"templateId": "o", "type": "http", "url": "http://shop"}, "unknown http method"),
    "op_4": ({"templateId": "o", "type": "http", "httpMethod": "get"}, "url is empty"),
    "op_5": ({**OPERATIONS["add"], "dynamicVariables": [{"name": "n", "type": "guid"}]}, "argument and variable share a name"),
    "op_6": ({**OPERATIONS["nap"], "units": "weeks"}, "unknown units"),
    "tx_1": ({"templateId": "y", "operations": []}, "no operations"),
    "tx_2": ({"operations": TRANSACTION["operations"]}, "templateId is empty"),
    "tx_3": ({"templateId": "y", "operations": [{"id": "o1"}]}, "operation reference is empty"),
    "tx_4": ({"templateId": "y", "operations": [{"operationReferenceId": "gone", "id": "o1"}]}, "unknown operation gone"),
    "workload_1": ({**WORKLOAD, "templateId": " "}, "templateId is empty"),
    "workload_2": ({**WORKLOAD, "transactions": []}, "no transactions"),
    "workload_3": ({**WORKLOAD, "generators": [{"id": "u", "type": "dice"}, {"id": "c", "type": "counter"}]}, "unknown generator type"),
    "workload_4": ({**WORKLOAD, "generators": [{"id": "u", "type": "guid"}]}, "unknown generator c"),
    "workload_5": ({**WORKLOAD, "transactions": [{"id": "x", "transactionReferenceId": "gone", "count": 0}]}, "count is missing"),
}


def test_definition_faults(spark, folder):
    write, path = folder
    for name, (doc, _) in FAULTS.items():
        write(name, doc)
    found = {(r.file, r.error) for r in S.definition_errors(*parsed(spark, path)).collect()}
    expected = {(f"{name}.json", error) for name, (_, error) in FAULTS.items()}
    expected.add(("workload_5.json", "unknown transaction gone"))
    assert found == expected


def test_rendering(spark):
    stops = '[{"at": "quay", "min": 4}, {"at": "mill", "min": 9}]'
    values = F.create_map(*[F.lit(x) for x in (
        "line", "17", "town", "Old Port", "note", "", "stops", stops, "live", "True", "odd", '{{line}} "q" \\ $1', "bad", "x1")])
    kinds = F.create_map(*[F.lit(x) for x in (
        "line", "number", "town", "string", "note", "null", "stops", "array", "live", "boolean", "odd", "string", "bad", "number")])
    cases = {
        '{"bus":"{{line}}","via":["{{town}}"],"rem":"{{note}}"}': {"bus": 17, "via": ["Old Port"], "rem": None},
        '{"m":"{{@@stops[1].min@@}}","w":"{{@@stops[0].at@@}}","whole":"{{@@stops[1]@@}}"}': {"m": 9, "w": "quay", "whole": {"at": "mill", "min": 9}},
        '{"f":"{{live}}","t":"{{odd}}","all":"{{stops}}"}': {"f": True, "t": '{{line}} "q" \\ $1', "all": json.loads(stops)},
        '{"fixed":"as is"}': {"fixed": "as is"},
        '{"x":"{{unknown}}"}': None,
        '{"x":"{{bad}}"}': None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    got = {r.t: r.body for r in df.select("t", T.render_payload(F.col("t"), values, kinds).alias("body")).collect()}
    assert {t: b and json.loads(b) for t, b in got.items()} == cases
    one = spark.range(1)
    url = T.render_url(F.lit("http://bus/{{town}}/@@trip.driver@@"), values, F.lit('{"trip":{"driver":"Ines"}}'))
    plain = T.render_url(F.lit("http://bus/{{odd}}"), values, F.lit(None).cast("string"))
    row = one.select(url.alias("u"), plain.alias("p"), T.sleep_us(F.lit("2.5"), F.lit("Minutes")).alias("s")).first()
    assert (row.u, row.p, row.s) == ("http://bus/Old Port/Ines", 'http://bus/{{line}} "q" \\ $1', 150_000_000)
    specs = F.expr("array(named_struct('key', 'third', 'value', '$.trip.stops[2].at'), named_struct('key', 'no', 'value', '$.none'))")
    trip = '{"trip": {"stops": [{"at": "quay"}, {"at": "mill"}, {"at": "fort"}]}}'
    got = one.select(T.return_values(F.lit(trip), specs).alias("m")).first().m
    assert got == {"third": "fort"}


def test_names_declared_twice_do_not_fail(spark):
    items = F.expr("array(named_struct('name', 'a', 'type', '1'), named_struct('name', 'b', 'type', '2'), named_struct('name', 'a', 'type', '3'), named_struct('name', null, 'type', '4'))")
    old = F.create_map(F.lit("a"), F.lit("0"), F.lit("z"), F.lit("9"))
    rows = spark.range(1).select(old.alias("values"), F.map_from_entries(W.last_named(items)).alias("m"))
    row = W.with_values(rows, "o", F.col("m")).first()
    assert row.m == {"a": "3", "b": "2"} and row.o == {"a": "3", "b": "2", "z": "9"}


def test_draws(spark):
    ids = spark.range(20_000)
    raw = D.hashed_raw(3, "id")
    row = ids.select(D.uniform_int(raw, 1, 30).alias("n"), D.uniform_int(raw, -5, 5).alias("m")).agg(
        F.min("n"), F.max("n"), F.min("m"), F.max("m")).first()
    assert list(row) == [1, 29, -5, 4]
    counted = D.dense_counter(ids.select((F.col("id") * 4096).alias("id")).repartition(5), "id", "n", start=7)
    assert list(counted.agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()) == [7, 20_006, 20_000]
    assert counted.filter("n <> id / 4096 + 7").count() == 0
    ranked = D.zipf(ids.select("id", raw.alias("raw")), "raw", 100, "rank").groupBy("rank").count().collect()
    counts = {r["rank"]: r["count"] for r in ranked}
    assert sum(counts.values()) == 20_000
    assert abs(counts[1] / 20_000 - 1 / sum(1 / r for r in range(1, 101))) < 0.02
    # where a weight times a draw passes 2^63, ranks are those of exact integers
    wide = D.zipf(ids.select(((F.col("id") + 1) * 107_374 - 1).alias("raw")), "raw", 3000, "rank").collect()
    highs = list(accumulate(1_000_000_000 // r for r in range(1, 3001)))
    assert all(r["rank"] == bisect_right(highs, r.raw * highs[-1] >> 31) + 1 for r in wide)
    # a longer table begins like a shorter one
    small, large = (1 << 16), (1 << 16) + 5
    top = [D.zipf_table(spark, n, 1.2).filter("rank = 65536").first().high for n in (small, large)]
    assert top[0] == top[1]
    steep = D.zipf(ids.select("id", raw.alias("raw")), "raw", 5, "rank", exponent=2.0)
    assert steep.count() == 20_000


def test_values_between_operations(spark):
    returned = spark.createDataFrame(
        [(1, 0, "a", "x"), (1, 2, "a", "y"), (1, 2, "b", "z"), (2, 0, "a", "q")], "tx int, op_index int, name string, value string")
    latest = {(r.tx, r.name): r.value for r in W.latest_values(returned, ["tx"]).collect()}
    assert latest == {(1, "a"): "y", (1, "b"): "z", (2, "a"): "q"}
    wanted = spark.createDataFrame([(1, 0, "a"), (1, 2, "a"), (1, 3, "a"), (2, 1, "b")], "tx int, op_index int, name string")
    seen = {(r.tx, r.op_index): r.value for r in W.visible_values(wanted, returned, ["tx"]).collect()}
    assert seen == {(1, 0): None, (1, 2): "x", (1, 3): "y", (2, 1): None}


def test_blocks_of_running_totals(spark):
    from evwarden.operators.running import latest_before, running_total

    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").alias("pos"), (F.col("id") % 7).alias("v"), F.lit(0).alias("tie"))
    want = running_total(df, ["g"], "pos", "v", "s", block=10_000).collect()
    assert sorted(running_total(df, ["g"], "pos", "v", "s", block=13).collect()) == sorted(want)
    gaps = df.withColumn("v", F.when(F.col("pos") % 97 == 0, F.col("v")))
    want = latest_before(gaps, ["g"], "pos", "v", "tie", block=10_000).collect()
    assert sorted(map(str, latest_before(gaps, ["g"], "pos", "v", "tie", block=13).collect())) == sorted(map(str, want))


def test_broken_references_with_a_hot_key(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 1000, 0).otherwise(F.col("id") % 50).alias("k"))
    targets = spark.range(3, 40).withColumnRenamed("id", "t")
    want = rows.filter("k < 3 or k >= 40").count()
    nulls = spark.createDataFrame([(-1, None)], "id long, k int")
    assert S.missing_references(rows.unionByName(nulls), "k", targets, "t").count() == want


def test_cdc_envelope(spark):
    after = '{"_id": {"$oid": "5f"}, "shelf": {"$numberLong": "31"}}'
    doc = {"payload": {"before": None, "after": after, "source": {"db": "stock", "collection": "shelves"}, "op": "c", "ts_ms": 1700000123456}}
    gone = {"payload": {"before": '{"a": 1}', "after": None, "source": {"collection": "shelves"}, "op": "d", "ts_ms": 1}}
    empty = {"payload": {"before": None, "after": None, "source": {"collection": "shelves"}, "op": "d", "ts_ms": 1}}
    df = spark.createDataFrame([(json.dumps(d), n) for n, d in enumerate((doc, gone, empty))], "value string, seq long")
    got = {r.seq: (r.type, r.content, r.us) for r in cdc_events(df).select("*", F.unix_micros("ts").alias("us")).collect()}
    assert got == {0: ("shelves.c", after, 1700000123456000), 1: ("shelves.d", '{"a": 1}', 1000)}
