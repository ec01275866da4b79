"""Workload tables and definition checks, seeded by the supplied tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evwarden.functions import draws as D
from evwarden.functions import templates as T
from evwarden.plans import workload as W
from evwarden.queries.tables import micros, table
from evwarden.sources import definitions as S
from evwarden.sources.cdc import cdc_events


def gen_expand(spark: SparkSession, sf: str) -> DataFrame:
    refs = table(spark, sf, "customer").select("c_custkey", F.pmod(F.col("c_custkey") * 7, F.lit(50)).alias("count"))
    return W.expand_counts(refs, "count", chunk=16).select("c_custkey", "ordinal")


def gen_uniform(spark: SparkSession, sf: str) -> DataFrame:
    raw = D.lcg_raw("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", D.uniform_int(raw, 1, 100).alias("item"), D.uniform_int(raw, -500, 500).alias("offset"),
        D.uniform_int(raw).alias("free"), D.sample(raw, ["red", "green", "blue"]).alias("colour"),
    )


def gen_counter(spark: SparkSession, sf: str) -> DataFrame:
    return D.dense_counter(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "number", start=10)


def gen_zipf(spark: SparkSession, sf: str) -> DataFrame:
    drawn = table(spark, sf, "orders").select("o_orderkey", D.lcg_raw("o_orderkey").alias("raw"))
    return D.zipf(drawn, "raw", 200, "rank").select("o_orderkey", "rank")


def gen_guid(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", D.guid(F.lit(42), "c_custkey").alias("id"))


_WORKLOAD = {
    "templateId": "shop",
    "generators": [
        {"id": "user", "type": "string"},
        {"id": "price", "type": "unsignedInt", "distribution": "uniform", "min": 10, "max": 500},
        {"id": "n", "type": "counter", "start": 100},
        {"id": "region", "type": "constant", "constant": "eu"},
        {"id": "product", "type": "unsignedInt", "distribution": "zipfian", "min": 1, "max": 51},
    ],
    "transactions": [
        {"id": "F", "transactionReferenceId": "buy", "count": 1000, "data": [
            {"name": "user", "generatorReferenceId": "user"}, {"name": "price", "generatorReferenceId": "price"},
            {"name": "old_price", "generatorReferenceId": "price"}, {"name": "n", "generatorReferenceId": "n"}]},
        {"id": "O", "transactionReferenceId": "buy", "count": 1000, "data": [
            {"name": "n", "generatorReferenceId": "n"}, {"name": "region", "generatorReferenceId": "region"},
            {"name": "product", "generatorReferenceId": "product"}]},
    ],
}


def _orders_as_transactions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.lit("shop").alias("workload"), F.lit(10).alias("concurrency"), F.col("o_orderstatus").alias("tx_ref"),
        F.lit("buy").alias("transaction"), F.col("o_orderkey").alias("ordinal"),
    )


def _lcg_draw(purpose: str) -> Column:
    """The draw of the binding queries: repeatable in SQL."""
    return D.lcg_raw(F.col("ordinal") * 64 + sum(map(ord, purpose)) % 64)


def bind_values(spark: SparkSession, sf: str) -> DataFrame:
    bound = W.bind(_orders_as_transactions(spark, sf), _WORKLOAD, seed=1, draw=_lcg_draw)
    names = ["user", "price", "old_price", "n", "region", "product"]
    return bound.select("ordinal", F.size("values").alias("n_values"), *[F.col("values")[n].alias(n) for n in names])


def bind_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """The same values from the parsed table of definitions: two workloads, joined with their transactions."""
    other = {**_WORKLOAD, "templateId": "fair", "generators": [{**g, "start": 7} if g["id"] == "n" else g for g in _WORKLOAD["generators"]]}
    texts = [(f"workload_{w['templateId']}.json", json.dumps(w), "workload") for w in (_WORKLOAD, other)]
    workloads = S.parse(spark.createDataFrame(texts, "file string, text string, kind string"), "workload")
    rows = _orders_as_transactions(spark, sf).withColumn("workload", F.when(F.col("ordinal") % 2 == 0, "shop").otherwise("fair"))
    codes = lambda purpose: F.aggregate(F.split(purpose, ""), F.lit(0), lambda n, c: n + F.ascii(c))
    bound = W.bind_all(rows, workloads, seed=1, draw=lambda purpose: D.lcg_raw(F.col("ordinal") * 64 + codes(purpose) % 64))
    names = ["user", "price", "old_price", "n", "region", "product"]
    return bound.select("ordinal", "workload", F.size("values").alias("n_values"), *[F.col("values")[n].alias(n) for n in names])


def schedule_order(spark: SparkSession, sf: str) -> DataFrame:
    planned = W.schedule(_orders_as_transactions(spark, sf), seed=1, draw=_lcg_draw)
    return W.in_random_order(planned).select("ordinal", "order_key", "worker", "transaction_id")


def render_template(spark: SparkSession, sf: str) -> DataFrame:
    """Text, typed JSON, argument paths, payload references and query strings for every customer."""
    c = table(spark, sf, "customer")
    id, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    name = F.concat(F.lit("{{id}}-"), F.col("c_name"))
    items = F.format_string('[{"p": %s}, {"p": "%s"}]', nation, F.col("c_mktsegment"))
    values = F.create_map(
        F.lit("id"), id, F.lit("name"), name, F.lit("ok"), F.when(F.col("c_custkey") % 2 == 0, "True").otherwise("false"),
        F.lit("none"), F.lit(""), F.lit("items"), items,
    )
    kinds = F.create_map(*[F.lit(x) for x in ("id", "number", "name", "string", "ok", "boolean", "none", "null", "items", "array")])
    payload = F.lit(
        '{"who":{"name":"{{name}}","key":"{{id}}","ok":"{{ok}}","gone":"{{none}}"},'
        '"all":"{{items}}","first":"{{@@items[0].p@@}}","second":"{{@@items[1].p@@}}"}'
    )
    query = F.array(F.struct(F.lit("seg ment").alias("key"), F.col("c_mktsegment").alias("value")),
                    F.struct(F.lit("n").alias("key"), nation.alias("value")))
    rows = c.select("c_custkey", values.alias("v"), kinds.alias("k"), T.query_string(query).alias("query"))
    rows = rows.withColumn("body", T.render_payload(payload, F.col("v"), F.col("k")))
    headers = F.array(F.struct(F.lit("x-{{id}}").alias("key"), F.lit("{{name}}").alias("value")))
    return rows.select(
        "c_custkey", "body", "query",
        T.render_url(F.lit("http://shop/{{id}}/@@who.name@@/@@second@@"), F.col("v"), F.col("body")).alias("url"),
        F.to_json(T.render_headers(headers, F.col("v"))).alias("headers"),
        T.render_text(F.lit("{{unknown}}"), F.col("v")).isNull().alias("unknown_is_null"),
        F.size(T.missing_arguments(F.expr("array(named_struct('name', 'id', 'type', 'x'), named_struct('name', 'nope', 'type', 'x'))"),
                                   F.col("v"))).alias("n_missing"),
    )


def _returned(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a response from which values are extracted; ``odd`` exists in odd turns only."""
    specs = F.expr("array(named_struct('key', 'role', 'value', '$.role'), named_struct('key', 'chars', 'value', '$.stats.chars'), "
                   "named_struct('key', 'odd', 'value', '$.odd'))")
    payload = F.to_json(F.struct(
        "role", F.struct(F.length("text").alias("chars")).alias("stats"), F.when(F.col("turn") % 2 == 1, F.col("turn")).alias("odd")))
    return table(spark, sf, "conversations").select(
        "conv_id", F.col("turn").alias("op_index"), F.explode(T.return_values(payload, specs)).alias("name", "value")
    )


def value_fold(spark: SparkSession, sf: str) -> DataFrame:
    return W.latest_values(_returned(spark, sf), ["conv_id"])


def value_visible(spark: SparkSession, sf: str) -> DataFrame:
    wanted = table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("op_index"), F.lit("odd").alias("name"))
    return W.visible_values(wanted, _returned(spark, sf), ["conv_id"])


def returned_into_request(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as transactions of two operations; the second one's URL holds what the first one returned."""
    ops = S.parse(_texts(spark, "op", [
        '{"templateId": "ask", "type": "http", "httpMethod": "get", "url": "http://chat/ask"}',
        '{"templateId": "tell", "type": "http", "httpMethod": "get", "url": "http://chat/{{role}}/{{chars}}", '
        '"arguments": [{"name": "role", "type": "string"}, {"name": "chars", "type": "number"}]}',
    ]), "op")
    txs = S.parse(_texts(spark, "tx", [
        '{"templateId": "talk", "operations": [{"operationReferenceId": "ask", "id": "o1"}, {"operationReferenceId": "tell", "id": "o2"}]}'
    ]), "tx")
    ids = [F.lit("chat").alias("workload"), F.lit("t").alias("tx_ref"), F.col("conv_id").alias("ordinal")]
    bound = table(spark, sf, "conversations").select("conv_id").distinct().select(
        *ids, F.lit("talk").alias("transaction"), F.create_map(F.lit("chars"), F.lit("none")).alias("values"))
    responses = _returned(spark, sf).select(*ids, "op_index", "name", "value")
    out = W.requests(bound, txs, ops, seed=1, responses=responses)
    return out.select(F.col("ordinal").alias("conv_id"), "operation_ref", F.col("request_url").alias("url"), F.size("missing").alias("n_missing"))


def sleep_offsets(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(
        F.lit("w").alias("workload"), F.col("conv_id").alias("tx_ref"), F.lit(0).alias("ordinal"), F.col("turn").alias("op_index"),
        T.sleep_us(F.length("text").cast("string"), F.when(F.col("role") == "user", "Milliseconds").otherwise("seconds")).alias("sleep_us"),
    )
    return W.planned_offsets(turns).select(F.col("tx_ref").alias("conv_id"), F.col("op_index").alias("turn"), "offset_us")


def _documents(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Definition documents made of parts, with faults tied to the part size."""
    p = table(spark, sf, "part").withColumn("k", F.col("p_partkey").cast("string"))
    size = F.col("p_size")
    named = lambda name: F.array(F.struct(name.alias("name"), F.lit("string").alias("type")))
    ops = F.to_json(F.struct(
        F.when(size == 1, "").otherwise(F.concat(F.lit("op"), "k")).alias("templateId"),
        F.when(size == 2, "ftp").otherwise("http").alias("type"),
        F.when(size != 3, "get").alias("httpMethod"),
        F.when(size == 4, "").otherwise("http://shop/{{a}}").alias("url"),
        named(F.lit("a")).alias("arguments"),
        F.when(size == 11, F.concat(named(F.lit("b")), named(F.lit("b")))).otherwise(named(F.when(size == 5, "a").otherwise("b"))).alias("dynamicVariables")))
    txs = F.to_json(F.struct(
        F.concat(F.lit("tx"), "k").alias("templateId"), F.when(size == 12, named(F.lit("b"))).alias("dynamicVariables"),
        F.array(F.struct(F.concat(F.lit("op"), "k").alias("operationReferenceId"), F.when(size == 7, "").otherwise("o1").alias("id"))).alias("operations")))
    gens = F.array(F.struct(F.lit("g").alias("id"), F.when(size == 8, "dice").otherwise("guid").alias("type")))
    data = F.array(F.struct(F.lit("a").alias("name"), F.when(size == 6, "h").otherwise("g").alias("generatorReferenceId")))
    wls = F.to_json(F.struct(
        F.concat(F.lit("w"), "k").alias("templateId"), gens.alias("generators"),
        F.array(F.struct(F.lit("t1").alias("id"), F.concat(F.lit("tx"), F.when(size == 9, "none").otherwise(F.col("k"))).alias("transactionReferenceId"),
                         F.pmod(size, F.lit(10)).alias("count"), data.alias("data"))).alias("transactions")))
    docs = {"op": ops, "tx": txs, "workload": wls}
    return {
        kind: S.parse(p.select(F.concat_ws("_", F.lit(kind), "k").alias("file"), F.lit(kind).alias("kind"), text.alias("text")), kind)
        for kind, text in docs.items()
    }


def definition_checks(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf)
    found = S.definition_errors(d["op"], d["tx"], d["workload"])
    error = F.regexp_replace("error", " (op|tx)[0-9a-z]*$| h$", "")
    return found.select(F.split("file", "_")[0].alias("kind"), F.split("file", "_")[1].cast("bigint").alias("part"), error.alias("error"))


def request_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as transactions of two operations, or of one that nothing declares, with the rendered parts of each operation."""
    ops = S.parse(_texts(spark, "op", [
        '{"templateId": "nap", "type": "sleep", "duration": "1.5", "units": "seconds"}',
        '{"templateId": "add", "type": "http", "httpMethod": "post", "url": "http://shop/{{n}}/@@item.price@@", '
        '"arguments": [{"name": "n", "type": "number"}, {"name": "price", "type": "number"}], '
        '"dynamicVariables": [{"name": "key", "type": "string"}, {"name": "key", "type": "guid"}], '
        '"requestPayload": {"type": "json", "content": {"item": {"price": "{{price}}", "key": "{{key}}"}}}}',
    ]), "op")
    txs = S.parse(_texts(spark, "tx", [
        '{"templateId": "buy", "operations": [{"operationReferenceId": "nap", "id": "o1"}, {"operationReferenceId": "add", "id": "o2"}]}',
        '{"templateId": "look", "dynamicVariables": [{"name": "key", "type": "guid"}], "operations": [{"operationReferenceId": "add", "id": "o3"}]}',
    ]), "tx")
    kind = F.when(F.col("tx_ref") == "P", "look").otherwise("buy")
    bound = W.bind(_orders_as_transactions(spark, sf).withColumn("transaction", kind), _WORKLOAD, seed=1, draw=_lcg_draw)
    out = W.requests(bound, txs, ops, seed=1, spread=spark.sparkContext.defaultParallelism)
    item = lambda name: F.get_json_object("body", f"$.item.{name}")
    return out.select(
        "ordinal", "tx_ref", "operation_ref", "method", "offset_us", F.col("request_url").alias("url"),
        item("price").cast("bigint").alias("price"), item("key").alias("key"), F.size("missing").alias("n_missing"),
    )


def _texts(spark: SparkSession, kind: str, texts: list[str]) -> DataFrame:
    return spark.createDataFrame([(t, kind, kind) for t in texts], "text string, kind string, file string")


def cdc_read(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    row, gone = F.to_json(F.struct("o_orderkey", "o_orderstatus")), F.col("o_orderstatus") == "F"
    envelope = F.to_json(F.struct(F.struct(
        F.when(gone, row).alias("before"), F.when(~gone, row).alias("after"),
        F.struct(F.lit("shop").alias("db"), F.lit("orders").alias("collection")).alias("source"),
        F.when(gone, "d").otherwise("c").alias("op"), F.floor(micros("o_orderdate") / 1000).cast("bigint").alias("ts_ms"),
    ).alias("payload")))
    events = cdc_events(o.select(envelope.alias("value"), F.col("o_orderkey").alias("seq")))
    return events.select("seq", "type", F.unix_micros("ts").alias("us"), F.get_json_object("content", "$.o_orderstatus").alias("status"))


def ref_integrity(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda name: table(spark, sf, name)
    unlabelled = S.missing_references(t("documents"), "doc_id", t("labels"), "doc_id").select(F.lit("documents").alias("rows"), F.col("doc_id").alias("key"))
    lineless = S.missing_references(t("orders"), "o_orderkey", t("lineitem"), "l_orderkey").select(F.lit("orders").alias("rows"), F.col("o_orderkey").alias("key"))
    return unlabelled.unionByName(lineless)


QUERIES = {
    f.__name__: f
    for f in (
        gen_expand, gen_uniform, gen_counter, gen_zipf, gen_guid, bind_values, bind_definitions, schedule_order, render_template, value_fold,
        value_visible, returned_into_request, sleep_offsets, definition_checks, request_table, cdc_read, ref_integrity,
    )
}


def _raw(id: str) -> str:
    return f"((({id}) % 2147483648 * 1103515245 + 12345) % 2147483648)"


def _draw(purpose: str) -> str:
    return _raw(f"o_orderkey * 64 + {sum(map(ord, purpose)) % 64}")


def _ranked(ranks: int) -> str:
    return (
        f"z AS (SELECT r AS rank, sum(1000000000 // r) OVER (ORDER BY r) - 1000000000 // r AS lo, sum(1000000000 // r) OVER (ORDER BY r) AS hi "
        f"FROM range(1, {ranks + 1}) g(r)), zt AS (SELECT max(hi) AS total FROM z)"
    )


_BODY = (
    "'{\"who\":{\"name\":\"' || name || '\",\"key\":' || c_custkey || ',\"ok\":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || "
    "',\"gone\":null},\"all\":[{\"p\": ' || c_nationkey || '}, {\"p\": \"' || c_mktsegment || '\"}],\"first\":' || c_nationkey || "
    "',\"second\":\"' || c_mktsegment || '\"}'"
)
_GUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)"
_VALS = (
    "r AS (SELECT conv_id, turn, role, length(text) AS chars, CASE WHEN turn % 2 = 1 THEN turn END AS odd FROM conversations)"
)

ORACLES = {
    "gen_expand": "SELECT c_custkey, unnest(range(0, (c_custkey * 7) % 50)) AS ordinal FROM customer",
    "gen_uniform": (
        f"WITH x AS (SELECT o_orderkey, {_raw('o_orderkey')} AS raw FROM orders) SELECT o_orderkey, (raw * 99) // 2147483648 + 1 AS item, "
        "(raw * 1000) // 2147483648 - 500 AS \"offset\", (raw * 2147483647) // 2147483648 AS free, "
        "CASE raw % 3 WHEN 0 THEN 'red' WHEN 1 THEN 'green' ELSE 'blue' END AS colour FROM x"
    ),
    "gen_counter": "SELECT o_orderkey, 9 + row_number() OVER (ORDER BY o_orderkey) AS number FROM orders",
    "gen_zipf": (
        f"WITH {_ranked(200)}, x AS (SELECT o_orderkey, CAST(CAST({_raw('o_orderkey')} AS HUGEINT) * total // 2147483648 AS BIGINT) AS pick FROM orders, zt) "
        "SELECT o_orderkey, rank FROM x JOIN z ON pick >= lo AND pick < hi"
    ),
    "gen_guid": f"WITH x AS (SELECT c_custkey, md5('42:' || c_custkey) AS h FROM customer) SELECT c_custkey, {_GUID} AS id FROM x",
    "bind_values": (
        f"WITH {_ranked(50)}, x AS (SELECT o_orderkey AS ordinal, o_orderstatus AS s, {_draw('price/price')} AS r1, {_draw('price/old_price')} AS r2, "
        f"CAST(CAST({_draw('product/product')} AS HUGEINT) * total // 2147483648 AS BIGINT) AS pick FROM orders, zt) "
        "SELECT ordinal, CASE s WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 0 END AS n_values, CASE WHEN s = 'F' THEN '1000-00000-00000000' END AS \"user\", "
        "CASE WHEN s = 'F' THEN CAST((r1 * 490) // 2147483648 + 10 AS VARCHAR) END AS price, "
        "CASE WHEN s = 'F' THEN CAST((r2 * 490) // 2147483648 + 10 AS VARCHAR) END AS old_price, "
        "CASE s WHEN 'F' THEN CAST(ordinal + 100 AS VARCHAR) WHEN 'O' THEN CAST(ordinal + 1100 AS VARCHAR) END AS n, "
        "CASE WHEN s = 'O' THEN 'eu' END AS region, CASE WHEN s = 'O' THEN CAST(rank AS VARCHAR) END AS product "
        "FROM x JOIN z ON pick >= lo AND pick < hi"
    ),
    "bind_definitions": (
        f"WITH {_ranked(50)}, x AS (SELECT o_orderkey AS ordinal, o_orderstatus AS s, {_draw('price/price')} AS r1, {_draw('price/old_price')} AS r2, "
        f"CAST(CAST({_draw('product/product')} AS HUGEINT) * total // 2147483648 AS BIGINT) AS pick FROM orders, zt) "
        "SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN 'shop' ELSE 'fair' END AS workload, CASE s WHEN 'F' THEN 4 WHEN 'O' THEN 3 ELSE 0 END AS n_values, CASE WHEN s = 'F' THEN '1000-00000-00000000' END AS \"user\", "
        "CASE WHEN s = 'F' THEN CAST((r1 * 490) // 2147483648 + 10 AS VARCHAR) END AS price, "
        "CASE WHEN s = 'F' THEN CAST((r2 * 490) // 2147483648 + 10 AS VARCHAR) END AS old_price, "
        "CASE s WHEN 'F' THEN CAST(ordinal + CASE WHEN ordinal % 2 = 0 THEN 100 ELSE 7 END AS VARCHAR) WHEN 'O' THEN CAST(ordinal + 1000 + CASE WHEN ordinal % 2 = 0 THEN 100 ELSE 7 END AS VARCHAR) END AS n, "
        "CASE WHEN s = 'O' THEN 'eu' END AS region, CASE WHEN s = 'O' THEN CAST(rank AS VARCHAR) END AS product "
        "FROM x JOIN z ON pick >= lo AND pick < hi"
    ),
    "schedule_order": (
        f"WITH x AS (SELECT o_orderkey AS ordinal, {_draw('order')} AS order_key, CAST({_draw('worker')} % 10 AS INTEGER) AS worker, "
        f"md5('1:shop:' || o_orderstatus || ':' || o_orderkey) AS h FROM orders) SELECT ordinal, order_key, worker, {_GUID} AS transaction_id FROM x"
    ),
    "render_template": (
        "WITH c AS (SELECT *, '{{id}}-' || c_name AS name FROM customer) "
        f"SELECT c_custkey, {_BODY} AS body, 'seg+ment=' || c_mktsegment || '&n=' || c_nationkey AS query, "
        "'http://shop/' || c_custkey || '/' || name || '/' || c_mktsegment AS url, "
        "'[{\"key\":\"x-' || c_custkey || '\",\"value\":\"' || name || '\"}]' AS headers, true AS unknown_is_null, 1 AS n_missing FROM c"
    ),
    "value_fold": (
        f"WITH {_VALS} SELECT conv_id, 'role' AS name, arg_max(role, turn) AS value FROM r GROUP BY 1 "
        "UNION ALL SELECT conv_id, 'chars', CAST(arg_max(chars, turn) AS VARCHAR) FROM r GROUP BY 1 "
        "UNION ALL SELECT conv_id, 'odd', CAST(max(odd) AS VARCHAR) FROM r WHERE odd IS NOT NULL GROUP BY 1"
    ),
    "value_visible": (
        f"WITH {_VALS} SELECT conv_id, 'odd' AS name, turn AS op_index, CAST(max(odd) OVER (PARTITION BY conv_id ORDER BY turn "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) AS value FROM r"
    ),
    "returned_into_request": (
        "SELECT DISTINCT conv_id, 'o1' AS operation_ref, 'http://chat/ask' AS url, 0 AS n_missing FROM conversations UNION ALL "
        "SELECT c.conv_id, 'o2', 'http://chat/' || f.role || '/' || length(f.text), CASE WHEN f.role IS NULL THEN 1 ELSE 0 END "
        "FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT * FROM conversations WHERE turn = 0) f USING (conv_id)"
    ),
    "sleep_offsets": (
        f"WITH {_VALS}, s AS (SELECT conv_id, turn, chars * CASE WHEN role = 'user' THEN 1000 ELSE 1000000 END AS us FROM r) "
        "SELECT conv_id, turn, CAST(coalesce(sum(us) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_us FROM s"
    ),
    "definition_checks": (
        "WITH p AS (SELECT p_partkey AS part, p_size AS s FROM part) "
        "SELECT 'op' AS kind, part, 'templateId is empty' AS error FROM p WHERE s = 1 "
        "UNION ALL SELECT 'op', part, 'unknown operation type' FROM p WHERE s = 2 "
        "UNION ALL SELECT 'op', part, 'unknown http method' FROM p WHERE s = 3 "
        "UNION ALL SELECT 'op', part, 'url is empty' FROM p WHERE s = 4 "
        "UNION ALL SELECT 'op', part, 'argument and variable share a name' FROM p WHERE s = 5 "
        "UNION ALL SELECT 'op', part, 'a name is declared twice' FROM p WHERE s = 11 "
        "UNION ALL SELECT 'tx', part, 'operation id is empty' FROM p WHERE s = 7 "
        "UNION ALL SELECT 'tx', part, 'unknown operation' FROM p WHERE s = 1 "
        "UNION ALL SELECT 'tx', part, 'variable clashes with an operation''s b' FROM p WHERE s = 12 "
        "UNION ALL SELECT 'workload', part, 'count is missing' FROM p WHERE s % 10 = 0 "
        "UNION ALL SELECT 'workload', part, 'unknown generator' FROM p WHERE s = 6 "
        "UNION ALL SELECT 'workload', part, 'unknown generator type' FROM p WHERE s = 8 "
        "UNION ALL SELECT 'workload', part, 'unknown transaction' FROM p WHERE s = 9"
    ),
    "request_table": (
        f"WITH x AS (SELECT o_orderkey AS ordinal, o_orderstatus AS s, ({_draw('price/price')} * 490) // 2147483648 + 10 AS price, "
        "CASE o_orderstatus WHEN 'F' THEN o_orderkey + 100 WHEN 'O' THEN o_orderkey + 1100 END AS n, "
        "md5('1:key:' || o_orderstatus || ':' || o_orderkey || ':1') AS h FROM orders) "
        "SELECT ordinal, s AS tx_ref, 'o1' AS operation_ref, NULL AS method, 0 AS offset_us, NULL AS url, NULL AS price, NULL AS key, 0 AS n_missing "
        "FROM x WHERE s <> 'P' "
        f"UNION ALL SELECT ordinal, s, 'o2', 'POST', 1500000, 'http://shop/' || n || '/' || price, CAST(price AS BIGINT), {_GUID}, 0 FROM x WHERE s = 'F' "
        "UNION ALL SELECT ordinal, s, 'o2', 'POST', 1500000, 'http://shop/' || n || '/@@item.price@@', NULL, NULL, 1 FROM x WHERE s = 'O' "
        "UNION ALL SELECT ordinal, s, 'o3', 'POST', 0, NULL, NULL, NULL, 2 FROM x WHERE s = 'P'"
    ),
    "cdc_read": (
        "SELECT o_orderkey AS seq, 'orders.' || CASE WHEN o_orderstatus = 'F' THEN 'd' ELSE 'c' END AS type, epoch_us(o_orderdate) AS us, o_orderstatus AS status FROM orders"
    ),
    "ref_integrity": (
        "SELECT 'documents' AS rows, doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) "
        "UNION ALL SELECT 'orders', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)"
    ),
}
