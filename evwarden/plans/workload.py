"""Workload tables: from definitions to a table of rendered requests.

``expand`` → ``bind`` → ``requests``.  Every value is a function of ids and a
seed, so the tables need no shared generator state and no order of execution.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.functions.draws import guid, hashed_raw, sample, uniform_int, zipf
from evwarden.operators.running import latest_before, running_total
from evwarden.sinks.scratch import stored
from evwarden.functions.templates import (
    fill_headers,
    fill_payload,
    fill_text,
    fill_url,
    header_parts,
    missing_arguments,
    payload_parts,
    query_string,
    render_text,
    sleep_us,
    text_parts,
)

DEFAULT_CONCURRENCY = 10
# Fixed value: the one string a plain string generator gives.
FIXED_STRING = "1000-00000-00000000"
_CHUNK = 65_536


def expand_counts(refs: DataFrame, count: str, ordinal: str = "ordinal", chunk: int = _CHUNK) -> DataFrame:
    """Every row ``count`` times, numbered from 0.

    A count is cut into chunks first and the chunks are spread over the
    cluster, so one row with a huge count is not one task.
    """
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / F.lit(chunk)).cast("bigint"))
    parts = refs.filter(F.col(count) > 0).withColumn("_chunk", F.explode(chunks))
    first = F.col("_chunk") * F.lit(chunk)
    last = F.least(first + F.lit(chunk), F.col(count).cast("bigint")) - 1
    return parts.repartition("_chunk", *refs.columns[:1]).withColumn(ordinal, F.explode(F.sequence(first, last))).drop("_chunk")


def transactions_of(workloads: DataFrame) -> DataFrame:
    """One row per transaction reference of a workload."""
    return workloads.select(
        F.col("templateId").alias("workload"),
        F.coalesce("maxConcurrentTransactions", F.lit(DEFAULT_CONCURRENCY)).alias("concurrency"),
        F.explode("transactions").alias("t"),
    ).select(
        "workload", "concurrency", F.col("t.id").alias("tx_ref"),
        F.col("t.transactionReferenceId").alias("transaction"), F.col("t.count").alias("count"),
    )


# Raw draw of a row for a purpose; the default hashes the purpose with the ids of the row.
Draw = Callable[[str], Column]
_IDS = ["workload", "tx_ref", "ordinal"]


def hashed_draw(seed: int) -> Draw:
    return lambda purpose: hashed_raw(seed, F.lit(purpose), *_IDS)


def schedule(expanded: DataFrame, seed: int, draw: Draw | None = None) -> DataFrame:
    """Adds ids, the random execution order and the worker of every transaction."""
    draw = draw or hashed_draw(seed)
    return expanded.select(
        "*",
        guid(F.lit(seed), "workload").alias("workload_id"),
        guid(F.lit(seed), *_IDS).alias("transaction_id"),
        draw("order").alias("order_key"),
        F.pmod(draw("worker"), F.col("concurrency")).cast("int").alias("worker"),
    )


def in_random_order(scheduled: DataFrame) -> DataFrame:
    return scheduled.orderBy("order_key", "transaction_id")


def bind(expanded: DataFrame, workload: Mapping[str, Any], seed: int, draw: Draw | None = None) -> DataFrame:
    """Adds ``values`` (argument → text): one independent draw per reference to a generator.

    ``workload`` is one workload document; its few generators become column expressions.
    """
    draw = draw or hashed_draw(seed)
    generators = {g["id"]: g for g in workload.get("generators") or []}
    counters = _counter_offsets(workload, generators)
    names: dict[str, list[Column]] = {}
    for tx in workload["transactions"]:
        entries = []
        for n, ref in enumerate(tx.get("data") or []):
            gen = generators[ref["generatorReferenceId"]]
            raw = draw(f"{gen['id']}/{ref['name']}")
            if gen["type"].lower() == "counter":
                offset, uses, position = counters[(tx["id"], n)]
                value = F.col("ordinal") * F.lit(uses) + F.lit(offset + position + (gen.get("start") or 0))
            elif (gen.get("distribution") or "").lower() == "zipfian":
                column, ranks = f"_z{len(names)}_{n}", _space_size(gen)
                draws = expanded.withColumn("_raw", raw)
                expanded = zipf(draws, "_raw", ranks, column, gen.get("exponent") or 1.0).drop("_raw")
                value = _from_space(gen, F.col(column) - 1)
            else:
                value = generated(gen, raw, seed)
            entries.append((ref["name"], value.cast("string")))
        names[tx["id"]] = entries
    values = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    for tx_ref, entries in names.items():
        if entries:
            bound = F.create_map(*[c for name, value in entries for c in (F.lit(name), value)])
            values = F.when(F.col("tx_ref") == tx_ref, bound).otherwise(values)
    base = [c for c in expanded.columns if not c.startswith("_z")]
    return expanded.select(*base, values.alias("values"))


# Raw draw of a row for the purpose in a column.
ColumnDraw = Callable[[Column], Column]


def bindings(workloads: DataFrame) -> DataFrame:
    """(workload, tx_ref, bound): for each transaction reference of the parsed workloads what its arguments draw from.

    ``bound`` holds, in the order of the document, the argument's name, the fields of its generator, the purpose of the draw and, for
    a counter, the draws made before the transaction, those in one transaction and the place among them.
    """
    tx = workloads.select(F.col("templateId").alias("workload"), "generators", F.posexplode("transactions").alias("t", "tx"))
    refs = tx.select("workload", "generators", "t", F.col("tx.id").alias("tx_ref"), F.col("tx.count").alias("count"), F.posexplode("tx.data").alias("d", "ref"))
    gen = F.get(F.filter("generators", lambda g: g["id"] == F.col("ref.generatorReferenceId")), 0)
    refs = refs.withColumn("gen", gen).where("gen IS NOT NULL")
    # tables of definitions: a row for each reference to a generator
    here = Window.partitionBy("workload", "t", "gen.id")
    earlier = Window.partitionBy("workload", "gen.id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    refs = refs.select(
        "*", F.count("*").over(here).alias("uses"), (F.row_number().over(here.orderBy("d")) - 1).alias("place"),
        F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"),
    )
    one = F.struct(
        "d", F.col("ref.name").alias("name"), F.concat("gen.id", F.lit("/"), "ref.name").alias("purpose"), F.lower("gen.type").alias("kind"),
        (F.lower(F.coalesce("gen.distribution", F.lit(""))) == "zipfian").alias("zipfian"), "gen", "uses", "place", "before",
    )
    return refs.groupBy("workload", "tx_ref").agg(F.sort_array(F.collect_list(one)).alias("bound"))


def bind_all(expanded: DataFrame, workloads: DataFrame, seed: int, draw: ColumnDraw | None = None) -> DataFrame:
    """As :func:`bind`, for the transactions of all ``workloads`` (a table as :func:`evwarden.sources.definitions.parse` gives it).

    Definitions are joined, one row for each transaction reference; values come from array functions. Zipfian draws, whose tables of ranks do not fit
    a row, are made by a join for each size of such a table and put together for each transaction. References to unknown generators bind nothing.
    """
    draw = draw or (lambda purpose: hashed_raw(seed, purpose, *_IDS))
    found = stored(bindings(workloads).withColumn("bound", last_named(F.col("bound"))), "bindings")
    joined = expanded.join(found, ["workload", "tx_ref"], "left")
    plain = F.filter("bound", lambda b: ~(b["zipfian"] & (b["kind"] != "counter")))
    pairs = F.transform(plain, lambda b: F.struct(b["name"], _drawn(b, draw(b["purpose"]), seed)))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    out = joined.withColumn("values", F.coalesce(F.map_from_entries(pairs), none)).drop("bound")
    skewed = found.select("workload", "tx_ref", F.explode("bound").alias("b")).where("b.zipfian AND b.kind <> 'counter'")
    space, size = F.col("b.gen.sampleSpace"), F.col("b.gen.max") - F.col("b.gen.min")
    skewed = skewed.withColumn("ranks", F.when(F.size(space) > 0, F.size(space)).otherwise(size)).withColumn("exponent", F.coalesce("b.gen.exponent", F.lit(1.0)))
    parts = []
    for ranks, exponent in skewed.select("ranks", "exponent").distinct().collect():  # as many as definitions have generators
        if ranks is None:
            raise ValueError("a zipfian draw needs bounds or a sample space")
        mine = skewed.where((F.col("ranks") == ranks) & (F.col("exponent") == exponent)).select("workload", "tx_ref", "b")
        rows = expanded.select(*_IDS).join(mine, ["workload", "tx_ref"]).withColumn("raw", draw(F.col("b.purpose")))
        rank = zipf(rows, "raw", ranks, "rank", exponent)
        value = F.when(F.size("b.gen.sampleSpace") > 0, F.get("b.gen.sampleSpace", (F.col("rank") - 1).cast("int"))).otherwise((F.col("rank") - 1 + F.col("b.gen.min")).cast("string"))
        parts.append(rank.select(*_IDS, F.struct(F.col("b.name"), value).alias("pair")))
    if not parts:
        return out
    more = reduce(DataFrame.unionByName, parts).groupBy(*_IDS).agg(F.map_from_entries(F.collect_list("pair")).alias("_more"))
    out = out.join(more, _IDS, "left")
    return out.select(*expanded.columns, F.when(F.col("_more").isNull(), F.col("values")).otherwise(F.map_concat("values", "_more")).alias("values"))


def _drawn(b: Column, raw: Column, seed: int) -> Column:
    """The text that a binding gives for its raw draw."""
    gen = b["gen"]
    bounded = gen["min"].isNotNull() & gen["max"].isNotNull()
    low, high = F.when(bounded, gen["min"]).otherwise(0).cast("bigint"), F.when(bounded, gen["max"]).otherwise((1 << 31) - 1).cast("bigint")
    number = F.when(high <= low, low).otherwise(F.floor(F.shiftright(raw * (high - low), 31)).cast("bigint") + low)
    counter = F.col("ordinal") * b["uses"] + b["before"] + b["place"] + F.coalesce(gen["start"], F.lit(0))
    return (
        F.when(b["kind"] == "counter", counter.cast("string"))
        .when(F.size(gen["sampleSpace"]) > 0, F.get(gen["sampleSpace"], F.pmod(raw, F.size(gen["sampleSpace"])).cast("int")))
        .when(b["kind"].isin("unsignedint", "signedint"), number.cast("string"))
        .when(b["kind"] == "string", F.lit(FIXED_STRING))
        .when(b["kind"] == "guid", guid(F.lit(seed), gen["id"], raw, *_IDS))
        .when(b["kind"] == "constant", gen["constant"])
    )


def generated(gen: Mapping[str, Any], raw: Column, seed: int) -> Column:
    """A value of a generator that needs nothing but its raw draw."""
    kind = gen["type"].lower()
    if gen.get("sampleSpace"):
        return sample(raw, gen["sampleSpace"])
    if kind in ("unsignedint", "signedint"):
        return uniform_int(raw, gen.get("min"), gen.get("max"))
    if kind == "string":
        return F.lit(FIXED_STRING)
    if kind == "guid":
        return guid(F.lit(seed), F.lit(gen["id"]), raw, *_IDS)
    if kind == "constant":
        constant = gen.get("constant")
        return F.lit(constant if constant is None or isinstance(constant, str) else str(constant))
    raise ValueError(f"unknown generator type {gen['type']!r}")


def dynamic_values(variables: Column, seed: int, *ids: Column | str) -> Column:
    """Random value per dynamic variable (``array<struct<name, type>>``, names differ: :func:`last_named`) as a map."""

    def value(v: Column) -> Column:
        raw = hashed_raw(seed, v["name"], *ids)
        kind = F.lower(v["type"])
        sign = F.when(F.pmod(F.xxhash64(F.lit(seed + 1), v["name"], *ids), F.lit(2)) == 0, F.lit(1)).otherwise(F.lit(-1))
        return (
            F.when(kind == "unsignedint", raw.cast("string"))
            .when(kind == "signedint", (raw * sign).cast("string"))
            .otherwise(guid(F.lit(seed), v["name"], *ids))
        )

    return F.coalesce(
        F.map_from_entries(F.transform(variables, lambda v: F.struct(v["name"], value(v)))),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")),
    )


def last_named(items: Column, name: str = "name") -> Column:
    """The items with a name; of those with the same name the last."""
    names = items[name]

    def again(v: Column, i: Column) -> Column:
        # null where the rest holds a null and not the name
        return F.coalesce(F.array_contains(F.slice(names, i + 2, F.size(names)), v[name]), F.lit(False))

    return F.filter(items, lambda v, i: v[name].isNotNull() & ~again(v, i))


def with_values(rows: DataFrame, out: str, more: Column) -> DataFrame:
    """``values`` and the map ``more`` in column ``out``; names of ``more`` replace those of ``values``."""
    both = rows.withColumn("_more", more).withColumn("_names", F.map_keys("_more"))
    old = F.map_filter("values", lambda k, _: ~F.array_contains("_names", k))
    merged = F.when(F.size("_names") == 0, F.col("values")).otherwise(F.map_concat(old, F.col("_more")))
    return both.withColumn(out, merged).drop("_more", "_names")


_OPERATION_FIELDS = (
    "type", "httpMethod", "url", "arguments", "dynamicVariables", "headers", "queryParameters", "requestPayload",
    "duration", "units",
)


def transaction_plans(transactions: DataFrame, operations: DataFrame) -> DataFrame:
    """Per transaction its operations in order, each with its definition made ready to fill: one small row per transaction.

    What does not depend on a row's values is done here: templates are cut, declared names and their kinds looked up.
    """
    refs = transactions.select(
        F.col("templateId").alias("transaction"), F.col("arguments").alias("tx_arguments"),
        last_named(F.col("dynamicVariables")).alias("tx_variables"), F.posexplode("operations").alias("op_index", "op"),
    ).select("*", F.col("op.operationReferenceId").alias("templateId"), F.col("op.id").alias("operation_ref"))
    joined = refs.join(operations.select("templateId", *_OPERATION_FIELDS), "templateId", "left")
    op = F.struct("op_index", "operation_ref", "templateId", *_OPERATION_FIELDS)
    plans = joined.groupBy("transaction").agg(
        F.first("tx_arguments").alias("tx_arguments"),
        F.first("tx_variables").alias("tx_variables"),
        F.sort_array(F.collect_list(op)).alias("ops"),
    )
    return plans.withColumn("ops", F.transform("ops", _ready))


def _ready(op: Column) -> Column:
    none = F.array().cast("array<struct<name:string,type:string>>")
    declared = F.concat(F.coalesce(op["arguments"], none), F.coalesce(op["dynamicVariables"], none))
    kinds = F.map_from_entries(last_named(declared))
    return F.struct(
        *[op[c].alias(c) for c in ("op_index", "operation_ref", "templateId", "type", "arguments", "units")],
        F.upper(op["httpMethod"]).alias("method"),
        last_named(op["dynamicVariables"]).alias("variables"),
        text_parts(op["url"]).alias("url"),
        header_parts(op["headers"]).alias("headers"),
        query_string(op["queryParameters"]).alias("query"),
        payload_parts(op["requestPayload"]["content"], kinds).alias("payload"),
        text_parts(op["duration"]).alias("duration"),
        # what a duration without placeholders gives
        sleep_us(render_text(op["duration"], F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), op["units"]).alias("fixed_us"),
    )


def _pause(op: Column, values: Column) -> Column:
    return F.coalesce(op["fixed_us"], sleep_us(fill_text(op["duration"], values), op["units"]))


def requests(
    bound: DataFrame, transactions: DataFrame, operations: DataFrame, seed: int, spread: int | None = None,
    responses: DataFrame | None = None,
) -> DataFrame:
    """One row per operation of every transaction: rendered, or with the names that are missing.

    ``responses(workload, tx_ref, ordinal, op_index, name, value)`` holds what operations returned. An operation sees
    the latest value of each name that an earlier operation of its transaction returned; it replaces a bound value.

    Definitions are joined among themselves first and stored; the join with
    ``bound`` names no strategy, so Spark knows their size when it plans and
    broadcasts them only if they are small.  The table itself is then made
    without a shuffle.  ``spread`` deals the bound transactions out again when
    the input has fewer pieces than there are cores.
    """
    rows = bound.repartition(spread, *_IDS) if spread else bound
    rows = rows.join(stored(transaction_plans(transactions, operations), "plans"), "transaction")
    rows = with_values(rows, "values", dynamic_values(F.col("tx_variables"), seed, "tx_ref", "ordinal"))

    # an operation list is part of one definition, so its prefix sums are cheap
    before = F.aggregate(F.slice("_slept", F.lit(1), F.col("_at")), F.lit(0).cast("bigint"), lambda acc, us: acc + us)
    slept = F.transform("ops", lambda op: F.coalesce(_pause(op, F.col("values")), F.lit(0).cast("bigint")))
    rows = rows.withColumn("_slept", slept).select(
        "workload", "tx_ref", "transaction", "ordinal", "values", "_slept",
        missing_arguments(F.col("tx_arguments"), F.col("values")).alias("tx_missing"),
        F.posexplode("ops").alias("_at", "op"),
    ).select("*", before.alias("offset_us"), "op.*").drop("_slept", "_at", "op")
    if responses is not None:
        rows = _with_returned(rows, responses)
    rows = with_values(rows, "op_values", dynamic_values(F.col("variables"), seed, "tx_ref", "ordinal", "op_index"))
    missing = F.concat("tx_missing", missing_arguments(F.col("arguments"), F.col("op_values")))
    return render(rows.withColumn("missing", missing), F.col("op_values")).select(
        "workload", "tx_ref", "transaction", "ordinal", "op_index", "operation_ref", "templateId", "type", "method",
        "request_url", "query", "request_headers", "body", "sleep_us", "offset_us", "missing",
        guid(F.lit(seed), "workload", "tx_ref", "ordinal", "op_index").alias("operation_id"),
    )


def _with_returned(rows: DataFrame, responses: DataFrame) -> DataFrame:
    """Operations with what earlier ones of their transaction returned among their values."""
    given = responses.select(*_IDS, F.col("op_index").alias("_from"), "name", F.col("value").cast("string").alias("value"))
    asked = rows.select(*_IDS, "op_index")
    seen = asked.join(given, _IDS).filter("_from < op_index and name is not null")
    latest = seen.groupBy(*_IDS, "op_index", "name").agg(F.max_by("value", "_from").alias("value"))
    maps = latest.groupBy(*_IDS, "op_index").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_returned"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    both = rows.join(maps, [*_IDS, "op_index"], "left")
    return with_values(both, "values", F.coalesce("_returned", none)).drop("_returned")


def render(rows: DataFrame, values: Column) -> DataFrame:
    """Adds the rendered parts of an operation of a plan; null where a value is missing."""
    return rows.withColumn("body", fill_payload(F.col("payload"), values)).select(
        "*",
        fill_url(F.col("url"), values, F.col("body")).alias("request_url"),
        fill_headers(F.col("headers"), values).alias("request_headers"),
        _pause(F.struct("fixed_us", "duration", "units"), values).alias("sleep_us"),
    )


def planned_offsets(requests_table: DataFrame) -> DataFrame:
    """Adds ``offset_us`` to any table of planned operations: the sleeps that precede each in its transaction."""
    rows = requests_table.withColumn("_sleep", F.coalesce("sleep_us", F.lit(0)).cast("bigint"))
    return running_total(rows, _IDS, "op_index", "_sleep", "offset_us").drop("_sleep")


def latest_values(returned: DataFrame, by: list[str], position: str = "op_index") -> DataFrame:
    """Final value per name, the last write wins.  ``returned``: one row per (…, position, name, value)."""
    return returned.groupBy(*by, "name").agg(F.max_by("value", position).alias("value"))


def visible_values(wanted: DataFrame, returned: DataFrame, by: list[str], position: str = "op_index") -> DataFrame:
    """For each wanted ``(…, position, name)`` the value returned by the latest earlier operation."""
    asked = wanted.select(*by, "name", position, F.lit(None).cast("string").alias("value"), F.lit(0).alias("is_return"))
    given = returned.select(*by, "name", position, F.col("value").cast("string"), F.lit(1).alias("is_return"))
    # a wanted value sorts before what the same operation returns
    found = latest_before(asked.unionByName(given), [*by, "name"], position, "value", "is_return")
    return found.filter("is_return = 0").drop("is_return")


def _space_size(gen: Mapping[str, Any]) -> int:
    if gen.get("sampleSpace"):
        return len(gen["sampleSpace"])
    if gen.get("min") is None or gen.get("max") is None:
        raise ValueError(f"generator {gen['id']!r}: a zipfian draw needs bounds or a sample space")
    return gen["max"] - gen["min"]


def _from_space(gen: Mapping[str, Any], index: Column) -> Column:
    if gen.get("sampleSpace"):
        return F.element_at(F.array(*[F.lit(v) for v in gen["sampleSpace"]]), (index + 1).cast("int"))
    return index + F.lit(gen["min"])


def _counter_offsets(workload: Mapping[str, Any], generators: Mapping[str, Any]) -> dict[tuple[str, int], tuple[int, int, int]]:
    """Where each reference draws from its counter: (offset of the transaction, draws per transaction, position)."""
    used: dict[str, int] = {}
    out = {}
    for tx in workload["transactions"]:
        refs = [(n, r["generatorReferenceId"]) for n, r in enumerate(tx.get("data") or [])]
        for gen in {g for _, g in refs if generators[g]["type"].lower() == "counter"}:
            mine = [n for n, g in refs if g == gen]
            for position, n in enumerate(mine):
                out[(tx["id"], n)] = (used.get(gen, 0), len(mine), position)
            used[gen] = used.get(gen, 0) + tx["count"] * len(mine)
    return out
