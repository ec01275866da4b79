"""Sequence matching and verdicts on ``events``, ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evwarden.model import DEFAULT, Alias, Invariant, Not, Or, Plus, Star
from evwarden.operators import check, check_all, find_matches
from evwarden.predicates import Predicate, attr
from evwarden.queries.tables import json_events, micros, table, user_aliases, user_events
from evwarden.sources.events import alias_view, decode_records, table_events, union_events
from evwarden.sinks.violations import kafka_records, log_records


def same_user(first: str, *others: str) -> list[Predicate]:
    return [attr(f"{first}.user_id") == attr(f"{o}.user_id") for o in others]


def purchase_after_signup() -> Invariant:
    """A purchase within a day of signing up, with no error in between, is below 100."""
    return Invariant(
        "purchase_after_signup",
        user_aliases(s="signup", e="error", p="purchase"),
        ["s", Not("e"), "p"],
        within="24 hours",
        where=same_user("s", "p", "e"),
        on_full_match=attr("p.value") < 100,
    )


def _ids(found: DataFrame, *more) -> DataFrame:
    return found.select("start_id", "end_id", *more)


def seq_single(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "small_purchase", user_aliases(p="purchase"), ["p"], where=[attr("p.value") > 10], on_full_match=attr("p.value") < 150
    )
    return check(user_events(spark, sf), inv).select("start_id", F.col("p.value").alias("value"))


def seq_follow(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "view_then_purchase", user_aliases(v="view", p="purchase"), ["v", "p"], within="12 hours",
        where=same_user("v", "p"), on_full_match=False,
    )
    return _ids(check(user_events(spark, sf), inv))


def seq_neg_full(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(check(user_events(spark, sf), purchase_after_signup()), F.col("p.value").alias("value"))


def seq_self_neg(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "latest_purchase_then_error", user_aliases(p="purchase", q="purchase", e="error"), ["p", Not("q"), "e"],
        within="48 hours", where=same_user("p", "e", "q"), on_full_match=attr("p.value") > attr("e.value"),
    )
    return _ids(check(user_events(spark, sf), inv))


def seq_trailing_neg(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "no_purchase_after_signup", user_aliases(s="signup", p="purchase"), ["s", Not("p")], within="24 hours",
        where=same_user("s", "p"), on_full_match=False,
    )
    return check(user_events(spark, sf), inv).select("start_id", micros("end_ts").alias("end_us"))


def seq_or(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "signup_outcome", user_aliases(s="signup", p="purchase", e="error"), ["s", Or("p", "e")], within="24 hours",
        where=[(attr("s.user_id") == attr("p.user_id")) | (attr("s.user_id") == attr("e.user_id"))],
        on_full_match=(attr("p.value") < 50) | (attr("e.value") < 30),
    )
    found = check(user_events(spark, sf), inv)
    return _ids(found, F.when(F.col("p").isNotNull(), "purchase").otherwise("error").alias("end_type"))


def _loop_figures(loop: str) -> list:
    return [F.col(f"{loop}.n").alias("n_loop"), F.col(f"{loop}.first.seq").alias("first_loop_id"), F.col(f"{loop}.last.seq").alias("last_loop_id")]


def _loop(name: str, step, loop_aliases: dict[str, str], verdict) -> Invariant:
    return Invariant(
        name, user_aliases(s="signup", p="purchase", **loop_aliases), ["s", step, "p"], within="72 hours",
        where=same_user("s", "p", *loop_aliases), on_full_match=verdict,
    )


def seq_plus(spark: SparkSession, sf: str) -> DataFrame:
    inv = _loop("clicks_before_purchase", Plus("c"), {"c": "click"}, attr("c.value") < 60)
    return _ids(check(user_events(spark, sf), inv, loops=["n", "first", "last"]), *_loop_figures("c"))


def seq_star(spark: SparkSession, sf: str) -> DataFrame:
    inv = _loop("views_before_purchase", Star("v"), {"v": "view"}, False)
    return _ids(check(user_events(spark, sf), inv, loops=["n"]), F.col("v.n").alias("n_loop"))


def seq_or_plus(spark: SparkSession, sf: str) -> DataFrame:
    inv = _loop(
        "activity_before_purchase", Plus("c", "v"), {"c": "click", "v": "view"}, attr("c.value") < attr("p.value")
    )
    found = check(user_events(spark, sf), inv, loops=["n"])
    return _ids(found, F.col("c.n").alias("n_clicks"), F.col("v.n").alias("n_views"))


def seq_loop_events(spark: SparkSession, sf: str) -> DataFrame:
    """The loop events themselves, and a verdict that compares every event of one list with every one of another."""
    inv = _loop("clicks_below_views", Plus("c", "v"), {"c": "click", "v": "view"}, attr("c.value") <= attr("v.value"))
    found = check(user_events(spark, sf), inv)
    ids = lambda loop: F.array_join(F.transform(loop, lambda e: e["seq"].cast("string")), ",")
    return _ids(found, ids("c").alias("clicks"), ids("v").alias("views"))


def seq_two_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks, then perhaps views, then a purchase, all of one user."""
    inv = Invariant(
        "clicks_then_views", user_aliases(s="signup", c="click", v="view", p="purchase"), ["s", Plus("c"), Star("v"), "p"], within="72 hours",
        where=same_user("s", "c", "v", "p"), where_eval="eager", on_full_match=False,
    )
    return _ids(check(user_events(spark, sf), inv), F.size("c").alias("n_clicks"), F.size("v").alias("n_views"))


def verdict_two_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The same verdict from the figures of both lists."""
    inv = _loop("clicks_below_views", Plus("c", "v"), {"c": "click", "v": "view"}, attr("c.value") <= attr("v.value"))
    found = check(user_events(spark, sf), inv, loops=["n", "sum", "max"])
    return _ids(found, F.col("c.n").alias("n_clicks"), F.round("v.sum.value", 4).alias("views_total"), F.col("c.max.value").alias("highest_click"))


def seq_five_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    """Five steps with an absence and an alternative; named prefixes and a default judge what stays unfinished."""
    inv = Invariant(
        "five_steps", user_aliases(s="signup", e="error", c="click", v="view", p="purchase", w="view"), ["s", Not("e"), Or("c", "v"), "p", "w"],
        within="36 hours", where=[*same_user("s", "e", "p", "w"), (attr("s.user_id") == attr("c.user_id")) | (attr("s.user_id") == attr("v.user_id"))],
        where_eval="eager", on_full_match=attr("w.value") > 20,
        on_prefix_match={("s",): attr("s.value") > 30, ("s", ("c", "v")): (attr("c.value") > 25) | (attr("v.value") > 50), DEFAULT: attr("p.value") > 40},
    )
    found = check(user_events(spark, sf), inv)
    return found.select("start_id", "kind", F.col("bound").cast("int").alias("bound"))


def seq_late_neg(spark: SparkSession, sf: str) -> DataFrame:
    """Two events, an absence and a closing event."""
    inv = Invariant(
        "late_negation", user_aliases(s="signup", c="click", e="error", p="purchase"), ["s", "c", Not("e"), "p"], within="48 hours",
        where=same_user("s", "c", "e", "p"), where_eval="eager", on_full_match=attr("p.value") < 80,
    )
    return _ids(check(user_events(spark, sf), inv), F.col("c.seq").alias("mid_id"))


def seq_theta(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "next_larger_purchase", user_aliases(a="purchase", b="purchase"), ["a", "b"], within="168 hours",
        where=[*same_user("a", "b"), attr("b.value") > attr("a.value")], on_full_match=False,
    )
    return _ids(check(user_events(spark, sf), inv))


def seq_where_or(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "no_worse_error", user_aliases(s="signup", e="error", p="purchase"), ["s", Not("e"), "p"], within="24 hours",
        where=[*same_user("s", "p"), (attr("s.user_id") == attr("e.user_id")) & ((attr("e.value") > attr("s.value")) | (attr("e.value") > 200))],
        on_full_match=False,
    )
    return _ids(check(user_events(spark, sf), inv))


def _three(where_eval: str) -> Invariant:
    return Invariant(
        f"three_{where_eval}", user_aliases(s="signup", c="click", p="purchase"), ["s", "c", "p"], within="48 hours",
        where=[*same_user("s", "c", "p"), attr("c.value") > 20], on_full_match=False, where_eval=where_eval,
    )


def seq_three_deferred(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(check(user_events(spark, sf), _three("deferred")), F.col("c.seq").alias("mid_id"))


def seq_three_eager(spark: SparkSession, sf: str) -> DataFrame:
    return _ids(check(user_events(spark, sf), _three("eager")), F.col("c.seq").alias("mid_id"))


def seq_any(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "every_later_purchase", user_aliases(s="signup", p="purchase"), ["s", "p"], within="24 hours",
        where=same_user("s", "p"), on_full_match=False, all_matches=True,
    )
    return _ids(check(user_events(spark, sf), inv))


def prefix_default(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "timely_purchase", user_aliases(s="signup", p="purchase"), ["s", "p"], within="24 hours",
        where=same_user("s", "p"), on_prefix_match={DEFAULT: attr("s.value") < 20},
    )
    return check(user_events(spark, sf), inv).select("start_id", "kind", micros("end_ts").alias("end_us"))


def prefix_named(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "funnel", user_aliases(s="signup", c="click", p="purchase"), ["s", "c", "p"], within="24 hours",
        where=same_user("s", "c", "p"), where_eval="eager", on_full_match=attr("p.value") > 5,
        on_prefix_match={("s",): attr("s.value") > 40, ("s", "c"): attr("c.value") < 30, DEFAULT: True},
    )
    found = check(user_events(spark, sf), inv)
    return found.select("start_id", "kind", F.col("bound").cast("int").alias("bound"))


def open_end(spark: SparkSession, sf: str) -> DataFrame:
    inv = Invariant(
        "timely_purchase_open", user_aliases(s="signup", p="purchase"), ["s", "p"], within="120 hours",
        where=same_user("s", "p"), on_prefix_match={DEFAULT: False},
    )
    return check(user_events(spark, sf), inv, end_of_input="open").select("start_id", "kind")


def _order_events(spark: SparkSession, sf: str, close_days: int | None = None) -> DataFrame:
    """Orders, their lines and optionally a closing mark; at equal times in this order."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    parts = [
        orders.select(F.lit("order").alias("type"), F.col("o_orderkey").alias("k"), F.lit(None).cast("double").alias("q"),
                      F.col("o_orderdate").alias("at"), F.lit(0).alias("n")),
        lines.select(F.lit("line").alias("type"), F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"),
                     F.col("l_shipdate").alias("at"), F.col("l_linenumber").alias("n")),
    ]
    if close_days:
        parts.append(orders.select(
            F.lit("close").alias("type"), F.col("o_orderkey").alias("k"), F.lit(None).cast("double").alias("q"),
            (F.col("o_orderdate") + F.expr(f"interval {close_days} days")).alias("at"), F.lit(1 << 62).alias("n"),
        ))
    return union_events(*[table_events(p, "type", "at", "n", ["k", "q"]) for p in parts])


_LINE = {"k": "number", "q": "number"}


def order_late_ship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of which nothing is shipped within 90 days, and how the others fare."""
    inv = Invariant(
        "timely_shipping", {"o": Alias("order", _LINE), "l": Alias("line", _LINE)}, ["o", "l"], within="90 days",
        where=[attr("o.k") == attr("l.k")], on_full_match=False, on_prefix_match={DEFAULT: False},
    )
    found = check(_order_events(spark, sf), inv)
    return found.select(F.col("o.k").cast("bigint").alias("orderkey"), "kind", micros("end_ts").alias("end_us"))


def verdict_forall(spark: SparkSession, sf: str) -> DataFrame:
    """Every line shipped within four years of its order has a quantity below 48."""
    inv = Invariant(
        "small_lines", {"o": Alias("order", _LINE), "l": Alias("line", _LINE), "c": Alias("close", _LINE)},
        ["o", Plus("l"), "c"], within="1461 days",
        where=[attr("o.k") == attr("l.k"), attr("o.k") == attr("c.k")], on_full_match=attr("l.q") < 48,
    )
    found = check(_order_events(spark, sf, close_days=1460), inv, loops=["n"])
    return found.select(F.col("o.k").cast("bigint").alias("orderkey"), F.col("l.n").alias("n_lines"))


def json_member(spark: SparkSession, sf: str) -> DataFrame:
    aliases = {n: Alias(t, {"k": "number"}) for n, t in (("v", "view"), ("c", "click"))}
    inv = Invariant("same_k", aliases, ["v", "c"], within="2 hours", where=[attr("v.k") == attr("c.k")], on_full_match=False)
    return _ids(check(json_events(spark, sf), inv), F.col("v.k").cast("bigint").alias("k"))


def schema_projection(spark: SparkSession, sf: str) -> DataFrame:
    view = alias_view(json_events(spark, sf), "purchase", {"k": "number", "missing": "string"})
    return view.select("seq", F.col("k").cast("bigint").alias("k"), F.coalesce("missing", F.lit("none")).alias("missing"))


def kafka_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Broker-shaped records; half of them carry ISO text with seven fraction digits, half epoch milliseconds."""
    df = table(spark, sf, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("1Z"))
    ms = F.floor(micros("ts") / 1000).cast("string")
    stamp = F.when(F.col("event_id") % 2 == 0, iso).otherwise(ms)
    records = df.select(
        F.col("event_type").cast("binary").alias("key"),
        F.to_json(F.struct(stamp.alias("CreationDate"), "user_id")).cast("binary").alias("value"),
        F.pmod("event_id", F.lit(3)).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 3).cast("bigint").alias("offset"),
    )
    events = decode_records(records, "CreationDate")
    return events.select(
        "type", "seq", F.unix_micros("ts").alias("us"), F.get_json_object("content", "$.user_id").cast("bigint").alias("user_id")
    )


def timely_purchase() -> Invariant:
    return Invariant(
        "timely_purchase", user_aliases(s="signup", p="purchase"), ["s", "p"], within="24 hours",
        where=same_user("s", "p"), on_prefix_match={DEFAULT: False},
    )


def many_invariants(spark: SparkSession, sf: str) -> DataFrame:
    found = check_all(user_events(spark, sf), [purchase_after_signup(), timely_purchase()])
    return found.select("invariant", "kind", "start_id")


def violation_records(spark: SparkSession, sf: str) -> DataFrame:
    """The Kafka and the log form of the same violations."""
    found = check_all(user_events(spark, sf), [purchase_after_signup()])
    sent = kafka_records(found).select("key", F.get_json_object("value", "$.start_id").cast("bigint").alias("start_id"))
    logged = log_records(found).select(
        F.get_json_object("value", "$.InvariantName").alias("key"),
        F.get_json_object(F.get_json_object("value", "$.Match"), "$.s.seq").cast("bigint").alias("start_id"),
    )
    return sent.withColumn("sink", F.lit("kafka")).unionByName(logged.withColumn("sink", F.lit("log")))


def match_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """Full and timed-out matches before any verdict."""
    found = find_matches(user_events(spark, sf), purchase_after_signup())
    return found.select("kind", F.col("s.seq").alias("start_id"), F.col("p.seq").alias("end_id"))


QUERIES = {
    f.__name__: f
    for f in (
        seq_single, seq_follow, seq_neg_full, seq_self_neg, seq_trailing_neg, seq_or, seq_plus, seq_star, seq_or_plus,
        seq_theta, seq_where_or, seq_three_deferred, seq_three_eager, seq_any, prefix_default, prefix_named, open_end,
        order_late_ship, verdict_forall, json_member, schema_projection, kafka_decode, many_invariants,
        violation_records, match_bindings, seq_loop_events, seq_two_loops, verdict_two_lists, seq_five_prefixes, seq_late_neg,
    )
}

# -- SQL ----------------------------------------------------------------------------------------



def _events_by(key: str) -> str:
    return f"e AS (SELECT event_id AS id, epoch_us(ts) AS us, {key} AS u, event_type AS t, value AS v FROM events)"


_E = _events_by("user_id")
_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_H = 3_600_000_000


def _later(a: str, b: str) -> str:
    return f"({b}.us > {a}.us OR ({b}.us = {a}.us AND {b}.id > {a}.id))"


def _first(name: str, prev: str, step_type: str, hours: int, cond: str, of: str = "id", start: str = "us") -> str:
    """CTE: for every start ``of`` in ``prev`` (id, us, …) its first later event of a type under a condition."""
    types = ", ".join(f"'{t}'" for t in step_type.split("|"))
    return (
        f"{name} AS (SELECT * FROM (SELECT a.*, b.id AS nid, b.us AS nus, b.v AS nv, b.t AS nt, "
        f"row_number() OVER (PARTITION BY a.{of} ORDER BY b.us, b.id) AS rn FROM {prev} a JOIN e b "
        f"ON b.t IN ({types}) AND {_later('a', 'b')} AND b.us < a.{start} + {hours * _H} AND {cond}) WHERE rn = 1)"
    )


def _of(t: str) -> str:
    return f"(SELECT * FROM e WHERE t = '{t}')"


def _no_between(row: str, types: str, cond: str = "k.u = m.u") -> str:
    """No event of a type between the start and its match."""
    return (
        f"NOT EXISTS (SELECT 1 FROM e k WHERE k.t = '{types}' AND {cond} "
        f"AND (k.us > {row}.us OR (k.us = {row}.us AND k.id > {row}.id)) "
        f"AND (k.us < {row}.nus OR (k.us = {row}.nus AND k.id < {row}.nid)))"
    )


_SLICE = (
    f"WITH {_E}, {_first('m', _of('signup'), 'purchase', 24, 'b.u = a.u')}, "
    f"f AS (SELECT * FROM m WHERE {_no_between('m', 'error')})"
)


def _loop_sql(types: str, least: int) -> str:
    """Signup, repeated events, first purchase after at least ``least`` of them; figures of the loop."""
    ts = ", ".join(f"'{t}'" for t in types.split("|"))
    first_loop = _first("l", _of("signup"), types, 72, "b.u = a.u")
    closing = (
        f"c AS (SELECT * FROM (SELECT l.*, b.id AS cid, b.us AS cus, b.v AS cv, "
        "row_number() OVER (PARTITION BY l.id ORDER BY b.us, b.id) AS rn2 FROM l JOIN e b ON b.t = 'purchase' "
        f"AND b.u = l.u AND (b.us > l.nus OR (b.us = l.nus AND b.id > l.nid)) AND b.us < l.us + {72 * _H}) WHERE rn2 = 1)"
    )
    if not least:
        closing = (
            f"{_first('c0', _of('signup'), 'purchase', 72, 'b.u = a.u')}, "
            "c AS (SELECT *, nid AS cid, nus AS cus, nv AS cv FROM c0)"
        )
        first_loop = None
    inside = (
        f"x AS (SELECT c.id, c.cid, c.cv, k.id AS kid, k.t AS kt, k.v AS kv, k.us AS kus FROM c LEFT JOIN e k ON k.t IN ({ts}) AND k.u = c.u "
        "AND (k.us > c.us OR (k.us = c.us AND k.id > c.id)) AND (k.us < c.cus OR (k.us = c.cus AND k.id < c.cid)))"
    )
    return f"WITH {_E}, " + ", ".join(p for p in (first_loop, closing, inside) if p)


_THREE_EAGER = (
    f"WITH {_E}, {_first('m', _of('signup'), 'click', 48, 'b.u = a.u AND b.v > 20')}, "
    "m2 AS (SELECT id AS sid, us AS sus, u, nid AS id, nus AS us FROM m)"
)

#: Not every click is at most every view, or one of them is missing.
_ABOVE = "NOT coalesce(max(kv) FILTER (kt = 'click') <= min(kv) FILTER (kt = 'view'), false)"

#: Violations of two invariants with the time at which each is known.
CHECKED = (
    f"{_SLICE}, found AS (SELECT nus AS us, 'purchase_after_signup' AS invariant FROM f WHERE NOT nv < 100 "
    f"UNION ALL SELECT us + {24 * _H}, 'timely_purchase' FROM e a WHERE t = 'signup' AND id NOT IN (SELECT id FROM m))"
)

ORACLES = {
    "seq_single": "SELECT event_id AS start_id, value FROM events WHERE event_type = 'purchase' AND value > 10 AND NOT value < 150",
    "seq_follow": f"WITH {_E}, {_first('m', _of('view'), 'purchase', 12, 'b.u = a.u')} SELECT id AS start_id, nid AS end_id FROM m",
    "seq_neg_full": f"{_SLICE} SELECT id AS start_id, nid AS end_id, nv AS value FROM f WHERE NOT nv < 100",
    "seq_self_neg": (
        f"WITH {_E}, {_first('m', _of('purchase'), 'error', 48, 'b.u = a.u')} "
        f"SELECT id AS start_id, nid AS end_id FROM m WHERE {_no_between('m', 'purchase')} AND NOT v > nv"
    ),
    "seq_trailing_neg": (
        f"WITH {_E} SELECT id AS start_id, us + {24 * _H} AS end_us FROM e a WHERE t = 'signup' AND NOT EXISTS "
        f"(SELECT 1 FROM e b WHERE b.t = 'purchase' AND b.u = a.u AND {_later('a', 'b')} AND b.us < a.us + {24 * _H})"
    ),
    "seq_or": (
        f"WITH {_E}, {_first('m', _of('signup'), 'purchase|error', 24, 'b.u = a.u')} "
        "SELECT id AS start_id, nid AS end_id, nt AS end_type FROM m "
        "WHERE NOT ((nt = 'purchase' AND nv < 50) OR (nt = 'error' AND nv < 30))"
    ),
    "seq_plus": (
        f"{_loop_sql('click', 1)} SELECT id AS start_id, cid AS end_id, CAST(count(*) AS INTEGER) AS n_loop, "
        "arg_min(kid, kus) AS first_loop_id, arg_max(kid, kus) AS last_loop_id FROM x GROUP BY id, cid HAVING NOT bool_and(kv < 60)"
    ),
    "seq_star": f"{_loop_sql('view', 0)} SELECT id AS start_id, cid AS end_id, CAST(count(kid) AS INTEGER) AS n_loop FROM x GROUP BY id, cid",
    "seq_or_plus": (
        f"{_loop_sql('click|view', 1)} SELECT id AS start_id, cid AS end_id, "
        "CAST(count(*) FILTER (kt = 'click') AS INTEGER) AS n_clicks, CAST(count(*) FILTER (kt = 'view') AS INTEGER) AS n_views "
        "FROM x GROUP BY id, cid HAVING NOT coalesce(bool_and(kv < cv) FILTER (kt = 'click'), false)"
    ),
    "seq_loop_events": (
        f"{_loop_sql('click|view', 1)} SELECT id AS start_id, cid AS end_id, "
        "coalesce(string_agg(CAST(kid AS VARCHAR), ',' ORDER BY kus, kid) FILTER (kt = 'click'), '') AS clicks, "
        "coalesce(string_agg(CAST(kid AS VARCHAR), ',' ORDER BY kus, kid) FILTER (kt = 'view'), '') AS views "
        f"FROM x GROUP BY id, cid HAVING {_ABOVE}"
    ),
    "seq_two_loops": (
        f"WITH {_E}, {_first('m', _of('signup'), 'click', 72, 'b.u = a.u')}, "
        "m2 AS (SELECT id AS sid, us AS sus, u, nid AS id, nus AS us FROM m), "
        f"{_first('p', 'm2', 'purchase', 72, 'b.u = a.u', 'sid', 'sus')}, {_first('x', 'm2', 'view|purchase', 72, 'b.u = a.u', 'sid', 'sus')}, "
        "c AS (SELECT p.sid, p.nid AS pid, count(*) FILTER (k.t = 'click' AND (k.us < x.nus OR (k.us = x.nus AND k.id < x.nid))) AS n_clicks, "
        "count(*) FILTER (k.t = 'view' AND (k.us > x.nus OR (k.us = x.nus AND k.id >= x.nid))) AS n_views FROM p JOIN x ON x.sid = p.sid "
        "JOIN e k ON k.u = p.u AND (k.us > p.us OR (k.us = p.us AND k.id >= p.id)) AND (k.us < p.nus OR (k.us = p.nus AND k.id < p.nid)) GROUP BY 1, 2) "
        "SELECT sid AS start_id, pid AS end_id, CAST(n_clicks AS INTEGER) AS n_clicks, CAST(n_views AS INTEGER) AS n_views FROM c"
    ),
    "verdict_two_lists": (
        f"{_loop_sql('click|view', 1)} SELECT id AS start_id, cid AS end_id, CAST(count(*) FILTER (kt = 'click') AS INTEGER) AS n_clicks, "
        "round(sum(kv) FILTER (kt = 'view'), 4) AS views_total, max(kv) FILTER (kt = 'click') AS highest_click "
        f"FROM x GROUP BY id, cid HAVING {_ABOVE}"
    ),
    "seq_late_neg": (
        f"WITH {_E}, {_first('m', _of('signup'), 'click', 48, 'b.u = a.u')}, "
        "m2 AS (SELECT id AS sid, us AS sus, u, nid AS id, nus AS us FROM m), "
        f"{_first('n', 'm2', 'purchase', 48, 'b.u = a.u', 'sid', 'sus')} SELECT sid AS start_id, nid AS end_id, id AS mid_id FROM n "
        f"WHERE NOT nv < 80 AND {_no_between('n', 'error', 'k.u = n.u')}"
    ),
    "seq_five_prefixes": (
        f"WITH {_E}, {_first('m', _of('signup'), 'click|view', 36, 'b.u = a.u')}, "
        f"q AS (SELECT id AS sid, us AS sus, u, nid AS id, nus AS us, nv AS mv, nt AS mt FROM m WHERE {_no_between('m', 'error')}), "
        f"{_first('p', 'q', 'purchase', 36, 'b.u = a.u', 'sid', 'sus')}, p2 AS (SELECT sid, sus, u, nv AS pv, nid AS id, nus AS us FROM p), "
        f"{_first('w', 'p2', 'view', 36, 'b.u = a.u', 'sid', 'sus')} "
        "SELECT sid AS start_id, 'full' AS kind, 29 AS bound FROM w WHERE NOT nv > 20 "
        "UNION ALL SELECT sid, 'timeout', 13 FROM p2 WHERE sid NOT IN (SELECT sid FROM w) AND NOT pv > 40 "
        "UNION ALL SELECT sid, 'timeout', 5 FROM q WHERE sid NOT IN (SELECT sid FROM p) AND NOT ((mt = 'click' AND mv > 25) OR (mt = 'view' AND mv > 50)) "
        "UNION ALL SELECT id, 'timeout', 1 FROM e s WHERE t = 'signup' AND id NOT IN (SELECT id FROM m) AND NOT v > 30 "
        f"AND NOT EXISTS (SELECT 1 FROM e k WHERE k.t = 'error' AND k.u = s.u AND {_later('s', 'k')} AND k.us < s.us + {36 * _H})"
    ),
    "seq_theta": f"WITH {_E}, {_first('m', _of('purchase'), 'purchase', 168, 'b.u = a.u AND b.v > a.v')} SELECT id AS start_id, nid AS end_id FROM m",
    "seq_where_or": (
        f"WITH {_E}, {_first('m', _of('signup'), 'purchase', 24, 'b.u = a.u')} SELECT id AS start_id, nid AS end_id FROM m "
        f"WHERE {_no_between('m', 'error', 'k.u = m.u AND (k.v > m.v OR k.v > 200)')}"
    ),
    "seq_three_deferred": (
        # the middle step is the next click of anyone; all terms are tested with the purchase
        f"WITH {_E}, m AS (SELECT a.id AS sid, a.us AS sus, a.u, b.id, b.us, b.u AS bu, b.v AS bv FROM {_of('signup')} a "
        f"ASOF JOIN {_of('click')} b ON b.us > a.us WHERE b.us < a.us + {48 * _H}), "
        "k AS (SELECT * FROM m WHERE bu = u AND bv > 20), "
        f"{_first('p', 'k', 'purchase', 48, 'b.u = a.u', of='sid', start='sus')} SELECT sid AS start_id, nid AS end_id, id AS mid_id FROM p"
    ),
    "seq_three_eager": f"{_THREE_EAGER}, {_first('p', 'm2', 'purchase', 48, 'b.u = a.u', of='sid', start='sus')} SELECT sid AS start_id, nid AS end_id, id AS mid_id FROM p",
    "seq_any": (
        f"WITH {_E} SELECT a.id AS start_id, b.id AS end_id FROM e a JOIN e b ON a.t = 'signup' AND b.t = 'purchase' AND a.u = b.u "
        f"AND {_later('a', 'b')} AND b.us < a.us + {24 * _H}"
    ),
    "prefix_default": (
        f"WITH {_E} SELECT id AS start_id, 'timeout' AS kind, us + {24 * _H} AS end_us FROM e a WHERE t = 'signup' AND NOT v < 20 AND NOT EXISTS "
        f"(SELECT 1 FROM e b WHERE b.t = 'purchase' AND b.u = a.u AND {_later('a', 'b')} AND b.us < a.us + {24 * _H})"
    ),
    "prefix_named": (
        f"WITH {_E}, {_first('m', _of('signup'), 'click', 24, 'b.u = a.u')}, "
        "m2 AS (SELECT id AS sid, us AS sus, u, nid AS id, nus AS us, nv AS cv FROM m), "
        f"{_first('p', 'm2', 'purchase', 24, 'b.u = a.u', of='sid', start='sus')} "
        "SELECT a.id AS start_id, CASE WHEN p.sid IS NOT NULL THEN 'full' ELSE 'timeout' END AS kind, "
        "CASE WHEN p.sid IS NOT NULL THEN 7 WHEN m2.sid IS NOT NULL THEN 3 ELSE 1 END AS bound "
        f"FROM {_of('signup')} a LEFT JOIN m2 ON m2.sid = a.id LEFT JOIN p ON p.sid = a.id "
        "WHERE CASE WHEN p.sid IS NOT NULL THEN NOT p.nv > 5 WHEN m2.sid IS NOT NULL THEN NOT m2.cv < 30 ELSE NOT a.v > 40 END"
    ),
    "open_end": (
        f"WITH {_E} SELECT id AS start_id, 'timeout' AS kind FROM e a WHERE t = 'signup' AND us + {120 * _H} <= (SELECT max(us) FROM e) AND NOT EXISTS "
        f"(SELECT 1 FROM e b WHERE b.t = 'purchase' AND b.u = a.u AND {_later('a', 'b')} AND b.us < a.us + {120 * _H})"
    ),
    "order_late_ship": (
        "SELECT o_orderkey AS orderkey, CASE WHEN min(l_shipdate) IS NULL THEN 'timeout' ELSE 'full' END AS kind, "
        "epoch_us(coalesce(min(l_shipdate), o_orderdate + INTERVAL 90 DAY)) AS end_us FROM orders LEFT JOIN lineitem "
        "ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 90 DAY GROUP BY o_orderkey, o_orderdate"
    ),
    "verdict_forall": (
        "SELECT o_orderkey AS orderkey, CAST(count(*) AS INTEGER) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey "
        "AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 1460 DAY GROUP BY o_orderkey HAVING NOT bool_and(l_quantity < 48)"
    ),
    "json_member": (
        f"WITH {_events_by(_K)}, "
        f"{_first('m', _of('view'), 'click', 2, 'b.u = a.u')} SELECT id AS start_id, nid AS end_id, u AS k FROM m"
    ),
    "schema_projection": (
        "SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, "
        "coalesce(json_extract_string(props, '$.missing'), 'none') AS missing FROM events WHERE event_type = 'purchase'"
    ),
    "kafka_decode": (
        "SELECT event_type AS type, (event_id % 3) * 281474976710656 + event_id // 3 AS seq, "
        "CASE WHEN event_id % 2 = 0 THEN epoch_us(ts) ELSE (epoch_us(ts) // 1000) * 1000 END AS us, user_id FROM events"
    ),
    "many_invariants": (
        f"{_SLICE} SELECT 'purchase_after_signup' AS invariant, 'full' AS kind, id AS start_id FROM f WHERE NOT nv < 100 "
        "UNION ALL SELECT 'timely_purchase', 'timeout', id FROM e a WHERE t = 'signup' AND id NOT IN (SELECT id FROM m)"
    ),
    "violation_records": (
        f"{_SLICE} SELECT 'purchase_after_signup' AS key, id AS start_id, sink FROM f, (VALUES ('kafka'), ('log')) s(sink) WHERE NOT nv < 100"
    ),
    "match_bindings": (
        f"{_SLICE}, killed AS (SELECT a.id FROM e a JOIN e k ON a.t = 'signup' AND k.t = 'error' AND k.u = a.u AND {_later('a', 'k')} "
        f"AND k.us < a.us + {24 * _H} LEFT JOIN m ON m.id = a.id WHERE m.id IS NULL OR k.us < m.nus OR (k.us = m.nus AND k.id < m.nid)) "
        "SELECT 'full' AS kind, id AS start_id, nid AS end_id FROM f UNION ALL SELECT 'timeout', id, NULL FROM e "
        "WHERE t = 'signup' AND id NOT IN (SELECT id FROM m) AND id NOT IN (SELECT id FROM killed)"
    ),
}
