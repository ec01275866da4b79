"""Random event tables: every strategy and every cell size gives the rows of the naive matcher."""

import json
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import naive
from evwarden import DEFAULT, Alias, CellOptions, Invariant, Not, Or, Plus, Star, attr, check, check_all, find_matches
from evwarden.operators.joins import loopable, pairable, tailable
from evwarden.operators.nearest import searches
from evwarden.operators.scan import key_signature, scannable
from evwarden.operators.stages import staged
from evwarden.operators.verdict import all_pairs
from evwarden.predicates import compare
from evwarden.sources.events import memory_events

AL = {n: Alias(n.upper(), {"k": "number", "v": "number", "s": "string"}) for n in "abcd"}
AL["a2"], AL["d2"] = AL["a"], AL["d"]
K = {n: attr(f"{n}.k") for n in AL}
V = {n: attr(f"{n}.v") for n in AL}


def on_key(*names):
    return [K["a"] == K[n] for n in names]


SPECS = {
    "follow": dict(seq=["a", "b"], where=on_key("b")),
    "follow_no_limit": dict(seq=["a", "b"], where=on_key("b"), within=None),
    "follow_unkeyed": dict(seq=["a", "b"], where=[V["b"] > 5]),
    "start_term": dict(seq=["a", "b"], where=[*on_key("b"), V["a"] > 4]),
    "negation": dict(seq=["a", Not("c"), "b"], where=on_key("b", "c")),
    "negated_type_pair": dict(seq=["a", Not("c", "d"), "b"], where=[*on_key("b", "c")]),
    "same_type_negation": dict(seq=["a", Not("a2"), "b"], where=[*on_key("b", "a2")]),
    "trailing": dict(seq=["a", Not("b")], where=on_key("b")),
    "two_keys": dict(seq=["a", "b"], where=[*on_key("b"), attr("a.s") == attr("b.s")]),
    "or_step": dict(seq=["a", Or("b", "c"), "d"], where=[*on_key("b", "d")]),
    "chain": dict(seq=["a", "b", Not("d"), "c", Not("a2")], where=[*on_key("b", "c", "d", "a2"), V["c"] > 2]),
    "theta": dict(seq=["a", "b"], where=[*on_key("b"), V["b"] > V["a"]]),
    "theta_below": dict(seq=["a", Not("c"), "b"], where=[*on_key("b", "c"), V["b"] <= V["a"], (V["c"] < V["a"]) | (V["c"] > 7) & (V["a"] > 3)]),
    "theta_or": dict(seq=["a", Not("c"), "b"], where=[(V["b"] > V["a"]) | (attr("b.s") == attr("a.s")), V["c"] != V["a"]]),
    "three": dict(seq=["a", "b", "c"], where=[*on_key("b", "c"), V["b"] > 3]),
    "tail": dict(seq=["a", "b", "c"], where=[K["a"] == K["c"], V["c"] > V["b"]]),
    "plus": dict(seq=["a", Plus("b"), "c"], where=[*on_key("b", "c"), V["b"] > 3]),
    "star": dict(seq=["a", Star("b"), Not("d"), "c"], where=[*on_key("b", "c", "d")]),
    "plus_or": dict(seq=["a", Not("d"), Plus("b", "c"), "a2"], where=[*on_key("b", "a2", "d")]),
    "two_loops": dict(seq=["a", Plus("b"), Star("c"), "d"], where=[*on_key("b", "c", "d"), V["b"] > 2]),
    "loops_and_negations": dict(seq=["a", Not("d2"), Star("b"), Not("a2"), Plus("c"), "d"], where=on_key("b", "c", "a2", "d", "d2"), within="90 msec"),
    "loop_then_absence": dict(seq=["a", Star("b"), "c", Not("d")], where=on_key("b", "c", "d")),
    "loops_in_a_row": dict(seq=["a", Star("b"), Plus("c"), "d"], where=[V["c"] >= V["a"]]),
    "all_later": dict(seq=["a", "b"], where=[*on_key("b")], all_matches=True),
}


def table(seed, n=260):
    rnd = random.Random(seed)
    rows, plain, ms = [], [], 0
    for i in range(n):
        ms += rnd.choice([0, 0, 1, 1, 2, 3])
        content = {"k": rnd.choice([1, 1, 1, 2, 3, None]), "v": rnd.randint(0, 9), "s": rnd.choice("xy")}
        if rnd.random() < 0.05:
            del content["v"]
        t = rnd.choice("AABBCD")
        rows.append((t, json.dumps(content), datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=ms)))
        base = 1_704_067_200_000_000
        plain.append({"type": t, "content": content, "us": base + ms * 1000, "seq": i})
    return rows, plain


@pytest.mark.parametrize("where_eval", ["deferred", "eager"])
@pytest.mark.parametrize("name", SPECS)
def test_strategies_agree(spark, name, where_eval):
    spec = {"within": "40 msec", **SPECS[name]}
    inv = Invariant(name, AL, on_full_match=False, where_eval=where_eval, **spec)
    rows, plain = table(sum(map(ord, name)))
    events = memory_events(spark, rows)
    expected = sorted((m[0], m[1], m[2] or -1, sum(1 << s for s in m[3])) for m in naive.matches(inv, plain))
    assert expected
    runs = [("sweep", CellOptions()), ("sweep", CellOptions(cell_rows=25, grain_us=3000))]
    if scannable(inv):
        runs += [("scan", CellOptions()), ("scan", CellOptions(cell_rows=25, grain_us=3000))]

    if searches(inv) is not None:
        runs += [("nearest", CellOptions()), ("nearest", CellOptions(cell_rows=25, grain_us=3000))]
    if staged(inv):
        runs += [("stages", CellOptions()), ("stages", CellOptions(cell_rows=25, grain_us=3000))]
    if pairable(inv) or loopable(inv) or tailable(inv):
        runs += [("joins", CellOptions()), ("joins", CellOptions(cell_rows=25, grain_us=3000))]

    def rows_of(run):
        found = find_matches(events, inv, strategy=run[0], cells=run[1])
        return sorted((r.kind, r.start_id, r.end_id or -1, r.bound) for r in found.collect())

    with ThreadPoolExecutor(len(runs)) as pool:
        for run, got in zip(runs, pool.map(rows_of, runs)):
            assert got == expected, run


@pytest.mark.parametrize("cells", [CellOptions(), CellOptions(cell_rows=25, grain_us=3000)])
@pytest.mark.parametrize("name", ["plus", "star_only", "plus_two"])
def test_loop_figures(spark, name, cells, monkeypatch):
    """Figures of loops are those of the lists that the naive matcher binds, in blocks of any size."""
    spec = {
        "plus": SPECS["plus"], "star_only": dict(seq=["a", Star("b"), "d"], where=on_key("b", "d")),
        "plus_two": dict(seq=["a", Plus("b", "c"), "d"], where=[*on_key("d"), (K["a"] == K["b"]) | (K["a"] == K["c"])], within="200 msec"),
    }[name]
    inv = Invariant(name, AL, on_full_match=V["b"] < V["a"], **{"within": "40 msec", **spec})
    rows, plain = table(5, 400)
    events = memory_events(spark, rows)
    from evwarden.operators import loops as module

    figures = ["n", "first", "last", "sum", "min", "max", "missing"]
    step = next(i for i, s in enumerate(inv.steps) if s.loop)
    expected = {}
    for kind, start, end, bound in naive.matches(inv, plain):
        held = bound.get(step, [])
        for alias in inv.steps[step].aliases:
            mine = [e for e in held if e["type"] == AL[alias].type]
            values = [x for x in (naive.member(e["content"], "v", "number") for e in mine) if x is not None]
            ends = (mine[0]["seq"], mine[-1]["seq"]) if mine else (None, None)
            expected[kind, start, alias] = (len(mine), *ends, sum(values) if mine else None, min(values, default=None), max(values, default=None), len(mine) - len(values) if mine else None)
    for block in (1024, 3):
        monkeypatch.setattr(module, "BLOCK", block)
        got = {}
        found = find_matches(events, inv, cells=cells, loops=figures)
        for r in found.collect():
            for alias in inv.steps[step].aliases:
                f = r[alias]
                some = f["n"] > 0
                got[r.kind, r.start_id, alias] = (
                    f["n"], f["first"]["seq"] if some else None, f["last"]["seq"] if some else None, f["sum"]["v"], f["min"]["v"], f["max"]["v"], f["missing"]["v"],
                )
        assert got == expected and max(v[0] for v in got.values()) > (3 if name == "plus_two" else 1)
        judged = sorted((r.kind, r.start_id) for r in check(events, inv, cells=cells, loops=["n"]).collect())
        assert judged == sorted((m[0], m[1]) for m in naive.violations(inv, plain))


@pytest.mark.parametrize("cells", [CellOptions(), CellOptions(cell_rows=25, grain_us=3000)])
@pytest.mark.parametrize("name", ["two_loops", "loops_and_negations", "loop_then_absence"])
def test_events_of_several_loops(spark, name, cells):
    inv = Invariant(name, AL, on_full_match=V["c"] > V["a"], on_prefix_match={DEFAULT: V["a"] > 5}, **{"within": "40 msec", **SPECS[name]})
    rows, plain = table(17, 400)
    events = memory_events(spark, rows)
    held = lambda bound, i: [e["seq"] for e in bound.get(i, [])]
    loops = [i for i, s in enumerate(inv.steps) if s.loop]
    want = sorted((m[0], m[1], *[held(m[3], i) for i in loops]) for m in naive.matches(inv, plain))
    found = find_matches(events, inv, strategy="stages", cells=cells).collect()
    assert sorted((r.kind, r.start_id, *[[e["seq"] for e in r[inv.steps[i].aliases[0]]] for i in loops]) for r in found) == want
    judged = sorted((r.kind, r.start_id) for r in check(events, inv, cells=cells).collect())
    assert judged == sorted((m[0], m[1]) for m in naive.violations(inv, plain)) and judged


def test_all_pairs_by_extremes(spark):
    """The extremes of two lists decide what comparing every pair does, missing values, NaN and signed zeros included."""
    rnd = random.Random(9)
    draw = lambda: rnd.choice([None, 0.0, -0.0, 1.0, 2.0, 2.0, 3.0, float("nan")] if rnd.random() < 0.2 else [1.0, 2.0, 3.0])
    rows = [([draw() for _ in range(rnd.randrange(4))], [draw() for _ in range(rnd.randrange(4))]) for _ in range(400)]
    df = spark.createDataFrame(rows, "l array<double>, r array<double>")
    left, right = F.col("l"), F.col("r")
    for op in ("<", "<=", ">", ">=", "=", "!="):
        pairs = F.forall(left, lambda x: F.forall(right, lambda y: compare(op, x, y)))  # noqa: B023
        want = F.coalesce((F.size(left) > 0) & (F.size(right) > 0) & pairs, F.lit(False))
        assert df.where(want != all_pairs(op, left, right, numbers=True)).count() == 0, op


def test_nearest_is_linear_on_a_hot_key(spark):
    """One key, falling starts and one late event: every start waits to the end, and none is joined with the events between."""
    n = 20_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("type"), F.lit('{"k": 1, "v": 1}').alias("content"),
        F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.col("id").alias("seq"),
    )
    last = spark.createDataFrame([("B", '{"k": 1, "v": 5}')], "type string, content string").select("type", "content", F.timestamp_micros(F.lit(n * 1000)).alias("ts"), F.lit(n).cast("bigint").alias("seq"))
    inv = Invariant("hot", AL, ["a", "b"], within=None, where=[*on_key("b"), V["b"] > V["a"]], on_full_match=False)
    found = find_matches(rows.unionByName(last), inv, cells=CellOptions(cell_rows=3_000, grain_us=1_000_000))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.groupBy("end_id").count().collect() == [(n, n // 2)]


def test_chunk_borders(monkeypatch):
    """The frontier gives the same matches however its input is cut."""
    import numpy as np
    import pyarrow as pa

    from evwarden.operators.advance import Frontier
    from evwarden.operators.project import Layout

    for name, spec in SPECS.items():
        inv = Invariant(name, AL, on_full_match=False, **{"within": "40 msec", **spec})
        layout = Layout(inv)
        _, plain = table(7)
        cols = {"us": [e["us"] for e in plain], "seq": [e["seq"] for e in plain], "type": [e["type"] for e in plain]}
        for (path, kind), col in layout.columns.items():
            vals = [naive.member(e["content"], path, kind) for e in plain]
            cols[col] = pa.array(vals, pa.float64() if kind == "number" else pa.string())
        data = pa.table(cols)
        expected = sorted((m[0], m[1], m[2] or -1) for m in naive.matches(inv, plain))
        for width in (1, 7, 400):
            f, got = Frontier(inv, layout), []
            for at in range(0, data.num_rows, width):
                part = data.slice(at, width).combine_chunks()
                f.push(part, np.zeros(part.num_rows, dtype=np.int64))
                got += f.drain().to_pylist()
                f.compact()
            f.finish()
            got += f.drain().to_pylist()
            assert sorted((r["kind"], r["start_seq"], r["end_seq"] or -1) for r in got) == expected, (name, width)


@pytest.mark.parametrize("cells", [CellOptions(), CellOptions(cell_rows=25, grain_us=3000)])
def test_shared_scan(spark, cells):
    """Invariants checked together give what each gives alone."""
    names = ["follow", "negation", "same_type_negation", "trailing", "or_step", "chain", "two_keys", "theta", "plus"]
    invs = [
        Invariant(n, AL, on_full_match=V["a"] > 3, on_prefix_match={DEFAULT: V["a"] < 5}, where_eval="eager", **{"within": "40 msec", **SPECS[n]})
        for n in names
    ]
    assert len({key_signature(i) for i in invs}) == 3  # k; k and s; the rest on its own
    rows, plain = table(11)
    events = memory_events(spark, rows)
    got = sorted((r.invariant, r.kind, r.start_id, r.end_id or -1) for r in check_all(events, invs, cells=cells).collect())
    expected = sorted((i.name, m[0], m[1], m[2] or -1) for i in invs for m in naive.violations(i, plain))
    assert got == expected and got


def test_same_names_are_refused(spark):
    inv = Invariant("x", AL, ["a"], on_full_match=False)
    with pytest.raises(ValueError):
        check_all(memory_events(spark, table(1)[0]), [inv, inv])
