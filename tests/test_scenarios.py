"""Small literal event sequences with a known number of violations."""

import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta, timezone

import pytest

import naive
from evwarden import DEFAULT, Alias, CellOptions, Invariant, Not, Or, Plus, Star, Step, attr, check, find_matches
from evwarden.sources.events import memory_events

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)


def make(rows, step_ms=1):
    """``[(type, content, ms?)]`` → (frame rows, naive events)."""
    frame, plain = [], []
    for n, row in enumerate(rows):
        ms = row[2] if len(row) > 2 else n * step_ms
        ts = EPOCH + timedelta(milliseconds=ms)
        frame.append((row[0], json.dumps(row[1]), ts))
        plain.append({"type": row[0], "content": row[1], "us": ms * 1000, "seq": n})
    return frame, plain


NX = {n: Alias(n.upper(), {"id": "number", "x": "number"}) for n in "abcdef"}

# shared bikes: an unlocked bike is docked again, unless it reports a fault
BIKES = {
    "u": Alias("Unlocked", {"bike": "string", "zone": "string", "battery": "number", "night": "bool"}),
    "f": Alias("Fault", {"bike": "string", "zone": "string"}),
    "d": Alias("Docked", {"bike": "string", "night": "bool"}),
}
# water tanks: filled, drawn from and emptied
TANKS = {n: Alias(t, {"tank": "string"}) for n, t in (("fill", "Fill"), ("pump", "Pump"), ("leak", "Leak"), ("empty", "Empty"))}
# tariffs of zones, and the rides billed by them
TARIFF, RIDE = Alias("TariffSet", {"zone": "number", "cents": "number"}), Alias("RideBilled", {"zone": "number", "cents": "number"})
# a lending desk
LOANS = {n: Alias(t, {"item": "number", "fee": "number"}) for n, t in (("lent", "Lent"), ("back", "Returned"), ("longer", "Extended"))}
# parcels on their way through a depot
DEPOT = {
    n: Alias(t, {"parcel": "number", "weight": "number", "bay": "number"})
    for n, t in (("o", "Ordered"), ("k", "Cancelled"), ("p", "Packed"), ("h", "Held"), ("s", "Shipped"), ("v", "Delivered"))
}


def bike_rule(fault):
    return dict(aliases=BIKES, seq=["u", Not("f"), "d"], within="900 msec", on_full_match=False,
                where=[fault, attr("u.battery") > 30, attr("u.night") != attr("d.night")])


def unlocked(bike, battery=80, zone="north"):
    return ("Unlocked", {"bike": bike, "battery": battery, "night": True, "zone": zone})


DAY_DOCK = ("Docked", {"bike": "b2", "night": False})


def tariff_rule():
    return dict(
        aliases={"t1": TARIFF, "t2": TARIFF, "r": RIDE}, seq=["t1", Not("t2"), "r"], within="4 min",
        where=[attr("t1.zone") == attr("r.zone"), attr("t1.zone") == attr("t2.zone")],
        on_full_match=attr("t1.cents") == attr("r.cents"),
    )


def settled():
    return (attr("lent.item") == attr("back.item")) | (attr("lent.item") == attr("longer.item"))


def loan(kind, item, fee=None):
    return (kind, {"item": item} if fee is None else {"item": item, "fee": fee})


TARIFFS = [("TariffSet", {"zone": z, "cents": c}) for z, c in ((5, "130"), (9, "95"), (9, "110"))]

SCENARIOS = {
    # a forbidden event about another key is no obstacle, and terms on one alias select starts
    "negation_other_key": (
        bike_rule(attr("u.bike") == attr("f.bike")),
        [unlocked("b1"), unlocked("b3", battery=10), ("Fault", {"bike": "b9"}), DAY_DOCK], 1),
    # it discards only the start it is about
    "negation_kills": (
        bike_rule(attr("u.bike") == attr("f.bike")),
        [unlocked("b1"), unlocked("b2"), ("Fault", {"bike": "b1"}), DAY_DOCK], 1),
    # AND inside OR inside AND
    "nested_or": (
        bike_rule(((attr("u.bike") == attr("f.bike")) & (attr("u.zone") == attr("f.zone"))) | (
            (attr("u.zone") != attr("f.zone")) & ((attr("f.bike") == attr("u.bike")) | (attr("f.zone") == attr("u.zone"))))),
        [unlocked("b1"), unlocked("b2"), ("Fault", {"bike": "b1", "zone": "south"}), DAY_DOCK], 1),
    "loop_of_alternatives": (
        dict(aliases=TANKS, seq=["fill", Plus("pump", "leak"), "empty"], within="2 sec",
             where=[attr("fill.tank") == attr("pump.tank"), attr("leak.tank") == attr("fill.tank")], on_full_match=False),
        [(t, {"tank": "t4"}) for t in ("Fill", "Pump", "Pump", "Leak", "Pump", "Empty")], 1),
    "negation_before_last": (
        dict(aliases=TANKS, seq=["fill", "pump", Not("leak"), "empty"], within="2 sec",
             where=[attr("leak.tank") == attr("fill.tank")], on_full_match=attr("fill.tank") != attr("empty.tank")),
        [("Fill", {"tank": "t1"}), ("Leak", {"tank": "t1"}), ("Pump", {"tank": "t3"}), ("Leak", {"tank": "t2"}), ("Empty", {"tank": "t1"})], 1),
    # a later event of the first type replaces the earlier one; numbers may come as text
    "latest_tariff_ok": (tariff_rule(), TARIFFS + [("RideBilled", {"zone": 9, "cents": 110}), ("RideBilled", {"zone": 5, "cents": 130})], 0),
    "latest_tariff_broken": (tariff_rule(), TARIFFS + [("RideBilled", {"zone": 9, "cents": 95}), ("RideBilled", {"zone": 5, "cents": 131})], 2),
    "single_step_number": (
        dict(aliases={"r": Alias("Reading", {"kind": "string", "celsius": "number"})}, seq=["r"],
             where=[attr("r.kind") == "soil"], on_full_match=(attr("r.celsius") < 35) & (attr("r.celsius") > 4)),
        [("Reading", {"kind": k, "celsius": c}) for k, c in (("soil", 3), ("soil", 20), ("air", 50), ("soil", 36), ("soil", 35))] + [("Rain", {})], 3),
    "single_step_text": (
        dict(aliases={"c": Alias("Consignment", {"by": "string", "state": "string"})}, seq=["c"],
             where=[attr("c.by") == "rail"], on_full_match=attr("c.state") != "lost"),
        [("Consignment", {"by": b, "state": s}) for b, s in (("rail", "lost"), ("rail", "here"), ("road", "lost"), ("rail", "lost"))], 2),
    "deadline": (
        dict(aliases=LOANS, seq=["lent", Or("back", "longer")], within="70 msec", where=[settled()], on_prefix_match={DEFAULT: False}),
        [loan("Lent", 7), loan("Lent", 8), loan("Lent", 9), loan("Returned", 8), loan("Extended", 9), loan("Returned", 60)], 1),
    "prefix_predicate": (
        dict(aliases=LOANS, seq=["lent", Or("back", "longer")], within="2 msec", where=[settled()],
             on_prefix_match={DEFAULT: attr("lent.fee") > 0}),
        [loan("Lent", 7, -3), loan("Lent", 8, 5), loan("Returned", 60), loan("Returned", 61), loan("Returned", 8)], 1),
    "full_and_prefix": (
        dict(aliases=LOANS, seq=["lent", Or("back", "longer")], within="50 msec", where=[settled()],
             on_full_match=(attr("lent.fee") == attr("back.fee")) | (attr("lent.fee") == attr("longer.fee")),
             on_prefix_match={DEFAULT: attr("lent.fee") > 0}),
        [loan("Lent", 7, -3), loan("Lent", 8, 40), loan("Returned", 8, 41), loan("Lent", 9, 12), loan("Extended", 9, 12)], 2),
    "default_prefix_short": (
        dict(aliases=LOANS, seq=["lent", "back", "longer"], within="1 msec", on_prefix_match={DEFAULT: attr("lent.fee") > -1}),
        [loan("Lent", 7, 40), loan("Lent", 8, -3), loan("Returned", 9)], 1),
    "default_prefix_long": (
        dict(aliases=LOANS, seq=["lent", "back", "longer"], within="3 sec", on_prefix_match={DEFAULT: attr("lent.fee") > -1}),
        [loan("Lent", 7, 40), loan("Lent", 8, -3), loan("Returned", 9)], 1),
    # the clause of the prefix that was reached counts, the default for all others
    "named_prefix": (
        dict(aliases=DEPOT, seq=["o", Not("k"), Or("p", "h"), "s", "v"], within="12 msec",
             where=[attr("o.parcel") == attr("k.parcel"), (attr("p.parcel") == attr("o.parcel")) | (attr("h.parcel") == attr("o.parcel")),
                    attr("s.parcel") == attr("o.parcel")],
             on_prefix_match={("o",): attr("o.weight") > 2, ("o", ("h", "p")): (attr("p.bay") > 5) | (attr("h.bay") > 5),
                              DEFAULT: attr("o.weight") == 1}),
        [("Ordered", {"parcel": 3, "weight": 9}), ("Cancelled", {"parcel": 4}), ("Held", {"parcel": 3, "bay": 2})] + [("Swept", {})] * 50, 1),
    # edges
    "closing_at_the_limit": (
        dict(aliases=NX, seq=["a", "b"], within="5 msec", where=[attr("a.id") == attr("b.id")],
             on_full_match=False, on_prefix_match={DEFAULT: attr("a.id") > 1}),
        [("A", {"id": 1}, 0), ("A", {"id": 2}, 0), ("B", {"id": 1}, 5), ("B", {"id": 2}, 4)], 2),
    "equal_times_keep_arrival_order": (
        dict(aliases=NX, seq=["a", "b"], within="5 msec", where=[attr("a.id") == attr("b.id")], on_full_match=False),
        [("B", {"id": 1}, 0), ("A", {"id": 1}, 0), ("A", {"id": 2}, 0), ("B", {"id": 2}, 0)], 1),
    "missing_member_under_or": (
        dict(aliases=NX, seq=["a", "b"], within="5 msec", where=[(attr("a.x") == attr("b.x")) | (attr("a.id") == attr("b.id"))],
             on_full_match=False),
        [("A", {"id": 1}), ("B", {"id": 1, "x": None}), ("A", {"id": 3, "x": None}), ("B", {"id": 4, "x": None})], 1),
    "text_that_is_no_number": (
        dict(aliases=NX, seq=["a"], where=[attr("a.x") == 0], on_full_match=False),
        [("A", {"x": "seven"}), ("A", {"x": "7"}), ("A", {"x": None}), ("A", {"x": 0})], 2),
    "number_not_equal": (
        dict(aliases=NX, seq=["a", "b"], within="1 sec", where=[attr("a.id") == attr("b.id")],
             on_full_match=attr("a.x") != attr("b.x")),
        [("A", {"id": 1, "x": 1}), ("B", {"id": 1, "x": 1}), ("A", {"id": 2, "x": 1}), ("B", {"id": 2, "x": 2})], 1),
    "star_may_be_empty": (
        dict(aliases=NX, seq=["a", Star("b"), "c"], within="1 sec",
             where=[attr("a.id") == attr("b.id"), attr("a.id") == attr("c.id")], on_full_match=False),
        [("A", {"id": 1}), ("C", {"id": 1}), ("A", {"id": 2}), ("B", {"id": 2}), ("C", {"id": 2})], 2),
    "plus_skips_early_closing": (
        dict(aliases=NX, seq=["a", Plus("b"), "c"], within="1 sec",
             where=[attr("a.id") == attr("b.id"), attr("a.id") == attr("c.id")],
             on_full_match=attr("b.x") > 1, on_prefix_match={DEFAULT: False}),
        [("A", {"id": 1}), ("C", {"id": 1}), ("B", {"id": 1, "x": 2}), ("B", {"id": 1, "x": 1}), ("C", {"id": 1})], 1),
    "killer_starts_a_match": (
        dict(aliases={"p": TARIFF, "q": TARIFF, "r": RIDE}, seq=["p", Not("q"), "r"], within="1 sec",
             where=[attr("p.zone") == attr("r.zone"), attr("p.zone") == attr("q.zone")], on_full_match=False),
        [("TariffSet", {"zone": 6}), ("TariffSet", {"zone": 6}), ("RideBilled", {"zone": 6})], 1),
    "trailing_negation": (
        dict(aliases=NX, seq=["a", "b", Not("c")], within="10 msec",
             where=[attr("a.id") == attr("b.id"), attr("a.id") == attr("c.id")], on_full_match=False),
        [("A", {"id": 1}), ("A", {"id": 2}), ("B", {"id": 2}), ("B", {"id": 1}), ("C", {"id": 1})], 1),
    "star_then_star": (
        dict(aliases=NX, seq=["a", Star("b"), Star("c"), "d"], within="1 sec", on_full_match=attr("c.x") > 1),
        [("A", {"x": 1}), ("C", {"x": 2}), ("D", {}), ("A", {}), ("B", {}), ("D", {})], 1),
}


@pytest.mark.parametrize("where_eval", ["deferred", "eager"])
@pytest.mark.parametrize("name", SCENARIOS)
def test_scenario(spark, name, where_eval):
    spec, rows, expected = SCENARIOS[name]
    inv = Invariant(name, where_eval=where_eval, **spec)
    frame, plain = make(rows)
    assert len(naive.violations(inv, plain)) == expected
    events = memory_events(spark, frame)
    runs = [{}, {"strategy": "sweep", "cells": CellOptions(cell_rows=2, grain_us=1000)}]
    with ThreadPoolExecutor(2) as pool:
        assert list(pool.map(lambda options: check(events, inv, **options).count(), runs)) == [expected, expected]


def test_loop_match_holds_every_event(spark):
    spec, rows, _ = SCENARIOS["loop_of_alternatives"]
    row = find_matches(memory_events(spark, make(rows)[0]), Invariant("m", **spec)).filter("kind = 'full'").first()
    assert [e.seq for e in row.pump] == [1, 2, 4] and [e.seq for e in row.leak] == [3]
    assert row.fill.seq == 0 and row.empty.seq == 5


def test_all_later_matches(spark):
    inv = Invariant("any", NX, ["a", "b"], within="1 sec", where=[attr("a.id") == attr("b.id")], on_full_match=False,
                    on_prefix_match={DEFAULT: False}, all_matches=True)
    frame, plain = make([("A", {"id": 1}), ("B", {"id": 1}), ("A", {"id": 1}), ("B", {"id": 1}), ("A", {"id": 2})])
    got = sorted((r.kind, r.start_id, r.end_id) for r in check(memory_events(spark, frame), inv).collect())
    assert got == [("full", 0, 1), ("full", 0, 3), ("full", 2, 3), ("timeout", 4, None)]
    assert len(naive.violations(inv, plain)) == 4


def test_open_end_of_input(spark):
    inv = Invariant("open", NX, [Step("a"), Step("b")], within="3 msec", where=[attr("a.id") == attr("b.id")],
                    on_prefix_match={DEFAULT: False})
    events = memory_events(spark, make([("A", {"id": 1}, 0), ("A", {"id": 2}, 2), ("X", {}, 3)])[0])
    assert [r.start_id for r in check(events, inv, end_of_input="open").collect()] == [0]
    assert [r.start_id for r in check(events, inv, end_of_input="open", strategy="sweep").collect()] == [0]
    assert check(events, inv).count() == 2
