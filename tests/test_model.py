"""Declarations that must be accepted or rejected before any job runs."""

import pytest

from evwarden import DEFAULT, Alias, Invariant, InvariantError, Not, Or, Plus, Star, Step, attr
from evwarden.model import duration_us
from evwarden.operators.scan import scannable

AL = {n: Alias(n.upper(), {"id": "number", "x": "number", "s": "string", "f": "bool", "t": "timestamp"}) for n in "abcde"}


def inv(seq, where=(), **kw):
    return Invariant("i", AL, seq, where=where, **{"within": "1 sec", **kw})


REJECTED = {
    "two negated aliases in a term": lambda: inv(["a", Not("b"), "d", Not("c"), "e"], [attr("b.id") == attr("c.id")]),
    "alias used twice": lambda: inv(["a", "b", "a"]),
    "alias not declared": lambda: inv(["a", "z"]),
    "negated alias with a later alias": lambda: inv(["a", Not("b"), "c"], [attr("b.id") == attr("c.id")]),
    "repeated alias with a later alias": lambda: inv(["a", Plus("b"), "c"], [attr("b.id") == attr("c.id")]),
    "repeated last step": lambda: inv(["a", Plus("b")]),
    "repeated first step": lambda: inv([Star("a"), "b"]),
    "negated first step": lambda: inv([Not("a"), "b"]),
    "negated and repeated": lambda: inv(["a", Step("b", kind="plus", negated=True), "c"]),
    "trailing negation without limit": lambda: inv(["a", Not("b")], within=None),
    "prefix clause without limit": lambda: inv(["a", "b"], within=None, on_prefix_match={DEFAULT: False}),
    "repeated prefix": lambda: inv(["a", Or("b", "c"), "d"], on_prefix_match={("a", ("b", "c")): False, ("a", ("c", "b")): True}),
    "prefix that is not leading": lambda: inv(["a", "b", "c"], on_prefix_match={("b",): False}),
    "prefix that is too long": lambda: inv(["a", "b"], on_prefix_match={("a", "b", "c"): False}),
    "different types": lambda: inv(["a", "b"], [attr("a.id") == attr("b.s")]),
    "two literals": lambda: inv(["a"], on_full_match=_literals()),
    "order on text": lambda: inv(["a", "b"], [attr("a.s") < attr("b.s")]),
    "order on bool": lambda: inv(["a"], [attr("a.f") >= True]),
    "timestamps compared": lambda: inv(["a", "b"], [attr("a.t") == attr("b.t")]),
    "member not declared": lambda: inv(["a"], [attr("a.nope") == 1]),
    "verdict on a negated alias": lambda: inv(["a", Not("b"), "c"], on_full_match=attr("b.id") == 1),
    "empty sequence": lambda: inv([]),
    "bad duration": lambda: inv(["a"], within="soon"),
    "bad mode": lambda: inv(["a"], where_eval="later"),
    "bad member type": lambda: Alias("A", {"id": "decimal"}),
    "every later match without limit": lambda: inv(["a", "b"], within=None, all_matches=True),
}


def _literals():
    from evwarden.predicates import Comparison, Literal

    return Comparison("=", Literal(1), Literal(1))


@pytest.mark.parametrize("name", REJECTED)
def test_rejected(name):
    with pytest.raises(InvariantError):
        REJECTED[name]()


def test_stream_needs_a_limit(spark):
    from evwarden.streaming import match_stream

    with pytest.raises(InvariantError):
        match_stream(spark.readStream.format("rate").load(), inv(["a", "b"], within=None))


def test_durations():
    assert [duration_us(t) for t in ("30 min", "60 sec", "1 hour", "500 msec", "2 days", 1.5)] == [
        1_800_000_000, 60_000_000, 3_600_000_000, 500_000, 172_800_000_000, 1_500_000,
    ]


def test_predicates_are_not_booleans():
    with pytest.raises(TypeError):
        bool(attr("a.id") == attr("b.id"))


def test_keys_and_strategy():
    keyed = inv(["a", Not("b"), "c"], [attr("a.id") == attr("b.id"), attr("a.id") == attr("c.id"), attr("c.x") > 1])
    assert len(keyed.key_classes()) == 1 and scannable(keyed)
    chained = inv(["a", "b", "c"], [attr("a.id") == attr("b.id"), attr("b.id") == attr("c.id")], where_eval="eager")
    assert scannable(chained)
    # deferred, the middle step is not tied to the key
    assert not inv(["a", "b", "c"], [attr("a.id") == attr("b.id"), attr("b.id") == attr("c.id")]).key_classes()
    either = inv(["a", Or("b", "c")], [(attr("a.id") == attr("b.id")) | (attr("a.id") == attr("c.id"))])
    assert len(either.key_classes()) == 1 and scannable(either)
    assert not scannable(inv(["a", "b"], [attr("a.x") < attr("b.x")]))
    mixed = inv(["a", "b"], [(attr("a.id") == attr("b.id")) | (attr("a.x") == attr("b.x"))])
    assert not mixed.key_classes() and not scannable(mixed)
    two = inv(["a", "b"], [attr("a.id") == attr("b.id"), attr("a.s") == attr("b.s")])
    assert len(two.key_classes()) == 2
    # one type that would need two different keys at once
    parent = Invariant(
        "p", {"x": Alias("N", {"id": "number", "parent": "number"}), "y": Alias("N", {"id": "number", "parent": "number"})},
        ["x", "y"], within="1 sec", where=[attr("x.id") == attr("y.parent")],
    )
    assert not parent.key_classes()
