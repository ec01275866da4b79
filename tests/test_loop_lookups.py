from evwarden.model import Alias, Invariant, Plus
from evwarden.operators.loops import _Loop
from evwarden.operators.project import Layout
from evwarden.predicates import attr


def loop(clause, figures=("n",)):
    aliases = {a: Alias(t, {"k": "number", "q": "number"}) for a, t in (("o", "order"), ("l", "line"), ("c", "close"))}
    inv = Invariant("i", aliases, ["o", Plus("l"), "c"], within="2 hours", where=[attr("o.k") == attr("l.k"), attr("o.k") == attr("c.k")], on_full_match=clause)
    return _Loop(inv, Layout(inv), "l", figures)


def test_only_extremes_that_decide_a_clause_are_kept():
    assert loop(attr("l.q") < 48).sides == {"q": ["max"]} and loop(attr("l.q") <= 48).sides == {"q": ["max"]}
    assert loop(attr("l.q") > 48).sides == {"q": ["min"]} and loop(attr("l.q") == 48).sides == {"q": ["min", "max"]}
    assert loop(attr("o.q") < attr("l.q")).sides == {"q": ["min"]} and loop(attr("o.q") > attr("l.q")).sides == {"q": ["max"]}
    assert loop(attr("l.q") < 48, ["n", "max"]).sides == {"k": ["min", "max"], "q": ["min", "max"]}
