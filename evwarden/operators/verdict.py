"""From matches to violations: full-match and prefix clauses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwarden.model import DEFAULT, Clause, Invariant
from evwarden.operators.project import Layout, _literal
from evwarden.predicates import Comparison, Literal, Predicate, Ref, compare, to_column


def bindings(matches: DataFrame, inv: Invariant, layout: Layout, figures: bool = False) -> DataFrame:
    """Match rows with one column per alias instead of one per step.

    An alias holds ``struct<ts, seq, member…>``, or an array of them for a
    repeated step (with ``figures``, the struct of its figures).  An alias of an OR step is set only if the event has its type.
    """
    return matches.select(*binding_columns(inv, layout, figures=figures))


def binding_columns(inv: Invariant, layout: Layout, col: Callable[[str], Column] = F.col, figures: bool = False) -> list[Column]:
    """The columns of :func:`bindings`; ``col`` gives a column of the match row."""
    cols = [
        F.lit(inv.name).alias("invariant"),
        col("kind").alias("kind"),
        F.timestamp_micros(col("start_us")).alias("start_ts"),
        col("start_seq").alias("start_id"),
        F.timestamp_micros(col("end_us")).alias("end_ts"),
        col("end_seq").alias("end_id"),
        col("bound").alias("bound"),
    ]
    for i in inv.positive:
        step = inv.steps[i]
        if step.loop and figures:
            cols += [col(f"f_{a}").alias(a) for a in step.aliases]
            continue
        slot = col(f"s{i}")
        for a in step.aliases:
            if step.loop:
                cols.append(_alias_array(slot, inv, layout, a).alias(a))
            else:
                own = F.when(slot["type"] == F.lit(inv.aliases[a].type), _alias_struct(slot, inv, layout, a))
                cols.append(own.alias(a))
    return cols


def _alias_array(slot: Column, inv: Invariant, layout: Layout, alias: str) -> Column:
    found = F.filter(slot, lambda e: e["type"] == F.lit(inv.aliases[alias].type))
    return F.transform(found, lambda e: _alias_struct(e, inv, layout, alias))


def _alias_struct(event: Column, inv: Invariant, layout: Layout, alias: str) -> Column:
    fields = [F.timestamp_micros(event["us"]).alias("ts"), event["seq"].alias("seq")]
    for path, kind in inv.aliases[alias].schema.items():
        fields.append(event[layout.columns[(path, kind)]].alias(path))
    return F.struct(*fields)


def violated(inv: Invariant, col: Callable[[str], Column] = F.col, figures: bool = False) -> Column:
    """Whether a row of :func:`bindings` breaks a clause; a kind without a clause never does."""
    breaks = lambda clause: _breaks(clause, inv, col, figures)
    full = F.lit(False) if inv.on_full_match is None else breaks(inv.on_full_match)
    default = inv.on_prefix_match.get(DEFAULT)
    prefix = F.lit(False) if default is None else breaks(default)
    for steps, clause in inv.prefixes:
        mask = sum(1 << i for i in steps)
        prefix = F.when(col("bound") == F.lit(mask), breaks(clause)).otherwise(prefix)
    return F.when(col("kind") == "full", full).when(col("kind") == "timeout", prefix).otherwise(F.lit(False))


def _breaks(clause: Clause, inv: Invariant, col: Callable[[str], Column], figures: bool) -> Column:
    if isinstance(clause, bool):
        return F.lit(not clause)
    return ~to_column(clause, lambda c: _by_figures(c, inv, col) if figures else _universal(c, inv, col))


def _by_figures(c: Comparison, inv: Invariant, col: Callable[[str], Column]) -> Column:
    """:func:`_universal` where a repeated step holds its figures: the extremes decide, and no event may miss the member."""

    def ends(side: Ref | Literal) -> tuple[Column, Column, Column]:
        if isinstance(side, Ref) and inv.steps[inv.step_of[side.alias]].loop:
            loop = col(side.alias)
            return loop["min"][side.path], loop["max"][side.path], (loop["n"] > 0) & (loop["missing"][side.path] == 0)
        value, _ = _values(side, inv, col)
        return value, value, F.lit(True)

    (least, most, some), (other_least, other_most, others) = ends(c.left), ends(c.right)
    if c.op == "=":
        holds = (least == most) & (other_least == other_most) & (least == other_least)
    else:
        holds = {"<": most < other_least, "<=": most <= other_least, ">": least > other_most, ">=": least >= other_most, "!=": least != other_least}[c.op]
    return F.coalesce(holds & some & others, F.lit(False))


def _universal(c: Comparison, inv: Invariant, col: Callable[[str], Column]) -> Column:
    """True iff both sides have events and the comparison holds for every pair of them."""
    sides = [_values(s, inv, col) for s in (c.left, c.right)]
    (lv, l_many), (rv, r_many) = sides
    if not l_many and not r_many:
        return compare(c.op, lv, rv)
    if l_many and r_many:
        numbers = inv._kind(c.left) == "number"
        return all_pairs(c.op, lv, rv, numbers)
    if l_many:
        return F.coalesce((F.size(lv) > 0) & F.forall(lv, lambda x: compare(c.op, x, rv)), F.lit(False))
    return F.coalesce((F.size(rv) > 0) & F.forall(rv, lambda y: compare(c.op, lv, y)), F.lit(False))


def all_pairs(op: str, left: Column, right: Column, numbers: bool = False) -> Column:
    """Whether two lists have elements, none missing, and every pair of them compares true: decided by the extremes of each list.

    ``!=`` holds for every pair if the lists have no element in common, zeros of both signs being one.
    """
    if numbers and op == "!=":
        left, right = (F.transform(side, lambda x: x + F.lit(0.0)) for side in (left, right))
    known = F.lit(True)
    for side in (left, right):
        known = known & (F.size(side) > 0) & F.forall(side, lambda x: x.isNotNull())
    least, most = F.array_min, F.array_max
    holds = {
        "<": lambda: most(left) < least(right), "<=": lambda: most(left) <= least(right),
        ">": lambda: least(left) > most(right), ">=": lambda: least(left) >= most(right),
        "=": lambda: (least(left) == most(left)) & (least(right) == most(right)) & (least(left) == least(right)),
        "!=": lambda: ~F.arrays_overlap(left, right),
    }[op]()
    return F.coalesce(known & holds, F.lit(False))


def _values(side: Ref | Literal, inv: Invariant, col: Callable[[str], Column]) -> tuple[Column, bool]:
    if isinstance(side, Literal):
        return F.lit(_literal(side)), False
    loop = inv.steps[inv.step_of[side.alias]].loop
    if loop:
        return F.transform(col(side.alias), lambda e: e.getField(side.path)), True
    return col(side.alias).getField(side.path), False


def clause_kinds(inv: Invariant) -> list[str]:
    """The kinds of matches that a clause of the invariant judges."""
    return [k for k, has in (("full", inv.on_full_match is not None), ("timeout", bool(inv.on_prefix_match))) if has]


def violations(bound: DataFrame, inv: Invariant, figures: bool = False) -> DataFrame:
    """Only the rows that break a clause; kinds without a clause never reach the expression."""
    return bound.filter(F.col("kind").isin(clause_kinds(inv)) & violated(inv, figures=figures))


RECORD = ("invariant", "kind", "start_ts", "start_id", "end_ts", "end_id")


def as_records(found: DataFrame, inv: Invariant) -> DataFrame:
    """``invariant, kind, start_ts, …, match`` with the match as JSON text: one schema for every invariant."""
    return found.select(*RECORD, match_text(inv).alias("match"))


def match_text(inv: Invariant, col: Callable[[str], Column] = F.col) -> Column:
    return F.to_json(F.struct(*[col(a).alias(a) for i in inv.positive for a in inv.steps[i].aliases]))


def records_together(matches: DataFrame, patterns: Sequence[tuple[Invariant, Layout]]) -> DataFrame:
    """The records of several invariants from rows with a match, or null, of each: columns ``match0``, ``match1``, …."""

    def within(name: str) -> Callable[[str], Column]:
        return lambda field: F.col(name).getField(field)

    bound = matches.select(
        *[F.struct(*binding_columns(inv, layout, within(f"match{n}"))).alias(f"bound{n}") for n, (inv, layout) in enumerate(patterns)]
    )
    records = F.array(
        *[
            F.when(
                violated(inv, within(f"bound{n}")),
                F.struct(*[F.col(f"bound{n}").getField(f).alias(f) for f in RECORD], match_text(inv, within(f"bound{n}")).alias("match")),
            )
            for n, (inv, _) in enumerate(patterns)
        ]
    )
    return bound.select(F.explode(F.filter(records, lambda r: r.isNotNull())).alias("r")).select("r.*")
