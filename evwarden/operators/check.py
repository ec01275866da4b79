"""Batch entry points: :func:`find_matches`, :func:`check`, :func:`check_all`."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwarden.model import Invariant
from evwarden.operators.cells import CellOptions
from evwarden.operators.joins import loop_matches, loopable, pair_matches, pairable, tail_matches, tailable
from evwarden.operators.loops import figure_matches, judged_by_extremes
from evwarden.operators.nearest import nearest_matches, searches
from evwarden.operators.project import Layout, shared_layouts
from evwarden.operators.scan import Chain, key_signature, look_ahead, scan_matches, scannable
from evwarden.operators.stages import staged, staged_matches
from evwarden.operators.sweep import sweep_matches
from evwarden.operators.verdict import as_records, bindings, records_together, violations


def find_matches(
    events: DataFrame,
    inv: Invariant,
    end_of_input: str = "flush",
    strategy: str = "auto",
    cells: CellOptions = CellOptions(),
    loops: Sequence[str] | None = None,
) -> DataFrame:
    """Full and timed-out matches of ``inv`` in ``events(type, content, ts, seq)``.

    ``end_of_input="flush"`` closes every open match at the end of the data;
    ``"open"`` leaves out those whose limit lies beyond the latest event.
    ``loops`` asks for figures of a repeated step instead of its events, of
    :data:`evwarden.operators.loops.FIGURES`; then no match collects its loop events.
    """
    if strategy not in ("auto", "scan", "nearest", "joins", "stages", "sweep"):
        raise ValueError("strategy must be 'auto', 'scan', 'nearest', 'joins', 'stages' or 'sweep'")
    if strategy == "stages" and not staged(inv):
        raise ValueError(f"invariant {inv.name!r} needs another strategy than stages")
    if strategy == "nearest" and searches(inv) is None:
        raise ValueError(f"invariant {inv.name!r} needs another strategy than nearest")
    if strategy == "joins" and not (pairable(inv) or loopable(inv) or tailable(inv)):
        raise ValueError(f"invariant {inv.name!r} needs another strategy than joins")
    if strategy == "scan" and not scannable(inv):
        raise ValueError(f"invariant {inv.name!r} needs the sweep strategy")
    open_until = None if inv.within_us is None else _open_until(events, end_of_input)
    layout = Layout(inv)
    if loops is not None:
        if not loopable(inv) or not judged_by_extremes(inv):
            raise ValueError(f"invariant {inv.name!r} has no single loop tied by a key, or compares its members with !=")
        return bindings(figure_matches(events, inv, layout, cells, open_until, loops), inv, layout, figures=True)
    if strategy == "scan" or (strategy == "auto" and scannable(inv)):
        found = scan_matches(events, inv, layout, cells, open_until)
    elif strategy in ("auto", "nearest") and searches(inv) is not None:
        found = nearest_matches(events, inv, layout, cells, open_until)
    elif strategy == "stages":
        found = staged_matches(events, inv, layout, cells, open_until)
    elif strategy != "sweep" and pairable(inv):
        found = pair_matches(events, inv, layout, open_until)
    elif strategy != "sweep" and loopable(inv):
        found = loop_matches(events, inv, layout, cells, open_until)
    elif strategy != "sweep" and tailable(inv):
        found = tail_matches(events, inv, layout, cells, open_until)
    elif strategy != "sweep" and staged(inv):
        found = staged_matches(events, inv, layout, cells, open_until)
    else:
        found = sweep_matches(events, inv, layout, cells, open_until)
    return bindings(found, inv, layout)


def _open_until(events: DataFrame, end_of_input: str) -> Column | None:
    """The latest time of the input, as a subquery of the plan."""
    if end_of_input not in ("flush", "open"):
        raise ValueError("end_of_input must be 'flush' or 'open'")
    return None if end_of_input == "flush" else events.agg(F.max(F.unix_micros("ts"))).scalar()


def check(events: DataFrame, inv: Invariant, **options) -> DataFrame:
    """The violations of ``inv``: one row each, with a struct column per alias."""
    return violations(find_matches(events, inv, **options), inv, figures=options.get("loops") is not None)


def check_all(
    events: DataFrame,
    invariants: Sequence[Invariant],
    end_of_input: str = "flush",
    cells: CellOptions = CellOptions(),
) -> DataFrame:
    """Violations of several invariants in one table, the match as JSON text.

    Invariants whose events are tied by the same key members are answered by one
    scan, one shuffle and one sort; the others run on their own.
    """
    if not invariants:
        raise ValueError("no invariants given")
    if len({inv.name for inv in invariants}) < len(invariants):
        raise ValueError("invariants need different names")
    shared: dict[tuple, list[Invariant]] = {}
    for n, inv in enumerate(invariants):
        shared.setdefault(key_signature(inv) or ("alone", n), []).append(inv)
    found = []
    for group in shared.values():
        if len(group) == 1:
            options = {"end_of_input": end_of_input, "cells": cells}
            found.append(as_records(check(events, group[0], **options), group[0]))
        else:
            found.append(_check_together(events, group, _open_until(events, end_of_input), cells))
    return reduce(DataFrame.unionByName, found)


def _check_together(
    events: DataFrame, invariants: Sequence[Invariant], open_until: Column | None, cells: CellOptions
) -> DataFrame:
    layouts = shared_layouts(invariants)
    chains = [Chain(inv, layout, f"_{n}_") for n, (inv, layout) in enumerate(zip(invariants, layouts))]
    starts = look_ahead(events, chains, cells)

    matches = starts.select(
        *[
            F.struct(*[c.alias(n) for n, c in chain.match_columns(open_until).items()]).alias(f"match{n}")
            for n, chain in enumerate(chains)
        ]
    )
    return records_together(matches, [(c.inv, c.layout) for c in chains])
