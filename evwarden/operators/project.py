"""Event rows as the matchers need them: relevant types, typed members, roles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwarden.functions.members import members
from evwarden.model import Invariant
from evwarden.predicates import Literal, Predicate, Ref, aliases_of, compare, refs, to_column

_SQL_TYPE = {"number": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp"}


@dataclass
class Layout:
    """Which physical column holds which member."""

    inv: Invariant
    columns: dict[tuple[str, str], str] | None = None

    def __post_init__(self) -> None:
        if self.columns is None:
            self.columns = {member: f"m{n}" for n, member in enumerate(wanted_members(self.inv))}

    def of(self, ref: Ref) -> str:
        return self.columns[(ref.path, self.inv.member_type(ref))]

    def slot_members(self, i: int) -> list[str]:
        """Member columns kept for an event bound at step ``i``."""
        keep: dict[str, None] = {}
        for a in self.inv.steps[i].aliases:
            for path, kind in self.inv.aliases[a].schema.items():
                keep[self.columns[(path, kind)]] = None
        for term in self.inv.terms:
            for r in refs(term):
                if self.inv.step_of[r.alias] == i:
                    keep[self.of(r)] = None
        return list(keep)

    def slot_type(self, i: int) -> str:
        kinds = {col: _SQL_TYPE[kind] for (_, kind), col in self.columns.items()}
        fields = ", ".join(f"{m}: {kinds[m]}" for m in self.slot_members(i))
        return "struct<us: bigint, seq: bigint, type: string" + (", " + fields if fields else "") + ">"

    def event_slot(self, i: int) -> list[Column]:
        return [F.col(c) for c in ("us", "seq", "type", *self.slot_members(i))]


def wanted_members(inv: Invariant) -> list[tuple[str, str]]:
    """``(path, kind)`` of the members declared for bound events or named in WHERE."""
    wanted: dict[tuple[str, str], None] = {}
    for i in inv.positive:
        for a in inv.steps[i].aliases:
            for path, kind in inv.aliases[a].schema.items():
                wanted[(path, kind)] = None
    for term in inv.terms:
        for r in refs(term):
            wanted[(r.path, inv.member_type(r))] = None
    return list(wanted)


def shared_layouts(invariants: Sequence[Invariant]) -> list[Layout]:
    """Layouts of several invariants over one set of member columns."""
    wanted = dict.fromkeys(m for inv in invariants for m in wanted_members(inv))
    columns = {member: f"m{n}" for n, member in enumerate(wanted)}
    return [Layout(inv, columns) for inv in invariants]


def local_terms(inv: Invariant, i: int) -> list[Predicate]:
    """Terms tested at step ``i`` that read the current event only."""
    return [t for t in inv.step_terms[i] if all(inv.step_of[a] == i for a in aliases_of(t))]


def current_event(layout: Layout, pred: Predicate) -> Column:
    """``pred`` on the current row; aliases stand for it whatever its type."""

    def leaf(c):
        sides = [F.lit(_literal(s)) if isinstance(s, Literal) else F.col(layout.of(s)) for s in (c.left, c.right)]
        return compare(c.op, *sides)

    return to_column(pred, leaf)


def _literal(lit: Literal):
    number = isinstance(lit.value, (int, float)) and not isinstance(lit.value, bool)
    return float(lit.value) if number else lit.value


def fits(layout: Layout, i: int) -> Column:
    """Type and single-event terms of step ``i``."""
    inv = layout.inv
    out = F.col("type").isin(inv.step_types(i))
    for term in local_terms(inv, i):
        out = out & current_event(layout, term)
    return out


def project_events(
    events: DataFrame, layout: Layout, keep: Sequence[str] = (), types: Sequence[str] | None = None
) -> DataFrame:
    """``type, us, seq, m0…`` for the event types the invariant names.

    The type filter and the member projection sit directly on the scan, so
    Parquet gets the pushed filter and reads only the named columns.
    """
    cols = members(F.col("content"), events.schema["content"].dataType, layout.columns)
    relevant = F.col("type").isin(list(types or layout.inv.types))
    if events.isStreaming:
        relevant = behind_watermark(relevant)
    return events.filter(relevant).select(
        "type",
        F.unix_micros("ts").alias("us"),
        "seq",
        *[cols[m].alias(c) for m, c in layout.columns.items()],
        *keep,
    )


def behind_watermark(condition: Column) -> Column:
    """A filter that stays above the watermark.

    Spark pushes filters on other columns below it, and then events of other
    types would no longer move the event time on.
    """
    return F.when(F.col("ts").isNotNull(), condition).otherwise(F.lit(False))


def key_columns(layout: Layout, classes: list[list[Ref]]) -> list[Column]:
    """The shared key of an event, one column per class; null if the member is missing."""
    inv, out = layout.inv, []
    for chosen in classes:
        by_column: dict[str, set[str]] = {}
        for i, ref in enumerate(chosen):
            by_column.setdefault(layout.of(ref), set()).update(inv.step_types(i))
        if len(by_column) == 1:
            out.append(F.col(next(iter(by_column))))
        else:
            out.append(F.coalesce(*[F.when(F.col("type").isin(sorted(ts)), F.col(c)) for c, ts in by_column.items()]))
    return out
