"""Matching by ordered windows: one shuffle, one sort, no join of events with events.

Reading the events of a key backwards, ``last(...) ignoring nulls`` over the
rows already seen is the *next* fitting event.  The slot of an event of step i
holds the slot found for step i+1, so a start ends up with its whole chain.

Several invariants that share their key share the scan, the shuffle and the
sort; only the look-ahead columns differ.

Applicable when every predicate between steps is covered by the shared key, or
reads only steps bound earlier.  Hot keys are cut into cells; each cell is
scanned on its own and what lies beyond its end is taken from a small table
with one row per cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.model import Invariant
from evwarden.operators.cells import CellOptions, assign_cells
from evwarden.operators.project import Layout, _literal, fits, key_columns, project_events
from evwarden.predicates import Literal, Predicate, aliases_of, compare, to_column


def scannable(inv: Invariant) -> bool:
    """Whether windows can express the invariant."""
    if inv.all_matches or any(s.loop for s in inv.steps):
        return False
    classes = inv.key_classes()
    for i in range(1, len(inv.steps)):
        for term in inv.step_terms[i]:
            here = [a for a in aliases_of(term) if inv.step_of[a] == i]
            local = len(here) == len(aliases_of(term))
            if here and not local and not inv.is_key_term(term, i, classes):
                return False
    return True


def key_signature(inv: Invariant) -> tuple | None:
    """Invariants with equal signatures can share one scan: the members that make up the key of every event."""
    if len(inv.steps) == 1 or not scannable(inv):
        return None
    signature = []
    for chosen in inv.key_classes():
        members = {(ref.path, inv.member_type(ref)) for ref in chosen}
        if len(members) != 1:
            return None
        signature += members
    return tuple(sorted(signature))


def scan_matches(
    events: DataFrame, inv: Invariant, layout: Layout, opts: CellOptions, open_until: Column | None
) -> DataFrame:
    """Full and timed-out matches, one row per start."""
    chain = Chain(inv, layout)
    cols = chain.match_columns(open_until)
    return look_ahead(events, [chain], opts).select(*[c.alias(n) for n, c in cols.items()]).filter(
        F.col("kind").isNotNull()
    )


def look_ahead(events: DataFrame, chains: Sequence[Chain], opts: CellOptions) -> DataFrame:
    """The starts of all chains, with the look-ahead columns of each."""
    first = chains[0]
    classes = first.inv.key_classes()
    keys = [f"k{n}" for n in range(len(classes))]
    types = sorted({t for c in chains for t in c.inv.types})
    ev = project_events(events, first.layout, types=types)
    ev = ev.select("*", *[c.alias(k) for k, c in zip(keys, key_columns(first.layout, classes))])
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    ev = ev.select("*", *[role for c in chains for role in c.roles(keyed)])
    ev = ev.filter(_any([c.role(i) for c in chains for i in range(len(c.inv.steps))]))
    is_start = _any([c.role(0) for c in chains])
    if all(len(c.inv.steps) == 1 for c in chains):
        return ev.filter(is_start)
    limits = [c.inv.within_us for c in chains]
    ev, split = assign_cells(ev, keys, opts, None if None in limits else max(limits))
    ahead = (
        Window.partitionBy(*keys, "cell")
        .orderBy(F.desc("us"), F.desc("seq"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for c in chains:
        ev = c.add_pointers(ev, ahead)
    starts = ev.filter(is_start)
    if split:
        cells = ev.filter("cell >= 0").groupBy(*keys, "cell").agg(*[a for c in chains for a in c.first_in_cell()])
        later = Window.partitionBy(*keys).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
        for c in chains:
            cells = c.add_carried(cells, later)
        carried = [n for c in chains for n in c.carried]
        starts = starts.join(cells.select(*keys, "cell", *carried), [*keys, "cell"], "left")
        for c in chains:
            starts = c.complete(starts)
        starts = starts.drop(*carried)
    return starts


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


@dataclass
class Chain:
    """The look-ahead columns of one invariant; ``tag`` keeps those of several apart.

    ``r<i>``: the event fits step i; ``nx<i>``: next event of positive step i;
    ``ng<i>``: next event that must not follow step i.  ``cnx``/``cng``: the
    same, taken from the later cells of a hot key.
    """

    inv: Invariant
    layout: Layout
    tag: str = ""

    def __post_init__(self) -> None:
        self.negations = {i: self.inv.negations_after(i) for i in self.inv.positive if self.inv.negations_after(i)}
        self.carried = [self._n("cng", i) for i in self.negations] + [self._n("cnx", i) for i in self.inv.positive[1:]]

    def _n(self, kind: str, i: int) -> str:
        return f"{kind}{self.tag}{i}"

    def role(self, i: int) -> Column:
        return F.col(self._n("r", i))

    def roles(self, keyed: Column) -> list[Column]:
        steps = range(len(self.inv.steps))
        conditions = [fits(self.layout, i) & keyed if i else fits(self.layout, i) for i in steps]
        return [c.alias(self._n("r", i)) for i, c in zip(steps, conditions)]

    def _next(self, i: int) -> int | None:
        return next((j for j in self.inv.positive if j > i), None)

    def _forbidden(self, i: int) -> Column:
        """Position of the current event if it must not follow step ``i``."""
        return F.when(_any([self.role(j) for j in self.negations[i]]), F.struct("us", "seq"))

    def _slot(self, i: int) -> Column:
        """The current event as step ``i``, with what follows it."""
        fields = self.layout.event_slot(i)
        if i in self.negations:
            fields.append(F.col(self._n("ng", i)).alias("ng"))
        if self._next(i) is not None:
            fields.append(F.col(self._n("nx", self._next(i))).alias("nx"))
        return F.when(self.role(i), F.struct(*fields))

    def add_pointers(self, ev: DataFrame, ahead: Window) -> DataFrame:
        out = ev.select(
            "*",
            *[F.last(self._forbidden(i), ignorenulls=True).over(ahead).alias(self._n("ng", i)) for i in self.negations],
        )
        for i in reversed(self.inv.positive[1:]):
            out = out.withColumn(self._n("nx", i), F.last(self._slot(i), ignorenulls=True).over(ahead))
        return out

    def first_in_cell(self) -> list[Column]:
        first = [F.min(self._forbidden(i)).alias(self._n("ng", i)) for i in self.negations]
        return first + [F.min(self._slot(i)).alias(self._n("nx", i)) for i in self.inv.positive[1:]]

    def add_carried(self, cells: DataFrame, later: Window) -> DataFrame:
        """From the first events per cell to the first ones in any later cell, with their chains completed."""
        out = cells.select(
            "*",
            *[F.last(self._n("ng", i), ignorenulls=True).over(later).alias(self._n("cng", i)) for i in self.negations],
        )
        for i in reversed(self.inv.positive[1:]):
            own = self._filled(F.col(self._n("nx", i)), i)
            out = out.withColumn(self._n("cnx", i), F.last(own, ignorenulls=True).over(later))
        return out

    def _filled(self, slot: Column, i: int) -> Column:
        """A chain found inside a cell, its open ends taken from the later cells."""
        out = slot
        if i in self.negations:
            out = out.withField("ng", F.coalesce(slot["ng"], F.col(self._n("cng", i))))
        following = self._next(i)
        if following is not None:
            rest = F.coalesce(self._filled(slot["nx"], following), F.col(self._n("cnx", following)))
            out = out.withField("nx", rest)
        return F.when(slot.isNotNull(), out)

    def complete(self, starts: DataFrame) -> DataFrame:
        """Pointers of starts whose chain runs past the end of their cell."""
        out = starts
        if 0 in self.negations:
            out = out.withColumn(self._n("ng", 0), F.coalesce(self._n("ng", 0), self._n("cng", 0)))
        second = self._next(0)
        if second is not None:
            filled = self._filled(F.col(self._n("nx", second)), second)
            out = out.withColumn(self._n("nx", second), F.coalesce(filled, F.col(self._n("cnx", second))))
        return out

    def match_columns(self, open_until: Column | None) -> dict[str, Column]:
        """The match of a start row; ``kind`` is null if there is none.

        Applies the limit, the negations and the terms on earlier steps to the chain.
        """
        inv, layout = self.inv, self.layout
        limit = None if inv.within_us is None else F.col("us") + F.lit(inv.within_us)
        slots = {0: F.struct(*layout.event_slot(0))}
        bound = {0: F.lit(True)}
        killed = F.lit(False)
        second = self._next(0)
        pointer, previous = None if second is None else F.col(self._n("nx", second)), 0
        blocker = F.col(self._n("ng", 0)) if 0 in self.negations else None

        def in_time(pos: Column) -> Column:
            return pos.isNotNull() if limit is None else pos.isNotNull() & (pos["us"] < limit)

        for i in inv.positive[1:]:
            ok = bound[previous] & in_time(pointer)
            for term in inv.step_terms[i]:
                if all(inv.step_of[a] < i for a in aliases_of(term)):
                    ok = ok & _on_slots(term, inv, layout, slots)
            if blocker is not None:
                before = ~ok | (blocker["us"] < pointer["us"]) | (
                    (blocker["us"] == pointer["us"]) & (blocker["seq"] < pointer["seq"])
                )
                hit = F.coalesce(bound[previous] & in_time(blocker) & before, F.lit(False))
                killed = killed | hit
                ok = ok & ~hit
            bound[i] = F.coalesce(ok, F.lit(False))
            slots[i] = F.struct(*[pointer[f].alias(f) for f in ("us", "seq", "type", *layout.slot_members(i))])
            blocker = pointer["ng"] if i in self.negations else None
            previous = i
            if self._next(i) is not None:
                pointer = pointer["nx"]
        complete = bound[previous]
        if inv.trailing_negation:
            killed = killed | F.coalesce(complete & in_time(blocker), F.lit(False))
            complete = complete & ~killed

        # what ends at the limit: timeouts, and full matches that end with a negation
        waited = F.lit(True) if inv.trailing_negation else ~complete
        decided = complete if limit is None else complete | ~killed
        if limit is not None and open_until is not None:
            decided = decided & (~waited | (limit <= open_until))
        mask = F.lit(0).cast("long")
        for i in inv.positive:
            mask = mask + F.when(bound[i], F.lit(1 << i)).otherwise(F.lit(0))
        no_limit = F.lit(None).cast("long")
        return {
            "kind": F.when(self.role(0) & decided, F.when(complete, F.lit("full")).otherwise(F.lit("timeout"))),
            "start_us": F.col("us"),
            "start_seq": F.col("seq"),
            "end_us": F.when(waited, no_limit if limit is None else limit).otherwise(slots[previous]["us"]),
            "end_seq": F.when(~waited, slots[previous]["seq"]),
            "bound": mask,
            **{f"s{i}": F.when(bound[i], slots[i]).cast(layout.slot_type(i)) for i in inv.positive},
        }


def _on_slots(term: Predicate, inv: Invariant, layout: Layout, slots: dict[int, Column]) -> Column:
    def side(s):
        return F.lit(_literal(s)) if isinstance(s, Literal) else slots[inv.step_of[s.alias]].getField(layout.of(s))

    return to_column(term, lambda c: compare(c.op, side(c.left), side(c.right)))
