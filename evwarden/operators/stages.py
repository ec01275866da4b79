"""Patterns with several loops and negations, by pointers from state to state.

The state of a match is the step that it entered last.  In a state an event does nothing, or moves the match to a later step, or discards
it; what it does depends on the event alone if all terms are key terms or read one event.  So each row holds, for every state, the next event that moves a
match out of it, and that event's own pointers for the state that it moves to: at a start the whole course of its match is known.
Reading a key backwards, ``last(... ignoring nulls)`` finds these events, from the last state to the first, with one shuffle and one sort.

Loop events are those that fit the loop from the event that entered it to the one that left it; a join bounded in time brings them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.model import STAR, Invariant
from evwarden.operators.cells import CellOptions, assign_cells_with_halo
from evwarden.operators.joins import _at, _bucket, _buckets, _keyed
from evwarden.operators.project import Layout, fits, local_terms


def staged(inv: Invariant) -> bool:
    """Whether every event's effect is known without the match: steps tied by a key, and terms on single events."""
    if inv.all_matches or not inv.key_classes() or len(inv.positive) < 2 or inv.within_us is None:
        return False
    classes = inv.key_classes()
    return all(
        inv.is_key_term(t, i, classes) or any(t is o for o in local_terms(inv, i)) for i in range(1, len(inv.steps)) for t in inv.step_terms[i]
    )


class _Course:
    """States are numbered as the positive steps; ``to`` of a pointer is the state that it leads to, -1 where the match is discarded."""

    def __init__(self, inv: Invariant):
        self.inv, self.pos = inv, inv.positive
        self.last = len(self.pos) - 1
        self.moving = list(range(self.last + (1 if inv.trailing_negation else 0)))

    def targets(self, k: int) -> list[int]:
        out = []
        for t in range(k + 1, len(self.pos)):
            out.append(t)
            if self.inv.steps[self.pos[t]].kind != STAR:
                break
        return out

    def negations(self, k: int) -> list[int]:
        out = self.inv.negations_after(self.pos[k])
        if k < self.last and self.inv.steps[self.pos[k + 1]].kind == STAR:
            out = out + self.inv.negations_after(self.pos[k + 1])
        return out

    def move(self, k: int) -> Column:
        """What the current event does to a match in state ``k``; null if nothing."""
        out = F.when(F.lit(False), F.lit(0))
        if self.inv.steps[self.pos[k]].loop:
            out = out.when(F.col(f"r{self.pos[k]}"), F.lit(None))
        for t in self.targets(k):
            out = out.when(F.col(f"r{self.pos[t]}"), F.lit(t))
        for n in self.negations(k):
            out = out.when(F.col(f"r{n}"), F.lit(-1))
        return out


def staged_matches(events: DataFrame, inv: Invariant, layout: Layout, opts: CellOptions, open_until: Column | None) -> DataFrame:
    """Full and timed-out matches, a row for each start; repeated steps hold arrays of their events."""
    course, pos = _Course(inv), inv.positive
    classes = inv.key_classes()
    ev, keys, known = _keyed(events, layout, classes)
    roles = {i: fits(layout, i) & known if i else fits(layout, i) for i in range(len(inv.steps))}
    ev = ev.select("*", *[c.alias(f"r{i}") for i, c in roles.items()])
    ev = ev.filter(reduce(lambda a, b: a | b, [F.col(f"r{i}") for i in roles]))
    ahead_of, _ = assign_cells_with_halo(ev, keys, inv.within_us, opts)
    ahead = Window.partitionBy(*keys, "cell").orderBy(F.desc("us"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    members = list(layout.columns.values())
    rows = ahead_of
    for k in reversed(course.moving):
        later = [F.col(f"p{t}") for t in course.targets(k) if t in course.moving]
        rows = rows.withColumn("_to", course.move(k))
        slot = F.when(F.col("_to").isNotNull(), F.struct("us", "seq", "type", *members, F.col("_to").alias("to"), *later))
        rows = rows.withColumn(f"p{k}", F.last(slot, ignorenulls=True).over(ahead))
    starts = rows.filter(F.col("r0") & F.col("own"))

    limit = F.col("us") + F.lit(inv.within_us)
    entered = {0: F.lit(True)}
    pointer = {0: F.col("p0")}
    event = {0: F.struct("us", "seq", "type", *members)}
    killed = F.lit(False)

    def taken(k: int, to: int) -> Column:
        p = pointer[k]
        return F.coalesce(entered[k] & p.isNotNull() & (p["us"] < limit) & (p["to"] == to), F.lit(False))

    for k in range(course.last + 1):
        if k:
            came = [j for j in range(k) if j in course.moving and k in course.targets(j)]
            ways = [taken(j, k) for j in came]
            entered[k] = reduce(lambda a, b: a | b, ways)
            event[k] = F.coalesce(*[F.when(w, F.struct(*[pointer[j][f].alias(f) for f in ("us", "seq", "type", *members)])) for j, w in zip(came, ways)])
            if k in course.moving:
                pointer[k] = F.coalesce(*[F.when(w, pointer[j][f"p{k}"]) for j, w in zip(came, ways)])
        # one state's columns at a time, or expressions would hold each other many times over
        starts = starts.withColumns({f"in{k}": entered[k], f"e{k}": event[k], **({f"q{k}": pointer[k]} if k in course.moving else {})})
        entered[k], event[k] = F.col(f"in{k}"), F.col(f"e{k}")
        if k in course.moving:
            pointer[k] = F.col(f"q{k}")
            killed = killed | taken(k, -1)
    complete = entered[course.last]
    if inv.trailing_negation:
        complete = complete & ~killed
    waited = F.lit(True) if inv.trailing_negation else ~complete
    decided = complete | ~killed
    if open_until is not None:
        decided = decided & (~waited | (limit <= open_until))
    mask = reduce(lambda a, b: a + b, [F.when(entered[k], F.lit(1 << pos[k])).otherwise(F.lit(0)) for k in range(course.last + 1)]).cast("bigint")
    end = event[course.last]
    slots = []
    for k, i in enumerate(pos):
        if not inv.steps[i].loop:
            fields = [event[k][f].alias(f) for f in ("us", "seq", "type", *layout.slot_members(i))]
            slots.append(F.when(entered[k], F.struct(*fields)).cast(layout.slot_type(i)).alias(f"s{i}"))
        else:  # from the event that entered to the one that left
            stop = F.when(pointer[k]["us"] < limit, _position(pointer[k]))
            slots += [F.when(entered[k], _position(event[k])).alias(f"from{i}"), F.when(entered[k], _position_of(stop, limit)).alias(f"till{i}")]
    kind = F.when(decided, F.when(complete, F.lit("full")).otherwise(F.lit("timeout")))
    found = starts.select(
        *keys, kind.alias("kind"), F.col("us").alias("start_us"), F.col("seq").alias("start_seq"),
        F.when(waited, limit).otherwise(end["us"]).alias("end_us"), F.when(~waited, end["seq"]).alias("end_seq"), mask.alias("bound"), *slots,
    ).filter(F.col("kind").isNotNull())
    loops = [i for i in pos if inv.steps[i].loop]
    return _with_loops(found, ev, keys, inv, layout, loops) if loops else found.drop(*keys)


def _position(event: Column) -> Column:
    return F.struct(event["us"].alias("us"), event["seq"].alias("seq"))


def _position_of(stop: Column, limit: Column) -> Column:
    return F.coalesce(stop, F.struct(limit.alias("us"), F.lit(-(1 << 63)).cast("bigint").alias("seq")))


def _with_loops(found: DataFrame, ev: DataFrame, keys: list[str], inv: Invariant, layout: Layout, loops: list[int]) -> DataFrame:
    """The events of all loops by one join: those of the match's key in its own stretch of time and the next."""
    whole = F.struct("us", "seq", "type", *layout.columns.values())
    inside = ev.filter(reduce(lambda a, b: a | b, [F.col(f"r{i}") for i in loops]))
    inside = inside.select(*keys, whole.alias("e"), *[F.col(f"r{i}") for i in loops], _bucket(F.col("us"), inv.within_us).alias("bucket"))
    spread = found.select("*", _buckets(F.col("start_us"), inv.within_us).alias("bucket"))
    joined = spread.join(inside, [*keys, "bucket"], "left")
    fixed = [c for c in found.columns if c not in keys]
    held = []
    for i in loops:
        here = F.col(f"r{i}") & (_at("e") >= F.col(f"from{i}")) & (_at("e") < F.col(f"till{i}"))
        event = F.struct(*[F.col("e")[f].alias(f) for f in ("us", "seq", "type", *layout.slot_members(i))]).cast(layout.slot_type(i))
        held.append(F.sort_array(F.collect_list(F.when(here, event))).alias(f"s{i}"))
    out = joined.groupBy(*fixed).agg(*held)
    return out.drop(*[f"{w}{i}" for w in ("from", "till") for i in loops])
