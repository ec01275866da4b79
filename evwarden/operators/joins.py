"""Matching by joins bounded in time: predicates between two events, all later matches, repeated steps.

A start joins the events of its key in its own bucket of time and the next one;
buckets are as wide as the limit, so these hold every event the start may need.
Of the candidates only the earliest of each kind is kept, by a grouped minimum.
Busy keys are spread over their buckets, and Spark divides what is left at run time.

An event is told from others by its time, ``seq`` and members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwarden.model import STAR, Invariant, InvariantError, Step
from evwarden.operators.cells import CellOptions
from evwarden.operators.project import Layout, _literal, fits, key_columns, local_terms, project_events
from evwarden.operators.scan import scan_matches, scannable
from evwarden.predicates import Literal, Predicate, compare, to_column


def pairable(inv: Invariant) -> bool:
    """Two steps that bind one event each, negations only between them, and something that bounds the candidates."""
    if len(inv.positive) != 2 or any(s.loop for s in inv.steps) or inv.trailing_negation:
        return False
    if inv.all_matches and len(inv.steps) > 2:
        return False
    return bool(inv.within_us is not None or inv.key_classes())


def loopable(inv: Invariant) -> bool:
    """Three steps tied by a key, the middle one repeated, of which the scan can find the ends."""
    return _without_loop(inv) is not None


def tailable(inv: Invariant) -> bool:
    """Steps that are told from the rest by their own events alone, and a last one with any predicates."""
    return _without_last(inv) is not None


def _keyed(events: DataFrame, layout: Layout, classes: list) -> tuple[DataFrame, list[str], Column]:
    keys = [f"k{n}" for n in range(len(classes))]
    ev = project_events(events, layout)
    ev = ev.select("*", *[c.alias(k) for k, c in zip(keys, key_columns(layout, classes))])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return ev, keys, known


def _bucket(us: Column, within_us: int | None) -> Column:
    return F.lit(0).cast("bigint") if within_us is None else F.floor(us / F.lit(within_us)).cast("bigint")


def _buckets(us: Column, within_us: int | None) -> Column:
    here = _bucket(us, within_us)
    return F.explode(F.array(here) if within_us is None else F.array(here, here + 1))


def _between(term: Predicate, inv: Invariant, layout: Layout) -> Column:
    """A term on the start (``a``) and a candidate (``e``)."""

    def side(s):
        if isinstance(s, Literal):
            return F.lit(_literal(s))
        return F.col("a" if inv.step_of[s.alias] == 0 else "e").getField(layout.of(s))

    return to_column(term, lambda c: compare(c.op, side(c.left), side(c.right)))


def _at(slot: str) -> Column:
    return F.struct(F.col(slot)["us"], F.col(slot)["seq"])


def pair_matches(events: DataFrame, inv: Invariant, layout: Layout, open_until: Column | None) -> DataFrame:
    """Full and timed-out matches of a two-step invariant; each start with its first fitting event, or with all of them."""
    classes = inv.key_classes()
    ev, keys, known = _keyed(events, layout, classes)
    first, last = inv.positive
    whole = F.struct("us", "seq", "type", *layout.columns.values())
    roles = {i: fits(layout, i) & known for i in range(1, len(inv.steps))}
    starts = ev.filter(fits(layout, 0)).select(*keys, whole.alias("a"))
    wanted = roles[last]
    for role in roles.values():
        wanted = wanted | role
    later = ev.filter(wanted).select(
        *keys, whole.alias("e"), *[role.alias(f"r{i}") for i, role in roles.items()], _bucket(F.col("us"), inv.within_us).alias("bucket")
    )

    def binds(i: int) -> Column:
        found = F.col(f"r{i}")
        locals_ = local_terms(inv, i)
        for term in inv.step_terms[i]:
            if not any(term is t for t in locals_):
                found = found & _between(term, inv, layout)
        return found

    timely = _at("e") > _at("a")
    limit = None if inv.within_us is None else F.col("a")["us"] + F.lit(inv.within_us)
    if limit is not None:
        timely = timely & (F.col("e")["us"] < limit)
    spread = starts.select("*", _buckets(F.col("a")["us"], inv.within_us).alias("bucket"))
    on = [*keys, "bucket"]
    if inv.all_matches:
        every = spread.join(later, on).filter(timely & binds(last)).select("a", F.col("e").alias("b"))
        alone = starts.select("a").join(every.select("a").distinct(), "a", "left_anti").select("a", F.lit(None).alias("b"))
        met = every.unionByName(alone).withColumn("killed", F.lit(False))
    else:
        negated = [i for i in roles if i != last]
        kills = F.lit(False)
        for i in negated:
            kills = kills | binds(i)
        joined = spread.join(later, on, "left")
        met = joined.groupBy("a").agg(
            F.min(F.when(timely & binds(last), F.col("e"))).alias("b"), F.min(F.when(timely & kills, _at("e"))).alias("n")
        )
        met = met.withColumn("killed", F.col("n").isNotNull() & (F.col("b").isNull() | (F.col("n") < _at("b"))))
    full = F.col("b").isNotNull()
    waited = F.lit(limit is not None)
    if limit is not None and open_until is not None:
        waited = limit <= open_until
    kind = F.when(F.col("killed"), None).when(full, "full").when(waited, "timeout")
    return met.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "kind", F.col("a")["us"].alias("start_us"), F.col("a")["seq"].alias("start_seq"),
        F.when(full, F.col("b")["us"]).otherwise(F.lit(None) if limit is None else limit).alias("end_us"),
        F.col("b")["seq"].alias("end_seq"),
        F.when(full, F.lit((1 << first) | (1 << last))).otherwise(F.lit(1 << first)).cast("bigint").alias("bound"),
        _slot("a", layout, first), _slot("b", layout, last),
    )


def _slot(source: str, layout: Layout, i: int) -> Column:
    fields = [F.col(source)[f].alias(f) for f in ("us", "seq", "type", *layout.slot_members(i))]
    return F.when(F.col(source).isNotNull(), F.struct(*fields)).cast(layout.slot_type(i)).alias(f"s{i}")


def _without_loop(inv: Invariant) -> Invariant | None:
    """The invariant whose scan finds where the loop begins and ends: ``+`` as a single step, ``*`` left out."""
    if len(inv.steps) != 3 or len(inv.positive) != 3 or not inv.steps[1].loop or inv.all_matches:
        return None
    if set(inv.step_types(1)) & set(inv.step_types(2)) or not inv.key_classes():
        return None
    loop = inv.steps[1]
    star = loop.kind == STAR
    middle = [] if star else [Step(*loop.aliases)]
    # terms of a loop that is left out apply to its events alone
    local = local_terms(inv, 1)
    if any(not any(t is o for o in local) and not inv.is_key_term(t, 1, inv.key_classes()) for t in inv.step_terms[1]):
        return None
    where = [t for t in inv.terms if not (star and any(t is o for o in inv.step_terms[1]))]
    try:
        plain = Invariant(inv.name, inv.aliases, [inv.steps[0], *middle, inv.steps[2]], inv.within, where, where_eval="eager")
    except InvariantError:
        return None
    same = [inv.step_terms[0], *([] if star else [inv.step_terms[1]]), inv.step_terms[2]]
    placed = [[id(t) for t in ts] for ts in plain.step_terms] == [[id(t) for t in ts] for ts in same]
    return plain if placed and scannable(plain) and len(plain.key_classes()) == len(inv.key_classes()) else None


def loop_matches(events: DataFrame, inv: Invariant, layout: Layout, opts: CellOptions, open_until: Column | None) -> DataFrame:
    """Matches of ``start, loop, end``: the scan finds first event and end of the loop, a join brings its events."""
    plain = _without_loop(inv)
    star = inv.steps[1].kind == STAR
    ends = scan_matches(events, plain, Layout(plain, layout.columns), opts, open_until)
    if star:
        ends = ends.withColumnRenamed("s1", "s2").withColumn("s1", F.lit(None)).withColumn(
            "bound", F.when(F.col("s2").isNotNull(), 5).otherwise(1).cast("bigint")
        )
    classes = inv.key_classes()
    ev, keys, known = _keyed(events, layout, classes)
    members = F.struct("us", "seq", "type", *layout.slot_members(1)).cast(layout.slot_type(1))
    inside = ev.filter(fits(layout, 1) & known).select(*keys, members.alias("e"), _bucket(F.col("us"), inv.within_us).alias("bucket"))
    own = [F.col("s0")[layout.of(c[0])].alias(k) for k, c in zip(keys, classes)]
    spread = ends.select(*own, "*", _buckets(F.col("start_us"), inv.within_us).alias("bucket"))
    after = _at("e") > F.struct("start_us", "start_seq")
    before = F.when(F.col("s2").isNotNull(), _at("e") < _at("s2"))
    if inv.within_us is not None:
        before = before.otherwise(F.col("e")["us"] < F.col("start_us") + F.lit(inv.within_us))
    joined = spread.join(inside, [*keys, "bucket"], "left")
    fixed = ["kind", "start_us", "start_seq", "end_us", "end_seq", "bound", "s0", "s2"]
    held = F.sort_array(F.collect_list(F.when(after & before, F.col("e")))).alias("s1")
    out = joined.groupBy(*fixed).agg(held)
    mask = F.when(F.size("s1") > 0, F.col("bound").bitwiseOR(F.lit(2).cast("bigint"))).otherwise(F.col("bound"))
    return out.withColumn("bound", mask)


def _without_last(inv: Invariant) -> Invariant | None:
    """The invariant of all steps but the last, if a scan can answer it."""
    if len(inv.steps) < 3 or len(inv.positive) < len(inv.steps) or inv.all_matches or inv.within_us is None:
        return None
    if any(s.loop for s in inv.steps) or not _tail_keys(inv):
        return None
    where = [t for terms in inv.step_terms[:-1] for t in terms]
    try:
        head = Invariant(inv.name, inv.aliases, inv.steps[:-1], inv.within, where, where_eval="eager")
    except InvariantError:
        return None
    placed = [{id(t) for t in ts} for ts in head.step_terms] == [{id(t) for t in ts} for ts in inv.step_terms[:-1]]
    return head if placed and scannable(head) else None


def _tail_keys(inv: Invariant) -> list[tuple]:
    """(member of the last step, earlier member) of the equalities that tie the last step to others."""
    return [pair for t in inv.step_terms[-1] if (pair := inv._equality(t, len(inv.steps) - 1)) is not None]


def tail_matches(events: DataFrame, inv: Invariant, layout: Layout, opts: CellOptions, open_until: Column | None) -> DataFrame:
    """Matches whose last step alone is tied to others: a scan of the steps before it, then a join for the first event that fits."""
    head, last = _without_last(inv), len(inv.steps) - 1
    ties = _tail_keys(inv)
    keys = [f"k{n}" for n in range(len(ties))]
    found = scan_matches(events, head, Layout(head, layout.columns), opts, None)
    slots = [f"s{i}" for i in range(last)]
    whole = F.struct("us", "seq", "type", *layout.slot_members(last)).cast(layout.slot_type(last))
    later = project_events(events, layout).filter(fits(layout, last)).select(
        *[F.col(layout.of(here)).alias(k) for k, (here, _) in zip(keys, ties)], whole.alias("e"), _bucket(F.col("us"), inv.within_us).alias("bucket")
    )
    own = [F.when(F.col("kind") == "full", F.col(f"s{inv.step_of[there.alias]}")[layout.of(there)]).alias(k) for k, (_, there) in zip(keys, ties)]
    spread = found.select(*own, "*", _buckets(F.col("start_us"), inv.within_us).alias("bucket"))

    def side(s):
        if isinstance(s, Literal):
            return F.lit(_literal(s))
        step = inv.step_of[s.alias]
        return F.col("e" if step == last else f"s{step}").getField(layout.of(s))

    local = local_terms(inv, last)
    fit = (_at("e") > _at(f"s{last - 1}")) & (F.col("e")["us"] < F.col("start_us") + F.lit(inv.within_us))
    for term in inv.step_terms[last]:
        if not any(term is t for t in local):
            fit = fit & to_column(term, lambda c: compare(c.op, side(c.left), side(c.right)))
    fixed = ["start_us", "start_seq", "bound", *slots]
    met = spread.join(later, [*keys, "bucket"], "left").groupBy(*fixed).agg(F.min(F.when(fit, F.col("e"))).alias(f"s{last}"))
    end, full = F.col(f"s{last}"), F.col(f"s{last}").isNotNull()
    limit = F.col("start_us") + F.lit(inv.within_us)
    out = met.select(
        F.when(full, "full").otherwise("timeout").alias("kind"), "start_us", "start_seq", F.when(full, end["us"]).otherwise(limit).alias("end_us"),
        end["seq"].alias("end_seq"), F.when(full, F.col("bound").bitwiseOR(F.lit(1 << last).cast("bigint"))).otherwise(F.col("bound")).alias("bound"),
        *slots, f"s{last}",
    )
    return out if open_until is None else out.filter((F.col("kind") == "full") | (F.col("end_us") <= open_until))
