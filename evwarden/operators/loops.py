"""Figures of repeated steps from running counts: a match reads a few positions of its key, never its loop events.

Per key, loop events and the borders of matches are ordered once and counted.  The difference of the counts at two borders is the number of
loop events between, and the counts are also the ranks of the first and the last of them.  Minima and maxima come from sparse tables: level k
of a rank covers ``2 ** k`` events from there on, so any stretch is covered by two entries.  Tables are kept for blocks of ``BLOCK`` ranks, and for
the blocks of a key; a stretch over several blocks takes the rest of the first, the begin of the last, and two entries of blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.model import STAR, Clause, Invariant, InvariantError
from evwarden.operators.cells import CellOptions, assign_cells
from evwarden.operators.joins import _keyed, _without_loop
from evwarden.operators.project import Layout, fits
from evwarden.operators.scan import scan_matches
from evwarden.predicates import Comparison, Predicate, Ref, comparisons
from evwarden.sinks.scratch import stored

#: What can be asked of a repeated step; ``missing`` counts the events without a member.
FIGURES = ("n", "first", "last", "sum", "min", "max", "missing")
BLOCK = 1024
_BEFORE_ALL = -(1 << 63)


def judged_by_extremes(inv: Invariant) -> bool:
    """Whether minima, maxima and counts decide every clause: all comparisons of loop members but ``!=``."""
    return all(c.op != "!=" for c, _ in _judged(inv))


def _judged(inv: Invariant) -> list[tuple]:
    """(comparison, member of a loop) for each loop member that a clause compares."""
    loops = {a for s in inv.steps if s.loop for a in s.aliases}
    clauses: list[Clause | None] = [inv.on_full_match, *inv.on_prefix_match.values()]
    return [
        (c, side) for clause in clauses if isinstance(clause, Predicate) for c in comparisons(clause)
        for side in (c.left, c.right) if isinstance(side, Ref) and side.alias in loops
    ]


def _deciding(c: Comparison, side: Ref) -> tuple[str, ...]:
    """Which extremes of a loop member decide a comparison."""
    if c.op == "=":
        return ("min", "max")
    return ("max",) if (side is c.left) == (c.op in ("<", "<=")) else ("min",)


def figure_matches(
    events: DataFrame, inv: Invariant, layout: Layout, opts: CellOptions, open_until: Column | None, figures: Sequence[str], block: int | None = None
) -> DataFrame:
    """Matches of ``start, loop, end`` as :func:`evwarden.operators.joins.loop_matches` finds them, with ``f_<alias>`` for each loop alias.

    That is a struct of the ``figures`` asked for: ``n``; ``first`` and ``last`` (``ts``, ``seq`` and members); ``sum``, ``min``, ``max`` and
    ``missing`` (a field for each member). What clauses compare is added. Without loop events ``n`` is 0 and the rest null.
    """
    unknown = set(figures) - set(FIGURES)
    if unknown:
        raise InvariantError(f"unknown figures {sorted(unknown)}")
    plain = _without_loop(inv)
    star = inv.steps[1].kind == STAR
    matches = scan_matches(events, plain, Layout(plain, layout.columns), opts, open_until)
    if star:
        matches = matches.withColumnRenamed("s1", "s2").withColumn("bound", F.when(F.col("s2").isNotNull(), 5).otherwise(1).cast("bigint"))
    else:
        matches = matches.drop("s1")
    classes = inv.key_classes()
    ev, keys, known = _keyed(events, layout, classes)
    own = [F.col("s0")[layout.of(c[0])].alias(k) for k, c in zip(keys, classes)]
    limit = F.lit(None).cast("bigint") if inv.within_us is None else F.col("start_us") + F.lit(inv.within_us)
    full = F.col("s2").isNotNull()
    matches = matches.select(
        *own, "*", F.when(full, F.col("s2")["us"]).otherwise(limit).alias("stop_us"),
        F.when(full, F.col("s2")["seq"]).otherwise(F.lit(_BEFORE_ALL)).alias("stop_seq"),
    )
    matches = stored(matches, "loop-ends")
    loops = [_Loop(inv, layout, a, figures) for a in inv.steps[1].aliases]
    ranked = _ranked(ev.filter(fits(layout, 1) & known), matches, keys, loops, opts)
    out = _with_counts(matches, ranked, keys, loops)
    for loop in loops:
        out = loop.with_lookups(out, ranked, keys, BLOCK if block is None else block)
    held = reduce(lambda a, b: a + b, [F.col(loop.n) for loop in loops])
    mask = F.when(held > 0, F.col("bound").bitwiseOR(F.lit(2).cast("bigint"))).otherwise(F.col("bound"))
    fixed = ["kind", "start_us", "start_seq", "end_us", "end_seq"]
    return out.select(*fixed, mask.alias("bound"), "s0", "s2", *[loop.struct().alias(f"f_{loop.alias}") for loop in loops])


def _ranked(inside: DataFrame, matches: DataFrame, keys: list[str], loops: list[_Loop], opts: CellOptions) -> DataFrame:
    """Loop events (``side`` 0) and borders of matches (1 begin, -1 end) in order, with the running counts of each alias."""
    members = [c for c in inside.columns if c not in (*keys, "us", "seq", "type")]
    nothing = [F.lit(None).cast(inside.schema[m].dataType).alias(m) for m in members]

    def border(us: str, seq: str, side: int) -> DataFrame:
        marks = matches.select(*keys, F.col(us).alias("us"), F.col(seq).alias("seq")).dropna("any", subset=[*keys, "us"]).distinct()
        return marks.select(*keys, "us", "seq", F.lit(None).cast("string").alias("type"), *nothing, F.lit(side).alias("side"))

    rows = inside.select(*keys, "us", "seq", "type", *members, F.lit(0).alias("side"))
    rows = rows.unionByName(border("start_us", "start_seq", 1)).unionByName(border("stop_us", "stop_seq", -1))
    rows, split = assign_cells(rows, keys, opts)
    counted = [c for loop in loops for c in loop.counted()]
    so_far = Window.partitionBy(*keys, "cell").orderBy("us", "seq", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.select("*", *[F.sum(c).over(so_far).alias(n) for n, c in counted])
    if split:
        earlier = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = rows.groupBy(*keys, "cell").agg(*[F.sum(c).alias(n) for n, c in counted])
        cells = cells.select(*keys, "cell", *[F.sum(n).over(earlier).alias(f"before_{n}") for n, _ in counted])
        here = here.join(cells, [*keys, "cell"])
        here = here.withColumns({n: F.col(n) + F.coalesce(f"before_{n}", F.lit(0)) for n, _ in counted}).drop(*[f"before_{n}" for n, _ in counted])
    return stored(here.drop("cell"), "loop-ranks")


def _with_counts(matches: DataFrame, ranked: DataFrame, keys: list[str], loops: list[_Loop]) -> DataFrame:
    """``matches`` with the counts at their borders (``a_…``, ``z_…``) and the number of loop events of each alias."""
    # looked up by merging here and below: files of ranks are small, but as a table in memory many times their size
    names = [n for loop in loops for n, _ in loop.counted()]
    for prefix, side, us, seq in (("a", 1, "start_us", "start_seq"), ("z", -1, "stop_us", "stop_seq")):
        at = ranked.where(F.col("side") == side).select(
            *keys, F.col("us").alias(us), F.col("seq").alias(seq), *[F.col(n).alias(f"{prefix}_{n}") for n in names]
        )
        matches = matches.join(at.hint("merge"), [*keys, us, seq], "left")
    zero = F.lit(0)
    counts = {loop.n: F.coalesce(F.col(f"z_{loop.n}") - F.col(f"a_{loop.n}"), zero).cast("bigint") for loop in loops}
    return matches.withColumns(counts)


class _Loop:
    """What one alias of a repeated step needs."""

    def __init__(self, inv: Invariant, layout: Layout, alias: str, figures: Sequence[str]):
        self.alias, self.type, self.n = alias, inv.aliases[alias].type, f"n_{alias}"
        self.members = {path: layout.columns[(path, kind)] for path, kind in inv.aliases[alias].schema.items()}
        self.numbers = [p for p, kind in inv.aliases[alias].schema.items() if kind == "number"]
        wanted = {r.path for _, r in _judged(inv) if r.alias == alias}
        self.figures = {"n", *figures} | ({"missing"} if wanted else set())
        self.extremes = sorted(set(self.members) if {"min", "max"} & self.figures else wanted)
        self.added = [p for p in self.numbers if "sum" in self.figures]
        self.missing = sorted(set(self.members) if "missing" in figures else wanted)
        if {"min", "max"} & self.figures:
            self.sides = {p: ["min", "max"] for p in self.extremes}
        else:
            self.sides = {p: [s for s in ("min", "max") if any(r.alias == alias and r.path == p and s in _deciding(c, r) for c, r in _judged(inv))] for p in self.extremes}

    def _is(self) -> Column:
        return (F.col("side") == 0) & (F.col("type") == self.type)

    def _name(self, figure: str, path: str) -> str:
        return f"{figure}_{self.alias}_{self.members[path]}"

    def counted(self) -> list[tuple[str, Column]]:
        """The running sums kept: number of events, of missing members, and totals."""
        out = [(self.n, F.when(self._is(), 1).otherwise(0).cast("bigint"))]
        out += [(self._name("missing", p), F.when(self._is() & F.col(self.members[p]).isNull(), 1).otherwise(0).cast("bigint")) for p in self.missing]
        return out + [(self._name("sum", p), F.when(self._is(), F.coalesce(self.members[p], F.lit(0.0))).otherwise(0.0)) for p in self.added]

    def with_lookups(self, out: DataFrame, ranked: DataFrame, keys: list[str], block: int) -> DataFrame:
        """Adds the entries at the first and last rank of each match, and the extremes between."""
        ends = {"first", "last"} & self.figures
        if not ends and not self.extremes:
            return out
        begin, end, n = F.col(f"a_{self.n}") + 1, F.col(f"z_{self.n}"), F.col(self.n)
        rank = F.col(self.n)
        events = ranked.where(self._is()).withColumn("block", F.floor((rank - 1) / block))
        event = F.struct(F.timestamp_micros("us").alias("ts"), "seq", *[F.col(m).alias(p) for p, m in self.members.items()]).alias("event")
        longest = (out.agg(F.max(n)).first()[0] or 0) if self.extremes else 0
        sides = {"min": (F.min, F.least), "max": (F.max, F.greatest)}
        inside = Window.partitionBy(*keys, "block").orderBy(self.n)
        begun = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        back = Window.partitionBy(*keys, "block").orderBy(F.desc(self.n)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # what is read at each place, no more: every join carries it
        columns = [event] if ends else []
        read: dict[str, list[str]] = {"head": ["event"] if "first" in ends else [], "tail": ["event"] if "last" in ends else [], "cover": []}
        for p in self.extremes:
            for side in self.sides[p]:
                over, both = sides[side]
                name = self._name(side, p)
                events = events.withColumn(f"{name}_0", F.col(self.members[p]))
                levels = _levels(min(longest, block))
                for k in range(1, levels):
                    ahead = F.lead(f"{name}_{k - 1}", 1 << (k - 1)).over(inside)
                    events = events.withColumn(f"{name}_{k}", both(F.col(f"{name}_{k - 1}"), ahead))
                events = events.withColumns({f"{name}_begun": over(self.members[p]).over(begun), f"{name}_rest": over(self.members[p]).over(back)})
                table = F.array(*[F.col(f"{name}_{k}") for k in range(levels)]).alias(f"{name}_table")
                columns += [table, F.col(f"{name}_begun"), F.col(f"{name}_rest")]
                read["head"] += [f"{name}_table", f"{name}_rest"]
                read["tail"].append(f"{name}_begun")
                read["cover"].append(f"{name}_table")
        events = events.select(*keys, rank.alias("rank"), *columns)
        events = stored(events, "loop-events") if self.extremes else events
        k = F.length(F.bin(F.greatest(n, F.lit(1)))) - 1
        step = F.pow(F.lit(2), k).cast("bigint")
        some = n > 0
        one_block = F.floor((begin - 1) / block) == F.floor((end - 1) / block)
        places = {"head": F.when(some, begin), "tail": F.when(some, end)}
        if self.extremes:
            places["cover"] = F.when(some & one_block, end - step + 1)
        for place, at in places.items():
            if not read[place]:
                continue
            found = events.select(*keys, F.col("rank").alias("_rank"), F.struct(*read[place]).alias(f"{place}_{self.alias}"))
            out = out.withColumn("_rank", at).join(found.hint("merge"), [*keys, "_rank"], "left").drop("_rank")
        if not self.extremes:
            return out
        out = self._with_blocks(out, ranked.where(self._is()), keys, block, longest)
        head, tail, cover = (F.col(f"{p}_{self.alias}") for p in ("head", "tail", "cover"))
        for p in self.extremes:
            for side in self.sides[p]:
                _, both = sides[side]
                name = self._name(side, p)
                level = F.least(k, F.lit(_levels(min(longest, block)) - 1))
                within = both(F.get(head[f"{name}_table"], level), F.get(cover[f"{name}_table"], level))
                across = both(head[f"{name}_rest"], tail[f"{name}_begun"], F.col(f"{name}_blocks"))
                out = out.withColumn(name, F.when(one_block, within).otherwise(across))
        return out

    def _with_blocks(self, out: DataFrame, events: DataFrame, keys: list[str], block: int, longest: int) -> DataFrame:
        """Adds the extremes of the whole blocks between the first and the last of each match."""
        names = [(side, p, self._name(side, p)) for p in self.extremes for side in self.sides[p]]
        kinds = {p: events.schema[self.members[p]].dataType for p in self.extremes}
        if longest < block + 2:  # no whole block fits between two others
            return out.withColumns({f"{name}_blocks": F.lit(None).cast(kinds[p]) for _, p, name in names})
        blocks = events.withColumn("block", F.floor((F.col(self.n) - 1) / block)).groupBy(*keys, "block").agg(
            *[(F.min if side == "min" else F.max)(self.members[p]).alias(f"{name}_0") for side, p, name in names]
        )
        order, levels = Window.partitionBy(*keys).orderBy("block"), _levels(longest // block + 1)
        for side, _, name in names:
            for k in range(1, levels):
                both = F.least if side == "min" else F.greatest
                blocks = blocks.withColumn(f"{name}_{k}", both(F.col(f"{name}_{k - 1}"), F.lead(f"{name}_{k - 1}", 1 << (k - 1)).over(order)))
        tables = [F.array(*[F.col(f"{name}_{k}") for k in range(levels)]).alias(name) for _, _, name in names]
        blocks = blocks.select(*keys, F.col("block").alias("_block"), F.struct(*tables).alias("_entry"))
        first = F.floor((F.col(f"a_{self.n}")) / block) + 1
        count = F.floor((F.col(f"z_{self.n}") - 1) / block) - first
        out = out.withColumn("_count", F.when(F.col(self.n) > 0, count)).withColumn("_k", F.length(F.bin(F.greatest("_count", F.lit(1)))) - 1)
        for side, at in (("l", first), ("r", first + F.col("_count") - F.pow(F.lit(2), F.col("_k")).cast("bigint"))):
            out = out.withColumn("_block", F.when(F.col("_count") > 0, at)).join(blocks.hint("merge"), [*keys, "_block"], "left")
            out = out.withColumnRenamed("_entry", f"_{side}").drop("_block")
        for side, _, name in names:
            both = F.least if side == "min" else F.greatest
            out = out.withColumn(f"{name}_blocks", both(F.get(F.col("_l")[name], F.col("_k")), F.get(F.col("_r")[name], F.col("_k"))))
        return out.drop("_l", "_r", "_count", "_k")

    def struct(self) -> Column:
        some = F.col(self.n) > 0
        fields = [F.col(self.n).cast("int").alias("n")]
        for figure, place in (("first", "head"), ("last", "tail")):
            if figure in self.figures:
                fields.append(F.col(f"{place}_{self.alias}")["event"].alias(figure))
        for figure, paths in (("sum", self.added), ("missing", self.missing)):
            if paths:
                total = [F.when(some, F.col(f"z_{self._name(figure, p)}") - F.col(f"a_{self._name(figure, p)}")).alias(p) for p in paths]
                fields.append(F.struct(*total).alias(figure))
        for figure in ("min", "max"):
            paths = [p for p in self.extremes if figure in self.sides[p]]
            if paths:
                fields.append(F.struct(*[F.when(some, F.col(self._name(figure, p))).alias(p) for p in paths]).alias(figure))
        return F.struct(*fields)


def _levels(n: int) -> int:
    """Levels of a sparse table that cover stretches of up to ``n``."""
    return max(n, 1).bit_length()
