"""The first later event by a value: ``b.price > a.price`` without joining a start with its candidates.

Events of a key are read once in order.  Starts wait in a heap by the value that they want exceeded; an event takes from it all
that it satisfies, so every start leaves the heap once and the work is linear but for the heap's logarithm.  Hot keys are cut into
cells; what still waits at the end of a cell goes on in the first later cell whose extreme satisfies it.
"""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evwarden.model import Invariant
from evwarden.operators.cells import CellOptions, assign_cells
from evwarden.operators.joins import _keyed, _slot
from evwarden.operators.project import Layout, _literal, fits, local_terms
from evwarden.predicates import Comparison, Literal, Predicate, Ref, compare, to_column
from evwarden.sinks.scratch import stored

#: Alternatives of one condition that are searched for side by side.
_SEARCHES = 8
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass
class Search:
    """The first event of ``step`` after a start for which all comparisons hold; at most one of them reads both."""

    step: int
    of_start: list[Comparison]
    of_event: list[Comparison]
    theta: tuple[Ref, str, Ref] | None  # event member, operator, start member


def searches(inv: Invariant) -> list[Search] | None:
    """The searches that answer a two-step invariant, or None if they cannot."""
    if len(inv.positive) != 2 or any(s.loop for s in inv.steps) or inv.trailing_negation or inv.all_matches or not inv.key_classes():
        return None
    out = []
    for i in range(1, len(inv.steps)):
        local = local_terms(inv, i)
        rest = [t for t in inv.step_terms[i] if not any(t is o for o in local) and not inv.is_key_term(t, i, inv.key_classes())]
        ways = [list(w) for w in product(*[_ways(t) for t in rest])] if rest else [[]]
        for way in ways:
            search = _search(inv, i, [c for part in way for c in part])
            if search is None:
                return None
            out.append(search)
    return out if len(out) <= _SEARCHES else None


def _ways(term: Predicate) -> list[list[Comparison]]:
    """The conjunctions of which one must hold."""
    if isinstance(term, Comparison):
        return [[term]]
    parts = [_ways(p) for p in term.parts]
    if term.op == "or":
        return [w for p in parts for w in p]
    return [[c for w in chosen for c in w] for chosen in product(*parts)]


def _search(inv: Invariant, i: int, way: list[Comparison]) -> Search | None:
    out = Search(i, [], [], None)
    for c in way:
        steps = {inv.step_of[s.alias] for s in (c.left, c.right) if isinstance(s, Ref)}
        if steps <= {i}:
            out.of_event.append(c)
        elif steps == {0}:
            out.of_start.append(c)
        elif steps == {0, i} and out.theta is None and c.op in _FLIPPED:
            here = inv.step_of[c.left.alias] == i
            out.theta = (c.left, c.op, c.right) if here else (c.right, _FLIPPED[c.op], c.left)
        else:
            return None
    return out


def nearest_matches(events: DataFrame, inv: Invariant, layout: Layout, opts: CellOptions, open_until: Column | None) -> DataFrame:
    """Full and timed-out matches of a two-step invariant, as :func:`evwarden.operators.joins.pair_matches` finds them."""
    wanted = searches(inv)
    classes = inv.key_classes()
    ev, keys, known = _keyed(events, layout, classes)
    limit = inv.within_us
    last = inv.positive[-1]

    def here(comparisons: list[Comparison]) -> Column:
        out = F.lit(True)
        for c in comparisons:
            side = lambda s: F.lit(_literal(s)) if isinstance(s, Literal) else F.col(layout.of(s))
            out = out & to_column(c, lambda x: compare(x.op, side(x.left), side(x.right)))
        return out

    columns = []
    for j, s in enumerate(wanted):
        x = F.col(layout.of(s.theta[2])) if s.theta else F.lit(0.0)
        v = F.col(layout.of(s.theta[0])) if s.theta else F.lit(1.0)
        columns.append(F.when(F.col("starts") & known & here(s.of_start), x).cast("double").alias(f"x{j}"))
        columns.append(F.when(known & fits(layout, s.step) & here(s.of_event), v).cast("double").alias(f"v{j}"))
    rows = ev.withColumn("starts", fits(layout, 0)).select("*", *columns)
    taken = F.col("starts")
    for j in range(len(wanted)):
        taken = taken | F.col(f"v{j}").isNotNull()
    rows, split = assign_cells(rows.filter(taken), keys, opts)
    rows = stored(rows, "nearest") if split else rows
    ops = [s.theta[1] if s.theta else ">" for s in wanted]
    found = _sweep(rows, keys, ops, limit)
    if split:
        found = _over_cells(found, rows, keys, ops, limit)

    def first(steps: list[int]) -> Column:
        picked = [F.col(f"f{j}") for j, s in enumerate(wanted) if s.step in steps]
        return picked[0] if len(picked) == 1 else F.least(*picked)

    b, n = first([last]), first([s.step for s in wanted if s.step != last]) if len(inv.steps) > 2 else None
    met = found.select("a", b.alias("b"), (F.lit(None) if n is None else F.struct(n["us"], n["seq"])).alias("n"))
    at = F.struct(F.col("b")["us"], F.col("b")["seq"])
    killed = F.lit(False) if n is None else F.coalesce(F.col("n")["us"].isNotNull() & (F.col("b").isNull() | (F.col("n") < at)), F.lit(False))
    end = None if limit is None else F.col("a")["us"] + F.lit(limit)
    full = F.col("b").isNotNull()
    waited = F.lit(end is not None) if end is None or open_until is None else end <= open_until
    kind = F.when(killed, None).when(full, "full").when(waited, "timeout")
    return met.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        "kind", F.col("a")["us"].alias("start_us"), F.col("a")["seq"].alias("start_seq"),
        F.when(full, F.col("b")["us"]).otherwise(F.lit(None) if end is None else end).alias("end_us"), F.col("b")["seq"].alias("end_seq"),
        F.when(full, F.lit(1 | (1 << last))).otherwise(F.lit(1)).cast("bigint").alias("bound"), _slot("a", layout, 0), _slot("b", layout, last),
    )


def _sweep(rows: DataFrame, keys: list[str], ops: list[str], limit: int | None) -> DataFrame:
    """(keys, cell, a, x…, f…, o…) for each start: its event ``a``, the events found, and whether a search is still open at the end of the cell."""
    n = len(ops)
    payload = [c for c in rows.columns if c not in (*keys, "cell", "starts", *[f"{k}{j}" for k in "xv" for j in range(n)])]
    event = F.struct(*payload)  # us and seq come first, so the order of events is that of the structs
    kind = rows.select(event.alias("e")).schema["e"].dataType.simpleString()
    tied = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{tied}, cell bigint, a {kind}, " + ", ".join(f"x{j} double, f{j} {kind}, o{j} boolean" for j in range(n))
    dealt = rows.select(*keys, "cell", "starts", *[f"{k}{j}" for j in range(n) for k in "xv"], "us", "seq", event.alias("e"))
    dealt = dealt.repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", "us", "seq")
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, out = None, []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*columns):
                group = row[: len(keys) + 1]
                if state is None or state.group != group:
                    if state is not None:
                        out += state.close()
                    state = _Waiting(group, ops, limit)
                out += state.read(row[len(keys) + 1 :])
            if len(out) >= 4096:
                yield _batch(out, arrow)
                out = []
        if state is not None:
            out += state.close()
        if out:
            yield _batch(out, arrow)

    return dealt.mapInArrow(run, schema)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)


class _Waiting:
    """The starts of one key (or cell of it) that still search, in the order of events."""

    def __init__(self, group: tuple, ops: list[str], limit: int | None):
        self.group, self.limit = group, limit
        self.down = [op in ("<", "<=") for op in ops]
        self.equal = [op in ("<=", ">=") for op in ops]
        self.heaps: list[list] = [[] for _ in ops]
        self.open: deque = deque()  # starts in order
        self.late: list[_Start] = []  # starts at the current position
        self.at: tuple | None = None
        self.count = 0

    def read(self, row: tuple) -> list[tuple]:
        starts, values, (us, seq, event) = row[0], row[1:-3], row[-3:]
        if self.at != (us, seq):
            for start in self.late:
                self._wait(start)
            self.late, self.at = [], (us, seq)
        out = []
        while self.limit is not None and self.open and self.open[0].us + self.limit <= us:
            out.append(self._row(self.open.popleft(), False))
        for j, heap in enumerate(self.heaps):
            v = values[2 * j + 1]
            if v is not None and heap:
                v = _rank(v, self.down[j])
                while heap and (heap[0][0] < v or self.equal[j] and heap[0][0] == v):
                    start = heapq.heappop(heap)[2]
                    if start.waits:
                        start.found[j] = event
        if starts:
            self.late.append(_Start(us, event, values[0::2]))
        return out

    def _wait(self, start: _Start) -> None:
        self.open.append(start)
        self.count += 1
        for j, x in enumerate(start.wants):
            if x is not None:
                heapq.heappush(self.heaps[j], (_rank(x, self.down[j]), self.count, start))
        if self.count % 65_536 == 0:  # starts whose time is over leave the heaps
            self.heaps = [[h for h in heap if h[2].waits] for heap in self.heaps]
            for heap in self.heaps:
                heapq.heapify(heap)

    def _row(self, start: _Start, going_on: bool) -> tuple:
        start.waits = False
        out = [*self.group, start.event]
        for x, found in zip(start.wants, start.found):
            out += [x, found, going_on and x is not None and found is None]
        return tuple(out)

    def close(self) -> list[tuple]:
        return [self._row(start, True) for start in [*self.open, *self.late]]


class _Start:
    __slots__ = ("us", "event", "wants", "found", "waits")

    def __init__(self, us: int, event: dict, wants: tuple):
        self.us, self.event, self.wants, self.found, self.waits = us, event, wants, [None] * len(wants), True


def _rank(x: float, down: bool) -> tuple:
    """Numbers in Spark's order, NaN above all; reversed for ``down``."""
    if x != x:
        return (-1, 0.0) if down else (1, 0.0)
    return (0, -x if down else x)


def _over_cells(found: DataFrame, rows: DataFrame, keys: list[str], ops: list[str], limit: int | None) -> DataFrame:
    """Searches open at the end of their cell go on in the first later cell that satisfies them."""
    n = len(ops)
    found = stored(found.withColumn("start", F.monotonically_increasing_id()), "starts")
    cells = rows.groupBy(*keys, "cell").agg(F.min("us").alias("begin"), *[(F.min if op in ("<", "<=") else F.max)(f"v{j}").alias(f"top{j}") for j, op in enumerate(ops)])
    cells = cells.select(*keys, F.col("cell").alias("later"), "begin", *[f"top{j}" for j in range(n)])
    going = None
    for j in range(n):
        fits_in = compare(ops[j], F.col(f"top{j}"), F.col(f"x{j}"))
        timely = F.lit(True) if limit is None else F.col("begin") < F.col("a")["us"] + F.lit(limit)
        waits = found.where(F.col(f"o{j}") & (F.col("cell") >= 0)).join(cells, keys).where((F.col("later") > F.col("cell")) & fits_in & timely)
        to = waits.groupBy(*keys, "start", "a", f"x{j}").agg(F.min("later").alias("cell"))
        wants = [F.when(F.lit(i == j), F.col(f"x{j}")).cast("double").alias(f"x{i}") for i in range(n)]
        part = to.select(*keys, "cell", F.lit(True).alias("starts"), *wants, *[F.lit(None).cast("double").alias(f"v{i}") for i in range(n)], "a.*", "start")
        going = part if going is None else going.unionByName(part)
    going = stored(going, "going-on")
    again = going.select(*keys, "cell").distinct()
    passed = rows.join(again, [*keys, "cell"], "left_semi").withColumn("starts", F.lit(False)).withColumn("start", F.lit(None).cast("bigint"))
    more = _sweep(passed.unionByName(going, allowMissingColumns=True), keys, ops, limit)
    picked = [F.first(f"f{j}", ignorenulls=True).alias(f"g{j}") for j in range(n)]  # each search goes on in one cell
    more = more.groupBy(F.col("a.start").alias("start")).agg(*picked)
    drop = [f for f in rows.columns if f not in (*keys, "cell", "starts", *[f"{k}{j}" for k in "xv" for j in range(n)])]
    plain = lambda c: F.when(F.col(c).isNotNull(), F.struct(*[F.col(c)[f].alias(f) for f in drop]))
    out = found.join(more, "start", "left")
    return out.select(*keys, "a", *[F.coalesce(F.col(f"f{j}"), plain(f"g{j}")).alias(f"f{j}") for j in range(n)])
