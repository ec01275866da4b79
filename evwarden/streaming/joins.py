"""Matching on streams by stream-stream joins bounded in time: state is Spark's own, and no Python runs.

What starts wait for in vain comes from a left outer join: a start leaves its state unmatched when the watermark has passed its limit.
Full matches come from the side of the closing event: it joins the earlier events of its key within the limit, and of these the latest that
closes or forbids cuts off all starts before it.  Both appear as soon as the watermark decides them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwarden.model import Invariant
from evwarden.operators.project import Layout, _literal, behind_watermark, fits, key_columns, local_terms, project_events
from evwarden.operators.scan import scannable
from evwarden.predicates import Literal, aliases_of, compare, to_column

KINDS = ("full", "timeout")
_NULL_KEY_SALTS = 1024


def joinable(inv: Invariant) -> bool:
    """A start and a closing event, or a start and an absence, that a key or their own members tie together."""
    if inv.within_us is None or not scannable(inv):
        return False
    return len(inv.positive) == (1 if inv.trailing_negation else 2) and len(inv.steps) > 1


def join_matches(stamped: DataFrame, inv: Invariant, layout: Layout, kinds: Sequence[str] = KINDS, buckets: bool = False) -> DataFrame:
    """Matches of the ``kinds`` wanted, of a stream with a watermark.

    With ``buckets`` the events of a key are also dealt by time, in stretches as long as the limit, of which a match touches two; so they are where there is no key.
    """
    sides = _Sides(stamped, inv, layout, buckets or not inv.key_classes())
    found = []
    if inv.trailing_negation:
        found += [sides.waiting("full")] if "full" in kinds else []
    else:
        found += [sides.closed()] if "full" in kinds else []
        found += [sides.waiting("timeout")] if "timeout" in kinds else []
    if not found:
        found = [sides.waiting("full").where(F.lit(False))]
    return reduce(DataFrame.unionByName, found)


class _Sides:
    def __init__(self, stamped: DataFrame, inv: Invariant, layout: Layout, buckets: bool):
        self.inv, self.layout, self.buckets = inv, layout, buckets
        classes = inv.key_classes()
        self.keys = [f"k{n}" for n in range(len(classes))]
        events = project_events(stamped, layout, keep=["ts"])
        self.events = events.select("*", *[c.alias(k) for k, c in zip(self.keys, key_columns(layout, classes))])
        self.known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys], F.lit(True))
        self.last = inv.positive[-1]
        self.negated = [i for i, s in enumerate(inv.steps) if s.negated]
        self.within = F.expr(f"INTERVAL '{inv.within_us // 1_000_000}.{inv.within_us % 1_000_000:06d}' SECOND")

    def _any(self, steps: Sequence[int]) -> Column:
        return reduce(lambda a, b: a | b, [fits(self.layout, i) for i in steps], F.lit(False))

    def _side(self, name: str, condition: Column, lonely: Column, bucket: Column | None, **flags: Column) -> DataFrame:
        """The events of a condition: ``<name>`` holds the event, ``<name>_ts`` its time, ``<name>_k…`` what it is joined on."""
        event = F.struct("us", "seq", "type", *self.layout.columns.values()).alias(name)
        tied = [F.col(k).alias(f"{name}_{k}") for k in self.keys]
        tied += [lonely.alias(f"{name}_lonely")] if self.keys else []
        tied += [bucket.alias(f"{name}_bucket")] if self.buckets else []
        marks = [c.alias(n) for n, c in flags.items()]
        return self.events.filter(behind_watermark(condition)).select(F.col("ts").alias(f"{name}_ts"), event, *tied, *marks)

    def _bucket(self) -> Column:
        return F.floor(F.col("us") / F.lit(self.inv.within_us)).cast("bigint")

    def _tied(self, a: str, b: str) -> Column:
        names = [*self.keys, *(["lonely"] if self.keys else []), *(["bucket"] if self.buckets else [])]
        return reduce(lambda x, y: x & y, [F.col(f"{a}_{n}") == F.col(f"{b}_{n}") for n in names])

    def _of_start(self, start: str) -> Column:
        """Terms that are tested at the last step but read the start alone."""
        out = F.lit(True)
        local = local_terms(self.inv, self.last) if self.last else []
        for term in self.inv.step_terms[self.last] if self.last else []:
            if not any(term is t for t in local) and all(self.inv.step_of[x] == 0 for x in aliases_of(term)):
                side = lambda s: F.lit(_literal(s)) if isinstance(s, Literal) else F.col(start).getField(self.layout.of(s))
                out = out & to_column(term, lambda c: compare(c.op, side(c.left), side(c.right)))
        return out

    def waiting(self, kind: str) -> DataFrame:
        """Starts with neither a closing nor a forbidden event within the limit."""
        alone = F.when(self.known, F.lit(0)).otherwise(F.lit(1) + F.pmod(F.xxhash64("us", "seq"), F.lit(_NULL_KEY_SALTS)).cast("int"))
        starts = self._side("a", fits(self.layout, 0), alone, self._bucket())
        closing = [self.last] if self.last else []
        later = self._side(
            "e", self.known & self._any([*closing, *self.negated]), F.lit(0), F.explode(F.array(self._bucket(), self._bucket() - 1)),
            closes=self._any(closing), forbids=self._any(self.negated),
        )
        after = (F.col("e_ts") >= F.col("a_ts")) & (F.col("e_ts") < F.col("a_ts") + self.within) & (_at("e") > _at("a"))
        ends = F.col("forbids") | (F.col("closes") & self._of_start("a"))
        alone = starts.join(later, self._tied("a", "e") & after & ends, "left_outer").where(F.col("e").isNull())
        limit = F.col("a")["us"] + F.lit(self.inv.within_us)
        return self._rows(alone, kind, limit, F.lit(None).cast("bigint"), {0: F.col("a")})

    def closed(self) -> DataFrame:
        """Starts with their first closing event, nothing forbidden between."""
        closing = self._side("b", self.known & fits(self.layout, self.last), F.lit(0), self._bucket())
        cuts = self._any([self.last, *self.negated])
        earlier = self._side(
            "e", self.known & (fits(self.layout, 0) | cuts), F.lit(0), F.explode(F.array(self._bucket(), self._bucket() + 1)),
            starts=fits(self.layout, 0), cuts=cuts,
        )
        before = (F.col("e_ts") <= F.col("b_ts")) & (F.col("e_ts") > F.col("b_ts") - self.within) & (_at("e") < _at("b"))
        met = closing.join(earlier, self._tied("b", "e") & before)
        met = met.select("b_ts", "b", "e", "starts", "cuts").groupBy("b_ts", "b").agg(
            F.max(F.when(F.col("cuts"), _at("e"))).alias("cut"), F.collect_list(F.when(F.col("starts") & self._of_start("e"), F.col("e"))).alias("open")
        )
        open_ = F.filter("open", lambda a: F.col("cut").isNull() | (F.struct(a["us"], a["seq"]) >= F.col("cut")))
        rows = met.select("b", F.explode(open_).alias("a"))
        return self._rows(rows, "full", F.col("b")["us"], F.col("b")["seq"], {0: F.col("a"), self.last: F.col("b")})

    def _rows(self, rows: DataFrame, kind: str, end_us: Column, end_seq: Column, bound: dict[int, Column]) -> DataFrame:
        slots = []
        for i in self.inv.positive:
            fields = ("us", "seq", "type", *self.layout.slot_members(i))
            slot = F.struct(*[bound[i][f].alias(f) for f in fields]) if i in bound else F.lit(None)
            slots.append(slot.cast(self.layout.slot_type(i)).alias(f"s{i}"))
        return rows.select(
            F.lit(kind).alias("kind"), F.col("a")["us"].alias("start_us"), F.col("a")["seq"].alias("start_seq"), end_us.alias("end_us"),
            end_seq.alias("end_seq"), F.lit(sum(1 << i for i in bound)).cast("bigint").alias("bound"), *slots,
        )


def _at(event: str) -> Column:
    return F.struct(F.col(event)["us"], F.col(event)["seq"])
