"""Invariants over event streams.

A start with its closing event, or with an absence, is answered by stream-stream joins
(:mod:`evwarden.streaming.joins`).  Longer patterns, loops and predicates between events need the
state operator below.  There, events of a key are buffered in state until the watermark has passed them,
then fed in time order to the same matcher as in batch.  Timers stand at the
oldest buffered event and at the earliest limit of an open match, so full
matches come out as soon as their order is certain and timeouts when their
limit has passed.  State lives in RocksDB; what no open match needs is dropped.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator, Sequence
from datetime import datetime
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from evwarden.model import Invariant, InvariantError
from evwarden.operators.advance import Frontier, Open
from evwarden.operators.project import Layout, behind_watermark, fits, key_columns, project_events, shared_layouts
from evwarden.operators.verdict import as_records, bindings, clause_kinds, records_together, violations
from evwarden.streaming.joins import KINDS, join_matches, joinable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NULL_KEY_SALTS = 1024


def use_rocksdb(spark: SparkSession) -> None:
    """What the stateful operators need: a store on disk, and one watermark for all operators of a query.

    With one watermark, the count of a closing event's earlier events ends when the watermark passes that event; else
    the joins before it would hold it back by the whole limit.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.statefulOperator.allowMultiple", "false")


def match_stream(
    events: DataFrame, inv: Invariant, lateness: str = "5 seconds", salts: int = 1, strategy: str = "auto", kinds: Sequence[str] = KINDS
) -> DataFrame:
    """Full and timed-out matches of a stream ``events(type, content, ts, seq)``; of the ``kinds`` wanted, where joins answer it.

    ``lateness`` is the out-of-orderness bound; events behind the watermark are
    dropped.  With ``salts`` > 1 a hot key is spread: by stretches of time over joins, else its
    starts over that many tasks, each of which also sees the key's other events.
    ``strategy`` is ``"joins"``, ``"state"`` or ``"auto"``, which takes joins where they can express the pattern.
    """
    if strategy not in ("auto", "joins", "state"):
        raise ValueError("strategy must be 'auto', 'joins' or 'state'")
    if inv.within_us is None and len(inv.steps) > 1:
        raise InvariantError("a stream needs a time limit, or its state grows for ever")
    layout = Layout(inv)
    stamped = events.withWatermark("ts", lateness)
    if len(inv.steps) == 1:
        return bindings(_single(stamped, inv, layout), inv, layout)
    if strategy != "state" and joinable(inv):
        return bindings(join_matches(stamped, inv, layout, kinds, salts > 1), inv, layout)
    if strategy == "joins":
        raise ValueError(f"invariant {inv.name!r} needs the state operator")
    raw = _matched(stamped, [(inv, layout)], salts)
    return bindings(raw.select(*_HEAD, *_slots(inv, layout)), inv, layout)


_HEAD = ["kind", "start_us", "start_seq", "end_us", "end_seq", "bound"]
Pattern = tuple[Invariant, Layout]


def _slots(inv: Invariant, layout: Layout) -> list[Column]:
    kinds = {i: f"array<{layout.slot_type(i)}>" if inv.steps[i].loop else layout.slot_type(i) for i in inv.positive}
    return [F.from_json(f"s{i}", kind).alias(f"s{i}") for i, kind in kinds.items()]


def _matched(stamped: DataFrame, patterns: Sequence[Pattern], salts: int) -> DataFrame:
    """Raw matches of invariants with the same key members: one shuffle, one buffer of events, one state for each key."""
    first, layout = patterns[0]
    classes = first.key_classes()
    keys = [f"k{n}" for n in range(len(classes))]
    types = sorted({t for inv, _ in patterns for t in inv.types})
    ev = project_events(stamped, layout, keep=["ts"], types=types)
    ev = ev.select("*", *[c.alias(k) for k, c in zip(keys, key_columns(layout, classes))])
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    start, later = F.lit(False), F.lit(False)
    for inv, own in patterns:
        start = start | fits(own, 0)
        for i in range(1, len(inv.steps)):
            later = later | (fits(own, i) & keyed)
    ev = ev.filter(behind_watermark(start | later))
    mine = F.pmod(F.xxhash64("us", "seq"), F.lit(salts)).cast("int")
    lonely = F.lit(-1) - F.pmod(F.xxhash64("us", "seq"), F.lit(_NULL_KEY_SALTS)).cast("int")
    targets = F.when(~keyed, F.array(lonely)).when(later, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(mine))
    ev = ev.withColumn("mine", mine).withColumn("salt", F.explode(targets))
    ev = ev.withColumn("own", (F.col("salt") < 0) | (F.col("salt") == F.col("mine"))).drop("mine")
    return ev.groupBy(*keys, "salt").transformWithStateInPandas(
        statefulProcessor=MatchProcessor(patterns),
        outputStructType=_raw_schema(patterns),
        outputMode="Append",
        timeMode="EventTime",
    )


def check_stream(events: DataFrame, inv: Invariant, lateness: str = "5 seconds", salts: int = 1) -> DataFrame:
    """The violations of ``inv`` on a stream, in append mode."""
    return violations(match_stream(events, inv, lateness, salts, kinds=clause_kinds(inv)), inv)


def check_streams(
    events: DataFrame, invariants: Sequence[Invariant], lateness: str = "5 seconds", salts: int = 1
) -> DataFrame:
    """Violations of several invariants as one stream, the match as JSON text; one query, one checkpoint.

    Those that joins can answer are joined on their own; others with the same key members share the read, the shuffle and the state operator.
    """
    if not invariants:
        raise ValueError("no invariants given")
    shared: dict[tuple, list[Invariant]] = {}
    for n, inv in enumerate(invariants):
        signature = None if joinable(inv) else _signature(inv)
        shared.setdefault(signature or ("alone", n), []).append(inv)
    found = []
    for group in shared.values():
        if len(group) == 1:
            found.append(as_records(check_stream(events, group[0], lateness, salts), group[0]))
            continue
        if any(inv.within_us is None for inv in group):
            raise InvariantError("a stream needs a time limit, or its state grows for ever")
        patterns = list(zip(group, shared_layouts(group)))
        raw = _matched(events.withWatermark("ts", lateness), patterns, salts)
        matches = raw.select(
            *[F.when(F.col("n") == n, F.struct(*_HEAD, *_slots(inv, own))).alias(f"match{n}") for n, (inv, own) in enumerate(patterns)]
        )
        found.append(records_together(matches, patterns))
    return reduce(DataFrame.unionByName, found)


def _signature(inv: Invariant) -> tuple | None:
    """The members that every event of a match shares; invariants with the same ones can share a state."""
    members = [{(ref.path, inv.member_type(ref)) for ref in chosen} for chosen in inv.key_classes()]
    if len(inv.steps) == 1 or not members or any(len(m) != 1 for m in members):
        return None
    return tuple(sorted(next(iter(m)) for m in members))


def _single(events: DataFrame, inv: Invariant, layout: Layout) -> DataFrame:
    """One step: a plain filter, no state."""
    ev = project_events(events, layout, keep=["ts"]).filter(fits(layout, 0))
    slot = F.struct(*layout.event_slot(0)).cast(layout.slot_type(0)).alias("s0")
    return ev.select(
        F.lit("full").alias("kind"), F.col("us").alias("start_us"), F.col("seq").alias("start_seq"),
        F.col("us").alias("end_us"), F.col("seq").alias("end_seq"), F.lit(1).cast("long").alias("bound"), slot,
    )


def _raw_schema(patterns: Sequence[Pattern]) -> str:
    head = "n int, kind string, start_us bigint, start_seq bigint, end_us bigint, end_seq bigint, bound bigint"
    return ", ".join([head, *[f"s{i} string" for i in range(max(len(inv.steps) for inv, _ in patterns))]])


class MatchProcessor(StatefulProcessor):
    """Buffered events of one key, and the open matches of each invariant."""

    def __init__(self, patterns: Sequence[Pattern]):
        self.patterns = list(patterns)
        columns = patterns[0][1].columns
        self.columns = ["us", "seq", "type", *columns.values(), "own"]
        kinds = {"number": pa.float64(), "bool": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
        members = [(c, kinds.get(kind, pa.string())) for (_, kind), c in columns.items()]
        self.schema = pa.schema(
            [("us", pa.int64()), ("seq", pa.int64()), ("type", pa.string()), *members, ("own", pa.bool_())]
        )

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buffered = handle.getListState("buffered", "chunk binary")
        self.frontiers = [handle.getValueState(f"frontier{n}", "blob binary") for n in range(len(self.patterns))]

    def _wake(self, ms: int) -> None:
        """One timer for a key, the earliest: a later one gives way."""
        standing = list(self.handle.listTimers())
        if standing and min(standing) <= ms:
            return
        for timer in standing:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        # Spark filters late rows by the watermark of the batch before; what the matcher has passed is late already.
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        earliest = None
        for pdf in rows:
            pdf = pdf[pdf["us"] >= passed_us]
            if len(pdf):
                chunk = pa.Table.from_pandas(pdf[self.columns], schema=self.schema, preserve_index=False)
                self.buffered.appendValue((_to_bytes(chunk),))
                first = int(pdf["us"].min())
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self._wake(earliest // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now_us = timerValues.getCurrentWatermarkInMs() * 1000
        chunks = [_from_bytes(row[0]) for row in self.buffered.get()]
        waiting = pa.concat_tables(chunks).combine_chunks() if chunks else self.schema.empty_table()
        us = waiting["us"].to_numpy()
        ready = waiting.filter(pa.array(us < now_us)).sort_by([("us", "ascending"), ("seq", "ascending")]).combine_chunks()
        wakes = []
        if ready.num_rows:
            rest = waiting.filter(pa.array(us >= now_us)).combine_chunks()
            if rest.num_rows:
                self.buffered.put([(_to_bytes(rest),)])
            else:
                self.buffered.clear()
            us = rest["us"].to_numpy()
        if len(us):
            wakes.append(int(us.min()) // 1000 + 1)
        out = []
        for n in range(len(self.patterns)):
            frontier = self._load(n)
            if ready.num_rows:
                frontier.push(ready.drop_columns(["own"]), np.zeros(ready.num_rows, dtype=np.int64), ready["own"].to_numpy())
            frontier.expire(frontier.open.limit <= now_us)
            found = frontier.drain()
            if ready.num_rows or found.num_rows:
                frontier.compact()
                self._store(n, frontier)
            if len(frontier.open):
                wakes.append(-(-int(frontier.open.limit.min()) // 1000))
            if found.num_rows:
                out.append(self._rows(n, found))
        if wakes:
            self.handle.registerTimer(min(wakes))  # the one that has just fired is gone
        return iter(out)

    def close(self) -> None:
        pass

    def _load(self, n: int) -> Frontier:
        frontier = Frontier(*self.patterns[n])
        if self.frontiers[n].exists():
            arena, fields = pickle.loads(self.frontiers[n].get()[0])
            frontier.arena, frontier.open = _from_bytes(arena), Open(**fields)
        return frontier

    def _store(self, n: int, frontier: Frontier) -> None:
        if not len(frontier.open):
            self.frontiers[n].clear()
            return
        self.frontiers[n].update((pickle.dumps((_to_bytes(frontier.arena), vars(frontier.open))),))

    def _rows(self, n: int, found: pa.Table) -> pd.DataFrame:
        out = found.select(_HEAD).to_pandas()
        out["end_seq"] = out["end_seq"].astype("Int64")
        out.insert(0, "n", np.int32(n))
        positive = self.patterns[n][0].positive
        for i in range(max(len(inv.steps) for inv, _ in self.patterns)):
            slots = found[f"s{i}"].to_pylist() if i in positive else [None] * found.num_rows
            out[f"s{i}"] = [None if v is None else json.dumps(v, default=_plain) for v in slots]
        return out


def _plain(value: Any) -> str:
    return value.isoformat() if isinstance(value, datetime) else str(value)


def _to_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()
