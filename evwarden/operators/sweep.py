"""General batch matching: sorted partitions streamed through the frontier.

Handles what windows cannot: predicates between events beyond key equality,
repetitions, all later matches.  Rows are hashed by key (and cell, for hot
keys), sorted by time inside the partition and read batch by batch, so a task
holds one batch and its open matches, never a whole group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwarden.model import Invariant
from evwarden.operators.advance import Frontier
from evwarden.operators.cells import CellOptions, assign_cells_with_halo
from evwarden.operators.project import Layout, fits, key_columns, project_events

_CHUNK_ROWS = 65_536


def match_type(inv: Invariant, layout: Layout) -> str:
    """DDL of a match row."""
    slots = []
    for i in inv.positive:
        t = layout.slot_type(i)
        slots.append(f"s{i} array<{t}>" if inv.steps[i].loop else f"s{i} {t}")
    head = "kind string, start_us bigint, start_seq bigint, end_us bigint, end_seq bigint, bound bigint"
    return ", ".join([head, *slots])


def sweep_matches(
    events: DataFrame, inv: Invariant, layout: Layout, opts: CellOptions, open_until: Column | None
) -> DataFrame:
    classes = inv.key_classes()
    keys = [f"k{n}" for n in range(len(classes))]
    ev = project_events(events, layout)
    ev = ev.select("*", *[c.alias(k) for k, c in zip(keys, key_columns(layout, classes))])
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    useful = fits(layout, 0)
    for i in range(1, len(inv.steps)):
        useful = useful | (fits(layout, i) & keyed)
    ev, _ = assign_cells_with_halo(ev.filter(useful), keys, inv.within_us, opts)
    order = [*keys, "cell"]
    ev = ev.repartition(*order).sortWithinPartitions(*order, "us", "seq")
    matches = ev.mapInArrow(_matcher(inv, layout, order), match_type(inv, layout))
    if open_until is not None:
        matches = matches.filter(F.col("end_seq").isNotNull() | (F.col("end_us") <= open_until))
    return matches


def _matcher(inv: Invariant, layout: Layout, order: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frontier = Frontier(inv, layout)
        group, previous = 0, None
        for chunk in _chunks(batches):
            ids, previous = _groups(chunk, order, group, previous)
            group = int(ids[-1])
            own = chunk["own"].to_numpy()
            frontier.push(chunk.drop_columns([*order, "own"]), ids, own)
            yield from frontier.drain().to_batches()
            frontier.compact()
        frontier.finish()
        yield from frontier.drain().to_batches()

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= _CHUNK_ROWS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _groups(chunk: pa.Table, order: list[str], group: int, previous: dict | None) -> tuple[np.ndarray, dict]:
    """Consecutive numbers for the runs of equal key and cell, going on from the previous chunk."""
    changed = np.zeros(chunk.num_rows, dtype=bool)
    for name in order:
        col = chunk[name].combine_chunks()
        here, there = col.slice(1), col.slice(0, len(col) - 1)
        differs = pc.fill_null(pc.not_equal(here, there), False)
        nulls = pc.xor(pc.is_null(here), pc.is_null(there))
        changed[1:] |= pc.or_(differs, nulls).to_numpy(zero_copy_only=False)
    first = {name: chunk[name][0].as_py() for name in order}
    changed[0] = previous is not None and first != previous
    last = {name: chunk[name][chunk.num_rows - 1].as_py() for name in order}
    return group + np.cumsum(changed), last
