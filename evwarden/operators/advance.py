"""Vectorised step-by-step matching on a time-ordered chunk of events.

:class:`Frontier` holds the open partial matches as arrays.  A chunk of events
advances all of them together: for each waiting position, the open matches look
at their next candidates as one matrix and stop at the first that binds or
kills.  Python loops run over positions and blocks, never over events.

It serves the general batch strategy (sorted partitions) and the stateful
streaming operator; both hand it consecutive chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from evwarden.model import ONCE, STAR, Invariant
from evwarden.operators.project import Layout, _literal
from evwarden.predicates import Comparison, Literal, Predicate, Ref, aliases_of, refs, to_mask

_PAIRS_PER_BLOCK = 1 << 17
_NO_LIMIT = np.iinfo(np.int64).max


@dataclass
class Open:
    """Open matches, one array entry each; events are row numbers of the arena."""

    state: np.ndarray
    group: np.ndarray
    after: np.ndarray  # first arena row still to be looked at
    limit: np.ndarray
    bound: np.ndarray  # (n, steps) arena rows, -1 if unbound
    loops: np.ndarray  # (n, steps) objects: list of row arrays of a repeated step, or None
    matched: np.ndarray  # already reported (all_matches), so no timeout

    def take(self, idx: np.ndarray) -> Open:
        return Open(*[getattr(self, f)[idx] for f in _FIELDS])

    def __len__(self) -> int:
        return len(self.state)


_FIELDS = ("state", "group", "after", "limit", "bound", "loops", "matched")


def _concat(parts: list[Open]) -> Open:
    return Open(*[np.concatenate([getattr(p, f) for p in parts]) for f in _FIELDS])


class Frontier:
    """Open matches of one or more groups and the events they hold."""

    def __init__(self, inv: Invariant, layout: Layout):
        self.inv, self.layout = inv, layout
        self.positive = inv.positive
        self.end_state = 2 * len(inv.steps)
        self.types = {i: inv.step_types(i) for i in range(len(inv.steps))}
        self.members = sorted({layout.of(r) for t in inv.terms for r in refs(t)})
        self.settled_terms = {
            i: [t for t in terms if all(inv.step_of[a] < i for a in aliases_of(t))] for i, terms in enumerate(inv.step_terms)
        }
        self.equal_members = {i: self._equal_member(i) for i in range(len(inv.steps))}
        self.arena: pa.Table | None = None
        self.open = self._none()
        self.done: list[tuple[str, Open, np.ndarray, np.ndarray]] = []

    def _equal_member(self, i: int) -> tuple[str, int, str] | None:
        """``(member of step i, earlier step, its member)`` of an equality tested at step ``i``."""
        for term in self.inv.step_terms[i]:
            if isinstance(term, Comparison) and term.op == "=" and isinstance(term.left, Ref) and isinstance(term.right, Ref):
                sides = sorted((term.left, term.right), key=lambda r: self.inv.step_of[r.alias])
                at, here = (self.inv.step_of[r.alias] for r in sides)
                if at < here == i:
                    return self.layout.of(sides[1]), at, self.layout.of(sides[0])
        return None

    # -- states: 2*i waits for step i, 2*i+1 is inside the repetition of step i ----------

    def _entering(self, i: int) -> int:
        """State after everything before step ``i`` is bound."""
        nxt = next((j for j in self.positive if j >= i), None)
        if nxt is None:
            return self.end_state
        return 2 * nxt + 1 if self.inv.steps[nxt].kind == STAR else 2 * nxt

    def _targets(self, state: int) -> list[int]:
        """Steps that an event may bind in ``state``."""
        if state == self.end_state:
            return []
        i, inside = divmod(state, 2)
        out = [i]
        while inside:
            i = next(j for j in self.positive if j > i)
            out.append(i)
            inside = self.inv.steps[i].kind == STAR
        return out

    def _killers(self, state: int) -> list[int]:
        i, inside = divmod(state, 2)
        if inside:
            return self.inv.negations_after(i) + self._negations_before(i)
        return self._negations_before(i if state != self.end_state else len(self.inv.steps))

    def _negations_before(self, i: int) -> list[int]:
        out = []
        while i > 0 and self.inv.steps[i - 1].negated:
            i -= 1
            out.append(i)
        return out

    # -- chunk by chunk --------------------------------------------------------------

    def _none(self) -> Open:
        n = len(self.inv.steps)
        e = np.empty(0, dtype=np.int64)
        return Open(
            e, e, e, e, np.empty((0, n), dtype=np.int64), np.empty((0, n), dtype=object), np.empty(0, dtype=bool)
        )

    def push(self, chunk: pa.Table, group: np.ndarray, own: np.ndarray | None = None) -> None:
        """Feeds events ordered by (group, us, seq).  A group may continue over chunks."""
        if not chunk.num_rows:
            return
        kept = 0 if self.arena is None else self.arena.num_rows
        self.arena = chunk if not kept else pa.concat_tables([self.arena, chunk]).combine_chunks()
        self.base, size = kept, self.arena.num_rows
        self._load()
        self.row_group = np.concatenate([np.full(kept, -1, dtype=np.int64), group])
        self.open.after[:] = kept
        starts = self._starts(own)
        self.open = _concat([self.open, starts]) if len(self.open) else starts
        states = sorted({s for i in self.positive[1:] for s in (2 * i, 2 * i + 1)} | {self.end_state})
        single = len(self.inv.steps) == 1
        if single:
            self._emit("full", self.open, self.open.bound[:, 0], self.open.limit)
            self.open = self._none()
        for state in [] if single else states:
            sel = self.open.state == state
            if sel.any():
                rest = self.open.take(~sel)
                self.open = _concat([rest, self._advance(self.open.take(sel), state, size)])
        last_us, last_group = self.us[-1], group[-1]
        self.expire((self.open.group < last_group) | (self.open.limit <= last_us))

    def finish(self) -> None:
        """End of input for every group still open."""
        self.expire(np.ones(len(self.open), dtype=bool))

    def expire(self, which: np.ndarray) -> None:
        """Takes open matches off; those with a limit become timeouts or trailing negations."""
        if not which.any():
            return
        gone = self.open.take(which)
        self.open = self.open.take(~which)
        gone = gone.take((gone.limit != _NO_LIMIT) & ~gone.matched)
        complete = gone.state == self.end_state
        for kind, part in (("full", gone.take(complete)), ("timeout", gone.take(~complete))):
            self._emit(kind, part, np.full(len(part), -1, dtype=np.int64), part.limit)

    def compact(self) -> None:
        """Drops events that no open match refers to."""
        if self.arena is None:
            return
        used = [self.open.bound[self.open.bound >= 0]]
        used += [rows for cell in self.open.loops.ravel() if cell is not None for rows in cell]
        keep = np.unique(np.concatenate(used)) if used else np.empty(0, dtype=np.int64)
        self.arena = self.arena.take(pa.array(keep)).combine_chunks()
        bound = self.open.bound
        self.open.bound = np.where(bound >= 0, np.searchsorted(keep, bound), -1)
        flat = self.open.loops.ravel()
        for n, cell in enumerate(flat):
            if cell is not None:
                flat[n] = [np.searchsorted(keep, rows) for rows in cell]
        self.open.loops = flat.reshape(self.open.loops.shape)

    # -- internals -----------------------------------------------------------------------

    def _load(self) -> None:
        t = self.arena
        self.us = t["us"].to_numpy()
        self.values, self.present = {}, {}
        for m in self.members:
            col = t[m]
            self.present[m] = ~col.is_null().to_numpy()
            if pa.types.is_floating(col.type):
                self.values[m] = col.fill_null(0.0).to_numpy()
            elif pa.types.is_boolean(col.type):
                self.values[m] = col.fill_null(False).to_numpy().astype(np.int8)
            else:
                self.values[m] = col.to_numpy().astype(object)
        self.of_type = {
            i: pc.is_in(t["type"], value_set=pa.array(ts, pa.string())).to_numpy() for i, ts in self.types.items()
        }

    def _starts(self, own: np.ndarray | None) -> Open:
        rows = np.arange(self.base, len(self.us))
        ok = self.of_type[0][rows] & self._holds(0, None, rows)
        if own is not None:
            ok &= own
        rows = rows[ok]
        n, steps = len(rows), len(self.inv.steps)
        bound = np.full((n, steps), -1, dtype=np.int64)
        bound[:, 0] = rows
        limit = np.full(n, _NO_LIMIT) if self.inv.within_us is None else self.us[rows] + self.inv.within_us
        state = np.full(n, self._entering(1), dtype=np.int64)
        loops = np.full((n, steps), None, dtype=object)
        return Open(state, self.row_group[rows], rows + 1, limit, bound, loops, np.zeros(n, dtype=bool))

    def _holds(
        self, step: int, bound: np.ndarray | None, rows: np.ndarray, terms: list[Predicate] | None = None
    ) -> np.ndarray:
        """Terms tested at ``step`` with ``rows`` as current events."""

        def value(side):
            if isinstance(side, Literal):
                v = _literal(side)
                v = np.int8(v) if isinstance(v, bool) else v
                arr = np.empty(len(rows), dtype=object) if isinstance(v, str) else np.empty(len(rows), type(v))
                arr[:] = v
                return arr, np.ones(len(rows), dtype=bool)
            m, at = self.layout.of(side), self.inv.step_of[side.alias]
            idx = rows if at == step else bound[:, at]
            return self.values[m][idx], self.present[m][idx] & (idx >= 0)

        out = np.ones(len(rows), dtype=bool)
        for term in self.inv.step_terms[step] if terms is None else terms:
            out &= to_mask(term, value)
        return out

    def _lookup(self, todo: Open, cand: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Candidates in search order, and for each open match its first one and the end of its run.

        If an equality ties the candidate to an earlier event, candidates are
        ordered by that value, so a match only looks at those that share it.
        """
        size = len(self.us)
        pair = self.equal_members[step]
        if pair is not None and len(cand):
            here, at, there = pair
            cand = cand[self.present[here][cand]]
            values, bound = self.values[here][cand], todo.bound[:, at]
            if not (values.dtype.kind == "f" and np.isnan(values).any()):
                codes, uniques = pd.factorize(values)
                mine = pd.Index(uniques).get_indexer(self.values[there][bound])
                mine = np.where(self.present[there][bound], mine, -1)
                order = np.lexsort((cand, codes))
                cand, slots = cand[order], codes[order] * size + cand[order]
                begin = np.where(mine >= 0, np.searchsorted(slots, mine * size + todo.after), 0)
                return cand, begin, np.where(mine >= 0, np.searchsorted(slots, (mine + 1) * size), 0)
        return cand, np.searchsorted(cand, todo.after), np.full(len(todo), len(cand))

    def _advance(self, todo: Open, state: int, size: int) -> Open:
        """Moves the matches waiting in ``state`` as far as the chunk allows."""
        targets, killers = self._targets(state), self._killers(state)
        inside = state % 2 == 1 and state != self.end_state
        relevant = np.zeros(size, dtype=bool)
        for i in targets + killers:
            relevant |= self.of_type[i]
        relevant[: self.base] = False
        cand = np.flatnonzero(relevant)
        out: list[Open] = []
        if len(targets) == 1 and not inside and not killers:
            # terms on earlier events alone are decided: without them only the limit is left to wait for
            possible = self._holds(targets[0], todo.bound, todo.bound[:, 0], self.settled_terms[targets[0]])
            out.append(todo.take(~possible))
            todo = todo.take(possible)
            cand, at, end = self._lookup(todo, cand, targets[0])
        else:
            at, end = np.searchsorted(cand, todo.after), np.full(len(todo), len(cand))
        live = np.arange(len(todo))
        waiting: list[np.ndarray] = []
        while len(live):
            width = int(np.clip(_PAIRS_PER_BLOCK // len(live), 1, 4096))
            pos = at[live][:, None] + np.arange(width)
            seen = pos < end[live][:, None]
            rows = cand[np.minimum(pos, len(cand) - 1)] if len(cand) else np.zeros_like(pos)
            seen &= self.row_group[rows] == todo.group[live][:, None]
            late = seen & (self.us[rows] >= todo.limit[live][:, None])
            seen &= ~late
            hit, kills, loop = self._classify(todo, live, rows, seen, targets, killers, inside)
            stop = (hit >= 0) | kills | late | ~seen
            stopped = stop.any(axis=1)
            first = np.where(stopped, stop.argmax(axis=1), width)
            if inside:
                self._collect(todo, live, rows, loop, first, state // 2)
            n = np.flatnonzero(stopped)
            col = first[n]
            target, at_row = hit[n, col], rows[n, col]
            moved = target >= 0
            killed = ~moved & kills[n, col]
            timed_out = ~moved & ~killed & late[n, col]
            who = live[n]
            if timed_out.any():
                gone = todo.take(who[timed_out & ~todo.matched[who]])
                kind = "full" if state == self.end_state else "timeout"
                self._emit(kind, gone, np.full(len(gone), -1, dtype=np.int64), gone.limit)
            again = self._bind(todo, who[moved], target[moved], at_row[moved], out)
            waiting.append(who[~moved & ~killed & ~timed_out])
            at[live] += first
            cont = live[~stopped]
            if len(again):
                at[again] += 1
                cont = np.concatenate([cont, again])
            live = cont
        out.append(todo.take(np.concatenate(waiting) if waiting else live))
        return _concat(out)

    def _classify(self, todo, live, rows, seen, targets, killers, inside):
        """Per (match, candidate): step bound or -1, killed, taken by the repetition."""
        shape, flat = rows.shape, rows.ravel()
        bound = np.repeat(todo.bound[live], shape[1], axis=0)
        ok = seen.ravel()

        def fits(i: int) -> np.ndarray:
            sel = np.flatnonzero(ok & self.of_type[i][flat])
            res = np.zeros(len(flat), dtype=bool)
            res[sel] = self._holds(i, bound[sel], flat[sel])
            return res.reshape(shape)

        hit = np.full(shape, -1, dtype=np.int64)
        loop = np.zeros(shape, dtype=bool)
        steps = list(targets)
        ready = np.ones(shape, dtype=bool)
        if inside:
            own = steps.pop(0)
            loop = fits(own)
            begun = np.array([c is not None for c in todo.loops[live, own]], dtype=bool)[:, None]
            if self.inv.steps[own].kind != STAR:
                before = np.zeros(shape, dtype=bool)
                before[:, 1:] = np.logical_or.accumulate(loop, axis=1)[:, :-1]
                ready = begun | before
        for i in steps:
            take = fits(i) & ~loop & ready & (hit < 0)
            hit[take] = i
        kills = np.zeros(shape, dtype=bool)
        if killers:
            if inside:
                started = begun | np.logical_or.accumulate(loop, axis=1)
            for i in killers:
                k = fits(i)
                if inside:
                    # negations before a repetition end with its first event, those after it need one
                    k &= ready if i > own else ~started
                kills |= k
            kills &= (hit < 0) & ~loop
        return hit, kills, loop

    def _collect(self, todo, live, rows, loop, first, step) -> None:
        taken = loop & (np.arange(loop.shape[1]) < first[:, None])
        for n in np.flatnonzero(taken.any(axis=1)):
            who = live[n]
            cell = todo.loops[who, step]
            # lists are not shared: the one of an emitted match must not grow
            todo.loops[who, step] = [*(cell or []), rows[n, taken[n]]]
            if todo.bound[who, step] < 0:
                todo.bound[who, step] = rows[n, taken[n]][0]

    def _bind(self, todo: Open, who: np.ndarray, target: np.ndarray, row: np.ndarray, out: list[Open]) -> np.ndarray:
        """Binds events; returns the matches that stay where they are as well (all_matches)."""
        again = [np.empty(0, dtype=np.int64)]
        for step in np.unique(target):
            sel = target == step
            part = todo.take(who[sel])
            part.bound[:, step] = row[sel]
            if self.inv.steps[step].kind == ONCE:
                new_state = self._entering(step + 1)
            else:
                new_state = 2 * step + 1
                for n, r in enumerate(row[sel]):
                    part.loops[n, step] = [np.array([r], dtype=np.int64)]
            if new_state == self.end_state and not self.inv.trailing_negation:
                self._emit("full", part, row[sel], part.limit)
                if self.inv.all_matches:
                    todo.matched[who[sel]] = True
                    again.append(who[sel])
                continue
            part.state = np.full(len(part), new_state, dtype=np.int64)
            part.after = row[sel] + 1
            out.append(part)
        return np.concatenate(again)

    def _emit(self, kind: str, part: Open, end_row: np.ndarray, limit: np.ndarray) -> None:
        if len(part):
            self.done.append((kind, part, end_row, limit))

    # -- output ------------------------------------------------------------------------------

    def drain(self) -> pa.Table:
        """The matches decided since the last call, in the layout of the window strategy."""
        done, self.done = self.done, []
        tables = [self._table(*d) for d in done]
        return pa.concat_tables(tables) if tables else self.schema().empty_table()

    def schema(self) -> pa.Schema:
        return pa.schema(
            [
                ("kind", pa.string()),
                ("start_us", pa.int64()),
                ("start_seq", pa.int64()),
                ("end_us", pa.int64()),
                ("end_seq", pa.int64()),
                ("bound", pa.int64()),
            ]
            + [(f"s{i}", self._slot_type(i)) for i in self.positive]
        )

    def _slot_type(self, i: int) -> pa.DataType:
        kinds = {
            c: {"number": pa.float64(), "bool": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}.get(k, pa.string())
            for (_, k), c in self.layout.columns.items()
        }
        base = [("us", pa.int64()), ("seq", pa.int64()), ("type", pa.string())]
        slot = pa.struct(base + [(m, kinds[m]) for m in self.layout.slot_members(i)])
        return pa.list_(slot) if self.inv.steps[i].loop else slot

    def _table(self, kind: str, part: Open, end_row: np.ndarray, limit: np.ndarray) -> pa.Table:
        us, seq = self.arena["us"].to_numpy(), self.arena["seq"].to_numpy()
        start, at_event = part.bound[:, 0], end_row >= 0
        mask = np.zeros(len(part), dtype=np.int64)
        for i in self.positive:
            mask |= np.where(part.bound[:, i] >= 0, np.int64(1 << i), np.int64(0))
        cols = [
            pa.array([kind] * len(part), pa.string()),
            pa.array(us[start]),
            pa.array(seq[start]),
            pa.array(np.where(at_event, us[end_row], limit)),
            pa.array(seq[end_row], mask=~at_event),
            pa.array(mask),
        ]
        for i in self.positive:
            cols.append(self._loop_slot(i, part) if self.inv.steps[i].loop else self._once_slot(i, part.bound[:, i]))
        return pa.Table.from_arrays(cols, schema=self.schema())

    def _once_slot(self, i: int, rows: np.ndarray) -> pa.Array:
        slot = self._slot_type(i)
        if pa.types.is_list(slot):
            slot = slot.value_type
        missing = rows < 0
        idx = pa.array(np.maximum(rows, 0))
        names = ["us", "seq", "type", *self.layout.slot_members(i)]
        fields = [self.arena[n].combine_chunks().take(idx).cast(slot.field(n).type) for n in names]
        return pa.StructArray.from_arrays(fields, fields=[slot.field(n) for n in names], mask=pa.array(missing))

    def _loop_slot(self, i: int, part: Open) -> pa.Array:
        lists = [np.concatenate(c) if c is not None else np.empty(0, dtype=np.int64) for c in part.loops[:, i]]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        rows = np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(offsets), self._once_slot(i, rows.astype(np.int64)), type=self._slot_type(i))
