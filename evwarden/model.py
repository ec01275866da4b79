"""Declaration of an invariant: aliases, event sequence, predicates, verdicts."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from evwarden.predicates import (
    Comparison,
    Literal,
    Predicate,
    Ref,
    aliases_of,
    comparisons,
    conjuncts,
    refs,
)

MEMBER_TYPES = ("number", "string", "bool", "timestamp")
DEFAULT = "DEFAULT"

ONCE, PLUS, STAR = "once", "plus", "star"

_UNIT_US = {
    "msec": 1_000, "millisecond": 1_000, "ms": 1_000,
    "sec": 1_000_000, "second": 1_000_000, "s": 1_000_000,
    "min": 60_000_000, "minute": 60_000_000,
    "hour": 3_600_000_000,
    "day": 86_400_000_000,
}


class InvariantError(ValueError):
    """The declaration is not valid; raised before any job is started."""


@dataclass(frozen=True)
class Alias:
    """An event type under a name, with the members a query may use."""

    type: str
    schema: Mapping[str, str] = field(default_factory=dict)
    topic: str | None = None

    def __post_init__(self) -> None:
        for member, kind in self.schema.items():
            if kind not in MEMBER_TYPES:
                raise InvariantError(f"member {member!r}: unknown type {kind!r}")


@dataclass(frozen=True)
class Step:
    """One position of the sequence; several aliases mean OR."""

    aliases: tuple[str, ...]
    kind: str = ONCE
    negated: bool = False

    def __init__(self, *aliases: str, kind: str = ONCE, negated: bool = False):
        if not aliases:
            raise InvariantError("a step needs at least one alias")
        object.__setattr__(self, "aliases", tuple(aliases))
        object.__setattr__(self, "kind", kind)
        object.__setattr__(self, "negated", negated)

    @property
    def loop(self) -> bool:
        return self.kind != ONCE


def Not(*aliases: str) -> Step:
    """No such event may come between the neighbouring steps."""
    return Step(*aliases, negated=True)


def Or(*aliases: str) -> Step:
    return Step(*aliases)


def Plus(*aliases: str) -> Step:
    """One or more events, greedy."""
    return Step(*aliases, kind=PLUS)


def Star(*aliases: str) -> Step:
    """Zero or more events, greedy."""
    return Step(*aliases, kind=STAR)


def duration_us(text: str | int | float | None) -> int | None:
    """``"30 minutes"``, ``"500 msec"``, ``"1 hour"`` → microseconds; numbers are seconds."""
    if text is None:
        return None
    if isinstance(text, (int, float)):
        us = round(text * 1_000_000)
    else:
        m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", text)
        unit = m and (m[2] if m[2] in _UNIT_US else m[2].removesuffix("s"))
        if not m or unit not in _UNIT_US:
            raise InvariantError(f"cannot read duration {text!r}")
        us = int(m[1]) * _UNIT_US[unit]
    if us <= 0:
        raise InvariantError("a duration must be positive")
    return us


Clause = Predicate | bool


@dataclass
class Invariant:
    """``SEQ`` … ``WITHIN`` … ``WHERE`` … ``ON FULL MATCH`` … ``ON PREFIX MATCH`` ….

    ``on_full_match`` and the values of ``on_prefix_match`` state what must
    hold: a predicate, ``False`` (every such match is a violation) or ``True``
    (none is).  ``None`` means there is no clause.  Keys of ``on_prefix_match``
    are tuples of steps, a step being an alias or a tuple of aliases, or
    ``DEFAULT``.

    ``where_eval="deferred"`` tests a WHERE term at the last step unless it
    names a negated or repeated alias; ``"eager"`` tests it at the latest step
    it names.
    """

    name: str
    aliases: Mapping[str, Alias]
    seq: Sequence[Step | str]
    within: str | int | float | None = None
    where: Sequence[Predicate] | Predicate = ()
    on_full_match: Clause | None = None
    on_prefix_match: Mapping[Any, Clause] = field(default_factory=dict)
    where_eval: str = "deferred"
    all_matches: bool = False

    def __post_init__(self) -> None:
        self.steps = [Step(s) if isinstance(s, str) else s for s in self.seq]
        terms = [self.where] if isinstance(self.where, Predicate) else list(self.where)
        self.terms = [c for t in terms for c in conjuncts(t)]
        self.within_us = duration_us(self.within)
        if self.where_eval not in ("deferred", "eager"):
            raise InvariantError("where_eval must be 'deferred' or 'eager'")
        self._check_steps()
        self.step_of = {a: i for i, s in enumerate(self.steps) for a in s.aliases}
        for term in self.terms:
            self._check_types(term)
            self._check_reach(term)
        for clause in [self.on_full_match, *self.on_prefix_match.values()]:
            if isinstance(clause, Predicate):
                self._check_types(clause)
                if any(self.steps[self.step_of[a]].negated for a in aliases_of(clause)):
                    raise InvariantError("a verdict cannot name a negated alias, it never binds")
        self.prefixes = self._prefixes()
        self.step_terms = self._place_terms()

    # -- derived views -------------------------------------------------------

    @property
    def positive(self) -> list[int]:
        """Indexes of the steps that bind events."""
        return [i for i, s in enumerate(self.steps) if not s.negated]

    @property
    def types(self) -> list[str]:
        return sorted({self.aliases[a].type for s in self.steps for a in s.aliases})

    def step_types(self, i: int) -> list[str]:
        return sorted({self.aliases[a].type for a in self.steps[i].aliases})

    def negations_after(self, i: int) -> list[int]:
        """Negated steps directly after step ``i`` and before the next positive one."""
        out = []
        for j in range(i + 1, len(self.steps)):
            if not self.steps[j].negated:
                break
            out.append(j)
        return out

    @property
    def trailing_negation(self) -> bool:
        return self.steps[-1].negated

    def member_type(self, ref: Ref) -> str:
        return self.aliases[ref.alias].schema[ref.path]

    # -- checks --------------------------------------------------------------

    def _check_steps(self) -> None:
        if not self.steps:
            raise InvariantError("the sequence is empty")
        seen: set[str] = set()
        for step in self.steps:
            for a in step.aliases:
                if a not in self.aliases:
                    raise InvariantError(f"alias {a!r} is not declared")
                if a in seen:
                    raise InvariantError(f"alias {a!r} is used twice in the sequence")
                seen.add(a)
            if step.negated and step.loop:
                raise InvariantError("a negated step cannot be repeated")
        if self.steps[0].negated:
            raise InvariantError("the first step cannot be negated")
        if self.steps[0].loop:
            raise InvariantError("the first step cannot be repeated")
        if self.steps[-1].loop:
            raise InvariantError("the last step cannot be repeated")
        last_positive = self.steps[self.positive[-1]]
        if self.steps[-1].negated and last_positive.loop:
            raise InvariantError("a repeated step cannot be closed by a negation only")
        if self.steps[-1].negated and self.within_us is None:
            raise InvariantError("a trailing negation needs a time limit")
        if self.on_prefix_match and self.within_us is None:
            raise InvariantError("prefix clauses need a time limit")
        if self.all_matches and (self.within_us is None or self.steps[-1].negated or len(self.positive) < 2):
            raise InvariantError("all_matches needs a time limit and a closing step after the first")

    def _check_types(self, pred: Predicate) -> None:
        for r in refs(pred):
            if r.alias not in self.step_of:
                raise InvariantError(f"{r!r}: alias is not part of the sequence")
            if r.path not in self.aliases[r.alias].schema:
                raise InvariantError(f"{r!r}: member is not declared")
        for c in comparisons(pred):
            kinds = [self._kind(c.left), self._kind(c.right)]
            if isinstance(c.left, Literal) and isinstance(c.right, Literal):
                raise InvariantError(f"{c!r}: both sides are literals")
            if kinds[0] != kinds[1]:
                raise InvariantError(f"{c!r}: compares {kinds[0]} with {kinds[1]}")
            if "timestamp" in kinds:
                raise InvariantError(f"{c!r}: timestamps cannot be compared")
            if c.op not in ("=", "!=") and kinds[0] != "number":
                raise InvariantError(f"{c!r}: only numbers have an order")

    def _kind(self, side: Ref | Literal) -> str:
        if isinstance(side, Ref):
            return self.member_type(side)
        if isinstance(side.value, bool):
            return "bool"
        return "number" if isinstance(side.value, (int, float)) else "string"

    def _check_reach(self, term: Predicate) -> None:
        names = aliases_of(term)
        if not names:
            raise InvariantError(f"{term!r}: names no alias")
        special = [a for a in names if self.steps[self.step_of[a]].negated or self.steps[self.step_of[a]].loop]
        negated = [a for a in special if self.steps[self.step_of[a]].negated]
        if len({self.step_of[a] for a in negated}) > 1 or len(negated) > 1:
            raise InvariantError(f"{term!r}: names more than one negated alias")
        latest = max(self.step_of[a] for a in names)
        for a in special:
            if self.step_of[a] != latest:
                raise InvariantError(f"{term!r}: {a!r} is negated or repeated, so only earlier aliases may join it")

    def _prefixes(self) -> list[tuple[frozenset[int], Clause]]:
        """Explicit prefixes as sets of step indexes."""
        positive, seen, out = self.positive, set(), []
        for key, clause in self.on_prefix_match.items():
            if isinstance(key, str) and key == DEFAULT:
                continue
            key = (key,) if isinstance(key, str) else tuple(key)
            if not 0 < len(key) <= len(positive):
                raise InvariantError(f"prefix {key!r} has the wrong length")
            for part, i in zip(key, positive):
                names = {part} if isinstance(part, str) else set(part)
                if names != set(self.steps[i].aliases):
                    raise InvariantError(f"prefix {key!r} is not a leading part of the sequence")
            steps = frozenset(positive[: len(key)])
            if steps in seen:
                raise InvariantError(f"prefix {key!r} is repeated")
            seen.add(steps)
            out.append((steps, clause))
        return out

    def _place_terms(self) -> list[list[Predicate]]:
        """For every step, the WHERE terms tested there."""
        placed: list[list[Predicate]] = [[] for _ in self.steps]
        for term in self.terms:
            latest = max(self.step_of[a] for a in aliases_of(term))
            step = self.steps[latest]
            if self.where_eval == "deferred" and not step.negated and not step.loop:
                latest = self.positive[-1]
            placed[latest].append(term)
        return placed

    def key_classes(self) -> list[list[Ref]]:
        """Members that every event of one match must share.

        Each entry holds one member per step, tied together by equality terms
        that are tested at that step.  An event can then only ever meet events
        with the same value, so the value can partition the work.
        """
        classes = []
        for start in self._equality_refs(0):
            chosen: list[Ref | None] = [start] + [None] * (len(self.steps) - 1)
            for i in range(1, len(self.steps)):
                for term in self.step_terms[i]:
                    pair = self._equality(term, i)
                    if pair is None:
                        continue
                    here, there = pair
                    tied = chosen[self.step_of[there.alias]]
                    if tied is not None and tied.path == there.path:
                        chosen[i] = here
                        break
            if all(c is not None for c in chosen) and len(chosen) > 1 and self._one_member_per_type(chosen):
                classes.append(chosen)
        return classes

    def _one_member_per_type(self, chosen: list[Ref]) -> bool:
        per_type: dict[str, tuple[str, str]] = {}
        for i, ref in enumerate(chosen):
            member = (ref.path, self.member_type(ref))
            for t in self.step_types(i):
                if per_type.setdefault(t, member) != member:
                    return False
        return True

    def is_key_term(self, term: Predicate, i: int, classes: list[list[Ref]]) -> bool:
        """Whether sharing the key already makes ``term`` true at step ``i``."""
        pair = self._equality(term, i)
        return pair is not None and any(
            c[i].path == pair[0].path and c[self.step_of[pair[1].alias]].path == pair[1].path for c in classes
        )

    def _equality(self, term: Predicate, i: int) -> tuple[Ref, Ref] | None:
        """``(member of step i, member of an earlier step)`` if the term ties the two."""
        pairs = {}
        for c in [term] if isinstance(term, Comparison) else _same_pair(term):
            if c.op != "=" or not (isinstance(c.left, Ref) and isinstance(c.right, Ref)):
                return None
            sides = sorted((c.left, c.right), key=lambda r: self.step_of[r.alias])
            if self.step_of[sides[1].alias] != i or self.step_of[sides[0].alias] >= i:
                return None
            there, here = sides
            key = (self.step_of[there.alias], there.path, here.path, self.member_type(here))
            pairs[key] = (here, there)
        return next(iter(pairs.values())) if len(pairs) == 1 else None

    def _equality_refs(self, step: int) -> list[Ref]:
        out: dict[str, Ref] = {}
        for term in self.terms:
            for r in refs(term):
                if self.step_of[r.alias] == step:
                    out.setdefault(r.path, r)
        return list(out.values())


def _same_pair(term: Predicate) -> list[Comparison]:
    """The comparisons of an OR.  In ``a.k = b.k OR a.k = c.k`` with step ``(b|c)`` an
    alias stands for the current event whatever its type, so both sides are one equality."""
    if getattr(term, "op", None) == "or" and all(isinstance(p, Comparison) or p.op == "or" for p in term.parts):
        return list(comparisons(term))
    return [Comparison("and", Literal(0), Literal(0))]
