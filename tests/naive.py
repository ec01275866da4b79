"""Row-by-row reference matcher for small inputs, written from the rules only."""

from evwarden.predicates import Comparison, Literal, aliases_of

_CMP = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}


def _number(v):
    try:
        return float(v)
    except (TypeError, ValueError):
        return 0.0


def member(content, path, kind):
    v = content
    for part in path.split("."):
        v = v.get(part) if isinstance(v, dict) else None
    if v is None:
        return None
    if kind == "number":
        return _number(v)
    if kind == "bool":
        return v is True or v == "true" or (not isinstance(v, (bool, str)) and v != 0)
    return str(v)


def holds(inv, pred, event_of):
    if isinstance(pred, Comparison):
        sides = []
        for s in (pred.left, pred.right):
            if isinstance(s, Literal):
                sides.append(s.value)
            else:
                e = event_of(s.alias)
                sides.append(None if e is None else member(e["content"], s.path, inv.member_type(s)))
        return None not in sides and _CMP[pred.op](*sides)
    parts = [holds(inv, p, event_of) for p in pred.parts]
    return all(parts) if pred.op == "and" else any(parts)


def fits(inv, i, event, bound):
    if event["type"] not in inv.step_types(i):
        return False

    def event_of(alias):
        j = inv.step_of[alias]
        if j == i:
            return event
        b = bound.get(j)
        return b[0] if isinstance(b, list) else b

    return all(holds(inv, t, event_of) for t in inv.step_terms[i])


def matches(inv, events):
    """``(kind, start_seq, end_seq, {step: event or [events]})`` for every decided start."""
    events = sorted(events, key=lambda e: (e["us"], e["seq"]))
    out = []
    for n, start in enumerate(events):
        if fits(inv, 0, start, {}):
            out += _run(inv, start, events[n + 1 :])
    return out


def _run(inv, start, later):
    pos = inv.positive
    limit = None if inv.within_us is None else start["us"] + inv.within_us
    bound = {0: start}
    if len(inv.steps) == 1:
        return [("full", start["seq"], start["seq"], bound)]
    at = 0  # index in ``pos`` of the last step entered
    found = []
    for e in later:
        if limit is not None and e["us"] >= limit:
            break
        here = pos[at]
        if inv.steps[here].loop and fits(inv, here, e, bound):
            bound.setdefault(here, []).append(e)
            continue
        here_open = inv.steps[here].kind == "plus" and here not in bound
        # steps this event may enter: the next one, and those after skippable repetitions
        target = None
        k = at + 1
        while k < len(pos) and not here_open:
            if fits(inv, pos[k], e, bound):
                target = k
                break
            if inv.steps[pos[k]].kind != "star":
                break
            k += 1
        if target is not None:
            step = pos[target]
            if target == len(pos) - 1 and not inv.trailing_negation:
                found.append(("full", start["seq"], e["seq"], {**bound, step: e}))
                if inv.all_matches:
                    continue
                return found
            at = target
            bound[step] = [e] if inv.steps[step].loop else e
            continue
        active = inv.negations_after(here)
        following = pos[at + 1] if at + 1 < len(pos) else None
        if following is not None and inv.steps[following].kind == "star":
            active = active + inv.negations_after(following)
        if any(fits(inv, j, e, bound) for j in active):
            return found
    if found or limit is None:
        return found
    complete = inv.trailing_negation and at == len(pos) - 1
    return [("full" if complete else "timeout", start["seq"], None, bound)]


def broken(inv, match):
    kind, _, _, bound = match
    if kind == "full":
        clause = inv.on_full_match
    else:
        clause = inv.on_prefix_match.get("DEFAULT")
        for steps, c in inv.prefixes:
            if steps == frozenset(bound):
                clause = c
    if clause is None:
        return False
    if isinstance(clause, bool):
        return not clause
    return not _verdict(inv, clause, bound)


def _verdict(inv, pred, bound):
    if not isinstance(pred, Comparison):
        parts = [_verdict(inv, p, bound) for p in pred.parts]
        return all(parts) if pred.op == "and" else any(parts)
    lists = []
    for s in (pred.left, pred.right):
        if isinstance(s, Literal):
            lists.append([s.value])
            continue
        evs = bound.get(inv.step_of[s.alias], [])
        evs = [e for e in (evs if isinstance(evs, list) else [evs]) if e["type"] == inv.aliases[s.alias].type]
        lists.append([member(e["content"], s.path, inv.member_type(s)) for e in evs])
    left, right = lists
    return bool(left and right) and all(
        x is not None and y is not None and _CMP[pred.op](x, y) for x in left for y in right
    )


def violations(inv, events):
    return [m for m in matches(inv, events) if broken(inv, m)]
