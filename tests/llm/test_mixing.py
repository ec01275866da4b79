import math
import random

import pytest
from tables import awkward, docs, empty, prose

from evwarden.llm.mixing import balanced_rates, mixed, mixture, source_targets


def naive_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target = dict.fromkeys(names, 0.0)
    left, free = float(sum(sizes.values())), set(names)
    while free and left > 1e-9:  # share what is left by weight, stop at the limit, share the excess again
        share = left / sum(weight[s] for s in free)
        given = {s: min(share * weight[s], 3 * sizes[s] - target[s]) for s in free}
        for s, g in given.items():
            target[s] += g
        left -= sum(given.values())
        free = {s for s in free if target[s] < 3 * sizes[s] - 1e-9}
    return target


def test_targets(spark):
    draw = random.Random(3)
    cases = [{f"s{i}": draw.choice([0, 1, 5, 50, 1000, 7000]) for i in range(n)} for n in (1, 2, 5, 9, 14)]
    cases += [{"a": 0, None: 0}, {None: 10}, {"é": 4, "z": 100, "Z": 1, None: 50}]
    for sizes in cases:
        table = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, source_size long, n_docs long")
        got = {r.source: r.target for r in source_targets(table).collect()}
        want = naive_targets(sizes)
        assert got == {s: pytest.approx(t, abs=1e-6) for s, t in want.items()}, sizes


def test_rates_meet_the_constraints_with_least_entropy(spark):
    cells = [("a", "x", 100), ("a", "y", 300), ("b", "x", 50), ("b", "y", 10), (None, "x", 40)]
    table = spark.createDataFrame(cells, "source string, lang string, size long")
    goals = {
        "source": spark.createDataFrame([("a", 200.0), ("b", 120.0), (None, 80.0)], "level string, target double"),
        "lang": spark.createDataFrame([("x", 180.0), ("y", 220.0)], "level string, target double"),
    }
    rate = {(r.source, r.lang): r.rate for r in balanced_rates(table, goals).collect()}
    given = {k: sum(n * rate[s, g] for s, g, n in cells if k in ((0, s), (1, g))) for k in ((0, "a"), (0, "b"), (0, None), (1, "x"), (1, "y"))}
    assert given == {(0, "a"): pytest.approx(200), (0, "b"): pytest.approx(120), (0, None): pytest.approx(80), (1, "x"): pytest.approx(180), (1, "y"): pytest.approx(220)}
    # the tilt is a product of a factor for the source and one for the language
    assert math.isclose(rate["a", "x"] * rate["b", "y"], rate["a", "y"] * rate["b", "x"], rel_tol=1e-6)


def test_far_and_empty_targets(spark):
    table = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 0), ("d", 5)], "source string, size long")
    goal = spark.createDataFrame([("a", 0.5), ("b", 30.0), ("c", 0.0), ("d", 0.0)], "level string, target double")
    rate = {r.source: r.rate for r in balanced_rates(table, {"source": goal}).collect()}
    assert rate["a"] == pytest.approx(0.0005) and rate["b"] == pytest.approx(3) and rate["d"] == 0


def corpus(spark):
    draw = random.Random(8)
    return docs(spark, [(i, " ".join(prose(i, draw.choice([1, 5, 30, 200]))), draw.choice(["hot"] * 5 + ["a", "b", "c", None])) for i in range(600)])


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = mixed(corpus(spark), together=50).collect()
    assert len(rows) == 600 and rows and sorted(rows) == sorted(mixed(corpus(spark).repartition(5), together=50).collect())
    for source in ("hot", "a", "b", "c", None):
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= max(30, 0.01 * own[0].target)
    assert all(0 <= r.copies <= 3 for r in rows)


def test_awkward_rows(spark):
    rows = mixed(awkward(spark)).collect()
    assert len(rows) == 11 and all(r.copies == 0 for r in rows if r["size"] == 0)
    assert mixed(empty(spark)).count() == 0 and mixture(empty(spark)).count() == 0
    only = docs(spark, [(1, None, "a"), (2, "", "b")])
    assert [(r.target, r.copies) for r in mixed(only).collect()] == [(0.0, 0)] * 2


def test_mixture_repeats_rows(spark):
    table = corpus(spark).union(docs(spark, [(9_000, "again and again", "a")] * 4))
    plan = mixed(table).collect()
    out = mixture(table)
    assert out.columns == table.columns
    times = {}
    for r in out.select("doc_id").collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    want = {}
    for r in plan:
        want[r.id] = want.get(r.id, 0) + r.copies
    assert times == {i: n for i, n in want.items() if n}
