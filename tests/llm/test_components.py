import random
import uuid

import pytest

from evwarden.llm import components as C
from evwarden.sinks import scratch


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    """A folder of the test's own for stored tables, and many partitions that Spark doesn't put together."""
    monkeypatch.setattr(scratch, "scratch_dir", lambda _, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield tmp_path
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def graph(spark):
    draw = random.Random(1)
    pairs = [(draw.randrange(900), draw.randrange(900)) for _ in range(350)] + [(1_000 + i, 1_001 + i) for i in range(40)]
    root = {x: x for p in pairs if p[0] != p[1] for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return spark.createDataFrame(pairs, "a long, b long"), {x: find(x) for x in root}


def rounds(shared):
    """Files of each table of edges, in the order they were written."""
    tables = sorted(shared.glob("edges-*/table"), key=lambda t: (t / "_SUCCESS").stat().st_mtime_ns)
    return [len(list(t.glob("part-*"))) for t in tables]


def test_rounds_over_few_edges_write_few_files(spark, shared):
    edges, want = graph(spark)
    assert {r.node: r.root for r in C.components(edges).collect()} == want
    files = rounds(shared)
    assert len(files) > 3 and max(files[1:]) <= 8


def test_rounds_over_many_edges_keep_their_partitions(spark, shared, monkeypatch):
    monkeypatch.setattr(C, "EDGES_PER_TASK", 1)
    edges, want = graph(spark)
    assert {r.node: r.root for r in C.components(edges).collect()} == want
    assert max(rounds(shared)[1:]) > 8
