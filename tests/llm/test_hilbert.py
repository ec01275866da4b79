import itertools
import zlib
from collections import Counter

from pyspark.sql import functions as F
from tables import awkward, docs, empty, prose

from evwarden.llm.hilbert import hilbert_index, hilbert_shards, shard_table, write_shards


def test_curve_visits_every_cell_and_moves_by_one(spark):
    for n, bits in ((1, 4), (2, 3), (3, 2), (4, 2)):
        cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), [f"c{i}" for i in range(n)])
        index = hilbert_index([F.col(f"c{i}").cast("int") for i in range(n)], bits)
        rows = cells.withColumn("h", index).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(1 << n * bits))
        assert all(sum(abs(a - b) for a, b in zip(x[:n], y[:n])) == 1 for x, y in zip(rows, rows[1:]))


def check_law(rows, n, shards=8):
    counts = Counter(r.shard for r in rows)
    assert len(rows) == n and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def corpus(spark):
    rows = [(i, " ".join(prose(i % 40, i % 57)), f"site{i % 7}" if i % 3 else "hot") for i in range(403)]
    return docs(spark, rows).repartition(6)


def test_shards_are_even_and_follow_the_curve(spark):
    rows = shard_table(corpus(spark)).collect()
    check_law(rows, 403)
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)
    texts = {r.doc_id: r.text for r in corpus(spark).collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_reruns_agree(spark):
    assert sorted(map(str, shard_table(corpus(spark)).collect())) == sorted(map(str, shard_table(corpus(spark).repartition(3)).collect()))


def test_one_cell_holds_everything(spark):
    rows = docs(spark, [(7, "same", "a")] * 50)
    check_law(shard_table(rows).collect(), 50)


def test_awkward_rows(spark):
    rows = shard_table(awkward(spark)).collect()
    check_law(rows, 11)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    assert shard_table(empty(spark)).count() == 0
    out = hilbert_shards(awkward(spark))
    assert out.count() == 11 and out.columns.count("shard") == 1 and set(out.columns) >= {"row", "_tie", "fp", "curve", "slot"}


def test_only_built_in_functions(spark):
    plan = shard_table(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_files_have_narrow_ranges(spark, tmp_path):
    path = str(tmp_path / "shards")
    write_shards(hilbert_shards(corpus(spark).drop("_tie")), path)
    back = spark.read.parquet(path)
    assert back.count() == 403 and {r.shard for r in back.select("shard").distinct().collect()} == set(range(8))
    spread = back.groupBy("shard").agg((F.max("n_chars") - F.min("n_chars")).alias("w")).agg(F.avg("w")).first()[0]
    whole = back.agg(F.max("n_chars") - F.min("n_chars")).first()[0]
    assert spread < 0.9 * whole
