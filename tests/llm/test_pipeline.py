from collections import Counter

import corpus_pipeline
import pytest
from tables import docs, prose

from evwarden.llm.queries import ORACLES, QUERIES


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "benchmark_passages", "source_mixture", "shards"]
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)] and set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    item = prose(999, 24)
    rows = [(i, " ".join(prose(i, 120)), "abc"[i % 3]) for i in range(90)]
    rows += [(200 + i, rows[5][1], "a") for i in range(20)]
    rows += [(300, "too short", "a"), (301, "again and again " * 60, "b"), (302, None, None), (303, "", "a")]
    rows += [(400, " ".join(prose(400, 60) + item + prose(401, 60)), "a")]
    path = tmp_path_factory.mktemp("tables")
    keep = ["doc_id", "text", "lang", "source", "n_chars"]
    docs(spark, rows).select(*keep).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_whole_pipeline(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = Counter(r.doc_id for r in rows)
    assert not {300, 301, 302, 303, 400} & set(ids) and not any(200 <= i < 220 for i in ids)
    assert set(ids) <= set(range(90)) and max(ids.values()) <= 3
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    words = Counter()
    for r in rows:
        words[r.source] += len(r.text.split())
    total = 90 * 120
    assert all(abs(words[s] - total * w / 8) <= 60 for s, w in zip("abc", (5, 2, 1)))


def test_every_stage_keeps_the_columns_of_documents(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, table, folder).columns == table.columns, name
        assert function(spark, table.limit(0), folder).count() == 0, name


def test_stages_keep_clean_documents(spark, folder):
    table = spark.read.parquet(f"{folder}/documents.parquet")
    clean = set(range(90))
    for name in ("quality_rules", "near_duplicates", "benchmark_passages"):
        kept = {r.doc_id for r in stage(name)(spark, table, folder).select("doc_id").collect()}
        assert clean <= kept, name
