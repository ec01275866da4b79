"""Connected components of an edge table, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwarden.llm.common import stored

#: A round over few edges is cut into few tasks, so that it writes few files: one for so many edges, and no fewer than ``TASKS``.
EDGES_PER_TASK = 20_000
TASKS = 6


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``: ``root`` is the smallest node that can be reached from it.

    Alternates the large-star and small-star rounds.  A round takes the minimum of
    each node's neighbours with map-side combine and joins it back, so the
    neighbours of a hub never meet in one task.  Each round is written to the
    shared folder, which also ends its lineage; the driver sees a count and a
    checksum of each.  By the count a round gets its tasks, as many as there are
    partitions for a large table.  Null ends and self loops are ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    now = stored(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        tasks = max(TASKS, -(-mark[0] // EDGES_PER_TASK))
        now = stored(_small_star(_large_star(now, tasks), tasks), "edges")
        mark, before = _mark(now), mark
        if mark == before:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    own = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return spark.createDataFrame([], roots.schema) if not mark[0] else roots.union(own)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.coalesce(tasks).distinct().coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks)
