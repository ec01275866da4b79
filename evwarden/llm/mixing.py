"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.llm.common import stored, word_count

WEIGHTS = (5, 2, 1)
#: No source and no document gives more than this many times its words.
MAX_COPIES = 3
#: Documents rounded together; expected size of a block.
ROUNDED_TOGETHER = 8_192
TOLERANCE = 1e-9
MAX_STEPS = 60


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs).

    Sources in code point order, null last, get the weights in turn and share the sum of all sizes by weight.  A target
    stops at ``most`` times its source's size; what is left is shared by weight among the others, until
    no target is above: a target is the lesser of its limit and weight x level, with one level for
    all, found from running sums over the sources in the order of limit / weight.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level)
    rows = rows.withColumn("level", F.when(F.col("level") <= F.col("limit") / F.col("weight") * (1 + 1e-12), F.col("level")))
    rows = rows.withColumn("level", F.max("level").over(everything))
    target = F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.lit(0.0))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def balanced_rates(cells: DataFrame, constraints: dict[str, DataFrame], size: str = "size") -> DataFrame:
    """``cells`` with ``rate``: of all rates that meet the constraints, those nearest to 1 in relative entropy over tokens.

    ``constraints`` maps a column of ``cells`` to (level, target): the tokens that the
    cells of each level must give together.  The dual is convex and its solution
    tilts exponentially, rate = exp(sum of the multipliers of the cell's levels).  Newton steps
    run over the constraints of one column at a time, for which the Hessian is
    diagonal: a grouped sum of tilted tokens and a join, so neither levels nor cells pass through the driver,
    which sees the largest relative gap of each round.  A target of 0 gives rate 0.
    """
    now = stored(cells.withColumn("tilt", F.lit(0.0)), "tilt")
    goals = {c: stored(g.select(F.col("level").alias("goal_level"), "target"), "goals") for c, g in constraints.items()}
    tokens = F.sum(F.col(size) * F.exp("tilt")).alias("given")
    for _ in range(MAX_STEPS):
        gaps = []
        for column, goal in goals.items():
            have = now.groupBy(F.col(column).alias("have_level")).agg(tokens)
            step = have.join(goal, F.col("have_level").eqNullSafe(F.col("goal_level")), "left")
            gap = (F.coalesce("target", F.lit(0.0)) - F.col("given")) / F.col("given")
            newton = F.when(F.col("given") > 0, gap).otherwise(0.0)
            # far above the solution a full step is long; one of log 4 is enough there
            newton = F.when(F.coalesce("target", F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(F.least(newton, F.lit(math.log(4))))
            step = step.select("have_level", newton.alias("newton"))
            now = now.join(step, F.col(column).eqNullSafe(F.col("have_level"))).select(
                *cells.columns, (F.col("tilt") + F.col("newton")).alias("tilt"), F.abs("newton").alias("gap")
            )
            now = stored(now, "tilt")
            gaps.append(now.agg(F.max("gap")).first()[0] or 0.0)
            now = now.drop("gap")
        if max(gaps, default=0.0) <= TOLERANCE:
            break
    rate = F.exp("tilt")
    for column, goal in goals.items():
        empty = goal.where("target <= 0").select(F.col("goal_level").alias("none_level"))
        now = now.join(empty, F.col(column).eqNullSafe(F.col("none_level")), "left")
        rate = F.when(F.col("none_level").isNotNull(), F.lit(0.0)).otherwise(rate)
        now = now.withColumn("_rate", rate).drop("none_level")
        rate = F.col("_rate")
    return now.select(*cells.columns, rate.alias("rate"))


def _copies(sizes: np.ndarray, rates: np.ndarray, most: int) -> np.ndarray:
    """Whole copies: each rate rounded down or up, the words owed carried from document to document."""
    out = np.zeros(len(sizes), np.int64)
    owed = 0.0
    for i, (size, rate) in enumerate(zip(sizes.tolist(), rates.tolist())):
        if size <= 0:
            continue
        low = int(math.floor(rate + 1e-9))
        high = low if rate - low <= 1e-9 else low + 1
        owed += rate * size
        out[i] = min(max(round(owed / size), low), high, most)
        owed -= out[i] * size
    return out


def _rounding(most: int):
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "order", "id"], ascending=[False, True, True], kind="stable")
        rows["copies"] = _copies(rows["size"].to_numpy(), rows["rate"].to_numpy(), most)
        return rows[["id", "source", "size", "source_size", "target", "copies"]]

    return block


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES, together: int = ROUNDED_TOGETHER,
) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of ``docs``; size counts its words.

    Rates meet the targets of ``source_targets``; they are rounded in blocks of about ``together`` documents of
    one source, largest documents first, each rounding taking up what those before it owe, so a block misses its share
    by about half its smallest document.  The order is fixed by size, a hash of the id and the id: reruns agree.

    Null and wordless texts have size 0 and no copies; the null source is a source;
    repeated rows and null ids are rows like any other.  An empty table gives no rows; other columns are not read.
    """
    kind, source = (docs.schema[c].dataType.simpleString() for c in (id_col, source_col))
    rows = docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"))
    rows = stored(rows.withColumn("order", F.xxhash64("id")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    cells = stored(source_targets(sources, weights, most), "targets")
    goal = cells.select(F.col("source").alias("level"), "target")
    rates = balanced_rates(cells, {"source": goal}, "source_size")
    rates = stored(
        rates.select(F.col("source").alias("of_source"), "source_size", "target", "rate", F.ceil(F.col("n_docs") / together).alias("blocks")), "rates"
    )
    rows = rows.join(rates, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    rows = rows.withColumn("block", F.pmod(F.col("order"), F.col("blocks")))
    schema = f"id {kind}, source {source}, size bigint, source_size bigint, target double, copies bigint"
    return rows.groupBy("source", "block").applyInPandas(_rounding(most), schema)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns are those of ``docs``.

    Rows with the same id share the copies of that id: each gets those of one of them.
    """
    taken = mixed(docs, id_col, text_col, source_col, **options)
    plan = stored(taken.select(F.col("id").alias("_mix_id"), F.col("copies").alias("_mix_copies")), "copies")
    counts = plan.groupBy("_mix_id").agg(F.count("*").alias("_mix_n"), F.max("_mix_copies").alias("_mix_copies"))
    # a row for each document: no side of a known size, so texts are dealt out at every size
    rows = docs.join(counts.hint("merge"), F.col("_mix_id").eqNullSafe(docs[id_col]))
    several = counts.where("_mix_n > 1").select(F.col("_mix_id").alias("_mix_dup"))
    numbered = plan.join(several, F.col("_mix_id").eqNullSafe(F.col("_mix_dup"))).select(
        F.col("_mix_id").alias("_mix_key"), F.col("_mix_copies").alias("_mix_own"),
        F.row_number().over(Window.partitionBy("_mix_id").orderBy("_mix_copies")).alias("_mix_place"),
    )
    one = rows.where("_mix_n = 1").select(*docs.columns, "_mix_copies")
    many = rows.where("_mix_n > 1").withColumn("_mix_nth", F.row_number().over(Window.partitionBy("_mix_id").orderBy(text_col)))
    many = many.join(numbered, F.col("_mix_id").eqNullSafe(F.col("_mix_key")) & (F.col("_mix_nth") == F.col("_mix_place")))
    both = one.unionByName(many.select(*docs.columns, F.col("_mix_own").alias("_mix_copies")))
    return both.select(*docs.columns, F.explode(_range("_mix_copies")).alias("_mix_copy")).drop("_mix_copy")


def _range(column: str) -> Column:
    return F.array_repeat(F.lit(1), F.col(column).cast("int"))
