"""What several operators share: reading tables, word splitting, names that cannot clash."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from evwarden.sinks.scratch import stored

__all__ = ["ROWS_PER_BLOCK", "WORD_BREAK", "map_blocks", "stored", "table", "text_of", "word_count"]

#: The white space that separates words.
WORD_BREAK = r"[\x20\x09-\x0D]"
#: Rows that a task turns into Python objects at a time.
ROWS_PER_BLOCK = 256


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(df[column], F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words; null counts as none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def map_blocks(
    df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str, at_a_time: int = ROWS_PER_BLOCK
) -> DataFrame:
    """``df`` run through ``rows`` in tasks, a block of ``at_a_time`` rows as lists of columns at a time.

    A task holds one Arrow batch and the objects of one block, never a partition.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_a_time):
                part = batch.slice(at, at_a_time)
                out = rows({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)

