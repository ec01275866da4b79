"""Shards along a Hilbert curve over several metadata columns, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, NumericType, StringType

from evwarden.llm.common import stored, text_of

SHARDS = 8
#: Bits of each dimension on the curve.
BITS = 6
#: Bytes of a text column, after the prefix common to all, that take part in its order.
TEXT_BYTES = 6
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")


def _rotated(x: Column, by: Column, n: int, left: bool) -> Column:
    there, back = ("shiftleft", "shiftright") if left else ("shiftright", "shiftleft")
    both = F.call_function(there, x, by).bitwiseOR(F.call_function(back, x, F.lit(n) - by))
    return both.bitwiseAND(F.lit((1 << n) - 1))


def _table(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """The position on the Hilbert curve of the cell at these coordinates, each of ``bits`` bits.

    Level by level from the highest bits: the corner that the cell lies in is turned
    into the frame of the current sub-cube, its rank there (the inverse Gray code) gives the next digits of the
    index, and entry corner and direction of the next sub-cube follow from that rank.
    """
    n = len(cells)
    corners = range(1 << n)
    gray = [i ^ (i >> 1) for i in corners]
    rank_of = [gray.index(c) for c in corners]
    entry = [0 if i == 0 else gray[2 * ((i - 1) // 2)] for i in corners]

    def trailing_ones(i: int) -> int:
        return 0 if i % 2 == 0 else 1 + trailing_ones(i // 2)

    direction = [0 if i == 0 else trailing_ones(i - 1 if i % 2 == 0 else i) % n for i in corners]
    levels = []
    for level in reversed(range(bits)):
        corner = F.lit(0)
        for d, cell in enumerate(cells):
            bit = F.shiftright(cell, level).bitwiseAND(F.lit(1))
            corner = corner.bitwiseOR(F.shiftleft(bit, d))
        levels.append(corner)

    def step(state: Column, corner: Column) -> Column:
        turn = state["direction"] + F.lit(1)
        turned = _rotated(corner.bitwiseXOR(state["entry"]), turn % n, n, left=False)
        rank = F.element_at(_table(rank_of), turned + 1)
        enter = _rotated(F.element_at(_table(entry), rank + 1), turn % n, n, left=True)
        return F.struct(
            F.shiftleft(state["index"], n).bitwiseOR(rank.cast("bigint")).alias("index"),
            state["entry"].bitwiseXOR(enter).alias("entry"),
            ((state["direction"] + F.element_at(_table(direction), rank + 1) + F.lit(1)) % n).alias("direction"),
        )

    start = F.struct(F.lit(0).cast("bigint").alias("index"), F.lit(0).alias("entry"), F.lit(0).alias("direction"))
    return F.aggregate(F.array(*levels), start, step, lambda state: state["index"])


def _common_prefix(low: bytes, high: bytes) -> int:
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return n


def _measured(docs: DataFrame, columns: list[str]) -> dict[str, Column]:
    """Each column as a number that keeps its order."""
    texts = [c for c in columns if isinstance(docs.schema[c].dataType, (StringType, BinaryType))]
    ends = {}
    if texts:
        row = docs.agg(*(f(docs[c].cast("binary")).alias(f"{i}{k}") for i, c in enumerate(texts) for k, f in (("a", F.min), ("z", F.max)))).first()
        ends = {c: (bytes(row[f"{i}a"] or b""), bytes(row[f"{i}z"] or b"")) for i, c in enumerate(texts)}
    out = {}
    for c in columns:
        kind = docs.schema[c].dataType
        if c in ends:
            head = F.substring(docs[c].cast("binary"), _common_prefix(*ends[c]) + 1, TEXT_BYTES)
            out[c] = F.conv(F.rpad(F.hex(head), 2 * TEXT_BYTES, "0"), 16, 10).cast("double")
        elif isinstance(kind, (NumericType, BooleanType)):
            out[c] = docs[c].cast("double")
        else:  # dates and times
            out[c] = docs[c].cast("timestamp").cast("double")
    return out


def _bin(value: Column, cuts: list[float], low: int = 0) -> Column:
    """How many cuts lie at or below ``value``, by halving."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    return F.when(value < cuts[mid], _bin(value, cuts[:mid], low)).otherwise(_bin(value, cuts[mid + 1 :], low + mid + 1))


def quantised(docs: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """Each column cut at its approximate quantiles into ``2 ** bits`` cells; null is cell 0."""
    measures = _measured(docs, columns)
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    row = docs.agg(*(F.percentile_approx(m, shares, 10_000).alias(str(i)) for i, m in enumerate(measures.values()))).first()
    return [
        F.when(m.isNull(), 0).otherwise(_bin(m, sorted(set(row[str(i)] or [])))) for i, m in enumerate(measures.values())
    ]


def hilbert_shards(
    docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, shards: int = SHARDS, bits: int = BITS,
    id_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with curve, shard and slot: rows in the order of the curve, cut into runs of equal length.

    Row counts of shards differ by one at most.  Rows of one cell are ordered by a hash of the id and the id,
    so a cell that holds much of the table is divided like any other stretch of the curve; the order is total up to rows with
    equal ids.  The rows are dealt by range and sorted once, written, and numbered by
    their place in their part plus the rows of the parts before it; only one count for each part is broadcast.

    Nulls of a dimension share its first cell; an empty table gives no rows; columns named
    curve, shard or slot are replaced.
    """
    kept = [c for c in docs.columns if c not in ("curve", "shard", "slot")]
    curve = hilbert_index(quantised(docs, list(dimensions), bits), bits)
    whole = F.struct(*(docs[c] for c in kept)).alias("row")  # names of the table stay apart from those used here
    rows = docs.select(whole, curve.alias("curve"), F.xxhash64(docs[id_col]).alias("tie"))
    order = ["curve", "tie", f"row.`{id_col}`"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(rows.withColumn("place", F.monotonically_increasing_id()), "curve")
    part = F.shiftright("place", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("before"), total.alias("total"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = rows.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", rank)
    shard = F.expr(f"(rank * {shards}) div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return numbered.withColumn("shard", shard).select(
        "row.*", "curve", F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot")
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, its rows in the order of the curve, so that files have narrow ranges in every dimension."""
    sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row of ``docs``; null text has size 1 and checksum 0."""
    text = text_of(docs)
    rows = docs.select(
        "doc_id", "lang", "source", "n_chars",
        (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return hilbert_shards(rows, shards=shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )
