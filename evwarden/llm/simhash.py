"""Near-duplicate documents by SimHash fingerprints and multi-index hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwarden.llm.common import map_blocks, stored, text_of
from evwarden.llm.components import components

SEED = 42
WIDTH = 3
RADIUS = 3
#: Buckets of the segment tables with more entries are divided by further segments before their entries are compared.
BUCKET = 64
_HASHES = 16_384
#: Wide fingerprints: bits, segments to a table of segments, and bits of a segment. Each of the permutations of the bits is cut into segments.
WIDE = 512
SEGMENT = 24
PERMUTATIONS = 6

_SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, WIDE // 64, np.uint64)
_PLACES = np.random.default_rng(SEED).permuted(np.tile(np.arange(WIDE), (PERMUTATIONS, 1)), axis=1)[:, : WIDE // SEGMENT * SEGMENT].reshape(-1, SEGMENT)
_COUNTED = 255


def wide_bits(hashes: list[int]) -> np.ndarray:
    """The bits of a SimHash of ``WIDE`` bits over the different ``hashes``; one is set if it is set in over half of them."""
    values, counts = np.unique(np.array(hashes, np.uint64)), np.zeros(WIDE, np.int64)
    for at in range(0, len(values), _COUNTED):
        x = values[at : at + _COUNTED, None] + _SALTS
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ x >> np.uint64(31)).astype("<u8").view(np.uint8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint8)  # no more rows than a byte counts
    return (counts * 2 > len(values)).astype(np.uint8)


def wide_keys(bits: np.ndarray) -> tuple[int, list[int]]:
    """The first 64 bits as a signed number, and the key of each segment in the table of its own."""
    parts = np.packbits(bits[_PLACES], axis=1).astype(np.int64)
    values = parts @ (1 << 8 * np.arange(parts.shape[1])[::-1])
    return int(np.packbits(bits[:64]).view(">i8")[0]), ((np.arange(len(values)) << SEGMENT) + values).tolist()


def segment_pairs(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b, apart), a > b: each node with the least node of each segment's bucket, if ``radius`` or fewer of their 64 bits, ``apart``, differ.

    ``prints`` holds (node, fp, segments) as :func:`wide_keys` gives them. A bucket gives a pair for each member, whatever its size.
    """
    entries = prints.select("node", "fp", F.explode("segments").alias("key"))
    hub = F.min(F.struct("node", "fp")).over(Window.partitionBy("key"))
    pairs = entries.withColumn("hub", hub).select(F.col("node").alias("a"), F.col("hub.node").alias("b"), _distance("fp", "hub.fp").alias("apart"))
    return pairs.where((F.col("a") != F.col("b")) & (F.col("apart") <= radius)).distinct()


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The SimHash of one text, as a signed number of 64 bits.

    Words are lower-cased in A-Z only; a shingle is ``width`` words joined by a
    space, all of the words if there are fewer.  A bit is set if it is set in
    over half of the shingles' hashes, repeats included.  No words: zero.
    """
    words = text.encode().lower().split()
    if not words:
        return 0
    runs = [words[i:] for i in range(width)] if len(words) >= width else [[w] for w in words]
    counts, n, block = np.zeros(64, np.int64), 0, []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for shingle in zip(*runs):
        block.append(digest(join(shingle), SEED))
        if len(block) == _HASHES:
            counts += _bits(block)
            n, block = n + len(block), []
    if block:
        counts += _bits(block)
        n += len(block)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def _bits(hashes: list[int]) -> np.ndarray:
    rows = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(rows, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp) for each row of ``docs``; null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    return map_blocks(
        rows, lambda b: {"id": b["id"], "fp": [fingerprint(t, width) for t in b["text"]]}, f"id {kind}, fp bigint"
    )


def fingerprint_components(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, root) for the values of ``fps.fp`` that have a neighbour within ``radius`` bits, ``root`` naming the component.

    First each fingerprint is put under itself and under each value one bit away.
    Those that share a value are at most two bits apart and at most 65, and each
    links to the smallest of them only: a dense group becomes one component
    without any pairs being listed.

    Then the segment tables.  Of ``radius + 1 >> 1`` segments, one differs by one bit at
    most.  A table holds each segment's value; a look-up also takes the values
    reached by clearing one set bit (the other end of a link looks up the reverse case).
    Only pairs from different components of the first step are fetched, and
    verified over all 64 bits.  A bucket with more than ``bucket`` entries of
    several components is divided by the segments of the rest in the same way.
    No bucket is capped.
    """
    distinct = stored(fps.select("fp").where("fp is not null").distinct(), "fingerprints")
    flips = F.explode(F.array(*[F.lit(m) for m in [0, *(_signed(1 << i) for i in range(64))]]))
    # the table is small before it grows 65 times, so it is dealt out first
    around = distinct.repartition("fp").select("fp", flips.alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))
    low = F.min("fp").over(Window.partitionBy("key"))  # at most 65 rows each
    members = around.select(F.col("fp").alias("a"), low.alias("b")).where("a != b")
    close = stored(members.distinct(), "near")
    dense = components(close)
    known = distinct.join(dense.withColumnRenamed("node", "fp"), "fp", "left")
    known = known.select("fp", F.coalesce("root", "fp").alias("part"))
    far = _segment_links(known, radius, bucket)
    return components(close.union(far)).withColumnRenamed("node", "fp")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _entries(rows: DataFrame, segments: list[tuple[int, int]], prefix: Column | None = None) -> DataFrame:
    """A row for each key of each segment: ``stored`` marks the value itself, the others have one set bit cleared."""
    keys = []
    for n, (start, width) in enumerate(segments):
        value = F.shiftrightunsigned("fp", start).bitwiseAND(F.lit((1 << width) - 1))
        cleared = [
            F.when(value.bitwiseAND(F.lit(1 << i)) != 0, value.bitwiseXOR(F.lit(1 << i))) for i in range(width)
        ]
        keys += [F.struct(F.lit(n).alias("seg"), k.alias("value"), F.lit(j == 0).alias("home")) for j, k in enumerate([value, *cleared])]
    out = rows.select(*rows.columns, F.explode(F.array(*keys)).alias("k")).where("k.value is not null")
    outer = [] if prefix is None else [prefix]
    return out.select("fp", "part", *outer, "k.seg", "k.value", "k.home")


def _segment_links(known: DataFrame, radius: int, bucket: int) -> DataFrame:
    """(a, b): pairs of fingerprints of different parts within ``radius`` bits."""
    count = (radius + 2) // 2
    edges = [64 * i // count for i in range(count + 1)]
    segments = [(edges[i], edges[i + 1] - edges[i]) for i in range(count)]
    entries = _entries(known, segments)
    keys = ["seg", "value"]
    buckets = stored(_mixed(entries, keys), "buckets")
    live = stored(entries.join(buckets, keys), "entries")
    small, large = live.where(F.col("n") <= bucket), live.where(F.col("n") > bucket)
    links = _verified(small, keys, radius)
    for n, (start, width) in enumerate(segments):
        # the rest of the bits, in segments of half the width
        rest = [(at, width // 2) for s, w in segments if s != start for at in (s, s + width // 2)]
        outer = F.struct("seg", "value", F.col("home").alias("at_home")).alias("outer")
        finer = _entries(large.where(F.col("seg") == n).select("fp", "part", outer), rest, F.col("outer"))
        finer = finer.select(
            "fp", "part", F.col("outer.seg").alias("seg0"), F.col("outer.value").alias("value0"),
            (F.col("home") & F.col("outer.at_home")).alias("home"), "seg", "value",
        )
        by = ["seg0", "value0", "seg", "value"]
        finer = finer.join(_mixed(finer, by), by)
        links = links.union(_verified(finer, by, radius, any_home=True))
    return stored(links.distinct(), "links")


def _mixed(entries: DataFrame, keys: list[str]) -> DataFrame:
    """The buckets with fingerprints of more than one part."""
    return (
        entries.groupBy(*keys)
        .agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n"))
        .where("lo != hi")
        .select(*keys, "n")
    )


def _verified(entries: DataFrame, keys: list[str], radius: int, any_home: bool = False) -> DataFrame:
    """Pairs of one bucket from different parts, complete distance checked.  Two look-ups without the entry itself need no comparison."""
    a = entries.select(*keys, F.col("fp").alias("a"), F.col("part").alias("pa"), F.col("home").alias("ha"))
    b = entries.select(*keys, F.col("fp").alias("b"), F.col("part").alias("pb"), F.col("home").alias("hb"))
    if not any_home:
        b = b.where("hb")
    pairs = a.join(b, keys).where((F.col("pa") != F.col("pb")) & (_distance("a", "b") <= radius))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def simhash_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, width: int = WIDTH
) -> DataFrame:
    """(id, fp, component) for each row of ``docs``.

    ``component`` is the smallest id of the rows reachable over links of at most ``radius`` bits.
    Null text is empty text; texts without words have fingerprint zero and are linked like
    any other.  Rows with a null id are kept; they take part, but name a component only as null where no
    row of it has an id.  Repeated rows stay repeated.  An empty table gives no rows; other columns are not read.
    """
    rows = stored(fingerprints(docs, id_col, text_col, width), "simhash")
    named = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "named")
    roots = stored(fingerprint_components(named, radius), "roots")
    linked = named.join(roots, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("of_root"))
    moved = stored(linked.join(least, "root").select("fp", F.col("of_root")), "classes")
    classes = named.join(moved, "fp", "left").select("fp", F.coalesce("of_root", "least").alias("component"))
    return rows.join(classes, "fp").select("id", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (a row without id only if no other has one).

    Rows with the same id are one document; one of them stays.  Columns are those of ``docs``, whatever their names.
    """
    return one_row_each(docs, simhash_duplicates(docs, id_col, text_col, radius), id_col)


def one_row_each(docs: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``docs`` whose id names the component that ``classes`` (id, component) puts them in, one for each id."""
    first = F.max(F.col("id").eqNullSafe(F.col("component"))).alias("first")
    ids = classes.groupBy(F.col("id").alias("_keep_id")).agg(F.count("*").alias("_keep_n"), first)
    keep = stored(ids.where("first").drop("first"), "keepers")
    # as many keepers as groups: no side of a known size, so texts are dealt out at every size
    kept = docs.join(keep.hint("merge"), F.col("_keep_id").eqNullSafe(docs[id_col]))
    once = kept.where("_keep_n = 1").select(*docs.columns)
    again = kept.where("_keep_n > 1").dropDuplicates([id_col]).select(*docs.columns)
    return once.unionByName(again)
