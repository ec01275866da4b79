"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

SimHash fingerprints of the shingles meet by multi-index hashing (:func:`fingerprint_links`); least hashes find what that
leaves between its classes (:func:`near_roots`). Every link is compared exactly.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evwarden.llm.common import map_blocks, stored, text_of
from evwarden.llm.components import components
from evwarden.llm.simhash import segment_pairs, wide_bits, wide_keys

WIDTH = 5
SIMILAR = 0.8
#: Sets of sizes s and t are similar if they differ in no more than (s + t) / APART elements.
APART = 9
#: Fingerprints of a text, and least hashes that make up one. At a similarity of 0.8 one or more are equal in 0.999 of all pairs.
BANDS = 18
ROWS = 5
SEED = 42
#: Bits of 64 by which SimHash fingerprints of texts that are compared may differ: at a similarity of 0.8 it is more in 0.0003 of all pairs.
RADIUS = 20
#: Texts to fetch are sent to the tasks as a list of hashes up to so many, beyond that texts and hashes are dealt out.
SENT_NODES = 2_000_000

_DRAWS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64)
_FACTORS, _SHIFTS = _DRAWS[0] | np.uint64(1), _DRAWS[1]
_HASHES = 256
#: Shingle sets that a task keeps while it compares pairs, and pairs with their texts that it takes at a time.
_KEPT = 64
_PAIRS = 64


def _hashes(words: list[bytes], width: int) -> list[int]:
    """Hashes of the shingles of ``words``, repeats included; fewer words than ``width`` are one shingle."""
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        return [digest(join(words), SEED)]
    return [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(width)))]


def shingles(text: str, width: int = WIDTH) -> set[int]:
    """Hashes of all runs of ``width`` words, in lower case of A-Z; a text without words has the one of no words."""
    return set(_hashes(text.encode().lower().split(), width))


def similarity(a: set[int], b: set[int]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def least_hashes(hashes: list[int]) -> np.ndarray:
    """The least value of each of the hash functions over ``hashes``."""
    values, least = np.array(hashes, np.uint64)[:, None], np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(values), _HASHES):
        np.minimum(least, (values[at : at + _HASHES] * _FACTORS + _SHIFTS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """The fingerprints, as signed numbers of 64 bits."""
    part = least.astype("<u8").reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(part[i].tobytes(), i)) for i in range(BANDS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def text_bands(text: str) -> list[int]:
    return band_keys(least_hashes(_hashes(text.encode().lower().split(), WIDTH)))


def fingerprint_links(prints: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b): nodes that are near copies, by multi-index hashing of SimHash fingerprints.

    ``prints`` holds (node, fp, segments): a hash of a text, each once, and the SimHash of its shingles as ``simhash.wide_keys`` gives it;
    ``docs`` the texts. A text is compared with the least of the nodes it meets, then with the one of fewest differing bits that this
    leaves in another component, so there are at most two pairs a text; what else there is to find is left to :func:`near_roots`.
    """
    pairs = stored(segment_pairs(prints, RADIUS), "met")

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "pairs")
        texts = _texts(docs, text_col, pairs.select("a").union(pairs.select("b")).distinct())
        return stored(_compared(pairs, texts, False), "compared").where("same").select("a", "b")

    least = pairs.groupBy("a").agg(F.min("b").alias("b"))
    close = linked(least)
    parts, rest = components(close), pairs.join(least, ["a", "b"], "left_anti")
    for end in "ab":
        part = parts.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        rest = rest.join(part, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    nearest = rest.where("root_a != root_b").groupBy("a").agg(F.min(F.struct("apart", "b")).alias("to"))
    return close.union(linked(nearest.select("a", F.col("to.b").alias("b"))))


def near_roots(bands: DataFrame, docs: DataFrame, text_col: str = "text", links: DataFrame | None = None) -> DataFrame:
    """(node, root) for the nodes that are near copies of another; ``root`` is the least node of the component.

    ``links`` (a, b) are near copies found before; a bucket whose members they make one component is not looked at.
    ``bands`` holds (node, keys): a hash of a text, each once, and its fingerprints; ``docs`` the texts. Texts with a fingerprint in common form
    a bucket. Each member is compared exactly with the hub of its bucket, the member that shares most with others, and what the two do not have
    in common is kept. Two members that are similar to each other but not both to the hub must have much of these differences in common, so
    further pairs come from the rarest differences of each member to a hub: every pair of a bucket that is similar is found, while
    the pairs of a large group are never listed. Nothing depends on the size of a bucket.
    """
    if links is None:
        bands, links = bands.withColumn("part", F.col("node")), docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    else:
        bands = bands.join(components(links), "node", "left").select("node", "keys", F.coalesce("root", "node").alias("part"))
    entries = stored(bands, "bands").select("node", "part", F.explode("keys").alias("key"))
    shared = entries.groupBy("key").agg(F.count("*").alias("n"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    live = stored(entries.join(shared.where("lo != hi").select("key", "n"), "key").drop("part"), "shared")
    weight = live.groupBy("node").agg(F.sum("n").alias("weight"))
    first = F.max(F.struct("weight", "node")).alias("top")
    hubs = live.join(weight, "node").groupBy("key").agg(first).select("key", F.col("top.node").alias("hub"))
    pairs = live.join(hubs, "key").where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = stored(pairs, "pairs")
    texts = _texts(docs, text_col, pairs.select("a").union(pairs.select("b")).distinct())
    met = stored(_compared(pairs, texts, True), "compared")
    close = met.where("same").select("a", "b")
    parts = components(links.union(close))
    further = stored(_further(met, parts), "further")
    far = stored(_compared(further, texts, False), "far").where("same").select("a", "b")
    return components(links.union(close).union(far))


def _texts(docs: DataFrame, text_col: str, nodes: DataFrame) -> DataFrame:
    """(node, text) for the wanted nodes, each text once."""
    nodes = stored(nodes.toDF("node"), "wanted")
    text = text_of(docs, text_col)
    keyed = docs.select(F.xxhash64(text).alias("node"), text.alias("text"))
    wanted = F.broadcast(nodes) if nodes.count() <= SENT_NODES else nodes.hint("merge")
    return stored(keyed.join(wanted, "node").dropDuplicates(["node"]), "texts")


def _compared(pairs: DataFrame, texts: DataFrame, differences: bool) -> DataFrame:
    """(a, b, same, size_a, size_b, apart) of pairs (a, b): whether their texts are near copies, the sizes of their sets, and the elements that one of them alone has."""

    def rows(block: dict[str, list]) -> dict[str, list]:
        kept: OrderedDict = OrderedDict()

        def of(node, text):
            if node not in kept:
                kept[node] = shingles(text)
                if len(kept) > _KEPT:
                    kept.popitem(last=False)
            kept.move_to_end(node)
            return kept[node]

        out: dict[str, list] = {c: [] for c in ("same", "size_a", "size_b", "apart")}
        for a, s, b, t in zip(*(block[c] for c in ("a", "text_a", "b", "text_b"))):
            x, y = of(a, s), of(b, t)
            apart = x ^ y
            out["same"].append(APART * len(apart) <= len(x) + len(y))
            out["size_a"].append(len(x))
            out["size_b"].append(len(y))
            out["apart"].append(np.array(list(apart), np.uint64).view(np.int64) if differences else None)
        return {"a": block["a"], "b": block["b"]} | out

    for end in "ab":
        side = texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
        pairs = pairs.join(side.hint("merge"), end)
    return map_blocks(pairs, rows, "a bigint, b bigint, same boolean, size_a int, size_b int, apart array<bigint>", _PAIRS)


def _further(met: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b): pairs of different components that may be similar, from the differences ``apart`` of members ``a`` to hubs ``b``.

    For members p and q of sizes s and t with differences P and Q to a hub of size h, P ^ Q is what p and q do not have in common, so they are
    similar only if ``2 * |P & Q| >= |P| + |Q| - (s + t) / 9``. One of them, q, is not similar to the hub: ``|Q| > (t + h) / 9``. So more than
    ``(|P| + (h - s) / 9) / 2`` elements of P are in Q, and ``|Q| - t / 4`` of Q or more in P. In one order of all elements, rare ones first, the two
    then share one of the first elements: of P as many as leave fewer than that, and of Q likewise.
    """
    mixed = met.groupBy("b").agg(F.count("*").alias("n"), F.bool_and("same").alias("all")).where("n > 1 and not all").select("b")
    members = met.where(F.size("apart") > 0).join(mixed, "b", "left_semi")
    members = members.join(parts.select(F.col("node").alias("a"), "root"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    count, size, hub = F.size("apart"), F.col("size_a"), F.col("size_b")
    half = count - F.floor((APART * count + hub - size) / (2 * APART) + 1e-6)  # of whole numbers by 18: rounding moves none
    most = F.least(count, F.floor(size / 4) + 1)
    members = members.select("b", "a", "same", "size_a", "root", count.alias("count"), half.alias("half"), most.alias("most"), "apart")
    members = stored(members, "members")
    tokens = members.select("b", "a", F.explode("apart").alias("token"))
    often = tokens.groupBy("b", "token").agg(F.count("*").alias("often")).where("often > 1")
    mine = Window.partitionBy("b", "a")  # the differences of one member
    place = F.row_number().over(mine.orderBy("often", "token")) - F.count("*").over(mine)
    ranked = tokens.join(often, ["b", "token"]).select("b", "a", "token", place.alias("place"))
    ranked = ranked.join(members.drop("apart"), ["b", "a"]).withColumn("place", F.col("place") + F.col("count"))
    ranked = stored(ranked.where((F.col("place") <= F.col("half")) | (~F.col("same") & (F.col("place") <= F.col("most")))), "ranked")
    near = F.col("place") <= F.col("half")
    of = lambda end: [F.col(c).alias(f"{end}_{c}") for c in ("same", "root", "size_a", "count", "place")]
    one = ranked.where(near).select("b", "token", F.col("a").alias("p"), *of("p"))
    two = ranked.where("not same").select("b", "token", F.col("a").alias("q"), near.alias("q_near"), *of("q"))
    fits = (F.col("p_root") != F.col("q_root")) & (F.least("p_size_a", "q_size_a") >= SIMILAR * F.greatest("p_size_a", "q_size_a"))
    # with both sizes known, more must be common, and the rarest common element comes so early that as many can follow
    common = (F.col("p_count") + F.col("q_count") - (F.col("p_size_a") + F.col("q_size_a")) / APART) / 2 - 1e-6
    for end in "pq":
        fits = fits & (F.col(f"{end}_place") <= F.col(f"{end}_count") - F.ceil(common) + 1)
    found = one.join(two, ["b", "token"]).where(fits & (F.col("p_same") | (F.col("q_near") & (F.col("p") < F.col("q")))))
    found = found.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    known = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.join(known, ["a", "b"], "left_anti")


def _scan(block: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {"id": block["id"], "content": block["content"], "fp": [], "segments": [], "keys": []}
    for text in block["text"]:
        hashes = _hashes(text.encode().lower().split(), WIDTH)
        fp, segments = wide_keys(wide_bits(hashes))
        out["fp"].append(fp)
        out["segments"].append(segments)
        out["keys"].append(band_keys(least_hashes(hashes)))
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, content, fp, segments, keys) of each row of ``docs``, and (content, root) of the texts that are near copies of another.

    Texts are told apart by a hash of 64 bits.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    rows = stored(map_blocks(rows, _scan, f"id {kind}, content bigint, fp bigint, segments array<bigint>, keys array<bigint>"), "bands")
    texts = rows.groupBy(F.col("content").alias("node"))
    links = fingerprint_links(texts.agg(F.first("fp").alias("fp"), F.first("segments").alias("segments")), docs, text_col)
    return rows, near_roots(texts.agg(F.first("keys").alias("keys")), docs, text_col, links).withColumnRenamed("node", "content")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component) for each row of ``docs``.

    ``component`` is the smallest id of the rows reachable over near copies. Null text is empty text; texts
    without words are copies of each other. Null ids name a component only as null where no row of it has an id.
    """
    rows, roots = _classes(docs, id_col, text_col)
    named = stored(rows.groupBy("content").agg(F.min("id").alias("least")).join(roots, "content", "left"), "named")
    least = named.where("root is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    # a class with ids takes the smallest; one without has null in all of its rows
    classes = named.join(least, "root", "left").select("content", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("of_root")).alias("component"))
    return rows.select("id", "content").join(classes, "content").select("id", "component")


def one_of_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of near copies: the row of the smallest id, ties by a hash of the text.

    Components are of texts, so documents that only share an id, or have none, all stay. Rows without an id give way to those
    with one. Of rows with equal id and text the one of the least hash over all columns stays. Columns are those of ``docs``, whatever their names.
    """
    rows, roots = _classes(docs, id_col, text_col)
    found = rows.groupBy("id", "content").agg(F.count("*").alias("n")).join(roots, "content", "left")
    found = found.withColumn("root", F.coalesce("root", "content"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "content", "n")).alias("first")
    keep = found.groupBy("root").agg(first).select(
        F.col("first.id").alias("_keep_id"), F.col("first.content").alias("_keep_content"), F.col("first.n").alias("_keep_n")
    )
    return _rows_of(docs, stored(keep, "keepers"), id_col, text_col)


def _rows_of(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` with an id and text of ``keep``, one for each."""
    # as many keepers as groups: no side of a known size, so texts are dealt out at every size
    here = (F.col("_keep_content") == F.xxhash64(text_of(docs, text_col))) & F.col("_keep_id").eqNullSafe(docs[id_col])
    kept = docs.join(keep.hint("merge"), here)
    once = kept.where("_keep_n = 1").select(*(docs[c] for c in docs.columns))
    if keep.where("_keep_n > 1").isEmpty():
        return once
    whole = F.struct(*(docs[c] for c in docs.columns))
    again = kept.where("_keep_n > 1").groupBy("_keep_id", "_keep_content").agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("_keep_row"))
    return once.unionByName(again.select("_keep_row.*"))
