"""Spelling variants: words one edit apart, found by a frontier of states that joins a trie's edge table level by level."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evwarden.llm.common import map_blocks, stored

MIN_LETTERS = 6
MIN_COUNT = 5
#: A form is so many times as frequent as the word it stands for.
RATIO = 5
#: One in so many (document, run) loses a letter.
LOSSES = 199
#: Edges of the first levels hold one code point each; after these the blocks double in length, so that very long words need few levels.
SINGLE = 32
#: Levels with no more edges than this are sent to the tasks (one code point and a short prefix each).
SENT_EDGES = 100_000
#: Levels that are joined before the states are written again, as long as their edges are sent.
LEVELS_AT_ONCE = 4
#: Nodes above more words than this are joined by sending their edges, of which there are at most 90 for each so many words.
HOT_WORDS = 100_000

_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")


def _code_points(run: bytes) -> int:
    return len(run) - run.count(b"\xc3")  # each letter outside ASCII begins with this byte, and no letter continues with it


def words_of(key: bytes, text: bytes) -> Counter:
    """The words of a UTF-8 text with their counts: runs of letters, lower case in A-Z, some of which lose a letter."""
    out: Counter = Counter()
    seed = zlib.crc32(key + b":")
    for run, n in Counter(_RUN.findall(text.lower())).items():
        length = _code_points(run)
        if length < MIN_LETTERS:
            continue
        h = zlib.crc32(run, seed)
        if h % LOSSES == 0:
            letters, at = run.decode(), h % length
            run, length = (letters[:at] + letters[at + 1 :]).encode(), length - 1
        if length >= MIN_LETTERS:
            out[run] += n
    return out


def corpus_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of at least six code points with ``min_count`` occurrences or more in the texts of ``docs``.

    Runs of A-Z, a-z and U+00C0 to U+00FF are lower-cased in A-Z only. Where 199 divides the crc32 h of ``id:run``, code point ``h % length`` is deleted. Null text
    has no words, a null id counts as the empty id, repeated rows count again; an empty table gives no rows; other columns are not read.
    Each task counts a block of texts before anything is shuffled.
    """
    key = F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary").alias("key")
    rows = docs.where(docs[text_col].isNotNull()).select(key, docs[text_col].cast("binary").alias("text"))

    def block(b: dict[str, list]) -> dict[str, list]:
        counts: Counter = Counter()
        for k, text in zip(b["key"], b["text"]):
            counts.update(words_of(k, text))
        return {"word": [w.decode() for w in counts], "n": list(counts.values())}

    found = map_blocks(rows, block, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def level_ends(longest: int, single: int = SINGLE) -> list[int]:
    """The depths at which the levels of the trie end, up to one that covers ``longest`` code points."""
    ends, size = [], 1
    while not ends or ends[-1] < longest:
        size = 1 if len(ends) < single else 2 * size
        ends.append((ends[-1] if ends else 0) + size)
    return ends


def trie_edges(words: DataFrame, ends: list[int]) -> DataFrame:
    """(level, node, label, n, below, spends): the edges of the trie of ``words``; a node is the text that leads to it.

    ``n`` is the count of the word that ends with the edge, null if none does; ``below`` the words whose path takes the edge. ``spends``: a
    word at the node may spend its edit on the edge, since the node has others or a word ends here.
    """
    bounds = F.array(*[F.lit(e) for e in [0, *ends]])
    deep = words.select("word", "n", F.explode(F.filter(F.sequence(F.lit(0), F.lit(len(ends) - 1)), lambda i: F.get(bounds, i) < F.length("word"))).alias("level"))
    start, end = F.get(bounds, F.col("level")), F.get(bounds, F.col("level") + 1)
    rows = deep.select(
        "level", F.left("word", start).alias("node"), F.substring("word", start + 1, end - start).alias("label"),
        F.when(F.length("word") <= end, F.col("n")).alias("n"),
    )
    edges = rows.groupBy("level", "node", "label").agg(F.max("n").alias("n"), F.count("*").alias("below"))
    fan = F.count("*").over(Window.partitionBy("level", "node"))
    return edges.withColumn("spends", (fan > 1) | F.col("n").isNotNull())


def near_words(words: DataFrame, single: int = SINGLE, sent_edges: int = SENT_EDGES, hot_words: int = HOT_WORDS) -> DataFrame:
    """(word, other, other_n): each pair of ``words`` (word, n; distinct) that are one inserted, deleted or replaced code point apart, both ways.

    A state is (word, position, node, edits). Those without an edit are the word's own path, so each level has them from the words; the others
    go on from level to level, and are written every few levels. At a level, states without an edit join the edges of their node and spend the edit on one: a
    replaced code point (towards the greater word) or a deleted one (towards the shorter word; the reverse is the insertion). States that have spent it take the one edge that
    their word continues with. A state that has used up its word at the end of another is a pair. Nodes of the first levels,
    and nodes above very many words, are joined by sending their edges; no state is dropped.
    """
    longest = words.agg(F.max(F.length("word"))).first()[0]
    nothing = words.select("word", F.col("word").alias("other"), F.col("n").alias("other_n"))
    if not longest:
        return nothing.limit(0)
    ends = level_ends(longest, single)
    edges = trie_edges(words, ends).repartitionByRange("level", "node").sortWithinPartitions("level", "node")
    edges = stored(edges, "edges")
    sizes = edges.groupBy("level").agg(F.count("*").alias("n"), F.count_if("spends").alias("spending"), F.max("below").alias("below"))
    sizes = {r.level: r for r in sizes.collect()}  # one row for each level
    states, unwritten, levels = None, 0, []
    for level, end in enumerate(ends):
        start = ends[level - 1] if level else 0
        here = edges.where(F.col("level") == level)
        short = level < SINGLE
        sent = short and sizes[level].n <= sent_edges
        spending = here.where("spends").select("node", "label", "n")
        hot = level > 0 and sizes[level - 1].below > hot_words
        busy = edges.where((F.col("level") == level - 1) & (F.col("below") > hot_words)).select(F.concat("node", "label").alias("node")) if hot else None
        now = _spent(words, spending, start, end, short and sizes[level].spending <= sent_edges, busy)
        if states is not None:
            now = now.unionByName(_continued(states, here, end - start, sent))
        unwritten += 1
        last = level == len(ends) - 1
        if last or not sent or unwritten == LEVELS_AT_ONCE or not (short and sizes[level + 1].n <= sent_edges):
            now = stored(now.where(_ALIVE), f"level-{level}")
            levels.append(now.where(_DONE))
            now, unwritten = now.where(_GOING), 0
        states = now
    found = reduce(DataFrame.unionByName, levels).select("word", F.col("node").alias("other"), F.col("n").alias("other_n")).distinct()
    counts = words.select("word", F.col("n").alias("word_n"))
    both = F.array(F.struct("word", "other", "other_n"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("word_n").alias("other_n")))
    return found.join(counts, "word").select(F.explode(both).alias("p")).select("p.*")


_GOING = "position < length(word)"
_DONE = "position = length(word) AND n IS NOT NULL"
_ALIVE = f"{_GOING} OR {_DONE}"


def _spent(words: DataFrame, edges: DataFrame, start: int, end: int, sent: bool, busy: DataFrame | None) -> DataFrame:
    """The states that spend their edit on one of the ``edges`` of a level; ``busy`` are nodes with very many words."""
    rows = words.where(F.length("word") > start).select("word", F.left("word", F.lit(start)).alias("node"))
    if sent or busy is None:
        return _edited(rows.join(F.broadcast(edges) if sent else edges.hint("merge"), "node"), start, end)
    busy = F.broadcast(busy)  # at most a node for each so many words
    often = rows.join(busy, "node", "left_semi").join(F.broadcast(edges.join(busy, "node", "left_semi")), "node")
    seldom = rows.join(busy, "node", "left_anti").join(edges.join(busy, "node", "left_anti").hint("merge"), "node")
    return _edited(often, start, end).unionByName(_edited(seldom, start, end))


def _edited(rows: DataFrame, start: int, end: int) -> DataFrame:
    size = end - start
    own, rest = F.substring("word", start + 1, size), F.substring("word", start + 1, size + 1)
    label, whole = F.col("label"), F.length("word")
    last = start + F.length(rest) == whole
    if size == 1:
        replaced = label > own
        deleted = (F.length(rest) == 2) & F.when(label == own, last).otherwise(label == F.right(rest, F.lit(1)))
    else:
        replaced = (label > own) & (F.length(label) == F.length(own)) & (F.levenshtein(label, own, 1) == 1)
        deleted = (F.length(rest) == F.length(label) + 1) & (F.levenshtein(label, rest, 1) == 1) & ((label != F.left(rest, F.length(label))) | last)
    after = F.array_compact(F.array(F.when(replaced, start + F.length(own)), F.when(deleted, start + F.length(rest))))
    return rows.where(replaced | deleted).select("word", F.explode(after).alias("position"), F.concat("node", "label").alias("node"), "n")


def _continued(states: DataFrame, here: DataFrame, size: int, sent: bool) -> DataFrame:
    """States that have spent their edit take the edge with the word's next code points; pairs found at an earlier level, not written yet, stay."""
    label = F.substring(F.col("word"), F.col("position") + 1, F.lit(size))
    rows = states.where(_ALIVE).select("word", "position", "node", "n", label.alias("label"))
    edges = here.select("node", "label", F.col("n").alias("child_n"), F.lit(True).alias("met"))
    rows = rows.join(F.broadcast(edges) if sent else edges.hint("merge"), ["node", "label"], "left").where(F.col("met") | (F.col("label") == ""))
    return rows.select(
        "word", (F.col("position") + F.length("label")).alias("position"), F.concat("node", "label").alias("node"),
        F.when(F.col("met"), F.col("child_n")).otherwise(F.col("n")).alias("n"),
    )


def spelling_variants(words: DataFrame, ratio: int = RATIO, **trie) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each row of ``words`` (word, n; distinct words).

    ``form`` is the near word of the largest n, ties by code point order, if its n is at least ``ratio`` times the word's; ``root`` the last word that forms
    lead to, the word itself without one. Counts grow along forms, so there are no cycles; roots are found by doubling the steps. No words give no rows.
    """
    words = stored(words.select("word", "n"), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("other"))).alias("best")
    near = near_words(words, **trie).groupBy("word").agg(F.count("*").alias("n_near"), best)
    stands = -F.col("best.less") >= ratio * F.col("n")
    out = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(stands, F.col("best.other")).alias("form"), F.when(stands, -F.col("best.less")).alias("form_n"),
    )
    out = stored(out, "forms")
    roots = _roots(out.where("form is not null").select("word", F.col("form").alias("root")))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    now = stored(links, "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = stored(now.join(ahead, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("on")), "roots")
        now = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return now


def variant_table(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs``."""
    return spelling_variants(corpus_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")
