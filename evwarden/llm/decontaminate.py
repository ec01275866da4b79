"""Passages of benchmark items inside documents, edited ones included.

The random-walk embedding of Chakraborty, Goldenberg and Koucky turns a sequence into a
longer one so that sequences at a small edit distance are at a small Hamming
distance.  Sampled positions of embedded windows and items are looked up
in hash tables; candidates are verified by their edit distance.  Symbols are words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwarden.llm.common import map_blocks, stored, text_of

#: Edits, in words, as a share of the item's words.
MAX_EDITS = 0.2
#: Hash tables, each with a walk of its own.
TABLES = 48
#: Sampled positions of a walk in each table.
SAMPLES = 2
RUN = 3
#: Benchmark items looked up in one pass over the documents.
ITEMS_PER_PASS = 20_000
_PAD = -1
_OTHER = 0
_ASCII = bytes(c if chr(c).isalnum() or c >= 128 else 0x20 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return text.lower().encode().translate(_ASCII).split()


def edits_allowed(n_words: int, max_edits: float = MAX_EDITS) -> int:
    return int(n_words * max_edits)


@dataclass
class Items:
    """The look-up tables over some benchmark items: small, and sent to every task."""

    max_edits: float
    tables: int
    samples: int
    word_ids: dict[bytes, int] = field(default_factory=dict)
    ids: list[int] = field(default_factory=list)
    seqs: list[np.ndarray] = field(default_factory=list)
    runs: np.ndarray = None  # sorted codes of the items' runs of RUN words
    places: list[list[tuple[int, int]]] = None  # (item, position) of each of these
    buckets: list[dict[int, list[int]]] = None  # by table

    @staticmethod
    def build(items: list[tuple[int, str]], max_edits: float = MAX_EDITS, tables: int = TABLES, samples: int = SAMPLES) -> Items:
        own = Items(max_edits, tables, samples)
        places: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text or "")
            if not words:
                continue
            seq = np.array([own.word_ids.setdefault(w, len(own.word_ids) + 1) for w in words], np.int64)
            own.ids.append(item_id)
            own.seqs.append(seq)
        base = len(own.word_ids) + 1
        for n, seq in enumerate(own.seqs):
            for at, code in enumerate(_codes(seq, min(RUN, len(seq)), base).tolist()):
                places.setdefault(code, []).append((n, at))
        own.runs = np.array(sorted(places), np.int64)
        own.places = [places[c] for c in own.runs.tolist()]
        own.buckets = [{} for _ in range(tables)]
        for n, seq in enumerate(own.seqs):
            for t, key in enumerate(own.keys([seq], len(seq))[0].tolist()):
                own.buckets[t].setdefault((len(seq), key), []).append(n)
        return own

    def anchors(self, seq: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, position in the item, position in ``seq``) of each run of words that both have."""
        base = len(self.word_ids) + 1
        for run in sorted({min(RUN, len(s)) for s in self.seqs}):
            if len(seq) < run:
                continue
            codes = _codes(seq, run, base)
            known = np.flatnonzero(codes)
            at = np.searchsorted(self.runs, codes[known])
            at[at == len(self.runs)] = 0
            same = self.runs[at] == codes[known]
            for place, where in zip(at[same].tolist(), known[same].tolist()):
                for item, q in self.places[place]:
                    yield item, q, where

    def keys(self, windows: list[np.ndarray], size: int) -> np.ndarray:
        """A key for each window and table: the symbols at the table's sampled positions of the window's walk."""
        if not windows:
            return np.zeros((0, self.tables), np.int64)
        rows = np.full((len(windows), size + 1), _PAD, np.int64)
        for i, w in enumerate(windows):
            rows[i, : len(w)] = w
        draw = np.random.default_rng(size)
        steps = 3 * size
        # early positions vary least with the walk; the sample is spread over the part in which the text lasts
        sampled = np.sort(draw.integers(0, 2 * size, (self.tables, self.samples)), axis=1)
        salts = draw.integers(1, 1 << 62, (self.tables, steps))
        index = np.arange(len(windows))[:, None]
        at = np.zeros((len(windows), self.tables), np.int64)
        keys = np.zeros((len(windows), self.tables), np.int64)
        for step in range(int(sampled.max()) + 1):
            symbols = rows[index, at]
            for s in range(self.samples):
                use = sampled[:, s] == step
                if use.any():
                    keys[:, use] = keys[:, use] * np.int64(1_000_003) + symbols[:, use] + 2
            at = np.minimum(at + _coin(symbols, salts[:, step]), size)
        return keys


def _coin(symbols: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """One random bit for each symbol and table."""
    with np.errstate(over="ignore"):
        x = (symbols.astype(np.uint64) + np.uint64(2)) * np.uint64(0x9E3779B97F4A7C15) ^ salts.astype(np.uint64)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64)


def _codes(seq: np.ndarray, run: int, base: int) -> np.ndarray:
    """A code for each run of ``run`` known words (other runs: 0), different for different lengths."""
    n = len(seq) - run + 1
    code = np.zeros(max(n, 0), np.int64)
    known = np.ones(max(n, 0), bool)
    for k in range(run):
        code = code * base + seq[k : n + k]
        known &= seq[k : n + k] != _OTHER
    return np.where(known, code * 4 + run, 0)


def fitting_distance(item: np.ndarray, window: np.ndarray, limit: int) -> tuple[int, int, int]:
    """(edits, start, end) of the stretch of ``window`` nearest to ``item``; edits beyond ``limit`` are not told apart.

    Words are inserted, left out or replaced.
    """
    if np.isin(item, window).sum() < len(item) - limit:
        return limit + 1, 0, 0
    best = np.zeros(len(window) + 1, np.int64)
    start = np.arange(len(window) + 1)
    for i, word in enumerate(item.tolist()):
        cost = np.empty_like(best)
        origin = np.empty_like(start)
        cost[0], origin[0] = i + 1, start[0]
        swap = best[:-1] + (window != word)
        drop = best[1:] + 1
        take = swap <= drop
        cost[1:] = np.where(take, swap, drop)
        origin[1:] = np.where(take, start[:-1], start[1:])
        # insertions run along the row: the least of cost[k] + (j - k) over k <= j
        shifted = cost - np.arange(len(cost))
        least = np.minimum.accumulate(shifted)
        from_k = np.maximum.accumulate(np.where(shifted == least, np.arange(len(cost)), 0))
        cost = least + np.arange(len(cost))
        origin = origin[from_k]
        best, start = cost, origin
        if best.min() > limit:
            return limit + 1, 0, 0
    end = int(best.argmin())
    return int(best[end]), int(start[end]), end


def passages(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """(item id, edits, first word, end word) of the nearest passage of each item that ``text`` holds within the limit."""
    get = items.word_ids.get
    seq = np.array([get(w, _OTHER) for w in words_of(text)], np.int64)
    shared: dict[int, list[tuple[int, int]]] = {}
    for item, q, where in items.anchors(seq):
        shared.setdefault(item, []).append((where, where - q))
    by_size: dict[int, set[int]] = {}
    for item, pairs in shared.items():
        size = len(items.seqs[item])
        run, edits = min(RUN, size), edits_allowed(size, items.max_edits)
        # an edit spoils at most ``run`` runs, so a passage keeps this many of its item's runs
        needed = max(size - run + 1 - run * edits, 1)
        if len(pairs) >= needed:
            wheres = np.unique([w for w, _ in pairs])
            starts = np.unique([p for _, p in pairs])
            inside = np.searchsorted(wheres, starts + size + edits) - np.searchsorted(wheres, starts - edits)
            by_size.setdefault(size, set()).update(starts[inside >= needed].tolist())
    found: dict[int, tuple[int, int, int]] = {}
    for size, places in by_size.items():
        order = sorted(places)
        for block in range(0, len(order), 256):
            some = order[block : block + 256]
            keys = items.keys([seq[max(p, 0) : max(p + size, 0)] for p in some], size)
            for p, row in zip(some, keys.tolist()):
                hits = {n for t, key in enumerate(row) for n in items.buckets[t].get((size, key), ())}
                limit = edits_allowed(size, items.max_edits)
                for n in hits:
                    if found.get(n, (1,))[0] == 0:
                        continue  # places are in order: the first exact passage is the answer
                    lo, hi = max(p - limit, 0), max(p + size + limit, 0)
                    edits, first, end = fitting_distance(items.seqs[n], seq[lo:hi], limit)
                    if edits <= limit:
                        found[n] = min(found.get(n, (edits, lo + first, lo + end)), (edits, lo + first, lo + end))
    return [(items.ids[n], *found[n]) for n in sorted(found)]


def benchmark_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
    max_edits: float = MAX_EDITS, tables: int = TABLES, samples: int = SAMPLES, items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """(id, item_id, n_words, edits, first_word, end_word) for each document and item of which it holds a passage.

    A passage is a stretch of a document's words at most ``max_edits`` x the item's words
    away from the item; the nearest one is given, the first of equal ones.  Words are lower-cased, without ASCII
    punctuation.  An edit spoils at most three of an item's runs of three words, so a
    stretch within the limit keeps a known number of them: only windows that hold that many are embedded, and no
    passage is lost by that. A window is compared with the items that share the sampled positions of at least
    one of ``tables`` walks.

    Items are looked up ``items_per_pass`` at a time, each lot sent to the tasks, which read the documents
    once a lot.  Null or wordless texts and items match nothing; repeated rows give repeated results; either
    table may be empty; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_id_col].dataType.simpleString()
    schema = f"id {kind}, item_id {item_kind}, n_words bigint, edits bigint, first_word bigint, end_word bigint"
    rows = docs.select(docs[id_col].alias("id"), text_of(docs, text_col).alias("text"))
    wanted = benchmark.select(benchmark[item_id_col].alias("item_id"), text_of(benchmark, item_text_col).alias("text"))
    out = None
    for lot in _lots(wanted, items_per_pass):
        items = Items.build(lot, max_edits, tables, samples)
        part = map_blocks(rows, _matcher(items), schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _lots(items: DataFrame, size: int) -> Iterator[list[tuple]]:
    lot: list[tuple] = []
    for row in items.toLocalIterator():
        lot.append((row["item_id"], row["text"]))
        if len(lot) == size:
            yield lot
            lot = []
    if lot:
        yield lot


def _matcher(items: Items):
    sizes = dict(zip(items.ids, map(len, items.seqs)))

    def rows(block: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("id", "item_id", "n_words", "edits", "first_word", "end_word")}
        for doc, text in zip(block["id"], block["text"]):
            for item, edits, first, end in passages(text, items):
                for k, v in zip(out, (doc, item, sizes[item], edits, first, end)):
                    out[k].append(v)
        return out

    return rows


def without_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns; a null id is an id of its own."""
    hits = benchmark_passages(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias("_leak_id")).distinct()
    leaks = stored(hits, "leaks")
    return docs.join(leaks, F.col("_leak_id").eqNullSafe(docs[id_col]), "left_anti")
