"""Quality rules: base counts of each text, and lines that too many documents of one host share."""

from __future__ import annotations

from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evwarden.llm.common import map_blocks, stored, text_of
from evwarden.llm.near import near_roots, text_bands

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A line is removed where more documents than this of one host have it; near copies count as one.
MAX_DOCUMENTS = 10
#: A document of which a larger share of words is removed is depleted.
MAX_REMOVED = 0.5
#: Lines to remove are sent to the tasks up to so many (host, hash), beyond that they are joined.
SENT_LINES = 500_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

_LINE_FORM = bytes(0x30 if 0x30 <= c <= 0x39 else c for c in range(256))


def line_key(line: str) -> int | None:
    """A hash of the line without case, digits and spacing; None if it has no word."""
    words = line.lower().encode().translate(_LINE_FORM).split()
    return None if not words else _signed(xxhash.xxh64_intdigest(b" ".join(words)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def base_counts(text: str) -> dict:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text, and a hash of it."""
    words = text.encode().split()
    windows = [b" ".join(t) for t in zip(words, words[1:], words[2:])] or [b" ".join(words)]
    distinct = set(windows)
    repeated = 0
    if len(distinct) < len(windows):
        often = Counter(windows)
        end = 0
        for at, window in enumerate(windows):
            if often[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "content": _signed(xxhash.xxh64_intdigest(text.encode(), 42)),  # as Spark's xxhash64
    }


def _line_words(text: str) -> list[dict]:
    words: Counter = Counter()
    for line in text.split("\n"):
        key = line_key(line)
        if key is not None:
            words[key] += len(line.encode().split())
    return [{"line": k, "words": n} for k, n in words.items()]


def _scan(block: dict[str, list]) -> dict[str, list]:
    texts = [t or "" for t in block["text"]]
    rows = [base_counts(t) for t in texts]
    out = {k: [r[k] for r in rows] for k in rows[0]} if rows else {}
    return out | {"id": block["id"], "host": block["host"], "lines": [_line_words(t) for t in texts], "keys": [text_bands(t) for t in texts]}


def _bad_lines(rows: DataFrame, docs: DataFrame, text_col: str, max_documents: int) -> DataFrame:
    """(bad_host, bad_line): the lines that more than ``max_documents`` documents of a host have, near copies counted once."""
    bands = rows.groupBy(F.col("content").alias("node")).agg(F.first("keys").alias("keys"))
    roots = near_roots(bands, docs, text_col)
    known = rows.select("host", "content", "lines").join(roots, F.col("node") == F.col("content"), "left")
    each = known.select("host", F.coalesce("root", "content").alias("text"), F.explode("lines.line").alias("line"))
    often = each.distinct().groupBy("host", "line").agg(F.count("*").alias("texts")).where(F.col("texts") > max_documents)
    return stored(often.select(F.col("host").alias("bad_host"), F.col("line").alias("bad_line")), "bad-lines")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def line_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED,
) -> DataFrame:
    """Counts and verdict of each row of ``docs``: id, host, content, the base counts, removed_words, bad_lines, base_failed, kept.

    Lines are compared without case, digits and spacing.  For each host the documents
    with a line are counted, near copies once: those of one component of texts linked by a similarity of 0.8 or more of their
    five-word shingles (``near.near_roots``).  ``bad_lines`` holds the keys
    of the lines to remove, ``removed_words`` their words.  A document is kept if it passes the base rules and
    at most ``max_removed`` of its words are removed.

    Null text is empty text (no words: fails); null hosts are one host; ids are only carried, so
    repeated rows and null ids each get their own result.  An empty table gives no rows.
    """
    kind, host = (docs.schema[c].dataType.simpleString() for c in (id_col, host_col))
    schema = f"id {kind}, host {host}, {', '.join(f'{c} bigint' for c in [*COUNTS, 'content'])}, lines array<struct<line: bigint, words: bigint>>, keys array<bigint>"
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[host_col].alias("host"))
    rows = stored(map_blocks(rows, _scan, schema).withColumn("row", F.monotonically_increasing_id()), "line-counts")

    bad = _bad_lines(rows, docs, text_col, max_documents)
    lines = rows.select("row", "host", F.explode("lines").alias("l")).select("row", "host", "l.*")
    sent = F.broadcast(bad) if bad.count() <= SENT_LINES else bad.hint("merge")
    hit = lines.join(sent, (F.col("line") == F.col("bad_line")) & F.col("host").eqNullSafe(F.col("bad_host")))
    removed = hit.groupBy("row").agg(F.sum("words").alias("removed"), F.collect_list("line").alias("bad"))
    out = rows.drop("lines", "keys").join(removed, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    lost = F.coalesce("removed", F.lit(0))
    return out.select(
        "id", "host", "content", *COUNTS, lost.alias("removed_words"), F.col("bad").alias("bad_lines"),
        failed.alias("base_failed"), (~failed & (lost <= F.col("n_words") * max_removed)).alias("kept"),
    )


@F.pandas_udf(StringType())
def without_lines(texts: pd.Series, bad: pd.Series) -> pd.Series:
    """The texts without the lines whose keys are listed."""
    out = []
    for text, keys in zip(texts, bad):
        if text is not None and keys is not None and len(keys):
            gone = set(keys)
            text = "\n".join(x for x in text.split("\n") if line_key(x) not in gone)
        out.append(text)
    return pd.Series(out, dtype=object)


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that ``line_rules`` keeps, without the lines it removes.  Columns are those of ``docs``.

    Verdicts belong to (id, text, host), so rows alike in these share one, whatever their other columns.
    """
    verdicts = line_rules(docs, id_col, text_col, host_col).where("kept")
    verdicts = verdicts.groupBy("id", "content", "host").agg(F.first("bad_lines").alias("bad"))
    verdicts = stored(verdicts.select(*(F.col(c).alias(f"_rule_{c}") for c in verdicts.columns)), "verdicts")
    keyed = docs.withColumn("_content", F.xxhash64(text_of(docs, text_col)))
    same = (
        F.col("_rule_id").eqNullSafe(docs[id_col])
        & (F.col("_rule_content") == F.col("_content"))
        & F.col("_rule_host").eqNullSafe(docs[host_col])
    )
    kept = keyed.join(verdicts.hint("merge"), same)
    text = without_lines(docs[text_col], F.col("_rule_bad")).alias(text_col)
    return kept.select(*(text if c == text_col else docs[c] for c in docs.columns))
