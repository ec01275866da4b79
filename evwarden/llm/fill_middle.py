"""Fill-in-the-middle texts: blocks of a text exchanged in place between sentinels, and put back exactly."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwarden.llm.common import map_blocks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts so many are rearranged, and of 100 rearranged ones so many with the suffix before the prefix.
REARRANGED = 90
SUFFIX_FIRST = 20
SEED = "1"


def draws(key: str, seed: str = SEED) -> list[int]:
    """Four numbers of 32 bits that depend on the seed and the key alone."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def byte_cuts(text: bytes, first: int, second: int) -> tuple[int, int, int]:
    """Code points of a UTF-8 text, and the bytes before two of its cuts, from one scan over the bytes that begin a code point."""
    if text.isascii():
        return len(text), first, second
    begins = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    ends = [*(int(begins[c]) if c < len(begins) else len(text) for c in (first, second))]
    return len(begins), ends[0], ends[1]


def code_points(text: bytes) -> int:
    return len(text) if text.isascii() else int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def rotate(block: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges the neighbours [start, middle) and [middle, end) by three reversals."""
    view = np.frombuffer(block, np.uint8)
    for a, b in ((start, middle), (middle, end), (start, end)):
        view[a:b] = view[a:b][::-1].copy()


def rearranged(text: bytes, first: int, second: int, form: str) -> bytes:
    """The text with sentinels, cut at two byte offsets, its blocks in the order of ``form``."""
    block = bytearray(text)
    block[second:second] = SUFFIX
    block[first:first] = MIDDLE
    block[0:0] = PREFIX
    at_middle, at_suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(block, at_middle if form == "psm" else 0, at_suffix, len(block))
    return bytes(block)


def restored(output: bytes, form: str) -> bytes:
    """The text that ``rearranged`` was given; the rotation is inverted by the one of the exchanged lengths."""
    if form == "plain":
        return output
    block = bytearray(output)
    # the text holds no sentinel, and none can begin in one and end outside, so each is found where it was put
    at_suffix = output.index(SUFFIX)
    moved = output.index(MIDDLE if form == "psm" else PREFIX)
    rotate(block, at_suffix, moved, len(block))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = block.index(sentinel)
        del block[at : at + len(sentinel)]
    return bytes(block)


def arranged(text: bytes, key: str, seed: str = SEED, percent: int = REARRANGED, suffix_first: int = SUFFIX_FIRST) -> dict:
    """n, form, prefix_chars, middle_chars and output of one text."""
    h1, h2, h3, h4 = draws(key, seed)
    n = code_points(text)
    if not text or h3 % 100 >= percent or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return {"n": n, "form": "plain", "prefix_chars": None, "middle_chars": None, "output": text}
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    form = "spm" if h4 % 100 < suffix_first else "psm"
    _, a, b = byte_cuts(text, first, second)
    return {"n": n, "form": form, "prefix_chars": first, "middle_chars": second - first, "output": rearranged(text, a, b, form)}


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED, percent: int = REARRANGED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``; ``output`` is the rearranged text.

    Draws depend on the seed and the id alone, so a lost task gives the same rows again. A null text is an empty one and
    stays plain, as do texts that hold a sentinel. A null id draws as the empty id; repeated rows and ids each get their own result, the same for
    the same text. An empty table gives no rows; other columns are not read. A task holds one block of texts at a time.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        docs[id_col].alias("id"), F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("key"),
        F.coalesce(docs[text_col], F.lit("")).cast("binary").alias("text"),
    )

    def block(b: dict[str, list]) -> dict[str, list]:
        found = [arranged(t, k, seed, percent, suffix_first) for k, t in zip(b["key"], b["text"])]
        return {"id": b["id"]} | {c: [r[c] for r in found] for c in ("n", "form", "prefix_chars", "middle_chars", "output")}

    out = map_blocks(rows, block, f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restore(rows: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with ``restored``: the text rebuilt from ``output`` and ``form``. Nulls stay null; a column ``restored`` is replaced."""
    kept = [c for c in rows.columns if c not in ("output", "restored")]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept), "output binary, restored binary"])

    def block(b: dict[str, list]) -> dict[str, list]:
        return b | {"restored": [None if o is None or f is None else restored(o, f) for o, f in zip(b["output"], b["form"])]}

    out = map_blocks(rows.select(*kept, F.col("output").cast("binary").alias("output")), block, schema)
    return out.withColumn("output", F.col("output").cast("string")).withColumn("restored", F.col("restored").cast("string"))


def middle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of each row of ``docs``."""
    rows = restore(fill_in_middle(docs))
    digests = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2,
  CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""
