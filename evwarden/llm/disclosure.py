"""Personal data, and the terms that give it away.

Base kinds are found by pattern.  A term reveals an entity as far as knowing the term makes the entity
likelier: the corpus gives the pointwise mutual information of both, from how many documents hold the two together and
how many each of them, and a term that takes away most of the entity's
information content is sanitised along with it in the documents that hold the entity.  Most values stand in one document, so
an entity is a value, what it belongs to (an e-mail's domain, the first parts of an address, the first digits of a number) and its kind.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evwarden.llm.common import ROWS_PER_BLOCK, map_blocks, stored, text_of
from evwarden.llm.near import near_roots, text_bands

KINDS = ("email", "ip", "card", "phone")
#: Different texts, near copies counted once, in which a term must stand beside an entity.
SUPPORT = 3
#: Share of an entity's information content that a term may give away at most.
DISCLOSED = 0.9
#: Distinct terms that a task gathers before it passes their counts on.
GATHERED = 200_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TERM = re.compile(r"[^\W\d_][\w'-]{2,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match has one @: its local part is all that fits before it, so no start is tried twice."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        before = text[floor:at]
        start = floor + len(before.rstrip(_LOCAL))
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            yield start, match.end()
        floor = match.end() if match else at + 1
        at = text.find("@", floor)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds in order; ``kind`` indexes KINDS, positions are code points, ends exclusive."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(map(_small, m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def entities_of(kind: int, value: str) -> list[str]:
    """What a value stands for, from the value itself to what it belongs to and to its kind."""
    digits = _NOT_DIGIT.sub("", value)
    plain = value.lower() if kind == 0 else value if kind == 1 else digits
    wider = {0: plain.rpartition("@")[2], 1: plain.rpartition(".")[0], 2: digits[:6], 3: digits[:5]}[kind]
    return [f"{kind}:{plain}", f"{kind}:{wider}:", f"{kind}::"]


def _entity(name: str) -> int:
    return _signed(xxhash.xxh64_intdigest(name.encode()))


def beside(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[int], list[str]]:
    """The entities of a text and its terms outside their spans, each once."""
    entities = {_entity(e) for a, kind, b in spans for e in entities_of(kind, text[a:b])}
    return sorted(entities), sorted({text[a:b].lower() for a, b in _terms(text, spans)})


def _terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Start and end of each term that touches no span; ``spans`` by start."""
    at, reach = 0, 0  # spans that begin before the term ends, and how far they go
    for m in _TERM.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        if m.start() >= reach:
            yield m.start(), m.end()


def spans_text(spans: list[tuple[int, int, int]], names: tuple[str, ...] = (*KINDS, "term")) -> str:
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


def all_spans(text: str, terms: set[str]) -> list[tuple[int, int, int]]:
    """The base spans and each occurrence of ``terms`` outside them, in order."""
    base = base_spans(text)
    return sorted([*base, *((a, len(KINDS), b) for a, b in _terms(text, base) if text[a:b].lower() in terms)])


def sanitised(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Base spans give way to their kind; terms are removed for a mark, or generalised to their digits' count if they hold any."""
    out, at = [], 0
    for start, kind, end in spans:
        if start < at:
            start = at
        if start >= end:
            continue
        out.append(text[at:start])
        term = text[start:end]
        out.append(f"[{KINDS[kind].upper()}]" if kind < len(KINDS) else re.sub(r"\d", "#", term) if re.search(r"\d", term) else "[TERM]")
        at = end
    return "".join(out) + text[at:]


def _scan(block: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in (*(f"n_{k}" for k in KINDS), "base", "entity", "term", "keys")}
    for text in block["text"]:
        spans = base_spans(text)
        kinds = Counter(k for _, k, _ in spans)
        entities, terms = beside(text, spans) if spans else ([], [])
        for i, k in enumerate(KINDS):
            out[f"n_{k}"].append(kinds[i])
        out["base"].append(spans_text(spans))
        for k, v in (("entity", entities), ("term", terms), ("keys", text_bands(text) if spans else [])):
            out[k].append(v)
    return {"id": block["id"], "content": block["content"]} | out


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_PER_BLOCK):
            for text in batch.slice(at, ROWS_PER_BLOCK).column(0).to_pylist():
                found.update(set(_TERM.findall(text.lower())))
            if len(found) >= GATHERED:
                yield _packed(found)
                found.clear()
    yield _packed(found)


def _packed(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of each row's base spans, and, where there are any, of its entities, its other terms and its fingerprints."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    schema = (
        f"id {kind}, content bigint, {', '.join(f'n_{k} bigint' for k in KINDS)}, base string, "
        "entity array<bigint>, term array<string>, keys array<bigint>"
    )
    return stored(map_blocks(rows, _scan, schema).withColumn("row", F.monotonically_increasing_id()), "spans")


def revealing_terms(
    docs: DataFrame, rows: DataFrame, text_col: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED
) -> DataFrame:
    """(entity, term): the terms that give away over ``disclosed`` of the entity's information content.

    With N documents, n_e of them holding the entity, n_t the term and n_te both, the share is
    log(N n_te / (n_e n_t)) / log(N / n_e).  Both must stand together in ``support`` different texts, near copies
    (``near.near_roots``, among the texts with personal data) counted once, so copies are no evidence.
    """
    held = rows.where(F.size("entity") > 0).groupBy("content").agg(
        F.first("entity").alias("entity"), F.first("term").alias("term"), F.first("keys").alias("keys"), F.count("*").alias("n")
    )
    held = stored(held, "held")
    roots = near_roots(held.select(F.col("content").alias("node"), "keys"), docs, text_col)
    held = held.drop("keys").join(roots, F.col("node") == F.col("content"), "left").withColumn("text", F.coalesce("root", "content"))
    each = held.select("text", "n", "term", F.explode("entity").alias("entity"))
    holders = each.groupBy("entity", "text").agg(F.sum("n").alias("n")).groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts"))
    holders = stored(holders.where(F.col("texts") >= support).drop("texts"), "holders")
    pairs = each.join(holders.select("entity"), "entity").select("entity", "text", "n", F.explode("term").alias("term"))
    seen = pairs.groupBy("entity", "term", "text").agg(F.sum("n").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("texts"))
    seen = stored(seen.where(F.col("texts") >= support).drop("texts"), "beside")
    anywhere = docs.select(text_of(docs, text_col)).mapInArrow(_document_counts, "term string, n bigint")
    anywhere = anywhere.groupBy("term").agg(F.sum("n").alias("n_t"))
    total = rows.count()
    known = seen.join(holders, "entity").join(anywhere, "term")
    gain = F.log(F.lit(float(total)) * F.least("n_te", "n_t") / (F.col("n_e") * F.col("n_t")))
    content = F.log(F.lit(float(total)) / F.col("n_e"))
    return stored(known.where((content > 0) & (gain >= content * disclosed)).select("entity", "term"), "revealing")


def _flagged(rows: DataFrame, revealing: DataFrame) -> DataFrame:
    """(flag_id, flag_content, terms) of the rows that hold an entity with revealing terms."""
    held = rows.select("row", "id", "content", F.explode(F.array_distinct("entity")).alias("entity"))
    flags = held.join(revealing, "entity").groupBy("id", "content").agg(F.collect_set("term").alias("terms"))
    return stored(flags.select(F.col("id").alias("_flag_id"), F.col("content").alias("_flag_content"), F.col("terms").alias("_flag_terms")), "flags")


def _same(docs: DataFrame, id_col: str, text_col: str):
    return F.col("_flag_id").eqNullSafe(docs[id_col]) & (F.col("_flag_content") == F.xxhash64(text_of(docs, text_col)))


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a count for each base kind, base (its spans) and spans (all) for each row of ``docs``.

    Spans are kind:start:end by start, then kind, joined by commas.  Terms are marked only in documents
    that hold the entity they reveal, wherever they stand outside base spans; documents without personal data get none.
    Null text is empty; rows with equal id and text get equal results; an empty table gives no rows; other columns are not read.
    """
    rows = scanned(docs, id_col, text_col)
    flags = _flagged(rows, revealing_terms(docs, rows, text_col))
    names = ["id", *(f"n_{k}" for k in KINDS), "base"]
    marked = docs.join(flags, _same(docs, id_col, text_col)).select(
        docs[id_col].alias("id"), F.col("_flag_content").alias("content"), text_of(docs, text_col).alias("text"), F.col("_flag_terms").alias("terms")
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def spans(block: dict[str, list]) -> dict[str, list]:
        found = [all_spans(t, set(terms)) for t, terms in zip(block["text"], block["terms"])]
        kinds = [Counter(k for _, k, _ in f) for f in found]
        return {
            "id": block["id"], **{f"n_{k}": [c[i] for c in kinds] for i, k in enumerate(KINDS)},
            "base": [spans_text([s for s in f if s[1] < len(KINDS)]) for f in found], "spans": [spans_text(f) for f in found],
        }

    marked = map_blocks(marked, spans, f"id {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base string, spans string")
    plain = rows.join(
        flags, F.col("id").eqNullSafe(F.col("_flag_id")) & (F.col("content") == F.col("_flag_content")), "left_anti"
    )
    return plain.select(*names, F.col("base").alias("spans")).unionByName(marked)


@F.pandas_udf(StringType())
def _sanitised(texts: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series(
        [None if t is None else sanitised(t, all_spans(t, set(() if w is None else w))) for t, w in zip(texts, terms)], dtype=object
    )


def without_disclosure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data and revealing terms replaced in the text; null stays null, other columns stay as they are."""
    rows = scanned(docs, id_col, text_col)
    flags = _flagged(rows, revealing_terms(docs, rows, text_col))
    both = docs.join(flags, _same(docs, id_col, text_col), "left")
    text = _sanitised(docs[text_col], F.col("_flag_terms")).alias(text_col)
    return both.select(*(text if c == text_col else docs[c] for c in docs.columns))
