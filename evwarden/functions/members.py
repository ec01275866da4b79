"""Typed access to the members of an event's content.

Content is either JSON text or a struct.  A struct keeps Parquet column
pruning intact (only the named leaves are read); JSON text is parsed once for
all members together.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number_member(text: Column) -> Column:
    """JSON value text → double: numeric text is parsed, other text is 0.0, missing stays null."""
    return F.coalesce(
        text.try_cast("double"), F.when(text == "true", F.lit(1.0)), F.when(text.isNotNull(), F.lit(0.0))
    )


def string_member(text: Column) -> Column:
    return text


def bool_member(text: Column) -> Column:
    """``true`` and non-zero numbers are true, everything else that is present is false."""
    return F.when(
        text.isNotNull(),
        (F.lower(F.trim(text)) == "true") | F.coalesce(text.try_cast("double") != 0.0, F.lit(False)),
    )


def event_time(value: Column) -> Column:
    """ISO-8601 text (fractions beyond microseconds are cut) or epoch milliseconds → timestamp."""
    text = value.cast("string")
    iso = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.coalesce(F.timestamp_millis(text.try_cast("bigint")), F.try_to_timestamp(iso))


def require_event_time(value: Column) -> Column:
    """:func:`event_time`, but text that is neither form is an error."""
    ts = event_time(value)
    return F.when(ts.isNotNull() | value.isNull(), ts).otherwise(
        F.raise_error(F.concat(F.lit("cannot read an event time from "), value.cast("string"))).cast("timestamp")
    )


_FROM_TEXT = {"number": number_member, "string": string_member, "bool": bool_member, "timestamp": event_time}


def members(content: Column, dtype: T.DataType, wanted: Iterable[tuple[str, str]]) -> dict[tuple[str, str], Column]:
    """``{(path, kind): column}`` for the wanted members of ``content``."""
    wanted = list(wanted)
    if isinstance(dtype, T.StructType):
        return {(path, kind): _from_struct(content, dtype, path, kind) for path, kind in wanted}
    if len(wanted) == 1:
        (path, kind), = wanted
        return {(path, kind): _FROM_TEXT[kind](F.get_json_object(content, "$." + path))}
    parsed = F.from_json(content, _text_schema(path for path, _ in wanted))
    return {(path, kind): _FROM_TEXT[kind](_walk(parsed, path)) for path, kind in wanted}


def _walk(col: Column, path: str) -> Column:
    for part in path.split("."):
        col = col.getField(part)
    return col


def _text_schema(paths: Iterable[str]) -> T.StructType:
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.split("."):
            node = node.setdefault(part, {})

    def build(node: dict) -> T.DataType:
        if not node:
            return T.StringType()
        return T.StructType([T.StructField(name, build(sub)) for name, sub in node.items()])

    return build(tree)  # type: ignore[return-value]


def _from_struct(content: Column, dtype: T.StructType, path: str, kind: str) -> Column:
    leaf: T.DataType = dtype
    for part in path.split("."):
        if not isinstance(leaf, T.StructType) or part not in leaf.fieldNames():
            return F.lit(None).cast({"number": "double", "bool": "boolean"}.get(kind, kind))
        leaf = leaf[part].dataType
    value = _walk(content, path)
    if kind == "number" and isinstance(leaf, T.NumericType):
        return value.cast("double")
    if kind == "bool" and isinstance(leaf, T.BooleanType):
        return value
    if kind == "timestamp" and isinstance(leaf, (T.TimestampType, T.TimestampNTZType)):
        return value.cast("timestamp")
    return _FROM_TEXT[kind](value.cast("string"))
