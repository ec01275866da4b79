"""Filling request templates: text, typed JSON, argument paths, payload references.

Substitution is one pass: the template is cut at its placeholders and the
pieces are joined with the values, so a value that looks like a placeholder is
never filled again.  A template with an unknown name gives null.

``render_*`` takes a template.  ``*_parts`` cuts it and ``fill_*`` fills the cut
one: a definition is cut once, however many rows it is filled for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns of the template language.
_TEXT_HOLE = r"\{\{([^}]*)\}\}"
_JSON_HOLE = r'"\{\{([^}]*)\}\}"'
_PAYLOAD_HOLE = r"@@([^@}]*)@@"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def _cut(template: Column, hole: str) -> Column:
    """``struct<first, holes>``: the text before the first placeholder and, for each, its ``name`` and the text ``after`` it."""
    names = F.regexp_extract_all(template, F.lit(hole), F.lit(1))

    def cut(pieces: Column) -> Column:
        after = F.slice(pieces, F.lit(2), F.size(pieces))
        holes = F.zip_with(names, after, lambda name, text: F.struct(name.alias("name"), text.alias("after")))
        return F.struct(pieces[0].alias("first"), holes.alias("holes"))

    return _let(F.split(template, hole, -1), cut)


def _fill(parts: Column, value_of: Callable[[Column], Column]) -> Column:
    # a missing value is null and makes the whole text null
    return F.aggregate(parts["holes"], parts["first"], lambda text, hole: F.concat(text, value_of(hole), hole["after"]))


def text_parts(template: Column) -> Column:
    """A text template cut for :func:`fill_text`; made once for a definition, filled for each row."""
    return _cut(template, _TEXT_HOLE)


def fill_text(parts: Column, values: Column) -> Column:
    return _fill(parts, lambda hole: F.try_element_at(values, hole["name"]))


def render_text(template: Column, values: Column) -> Column:
    """``{{name}}`` in URLs, headers and sleep durations; ``values`` is a string map."""
    return _let(text_parts(template), lambda parts: fill_text(parts, values))


def json_literal(value: Column, kind: Column) -> Column:
    """``value`` as JSON of the declared type; null if it does not fit."""
    return _let(value, lambda v: _literal(v, F.lower(kind)))


def _literal(value: Column, kind: Column) -> Column:
    number = F.when(
        value.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"), value
    ).otherwise(value.try_cast("decimal(38,10)").cast("string"))
    # An array of one string is the quoted string in brackets.
    text = F.when(value.isNotNull(), F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", ""))
    return (
        F.when(kind.isin("string", "guid"), text)
        .when(kind.isin("number", "unsignedint", "signedint"), number)
        .when(kind.isin("object", "array"), value)
        .when(kind == "boolean", F.lower(value))
        .when(kind == "null", F.lit("null"))
    )


def payload_parts(template: Column, kinds: Column) -> Column:
    """A payload template cut for :func:`fill_payload`, its placeholders with ``path``, where one is asked for, and ``kind``.

    ``kinds`` maps names to declared types.
    """

    def typed(hole: Column) -> Column:
        name = hole["name"]
        whole = F.replace(name, F.lit("@"), F.lit(""))
        root = F.regexp_extract(whole, r"^([^\[.]*)", 1)
        path = F.concat(F.lit("$"), F.substring(whole, F.length(root) + 1, F.length(whole)))
        asked = F.startswith(name, F.lit("@@"))
        return F.struct(
            F.when(asked, root).otherwise(name).alias("name"), F.when(asked, path).alias("path"),
            F.lower(F.try_element_at(kinds, name)).alias("kind"), hole["after"].alias("after"),
        )

    return _let(
        _cut(template, _JSON_HOLE),
        lambda parts: F.struct(parts["first"].alias("first"), F.transform(parts["holes"], typed).alias("holes")),
    )


def fill_payload(parts: Column, values: Column) -> Column:
    def value_of(hole: Column) -> Column:
        def as_json(v: Column) -> Column:
            at_path = F.to_json(F.try_variant_get(F.try_parse_json(v), hole["path"], "variant"))
            return F.when(hole["path"].isNotNull(), at_path).otherwise(_literal(v, hole["kind"]))

        return _let(F.try_element_at(values, hole["name"]), as_json)

    return _fill(parts, value_of)


def render_payload(template: Column, values: Column, kinds: Column) -> Column:
    """``"{{name}}"`` becomes a typed literal, ``"{{@@arg[1].x@@}}"`` the JSON found at that path.

    ``values`` maps names to text, ``kinds`` maps names to declared types.
    """
    return _let(payload_parts(template, kinds), lambda parts: fill_payload(parts, values))


def fill_url(parts: Column, values: Column, payload: Column) -> Column:
    def at_path(hole: Column) -> Column:
        return F.call_function("get_json_object", payload, F.concat(F.lit("$."), hole["name"]))

    def referred(text: Column) -> Column:
        filled = _let(_cut(text, _PAYLOAD_HOLE), lambda cut: _fill(cut, at_path))
        # a text without the mark has nothing to fill
        return F.when(payload.isNull() | ~F.contains(text, F.lit("@@")), text).otherwise(filled)

    return _let(fill_text(parts, values), referred)


def render_url(template: Column, values: Column, payload: Column) -> Column:
    """Text placeholders first, then ``@@key.sub@@`` references into the rendered payload."""
    return _let(text_parts(template), lambda parts: fill_url(parts, values, payload))


def query_string(parameters: Column) -> Column:
    """``array<struct<key, value>>`` → encoded ``k=v&k=v``."""
    return F.array_join(
        F.transform(parameters, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))), "&"
    )


def header_parts(headers: Column) -> Column:
    """Headers cut for :func:`fill_headers`."""
    return F.transform(headers, lambda h: F.struct(text_parts(h["key"]).alias("key"), text_parts(h["value"]).alias("value")))


def fill_headers(parts: Column, values: Column) -> Column:
    return F.transform(
        parts, lambda h: F.struct(fill_text(h["key"], values).alias("key"), fill_text(h["value"], values).alias("value"))
    )


def render_headers(headers: Column, values: Column) -> Column:
    return F.transform(
        headers,
        lambda h: F.struct(render_text(h["key"], values).alias("key"), render_text(h["value"], values).alias("value")),
    )


def missing_arguments(arguments: Column, values: Column) -> Column:
    """Names of ``array<struct<name, type>>`` without a value; empty when complete."""
    names = F.transform(F.coalesce(arguments, F.array().cast("array<struct<name:string,type:string>>")), lambda a: a["name"])
    return F.filter(names, lambda n: ~F.map_contains_key(values, n))


def return_values(payload: Column, specs: Column) -> Column:
    """``array<struct<key, value>>`` of JSON paths → map of what the response holds; absent paths are left out."""
    found = F.transform(specs, lambda s: F.struct(s["key"], F.call_function("get_json_object", payload, s["value"]).alias("value")))
    return F.map_from_entries(F.filter(found, lambda kv: kv["value"].isNotNull()))


def sleep_us(duration: Column, units: Column) -> Column:
    """Sleep duration text and unit → microseconds."""
    factor = (
        F.when(F.lower(units) == "milliseconds", F.lit(1_000))
        .when(F.lower(units) == "seconds", F.lit(1_000_000))
        .when(F.lower(units) == "minutes", F.lit(60_000_000))
    )
    return (duration.try_cast("decimal(20,6)") * factor).cast("bigint")
