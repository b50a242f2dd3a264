"""Schemas of descriptions and queries, compiled to a Column that lists what is wrong with each document (B-16).

Documents are JSON texts, read as variants, so that a value of the wrong kind is seen as it is. One projection checks all fields of all
documents, lists and nested objects included; ``check`` says the same of one document on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


@dataclass(frozen=True)
class Text:
    """A text, of a list of texts if one is given."""

    one_of: Sequence[str] = ()


@dataclass(frozen=True)
class Number:
    whole: bool = False


@dataclass(frozen=True)
class Free:
    """An object or a text of any content."""


@dataclass(frozen=True)
class Items:
    of: object
    #: Whether a single value may stand for a list of one.
    single: bool = False


@dataclass(frozen=True)
class Fields:
    """An object; null fields are as good as missing ones unless ``required``. ``closed`` objects have no other fields."""

    fields: Mapping[str, object] = field(default_factory=dict)
    required: Sequence[str] = ()
    closed: bool = False


@dataclass(frozen=True)
class ByType:
    """An object whose field ``type`` says which of several it is."""

    kinds: Mapping[str, Fields]


_ANY_TEXT = Text()
_TEXTS = Items(_ANY_TEXT)
_MANY = Items(_ANY_TEXT, single=True)
# The fields of descriptions and queries, their kinds and permitted values.
DESCRIPTION = Fields(
    {
        **dict.fromkeys(("title", "description", "url", "date_published", "date_updated", "original_identifier"), _ANY_TEXT), "keywords": _TEXTS,
        **dict.fromkeys(("license", "provenance", "additional_info"), Free()),
        "implicit_variables": Items(Fields({"name": _ANY_TEXT, "value": _ANY_TEXT, "semantic_type": _MANY})),
        "variables": Items(Fields({"name": _ANY_TEXT, "description": _ANY_TEXT, "semantic_type": _TEXTS, "named_entity": _TEXTS, "temporal_coverage": Fields({"start": _ANY_TEXT, "end": _ANY_TEXT}), "spatial_coverage": Free()})),
        "materialization": Fields({"source": _ANY_TEXT, "arguments": Free()}, required=("source",)),
    },
    required=("materialization",),
)
_RELATION = Text(("contains", "similar", "correlated", "anti-correlated", "mutually-informative", "mutually-uninformative"))
_PLACE = Text(("country", "state", "city", "county", "postalcode"))
_SPAN = Fields({"after": _ANY_TEXT, "before": _ANY_TEXT})
_ENTITY = ByType({
    "temporal_entity": Fields({"start": _ANY_TEXT, "end": _ANY_TEXT, "granularity": Text(("year", "month", "day", "hour", "minute", "second"))}),
    "geospatial_entity": Fields({
        "circle": Fields({"latitude": Number(), "longitude": Number(), "radius": _ANY_TEXT, "granularity": _PLACE}),
        "bounding_box": Fields({**dict.fromkeys(("latitude1", "longitude1", "latitude2", "longitude2"), Number()), "granularity": _PLACE}),
        "named_entities": Fields({"semantic_type": Text(tuple(f"http://schema.org/{x}" for x in ("AdministrativeArea", "Country", "City", "State"))), "items": _TEXTS}),
    }),
    "dataframe_columns": Fields({"index": Items(Number(whole=True)), "names": _TEXTS, "relationship": _RELATION}),
    "generic_entity": Fields({**dict.fromkeys(("variable_name", "variable_metadata", "variable_description", "variable_syntactic_type", "variable_semantic_type"), _MANY), "about": _ANY_TEXT, "column_values": Fields({"items": Items(_ANY_TEXT), "relationship": _RELATION})}),
})
QUERY = Fields(
    {"dataset": Fields({**dict.fromkeys(("name", "description", "keywords", "creator", "publisher", "url"), _MANY), "about": _ANY_TEXT, "date_published": _SPAN, "date_created": _SPAN}, closed=True), "required_variables": Items(_ENTITY), "desired_variables": Items(_ENTITY)},
    closed=True,
)


def _kind(v: Column) -> Column:
    """BIGINT, STRING, ARRAY, OBJECT, ...; VOID for null, null for what is missing."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _none() -> Column:
    return F.array().cast("array<string>")


def _said(path: Column, what: str) -> Column:
    return F.array(F.concat(path, F.lit(f" {what}")))


def compiled(node: object, v: Column, path: Column) -> Column:
    """Violations (array<string>) of a variant; null and missing values have none."""
    there, kind = v.isNotNull() & ~F.coalesce(F.is_variant_null(v), F.lit(True)), _kind(v)
    if isinstance(node, Text):
        good = kind == "STRING"
        wrong = F.when(~good, _said(path, "must be a text"))
        if node.one_of:
            wrong = wrong.when(~F.try_variant_get(v, "$", "string").isin(list(node.one_of)), _said(path, f"must be one of {', '.join(node.one_of)}"))
        return F.when(there, F.coalesce(wrong, _none())).otherwise(_none())
    if isinstance(node, Number):
        good = kind.isin("BIGINT") if node.whole else kind.isin(*_NUMBERS)
        return F.when(there & ~good, _said(path, "must be a whole number" if node.whole else "must be a number")).otherwise(_none())
    if isinstance(node, Free):
        return F.when(there & ~kind.isin("OBJECT", "STRING"), _said(path, "must be an object")).otherwise(_none())
    if isinstance(node, Items):
        each = F.flatten(F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: _item(node.of, x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        other = compiled(node.of, v, path) if node.single else _said(path, "must be a list")
        return F.when(~there, _none()).when(kind == "ARRAY", each).otherwise(other)
    if isinstance(node, ByType):
        named = F.when(F.coalesce(_kind(F.try_variant_get(v, "$.type", "variant")) == "STRING", F.lit(False)), F.try_variant_get(v, "$.type", "string"))
        out = F.when(~there, _none()).when(kind != "OBJECT", _said(path, "must be an object"))
        for name, fields in node.kinds.items():
            out = out.when(named == name, compiled(fields, v, path))
        return out.otherwise(_said(path, f"must have a type of {', '.join(node.kinds)}"))
    begin = F.when(path == "", path).otherwise(F.concat(path, F.lit(".")))
    parts = []
    for name, child in node.fields.items():
        x, at = F.try_variant_get(v, f"$.{name}", "variant"), F.concat(begin, F.lit(name))
        if name in node.required:
            parts.append(F.when(x.isNull() | F.coalesce(F.is_variant_null(x), F.lit(True)), _said(at, "is required")).otherwise(_none()))
        parts.append(compiled(child, x, at))
    if node.closed:
        keys = F.array_sort(F.json_object_keys(F.to_json(v)))
        parts.append(F.transform(F.filter(F.coalesce(keys, _none()), lambda k: ~k.isin(list(node.fields))), lambda k: F.concat(F.lit("unknown key "), begin, k)))
    return F.when(~there, _none()).when(kind != "OBJECT", _said(F.when(path == "", F.lit("a document")).otherwise(path), "must be an object")).otherwise(F.concat(*parts))


def _item(node: object, x: Column, path: Column) -> Column:
    """As ``compiled``, but nulls in lists are no values of any kind."""
    return F.when(x.isNull() | F.is_variant_null(x), _said(path, "must not be null")).otherwise(compiled(node, x, path))


def violations(lines: DataFrame, node: object = DESCRIPTION, column: str = "line", name: str = "violations") -> DataFrame:
    """The lines (a JSON document each) with a list of what is wrong with them, empty for good ones."""
    v = F.try_parse_json(F.col(column))
    wrong = F.when(v.isNull(), F.array(F.lit("no JSON document"))).when(_kind(v) != "OBJECT", F.array(F.lit("a document must be an object"))).otherwise(compiled(node, v, F.lit("")))
    return lines.withColumn(name, wrong)


def check(node: object, value: object, path: str = "") -> list[str]:
    """Violations of one document."""
    if value is None:
        return []
    if isinstance(node, Text):
        return [f"{path} must be a text"] if not isinstance(value, str) else [f"{path} must be one of {', '.join(node.one_of)}"] if node.one_of and value not in node.one_of else []
    if isinstance(node, Number):
        good = isinstance(value, int if node.whole else (int, float)) and not isinstance(value, bool)
        return [] if good else [f"{path} must be a whole number" if node.whole else f"{path} must be a number"]
    if isinstance(node, Free):
        return [] if isinstance(value, (dict, str)) else [f"{path} must be an object"]
    if isinstance(node, Items):
        if not isinstance(value, (list, tuple)):
            return check(node.of, value, path) if node.single else [f"{path} must be a list"]
        return [w for i, x in enumerate(value) for w in ([f"{path}[{i}] must not be null"] if x is None else check(node.of, x, f"{path}[{i}]"))]
    if not isinstance(value, dict):
        return [f"{path or 'a document'} must be an object"]
    if isinstance(node, ByType):
        found = node.kinds.get(value.get("type")) if isinstance(value.get("type"), str) else None
        return check(found, value, path) if found else [f"{path} must have a type of {', '.join(node.kinds)}"]
    begin, out = f"{path}." if path else "", []
    for name, child in node.fields.items():
        if name in node.required and value.get(name) is None:
            out.append(f"{begin}{name} is required")
        out += check(child, value.get(name), begin + name)
    if node.closed:
        out += [f"unknown key {begin}{k}" for k in sorted(value) if k not in node.fields]
    return out
