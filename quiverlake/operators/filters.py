"""Metadata filters with two-valued logic: a missing field makes a predicate false, so its negation is true.

Filters are small trees; :func:`to_column` turns one into a boolean Column over flat typed
columns, which Catalyst can push into the scan, or over a ``map<string, struct>`` of typed values.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class All:
    pass


@dataclass(frozen=True)
class Eq:
    field: str
    value: str | float | int | bool


@dataclass(frozen=True)
class Range:
    field: str
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


def eq(field, value):
    return Eq(field, value)


def ne(field, value):
    return Not(Eq(field, value))


def gt(field, v):
    return Range(field, low=v, low_open=True)


def gte(field, v):
    return Range(field, low=v)


def lt(field, v):
    return Range(field, high=v, high_open=True)


def lte(field, v):
    return Range(field, high=v)


def between(field, low, high):
    return Range(field, low, high)


def isin(field, values):
    return In(field, tuple(values))


def nin(field, values):
    return Not(In(field, tuple(values)))


def and_(*parts):
    if not parts:
        raise ValueError("and needs a child")
    return And(parts)


def or_(*parts):
    if not parts:
        raise ValueError("or needs a child")
    return Or(parts)


def not_(part):
    return Not(part)


KINDS = {"str": T.StringType, "bool": T.BooleanType}


def _kind_of(value) -> str:
    return "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num"


class FlatFields:
    """Fields that are columns; the column's type is the field's kind."""

    def __init__(self, schema: T.StructType):
        self.schema = {f.name: f.dataType for f in schema.fields}

    def of(self, field: str, kind: str) -> Column | None:
        t = self.schema.get(field)
        if t is None:
            return None
        fits = {"str": isinstance(t, T.StringType), "bool": isinstance(t, T.BooleanType), "num": isinstance(t, T.NumericType), "tags": isinstance(t, T.ArrayType) and isinstance(t.elementType, T.StringType)}
        return F.col(f"`{field}`") if fits[kind] else None


class MapFields:
    """Fields inside ``map<string, struct<kind,str,num,bool,tags>>``; the kind is each row's own."""

    def __init__(self, column: str = "metadata"):
        self.column = column

    def of(self, field: str, kind: str) -> Column | None:
        v = F.element_at(F.col(self.column), F.lit(field))
        return F.when(v["kind"] == kind, v[kind])


def to_column(f, fields) -> Column:
    """A boolean Column that is never null. No coercion: a string never equals a number, a range on
    a field that is no number is false, equality on tags means contains, ``in`` on tags means overlap."""
    return F.coalesce(to_where(f, fields), F.lit(False))


def to_where(f, fields) -> Column:
    """The same for a WHERE clause: null stands for false, which lets plain comparisons reach the scan.

    Where no negation is above it, a null is as good as false; a negation makes its part sure first.
    """
    never = F.lit(False)

    def any_of(*columns):
        out = None
        for c in columns:
            if c is not None:
                out = c if out is None else out | c
        return never if out is None else out

    if f is None or isinstance(f, All):
        return F.lit(True)
    if isinstance(f, Eq):
        kind = _kind_of(f.value)
        c = fields.of(f.field, kind)
        tags = fields.of(f.field, "tags") if kind == "str" else None
        return any_of(None if c is None else c == F.lit(f.value), None if tags is None else F.array_contains(tags, f.value))
    if isinstance(f, Range):
        c = fields.of(f.field, "num")
        if c is None:
            return never
        real = isinstance(fields, MapFields) or isinstance(fields.schema[f.field], (T.DoubleType, T.FloatType))
        out = c.isNotNull() & ~F.isnan(c) if real else c.isNotNull()
        if f.low is not None:
            out = out & ((c > f.low) if f.low_open else (c >= f.low))
        if f.high is not None:
            out = out & ((c < f.high) if f.high_open else (c <= f.high))
        return out
    if isinstance(f, In):
        columns = []
        for kind in ("str", "num", "bool"):
            values = [v for v in f.values if _kind_of(v) == kind]
            c = fields.of(f.field, kind) if values else None
            if c is not None:
                columns.append(c.isin(values))
            tags = fields.of(f.field, "tags") if values and kind == "str" else None
            if tags is not None:
                columns.append(F.arrays_overlap(tags, F.array(*[F.lit(v) for v in values])))
        return any_of(*columns)
    if isinstance(f, (And, Or)):
        parts = [to_where(p, fields) for p in f.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(f, And) else out | p
        return out
    if isinstance(f, Not):
        part = f.part
        if isinstance(part, (Eq, In)) and isinstance(fields, FlatFields) and part.field in fields.schema and not isinstance(fields.schema[part.field], T.ArrayType):
            return F.col(f"`{part.field}`").isNull() | ~to_where(part, fields)  # reaches the scan
        return ~to_column(part, fields)
    raise TypeError(f"no filter: {f!r}")


def apply(df: DataFrame, f, metadata: str | None = None) -> DataFrame:
    return df.where(to_where(f, MapFields(metadata) if metadata else FlatFields(df.schema)))


_LOGIC, _RANGE = ("and", "or", "not"), ("gt", "gte", "lt", "lte")


def parse_json(source) -> object:
    """The JSON filter language: ``{and|or|not}`` or ``{field, eq|ne|in|nin|gt|gte|lt|lte}``.

    A range may have both bounds; null and ``{}`` mean everything. Unknown operations, mixed
    kinds of operations, empty or mixed arrays and overlong field names are errors.
    """
    node = json.loads(source) if isinstance(source, str) else source
    if node is None or node == {}:
        return All()
    if not isinstance(node, dict):
        raise ValueError("a filter is an object")
    logic = [k for k in node if k in _LOGIC]
    if logic:
        if len(node) != 1:
            raise ValueError("a logical node has one key")
        key, value = next(iter(node.items()))
        if key == "not":
            return Not(parse_json(value))
        if not isinstance(value, list) or not value:
            raise ValueError(f"{key} needs a list of filters")
        return (And if key == "and" else Or)(tuple(parse_json(v) for v in value))
    field = node.get("field")
    if not isinstance(field, str) or not field or len(field) > 256:
        raise ValueError("field must be a name of at most 256 characters")
    ops = {k: v for k, v in node.items() if k != "field"}
    unknown = set(ops) - {"eq", "ne", "in", "nin", *_RANGE}
    if unknown or not ops:
        raise ValueError(f"unknown operation {sorted(unknown)}" if unknown else "no operation")
    ranged = [k for k in ops if k in _RANGE]
    if ranged:
        if len(ranged) != len(ops) or ("gt" in ops and "gte" in ops) or ("lt" in ops and "lte" in ops):
            raise ValueError("mixed operations")
        if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in ops.values()):
            raise ValueError("range bounds are numbers")
        return Range(field, ops.get("gt", ops.get("gte")), ops.get("lt", ops.get("lte")), "gt" in ops, "lt" in ops)
    if len(ops) != 1:
        raise ValueError("mixed operations")
    op, value = next(iter(ops.items()))
    if op in ("eq", "ne"):
        if not isinstance(value, (str, int, float, bool)):
            raise ValueError("value must be a string, number or boolean")
        return Eq(field, value) if op == "eq" else Not(Eq(field, value))
    if not isinstance(value, list) or not value or len({_kind_of(v) for v in value}) != 1 or any(not isinstance(v, (str, int, float)) for v in value):
        raise ValueError("a list of values of one kind is needed")
    return In(field, tuple(value)) if op == "in" else Not(In(field, tuple(value)))


def translate(node) -> object:
    """Filter expressions of document-store frameworks: ``{"op": ..., "key": ..., "value": ...}`` with EQ NE GT GTE LT LTE IN NIN, and
    ``{"op": "AND"|"OR", "left": ..., "right": ...}`` or ``{"op": "NOT", "child": ...}``; a list is joined by AND.

    NE and NIN are negations, so rows without the field match them.
    """
    if node is None or node == {} or node == []:
        return All()
    if isinstance(node, list):
        return And(tuple(translate(n) for n in node))
    op = str(node.get("op", "")).upper()
    if op in ("AND", "OR"):
        return (And if op == "AND" else Or)((translate(node["left"]), translate(node["right"])))
    if op == "NOT":
        return Not(translate(node["child"]))
    key, value = node.get("key"), node.get("value")
    if not isinstance(key, str) or not key:
        raise ValueError("a comparison needs a key")
    if op in ("EQ", "NE"):
        return Eq(key, value) if op == "EQ" else Not(Eq(key, value))
    if op in ("IN", "NIN"):
        return In(key, tuple(value)) if op == "IN" else Not(In(key, tuple(value)))
    if op in ("GT", "GTE", "LT", "LTE"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            raise ValueError(f"{op} compares numbers")
        return Range(key, value, None, op == "GT", False) if op[0] == "G" else Range(key, None, value, False, op == "LT")
    raise ValueError(f"unknown operation {op!r}")


# -- metadata values ----------------------------------------------------------------------------

VALUE_TYPE = "struct<kind:string,str:string,num:double,bool:boolean,tags:array<string>>"


def typed_metadata(json_column: Column) -> Column:
    """A JSON object to ``map<string, struct<kind,...>>``; numbers are doubles, arrays are tags, nulls and objects are dropped."""
    entries = F.map_entries(F.from_json(json_column, "map<string,variant>"))

    def value(e):
        v = e["value"]
        name = F.schema_of_variant(v)
        kind = (
            F.when(name == "STRING", "str").when(name == "BOOLEAN", "bool").when(name.startswith("ARRAY"), "tags")
            .when(name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL"), "num")
        )
        return F.struct(
            kind.alias("kind"),
            F.when(kind == "str", v.cast("string")).alias("str"),
            F.when(kind == "num", v.cast("double")).alias("num"),
            F.when(kind == "bool", v.cast("boolean")).alias("bool"),
            F.when(kind == "tags", v.cast("array<string>")).alias("tags"),
        )

    pairs = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), value(e).alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"]["kind"].isNotNull()))


def plain_metadata(column: Column) -> Column:
    """Typed metadata to ``map<string,string>``: booleans as text, tags joined by commas."""
    return F.transform_values(column, lambda _, v: F.when(v["kind"] == "str", v["str"]).when(v["kind"] == "num", v["num"].cast("string")).when(v["kind"] == "bool", v["bool"].cast("string")).otherwise(F.array_join(v["tags"], ",")))
