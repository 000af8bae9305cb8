"""Scalar values in columns, with the language's two-valued comparisons.

A value is a column and its kind.  str, int, float and bool are native columns in which NULL means
missing.  A `tagged` column, struct(t, s, i, f, b), holds values of several types or explicit nulls
(t = 0); there a NULL struct means missing.  list values are arrays of one of these.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGGED = T.StructType([T.StructField("t", T.ByteType()), T.StructField("s", T.StringType()), T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("b", T.BooleanType())])
NATIVE = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}
_TAG = {"null": 0, "str": 1, "int": 2, "float": 3, "bool": 4}
_SLOT = {"str": "s", "int": "i", "float": "f", "bool": "b"}


@dataclass(frozen=True)
class Val:
    """constant: for literals and parameters, their value in a one-tuple."""

    kind: str
    col: Column
    element: str | None = None
    constant: tuple | None = None


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.StringType):
        return "str"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.FractionalType, T.DecimalType)):
        return "float"
    if data_type == TAGGED or (isinstance(data_type, T.StructType) and data_type.names == TAGGED.names):
        return "tagged"
    raise TypeError(f"no property type for {data_type.simpleString()}")


def literal(value: Any) -> Val:
    if value is None:
        return Val("null", F.lit(None).cast("string"), constant=(None,))
    kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "float" if isinstance(value, float) else "str"
    return Val(kind, F.lit(value).cast(NATIVE[kind]), constant=(value,))


def missing() -> Val:
    return Val("missing", F.lit(None).cast("string"))


def tag_value(value: Any) -> tuple:
    """A Python value as a tuple for a tagged column."""
    if value is None:
        return (0, None, None, None, None)
    if isinstance(value, bool):
        return (4, None, None, None, value)
    if isinstance(value, int):
        return (2, None, value, None, None)
    return (3, None, None, value, None) if isinstance(value, float) else (1, value, None, None, None)


def untag(row: Any) -> Any:
    return None if row is None else (None, row.s, row.i, row.f, row.b)[row.t]


def tagged(v: Val) -> Column:
    """Any scalar as a tagged column."""
    if v.kind == "tagged":
        return v.col
    if v.kind == "missing":
        return F.lit(None).cast(TAGGED)
    parts = [F.lit(_TAG[v.kind]).cast("byte").alias("t")]
    for kind, slot in _SLOT.items():
        parts.append((v.col.cast(NATIVE[kind]) if kind == v.kind else F.lit(None).cast(NATIVE[kind])).alias(slot))
    whole = F.struct(*parts)
    return whole if v.kind == "null" else F.when(v.col.isNotNull(), whole)


def _operator(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def compare(op: str, a: Val, b: Val) -> Column:
    """NULL or false where it doesn't hold: of a missing side, and of different types, `<>` too."""
    kinds = {a.kind, b.kind}
    if "missing" in kinds or "list" in kinds:
        return F.lit(False)
    if "tagged" not in kinds:
        if "null" in kinds:
            return F.lit(a.kind == b.kind and op in ("=", "<=", ">="))
        if a.kind == b.kind:
            return _operator(op, a.col, b.col)
        return _operator(op, a.col.cast("double"), b.col.cast("double")) if kinds == {"int", "float"} else F.lit(False)
    x, y = tagged(a), tagged(b)
    number = lambda c: F.when(c["t"] == 2, c["i"].cast("double")).when(c["t"] == 3, c["f"])
    return (
        F.when((x["t"] == 1) & (y["t"] == 1), _operator(op, x["s"], y["s"]))
        .when((x["t"] == 2) & (y["t"] == 2), _operator(op, x["i"], y["i"]))
        .when(x["t"].isin(2, 3) & y["t"].isin(2, 3), _operator(op, number(x), number(y)))
        .when((x["t"] == 4) & (y["t"] == 4), _operator(op, x["b"], y["b"]))
        .when((x["t"] == 0) & (y["t"] == 0), F.lit(op in ("=", "<=", ">=")))
        .otherwise(False)
    )


def same(a: Val, b: Val) -> Column:
    """Structural equality, without coercion: that of IN and of inline properties."""
    if "tagged" in (a.kind, b.kind):
        x, y = tagged(a), tagged(b)
        return (x["t"] == y["t"]) & x["s"].eqNullSafe(y["s"]) & x["i"].eqNullSafe(y["i"]) & x["f"].eqNullSafe(y["f"]) & x["b"].eqNullSafe(y["b"])
    if a.kind != b.kind or a.kind in ("missing", "list"):
        return F.lit(False)
    return F.lit(True) if a.kind == "null" else a.col == b.col


def as_string(v: Val) -> Column:
    """The string of a value, NULL for other types."""
    if v.kind == "str":
        return v.col
    return F.when(v.col["t"] == 1, v.col["s"]) if v.kind == "tagged" else F.lit(None).cast("string")


def sort_key(v: Val) -> Column:
    """The type-tagged string by which rows without an order are sorted."""
    if v.kind == "list":
        element = Val(v.element or "str", F.lit(None))
        return F.array_join(F.transform(v.col, lambda x: sort_key(Val(element.kind, x))), ",")
    if v.kind in ("null", "missing"):
        return F.lit("0:")
    one = {
        "bool": lambda c: F.concat(F.lit("1:"), c.cast("string")),
        "int": lambda c: F.concat(F.lit("2:"), F.format_string("%020d", c)),
        "float": lambda c: F.concat(F.lit("3:"), F.format_string("%020.10f", c)),
        "str": lambda c: F.concat(F.lit("4:"), c),
    }
    if v.kind != "tagged":
        return F.coalesce(one[v.kind](v.col), F.lit("0:"))
    c = v.col
    return F.when(c["t"] == 4, one["bool"](c["b"])).when(c["t"] == 2, one["int"](c["i"])).when(c["t"] == 3, one["float"](c["f"])).when(c["t"] == 1, one["str"](c["s"])).otherwise("0:")
