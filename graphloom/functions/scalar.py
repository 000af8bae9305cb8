"""The scalar functions of the language, as column expressions, and regular expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import Val, as_string, missing

#: A JSON array of strings alone, and of integers alone.
_STRINGS = r'(?s)^\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\s*$'
_INTEGERS = r"^\s*\[\s*-?[0-9]+\s*(,\s*-?[0-9]+\s*)*\]\s*$"
_JACCARD_HIGH = 0.5


def java_pattern(pattern: str) -> str | None:
    """A pattern of a linear-time dialect in Java's: Unicode classes, `.` stops at \\n only and `$` is
    the end of the text.  None where that dialect has no such pattern."""
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k|[*+?}]\+", re.sub(r"\\\\", "", pattern)):
        return None  # look-around, back references, possessive quantifiers
    out, i, in_class = ["(?dU)"], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        in_class = c == "[" or (in_class and c != "]")
        out.append("\\z" if c == "$" and not in_class else c)
        i += 1
    return "".join(out)


def _valid(pattern: str) -> str | None:
    from pyspark.sql import SparkSession

    java = java_pattern(pattern)
    if java is None:
        return None
    session = SparkSession.getActiveSession()
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException:  # what a PatternSyntaxException is
        return None
    return java


def _pattern(v: Val) -> Column | None:
    if v.constant:
        java = _valid(v.constant[0]) if isinstance(v.constant[0], str) else None
        return F.lit(java) if java is not None else None
    return F.concat(F.lit("(?dU)"), F.regexp_replace(as_string(v), r"(?<!\\)\$", r"\\\\z"))


def matches(text: Val, pattern: Val) -> Column:
    """Whether the pattern occurs anywhere; invalid patterns never do."""
    p = _pattern(pattern)
    return F.lit(False) if p is None else F.regexp_like(as_string(text), p)


def _regexp_extract(text: Val, pattern: Val) -> Val:
    p = _pattern(pattern)
    return missing() if p is None else Val("str", F.regexp_substr(as_string(text), p))


def _starts_with(text: Val, prefix: Val) -> Val:
    return Val("bool", F.startswith(as_string(text), as_string(prefix)))


def _ends_with(text: Val, suffix: Val) -> Val:
    return Val("bool", F.endswith(as_string(text), as_string(suffix)))


def _size(v: Val) -> Val:
    return Val("int", (F.size(v.col) if v.kind == "list" else F.char_length(as_string(v))).cast("long"))


def _last_segment(v: Val) -> Val:
    return Val("str", F.substring_index(as_string(v), "::", -1))


def _squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def _squeezed_of(v: Val) -> Column:
    return v.col if v.kind == "squeezed" else _squeezed(as_string(v))


def _signature_divergent(a: Val, b: Val) -> Val:
    return Val("bool", _squeezed_of(a) != _squeezed_of(b))


def _entries(v: Val) -> tuple[Column, Column, Column]:
    """Distinct entries as strings, their type (0 none, 1 strings, 2 integers; NULL if invalid), and
    whether there is a text."""
    if v.kind == "entries":
        return v.col["x"], v.col["t"], v.col.isNotNull()
    c = as_string(v)
    integers = F.from_json(c, "array<bigint>")
    whole = F.regexp_like(c, F.lit(_INTEGERS)) & ~F.exists(F.coalesce(integers, F.array(F.lit(None).cast("bigint"))), lambda x: x.isNull())
    kind = F.when(F.regexp_like(c, F.lit(r"^\s*\[\s*\]\s*$")), 0).when(F.regexp_like(c, F.lit(_STRINGS)), 1).when(whole, 2)
    values = F.when(kind == 2, integers.cast("array<string>")).when(kind < 2, F.from_json(c, "array<string>"))
    return F.array_distinct(values), F.when(values.isNotNull(), kind), c.isNotNull()


def _subset(a: Val, b: Val) -> Column:
    (x, tx, has_a), (y, ty, has_b) = _entries(a), _entries(b)
    return F.when(has_a & has_b, F.coalesce((tx == 0) | ((tx == ty) & (F.size(F.array_except(x, y)) == 0)), F.lit(False)))


def _jaccard(a: Val, b: Val) -> Column:
    (x, tx, has_a), (y, ty, has_b) = _entries(a), _entries(b)
    share = F.when((tx == ty) & (tx > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))
    return F.when(has_a & has_b, F.coalesce(share, F.lit(0.0)))


def _entries_subset(a: Val, b: Val) -> Val:
    return Val("bool", _subset(a, b))


def _entries_jaccard(a: Val, b: Val) -> Val:
    return Val("float", _jaccard(a, b))


def _overlap_verdict(a: Val, b: Val, hash_a: Val, hash_b: Val) -> Val:
    known = _entries(a)[2] & _entries(b)[2] & as_string(hash_a).isNotNull() & as_string(hash_b).isNotNull()
    verdict = (
        F.when(as_string(hash_a) == as_string(hash_b), "CONST_TABLE_DUPLICATE")
        .when(_subset(a, b) | _subset(b, a), "CONST_TABLE_SUBSET")
        .when(_jaccard(a, b) >= _JACCARD_HIGH, "CONST_TABLE_INTERSECTION_HIGH")
        .otherwise("CONST_TABLE_NONE")
    )
    return Val("str", F.when(known, verdict))


#: name -> (number of arguments, builder); further functions may be added here.
FUNCTIONS: dict[str, tuple[int, Callable[..., Val]]] = {
    "regexp_extract": (2, _regexp_extract),
    "size": (1, _size),
    "starts_with": (2, _starts_with),
    "ends_with": (2, _ends_with),
    "last_segment": (1, _last_segment),
    "signature_divergent": (2, _signature_divergent),
    "entries_subset": (2, _entries_subset),
    "entries_jaccard": (2, _entries_jaccard),
    "overlap_verdict": (4, _overlap_verdict),
}

#: What each argument of a function on pairs is turned into first, once a row instead of once a pair.
PREPARED: dict[str, tuple[str | None, ...]] = {
    "signature_divergent": ("squeezed", "squeezed"),
    "entries_subset": ("entries", "entries"),
    "entries_jaccard": ("entries", "entries"),
    "overlap_verdict": ("entries", "entries", None, None),
}


def prepared(kind: str, v: Val) -> Val:
    """An argument in a form of PREPARED, NULL where it is no text."""
    if kind == "squeezed":
        return Val(kind, _squeezed(as_string(v)))
    values, own, present = _entries(v)
    return Val(kind, F.when(present, F.struct(values.alias("x"), own.alias("t"))))
