"""Canonical dump, its comparison, and recall."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import Val, as_string, kind_of
from ..sources.graph import ORD, Graph


#: Characters that JSON writes as escapes of their own.
_CONTROL = "[\\x00-\\x1f]"


def _quoted(c: Column) -> Column:
    """A string without control characters as JSON."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _few_digits(c: Column) -> Column:
    """Whether a number's text is the same in Java and in Python: no exponent, at most four digits behind the point."""
    tested = (F.abs(c) >= 1e-3) & (F.abs(c) < 1e7) & (F.rint(c * 1e4) / F.lit(1e4) == c)
    return F.when(c == 0, c.cast("string") == "0.0").otherwise(tested)


def _decimal(c: Column) -> Column:
    return c.cast("string")


def _in_python(c: Column) -> Column:
    """Any string or number as JSON."""
    return F.udf(lambda x: None if x is None else json.dumps(x, ensure_ascii=False), "string")(c)


#: How strings and finite numbers are written: by columns, or by Python where columns don't do.
_FAST, _SLOW = (_quoted, _decimal), (_in_python, _in_python)


def _json(kind: str, c: Column, ways) -> Column:
    """A value as JSON, NULL where it is missing."""
    text, number = ways
    if kind == "str":
        return text(c)
    if kind in ("int", "bool"):
        return c.cast("string")
    if kind == "float":
        c = c.cast("double")
        finite = F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)
        return F.when(c.isNotNull(), F.coalesce(number(finite), F.lit("null")))
    own = {0: F.lit("null"), 1: text(c["s"]), 2: c["i"].cast("string"), 3: _json("float", c["f"], ways), 4: c["b"].cast("string")}
    out = F.when(F.lit(False), "")
    for t, value in own.items():
        out = out.when(c["t"] == t, value)
    return out


def _plain(texts: list[Column], numbers: list[Column]) -> Column:
    """Whether columns write a row's strings and numbers as Python does."""
    out = ~F.regexp_like(F.concat_ws("", *texts), F.lit(_CONTROL))
    for c in numbers:
        out = out & F.coalesce(F.isnan(c) | (F.abs(c) == F.lit(math.inf)) | _few_digits(c), F.lit(True))
    return out


def _table_lines(kind: str, label: str, t: DataFrame, props: dict[str, str]) -> DataFrame:
    """The lines of one label's table, of which `_k1` and `_k2` are keys."""

    def lines(rows: DataFrame, ways) -> DataFrame:
        pieces = [F.concat(F.lit(json.dumps(p, ensure_ascii=False) + ":"), _json(props[p], F.col(f"`{p}`"), ways)) for p in sorted(props)]
        pair = lambda key, c: F.concat(F.lit(f'"{key}":'), ways[0](F.col(c)))
        head = F.concat_ws(",", F.lit(f'"kind":"{kind}","label":{json.dumps(label, ensure_ascii=False)}'), F.when(F.col("_props") != "", F.concat(F.lit('"props":{'), "_props", F.lit("}"))))
        whole = [pair("id", "id"), head] if kind == "node" else [pair("dst_qname", "_k2"), head, pair("src_qname", "_k1")]
        order = F.col(ORD) if ORD in rows.columns else F.lit(0).cast("long")
        rows = rows.withColumn("_props", F.concat_ws(",", *pieces) if pieces else F.lit(""))
        return rows.select(F.lit(0 if kind == "node" else 1).alias("part"), F.lit(label).alias("label"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), order.alias("ord"), F.concat(F.lit("{"), F.concat_ws(",", *whole), F.lit("}")).alias("line"))

    tagged = [p for p, own in props.items() if own == "tagged"]
    texts = [F.col(c) for c in (("id",) if kind == "node" else ("_k1", "_k2"))] + [F.col(f"`{p}`") for p, own in props.items() if own == "str"] + [F.col(f"`{p}`")["s"] for p in tagged]
    plain = _plain(texts, [F.col(f"`{p}`").cast("double") for p, own in props.items() if own == "float"] + [F.col(f"`{p}`")["f"] for p in tagged])
    return lines(t.where(plain), _FAST).unionByName(lines(t.where(~plain), _SLOW))


def _lines(graph: Graph) -> DataFrame:
    """The rows of dump_lines, in no order."""
    parts, named = [], None
    kinds = lambda t, *fixed: {f.name: kind_of(f.dataType) for f in t.schema.fields if f.name not in (*fixed, ORD)}
    for label, t in graph.nodes.items():
        props = kinds(t, "id")
        if props.get("qname") in ("str", "tagged"):
            own = as_string(Val(props["qname"], F.col("qname")))
            names = t.select("id", own.alias("_name")).where("_name is not null")
            named = names if named is None else named.unionByName(names)
            k1 = F.coalesce(own, F.col("id"))
        else:
            k1 = F.col("id")
        parts.append(_table_lines("node", label, t.withColumns({"_k1": k1, "_k2": F.lit("")}), props))
    for label, t in graph.edges.items():
        props = kinds(t, "src", "dst")
        for end, k in (("src", "_k1"), ("dst", "_k2")):
            if named is None:  # ids are the names
                t = t.withColumn(k, F.col(end))
            else:
                t = t.join(named.select(F.col("id").alias(end), F.col("_name").alias(f"_{end}_name")), end, "left").withColumn(k, F.coalesce(f"_{end}_name", end))
        parts.append(_table_lines("edge", label, t, props))
    if not parts:
        return graph.spark.createDataFrame([], "part int, label string, k1 string, k2 string, ord long, line string")
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def dump_lines(graph: Graph) -> DataFrame:
    """(part, label, k1, k2, ord, line), ordered: nodes by label and qualified name or id, then edges by
    label and those of their ends, ties as they came.  One JSON object a line, keys sorted, no empty props."""
    return _lines(graph).orderBy("part", "label", "k1", "k2", "ord", "line")


def canonical_dump(graph: Graph) -> str:
    """All lines on the driver: no newline at the end."""
    return "\n".join(r.line for r in dump_lines(graph).select("line").toLocalIterator())


@dataclass
class Diff:
    """added, removed(kind, key, line), changed(kind, key, a, b)"""

    added: DataFrame
    removed: DataFrame
    changed: DataFrame


def diff(a: Graph, b: Graph, kinds: tuple[str, ...] = ("node", "edge")) -> Diff:
    """Facts by their key (nodes: label and name; edges: label and both ends' names); of facts with
    one key the one that came last counts.  A full outer join of both sides."""

    def keyed(g: Graph, side: str) -> DataFrame:
        rows = _lines(g).withColumn("kind", F.when(F.col("part") == 0, "node").otherwise("edge")).where(F.col("kind").isin(*kinds))
        key = F.concat_ws("\x1f", "label", "k1", "k2")
        return rows.groupBy("kind", key.alias("key")).agg(F.max_by("line", F.struct("ord", "line")).alias(side))

    both = keyed(a, "a").join(keyed(b, "b"), ["kind", "key"], "full_outer")
    return Diff(
        both.where("a is null").select("kind", "key", F.col("b").alias("line")).orderBy("kind", "key"),
        both.where("b is null").select("kind", "key", F.col("a").alias("line")).orderBy("kind", "key"),
        both.where("a is not null and b is not null and a <> b").select("kind", "key", "a", "b").orderBy("kind", "key"),
    )


def diff_envelope(d: Diff, a: str, b: str) -> dict:
    one = lambda df: [{"kind": r.kind, "envelope": json.loads(r.line)} for r in df.collect()]
    out = {"a": a, "b": b, "schema_version": "v1", "added": one(d.added), "removed": one(d.removed)}
    changed = [{"kind": r.kind, "a": json.loads(r.a), "b": json.loads(r.b)} for r in d.changed.collect()]
    return out | ({"changed": changed} if changed else {})


#: Thresholds of recall: by default, for one crate, for all.
RECALL, RECALL_CRATE, RECALL_TOTAL = 0.95, 0.85, 0.90


@dataclass
class Recall:
    total: int
    matched: int
    missing: DataFrame
    audited: DataFrame
    recall: float
    passed: bool


def compute_recall(public: DataFrame, extracted: DataFrame, audit: DataFrame, threshold: float = RECALL) -> Recall:
    """Sets of one string column `name`: the share of public names without audited ones that were
    extracted.  Nothing to find passes."""
    public, extracted, audit = public.distinct(), extracted.distinct(), audit.distinct()
    adjusted = public.join(audit, "name", "left_anti")
    missing = adjusted.join(extracted, "name", "left_anti")
    total, lost = adjusted.count(), missing.count()
    share = 1.0 if total == 0 else (total - lost) / total
    return Recall(total, total - lost, missing.orderBy("name"), public.join(audit, "name", "left_semi").orderBy("name"), share, total == 0 or share >= threshold)


def names(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], "name string")
