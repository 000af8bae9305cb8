"""Labelled property graphs as DataFrames: one wide table for each node label and edge label.

A node table has id and a column for each property; an edge table src, dst and its properties.  Wide
typed tables let Spark prune columns and push filters down to the files.  A property of several
types, or with explicit nulls, is a tagged column (see functions.values).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import NATIVE, TAGGED, Val, kind_of, tag_value, tagged, untag
from ..plans.tables import stored

#: A column that keeps the order in which facts came, where a table has one; no property.
ORD = "_ord"
#: What this library writes; a reader takes graphs of its own major version up to itself.
SCHEMA_VERSION = (0, 3, 2)


@dataclass
class Graph:
    """nodes[label], edges[label]: tables.  warnings: what ingestion had to say.  ends[edge label]: the
    one node label of all sources and that of all targets (None where there are several), for edges
    whose ends are known to be nodes: a query that reads nothing of such an end needs no join."""

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=dict)
    edges: dict[str, DataFrame] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    ends: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    turns: int = 0  # how often facts were added

    def properties(self, of: str, label: str | None) -> dict[str, str]:
        """Kinds of the properties of a label (None: of all, tagged where they differ)."""
        tables, fixed = (self.nodes, {"id", ORD}) if of == "node" else (self.edges, {"src", "dst", ORD})
        out: dict[str, str] = {}
        for name in tables if label is None else [label] * (label in tables):
            for f in tables[name].schema.fields:
                if f.name not in fixed:
                    kind = kind_of(f.dataType)
                    out[f.name] = kind if out.get(f.name, kind) == kind else "tagged"
        return out

    def table(self, of: str, label: str | None, props: Iterable[str]) -> DataFrame:
        """id (or src, dst), label and the named properties, NULL where a table lacks one."""
        tables, fixed = (self.nodes, ["id"]) if of == "node" else (self.edges, ["src", "dst"])
        kinds = self.properties(of, label)
        parts = []
        for name in tables if label is None else [label] * (label in tables):
            t = tables[name]
            cols = [*fixed, F.lit(name).alias("label")]
            for p in sorted(set(props)):
                kind = kinds.get(p, "str")
                target = TAGGED if kind == "tagged" else NATIVE[kind]
                if p not in t.columns or p in fixed:
                    value = F.lit(None).cast(target)
                else:
                    own = Val(kind_of(t.schema[p].dataType), F.col(f"`{p}`"))
                    value = tagged(own) if kind == "tagged" else own.col.cast(target)
                cols.append(value.alias(f"p_{p}"))
            parts.append(t.select(*cols))
        if not parts:
            fields = [T.StructField(c, T.StringType()) for c in [*fixed, "label", *(f"p_{p}" for p in sorted(set(props)))]]
            return self.spark.createDataFrame([], T.StructType(fields))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def all_nodes(self) -> DataFrame:
        """(id, label, props, ord): canonical form, properties as a map of tagged values."""
        return self._canonical("node")

    def all_edges(self) -> DataFrame:
        """(src, dst, label, props, ord)"""
        return self._canonical("edge")

    def _canonical(self, of: str) -> DataFrame:
        tables, fixed = (self.nodes, ["id"]) if of == "node" else (self.edges, ["src", "dst"])
        parts = []
        for name, t in tables.items():
            pairs = []
            for f in t.schema.fields:
                if f.name not in (*fixed, ORD):
                    pairs.append(F.struct(F.lit(f.name).alias("key"), tagged(Val(kind_of(f.dataType), F.col(f"`{f.name}`").cast(NATIVE.get(kind_of(f.dataType), TAGGED)))).alias("value")))
            kind = f"array<struct<key:string,value:{TAGGED.simpleString()}>>"
            have = F.filter(F.array(*pairs), lambda x: x["value"].isNotNull()) if pairs else F.array().cast(kind)
            order = F.col(ORD) if ORD in t.columns else F.lit(0).cast("long")
            parts.append(t.select(*fixed, F.lit(name).alias("label"), F.map_from_entries(have).alias("props"), order.alias("ord")))
        if not parts:
            return self.spark.createDataFrame([], T.StructType([*(T.StructField(c, T.StringType()) for c in [*fixed, "label"]), T.StructField("props", T.MapType(T.StringType(), TAGGED)), T.StructField("ord", T.LongType())]))
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out


def _scalar(value: Any) -> Any:
    """A JSON value as a property: whole numbers beyond 64 bits are floats, arrays and objects null."""
    if isinstance(value, (list, dict)):
        return None
    if isinstance(value, int) and not isinstance(value, bool) and not -(1 << 63) <= value < 1 << 63:
        return float(value)
    return value


def _tables(spark: SparkSession, facts: list[dict], fixed: list[str]) -> dict[str, DataFrame]:
    by: dict[str, list[dict]] = {}
    for k, f in enumerate(facts):
        by.setdefault(f["label"], []).append(f | {ORD: k})
    out = {}
    for label, rows in by.items():
        kinds: dict[str, set] = {}
        for r in rows:
            for k, v in (r.get("props") or {}).items():
                v = _scalar(v)
                kinds.setdefault(k, set()).add("null" if v is None else "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "str")
        names = sorted(k for k in kinds if k not in fixed)
        native = {k: next(iter(kinds[k])) if len(kinds[k]) == 1 and kinds[k] != {"null"} else "tagged" for k in names}
        schema = T.StructType([*(T.StructField(c, T.StringType()) for c in fixed), *(T.StructField(k, NATIVE.get(native[k], TAGGED)) for k in names), T.StructField(ORD, T.LongType())])
        data = []
        for r in rows:
            props = r.get("props") or {}
            data.append((*(r[c] for c in fixed), *((None if k not in props else tag_value(_scalar(props[k])) if native[k] == "tagged" else _scalar(props[k])) for k in names), r[ORD]))
        out[label] = spark.createDataFrame(data, schema)
    return out


def graph_of(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """A graph of facts at hand.  A later node replaces an earlier one of its id, label and all
    properties included; an edge whose source or target is no node is left out with a warning."""
    last: dict[str, dict] = {}
    for n in nodes:
        last[n["id"]] = n
    kept, warnings = [], []
    for e in edges:
        gone = "src" if e["src"] not in last else "dst" if e["dst"] not in last else None
        if gone:
            warnings.append(f"edge {e['src']} -[{e['label']}]-> {e['dst']}: unknown {gone} id, edge skipped")
        else:
            kept.append(e)
    seen: dict[str, tuple[set, set]] = {}
    for e in kept:
        for side, end in zip(seen.setdefault(e["label"], (set(), set())), ("src", "dst")):
            side.add(last[e[end]]["label"])
    ends = {label: tuple(next(iter(s)) if len(s) == 1 else None for s in sides) for label, sides in seen.items()}
    return Graph(spark, _tables(spark, list(last.values()), ["id"]), _tables(spark, kept, ["src", "dst"]), warnings, ends)


def can_read(version: tuple[int, int, int]) -> bool:
    return version[0] == SCHEMA_VERSION[0] and tuple(version) <= SCHEMA_VERSION


#: Facts as rows: nodes have an id, edges src and dst; ord is the order in which they came.
FACTS = f"kind string, ord long, label string, id string, src string, dst string, props map<string,{TAGGED.simpleString()}>"
#: Warnings that name an edge; of further ones the number is told.
NAMED = 100


def fact_rows(facts: Iterable[tuple[str, int, dict]]) -> pa.RecordBatch:
    """(kind, ord, fact) as a batch of FACTS."""
    tag = [pa.field("t", pa.int8()), pa.field("s", pa.string()), pa.field("i", pa.int64()), pa.field("f", pa.float64()), pa.field("b", pa.bool_())]
    rows = []
    for kind, order, f in facts:
        props = [(k, dict(zip("tsifb", tag_value(_scalar(v))))) for k, v in (f.get("props") or {}).items()]
        rows.append({"kind": kind, "ord": order, "label": f["label"], "id": f.get("id"), "src": f.get("src"), "dst": f.get("dst"), "props": props})
    text = [pa.field(c, pa.string()) for c in ("label", "id", "src", "dst")]
    return pa.RecordBatch.from_pylist(rows, pa.schema([pa.field("kind", pa.string()), pa.field("ord", pa.int64()), *text, pa.field("props", pa.map_(pa.string(), pa.struct(tag)))]))


def graph_of_facts(facts: DataFrame) -> Graph:
    """A graph of FACTS, as graph_of makes it, without any of them on the driver: it gets the properties'
    types, the labels at the ends of edges, and the first warnings."""
    spark = facts.sparkSession
    facts = stored(facts, "facts")
    latest = facts.where("kind = 'node'").groupBy("id").agg(F.max_by(F.struct("label", "props", "ord"), "ord").alias("f")).select("id", "f.*")
    nodes = stored(latest, "nodes")
    of = lambda end: nodes.select(F.col("id").alias(end), F.col("label").alias(f"{end}_label"))
    every = stored(facts.where("kind = 'edge'").join(of("src"), "src", "left").join(of("dst"), "dst", "left"), "edges")
    whole = "src_label is not null and dst_label is not null"
    edges, gone = every.where(whole), every.where(f"not ({whole})")
    at = F.min(F.struct(F.col("src_label").alias("s"), F.col("dst_label").alias("d")))
    seen = edges.groupBy("label").agg(F.count_distinct("src_label").alias("ns"), F.count_distinct("dst_label").alias("nd"), at.alias("at")).collect()
    ends = {r.label: (r["at"].s if r.ns == 1 else None, r["at"].d if r.nd == 1 else None) for r in seen}
    lost = gone.count()
    warnings = [f"edge {e.src} -[{e.label}]-> {e.dst}: unknown {'src' if e.src_label is None else 'dst'} id, edge skipped" for e in gone.orderBy("ord").limit(NAMED).collect()]
    if lost > NAMED:
        warnings.append(f"{lost - NAMED} more edges without a node at an end skipped")
    return Graph(spark, _wide(nodes, ["id"]), _wide(edges, ["src", "dst"]), warnings, ends)


def _wide(facts: DataFrame, fixed: list[str]) -> dict[str, DataFrame]:
    """Fact rows as one table for each label, a typed column for each property."""
    tags = facts.select("label", F.explode_outer(F.map_entries("props")).alias("p")).groupBy("label", F.col("p.key").alias("key")).agg(F.sort_array(F.collect_set("p.value.t")).alias("t"))
    kinds: dict[str, dict[str, list[int]]] = {}
    for r in tags.collect():
        kinds.setdefault(r.label, {}).update({r.key: r.t} if r.key is not None and r.key not in fixed else {})
    native = {1: "str", 2: "int", 3: "float", 4: "bool"}
    out = {}
    for label, props in kinds.items():
        cols = []
        for key, t in sorted(props.items()):
            value = F.col("props")[key]
            cols.append((value[{1: "s", 2: "i", 3: "f", 4: "b"}[t[0]]] if len(t) == 1 and t[0] in native else value).alias(key))
        out[label] = facts.where(F.col("label") == label).select(*fixed, *cols, F.col("ord").alias(ORD))
    return out


def load_json(spark: SparkSession, path: str) -> Graph:
    """A keyspace file: {schema_version, nodes, edges}.  It is one JSON document, so one task parses it;
    the driver sees its version alone.  Large graphs are kept as Parquet tables (load_tables)."""

    def parsed(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                doc = json.loads(text)
                v = doc.get("schema_version", {})
                yield fact_rows([("version", 0, {"label": ".".join(str(v.get(k, 0)) for k in ("major", "minor", "patch"))})])
                for kind in ("node", "edge"):
                    own = doc[f"{kind}s"]
                    for at in range(0, len(own), 5000):
                        yield fact_rows((kind, k, own[k]) for k in range(at, min(at + 5000, len(own))))

    facts = stored(spark.read.text(path, wholetext=True).mapInArrow(parsed, FACTS), "keyspace")
    version = tuple(map(int, facts.where("kind = 'version'").first().label.split(".")))
    if not can_read(version):
        raise ValueError(f"a graph of version {'.'.join(map(str, version))} isn't readable by {'.'.join(map(str, SCHEMA_VERSION))}")
    return graph_of_facts(facts.where("kind <> 'version'"))


def _facts_of(df: DataFrame, keys: list[str]) -> Iterator[dict]:
    for row in df.toLocalIterator():
        props = {k: untag(v) for k, v in sorted(row.props.items())}
        yield {k: row[k] for k in keys} | {"label": row.label} | ({"props": props} if props else {})


def save_json(graph: Graph, path: str) -> None:
    """Writes a keyspace file, nodes by (label, id) and edges by (src, dst, label), a partition of them
    at a time on the driver."""
    parts = (("nodes", graph.all_nodes().orderBy("label", "id"), ["id"]), ("edges", graph.all_edges().orderBy("src", "dst", "label", "ord"), ["src", "dst"]))
    with open(path, "w", encoding="utf-8") as f:
        version = json.dumps(dict(zip(("major", "minor", "patch"), SCHEMA_VERSION)), indent=2).replace("\n", "\n  ")
        f.write('{\n  "schema_version": ' + version)
        for name, df, keys in parts:
            f.write(f',\n  "{name}": [')
            for k, fact in enumerate(_facts_of(df, keys)):
                f.write(("," if k else "") + "\n    " + json.dumps(fact, indent=2, ensure_ascii=False).replace("\n", "\n    "))
            f.write("\n  ]")
        f.write("\n}")


def save_tables(graph: Graph, path: str) -> None:
    """A folder for each label under path/nodes and path/edges, and the version."""
    for of, tables in (("nodes", graph.nodes), ("edges", graph.edges)):
        for label, t in tables.items():
            t.write.mode("overwrite").parquet(f"{path}/{of}/label={label}")
    index = json.dumps({"version": list(SCHEMA_VERSION), "nodes": sorted(graph.nodes), "edges": sorted(graph.edges)})
    graph.spark.createDataFrame([(index,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/graph")


def load_tables(spark: SparkSession, path: str) -> Graph:
    index = json.loads(spark.read.text(f"{path}/graph").first()[0])
    if not can_read(tuple(index["version"])):
        raise ValueError(f"a graph of version {index['version']} isn't readable")
    read = lambda of: {label: spark.read.parquet(f"{path}/{of}/label={label}") for label in index[of]}
    return Graph(spark, read("nodes"), read("edges"))


def merged(base: Graph, more: Graph) -> Graph:
    """base with the facts of more: nodes of more replace those of their ids in base; edges add up,
    those without both ends left out."""
    # what is added comes later: a range of ordinals for each addition
    turns = base.turns + more.turns + 1
    later = lambda t: t.withColumn(ORD, F.col(ORD) + (turns << 40)) if ORD in t.columns else t
    more = Graph(more.spark, {k: later(more.nodes[k]) for k in more.nodes}, {k: later(more.edges[k]) for k in more.edges}, more.warnings)
    nodes: dict[str, DataFrame] = {}
    ids = None
    for t in more.nodes.values():
        ids = t.select("id") if ids is None else ids.unionByName(t.select("id"))
    for label in {**base.nodes, **more.nodes}:
        parts = []
        if label in base.nodes:
            own = base.nodes[label]
            parts.append(own.join(ids, "id", "left_anti") if ids is not None else own)
        if label in more.nodes:
            parts.append(more.nodes[label])
        nodes[label] = parts[0] if len(parts) == 1 else _union(parts)
    every = None
    for t in nodes.values():
        every = t.select("id") if every is None else every.unionByName(t.select("id"))
    edges = {}
    for label in {**base.edges, **more.edges}:
        parts = [g.edges[label] for g in (base, more) if label in g.edges]
        own = parts[0] if len(parts) == 1 else _union(parts)
        if every is not None and label in more.edges:
            own = own.join(every.withColumnRenamed("id", "src"), "src", "left_semi").join(every.withColumnRenamed("id", "dst"), "dst", "left_semi")
        edges[label] = own
    return Graph(base.spark, nodes, edges, base.warnings + more.warnings, turns=turns)


def _union(parts: list[DataFrame]) -> DataFrame:
    """Union of tables whose properties may differ in presence and kind."""
    a, b = parts
    kinds: dict[str, set] = {}
    for t in parts:
        for f in t.schema.fields:
            kinds.setdefault(f.name, set()).add(kind_of(f.dataType))
    out = []
    for t in parts:
        cols = []
        for name, k in kinds.items():
            kind = next(iter(k)) if len(k) == 1 else "tagged"
            target = NATIVE.get(kind, TAGGED)
            if name not in t.columns:
                value = F.lit(None).cast(target)
            else:
                own = Val(kind_of(t.schema[name].dataType), F.col(f"`{name}`"))
                value = tagged(own) if kind == "tagged" else own.col.cast(target)
            cols.append(value.alias(name))
        out.append(t.select(*cols))
    return out[0].unionByName(out[1])
