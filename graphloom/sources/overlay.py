"""The star-schema tables as a property graph, so that queries and their SQL share data.

Tables are opened when a query asks for their label.  Line items are edges, not nodes: their key
repeats, and edges are a bag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import Graph


class Opened(dict):
    """Labels whose tables are made at first use."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        super().__init__(makers)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, label: str) -> DataFrame:
        if label not in self._made:
            self._made[label] = super().__getitem__(label)()
        return self._made[label]

    def items(self):
        return [(label, self[label]) for label in self]

    def values(self):
        return [self[label] for label in self]


#: table -> (label, column prefix, key, columns as properties)
_NODES = {
    "region": ("Region", "r_", "regionkey", "regionkey name"),
    "nation": ("Nation", "n_", "nationkey", "nationkey name regionkey"),
    "customer": ("Customer", "c_", "custkey", "custkey name nationkey acctbal mktsegment"),
    "supplier": ("Supplier", "s_", "suppkey", "suppkey name nationkey acctbal"),
    "part": ("Part", "p_", "partkey", "partkey name brand type size retailprice"),
    "orders": ("SalesOrder", "o_", "orderkey", "orderkey custkey orderstatus totalprice orderpriority"),
    "events": ("Event", "", "event_id", "event_id user_id event_type value"),
    "documents": ("Document", "", "doc_id", "doc_id lang source n_chars"),
    "pages": ("Page", "", "page_id", "page_id url"),
}


#: What the star schema's foreign keys vouch for: the labels of the ends of edges.
ENDS = {
    "IN_REGION": ("Nation", "Region"),
    "IN_NATION": (None, "Nation"),
    "PLACED": ("Customer", "SalesOrder"),
    "CONTAINS": ("SalesOrder", "Part"),
    "SHIPPED_BY": ("SalesOrder", "Supplier"),
    "EMITTED": ("User", "Event"),
    "NEXT": ("Event", "Event"),
    "REPLIES_TO": ("Turn", "Turn"),
}


def _id(label: str, key: str):
    return F.concat(F.lit(f"{label.lower()}:"), F.col(key).cast("string"))


def overlay(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")

    def node(table: str) -> Callable[[], DataFrame]:
        label, prefix, key, props = _NODES[table]
        return lambda: read(table).select(_id(label, prefix + key).alias("id"), *[F.col(prefix + p).alias(p) for p in props.split()])

    def edge(table: str, src: tuple[str, str], dst: tuple[str, str], *props) -> DataFrame:
        return read(table).select(_id(*src).alias("src"), _id(*dst).alias("dst"), *props)

    def turns() -> DataFrame:
        return read("conversations").select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("id"), "conv_id", "turn", "role")

    def in_nation() -> DataFrame:
        return edge("customer", ("Customer", "c_custkey"), ("Nation", "c_nationkey")).unionByName(edge("supplier", ("Supplier", "s_suppkey"), ("Nation", "s_nationkey")))

    def next_event() -> DataFrame:
        after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
        rows = read("events").select("event_id", after.alias("_after")).where("_after is not null")
        return rows.select(_id("Event", "event_id").alias("src"), _id("Event", "_after").alias("dst"))

    def replies() -> DataFrame:
        rows = read("conversations").where("turn > 0")
        return rows.select(F.concat_ws(":", F.lit("turn"), "conv_id", "turn").alias("src"), F.concat_ws(":", F.lit("turn"), "conv_id", F.col("turn") - 1).alias("dst"))

    items = [F.col(f"l_{c}").alias(c) for c in ("linenumber", "quantity", "extendedprice", "discount", "returnflag", "linestatus")]
    nodes = {_NODES[t][0]: node(t) for t in _NODES}
    nodes["User"] = lambda: read("events").select("user_id").distinct().select(_id("User", "user_id").alias("id"), "user_id")
    nodes["Turn"] = turns
    edges = {
        "IN_REGION": lambda: edge("nation", ("Nation", "n_nationkey"), ("Region", "n_regionkey")),
        "IN_NATION": in_nation,
        "PLACED": lambda: edge("orders", ("Customer", "o_custkey"), ("SalesOrder", "o_orderkey")),
        "CONTAINS": lambda: edge("lineitem", ("SalesOrder", "l_orderkey"), ("Part", "l_partkey"), *items),
        "SHIPPED_BY": lambda: edge("lineitem", ("SalesOrder", "l_orderkey"), ("Supplier", "l_suppkey"), *items[:2]),
        "EMITTED": lambda: edge("events", ("User", "user_id"), ("Event", "event_id")),
        "NEXT": next_event,
        "REPLIES_TO": replies,
    }
    return Graph(spark, Opened(nodes), Opened(edges), ends=ENDS)
