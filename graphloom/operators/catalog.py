"""Registered queries of the enrichment, comparison and report operators, over the overlay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.graph import Graph
from ..sources.overlay import overlay
from . import dump, enrich


def _items(spark: SparkSession, sf_dir: str, *columns) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    return parts.select(F.concat(F.lit("item:"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws("::", "p_brand", F.col("p_partkey").cast("string")).alias("qname"), F.col("p_name").alias("name"), F.lit("fn").alias("kind"), *columns)


def dup_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir, F.col("p_name").alias("signature_hash"))
    return enrich.dup_clusters(items)


def bounded_context_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    crate = F.concat(F.lit("domain-"), F.lower("c_mktsegment"))
    items = customers.select(F.concat(F.lit("item:"), F.col("c_custkey").cast("string")).alias("id"), crate.alias("crate"))
    graph, _ = enrich.bounded_context(Graph(spark, {"Item": items}), {"domain-building": "construction"})
    return graph.nodes["Item"].groupBy("bounded_context").agg(F.count("*").alias("n"))


def concepts_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _items(spark, sf_dir, F.col("p_brand").alias("crate"))
    declared = [{"name": "first", "crates": ["Brand#11", "Brand#12"], "canonical_crate": "Brand#12"}, {"name": "second", "crates": ["Brand#12"]}, {"name": "idle", "crates": []}]
    graph, _ = enrich.concepts(Graph(spark, {"Item": items}), declared)
    edges = graph.all_edges()
    return edges.groupBy("label", "dst").agg(F.count("*").alias("n"))


def reachability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last turn of each conversation as an entry point, following what turns reply to."""
    g = overlay(spark, sf_dir)
    calls, turns = g.edges["REPLIES_TO"], g.nodes["Turn"]
    last = turns.select("id").join(calls.select(F.col("dst").alias("id")), "id", "left_anti")
    entries = last.select(F.concat(F.lit("entry:"), "id").alias("id"), F.lit("cli_command").alias("kind"))
    exposes = last.select(F.concat(F.lit("entry:"), "id").alias("src"), F.col("id").alias("dst"))
    graph, _ = enrich.reachability(Graph(spark, {"Item": turns, "EntryPoint": entries}, {"CALLS": calls, "EXPOSES": exposes}))
    return graph.nodes["Item"].select("conv_id", "turn", "reachable_entry_count", "reachable_from_entry")


def _sides(spark: SparkSession, sf_dir: str) -> dump.Diff:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("k"))
    a = c.where("k % 10 <> 0")
    b = c.where("k % 10 <> 1").withColumn("segment", F.when(F.col("k") % 10 == 2, "moved").otherwise(F.col("segment")))
    return dump.diff(Graph(spark, {"Customer": a}), Graph(spark, {"Customer": b}))


def diff_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).added.select(F.split("key", "\x1f")[1].alias("id"))


def diff_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).removed.select(F.split("key", "\x1f")[1].alias("id"))


def diff_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).changed.select(F.split("key", "\x1f")[1].alias("id"), F.get_json_object("b", "$.props.segment").alias("segment"))


def recall_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    of = lambda t: parts.where(t).select(F.col("p_name").alias("name"))
    return dump.compute_recall(of("p_size <= 40"), of("p_size > 20 and p_partkey % 50 = 0"), of("p_size = 7")).missing


def dump_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = overlay(spark, sf_dir)
    small = Graph(spark, {k: g.nodes[k] for k in ("Region", "Nation")}, {"IN_REGION": g.edges["IN_REGION"]})
    return dump.dump_lines(small).where("part = 1").select("line")


_C = "'customer:' || CAST(c_custkey AS VARCHAR)"
#: name -> (function, SQL or None)
_ALL: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "dup_clusters": (dup_clusters, "SELECT p_name AS signature_hash, sha256(string_agg(p_brand || '::' || CAST(p_partkey AS VARCHAR), chr(10) ORDER BY p_brand || '::' || CAST(p_partkey AS VARCHAR))) AS dup_cluster_id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) >= 2"),
    "bounded_context_map": (bounded_context_map, "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'construction' ELSE lower(c_mktsegment) END AS bounded_context, count(*) AS n FROM customer GROUP BY 1"),
    "concepts_edges": (concepts_edges, "SELECT label, dst, count(*) AS n FROM (SELECT 'LABELED_AS' AS label, 'concept:first' AS dst FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') UNION ALL SELECT 'LABELED_AS', 'concept:second' FROM part WHERE p_brand = 'Brand#12' UNION ALL SELECT 'CANONICAL_FOR', 'concept:first' FROM part WHERE p_brand = 'Brand#12') t GROUP BY label, dst"),
    "reachability_counts": (reachability_counts, "SELECT conv_id, turn, CAST(1 AS BIGINT) AS reachable_entry_count, true AS reachable_from_entry FROM conversations"),
    "diff_added": (diff_added, f"SELECT {_C} AS id FROM customer WHERE c_custkey % 10 = 0"),
    "diff_removed": (diff_removed, f"SELECT {_C} AS id FROM customer WHERE c_custkey % 10 = 1"),
    "diff_changed": (diff_changed, f"SELECT {_C} AS id, 'moved' AS segment FROM customer WHERE c_custkey % 10 = 2"),
    "recall_set": (recall_set, "SELECT DISTINCT p_name AS name FROM part WHERE p_size <= 40 AND p_name NOT IN (SELECT p_name FROM part WHERE p_size = 7) AND p_name NOT IN (SELECT p_name FROM part WHERE p_size > 20 AND p_partkey % 50 = 0)"),
    "dump_lines": (dump_lines, """SELECT '{"dst_qname":"region:' || CAST(n_regionkey AS VARCHAR) || '","kind":"edge","label":"IN_REGION","src_qname":"nation:' || CAST(n_nationkey AS VARCHAR) || '"}' AS line FROM nation"""),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in _ALL.items() if s}
