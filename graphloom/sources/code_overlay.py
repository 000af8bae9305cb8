"""The star-schema tables as a graph of code, so that rule programs and their SQL share data.

Parts are items, orders call sites, line items calls, nations entry points, regions contexts and
concepts, suppliers constant tables, benchmark items documents.  What a program asks for is derived
from keys and columns; ITEM_SQL and the others state the same in DuckDB's words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph
from .overlay import Opened

CRATES = ("domain-market", "adapters-market", "ports-market", "domain-ledger", "application-ledger", "infra-utils", "use-cases-trade", "domain-trade")
CONTEXTS = ("market", "market", "market", "ledger", "ledger", "infra-utils", "trade", "trade")
KINDS = ("fn", "method", "struct", "enum", "trait", "fn", "method")
JOINTS = ("_from_", "_to_", "_for_", "_as_", "_")
CALLEES = ("chrono::Utc::now", "Decimal::from_f64", "reqwest::Client::new", "ClientBuilder::new", "ledger::post", "raw::append", "Vec::push", "x::to_f64", "std::fs::read")
PARAMS = ("limit", "offset", "depth", "mode", "since")
DECLARED = (("market", "domain-market", "0"), ("ledger", "nowhere", ""), ("trade", "", "RFC-none"), ("idle", None, None), ("infra-utils", "infra-utils", "rfc-3"))


def _pick(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def code_overlay(spark: SparkSession, sf_dir: str) -> Graph:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = lambda c: F.col(c).cast("string")
    id_ = lambda label, c: F.concat(F.lit(f"{label}:"), text(c))

    def items() -> DataFrame:
        k = F.col("p_partkey")
        words = F.split("p_name", " ")
        crate, kind = _pick(CRATES, k % 8), _pick(KINDS, F.floor(k / 8) % 7)
        callable_ = kind.isin("fn", "method")
        name = F.when(callable_, F.concat(words[0], _pick(JOINTS, F.col("p_size") % 5), words[1])).otherwise(F.concat(words[0], words[1]))
        return read("part").select(
            id_("item", "p_partkey").alias("id"),
            F.concat_ws("::", crate, F.concat(F.lit("m"), text("p_partkey")), name).alias("qname"),
            name.alias("name"),
            kind.alias("kind"),
            crate.alias("crate"),
            _pick(CONTEXTS, k % 8).alias("bounded_context"),
            F.concat(F.lit("crates/"), crate, F.lit("/src/m"), (k % 10).cast("string"), F.lit(".rs")).alias("file"),
            (k + 1).alias("line"),
            (k % 11 == 0).alias("is_test"),
            (k % 13 == 0).alias("is_deprecated"),
            (k % 4 != 0).alias("reachable_from_entry"),
            F.when(callable_, F.concat(F.when(k % 3 == 0, "fn  (").otherwise("fn ("), F.lower(F.when(k % 2 == 0, F.lit("T")).otherwise(F.col("p_type"))), F.lit(")"))).alias("signature"),
            F.when(k % 17 != 0, F.col("p_size") % 20).cast("long").alias("unwrap_count"),
            F.when(k % 19 != 0, (k % 10) / F.lit(10.0)).alias("test_coverage"),
            F.when(k % 5 == 0, F.concat(F.lit("c"), text("p_size"))).alias("dup_cluster_id"),
        )

    def call_sites() -> DataFrame:
        k = F.col("o_orderkey")
        path = _pick(CALLEES, k % 9)
        return read("orders").select(id_("callsite", "o_orderkey").alias("id"), path.alias("callee_path"), F.substring_index(path, "::", -1).alias("callee_last_segment"), F.concat(F.lit("crates/"), _pick(CRATES, F.floor(k / 9) % 8), F.lit("/src/lib.rs")).alias("file"), (k % 7 == 0).alias("is_test"))

    def tables() -> DataFrame:
        k = F.col("s_suppkey")
        first = k % 10
        entries = F.concat(F.lit("["), F.array_join(F.sequence(first, first + k % 4), ","), F.lit("]"))
        crate = _pick(CRATES, k % 8)
        return read("supplier").select(id_("const_table", "s_suppkey").alias("id"), F.concat_ws("::", crate, F.col("s_name")).alias("qname"), crate.alias("crate"), F.when(k % 6 == 0, "u32").otherwise("i64").alias("element_type"), entries.alias("entries_normalized"), F.concat(F.lit("h"), entries).alias("entries_hash"), entries.alias("entries_sample"), (k % 4 + 1).alias("entry_count"), (k % 7 == 3).alias("is_test"))

    def contexts() -> DataFrame:
        k = F.col("r_regionkey")
        name, crate, rfc = zip(*DECLARED)
        return read("region").select(id_("context", "r_regionkey").alias("id"), _pick(name, k).alias("name"), _pick(crate, k).alias("canonical_crate"), _pick(rfc, k).alias("owning_rfc"))

    nodes = {
        "Item": items,
        "CallSite": call_sites,
        "ConstTable": tables,
        "Context": contexts,
        "Concept": lambda: read("region").select(id_("concept", "r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "Crate": lambda: read("part").select(_pick(CRATES, F.col("p_partkey") % 8).alias("name")).distinct().select(F.concat(F.lit("crate:"), "name").alias("id"), "name"),
        "RfcDoc": lambda: read("benchmark").select(id_("rfc", "item_id").alias("id"), F.concat(F.lit("docs/rfc-"), text("item_id"), F.lit(".md")).alias("path"), F.substring("text", 1, 20).alias("title")),
        "EntryPoint": lambda: read("nation").select(id_("entrypoint", "n_nationkey").alias("id"), F.col("n_name").alias("name"), id_("item", "n_nationkey").alias("handler_qname")),
        "Param": lambda: read("part").where("p_partkey % 4 = 1").select(id_("param", "p_partkey").alias("id"), _pick(PARAMS, F.floor(F.col("p_partkey") / 4) % 5).alias("name")).unionByName(read("nation").select(id_("wire", "n_nationkey").alias("id"), _pick(PARAMS, F.col("n_nationkey") % 5).alias("name"))),
    }
    edges = {
        "INVOKES_AT": lambda: read("orders").select(id_("item", "o_custkey").alias("src"), id_("callsite", "o_orderkey").alias("dst")),
        "CALLS": lambda: read("lineitem").select(id_("item", "l_partkey").alias("src"), id_("item", "l_suppkey").alias("dst")),
        "CANONICAL_FOR": lambda: read("part").where("p_size = 7").select(id_("item", "p_partkey").alias("src"), F.concat(F.lit("concept:"), (F.col("p_partkey") % 4).cast("string")).alias("dst")),
        "EXPOSES": lambda: read("nation").select(id_("entrypoint", "n_nationkey").alias("src"), id_("item", "n_nationkey").alias("dst")),
        "REGISTERS_PARAM": lambda: read("nation").select(id_("entrypoint", "n_nationkey").alias("src"), id_("wire", "n_nationkey").alias("dst")),
        "HAS_PARAM": lambda: read("part").where("p_partkey % 4 = 1").select(id_("item", "p_partkey").alias("src"), id_("param", "p_partkey").alias("dst")),
    }
    ends = {"INVOKES_AT": ("Item", "CallSite"), "CALLS": ("Item", "Item"), "CANONICAL_FOR": ("Item", "Concept"), "EXPOSES": ("EntryPoint", "Item"), "REGISTERS_PARAM": ("EntryPoint", "Param"), "HAS_PARAM": ("Item", "Param")}
    return Graph(spark, Opened(nodes), Opened(edges), ends=ends)


def _list(values: tuple, index: str) -> str:
    return f"([{', '.join('NULL' if v is None else chr(39) + v + chr(39) for v in values)}])[CAST({index} AS BIGINT) + 1]"


_CRATE = _list(CRATES, "p_partkey % 8")
_KIND = _list(KINDS, "(p_partkey // 8) % 7")
_NAME = f"CASE WHEN {_KIND} IN ('fn', 'method') THEN split_part(p_name, ' ', 1) || {_list(JOINTS, 'p_size % 5')} || split_part(p_name, ' ', 2) ELSE replace(p_name, ' ', '') END"
#: Common table expressions of the graph's nodes and edges.
CODE_SQL = f"""WITH item AS (SELECT p_partkey AS k, {_CRATE} || '::m' || CAST(p_partkey AS VARCHAR) || '::' || {_NAME} AS qname, {_NAME} AS name, {_KIND} AS kind, {_CRATE} AS crate,
 {_list(CONTEXTS, "p_partkey % 8")} AS bounded_context, 'crates/' || {_CRATE} || '/src/m' || CAST(p_partkey % 10 AS VARCHAR) || '.rs' AS file, p_partkey + 1 AS line, p_partkey % 11 = 0 AS is_test, p_partkey % 13 = 0 AS is_deprecated,
 p_partkey % 4 <> 0 AS reachable, CASE WHEN {_KIND} IN ('fn', 'method') THEN CASE WHEN p_partkey % 3 = 0 THEN 'fn  (' ELSE 'fn (' END || CASE WHEN p_partkey % 2 = 0 THEN 't' ELSE lower(p_type) END || ')' END AS signature, CASE WHEN p_partkey % 17 <> 0 THEN p_size % 20 END AS unwrap_count,
 CASE WHEN p_partkey % 19 <> 0 THEN (p_partkey % 10) / 10.0::DOUBLE END AS test_coverage, CASE WHEN p_partkey % 5 = 0 THEN 'c' || CAST(p_size AS VARCHAR) END AS dup_cluster_id FROM part),
callsite AS (SELECT o_orderkey AS k, o_custkey AS src, {_list(CALLEES, "o_orderkey % 9")} AS callee_path, 'crates/' || {_list(CRATES, "(o_orderkey // 9) % 8")} || '/src/lib.rs' AS file, o_orderkey % 7 = 0 AS is_test FROM orders),
called AS (SELECT i.qname, i.crate, i.reachable, i.is_test OR c.is_test AS in_test, c.callee_path, c.file FROM callsite c JOIN item i ON i.k = c.src),
calls AS (SELECT l_partkey AS src, l_suppkey AS dst FROM lineitem),
canonical AS (SELECT p_partkey AS k, p_partkey % 4 AS concept FROM part WHERE p_size = 7),
context AS (SELECT r_regionkey AS k, {_list(tuple(d[0] for d in DECLARED), "r_regionkey")} AS name, {_list(tuple(d[1] for d in DECLARED), "r_regionkey")} AS canonical_crate, {_list(tuple(d[2] for d in DECLARED), "r_regionkey")} AS owning_rfc FROM region),
param AS (SELECT p_partkey AS k, {_list(PARAMS, "(p_partkey // 4) % 5")} AS name FROM part WHERE p_partkey % 4 = 1),
tab AS (SELECT {_list(CRATES, "s_suppkey % 8")} || '::' || s_name AS qname, {_list(CRATES, "s_suppkey % 8")} AS crate, CASE WHEN s_suppkey % 6 = 0 THEN 'u32' ELSE 'i64' END AS element_type, s_suppkey % 10 AS lo, s_suppkey % 10 + s_suppkey % 4 AS hi, s_suppkey % 4 + 1 AS entry_count, s_suppkey % 7 = 3 AS is_test FROM supplier)
"""
