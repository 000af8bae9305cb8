"""Registered graph queries over the overlay, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import run_query
from .sources.overlay import overlay

#: name -> (query text, parameters, SQL)
_TEXT: dict[str, tuple[str, dict, str]] = {}


def _q(name: str, text: str, sql: str, **params) -> None:
    _TEXT[name] = (text, params, sql)


_q("scan_label_filter", "MATCH (c:Customer) WHERE c.acctbal > 5000 RETURN c.custkey AS custkey, c.name AS name, c.acctbal AS acctbal", "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 5000")
_q("inline_props", "MATCH (c:Customer {mktsegment: 'HOUSEHOLD'}) RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment = 'HOUSEHOLD'")
_q("unlabelled_scan", "MATCH (r) WHERE r.regionkey >= 0 RETURN r.name AS name, r.regionkey AS regionkey", "SELECT r_name AS name, r_regionkey AS regionkey FROM region UNION ALL SELECT n_name, n_regionkey FROM nation")
_q("hop_out", "MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) WHERE o.totalprice > 200000 RETURN c.name AS name, o.orderkey AS orderkey", "SELECT c_name AS name, o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000")
_q("hop_in", "MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, s.name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey")
_q("hop_undirected", "MATCH (a:Nation)-[:IN_REGION]-(b:Region) RETURN a.name AS nation, b.name AS region", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
_q("hop_any_label", "MATCH (s:Supplier)-[r]->(n:Nation) RETURN r.label AS kind, n.name AS nation, count(*) AS n", "SELECT 'IN_NATION' AS kind, n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
_q("parallel_edges_bag", "MATCH (o:SalesOrder)-[r:CONTAINS]->(p:Part) RETURN o.orderkey AS orderkey, count(r) AS n", "SELECT l_orderkey AS orderkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey")
_q("edge_var_props", "MATCH (o:SalesOrder)-[r:CONTAINS]->(p:Part) WHERE r.quantity > 45 RETURN r.label AS kind, r.src AS src, r.quantity AS quantity, p.partkey AS partkey", "SELECT 'CONTAINS' AS kind, 'salesorder:' || CAST(l_orderkey AS VARCHAR) AS src, l_quantity AS quantity, l_partkey AS partkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45")
_q("chain_4hop", "MATCH (o:SalesOrder)-[:CONTAINS]->(p:Part), (c:Customer)-[:PLACED]->(o), (c)-[:IN_NATION]->(n:Nation), (n)-[:IN_REGION]->(r:Region) RETURN r.name AS region, p.brand AS brand, count(*) AS n", "SELECT r_name AS region, p_brand AS brand, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name, p_brand")
_q("bound_var_confirm", "MATCH (c:Customer)-[:PLACED]->(o:SalesOrder), (c:Customer {mktsegment: 'BUILDING'}) RETURN c.custkey AS custkey, count(*) AS n", "SELECT c_custkey AS custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY c_custkey")
_q("anonymous_node", "MATCH (c:Customer)-[:PLACED]->() RETURN c.custkey AS custkey, count(*) AS n", "SELECT c_custkey AS custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_q("self_join_equi", "MATCH (a:Supplier), (b:Supplier) WHERE a.nationkey = b.nationkey AND a.suppkey < b.suppkey RETURN a.suppkey AS a, b.suppkey AS b", "SELECT x.s_suppkey AS a, y.s_suppkey AS b FROM supplier x JOIN supplier y ON x.s_nationkey = y.s_nationkey AND x.s_suppkey < y.s_suppkey")
_q("self_join_theta", "MATCH (a:Nation), (b:Nation) WHERE a.regionkey < b.regionkey AND a.name > b.name RETURN a.name AS a, b.name AS b", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey < y.n_regionkey AND x.n_name > y.n_name")
_q("computed_key_join", "MATCH (a:Part), (b:Part) WHERE last_segment(a.name) = last_segment(b.name) AND a.partkey < b.partkey AND a.brand <> b.brand RETURN a.partkey AS a, b.partkey AS b", "SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_name = y.p_name AND x.p_partkey < y.p_partkey AND x.p_brand <> y.p_brand")
_q("optional_match", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, s.suppkey AS suppkey", "SELECT n_name AS nation, s_suppkey AS suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
_q("optional_count_zero", "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:SalesOrder {orderstatus: 'P'}) WITH c.custkey AS custkey, collect(o.orderkey) AS found WHERE size(found) = 0 RETURN custkey", "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_q("unwind_param", "UNWIND $keys AS k MATCH (c:Customer) WHERE c.custkey = k RETURN k AS k, c.name AS name", "SELECT k, c_name AS name FROM (VALUES (1), (2), (2), (999999999)) t(k) JOIN customer ON c_custkey = k", keys=[1, 2, 2, 999999999])
for _op, _n in (("=", "eq"), ("<>", "ne"), ("<", "lt"), ("<=", "le"), (">", "gt"), (">=", "ge")):
    _q(f"cmp_{_n}", f"MATCH (p:Part) WHERE p.size {_op} 25 RETURN p.partkey AS partkey", f"SELECT p_partkey AS partkey FROM part WHERE p_size {_op} 25")
_q("cmp_int_float", "MATCH (p:Part) WHERE p.size = 25.0 RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE p_size = 25")
_q("ne_missing", "MATCH (p:Part) WHERE p.nothing <> 1 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE 1 = 0 HAVING count(*) > 0")
_q("not_missing", "MATCH (p:Part) WHERE NOT p.nothing = 1 RETURN count(*) AS n", "SELECT count(*) AS n FROM part")
_q("cross_type_false", "MATCH (p:Part) WHERE NOT p.size <> 'a' RETURN count(*) AS n", "SELECT count(*) AS n FROM part")
_q("in_literal", "MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY', c.nothing] RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_q("in_param", "MATCH (c:Customer) WHERE c.nationkey IN $keys RETURN c.custkey AS custkey", "SELECT c_custkey AS custkey FROM customer WHERE c_nationkey IN (1, 3, 5)", keys=[1, 3, 5])
_q("in_no_coercion", "MATCH (p:Part) WHERE NOT p.size IN [1.0, 2.0, 25.0] RETURN count(*) AS n", "SELECT count(*) AS n FROM part")
_q("regex_find", "MATCH (p:Part) WHERE p.type =~ 'D.*D$|O$' RETURN p.partkey AS partkey, p.type AS type", "SELECT p_partkey AS partkey, p_type AS type FROM part WHERE regexp_matches(p_type, 'D.*D$|O$')")
_q("bool_or_not", "MATCH (o:SalesOrder) WHERE NOT (o.orderstatus = 'F' OR o.totalprice < 100000) AND (o.orderkey > 10 OR o.custkey = 1) RETURN o.orderkey AS orderkey", "SELECT o_orderkey AS orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000) AND (o_orderkey > 10 OR o_custkey = 1)")
_q("not_exists_true", "MATCH (r:Region) WHERE NOT EXISTS { MATCH (s:Supplier) WHERE s.acctbal > 99999999 } RETURN r.name AS name", "SELECT r_name AS name FROM region WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 99999999)")
_q("not_exists_false", "MATCH (r:Region) WHERE NOT EXISTS { MATCH (s:Supplier) } RETURN r.name AS name", "SELECT r_name AS name FROM region WHERE NOT EXISTS (SELECT 1 FROM supplier)")
_q("fn_regexp_extract", "MATCH (p:Part) RETURN p.partkey AS partkey, regexp_extract(p.type, '[A-Z]+') AS found", "SELECT p_partkey AS partkey, NULLIF(regexp_extract(p_type, '[A-Z]+'), '') AS found FROM part")
_q("fn_size", "MATCH (p:Part) WHERE size(p.name) > 9 RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE length(p_name) > 9")
_q("fn_starts_with", "MATCH (p:Part) WHERE starts_with(p.brand, 'Brand#1') = true RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE p_brand LIKE 'Brand#1%'")
_q("fn_ends_with", "MATCH (p:Part) WHERE ends_with(p.brand, '3') = true RETURN p.partkey AS partkey", "SELECT p_partkey AS partkey FROM part WHERE p_brand LIKE '%3'")
_q("fn_last_segment", "UNWIND $paths AS q RETURN q AS q, last_segment(q) AS last", "SELECT q, last FROM (VALUES ('a::b::c', 'c'), ('plain', 'plain'), ('x::', ''), ('a:::b', 'b')) t(q, last)", paths=["a::b::c", "plain", "x::", "a:::b"])
_q("fn_signature_divergent", "UNWIND $sigs AS s RETURN s AS s, signature_divergent(s, 'fn a ( x )') AS differs", "SELECT s, differs FROM (VALUES ('fn  a ( x ) ', false), ('fn a(x)', true)) t(s, differs)", sigs=["fn  a ( x ) ", "fn a(x)"])
_SETS = ["[]", "[1,2]", "[2, 1, 3]", '["1","2"]', "[1,\"a\"]", "no json"]
_q("fn_entries_subset", "UNWIND $sets AS a RETURN a AS a, entries_subset(a, '[1,2,3]') AS inside", """SELECT a, inside FROM (VALUES ('[]', true), ('[1,2]', true), ('[2, 1, 3]', true), ('["1","2"]', false), ('[1,"a"]', false), ('no json', false)) t(a, inside)""", sets=_SETS)
_q("fn_entries_jaccard", "UNWIND $sets AS a RETURN a AS a, entries_jaccard(a, '[1,2,3,4]') AS share", """SELECT a, CAST(share AS DOUBLE) AS share FROM (VALUES ('[]', 0.0), ('[1,2]', 0.5), ('[2, 1, 3]', 0.75), ('["1","2"]', 0.0), ('[1,"a"]', 0.0), ('no json', 0.0)) t(a, share)""", sets=_SETS)
_q("fn_overlap_verdict", "UNWIND $sets AS a RETURN a AS a, overlap_verdict(a, '[1,2,5]', a, 'no json') AS verdict", """SELECT a, verdict FROM (VALUES ('[]', 'CONST_TABLE_SUBSET'), ('[1,2]', 'CONST_TABLE_SUBSET'), ('[2, 1, 3]', 'CONST_TABLE_INTERSECTION_HIGH'), ('["1","2"]', 'CONST_TABLE_NONE'), ('[1,"a"]', 'CONST_TABLE_NONE'), ('no json', 'CONST_TABLE_DUPLICATE')) t(a, verdict)""", sets=_SETS)
_q("fn_unknown", "MATCH (p:Part) WHERE NOT nofn(p.size) = 1 RETURN count(*) AS n", "SELECT count(*) AS n FROM part")
_q("agg_count_star", "MATCH (c:Customer) RETURN c.mktsegment AS segment, count(*) AS n", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY c_mktsegment")
_q("agg_count", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:IN_NATION]->(n) RETURN n.name AS nation, count(s) AS n", "SELECT n_name AS nation, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
_q("agg_count_distinct", "MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) RETURN c.mktsegment AS segment, count(DISTINCT o.orderpriority) AS n", "SELECT c_mktsegment AS segment, count(DISTINCT o_orderpriority) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_mktsegment")
_q("agg_size", "MATCH (p:Part) RETURN p.brand AS brand, size(p.brand) AS n", "SELECT p_brand AS brand, CAST(length(p_brand) AS BIGINT) AS n FROM part GROUP BY p_brand")
_q("agg_empty_zero_rows", "MATCH (p:Part) WHERE p.size > 100000 RETURN count(*) AS n", "SELECT count(*) AS n FROM part WHERE p_size > 100000 HAVING count(*) > 0")
_q("with_having", "MATCH (c:Customer)-[:PLACED]->(o:SalesOrder) WITH c.custkey AS custkey, count(*) AS n WHERE n > 15 RETURN custkey, n", "SELECT c_custkey AS custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(*) > 15")
_q("distinct", "MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN DISTINCT n.name AS nation, c.mktsegment AS segment", "SELECT DISTINCT n_name AS nation, c_mktsegment AS segment FROM customer JOIN nation ON n_nationkey = c_nationkey")
_q("topk", "MATCH (o:SalesOrder) RETURN o.orderkey AS orderkey, o.totalprice AS totalprice ORDER BY totalprice DESC, orderkey LIMIT 10", "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders ORDER BY totalprice DESC, orderkey LIMIT 10")
_q("order_nulls", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier {suppkey: 1})-[:IN_NATION]->(n) RETURN n.name AS nation, s.suppkey AS suppkey ORDER BY suppkey, nation LIMIT 24", "SELECT n_name AS nation, s_suppkey AS suppkey FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey = 1) s ON s_nationkey = n_nationkey ORDER BY suppkey NULLS FIRST, nation LIMIT 24")
_q("default_order", "MATCH (c:Customer) RETURN c.custkey AS custkey LIMIT 5", "SELECT c_custkey AS custkey FROM customer ORDER BY c_custkey LIMIT 5")
_q("unknown_label", "MATCH (x:Shop) RETURN x.name AS name", "SELECT CAST(NULL AS VARCHAR) AS name WHERE 1 = 0")
_q("unknown_edge_optional", "MATCH (r:Region) OPTIONAL MATCH (r)-[:SOLD_BY]->(s:Supplier) RETURN r.name AS name, count(s) AS n", "SELECT r_name AS name, 0 AS n FROM region")
_q("source_rebound", "MATCH (n:Nation) OPTIONAL MATCH (s:Supplier {suppkey: 1})-[:IN_NATION]->(n) MATCH (s)-[:IN_NATION]->(m:Nation) RETURN n.name AS n, m.name AS m, count(*) AS k", "WITH e AS (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier), one AS (SELECT s_nationkey AS k FROM supplier WHERE s_suppkey = 1) SELECT n.n_name AS n, m.n_name AS m, count(*) AS k FROM nation n CROSS JOIN e JOIN nation m ON m.n_nationkey = e.k WHERE n.n_nationkey NOT IN (SELECT k FROM one) GROUP BY 1, 2 UNION ALL SELECT n_name, n_name, 1 FROM nation WHERE n_nationkey IN (SELECT k FROM one)")
_q("bound_source_label_unchecked", "MATCH (c:Customer {mktsegment: 'BUILDING'}), (c:Nation)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY n_name")
_q("not_exists_nested", "MATCH (r:Region) WHERE NOT EXISTS { MATCH (s:Supplier) WHERE NOT EXISTS { MATCH (p:Part) WHERE p.size > 1000 } AND s.acctbal > 99999999 } RETURN r.name AS name", "SELECT r_name AS name FROM region")
_CHAIN = "WITH ev AS (SELECT event_id AS id, LEAD(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), e AS (SELECT id AS a, nxt AS b FROM ev WHERE nxt IS NOT NULL)"


def _steps(n: int) -> str:
    """Walks of exactly n steps in the events' chains."""
    joins = "".join(f" JOIN e e{i} ON e{i}.a = e{i - 1}.b" for i in range(2, n + 1))
    return f"SELECT e1.a AS a, e{n}.b AS b FROM e e1{joins}"


def _ranged(least: int, most: int) -> str:
    return f"{_CHAIN} " + " UNION ALL ".join(_steps(n) for n in range(least, most + 1))


_q("varlen_1_3", "MATCH (a:Event)-[:NEXT*1..3]->(b:Event) RETURN a.event_id AS a, b.event_id AS b", _ranged(1, 3))
_q("varlen_2_5", "MATCH (a:Event)-[:NEXT*2..5]->(b:Event) RETURN a.event_id AS a, b.event_id AS b", _ranged(2, 5))
_q("varlen_clamped_1_8", "MATCH (a:Event)-[:NEXT*1..8]->(b:Event) RETURN a.event_id AS a, count(b) AS n", f"SELECT a, count(*) AS n FROM ({_ranged(1, 5)}) t GROUP BY a")
_q("varlen_in", "MATCH (b:Event {event_type: 'purchase'})<-[:NEXT*1..2]-(a:Event) RETURN a.event_id AS a, b.event_id AS b", f"SELECT t.a, t.b FROM ({_ranged(1, 2)}) t JOIN events ON event_id = t.b WHERE event_type = 'purchase'")
_q("varlen_undirected", "MATCH (a:Event)-[:NEXT*1..2]-(b:Event) RETURN a.event_id AS a, b.event_id AS b", f"SELECT t.a, t.b FROM (SELECT a, b FROM ({_ranged(1, 2)}) x UNION ALL SELECT b AS a, a AS b FROM ({_ranged(1, 2)}) y) t JOIN events ON event_id = t.a")
_q("homonym_groups", "MATCH (p:Part) WITH p.name AS name, count(*) AS n, count(DISTINCT p.brand) AS brands WHERE brands > 1 RETURN name, n, brands ORDER BY n DESC, name", "SELECT p_name AS name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) > 1")


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    text, params, _ = _TEXT[name]
    return lambda spark, sf_dir: run_query(overlay(spark, sf_dir), text, params).df


def _joined_list(text: str) -> Callable[[SparkSession, str], DataFrame]:
    """Lists as one string, so that any engine compares them alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run_query(overlay(spark, sf_dir), text).df
        return df.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])

    return run


#: name -> (function, SQL)
_MORE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "agg_collect": (_joined_list("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, collect(n.name) AS nations"), "SELECT r_name AS region, string_agg(n_name, ',' ORDER BY 'nation:' || CAST(n_nationkey AS VARCHAR)) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name"),
    "agg_collect_distinct": (_joined_list("MATCH (c:Customer)-[:IN_NATION]->(n:Nation) RETURN n.name AS nation, collect(DISTINCT c.mktsegment) AS segments"), "SELECT n_name AS nation, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .operators import catalog as more
    from .operators import rule_catalog as rules

    return {n: _run(n) for n in _TEXT} | {n: f for n, (f, _) in _MORE.items()} | more.queries() | rules.queries()


def oracle_sql() -> dict[str, str]:
    from .operators import catalog as more
    from .operators import rule_catalog as rules

    return {n: s for n, (_, _, s) in _TEXT.items()} | {n: s for n, (_, s) in _MORE.items()} | more.oracle_sql() | rules.oracle_sql()
