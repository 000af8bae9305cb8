"""Registered queries of the rule programs and of the reports on them, over the graph of code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import run_query, run_rule
from ..sources.code_overlay import CODE_SQL, CRATES, code_overlay
from ..sources.graph import Graph
from ..sources.overlay import overlay
from . import dump, enrich, reports

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Lists as one string and dots in names as underscores, so that any engine compares them alike."""
    return df.select(*[(F.array_join(F.col(f"`{c}`").cast("array<string>"), ",") if t.startswith("array") else F.col(f"`{c}`")).alias(c.replace(".", "_")) for c, t in df.dtypes])


_FIND = "a.qname, a.name, a.kind, a.crate, a.file, a.line, a.bounded_context"
_CALL = "qname AS caller_qname, crate AS caller_crate, file AS cs_file, callee_path AS cs_callee_path FROM called"
_PAIR = "FROM item a JOIN item b ON split_part(a.qname, '::', 3) = split_part(b.qname, '::', 3) AND replace(a.signature, '  ', ' ') <> replace(b.signature, '  ', ' ') AND NOT a.is_test AND NOT b.is_test"
_FORK = "(from|to|for|as)"
_HEAD, _TAIL = (lambda v: f"regexp_extract({v}.name, '^\\w+_{_FORK}_')"), (lambda v: f"regexp_extract({v}.name, '_{_FORK}_\\w+$')")
_FORKED = f"regexp_matches(a.name, '^\\w+_{_FORK}_\\w+$') AND regexp_matches(b.name, '^\\w+_{_FORK}_\\w+$') AND {_HEAD('a')} = {_HEAD('b')} AND {_TAIL('a')} <> {_TAIL('b')} AND NOT a.is_test AND NOT b.is_test"
_TYPES = "kind IN ('struct', 'enum', 'trait')"
_SHARED = "string_agg(DISTINCT crate, ',' ORDER BY crate) AS crates, string_agg(qname, ',' ORDER BY 'item:' || CAST(k AS VARCHAR)) AS qnames, string_agg(file, ',' ORDER BY 'item:' || CAST(k AS VARCHAR)) AS files"
_GROUPED = f"FROM item WHERE {_TYPES} AND NOT is_test GROUP BY name, kind HAVING count(*) > 1 AND count(DISTINCT crate) > 1"
def _reach(most: int) -> str:
    """Shortest walks of at most so many calls from entry points: (ep, node), never the handler itself."""
    rounds = ", hop AS (SELECT DISTINCT src, dst FROM calls), r1 AS (SELECT n_nationkey AS ep, dst AS node FROM nation JOIN hop ON src = n_nationkey)" + "".join(f", r{i} AS (SELECT DISTINCT ep, dst AS node FROM r{i - 1} JOIN hop ON src = node)" for i in range(2, most + 1))
    return rounds + ", reach AS (SELECT DISTINCT ep, node FROM (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(1, most + 1)) + ") t WHERE node <> ep)"


_PORTAGE, _GLUE, _DROP = ("k % 5 = 1", "k % 5 = 2", "k % 5 = 3")
_BYPASS = "'posting' AS concept, callee_path AS call_site, qname AS caller, '{0}' AS verdict, file AS evidence FROM called WHERE regexp_matches(qname, 'ledger::') AND split_part(callee_path, '::', -1) = '{1}' AND NOT in_test"
_INTER = "greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1)"
_OVERLAP = f"CASE WHEN a.lo = b.lo AND a.hi = b.hi THEN 'CONST_TABLE_DUPLICATE' WHEN {_INTER} IN (a.entry_count, b.entry_count) THEN 'CONST_TABLE_SUBSET' WHEN {_INTER} >= 0.5 * (a.entry_count + b.entry_count - {_INTER}) THEN 'CONST_TABLE_INTERSECTION_HIGH' ELSE 'CONST_TABLE_NONE' END"
_SAMPLE = "'[' || array_to_string(range(a.lo, a.hi + 1), ',') || ']'"

_CTX, _SRC = {"context": "market"}, {"source_context": "domain-ledger"}
#: program -> (parameters, SQL after the common table expressions, further ones before it)
_RULES: dict[str, tuple[dict, str]] = {
    "arch-ban-utc-now": ({}, f"SELECT {_CALL} WHERE NOT in_test AND regexp_matches(crate, '(domain|ports).*') AND callee_path = 'chrono::Utc::now'"),
    "arch-ban-f64-in-domain": ({}, f"SELECT {_CALL} WHERE NOT in_test AND crate IN ('domain-market', 'domain-ledger') AND callee_path IN ('Decimal::from_f64', 'x::to_f64')"),
    "arch-ban-reqwest-client-new": ({}, f"SELECT {_CALL} WHERE NOT in_test AND file IN ('crates/adapters-market/src/lib.rs', 'crates/ports-market/src/lib.rs') AND callee_path IN ('reqwest::Client::new', 'ClientBuilder::new')"),
    "list-callers": ({"qname": "(post|append)$"}, f"SELECT {_CALL} WHERE callee_path IN ('ledger::post', 'raw::append')"),
    "canonical-bypass-caller": ({"concept": "posting", "caller_regex": "ledger::", "canonical_callee_name": "post"}, "SELECT " + _BYPASS.format("CANONICAL_CALLER", "post")),
    "canonical-bypass-dead": ({"concept": "posting", "caller_regex": "ledger::", "bypass_callee_name": "append"}, "SELECT " + _BYPASS.format("BYPASS_DEAD", "append") + " AND NOT reachable"),
    "canonical-bypass-reachable": ({"concept": "posting", "caller_regex": "ledger::", "bypass_callee_name": "append"}, "SELECT " + _BYPASS.format("BYPASS_REACHABLE", "append") + " AND reachable"),
    "canonical-unreachable": ({"concept": "AFRICA"}, "SELECT r_name AS concept, qname AS canonical_item, '(no call site — canonical impl is unreachable)' AS call_site, qname AS caller, 'CANONICAL_UNREACHABLE' AS verdict, file AS evidence FROM item JOIN canonical c USING (k) JOIN region ON r_regionkey = c.concept WHERE r_name = 'AFRICA' AND NOT reachable AND NOT is_test"),
    "classifier-duplicated-feature": (_CTX, f"SELECT {_FIND} FROM item a JOIN item b ON a.kind = b.kind AND a.name = b.name AND a.crate <> b.crate AND a.bounded_context = b.bounded_context WHERE a.{_TYPES} AND a.bounded_context = 'market' AND NOT a.is_test AND NOT b.is_test"),
    "classifier-context-homonym": (_CTX, f"SELECT {_FIND} {_PAIR} WHERE a.bounded_context = 'market' AND b.bounded_context <> 'market'"),
    "classifier-unfinished-refactor": (_CTX, f"SELECT {_FIND} FROM item a WHERE a.is_deprecated AND NOT a.is_test AND a.bounded_context = 'market'"),
    "classifier-random-scattering": (_CTX, f"SELECT {_FIND} FROM item a JOIN item b ON a.qname < b.qname AND a.reachable AND b.reachable AND {_FORKED} WHERE a.kind IN ('fn', 'method') AND b.kind IN ('fn', 'method') AND a.bounded_context = 'market' AND b.bounded_context = 'market'"),
    "classifier-canonical-bypass": (_CTX, f"SELECT {_FIND} FROM item a JOIN canonical USING (k) WHERE NOT a.reachable AND NOT a.is_test AND a.bounded_context = 'market'"),
    "classifier-unwired": (_CTX, f"SELECT {_FIND} FROM item a WHERE a.kind IN ('fn', 'method') AND NOT a.reachable AND NOT a.is_test AND a.bounded_context = 'market'"),
    "const-table-overlap": ({}, f"SELECT * FROM (SELECT {_OVERLAP} AS verdict, a.qname AS a_qname, a.crate AS a_crate, b.qname AS b_qname, b.crate AS b_crate, a.element_type, a.entry_count, {_SAMPLE} AS sample FROM tab a JOIN tab b ON a.crate <> b.crate AND a.qname < b.qname AND a.element_type = b.element_type AND NOT a.is_test AND NOT b.is_test) t WHERE verdict <> 'CONST_TABLE_NONE'"),
    "hsb-by-name": ({}, f"SELECT name, kind, count(*) AS n, {_SHARED} {_GROUPED}"),
    "t3-concept-multi-crate": ({}, f"SELECT name, kind, count(*) AS n, count(DISTINCT crate) AS n_crates, count(DISTINCT bounded_context) AS n_contexts, string_agg(DISTINCT bounded_context, ',' ORDER BY bounded_context) AS bounded_contexts, {_SHARED} {_GROUPED}"),
    "t1-concept-unwired": ({}, "SELECT name AS context_name, canonical_crate, owning_rfc FROM context"),
    "signature-divergent": ({}, f"SELECT a.name AS last_segment, a.qname AS a_qname, a.bounded_context AS a_bounded_context, a.signature AS a_signature, b.qname AS b_qname, b.bounded_context AS b_bounded_context, b.signature AS b_signature {_PAIR} WHERE a.qname < b.qname AND a.bounded_context <> b.bounded_context"),
    "vertical-split-brain": ({}, f"SELECT n_name AS entry_point, 'item:' || CAST(n_nationkey AS VARCHAR) AS entry_qname, {_HEAD('a')} AS concept_prefix, a.qname AS resolver_a_qname, b.qname AS resolver_b_qname, 'fork' AS divergence_kind FROM nation JOIN reach x ON x.ep = n_nationkey JOIN reach y ON y.ep = n_nationkey JOIN item a ON a.k = x.node JOIN item b ON b.k = y.node AND a.qname < b.qname AND {_FORKED} WHERE a.kind = 'fn' AND b.kind = 'fn'"),
    "vertical-split-brain-drop": ({}, f"SELECT n_name AS entry_point, 'item:' || CAST(n_nationkey AS VARCHAR) AS entry_qname, p.name AS wire_param, a.qname AS matching_resolver, b.qname AS divergent_resolver, q.name AS divergent_key, 'drop' AS divergence_kind FROM nation JOIN reach x ON x.ep = n_nationkey JOIN reach y ON y.ep = n_nationkey JOIN item a ON a.k = x.node JOIN item b ON b.k = y.node JOIN param p ON p.k = a.k JOIN param q ON q.k = b.k WHERE p.name = (['limit', 'offset', 'depth', 'mode', 'since'])[n_nationkey % 5 + 1] AND q.name <> p.name AND a.k <> b.k AND NOT a.is_test AND NOT b.is_test"),
    "raid-completeness": (_SRC, f"SELECT qname, kind, name FROM item WHERE crate = 'domain-ledger' AND NOT ({_PORTAGE} OR {_GLUE} OR {_DROP})"),
    "raid-dangling-drop": (_SRC, f"SELECT d.qname AS dropped_qname, c.qname AS caller_qname FROM calls JOIN (SELECT * FROM item WHERE crate = 'domain-ledger' AND {_DROP}) d ON d.k = dst JOIN (SELECT * FROM item WHERE crate = 'domain-ledger' AND ({_PORTAGE} OR {_GLUE})) c ON c.k = src"),
    "raid-hidden-callers": (_SRC, f"SELECT d.qname AS portaged_qname, c.qname AS external_qname, c.crate AS external_crate FROM calls JOIN (SELECT * FROM item WHERE crate = 'domain-ledger' AND {_PORTAGE}) d ON d.k = dst JOIN item c ON c.k = src AND c.crate <> 'domain-ledger'"),
    "raid-missing-canonical": ({"rewrite": ["AFRICA", "MIDDLE EAST", "nowhere"]}, "SELECT r_name AS concept_name FROM region WHERE r_name IN ('AFRICA', 'MIDDLE EAST', 'nowhere') AND r_regionkey NOT IN (SELECT concept FROM canonical)"),
    "raid-signal-mismatch": (_SRC | {"max_unwraps": 15, "min_coverage": 0.3}, f"SELECT qname, unwrap_count, test_coverage, dup_cluster_id FROM item WHERE crate = 'domain-ledger' AND {_PORTAGE} AND kind = 'fn' AND (unwrap_count > 15 OR test_coverage < 0.3)"),
}


def _raid_lists(graph: Graph, params: dict) -> dict:
    """The buckets of a plan to move one crate, as a caller lists them: names by the item's number, in
    tables, as they grow with the crate."""
    if "source_context" not in params:
        return params
    own = graph.nodes["Item"].where(F.col("crate") == params["source_context"])
    return params | {p: own.where((F.col("line") - 1) % 5 == b).select("qname") for p, b in (("portage", 1), ("glue", 2), ("drop", 3))}


def _rule(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        graph = code_overlay(spark, sf_dir)
        return plain(run_rule(graph, name, _raid_lists(graph, _RULES[name][0])).df)

    return run


def check_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.check_t1(code_overlay(spark, sf_dir))


def check_t3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(reports.check_t3(code_overlay(spark, sf_dir)))


def scope_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scope(code_overlay(spark, sf_dir), "ledger").findings


def scope_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scope(code_overlay(spark, sf_dir), "ledger").items_by_crate


def scope_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(reports.scope(code_overlay(spark, sf_dir), "infra-utils").candidates)


def classify_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings on items whose lines a change has moved."""
    g = code_overlay(spark, sf_dir)
    moved = g.nodes["Item"].withColumn("line", F.when((F.col("line") - 1) % 3 == 0, F.col("line") + 1).otherwise(F.col("line")))
    changes = dump.diff(Graph(spark, {"Item": moved}), Graph(spark, {"Item": g.nodes["Item"]}))
    return reports.classify(reports.scope(g, "ledger"), changes)


def list_items_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.list_items_matching(code_overlay(spark, sf_dir), "^(red|hot)", ["Fn", "Struct"]).df


def list_items_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(reports.list_items_matching(code_overlay(spark, sf_dir), "plate$", None, True).df)


def check_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "MATCH (i:Item) WHERE i.kind = $kind AND i.crate IN $crates AND i.name =~ $shape RETURN i.qname AS qname, i.line AS line, i.file AS reason"
    return reports.check_predicate(code_overlay(spark, sf_dir), text, ["kind:literal:fn", "crates:list:domain-market, ports-market", "shape:regex:^small"])


def bounded_context_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = code_overlay(spark, sf_dir)
    out, _ = enrich.bounded_context(Graph(spark, {"Item": g.nodes["Item"].drop("bounded_context")}), {"infra-utils": "platform"})
    return out.nodes["Item"].select("qname", "bounded_context")


def _text(text: str, **params) -> Query:
    return lambda spark, sf_dir: plain(run_query(code_overlay(spark, sf_dir), text, params).df)


def deprecated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, report = enrich.enrich(code_overlay(spark, sf_dir), "deprecation")
    assert report.ran
    return run_query(g, "MATCH (i:Item {is_deprecated: true}) RETURN i.crate AS crate, count(*) AS n").df


def rfc_doc_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items named in texts, each with its documents."""
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 97 = 0").select(F.concat(F.lit("docs/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# Part\n"), F.regexp_replace("p_name", " ", ""), F.lit(" is "), "p_type").alias("text"))
    g, _ = enrich.rfc_docs(code_overlay(spark, sf_dir), docs)
    return g.edges["REFERENCED_BY"]


def git_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of files; what the items of each file then have."""
    k = F.col("o_orderkey")
    commits = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("crates/"), F.element_at(F.array(*[F.lit(c) for c in CRATES]), (k % 8 + 1).cast("int")), F.lit("/src/m"), (F.floor(k / 8) % 7).cast("string"), F.lit(".rs")).alias("path"), k.cast("long").alias("commit_ts"), F.col("o_orderpriority").alias("author_email"))
    g, _ = enrich.git_history(code_overlay(spark, sf_dir), commits)
    return run_query(g, "MATCH (i:Item) RETURN i.qname AS qname, i.git_commit_count AS n, i.git_last_commit_unix_ts AS ts, i.git_last_author AS who").df.select("qname", F.col("n.i").alias("n"), F.col("ts.i").alias("ts"), F.col("who.s").alias("who"))


def metric_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions with a coverage, signals and the cluster of their signature."""
    g = code_overlay(spark, sf_dir)
    items = g.nodes["Item"].drop("unwrap_count", "test_coverage", "dup_cluster_id").withColumn("signature_hash", F.col("signature"))
    coverage = items.where("line % 2 = 0").select("qname", (F.col("line") % 10 / 10.0).alias("ratio"))
    signals = items.select("qname", (F.col("line") % 4).alias("unwrap_count"), (F.col("line") % 6).alias("cyclomatic"))
    out, _ = enrich.metrics(Graph(spark, {"Item": items}), coverage, signals)
    return out.nodes["Item"].where("kind = 'fn'").select("qname", "test_coverage", "unwrap_count", "cyclomatic", "dup_cluster_id")


def reached_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the entry points' items reach each item, over a chain of calls."""
    g = code_overlay(spark, sf_dir)
    calls = g.nodes["Item"].where("line % 3 <> 0").select(F.col("id").alias("src"), F.concat(F.lit("item:"), (F.col("line") * 2).cast("string")).alias("dst"))
    items = g.nodes["Item"].drop("reachable_from_entry")
    out, _ = enrich.reachability(Graph(spark, {"Item": items, "EntryPoint": g.nodes["EntryPoint"]}, {"CALLS": calls, "EXPOSES": g.edges["EXPOSES"]}))
    return out.nodes["Item"].select("qname", "reachable_entry_count", "reachable_from_entry")


def dump_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node and edge lines with and without properties."""
    g = overlay(spark, sf_dir)
    return dump.dump_lines(Graph(spark, {k: g.nodes[k] for k in ("Region", "Part", "SalesOrder")}, {"CONTAINS": g.edges["CONTAINS"]})).select("part", "line")


_CLASSES = {
    "duplicated_feature": "classifier-duplicated-feature",
    "context_homonym": "classifier-context-homonym",
    "unfinished_refactor": "classifier-unfinished-refactor",
    "random_scattering": "classifier-random-scattering",
    "canonical_bypass": "classifier-canonical-bypass",
    "unwired": "classifier-unwired",
}
_FOUND = "found AS (" + " UNION ".join(f"SELECT DISTINCT '{c}' AS class, t.* FROM ({_RULES[r][1].replace(chr(39) + 'market' + chr(39), chr(39) + 'ledger' + chr(39))}) t" for c, r in _CLASSES.items()) + ")"
_CITED = "EXISTS (SELECT 1 FROM benchmark WHERE contains('docs/rfc-' || CAST(item_id AS VARCHAR) || '.md', owning_rfc) OR contains(substr(text, 1, 20), owning_rfc))"
_LISTED = "([" + ", ".join(f"'{c}'" for c in CRATES) + "])[o_orderkey % 8 + 1]"
_REPORTS: dict[str, tuple[Query, str]] = {
    "check_t1": (check_t1, f"{CODE_SQL} SELECT 'CONCEPT_UNWIRED' AS verdict, name AS context_name, canonical_crate, owning_rfc, name AS evidence FROM context WHERE name NOT IN (SELECT bounded_context FROM item) UNION ALL SELECT 'MISSING_CANONICAL_CRATE', name, canonical_crate, owning_rfc, canonical_crate FROM context WHERE canonical_crate <> '' AND canonical_crate NOT IN (SELECT crate FROM item) UNION ALL SELECT 'STALE_RFC_REFERENCE', name, canonical_crate, owning_rfc, owning_rfc FROM context WHERE owning_rfc <> '' AND NOT {_CITED}"),
    "check_t3": (check_t3, f"{CODE_SQL} SELECT t.*, n_contexts > 1 AS is_cross_context, (SELECT min(canonical_crate) FROM context WHERE list_contains(string_split(t.crates, ','), canonical_crate)) AS canonical_candidate FROM ({_RULES['t3-concept-multi-crate'][1]}) t"),
    "scope_findings": (scope_findings, f"{CODE_SQL}, {_FOUND} SELECT * FROM found"),
    "scope_items": (scope_items, f"{CODE_SQL} SELECT crate, count(*) AS n FROM item WHERE bounded_context = 'ledger' GROUP BY crate"),
    "scope_candidates": (scope_candidates, f"{CODE_SQL} SELECT name, kind, crates, qnames, files FROM ({_RULES['hsb-by-name'][1]}) t WHERE list_contains(string_split(crates, ','), 'infra-utils')"),
    "classify_findings": (classify_findings, f"{CODE_SQL}, {_FOUND} SELECT * FROM found WHERE (line - 1) % 3 = 0"),
    "list_items_flat": (list_items_flat, f"{CODE_SQL} SELECT {_FIND} FROM item a WHERE regexp_matches(name, '^(red|hot)') AND kind IN ('fn', 'struct')"),
    "list_items_grouped": (list_items_grouped, f"{CODE_SQL} SELECT bounded_context, string_agg('item:' || CAST(k AS VARCHAR), ',' ORDER BY 'item:' || CAST(k AS VARCHAR)) AS items FROM item WHERE regexp_matches(name, 'plate$') GROUP BY bounded_context"),
    "check_predicate": (check_predicate, f"{CODE_SQL} SELECT qname, line, file AS reason FROM item WHERE kind = 'fn' AND crate IN ('domain-market', 'ports-market') AND name LIKE 'small%'"),
    "fn_last_segment_items": (_text("MATCH (i:Item) RETURN i.qname AS qname, last_segment(i.qname) AS last"), f"{CODE_SQL} SELECT qname, name AS last FROM item"),
    "fn_regexp_extract_items": (_text("MATCH (i:Item) RETURN i.qname AS qname, regexp_extract(i.qname, 'm[0-9]+') AS found"), f"{CODE_SQL} SELECT qname, regexp_extract(qname, 'm[0-9]+') AS found FROM item"),
    "fn_signature_divergent_items": (_text("MATCH (i:Item) WHERE signature_divergent(i.signature, 'fn ( t)') = false OR signature_divergent(i.signature, 'fn (t)') = false RETURN i.qname AS qname"), f"{CODE_SQL} SELECT qname FROM item WHERE replace(signature, '  ', ' ') = 'fn (t)'"),
    "fn_entries_tables": (_text("MATCH (a:ConstTable), (b:ConstTable) WHERE a.element_type = b.element_type AND a.crate = b.crate RETURN a.qname AS a, b.qname AS b, entries_subset(a.entries_normalized, b.entries_normalized) AS inside, entries_jaccard(a.entries_normalized, b.entries_normalized) AS share, overlap_verdict(a.entries_normalized, b.entries_normalized, a.entries_hash, b.entries_hash) AS verdict"), f"{CODE_SQL} SELECT a.qname AS a, b.qname AS b, {_INTER} = a.entry_count AS inside, {_INTER} / (a.entry_count + b.entry_count - {_INTER})::DOUBLE AS share, {_OVERLAP} AS verdict FROM tab a JOIN tab b ON a.element_type = b.element_type AND a.crate = b.crate"),
    "deprecated_items": (deprecated_items, f"{CODE_SQL} SELECT crate, count(*) AS n FROM item WHERE is_deprecated GROUP BY crate"),
    "rfc_doc_edges": (rfc_doc_edges, f"{CODE_SQL} SELECT DISTINCT 'item:' || CAST(i.k AS VARCHAR) AS src, 'rfc:docs/' || CAST(p_partkey AS VARCHAR) || '.md' AS dst FROM part JOIN item i ON i.name = replace(p_name, ' ', '') WHERE p_partkey % 97 = 0"),
    "git_items": (git_items, f"{CODE_SQL}, log AS (SELECT 'crates/' || {_LISTED} || '/src/m' || CAST((o_orderkey // 8) % 7 AS VARCHAR) || '.rs' AS file, max(o_orderkey) AS ts, arg_max(o_orderpriority, o_orderkey) AS who, count(*) AS n FROM orders GROUP BY 1) SELECT qname, n, ts, who FROM item LEFT JOIN log USING (file)"),
    "metric_items": (metric_items, f"{CODE_SQL}, dup AS (SELECT signature, sha256(string_agg(qname, chr(10) ORDER BY qname)) AS c FROM item WHERE kind = 'fn' GROUP BY signature HAVING count(*) >= 2) SELECT qname, CASE WHEN line % 2 = 0 THEN line % 10 / 10.0::DOUBLE END AS test_coverage, line % 4 AS unwrap_count, line % 6 AS cyclomatic, c AS dup_cluster_id FROM item LEFT JOIN dup USING (signature) WHERE kind = 'fn'"),
    "reached_items": (reached_items, f"{CODE_SQL.replace('WITH item', 'WITH RECURSIVE item', 1)}, walk(seed, k) AS (SELECT n_nationkey, n_nationkey FROM nation UNION SELECT seed, (i.line) * 2 FROM walk w JOIN item i ON i.k = w.k WHERE i.line % 3 <> 0) SELECT qname, count(seed) AS reachable_entry_count, count(seed) > 0 AS reachable_from_entry FROM item LEFT JOIN walk USING (k) GROUP BY qname"),
    "dump_all": (dump_all, """SELECT 0 AS part, '{"id":"region:' || r_regionkey || '","kind":"node","label":"Region","props":{"name":' || to_json(r_name) || ',"regionkey":' || r_regionkey || '}}' AS line FROM region
 UNION ALL SELECT 0, '{"id":"part:' || p_partkey || '","kind":"node","label":"Part","props":{"brand":' || to_json(p_brand) || ',"name":' || to_json(p_name) || ',"partkey":' || p_partkey || ',"retailprice":' || to_json(p_retailprice) || ',"size":' || p_size || ',"type":' || to_json(p_type) || '}}' FROM part
 UNION ALL SELECT 0, '{"id":"salesorder:' || o_orderkey || '","kind":"node","label":"SalesOrder","props":{"custkey":' || o_custkey || ',"orderkey":' || o_orderkey || ',"orderpriority":' || to_json(o_orderpriority) || ',"orderstatus":' || to_json(o_orderstatus) || ',"totalprice":' || to_json(o_totalprice) || '}}' FROM orders
 UNION ALL SELECT 1, '{"dst_qname":"part:' || l_partkey || '","kind":"edge","label":"CONTAINS","props":{"discount":' || to_json(l_discount) || ',"extendedprice":' || to_json(l_extendedprice) || ',"linenumber":' || l_linenumber || ',"linestatus":' || to_json(l_linestatus) || ',"quantity":' || to_json(l_quantity) || ',"returnflag":' || to_json(l_returnflag) || '},"src_qname":"salesorder:' || l_orderkey || '"}' FROM lineitem"""),
    "bounded_context_items": (bounded_context_items, f"{CODE_SQL} SELECT qname, CASE WHEN crate = 'infra-utils' THEN 'platform' ELSE bounded_context END AS bounded_context FROM item"),
}


def queries() -> dict[str, Query]:
    return {"rule_" + n.replace("-", "_"): _rule(n) for n in _RULES} | {n: f for n, (f, _) in _REPORTS.items()}


def oracle_sql() -> dict[str, str]:
    rules = {"rule_" + n.replace("-", "_"): CODE_SQL.rstrip() + (_reach(8 if n.endswith("-drop") else 5) if "split-brain" in n else "") + " " + sql for n, (_, sql) in _RULES.items()}
    return rules | {n: s for n, (_, s) in _REPORTS.items()}
