"""Queries whose rows, plans or driver lists once outgrew their input."""

import json

import pytest

from graphloom.engine import program, run_query, run_rule
from graphloom.operators import dump, enrich, reports, rule_catalog
from graphloom.sources.graph import Graph, graph_of

from .test_graph import N


def joined(df):
    """Rows that the joins of a plan put out when it runs."""
    df.write.format("noop").mode("overwrite").save()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    rows = df.collect()
    while todo:
        p = todo.pop()
        name = p.nodeName()
        if "Join" in name or name == "CartesianProduct":
            total += p.metrics().apply("numOutputRows").value()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(p.executedPlan())
        elif "QueryStage" in name:
            todo.append(p.plan())
        else:
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return total, rows


def items(spark, n=200, **more):
    """n functions `price_from_<k>` of two contexts in turn, each signature twice."""
    rows = [(f"item:{k}", f"c{k % 2}::m{k}::price_from_{k % 4}", f"price_from_{k % 4}", "fn", f"c{k % 2}", f"f{k}", k, False, k % 3 > 0, f"fn (a{k % 5})", f"x{k // 2 % 2}") for k in range(n)]
    t = spark.createDataFrame(rows, "id string, qname string, name string, kind string, crate string, file string, line long, is_test boolean, reachable_from_entry boolean, signature string, bounded_context string")
    return Graph(spark, {"Item": t.selectExpr(*[f"{more[c]} AS {c}" if c in more else c for c in t.columns])})


def by_hand(rows, rule):
    own = [r.asDict() for r in rows]
    seg = lambda r: r["qname"].split("::")[-1]
    tests = {
        "classifier-context-homonym": lambda a, b: seg(a) == seg(b) and a["signature"] != b["signature"] and b["bounded_context"] != "x0",
        "classifier-random-scattering": lambda a, b: a["qname"] < b["qname"] and a["reachable_from_entry"] and b["reachable_from_entry"] and b["bounded_context"] == "x0" and a["name"] != b["name"],
        "classifier-duplicated-feature": lambda a, b: a["name"] == b["name"] and b["bounded_context"] == "x0" and a["crate"] != b["crate"],
    }
    return sorted(a["qname"] for a in own for b in own if a["bounded_context"] == "x0" and tests[rule](a, b))


@pytest.mark.parametrize("rule,more", [("classifier-duplicated-feature", {"kind": "'enum'", "name": "'Shared'"}), ("classifier-context-homonym", {"qname": "concat(crate, '::m', line, '::price')"}), ("classifier-random-scattering", {})])
def test_partners_are_counted(spark, rule, more):
    """a finding comes once for each partner, in order, but pairs aren't joined."""
    g = items(spark, 400, **more)
    n, rows = joined(run_query(g, program(rule), {"context": "x0"}).df)
    want = by_hand(g.nodes["Item"].collect(), rule)
    assert [r.qname for r in rows] == want and len(want) > 4000 and n <= 4 * 400


@pytest.mark.parametrize("cls,more", [("context_homonym", {"qname": "concat(crate, '::m', line, '::price')"}), ("random_scattering", {})])
def test_findings_need_one_partner(spark, cls, more):
    """distinct findings without their pairs."""
    g = items(spark, 400, **more)
    n, rows = joined(reports.findings_of(g, cls, "x0"))
    assert sorted(r.qname for r in rows) == sorted(set(by_hand(g.nodes["Item"].collect(), reports.CLASSES[cls]))) and n <= 4 * 400


def test_scope_is_lazy(spark):
    """items and candidates don't wait for the findings of six classes."""
    g = items(spark)
    g.nodes["Context"] = spark.createDataFrame([("context:x0", "x0")], "id string, name string")
    spark.sparkContext.setJobGroup("scope", "scope")
    s = reports.scope(g, "x0")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("scope"))
    spark.sparkContext.setJobGroup("rest", "rest")
    assert jobs <= 2 and sum(r.n for r in s.items_by_crate.collect()) == 100 and "duplicated_feature" in s.warnings[0]


@pytest.mark.parametrize("rule", ["raid-completeness", "raid-dangling-drop", "raid-hidden-callers"])
def test_lists_as_tables(spark, rule):
    """buckets of any length are tables and give what lists give."""
    g = items(spark)
    g.edges["CALLS"] = spark.createDataFrame([(f"item:{k}", f"item:{(k * 7 + k // 100) % 200}") for k in range(200)], "src string, dst string")
    params = rule_catalog._raid_lists(g, {"source_context": "c0"})
    lists = {k: v if isinstance(v, str) else [r[0] for r in v.collect()] for k, v in params.items()}
    found = lambda p: [r.asDict() for r in run_query(g, program(rule), p).df.collect()]
    assert not isinstance(params["drop"], list) and found(params) == found(lists) != []
    text = "MATCH (i:Item) WHERE i.line > 5 OR NOT i.qname IN $drop RETURN count(*) AS n"
    assert found(params) and run_query(g, text, params).rows() == run_query(g, text, lists).rows()


def test_differences_without_a_sort(spark):
    """facts are compared by their keys; the order of the dump doesn't matter there."""
    g = items(spark)
    d = dump.diff(g, items(spark, line="line + cast(line % 10 = 0 AS int)"))
    plan = d.changed.select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Sort [part") == 0
    assert d.changed.count() == 20 and d.added.count() == 0


def test_pairs_in_order(spark):
    """F8: pairs are sorted where they are made, and signatures are squeezed once a row."""
    g = items(spark, qname="concat(crate, '::m', line, '::price')", signature="concat('fn  ( a', line % 5, ')')")
    df = run_query(g, program("signature-divergent")).df
    own = g.nodes["Item"].collect()
    want = sorted((a.qname, b.bounded_context, b.qname) for a in own for b in own if a.qname < b.qname and a.bounded_context != b.bounded_context and a.signature != b.signature)
    assert [(r.a_qname, r.b_bounded_context, r.b_qname) for r in df.collect()] == want and len(want) > 1000
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_replace" in line for line in plan.splitlines() if " Join " in line)


def tables(spark):
    rows = [(f"t{k}", f"c{k % 3}::T{k}", f"c{k % 3}", "i64", json.dumps(list(range(k % 4, k % 4 + k % 3))) if k % 11 else None, f"h{k % 4}{k % 3}", False, k % 3, "s") for k in range(60)]
    return Graph(spark, {"ConstTable": spark.createDataFrame(rows, "id string, qname string, crate string, element_type string, entries_normalized string, entries_hash string, is_test boolean, entry_count long, entries_sample string")})


def test_functions_of_pairs_by_value(spark):
    """entries are read once a text, and functions of two computed once for two texts."""
    g = tables(spark)
    df = run_query(g, program("const-table-overlap")).df
    rows = df.collect()
    one = "UNWIND $v AS v RETURN overlap_verdict($a, $b, $ha, $hb) AS verdict"
    assert [(r.verdict, r.a_qname, r.b_qname) for r in rows] == sorted((r.verdict, r.a_qname, r.b_qname) for r in rows) and rows
    own = {r.qname: r for r in g.nodes["ConstTable"].collect()}
    for r in rows[:: max(1, len(rows) // 4)]:
        a, b = own[r.a_qname], own[r.b_qname]
        assert run_query(g, one, {"v": [1], "a": a.entries_normalized, "b": b.entries_normalized, "ha": a.entries_hash, "hb": b.entries_hash}).rows() == [{"verdict": r.verdict}]
    text = "MATCH (a:ConstTable), (b:ConstTable) WHERE a.element_type = b.element_type RETURN a.qname AS a, b.qname AS b, entries_subset(a.entries_normalized, b.entries_normalized) AS inside"
    pairs = run_query(g, text).df
    assert pairs.count() == 3600 and pairs.where("inside is null").count() == 60 * 60 - 54 * 54
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if " Join " in line]
    assert not any("from_json" in line for line in joins)
    assert len(joins) >= 3


def test_dump_of_odd_values(spark):
    """lines are put together from columns and are what Python writes."""
    values = ["plain", 'q"\\', "a\nb", "\x1f\x0b", "é\u2028", "", 0, -3, 0.0, -0.0, 1.5, -2.25, 100.0, 1e16, 1e-5, 0.1 + 0.2, 1234567.8901, 99999999999.5, 1e300, 12345678.12, None, True, False]
    g = graph_of(spark, [{"id": f"n{i:02}", "label": "N", "props": {"v": v}} for i, v in enumerate(values)] + [{"id": f"m{i:02}", "label": "F", "props": {"f": v, "qname": f"q{i}"}} for i, v in enumerate(values) if isinstance(v, float)], [{"src": "n00", "dst": "m08", "label": "E", "props": {}}, {"src": "n01", "dst": "n02", "label": "E", "props": {"w": 2.0}}])
    lines = [r.line for r in dump.dump_lines(g).collect()]
    assert [json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in lines] == lines
    assert [json.loads(x)["props"]["v"] for x in lines if '"label":"N"' in x] == values and '"v":-0.0' in "".join(lines)
    assert '{"dst_qname":"q8","kind":"edge","label":"E","src_qname":"n00"}' in lines
    assert "MapInArrow" not in dump.dump_lines(g)._jdf.queryExecution().optimizedPlan().toString()


def test_references_once(spark):
    """pairs of items and documents are made once, not told apart afterwards, in evenly dealt tasks."""
    g = items(spark, 40)
    docs = spark.createDataFrame([("d", "price_from_1 and c1::m1::price_from_1, c0::m2::price_from_2"), ("f5", "c1::m5::price_from_1"), ("e", "c1::m1 x")], "path string, text string")
    out, report = enrich.rfc_docs(g, docs)
    edges = out.edges["REFERENCED_BY"]
    want = sorted((f"item:{k}", f"rfc:{d}") for d, named in (("d", (1, 2)), ("f5", (1,))) for k in range(40) if k % 4 in named and f"f{k}" != d)
    assert sorted((r.src, r.dst) for r in edges.collect()) == want and report.edges_written == len(want)
    assert "Aggregate" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert [r.path for r in out.nodes["RfcDoc"].orderBy("path").collect()] == ["d", "f5"]


def walks(spark, n):
    """An entry point whose handler calls n functions of one concept, and a chain of n calls below it."""
    names = [*(f"price_from_{k}" for k in range(n)), *(f"c{k}" for k in range(n)), "h"]
    rows = [N(f"i{k}", "Item", qname=f"x::{q}", name=q, kind="fn", is_test=False) for k, q in enumerate(names)]
    rows += [N("ep", "EntryPoint", name="GET", handler_qname="x::h"), N("w", "Param", name="limit"), N("ok", "Param", name="limit"), N("bad", "Param", name="max")]
    edge = lambda s, d, label: {"src": s, "dst": d, "label": label, "props": {}}
    h = f"i{2 * n}"
    edges = [edge("ep", "w", "REGISTERS_PARAM"), edge("ep", h, "EXPOSES"), *(edge(h, f"i{k}", "CALLS") for k in range(n)), edge(h, f"i{n}", "CALLS"), *(edge(f"i{n + k}", f"i{n + k + 1}", "CALLS") for k in range(n - 1))]
    return graph_of(spark, rows, [*edges, edge("i0", "ok", "HAS_PARAM"), *(edge(f"i{n + k}", "bad", "HAS_PARAM") for k in range(n))])


def test_walks_as_long_as_the_program_says(spark):
    """the rule on dropped parameters follows its eight calls; other walks stop at five."""
    g = walks(spark, 12)
    rows = run_rule(g, "vertical-split-brain-drop").df.collect()
    assert [r.divergent_resolver for r in rows] == [f"x::c{k}" for k in range(8)]
    assert run_query(g, program("vertical-split-brain-drop")).df.count() == 5
    assert "r8 AS" in rule_catalog.oracle_sql()["rule_vertical_split_brain_drop"] and "r6 AS" not in rule_catalog.oracle_sql()["rule_vertical_split_brain"]


@pytest.mark.parametrize("rule", ["vertical-split-brain", "vertical-split-brain-drop"])
def test_branches_meet_last(spark, rule):
    """F2, F16: what hangs on a walk is put together before two walks meet, by all that ties them."""
    n, rows = joined(run_rule(walks(spark, 60), rule).df)
    want = 60 * 59 // 2 if rule == "vertical-split-brain" else 8
    assert len(rows) == want and n <= want + 12 * 60


def test_frequent_keys_are_dealt_out(spark):
    """pairs of one key are made by several tasks."""
    t = spark.createDataFrame([(f"p{k}", k, "x::same", f"b{k % 3}") for k in range(300)], "id string, partkey long, name string, brand string")
    df = run_query(Graph(spark, {"Part": t}), "MATCH (a:Part), (b:Part) WHERE last_segment(a.name) = last_segment(b.name) AND a.partkey < b.partkey AND a.brand <> b.brand RETURN a.partkey AS a, b.partkey AS b").df
    rows = df.collect()
    assert {(r.a, r.b) for r in rows} == {(a, b) for a in range(300) for b in range(a + 1, 300) if a % 3 != b % 3} and len(rows) == 30000
    assert df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).filter(bool).count() > 3
