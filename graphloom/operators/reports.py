"""Report verbs: scope, classify, the checks and predicates."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..engine import QueryResult, program, run_query
from ..functions.values import Val, as_string, kind_of
from ..plans.compiler import Warning_
from ..plans.parser import parse
from ..rules import FINDING
from ..sources.graph import Graph
from ..sources.toml_specs import Contexts
from .dump import Diff

#: Classes of debt, in their order, and the rule program of each (fixed values).
CLASSES = {
    "duplicated_feature": "classifier-duplicated-feature",
    "context_homonym": "classifier-context-homonym",
    "unfinished_refactor": "classifier-unfinished-refactor",
    "random_scattering": "classifier-random-scattering",
    "canonical_bypass": "classifier-canonical-bypass",
    "unwired": "classifier-unwired",
}


#: Why a class may be empty (what its program needs).
NEEDS = {
    "duplicated_feature": "no two crates of this context have a type of one name",
    "context_homonym": "no function here differs in signature from one of its name in another context; without signatures there are none",
    "unfinished_refactor": "no deprecated item here",
    "random_scattering": "no reachable functions here fork one concept; this needs entry points, CALLS and the reachability pass",
    "canonical_bypass": "no canonical item here is unreachable; this needs the concepts and the reachability passes",
    "unwired": "no function here is unreachable; this needs the reachability pass",
}


@dataclass
class Scope:
    """findings(class and the columns of a finding), items of each crate, candidates for one home, and,
    once asked for, a warning for each empty class."""

    context: str
    findings: DataFrame
    items_by_crate: DataFrame
    candidates: DataFrame

    @cached_property
    def warnings(self) -> list[str]:
        found = {r["class"] for r in self.findings.select("class").distinct().collect()}
        return [f"{c} is empty: {why}" for c, why in NEEDS.items() if c not in found]


def _text(table: DataFrame, prop: str) -> Column:
    """A property's strings; other values are null."""
    kind = kind_of(table.schema[f"p_{prop}"].dataType)
    return as_string(Val(kind, F.col(f"p_{prop}")))


def _texts(graph: Graph, label: str, *props: str) -> DataFrame:
    table = graph.table("node", label, list(props))
    return table.select("id", *[_text(table, p).alias(p) for p in props])


def findings_of(graph: Graph, cls: str, context: str) -> DataFrame:
    """The distinct findings of one class in a context; rows that lack a text other than the line are no
    findings.  The program is asked for distinct rows: a finding needs one partner, not all of them."""
    text = parse(program(CLASSES[cls]))
    rows = run_query(graph, replace(text, return_=replace(text.return_, distinct=True, order=())), {"context": context}).df
    texts = [c for c in FINDING if c != "line"]
    have = rows.select(F.lit(cls).alias("class"), *[(F.coalesce(F.col(c).cast("long"), F.lit(0)) if c == "line" else F.col(c)).alias(c) for c in FINDING])
    return have.dropna(subset=texts).distinct()


def scope(graph: Graph, context: str) -> Scope:
    """The findings of all classes in one declared context, its crates' item counts, the names that
    several crates share, one of the context's among them; none of them is computed before it is read."""
    known = _texts(graph, "Context", "name")
    if known.where(F.col("name") == context).isEmpty():
        raise ValueError(f"no context {context!r}; known: {sorted(r.name for r in known.distinct().collect() if r.name)}")
    parts = None
    for cls in CLASSES:
        own = findings_of(graph, cls, context)
        parts = own if parts is None else parts.unionByName(own)
    place = F.create_map(*[F.lit(x) for i, c in enumerate(CLASSES) for x in (c, i)])
    findings = parts.orderBy(place[F.col("class")], *FINDING)
    whole = _all_texts(graph, "Item", *[c for c in FINDING if c != "line"]).where(F.col("bounded_context") == context)
    inventory = whole.groupBy("crate").agg(F.count(F.lit(1)).alias("n")).orderBy("crate")
    mine = _texts(graph, "Item", "crate", "bounded_context").where((F.col("bounded_context") == context) & F.col("crate").isNotNull()).select(F.collect_set("crate").alias("_mine"))  # one row
    named = run_query(graph, program("hsb-by-name")).df
    candidates = named.crossJoin(F.broadcast(mine)).where(F.arrays_overlap("crates", "_mine")).select("name", "kind", "crates", "qnames", "files").orderBy("name", "kind")
    return Scope(context, findings, inventory, candidates)


def _all_texts(graph: Graph, label: str, *props: str) -> DataFrame:
    return _texts(graph, label, *props).dropna(subset=list(props))


def classify(s: Scope, d: Diff) -> DataFrame:
    """The findings of a scope whose qualified names a diff adds or changes, on either side: a node's
    qualified name or else its id, an edge's both ends."""
    lines = d.added.select("line").unionByName(d.changed.select(F.col("a").alias("line"))).unionByName(d.changed.select(F.col("b").alias("line")))
    get = lambda p: F.get_json_object("line", p)
    names = F.when(get("$.kind") == "node", F.array(F.coalesce(get("$.props.qname"), get("$.id")))).otherwise(F.array(get("$.src_qname"), get("$.dst_qname")))
    touched = lines.select(F.explode(names).alias("qname")).where("qname is not null").distinct()
    return s.findings.join(touched, "qname", "left_semi")


def classify_jsonl(s: Scope, findings: DataFrame) -> str:
    """A header, the findings in class order, the warnings: one JSON object a line."""
    place = {c: i for i, c in enumerate(CLASSES)}
    rows = sorted((r.asDict() for r in findings.collect()), key=lambda r: (place[r["class"]], *(r[c] for c in FINDING)))
    out = [{"op": "header", "schema_version": "v1", "inventory_context": s.context, "findings": len(rows)}, *({"op": "finding", **r} for r in rows), *({"op": "warning", "message": w} for w in s.warnings)]
    return "\n".join(json.dumps(x, sort_keys=True) for x in out)


def check_t1(graph: Graph) -> DataFrame:
    """(verdict, context_name, canonical_crate, owning_rfc, evidence), by name and verdict: contexts
    that no item has, whose canonical crate isn't in the graph, or whose governing document no document
    node has in its path or title.  Empty and missing texts are no declaration."""
    contexts = _texts(graph, "Context", "name", "canonical_crate", "owning_rfc").where("name is not null")
    contexts = contexts.withColumnRenamed("name", "context_name")
    used = _texts(graph, "Item", "bounded_context").select(F.col("bounded_context").alias("context_name")).distinct()
    crates = _texts(graph, "Crate", "name").select(F.col("name").alias("canonical_crate")).distinct()
    titles = _texts(graph, "RfcDoc", "path", "title")
    words = titles.select(F.explode(F.array("path", "title")).alias("words")).where("words is not null")
    # each document text meets the few declared names, not the other way round; what is found is distinct
    wanted = contexts.where("owning_rfc <> ''").select("owning_rfc").distinct()
    cited = words.join(wanted, F.contains("words", "owning_rfc")).select("owning_rfc").distinct()
    verdict = lambda rows, name, evidence: rows.select(F.lit(name).alias("verdict"), "context_name", "canonical_crate", "owning_rfc", F.col(evidence).alias("evidence"))
    unwired = verdict(contexts.join(used, "context_name", "left_anti"), "CONCEPT_UNWIRED", "context_name")
    homeless = verdict(contexts.where("canonical_crate <> ''").join(crates, "canonical_crate", "left_anti"), "MISSING_CANONICAL_CRATE", "canonical_crate")
    stale = verdict(contexts.where("owning_rfc <> ''").join(cited, "owning_rfc", "left_anti"), "STALE_RFC_REFERENCE", "owning_rfc")
    return unwired.unionByName(homeless).unionByName(stale).orderBy("context_name", "verdict")


def check_t3(graph: Graph) -> DataFrame:
    """Types whose name several crates share, whether they cross contexts, and the first of their
    crates that some context declares canonical; most frequent first."""
    rows = run_query(graph, program("t3-concept-multi-crate")).df
    canon = _texts(graph, "Context", "canonical_crate").select(F.coalesce(F.collect_set("canonical_crate"), F.array().cast("array<string>")).alias("_canon"))  # one row
    rows = rows.crossJoin(F.broadcast(canon)).where("name is not null and kind is not null")
    return rows.withColumns({"is_cross_context": F.col("n_contexts") > 1, "canonical_candidate": F.try_element_at(F.array_intersect("crates", "_canon"), F.lit(1))}).drop("_canon").orderBy(F.desc("n"), "name", "kind")


_FORMS = ("context", "regex", "literal", "list")


def resolve_param(text: str, contexts: Contexts | None = None) -> tuple[str, object]:
    """name:form:value -> the parameter's name and value."""
    name, form, value = ([*text.split(":", 2), "", ""])[:3]
    if not name or form not in _FORMS:
        raise ValueError(f"{text!r}: expected name:form:value with a form of {', '.join(_FORMS)}")
    if form == "context":
        crates = sorted(c for c, ctx in (contexts.by_crate if contexts else {}).items() if ctx == value)
        if not crates:
            raise ValueError(f"no context {value!r}")
        return name, crates
    if form == "regex":
        re.compile(value)
    return name, [v.strip() for v in value.split(",") if v.strip()] if form == "list" else value


def check_predicate(graph: Graph, text: str, params: list[str], contexts: Contexts | None = None) -> DataFrame:
    """A predicate program's rows (qname, line, reason), sorted."""
    df = run_query(graph, text, dict(resolve_param(p, contexts) for p in params)).df
    gone = {"qname", "line", "reason"} - set(df.columns)
    if gone:
        raise ValueError(f"a predicate returns qname, line and reason; {', '.join(sorted(gone))} is missing")
    return df.select("qname", "line", "reason").orderBy("qname", "line", "reason")


#: Kinds of items by the names that callers give (fixed values: "Fn" -> "fn").
KINDS = {"Struct": "struct", "Enum": "enum", "Fn": "fn", "Const": "const", "TypeAlias": "type_alias", "ImplBlock": "impl_block", "Trait": "trait"}


def list_items_matching(graph: Graph, pattern: str, kinds: list[str] | None = None, group_by_context: bool = False) -> QueryResult:
    """Items whose name the pattern finds, flat or collected by bounded context.  kinds: names of KINDS
    or their values; of impl blocks there are no items, which a warning says."""
    where = "WHERE item.name =~ $pattern" + (" AND item.kind IN $kinds" if kinds is not None else "")
    if group_by_context:
        text = f"MATCH (item:Item) {where} WITH item.bounded_context AS bounded_context, collect(item) AS items RETURN bounded_context, items ORDER BY bounded_context"
    else:
        text = f"MATCH (item:Item) {where} RETURN {', '.join(f'item.{c} AS {c}' for c in FINDING)} ORDER BY qname"
    own = [KINDS.get(k, k) for k in kinds or []]
    result = run_query(graph, text, {"pattern": pattern, "kinds": own})
    if KINDS["ImplBlock"] in own:
        result.warnings.append(Warning_("EmptyResult", "impl blocks are no items of their own: the kind ImplBlock matches none", "leave ImplBlock out"))
    return result
