"""Enrichment: each pass takes a graph and returns it with further properties or edges, and a report."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import TAGGED, Val, tagged
from ..plans.joins import spread
from ..plans.tables import stored
from ..sources.graph import Graph

#: Crate-name prefixes that a context's name drops (fixed values).
CONTEXT_PREFIXES = ("adapters", "application", "domain", "ports", "qbot", "use-cases")
REACHING = ("CALLS", "INVOKES_AT")


@dataclass
class Report:
    verb: str
    ran: bool
    facts_scanned: int = 0
    attrs_written: int = 0
    edges_written: int = 0
    warnings: list[str] = field(default_factory=list)


def _with_items(graph: Graph, items: DataFrame) -> Graph:
    return replace(graph, nodes={**{k: graph.nodes[k] for k in graph.nodes if k != "Item"}, "Item": items})


def _with_edges(graph: Graph, label: str, edges: DataFrame) -> Graph:
    old = graph.edges[label] if label in graph.edges else None
    edges = {**{k: graph.edges[k] for k in graph.edges if k != label}, label: edges if old is None else old.unionByName(edges, allowMissingColumns=True)}
    return replace(graph, edges=edges, ends={k: v for k, v in graph.ends.items() if k != label})


def _put(table: DataFrame, **columns: Column) -> DataFrame:
    return table.withColumns(columns)


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """edges(src, dst), seeds(id) -> (seed, node): all that each seed reaches, itself included.  Each
    round joins the newest pairs alone and is written out; it ends when a round finds nothing."""
    edges = stored(edges.select("src", "dst").distinct(), "hops")
    found = newest = stored(seeds.select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct(), "reach")
    while True:
        step = newest.join(edges, newest.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        newest = stored(step.join(found, ["seed", "node"], "left_anti"), "reach")
        if newest.isEmpty():
            return found
        found = found.unionByName(newest)


def reachability(graph: Graph) -> tuple[Graph, Report]:
    """reachable_entry_count: how many different exposed items reach an item, each reaching itself."""
    if "EntryPoint" not in graph.nodes or graph.nodes["EntryPoint"].isEmpty():
        return graph, Report("reachability", False, warnings=["no EntryPoint in the graph"])
    exposes = graph.table("edge", "EXPOSES", []).join(graph.nodes["EntryPoint"].select(F.col("id").alias("src")), "src", "left_semi")
    hops = None
    for label in REACHING:
        own = graph.table("edge", label, []).select("src", "dst")
        hops = own if hops is None else hops.unionByName(own)
    pairs = reach(hops, exposes.select(F.col("dst").alias("id")))
    counts = pairs.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("_n"))
    items = graph.nodes["Item"].drop("reachable_entry_count", "reachable_from_entry").join(counts, "id", "left")
    n = F.coalesce("_n", F.lit(0)).cast("long")
    items = _put(items, reachable_entry_count=n, reachable_from_entry=n > 0).drop("_n")
    total = items.count()
    return _with_items(graph, items), Report("reachability", True, total, 2 * total)


def context_of(crate: Column) -> Column:
    """A crate's context by its name alone."""
    return F.regexp_replace(crate, f"^({'|'.join(CONTEXT_PREFIXES)})-(?=.)", "")


def context_name(crate: str) -> str:
    """context_of for one name at hand."""
    head, _, rest = crate.partition("-")
    if crate.startswith("use-cases-"):
        head, rest = "use-cases", crate[len("use-cases-") :]
    return rest if rest and head in CONTEXT_PREFIXES else crate


def bounded_context(graph: Graph, overrides: dict[str, str] | None = None) -> tuple[Graph, Report]:
    """Sets each item's bounded_context: the declared one of its crate, else by the crate's name."""
    spark = graph.spark
    declared = spark.createDataFrame(list((overrides or {}).items()), "crate string, _declared string")
    items = graph.nodes["Item"]
    old = F.col("bounded_context") if "bounded_context" in items.columns else F.lit(None).cast("string")
    rows = items.withColumn("_old", old).join(F.broadcast(declared), "crate", "left")  # a configuration's rows, on the driver already
    now = F.coalesce("_declared", context_of(F.col("crate")), F.col("_old"))
    rows = rows.withColumn("bounded_context", now)
    seen = rows.agg(F.count("*"), F.count_if(~F.col("_old").eqNullSafe(F.col("bounded_context")))).first()
    return _with_items(graph, rows.drop("_old", "_declared")), Report("bounded_context", True, seen[0], seen[1])


def concepts(graph: Graph, declared: list[dict]) -> tuple[Graph, Report]:
    """declared: {name, crates, canonical_crate?} each.  A Concept for each with a crate; LABELED_AS
    from all items of its crates, CANONICAL_FOR from all items of its canonical crate."""
    spark, used = graph.spark, [d for d in declared if d.get("crates")]
    if not used:
        return graph, Report("concepts", True)
    id_ = F.concat(F.lit("concept:"), "name")
    nodes = spark.createDataFrame([(d["name"],) for d in used], "name string").select(id_.alias("id"), "name", F.lit("manual").alias("assigned_by"))
    crates = spark.createDataFrame([(c, d["name"]) for d in used for c in d["crates"]], "crate string, name string").distinct()
    canonical = spark.createDataFrame([(d["canonical_crate"], d["name"]) for d in used if d.get("canonical_crate")], "crate string, name string")
    items = graph.nodes["Item"].select("id", "crate")
    out, written = graph, 0
    for label, of in (("LABELED_AS", crates), ("CANONICAL_FOR", canonical)):
        edges = items.join(F.broadcast(of), "crate").select(F.col("id").alias("src"), id_.alias("dst"))
        out = _with_edges(out, label, edges)
        written += edges.count()
    have = out.nodes["Concept"] if "Concept" in out.nodes else None
    if have is not None:
        nodes = have.join(nodes.select("id"), "id", "left_anti").unionByName(nodes, allowMissingColumns=True)
    out = replace(out, nodes={**{k: out.nodes[k] for k in out.nodes if k != "Concept"}, "Concept": nodes})
    return out, Report("concepts", True, items.count(), 2 * len(used), written)


def rfc_docs(graph: Graph, docs: DataFrame) -> tuple[Graph, Report]:
    """docs(path, text): REFERENCED_BY from each item to each document in which its name or qualified
    name stands as a whole word, the item's own file excepted; an RfcDoc node for each such document.
    Words join by equality: names as single words, qualified names as runs of words joined by `::`."""
    items = graph.table("node", "Item", ["name", "qname", "file"]).select("id", F.col("p_name").alias("name"), F.col("p_qname").alias("qname"), F.col("p_file").alias("file"))
    words = docs.select("path", F.explode(F.array_distinct(F.split("text", "[^A-Za-z0-9_]+"))).alias("word")).where("word <> ''")
    # every run of segments of a path in the text is a whole-word occurrence of that run
    paths = docs.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_]+(?:::[A-Za-z0-9_]+)+)"), F.lit(1)))).alias("whole"))
    parts = paths.select("path", F.split("whole", "::").alias("s"))
    starts = parts.select("path", "s", F.explode(F.sequence(F.lit(1), F.size("s") - 1)).alias("i"))
    runs = starts.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size("s") - F.col("i") + 1), lambda n: F.array_join(F.slice("s", F.col("i"), n), "::"))).alias("word"))
    terms = words.unionByName(runs).distinct()
    terms = stored(terms, "terms")
    other = F.expr("file is null or file <> path")
    word = lambda c: items.where(f"{c} <> ''").select("id", "file", "name", F.col(c).alias("word"))
    # pairs of an item and a document come once each without being told apart: those by name, then by a
    # qualified name where the name isn't in the document as well
    by_name = spread(word("name"), terms, ["word"], ["id"], other).select("id", "path")
    again = terms.select("path", F.col("word").alias("name"))
    by_qname = spread(word("qname").where("name is null or qname <> name"), terms, ["word"], ["id"], other).join(again, ["path", "name"], "left_anti").select("id", "path")
    edges = by_name.unionByName(by_qname).select(F.col("id").alias("src"), F.concat(F.lit("rfc:"), "path").alias("dst"))
    title = F.regexp_extract("text", r"(?m)^#\s+(.+?)\s*$", 1)
    used = docs.join(edges.select(F.expr("substring(dst, 5)").alias("path")).distinct(), "path", "left_semi")
    title = Val("str", F.when(title != "", title))
    null = F.struct(F.lit(0).cast("byte").alias("t"), F.lit(None).cast("string").alias("s"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("double").alias("f"), F.lit(None).cast("boolean").alias("b"))
    nodes = used.select(F.concat(F.lit("rfc:"), "path").alias("id"), "path", F.coalesce(tagged(title), null).alias("title"))
    out = _with_edges(graph, "REFERENCED_BY", edges)
    out = replace(out, nodes={**{k: out.nodes[k] for k in out.nodes if k != "RfcDoc"}, "RfcDoc": nodes})
    n = edges.count()
    return out, Report("rfc_docs", True, items.count(), 0, n)


def git_history(graph: Graph, commits: DataFrame) -> tuple[Graph, Report]:
    """commits(path, commit_ts, author_email), a row for each file of a commit: the last commit's time
    and author and the number of commits on each item, explicit nulls where its file has none."""
    last = commits.groupBy(F.col("path").alias("file")).agg(F.max("commit_ts").cast("long").alias("_ts"), F.max_by("author_email", F.struct("commit_ts", "author_email")).alias("_who"), F.count("*").alias("_n"))
    items = graph.nodes["Item"].drop("git_last_commit_unix_ts", "git_last_author", "git_commit_count").join(last, "file", "left")

    def or_null(kind: str, c: str) -> Column:
        null = F.struct(F.lit(0).cast("byte").alias("t"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in TAGGED.fields[1:]])
        return F.coalesce(tagged(Val(kind, F.col(c))), null)

    items = _put(items, git_last_commit_unix_ts=or_null("int", "_ts"), git_last_author=or_null("str", "_who"), git_commit_count=or_null("int", "_n")).drop("_ts", "_who", "_n")
    n = items.count()
    return _with_items(graph, items), Report("git_history", True, n, 3 * n)


def dup_clusters(items: DataFrame) -> DataFrame:
    """items(qname, signature_hash) -> (signature_hash, dup_cluster_id, n) of hashes with two or more."""
    groups = items.where("signature_hash is not null").groupBy("signature_hash").agg(F.sort_array(F.collect_list("qname")).alias("_q"), F.count("*").alias("n")).where("n >= 2")
    return groups.select("signature_hash", F.sha2(F.array_join("_q", "\n"), 256).alias("dup_cluster_id"), "n")


def metrics(graph: Graph, coverage: DataFrame | None = None, signals: DataFrame | None = None) -> tuple[Graph, Report]:
    """On functions: test_coverage of coverage(qname, ratio), unwrap_count and cyclomatic of
    signals(qname, ...), and dup_cluster_id of functions that share a signature_hash."""
    items = graph.nodes["Item"]
    is_fn = F.col("kind") == "fn"
    scanned = items.where(is_fn).count()
    wrote = 0
    for table, columns in ((coverage, {"ratio": "test_coverage"}), (signals, {"unwrap_count": "unwrap_count", "cyclomatic": "cyclomatic"})):
        if table is not None:
            own = table.select("qname", *[F.col(c).alias(f"_{to}") for c, to in columns.items()])
            items = items.drop(*columns.values()).join(own.dropDuplicates(["qname"]), "qname", "left")
            items = items.withColumns({to: F.when(is_fn, F.col(f"_{to}")) for to in columns.values()}).drop(*[f"_{to}" for to in columns.values()])
            wrote += len(columns)
    if "signature_hash" in items.columns:
        clusters = dup_clusters(items.where(is_fn)).select("signature_hash", F.col("dup_cluster_id").alias("_c"))
        items = items.drop("dup_cluster_id").join(clusters, "signature_hash", "left")
        items = items.withColumn("dup_cluster_id", F.when(is_fn, F.col("_c"))).drop("_c")
        wrote += 1
    return _with_items(graph, items), Report("metrics", True, scanned, wrote * scanned)


def deprecation(graph: Graph) -> tuple[Graph, Report]:
    """Nothing to do: extraction writes these facts."""
    return graph, Report("deprecation", True)


def coverage_of(rows: DataFrame) -> DataFrame:
    """The table of a coverage report, read with spark.read.json(multiLine=True) -> (qname, ratio in 0..1)."""
    functions = rows.select(F.explode("data").alias("d")).select(F.explode("d.functions").alias("f"))
    ratio = F.least(F.greatest(F.col("f.summary.lines.percent") / 100, F.lit(0.0)), F.lit(1.0))
    return functions.select(F.col("f.name").alias("qname"), ratio.alias("ratio"))


VERBS = {"reachability": reachability, "bounded_context": bounded_context, "concepts": concepts, "rfc_docs": rfc_docs, "git_history": git_history, "metrics": metrics, "deprecation": deprecation}


def enrich(graph: Graph, verb: str, *args, **kwargs) -> tuple[Graph, Report]:
    if verb not in VERBS:
        return graph, Report(verb, False, warnings=["not implemented"])
    return VERBS[verb](graph, *args, **kwargs)


