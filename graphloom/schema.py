"""The vocabulary of code graphs: labels, their properties and types, and what edges link.

Labels, properties and types are those that producers and rule programs share (fixed values).
"""

from __future__ import annotations

from .sources.graph import SCHEMA_VERSION, Graph

#: label -> what it is, and properties as name:type; `?` marks what may be missing or null.
NODES: dict[str, tuple[str, str]] = {
    "Crate": ("A package of a workspace.", "name:string version:string is_workspace_member:bool published_language:bool"),
    "Module": ("A module: a file or a block in one.", "crate:string file:string is_inline:bool qpath:string"),
    "File": ("A source file.", "crate:string is_test:bool path:string"),
    "Item": (
        "A declaration.",
        "bounded_context:string cfg_gate:string? crate:string cyclomatic:int? deprecation_since:string? dup_cluster_id:string? file:string git_commit_count:int? git_last_author:string? git_last_commit_unix_ts:int? impl_target:string? impl_trait:string? is_deprecated:bool is_test:bool kind:string line:int module_qpath:string name:string qname:string reachable_entry_count:int? reachable_from_entry:bool? signature:string? signature_hash:string? test_coverage:float? unwrap_count:int? visibility:string",
    ),
    "Field": ("A field of a struct or variant.", "index:int name:string parent_qname:string type_path:string"),
    "Variant": ("A variant of an enum.", "index:int name:string parent_qname:string payload_kind:string"),
    "Param": ("A parameter of a function.", "index:int is_self:bool name:string parent_qname:string type_path:string"),
    "CallSite": ("A call as written.", "arg_count:int callee_last_segment:string callee_path:string callee_resolved:bool caller_qname:string file:string is_test:bool kind:string line:int resolver:string"),
    "EntryPoint": ("Where a program is entered.", "file:string handler_qname:string kind:string name:string params:string?"),
    "Concept": ("A concept that items stand for.", "assigned_by:string name:string"),
    "Context": ("A bounded context.", "canonical_crate:string? name:string owning_rfc:string? source:string"),
    "ConstTable": ("A constant table of literals.", "crate:string element_type:string entries_hash:string entries_normalized:string entries_sample:string entry_count:int is_test:bool module_qpath:string name:string qname:string"),
    "RfcDoc": ("A document that names items.", "path:string title:string?"),
}
#: label -> sources, targets, what it says.
EDGES: dict[str, tuple[str, str, str]] = {
    "IN_CRATE": ("any", "Crate", "belongs to a package"),
    "IN_MODULE": ("Item File", "Module", "lies in a module"),
    "HAS_FIELD": ("Item Variant", "Field", "owns a field"),
    "HAS_VARIANT": ("Item", "Variant", "owns a variant"),
    "HAS_PARAM": ("Item", "Param", "takes a parameter"),
    "HAS_CONST_TABLE": ("Item", "ConstTable", "is a constant table"),
    "TYPE_OF": ("Field Param Variant", "Item", "has this type"),
    "IMPLEMENTS": ("Item", "Item", "implements a trait"),
    "IMPLEMENTS_FOR": ("Item", "Item", "implements for a type"),
    "RETURNS": ("Item", "Item", "returns this type"),
    "BELONGS_TO": ("Crate", "Context", "is of a context"),
    "CALLS": ("Item", "Item", "calls"),
    "INVOKES_AT": ("Item", "CallSite", "has a call"),
    "EXPOSES": ("EntryPoint", "Item", "is handled by"),
    "REGISTERS_PARAM": ("EntryPoint", "Param Field Variant", "takes from outside"),
    "LABELED_AS": ("Item", "Concept", "is about a concept"),
    "CANONICAL_FOR": ("Item", "Concept", "is the home of a concept"),
    "EQUIVALENT_TO": ("Concept", "Concept", "means the same (reserved)"),
    "REFERENCED_BY": ("Item", "RfcDoc", "is named in"),
}


def schema_describe() -> dict:
    """The vocabulary as plain data."""
    attrs = lambda text: [{"name": n, "type": k.rstrip("?"), "optional": k.endswith("?")} for n, k in (p.split(":") for p in text.split())]
    return {
        "schema_version": ".".join(map(str, SCHEMA_VERSION)),
        "nodes": [{"label": k, "description": d, "attributes": attrs(p)} for k, (d, p) in NODES.items()],
        "edges": [{"label": k, "description": d, "from": [] if s == "any" else s.split(), "to": t.split()} for k, (s, t, d) in EDGES.items()],
    }


def schema_of(graph: Graph) -> dict:
    """The labels that a graph holds, with the properties found there and their kinds."""
    return {of: {label: dict(sorted(graph.properties(of[:-1], label).items())) for label in sorted(getattr(graph, of))} for of in ("nodes", "edges")}
