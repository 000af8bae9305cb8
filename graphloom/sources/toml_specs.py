"""Small configuration files: contexts, published languages, index hints, skill routes."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path


@dataclass
class Contexts:
    """declared: {name, crates, canonical_crate?, owning_rfc?} each; by_crate: crate -> context."""

    declared: list[dict] = field(default_factory=list)
    by_crate: dict[str, str] = field(default_factory=dict)


def load_contexts(folder: str) -> Contexts:
    """All *.toml of a folder by name; a later file wins a crate.  No folder, no contexts."""
    out = Contexts()
    for path in sorted(Path(folder).glob("*.toml")):
        doc = tomllib.loads(path.read_text(encoding="utf-8"))
        if "name" not in doc:
            raise ValueError(f"{path}: a context needs a name")
        out.declared.append({"crates": [], **doc})
        out.by_crate |= {c: doc["name"] for c in doc.get("crates", [])}
    return out


def load_published_languages(path: str) -> dict[str, dict]:
    """crate -> {language, owning_context, consumers}; a crate may be listed once."""
    out: dict[str, dict] = {}
    if Path(path).exists():
        for c in tomllib.loads(Path(path).read_text(encoding="utf-8")).get("crate", []):
            if c["name"] in out:
                raise ValueError(f"{path}: crate {c['name']} is listed twice")
            out[c["name"]] = {"language": c["language"], "owning_context": c["owning_context"], "consumers": c.get("consumers", [])}
    return out


def load_index_specs(path: str) -> list[dict]:
    """Index hints {label, prop or computed, notes}: which columns to keep apart or to bucket by."""
    out = []
    for s in tomllib.loads(Path(path).read_text(encoding="utf-8")).get("index", []):
        if ("prop" in s) == ("computed" in s):
            raise ValueError(f"{path}: an index has either prop or computed")
        if not s.get("notes"):
            raise ValueError(f"{path}: an index needs notes")
        out.append(s)
    return out


def load_skill_routes(path: str, classes: list[str]) -> tuple[dict[str, dict], list[str]]:
    """Routes by class of debt, and the classes without one."""
    routes = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("classes", {})
    return routes, [c for c in classes if c not in routes]
