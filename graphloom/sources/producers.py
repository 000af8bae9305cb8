"""Producers: source trees -> facts.  Spark lists and reads the files, one row each; a light scanner
runs over each in a task and yields facts, which become a graph by graph_of_facts.

The scanner reads the shape of declarations and calls off the text with comments and strings blanked
out; it resolves no types, so call sites carry the path as written.
"""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import FACTS, fact_rows

Fact = tuple[str, dict]


class Producer(Protocol):
    """A language: whether a folder is a workspace of it, and the FACTS in it."""

    name: str

    def detect(self, root: str) -> bool: ...

    def produce(self, spark: SparkSession, root: str) -> DataFrame: ...


class NoProducer(ValueError):
    pass


def node(id_: str, label: str, **props) -> Fact:
    return "node", {"id": id_, "label": label, "props": {k: v for k, v in props.items() if v is not None}}


def edge(src: str, label: str, dst: str, **props) -> Fact:
    return "edge", {"src": src, "dst": dst, "label": label, "props": props}


def _read(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, text): paths relative to the root, both sides decoded alike."""
    base = "file://" + os.path.abspath(root) + "/"
    rows = spark.read.text(base, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=True)
    full = F.regexp_replace(F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")), "^file:/+", "/")
    return rows.select(F.substring(full, F.lit(len(os.path.abspath(root)) + 2), F.length(full)).alias("path"), F.col("value").alias("text"))


def _facts(files: DataFrame, scan) -> DataFrame:
    """Facts of scan(path, text) for each file, in order of paths: a file's facts follow its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, path, text in zip(*(batch.column(c).to_pylist() for c in ("number", "path", "text"))):
                yield fact_rows((kind, number * (1 << 24) + k, fact) for k, (kind, fact) in enumerate(scan(path, text or "")))

    return files.select(F.xxhash64("path").bitwiseAND(F.lit((1 << 38) - 1)).alias("number"), "path", "text").mapInArrow(run, FACTS)


def _at_hand(spark: SparkSession, facts: list[Fact]) -> DataFrame:
    rows = [r | {"props": dict(r["props"])} for r in fact_rows((kind, k - (1 << 20), f) for k, (kind, f) in enumerate(facts)).to_pylist()]
    return spark.createDataFrame(rows, FACTS)


_QUIET = re.compile(r"""//[^\n]*|/\*.*?\*/|r(?P<h>#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*"|'(?:\\.[^']*|[^'\\])'""", re.S)


def _blank(m: re.Match) -> str:
    gone = re.sub(r"[^\n]", " ", m.group())
    return gone if m.group().startswith("/") else '"' + gone[1:]  # a literal still stands for a value


def blanked(text: str) -> str:
    """The text with comments, strings and characters as spaces; places and lines stay."""
    return _QUIET.sub(_blank, text)


def _closing(code: str) -> dict[int, int]:
    """Where each opening bracket closes."""
    out, open_ = {}, []
    for m in re.finditer(r"[(\[{}\])]", code):
        if m.group() in "([{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out


def _split(code: str, sep: str = ",") -> list[tuple[int, str]]:
    """Parts between separators outside all brackets, with their places."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(code + sep):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and code[i - 1 : i] not in ("-", "=")):
            depth -= 1
        elif c == sep and depth <= 0:
            if code[start:i].strip():
                out.append((start, code[start:i].strip()))
            start = i + 1
    return out


def _squeezed(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


_ITEM = re.compile(
    r"""(?P<attr>\#!?\[)|(?P<vis>\bpub(?:\s*\([^)]*\))?)\s|\b(?P<kind>mod|struct|enum|union|trait|type|const|static|fn)\s+(?:mut\s+)?(?P<name>[A-Za-z_]\w*)|\b(?P<impl>impl)\b|(?P<macro>\bmacro_rules!)|(?P<open>[{(\[])|(?P<end>;)""",
    re.X,
)
_CALL = re.compile(r"(?P<dot>\.\s*)?(?P<path>(?:::)?[A-Za-z_]\w*(?:\s*::\s*(?:<[^<>]*>\s*::\s*)?[A-Za-z_]\w*)*)\s*(?:::\s*<[^()]*?>\s*)?\(")
_NO_CALL = frozenset("if while match for return fn loop in let else move as where unsafe async await ref mut break continue impl dyn pub use mod".split())
_KINDS = {"union": "struct", "type": "type_alias"}
_BRANCH = re.compile(r"\b(?:if|while|for|loop)\b|&&|\|\||\?(?=[\s.;,)\]}?])")


class _Rust:
    """One file's facts."""

    def __init__(self, crate: str, context: str, path: str, module: list[str], text: str, is_test: bool):
        self.crate, self.context, self.path, self.text = crate, context, path, text
        self.code = blanked(text)
        self.closing = _closing(self.code)
        self.facts: list[Fact] = []
        self.file_id = f"file:{crate}:{path}"
        self.facts += [node(self.file_id, "File", path=path, crate=crate, is_test=is_test), edge(self.file_id, "IN_CRATE", f"crate:{crate}")]
        self._module(module, False)
        self.facts.append(edge(self.file_id, "IN_MODULE", f"module:{'::'.join(module)}"))
        self._scan(0, len(self.code), module, None, None, is_test)

    def _line(self, at: int) -> int:
        return self.code.count("\n", 0, at) + 1

    def _module(self, module: list[str], inline: bool) -> None:
        path = "::".join(module)
        self.facts += [node(f"module:{path}", "Module", qpath=path, crate=self.crate, file=self.path, is_inline=inline), edge(f"module:{path}", "IN_CRATE", f"crate:{self.crate}")]

    def _scan(self, at: int, end: int, module: list[str], target: str | None, trait: str | None, is_test: bool) -> None:
        attrs, visibility = "", "private"
        while m := _ITEM.search(self.code, at, end):
            at = m.end()
            if m["attr"]:
                close = self.closing.get(m.end() - 1, end)
                if not m.group().startswith("#!"):
                    attrs += self.text[m.end() : close] + "\n"
                at = close + 1
                continue
            if m["vis"]:
                visibility = re.sub(r"\s+", "", m["vis"]).replace("pub(in", "pub(in ")
                continue
            if m["open"]:
                at = self.closing.get(m.start(), end) + 1
                continue
            test = is_test or bool(re.search(r"^\s*(?:test\b|\w+::test\b|cfg\(test\))", attrs, re.M))
            if m["impl"]:
                at = self._impl(m.end(), end, module, test)
            elif m["kind"] == "mod":
                brace = re.compile(r"\s*\{").match(self.code, at, end)
                if brace:
                    close = self.closing.get(brace.end() - 1, end)
                    self._module([*module, m["name"]], True)
                    self._scan(brace.end(), close, [*module, m["name"]], None, None, test)
                    at = close + 1
            elif m["kind"] and not (m["kind"] == "const" and m["name"] == "fn"):
                at = self._item(m, end, module, target, trait, attrs, visibility, test)
            elif m["kind"]:  # const fn: the keyword that follows names the item
                at = m.start("name")
                continue
            attrs, visibility = "", "private"

    def _impl(self, at: int, end: int, module: list[str], is_test: bool) -> int:
        brace = self.code.find("{", at, end)
        if brace < 0:
            return end
        head = self.code[at:brace].split(" where ")[0].strip()
        if head.startswith("<"):
            depth = 0
            for i, c in enumerate(head):
                depth += (c == "<") - (c == ">" and head[i - 1] not in "-=")
                if depth == 0:
                    head = head[i + 1 :].strip()
                    break
        trait, _, own = head.rpartition(" for ")
        name = re.sub(r"<.*", "", own.strip(), flags=re.S).strip().lstrip("&").split("::")[-1].strip()
        close = self.closing.get(brace, end)
        if re.fullmatch(r"\w+", name):
            self._scan(brace + 1, close, module, name, _squeezed(trait) or None, is_test)
        return close + 1

    def _item(self, m: re.Match, end: int, module: list[str], target: str | None, trait: str | None, attrs: str, visibility: str, is_test: bool) -> int:
        kind, name = m["kind"], m["name"]
        qname = "::".join([*module, *([target] if target else []), name])
        id_ = f"item:{qname}"
        stop = re.compile(r"[;{]|\((?=[^()]*\)\s*;)" if kind == "struct" else r"[;{=]" if kind in ("type", "const", "static") else r"[;{]").search(self.code, m.end(), end)
        if kind == "fn" and (paren := self.code.find("(", m.end(), end)) >= 0:
            stop = re.compile(r"[;{]").search(self.code, self.closing.get(paren, paren) + 1, end)
        place = stop.start() if stop else end
        body = (place, self.closing.get(place, end)) if stop and stop.group() in "{(" else None
        gate = re.search(r"cfg\(([^\n]*feature[^\n]*)\)", attrs)
        since = re.search(r'deprecated\(.*?since\s*=\s*"([^"]*)"', attrs, re.S)
        props: dict = {}
        if kind == "fn":
            props["signature"] = _squeezed(re.sub(r"\s*where\b.*", "", self.code[m.start() : place], flags=re.S))
            if body:
                code = self.code[body[0] : body[1]]
                props["unwrap_count"] = len(re.findall(r"\.\s*(?:unwrap|expect)\s*\(", code))
                props["cyclomatic"] = 1 + len(_BRANCH.findall(code)) + self._match_arms(body)
        shown = "method" if kind == "fn" and target else _KINDS.get(kind, kind)
        self.facts += [
            node(id_, "Item", qname=qname, name=name, kind=shown, crate=self.crate, bounded_context=self.context, module_qpath="::".join(module), file=self.path, line=self._line(m.start()), is_test=is_test, visibility=visibility, is_deprecated=bool(re.search(r"^\s*deprecated\b", attrs, re.M)), deprecation_since=since and since[1], cfg_gate=gate and _squeezed(gate[1]), impl_target=target, impl_trait=trait, **props),
            edge(id_, "IN_CRATE", f"crate:{self.crate}"),
            edge(id_, "IN_MODULE", f"module:{'::'.join(module)}"),
        ]
        if kind == "fn":
            self._params(id_, qname, m.end(), place)
            if body:
                self._calls(id_, qname, *body, is_test)
        elif body and kind in ("struct", "union"):
            self._fields(id_, qname, *body)
        elif body and kind == "enum":
            self._variants(id_, qname, *body)
        elif body and kind == "trait":
            self._scan(body[0] + 1, body[1], module, name, None, is_test)
        if body:
            return body[1] + 1
        return (self.code.find(";", place, end) + 1) or end

    def _match_arms(self, body: tuple[int, int]) -> int:
        """Arms beyond the first of all matches in a body."""
        out = 0
        for m in re.compile(r"\bmatch\b").finditer(self.code, *body):
            brace = self.code.find("{", m.end(), body[1])
            if brace >= 0:
                out += max(0, self._arms(brace) - 1)
        return out

    def _arms(self, brace: int) -> int:
        close = self.closing.get(brace, brace)
        n, at = 0, brace + 1
        while m := re.compile(r"=>|[({\[]").search(self.code, at, close):
            n += m.group() == "=>"
            at = m.end() if m.group() == "=>" else self.closing.get(m.start(), close) + 1
        return n

    def _params(self, id_: str, qname: str, at: int, place: int) -> None:
        paren = self.code.find("(", at, place)
        if paren < 0:
            return
        for k, (_, part) in enumerate(_split(self.code[paren + 1 : self.closing.get(paren, place)])):
            own, _, kind = part.partition(":")
            own = _squeezed(own).removeprefix("mut ")
            is_self = bool(re.fullmatch(r"(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?self", own))
            name = "self" if is_self else own
            self.facts += [node(f"param:{qname}:{k}", "Param", name=name, index=k, is_self=is_self, parent_qname=qname, type_path=_squeezed(kind) or own), edge(id_, "HAS_PARAM", f"param:{qname}:{k}")]

    def _fields(self, id_: str, qname: str, start: int, end: int, owner: str | None = None) -> None:
        for k, (_, part) in enumerate(_split(re.sub(r"#\[[^\]]*\]", "", self.code[start + 1 : end]))):
            part = re.sub(r"^pub(?:\s*\([^)]*\))?\s+", "", part)
            name, colon, kind = part.partition(":")
            name = name.strip() if colon and self.code[start] == "{" else str(k)
            self.facts += [node(f"field:{qname}.{name}", "Field", name=name, index=k, parent_qname=qname, type_path=_squeezed(kind if colon and name != str(k) else part)), edge(owner or id_, "HAS_FIELD", f"field:{qname}.{name}")]

    def _variants(self, id_: str, qname: str, start: int, end: int) -> None:
        inside = re.sub(r"#\[[^\]]*\]", lambda m: " " * len(m.group()), self.code[start + 1 : end])
        for k, (_, part) in enumerate(_split(inside)):
            name = re.match(r"\w+", part)
            if name:
                rest = part[name.end() :].lstrip()
                kind = "tuple" if rest.startswith("(") else "struct" if rest.startswith("{") else "unit"
                self.facts += [node(f"variant:{qname}::{name[0]}", "Variant", name=name[0], index=k, parent_qname=qname, payload_kind=kind), edge(id_, "HAS_VARIANT", f"variant:{qname}::{name[0]}")]

    def _calls(self, id_: str, qname: str, start: int, end: int, is_test: bool) -> None:
        for k, m in enumerate(x for x in _CALL.finditer(self.code, start, end) if x["path"] not in _NO_CALL):
            before = self.code[max(0, m.start() - 4) : m.start()]
            if re.search(r"\bfn\s*$", before):
                continue
            path = re.sub(r"\s*::\s*(?:<[^<>]*>\s*::\s*)?", "::", m["path"]).lstrip(":") if not m["dot"] else m["path"].split("::")[0]
            args = len(_split(self.code[m.end() : self.closing.get(m.end() - 1, end)]))
            site = f"callsite:{qname}:{path}:{k}"
            self.facts += [node(site, "CallSite", caller_qname=qname, callee_path=path, callee_last_segment=path.split("::")[-1], kind="method" if m["dot"] else "call", file=self.path, line=self._line(m.start("path")), is_test=is_test, resolver="syn", callee_resolved=False, arg_count=args), edge(id_, "INVOKES_AT", site)]


class RustProducer:
    """Cargo workspaces: crates by their Cargo.toml, modules by paths and `mod` blocks."""

    name = "rust"

    def detect(self, root: str) -> bool:
        return os.path.exists(os.path.join(root, "Cargo.toml"))

    def produce(self, spark: SparkSession, root: str) -> DataFrame:
        from ..operators.enrich import context_name
        from .toml_specs import load_contexts, load_published_languages

        contexts = load_contexts(os.path.join(root, ".cfdb", "concepts"))
        published = load_published_languages(os.path.join(root, ".cfdb", "published-language-crates.toml"))
        crates, facts = {}, []
        manifests = _read(spark, root, "Cargo.toml").where(~F.col("path").rlike("(^|/)target/")).orderBy("path")
        for r in manifests.toLocalIterator():  # a workspace's manifests
            package = tomllib.loads(r.text).get("package")
            if package:
                version = package.get("version", "")
                crates[os.path.dirname(r.path)] = package["name"]
                context = contexts.by_crate.get(package["name"], context_name(package["name"]))
                facts += [node(f"crate:{package['name']}", "Crate", name=package["name"], version=version if isinstance(version, str) else "", is_workspace_member=True, published_language=package["name"] in published), edge(f"crate:{package['name']}", "BELONGS_TO", f"context:{context}")]
                declared = next((d for d in contexts.declared if d["name"] == context), None)
                facts.append(("node", {"id": f"context:{context}", "label": "Context", "props": {"name": context, "canonical_crate": (declared or {}).get("canonical_crate"), "owning_rfc": (declared or {}).get("owning_rfc"), "source": "declared" if declared else "heuristic"}}))
        names = dict(sorted(crates.items(), key=lambda kv: -len(kv[0])))
        by_crate = {c: contexts.by_crate.get(c, context_name(c)) for c in crates.values()}

        def scan(path: str, text: str) -> list[Fact]:
            folder = next((d for d in names if d == "" or path.startswith(d + "/")), None)
            if folder is None:
                return []
            inner = path[len(folder) + 1 if folder else 0 :]
            crate, parts = names[folder], inner.removesuffix(".rs").split("/")
            is_test = parts[0] in ("tests", "benches")
            parts = parts[1:] if parts[0] == "src" else parts
            module = [crate.replace("-", "_"), *(p for k, p in enumerate(parts) if not (k == len(parts) - 1 and p in ("lib", "main", "mod")))]
            return _Rust(crate, by_crate[crate], path, module, text, is_test).facts

        files = _read(spark, root, "*.rs").where(~F.col("path").rlike("(^|/)target/"))
        return _at_hand(spark, facts).unionByName(_facts(files, scan))


class _Simple:
    """Languages of which crates, modules and declarations are read."""

    name, marks, glob, skip = "", (), "", ""

    def detect(self, root: str) -> bool:
        return all(os.path.exists(os.path.join(root, m)) for m in self.marks)

    def crate(self, root: str) -> dict:
        raise NotImplementedError

    def scan(self, crate: str, path: str, text: str) -> list[Fact]:
        raise NotImplementedError

    def produce(self, spark: SparkSession, root: str) -> DataFrame:
        own = self.crate(root)
        files = _read(spark, root, self.glob).where(~F.col("path").rlike(self.skip))
        scan, name = self.scan, own["name"]
        return _at_hand(spark, [node(f"crate:{name}", "Crate", **own, is_workspace_member=True)]).unionByName(_facts(files, lambda p, t: scan(name, p, t)))

    def _declared(self, crate: str, module: str, path: str, code: str, found: Iterator[tuple[int, str, str]]) -> list[Fact]:
        out = [node(f"module:{module}", "Module", qpath=module, crate=crate, file=path, is_inline=False), edge(f"module:{module}", "IN_CRATE", f"crate:{crate}")]
        for at, kind, name in found:
            qname = f"{module}::{name}"
            out += [node(f"item:{qname}", "Item", qname=qname, name=name.split("::")[-1], kind=kind, crate=crate, module_qpath=module, file=path, line=code.count("\n", 0, at) + 1, is_test=False, is_deprecated=False), edge(f"item:{qname}", "IN_CRATE", f"crate:{crate}"), edge(f"item:{qname}", "IN_MODULE", f"module:{module}")]
        return out


def _members(code: str, closing: dict[int, int], m: re.Match, name: str, method: re.Pattern) -> Iterator[tuple[int, str, str]]:
    brace = code.find("{", m.end())
    if brace >= 0:
        for x in method.finditer(code, brace, closing.get(brace, len(code))):
            yield x.start(), "fn", f"{name}::{x['name']}"


class PhpProducer(_Simple):
    """Composer packages: types as traits, functions and methods."""

    name, marks, glob, skip = "php", ("composer.json",), "*.php", "(^|/)vendor/"

    def crate(self, root: str) -> dict:
        return {"name": "php-workspace"}

    def scan(self, crate: str, path: str, text: str) -> list[Fact]:
        code = re.sub(r"#(?!\[)[^\n]*", lambda m: " " * len(m.group()), blanked(text))
        space = re.search(r"\bnamespace\s+([\w\\]+)", code)
        module, closing = space[1].replace("\\", "::") if space else path.removesuffix(".php").replace("/", "::"), _closing(code)

        def found() -> Iterator[tuple[int, str, str]]:
            inside: list[tuple[int, int]] = []
            for m in re.finditer(r"\b(?:class|interface|trait)\s+(\w+)", code):
                brace = code.find("{", m.end())
                inside.append((brace, closing.get(brace, len(code))))
                yield m.start(), "trait", m[1]
                yield from _members(code, closing, m, m[1], re.compile(r"\bfunction\s+&?(?P<name>\w+)"))
            for m in re.finditer(r"\bfunction\s+&?(\w+)", code):
                if not any(a < m.start() < b for a, b in inside):
                    yield m.start(), "fn", m[1]

        return self._declared(crate, module, path, code, found())


class TypeScriptProducer(_Simple):
    """Packages with a tsconfig: types, functions, methods and constants at the top of a file."""

    name, marks, glob, skip = "typescript", ("package.json", "tsconfig.json"), "*.ts", r"(^|/)(node_modules|dist)/|\.d\.ts$"
    _KIND = {"class": "struct", "interface": "trait", "enum": "enum", "type": "type_alias", "function": "fn", "const": "const"}

    def crate(self, root: str) -> dict:
        with open(os.path.join(root, "package.json"), encoding="utf-8") as f:
            return {"name": json.load(f).get("name") or os.path.basename(os.path.abspath(root)), "language": self.name, "published_language": False}

    def scan(self, crate: str, path: str, text: str) -> list[Fact]:
        code = re.sub(r"`(?:\\.|[^`\\])*`", lambda m: re.sub(r"[^\n]", " ", m.group()), blanked(text), flags=re.S)
        module, closing = "::".join([crate, *path.removesuffix(".ts").split("/")]), _closing(code)
        tops = re.compile(r"\b(class|interface|enum|type|function|const)\s*\*?\s+(\w+)")

        def found() -> Iterator[tuple[int, str, str]]:
            at = 0
            while m := re.compile(r"[{(\[]|" + tops.pattern).search(code, at):
                if m[0] in "{([":
                    at = closing.get(m.start(), len(code)) + 1
                    continue
                yield m.start(), self._KIND[m[1]], m[2]
                if m[1] == "class":
                    yield from _members(code, closing, m, m[2], re.compile(r"(?m)^\s*(?:(?:public|private|protected|static|async|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|return\b|catch\b)(?P<name>\w+)\s*(?:<[^<>{}]*>)?\([^{};]*\)\s*(?::[^{};=]+)?\{"))
                at = m.end()

        return self._declared(crate, module, path, code, found())


PRODUCERS: list[Producer] = [RustProducer(), PhpProducer(), TypeScriptProducer()]


def extract(spark: SparkSession, root: str) -> tuple[DataFrame, list[str]]:
    """The FACTS of a workspace by the first producer that detects it, and warnings."""
    found = [p for p in PRODUCERS if p.detect(root)]
    if not found:
        raise NoProducer(f"{root}: none of {', '.join(p.name for p in PRODUCERS)} is at home here")
    warnings = [f"several languages; {found[0].name} is read, not {', '.join(p.name for p in found[1:])}"] if len(found) > 1 else []
    return found[0].produce(spark, root), warnings
