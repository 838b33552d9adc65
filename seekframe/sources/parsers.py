"""Source files to symbols and edges.

A parser is a function from a text to a ``Parsed``; ``parse`` runs them over a table of files
in Arrow batches.  Python is read by its own grammar, data files by the standard parsers, and
other languages by declaration patterns; what yields no symbol is cut into line windows.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_SELECTORS, MOST_VARIABLES, WINDOW, WINDOW_CHARS = 300, 100, 60, 1600

SYMBOL = "struct<name:string,qualified_name:string,kind:string,line_start:int,line_end:int,signature:string,body:string,docstring:string,decorators:array<string>,parent:string>"
CALL = "struct<caller:string,callee_name:string,hint:string,line:int>"
IMPORT = "struct<imported_from:string,names:array<string>>"
TYPE = "struct<from_symbol:string,to_type_name:string,edge_kind:string>"
SCHEMA = f"rel_path string, symbols array<{SYMBOL}>, calls array<{CALL}>, imports array<{IMPORT}>, types array<{TYPE}>, error string"


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    types: list[dict] = field(default_factory=list)

    def symbol(self, name: str, kind: str, start: int, end: int, text: str, *, parent: str | None = None, signature: str | None = None, doc: str | None = None, decorators: list[str] | None = None) -> str:
        lines = text.split("\n")[start - 1 : end]
        qualified = f"{parent}.{name}" if parent else name
        self.symbols.append({"name": name, "qualified_name": qualified, "kind": kind, "line_start": start, "line_end": end, "signature": signature or (lines[0].strip() if lines else name), "body": "\n".join(lines), "docstring": doc, "decorators": decorators or [], "parent": parent})
        return qualified


class _Python(ast.NodeVisitor):
    def __init__(self, text: str):
        self.text, self.out = text, Parsed()
        self.scope: list[str] = []
        self.hints: list[dict[str, str]] = [{}]
        self.in_function = False

    def _add(self, node, kind: str) -> str:
        decorators = [ast.unparse(d) for d in node.decorator_list]
        first = self.text.split("\n")[node.lineno - 1].strip().rstrip(":")
        return self.out.symbol(node.name, kind, node.lineno, node.end_lineno, self.text, parent=".".join(self.scope) or None, signature=first, doc=ast.get_docstring(node), decorators=decorators)

    def visit_Module(self, node):  # noqa: N802
        if doc := ast.get_docstring(node):
            self.out.symbol("module", "module", 1, node.body[0].end_lineno, self.text, doc=doc)
        self.generic_visit(node)

    def visit_ClassDef(self, node):  # noqa: N802
        bases = [ast.unparse(b) for b in node.bases]
        kind = "enum" if any("Enum" in b for b in bases) else "interface" if any("Protocol" in b for b in bases) else "class"
        name = self._add(node, kind)
        self.out.types += [{"from_symbol": name, "to_type_name": b.split("[")[0].split(".")[-1], "edge_kind": "extends"} for b in bases]
        self._inside(node, node.name, self.in_function)

    def _function(self, node):
        method = bool(self.scope) and not self.in_function
        self._add(node, "method" if method else "function")
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        self.hints.append({a.arg: ast.unparse(a.annotation).strip("'\"").split("[")[0] for a in args if a.annotation})
        if method and args and args[0].arg in ("self", "cls"):
            self.hints[-1][args[0].arg] = self.scope[-1]
        self._inside(node, node.name, True)
        self.hints.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function  # noqa: N815

    def _inside(self, node, name: str, in_function: bool):
        before, self.in_function = self.in_function, in_function
        self.scope.append(name)
        for child in node.body:
            self.visit(child)
        self.scope.pop()
        self.in_function = before

    def visit_Call(self, node):  # noqa: N802
        callee, hint = None, None
        if isinstance(node.func, ast.Name):
            callee = node.func.id
        elif isinstance(node.func, ast.Attribute):
            callee = node.func.attr
            if isinstance(node.func.value, ast.Name):
                hint = next((h[node.func.value.id] for h in reversed(self.hints) if node.func.value.id in h), None)
        if callee:
            self.out.calls.append({"caller": ".".join(self.scope) or "module", "callee_name": callee, "hint": hint, "line": node.lineno})
        self.generic_visit(node)

    def visit_Import(self, node):  # noqa: N802
        self.out.imports += [{"imported_from": a.name, "names": []} for a in node.names]

    def visit_ImportFrom(self, node):  # noqa: N802
        self.out.imports.append({"imported_from": "." * node.level + (node.module or ""), "names": [a.name for a in node.names]})

    def visit_Assign(self, node):  # noqa: N802
        if not self.in_function and not self.scope:
            for target in node.targets:
                if isinstance(target, ast.Name):
                    self.out.symbol(target.id, "constant" if target.id.isupper() else "variable", node.lineno, node.end_lineno, self.text)
        self.generic_visit(node)


def python(text: str) -> Parsed:
    visitor = _Python(text)
    visitor.visit(ast.parse(text))
    return visitor.out


#: Declarations by language: (kind, pattern with the name in group 1 and, if any, what it extends in group 2).
DECLARATIONS: dict[str, list[tuple[str, str]]] = {
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:\s+extends\s+([\w.]+))?"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)\s*\("), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("constant", r"^(?:export\s+)?const\s+([A-Z][A-Z0-9_]+)\s*="), ("method", r"^\s{2,}(?:async\s+|static\s+|get\s+|set\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(\w+)\s*\([^)]*\)\s*\{")],
    "typescript": [("interface", r"^\s*(?:export\s+)?interface\s+(\w+)(?:\s+extends\s+([\w.]+))?"), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("constant", r"^\s*(?:export\s+)?type\s+(\w+)\s*=")],
    "go": [("class", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("method", r"^func\s+\([^)]*\)\s+(\w+)\s*\("), ("function", r"^func\s+(\w+)\s*[\[(]"), ("constant", r"^(?:const|var)\s+(\w+)")],
    "rust": [("class", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)(?:\s*:\s*(\w+))?"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)"), ("constant", r"^\s*(?:pub\s+)?(?:const|static)\s+(\w+)\s*:")],
    "java": [("class", r"^\s*(?:public\s+|private\s+|protected\s+|abstract\s+|final\s+|static\s+)*(?:class|record)\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+([\w.]+))?"), ("interface", r"^\s*(?:public\s+|private\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:public\s+|private\s+)*enum\s+(\w+)"), ("method", r"^\s+(?:public|private|protected|static|final|synchronized|abstract|\s)+[\w<>\[\],.? ]+\s+(\w+)\s*\([^;]*$")],
    "kotlin": [("class", r"^\s*(?:\w+\s+)*class\s+(\w+)(?:[^:{]*:\s*(\w+))?"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"), ("class", r"^\s*(?:\w+\s+)*object\s+(\w+)"), ("function", r"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(")],
    "c": [("class", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(\w+)"), ("constant", r"^\s*#define\s+(\w+)"), ("function", r"^[A-Za-z_][\w\s*]*?\b(?!if\b|for\b|while\b|switch\b|return\b)(\w+)\s*\([^;]*\)\s*\{?\s*$")],
    "cpp": [("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)(?:\s*:\s*(?:public|private|protected)\s+([\w:]+))?"), ("method", r"^[\w:<>*&\s]+?\b\w+::(~?\w+)\s*\([^;]*\)[^;]*\{?\s*$")],
    "csharp": [("class", r"^\s*(?:\w+\s+)*(?:class|record|struct)\s+(\w+)(?:<[^>]*>)?(?:\s*:\s*([\w.]+))?"), ("interface", r"^\s*(?:\w+\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:\w+\s+)*enum\s+(\w+)"), ("method", r"^\s+(?:public|private|protected|internal)\s+(?:\w+\s+)*[\w<>\[\],.?]+\s+(\w+)\s*\([^;]*$")],
    "ruby": [("class", r"^\s*class\s+([\w:]+)(?:\s*<\s*([\w:]+))?"), ("module", r"^\s*module\s+([\w:]+)"), ("method", r"^\s*def\s+(?:self\.)?([\w?!=]+)"), ("constant", r"^\s*([A-Z][A-Z0-9_]+)\s*=")],
}
SAME = {"typescript": "javascript", "tsx": "javascript", "cpp": "c"}
IMPORTS = {
    "javascript": r"(?:import\s+(?:[^'\"]*?from\s+)?|require\()\s*['\"]([^'\"]+)['\"]",
    "go": r"^\s*(?:import\s+)?(?:\w+\s+)?\"([\w./-]+)\"\s*$",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
    "java": r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;",
    "kotlin": r"^\s*import\s+([\w.*]+)",
    "c": r"^\s*#include\s+[<\"]([^>\"]+)[>\"]",
    "csharp": r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;",
    "ruby": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",
    "css": r"@import\s+(?:url\()?['\"]([^'\"]+)['\"]",
}
_CALL = re.compile(r"(?:(\w+)\.)?\b(\w+)\s*\(")
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "fn", "func", "def", "fun", "sizeof", "new", "class"}


def declared(language: str) -> Callable[[str], Parsed]:
    rules = [(k, re.compile(p)) for k, p in [*DECLARATIONS.get(language, []), *DECLARATIONS.get(SAME.get(language, ""), [])]]
    imports = re.compile(IMPORTS.get(language) or IMPORTS.get(SAME.get(language, ""), r"(?!)"), re.MULTILINE)

    def parse(text: str) -> Parsed:
        out, lines = Parsed(), text.split("\n")
        found = [(n, kind, m) for n, line in enumerate(lines, 1) if (hit := next(((k, m) for k, p in rules if (m := p.match(line))), None)) for kind, m in [hit]]
        stack: list[tuple[int, str]] = []
        for i, (n, kind, m) in enumerate(found):
            indent = len(lines[n - 1]) - len(lines[n - 1].lstrip())
            while stack and stack[-1][0] >= indent:
                stack.pop()
            end = next((o - 1 for o, _, x in found[i + 1 :] if len(lines[o - 1]) - len(lines[o - 1].lstrip()) <= indent), len(lines))
            name = out.symbol(m[1], kind, n, max(n, end), text, parent=stack[-1][1] if stack else None)
            if m.re.groups > 1 and m[2]:
                out.types.append({"from_symbol": name, "to_type_name": re.split(r"[.:]+", m[2])[-1], "edge_kind": "extends"})
            if kind in ("class", "interface", "module", "enum"):
                stack.append((indent, name))
            elif kind in ("function", "method"):
                for k in range(n, min(end, len(lines))):
                    out.calls += [{"caller": name, "callee_name": c[2], "hint": c[1], "line": k + 1} for c in _CALL.finditer(lines[k]) if c[2] not in _NO_CALL]
        out.imports = [{"imported_from": m[1], "names": []} for m in imports.finditer(text)]
        return out

    return parse


def _tree(out: Parsed, value: object, text: str, parent: str | None = None, depth: int = 0) -> None:
    if isinstance(value, dict) and depth < 3:
        for key, inner in value.items():
            line = next((i for i, x in enumerate(text.split("\n"), 1) if re.search(rf"(^|[\s\"'\[{{.]){re.escape(str(key))}[\"']?\s*[:=\]]", x)), 1)
            name = out.symbol(str(key), "section" if isinstance(inner, dict) else "constant", line, line, text, parent=parent)
            _tree(out, inner, text, name, depth + 1)


def _dependencies(out: Parsed, value: object, keys: set[str]) -> None:
    if isinstance(value, dict):
        for key, inner in value.items():
            if key in keys and isinstance(inner, dict | list):
                out.imports += [{"imported_from": re.split(r"[<>=~! \[]", str(x))[0], "names": []} for x in inner]
            _dependencies(out, inner, keys)


def json_file(text: str) -> Parsed:
    out, value = Parsed(), json.loads(text)
    _tree(out, value, text)
    _dependencies(out, value, {"dependencies", "devDependencies", "peerDependencies"})
    return out


def toml_file(text: str) -> Parsed:
    out, value = Parsed(), tomllib.loads(text)
    _tree(out, value, text)
    _dependencies(out, value, {"dependencies", "dev-dependencies"})
    return out


def yaml_file(text: str) -> Parsed:
    out = Parsed()
    parents: list[tuple[int, str]] = []
    document = 0
    for n, line in enumerate(text.split("\n"), 1):
        document += line.startswith("---") and n > 1
        m = re.match(r"^(\s*)(?:- )?([\w./-]+):(?:\s|$)", line)
        if m:
            while parents and parents[-1][0] >= len(m[1]):
                parents.pop()
            parent = parents[-1][1] if parents else (f"doc{document}" if document else None)
            parents.append((len(m[1]), out.symbol(m[2], "constant" if line.split(":", 1)[1].strip() else "section", n, n, text, parent=parent)))
    return out


def markdown(text: str) -> Parsed:
    out, lines = Parsed(), text.split("\n")
    heads: list[tuple[int, int, str]] = []
    fenced = False
    for n, line in enumerate(lines, 1):
        fenced ^= line.startswith(("```", "~~~"))
        if not fenced and (m := re.match(r"^(#{1,6})\s+(.*?)\s*#*$", line)):
            heads.append((n, len(m[1]), m[2]))
        elif not fenced and n > 1 and re.match(r"^(=+|-+)\s*$", line) and lines[n - 2].strip() and not re.match(r"^(#|---$)", lines[n - 2]):
            heads.append((n - 1, 1 if line[0] == "=" else 2, lines[n - 2].strip()))
    path: list[tuple[int, str]] = []
    for i, (n, level, title) in enumerate(heads):
        while path and path[-1][0] >= level:
            path.pop()
        end = next((o - 1 for o, other, _ in heads[i + 1 :] if other <= level), len(lines))
        out.symbol(title, "section", n, end, text)
        path.append((level, title))
        out.symbols[-1]["qualified_name"] = " > ".join(t for _, t in path)
        out.symbols[-1]["parent"] = " > ".join(t for _, t in path[:-1]) or None
    return out


class _Html(HTMLParser):
    def __init__(self, text: str):
        super().__init__()
        self.text, self.out = text, Parsed()
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        given, line = dict(attrs), self.getpos()[0]
        if tag in ("header", "nav", "main", "footer", "aside", "section", "article", "form"):
            self.out.symbol(given.get("id") or tag, "section", line, line, self.text)
        elif given.get("id"):
            self.out.symbol(given["id"], "constant", line, line, self.text)
        if "-" in tag and len(self.out.symbols) < 150:
            self.out.symbol(tag, "class", line, line, self.text)
        link = given.get("src") if tag == "script" else given.get("href") if tag == "link" else None
        if link:
            self.out.imports.append({"imported_from": link, "names": []})


def html(text: str) -> Parsed:
    return _Html(text).out


def css(text: str) -> Parsed:
    out, selectors, variables = Parsed(), 0, 0
    for n, line in enumerate(text.split("\n"), 1):
        if (m := re.match(r"^\s*(--[\w-]+)\s*:", line)) and variables < MOST_VARIABLES:
            variables += 1
            out.symbol(m[1], "constant", n, n, text)
        elif m := re.match(r"^\s*@(media|keyframes|supports|layer|font-face)\b\s*([^{]*)", line):
            out.symbol(f"@{m[1]} {m[2].strip()}".strip(), "section", n, n, text)
        elif (m := re.match(r"^\s*([^@{}/\s][^{}]*?)\s*\{", line)) and selectors < MOST_SELECTORS:
            selectors += 1
            out.symbol(m[1], "class", n, n, text)
    out.imports = [{"imported_from": m[1], "names": []} for m in re.finditer(IMPORTS["css"], text)]
    return out


def windows(text: str) -> Parsed:
    """Windows of 60 lines, shorter while they have more than 1,600 characters, blank ones dropped."""
    out, lines, at = Parsed(), text.split("\n"), 0
    while at < len(lines):
        size = WINDOW
        while size > 1 and len("\n".join(lines[at : at + size])) > WINDOW_CHARS:
            size //= 2
        if "".join(lines[at : at + size]).strip():
            out.symbol(f"section_{len(out.symbols) + 1}", "section", at + 1, min(at + size, len(lines)), text)
        at += size
    return out


def razor(text: str) -> Parsed:
    out = declared("csharp")(text)
    out.imports += [{"imported_from": m[1], "names": []} for m in re.finditer(r"^@using\s+([\w.]+)", text, re.MULTILINE)]
    out.types += [{"from_symbol": "module", "to_type_name": m[1].split(".")[-1], "edge_kind": "extends"} for m in re.finditer(r"^@inherits\s+([\w.]+)", text, re.MULTILINE)]
    return out


def csproj(text: str) -> Parsed:
    out = Parsed()
    for n, line in enumerate(text.split("\n"), 1):
        if m := re.search(r"<(?:PackageReference|ProjectReference)\s+Include=\"([^\"]+)\"", line):
            out.imports.append({"imported_from": m[1], "names": []})
        elif m := re.match(r"\s*<(\w+)>([^<]+)</\1>", line):
            out.symbol(m[1], "constant", n, n, text)
    return out


PARSERS: dict[str, Callable[[str], Parsed]] = {
    "python": python, "json": json_file, "toml": toml_file, "yaml": yaml_file, "markdown": markdown, "html": html, "css": css, "razor": razor, "cshtml": razor, "csproj": csproj,
    **{lang: declared(lang) for lang in ("javascript", "typescript", "tsx", "go", "rust", "java", "kotlin", "c", "cpp", "csharp", "ruby")},
}


def parse_one(text: str, language: str) -> tuple[Parsed, str | None]:
    """The parse of a text, by windows if its parser finds nothing, and what went wrong."""
    error = None
    try:
        out = PARSERS.get(language, windows)(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out, error = Parsed(), f"{type(e).__name__}: {e}"[:200]
    return (out, error) if out.symbols else (Parsed(windows(text).symbols, out.calls, out.imports, out.types), error)


def parse(files: DataFrame) -> DataFrame:
    """rel_path, symbols, calls, imports, types, error of each file (rel_path, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, text in zip(pdf["rel_path"], pdf["language"], pdf["text"], strict=True):
                out, error = parse_one(text or "", language)
                rows.append((path, out.symbols, out.calls, out.imports, out.types, error))
            yield pd.DataFrame(rows, columns=["rel_path", "symbols", "calls", "imports", "types", "error"])

    return files.select("rel_path", "language", "text").mapInPandas(run, SCHEMA)


def symbols(parsed: DataFrame) -> DataFrame:
    """One row for each symbol, with an id that stays the same as long as its path and name do."""
    rows = parsed.select("rel_path", F.inline("symbols"))
    return rows.withColumn("id", F.xxhash64("rel_path", "qualified_name")).withColumn("content_hash", F.sha2(F.concat("signature", "body"), 256))


def sub_chunks(text: str) -> list[dict]:
    """Blocks of three lines or more and statements of more than two words of a Python text, with their lines."""
    out = []
    for node in ast.walk(ast.parse(text)):
        if not isinstance(node, ast.stmt):
            continue
        body = "\n".join(text.split("\n")[node.lineno - 1 : node.end_lineno])
        compound = hasattr(node, "body")
        if compound and node.end_lineno - node.lineno + 1 >= 3 and not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            out.append({"granularity": "block", "line_start": node.lineno, "line_end": node.end_lineno, "text": body, "tokens": len(body.split())})
        elif not compound and len(body.split()) > 2:
            out.append({"granularity": "statement", "line_start": node.lineno, "line_end": node.end_lineno, "text": body, "tokens": len(body.split())})
    return out


def def_use(text: str) -> list[tuple[str, int, int, str]]:
    """(variable, line of its definition, line of this, def or use): a use refers to the latest definition above it."""
    latest: dict[str, int] = {}
    out = []
    for node in sorted((n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Name)), key=lambda n: (n.lineno, isinstance(n.ctx, ast.Store), n.col_offset)):
        if isinstance(node.ctx, ast.Store):
            latest[node.id] = node.lineno
            out.append((node.id, node.lineno, node.lineno, "def"))
        elif node.id in latest and latest[node.id] != node.lineno:
            out.append((node.id, latest[node.id], node.lineno, "use"))
    return out
