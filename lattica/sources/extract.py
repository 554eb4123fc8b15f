"""Declarations and imports of source texts: text -> rows, with a registry of extractors by language.

Python goes by its own syntax tree; brace languages by statements (see scan), other languages by lines. Rows are in
pre-order with subtree_end, so that trees are intervals (see operators.trees).
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from . import scan

DECLS = "path string, language string, decl_ord int, parent_ord int, depth int, subtree_end int, kind string, name string, signature string, visibility string, line int, doc_comment string, is_test boolean, is_async boolean, is_deprecated boolean, body_lines int, cyclomatic int, nesting int, params int, relationships array<string>"
#: What a kind is called by callers, in lower case.
KINDS = {
    **{k.lower(): k for k in ("Function", "Method", "Struct", "Enum", "Trait", "Impl", "Constant", "Static", "TypeAlias", "Module", "Macro", "Field", "Variant", "Heading", "ConfigKey", "TableDef", "SchemaType", "ShellFunction", "Message", "Service", "RpcMethod", "Class", "Interface", "Element", "Selector")},
    "fn": "Function", "func": "Function", "def": "Function", "const": "Constant", "type": "TypeAlias", "mod": "Module", "namespace": "Module", "table": "TableDef", "key": "ConfigKey", "rpc": "RpcMethod", "var": "Static",
}


@dataclass
class Decl:
    kind: str
    name: str
    signature: str
    line: int
    visibility: str = "Private"
    doc: str | None = None
    test: bool = False
    asynchronous: bool = False
    deprecated: bool = False
    body: int | None = None
    metrics: tuple[int, int, int] | None = None
    rels: list[str] = field(default_factory=list)
    children: list[Decl] = field(default_factory=list)


Extractor = Callable[[str], tuple[list[str], list[Decl]]]
EXTRACTORS: dict[str, Extractor] = {}


def extractor(*languages: str):
    def add(f: Extractor) -> Extractor:
        EXTRACTORS.update(dict.fromkeys(languages, f))
        return f

    return add


# Python

_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def python_metrics(f: ast.FunctionDef) -> tuple[int, int, int]:
    """(cyclomatic, deepest nesting, parameters without self and cls); nested functions aren't entered."""
    cc, deepest = 1, 0

    def visit(node: ast.AST, depth: int, elif_of: bool = False) -> None:
        nonlocal cc, deepest
        if isinstance(node, (*_FUNCTION, ast.Lambda)):
            return
        cc += isinstance(node, _BRANCH)
        if isinstance(node, ast.BoolOp):
            cc += len(node.values) - 1
        if isinstance(node, _NEST) and not elif_of:
            depth += 1
            deepest = max(deepest, depth)
        for name, value in ast.iter_fields(node):
            for x in value if isinstance(value, list) else [value]:
                if isinstance(x, ast.AST):
                    visit(x, depth, isinstance(node, ast.If) and name == "orelse" and len(value) == 1 and isinstance(x, ast.If))

    for x in f.body:
        visit(x, 0)
    a = f.args
    names = [*a.posonlyargs, *a.args, *a.kwonlyargs, *([a.vararg] if a.vararg else []), *([a.kwarg] if a.kwarg else [])]
    return cc, deepest, sum(x.arg not in ("self", "cls") for x in names)


@extractor("Python")
def python(text: str) -> tuple[list[str], list[Decl]]:
    tree = ast.parse(text)
    imports: list[str] = []
    lines = text.split("\n")

    def visibility(name: str) -> str:
        return "Private" if name.startswith("_") else "Public"

    def remark(node: ast.AST, line: int) -> str | None:
        doc = ast.get_docstring(node)
        if doc:
            return doc
        out, i = [], line - 2
        while i >= 0 and lines[i].strip().startswith("#"):
            out.append(lines[i].strip().lstrip("#").strip())
            i -= 1
        return "\n".join(reversed(out)) or None

    def decl(node: ast.AST, inside: bool) -> list[Decl]:
        if isinstance(node, _FUNCTION):
            marks = [f"@{ast.unparse(d)}" for d in node.decorator_list]
            signature = " ".join([*marks, f"def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")])
            line = node.decorator_list[0].lineno if marks and not inside else node.lineno
            first = node.decorator_list[0].lineno if marks else node.lineno
            metrics = None if marks and not inside else python_metrics(node)
            return [Decl("Method" if inside else "Function", node.name, signature, line, visibility(node.name), remark(node, first), node.name.startswith("test_"), any("async" in m for m in marks), any("deprecated" in m for m in marks), (node.end_lineno or line) - line, metrics)]
        if isinstance(node, ast.ClassDef):
            bases, marks = [ast.unparse(b) for b in node.bases], [f"@{ast.unparse(d)}" for d in node.decorator_list]
            line = node.decorator_list[0].lineno if marks else node.lineno
            signature = " ".join([*marks, f"class {node.name}" + (f"({', '.join(bases)})" if bases else "")])
            d = Decl("Struct", node.name, signature, line, visibility(node.name), remark(node, line), node.name.startswith("Test"), deprecated=any("deprecated" in m for m in marks), body=(node.end_lineno or line) - line, rels=[f"extends {b}" for b in bases])
            d.children = [c for x in node.body if isinstance(x, _FUNCTION) for c in decl(x, True)]
            return [d]
        if isinstance(node, (ast.Assign, ast.AnnAssign)) and not inside:
            target = node.targets[0] if isinstance(node, ast.Assign) and len(node.targets) == 1 else getattr(node, "target", None)
            if isinstance(target, ast.Name):
                return [Decl("Constant", target.id, lines[node.lineno - 1].strip(), node.lineno, visibility(target.id))]
        return []

    out = []
    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            imports.append(ast.unparse(node))
        else:
            out += decl(node, False)
    return imports, out


# brace languages


class Braces:
    """One text of a brace language. Subclasses say what a statement declares and what is in its body."""

    language = ""
    newline = False
    style = "//"
    measured = False

    def __init__(self, text: str):
        self.text, self.code = text, scan.blanked(text, self.language)
        self.imports: list[str] = []
        self.feeds = [m.start() for m in re.finditer("\n", text)]

    def line(self, at: int) -> int:
        from bisect import bisect_left

        return bisect_left(self.feeds, at) + 1

    def items(self, start: int, end: int) -> Iterator[scan.Statement]:
        return scan.statements(self.code, start, end, self.newline)

    def raw(self, start: int, end: int) -> str:
        return " ".join(self.text[start:end].split())

    def decl(self, kind: str, name: str, s: scan.Statement, visibility: str, at: int | None = None, cut: str = "{") -> Decl:
        start = s.start if at is None else at
        d = Decl(kind, name, self.raw(start, s.stop()).rstrip("; "), self.line(start), visibility, scan.comment(self.text[s.gap[0] : start], self.style))
        d.deprecated = bool(d.doc and "deprecated" in d.doc.lower())
        d.body = self.line(s.end - 1) - d.line
        return d

    def function(self, d: Decl, s: scan.Statement, name_at: int) -> Decl:
        if self.measured and s.body:
            cc, nest = scan.metrics(self.code[slice(*s.body)], self.language)
            d.metrics = (cc, nest, scan.parameters(s.head, name_at, self.language))
        d.asynchronous = bool(re.search(r"\basync\b", s.head))
        return d

    def top(self) -> list[Decl]:
        return [d for s in self.items(0, len(self.code)) for d in self.declared(s, None)]

    def members(self, s: scan.Statement, inside: Decl) -> list[Decl]:
        return [d for x in self.items(*s.body) for d in self.declared(x, inside)] if s.body else []

    def pieces(self, s: scan.Statement, kind: str, pattern: str, visibility: Callable[[str], str] | str) -> list[Decl]:
        """Fields or variants of a body, separated by commas."""
        out = []
        for a, b in scan.split_top(self.code, *s.body) if s.body else []:
            head = self.code[a:b]
            lead = len(head) - len(head.lstrip())
            m = re.match(pattern, head[lead:])
            if m:
                at = a + lead + (m.start("decl") if "decl" in m.re.groupindex else 0)
                out.append(Decl(kind, m["name"], self.raw(at, b), self.line(at), visibility(m.group()) if callable(visibility) else visibility, scan.comment(self.text[a : a + lead] + self.text[a + lead : at], self.style)))
        return out

    def declared(self, s: scan.Statement, inside: Decl | None) -> list[Decl]:
        raise NotImplementedError


def braces(*languages: str):
    def add(cls):
        def run(text: str, cls=cls) -> tuple[list[str], list[Decl]]:
            b = cls(text)
            top = b.top()
            return b.imports, top

        for name in languages:
            own = type(cls.__name__, (cls,), {"language": name})
            EXTRACTORS[name] = lambda text, own=own, run=run: run(text, own)
        return cls

    return add


@braces("Rust")
class Rust(Braces):
    style, measured = "///", True
    _attr = re.compile(r"(?:#!?\[(?:[^\[\]]|\[[^\]]*\])*\]\s*)+")
    _vis = re.compile(r"pub(?:\s*\([^)]*\))?\s+")
    _head = re.compile(r"(?:default\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\"|\s+)?)\s+)*(fn|struct|enum|union|trait|impl|const|static|type|mod|use|macro_rules!)(?!\w)\s*(?:mut\s+)?(\w+)?")

    def declared(self, s, inside):
        m = self._attr.match(s.head)
        attrs = self.text[s.start : s.start + m.end()] if m else ""
        start = s.start + (m.end() if m else 0)
        code = self.code[start : s.stop()]
        v = self._vis.match(code)
        at = v.end() if v else 0
        m = self._head.match(code[at:])
        if not m:
            return []
        word, name = m[1], m[2] or ""
        visibility = "Private" if not v else "PublicCrate" if "(" in v.group() else "Public"
        if word == "use":
            if inside is None:
                self.imports.append(self.raw(start, s.end).rstrip(";") + ";")
            return []
        kind = {"fn": "Method" if inside else "Function", "struct": "Struct", "union": "Struct", "enum": "Enum", "trait": "Trait", "impl": "Impl", "const": "Constant", "static": "Static", "type": "TypeAlias", "mod": "Module", "macro_rules!": "Macro"}[word]
        d = self.decl(kind, name, s, visibility, start)
        d.test, d.deprecated = "test" in attrs, "deprecated" in attrs or d.deprecated
        if word == "fn":
            self.function(d, s, s.head.find("("))
            if inside and inside.kind == "Trait" and not v:
                d.visibility = inside.visibility
        elif word == "impl":
            rest = re.sub(r"^impl\s*(?:<[^{]*?>(?=\s*[A-Za-z!&(\[]))?\s*", "", code[at:]).split(" where ")[0].split("\nwhere")[0].strip()
            d.name = " ".join(rest.split())
            d.visibility = "Private"
            if " for " in d.name:
                d.rels.append("implements " + d.name.split(" for ")[0].strip())
            d.children = self.members(s, d)
        elif word == "trait":
            d.children = self.members(s, d)
        elif word in ("struct", "union"):
            d.children = self.pieces(s, "Field", r"(?:#\[[^\]]*\]\s*)*(?P<decl>(?:pub(?:\([^)]*\))?\s+)?(?P<name>\w+)\s*:)", lambda t: "PublicCrate" if "pub(" in t else "Public" if re.search(r"\bpub\b", t) else "Private")
        elif word == "enum":
            d.children = self.pieces(s, "Variant", r"(?:#\[[^\]]*\]\s*)*(?P<decl>(?P<name>\w+))", visibility)
        return [d]


@braces("TypeScript", "JavaScript")
class Script(Braces):
    style, measured, newline = "/**", True, True
    _head = re.compile(r"(?P<export>export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:(?P<word>async\s+function\*?|function\*?|class|interface|enum|const\s+enum|type|const|let|var|namespace|module|import|export)\b)\s*(?P<name>[\w$]+)?")
    _member = re.compile(r"(?:@\w+(?:\([^)]*\))?\s*)*(?P<mods>(?:(?:public|private|protected|static|readonly|abstract|async|override|get|set|declare)\s+)*)(?P<name>#?[\w$]+)\??!?\s*(?P<next>[(<:=;?]|$)")

    def declared(self, s, inside):
        if inside is not None:
            return self.member(s, inside)
        m = self._head.match(s.head)
        if not m:
            return []
        word, name = " ".join(m["word"].split()), m["name"] or ""
        if word == "import" or word == "export" and re.search(r"\bfrom\b", s.head):
            self.imports.append(self.raw(s.start, s.end).rstrip(";"))
            return []
        visibility = "Public" if m["export"] else "Private"
        typed = self.language == "TypeScript"
        if word.split()[-1].startswith("function"):
            d = self.function(self.decl("Function", name, s, visibility), s, m.end())
        elif word == "class":
            d = self.decl("Struct", name, s, visibility)
            self.heritage(d, s.head)
            d.children = self.members(s, d)
        elif word == "interface" and typed:
            d = self.decl("Trait", name, s, visibility)
            self.heritage(d, s.head)
            d.children = self.members(s, d)
        elif word in ("enum", "const enum") and typed:
            d = self.decl("Enum", name, s, visibility)
            d.children = self.pieces(s, "Variant", r"(?P<name>[\w$]+)", visibility)
        elif word in ("namespace", "module") and s.body:
            d = self.decl("Module", name, s, visibility)
        elif word == "type" and typed:
            d = self.decl("TypeAlias", name, s, visibility)
        elif word == "const" or word == "var" and not typed:
            d = self.decl("Constant", name, s, visibility)
            d.signature = d.signature.split("{")[0].strip() or d.signature
            d.asynchronous = " async " in d.signature
        else:
            return []
        d.test = name in ("describe", "it", "test") or bool(re.match(r"test[A-Z_]", name))
        return [d]

    def heritage(self, d: Decl, head: str) -> None:
        for word in ("extends", "implements"):
            if m := re.search(rf"\b{word}\s+([^{{]*?)(?=\bimplements\b|$)", head, re.S):
                d.rels += [f"{word} {' '.join(m.string[a:b].split())}" for a, b in scan.split_top(head, m.start(1), m.end(1))]

    def member(self, s, inside):
        m = self._member.match(s.head)
        if not m or m["name"] in ("if", "for", "while", "switch", "return"):
            return []
        mods = m["mods"].split()
        visibility = "Public" if self.language == "JavaScript" else "Private" if "private" in mods or m["name"].startswith("#") else "PublicCrate" if "protected" in mods else "Public"
        method = m["next"] in ("(", "<") or bool(s.body)
        d = self.decl("Method" if method else "Field", m["name"].lstrip("#"), s, visibility)
        return [self.function(d, s, m.start("next")) if method else d]


@braces("Go")
class Go(Braces):
    newline, measured = True, True

    def declared(self, s, inside):
        h = s.head
        if h.startswith("import"):
            self.imports += [f'import "{x}"' for x in re.findall(r'"([^"]+)"', self.text[s.start : s.end])]
        if h.startswith("package") or h.startswith("import"):
            return []
        vis = lambda n: "Public" if n[:1].isupper() else "Private"
        if m := re.match(r"func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)\s*(?:\[[^\]]*\])?\s*", h):
            name = f"{m[1]}.{m[2]}" if m[1] else m[2]
            d = self.function(self.decl("Method" if m[1] else "Function", name, s, vis(m[2])), s, m.end())
            d.test = m[2].startswith("Test")
            d.deprecated = bool(d.doc and "Deprecated:" in d.doc)
            return [d]
        if m := re.match(r"(type|const|var)\s*\(", h):
            open_ = s.start + m.end() - 1
            inner = list(scan.statements(self.code, open_ + 1, s.stop() if h.rstrip().endswith(")") else s.end, True))
            group = scan.comment(self.text[s.gap[0] : s.start], "//")
            out = []
            for x in inner:
                x.head = f"{m[1]} {x.head}".rstrip(") ")
                for d in self.spec(m[1], x, vis):
                    d.doc = d.doc or group
                    d.deprecated = bool(d.doc and "Deprecated:" in d.doc)
                    out.append(d)
            return out
        if m := re.match(r"(type|const|var)\s", h):
            return self.spec(m[1], s, vis)
        return []

    def spec(self, word, s, vis):
        m = re.match(rf"{word}\s+(\w+)\s*(?:\[[^\]]*\]\s*)?(=?\s*(?:struct|interface)\b)?", s.head)
        if not m or m[1] == "_":
            return []
        what = (m[2] or "").strip("= ")
        kind = {"const": "Constant", "var": "Static"}.get(word) or {"struct": "Struct", "interface": "Trait"}.get(what, "TypeAlias")
        d = self.decl(kind, m[1], s, vis(m[1]))
        if not d.signature.startswith(word):
            d.signature = f"{word} {d.signature}"
        if kind == "Struct" and s.body:
            for x in scan.statements(self.code, *s.body, True):
                if f := re.match(r"(\w+)(?:\s*,\s*\w+)*\s+\S", x.head):
                    d.children.append(self.decl("Field", f[1], x, vis(f[1])))
        if kind == "Trait" and s.body:
            for x in scan.statements(self.code, *s.body, True):
                if f := re.match(r"(\w+)\s*\(", x.head):
                    d.children.append(self.decl("Method", f[1], x, vis(f[1])))
        return [d]


@braces("Java")
class Java(Braces):
    style, measured = "/**", True
    _mods = r"(?:(?:@\w+(?:\.\w+)*(?:\((?:[^()]|\([^()]*\))*\))?|public|private|protected|static|final|abstract|synchronized|native|default|strictfp|transient|volatile|sealed|non-sealed)\s+)*"
    _type = re.compile(rf"(?P<mods>{_mods})(?P<word>class|interface|enum|record|@interface)\s+(?P<name>\w+)")
    _method = re.compile(rf"(?P<mods>{_mods})(?:<[^>]*(?:<[^>]*>)?[^>]*>\s*)?(?:(?P<type>[\w.]+(?:<.*?>)?(?:\[\])*)\s+)?(?P<name>\w+)\s*\(", re.S)
    _field = re.compile(rf"(?P<mods>{_mods})(?P<type>[\w.]+(?:<.*>)?(?:\[\])*)\s+(?P<name>\w+)\s*(?:=|,|$|\[)", re.S)

    def visibility(self, mods: str) -> str:
        return "Public" if re.search(r"\bpublic\b", mods) else "Private"

    def declared(self, s, inside):
        if inside is None and (m := re.match(r"import\s+(?:static\s+)?[\w.*]+", s.head)):
            self.imports.append(self.raw(s.start, s.end))
            return []
        if m := self._type.match(s.head):
            kind = {"class": "Struct", "record": "Struct", "interface": "Trait", "@interface": "Trait", "enum": "Enum"}[m["word"]]
            d = self.decl(kind, m["name"], s, self.visibility(m["mods"]))
            for word in ("extends", "implements"):
                if r := re.search(rf"\b{word}\s+(.*?)(?=\bimplements\b|\bpermits\b|$)", s.head[m.end() :], re.S):
                    x = r[1]
                    d.rels += [f"{word} {' '.join(x[a:b].split())}" for a, b in scan.split_top(x, 0, len(x))]
            if kind == "Enum" and s.body:
                end = self.code.find(";", *s.body)
                end = end if end >= 0 else s.body[1]
                part = scan.Statement(s.head, s.start, end, (s.body[0], end), s.gap)
                d.children = self.pieces(part, "Variant", r"(?:@\w+\s+)*(?P<name>\w+)", "Public")
                if end < s.body[1]:
                    d.children += [c for x in self.items(end + 1, s.body[1]) for c in self.declared(x, d)]
            else:
                d.children = self.members(s, d)
            self.mark(d, m["mods"])
            return [d]
        if inside is None:
            return []
        if (m := self._method.match(s.head)) and m["name"] not in ("if", "for", "while", "switch", "return", "new", "catch", "synchronized") and (m["type"] or m["name"] == inside.name) and "=" not in s.head[: m.end()]:
            d = self.function(self.decl("Method", m["name"], s, self.visibility(m["mods"])), s, m.end() - 1)
            self.mark(d, m["mods"])
            return [d]
        if (m := self._field.match(s.head)) and m["type"] not in ("return", "throw", "new", "package", "else"):
            d = self.decl("Field", m["name"], s, self.visibility(m["mods"]))
            d.signature = d.signature.split("=")[0].strip()
            self.mark(d, m["mods"])
            return [d]
        return []

    def mark(self, d: Decl, mods: str) -> None:
        d.test = bool(re.search(r"@(?:\w+\.)*(?:Test|ParameterizedTest)\b", mods))
        d.deprecated = d.deprecated or "@Deprecated" in mods


@braces("C", "C++")
class C(Braces):
    measured = True
    _function = re.compile(r"(?P<ret>(?:[\w:<>,~*&\[\]\s]|\([^()]*\)(?=\s*\())*?[\s*&])?(?P<name>(?:\w+::)*~?\w+|operator\s*[^\s(]+)\s*\((?P<rest>.*)$", re.S)
    _words = {"if", "for", "while", "switch", "return", "else", "do", "sizeof", "defined", "catch", "case"}

    def __init__(self, text: str):
        super().__init__(text)
        self.macros: list[tuple[int, Decl]] = []
        kept = []
        # directives are no statements; what stands between #if and #endif isn't entered
        depth = 0
        at = 0
        for line in self.code.split("\n"):
            raw = text[at : at + len(line)]
            if m := re.match(r"\s*#\s*(\w+)(.*)", line):
                if m[1] in ("if", "ifdef", "ifndef"):
                    depth += 1
                elif m[1] == "endif":
                    depth = max(0, depth - 1)
                elif not depth and m[1] == "include":
                    self.imports.append(raw.strip())
                elif not depth and m[1] == "define" and (x := re.match(r"\s*(\w+)", m[2])):
                    self.macros.append((at, Decl("Macro", x[1], " ".join(raw.split()), self.line(at), "Public", scan.comment(text[:at][-2000:], "//") if at else None)))
                kept.append(" " * len(line))
            else:
                kept.append(" " * len(line) if depth else line)
            at += len(line) + 1
        self.code = "\n".join(kept)

    def top(self):
        found = [(self.offset(d), d) for d in super().top()] + self.macros
        return [d for _, d in sorted(found, key=lambda x: x[1].line)]

    def offset(self, d: Decl) -> int:
        return d.line

    def section(self, inside: Decl | None) -> str:
        return getattr(inside, "section", "Public") if inside else "Public"

    def members(self, s, inside):
        inside.section = "Public" if re.search(r"\bstruct\b|\bunion\b", s.head) else "Private"
        return super().members(s, inside)

    def declared(self, s, inside):
        head, start = s.head, s.start
        while m := re.match(r"(public|private|protected)\s*(?:\w+\s*)?:(?!:)\s*", head):
            inside and setattr(inside, "section", {"public": "Public", "private": "Private", "protected": "PublicCrate"}[m[1]])
            head, start = head[m.end() :], start + m.end()
        attr = re.match(r"(?:\[\[.*?\]\]\s*)+", head)
        deprecated = bool(attr and "deprecated" in attr.group())
        template = re.match(r"template\s*<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>\s*", head)
        body = head[template.end() :] if template else head
        if not head:
            return []
        visibility = self.section(inside) if inside and inside.kind == "Struct" else "Private" if re.match(r"(?:inline\s+)?static\b", body) else "Public"
        out = self.typed(s, body, start, visibility, inside)
        for d in out:
            d.deprecated = d.deprecated or deprecated
            d.test = d.kind in ("Function", "Method") and d.name.split("::")[-1].startswith("test_")
        return out

    def typed(self, s, head, start, visibility, inside):
        cpp = self.language == "C++"
        if re.match(r"extern\s*$", head) and s.body:
            return []
        if cpp and (m := re.match(r"(?:inline\s+)?namespace\s*([\w:]*)", head)):
            if not s.body:
                return []
            d = self.decl("Module", m[1], s, "Public", start)
            d.children = [c for x in self.items(*s.body) for c in self.declared(x, d)]
            return [d] if m[1] else d.children
        if cpp and re.match(r"using\b", head):
            if m := re.match(r"using\s+(\w+)\s*=", head):
                return [self.decl("TypeAlias", m[1], s, visibility, start)]
            return []
        if re.match(r"friend\b|static_assert\b|return\b|goto\b", head):
            return []
        if m := re.match(r"typedef\b", head):
            tail = re.search(r"(\w+)\s*$", self.code[s.start : s.end].rstrip("; \n") if not s.body else self.code[s.end : self.code.find(";", s.end) if self.code.find(";", s.end) >= 0 else s.end])
            fp = re.search(r"\(\s*\*\s*(\w+)\s*\)", head)
            name = fp[1] if fp else tail[1] if tail else ""
            return [self.decl("TypeAlias", name, s, "Public", start)] if name else []
        if s.body and (m := re.match(r"(struct|class|union|enum(?:\s+(?:class|struct))?)\s*(?:\[\[.*?\]\]\s*)?(?:alignas\([^)]*\)\s*)?(\w*)\s*(?:final\s*)?(:[^:].*)?$", head, re.S)):
            if m[1].startswith("enum"):
                d = self.decl("Enum", m[2], s, visibility, start)
                d.children = self.pieces(s, "Variant", r"(?P<name>\w+)", "Public")
                return [d] if m[2] else []
            d = self.decl("Struct", m[2], s, visibility, start)
            for a, b in scan.split_top(m[3] or "", 1, len(m[3] or "")) if m[3] else []:
                d.rels.append("extends " + re.sub(r"\b(?:public|private|protected|virtual)\b\s*", "", m[3][a:b]).strip())
            d.children = self.members(s, d)
            return [d] if m[2] else []
        if re.match(r"(?:struct|class|union|enum)\s+\w+$", head):
            return []
        m = self._function.match(head)
        if m and m["name"].split("::")[-1] not in self._words and not re.search(r"(?<![=!<>])=(?!=)", head[: m.end("name")]):
            own = inside and inside.kind == "Struct"
            if m["ret"] or own or s.body or "::" in m["name"]:
                if not m["ret"] and not s.body and not own:
                    return []
                if m["ret"] and m["ret"].split()[-1:] in (["return"], ["else"], ["new"]):
                    return []
                d = self.decl("Method" if own else "Function", m["name"], s, visibility, start)
                return [self.function(d, s, s.head.find("(", len(s.head) - len(head) + m.start("name")))]
        if m := re.match(r"(?:[\w:<>,*&\s]+?[\s*&])(\w+)\s*(?:\[[^\]]*\]\s*)*(?:=|,|$|:\s*\d|\{)", head, re.S):
            if head.split()[0] in ("return", "else", "goto", "case", "throw", "delete", "break", "continue"):
                return []
            kind = "Field" if inside and inside.kind == "Struct" else "Static"
            d = self.decl(kind, m[1], s, visibility, start)
            return [d]
        return []


@braces("Protobuf")
class Protobuf(Braces):
    def declared(self, s, inside):
        if m := re.match(r"(?:import|package)\b", s.head):
            self.imports.append(self.raw(s.start, s.end).rstrip(";"))
            return []
        if m := re.match(r"syntax\s*=", s.head):
            return [self.decl("ConfigKey", "syntax", s, "Public")]
        if m := re.match(r"(message|service|enum|oneof|extend)\s+([\w.]+)", s.head):
            kind = {"message": "Message", "service": "Service", "enum": "Enum", "oneof": "Field", "extend": "Message"}[m[1]]
            d = self.decl(kind, m[2], s, "Public")
            d.children = self.members(s, d)
            return [d]
        if m := re.match(r"rpc\s+(\w+)", s.head):
            return [self.decl("RpcMethod", m[1], s, "Public")]
        if inside is None or re.match(r"(?:option|reserved|extensions)\b", s.head):
            return []
        if inside.kind == "Enum" and (m := re.match(r"(\w+)\s*=", s.head)):
            return [self.decl("Variant", m[1], s, "Public")]
        if m := re.match(r"(?:(?:repeated|optional|required)\s+)?(?:map\s*<[^>]*>|[\w.]+)\s+(\w+)\s*=", s.head):
            return [self.decl("Field", m[1], s, "Public")]
        return []


@braces("GraphQL")
class GraphQL(Braces):
    newline, style = True, "#"

    def declared(self, s, inside):
        if inside is not None:
            m = re.match(r"(\w+)\s*(?:\(|:|@|$)", s.head)
            return [self.decl("Variant" if inside.kind == "Enum" else "Field", m[1], s, "Public")] if m else []
        m = re.match(r"(extend\s+)?(type|input|interface|enum|schema|scalar|union|directive|query|mutation|subscription|fragment)\b\s*@?(\w*)", s.head)
        if not m:
            return []
        kind = {"interface": "Trait", "enum": "Enum", "scalar": "TypeAlias", "union": "TypeAlias", "query": "Function", "mutation": "Function", "subscription": "Function", "fragment": "Function", "directive": "Macro"}.get(m[2], "SchemaType")
        d = self.decl(kind, m[3] or m[2], s, "Public")
        if r := re.search(r"\bimplements\s+(.+)$", s.head, re.S):
            d.rels = [f"implements {x}" for x in re.findall(r"\w+", r[1])]
        if m[2] in ("type", "input", "interface", "enum", "schema"):
            d.children = self.members(s, d)
        return [d]


class Modern(Braces):
    """Kotlin, Swift and C#: modifiers, a word, a name."""

    newline = True
    mods = r""
    words: dict[str, str] = {}
    callable = r"fun"

    def visibility(self, mods: str, inside: Decl | None) -> str:
        return "Private" if re.search(r"\bprivate\b|\bfileprivate\b", mods) else "PublicCrate" if re.search(r"\binternal\b|\bprotected\b", mods) else "Public"

    def heritage(self, d: Decl, head: str) -> None:
        depth_free = re.sub(r"<[^<>]*>", "", re.sub(r"\([^()]*\)", "", head))
        if m := re.search(r"(?<!:):(?!:)\s*([^{]+?)(?:\bwhere\b|$)", depth_free, re.S):
            d.rels = [f"extends {x.strip()}" for x in m[1].split(",") if x.strip()]


@braces("Kotlin")
class Kotlin(Modern):
    _mods = r"(?P<mods>(?:(?:@\w+(?:\([^)]*\))?|public|private|internal|protected|override|suspend|inline|data|sealed|abstract|open|final|const|lateinit|companion|operator|infix|tailrec|external|annotation|inner|value|enum|fun(?=\s+interface))\s+)*)"
    _rx = re.compile(_mods + r"(?P<word>class|interface|object|fun|val|var|typealias|import|package)\b\s*(?:<[^>]*>\s*)?(?P<name>(?:[\w<>?]+\.)*\w+)?")

    def declared(self, s, inside):
        m = self._rx.match(s.head)
        if not m:
            return []
        name = (m["name"] or "").split(".")[-1]
        if m["word"] in ("import", "package"):
            m["word"] == "import" and self.imports.append(self.raw(s.start, s.end))
            return []
        v = self.visibility(m["mods"], inside)
        kind = {"class": "Enum" if re.search(r"\benum\b", m["mods"]) else "Struct", "interface": "Trait", "object": "Struct", "fun": "Method" if inside else "Function", "val": "Field" if inside else "Constant", "var": "Field" if inside else "Static", "typealias": "TypeAlias"}[m["word"]]
        d = self.decl(kind, name or "Companion", s, v)
        d.test, d.deprecated, d.asynchronous = "@Test" in m["mods"], "@Deprecated" in m["mods"], "suspend" in m["mods"]
        if m["word"] in ("class", "interface", "object"):
            self.heritage(d, s.head[m.end() :])
            if kind == "Enum" and s.body:
                end = self.code.find(";", *s.body)
                part = scan.Statement(s.head, s.start, s.end, (s.body[0], end if end >= 0 else s.body[1]), s.gap)
                d.children = self.pieces(part, "Variant", r"(?P<name>[A-Z]\w*)", "Public")
            else:
                d.children = self.members(s, d)
        return [d]


@braces("Swift")
class Swift(Modern):
    style = "///"
    _rx = re.compile(r"(?P<mods>(?:(?:@\w+(?:\([^)]*\))?|public|private|fileprivate|internal|open|static|class(?=\s+(?:func|var))|final|override|mutating|required|convenience|lazy|weak|unowned|indirect|async)\s+(?:\(set\)\s*)?)*)(?P<word>class|struct|protocol|enum|extension|actor|func|init|deinit|let|var|typealias|import|case|subscript)\b\s*(?P<name>[\w.]+)?")

    def declared(self, s, inside):
        m = self._rx.match(s.head)
        if not m:
            return []
        word, name, mods = m["word"], m["name"] or m["word"], m["mods"]
        if word == "import":
            self.imports.append(self.raw(s.start, s.end))
            return []
        if word == "case":
            return [self.decl("Variant", x, s, "Public") for x in re.findall(r"(?:case|,)\s*(\w+)", re.sub(r"\([^)]*\)", "", s.head))] if inside and inside.kind == "Enum" else []
        v = "Public" if re.search(r"\b(?:public|open)\b", mods) else "Private" if re.search(r"\b(?:file)?private\b", mods) else "PublicCrate"
        kind = {"class": "Struct", "struct": "Struct", "actor": "Struct", "protocol": "Trait", "enum": "Enum", "extension": "Impl", "func": "Method" if inside else "Function", "init": "Method", "deinit": "Method", "subscript": "Method", "let": "Field" if inside else "Constant", "var": "Field" if inside else "Static", "typealias": "TypeAlias"}[word]
        d = self.decl(kind, name, s, v)
        d.test, d.deprecated, d.asynchronous = kind == "Method" and name.startswith("test"), "deprecated" in mods, bool(re.search(r"\)\s*async\b", s.head))
        if word in ("class", "struct", "actor", "protocol", "enum", "extension"):
            self.heritage(d, s.head[m.end() :])
            d.children = self.members(s, d)
        return [d]


@braces("C#")
class CSharp(Modern):
    newline, style = False, "///"
    _mods = r"(?P<mods>(?:(?:\[[^\]]*\]|public|private|protected|internal|static|sealed|abstract|partial|virtual|override|async|readonly|const|extern|unsafe|new|ref|required|file)\s*(?=\W|\b)\s*)*)"
    _type = re.compile(_mods + r"(?P<word>namespace|class|struct|interface|enum|record(?:\s+(?:class|struct))?|delegate)\s+(?P<name>[\w.]+)")
    _method = re.compile(_mods + r"(?:(?P<type>[\w.]+(?:<.*?>)?(?:\[,*\])*\??)\s+)?(?P<name>~?\w+)\s*(?:<[^>(]*>)?\s*\(", re.S)
    _field = re.compile(_mods + r"(?P<type>[\w.]+(?:<.*>)?(?:\[,*\])*\??)\s+(?P<name>\w+)\s*(?:=|$|\{)", re.S)

    def visibility(self, mods, inside):
        return "Public" if re.search(r"\bpublic\b", mods) else "PublicCrate" if re.search(r"\b(?:internal|protected)\b", mods) else "Public" if inside and inside.kind == "Trait" else "Private"

    def declared(self, s, inside):
        if re.match(r"(?:global\s+)?using\s+[^(]", s.head) and not s.body:
            self.imports.append(self.raw(s.start, s.end))
            return []
        if m := self._type.match(s.head):
            word = m["word"].split()[0]
            kind = {"namespace": "Module", "interface": "Trait", "enum": "Enum", "delegate": "TypeAlias"}.get(word, "Struct")
            d = self.decl(kind, m["name"], s, "Public" if word == "namespace" else self.visibility(m["mods"], None))
            d.deprecated = "Obsolete" in m["mods"]
            if kind == "Enum":
                d.children = self.pieces(s, "Variant", r"(?:\[[^\]]*\]\s*)*(?P<name>\w+)", "Public")
            else:
                if kind != "Module":
                    self.heritage(d, s.head[m.end() :])
                d.children = self.members(s, d)
            return [d]
        if inside is None or inside.kind == "Module":
            return []
        if (m := self._method.match(s.head)) and m["name"] not in ("if", "for", "foreach", "while", "switch", "return", "lock", "using", "catch", "new") and (m["type"] or m["name"].lstrip("~") == inside.name) and "=" not in s.head[: m.end()].replace("=>", ""):
            d = self.function(self.decl("Method", m["name"], s, self.visibility(m["mods"], inside)), s, m.end() - 1)
            d.test, d.deprecated = bool(re.search(r"\[(?:Test|Fact|Theory|TestMethod)\b", m["mods"])), "Obsolete" in m["mods"]
            return [d]
        if (m := self._field.match(s.head)) and m["type"] not in ("return", "throw", "new", "else", "using", "namespace"):
            d = self.decl("Field", m["name"], s, self.visibility(m["mods"], inside))
            d.signature = d.signature.split("=")[0].strip()
            return [d]
        return []


@extractor("Objective-C")
def objective_c(text: str) -> tuple[list[str], list[Decl]]:
    """@implementation of a class adds to its @interface."""
    code, lines = scan.blanked(text), text.split("\n")
    imports, top, by, now = [], [], {}, None
    for i, line in enumerate(code.split("\n")):
        raw = " ".join(lines[i].split())
        if re.match(r"\s*(?:#\s*(?:import|include)|@import)\b", line):
            imports.append(raw.rstrip(";"))
        elif m := re.match(r"\s*@(interface|implementation|protocol)\s+(\w+)\s*(?:\((\w*)\))?\s*(?::\s*(\w+))?\s*(?:<([^>]*)>)?\s*(;?)", line):
            if m[6]:
                continue
            key = (m[1] == "protocol", m[2])
            now = by.get(key)
            if now is None:
                now = by[key] = Decl("Trait" if m[1] == "protocol" else "Struct", m[2], raw, i + 1, "Public")
                now.rels = ([f"extends {m[4]}"] if m[4] else []) + [f"implements {x.strip()}" for x in (m[5] or "").split(",") if x.strip()]
                top.append(now)
        elif re.match(r"\s*@end\b", line):
            now = None
        elif now is not None and (m := re.match(r"\s*@property\s*(?:\([^)]*\))?\s*[^;]*?(\w+)\s*;", line)):
            now.children.append(Decl("Field", m[1], raw.rstrip(";"), i + 1, "Public"))
        elif now is not None and (m := re.match(r"\s*[-+]\s*\([^)]*\)\s*(\w+(?::)?)(.*)", line)):
            name = m[1] + "".join(re.findall(r"\s(\w+:)", m[2]))
            if not any(c.name == name for c in now.children):
                now.children.append(Decl("Method", name, raw.rstrip("{; "), i + 1, "Public", test=name.startswith("test")))
    return imports, top


# languages by lines


def _value(text: str, most: int = 80) -> str:
    """A line's text, cut where it is too long."""
    return text if len(text.encode()) <= most else text[:most] + "..."


@extractor("Markdown")
def markdown(text: str) -> tuple[list[str], list[Decl]]:
    top, stack = [], []
    for i, line in enumerate(text.split("\n")):
        if m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line):
            d, level = Decl("Heading", m[2], line.strip(), i + 1, "Public"), len(m[1])
            while stack and stack[-1][0] >= level:
                stack.pop()
            (stack[-1][1].children if stack else top).append(d)
            stack.append((level, d))
    return [], top


@extractor("TOML")
def toml(text: str) -> tuple[list[str], list[Decl]]:
    """Tables and their keys; the keys of a manifest's dependency tables are imports."""
    top, table, imports, open_ = [], None, [], 0
    for i, line in enumerate(text.split("\n")):
        s = re.sub(r"\"(?:\\.|[^\"\\])*\"|'[^']*'", lambda m: m.group().replace("#", " "), line).split("#")[0].strip()
        if open_ > 0:
            open_ += s.count("[") + s.count("{") - s.count("]") - s.count("}")
        elif m := re.match(r"\[\[?\s*([^\]]+?)\s*\]\]?$", s):
            table = Decl("ConfigKey", m[1], s, i + 1, "Public")
            top.append(table)
            if re.search(r"(?:^|\.)(?:dev-|build-)?dependencies\.", m[1]):
                imports.append(m[1].rsplit(".", 1)[1].strip('"'))
        elif m := re.match(r"([\w.\-]+|\"[^\"]+\")\s*=\s*(.*)", s):
            (table.children if table else top).append(Decl("ConfigKey", m[1].strip('"'), _value(line.strip()), i + 1, "Public"))
            if table and re.search(r"(?:^|\.)(?:dev-|build-)?dependencies$", table.name):
                imports.append(m[1].strip('"').split(".")[0])
            open_ = m[2].count("[") + m[2].count("{") - m[2].count("]") - m[2].count("}")
    return imports, top


@extractor("Properties")
def properties(text: str) -> tuple[list[str], list[Decl]]:
    """Keys below their first part."""
    top, by = [], {}
    for i, line in enumerate(text.split("\n")):
        s = line.strip()
        if not s or s[0] in "#!" or not (m := re.match(r"((?:\\.|[^\s=:\\])+)\s*[=:\s]\s*(.*)", s)):
            continue
        d = Decl("ConfigKey", m[1], _value(s), i + 1, "Public")
        head, dot, _ = m[1].partition(".")
        if not dot:
            top.append(d)
        else:
            if head not in by:
                by[head] = Decl("ConfigKey", head, head, i + 1, "Public")
                top.append(by[head])
            by[head].children.append(d)
    return [], top


@extractor("YAML")
def yaml_keys(text: str) -> tuple[list[str], list[Decl]]:
    """Top-level keys; below `services`, a compose file's services."""
    top, inside, indent = [], None, None
    for i, line in enumerate(text.split("\n")):
        if m := re.match(r"([\w.\-/\"']+)\s*:(?:\s|$)", line):
            d = Decl("ConfigKey", m[1].strip("\"'"), _value(line.strip()), i + 1, "Public")
            top.append(d)
            inside, indent = (d, None) if d.name == "services" else (None, None)
        elif inside is not None and (m := re.match(r"(\s+)([\w.\-]+)\s*:\s*(?:#.*)?$", line)):
            indent = indent or len(m[1])
            if len(m[1]) == indent:
                inside.children.append(Decl("ConfigKey", m[2], line.strip(), i + 1, "Public"))
    return [], top


@extractor("JSON")
def json_keys(text: str) -> tuple[list[str], list[Decl]]:
    """Keys of the first two levels, of text with a key a line; a manifest's dependencies are imports."""
    top, depth, imports = [], 0, []
    for i, line in enumerate(text.split("\n")):
        bare = re.sub(r'"(?:\\.|[^"\\])*"', '""', line)
        if m := re.match(r'\s*"((?:\\.|[^"\\])+)"\s*:\s*(.*)', line):
            d = Decl("ConfigKey", m[1], _value(line.strip().rstrip(",")), i + 1, "Public")
            if depth == 1:
                top.append(d)
            elif depth == 2 and top:
                top[-1].children.append(d)
                if re.fullmatch(r"(?:dev|peer|optional)?[dD]ependencies", top[-1].name):
                    imports.append(m[1])
        depth += sum(bare.count(c) for c in "{[") - sum(bare.count(c) for c in "}]")
    return imports, top


@extractor("SQL")
def sql(text: str) -> tuple[list[str], list[Decl]]:
    rx = re.compile(r"^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:unique\s+)?(?:materialized\s+)?(table|view|index|function|procedure|type)\s+(?:concurrently\s+)?(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)", re.I)
    kinds = {"table": "TableDef", "view": "TableDef", "index": "ConfigKey", "function": "Function", "procedure": "Function", "type": "SchemaType"}
    top, table, depth = [], None, 0
    for i, line in enumerate(text.split("\n")):
        code = re.sub(r"'(?:''|[^'])*'|--.*", " ", line)
        if m := rx.match(code):
            d = Decl(kinds[m[1].lower()], m[2].strip('"`[]'), line.strip().rstrip("( "), i + 1, "Public")
            top.append(d)
            table, depth = (d, 0) if m[1].lower() == "table" else (None, 0)
            code = code[m.end() :]
        elif table is not None and depth == 1 and (m := re.match(r"\s*[\"`\[]?(\w+)[\"`\]]?\s+\w+", code)) and m[1].lower() not in ("primary", "foreign", "constraint", "unique", "check", "key", "index", "exclude"):
            table.children.append(Decl("Field", m[1], line.strip().rstrip(","), i + 1, "Public"))
        if table is not None:
            depth += code.count("(") - code.count(")")
            if ";" in code:
                table = None
    return [], top


_NO_FUNCTION = {"if", "then", "else", "elif", "fi", "for", "while", "until", "do", "done", "case", "esac", "select", "function", "in", "return", "exit", "echo"}


@extractor("Shell")
def shell(text: str) -> tuple[list[str], list[Decl]]:
    imports, top, doc = [], [], []
    for i, line in enumerate(text.split("\n")):
        s = line.strip()
        if s.startswith("#") and not s.startswith("#!"):
            doc.append(s.lstrip("# "))
            continue
        d = None
        if m := re.match(r"(?:source|\.)\s+(\S+)", s):
            imports.append(m[1].strip("\"'"))
        elif (m := re.match(r"(?:function\s+([\w:.-]+)\s*(?:\(\s*\))?|([\w:.-]+)\s*\(\s*\))\s*\{?", s)) and (m[1] or m[2]) not in _NO_FUNCTION:
            d = Decl("ShellFunction", m[1] or m[2], s.rstrip("{ "), i + 1, "Public")
        elif m := re.match(r"(?:export\s+(?:-\w+\s+)?|alias\s+)([\w-]+)=", s):
            d = Decl("Constant", m[1], _value(s), i + 1, "Public")
        if d:
            d.doc = "\n".join(doc) or None
            top.append(d)
        doc = []
    return imports, top


@extractor("Ruby")
def ruby(text: str) -> tuple[list[str], list[Decl]]:
    """Blocks by their `end`s: containers hold what is declared until they end."""
    imports, top, stack, doc = [], [], [], []
    opens = re.compile(r"^(?:class|module|def|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$|=\s*(?:if|case|begin)\b")
    access = {0: "Public"}
    for i, line in enumerate(text.split("\n")):
        s = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", '""', line).strip()
        if s.startswith("#"):
            doc.append(s.lstrip("# "))
            continue
        s = s.split(" #")[0].strip()
        holder = next((d for d, _ in reversed(stack) if d is not None), None)
        d, level = None, len(stack)
        if re.match(r"(?:require|require_relative|load|gem|include|extend|prepend)\b", s) and not s.endswith(" do"):
            imports.append(" ".join(line.split()))
        elif m := re.match(r"(class|module)\s+([A-Z][\w:]*)\s*(?:<\s*([\w:]+))?", s):
            d = Decl("Struct" if m[1] == "class" else "Module", m[2], line.strip(), i + 1, "Public", rels=[f"extends {m[3]}"] if m[3] else [])
            access[level + 1] = "Public"
        elif m := re.match(r"(?:(?:private|public|protected)\s+)?def\s+((?:self\.)?[\w]+[?!=]?|[^\s(]+)", s):
            own = s.split()[0]
            v = {"private": "Private", "protected": "PublicCrate", "public": "Public"}.get(own) or access.get(level, "Public")
            d = Decl("Method" if holder else "Function", m[1], line.strip(), i + 1, v, test=m[1].startswith("test_"))
        elif m := re.match(r"([A-Z][A-Z0-9_]*)\s*=[^=~]", s + " "):
            d = Decl("Constant", m[1], _value(line.strip()), i + 1, "Public")
        elif m := re.match(r"attr_(?:reader|writer|accessor)\s+(.+)", s):
            for x in re.findall(r":(\w+)", m[1]):
                (holder.children if holder else top).append(Decl("Field", x, line.strip(), i + 1, access.get(level, "Public")))
        elif s in ("private", "protected", "public"):
            access[level] = {"private": "Private", "protected": "PublicCrate", "public": "Public"}[s]
        if d:
            d.doc = "\n".join(doc) or None
            (holder.children if holder else top).append(d)
        if s:
            doc = []
        if (opens.search(s) or re.match(r"(?:private|public|protected)\s+def\b", s)) and not re.search(r"\bend$", s) and not re.match(r"def\s+[^=]*\)?\s=\s", s):
            stack.append((d if d and d.kind in ("Struct", "Module") else None, i))
        elif re.match(r"end\b", s) and stack:
            stack.pop()
    return imports, top


@extractor("XML")
def xml(text: str) -> tuple[list[str], list[Decl]]:
    """The root and the first of each element name just below it."""
    clean = re.sub(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<!DOCTYPE[^>]*>", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    top, depth, seen = [], 0, set()
    for m in re.finditer(r"<(/?)([A-Za-z_][\w:.\-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*?)(/?)>", clean):
        if m[1]:
            depth = max(0, depth - 1)
            continue
        if depth <= 1 and (depth, m[2]) not in seen:
            seen.add((depth, m[2]))
            d = Decl("Element", m[2], _value(" ".join(m.group().split())), clean.count("\n", 0, m.start()) + 1, "Public")
            (top[0].children if depth and top else top).append(d)
        if not m[4]:
            depth += 1
    return [], top


@extractor("HTML")
def html(text: str) -> tuple[list[str], list[Decl]]:
    """Sections with their ids, and the title; sheets and scripts are imports. Of each line the first match counts."""
    imports, top = [], []
    for i, line in enumerate(text.split("\n")):
        if m := re.search(r"<title[^>]*>([^<]*)</title>", line, re.I):
            top.append(Decl("Element", "title", _value(m[1].strip()), i + 1, "Public"))
        if m := re.search(r"<(header|nav|main|section|article|aside|footer|form|div|h1|h2)\b([^>]*)>", line, re.I):
            id_ = re.search(r"\bid\s*=\s*[\"']([^\"']+)", m[2])
            tag = m[1].lower()
            if id_ or tag not in ("div", "form", "h1", "h2"):
                top.append(Decl("Element", tag + (f"#{id_[1]}" if id_ else ""), _value(m.group().strip()), i + 1, "Public"))
        if m := re.search(r"<link\b[^>]*>", line, re.I):
            if "stylesheet" in m.group() and (h := re.search(r"href\s*=\s*[\"']([^\"']+)", m.group())):
                imports.append(h[1])
        if m := re.search(r"<script\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)", line, re.I):
            imports.append(m[1])
    return imports, top


@extractor("CSS")
def css(text: str) -> tuple[list[str], list[Decl]]:
    """Imports, rules of the top level, and custom properties."""
    clean = re.sub(r"/\*.*?\*/|(?<![:\w])//[^\n]*", lambda m: re.sub(r"[^\n]", " ", m.group()), text, flags=re.S)
    imports, top = [], []
    for m in re.finditer(r"@(?:import|use|forward)\s+(?:url\()?[\"']?([^\"');]+)", clean):
        imports.append(m[1].strip())
    for s in scan.statements(clean, 0, len(clean)):
        line = clean.count("\n", 0, s.start) + 1
        head = " ".join(s.head.split())
        if re.match(r"@(?:import|use|forward|charset)\b", head):
            continue
        if head.startswith("@"):
            top.append(Decl("Macro", head.split("(")[0].strip(), _value(head), line, "Public"))
        elif s.body:
            top.append(Decl("Class", head, _value(head), line, "Public"))
        if s.body:
            for p in re.finditer(r"(--[\w-]+)\s*:\s*([^;}]*)", clean[slice(*s.body)]):
                (top[-1].children if top else top).append(Decl("Constant", p[1], _value(" ".join(p.group().split())), clean.count("\n", 0, s.body[0] + p.start()) + 1, "Public"))
        elif m := re.match(r"(\$[\w-]+)\s*:", head):
            top.append(Decl("Constant", m[1], _value(head), line, "Public"))
    return imports, top


@extractor("Gradle")
def gradle(text: str) -> tuple[list[str], list[Decl]]:
    """Blocks, plugins, tasks and values; what depends on something is an import."""
    imports, top, depth, block = [], [], 0, None
    raw = text.split("\n")
    for i, line in enumerate(scan.blanked(text, "TypeScript").split("\n")):
        s, full = line.strip(), raw[i].strip()
        if m := re.match(r"(?:tasks\.(?:register|create|named)(?:<\w+>)?\s*\(|task\s+)\s*[\"']?(\w+)?", full):
            if m[1]:
                top.append(Decl("Function", m[1], full.rstrip("{ "), i + 1, "Public"))
        elif depth == 0 and (m := re.match(r"(\w+)\s*(?:\([^)]*\)\s*)?\{", s)):
            block = Decl("Module", m[1], full.rstrip("{ "), i + 1, "Public")
            top.append(block)
        elif depth == 0 and (m := re.match(r"(?:def|val|var|ext\.)\s*(\w+)\s*(?::\s*[\w<>]+\s*)?=", s)):
            top.append(Decl("Constant", m[1], _value(full), i + 1, "Public"))
        elif block is not None and block.name == "plugins" and (m := re.search(r"(?:id|kotlin|alias)\s*\(?\s*[\"']?([\w.\-]+)", full)):
            block.children.append(Decl("ConfigKey", m[1], _value(full), i + 1, "Public"))
        elif m := re.match(r"apply\s*\(?\s*plugin\s*[:=]\s*[\"']([^\"']+)", full):
            top.append(Decl("ConfigKey", m[1], full, i + 1, "Public"))
        if m := re.match(r"(?:\w*[iI]mplementation|api|compileOnly|runtimeOnly|\w*[cC]ompile|kapt|classpath|annotationProcessor)\s*\(?\s*[\"']([^\"']+)", full):
            imports.append(m[1])
        depth += s.count("{") - s.count("}")
    return imports, top


@extractor("CMake")
def cmake(text: str) -> tuple[list[str], list[Decl]]:
    kinds = {"project": "Module", "add_library": "Module", "add_executable": "Function", "function": "Function", "macro": "Macro", "option": "ConfigKey"}
    imports, top = [], []
    for i, line in enumerate(text.split("\n")):
        m = re.match(r"\s*(\w+)\s*\(\s*\"?([\w${}.\-:/]+)?", line.split("#")[0])
        if not m or not m[2]:
            continue
        word = m[1].lower()
        if word in kinds:
            top.append(Decl(kinds[word], m[2], line.strip(), i + 1, "Public"))
        elif word == "set" and re.fullmatch(r"[A-Z][A-Z0-9_]*", m[2]):
            top.append(Decl("Constant", m[2], _value(line.strip()), i + 1, "Public"))
        elif word in ("find_package", "add_subdirectory", "include"):
            imports.append(m[2])
    return imports, top


def rows(path: str, language: str, text: str) -> Iterator[tuple]:
    """Pre-order rows; texts that don't parse have none."""
    f = EXTRACTORS.get(language)
    if f is None:
        return
    try:
        _, top = f(text)
    except (SyntaxError, ValueError, RecursionError):
        return
    out: list[list] = []

    def add(d: Decl, parent: int | None, depth: int) -> None:
        k = len(out)
        m = d.metrics or (None, None, None)
        out.append([path, language, k, parent, depth, k, d.kind, d.name, d.signature, d.visibility, d.line, d.doc, d.test, d.asynchronous, d.deprecated, d.body, *m, d.rels])
        for c in d.children:
            add(c, k, depth + 1)
        out[k][5] = len(out) - 1

    for d in top:
        add(d, None, 0)
    yield from map(tuple, out)


def declarations(contents: DataFrame) -> DataFrame:
    """contents (path, language, text) -> DECLS, one pass in tasks."""
    names = [x.split()[0] for x in DECLS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [r for p, lang, t in zip(b["path"], b["language"], b["text"]) for r in rows(p, lang, t)]
            df = pd.DataFrame(out, columns=names)
            for c in ("parent_ord", "body_lines", "cyclomatic", "nesting", "params"):
                df[c] = df[c].astype("Int32")
            yield df

    return contents.select("path", "language", "text").mapInPandas(run, DECLS)


def imports(contents: DataFrame) -> DataFrame:
    """contents -> (path, import_ord, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, lang, t in zip(b["path"], b["language"], b["text"]):
                try:
                    found = EXTRACTORS[lang](t)[0] if lang in EXTRACTORS else []
                except (SyntaxError, ValueError, RecursionError):
                    found = []
                out += [(p, i, x) for i, x in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "import_ord", "text"])

    return contents.select("path", "language", "text").mapInPandas(run, "path string, import_ord int, text string")
