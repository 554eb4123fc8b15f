"""Source text of brace languages as statements: what stands before a body or a terminator, with its place, comment and
body. Comments and strings are blanked first, so that brackets in them don't count; lengths and lines stay the same."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

_SLASH = r"/\*.*?(?:\*/|\Z)|//[^\n]*"
_STRINGS = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\''
_BLANK = {
    "Rust": re.compile(rf"{_SLASH}|r(#*)\".*?\"\1|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\])'", re.S),
    "TypeScript": re.compile(rf"{_SLASH}|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S),
    "Go": re.compile(rf"{_SLASH}|`[^`]*`|{_STRINGS}", re.S),
    "GraphQL": re.compile(r'"""(?:.*?)"""|#[^\n]*|"(?:\\.|[^"\\\n])*"', re.S),
    "": re.compile(rf"{_SLASH}|\"\"\".*?\"\"\"|{_STRINGS}", re.S),
}
_BLANK["JavaScript"] = _BLANK["TypeScript"]


def blanked(text: str, language: str = "") -> str:
    rx = _BLANK.get(language, _BLANK[""])
    return rx.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


@dataclass
class Statement:
    head: str  # code before the body or terminator, blanked
    start: int  # place of its first character
    end: int  # after the body or terminator
    body: tuple[int, int] | None  # inside the braces
    gap: tuple[int, int]  # what stands before it since the last one: comments

    def stop(self) -> int:
        return self.body[0] - 1 if self.body else self.end


def closing(code: str, at: int, end: int) -> int:
    """The place of the brace that closes the one at `at`; the end without one."""
    depth = 0
    for m in _BRACE.finditer(code, at, end):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.start()
    return end


_BRACE = re.compile(r"[{}]")
_MARK = re.compile(r"[(\[{)\]};\n]")
_CONTINUES = re.compile(r"[,(\[=+\-*/|&<:.]\s*$|\b(?:where|extends|implements)\s*$")
_GOES_ON = re.compile(r"\s*(?:\{|\.|where\b|->|:|=|<|throws\b|extends\b|implements\b)")


def statements(code: str, start: int, end: int, newline: bool = False) -> Iterator[Statement]:
    """newline: a line's end ends a statement as well, unless the line or the next one goes on."""
    at = last = start
    depth, valued = 0, False
    pos = start
    while True:
        m = _MARK.search(code, pos, end)
        if not m:
            break
        c, i = m.group(), m.start()
        pos = i + 1
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        elif c == "{":
            j = closing(code, i, end)
            if depth:  # a body within brackets belongs to an expression
                pos = j + 1
                continue
            head = code[at:i]
            if re.search(r"(?:=|=>|\breturn|\()\s*$", head.rstrip()) or newline and re.match(r"\s*(?:import\b[^\n]*|export\s*(?:type\s*)?)$", head) or re.search(r"(?<![=!<>])=(?![=>])", head) and not re.search(r"=>\s*$", head):
                pos, valued = j + 1, True  # a value in braces: the statement goes on behind it
                continue
            yield from _one(code, at, i, j + 1, (i + 1, j), last)
            at = last = pos = j + 1
        elif c == "}":
            at = last = i + 1
        elif c == ";" and not depth or c == "\n" and newline and not depth:
            head = code[at:i]
            if c == "\n" and (not head.strip() or _CONTINUES.search(head) or _GOES_ON.match(code, i + 1, end) and not valued):
                continue
            yield from _one(code, at, i, i + 1, None, last)
            at = last = i + 1
            valued = False
    if code[at:end].strip():
        yield from _one(code, at, end, end, None, last)


def _one(code: str, at: int, stop: int, end: int, body: tuple[int, int] | None, last: int) -> Iterator[Statement]:
    head = code[at:stop]
    if head.strip():
        first = at + len(head) - len(head.lstrip())
        yield Statement(code[first:stop].rstrip(), first, end, body, (last, first))


def split_top(code: str, start: int, end: int, mark: str = ",") -> Iterator[tuple[int, int]]:
    """Pieces between marks that stand in no brackets."""
    depth, at = 0, start
    for i in range(start, end):
        c = code[i]
        if c in "([{<":
            depth += 1
        elif c in ")]}>" and not (c == ">" and code[i - 1] in "-="):
            depth = max(0, depth - 1)
        elif c == mark and depth == 0:
            yield at, i
            at = i + 1
    if code[at:end].strip():
        yield at, end


def comment(text: str, style: str) -> str | None:
    """The comment just before a declaration, from what stands between it and the last one. style: /// doc comments only,
    /** blocks only, or // any."""
    block = list(re.finditer(r"/\*\*?(.*?)\*/", text, re.S))
    if block and not re.sub(r"//[^\n]*|#!?\[[^\]]*\]|@\w+(\([^)]*\))?", "", text[block[-1].end() :]).strip() and (style == "//" or block[-1].group().startswith("/**")):
        lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in block[-1][1].split("\n")]
        return "\n".join(lines).strip() or None
    if style == "/**":
        return None
    lead, out = ("///", []) if style == "///" else ("#" if style == "#" else "//", [])
    for line in reversed(text.rstrip().split("\n")):
        s = line.strip()
        if s.startswith(lead) and not s.startswith("#["):
            out.append(s.lstrip(lead[0]).lstrip("!").strip())
        elif s.startswith(("#[", "@")) and not out:
            continue
        else:
            break
    return "\n".join(reversed(out)).strip() or None


# complexity

_RULES: dict[str, tuple[str, str]] = {
    # branches, nesting
    "Rust": (r"\b(?:if|while|for|loop)\b|=>", r"if|while|for|loop|match"),
    "TypeScript": (r"\b(?:if|while|for|case|catch)\b|\s\?\s|\?\?", r"if|while|for|do|switch|try"),
    "Go": (r"\b(?:if|for|case)\b", r"if|for|select|switch"),
    "Java": (r"\b(?:if|while|for|case|default|catch)\b|\s\?\s", r"if|while|for|do|switch|try"),
    "C": (r"\b(?:if|while|for|case|default)\b|\s\?\s", r"if|while|for|do|switch"),
    "C++": (r"\b(?:if|while|for|case|default|catch)\b|\s\?\s", r"if|while|for|do|switch|try"),
}
_RULES["JavaScript"] = _RULES["TypeScript"]
_BRANCH = {k: re.compile(b) for k, (b, _) in _RULES.items()}
_NEST = {k: re.compile(rf"\b(?:{n})\b|[{{}}();]") for k, (_, n) in _RULES.items()}
_BOOLEAN = re.compile(r"&&|(?<=[\w)\]\"' ])\|\|(?!\s*\{)")
_INNER = {
    "Rust": re.compile(r"\bfn\s+\w+[^{;]*\{|(?<![|\w])\|[^|\n]*\|\s*(?:->[^{]*)?\{|\|\|\s*\{"),
    "TypeScript": re.compile(r"\bfunction\b[^{]*\{|=>\s*\{"),
    "Go": re.compile(r"\bfunc\s*\([^{]*\{"),
    "Java": re.compile(r"->\s*\{"),
    "C++": re.compile(r"\[[^\]\n]*\]\s*(?:\([^)]*\))?\s*(?:mutable\s*)?(?:->[^{]*)?\{"),
}
_INNER["JavaScript"] = _INNER["TypeScript"]


def own_body(code: str, language: str) -> str:
    """A function's body without the bodies of functions inside it."""
    rx, out, at = _INNER.get(language), [], 0
    while rx and (m := rx.search(code, at)):
        end = closing(code, m.end() - 1, len(code))
        out.append(code[at : m.start()])
        at = end + 1
    return "".join(out) + code[at:]


def metrics(body: str, language: str) -> tuple[int, int]:
    """(cyclomatic, deepest nesting) of a blanked body; functions inside it aren't entered."""
    code = own_body(body, language)
    cc = 1 + len(_BRANCH[language].findall(code)) + len(_BOOLEAN.findall(code))
    stack: list[bool] = []
    deepest = depth = brackets = 0
    pending = False
    for m in _NEST[language].finditer(code):
        c = m.group()
        if c == "(":
            brackets += 1
        elif c == ")":
            brackets -= 1
        elif c == "{":
            stack.append(pending)
            depth += pending
            deepest, pending = max(deepest, depth), False
        elif c == "}":
            if stack:
                depth -= stack.pop()
        elif c == ";":
            if pending and brackets <= 0:
                deepest, pending = max(deepest, depth + 1), False
        elif not (c == "while" and re.search(r"\}\s*$", code[: m.start()]) and language != "Rust"):
            pending = True
    return cc, deepest


def parameters(head: str, at: int, language: str) -> int:
    """How many are declared in the first round brackets from `at` on."""
    open_ = head.find("(", at)
    if open_ < 0:
        return 0
    depth = 0
    for i in range(open_, len(head)):
        depth += (head[i] in "([{") - (head[i] in ")]}")
        if depth == 0:
            break
    else:
        return 0
    parts = [head[a:b].strip() for a, b in split_top(head, open_ + 1, i) if head[a:b].strip()]
    return 0 if language in ("C", "C++") and parts == ["void"] else len(parts)
