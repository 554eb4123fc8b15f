"""Type flow: which declarations give back a type and which take it, by the types that their signatures name."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..storage import saved

_PLAIN = set("any bool boolean byte char double error f32 f64 float i128 i16 i32 i64 i8 int isize long none null number object self short str string u128 u16 u32 u64 u8 undefined usize void".split())
_NAME = re.compile(r"\w+")
_OPEN, _CLOSE = "([{<", ")]}>"
_MODIFIERS = set("abstract async const constexpr default explicit extern final fn func inline internal native new open override partial private protected pub public sealed static suspend synchronized unsafe virtual".split())


def type_names(text: str) -> list[str]:
    """Names of types in a type's text; those of the language itself don't count."""
    text = re.sub(r"\bmut\s|\bconst\s", " ", text)
    return [w for w in _NAME.findall(text) if w[0].isalpha() and w.lower() not in _PLAIN]


def split_top(text: str, mark: str = ",") -> list[str]:
    """Pieces between marks that stand in no brackets; the > of an arrow closes nothing."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE and not (c == ">" and i and text[i - 1] in "-="):
            depth = max(0, depth - 1)
        elif c == mark and depth == 0:
            out.append(text[at:i])
            at = i + 1
    return [p for p in [*out, text[at:]] if p.strip()]


def closing(text: str, at: int) -> int:
    """The place of the bracket that closes the round one at `at`; -1: none."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return -1


def _groups(text: str) -> list[tuple[int, int]]:
    out, i = [], text.find("(")
    while i >= 0:
        j = closing(text, i)
        if j < 0:
            break
        out.append((i, j))
        i = text.find("(", j + 1)
    return out


def _tail(text: str, *ends: str) -> str:
    for e in ends:
        text = text.split(e)[0]
    return text.strip()


def _after_colon(params: list[str], cut: str = "=") -> list[str]:
    return [t for p in params if ":" in p for t in type_names(split_top(p.partition(":")[2], cut)[0] if p.partition(":")[2].strip() else "")]


def _leading(text: str) -> list[str]:
    """Types before a declared name, without modifiers and annotations."""
    words = re.sub(r"@\w+(\([^)]*\))?", " ", text).split()[:-1]
    return type_names(" ".join(w for w in words if w.lower() not in _MODIFIERS))


def _c_like(sig: str, params: list[str], rest: str, head: str) -> tuple[list[str], list[str]]:
    takes = []
    for p in params:
        if ":" in p.replace("::", ""):
            takes += type_names(re.split(r"(?<!:):(?!:)", p, maxsplit=1)[-1])
        elif p.strip().lstrip("&").replace("mut ", "").strip() != "self":
            takes += type_names(" ".join(p.split()[:-1]))
    if "->" in rest:
        return takes, type_names(_tail(rest.partition("->")[2], "{", " where "))
    return takes, [] if "->" in sig else _leading(head)


def _typescript(sig, params, rest, head):
    r = rest.strip()
    return _after_colon(params), type_names(_tail(r[1:], "{", "=>")) if r.startswith(":") else []


def _python(sig, params, rest, head):
    return _after_colon(params), type_names(rest.partition("->")[2].strip().rstrip(":")) if "->" in rest else []


def _kotlin(sig, params, rest, head):
    r = rest.strip()
    return _after_colon(params), type_names(_tail(r[1:], "{", "=")) if r.startswith(":") else []


def _swift(sig, params, rest, head):
    return _after_colon(params), type_names(_tail(rest.partition("->")[2], "{", " where ")) if "->" in rest else []


def _java_like(sig, params, rest, head):
    takes = []
    for p in params:
        words = re.sub(r"@\w+(\([^)]*\))?", " ", p).split()
        takes += type_names(" ".join(w for w in words[:-1] if w not in ("final", "ref", "out", "in", "params", "this")))
    return takes, _leading(head)


def _go(sig: str) -> tuple[list[str], list[str]]:
    g = _groups(sig)
    if not g:
        return [], []
    named = len(g) > 1 and re.search(r"[^\W\d_]", sig[g[0][1] + 1 : g[1][0]])  # a receiver comes first
    p = 1 if named else 0
    takes = [t for x in split_top(sig[g[p][0] + 1 : g[p][1]]) for t in type_names(x.split()[-1])]
    if len(g) > p + 1:
        gives = [t for x in split_top(sig[g[p + 1][0] + 1 : g[p + 1][1]]) for t in type_names(x.split()[-1])]
    else:
        gives = type_names(_tail(sig[g[p][1] + 1 :], "{"))
    return takes, gives


_LANGUAGES = {"Rust": _c_like, "C": _c_like, "C++": _c_like, "TypeScript": _typescript, "JavaScript": _typescript, "Python": _python, "Kotlin": _kotlin, "Java": _java_like, "C#": _java_like, "Swift": _swift}


def signature_types(signature: str, language: str) -> tuple[list[str], list[str]]:
    """(types taken, types given back) of a function's signature; languages without types in it: none."""
    sig = (signature or "").strip()
    if language == "Go":
        return _go(sig)
    at = sig.find("(")
    end = closing(sig, at) if at >= 0 else -1
    if language not in _LANGUAGES or end < 0:
        return [], []
    return _LANGUAGES[language](sig, split_top(sig[at + 1 : end]), sig[end + 1 :], sig[:at])


def flows(decls: DataFrame, fields: bool = False) -> DataFrame:
    """decls (path, language, decl_ord, kind, name, signature, line) -> a row for each type that a function or method
    takes (consumer) or gives back (producer) and, with `fields`, that a field's signature names (consumer)."""
    ship(decls.sparkSession)
    kinds = ["Function", "Method"] + (["Field"] if fields else [])

    def run(kind: pd.Series, language: pd.Series, signature: pd.Series) -> pd.Series:
        return pd.Series([_uses(k == "Field", lang, s) for k, lang, s in zip(kind, language, signature)], dtype=object)

    # only what it reads goes through Python, so what a caller leaves out is never made
    uses = F.pandas_udf(run, "array<string>")("kind", "language", "signature")
    rest = ["path", F.col("decl_ord").cast("int"), "kind", "name", "signature", F.col("line").cast("int")]
    some = decls.where(F.col("kind").isin(kinds)).select(*rest, F.explode(uses).alias("use"))
    role = F.when(F.startswith("use", F.lit(">")), "producer").otherwise("consumer")
    return some.select(F.expr("substring(use, 2)").alias("type"), role.alias("role"), "path", "decl_ord", "kind", "name", "signature", "line")


@lru_cache(1 << 16)
def _uses(field: bool, language: str | None, signature: str | None) -> list[str]:
    """Types with a mark in front: > given back, < taken."""
    takes, gives = (type_names(signature or ""), []) if field else signature_types(signature, language)
    return [mark + t for mark, ts in ((">", gives), ("<", takes)) for t in dict.fromkeys(ts)]


def type_flow(decls: DataFrame, name: str, limit: int = 50, fields: bool = False) -> DataFrame:
    """Who gives back and who takes the type, whatever its name's case: at most `limit` of either, in order."""
    if name.isascii():  # a type stands in its signature as it is
        decls = decls.where(F.contains(F.lower("signature"), F.lit(name.lower())))
    f = saved(flows(decls, fields).where(F.lower("type") == name.lower()))
    top = lambda role: f.where(F.col("role") == role).orderBy(F.split("path", "/"), "decl_ord").limit(min(limit, 200))
    return top("producer").unionByName(top("consumer")).select("role", "path", "kind", "name", "signature", "line")
