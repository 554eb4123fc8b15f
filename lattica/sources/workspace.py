"""Workspaces: which folders of a tree are members of their own, by its manifests. The driver reads a few small files."""

from __future__ import annotations

import json
import os
import re
import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Member = tuple[str, str]


def segment_matches(pattern: str, name: str) -> bool:
    """* and ? within one segment; a square bracket stands for itself."""
    rx = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return re.fullmatch(rx, name, re.S) is not None


def expand(root: str, pattern: str) -> list[str]:
    """Folders below the root that a pattern names, a segment at a time; ** isn't one. Hidden ones only if named so."""
    found = [""]
    for segment in [s for s in pattern.strip("/").split("/") if s not in ("", ".")]:
        below = []
        for f in found:
            here = os.path.join(root, f)
            if any(c in segment for c in "*?["):
                below += [os.path.join(f, n) for n in sorted(os.listdir(here)) if segment_matches(segment, n) and (segment.startswith(".") or not n.startswith("."))]
            else:
                below.append(os.path.join(f, segment))
        found = [b for b in below if os.path.isdir(os.path.join(root, b))]
    return [f for f in found if f]


def _load(path: str, how: Callable) -> dict | None:
    try:
        with open(path, "rb") as f:
            out = how(f)
        return out if isinstance(out, dict) else None
    except (OSError, ValueError):
        return None


def _cargo(root: str) -> list[Member] | None:
    w = (_load(f"{root}/Cargo.toml", tomllib.load) or {}).get("workspace")
    if not isinstance(w, dict) or not w.get("members"):
        return None
    gone = {p for x in w.get("exclude", []) for p in expand(root, x)}
    out = []
    for p in dict.fromkeys(p for m in w["members"] for p in expand(root, m) if p not in gone):
        own = _load(f"{root}/{p}/Cargo.toml", tomllib.load)
        if own is not None:
            out.append((own.get("package", {}).get("name") or p.rsplit("/", 1)[-1], p))
    return out


def _npm(root: str) -> list[Member] | None:
    w = (_load(f"{root}/package.json", json.load) or {}).get("workspaces")
    patterns = w.get("packages") if isinstance(w, dict) else w
    if not patterns:
        return None
    gone = {p for x in patterns if x.startswith("!") for p in expand(root, x[1:])}
    out = []
    for p in dict.fromkeys(p for m in patterns if not m.startswith("!") for p in expand(root, m) if p not in gone):
        own = _load(f"{root}/{p}/package.json", json.load)
        if own is not None:
            out.append((own.get("name") or p.rsplit("/", 1)[-1], p))
    return out


def _go(root: str) -> list[Member] | None:
    try:
        with open(f"{root}/go.work", encoding="utf-8") as f:
            text = re.sub(r"//[^\n]*", "", f.read())
    except (OSError, UnicodeDecodeError):
        return None
    used = [x for block in re.findall(r"^\s*use\s*\(([^)]*)\)", text, re.M) for x in block.split()] + re.findall(r"^\s*use\s+([^\s(]+)", text, re.M)
    out = []
    for p in dict.fromkeys(os.path.normpath(u.strip('"')) for u in used):
        if os.path.isdir(f"{root}/{p}") and p != ".":
            try:
                with open(f"{root}/{p}/go.mod", encoding="utf-8") as f:
                    m = re.search(r"^module\s+(\S+)", f.read(), re.M)
            except OSError:
                m = None
            out.append((m[1].rsplit("/", 1)[-1] if m else p.rsplit("/", 1)[-1], p))
    return out


def detect(root: str) -> tuple[str, list[Member]]:
    """(kind, [(name, path below the root)]) by the first manifest that names members; kind none: the root alone."""
    for kind, find in (("cargo", _cargo), ("npm", _npm), ("go", _go)):
        members = find(root)
        if members:
            return kind, sorted(members, key=lambda m: m[1].split("/"))
    return "none", [(os.path.basename(os.path.abspath(root)), "")]


def members(spark: SparkSession, root: str) -> DataFrame:
    """member, root (below the tree's), member_ord."""
    return spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(detect(root)[1])], "member string, root string, member_ord int")


def assigned(files: DataFrame, members: DataFrame) -> DataFrame:
    """files (path) with the member that owns each; nested members take their own files, the rest are the root's."""
    from ..operators.preflight import owning_member

    return owning_member(files.drop("member"), members.select("member", "root"))
