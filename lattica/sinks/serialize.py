"""An index as JSON or YAML, whole: a document for each file, nested declarations included."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DECL = ["decl_ord", "parent_ord", "kind", "name", "signature", "visibility", "line", "doc_comment", "is_test", "is_deprecated", "body_lines", "cyclomatic", "nesting", "params", "relationships"]


def documents(files: DataFrame, decls: DataFrame, imports: DataFrame) -> DataFrame:
    """(member, path, json): a file with its imports and its flat declarations, children by parent_ord."""
    columns = [c for c in _DECL if c in decls.columns]
    d = decls.groupBy("member", "path").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("declarations"))
    i = imports.groupBy("member", "path").agg(F.transform(F.array_sort(F.collect_list(F.struct("import_ord", "text"))), lambda x: x["text"]).alias("imports"))
    f = files.join(i, ["member", "path"], "left").join(d, ["member", "path"], "left")
    return f.select("member", "path", F.to_json(F.struct("member", "path", "language", "size", "lines", F.coalesce("imports", F.array().cast("array<string>")).alias("imports"), "declarations")).alias("json"))


def nested(document: dict) -> dict:
    """The declarations of a file's document as a tree."""
    by, top = {}, []
    for d in document.get("declarations") or []:
        d = dict(d)
        at, parent = d.pop("decl_ord"), d.pop("parent_ord", None)
        by[at] = d
        (top if parent is None else by[parent].setdefault("children", [])).append(d)
    return document | {"declarations": top}


def json_lines(files: DataFrame, decls: DataFrame, imports: DataFrame, name: str, generated_at: str = "") -> Iterator[str]:
    """One JSON object, a file a line; the driver holds one file at a time."""
    yield json.dumps({"root_name": name, "generated_at": generated_at})[:-1] + ', "files": ['
    held = None
    for r in documents(files, decls, imports).orderBy("member", F.split("path", "/")).toLocalIterator():
        if held is not None:
            yield held + ","
        held = json.dumps(nested(json.loads(r.json)), ensure_ascii=False)
    yield from ([] if held is None else [held])
    yield "]}"


def _yaml(value, indent: int = 0) -> Iterator[str]:
    pad = "  " * indent
    if isinstance(value, dict):
        for k, v in value.items():
            if isinstance(v, (dict, list)) and v:
                yield f"{pad}{k}:"
                yield from _yaml(v, indent + 1)
            else:
                yield f"{pad}{k}: {json.dumps(v, ensure_ascii=False)}"
    else:
        for v in value:
            if isinstance(v, (dict, list)) and v:
                first, *rest = _yaml(v, indent + 1)
                yield f"{pad}- {first.lstrip()}"
                yield from rest
            else:
                yield f"{pad}- {json.dumps(v, ensure_ascii=False)}"


def yaml_lines(files: DataFrame, decls: DataFrame, imports: DataFrame, name: str, generated_at: str = "") -> Iterator[str]:
    """The same document as YAML; scalars in JSON's own spelling, which YAML takes as it is."""
    yield f"root_name: {json.dumps(name)}"
    yield f"generated_at: {json.dumps(generated_at)}"
    yield "files:"
    for r in documents(files, decls, imports).orderBy("member", F.split("path", "/")).toLocalIterator():
        yield from _yaml([nested(json.loads(r.json))], 1)
