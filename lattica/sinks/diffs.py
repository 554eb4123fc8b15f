"""Structural differences as Markdown or JSON (see operators.difference.declaration_diff)."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.difference import in_order

_TITLES = {"added": "Added", "removed": "Removed", "modified": "Modified"}


def change_line() -> Column:
    """+ added, - removed, ~ old -> new."""
    return (
        F.when(F.col("change") == "added", F.concat(F.lit("+ "), "new_value"))
        .when(F.col("change") == "removed", F.concat(F.lit("- "), "old_value"))
        .otherwise(F.concat(F.lit("~ "), "old_value", F.lit(" -> "), "new_value"))
    )


def markdown(diff: DataFrame, since: str = "") -> Iterator[str]:
    yield f"# Changes since {since}" if since else "# Changes"
    last = None
    for r in in_order(diff.withColumn("line", change_line())).toLocalIterator():
        if r.path != last:
            yield ""
            yield f"## {_TITLES[r.file_change]}: {r.path}"
            last = r.path
        yield f"- `{r.line}`"


def as_json(diff: DataFrame, since: str = "") -> str:
    out: dict = {"since_ref": since, "files_added": [], "files_removed": [], "files_modified": []}
    last = None
    for r in in_order(diff).toLocalIterator():
        if r.path != last:
            out[f"files_{r.file_change}"].append({"path": r.path, "changes": []})
            last = r.path
        out[f"files_{r.file_change}"][-1]["changes"].append({"change": r.change, "kind": r.kind, "name": r.name, "old": r.old_value, "new": r.new_value})
    return json.dumps(out, ensure_ascii=False)
