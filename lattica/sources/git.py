"""Git as a source: changed paths by the driver, files at a ref by tasks where they see the repository."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .languages import detect


def _git(root: str, *args: str, stdin: bytes | None = None) -> bytes | None:
    r = subprocess.run(["git", "-C", root, *args], capture_output=True, input=stdin)
    return r.stdout if r.returncode == 0 else None


def head(root: str) -> str:
    return (_git(root, "rev-parse", "HEAD") or b"unknown").decode().strip()


def commits_behind(root: str, ref: str) -> int | None:
    """Commits from a ref (given by its hex digits) to the head; anything else: unknown."""
    if not re.fullmatch(r"[0-9a-fA-F]+", ref):
        return None
    out = _git(root, "rev-list", "--count", f"{ref}..HEAD")
    return int(out) if out is not None else None


def changed_paths(root: str, ref: str, kinds: str | None = None) -> list[str]:
    """Committed changes since the merge base; kinds: letters of added, modified, deleted files and so on."""
    out = _git(root, "diff", "--name-only", "-z", *([f"--diff-filter={kinds}"] if kinds else []), f"{ref}...HEAD")
    if out is None:
        raise ValueError(f"unknown ref {ref}")
    return [p for p in out.decode("utf-8", "replace").split("\0") if p]


def resolve_branch(root: str, branch: str) -> str | None:
    """The ref of a branch: the remote's, else the local one."""
    return next((r for r in (f"origin/{branch}", branch) if _git(root, "rev-parse", "--verify", "--quiet", r) is not None), None)


def blobs(root: str, ref: str, paths: list[str]) -> Iterator[tuple[str, bytes]]:
    """(path, content) at the ref, from one process for all of them; files that weren't there are left out."""
    asked = [p for p in paths if "\n" not in p]
    out = _git(root, "cat-file", "--batch", stdin="".join(f"{ref}:{p}\n" for p in asked).encode())
    at = 0
    for p in asked if out is not None else []:
        end = out.index(b"\n", at)
        line, at = out[at:end], end + 1
        if line.endswith((b" missing", b" ambiguous")):
            continue
        size = int(line.rsplit(b" ", 1)[1])
        if b" blob " in line:
            yield p, out[at : at + size]
        at += size + 1


def at_ref(spark: SparkSession, root: str, ref: str, paths: list[str], batch: int = 256) -> DataFrame:
    """path, language, text as of the ref; files that weren't there or aren't UTF-8 have no row.

    Tasks read their paths from the repository, a process a batch, so `root` must be a folder that all of them see."""
    known = [p for p in paths if detect(p)]
    rows = [(i // batch, p, detect(p)) for i, p in enumerate(known)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            languages, out = dict(zip(b["path"], b["language"])), []
            for p, raw in blobs(root, ref, list(languages)):
                try:
                    out.append((p, languages[p], raw.decode("utf-8")))
                except UnicodeDecodeError:
                    pass
            yield pd.DataFrame(out, columns=["path", "language", "text"])

    from ..session import ship

    ship(spark)
    listed = spark.createDataFrame(rows, "batch int, path string, language string")
    return listed.repartitionById(max(1, -(-len(rows) // batch)), "batch").mapInPandas(run, "path string, language string, text string")


def diff_since(spark: SparkSession, root: str, ref: str, current: DataFrame) -> DataFrame:
    """What the committed changes since the ref did to declarations: (path, file_change, kind, name, change, old_value,
    new_value). current: contents (path, language, text) of the tree as it is."""
    from ..operators.difference import declaration_diff
    from .extract import declarations

    paths = changed_paths(root, ref)
    base = (_git(root, "merge-base", ref, "HEAD") or ref.encode()).decode().strip()
    changed = spark.createDataFrame([(p,) for p in paths], "path string")
    new = current.join(changed, "path", "left_semi")
    return declaration_diff(declarations(at_ref(spark, root, base, paths)), declarations(new), changed)
