"""Source trees as tables: paths are walked on the driver, contents are read by tasks in bytes.

Spark's own file sources drop names that begin with _ and empty files, so they aren't used here. Hidden entries are
skipped, .gitignore files are followed, files above `max_kb` or of unknown language are left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .languages import detect

FILES = "path string, language string, size long, mtime long, full string"


def ignore_rules(text: str) -> list[tuple[bool, bool, re.Pattern]]:
    """(negated, directories only, pattern on the path below the file's folder) of each line of a .gitignore."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        no, line = line.startswith("!"), line.lstrip("!")
        only, line = line.endswith("/"), line.rstrip("/")
        rooted, line = "/" in line, line.lstrip("/")
        rx, i = "" if rooted else "(.*/)?", 0
        while i < len(line):
            if line.startswith("**/", i):
                rx, i = rx + "(.*/)?", i + 3
            elif line.startswith("**", i):
                rx, i = rx + ".*", i + 2
            else:
                rx, i = rx + {"*": "[^/]*", "?": "[^/]"}.get(line[i], re.escape(line[i])), i + 1
        out.append((no, only, re.compile(rx + "$")))
    return out


def walk(root: str, respect_gitignore: bool = True, max_kb: int = 512, max_depth: int | None = None, excludes: tuple[str, ...] = ()) -> list[tuple[str, str, int, int, str]]:
    """Rows of FILES in the order of path components."""
    outer = [("", ignore_rules("\n".join(excludes)))]
    out: list[tuple[str, str, int, int, str]] = []

    def visit(folder: str, rel: str, rules: list, depth: int) -> None:
        mark = os.path.join(folder, ".gitignore")
        if respect_gitignore and os.path.isfile(mark):
            with open(mark, encoding="utf-8", errors="replace") as f:
                rules = [*rules, (rel, ignore_rules(f.read()))]
        for e in sorted(os.scandir(folder), key=lambda e: e.name):
            if e.name.startswith("."):
                continue
            path, is_dir, drop = rel + e.name, e.is_dir(follow_symlinks=False), False
            for base, rs in rules:
                for no, only, rx in rs:
                    if path.startswith(base) and (is_dir or not only) and rx.match(path[len(base) :]):
                        drop = not no
            if drop or (max_depth is not None and depth > max_depth):
                continue
            if is_dir:
                visit(e.path, path + "/", rules, depth + 1)
            elif e.is_file(follow_symlinks=False) and (language := detect(path)):
                s = e.stat()
                if s.st_size <= max_kb * 1024:
                    out.append((path, language, s.st_size, int(s.st_mtime), e.path))

    visit(root, "", outer, 1)
    return sorted(out, key=lambda r: r[0].split("/"))


def files(spark: SparkSession, root: str, **options) -> DataFrame:
    rows = walk(root, **options)
    return spark.createDataFrame(rows, FILES).withColumn("path_parts", F.split("path", "/"))


def contents(listed: DataFrame) -> DataFrame:
    """path, language, text of the files that can be read as UTF-8; line ends as they are.

    Tasks read the files themselves, so the tree must be in a folder that all of them see: a task that doesn't see a
    file's folder ends with an error rather than without the file. Files that went away since the walk, or that aren't
    UTF-8, have no row (see unread).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, full in zip(b["path"], b["language"], b["full"]):
                try:
                    with open(full, "rb") as f:
                        rows.append((path, language, f.read().decode("utf-8")))
                except UnicodeDecodeError:
                    pass
                except OSError as e:
                    if not os.path.isdir(os.path.dirname(full)):
                        raise OSError(f"{full} isn't to be seen from this executor: keep the tree in a shared folder") from e
            yield pd.DataFrame(rows, columns=["path", "language", "text"])

    return listed.select("path", "language", "full").repartition(max(1, listed.sparkSession.sparkContext.defaultParallelism)).mapInPandas(read, "path string, language string, text string")


def unread(listed: DataFrame, texts: DataFrame) -> DataFrame:
    """The listed files that have no text."""
    return listed.join(texts.select("path"), "path", "left_anti")
