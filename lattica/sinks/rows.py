"""Ordered lines: every sink makes a table (section, keys..., line) in Spark and only then streams it to a file."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame


def lines(table: DataFrame, order: list, column: str = "line") -> Iterator[str]:
    """The column in order, a partition at a time in the driver's memory."""
    for r in table.orderBy(*order).select(column).toLocalIterator():
        yield r[0]


def save(path: str, text: Iterator[str]) -> int:
    """Writes lines to a local file and gives back how many there were."""
    n = 0
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        for n, x in enumerate(text, 1):
            f.write(x + "\n")
    return n
