"""Order statistics and roundings in the definitions of the health report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round1(x: Column) -> Column:
    return F.floor(x * 10 + 0.5) / 10


def hotspot_score(cyclomatic: Column, nesting: Column, params: Column, body_lines: Column) -> Column:
    return cyclomatic + 2.0 * nesting + 0.5 * params + body_lines / 20.0
