"""Hotspots and health of functions by their complexity metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import hotspot_score, round1

SORTS = ("score", "cyclomatic", "nesting", "params", "body_lines")
#: Complexity from here on is high.
HIGH = 10


def with_score(m: DataFrame) -> DataFrame:
    return m.withColumn("score", hotspot_score(F.col("cyclomatic"), F.col("nesting"), F.col("params"), F.col("body_lines")))


def hotspots(m: DataFrame, limit: int = 20, min_complexity: int = 1, sort_by: str = "score", ties: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """The worst functions; the order is total if `ties` identify a row."""
    if sort_by not in SORTS:
        raise ValueError(f"sort_by must be one of {SORTS}")
    return with_score(m).where(F.col("cyclomatic") >= min_complexity).orderBy(F.desc(sort_by), *ties).limit(limit)


def _at(ordered: Column, i: Column) -> Column:
    """The value with place i (from 0) of a distribution: ascending (v, c) with the counts up to and including v."""
    return F.get(F.filter(ordered, lambda x: x["upto"] > i), F.lit(0))["v"]


def _distribution() -> Column:
    """Of the aggregated counts (v, c): ascending structs (v, upto)."""
    s = F.array_sort(F.collect_list(F.struct("v", "c")))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<v:bigint,upto:bigint>>").alias("out"))
    step = lambda a, x: F.struct((a["n"] + x["c"]).alias("n"), F.concat(a["out"], F.array(F.struct(x["v"].cast("long").alias("v"), (a["n"] + x["c"]).alias("upto")))).alias("out"))
    return F.aggregate(s, zero, step)["out"]


def _report(m: DataFrame) -> DataFrame:
    """Counts by value of complexity carry all sums, so the table is read once and one small row for each value is left."""
    high = F.col("v") >= HIGH
    by = m.groupBy(F.col("cyclomatic").cast("long").alias("v")).agg(F.count("*").alias("c"), *[F.sum(c).alias(c) for c in ("nesting", "params", "body_lines")])
    one = by.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("analyzed"),
        F.sum(F.col("v") * F.col("c")).alias("cyclomatic"),
        F.coalesce(F.max("v"), F.lit(0)).alias("max_complexity"),
        *[F.sum(c).alias(c) for c in ("nesting", "params", "body_lines")],
        F.coalesce(F.sum(F.when(high, F.col("c"))), F.lit(0)).alias("high_count"),
        _distribution().alias("ordered"),
    )
    n = F.greatest("analyzed", F.lit(1))
    avg = lambda c: F.coalesce(round1(F.col(c) / n), F.lit(0.0))
    low, up = _at(F.col("ordered"), F.floor((F.col("analyzed") - 1) / 2)), _at(F.col("ordered"), F.floor(F.col("analyzed") / 2))
    return one.select(
        "analyzed", avg("cyclomatic").alias("avg_complexity"), "max_complexity", avg("nesting").alias("avg_nesting"), avg("params").alias("avg_params"), avg("body_lines").alias("avg_body_lines"), "high_count",
        round1(100.0 * F.col("high_count") / n).alias("high_percent"),
        F.coalesce(F.ceil((low + up) / 2).cast("long"), F.lit(0)).alias("median"),
        F.coalesce(_at(F.col("ordered"), F.floor((F.col("analyzed") - 1) * 0.9)), F.lit(0)).alias("p90"),
    )


def health(m: DataFrame) -> DataFrame:
    """One row of aggregates over metrics (cyclomatic, nesting, params, body_lines); zeros for an empty table."""
    return _report(m)


def declaration_counts(decls: DataFrame) -> DataFrame:
    """One row: functions (and methods) in all, tests, deprecated, public, with a comment."""
    f = decls.where(F.col("kind").isin("Function", "Method"))
    return f.agg(F.count("*").alias("functions"), F.count_if("is_test").alias("tests"), F.count_if("is_deprecated").alias("deprecated"), F.count_if(F.col("visibility") == "Public").alias("public"), F.count_if(F.col("doc_comment").isNotNull()).alias("documented"))


def health_of(decls: DataFrame, path: str | None = None) -> dict:
    """All aggregates of the report over declarations whose path holds `path`, with the hottest files: a dict."""
    if path:
        decls = decls.where(F.contains("path", F.lit(path)))
    m = decls.where(F.col("kind").isin("Function", "Method") & F.col("cyclomatic").isNotNull())
    out = declaration_counts(decls).first().asDict() | health(m).first().asDict()
    return out | {"hottest_files": [r.asDict() for r in hottest_files(m.withColumnRenamed("path", "file")).collect()]}


def hottest_files(m: DataFrame, limit: int = 5, least: int = 2) -> DataFrame:
    g = m.groupBy("file").agg(F.count("*").alias("functions"), round1(F.avg("cyclomatic")).alias("avg_complexity"), F.max("cyclomatic").cast("long").alias("max_complexity"))
    return g.where(F.col("functions") >= least).orderBy(F.desc("avg_complexity"), "file").limit(limit)
