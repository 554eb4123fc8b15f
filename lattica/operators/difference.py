"""Structural differences of two snapshots, and first or last wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def structural_diff(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, change (added, removed, modified), old_value, new_value of what differs."""
    o = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("in_old"))
    n = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("in_new"))
    j = o.join(n, keys, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "modified")
    return j.withColumn("change", change).where("change is not null").select(*keys, "change", "old_value", "new_value")


def flattened(decls: DataFrame) -> DataFrame:
    """(path, kind, name, signature) of the top level and its children; of equal keys the last counts."""
    return decls.where("depth <= 1").groupBy("path", "kind", "name").agg(F.max_by("signature", "decl_ord").alias("signature"))


def declaration_diff(old: DataFrame, new: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """Two tables of declarations -> (path, file_change, kind, name, change, old_value, new_value), of the changed paths
    only if they are given. file_change: added, removed or modified; files without a changed declaration have no row."""
    if changed is not None:
        old, new = (x.join(changed.select("path").distinct(), "path", "left_semi") for x in (old, new))
    keys = ["path", "kind", "name"]
    side = lambda df, new: df.select(*keys, "signature", "decl_ord", (F.col("depth") <= 1).alias("flat"), F.lit(new).alias("new"))
    # one grouping of both tables in place of joins; null keys equal nothing, so those of either side stay apart
    lone = F.when(F.col("path").isNull() | F.col("kind").isNull() | F.col("name").isNull(), F.col("new"))
    last = lambda at: F.max_by(F.when(at, F.col("signature")), F.when(at, F.col("decl_ord")))
    of_old, of_new = ~F.col("new"), F.col("new")
    d = side(old, False).unionByName(side(new, True)).groupBy(*keys, lone.alias("lone")).agg(
        last(F.col("flat") & of_old).alias("old_value"), last(F.col("flat") & of_new).alias("new_value"),
        F.coalesce(F.bool_or(F.col("flat") & of_old), F.lit(False)).alias("in_old"), F.coalesce(F.bool_or(F.col("flat") & of_new), F.lit(False)).alias("in_new"),
        F.bool_or(of_old).alias("was"), F.bool_or(of_new).alias("is"),
    )
    file = Window.partitionBy("path")
    d = d.withColumn("was", F.max("was").over(file)).withColumn("is", F.max("is").over(file))
    state = F.when(F.col("path").isNull() | ~F.col("was"), "added").when(~F.col("is"), "removed").otherwise("modified")
    change = F.when(~F.col("in_old"), "added").when(~F.col("in_new"), "removed").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "modified")
    d = d.where("in_old or in_new").withColumn("file_change", state).withColumn("change", change).where("change is not null")
    return d.select("path", "file_change", "kind", "name", "change", "old_value", "new_value")


def in_order(diff: DataFrame) -> DataFrame:
    """Files by components, declarations by name and then kind."""
    return diff.orderBy(F.split("path", "/"), "name", "kind")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; as an aggregate, so a key's rows aren't gathered in one task."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
    best = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_row._{rest.index(c)}").alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def snapshot_delta(old_files: DataFrame, new_files: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """What a rebuild of an index changed: declaration_diff over all paths of either."""
    paths = old_files.select("path").unionByName(new_files.select("path")).distinct()
    return declaration_diff(old, new, paths)


def numbered_within(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
