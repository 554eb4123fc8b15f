"""Tree-preserving filters on declarations in pre-order: (member, path, decl_ord, subtree_end, ...).

"Has a matching descendant" and "is below a match" are running values over a file's declarations in order: one sort by
(member, path, decl_ord), no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

_KEYS = ["member", "path"]


def _known() -> Column:
    return F.col("member").isNotNull() & F.col("path").isNotNull() & F.col("decl_ord").isNotNull()


def _holds(match: Column) -> Column:
    """Whether a match lies from the row to its subtree's end: the next match is the nearest."""
    later = Window.partitionBy(*_KEYS).orderBy(F.col("decl_ord").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(_known() & (F.min(F.when(match, F.col("decl_ord"))).over(later) <= F.col("subtree_end")), F.lit(False))


def _below(match: Column) -> Column:
    """Whether the row lies from a match to the end of its subtree: the farthest end of those before decides."""
    before = Window.partitionBy(*_KEYS).orderBy("decl_ord").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.coalesce(_known() & (F.max(F.when(match & F.col("decl_ord").isNotNull(), F.col("subtree_end"))).over(before) >= F.col("decl_ord")), F.lit(False))


def _where(decls: DataFrame, keep: Column) -> DataFrame:
    return decls.withColumn("_keep", keep).where("_keep").drop("_keep")


def with_ancestors(decls: DataFrame, match: Column) -> DataFrame:
    """Matches and all that contain one."""
    return _where(decls, _holds(match))


def with_descendants(decls: DataFrame, match: Column) -> DataFrame:
    """Matches and all below one."""
    return _where(decls, _below(match))


def without_subtrees(decls: DataFrame, match: Column) -> DataFrame:
    """Neither matches nor anything below one."""
    return _where(decls, ~_below(match))


def by_kind(decls: DataFrame, kinds: list[str]) -> DataFrame:
    return with_ancestors(decls, F.col("kind").isin(kinds))


def public_only(decls: DataFrame) -> DataFrame:
    return without_subtrees(decls, F.col("visibility") == "Private")


def by_symbol(decls: DataFrame, name: str) -> DataFrame:
    """Matches with all above and below."""
    match = F.contains(F.lower("name"), F.lit(name.lower()))
    return _where(decls, _holds(match) | _below(match))


def filter_index(files: DataFrame, decls: DataFrame, imports: DataFrame, path: str | None = None, kinds: list[str] | None = None, public: bool = False, symbol: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, decls, imports) that pass, in the order path, kind, public, symbol. Files in which a kind, public or symbol
    filter leaves no declaration go with their imports."""
    if path:
        files, decls, imports = (x.where(X.under(F.col("path"), path)) for x in (files, decls, imports))
    kept = decls
    if kinds:
        kept = by_kind(kept, kinds)
    if public:
        kept = public_only(kept)
    if symbol:
        kept = by_symbol(kept, symbol)
    if kinds or public or symbol:
        some = kept.select(*_KEYS).distinct()
        files, imports = (x.join(some, _KEYS, "left_semi") for x in (files, imports))
    return files, kept, imports


def stats(files: DataFrame) -> DataFrame:
    """A row for each member and language and for the totals (null): files, lines."""
    return files.rollup("member", "language").agg(F.count("*").alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def tree_entries(files: DataFrame) -> DataFrame:
    """(member, path, name, is_dir, depth): files and the folders above them, once each."""
    parts = F.split("path", "/")
    above = F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i < F.size(parts), F.array_join(F.slice(parts, F.lit(1), i), "/"))), lambda x: x.isNotNull())
    folders = files.select("member", F.explode(above).alias("path"), F.lit(True).alias("is_dir")).distinct()
    both = folders.unionByName(files.select("member", "path", F.lit(False).alias("is_dir")))
    return both.select("member", "path", F.substring_index("path", "/", -1).alias("name"), "is_dir", F.size(F.split("path", "/")).alias("depth"))


def tree(files: DataFrame, prefix: str | None = None) -> DataFrame:
    """The entries below the prefix, and the folders above it."""
    t = tree_entries(files)
    if not prefix:
        return t
    prefix = prefix.rstrip("/")
    return t.where(X.under(F.col("path"), prefix) | F.startswith(F.lit(prefix + "/"), F.concat("path", F.lit("/"))))
