"""What an index would hold, before anything costly is done with it: groups, largest files, suspicious folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .difference import first_wins

#: Folders that an index seldom wants, the first named counting.
SUSPICIOUS = tuple("node_modules vendor dist build coverage .next .turbo .yarn".split())
#: Folders of which the second level makes the groups.
TWO_LEVELS = tuple("config docs extensions migrations review-ui scripts src tests".split())


def group_key(path: Column, member: Column | None = None, deep: tuple[str, ...] = TWO_LEVELS) -> Column:
    """The member, else the first part of the path, with the second below the `deep` ones."""
    parts = F.split(path, "/")
    own = F.when((F.size(parts) > 1) & parts[0].isin(*deep), F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))).otherwise(parts[0])
    return own if member is None else F.coalesce(F.when(member != "", member), own)


def groups(files: DataFrame, key: Column) -> DataFrame:
    """grp, files, lines, bytes; the largest first."""
    g = files.groupBy(key.alias("grp")).agg(F.count("*").alias("files"), F.sum("lines").alias("lines"), F.sum("size").alias("bytes"))
    return g.orderBy(F.desc("files"), F.desc("lines"), "grp")


def largest_files(files: DataFrame, decls: DataFrame, most: int = 20) -> DataFrame:
    """path, lines, declarations, size; a path of several members is the first member's."""
    one = first_wins(files.select("path", "member", "lines", "size"), ["path"], ["member"])
    n = decls.groupBy("member", "path").agg(F.count("*").alias("declarations"))
    f = one.join(n, ["member", "path"], "left").select("path", "lines", F.coalesce("declarations", F.lit(0)).alias("declarations"), "size")
    return f.orderBy(F.desc("lines"), F.desc("declarations"), F.desc("size"), F.split("path", "/")).limit(most)


def suspicious(files: DataFrame, names: tuple[str, ...] = SUSPICIOUS, examples: int = 3) -> DataFrame:
    """flag, files, examples: files below folders of these names (of several, the first in `names`); the first paths."""
    parts = F.split("path", "/")
    flag = F.coalesce(*[F.when(F.array_contains(parts, n), n) for n in names])
    f = files.select("path", flag.alias("flag")).where("flag is not null")
    counts = f.groupBy("flag").agg(F.count("*").alias("files"))
    # the first few of each: a bounded minimum, one more each time, so that no folder's paths are gathered
    out, rest = counts, f.select("flag", F.struct(F.split("path", "/").alias("parts"), "path").alias("p"))
    for i in range(examples):
        least = rest.groupBy("flag").agg(F.min("p").alias(f"p{i}"))
        out = out.join(least, "flag", "left")
        rest = rest.join(F.broadcast(least), "flag").where(F.col("p") > F.col(f"p{i}")).select("flag", "p")
    return out.select("flag", "files", F.filter(F.array(*[F.col(f"p{i}.path") for i in range(examples)]), lambda x: x.isNotNull()).alias("examples"))


def owning_member(files: DataFrame, members: DataFrame) -> DataFrame:
    """files (path), members (member, root) -> path, member: that with the longest root above the path; null: none.

    An equi-join on the path's folders, so no pairs of files and members are tried."""
    parts = F.split("path", "/")
    up = files.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("root"))
    best = up.join(members.select("member", "root"), "root").groupBy("path").agg(F.max_by("member", F.length("root")).alias("member"))
    return files.join(best, "path", "left")
