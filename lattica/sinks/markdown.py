"""An index as Markdown: header, folders, public surface, a section for each file. Lines are made by expressions over the
tables; the driver only puts them one after another."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.trees import tree_entries
from .rows import lines

DETAILS = ("summary", "signatures", "full")
#: A file's section lists so many imports and says how many more there are.
IMPORTS = 10


def size_text(size: Column) -> Column:
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1 << 20, F.format_string("%.1f KB", size / 1024)).otherwise(F.format_string("%.1f MB", size / (1 << 20)))


def header(name: str, files: DataFrame, generated_at: str) -> list[str]:
    by = files.groupBy("language").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).collect()  # a row for each language
    langs = ", ".join(f"{r.language} ({r.n})" for r in sorted(by, key=lambda r: (-r.n, r.language)))
    return [f"# Index of {name}", "", f"> {generated_at} | {sum(r.n for r in by)} files | {sum(r.lines or 0 for r in by)} lines", f"> {langs}", ""]


def folder_lines(files: DataFrame) -> DataFrame:
    """(member, parts, line): the tree, indented by depth."""
    t = tree_entries(files)
    return t.select("member", F.split("path", "/").alias("parts"), F.concat(F.repeat(F.lit("  "), F.col("depth")), "name", F.when(F.col("is_dir"), "/").otherwise("")).alias("line"))


def surface_lines(decls: DataFrame) -> DataFrame:
    """(member, parts, line_no, line): public declarations, of several at one line of a file the first."""
    d = decls.where("visibility = 'Public'").groupBy("member", "path", "line").agg(F.min_by(F.struct("signature", "kind"), "decl_ord").alias("d"))
    return d.select("member", F.split("path", "/").alias("parts"), F.col("line").alias("line_no"), F.concat(F.lit("- `"), "d.signature", F.lit("` ("), "path", F.lit(":"), "line", F.lit(")")).alias("line"))


def declaration_line(detail: str) -> Column:
    badge = lambda c, text: F.when(F.col(c), text).otherwise("")
    sign = F.concat(F.when(F.col("visibility") == "Public", "pub ").otherwise(""), F.lit("`"), "signature", F.lit("`"))
    out = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), sign, F.lit(" (line "), "line", F.lit(")"), badge("is_test", " [test]"), badge("is_deprecated", " [deprecated]"))
    if detail == "full":
        rel = F.when(F.size("relationships") > 0, F.concat(F.lit(" — "), F.array_join("relationships", ", "))).otherwise("")
        doc = F.when(F.col("doc_comment").isNotNull(), F.concat(F.lit("\n"), F.repeat(F.lit("  "), F.col("depth") + 1), F.lit("> "), F.regexp_replace("doc_comment", "\n", " "))).otherwise("")
        out = F.concat(out, rel, doc)
    return out


def file_lines(files: DataFrame, decls: DataFrame, imports: DataFrame, detail: str = "signatures") -> DataFrame:
    """(member, parts, part, ord, line): each file's heading (0), imports (1) and, but for the summary, declarations (2)."""
    if detail not in DETAILS:
        raise ValueError(f"detail must be one of {DETAILS}")
    where = ["member", F.split("path", "/").alias("parts")]
    out = files.select(*where, F.lit(0).alias("part"), F.lit(0).cast("long").alias("ord"), F.concat(F.lit("\n## "), "path", F.lit("\n\n"), "language", F.lit(", "), size_text(F.col("size")), F.lit(", "), "lines", F.lit(" lines\n")).alias("line"))
    if detail == "summary":
        return out
    n = imports.groupBy("member", "path").agg(F.count("*").alias("n")).where(F.col("n") > IMPORTS)
    more = n.select(*where, F.lit(1), F.lit(IMPORTS).cast("long"), F.concat(F.lit("- and "), F.col("n") - IMPORTS, F.lit(" more imports")))
    first = imports.where(F.col("import_ord") < IMPORTS).select(*where, F.lit(1), F.col("import_ord").cast("long"), F.concat(F.lit("- imports `"), "text", F.lit("`")))
    return out.union(first).union(more).union(decls.select(*where, F.lit(2), F.col("decl_ord").cast("long"), declaration_line(detail)))


def index(name: str, files: DataFrame, decls: DataFrame, imports: DataFrame, generated_at: str = "", detail: str = "signatures") -> Iterator[str]:
    """The lines of the whole document."""
    yield from header(name, files, generated_at)
    yield from ["## Folders", "", "```", f"{name}/"]
    yield from lines(folder_lines(files), ["member", "parts"])
    yield from ["```", "", "## Public surface", ""]
    yield from lines(surface_lines(decls), ["member", "parts", "line_no"])
    yield from lines(file_lines(files, decls, imports, detail), ["member", "parts", "part", "ord"])


def workspace(name: str, files: DataFrame, decls: DataFrame, imports: DataFrame, generated_at: str = "", detail: str = "signatures") -> Iterator[str]:
    """A table of members and an index of each; a single member's index is plain."""
    members = [r for r in files.groupBy("member").agg(F.count("*").alias("n"), F.sum("lines").alias("lines")).orderBy("member").collect()]
    if len(members) < 2:
        yield from index(name, files, decls, imports, generated_at, detail)
        return
    yield from [f"# Workspace {name}", "", "| Member | Files | Lines |", "| --- | --- | --- |"]
    yield from (f"| {r.member} | {r.n} | {r.lines} |" for r in members)
    for r in members:
        yield ""
        own = lambda df, m=r.member: df.where(F.col("member") == m)
        yield from index(r.member, own(files), own(decls), own(imports), generated_at, detail)
