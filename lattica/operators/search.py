"""Lookups over files and declarations; every limit stands above a total order (path components, decl_ord)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

_KEYS = ["member", "path"]


def _order(df: DataFrame, *more: str) -> list[Column]:
    return [*([F.col("member")] if "member" in df.columns else []), F.split("path", "/"), *map(F.col, more)]


def _ordered(decls: DataFrame, match: Column, limit: int | None) -> DataFrame:
    out = decls.where(match)
    return out if limit is None else out.orderBy(*_order(out, "decl_ord")).limit(limit)


# finding


def lookup_symbol(decls: DataFrame, name: str, limit: int = 50) -> DataFrame:
    """By a part of the name, whatever its case."""
    return _ordered(decls, F.contains(F.lower("name"), F.lit(name.lower())), min(limit, 200))


def search_signatures(decls: DataFrame, query: str, limit: int = 20) -> DataFrame:
    return _ordered(decls, F.contains(F.lower("signature"), F.lit(query.lower())), min(limit, 100))


def find_declaration(decls: DataFrame, name: str) -> DataFrame:
    """The first of this name in each file, whatever its case."""
    found = decls.where(F.lower("name") == name.lower())
    keys = [c for c in _KEYS if c in decls.columns]
    first = found.groupBy(*keys).agg(F.min("decl_ord").alias("decl_ord"))
    return found.join(first, [*keys, "decl_ord"], "left_semi")


def explain_symbol(decls: DataFrame, name: str) -> DataFrame:
    """At most ten of this name, whatever its case, with how many children of each kind they have."""
    top = _ordered(decls, F.lower("name") == name.lower(), 10)
    keys = [c for c in _KEYS if c in decls.columns]
    kinds = decls.where("parent_ord is not null").join(top.select(*keys, F.col("decl_ord").alias("parent_ord")), [*keys, "parent_ord"], "left_semi")
    kinds = kinds.groupBy(*keys, "parent_ord", "kind").agg(F.count("*").alias("n")).groupBy(*keys, F.col("parent_ord").alias("decl_ord")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("children"))
    return top.join(kinds, [*keys, "decl_ord"], "left")


def public_api(decls: DataFrame, path: str = "", limit: int = 100) -> DataFrame:
    """Public at any depth, below paths that begin so."""
    return _ordered(decls, (F.col("visibility") == "Public") & F.startswith("path", F.lit(path)), min(limit, 500))


def list_declarations(decls: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """Of a file: its top level or, with a kind, all of that kind."""
    return _ordered(decls, (F.col("path") == path) & (F.col("kind") == kind if kind else F.col("depth") == 0), None)


def shallow(decls: DataFrame, some: DataFrame | None = None) -> DataFrame:
    """kind, name, signature, line and how many children (null: none), of `some` of the declarations."""
    some = decls if some is None else some
    keys = [c for c in _KEYS if c in decls.columns]
    n = decls.where("parent_ord is not null").groupBy(*keys, F.col("parent_ord").alias("decl_ord")).agg(F.count("*").alias("children"))
    return some.join(n, [*keys, "decl_ord"], "left").select(*keys, "decl_ord", "kind", "name", "signature", "line", "children")


def compact(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row as a JSON array of these columns; one that isn't there is null."""
    values = [F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"^\{\"v\":(?s:(.*))\}$", 1), F.lit("")) if c in df.columns else F.lit("null") for c in columns]
    values = [F.when(v == "", "null").otherwise(v) for v in values]
    return df.withColumn("compact", F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")))


def callers(decls: DataFrame, imports: DataFrame, symbol: str, limit: int = 20) -> DataFrame:
    """path, source (import, signature), line, text where the symbol stands as a word; imports first in each file."""
    a = imports.where(X.has_word(F.col("text"), symbol)).select("path", F.lit("import").alias("source"), F.lit(None).cast("int").alias("line"), "text", F.col("import_ord").alias("o"))
    b = decls.where(X.has_word(F.col("signature"), symbol) & (F.col("name") != symbol)).select("path", F.lit("signature").alias("source"), "line", F.col("signature").alias("text"), F.col("decl_ord").alias("o"))
    return a.unionByName(b).orderBy(F.split("path", "/"), "source", "o").limit(min(limit, 50)).drop("o")


def search_relevant(decls: DataFrame, files: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """path, name, score: three times the name's score, twice the signature's, the comment's, five more if public."""
    q = query.lower()
    s = 3 * X.score_match(F.lower("name"), q) + 2 * X.score_match(F.lower("signature"), q) + X.score_match(F.lower(F.coalesce("doc_comment", F.lit(""))), q)
    d = decls.where(F.col("kind") == kind) if kind else decls
    d = d.withColumn("score", s).withColumn("score", F.when((F.col("score") > 0) & (F.col("visibility") == "Public"), F.col("score") + 5).otherwise(F.col("score"))).select("path", "name", "score", F.lit(1).alias("d"), "decl_ord")
    if kind is None:
        d = files.select("path", F.lit(None).cast("string").alias("name"), (3 * X.score_match(F.lower("path"), q)).alias("score"), F.lit(0).alias("d"), F.lit(-1).alias("decl_ord")).unionByName(d)
    return d.where("score > 0").orderBy(F.desc("score"), F.split("path", "/"), "d", "decl_ord").limit(min(limit, 50)).select("path", "name", "score")


def related_tests(decls: DataFrame, symbol: str, path: str | None = None) -> DataFrame:
    """Tests that name the symbol: those of the file first, then by why they count."""
    name = F.substring_index("path", "/", -1)
    reason = F.when(F.col("path") == path, "same_file").when(F.contains(name, F.lit("test")) | F.contains(name, F.lit("spec")), "test_file").otherwise("name_convention")
    d = decls.where(F.col("is_test") & F.contains(F.lower("name"), F.lit(symbol.lower()))).withColumn("reason", reason)
    return d.orderBy(F.col("reason") != "same_file", F.split("path", "/"), "decl_ord").limit(20).select("path", "name", "line", "reason")


# files


def find_file(files: DataFrame, path: str) -> DataFrame:
    """The first file, in order, that is the path or ends with /path."""
    hit = (F.col("path") == path) | F.endswith("path", F.lit("/" + path))
    return files.where(hit).orderBy(*_order(files)).limit(1)


def find_member(files: DataFrame, path: str) -> DataFrame:
    """The one member that holds the path: whole if just one does, else as an end if just one does."""
    whole, end = F.col("path") == path, F.endswith("path", F.lit("/" + path))
    m = files.where(whole | end).groupBy("member").agg(F.max(whole).alias("whole"))
    n = m.agg(F.count_if("whole").alias("whole"), F.count("*").alias("any")).first()  # one row
    if n["whole"] == 1:
        return m.where("whole").select("member")
    return m.where(F.lit(n["whole"] == 0 and n["any"] == 1)).select("member")


def of_member(df: DataFrame, member: str | None) -> DataFrame:
    """The rows of a member, whatever its name's case; all without one. An unknown member is an error."""
    if member is None:
        return df
    out = df.where(F.lower("member") == member.lower())
    if out.isEmpty():
        raise ValueError(f"unknown member {member}")
    return out


_ENDINGS = re.compile(r"\.[A-Za-z][A-Za-z0-9]{0,9}$")


def looks_like_file(text: str) -> bool:
    """Whether it has the ending of a source file."""
    from ..sources.languages import detect

    return detect(text) is not None or bool(_ENDINGS.search(text.rsplit("/", 1)[-1])) and "/" in text


def is_directory(files: DataFrame, path: str) -> bool:
    return not files.where(F.startswith("path", F.lit(path.rstrip("/") + "/"))).isEmpty()


def members(files: DataFrame, decls: DataFrame) -> DataFrame:
    """member, files, lines, declarations."""
    d = decls.groupBy("member").agg(F.count("*").alias("declarations"))
    return files.groupBy("member").agg(F.count("*").alias("files"), F.sum("lines").alias("lines")).join(d, "member", "left").select("member", "files", "lines", F.coalesce("declarations", F.lit(0)).alias("declarations"))


def file_summaries(decls: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per file: declarations, public ones, whether it has tests, counts by kind (all depths). With files, also those
    that have none."""
    kinds = decls.groupBy("path", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("visibility") == "Public").alias("public"), F.max("is_test").alias("tests"))
    out = kinds.groupBy("path").agg(F.sum("n").alias("declarations"), F.sum("public").alias("public"), F.max("tests").alias("has_tests"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    if files is None:
        return out
    out = files.select("path", "language", "lines").join(out, "path", "left")
    return out.withColumns({"declarations": F.coalesce("declarations", F.lit(0)), "public": F.coalesce("public", F.lit(0)), "has_tests": F.coalesce("has_tests", F.lit(False))})


def batch_summaries(decls: DataFrame, files: DataFrame, paths: list[str] | None = None, glob: str | None = None, most: int = 30) -> tuple[DataFrame, int]:
    """(the summaries of the first `most` of the files asked for, how many were matched): paths in the order of asking,
    a glob's files in their own."""
    if paths is not None:
        asked = files.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(paths))), "ord int, path string")
        found = files.join(F.broadcast(asked), "path")
        order = [F.col("ord")]
    else:
        found, order = files.where(F.regexp_like("path", F.lit(X.glob_regex(glob or "**")))), [F.split("path", "/")]
    top = found.orderBy(*order).limit(min(most, 30))
    return file_summaries(decls.join(top.select("path"), "path", "left_semi"), top), found.count()


def imported_by(imports: DataFrame, path: str) -> DataFrame:
    """(file, import): the first import of each other file that holds the file's stem (of three letters or more), its
    path without ending or, for a folder's own file, the folder's name."""
    stem = path.rsplit("/", 1)[-1]
    stem = stem.rsplit(".", 1)[0] if "." in stem[1:] else stem
    no_ending = path[: path.rfind(stem) + len(stem)]
    wanted = [no_ending] + ([stem] if len(stem.encode()) >= 3 else [])
    if stem in ("mod", "index") and "/" in path:
        folder = path.split("/")[-2]
        wanted += [folder] if len(folder.encode()) >= 3 else []
    hit = F.lit(False)
    for w in wanted:
        hit = hit | F.contains("text", F.lit(w))
    return imports.where((F.col("path") != path) & hit).groupBy(F.col("path").alias("file")).agg(F.min_by("text", "import_ord").alias("import"))


def related_files(files: DataFrame, path: str, most: int = 10) -> DataFrame:
    """(file, relation): tests by their names, wherever they are, and the first of the files beside it."""
    name = path.rsplit("/", 1)[-1]
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    own = F.substring_index("path", "/", -1)
    test = F.lit(False)
    for p in (f"{stem}_test.", f"{stem}_spec.", f"test_{stem}.", f"{stem}.test.", f"{stem}.spec."):
        test = test | F.startswith(own, F.lit(p))
    others = files.where(F.col("path") != path)
    beside = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise("") == folder
    siblings = others.where(~test & beside).orderBy(F.split("path", "/")).limit(most)
    return others.where(test).select(F.col("path").alias("file"), F.lit("test").alias("relation")).unionByName(siblings.select(F.col("path").alias("file"), F.lit("sibling").alias("relation")))


# source text


def read_lines(contents: DataFrame, first: Column | int, last: Column | int, most: int = 200) -> DataFrame:
    """contents (path, text) with `source`: lines first to last, counted from 1, at most `most` of them."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    start = F.greatest(first, F.lit(1))
    n = F.least(F.greatest(last - start + 1, F.lit(0)), F.lit(most))
    return contents.withColumn("source", F.array_join(F.slice(F.split("text", "\n"), start, n), "\n"))


def read_symbols(contents: DataFrame, decls: DataFrame, names: list[str], each: int = 200, together: int = 500) -> DataFrame:
    """(path, name, line, source) of the first declaration of each name in each file, in the order of asking; lines are
    given out in that order until `together` are spent (a single name: at most `each`)."""
    asked = contents.sparkSession.createDataFrame([(i, n.lower()) for i, n in enumerate(dict.fromkeys(names))], "ord int, asked string")
    keys = [c for c in _KEYS if c in decls.columns and c in contents.columns]
    d = decls.join(F.broadcast(asked), F.lower("name") == F.col("asked"))
    d = d.groupBy(*keys, "ord").agg(F.min(F.struct("decl_ord", "name", "line", F.coalesce("body_lines", F.lit(0)).alias("body"))).alias("d")).select(*keys, "ord", "d.*")
    n = F.least(F.col("body") + 1, F.lit(each))
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # the names asked for in one file
    d = d.withColumn("n", n).withColumn("left", together - F.coalesce(F.sum("n").over(w), F.lit(0)))
    d = d.where("left > 0").withColumn("n", F.least("n", "left"))
    out = contents.select(*keys, "text").join(d, keys)
    return out.select(*keys, "ord", "name", "line", F.array_join(F.slice(F.split("text", "\n"), F.col("line"), F.col("n").cast("int")), "\n").alias("source"))


def token_estimates(files: DataFrame, directory: str | None = None, glob: str | None = None, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(one row: files, tokens, lines; the largest files) below what begins with `directory` or matches the glob."""
    if directory is not None:
        files = files.where(F.startswith("path", F.lit(directory)))
    if glob is not None:
        files = files.where(F.regexp_like("path", F.lit(X.glob_regex(glob))))
    f = files.select("path", "lines", F.ceil(F.col("size") / 4).cast("long").alias("tokens"))
    one = f.agg(F.count("*").alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))
    return one, f.orderBy(F.desc("tokens"), F.split("path", "/")).limit(most)


def symbol_tokens(contents: DataFrame, decls: DataFrame, name: str) -> DataFrame:
    """(path, file_tokens, symbol_tokens, saved_percent): what reading the symbol costs beside the whole file."""
    s = read_symbols(contents, decls, [name]).select("path", X.token_estimate(F.col("source")).alias("symbol_tokens"))
    c = contents.select("path", X.token_estimate(F.col("text")).alias("file_tokens")).join(s, "path")
    saved = F.floor(100 * F.greatest(F.col("file_tokens") - F.col("symbol_tokens"), F.lit(0)) / F.greatest("file_tokens", F.lit(1)))
    return c.select("path", "file_tokens", "symbol_tokens", saved.cast("int").alias("saved_percent"))
