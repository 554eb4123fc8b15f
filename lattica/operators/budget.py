"""The token budget: a rewrite of an index in stages, each a lazy change of the stage before, until the estimate fits.

The driver only sees one estimate for each stage. An index is (files, decls, imports, tree): files (member, path,
lines), decls in pre-order (see trees), imports (member, path, import_ord, text), tree (path, depth).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import short_doc, token_estimate
from . import trees
from .order import running

_KEYS = ["member", "path"]
_ENTRY = {
    100: [f"main.{e}" for e in ("rs", "py", "go", "ts", "js", "java")] + [f"index.{e}" for e in ("ts", "js", "tsx", "jsx")],
    90: ["lib.rs", "lib.py"],
    50: ["mod.rs", "__init__.py", "mod.ts"],
}


@dataclass
class Index:
    name: str
    files: DataFrame
    decls: DataFrame
    imports: DataFrame
    tree: DataFrame


def declaration_tokens(comment: Column | None = None) -> Column:
    """Of one declaration: signature, comment, line and relationships, with the marks around them."""
    rels = F.aggregate(F.coalesce("relationships", F.array().cast("array<string>")), F.lit(0).cast("long"), lambda n, r: n + 3 + token_estimate(F.regexp_replace(r, "^[^ ]* ", "")))
    comment = F.col("doc_comment") if comment is None else comment
    doc = F.when(comment.isNull(), 0).otherwise(2 + token_estimate(comment))
    return (3 + token_estimate(F.col("signature")) + doc + F.when(F.col("line") > 0, 5).otherwise(0) + rels).cast("long")


def file_tokens(files: DataFrame, decls: DataFrame, imports: DataFrame) -> DataFrame:
    """files -> (member, path, tokens): its section's header, imports and declarations."""
    return _file_tokens(files, decls, imports, {"tokens": F.col("doc_comment")})


def _file_tokens(files: DataFrame, decls: DataFrame, imports: DataFrame, comments: dict[str, Column]) -> DataFrame:
    """The tokens with each choice of comments, by its name."""
    of_import = (3 + token_estimate(F.col("text"))).cast("long")
    parts = decls.select(*_KEYS, *[declaration_tokens(c).alias(n) for n, c in comments.items()]).unionByName(imports.select(*_KEYS, *[of_import.alias(n) for n in comments]))
    sums = parts.groupBy(*_KEYS).agg(*[F.sum(n).alias(n) for n in comments])
    return files.select(*_KEYS).join(sums, _KEYS, "left").select(*_KEYS, *[(15 + token_estimate(F.col("path")) + F.coalesce(n, F.lit(0))).cast("long").alias(n) for n in comments])


def index_tokens(ix: Index) -> int:
    """Of the whole index: header, tree and file sections."""
    return _totals(ix, [F.col("doc_comment")])[0]


def _totals(ix: Index, comments: list[Column]) -> list[int]:
    """index_tokens with each choice of comments, in one reading."""
    named = {f"t{i}": c for i, c in enumerate(comments)}
    head = 20 + -(-len(ix.name.encode()) // 4) + 30 + 10 + 15
    one = token_estimate(F.col("name")) + F.col("depth") + 1
    tree = ix.tree.agg(F.coalesce(F.sum(one), F.lit(0)).alias("t")).select(*[F.col("t").alias(n) for n in named])
    files = _file_tokens(ix.files, ix.decls, ix.imports, named).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in named])
    rows = tree.unionByName(files).collect()
    return [head + sum(r[n] for r in rows) for n in named]


def importance(files: DataFrame, decls: DataFrame) -> DataFrame:
    """files -> (member, path, importance): entry files most, then by depth, public declarations and length."""
    public = decls.where("visibility = 'Public'").groupBy(*_KEYS).agg(F.count("*").alias("public"))
    name = F.substring_index("path", "/", -1)
    entry = F.lit(0)
    for points, names in _ENTRY.items():
        entry = F.when(name.isin(names), points).otherwise(entry)
    depth = F.size(F.split("path", "/")) - 1
    score = entry - 5 * depth + 3 * F.coalesce("public", F.lit(0)) - F.floor(F.col("lines") / 100)
    return files.select(*_KEYS, "lines").join(public, _KEYS, "left").select(*_KEYS, score.cast("long").alias("importance"))


def without_least(files: DataFrame, decls: DataFrame, imports: DataFrame, over: int) -> DataFrame:
    """The files that stay when the least important go, ties by path, until `over` tokens are gone; one always stays."""
    f = file_tokens(files, decls, imports).join(importance(files, decls), _KEYS).withColumn("one", F.lit(1))
    f = running(f, ["one"], [F.col("importance"), F.split("path", "/"), F.col("member")], "tokens", "before", "all")
    top = f.agg(F.max(F.struct("importance", F.split("path", "/").alias("parts"), "member", "path")).alias("last"))
    kept = f.where(F.col("before") >= over).select(*_KEYS)
    return files.join(kept.unionByName(top.select("last.member", "last.path")).distinct(), _KEYS, "left_semi")


def shortened(ix: Index) -> Index:
    """Stage 1: long comments as their first line."""
    return replace(ix, decls=ix.decls.withColumn("doc_comment", short_doc(F.col("doc_comment"))))


def undocumented(ix: Index) -> Index:
    """Stage 2: no comments."""
    return replace(ix, decls=ix.decls.withColumn("doc_comment", F.lit(None).cast("string")))


def without_private(ix: Index) -> Index:
    """Stage 3: no private declarations with what is below them, nor files left with nothing."""
    decls = trees.public_only(ix.decls)
    some = decls.select(*_KEYS).unionByName(ix.imports.select(*_KEYS)).distinct()
    return replace(ix, decls=decls, files=ix.files.join(some, _KEYS, "left_semi"))


def flat(ix: Index) -> Index:
    """Stage 4: top-level declarations only."""
    return replace(ix, decls=ix.decls.where("depth = 0"))


def fitted(ix: Index, most: int) -> tuple[Index, int]:
    """The index at the first stage of which the estimate is at most `most`, and that stage (0: as it was; 5: the least
    important files went, which may still not suffice). What a dropped empty file's header cost isn't given back."""
    doc = F.col("doc_comment")
    totals = _totals(ix, [doc, short_doc(doc), F.lit(None).cast("string")])  # the first stages only change comments
    if totals[0] <= most:
        return ix, 0
    kept_files = ix.files
    for k, stage in enumerate((shortened, undocumented, without_private, flat), 1):
        ix = stage(ix)
        total = totals[k] if k < len(totals) else index_tokens(replace(ix, files=kept_files))
        if total <= most:
            return ix, k
    files = without_least(ix.files, ix.decls, ix.imports, total - most)
    decls, imports = (x.join(files.select(*_KEYS), _KEYS, "left_semi") for x in (ix.decls, ix.imports))
    return replace(ix, files=files, decls=decls, imports=imports), 5
