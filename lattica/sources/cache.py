"""The index cache: what was extracted, by path, size and time, so that only changed files are parsed again.

A version is a folder of Parquet tables; a new one is written beside it and then named as the current one, so a table is
never overwritten while it is read, and a build that ends early leaves the old version in place.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extract, walk

VERSION = 1
_POINTER = "current.json"


def states(listed: DataFrame, cached: DataFrame) -> DataFrame:
    """path, state: hit (same size and time), miss, or pruned (no longer there)."""
    now = listed.select("path", F.col("size").alias("s"), F.col("mtime").alias("m"))
    j = now.join(cached.select("path", "size", "mtime"), "path", "full_outer")
    state = F.when(F.col("s").isNull(), "pruned").when((F.col("size") == F.col("s")) & (F.col("mtime") == F.col("m")), "hit").otherwise("miss")
    return j.select("path", state.alias("state"))


class Cache:
    """folder: shared, and the cache's own."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        try:
            with open(os.path.join(folder, _POINTER), encoding="utf-8") as f:
                p = json.load(f)
            self.current = p["name"] if p.get("version") == VERSION and os.path.isdir(os.path.join(folder, p["name"])) else None
        except (OSError, ValueError, KeyError):
            self.current = None  # corrupt, of another version or not there: empty

    def table(self, name: str, schema: str) -> DataFrame:
        if self.current is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(os.path.join(self.folder, self.current, name))

    def tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.table("files", FILES), self.table("decls", extract.DECLS), self.table("imports", "path string, import_ord int, text string")

    def refresh(self, root: str, **options) -> dict[str, int]:
        """Brings the cache up to date with the tree: {hit, miss, pruned}. Without changes nothing is written."""
        listed = walk.files(self.spark, root, **options).drop("path_parts")
        files, decls, imports = self.tables()
        s = states(listed, files)
        counts = {"hit": 0, "miss": 0, "pruned": 0} | {r.state: r["count"] for r in s.groupBy("state").count().collect()}
        if not counts["miss"] and not counts["pruned"] and self.current:
            return counts
        fresh = listed.join(s.where("state = 'miss'"), "path", "left_semi")
        texts = walk.contents(fresh).join(listed.select("path", "size", "mtime"), "path").persist()
        kept = s.where("state = 'hit'").select("path")
        name = f"v-{uuid.uuid4().hex}"
        new = os.path.join(self.folder, name)
        from ..functions.text import line_count

        known = lambda df: df.join(kept, "path", "left_semi")
        added = texts.select("path", "language", "size", "mtime", line_count(F.col("text")).alias("lines"), F.xxhash64("text").alias("content_hash"))
        known(files).unionByName(added).write.parquet(f"{new}/files")
        known(decls).unionByName(extract.declarations(texts)).write.parquet(f"{new}/decls")
        known(imports).unionByName(extract.imports(texts)).write.parquet(f"{new}/imports")
        texts.unpersist()
        old, self.current = self.current, name
        with open(os.path.join(self.folder, f"{_POINTER}.{name}"), "w", encoding="utf-8") as f:
            json.dump({"version": VERSION, "name": name}, f)
        os.replace(os.path.join(self.folder, f"{_POINTER}.{name}"), os.path.join(self.folder, _POINTER))
        if old:
            shutil.rmtree(os.path.join(self.folder, old), ignore_errors=True)
        return counts


FILES = "path string, language string, size long, mtime long, lines long, content_hash long"
