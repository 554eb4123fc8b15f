"""The corpus pipeline: quality, near duplicates, benchmark leaks, secrets, packing; each stage on all its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import ballhash, cotrain, secrets, tiling
from lattica.llm.common import written
from lattica.llm.queries import pack_documents
from lattica.session import ship

#: The name of a row's identity within near_duplicates.
ROW = "_near_duplicates_row"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects (poor or toxic) go.

    Null text is scored as empty, null metadata is a value of its own. Equal rows fare alike; rows are judged by
    themselves, whatever their doc_id. Without labels, or of an empty table, nothing is rejected.
    """
    ship(spark)
    model = cotrain.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keep = cotrain.score(model, F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars"))["keep"]
    return docs.where(keep)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exactly one row of each component of near duplicates stays: that with the least (doc_id, hash of text), nulls last.

    Linked are rows of which the fingerprints of their different words differ in at most 6 of 64 bits (copies with some
    words replaced differ less in these than in pairs of words). Null and wordless texts are all one component; an empty
    table has none.

    Decided by rows: a doc_id may stand for several texts, and rows may be equal or without a doc_id.
    """
    rows = written(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    found = ballhash.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), unit="words").select(F.col("doc_id").alias(ROW), F.col("component_id").alias("component"))
    order = rows.select(ROW, F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("text"), ROW).alias("rank"))
    first = found.join(order, ROW).groupBy("component").agg(F.min("rank").alias("rank")).select(F.col(f"rank.{ROW}").alias(ROW))
    return rows.join(first, ROW, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose string tiles cover half of a benchmark item or more.

    Null and empty texts stay, and all rows where the benchmark is empty. Equal rows fare alike; other columns, whatever
    their names, are left as they are.
    """
    ship(spark)
    return docs.where(~tiling.is_contaminated(F.col("text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and weak parts linked to them, are replaced in the text; n_chars follows. No document goes.

    Null text stays null and keeps its n_chars. Equal rows fare alike. Empty table: no rows.
    """
    ship(spark)
    out = docs.withColumn("text", secrets.redacted(F.col("text")))
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text"))
    return out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 2048: a row a piece.

    Null text: as empty (the closing token alone). Null, repeated and equal rows are documents of their own; ties in
    length are packed in the order of doc_id and then of tokens. Empty table: no rows.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("secrets", scan_secrets),
    ("packing", pack),
]

#: No stage's model, fingerprint or tokenizer can be written in SQL: run() is held against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
