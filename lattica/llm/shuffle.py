"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Input partitions are the rows of the matrix, parts of shards its columns; how many rows go from one to another is
drawn from the multivariate hypergeometric law with the exact row and column sums, the law that a uniform permutation
of all rows has. The matrix is never built: a task finds its own row by descending a binary tree over the input
partitions, whose nodes draw with seeds of their own. The task permutes its rows locally, they are exchanged, and
each part is permuted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import partitions, written

#: File names of at most so many bytes are broadcast.
NAMES = 64 << 20
#: An input partition is a run of at most 2^BLOCK rows of a file, so a task's permutation stays small in a large file.
BLOCK = 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement are good. Above numpy's limit of 10^9: ratio of uniforms (HRUA)."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n and good and bad else (n if not bad else 0)
    total = good + bad
    small, m = min(good, bad), min(n, total - n)
    if not small or not m:
        z = 0
    else:
        large = total - small
        mean = m * small / total
        var = mean * (large / total) * (total - m) / (total - 1)
        a, c = mean + 0.5, sqrt(var + 0.5)
        h = 1.7155277699214135 * c + 0.8989161620588988
        mode = (m + 1) * (small + 1) // (total + 2)
        f = lambda k: lgamma(k + 1) + lgamma(small - k + 1) + lgamma(m - k + 1) + lgamma(large - m + k + 1)
        g, top = f(mode), min(min(m, small) + 1, int(a + 16 * c))
        low = max(0, m - large)
        while True:
            u, v = 1 - rng.random(), rng.random()
            w = a + h * (v - 0.5) / u
            if w < low or w >= top:
                continue
            z = int(w)
            if 2 * log(u) <= g - f(z):
                break
    if good > bad:
        z = m - z
    return good - z if m < n else z


def draw(rng: np.random.Generator, columns: np.ndarray, n: int) -> np.ndarray:
    """Multivariate hypergeometric: n draws from columns of these sizes."""
    if columns.sum() < 1_000_000_000:
        return rng.multivariate_hypergeometric(columns, n, method="marginals")
    out, rest = np.zeros_like(columns), int(columns.sum())
    for i, c in enumerate(columns):
        rest -= int(c)
        out[i] = hypergeometric(rng, int(c), rest, n)
        n -= int(out[i])
    return out


def matrix_row(p: int, before: np.ndarray, columns: np.ndarray, seed: int) -> np.ndarray:
    """Row p of the matrix; before: the rows before each input partition, and of all."""
    lo, hi, cols = 0, len(before) - 1, columns.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = draw(np.random.default_rng([seed, lo, hi]), cols, int(before[mid] - before[lo]))
        if p < mid:
            hi, cols = mid, left
        else:
            lo, cols = mid, cols - left
    return cols


def _even(total: int, parts: int) -> np.ndarray:
    return total // parts + (np.arange(parts) < total % parts)


def _identified(df: DataFrame) -> DataFrame | None:
    """The rows with their file and place in it, which stay the same however the files are split into tasks."""
    try:
        return df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return None


def shuffled(df: DataFrame, shards: int = 8, seed: int = 42) -> DataFrame:
    """All rows and columns of df, with shard int (0..shards-1) and slot long (gapless from 0 in its shard).

    Every order of all rows is equally likely; shard sizes differ by one row at most. A column of df named shard or
    slot is replaced. Nulls, empty texts and repeated rows are rows like any others. Empty table: no rows.

    A shard is exchanged in several parts of exact size, so that it isn't one task's work. df is read twice; unless
    its rows are those of Parquet files as they stand, it is written to the shared folder first.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")

    def counted(x: DataFrame):
        return x.groupBy("__file").agg(F.count("*").alias("n"), F.max("__row").alias("top")).orderBy("__file").collect()

    rows = _identified(df)
    files = counted(rows) if rows is not None else []
    if rows is None or any(f.top + 1 != f.n for f in files):
        rows = _identified(written(df, "rows"))
        files = counted(rows)
    total = sum(f.n for f in files)
    each = max(1, -(-partitions(spark) // shards))
    sizes = _even(total, shards)
    columns = np.concatenate([_even(int(s), each) for s in sizes])
    parts = [-(-f.n // (1 << BLOCK)) for f in files]
    first = np.r_[0, np.cumsum(parts, dtype=np.int64)]
    runs = [min(1 << BLOCK, f.n - at) for f in files for at in range(0, f.n, 1 << BLOCK)]
    before = np.r_[0, np.cumsum(runs, dtype=np.int64)]
    known = spark.sparkContext.broadcast(before)
    names = spark.createDataFrame([(f["__file"], int(i)) for i, f in zip(first, files)], "__file string, __first long")
    if sum(len(f["__file"]) + 32 for f in files) <= NAMES:  # else the join is a shuffle by file
        names = F.broadcast(names)

    number, within = F.col("__first") + F.shiftright("__row", BLOCK), F.col("__row") % (1 << BLOCK)

    @F.pandas_udf("int")
    def part(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        permuted: dict[int, np.ndarray] = {}
        for ps, rs in batches:
            p, r, out = ps.to_numpy(), rs.to_numpy(), np.empty(len(ps), np.int32)
            for x in np.unique(p):
                if x not in permuted:
                    permuted.clear()
                    row = matrix_row(int(x), known.value, columns, seed)
                    permuted[x] = np.random.default_rng([seed, int(x)]).permutation(np.repeat(np.arange(len(columns), dtype=np.int32), row))
                out[p == x] = permuted[x][r[p == x]]
            yield pd.Series(out)

    sent = rows.join(names, "__file").withColumn("__p", number).withColumn("__row", within).withColumn("__part", part("__p", "__row")).withColumn("__key", F.xxhash64(F.lit(seed), "__p", "__row"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("__key", "__p", "__row")) - 1
    shard, sub = F.floor(F.col("__part") / each).cast("int"), F.col("__part") % each
    size = F.lit(total // shards) + (F.col("shard") < total % shards).cast("long")
    q, r = F.floor(size / each), size % each
    out = sent.withColumn("__place", place).withColumn("shard", shard).withColumn("slot", (sub * q + F.least(sub.cast("long"), r) + F.col("__place")).cast("long"))
    return out.select(*[f"`{c}`" for c in df.columns], "shard", "slot")
