"""Packing into sequences by first-fit decreasing, with a tournament tree of bin capacities.

Documents are put into random groups, each packed by itself in one task. A document's full sequences are cut off; what
is left over (shorter than a sequence) goes, longest first, into the first bin with room for it. The tree's leaves are
bins, each inner node holds the larger of its children's rooms, so the first bin with room is found in log2(bins)
steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, strings
from .tokens import encoder


class Tournament:
    """Bins of equal capacity, opened as they are needed."""

    def __init__(self, capacity: int, leaves: int):
        self.capacity, self.size = capacity, 1
        while self.size < max(1, leaves):
            self.size *= 2
        self.room = [capacity] * (2 * self.size)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, offset) in the first bin with room."""
        room, k = self.room, 1
        while k < self.size:
            k *= 2
            if room[k] < length:
                k += 1
        offset = self.capacity - room[k]
        room[k] -= length
        out = k - self.size
        k //= 2
        while k:
            top = max(room[2 * k], room[2 * k + 1])
            if room[k] == top:
                break
            room[k] = top
            k //= 2
        return out, offset


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; equal lengths in the order given. No length may exceed the capacity."""
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    tree = Tournament(capacity, len(lengths))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        out[i] = tree.put(lengths[i])
    return out


def tokenized(docs: DataFrame, tokenizer_path: str, end: int | None = 1) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, ids binary, width int): whole texts' ids, closed by `end`. Null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        tail = b"" if end is None else np.array([end], enc.dtype).tobytes()
        for b in slices(batches):
            ids = [enc.encode(t) + tail for t in strings(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([enc.width] * len(ids), pa.int32())], names=["doc_id", "ids", "width"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "doc_id long, ids binary, width int")


def packed(tokens: DataFrame, length: int = 2048, group: int = 4000, seed: int = 42, rows: int | None = None) -> DataFrame:
    """tokens (doc_id, ids, width) -> a row a piece: (doc_id, start, length, ids binary of little-endian unsigned
    32-bit ids, doc_tokens, sequence_id, offset).

    Each document without ids has one piece of length 0 at offset 0 of a sequence of its own group. sequence_id is
    unique over all groups, offsets in a sequence are gapless from 0. Documents are put into groups of about `group`
    by a random number, so null or repeated doc_ids gather nowhere; a task takes a group in slices of at most four
    times that. Empty table: no rows. `rows`: the number of documents, if known.
    """
    groups = max(1, round((tokens.count() if rows is None else rows) / group))
    def pack_slice(g: int, part: int, t: pa.Table) -> pa.RecordBatch:
        ids, docs, width = t["ids"].to_pylist(), t["doc_id"].to_pylist(), t["width"].to_pylist()
        n = [len(x) // w for x, w in zip(ids, width)]
        order = sorted(range(len(n)), key=lambda i: (docs[i] is None, docs[i] or 0, ids[i][:64]))
        rest = [n[i] % length for i in order]
        bins = first_fit_decreasing(rest, length)
        bin_at = 1 + max((b for b, _ in bins), default=-1)
        base = (g << 32) | (part << 24)
        out: list[list] = [[] for _ in range(7)]
        for i, r, (b, offset) in zip(order, rest, bins):
            whole = np.frombuffer(ids[i], f"<u{width[i]}").astype("<u4")
            pieces = []
            for s in range(0, n[i] - r, length):
                pieces.append((s, length, bin_at, 0))
                bin_at += 1
            if r or not n[i]:
                pieces.append((n[i] - r, r, b, offset if r else 0))
            for s, m, k, o in pieces:
                for c, v in zip(out, (docs[i], s, m, whole[s : s + m].tobytes(), n[i], base + k, o)):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, types)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([pack_slice(key[0].as_py(), k, table.slice(at, 4 * group)) for k, at in enumerate(range(0, table.num_rows, 4 * group))])

    spread = tokens.withColumn("g", F.floor(F.rand(seed) * groups).cast("long"))
    return spread.groupBy("g").applyInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
