"""Removal of repeated word windows, with a count-min prefilter before the exact grouping.

Documents are written to the shared folder in chunks, each read by one task in each pass.

1. A chunk's windows are hashed to cells of a sketch with `depth` rows. Per row the chunk sends its cells, with a bit
   for those that it has twice, to the owners of the sketch's slices. The owner adds up the chunks' counts (two is
   enough to know, so counters stop there) and answers each chunk with those of its cells that hold two or more.
2. A window's estimate is the least of its cells' counts and never too low. Only windows estimated at two or more go
   on: per chunk the distinct ones, as 128-bit hashes with the chunk's least doc_id, to the owners of hash ranges,
   which find the least doc_id of all and answer where it is below the chunk's.
3. Each chunk removes the covered words.

The sketch is as wide as the corpus needs, since no task ever holds more than a slice of it, and nothing is broadcast.
A window that a third of all documents share is one entry for each chunk.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WordHashes, filesystem, pack, pack_sorted, partitions, pick, shared_folder, slices, unpack, unpack_sorted, utf8, written

#: Bytes of text that a task holds at once, with some thirty times as much beside them.
CHUNK = 4 << 20
_words: list[WordHashes] = []
_MESSAGE = "slot int, chunk long, sketch int, path string, cells binary, more binary"
_ARROW = pa.schema([("slot", pa.int32()), ("chunk", pa.int64()), ("sketch", pa.int32()), ("path", pa.string()), ("cells", pa.binary()), ("more", pa.binary())])
_NULL = np.iinfo(np.int64).max  # a null doc_id is no smaller one


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _ARROW.types)], schema=_ARROW)


def chunks(docs: DataFrame, folder: str, most: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) -> written table (chunk, path) of Parquet files of about `most` bytes of text each.

    Only the files of attempts that ended are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        part, held, size, n = TaskContext.get().partitionId(), [], 0, 0

        def flush():
            name = f"/{part}-{n}-{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.Table.from_batches(held), base + name, filesystem=fs, compression="zstd")
            return pa.RecordBatch.from_pydict({"chunk": [(part << 32) | n], "path": [folder + name]})

        for b in slices(batches, most=most):
            held.append(b)
            size += b.column("text").nbytes
            if size >= most:
                yield flush()
                held, size, n = [], 0, n + 1
        if any(x.num_rows for x in held):
            yield flush()

    return written(pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, "chunk long, path string"), "chunks")


class Chunk:
    """Words and windows of a chunk's documents."""

    def __init__(self, path: str, k: int):
        fs, p = filesystem(path)
        t = pq.read_table(p, filesystem=fs, columns=["doc_id", "text"])
        self.doc_ids = t["doc_id"].combine_chunks()
        self.order = self.doc_ids.fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64)
        self.words = [x.split() for x in utf8(t["text"])]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        if not _words:
            _words.append(WordHashes())
        h = np.concatenate([_words[0].of(w) for w in self.words], axis=1) if len(self.words) else np.zeros((2, 0), U64)
        self.n = np.maximum(self.counts - k + 1, 0)
        ends = np.cumsum(self.counts)
        #: Of each window: the place of its first word among the chunk's words, and its document.
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        within = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.at = (ends - self.counts)[self.doc] + within if len(self.doc) else np.zeros(0, np.int64)
        self.a, self.b = (self._windows(h[i], m, k)[self.at] if len(self.at) else np.zeros(0, U64) for i, m in ((0, U64(0x9E3779B97F4A7C15)), (1, U64(0xC2B2AE3D27D4EB4F))))

    @staticmethod
    def _windows(h: np.ndarray, m: np.uint64, k: int) -> np.ndarray:
        """A polynomial of each k neighbouring hashes, by doubling, then mixed."""
        out, size, power, w, mult = None, 0, h, 1, m
        while k:
            if k & 1:
                if out is None:
                    out = power
                else:
                    n = max(0, len(power) - size)
                    out = out[:n] * mult + power[size : size + n]
                size += w
            k >>= 1
            if k:
                power = power[: max(0, len(power) - w)] * mult + power[w:]
                w, mult = 2 * w, U64(int(mult) * int(mult) & 0xFFFFFFFFFFFFFFFF)
        out = (out ^ (out >> U64(31))) * U64(0xBF58476D1CE4E5B9)
        return out ^ (out >> U64(29))

    def cells(self, sketch: int, width: int) -> np.ndarray:
        return (self.a if sketch == 0 else self.b if sketch == 1 else self.a + U64(sketch) * self.b) >> U64(64 - width)


def _cuts(values: np.ndarray, bits: int, slots: int) -> list[int]:
    """Where the ranges of the slots begin in ascending values of so many bits; and the end."""
    bounds = np.array([(i << bits) // slots for i in range(1, slots)], U64)
    return [0, *np.searchsorted(values, bounds).tolist(), len(values)]


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending values, and whether each came at least twice."""
    v = np.sort(values)
    first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, int)
    return v[first], np.diff(np.r_[first, len(v)]) > 1


def _sketch(k: int, width: int, depth: int, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, path in zip(batch["chunk"].to_pylist(), batch["path"].to_pylist()):
                c, rows = Chunk(path, k), []
                for s in range(depth):
                    cells, twice = _unique(c.cells(s, width))
                    cut = _cuts(cells, width, slots)
                    for i in range(slots):
                        lo, hi = cut[i], cut[i + 1]
                        if hi > lo or (s == 0 and i == 0):  # a chunk without windows is told of too
                            rows.append((i, chunk, s, path, pack_sorted(cells[lo:hi]), pack(np.packbits(twice[lo:hi]))))
                yield from _rows(rows).to_batches()

    return run


def _add_up(key: tuple, t: pa.Table) -> pa.Table:
    """The owner of a slice of a row of the sketch: each chunk's cells that hold two or more."""
    parts = [unpack_sorted(x.as_py()) for x in t["cells"]]
    own = [p[np.unpackbits(unpack(m.as_py(), "u1"))[: len(p)].astype(bool)] for p, m in zip(parts, t["more"])]
    full, more = _unique(np.concatenate(parts))
    full = np.union1d(full[more], np.concatenate(own))
    rows = []
    for p, chunk, path in zip(parts, t["chunk"].to_pylist(), t["path"].to_pylist()):
        hit = _member(p, full)
        rows.append((key[0].as_py(), chunk, key[1].as_py(), path, pack_sorted(p[hit]), None))
    return _rows(rows)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def _member_of_both(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
    """Whether (a, b) is among the pairs (ea, eb)."""
    out = np.zeros(len(a), bool)
    order = np.argsort(ea, kind="stable")
    ea, eb = ea[order], eb[order]
    at = np.searchsorted(ea, a)
    left = np.flatnonzero(at < len(ea))
    while len(left := left[at[left] < len(ea)]) and len(left := left[ea[at[left]] == a[left]]):
        out[left] |= eb[at[left]] == b[left]
        at[left] += 1
    return out


def _candidates(k: int, width: int, depth: int, slots: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        c, path = Chunk(t["path"][0].as_py(), k), t["path"][0].as_py()
        full = [[] for _ in range(depth)]
        for s, cells in zip(t["sketch"].to_pylist(), t["cells"]):
            full[s].append(unpack_sorted(cells.as_py()))
        idx = np.argsort(c.a, kind="stable")
        for s in range(depth):
            among = np.sort(np.concatenate(full[s])) if full[s] else np.zeros(0, U64)
            idx = idx[_member(c.cells(s, width)[idx], among)]
        a, b, doc = c.a[idx], c.b[idx], c.order[c.doc[idx]]
        if len(a) and (a[1:] == a[:-1]).any():
            order = np.lexsort((b, a))
            a, b, doc = a[order], b[order], doc[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, int)
        least = np.minimum.reduceat(doc, first) if len(first) else doc[:0]
        a, b = a[first], b[first]
        cut, rows = _cuts(a, 64, slots), []
        for i in range(slots):
            lo, hi = cut[i], cut[i + 1]
            if hi > lo or i == 0:
                more = pack(b[lo:hi])
                rows.append((i, key[0].as_py(), 0, path, pack_sorted(a[lo:hi]), more + pack(least[lo:hi].view(U64)) + len(more).to_bytes(8, "little")))
        return _rows(rows)

    return run


def _group(key: tuple, t: pa.Table) -> pa.Table:
    """The owner of a range of window hashes: each chunk's windows whose least doc_id is below the chunk's."""
    parts = []
    for cells, more in zip(t["cells"], t["more"]):
        m = more.as_py()
        n = int.from_bytes(m[-8:], "little")
        parts.append((unpack_sorted(cells.as_py()), unpack(m[:n]), unpack(m[n:-8]).view(np.int64)))
    a, b, least = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    sa, sb = a[order], b[order]
    first = np.r_[True, (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])] if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    low = np.empty(len(a), np.int64)
    if len(a):
        low[order] = np.minimum.reduceat(least[order], at)[np.cumsum(first) - 1]
    flag, rows, pos = low < least, [], 0
    for (pa_, pb, _), chunk, path in zip(parts, t["chunk"].to_pylist(), t["path"].to_pylist()):
        f = flag[pos : pos + len(pa_)]
        rows.append((key[0].as_py(), chunk, 0, path, pack_sorted(pa_[f]), pack(pb[f])))
        pos += len(pa_)
    return _rows(rows)


_RESULT = "doc_id long, n_words long, n_removed long, kept string"


def _remove(k: int, digest: bool):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        c = Chunk(t["path"][0].as_py(), k)
        ea, eb = (np.concatenate(x) for x in zip(*[(unpack_sorted(x.as_py()), unpack(m.as_py())) for x, m in zip(t["cells"], t["more"])]))
        idx = np.argsort(c.a, kind="stable")
        a, b, doc = c.a[idx], c.b[idx], c.order[c.doc[idx]]
        out = _member_of_both(a, b, ea, eb)
        if len(a):  # the others repeat only within the chunk: its least doc_id keeps them
            if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
                order = np.lexsort((b, a))
                idx, a, b, doc, out = idx[order], a[order], b[order], doc[order], out[order]
            first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            least = np.minimum.reduceat(doc, np.flatnonzero(first))[np.cumsum(first) - 1]
            out |= least < doc
            out &= doc != _NULL
        total = int(c.counts.sum())
        at = c.at[idx[out]]
        cover = np.zeros(total + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, np.minimum(at + k, total), -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows, s = [], 0
        for d, words, n in zip(c.doc_ids.to_pylist(), c.words, c.counts.tolist()):
            g = gone[s : s + n]
            s += n
            m = int(g.sum())
            left = b" ".join(words if not m else [w for w, x in zip(words, g.tolist()) if not x])
            rows.append((d, n, m, hashlib.sha256(left).hexdigest() if digest else left.decode("utf-8", "replace")))
        return pa.Table.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_words", "n_removed", "kept"])

    return run


def without_repeats(docs: DataFrame, k: int = 13, depth: int = 2, digest: bool = False) -> DataFrame:
    """docs (doc_id integer, text) -> (doc_id, n_words, n_removed, kept): the words that are left, joined by a space
    (digest: their SHA-256), after the removal of each word covered by a window of k words that also starts in a
    document with a smaller doc_id.

    Null text: no words. A null doc_id is not smaller than any and none is smaller than it: such rows keep all words
    and take none from others. Rows of equal doc_id don't remove one another's windows. Fewer than k words: nothing is
    removed. Empty table: no rows. Other columns are ignored. Word sequences are told apart by 128 hash bits.
    """
    spark = docs.sparkSession
    folder, slots = shared_folder(spark, "texts"), partitions(spark)
    files = chunks(docs, folder)
    tasks = max(1, files.count())
    # cells: at least four times the bytes of the texts, hence many for each window
    width = min(44, max(20, (tasks * CHUNK * 4).bit_length()))

    def by_chunk(df: DataFrame) -> DataFrame:  # as many tasks as chunks: their texts weigh more than what is sent
        return df.repartition(tasks, "chunk").groupBy("chunk")

    ids = files.repartition(tasks)
    cells = ids.mapInArrow(_sketch(k, width, depth, slots), _MESSAGE)
    full = cells.groupBy("slot", "sketch").applyInArrow(_add_up, _MESSAGE)
    found = by_chunk(full).applyInArrow(_candidates(k, width, depth, slots), _MESSAGE)
    repeated = found.groupBy("slot").applyInArrow(_group, _MESSAGE)
    return by_chunk(repeated).applyInArrow(_remove(k, digest), _RESULT)
