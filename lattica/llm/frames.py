"""Token ids in files of independent zstandard frames with a trailing seek table.

A file: frames, each with its own checksum and holding whole documents of together at most `frame_ids` ids (a longer
document has frames of its own); a skippable frame with the
index of documents (doc_id, first token; itself a checked zstandard frame); a skippable frame with the seek table in
the published seekable layout: for each frame its compressed size, size, and the low half of the XXH64 of its content,
then the number of frames, a descriptor and the magic number. A reader reads the end of the file first and then
decompresses only the frames that hold the documents asked for.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, pack, pick, shared_folder, slices, strings, unpack, utf8, written
from .tokens import encoder

#: A frame holds at most so many ids: what a reader decompresses for a document.
FRAME = 1 << 14
_INDEX, _TABLE, _FOOT = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1


_MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64())])


class Corrupt(ValueError):
    pass


class Writer:
    """add(doc_id, ids) in the order wanted; close() writes index and seek table."""

    def __init__(self, out, width: int = 4, frame_ids: int = FRAME, level: int = 3):
        self.out, self.width, self.size = out, width, frame_ids * width
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.table: list[tuple[int, int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.tokens = 0
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, self.tokens))
        self.tokens += len(ids) // self.width
        if self.held + len(ids) > self.size:
            self._frames()
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            self._frames()

    def _frames(self) -> None:
        """Writes what is held, in frames of at most self.size."""
        data = b"".join(self.parts)
        for at in range(0, len(data), self.size):
            piece = data[at : at + self.size]
            packed = self.zstd.compress(piece)
            self.out.write(packed)
            self.table.append((len(packed), len(piece), xxhash.xxh64_intdigest(piece) & 0xFFFFFFFF))
        self.parts, self.held = [], 0

    def close(self) -> None:
        self._frames()
        ids = np.array([d if d is not None else 0 for d, _ in self.docs], np.int64)
        null = np.packbits(np.array([d is None for d, _ in self.docs], bool))
        starts = np.array([s for _, s in self.docs] + [self.tokens], np.uint64)
        parts = [pack(ids.view(np.uint64)), pack(null), pack(starts)]
        index = struct.pack("<BQ3I", self.width, len(self.docs), *map(len, parts)) + b"".join(parts)
        self.out.write(struct.pack("<II", _INDEX, len(index)) + index)
        rows = [*self.table, (len(index) + 8, 0, xxhash.xxh64_intdigest(index) & 0xFFFFFFFF)]
        body = b"".join(struct.pack("<III", *r) for r in rows) + struct.pack("<IBI", len(rows), 0x80, _FOOT)
        self.out.write(struct.pack("<II", _TABLE, len(body)) + body)


class Reader:
    """Reads the seek table and index of an open seekable file; frames are decompressed as they are asked for."""

    def __init__(self, f, size: int):
        self.f = f
        self.decompressed = 0  # frames read so far
        foot = self._at(size - 9, 9)
        n, kind, magic = struct.unpack("<IBI", foot)
        if magic != _FOOT or kind != 0x80:
            raise Corrupt("no seek table")
        rows = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.sums = rows[:-1, 2]
        self.at = np.r_[0, np.cumsum(rows[:, 0], dtype=np.int64)]
        self.content = np.r_[0, np.cumsum(rows[:-1, 1], dtype=np.int64)]
        index = self._at(int(self.at[-2]) + 8, int(rows[-1, 0]) - 8)
        if xxhash.xxh64_intdigest(index) & 0xFFFFFFFF != rows[-1, 2]:
            raise Corrupt("index")
        self.width, docs, *sizes = struct.unpack_from("<BQ3I", index)
        parts, p = [], struct.calcsize("<BQ3I")
        for s in sizes:
            parts.append(index[p : p + s])
            p += s
        null = np.unpackbits(unpack(parts[1], "u1"))[:docs].astype(bool)
        self.doc_ids = [None if z else int(d) for d, z in zip(unpack(parts[0]).view(np.int64), null)]
        self.starts = unpack(parts[2]).astype(np.int64)
        self.tokens = int(self.starts[-1])
        ids = unpack(parts[0]).view(np.int64)
        self._null, known = np.flatnonzero(null), np.flatnonzero(~null)
        self._order = known[np.argsort(ids[known], kind="stable")]
        self._sorted = ids[self._order]
        self._last: tuple[int, bytes] = (-1, b"")

    def _at(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        b = self.f.read(n)
        if len(b) != n:
            raise Corrupt("short file")
        return b

    def frame(self, k: int) -> bytes:
        if self._last[0] != k:
            self.decompressed += 1
            try:
                b = zstandard.ZstdDecompressor().decompress(self._at(int(self.at[k]), int(self.at[k + 1] - self.at[k])))
            except zstandard.ZstdError as e:
                raise Corrupt(f"frame {k}") from e
            if xxhash.xxh64_intdigest(b) & 0xFFFFFFFF != self.sums[k]:
                raise Corrupt(f"frame {k}")
            self._last = (k, b)
        return self._last[1]

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document."""
        lo, hi = int(self.starts[i]) * self.width, int(self.starts[i + 1]) * self.width
        k, out = int(np.searchsorted(self.content, lo, "right")) - 1, []
        while lo < hi:
            b = self.frame(k)
            s = lo - int(self.content[k])
            piece = b[s : s + hi - lo]
            out.append(piece)
            lo += len(piece)
            k += 1
        return np.frombuffer(b"".join(out), f"<u{self.width}")

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of this id."""
        return [self.ids(i) for i in self.where(doc_id)]

    def where(self, doc_id: int | None) -> list[int]:
        """The places of the documents of this id, by bisection."""
        if doc_id is None:
            return self._null.tolist()
        lo, hi = np.searchsorted(self._sorted, doc_id, "left"), np.searchsorted(self._sorted, doc_id, "right")
        return self._order[lo:hi].tolist()


def open_file(uri: str) -> Reader:
    fs, path = filesystem(uri)
    return Reader(fs.open_input_file(path), fs.get_file_info(path).size)


def write_frames(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end: int | None = 0, frame_ids: int = FRAME) -> DataFrame:
    """Encodes docs (doc_id integer, text), each closed by id `end`, into files in ascending doc_id order.

    -> written table (part, path, n_docs, n_tokens, least, greatest): a file for each part, parts in order, with the
    range of its doc_ids (null: none; a file with a null doc_id has no least). Null text: as empty. Null
    doc_ids come first, equal ones in the order of their texts' hashes. Empty table: no files. A file takes its name
    when it is whole and each attempt has its own, so that a lost executor leaves no half of one.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, w, f = encoder(tokenizer_path), None, None
        fs, base = filesystem(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        tail = b"" if end is None else np.array([end], enc.dtype).tobytes()
        path = f"{base}/part-{part:08d}-{attempt}.zst"
        for b in slices(batches):
            for d, t in zip(b.column("doc_id").to_pylist(), strings(b.column("text"))):
                if w is None:
                    fs.create_dir(base, recursive=True)
                    f = fs.open_output_stream(path + ".part")
                    w = Writer(f, enc.width, frame_ids)
                w.add(d, enc.encode(t) + tail)
        if w is not None:
            w.close()
            f.close()
            fs.move(path + ".part", path)
            name = f"{folder}/part-{part:08d}-{attempt}.zst"
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [len(w.docs)], "n_tokens": [w.tokens], "least": [w.docs[0][0]], "greatest": [w.docs[-1][0]]}, schema=_MANIFEST)

    ordered = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return written(ordered.mapInArrow(run, "part long, path string, n_docs long, n_tokens long, least long, greatest long"), "manifest")


def read_frames(spark, files: Iterable[tuple], doc_ids: list[int | None] | None = None) -> DataFrame:
    """(path, ids before the file, least, greatest doc_id) -> (doc_id, start, ids binary of little-endian unsigned
    32-bit ids), a task a file.

    With doc_ids, only files whose range may hold one are opened, and only these documents' frames are decompressed.
    A file given without its range is opened.
    """
    files = [(*f, None, None)[:4] for f in files]
    wanted = None if doc_ids is None else sorted({d for d in doc_ids if d is not None}) + [None] * (None in doc_ids)
    if wanted is not None:
        known = [d for d in wanted if d is not None]
        files = [f for f in files if f[2] is None or bisect_left(known, f[2]) < bisect_right(known, f[3])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, before in zip(b.column("path").to_pylist(), b.column("before").to_pylist()):
                r = open_file(uri)
                at = range(len(r.doc_ids)) if wanted is None else sorted(i for d in wanted for i in r.where(d))
                for j in range(0, len(at), 512):
                    some = at[j : j + 512]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r.doc_ids[i] for i in some], pa.int64()), pa.array([before + int(r.starts[i]) for i in some], pa.int64()), pa.array([r.ids(i).astype("<u4").tobytes() for i in some], pa.binary())],
                        names=["doc_id", "start", "ids"],
                    )

    rows = spark.createDataFrame([(i, p, b) for i, (p, b, _, _) in enumerate(files)], "i int, path string, before long")
    return rows.repartitionById(max(1, len(files)), "i").mapInArrow(run, "doc_id long, start long, ids binary")


def offsets(manifest: DataFrame) -> list[tuple[str, int, int | None, int | None]]:
    """The files with the ids before each and their ranges; one row a file comes to the driver."""
    out, before = [], 0
    for r in sorted(manifest.collect(), key=lambda r: r.part):
        out.append((r.path, before, r.least, r.greatest))
        before += r.n_tokens
    return out


def digest(ids: bytes) -> int:
    return zlib.crc32(ids)


__all__ = ["Corrupt", "Reader", "Writer", "digest", "offsets", "open_file", "read_frames", "write_frames", "utf8"]
