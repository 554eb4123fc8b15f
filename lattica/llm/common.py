"""What the corpus operators share: the cluster's shared folder, packed shuffles, words and word hashes."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import new_folder

U64 = np.uint64


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder (URI) below the one that all executors share (see storage)."""
    return new_folder(spark, name)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; works on executors without a JVM."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage and outlives lost executors."""
    uri = shared_folder(df.sparkSession, name)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing ones can't disturb an operator; text is cast to string.
    Also sees to it that workers can import the package."""
    ship(df.sparkSession)
    return df.select(*[F.col(f"`{n}`").cast("string").alias(n) if n == "text" else F.col(f"`{n}`") for n in names])


# packed arrays

_C, _D = zstandard.ZstdCompressor(level=1, write_checksum=True), zstandard.ZstdDecompressor()


def pack(a: np.ndarray) -> bytes:
    """An integer array as byte planes in a checked zstandard frame; the first byte is the item size."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return bytes([a.dtype.itemsize]) + _C.compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes, dtype: str = "u8") -> np.ndarray:
    planes = np.frombuffer(_D.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    return np.ascontiguousarray(planes.T).view(f"<u{b[0]}").ravel().astype(dtype)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned values as differences, in the narrowest type that holds them."""
    d = np.diff(a, prepend=U64(0)) if len(a) else a.astype(U64)
    return pack(d.astype(np.min_scalar_type(d.max()) if len(d) else np.uint8))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=U64)


# texts


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `most` bytes of text each, so that a worker's memory doesn't follow the batch size."""
    for b in batches:
        size = max(1, b.column(b.schema.get_field_index(text)).nbytes)
        step = max(1, int(b.num_rows * most / size))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


# what worker processes keep: they outlive their tasks and serve one operator after another

_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task: what was asked for last, made if it isn't there."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def release() -> None:
    """For operators that keep nothing: what an earlier one kept in this worker process doesn't lie beside their own."""
    if _held:
        _held.clear()
        gc.collect()  # what is kept may refer to itself


class WordHashes(dict):
    """Words (bytes) -> index into two arrays of 64 hash bits each; emptied between uses when it holds `cap` words."""

    def __init__(self, cap: int = 400_000, seed: int = 0):
        super().__init__()
        self.cap, self.seed = cap, seed
        self.lanes = np.empty((2, 1 << 16), U64)

    def __missing__(self, word: bytes) -> int:
        i = len(self)
        if i == self.lanes.shape[1]:
            self.lanes = np.concatenate([self.lanes, np.empty_like(self.lanes)], axis=1)
        h = xxhash.xxh3_128_intdigest(word, self.seed)
        self.lanes[0, i], self.lanes[1, i] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        self[word] = i
        return i

    def of(self, words: list[bytes]) -> np.ndarray:
        """(2, n) hashes."""
        if len(self) > self.cap:
            self.clear()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.lanes[:, ids]


def hexdigits(a: np.ndarray, digits: int = 16) -> list[str]:
    return [f"{int(x):0{digits}x}" for x in a]
