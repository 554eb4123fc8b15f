"""SimHash document fingerprints, and the search for all fingerprints within a Hamming radius.

Terms are words and pairs of neighbouring words, lower-cased. A term that occurs n times votes with weight
1 + log2(n) with the signs of its hash's bits; the fingerprint holds the signs of the sums. The search cuts the bits into radius + extra blocks; by the pigeonhole
principle two fingerprints within the radius agree in `extra` whole blocks. There is a table for each choice of
`extra` blocks, permuted so that these lead; rows that share a leading key are compared in full.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from . import ballhash
from .common import U64, WordHashes, pack, partitions, pick, slices, strings, unpack, written

_words: list[WordHashes] = []


def fingerprint(text: str, lanes: int = 2) -> bytes:
    """64 bits a lane (at most 2), big-endian; a text without words: zeros."""
    if not _words:
        _words.append(WordHashes())
    words = text.lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return bytes(8 * lanes)
    h = _words[0].of(words)[:lanes]
    pairs = (h[:, :-1] * U64(0x9E3779B97F4A7C15)) ^ (h[:, 1:] * U64(0xC2B2AE3D27D4EB4F))
    pairs ^= pairs >> U64(29)
    pairs *= U64(0xBF58476D1CE4E5B9)
    pairs ^= pairs >> U64(32)
    terms = np.concatenate([h, pairs], axis=1)
    order = np.argsort(terms[0], kind="stable")
    terms = terms[:, order]
    first = np.flatnonzero(np.r_[True, terms[0, 1:] != terms[0, :-1]])
    weights = 1 + np.log2(np.diff(np.r_[first, len(order)])).astype(np.float32)
    votes = np.zeros(64 * lanes)
    for at in range(0, len(first), 1 << 14):  # a piece's matrix stays small however long the text is
        piece = slice(at, at + (1 << 14))
        bits = np.unpackbits(np.ascontiguousarray(terms[:, first[piece]].T).astype(">u8").view(np.uint8).reshape(-1, 8 * lanes), axis=1)
        votes += weights[piece] @ bits.astype(np.float32)
    return np.packbits(2 * votes > weights.sum(dtype=np.float64)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / (8 * len(a))


def fingerprints(docs: DataFrame, lanes: int = 2) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fingerprint hex string). Null text: as empty. Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([fingerprint(t, lanes).hex() for t in strings(b.column("text"))])], names=["doc_id", "fingerprint"])

    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


class Tables:
    """Block tables: a mask of the fingerprint's words for each choice of `extra` of radius + extra blocks."""

    def __init__(self, radius: int, extra: int, bits: int):
        blocks = radius + extra
        if bits % 64 or extra < 1 or not 0 <= radius or blocks > bits // 4:
            raise ValueError("the radius is too large for block tables")
        self.radius, self.words = radius, bits // 64
        cuts = [bits * i // blocks for i in range(blocks + 1)]
        masks = [sum((1 << (bits - cuts[i])) - (1 << (bits - cuts[i + 1])) for i in c) for c in combinations(range(blocks), extra)]
        self.masks = np.frombuffer(b"".join(m.to_bytes(bits // 8) for m in masks), ">u8").astype(U64).reshape(len(masks), -1)

    def verify(self, table: int, w: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of the pairs w[i], v[j]: those within the radius that meet in no earlier table, and their distances."""
        d = w[i] ^ v[j]
        k = np.bitwise_count(d).sum(1, dtype=np.int64)
        near = np.flatnonzero(k <= self.radius)
        near = near[~((d[near, None] & self.masks[None, :table]) == 0).all(2).any(1)]
        return i[near], j[near], k[near]


_FOUND = "fp long, near long, root long, work binary"


def _report(found: list, ids: np.ndarray, n: np.ndarray, ids2: np.ndarray, n2: np.ndarray, pairs: bool) -> list[pa.RecordBatch]:
    if not sum(len(f[0]) for f in found):
        return []
    i, j, k = (np.concatenate(z) for z in zip(*found))
    if not pairs:
        return [ballhash._links(ids[i], ids2[j], n[i], n2[j])]
    return [pa.RecordBatch.from_arrays([pa.array(ids[i].astype(np.int64)), pa.array(k), pa.array(ids2[j].astype(np.int64)), pa.nulls(len(i), pa.binary())], schema=ballhash._FOUND)]


def _search(groups: DataFrame, tables: Tables, hot: int, pairs: bool) -> DataFrame:
    """groups (id long, n long, fingerprint; distinct), written -> (fp, near, root): of each key the links' counts and
    roots by id or, with `pairs`, (id, distance, id). A key with more than `hot` fingerprints is cut into blocks, and
    each pair of blocks is a row of work of its own, so no key is left to one task."""
    spark, words = groups.sparkSession, tables.words
    slots = max(1, partitions(spark) // 4)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = (b.column(c).to_numpy(zero_copy_only=False).astype(U64) for c in ("id", "n"))
            w = np.frombuffer(bytes.fromhex("".join(b.column("fingerprint").to_pylist())), ">u8").astype(U64).reshape(-1, words)
            for c, mask in enumerate(tables.masks):
                slot = np.zeros(len(w), U64)
                for x in (w & mask).T:
                    slot = (slot ^ x) * U64(0x9E3779B97F4A7C15)
                    slot ^= slot >> U64(32)
                slot %= U64(slots)
                order = np.argsort(slot, kind="stable")
                cuts = np.searchsorted(slot[order], np.arange(slots + 1, dtype=U64))
                rows = [(s, c, *[pack(x[order[lo:hi]].ravel()) for x in (ids, n, w)]) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 3))], names=["slot", "choice", "ids", "ns", "fps"])

    def collide(key: tuple, table: pa.Table) -> pa.Table:
        c = key[1].as_py()
        ids, n, w = (np.concatenate([unpack(x.as_py()) for x in table[f]]) for f in ("ids", "ns", "fps"))
        w = w.reshape(-1, words)
        m = w & tables.masks[c]
        order = np.lexsort(m.T)
        ids, n, w, m = ids[order], n[order], w[order], m[order]
        starts = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]).any(1)])
        sizes = np.diff(np.r_[starts, len(m)])
        run, found, work = np.repeat(np.arange(len(starts)), sizes), [], []
        for s, size in zip(starts[sizes > hot], sizes[sizes > hot]):
            cuts = [slice(x, min(x + hot, s + size)) for x in range(s, s + size, hot)]
            for i, x in enumerate(cuts):
                for y in cuts[i:]:
                    work.append(np.concatenate([np.array([c, x.stop - x.start, x == y], U64), *[z[k].ravel() for k in (x, y) for z in (ids, n, w)]]).tobytes())
        at, d, held, out = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= hot), sizes)), 1, 0, []
        while len(at := at[at + d < len(m)]) and len(at := at[run[at + d] == run[at]]):
            for part in np.array_split(at, -(-len(at) // ballhash._PAIRS)):
                found.append(tables.verify(c, w, w, part, part + d))
                held += len(found[-1][0])
                if held > ballhash._PAIRS:
                    out, found, held = out + _report(found, ids, n, ids, n, pairs), [], 0
            d += 1
        out += _report(found, ids, n, ids, n, pairs)
        if work:
            none = pa.nulls(len(work), pa.int64())
            out.append(pa.RecordBatch.from_arrays([none, none, none, pa.array(work, pa.binary())], schema=ballhash._FOUND))
        return pa.Table.from_batches(out, ballhash._FOUND)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("work"):
                a = np.frombuffer(raw.as_py(), U64)
                c, size, same = map(int, a[:3])
                x, y = a[3 : 3 + size * (2 + words)], a[3 + size * (2 + words) :]
                (ids, n, w), (ids2, n2, v) = ((z[:k], z[k : 2 * k], z[2 * k :].reshape(-1, words)) for z in (x, y) for k in (len(z) // (2 + words),))
                found, held = [], 0
                for i in range(size):
                    j = np.arange(i + 1 if same else 0, len(v))
                    found.append(tables.verify(c, w, v, np.full(len(j), i), j))
                    held += len(found[-1][0])
                    if held > ballhash._PAIRS:
                        yield from _report(found, ids, n, ids2, n2, pairs)
                        found, held = [], 0
                yield from _report(found, ids, n, ids2, n2, pairs)

    emitted = groups.select("id", "n", "fingerprint").mapInArrow(emit, "slot int, choice int, ids binary, ns binary, fps binary")
    found = written(emitted.groupBy("slot", "choice").applyInArrow(collide, _FOUND), "near")
    rest = found.where("work is not null").select("work").repartition(partitions(spark)).mapInArrow(blocks, _FOUND)
    return found.where("work is null").drop("work").unionByName(rest.drop("work"))


def _tables(groups: DataFrame, radius: int, extra: int, bits: int | None) -> Tables:
    """bits: by default, of the fingerprints' length."""
    if bits is None:
        row = groups.select(F.length("fingerprint").alias("n")).first()
        bits = 4 * row.n if row else 64
    return Tables(radius, extra, bits)


def near_pairs(fps: DataFrame, radius: int = 3, extra: int = 2, bits: int | None = None, hot: int = 20_000) -> DataFrame:
    """fps (fingerprint hex) -> (a, b, distance), a < b: the distinct fingerprints within the radius of each other.

    Equal fingerprints are one, so copies make no pairs. A pair is emitted only by the first table in which it meets.
    Null fingerprints pair with none; an empty table has no pairs; other columns are ignored, whatever their names.
    """
    ship(fps.sparkSession)
    one = fps.select("fingerprint").where("fingerprint is not null").distinct()
    groups = written(one.select(F.monotonically_increasing_id().alias("id"), F.lit(1).cast("long").alias("n"), "fingerprint"), "groups")
    found = _search(groups, _tables(groups, radius, extra, bits), hot, True)
    x, y = (groups.select(F.col("id").alias(k), F.col("fingerprint").alias(f)) for k, f in (("fp", "x"), ("root", "y")))
    return found.join(x, "fp").join(y, "root").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.col("near").cast("int").alias("distance"))


def with_near(rows: DataFrame, radius: int = 3, extra: int = 2, bits: int | None = None, hot: int = 20_000) -> DataFrame:
    """rows (doc_id, fingerprint, ...) -> the rows with n_near and class_id.

    n_near: other rows whose fingerprint differs in at most `radius` bits. class_id: the least doc_id reachable by
    such links, itself included; null only if all are null. Fingerprints, one for each row, are not null.
    """
    ship(rows.sparkSession)
    groups = rows.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    groups = written(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    found = _search(groups, _tables(groups, radius, extra, bits), hot, False)
    found = written(found.groupBy("fp", "root").agg(F.sum("near").alias("near")), "links")
    near = found.groupBy("fp").agg(F.sum("near").alias("near")).withColumnRenamed("fp", "id")
    roots = ballhash.components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    g = groups.join(near, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = g.groupBy("root").agg(F.min("least").alias("class_id"))
    g = g.join(least, "root").select("fingerprint", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_near"), "class_id")
    return rows.join(g, "fingerprint").select(*rows.columns, "n_near", "class_id")


_SCHEMA = "part int, place int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, head string, text string"


def with_next(docs: DataFrame, lanes: int = 2, marks: bool = True) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The next document is the one after it by (doc_id, hash of text), nulls first; after the last: the first. Null text:
    as empty. Equal doc_ids follow one another. A single document is its own next. Empty table: no rows. Other columns
    are ignored. Without `marks` nothing is fingerprinted, and what comes of fingerprints is null.

    One shuffle by ranges of doc_id. A task sees the next row of all its rows but the last; its first and last row (two
    a task) go through a second, small join.
    """
    spark = docs.sparkSession

    def edit(text: str, nxt: str) -> str:
        n = len(text) // 2
        return text[: len(text) - n] + nxt[:n]

    def finish(doc_id, text, fp, nxt, nfp):
        e = edit(text, nxt)
        digest = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
        if not marks:
            return doc_id, len(text), digest, None, None, None, None
        efp = fp if e == text else fingerprint(e, lanes)
        return doc_id, len(text), digest, fp.hex(), efp.hex(), likeness(fp, efp), likeness(fp, nfp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for b in slices(batches):
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), strings(b.column("text"))):
                fp = fingerprint(t, lanes) if marks else b""
                if held is None:
                    rows.append((part, 0, d, None, None, fp.hex(), None, None, None, t, None))
                else:
                    rows.append((part, 1, *finish(*held, t, fp), None, None))
                held = (d, t, fp)
            yield batch(rows)
        if held is not None:
            yield batch([(part, 2, held[0], None, None, held[2].hex(), None, None, None, None, held[1])])

    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("doc_id", "text", "fingerprint", "head", "next_fingerprint")}
            out = [(0, 1, *finish(d, t, bytes.fromhex(f), h, bytes.fromhex(n)), None, None) for d, t, f, h, n in zip(*c.values())]
            yield batch(out).select(names[2:9])

    ordered = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = ordered.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    table = written(ordered.mapInArrow(run, _SCHEMA), "edited")
    seams = table.where("place <> 1")
    # two rows a task; parts in order, and the first again after the last
    order = seams.where("place = 0").select("part").withColumn("k", F.row_number().over(Window.orderBy("part")) - 1)
    order = order.withColumn("of", F.count("*").over(Window.partitionBy()))
    tails = seams.where("place = 2").select("part", "doc_id", "text", "fingerprint").join(order, "part").withColumn("k", (F.col("k") + 1) % F.col("of"))
    heads = seams.where("place = 0").select("part", "head", F.col("fingerprint").alias("next_fingerprint")).join(order, "part").select("k", "head", "next_fingerprint")
    ends = tails.join(heads, "k").mapInArrow(last, ", ".join(_SCHEMA.split(", ")[2:9]))
    return table.where("place = 1").select(names[2:9]).unionByName(ends)
