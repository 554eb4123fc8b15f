"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint's 64 bits are cut into `blocks` blocks. If two fingerprints differ in at most `radius` bits, some
choice of `keep` blocks holds at most t of the differences (t: the largest possible sum of the `keep` least of
`blocks` counts that add up to `radius`; 2 for radius 6 and two of four blocks). For each choice, every distinct
fingerprint emits all variants of these blocks within half of t, so that any two such fingerprints meet at a common
variant. Variants are shuffled; where fingerprints collide, pairs are verified on all bits, and a pair counts only at
its first choice and least common variant, which deduplicates without a second shuffle. With blocks=keep=1 this is
the ball over all bits at once (43,745 variants for radius 6); with two of four blocks it is 198.

Equal fingerprints are one entry with a count, so copies are never expanded into pairs. Buckets above `hot` entries
are cut into blocks whose pairs are separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, pack, pack_sorted, partitions, pick, release, slices, unpack, unpack_sorted, utf8, written

BITS = 64
#: Verified pairs are merged into counts and roots when a task holds more than this many.
_PAIRS = 1 << 20
_LOW = U64(0x0101010101010101)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `counts` hashes: bit i is 1 if it is set in over half of them; none: 0.

    Eight counters of a byte each are summed in a word, over pieces of at most 255 hashes.
    """
    counts = np.asarray(counts, np.int64)
    pieces = -(-counts // 255)
    out = np.zeros(len(counts), U64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    ends = np.cumsum(counts)
    starts = np.repeat((ends - counts)[some], pieces[some])
    first = np.cumsum(pieces[some]) - pieces[some]
    starts += 255 * (np.arange(len(starts)) - np.repeat(first, pieces[some]))
    for k in range(8):
        sums = np.add.reduceat((hashes >> U64(k)) & _LOW, starts)
        bits = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[some] |= (2 * bits[:, byte] > counts[some]).astype(U64) << U64(8 * byte + k)
    return out


def shingle_hashes(text: bytes) -> bytes:
    """XXH64 (seed 42, big-endian) of each pair of neighbouring words, A-Z lower-cased; one word: of the word."""
    words = text.lower().split()
    if len(words) < 2:
        return xxhash.xxh64_digest(words[0], 42) if words else b""
    line, digest = b" ".join(words), xxhash.xxh64_digest
    at = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *at[:-2].tolist()]
    return b"".join([digest(line[s:e], 42) for s, e in zip(starts, (at[1:] - 1).tolist())])


def word_hashes(text: bytes) -> bytes:
    """XXH64 (seed 42, big-endian) of each different word, A-Z lower-cased. A replaced word moves one hash of these and two
    of shingle_hashes, so copies with more edits stay within the same radius."""
    return b"".join([xxhash.xxh64_digest(w, 42) for w in set(text.lower().split())])


UNITS = {"pairs": shingle_hashes, "words": word_hashes}


def fingerprints(docs: DataFrame, unit: str = "pairs") -> DataFrame:
    """(doc_id, fp) of every document, by its pairs of neighbouring words or its different words; null or wordless texts
    have fingerprint 0. Map only."""
    hashes = UNITS[unit]

    def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            parts = [hashes(t) for t in utf8(b.column("text"))]
            h = np.frombuffer(b"".join(parts), ">u8").astype(U64)
            fp = majority(h, np.array([len(p) // 8 for p in parts], np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(_fingerprint, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


class Balls:
    """The choices of blocks, their keys and variants."""

    def __init__(self, radius: int, blocks: int, keep: int):
        if not 0 <= radius < BITS or not 1 <= keep <= blocks <= 16:
            raise ValueError("radius must be in 0..63 and 1 <= keep <= blocks <= 16")
        self.radius = radius
        cuts = [BITS * i // blocks for i in range(blocks + 1)]

        def least(k: int, low: int, left: int) -> int:  # largest sum of the first `keep` of ascending counts
            if k == blocks:
                return 0
            return max((c * (k < keep) + least(k + 1, c, left - c) for c in range(low, left // (blocks - k) + 1)), default=0)

        self.t = least(0, 0, radius)
        self.half = -(-self.t // 2)
        self.choices = list(combinations(range(blocks), keep))
        self.pieces = [[(cuts[i], cuts[i + 1] - cuts[i]) for i in c] for c in self.choices]
        self.widths = [sum(w for _, w in p) for p in self.pieces]
        self.masks = [np.array([sum(1 << i for i in c) for n in range(self.half + 1) for c in combinations(range(w), n)], U64) for w in self.widths]
        self.key_bits = max(self.widths)

    def key(self, fp: np.ndarray, choice: int) -> np.ndarray:
        out = np.zeros(len(fp), U64)
        for at, width in self.pieces[choice]:
            out = (out << U64(width % 64)) | ((fp >> U64(at)) & U64((1 << width) - 1)) if width < 64 else fp.copy()
        return out

    def mixed(self, key: np.ndarray) -> np.ndarray:
        """A bijection on keys that spreads them evenly over ranges."""
        m = U64((1 << self.key_bits) - 1)
        x = (key * U64(0x9E3779B97F4A7C15)) & m
        x ^= x >> U64(self.key_bits // 2 or 1)
        return (x * U64(0xD6E8FEB86659FD93)) & m

    def canonical(self, x: np.ndarray, y: np.ndarray, choice: int, key: np.ndarray) -> np.ndarray:
        """Whether this bucket is the one at which the pair counts."""
        ok = np.ones(len(x), bool)
        for c in range(choice):
            ok &= np.bitwise_count(self.key(x, c) ^ self.key(y, c)) > self.t
        kx, ky = self.key(x, choice), self.key(y, choice)
        ok &= np.bitwise_count(kx ^ ky) <= self.t
        best = np.full(len(x), np.iinfo(np.uint64).max, U64)
        for m in self.masks[choice]:
            v = self.mixed(kx ^ m)
            best = np.where(np.bitwise_count(kx ^ m ^ ky) <= self.half, np.minimum(best, v), best)
        return ok & (best == key)


def _emit(balls: Balls, slots: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 8192):
                b = big.slice(at, 8192)
                fp = b.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
                n = b.column("n").to_numpy(zero_copy_only=False).astype(U64)
                rows: dict[str, list] = {"slot": [], "choice": [], "keys": [], "fps": [], "ns": []}
                for c, masks in enumerate(balls.masks):
                    step = max(1, (1 << 21) // len(masks))
                    for i in range(0, len(fp), step):
                        f = fp[i : i + step]
                        keys = balls.mixed((balls.key(f, c)[:, None] ^ masks[None, :]).ravel())
                        order = np.argsort(keys, kind="stable")
                        keys, who = keys[order], order // len(masks)
                        slot = ((keys >> U64(max(0, balls.key_bits - 20))) * U64(slots)) >> U64(min(20, balls.key_bits))
                        cuts = np.searchsorted(slot, np.arange(slots + 1, dtype=U64))
                        for s in range(slots):
                            lo, hi = cuts[s], cuts[s + 1]
                            if hi > lo:
                                w = who[lo:hi]
                                for k, v in zip(rows, (s, c, pack_sorted(keys[lo:hi]), pack(f[w]), pack(n[i : i + step][w]))):
                                    rows[k].append(v)
                yield pa.RecordBatch.from_pydict(rows, schema=_EMITTED)

    return emit


_EMITTED = pa.schema([("slot", pa.int32()), ("choice", pa.int32()), ("keys", pa.binary()), ("fps", pa.binary()), ("ns", pa.binary())])
_FOUND = pa.schema([("fp", pa.int64()), ("near", pa.int64()), ("root", pa.int64()), ("work", pa.binary())])


def _links(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> pa.RecordBatch:
    """Per fingerprint its number of linked documents here, and the least fingerprint of its group: no pairs."""
    nodes, ids = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ids[: len(x)], ids[len(x) :]
    near = np.bincount(a, ny.astype(float), len(nodes)) + np.bincount(b, nx.astype(float), len(nodes))
    root = np.arange(len(nodes))
    while True:
        old = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, old, root)  # hooks whole trees
        root = root[root]
        if (root == old).all():
            break
    none = pa.nulls(len(nodes), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(near.astype(np.int64)), pa.array(nodes[root].view(np.int64)), none], schema=_FOUND)


def _verify(balls: Balls, choice: int, key, x, y, nx, ny) -> list:
    ok = (x != y) & (np.bitwise_count(x ^ y) <= balls.radius)
    x, y, nx, ny, key = x[ok], y[ok], nx[ok], ny[ok], key[ok]
    if not len(x):
        return []
    ok = balls.canonical(x, y, choice, key)
    return [(x[ok], y[ok], nx[ok], ny[ok])] if ok.any() else []


def _merge(found: list) -> list[pa.RecordBatch]:
    return [_links(*[np.concatenate(z) for z in zip(*found)])] if found else []


def _collide(balls: Balls, hot: int):
    def collide(key: tuple, table: pa.Table) -> pa.Table:
        choice = key[1].as_py()
        parts = [[], [], []]
        for k, f, n in zip(table["keys"], table["fps"], table["ns"]):
            for p, v in zip(parts, (unpack_sorted(k.as_py()), unpack(f.as_py()), unpack(n.as_py()))):
                p.append(v)
        keys, fp, n = (np.concatenate(p) for p in parts)
        order = np.argsort(keys, kind="stable")
        keys, fp, n = keys[order], fp[order], n[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        sizes = np.diff(np.r_[starts, len(keys)])
        out, work = [], []
        for s, m in zip(starts[sizes > hot], sizes[sizes > hot]):  # cut into blocks; each pair of blocks is a task
            cuts = list(range(s, s + m, hot))
            for i, a in enumerate(cuts):
                for b in cuts[i:]:
                    za, zb = slice(a, min(a + hot, s + m)), slice(b, min(b + hot, s + m))
                    work.append(np.r_[np.array([choice, keys[s], za.stop - za.start, a == b], U64), fp[za], n[za], fp[zb], n[zb]].tobytes())
        few = np.repeat((sizes > 1) & (sizes <= hot), sizes)
        keys, fp, n = keys[few], fp[few], n[few]
        at, d, found, held = np.arange(len(keys)), 1, [], 0
        while len(at := at[at + d < len(keys)]) and len(at := at[keys[at + d] == keys[at]]):
            for part in np.array_split(at, -(-len(at) // _PAIRS)):
                new = _verify(balls, choice, keys[part], fp[part], fp[part + d], n[part], n[part + d])
                found, held = found + new, held + sum(len(f[0]) for f in new)
                if held > _PAIRS:
                    out, found, held = out + _merge(found), [], 0
            d += 1
        out += _merge(found)
        if work:
            k = pa.nulls(len(work), pa.int64())
            out.append(pa.RecordBatch.from_arrays([k, k, k, pa.array(work, pa.binary())], schema=_FOUND))
        return pa.Table.from_batches(out, _FOUND)

    return collide


def _block_pairs(balls: Balls):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("work"):
                a = np.frombuffer(raw.as_py(), U64)
                choice, key, m, same = int(a[0]), a[1], int(a[2]), bool(a[3])
                x, nx, rest = a[4 : 4 + m], a[4 + m : 4 + 2 * m], a[4 + 2 * m :]
                y, ny = rest[: len(rest) // 2], rest[len(rest) // 2 :]
                found, held = [], 0
                for i in range(m):
                    z = slice(i + 1, None) if same else slice(None)
                    k = len(y[z])
                    new = _verify(balls, choice, np.full(k, key), np.full(k, x[i]), y[z], np.full(k, nx[i]), ny[z])
                    found, held = found + new, held + sum(len(f[0]) for f in new)
                    if held > _PAIRS:
                        yield from _merge(found)
                        found, held = [], 0
                yield from _merge(found)

    return run


def near_groups(groups: DataFrame, radius: int = 6, blocks: int = 4, keep: int = 2, hot: int = 20_000) -> DataFrame:
    """groups (fp long, n long; distinct fp) -> written table (fp, near, root): a row for each fingerprint and bucket
    in which it has links; near adds up to the documents linked to it, (fp, root) spans the links' components."""
    spark, balls = groups.sparkSession, Balls(radius, blocks, keep)
    slots = partitions(spark)
    spread = groups.select("fp", "n").repartition(slots)  # few rows become many here
    schema = "slot int, choice int, keys binary, fps binary, ns binary"
    emitted = spread.mapInArrow(_emit(balls, slots), schema)
    found = emitted.groupBy("slot", "choice").applyInArrow(_collide(balls, hot), "fp long, near long, root long, work binary")
    found = written(found, "collisions")
    # a hot bucket's blocks: as many tasks as there are pairs of blocks
    rest = found.where("work is not null").select("work").repartition(slots).mapInArrow(_block_pairs(balls), "fp long, near long, root long, work binary")
    return found.where("work is null").select("fp", "near", "root").unionByName(rest.select("fp", "near", "root"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long -> (node, root): the least node reachable, by alternating large and small stars.

    Each round is a written table; minima are aggregated before the shuffle, so a hub isn't gathered in one task.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        j = large.join(low, "a")
        small = j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        edges = written(small, "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.min(F.xxhash64("b", "a"))).first()
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        before = now


def near_duplicates(docs: DataFrame, radius: int = 6, blocks: int = 4, keep: int = 2, unit: str = "pairs") -> DataFrame:
    """docs (doc_id, text) -> (doc_id, fp long, n_near long, component_id).

    n_near: other documents whose fingerprint differs in at most `radius` bits. component_id: the least doc_id
    reachable by links, itself included. Null text: as empty. Wordless documents share fingerprint 0 and are linked.
    A null doc_id counts as a document and links others, but is never a component_id (null only if all are null).
    Repeated rows are documents of their own. Empty table: no rows. Other columns are ignored.
    """
    fps = written(fingerprints(docs, unit), "fingerprints")
    groups = written(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "groups")
    found = near_groups(groups, radius, blocks, keep)
    found = written(found.groupBy("fp", "root").agg(F.sum("near").alias("near")), "links")
    near = found.groupBy("fp").agg(F.sum("near").alias("near"))
    roots = components(found.select(F.col("fp").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "fp")
    g = groups.join(near, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = g.groupBy("root").agg(F.min("least").alias("component_id"))
    g = g.join(least, "root").select("fp", (F.coalesce("near", F.lit(0)) + F.col("n") - 1).alias("n_near"), "component_id")
    return fps.join(g, "fp").select("doc_id", "fp", "n_near", "component_id")
