"""Benchmark decontamination by greedy string tiling.

Benchmark items' windows of `least` tokens are joined to documents by Karp-Rabin hashes of token sequences. For a
document and an item that share such seeds, matches are marked greedily: again and again the longest one that
overlaps none marked before (ties: first in the item, then in the document). The share of the item's tokens marked is
its coverage, which reordered passages reach too.

Documents aren't shuffled. The benchmark is a query set: it goes to the documents in blocks of at most `block` tokens,
each a bounded broadcast, however large it is.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import U64, pick, release, slices, strings

LEAST, COVERAGE, BLOCK = 5, 0.5, 2_000_000
#: Where an item and a document have more pairs of places than this for each token of either, matches are sought by an
#: automaton; the tiles are the same.
MANY = 8
_MULT = U64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def greedy_tiles(diagonals: dict[int, list[tuple[int, int]]], n_item: int, n_doc: int, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, document position, length) from maximal matches: diagonal -> [(item position, length)].

    A match of which a part has been marked is cut to its free stretches and waits with them.
    """
    heap = [(-n, j, j - d) for d, runs in diagonals.items() for j, n in runs if n >= least]
    heapq.heapify(heap)
    item, doc, out = bytearray(n_item), bytearray(n_doc), []
    while heap:
        n, j, i = heapq.heappop(heap)
        n = -n
        if not any(item[j : j + n]) and not any(doc[i : i + n]):
            out.append((j, i, n))
            item[j : j + n] = doc[i : i + n] = b"\1" * n
            continue
        s = None
        for k in range(n + 1):
            free = k < n and not item[j + k] and not doc[i + k]
            if free and s is None:
                s = k
            elif not free and s is not None:
                if k - s >= least:
                    heapq.heappush(heap, (-(k - s), j + s, i + s))
                s = None
    return out


def _longest(item: list[int], doc: list[int], marked_item: bytearray, marked_doc: bytearray) -> tuple[int, int, int]:
    """(length, item position, document position) of the longest match of free tokens; ties: first in the item, then in
    the document. A suffix automaton of the item's free stretches is run over the document's, so repeats cost no more
    than other tokens."""
    nxt: list[dict] = [{}]
    link, size, first, last = [-1], [0], [-1], 0
    for j, c in enumerate(item):
        if marked_item[j]:
            c = -1 - j  # matches nothing
        cur = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        first.append(j)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if size[p] + 1 == size[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    best, v, n = (0, 0, 0), 0, 0
    for i, c in enumerate(doc):
        if marked_doc[i]:
            v = n = 0
            continue
        while v and c not in nxt[v]:
            v = link[v]
            n = size[v]
        if c in nxt[v]:
            v, n = nxt[v][c], n + 1
        if n and n >= best[0]:
            j = first[v] - n + 1
            if n > best[0] or j < best[1]:
                best = (n, j, i - n + 1)
    return best


def running_tiles(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """The same tiles as greedy_tiles, without listing matches: for sequences whose tokens repeat very often. At most
    len(item) / least rounds of one pass each."""
    mi, md, out = bytearray(len(item)), bytearray(len(doc)), []
    while True:
        n, j, i = _longest(item, doc, mi, md)
        if n < least:
            return out
        out.append((j, i, n))
        mi[j : j + n] = md[i : i + n] = b"\1" * n


class Tiler:
    """A block of benchmark items: (item_id, tokens). An item of fewer than `least` tokens matches as a whole only."""

    def __init__(self, items: list[tuple[int | None, list[str]]], least: int = LEAST):
        if least < 1:
            raise ValueError("least must be at least 1")
        self.items, self.least, self.ids = items, least, {}
        self.coded = [[self.ids.setdefault(t, len(self.ids) + 1) for t in toks] for _, toks in items]
        #: By seed length: hash of a seed -> its places (item, position), and the hashes in order.
        self.seeds: dict[int, tuple[dict[int, list[tuple[int, int]]], np.ndarray]] = {}
        for x, codes in enumerate(self.coded):
            k = min(least, len(codes))
            if k:
                places = self.seeds.setdefault(k, (defaultdict(list), np.zeros(0, U64)))[0]
                for j, h in enumerate(self._hashes(np.array(codes, np.int64), k).tolist()):
                    places[h].append((x, j))
        self.seeds = {k: (dict(p), np.sort(np.array(list(p), U64))) for k, (p, _) in self.seeds.items()}

    @staticmethod
    def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
        """Karp-Rabin, of each window of k codes."""
        n = len(codes) - k + 1
        if n <= 0:
            return np.zeros(0, U64)
        c = codes.astype(U64) * U64(0xD6E8FEB86659FD93)
        c ^= c >> U64(32)
        h = np.zeros(n, U64)
        for i in range(k):
            h = h * _MULT + c[i : i + n]
        return h

    def match(self, toks: list[str]) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(index of item, its tiles) for each item that shares a seed."""
        get = self.ids.get
        codes = np.fromiter((get(t, 0) for t in toks), np.int64, len(toks))
        zero, out = np.r_[0, np.cumsum(codes == 0)], []
        for k, (places, known) in self.seeds.items():
            if k > len(codes):
                continue
            at = np.flatnonzero(zero[k:] == zero[:-k])
            h = self._hashes(codes, k)[at]
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            if hit.any():
                out += self._tile(codes.tolist(), at[hit], h[hit], k, places)
        return sorted(out)

    def _tile(self, code: list[int], at: np.ndarray, h: np.ndarray, k: int, places: dict) -> list[tuple[int, list[tuple[int, int, int]]]]:
        pairs: Counter = Counter()
        values, counts = np.unique(h, return_counts=True)
        for v, n in zip(values.tolist(), counts.tolist()):
            for x, _ in places[v]:
                pairs[x] += n
        # tokens that repeat so often that places would be paired with places: no matches are listed
        many = {x for x, n in pairs.items() if n > MANY * (len(self.coded[x]) + len(at))}
        out = [(x, tiles) for x in many if (tiles := running_tiles(self.coded[x], code, k))]
        diagonals: dict = defaultdict(lambda: defaultdict(list))
        if len(many) < len(pairs):
            for i, v in zip(at.tolist(), h.tolist()):
                for x, j in places[v]:
                    if x not in many and code[i : i + k] == self.coded[x][j : j + k]:
                        runs = diagonals[x][j - i]
                        if runs and runs[-1][0] + runs[-1][1] - k + 1 == j:
                            runs[-1] = (runs[-1][0], runs[-1][1] + 1)
                        else:
                            runs.append((j, k))
        return out + [(x, greedy_tiles(d, len(self.coded[x]), len(code), k)) for x, d in diagonals.items()]

    def coverage(self, x: int, tiles: list[tuple[int, int, int]]) -> float:
        return sum(n for _, _, n in tiles) / len(self.coded[x])


def blocks(benchmark: DataFrame, least: int = LEAST, most: int = BLOCK) -> Iterator[Tiler]:
    """The benchmark's items in blocks of at most `most` tokens (an item of more is a block of its own); items without
    tokens match nothing. One block at a time is held by the driver."""
    held, size = [], 0
    for r in pick(benchmark, "item_id", "text").toLocalIterator():
        t = tokens(r.text)
        if not t:
            continue
        if held and size + len(t) > most:
            yield Tiler(held, least)
            held, size = [], 0
        held.append((r.item_id, t))
        size += len(t)
    if held:
        yield Tiler(held, least)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block: int = BLOCK) -> DataFrame:
    """docs (doc_id, text), benchmark (item_id, text) -> (doc_id, item_id, coverage, n_tiles, n_tokens, tiles): each
    document and item of which the tiles cover at least `coverage`.

    Null or empty texts match nothing. Null and repeated doc_ids and item_ids are kept as they are, a row each. An
    empty table on either side: no rows. Other columns are ignored. Map only.
    """
    spark = docs.sparkSession
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, coverage double, n_tiles long, n_tokens long, tiles array<struct<item_at:int,doc_at:int,length:int>>"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = spark.createDataFrame([], schema)
    for tiler in blocks(benchmark, least, block):
        known = spark.sparkContext.broadcast(tiler)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            t = known.value
            tile = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))
            for b in slices(batches):
                where, rows = [], []
                for i, text in enumerate(strings(b.column("text"))):
                    for x, tiles in t.match(tokens(text)):
                        c = t.coverage(x, tiles)
                        if c >= coverage:
                            where.append(i)
                            rows.append((t.items[x][0], c, len(tiles), sum(n for _, _, n in tiles), [{"item_at": j, "doc_at": i, "length": n} for j, i, n in tiles]))
                ids = b.column("doc_id").take(pa.array(where, pa.int64()))
                cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, (item_type, pa.float64(), pa.int64(), pa.int64(), tile))]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=["doc_id", "item_id", "coverage", "n_tiles", "n_tokens", "tiles"])

        out = out.unionByName(pick(docs, "doc_id", "text").mapInArrow(run, schema))
    return out


def is_contaminated(text: Column, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE, block: int = BLOCK) -> Column:
    """A boolean column: some item is covered; null or empty text, or an empty benchmark: false. A column of an
    expression, so other columns of the table can't clash with it."""
    out = F.lit(False)
    for tiler in blocks(benchmark, least, block):
        known = benchmark.sparkSession.sparkContext.broadcast(tiler)

        out = out | _covered(known, coverage)(text)
    return out


def _covered(known, coverage: float):
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        release()
        t = known.value
        return s.map(lambda x: any(t.coverage(i, tiles) >= coverage for i, tiles in t.match(tokens(x)))).astype(bool)

    return run
