"""Each query against a brute-force version, on odd rows, an empty table and a small corpus."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from tokenizers import Tokenizer

from lattica.llm import queries as Q
from lattica.llm import tiling
from lattica.llm.tokens import public

from .conftest import docs_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def same(a, b):
    key = lambda r: sorted((k, str(v)) for k, v in r.items())
    assert sorted(a, key=key) == sorted(b, key=key)


def spell(spans, kinds):
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], kinds.index(x[1]))))


def test_op1(spark, folder):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = []
    for d, t, *_ in docs_of(spark, folder):
        t = t or ""
        s = [(m.start(), "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        s += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        s += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(k for _, k, _ in s)
        want.append({"doc_id": d, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "base_sha256": hashlib.sha256(spell(s, ["assign", "access", "hex"]).encode()).hexdigest()})
    got = rows(Q.op1_secret_scan(spark, folder))
    same([{k: r[k] for k in want[0]} for r in got], want) if want else None
    assert len(got) == len(want)


def test_op2(spark, folder):
    t = Tokenizer.from_file(public("byte_bpe_50k.json"))
    want, start = [], 0
    docs = docs_of(spark, folder)
    for d, text, *_ in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows(Q.op2_seekable_frames(spark, folder))]
    assert sum(r[2] for r in got) == start
    unique = lambda rs: sorted(r for r in rs if r[0] is not None)  # noqa: E731  (ties may come in any order)
    assert unique(got) == unique(want)
    at = 0
    for _, s, n, _ in sorted(got, key=lambda r: r[1]):
        assert s == at
        at += n


def test_op3(spark, folder):
    docs = docs_of(spark, folder)
    got = rows(Q.op3_simhash(spark, folder))
    assert len(got) == len(docs)
    known = sorted(((d, t or "") for d, t, *_ in docs if d is not None), key=lambda r: r[0])
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    prints = {}
    for (d, t), (_, nxt) in zip(known, known[1:]):
        if sum(x == d for x, _ in known) > 1:
            continue
        n = len(t) // 2
        edited = t[: len(t) - n] + nxt[:n]
        r = by[d]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        for text, fp in ((t, r["fingerprint"]), (edited, r["edited_fingerprint"])):
            assert prints.setdefault(text, fp) == fp
    if folder.endswith("sf0.001"):
        long = [r for r in got if r["n_chars"] > 500]
        assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9


def test_op4(spark, folder):
    docs = docs_of(spark, folder)
    fps = []
    for _, t, *_ in docs:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sh = [f"{a} {b}" for a, b in zip(w, w[1:])] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append(sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h)))
    n = len(docs)
    near = [[j for j in range(n) if j != i and (fps[i] ^ fps[j]).bit_count() <= 6] for i in range(n)]
    comp = list(range(n))
    for _ in range(n):
        comp = [min([comp[i], *(comp[j] for j in near[i])]) for i in range(n)]
    least = defaultdict(list)
    for i in range(n):
        if docs[i][0] is not None:
            least[comp[i]].append(docs[i][0])
    want = [{"doc_id": docs[i][0], "fingerprint": f"{fps[i]:016x}", "n_near": len(near[i]), "component_id": min(least[comp[i]], default=None)} for i in range(n)]
    same(rows(Q.op4_ball_hashing(spark, folder)), want)


def test_op5(spark, folder):
    got = rows(Q.op5_cotraining(spark, folder))
    docs = docs_of(spark, folder)
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in docs)
    assert all(0 <= r["p_quality"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in got)


def test_op6(spark, folder):
    docs = docs_of(spark, folder)
    got = rows(Q.op6_uniform_shuffle(spark, folder))
    raw = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(raw(t)) + 1, zlib.crc32(raw(t))) for d, t, *_ in docs)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and not set(by) - set(range(8))
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def brute_tiles(item, doc, least):
    mi, md, out = [0] * len(item), [0] * len(doc), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while j + n < len(item) and i + n < len(doc) and item[j + n] == doc[i + n] and not mi[j + n] and not md[i + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (j, i, n)
        if best is None:
            return out
        out.append(best)
        j, i, n = best
        mi[j : j + n] = md[i : i + n] = [1] * n


def test_op7(spark, folder):
    items = [(r.item_id, tiling.tokens(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    want = []
    for d, t, *_ in docs_of(spark, folder):
        toks = tiling.tokens(t)
        for x, item in items:
            k = min(5, len(item))
            grams = {tuple(item[j : j + k]) for j in range(len(item) - k + 1)}
            at = [i for i in range(len(toks) - k + 1) if tuple(toks[i : i + k]) in grams]
            if not item or not at:
                continue
            tiles = brute_tiles(item, toks[: at[-1] + len(item) + k], k)
            c = sum(n for *_, n in tiles) / len(item)
            if c >= 0.5:
                want.append({"doc_id": d, "item_id": x, "coverage": c, "n_tiles": len(tiles), "n_tokens": sum(n for *_, n in tiles)})
    same(rows(Q.op7_string_tiling(spark, folder)), want)


def test_op8(spark, folder):
    t = Tokenizer.from_file(public("word_bpe_49k.json"))
    docs = docs_of(spark, folder)
    ids = defaultdict(list)
    for d, text, *_ in docs:
        ids[d].append(t.encode(text or "", add_special_tokens=False).ids + [1])
    got = rows(Q.op8_packing(spark, folder))
    seqs, total = defaultdict(list), Counter()
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        total[r["doc_id"]] += r["length"]
        whole = [x for x in ids[r["doc_id"]] if len(x) == r["doc_tokens"]]
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in whole)
    assert total == Counter({d: sum(map(len, x)) for d, x in ids.items()})
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048


def test_op9(spark, folder):
    docs = [(d, WORD.findall(t or "")) for d, t, *_ in docs_of(spark, folder)]
    least = {}
    for d, w in docs:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            if d is not None:
                least[k] = min(d, least.get(k, d))
    want = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append({"doc_id": d, "n_words": len(w), "n_removed": len(gone), "kept_sha256": hashlib.sha256(left.encode()).hexdigest()})
    same(rows(Q.op9_repeated_windows(spark, folder)), want)


def test_op10(spark, folder):
    kinds = ["email", "ip", "card", "phone"]
    want = []
    for d, t, *_ in docs_of(spark, folder):
        s, t = [], t or ""
        s += [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        s += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            g = [int(c) for c in m[0] if c.isdigit()][::-1]
            if 12 <= len(g) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(g)) % 10 == 0:
                s.append((m.start(), "card", m.end()))
        s += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        n = Counter(k for _, k, _ in s)
        want.append({"doc_id": d, **{f"n_{k}": n[k] for k in kinds}, "base_sha256": hashlib.sha256(spell(s, kinds).encode()).hexdigest(), "base": spell(s, kinds)})
    got = rows(Q.op10_personal_data(spark, folder))
    keys = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    same([{k: r[k] for k in keys} for r in got], [{k: r[k] for k in keys} for r in want])
    spans = defaultdict(list)
    for r in got:
        spans[r["doc_id"]].append(set(r["spans"].split(",")))
    for r in want:
        assert any(set(r["base"].split(",")) <= s | {""} for s in spans[r["doc_id"]])
