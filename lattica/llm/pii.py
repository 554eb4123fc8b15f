"""Personal data by a skip-chain conditional random field.

Variables are the tokens that can carry personal data (those with a digit or an @); all others are O by definition.
A chain potential joins neighbours with no word between them. A skip potential joins a token to the previous one in the
document that repeats it exactly, whatever its length, and to the previous similar one (the same last seven digits, or
the same mailbox), so a group of repeats is a chain of links and never all pairs. Loopy message passing then makes the labels of a document's mentions agree.
What the base detectors found is given; the field infers the labels of all other tokens from shape, context and links.
Weights are trained here, by pseudo-likelihood on all documents, with the base detectors' findings as labels. For the
links to be learned, findings are also mentioned again in part, unseen by the base detectors, and so are mailboxes and
numbers of the same shape that were never found, which are no personal data. A token's features and its
neighbours' labels take few different values, so only their counts come to the driver, not texts.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices, strings

KINDS = ("email", "ip", "card", "phone")
LABELS = ("o", *KINDS)
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
# from the token's beginning only, so a long token without a digit is read once
_TOKEN = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*")
_CUES = ({"mail", "email", "e-mail", "contact", "write"}, {"ip", "host", "address", "server"}, {"card", "visa", "mastercard", "amex", "cc"}, {"phone", "tel", "call", "fax", "mobile", "cell"})

Span = tuple[int, str, int]
#: The potential of a label that is given.
SURE = 20.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, in linear time."""
    low, at = 0, text.find("@")
    while at >= 0:
        part = text[low:at]
        start = low + len(part.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        low = m.end() if m else at + 1
        at = text.find("@", low)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if "@" in text:
        out += [(s, "email", e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text):
            d = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _rejected(text: str) -> list[tuple[int, int]]:
    """Where a base pattern matched too many or too few digits, so that its silence says nothing."""
    digits = lambda m: sum("0" <= c <= "9" for c in m.group())
    out = [m.span() for m in _PHONE.finditer(text) if not 9 <= digits(m) <= 15] if "+" in text else []
    return out + [m.span() for m in _CARD.finditer(text) if digits(m) > 19]


# the field

_SHAPES = 13
FEATURES = 1 + _SHAPES + len(_CUES)


def _before(text: str, at: int) -> list[str]:
    """The last two words before a place, whole."""
    n = 64
    while True:
        words = text[max(0, at - n) : at].split()
        if len(words) > 2 or n >= at:
            return words[-2:]
        n *= 8


def nodes(text: str, base: list[Span]) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """(spans, features, base labels, chain links, skip links) of the document's candidate tokens."""
    spans, feats, labels, keys = [], [], [], []
    bi = 0
    for m in _TOKEN.finditer(text):
        s, e = m.span()
        while s < e and text[e - 1] in ".,;:!?)\"'":
            e -= 1
        while s < e and text[s] in "(\"'":
            s += 1
        if s == e:
            continue
        tok = text[s:e]
        while bi < len(base) and base[bi][2] <= s:
            bi += 1
        label = LABELS.index(base[bi][1]) if bi < len(base) and base[bi][0] < e else 0
        digits = "".join(c for c in tok if "0" <= c <= "9")
        n = len(digits)
        before = [w.strip(".,:;()").lower() for w in _before(text, s)]
        summed = 12 <= n <= 19 and luhn(digits)
        shape = ["@" in tok, n == 0, 1 <= n <= 3, 4 <= n <= 6, 7 <= n <= 10, n > 10, tok.count(".") == 3, "+" in tok, "-" in tok, tok.isdigit(), any(c.isalpha() for c in tok), summed, n >= 12 and not summed]
        cue = [any(w in c for w in before) for c in _CUES]
        # what makes two mentions similar: the mailbox, or the last seven digits of a number and of those just before
        run = digits
        if "@" not in tok and spans and keys[-1] and keys[-1][0] == "#" and text[spans[-1][1] : s].strip(" ()-+") == "":
            run = keys[-1][1] + digits
        spans.append((s, e))
        feats.append([1, *shape, *cue])
        labels.append(label)
        keys.append(("@", tok.partition("@")[0].lower()) if "@" in tok else ("#", run[-19:]) if n else None)
    chain = [(i - 1, i) for i in range(1, len(spans)) if not text[spans[i - 1][1] : spans[i][0]].strip(" \t\r\n()-.,;:")]
    last: dict[tuple[str, str], int] = {}
    skip = []
    for i, ((s, e), k) in enumerate(zip(spans, keys)):
        # repeated exactly, of any length; similar, at seven digits or more
        same, like = ("=", text[s:e]), k and (k[0], k[1][-7:] if k[0] == "#" else k[1])
        if like and like[0] == "#" and len(like[1]) < 7:
            like = None
        skip += [(j, i) for j in sorted({last[x] for x in (same, like) if x in last})]
        last[same] = i
        if like:
            last[like] = i
    return spans, np.array(feats, float).reshape(len(spans), FEATURES), np.array(labels, int), chain, skip


def _mentions(text: str) -> Iterator[tuple[str, list[Span]]]:
    """The text, and the text with each of its findings mentioned again in part, with these mentions' labels: what
    the base detectors can't see and only the link explains; and with strangers of the same shape, which are nothing."""
    yield text, []
    base = base_spans(text)
    again, given, strange = text, [], text
    for s, kind, e in base:
        part = text[s:e].rpartition(" ")[2]
        digits = "".join(c for c in text[s:e] if c.isdigit())
        if kind == "email":
            part = text[s:e].partition("@")[0] + "@"
        elif sum(c.isdigit() for c in part) != 7:
            part = digits[-7:]
        if kind == "email" or kind != "ip" and len(part) >= 7:
            again += " also "
            given.append((len(again), kind, len(again) + len(part)))
            again += part
            strange += " also " + (part[::-1].lstrip("@") + "x@" if kind == "email" else part.translate(_OTHER))
    if given:
        yield again, given
        yield strange, []


_OTHER = str.maketrans("0123456789", "3456789012")


def examples(text: str) -> Iterator[tuple[bytes, int]]:
    """(features, counts of labels at the other ends of chain and of skip links, as bytes; label) of each candidate
    token of the text and of the text with its findings' further mentions; and once more with no neighbour's label
    known, else "all are nothing" and "all are one phone" would explain a run equally well. Tokens of which the base
    detectors took too much or too little to decide are left out."""
    n = len(LABELS)
    for t, given in _mentions(text):
        spans, f, y, chain, skip = nodes(t, base_spans(t))
        y = np.array([next((LABELS.index(k) for a, k, b in given if a < e and s < b), v) for (s, e), v in zip(spans, y)], int)
        doubtful = _rejected(t)
        open_ = np.array([not v and any(a < e and s < b for a, b in doubtful) for (s, e), v in zip(spans, y)], bool)
        near = np.zeros((len(y), 2 * n))
        for at, links in ((0, chain), (n, skip)):
            for a, b in links:
                near[a, at + y[b]] += not open_[b]
                near[b, at + y[a]] += not open_[a]
        for seen in (near, 0 * near):
            for row, label in zip(np.hstack([f, seen])[~open_].astype(np.uint8), y[~open_].tolist()):
                yield row.tobytes(), label


class SkipChain:
    """weights: features x labels; chain and skip: symmetric label x label potentials (logarithms)."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    @classmethod
    def train(cls, texts: list[str], **options) -> SkipChain:
        return cls.fit(Counter(x for t in texts for x in examples(t)), **options)

    @classmethod
    def fit(cls, counts: dict[tuple[bytes, int], int], steps: int = 400, l2: float = 1e-5) -> SkipChain:
        """Pseudo-likelihood: each label given its token's features and its neighbours' labels; counts of examples()."""
        n = len(LABELS)
        w = np.zeros((FEATURES + 2 * n, n))
        if counts:
            keys = sorted(counts)
            x = np.frombuffer(b"".join(k for k, _ in keys), np.uint8).reshape(len(keys), -1).astype(float)
            y = np.eye(n)[[label for _, label in keys]]
            c = np.array([counts[k] for k in keys], float)[:, None]
            c /= c.sum()
            m, v = np.zeros_like(w), np.zeros_like(w)
            for t in range(1, steps + 1):
                p = x @ w
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                g = x.T @ (c * (p - y)) + l2 * w
                for k in (FEATURES, FEATURES + n):  # potentials are symmetric
                    g[k : k + n] = (g[k : k + n] + g[k : k + n].T) / 2
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        else:  # nothing to learn from: the base labels alone
            w[0, 0] = 4
        return cls(w[:FEATURES], w[FEATURES : FEATURES + n], w[FEATURES + n :])

    def marginals(self, f: np.ndarray, chain: list[tuple[int, int]], skip: list[tuple[int, int]], given: np.ndarray | None = None) -> np.ndarray:
        """given: known labels, 0 where there is none. Loopy sum-product with damping, until no message moves; a message each way on every link.

        Only messages whose inputs moved are computed again. The bound on the rounds follows the longest path of links
        (damped, a message takes some two rounds a link), so it only ends rounds that don't converge.
        """
        unary = f @ self.weights
        if given is not None:
            known = np.flatnonzero(given)
            unary[known] = -SURE
            unary[known, given[known]] = SURE
        if chain or skip:
            links = chain + skip
            a = np.array([x for x, _ in links] + [y for _, y in links])
            b = np.array([y for _, y in links] + [x for x, _ in links])
            kind, pots = np.tile(np.repeat([0, 1], [len(chain), len(skip)]), 2), np.stack([self.chain, self.skip])
            back = np.r_[len(links) : 2 * len(links), 0 : len(links)]
            far = [0] * len(unary)
            for x, y in sorted(links):  # x < y
                far[y] = max(far[y], far[x] + 1)
            msg = np.zeros((len(a), len(LABELS)))
            live = np.arange(len(a))
            for _ in range(50 + 4 * max(far)):
                z = (unary[a[live]] - msg[back[live]])[:, :, None] + pots[kind[live]]
                top = z.max(1)
                new = top + np.log(np.exp(z - top[:, None, :]).sum(1))
                new -= new.max(1, keepdims=True)
                step = 0.5 * (new - msg[live])
                moved = np.abs(step).max(1) >= 5e-5
                live, step = live[moved], step[moved]
                if not len(live):
                    break
                msg[live] += step
                np.add.at(unary, b[live], step)
                heard = np.zeros(len(unary), bool)
                heard[b[live]] = True
                again = heard[a]
                again[live] = True
                live = np.flatnonzero(again)
        p = np.exp(unary - unary.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[Span], sure: float = 0.8) -> list[Span]:
        """The spans that the field adds to the base ones: runs of neighbouring tokens of one label, outside them."""
        spans, f, y, chain, skip = nodes(text, base)
        if not len(y):
            return []
        p = self.marginals(f, chain, skip, y)
        out: list[Span] = []
        for i, (s, e) in enumerate(spans):
            k = int(p[i].argmax())
            if k == 0 or y[i] or p[i, k] < sure:
                continue
            if out and out[-1][1] == LABELS[k] and text[out[-1][2] : s].strip(" ()-\n") == "" and sum(map(str.isdigit, text[out[-1][0] : e])) <= 19:
                out[-1] = (out[-1][0], LABELS[k], e)
            else:
                out.append((s, LABELS[k], e))
        return out


def train(docs: DataFrame) -> SkipChain:
    """Trained on all documents, by the base detectors' labels. What comes to the driver is a row for each different
    example (features and neighbours' labels are small counts, so their number has a bound that no corpus moves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for b in slices(batches):
            for t in strings(b.column("text")):
                if "@" in t or _DIGIT.search(t):
                    found.update(examples(t))
        rows = [(k, y, n) for (k, y), n in found.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 3, (pa.binary(), pa.int32(), pa.int64()))], names=["example", "label", "n"])

    counted = pick(docs, "text").mapInArrow(run, "example binary, label int, n long").groupBy("example", "label").agg(F.sum("n").alias("n"))
    return SkipChain.fit({(bytes(r.example), r.label): r.n for r in counted.collect()})


def spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def find_documents(docs: DataFrame, model: SkipChain) -> DataFrame:
    """docs (doc_id, text) -> per row: counts and digest of the base findings, all spans, and how many were added.

    Null text: as empty. Rows keep their doc_id whatever it is (null, repeated); other columns are ignored. Empty
    table: no rows. Map only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t in strings(b.column("text")):
                base = base_spans(t)
                more = model.added(t, base) if "@" in t or _DIGIT.search(t) else []
                n = Counter(k for _, k, _ in base)
                both = sorted(base + more, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                rows.append((*[n[k] for k in KINDS], hashlib.sha256(spell(base).encode()).hexdigest(), spell(both), len(more)))
            types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return pick(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
