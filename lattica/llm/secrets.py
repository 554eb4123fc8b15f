"""Secret scan with multipart credential linking.

Base findings stand on their own: assignments, access-key identifiers, long hex runs. Beside them there are parts that
mean little alone: identifiers (named accounts, mailboxes), opaque strings, endpoints (URLs, named hosts, addresses).
Within a scope (text between blank lines) each part covers the interval of its span widened by `reach` code points; a
weak part is reported only where its interval meets that of a complementary part: an opaque string needs an access
identifier, an identifier or endpoint needs a secret. Base findings take part on either side: an access key identifies,
an assignment or hex run is a secret. The interval join is a sorted sweep inside the task that scans the text, so it
needs no shuffle and no pairs are listed. What belongs together is returned as credentials: each secret with the
nearest identifier and the nearest endpoint that its interval meets.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, release, slices, strings

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identifier", "opaque", "endpoint")
REACH = 400

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_IDENTIFIER = re.compile(r"""\b(?:user(?:name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id)\b["']?\x20?[:=]\x20?["']?([A-Za-z0-9@._-]{3,})""", re.I | re.A)
# '=' may stand before the run (KEY=VALUE); behind it only as padding, so a key's name is no match
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""\b[a-z](?:[a-z0-9+.-]{1,15}|[a-z0-9]{16,}+)://[^\s"'<>]{3,}|\b(?:host|endpoint|server)["']?\x20?[:=]\x20?["']?([A-Za-z0-9.-]{3,}(?::[0-9]{2,})?)""", re.I | re.A)
_MAILBOX = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ADDRESS = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]+)?(?![0-9.]*[0-9])")
_SCOPE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, str, int]


def _base(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def _is_opaque(s: str) -> bool:
    """Three kinds of characters and at least three bits of entropy a character."""
    kinds = any(c.isdigit() for c in s) + any("a" <= c <= "z" for c in s) + any("A" <= c <= "Z" for c in s)
    return kinds == 3 and -sum(n / len(s) * log2(n / len(s)) for n in Counter(s).values()) >= 3


def _weak(text: str) -> list[Span]:
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [(m.start(1), "identifier", m.end(1)) for m in _IDENTIFIER.finditer(text)]
        out += [(m.start(m.lastindex or 0), "endpoint", m.end(m.lastindex or 0)) for m in _ENDPOINT.finditer(text)]
    if "@" in text:
        out += [(m.start(), "identifier", m.end()) for m in _MAILBOX.finditer(text)]
    out += [(m.start(), "endpoint", m.end()) for m in _ADDRESS.finditer(text)]
    return out + [(m.start(), "opaque", m.end()) for m in _OPAQUE.finditer(text) if _is_opaque(m.group())]


def unions(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans made one, ascending."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _free(weak: list[Span], base: list[Span]) -> list[Span]:
    """The weak parts that touch no base span; of parts of one kind that overlap only the first (of those that begin
    together, the longest). What is an identifier isn't opaque as well."""
    taken = unions([(s, e) for s, _, e in base])
    out: list[Span] = []
    for kind in ("identifier", "endpoint", "opaque"):
        starts, at = [s for s, _ in taken], 0
        for s, _, e in sorted((w for w in weak if w[1] == kind), key=lambda w: (w[0], -w[2])):
            i = bisect_left(starts, e)
            if s >= at and (i == 0 or taken[i - 1][1] <= s):
                out.append((s, kind, e))
                at = e
        if kind == "endpoint":
            taken = unions(taken + [(s, e) for s, k, e in out if k == "identifier"])
    return out


Part = tuple[int, int, int]


def _nearest(parts: list[Part], scope: int, s: int, e: int, reach: int) -> Part | None:
    """Of disjoint ascending parts (scope, start, end), the nearest whose widened interval meets that of (s, e)."""
    i, best = bisect_left(parts, (scope, s, e)), None
    for j in (i - 1, i):
        if 0 <= j < len(parts) and parts[j][0] == scope:
            gap = max(parts[j][1] - e, s - parts[j][2], 0)
            if gap <= 2 * reach and (best is None or gap < best[0]):
                best = (gap, parts[j])
    return best and best[1]


Credential = tuple[Span, Span | None, Span | None]


def link(text: str, base: list[Span], weak: list[Span], reach: int = REACH) -> tuple[list[Span], list[Credential]]:
    """(the weak parts whose widened interval meets a complementary part's in the same scope; the credentials).

    An opaque part that an identifier confirms counts as a secret for identifiers and endpoints. Parts that touch a
    base span are left out. A credential is (secret, nearest identifier, nearest endpoint), either of which may be
    None but not both; overlapping base secrets are one, from the first's start to the last's end and named by the
    first. Parts are sorted once and found by bisection.
    """
    weak = _free(weak, base)
    ends = [m.start() for m in _SCOPE.finditer(text)]
    at = lambda s: bisect_right(ends, s)

    def parts(kinds: tuple[str, ...], given: list[Span]) -> list[Part]:
        return [(at(s), s, e) for s, e in unions([(s, e) for s, k, e in given if k in kinds])]

    identifiers = parts(("identifier", "access"), base + weak)
    opaque = [w for w in weak if w[1] == "opaque" and _nearest(identifiers, at(w[0]), w[0], w[2], reach)]
    known = [x for x in base if x[1] != "access"] + opaque
    secrets, endpoints = parts(("assign", "hex", "opaque"), known), parts(("endpoint",), weak)
    sure = {(s, e) for s, _, e in opaque}
    linked = [w for w in weak if ((w[0], w[2]) in sure if w[1] == "opaque" else _nearest(secrets, at(w[0]), w[0], w[2], reach))]
    first: dict[int, str] = {}
    for s, k, _ in sorted(known, key=lambda x: (x[0], KINDS.index(x[1]))):
        first.setdefault(s, k)
    names = {(s, e): k for s, k, e in base + weak if k != "opaque"}
    found: list[Credential] = []
    for scope, s, e in secrets:
        who, where = _nearest(identifiers, scope, s, e, reach), _nearest(endpoints, scope, s, e, reach)
        if who or where:
            spell_part = lambda p, k: p and (p[1], names.get((p[1], p[2]), k), p[2])
            found.append(((s, first[s], e), spell_part(who, "identifier"), spell_part(where, "endpoint")))
    return linked, found


def scan(text: str | None, reach: int = REACH) -> tuple[list[Span], list[Span], list[Credential]]:
    """(base spans, linked weak spans, credentials) of a whole text, spans by start and then kind; code points, end
    exclusive.

    Null and empty texts have none.
    """
    if not text:
        return [], [], []
    base = _base(text)
    # an opaque part needs an identifier, the others a secret: without '=', ':', '@' or a key there are no links
    weak = _weak(text) if base or "=" in text or ":" in text or "@" in text else []
    order = lambda x: (x[0], KINDS.index(x[1]), x[2])
    linked, found = link(text, base, weak, reach) if base or weak else ([], [])
    return sorted(base, key=order), sorted(linked, key=order), found


def spell(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


_OUT = "doc_id {}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long, n_credentials long, credentials string, linked array<struct<kind:string,start:int,end:int,value:string>>"


def scan_documents(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs (doc_id, text) -> per row the counts, digest and spans of its findings, its credentials (the parts of each
    joined by +, separated by commas), and the linked weak parts with their text.

    Null text: as empty. Rows keep their doc_id whatever it is (null, repeated); other columns are ignored. Empty
    table: no rows. Map only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for t in strings(b.column("text")):
                base, linked, creds = scan(t, reach)
                n = Counter(k for _, k, _ in base)
                both = sorted(base + linked, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(spell(base).encode()).hexdigest(), spell(both), len(linked), len(creds), ",".join("+".join(f"{p[1]}:{p[0]}:{p[2]}" for p in c if p) for c in creds), [{"kind": k, "start": s, "end": e, "value": t[s:e]} for s, k, e in linked]))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
            types = [*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), kind]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked", "n_credentials", "credentials", "linked"])

    return pick(docs, "doc_id", "text").mapInArrow(run, _OUT.format(docs.schema["doc_id"].dataType.simpleString()))


def redact(text: str | None, mark: str = "<secret>", reach: int = REACH) -> str | None:
    """The text with each union of overlapping spans replaced by `mark`; null stays null."""
    base, linked, _ = scan(text, reach)
    if not base and not linked:
        return text
    out, at = [], 0
    for s, e in unions([(s, e) for s, _, e in base + linked]):
        out += [text[at:s], mark]
        at = e
    return "".join(out) + text[at:]


def redacted(text: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        release()
        return s.map(redact, na_action="ignore")

    return run(text)
