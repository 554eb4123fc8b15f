"""Quality classifier by co-training a view of the text's content with a view of the page around it.

Two heads (quality, toxic), each with two logistic models. The content view sees the words and runs of marks of the
text; the page view sees language, source, length and layout (shares of capitals, digits and marks, repeated lines and
words, lengths of words and sentences), but no words. Both are fit on a bounded sample of labelled documents
(LABELLED). Then rounds follow: every document without a label in the sample is scored by both views, and where one
view's calibrated probability is beyond `sure`, its verdict counts as a label for the other. Such pseudo-labels of the
whole corpus are added up by tasks (how many documents of either class hold each feature); each view then learns again,
with the log-odds of these counts as a further score beside its own weights. Last, the views are calibrated and
combined on labelled documents that neither was fit on, so a view that knows nothing gets no weight. Every document is
scored, whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, release, slices, strings, written

#: At most so many labelled documents are fit on.
LABELLED = 6000
ROUNDS, SURE = 2, 0.97
HEADS = ("quality", "toxic")
VIEWS = ("text", "page")
_PARTS = re.compile(r"[^\W\d_]+|[^\w\s]+")
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?%&$*|#@=<>{}[]~^\\/_+"
BINS, MEASURES = 8, 9
META = 288
PAGE = META + BINS * MEASURES
#: Folds of twenty, by hash of doc_id: models are fit on the first, calibrated on the next, and measured on the rest.
FIT, CALIBRATE = 12, 16


def content(text: str | None) -> set[str]:
    """Distinct lower-case words and runs of marks; null: none."""
    return set(_PARTS.findall((text or "").lower()))


def prefix(word: str) -> str | None:
    """Longer words count by their first five letters as well."""
    return word[:5] + "*" if len(word) > 5 else None


def layout(text: str | None) -> list[float]:
    text = text or ""
    raw, n = text.encode("utf-8", "surrogatepass"), max(1, len(text))
    lines, parts = text.split("\n"), raw.split()
    types = len(set(parts))
    return [
        np.log1p(len(parts)),
        (len(raw) - len(raw.translate(None, _UPPER))) / n,
        (len(raw) - len(raw.translate(None, _DIGITS))) / n,
        (len(raw) - len(raw.translate(None, _MARKS))) / n,
        np.log1p(types) / np.log1p(max(1, len(parts))),
        types / max(1, len(parts)),
        len(set(lines)) / len(lines),
        n / max(1, len(parts)),
        (text.count(",") + text.count(".")) / max(1, len(parts)),
    ]


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    """Three indices below META: nulls are values of their own."""
    h = lambda x: zlib.crc32(("" if x is None else "=" + x).encode("utf-8", "surrogatepass"))
    n = 0 if n_chars is None or n_chars != n_chars else 1 + min(30, int(max(0, n_chars)).bit_length())
    return [h(lang) % 64, 64 + h(source) % 192, 256 + n]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, size: int, use: np.ndarray, odds: np.ndarray, l2: float = 5e-4, steps: int = 250) -> np.ndarray:
    """Logistic regression on binary features (rows, cols) and on their summed log-odds, for the rows in `use`: a weight
    for each feature, and last the bias."""
    s = np.bincount(rows, odds[cols], len(y))
    mean, spread = s[use].mean(), max(s[use].std(), 1e-6)
    s = (s - mean) / spread
    w, m, v = np.zeros(size + 2), np.zeros(size + 2), np.zeros(size + 2)
    keep = use[rows]
    rows, cols, total = rows[keep], cols[keep], max(1, use.sum())
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], len(y)) + w[-2] * s + w[-1]
        g = (_sigmoid(z) - y) * use / total
        d = np.r_[np.bincount(cols, g[rows], size) + l2 * w[:-2], g @ s, g.sum()]
        m, v = 0.9 * m + 0.1 * d, 0.99 * v + 0.01 * d * d
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return np.r_[w[:-2] + w[-2] * odds / spread, w[-1] - w[-2] * mean / spread]


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of scores z (n, views)."""
    s = np.maximum(z.std(0), 1e-6)
    x = np.c_[z / s, np.ones(len(z))]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-4 * len(z)] * (x.shape[1] - 1) + [1e-6])
        step = np.linalg.solve(h, x.T @ (p - y) + np.r_[1e-4 * len(z) * w[:-1], 0])
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / s, float(w[-1])


class _Known(dict):
    """A word -> the indices of those of its features that the vocabulary holds; emptied when it holds `cap` words."""

    def __init__(self, vocabulary: dict[str, int], cap: int = 200_000):
        super().__init__()
        self.vocabulary, self.cap = vocabulary, cap

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.cap:
            self.clear()
        out = tuple(i for w in (word, prefix(word)) if w is not None and (i := self.vocabulary.get(w)) is not None)
        if len(word) <= 64:
            self[word] = out
        return out


class Model:
    """Scores (text, lang, source, n_chars) for each head; made by train()."""

    def __init__(self):
        self.vocabulary: dict[str, int] = {}
        self.edges = np.zeros((MEASURES, BINS - 1))
        #: head -> view -> (weights with the bias last, calibration), and "both": the combination.
        self.heads: dict[str, dict] = {}
        #: head -> share of right verdicts on labelled documents that were neither fit on nor calibrated on, if any.
        self.accuracy: dict[str, float] = {}
        #: A row for each round: head, view that learned, pseudo-labels of either class that it was given.
        self.exchanged: list[tuple[int, str, str, int, int]] = []
        self._known: _Known | None = None

    def __getstate__(self):
        return self.__dict__ | {"_known": None}

    def features(self, text: str | None, lang, source, n_chars) -> tuple[list[int], list[int]]:
        """Indices of the content view's and of the page view's features."""
        if self._known is None:
            self._known = _Known(self.vocabulary)
        words = sorted(set(chain.from_iterable(map(self._known.__getitem__, content(text)))))
        measures = layout(text)
        return words, metadata(lang, source, n_chars) + [META + BINS * i + int(np.searchsorted(self.edges[i], x)) for i, x in enumerate(measures)]

    def probabilities(self, rows: list[tuple[np.ndarray, np.ndarray]], n: int) -> dict[str, list[np.ndarray]]:
        """rows: for each view (row, feature) -> per head [p_text, p_page, p]. A head that no labels speak of: 1 for
        quality, 0 for toxic."""
        out = {}
        for head in HEADS:
            m = self.heads.get(head)
            if m is None:
                out[head] = [np.full(n, float(head == "quality"))] * 3
                continue
            z = [np.bincount(r, m[v][0][c], n) + m[v][0][-1] for v, (r, c) in zip(VIEWS, rows)]
            own = [_sigmoid(m[v][1][0][0] * x + m[v][1][1]) for v, x in zip(VIEWS, z)]
            out[head] = [*own, _sigmoid(np.stack(z, 1) @ m["both"][0] + m["both"][1])]
        return out

    def scores(self, text: str | None, lang, source, n_chars) -> list[float]:
        """[p_text, p_page, p] of each head for one document."""
        f = self.features(text, lang, source, n_chars)
        p = self.probabilities([(np.zeros(len(x), int), np.array(x, int)) for x in f], 1)
        return [float(x[0]) for head in HEADS for x in p[head]]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.fromiter(chain.from_iterable(lists), np.int64)


def _columns(b: pa.RecordBatch):
    return zip(strings(b.column("text")), *[b.column(c).to_pylist() for c in ("lang", "source", "n_chars")])


_META = ("text", "lang", "source", "n_chars")


def _chosen(docs: DataFrame, given: DataFrame) -> DataFrame:
    """One row for each labelled doc_id, whatever its repeats: that with the least hash."""
    j = pick(docs, "doc_id", *_META).withColumn("n_chars", F.col("n_chars").cast("long")).join(F.broadcast(given), "doc_id")
    row = F.struct(F.xxhash64(*_META).alias("h"), *_META, "quality", "toxic")
    return j.groupBy("doc_id").agg(F.min(row).alias("r")).select("doc_id", *[f"r.{c}" for c in (*_META, "quality", "toxic")], F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(20)).cast("int").alias("fold"))


def _vocabulary(table: DataFrame, least: int = 5, surely: float = 3.5) -> dict[str, int]:
    """The words (and prefixes) that tell the classes of either head apart, by labelled documents to fit on. Words are
    counted by tasks; those too rare stay there."""
    at = lambda head, y: F.count_if(F.col(head) == y)
    fit = table.where(F.col("fold") < FIT)
    sides = [(h, y) for h in HEADS for y in (1, 0)]
    totals = fit.agg(*[at(h, y) for h, y in sides]).first()
    counts = fit.select(F.explode("words").alias("word"), *HEADS).groupBy("word").agg(F.count("*").alias("n"), *[at(h, y).alias(f"{h}{y}") for h, y in sides])
    t = counts.where(F.col("n") >= least).drop("n").orderBy("word").toPandas()
    sure = np.zeros(len(t), bool)
    for i, head in enumerate(HEADS):
        a, b = t[f"{head}1"].to_numpy(float), t[f"{head}0"].to_numpy(float)
        na, nb = totals[2 * i], totals[2 * i + 1]
        odds = np.log((a + 0.5) / (na - a + 0.5)) - np.log((b + 0.5) / (nb - b + 0.5))
        sure |= (np.abs(odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))) > surely) & (a + b >= least)
    return {w: i for i, w in enumerate(t["word"][sure].tolist())}


def featured(docs: DataFrame, model: Model, known: DataFrame | None = None) -> DataFrame:
    """docs -> written table (doc_id, known, words, page) of every row's features: small integers, no texts. known:
    whether the doc_id is among `known`."""
    docs = pick(docs, "doc_id", *_META).withColumn("n_chars", F.col("n_chars").cast("long"))
    flag = F.lit(False)
    if known is not None:
        docs = docs.join(F.broadcast(known.select("doc_id", F.lit(True).alias("known"))), "doc_id", "left")
        flag = F.coalesce("known", F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            rows = [model.features(*r) for r in _columns(b)]
            lists = [pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("known"), *lists], names=["doc_id", "known", "words", "page"])

    return written(docs.select("doc_id", *_META, flag.alias("known")).mapInArrow(run, f"doc_id {kind}, known boolean, words array<int>, page array<int>"), "features")


def _arrays(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for c in ("words", "page"):
        x = b.column(c)
        out.append((np.repeat(np.arange(len(x)), np.diff(x.offsets.to_numpy())), x.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
    return out


def _exchange(features: DataFrame, model: Model, sure: float) -> dict[tuple[str, str, int], Counter]:
    """(head, view that learns, class) -> how many documents without a label, of which the other view is sure, hold each
    feature; -1: how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        sums: dict[tuple[str, str, int], np.ndarray] = {}
        for b in batches:
            rows, free = _arrays(b), ~b.column("known").to_numpy(zero_copy_only=False).astype(bool)
            p = model.probabilities(rows, b.num_rows)
            for head in model.heads:
                for i, view in enumerate(VIEWS):
                    other = p[head][1 - i]
                    r, c = rows[i]
                    for y, mask in ((1, free & (other > sure)), (0, free & (other < 1 - sure))):
                        if mask.any():
                            n = np.bincount(np.append(c[mask[r]], model.heads[head][view][0].size - 1), minlength=model.heads[head][view][0].size)
                            n[-1] = mask.sum()
                            sums[head, view, y] = sums.get((head, view, y), 0) + n
        out = [(*k, -1 if f == len(n) - 1 else f, int(n[f])) for k, n in sums.items() for f in np.flatnonzero(n).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["head", "view", "y", "feature", "n"])

    got = features.mapInArrow(run, "head string, view string, y int, feature int, n long").groupBy("head", "view", "y", "feature").agg(F.sum("n").alias("n"))
    out: dict[tuple[str, str, int], Counter] = {}
    for r in got.collect():  # at most a row for each feature, view, head and class
        out.setdefault((r.head, r.view, r.y), Counter())[r.feature] = r.n
    return out


def _log_odds(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, use: np.ndarray, size: int, given: list[Counter | None]) -> np.ndarray:
    """Of each feature, by the labelled rows in use and the pseudo-labels of class 0 and 1 (if there are both)."""
    sides = []
    for c in (0, 1):
        mask = use & (y == c)
        n, total = np.bincount(cols[mask[rows]], minlength=size).astype(float), float(mask.sum())
        if all(given):
            more = np.zeros(size)
            for f, k in given[c].items():
                if f >= 0:
                    more[f] = k
            n, total = n + more, total + given[c][-1]
        sides.append(np.log((n + 0.5) / (total + 1)))
    return sides[1] - sides[0]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> Model:
    """docs (doc_id, text, lang, source, n_chars), labels (doc_id, quality, toxic) -> Model."""
    return _train(docs, labels, labelled, rounds, sure)[0]


def _train(docs: DataFrame, labels: DataFrame, labelled: int, rounds: int, sure: float) -> tuple[Model, DataFrame]:
    """The model, and the features of all rows (see featured).

    The labelled sample is chosen by the hash of doc_id. Null doc_ids and labels are left out; of repeated labels the
    worse counts. A head with labels of only one kind isn't trained.
    """
    given = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    given = written(given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "given")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            words, measures = [], []
            for t in strings(b.column("text")):
                w = content(t)
                words.append(sorted(w | {p for x in w if (p := prefix(x))}))
                measures.append(layout(t))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(words, pa.list_(pa.string())), pa.array(measures, pa.list_(pa.float64()))], names=[*b.schema.names, "words", "measures"])

    chosen = _chosen(docs, given)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    head = f"doc_id {kind}, text string, lang string, source string, n_chars long, quality int, toxic int, fold int"
    table = written(chosen.mapInArrow(look, f"{head}, words array<string>, measures array<double>"), "labelled")
    model = Model()
    measures = np.array([r[0] for r in table.select("measures").collect()], float)
    if len(measures):
        model.edges = np.quantile(measures, np.arange(1, BINS) / BINS, axis=0).T
        model.vocabulary = _vocabulary(table)
    features = featured(docs, model, given)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in slices(batches):
            rows = [model.features(*r) for r in _columns(b)]
            yield pa.RecordBatch.from_arrays([*[pa.array([r[i] for r in rows], pa.list_(pa.int32())) for i in (0, 1)], *[b.column(c) for c in (*HEADS, "fold")]], names=["words", "page", *HEADS, "fold"])

    t = table.drop("words", "measures").mapInArrow(small, "words array<int>, page array<int>, quality int, toxic int, fold int").orderBy(F.xxhash64("words", "page"), *HEADS, "fold").toPandas()
    n = len(t)
    if not n:
        return model, features
    flat = dict(zip(VIEWS, (_flat(t["words"].tolist()), _flat(t["page"].tolist()))))
    size = {"text": len(model.vocabulary), "page": PAGE}
    fold, ys = t["fold"].to_numpy(), {h: t[h].to_numpy(float) for h in HEADS}
    parts = {h: [~np.isnan(y) & f for f in (fold < FIT, (fold >= FIT) & (fold < CALIBRATE), fold >= CALIBRATE)] for h, y in ys.items()}
    heads = [h for h in HEADS if all(len(set(ys[h][m])) == 2 for m in parts[h][:2])]
    pseudo: dict[tuple[str, str, int], Counter] = {}
    for r in range(rounds + 1):
        for h in heads:
            y, (fit, cal, rest) = ys[h], parts[h]
            clean = np.where(fit, y, 0.0)
            m: dict = {}
            z = []
            for v in VIEWS:
                odds = _log_odds(*flat[v], y, fit, size[v], [pseudo.get((h, v, c)) for c in (0, 1)])
                w = _fit(*flat[v], clean, size[v], fit, odds)
                z.append(np.bincount(flat[v][0], w[flat[v][1]], n) + w[-1])
                m[v] = (w, _platt(z[-1][cal][:, None], y[cal]))
            m["both"] = _platt(np.stack(z, 1)[cal], y[cal])
            model.heads[h] = m
            if rest.any():
                p = np.stack(z, 1) @ m["both"][0] + m["both"][1]
                model.accuracy[h] = float(((p > 0) == y)[rest].mean())
        if r < rounds and heads:
            pseudo = _exchange(features, model, sure)
            model.exchanged += [(r + 1, h, v, pseudo.get((h, v, 0), Counter())[-1], pseudo.get((h, v, 1), Counter())[-1]) for h in heads for v in VIEWS]
    return model, features


_FIELDS = ("quality_text", "quality_page", "p_quality", "toxic_text", "toxic_page", "p_toxic")


def _verdicts(model: Model, b: pa.RecordBatch) -> pa.StructArray:
    rows = [model.features(*r) for r in _columns(b)]
    p = model.probabilities([_flat([r[i] for r in rows]) for i in (0, 1)], len(rows))
    cols = [x for h in HEADS for x in p[h]]
    return pa.StructArray.from_arrays([*map(pa.array, cols), pa.array((cols[2] >= 0.5) & (cols[5] < 0.5))], names=[*_FIELDS, "keep"])


def score(model: Model, text: Column, lang: Column, source: Column, n_chars: Column) -> Column:
    """A struct of the views' and the combined probabilities of each head, and keep: p_quality >= 0.5 > p_toxic.
    A worker holds the features of a few MB of text at a time, whatever the size of its batches."""
    known = model

    @F.arrow_udf(", ".join(f"{f} double" for f in _FIELDS) + ", keep boolean")
    def run(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        release()
        return pa.concat_arrays([_verdicts(known, b) for b in slices(iter([pa.RecordBatch.from_arrays([text, lang, source, n_chars], names=_META)]))])

    return run(text.cast("string"), lang.cast("string"), source.cast("string"), n_chars.cast("long"))


def scored(features: DataFrame, model: Model) -> DataFrame:
    """Features (see featured) -> doc_id, the probabilities and keep, of every row. Map only."""
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            p = model.probabilities(_arrays(b), b.num_rows)
            cols = [x for h in HEADS for x in p[h]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, cols), pa.array((cols[2] >= 0.5) & (cols[5] < 0.5))], names=["doc_id", *_FIELDS, "keep"])

    return features.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{f} double' for f in _FIELDS)}, keep boolean")


def classified(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, sure: float = SURE) -> DataFrame:
    """Trained on docs (doc_id, text, lang, source, n_chars) and labels (doc_id, quality, toxic) and applied to docs:
    doc_id, the probabilities and keep, of every row.

    Null text: as empty; null metadata is a value of its own. Null and repeated doc_ids are rows like any others. Other
    columns are ignored. Empty tables: no rows; without labels all are kept. Texts are read once for the features, which
    are written; rounds and scores need no texts.
    """
    model, features = _train(docs, labels, labelled, rounds, sure)
    return scored(features, model)
