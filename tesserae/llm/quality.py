"""Document quality by a linear-chain conditional random field over lines.

Every non-blank line is good or bad.  A line's emission is a sum of table entries, one for each of
its features and of its two neighbours' features, cut into bins at quantiles; a 2 x 2 table scores
neighbouring labels.  Fitting takes each line's label from its document and ascends one penalised
conditional log-likelihood, in which a document counts by one over its lines and its class's size;
emissions and label pairs follow its gradient, which comes from forward-backward marginals.  A
document's raw score is the mean marginal of its lines, weighted by length, and nothing else; a
logistic curve fitted on the training documents, weighted to the class shares of all training
labels, makes it a probability.

Only the fit is on a bounded sample (``Options.per_class`` documents a class, each of at most
``max_lines`` lines); scoring reads every line of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import lean, over_rows
from ._text import U64, Words, mix, pieces, space_words, utf8
from .labelled import fold_labels, remainder, sample


@dataclass(frozen=True)
class Options:
    per_class: int = 2000
    max_lines: int = 400
    bins: int = 8
    iterations: int = 200
    rate: float = 0.05
    l2: float = 1e-3
    folds: int = 4
    held: int = 2
    threshold: float = 0.7


FEATURES = (
    "log_words", "word_length", "upper", "digit", "symbol", "bar", "bang", "stop", "comma", "same_1", "same_2", "distinct",
    "upper_words", "symbol_words", "repeated_line", "high_bytes", "longest", "lower_start", "log_lines", "repeat_in_text",
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


UPPER = _class(bytes(range(0x41, 0x5B)))
DIGIT = _class(bytes(range(0x30, 0x3A)))
SYMBOL = _class(b"#$%&*@^~=+_<>{}[]\\/|")
STOP = _class(b".;:?")


class Lines:
    """The non-blank lines of several texts: ``x`` features, ``doc`` owner, ``weight`` bytes in words."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        breaks = np.flatnonzero(buf == 10) + 1
        at = np.unique(np.concatenate([offs, breaks]))
        w = Words(buf, at, space_words())
        n = np.diff(w.first)
        keep = np.flatnonzero(n > 0)
        n = n[keep]
        first = w.first[:-1][keep]
        self.doc = np.searchsorted(offs, at[:-1][keep], "right") - 1
        m = len(keep)
        self.x = np.zeros((m, len(FEATURES)), np.float32)
        self.weight = np.zeros(m)
        self.count = np.bincount(self.doc, minlength=len(offs) - 1)
        if not m:
            return
        h = w.hashes()
        line = np.repeat(np.arange(m), n)
        size = w.end - w.start
        chars = np.add.reduceat(size, first)
        share = lambda t: self._per_line(t[buf], at, keep) / chars
        per_word = lambda v: np.add.reduceat(v.astype(np.float64), first) / n
        same = [np.zeros(len(h), bool), np.zeros(len(h), bool)]
        for k in (1, 2):
            if len(h) > k:
                same[k - 1][k:] = (h[k:] == h[:-k]) & (line[k:] == line[:-k])
        order = np.lexsort((h, line))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        text = self.doc[line]
        order_t = np.lexsort((h, text))
        again = np.zeros(len(h), bool)
        again[order_t[1:]] = (h[order_t][1:] == h[order_t][:-1]) & (text[order_t][1:] == text[order_t][:-1])
        key = np.add.reduceat(mix(h ^ (np.arange(len(h)) - np.repeat(first, n)).astype(U64)), first)
        lo = np.lexsort((key, self.doc))
        twice = np.zeros(m, bool)
        eq = (key[lo][1:] == key[lo][:-1]) & (self.doc[lo][1:] == self.doc[lo][:-1])
        twice[lo[1:]] |= eq
        twice[lo[:-1]] |= eq
        head, tail = buf[w.start], buf[w.end - 1]
        mid = buf[np.minimum(w.start + 1, w.end - 1)]
        high = np.zeros(256, bool)
        high[0x80:] = True
        cols = (
            np.log1p(n), chars / n, share(UPPER), share(DIGIT), share(SYMBOL), share(_class(b"|")), share(_class(b"!")), share(STOP), share(_class(b",")),
            per_word(same[0]), per_word(same[1]), np.add.reduceat(fresh.astype(np.float64), first) / np.maximum(1, np.minimum(n, 1e9)),
            per_word(UPPER[head] & UPPER[mid] & (size > 1)), per_word(SYMBOL[tail]), twice, share(high), np.maximum.reduceat(size, first), 1.0 - UPPER[head[first]],
            np.log1p(self.count[self.doc]), per_word(again),
        )
        for i, c in enumerate(cols):
            self.x[:, i] = c
        self.weight = chars.astype(np.float64)

    @staticmethod
    def _per_line(mask: np.ndarray, at: np.ndarray, keep: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, at[:-1], dtype=np.int64)[keep] if len(at) > 1 else np.zeros(0)


class Chains:
    """Lines of several documents as chains, stepped through together; longer chains come first."""

    def __init__(self, count: np.ndarray):
        self.first = np.concatenate([[0], np.cumsum(count)])[:-1]
        self.order = np.argsort(-count, kind="stable")
        self.order = self.order[count[self.order] > 0]
        self.sorted = count[self.order]
        self.longest = int(self.sorted[0]) if len(self.sorted) else 0
        self.alive = np.searchsorted(-self.sorted, -np.arange(self.longest), "left")  # chains longer than t

    def marginals(self, e: np.ndarray, t: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line for emissions ``e`` (bad lines have 0).  With ``edges``, a weight of each document: the sum of expected label pairs too, and the log partition function of each document."""
        n = len(e)
        pot = np.empty((n, 2))
        top = np.maximum(e, 0)
        pot[:, 0], pot[:, 1] = np.exp(-top), np.exp(e - top)
        a, b = np.empty((n, 2)), np.empty((n, 2))
        trans = np.exp(t - t.max())
        at = self.first[self.order]
        expected, log_z = np.zeros((2, 2)), np.zeros(len(self.first))
        for s in range(self.longest):
            k = self.alive[s]
            i = at[:k] + s
            v = pot[i] if s == 0 else pot[i] * (a[i - 1] @ trans)
            total = v.sum(1, keepdims=True)
            a[i] = v / total
            if edges is not None:
                log_z[self.order[:k]] += np.log(total[:, 0]) + top[i] + (t.max() if s else 0.0)
        for s in range(self.longest - 1, -1, -1):
            k = self.alive[s]
            i = at[:k] + s
            b[i] = 1.0
            k2 = self.alive[s + 1] if s + 1 < self.longest else 0
            if k2:
                j = i[:k2]
                v = (pot[j + 1] * b[j + 1]) @ trans.T
                b[j] = v / v.sum(1, keepdims=True)
                if edges is not None:
                    p = a[j][:, :, None] * trans[None] * (pot[j + 1] * b[j + 1])[:, None, :]
                    expected += (p * (edges[self.order[:k2]] / p.sum((1, 2)))[:, None, None]).sum(0)
        m = a * b
        return m[:, 1] / m.sum(1), expected, log_z


class Crf:
    """The fitted field: bin edges, emission tables for the line and its neighbours, label pairs, calibration."""

    def __init__(self, options: Options = Options()):
        self.o = options
        self.cuts: list[np.ndarray] = []
        self.table = np.zeros((3 * len(FEATURES), 2 * options.bins + 1))
        self.pairs = np.zeros((2, 2))
        self.curve = np.array([1.0, 0.0])
        self.prior = 0.5

    def binned(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Bins of the own, previous and next line; bin 0 stands for no neighbour."""
        own = np.empty(x.shape, np.int64)
        for f, c in enumerate(self.cuts):
            own[:, f] = 1 + np.searchsorted(c, x[:, f], "left")
        some = count[count > 0]
        start = np.concatenate([[0], np.cumsum(some)])
        before, after = np.zeros_like(own), np.zeros_like(own)
        if len(own):
            before[1:], after[:-1] = own[:-1], own[1:]
            before[start[:-1]] = 0
            after[start[1:] - 1] = 0
        return np.concatenate([own, before, after], 1)

    def emissions(self, bins: np.ndarray) -> np.ndarray:
        e = np.zeros(len(bins))
        for f in range(bins.shape[1]):
            e += self.table[f][bins[:, f]]
        return np.clip(e, -30, 30)

    def raw(self, lines: Lines) -> np.ndarray:
        """The logit of each document's length-weighted mean marginal; without lines, nan."""
        bins = self.binned(lines.x, lines.count)
        p, _, _ = Chains(lines.count).marginals(self.emissions(bins), self.pairs)
        n = len(lines.count)
        w = np.bincount(lines.doc, lines.weight, n)
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = np.bincount(lines.doc, lines.weight * p, n) / w
        mean = np.clip(mean, 1e-4, 1 - 1e-4)
        return np.log(mean / (1 - mean))[:, None]

    def score(self, lines: Lines) -> np.ndarray:
        z = self.raw(lines)
        return np.where(np.isnan(z[:, 0]), self.prior, 1 / (1 + np.exp(-np.clip(z @ self.curve[:-1] + self.curve[-1], -40, 40))))

    def ascent(self, bins: np.ndarray, chains: Chains, y: np.ndarray, count: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The penalised log-likelihood of all lines having their document's label, and its gradients by emission table and label pairs."""
        o = self.o
        # each document weighs the same, and so does each class
        weight = 1.0 / np.maximum(count, 1) / np.where(y == 1, max(1, (y == 1).sum()), max(1, (y == 0).sum()))
        e = self.emissions(bins)
        p, expected, log_z = chains.marginals(e, self.pairs, weight)
        label = np.repeat(y, count).astype(np.float64)
        pairs = np.zeros((2, 2))
        for k in (0, 1):
            pairs[k, k] = (weight * np.maximum(count - 1, 0))[y == k].sum()
        owner = np.repeat(np.arange(len(count)), count)
        value = (weight * (np.bincount(owner, label * e, len(count)) - log_z)).sum() + (pairs * self.pairs).sum()
        value -= o.l2 / 2 * ((self.table**2).sum() / len(FEATURES) + (self.pairs**2).sum())
        d = np.repeat(weight, count) * (label - p) * (np.abs(e) < 30)
        g = np.stack([np.bincount(bins[:, f], d, self.table.shape[1]) for f in range(bins.shape[1])]) - o.l2 * self.table / len(FEATURES)
        return value, g, pairs - expected - o.l2 * self.pairs

    def fit(self, x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray, shares: tuple[float, float]) -> Crf:
        """``x``: lines of all documents in order; ``count``, ``y``: lines and label of each document; ``shares``: of labels 0 and 1 in all training rows."""
        o = self.o
        self.prior = shares[1]
        for f in range(x.shape[1]):
            self.cuts.append(_cuts(x[:, f], o.bins))
        if not len(x) or y.min() == y.max():
            self.curve = np.array([0.0, np.clip(np.log((self.prior + 1e-6) / (1 - self.prior + 1e-6)), -10, 10)])
            return self
        bins, chains = self.binned(x, count), Chains(count)
        m, v = np.zeros_like(self.table), np.zeros_like(self.table)
        tm, tv = np.zeros((2, 2)), np.zeros((2, 2))
        for step in range(1, o.iterations + 1):
            _, g, tg = self.ascent(bins, chains, y, count)
            for param, grad, mm, vv in ((self.table, g, m, v), (self.pairs, tg, tm, tv)):
                mm *= 0.9
                mm += 0.1 * grad
                vv *= 0.99
                vv += 0.01 * grad * grad
                param += o.rate * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.99**step)) + 1e-8)
        fitted = Lines.__new__(Lines)
        fitted.x, fitted.count, fitted.weight = x, count, weight
        fitted.doc = np.repeat(np.arange(len(count)), count)
        z = self.raw(fitted)
        ok = ~np.isnan(z[:, 0])
        cw = np.where(y == 1, shares[1] / max(1, (y == 1).sum()), shares[0] / max(1, (y == 0).sum()))
        self.curve = logistic(z[ok], y[ok], cw[ok])
        return self


def _cuts(v: np.ndarray, bins: int) -> np.ndarray:
    """At most 2 * bins - 1 bin edges: 0, and quantiles of all values and of those above 0, as many features are mostly 0."""
    if not len(v):
        return np.zeros(0)
    q = np.arange(1, bins) / bins
    return np.unique(np.concatenate([[0.0], np.quantile(v, q), np.quantile(v[v > 0], q) if (v > 0).any() else []]))


def logistic(z: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float = 1e-3) -> np.ndarray:
    """Weights and constant of a weighted logistic regression, by Newton steps."""
    x = np.column_stack([z, np.ones(len(z))])
    ridge = np.append(np.full(x.shape[1] - 1, l2), 1e-9)
    t = np.zeros(x.shape[1])
    w = w / w.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -40, 40)))
        g = x.T @ (w * (y - p)) - ridge * t
        h = (x * (w * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        t = t + step
        if np.abs(step).max() < 1e-8:
            break
    return t


def line_features(docs: DataFrame) -> DataFrame:
    """``doc_id, y, x, weight``: the features of all lines of each document as float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                ls = Lines(*utf8(b.column("text")))
                at = np.concatenate([[0], np.cumsum(ls.count)])
                cut = lambda v, t: pa.array([v[s:e].astype(t).tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), cut(ls.x, np.float32), cut(ls.weight, np.float64)], names=["doc_id", "y", "x", "weight"])

    return docs.select("doc_id", "y", "text").mapInArrow(run, "doc_id bigint, y int, x binary, weight binary")


def fit(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> Crf:
    """Fits on a bounded sample of the labelled rows outside the held-out fold; only that sample reaches the driver."""
    lean(docs.sparkSession)
    rows = fold_labels(labels, "quality", options.folds, options.held)
    shares = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    total = max(1, sum(shares.values()))
    chosen = sample(rows, options.per_class)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    some = line_features(some).where(F.length("x") <= 4 * len(FEATURES) * options.max_lines)
    got = sorted(some.collect(), key=lambda r: (r.doc_id, r.x))
    xs = [np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)) for r in got]
    x = np.concatenate([*xs, np.zeros((0, len(FEATURES)), np.float32)])
    y = np.array([r.y for r in got], np.int64)
    weight = np.concatenate([*(np.frombuffer(r.weight) for r in got), np.zeros(0)])
    share = (shares.get(0, 0) / total, shares.get(1, 0) / total) if shares else (0.5, 0.5)
    return Crf(options).fit(x, np.array([len(v) for v in xs], np.int64), y, weight, share)


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """``docs`` with ``quality_score``, a probability of label 1 from the text alone.

    Null, empty and blank texts get the share of label 1 among all training labels.  Rows pass
    through one by one, so repeated rows, nulls elsewhere and further columns do no harm (a column
    quality_score of the input is replaced); an empty table gives no rows.
    """
    docs = docs.drop("quality_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                s = model.score(Lines(*utf8(b.column("text"))))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[*b.schema.names, "quality_score"])

    return over_rows(docs, run, T.StructField("quality_score", T.DoubleType()))


def held_out(options: Options = Options()):
    return remainder(F.col("doc_id"), options.folds) == options.held
