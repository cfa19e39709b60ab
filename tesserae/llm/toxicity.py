"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, with block-max search.

Features are whole words and word beginnings, since inflected insults share their stem.  The
vocabulary is every feature that at least ``min_share`` of the examples hold, whatever their label;
a feature weighs its count times its inverse document frequency over all documents.  Every training
example is a sparse unit vector.

Features that more than ``dense_share`` of the examples hold are kept as rows over all examples and
multiplied out.  The others form an inverted index cut into blocks of ``block`` examples, and each
feature keeps the largest weight it has in each block.  For a query, the block's largest product of
the first kind plus the sum of query weight times block maximum bounds every cosine in a block; the
blocks with the largest bounds are evaluated first, and then only those whose bound reaches the k-th
best found, so the k neighbours are exact.

The nearest 4, 16 and 64 neighbours vote with weights exp(-distance / width).  A logistic curve fitted
on leave-one-out values of the training examples makes a probability of these votes, of the largest
cosine and of the strongest label odds among the document's features (counted on the same examples);
labels enter here only, not into vectors, vocabulary or search.  The neighbours are the evidence.
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
from ._text import U64, Words, _powers, _values, letter_words, mix, pieces, utf8
from .labelled import fold_labels, remainder, sample
from .quality import logistic


@dataclass(frozen=True)
class Options:
    per_class: int = 1500  # bound of the labelled sample, for each label
    prefixes: tuple[int, ...] = (5, 7)  # bytes of word beginnings that are features
    min_share: float = 0.01  # of the examples that hold a feature; 2 examples at least
    dense_share: float = 0.1
    block: int = 64
    first: int = 4  # blocks evaluated before the others are compared with the k-th best
    votes: tuple[int, ...] = (4, 16, 64)  # neighbours that vote together; the last is k
    width: float = 0.1
    folds: int = 3
    held: int = 1
    threshold: float = 0.7


def features(buf: np.ndarray, offs: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature hash) of every occurrence: each word, and its beginnings of the given lengths."""
    w = Words(buf, offs, letter_words())
    h = w.hashes()
    text = np.repeat(np.arange(len(offs) - 1), np.diff(w.first))
    own, out = [text], [mix(h ^ U64(0x77))]
    size = w.end - w.start
    p, val = _powers()[0], _values(True)
    for n in o.prefixes:
        at = np.flatnonzero(size >= n)
        acc = np.full(len(at), U64(n))
        for j in range(n):
            acc += val[buf[w.start[at] + j]] * p[j + 1]
        own.append(text[at])
        out.append(mix(acc))
    return np.concatenate(own), np.concatenate(out)


TOGETHER = 128  # vectors multiplied at once


class Index:
    """Unit vectors of the labelled examples: dense rows of frequent features, a blocked inverted index of the others."""

    def __init__(self, o: Options, vocabulary: np.ndarray, idf: np.ndarray, counts: np.ndarray | None = None, n: tuple[int, int] = (0, 0)):
        """``vocabulary``: sorted hashes; ``counts``: for each the examples of label 0 and 1 that hold it, of ``n`` examples."""
        self.o, self.vocabulary, self.idf, self.n = o, vocabulary, idf, n
        self.counts = np.zeros((len(vocabulary), 2), np.int64) if counts is None else counts

    def vectors(self, own: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, features and weights of ``n`` unit vectors tf * idf, from occurrences."""
        size = max(1, len(self.vocabulary))
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        ok = (self.vocabulary[at] == h) if len(self.vocabulary) else np.zeros(len(h), bool)
        key, tf = np.unique(own[ok] * size + at[ok], return_counts=True)
        row, f = np.divmod(key, size)
        v = tf * self.idf[f]
        norm = np.sqrt(np.bincount(row, v * v, n))
        return row, f, v / norm[row]

    def build(self, row: np.ndarray, f: np.ndarray, v: np.ndarray, y: np.ndarray, ids: np.ndarray) -> Index:
        # similar examples share a block, which keeps the bounds tight
        size, m = len(self.vocabulary), len(y)
        lead = np.full(m, size)
        order = np.lexsort((-v, row))
        head = np.unique(row[order], return_index=True)
        lead[head[0]] = f[order][head[1]]
        place = np.argsort(np.lexsort((ids, lead, y)))
        row = place[row]
        self.y, self.ids = np.empty_like(y), np.empty_like(ids)
        self.y[place], self.ids[place] = y, ids
        self.n_blocks = max(1, -(-m // self.o.block))
        self.edges = np.arange(self.n_blocks) * self.o.block
        frequent = np.bincount(f, minlength=size) > self.o.dense_share * max(1, m)
        self.dense_at = np.where(frequent, np.cumsum(frequent) - 1, -1)
        self.dense = np.zeros((int(frequent.sum()), m))
        d = frequent[f]
        self.dense[self.dense_at[f[d]], row[d]] = v[d]
        row, f, v = row[~d], f[~d], v[~d]
        self.maxima = np.zeros((size, self.n_blocks), np.float32)
        np.maximum.at(self.maxima, (f, row // self.o.block), np.nextafter(v.astype(np.float32), np.float32(2)))
        # postings by feature and row: offsets[f, b] is where those of block b begin
        by = np.lexsort((row, f))
        self.post_row, self.post_v = row[by].astype(np.int64), v[by]
        key = f[by] * self.n_blocks + row[by] // self.o.block
        at = np.searchsorted(key, np.arange(size * self.n_blocks + 1)).astype(np.int32)
        self.offsets = np.concatenate([at[:-1].reshape(size, self.n_blocks), at[self.n_blocks :: self.n_blocks, None]], 1) if size else np.zeros((0, self.n_blocks + 1), np.int32)
        return self

    def _add(self, sims: np.ndarray, f: np.ndarray, v: np.ndarray, blocks: np.ndarray | slice) -> None:
        """Adds the products of rare features with the examples of some blocks, or of all (a slice)."""
        if isinstance(blocks, slice):
            s, e, w = self.offsets[f, 0], self.offsets[f, -1], v
        else:
            s, e = self.offsets[f[:, None], blocks].ravel(), self.offsets[f[:, None], blocks + 1].ravel()
            w = np.repeat(v, len(blocks))
        n = e - s
        some = n > 0
        s, n, w = s[some], n[some], w[some]
        if len(n):
            at = np.repeat(s - np.cumsum(n) + n, n) + np.arange(n.sum())
            sims += np.bincount(self.post_row[at], np.repeat(w, n) * self.post_v[at], len(sims))

    def frequent(self, row: np.ndarray, f: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
        """Products of ``n`` vectors with all examples over the frequent features."""
        d = self.dense_at[f]
        q = np.zeros((n, len(self.dense)))
        q[row[d >= 0], d[d >= 0]] = v[d >= 0]
        return q @ self.dense

    def nearest(self, f: np.ndarray, v: np.ndarray, skip: int = -1, sims: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and places of the k nearest examples, ties to the smaller id; examples that share nothing are not listed.  ``sims``: what :func:`frequent` gives for the vector."""
        k, m = self.o.votes[-1], len(self.y)
        if not m:
            return np.zeros(0), np.zeros(0, np.int64)
        sims = self.frequent(np.zeros(len(f), np.int64), f, v, 1)[0] if sims is None else sims
        rare = self.dense_at[f] < 0
        f, v = f[rare], v[rare]
        bound = np.maximum.reduceat(sims, self.edges) + v @ self.maxima[f]
        order = np.argsort(-bound, kind="stable")
        done = np.zeros(self.n_blocks, bool)
        done[order[: self.o.first]] = True
        self._add(sims, f, v, order[: self.o.first])
        block = np.arange(m) // self.o.block
        known = np.where(done[block], sims, 0.0)
        known[skip if skip >= 0 else slice(0, 0)] = 0.0
        least = np.partition(known, m - k)[m - k] if m > k else 0.0
        left = np.flatnonzero(~done & (bound * (1 + 1e-5) >= least) & (bound > 0))
        if 3 * len(left) > self.n_blocks:  # cheaper in one sweep
            fresh = np.zeros(m)
            self._add(fresh, f, v, slice(None))
            sims = np.where(done[block], sims, sims + fresh)
            done[:] = True
        elif len(left):
            self._add(sims, f, v, left)
            done[left] = True
        ok = done[block] & (sims > 0)
        ok[skip if skip >= 0 else slice(0, 0)] = False
        rows = np.flatnonzero(ok)
        if len(rows) > k:
            value = np.round(sims[rows], 12)
            rows = rows[value >= np.partition(value, len(rows) - k)[len(rows) - k]]
        top = np.lexsort((self.ids[rows], -np.round(sims[rows], 12)))[:k]
        return sims[rows[top]], rows[top]

    def tilt(self, f: np.ndarray, own: int = -1) -> float:
        """The strongest log odds of label 1 among features; without the example itself, if its label is given."""
        if not len(f):
            return 0.0
        a, b = self.counts[f, 1] - (own == 1), self.counts[f, 0] - (own == 0)
        return float((np.log((a + 1) / (self.n[1] + 2)) - np.log((b + 1) / (self.n[0] + 2))).max())

    def signals(self, row: np.ndarray, f: np.ndarray, v: np.ndarray, n: int, skip: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each of ``n`` vectors with a feature: its number; votes of the nearest examples as logits, the logarithm of the largest cosine and the strongest odds; the neighbours' places.

        ``skip`` leaves out an example for each vector, from the neighbours and from the odds.
        """
        at = np.searchsorted(row, np.arange(n + 1))
        for s in range(0, n, TOGETHER):
            e = min(n, s + TOGETHER)
            part = slice(at[s], at[e])
            base = self.frequent(row[part] - s, f[part], v[part], e - s)
            for i in s + np.flatnonzero(np.diff(at[s : e + 1])):
                own, out = slice(at[i], at[i + 1]), -1 if skip is None else int(skip[i])
                sims, rows = self.nearest(f[own], v[own], out, base[i - s])
                best = float(sims[0]) if len(sims) else 1e-6
                w = np.exp((sims - best) / self.o.width)
                one = np.cumsum(np.append(0, w * (self.y[rows] == 1)))
                zero = np.cumsum(np.append(0, w * (self.y[rows] == 0)))
                k = np.minimum(self.o.votes, len(rows))
                tilt = self.tilt(f[own], int(self.y[out]) if out >= 0 else -1)
                yield i, np.array([*np.log((one[k] + 0.02) / (zero[k] + 0.02)), np.log(max(best, 1e-6)), tilt]), rows

    def fit(self, row: np.ndarray, f: np.ndarray, v: np.ndarray, shares: tuple[float, float]) -> Index:
        """The calibration, from leave-one-out signals.  Rows are places in the index."""
        order = np.argsort(row, kind="stable")
        z = np.zeros((len(self.y), self.width))
        for i, signal, _ in self.signals(row[order], f[order], v[order], len(self.y), np.arange(len(self.y))):
            z[i] = signal
        n1, n0 = max(1, int((self.y == 1).sum())), max(1, int((self.y == 0).sum()))
        self.mean, self.scale = (z.mean(0), z.std(0) + 1e-9) if len(z) else (np.zeros(self.width), np.ones(self.width))
        if len(self.y) and 0 < self.y.mean() < 1:
            self.curve = logistic((z - self.mean) / self.scale, self.y, np.where(self.y == 1, shares[1] / n1, shares[0] / n0))
        else:
            self.curve = np.append(np.zeros(self.width), np.clip(np.log((shares[1] + 1e-6) / (shares[0] + 1e-6)), -10, 10))
        return self

    @property
    def width(self) -> int:
        return len(self.o.votes) + 2

    def score(self, z: np.ndarray) -> np.ndarray:
        z = (z - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(z @ self.curve[:-1] + self.curve[-1], -40, 40)))


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, o: Options) -> np.ndarray:
    """In how many of all documents each vocabulary feature occurs; partitions count, Spark adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(vocabulary), np.int64)
        for whole in batches:
            for b in pieces(whole):
                own, h = features(*utf8(b.column("text")), o)
                at = np.searchsorted(vocabulary, h)
                at[at == len(vocabulary)] = 0
                ok = vocabulary[at] == h
                df += np.bincount(np.unique(own[ok] * len(vocabulary) + at[ok]) % len(vocabulary), minlength=len(vocabulary))
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(df[some], pa.int64())], names=["f", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    if len(vocabulary):
        for r in docs.select("text").mapInArrow(run, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).collect():
            out[r.f] = r.n
    return out


def fit(docs: DataFrame, labels: DataFrame, o: Options = Options()) -> Index:
    """Fits on a bounded sample of the labelled rows outside the held-out fold.  To the driver come that sample's vectors and the counts of a bounded vocabulary."""
    lean(docs.sparkSession)
    rows = fold_labels(labels, "toxic", o.folds, o.held)
    shares = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    total = sum(shares.values())
    share = (shares.get(0, 0) / total, shares.get(1, 0) / total) if total else (0.5, 0.5)
    chosen = sample(rows, o.per_class)
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                own, h = features(*utf8(b.column("text")), o)
                order = np.lexsort((h, own))
                own, h = own[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
                y = b.column("y").to_numpy(zero_copy_only=False)[own[new]]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(y, pa.int32())], names=["f", "y"])

    counts = some.select("y", "text").mapInArrow(distinct, "f bigint, y int").groupBy("f").agg(F.sum(1 - F.col("y")).alias("c0"), F.sum("y").alias("c1"))
    n = [min(o.per_class, shares.get(y, 0)) for y in (0, 1)]
    # at most (features of a mean example) / min_share rows, however many examples there are
    picked = counts.where(F.col("c0") + F.col("c1") >= max(2, o.min_share * sum(n))).collect()
    vocabulary = np.array([r.f for r in picked], np.int64).view(U64)
    order = np.argsort(vocabulary)
    vocabulary, held = vocabulary[order], np.array([(r.c0, r.c1) for r in picked], np.int64).reshape(-1, 2)[order]
    df = document_frequencies(docs, vocabulary, o)
    n_docs = docs.count()
    index = Index(o, vocabulary, np.log((1.0 + n_docs) / (1.0 + df)) + 1e-6, held)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                r, f, v = index.vectors(*features(*utf8(b.column("text")), o), b.num_rows)
                at = np.searchsorted(r, np.arange(b.num_rows + 1))
                cut = lambda a: pa.array([a[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), cut(f.astype(np.int64)), cut(v)], names=["doc_id", "y", "f", "v"])

    got = some.select("doc_id", "y", "text").mapInArrow(keep, "doc_id bigint, y int, f binary, v binary").collect()
    got.sort(key=lambda r: (r.doc_id, r.f, r.v))
    f = np.concatenate([*(np.frombuffer(r.f, np.int64) for r in got), np.zeros(0, np.int64)])
    v = np.concatenate([*(np.frombuffer(r.v) for r in got), np.zeros(0)])
    row = np.repeat(np.arange(len(got)), [len(r.f) // 8 for r in got])
    ids, y = np.array([r.doc_id for r in got], np.int64), np.array([r.y for r in got], np.int64)
    index.n = (int((y == 0).sum()), int((y == 1).sum()))
    index.build(row, f, v, y, ids)
    # rows of the calibration are places in the built index
    where = {(int(i), n): p for p, (i, n) in enumerate(zip(index.ids, _ordinal(index.ids)))}
    place = np.array([where[(int(i), n)] for i, n in zip(ids, _ordinal(ids))], np.int64)
    return index.fit(place[row], f, v, share)


def _ordinal(ids: np.ndarray) -> list[int]:
    """How many equal ids stand before each."""
    seen: dict[int, int] = {}
    out = []
    for i in ids:
        out.append(seen.get(int(i), 0))
        seen[int(i)] = out[-1] + 1
    return out


def score(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` with ``toxicity``, a probability of label 1, and ``evidence``, the ids of the three nearest examples.

    A text without any feature of the vocabulary, null and empty ones included, has no neighbour and
    gets the calibrated score of even votes.  Rows pass through one by one, so repeated rows, nulls
    elsewhere and further columns do no harm (columns toxicity and evidence are replaced); an empty
    table gives no rows.
    """
    docs = docs.drop("toxicity", "evidence")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                r, f, v = index.vectors(*features(*utf8(b.column("text")), index.o), b.num_rows)
                z, near = np.zeros((b.num_rows, index.width)), [[] for _ in range(b.num_rows)]
                for i, signal, rows in index.signals(r, f, v, b.num_rows):
                    z[i], near[i] = signal, index.ids[rows[:3]].tolist()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.score(z), pa.float64()), pa.array(near, pa.list_(pa.int64()))], names=[*b.schema.names, "toxicity", "evidence"])

    return over_rows(docs, run, T.StructField("toxicity", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType())))


def held_out(o: Options = Options()):
    return remainder(F.col("doc_id"), o.folds) == o.held
