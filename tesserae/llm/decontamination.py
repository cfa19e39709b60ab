"""Benchmark decontamination: approximate passages under edit distance.

Documents and benchmark items are sequences of words (letters and digits, A-Z lower-cased).  An item
of W words leaks where a window of the document lies within floor(tau * W) word insertions,
deletions and substitutions of it; for items of fewer than 1 / tau words that is an exact match.

Candidates come from the CGK embedding: a random walk copies the current word to the output and
moves on or stays by a random bit of (output place, word), the same bits for both sides, so after an
edit the two walks meet again and edit distance becomes Hamming distance.  Bit sampling hashes a few
output places; ``walks`` independent walks with ``keys`` samples each give the target recall.  Walks
drift apart as edits add up, so for items of more than ``whole`` words as many walks each are also
made over their first half, quarter and so on, down to some ``whole`` words: where edits are spread
the beginnings still agree, where they are crowded into the beginning the rest does.  Items that
allow no edit have one key, their words.  A window that agrees with an item in any sample is
verified by exact bit-parallel dynamic programming.

Windows are taken at every word, with the length of each class of items.  An edit breaks at most q
of an item's W - q + 1 runs of q words, so a window within the bound keeps W - q + 1 - q * floor(tau * W)
of them; q is the largest of 3, 2 and 1 for which that is positive.  Windows with fewer words where
known runs begin cannot match and are not embedded; this loses nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import lean, over_rows
from ._text import U64, Words, grams, letter_words, mix, pieces, utf8


@dataclass(frozen=True)
class Options:
    tau: float = 0.2
    walks: int = 16
    keys: int = 6
    sampled: int = 3  # output places in each key
    whole: int = 60  # words of an item from which beginnings have walks of their own
    ratio: float = 1.15  # of the longest to the shortest item of a class
    chunk_words: int = 1_000_000  # of items searched together: some 80 MB a worker
    seed: int = 11


def allowed(words: int, o: Options) -> int:
    """Edits allowed for an item."""
    return int(o.tau * words)


def kept(words: int, q: int, o: Options) -> int:
    """Runs of q words of an item that survive the most edits allowed."""
    return words - q + 1 - q * allowed(words, o)


def run_length(words: int, o: Options) -> int:
    """The longest runs, of 3 words at most, of which some survive."""
    return next((q for q in (3, 2) if kept(words, q, o) > 0), 1)


def embed(x: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """One CGK walk over each row of word hashes (0 after the end): the words copied in ``steps`` steps."""
    at = np.zeros(len(x), np.int64)
    rows, last = np.arange(len(x)), x.shape[1] - 1
    out = np.empty((len(x), steps), U64)
    salt = mix(np.arange(1, steps + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)
    for j in range(steps):
        w = x[rows, at]
        out[:, j] = w
        at = np.minimum(at + ((w * salt[j]) >> U64(63)).astype(np.int64), last)  # multiply-shift of a word's hash
    return out


@dataclass
class Class:
    """Items of similar length, with their keys in sorted order."""

    low: int
    high: int
    most: int  # edits
    q: int
    need: int
    keys: np.ndarray = field(default=None)
    items: np.ndarray = field(default=None)

    @property
    def span(self) -> int:
        return self.high + self.most


def classes_of(lengths: list[int], o: Options) -> list[Class]:
    """Lengths in classes: of one length where no edit is allowed, else of those within ``ratio``."""
    out: list[Class] = []
    left = sorted({n for n in lengths if n})
    while left:
        low = left[0]
        group = [n for n in left if n == low or allowed(low, o) and n <= low * o.ratio]
        left = left[len(group) :]
        q = min(run_length(n, o) for n in group)
        out.append(Class(low, group[-1], max(allowed(n, o) for n in group), q, max(1, min(kept(n, q, o) for n in group))))
    return out


class Runs:
    """The runs of q words of all items: which are known, and to which classes they belong."""

    def __init__(self, parts: list[tuple[int, np.ndarray]]):
        """``parts``: runs of the items of each class, by the class's number."""
        self.known = np.unique(np.concatenate([*(g for _, g in parts), np.zeros(0, U64)]))
        self.member = np.zeros(len(self.known), U64)  # bit n % 64: an item of class n has the run
        for number, g in parts:
            self.member[np.searchsorted(self.known, np.unique(g))] |= U64(1 << (number % 64))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.known >> U64(44)).astype(np.int64)] = True

    def members(self, g: np.ndarray) -> np.ndarray:
        """Class bits of each run; 0 for unknown ones."""
        out = np.zeros(len(g), U64)
        some = np.flatnonzero(self.bits[(g >> U64(44)).astype(np.int64)])
        at = np.searchsorted(self.known, g[some])
        at[at == len(self.known)] = 0
        ok = self.known[at] == g[some] if len(self.known) else np.zeros(0, bool)
        out[some[ok]] = self.member[at[ok]]
        return out


class Items:
    """The benchmark items of one pass, as word hashes, with runs and keys."""

    def __init__(self, ids: list[int], texts: list[str], o: Options):
        self.o = o
        w = Words(*utf8(pa.array(texts, pa.string())), letter_words())
        h = w.hashes()
        self.ids = np.array(ids, np.int64)
        self.words = [h[s:e] for s, e in zip(w.first[:-1], w.first[1:])]
        self.masks: dict[int, dict[int, int]] = {}
        self.classes = classes_of([len(x) for x in self.words], o)
        parts: dict[int, list[tuple[int, np.ndarray]]] = {}
        of = {q: grams(h, w.first, q, whole=False) for q in {c.q for c in self.classes}}
        for number, c in enumerate(self.classes):
            group = [i for i, x in enumerate(self.words) if c.low <= len(x) <= c.high]
            k = self.sample(self.matrix([self.words[i] for i in group], c.span), c)
            by = np.argsort(k.ravel(), kind="stable")
            c.keys, c.items = k.ravel()[by], np.repeat(np.array(group, np.int32), k.shape[1])[by]
            g, at = of[c.q]
            parts.setdefault(c.q, []).append((number, np.concatenate([g[at[i] : at[i + 1]] for i in group])))
        self.runs = {q: Runs(p) for q, p in parts.items()}

    def mask(self, i: int) -> dict[int, int]:
        """For each word of an item, the bits of its places."""
        if i not in self.masks:
            m: dict[int, int] = {}
            for place, w in enumerate(self.words[i].tolist()):
                m[w] = m.get(w, 0) | 1 << place
            self.masks[i] = m
        return self.masks[i]

    @staticmethod
    def matrix(rows: list[np.ndarray], width: int) -> np.ndarray:
        m = np.zeros((len(rows), width + 1), U64)
        for i, r in enumerate(rows):
            m[i, : min(len(r), width)] = r[:width]
        return m

    def sample(self, m: np.ndarray, c: Class) -> np.ndarray:
        """The keys of each row: samples of its embeddings, or its words where no edit is allowed."""
        o, n = self.o, c.low
        if not c.most:
            key = np.full(len(m), U64(n))
            for place in range(n):
                key = mix(key * U64(31) ^ m[:, place])
            return key[:, None]
        rng = np.random.default_rng((o.seed, c.low))
        lengths = [n]
        while n > o.whole:
            n //= 2
            lengths.append(n)
        out = []
        for walk in range(o.walks * len(lengths)):
            steps = max(2, 2 * lengths[walk // o.walks])
            picked = [np.sort(rng.choice(steps, min(steps, o.sampled), replace=False)) for _ in range(o.keys)]
            e = embed(m, 1 + max(p[-1] for p in picked), o.seed * 1000 + walk)
            for k, places in enumerate(picked):
                key = np.full(len(m), U64(walk * o.keys + k + 1))
                for place in places:
                    key = mix(key * U64(31) ^ e[:, place])
                out.append(key)
        return np.stack(out, 1)


def align(mask: dict[int, int], m: int, text: list[int], most: int) -> tuple[int, int] | None:
    """(edits, words of text) of the best match of a whole item of m words with a beginning of ``text``; ties go to the length nearest the item's, then to the shorter.  None beyond ``most``.

    Columns of the distance table are bit vectors of differences (Myers), here with both sides
    anchored at their beginning.
    """
    full, last = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (m, m, 0)
    for j, w in enumerate(text, 1):
        eq = mask.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph, mh = ph << 1 | 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv & full
        if score <= best[0]:
            best = min(best, (score, abs(j - m), j))
    return (best[0], best[2]) if best[0] <= most else None


def windows(members: dict[int, np.ndarray], number: int, c: Class, stop: np.ndarray) -> np.ndarray:
    """First words of the windows that hold enough runs of the class's items."""
    one = (members[c.q] >> U64(number % 64)) & U64(1) == 1
    if not one.any():
        return np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(one)])
    here = np.arange(len(one))
    return np.flatnonzero(total[np.minimum(here + max(c.span - c.q + 1, 1), stop)] - total[:-1] >= c.need)


def leaks(h: np.ndarray, members: dict[int, np.ndarray], stop: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(item index, first word, end word, edits) of the leaks in several texts; places of one item do not overlap.

    ``h`` are the words of all texts, ``members`` the class bits of the run of q words that begins at
    each, ``stop`` is the end of each word's text.
    """
    o = items.o
    found: dict[int, list[tuple[int, int, int]]] = {}
    for number, c in enumerate(items.classes):
        start = windows(members, number, c, stop)
        for s in range(0, len(start), 4096):
            at = start[s : s + 4096]
            place = at[:, None] + np.arange(c.span + 1)
            inside = place < np.minimum(stop[at], at + c.span)[:, None]
            k = items.sample(np.where(inside, h[np.where(inside, place, 0)], U64(0)), c)
            lo, hi = np.searchsorted(c.keys, k.ravel(), "left"), np.searchsorted(c.keys, k.ravel(), "right")
            hit = np.flatnonzero(hi > lo)
            many = (hi - lo)[hit]
            row = np.repeat(hit // k.shape[1], many)
            item = c.items[np.repeat(lo[hit], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
            for pair in np.unique(row * len(items.words) + item).tolist():
                r, i = divmod(pair, len(items.words))
                p, n = int(at[r]), len(items.words[i])
                most = allowed(n, o)
                got = align(items.mask(i), n, h[p : min(int(stop[p]), p + n + most)].tolist(), most)
                if got:
                    found.setdefault(i, []).append((got[0], p, p + got[1]))
    out = []
    for i, places in found.items():
        taken: list[tuple[int, int]] = []
        for d, s, e in sorted(places):
            at = bisect_left(taken, (s, s))
            if (at == 0 or taken[at - 1][1] <= s) and (at == len(taken) or e <= taken[at][0]):
                insort(taken, (s, e))
                out.append((i, s, e, d))
    return sorted(out)


FOUND = "doc_id bigint, item_id bigint, start bigint, end bigint, edits int, item_words int"


def _passes(benchmark: DataFrame, o: Options) -> Iterator[Items]:
    """The benchmark in chunks of about ``Options.chunk_words`` words: what is shipped to the workers is bounded however long it is."""
    rows = benchmark.select("item_id", "text").where(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    words = rows.agg(F.sum(F.length("text") / 4)).head()[0] or 0
    chunks = max(1, -(-int(words) // o.chunk_words))
    for chunk in range(chunks):
        got = sorted({(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk).collect()})
        yield Items([i for i, _ in got], [t for _, t in got], o)


def _search(b: pa.RecordBatch, items: Items) -> list[tuple[int, int, int, int, int, int]]:
    """(row, item_id, start byte, end byte, edits, words of the item) of the leaks in a batch."""
    w = Words(*utf8(b.column("text")), letter_words())
    h = w.hashes()
    members = {}
    for q, runs in items.runs.items():
        g, at = grams(h, w.first, q, whole=False)
        n = np.diff(at)
        # by the word where the run begins
        begin = np.repeat(w.first[:-1], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)
        members[q] = np.zeros(len(h), U64)
        members[q][begin] = runs.members(g)
    owner = np.repeat(np.arange(b.num_rows), np.diff(w.first))
    return [
        (int(owner[s]), int(items.ids[i]), int(w.start[s] - w.offs[owner[s]]), int(w.end[max(s, e - 1)] - w.offs[owner[s]]), d, len(items.words[i]))
        for i, s, e, d in leaks(h, members, w.first[1:][owner], items)
    ]


def find(docs: DataFrame, benchmark: DataFrame, o: Options = Options()) -> DataFrame:
    """``doc_id, item_id, start, end, edits, item_words``: every leak; start and end are byte offsets into the UTF-8 text.

    Edge cases: null and empty texts, and items without words, leak nowhere;
    equal items are found under each item_id; repeated rows give repeated leaks; null doc_ids are
    kept; columns besides doc_id, item_id and text are not read; an empty table on either side gives
    no rows.  Very long texts are searched as a whole.
    """
    lean(docs.sparkSession)
    out: DataFrame | None = None
    for items in _passes(benchmark, o):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            for whole in batches:
                for b in pieces(whole):
                    if rows := _search(b, items):
                        row, *rest = zip(*rows)
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *(pa.array(c, t) for c, t in zip(rest, types[1:]))], names=["doc_id", "item_id", "start", "end", "edits", "item_words"])

        part = docs.select("doc_id", "text").mapInArrow(run, FOUND)
        out = part if out is None else out.unionAll(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, o: Options = Options()) -> DataFrame:
    """The rows of ``docs``, with all their columns, into which no item leaks.

    Row by row: nothing is shuffled or joined.  Edge cases are those of :func:`find`: null and empty
    texts stay, repeated rows stay or go together, null doc_ids and further columns do no harm, and
    an empty table on either side changes nothing.
    """
    for items in _passes(benchmark, o):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in pieces(whole):
                    bad = np.zeros(b.num_rows, bool)
                    bad[[r[0] for r in _search(b, items)]] = True
                    yield b.filter(pa.array(~bad))

        docs = over_rows(docs, run)
    return docs


def leaking(docs: DataFrame, benchmark: DataFrame, o: Options = Options()) -> DataFrame:
    """One row for each document and item that leaks into it, with the number of places and the best match."""
    best = F.min(F.struct("edits", "start", "end")).alias("best")
    per = find(docs, benchmark, o).groupBy("doc_id", "item_id").agg(F.count("*").cast("bigint").alias("n_places"), best, F.max("item_words").alias("item_words"))
    return per.select("doc_id", "item_id", "n_places", F.col("best.edits").alias("edits"), F.col("best.start").alias("start"), F.col("best.end").alias("end"), "item_words")
