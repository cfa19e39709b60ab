"""Removing repeated byte strings by a sparse suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else.  The suffixes
to sort are chosen so that none of these strings is missed and few suffixes remain: in every window
of ``length`` bytes the gram of smallest hash is an anchor, so two equal windows have an anchor at
the same place.  Anchors whose gram occurs once are done after counting.  Anchors that agree on all
bytes any of their windows can reach (their context) are equal everywhere and are settled by
counting too.  What is left are grams with several contexts, one representative of each.  There the
texts after the anchor are suffix sorted (deep-shallow, :mod:`suffix_sort`), which gives the right
match of any two members as the smallest common prefix between them.  Members are merged from the
longest common prefix down, always the smaller set into the larger, in the order of their reversed
left contexts; only neighbours in that order can match best on both sides, so all windows that occur
twice are found without looking at all pairs.

A gram with more than ``limit`` contexts is not sorted in one task.  Its windows are halved by where
the anchor lies in them: all windows of one half share a piece of context, which splits the members
by its hash, counted in Spark.  Halving goes on until groups are small or a single window position
is left, where equal hashes are equal windows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Workspace, lean, small_batches
from ._text import PIECE, U64, _powers, _values, mix, pieces, utf8
from .suffix_sort import lcp, sort

BITS = 14  # of a context's length on one side; leaves 35 bits for the position
SEGMENT = PIECE - 3 * (1 << BITS)  # with the contexts around it a segment stays within the power tables


@dataclass(frozen=True)
class Options:
    length: int = 400
    gram: int = 192
    limit: int = 20_000  # contexts of one gram that one task may sort: some 8 MB


def _slide(v: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every window of w values."""
    n = len(v) - w + 1
    if n <= 0:
        return v[:0]
    pad = (-len(v)) % w
    fill = v.dtype.type(np.iinfo(v.dtype).max if f is np.minimum else 0)
    p = np.concatenate([v, np.full(pad, fill, v.dtype)]).reshape(-1, w)
    left = f.accumulate(p, 1).ravel()
    right = f.accumulate(p[:, ::-1], 1)[:, ::-1].ravel()
    return f(right[:n], left[w - 1 : w - 1 + n])


def anchors(buf: np.ndarray, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor positions of one text, their gram hashes and the hashes of their contexts."""
    w = o.length - o.gram + 1
    p, inv = _powers()
    val = _values(False)
    pos, grams, contexts = [], [], []
    reach = o.length - o.gram
    for at in range(0, len(buf) - o.length + 1, SEGMENT):
        # windows that start in [at, at + SEGMENT)
        to = min(len(buf), at + SEGMENT + o.length - 1)
        lo, hi = max(0, at - reach), min(len(buf), to + o.length)
        seg = val[buf[lo:hi]]
        seg *= p[: len(seg)]
        cs = np.empty(len(seg) + 1, U64)
        cs[0] = 0
        np.cumsum(seg, out=cs[1:])
        s, e = at - lo, to - lo
        h = mix((cs[s + o.gram : e + 1] - cs[s : e - o.gram + 1]) * inv[s : e - o.gram + 1]) | U64(1)
        low = _slide(h, w, np.minimum)
        high = _slide(np.concatenate([np.zeros(w - 1, U64), low, np.zeros(w - 1, U64)]), w, np.maximum)
        a = np.flatnonzero(high == h) + at
        if len(pos) and len(a):
            a = a[a > pos[-1][-1]] if len(pos[-1]) else a
        l, r = np.maximum(a - reach, 0) - lo, np.minimum(a + o.length, len(buf)) - lo
        pos.append(a)
        grams.append(h[a - at])
        contexts.append(mix((cs[r] - cs[l]) * inv[l] + (r - l).astype(U64) * U64(0x9E3779B97F4A7C15) + (a - lo - l).astype(U64)))
    if not pos:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64)
    return np.concatenate(pos), np.concatenate(grams), np.concatenate(contexts)


def scan(docs: DataFrame, o: Options) -> DataFrame:
    """``doc_id, t_hash, gram, context, place`` for the anchors of every text; place packs the position and the context's length on either side (see :func:`_unpack`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                buf, offs = utf8(b.column("text"))
                found = [anchors(buf[s:e], o) for s, e in zip(offs[:-1], offs[1:])]
                n = np.array([len(f[0]) for f in found], np.int64)
                at = pa.array(np.repeat(np.arange(len(n)), n))
                pos, gram, ctx = (np.concatenate([f[k] for f in found]) for k in range(3))
                size = np.repeat(np.diff(offs), n)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(at), b.column("t_hash").take(at), pa.array(gram.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array((pos << 2 * BITS) | (np.minimum(pos, o.length - o.gram) << BITS) | np.minimum(o.length, size - pos))],
                    names=["doc_id", "t_hash", "gram", "context", "place"],
                )

    return docs.select("doc_id", "t_hash", "text").mapInArrow(run, "doc_id bigint, t_hash bigint, gram bigint, context bigint, place bigint")


def _unpack(rows: DataFrame) -> DataFrame:
    """``pos, lo, hi`` (bytes of the text) in place of ``place``."""
    side = (1 << BITS) - 1
    pos = F.shiftright("place", 2 * BITS)
    return rows.withColumns({"pos": pos, "lo": pos - F.shiftright("place", BITS).bitwiseAND(F.lit(side)), "hi": pos + F.col("place").bitwiseAND(F.lit(side))}).drop("place")


def repeated(left: list[bytes], right: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(member, l, r): the strings from l bytes before a member's gram to r bytes after it that another member has too, with l + r >= length.

    ``left`` are reversed left contexts, ``right`` begin after the gram that all share.
    """
    m = len(left)
    if m == 2:
        l, r = lcp(left[0], left[1]), lcp(right[0], right[1])
        if l + r >= length:
            yield from ((0, l, r), (1, l, r))
        return
    order, common = sort(right)
    by_left, _ = sort(left)
    rank = [0] * m
    for k, i in enumerate(by_left):
        rank[i] = k
    sets: list[list[int] | None] = [[rank[i]] for i in order]
    head = list(range(m))  # union-find over places in ``order``

    def find(k: int) -> int:
        while head[k] != k:
            head[k] = head[head[k]]
            k = head[k]
        return k

    for k in sorted(range(1, m), key=lambda k: -common[k]):
        r = common[k]
        a, b = find(k - 1), find(k)
        x, y = sets[a], sets[b]
        if len(x) > len(y):
            x, y, a, b = y, x, b, a
        for v in x:
            at = bisect_left(y, v)
            for u in y[max(0, at - 1) : at + 1]:
                i, j = by_left[v], by_left[u]
                l = lcp(left[i], left[j])
                if l + r >= length:
                    yield from ((i, l, r), (j, l, r))
        if len(x) < 16:
            for v in x:
                insort(y, v)
        else:
            sets[b] = sorted(x + y)  # two runs: one merge
        sets[a] = None
        head[a] = b


def contexts(docs: DataFrame, wanted: DataFrame, o: Options) -> DataFrame:
    """The bytes of the wanted contexts around the gram: ``gram, doc_id, t_hash, pos, single, before, after`` (before is reversed)."""
    places = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("t_hash").alias("w_hash")).agg(F.collect_list(F.struct("gram", "pos", "lo", "hi", "single")).alias("at"))
    texts = docs.select("doc_id", "t_hash", "text").join(places.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("t_hash") == F.col("w_hash")))
    texts = texts.select("doc_id", "t_hash", "text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                buf, offs = utf8(b.column("text"))
                owner, at = b.column("at").value_parent_indices(), b.column("at").flatten()
                gram, pos, lo, hi, single = (at.field(k) for k in range(5))
                base = offs[owner.to_numpy()]
                p, l, r = (base + x.to_numpy() for x in (pos, lo, hi))
                raw = buf.tobytes()
                before = pa.array([raw[x:y][::-1] for x, y in zip(l.tolist(), p.tolist())], pa.binary())
                after = pa.array([raw[x:y] for x, y in zip((p + o.gram).tolist(), r.tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([gram, b.column("doc_id").take(owner), b.column("t_hash").take(owner), pos, single, before, after], names=["gram", "doc_id", "t_hash", "pos", "single", "before", "after"])

    return texts.mapInArrow(run, "gram bigint, doc_id bigint, t_hash bigint, pos bigint, single boolean, before binary, after binary")


def _resolve(rows: DataFrame, o: Options) -> DataFrame:
    """Sorts each small group of contexts; ``rows`` arrive by group.  Gives ``doc_id, t_hash, lo, hi`` to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def flush() -> list[tuple]:
            out = []
            if len(group) > 1:
                hits = repeated([g[4] for g in group], [g[5] for g in group], o.length - o.gram)
                best: dict[int, set[tuple[int, int]]] = {}
                for i, l, r in hits:
                    if group[i][3]:
                        best.setdefault(i, set()).add((l, r))
                for i, spans in best.items():
                    d, t, p = group[i][:3]
                    out += [(d, t, p - l, p + o.gram + r) for l, r in spans]
            return out

        for b in batches:
            out = []
            cols = [b.column(c).to_pylist() for c in ("group", "doc_id", "t_hash", "pos", "single", "before", "after")]
            for g, *row in zip(*cols):
                if g != key:
                    out += flush()
                    key, group = g, []
                group.append(row)
            if out:
                yield _spans(out)
        if out := flush():
            yield _spans(out)

    return rows.mapInArrow(run, "doc_id bigint, t_hash bigint, lo bigint, hi bigint")


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["doc_id", "t_hash", "lo", "hi"])


def _small(ws: Workspace, rows: DataFrame, o: Options) -> DataFrame:
    at = rows.repartition("group").sortWithinPartitions("group")
    return ws.put(_resolve(at.select("group", "doc_id", "t_hash", "pos", "single", "before", "after"), o), "spans")


def _large(ws: Workspace, rows: DataFrame, o: Options) -> DataFrame | None:
    """Halves the windows of large groups until they are small or one window position is left."""
    spans: DataFrame | None = None
    rows = rows.withColumns({"j0": F.lit(0), "j1": F.lit(o.length - o.gram)})
    while rows.limit(1).count():
        mid = F.floor((F.col("j0") + F.col("j1")) / 2).cast("int")
        both = rows.withColumn("half", F.explode(F.array(F.struct(F.col("j0").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("j1").alias("b")))))
        both = both.withColumn("j0", F.col("half.a")).withColumn("j1", F.col("half.b")).where("j0 <= j1").drop("half")
        # all windows of this half reach from j0 bytes before the gram to length - gram - j1 bytes after it
        both = both.where((F.length("before") >= F.col("j0")) & (F.length("after") >= o.length - o.gram - F.col("j1")))
        key = F.xxhash64("group", "j0", "j1", F.expr("substring(before, 1, j0)"), F.expr(f"substring(after, 1, {o.length - o.gram} - j1)"))
        both = ws.put(both.withColumn("group", key), "halves", "lz4")
        n = ws.put(both.groupBy(F.col("group").alias("g")).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        both = ws.put(both.join(n, F.col("group") == F.col("g")).drop("g"), "halves", "lz4")
        last = both.where("j0 = j1 AND single").select("doc_id", "t_hash", (F.col("pos") - F.col("j0")).alias("lo"), (F.col("pos") - F.col("j0") + o.length).alias("hi"))
        # a small group answers for its own windows only: cut the contexts to them
        few = both.where(F.col("n").between(2, o.limit) & (F.col("j0") < F.col("j1")))
        few = few.withColumn("before", F.expr("substring(before, 1, j1)")).withColumn("after", F.expr(f"substring(after, 1, {o.length - o.gram} - j0)"))
        part = ws.put(last, "spans").unionAll(_small(ws, few, o))
        spans = part if spans is None else spans.unionAll(part)
        rows = both.where((F.col("n") > o.limit) & (F.col("j0") < F.col("j1"))).drop("n")
    return spans


def remove_repeats(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``spans`` (removed runs in bytes) for every row of ``docs``.

    Edge cases: null and empty texts have no bytes; texts shorter than ``length`` keep all; a
    repeated row is a place of its own, so equal long texts remove each other; strings may overlap
    and repeat inside one text; rows of one doc_id, or of none, are told apart by a 64-bit hash of their text; columns besides doc_id and
    text are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    lean(spark)
    ws = Workspace(spark, "repeats")
    docs = docs.select("doc_id", F.xxhash64("text").alias("t_hash"), "text")
    with small_batches(spark):
        found = ws.put(scan(docs, o), "anchors")
        # small sides are written first: then both sides of a join are plain shuffles, whose hot keys Spark can split
        twice = ws.put(found.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n")).where("n > 1").select("g"), "twice")
        found_twice = ws.put(found.join(twice, F.col("gram") == F.col("g"), "left_semi"), "repeated")
        ws.drop(found)
        stats = found_twice.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "t_hash", "place")).alias("first"))
        stats = ws.put(stats, "contexts")
        copies = ws.put(stats.where("n > 1").select(F.col("gram").alias("g"), F.col("context").alias("c")), "copies")
        whole = _unpack(found_twice.join(copies, (F.col("gram") == F.col("g")) & (F.col("context") == F.col("c")), "left_semi"))
        spans = ws.put(whole.where(F.col("hi") - F.col("lo") >= o.length).select("doc_id", "t_hash", "lo", "hi"), "spans")
        ws.drop(found_twice)

        # grams with several contexts: one representative of each, compared with the others
        varied = ws.put(stats.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("v")).where("v > 1"), "varied")
        wanted = stats.join(varied, F.col("gram") == F.col("g")).select("gram", "first.*", (F.col("n") == 1).alias("single"), "v")
        wanted = _unpack(ws.put(wanted, "wanted"))
        bytes_ = ws.put(contexts(docs, wanted, o), "bytes", "lz4").withColumnRenamed("gram", "group")
        large = ws.put(wanted.where(F.col("v") > o.limit).select(F.col("gram").alias("g")).distinct(), "large")
        if large.limit(1).count():
            small = bytes_.join(large, F.col("group") == F.col("g"), "left_anti")
            rest = _large(ws, bytes_.join(large, F.col("group") == F.col("g"), "left_semi"), o)
        else:
            small, rest = bytes_, None
        spans = spans.unionAll(_small(ws, small, o))
        if rest is not None:
            spans = spans.unionAll(rest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for b in pieces(whole_batch):
                buf, offs = utf8(b.column("text"))
                lists = b.column("at")
                out: tuple[list, ...] = ([], [], [], [])
                for i in range(b.num_rows):
                    text = buf[offs[i] : offs[i + 1]]
                    runs = merged(lists[i].as_py() or [])
                    kept, at = hashlib.sha256(), 0
                    for s, e in runs:
                        kept.update(text[at:s].tobytes())
                        at = e
                    kept.update(text[at:].tobytes())
                    for column, v in zip(out, (len(text), sum(e - s for s, e in runs), [{"lo": s, "hi": e} for s, e in runs], kept.hexdigest())):
                        column.append(v)
                span = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array([len(x) for x in out[2]], pa.int64()), pa.array(out[3], pa.string()), pa.array(out[2], span)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    per = spans.groupBy(F.col("doc_id").alias("s_id"), F.col("t_hash").alias("s_hash")).agg(F.collect_set(F.struct("lo", "hi")).alias("at"))
    texts = docs.join(per, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("t_hash") == F.col("s_hash")), "left")
    return texts.select("doc_id", "text", "at").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<lo:bigint,hi:bigint>>")


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans; spans that touch are one run."""
    out: list[list[int]] = []
    for s, e in sorted((x["lo"], x["hi"]) for x in spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
