"""Near duplicates by min-max hashing.

For each of ``permutations`` hash functions both the smallest and the largest value over a
document's shingles are kept, so one evaluation gives two signature values, each of which agrees
between two sets with the probability of their Jaccard similarity.  Bands of ``rows`` values, of
minima and of maxima, propose pairs: at similarity 0.75, 64 permutations and 4 rows make 32 bands,
and a pair shares none with probability (1 - 0.75^4)^32 = 5e-6.

Documents with equal shingle sets are one class from the start and only its smallest doc_id goes
on, so exact copies never meet in a band.  A band's bucket is never expanded into pairs at first:
(1) every class is compared with one smaller class, the smallest of the centres of its buckets;
(2) those still apart from another centre are compared with that; (3) what may still link to another
component of its bucket goes by the shingles that several components hold.  A link needs so many of
them that, ordered from the rarest, both ends share one of their first few (prefix filtering), so
documents meet only over rare shared shingles, in blocks of sets that never become rows of pairs.
Sizes bound the similarity first; every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import Workspace, lean, small_batches
from ._text import U64, Words, grams, mix, pieces, space_words, utf8
from .components import components


@dataclass(frozen=True)
class Options:
    shingle: int = 5
    percent: int = 75  # links: 100 * intersection >= percent * union
    permutations: int = 64
    rows: int = 4
    block: int = 512  # sets of a family compared together
    seed: int = 20_240_501


def _sets(b: pa.RecordBatch, o: Options) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, and where each begins."""
    w = Words(*utf8(b.column("text")), space_words())
    g, at = grams(w.hashes(), w.first, o.shingle)
    out = [np.unique(g[at[i] : at[i + 1]]) for i in range(b.num_rows)]
    return np.concatenate([*out, np.empty(0, U64)]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def fingerprints(docs: DataFrame, o: Options) -> DataFrame:
    """``doc_id, n, k1, k2, bands``: set size, a 128-bit hash of the set, and one hash for each band (null without shingles)."""
    rng = np.random.default_rng(o.seed)
    mult = rng.integers(0, 1 << 63, o.permutations, dtype=np.int64).astype(U64) * U64(2) + U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                g, at = _sets(b, o)
                n = np.diff(at)
                some = np.flatnonzero(n)
                starts = at[:-1][some]
                k1, k2 = np.zeros(len(n), U64), np.zeros(len(n), U64)
                n_bands = 2 * (o.permutations // o.rows)
                bands = np.zeros((len(some), n_bands), U64)
                if len(some):
                    k1[some] = np.add.reduceat(mix(g), starts)
                    k2[some] = np.add.reduceat(mix(g ^ U64(0xA5A5A5A55A5A5A5A)), starts)
                    for p in range(o.permutations):
                        y = g * mult[p]
                        j = p // o.rows
                        for half, f in enumerate((np.minimum, np.maximum)):
                            band = half * (n_bands // 2) + j
                            bands[:, band] = mix(bands[:, band] * U64(31) ^ f.reduceat(y, starts) + U64(band + 1))
                lists = np.zeros(len(n) + 1, np.int32)
                lists[1:] = np.cumsum(np.where(n > 0, n_bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(pa.array(lists), pa.array(bands.ravel().view(np.int64)))],
                    names=["doc_id", "n", "k1", "k2", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, o: Options) -> DataFrame:
    """``doc_id, members``: the sorted 64-bit shingle hashes of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole):
                g, at = _sets(b, o)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([g[s:e].tobytes() for s, e in zip(at[:-1], at[1:])], pa.binary())], names=["doc_id", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, members binary")


def confirm(pairs: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for i, (x, y) in enumerate(zip(t.column("x"), t.column("y"))):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= o.percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield t.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a")
    two = one.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _spread(members: DataFrame) -> DataFrame:
    """``rep, label, h``: one row for each shingle of ``rep, label, members``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 200):
                c = b.slice(i, 200)
                n = np.array([len(x.as_buffer()) // 8 for x in c.column("members")], np.int64)
                h = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in c.column("members")])
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([c.column("rep").take(at), c.column("label").take(at), pa.array(h)], names=["rep", "label", "h"])

    return members.select("rep", "label", "members").mapInArrow(run, "rep bigint, label bigint, h bigint")


def shared_shingles(ws: Workspace, lm: DataFrame, sets: DataFrame) -> DataFrame:
    """``rep, label, h, df``: the shingles of the members that members of several components hold, and by how many members."""
    who = lm.select("rep", "label").distinct()
    held = ws.put(_spread(who.join(sets, F.col("rep") == F.col("doc_id"))), "held")
    several = held.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("df")).where("lo <> hi").select(F.col("h").alias("s_h"), "df")
    several = ws.put(several, "several")
    out = ws.put(held.join(several, F.col("h") == F.col("s_h")).select("rep", "label", "h", "df"), "shared")
    ws.drop(held, several)
    return out


def narrow(ws: Workspace, lm: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """Bucket members (rep, n, label) that may still link to another component of their bucket, and ``most``, the largest set they may link to.

    Lossless.  A link to another component runs over shingles that several components hold.  With s
    of those among n shingles, a partner of m shingles needs percent * (n + m - s) <= 100 * s, which
    bounds m; members whose bucket has no such partner are done.
    """
    mixed = lm.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("n").alias("least")).where("lo <> hi")
    mixed = ws.put(mixed, "buckets")
    lm = ws.put(lm.select("key", "rep", "n", "label").join(mixed.select(F.col("key").alias("m_key"), "least"), F.col("key") == F.col("m_key")).drop("m_key"), "mixed")
    shared = shared_shingles(ws, lm, sets)
    counted = shared.groupBy(F.col("rep").alias("s_rep")).agg(F.count("*").alias("s"))
    out = lm.join(counted, F.col("rep") == F.col("s_rep")).withColumn("most", F.floor(F.col("s") * (100 + o.percent) / o.percent - F.col("n")))
    out = out.where(F.col("most") >= F.greatest("least", F.ceil(F.col("n") * o.percent / 100)))
    out = ws.put(out.select("rep", "n", "label", "most").distinct(), "narrow")
    ws.drop(shared)
    return out


def block_links(ws: Workspace, lm: DataFrame, sets: DataFrame, o: Options) -> DataFrame:
    """The links (a, b) between members (rep, n, label, most) of different components, without a row for each pair.

    Of its shared shingles, rarest first, a member of n shingles keeps as prefix all but the last
    ceil(n * percent / 100) - 1: two members that link share a shingle of both prefixes.  Members that
    share one are one family, cut into blocks of about ``o.block`` sets.  Two blocks meet, in one
    group of at most twice that, only if they share such a shingle; there the shared shingles are
    counted together and only links come out.  What travels with a member is its list of shared
    shingles, once for each block that it meets.
    """
    shared = shared_shingles(ws, lm, sets).groupBy(F.col("rep").alias("t_rep")).agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("t"))
    docs = lm.join(shared, F.col("rep") == F.col("t_rep")).withColumn("t", F.col("t.h"))
    extra = F.size("t") - F.ceil(F.col("n") * o.percent / 100).cast("int") + 1
    docs = ws.put(docs.where(extra > 0).select("rep", "n", "label", "most", "t", F.slice("t", F.lit(1), F.greatest(extra, F.lit(1))).alias("prefix")), "prefixed")
    rare = docs.select("rep", "label", F.explode("prefix").alias("h"))
    first = rare.groupBy(F.col("h").alias("f_h")).agg(F.min("rep").alias("first"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("f_h", "first")
    rare = ws.put(rare.join(ws.put(first, "rare"), F.col("h") == F.col("f_h")).select("rep", "h", "first"), "rare")
    family = components(ws, rare.select(F.col("rep").alias("a"), F.col("first").alias("b")).where("a <> b").distinct())
    size = family.groupBy(F.col("label").alias("family")).agg(F.ceil(F.count("*") / o.block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    place = ws.put(family.join(size, F.col("label") == F.col("family")).select("node", "family", own), "family")
    # which blocks meet; shingles that the same blocks hold count once
    met = rare.join(place, F.col("rep") == F.col("node")).groupBy("family", "h").agg(F.sort_array(F.collect_set("own")).alias("held")).select("family", "held").distinct()
    pairs = met.select("family", "held", F.explode("held").alias("lo")).select("family", "lo", F.explode("held").alias("hi")).where("lo <= hi").distinct()
    pairs = ws.put(pairs, "meet")
    either = pairs.select("family", F.col("lo").alias("of"), "lo", "hi").unionAll(pairs.where("lo < hi").select("family", F.col("hi").alias("of"), "lo", "hi"))
    either = either.select(F.col("family").alias("e_family"), "of", "lo", "hi")
    rows = docs.join(place, F.col("rep") == F.col("node")).join(either, (F.col("family") == F.col("e_family")) & (F.col("own") == F.col("of")))
    rows = rows.select("family", "lo", "hi", "own", "rep", "label", "most", "n", "t").repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for b in batches:
            links: list[tuple[int, int]] = []
            cols = [b.column(c).to_pylist() for c in ("family", "lo", "hi", "own", "rep", "label", "most", "n")]
            for f, lo, hi, own, rep, label, most, n, t in zip(*cols, b.column("t")):
                if (f, lo, hi) != key:
                    links += linked_pairs(group, key, o)
                    key, group = (f, lo, hi), []
                group.append((own, rep, label, most, n, t.values.to_numpy()))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])
        if links := linked_pairs(group, key, o):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint")


def linked_pairs(group: list[tuple], key: tuple | None, o: Options) -> list[tuple[int, int]]:
    """Links between two blocks (own, rep, label, most, n, shared shingles), or inside one."""
    if len(group) < 2:
        return []
    own, rep, label, most, n = (np.array([g[k] for g in group], np.int64) for k in range(5))
    ask = (label[:, None] != label[None]) & (n[:, None] <= most[None]) & (n[None] <= most[:, None]) & (rep[:, None] > rep[None])
    if key[1] != key[2]:
        ask &= own[:, None] != own[None]
    x, y = np.nonzero(ask & (100 * np.minimum(n[:, None], n[None]) >= o.percent * np.maximum(n[:, None], n[None])))
    if not len(x):
        return []
    h = np.concatenate([g[5] for g in group])
    doc = np.repeat(np.arange(len(group)), [len(g[5]) for g in group])
    by = np.argsort(h, kind="stable")
    h, doc = h[by], doc[by]
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.append(start, len(h)))
    keep = np.repeat(count > 1, count)
    column = np.repeat(np.cumsum(count > 1) - 1, count)[keep]
    doc = doc[keep]
    both = np.zeros((len(group), len(group)), np.float32)
    wide = 4096
    edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + wide + 1, wide))
    for s, e in zip(edge[:-1], edge[1:]):
        m = np.zeros((len(group), wide), np.float32)
        m[doc[s:e], column[s:e] % wide] = 1
        both += m @ m.T
    both = both[x, y].astype(np.int64)
    ok = 100 * both >= o.percent * (n[x] + n[y] - both)
    return list(zip(rep[x[ok]].tolist(), rep[y[ok]].tolist()))


def near_duplicates(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, class_id, n_links`` for every row of ``docs``.

    component_id is the smallest doc_id reachable by links, class_id the smallest doc_id with the
    same shingle set, n_links the confirmed links that the search recorded for the class.

    Edge cases: null and empty texts and texts without words have no shingles and stay alone, each
    its own component; a text under five words is one shingle.  Rows with a null doc_id take no
    part (component_id null, kept true).  Repeated rows get equal results.  Rows that share a doc_id
    but not a text are judged by their own text and may be joined through the shared id.  Columns
    besides doc_id and text are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    lean(spark)
    ws = Workspace(spark, "near")
    with small_batches(spark):
        prints = ws.put(fingerprints(docs, o), "prints")
        some = prints.where("n > 0 AND doc_id IS NOT NULL")
        classes = ws.put(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
        keys = classes.select("rep", "n", F.explode("bands").alias("key"))
        # written first, so that both sides of the join are plain shuffles, whose hot keys Spark can split
        centre = keys.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("c"), F.count("*").alias("m")).where("m > 1").select(F.col("key").alias("c_key"), "c")
        centre = ws.put(centre, "centres")
        members = keys.join(centre, F.col("key") == F.col("c_key")).select("key", "rep", "n", F.col("c.rep").alias("centre"), F.col("c.n").alias("c_n"))
        members = ws.put(members, "members")
        wanted = members.select(F.col("rep").alias("w")).distinct()
        texts = docs.select("doc_id", "text").join(wanted.hint("shuffle_hash"), F.col("doc_id") == F.col("w"), "left_semi")
        sets = ws.put(shingle_sets(texts, o), "sets", "none")
        if_sized = lambda p, q: 100 * F.least(p, q) >= o.percent * F.greatest(p, q)

        star = members.where((F.col("rep") != F.col("centre")) & if_sized(F.col("n"), F.col("c_n")))
        tried = star.groupBy("rep").agg(F.min("centre").alias("centre"))
        links = ws.put(confirm(tried.select(F.col("rep").alias("a"), F.col("centre").alias("b")), sets, o), "linked")
        labels = components(ws, links)

        def labelled(t: DataFrame, column: str, name: str) -> DataFrame:
            of = labels.select(F.col("node").alias(f"{name}_node"), F.col("label").alias(f"{name}_label"))
            return t.join(of, F.col(column) == F.col(f"{name}_node"), "left").withColumn(name, F.coalesce(f"{name}_label", column)).drop(f"{name}_node", f"{name}_label")

        found = links
        left = labelled(labelled(star.select("rep", "centre").distinct(), "rep", "la"), "centre", "lb").where("la <> lb")
        more = ws.put(confirm(left.select(F.col("rep").alias("a"), F.col("centre").alias("b")), sets, o), "linked")
        found = found.unionAll(more)
        labels = components(ws, found)

        # what is left: buckets whose members still lie in several components
        lm = ws.put(labelled(members.select("key", "rep", "n"), "rep", "label"), "labelled")
        narrowed = narrow(ws, lm, sets, o)
        if narrowed.limit(1).count():
            found = found.unionAll(ws.put(block_links(ws, narrowed, sets, o), "linked"))
            labels = components(ws, found)
        ws.drop(members, sets, lm, narrowed)

    degree = found.select(F.explode(F.array("a", "b")).alias("d_node")).groupBy("d_node").agg(F.count("*").alias("n_links"))
    named = labelled(classes.select("k1", "k2", "n", "rep"), "rep", "component_id").join(degree, F.col("rep") == F.col("d_node"), "left")
    named = named.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n").alias("cn"), "rep", "component_id", "n_links")
    out = prints.select("doc_id", "n", "k1", "k2").join(named, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") == F.col("cn")) & F.col("doc_id").isNotNull(), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def one_of_each(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one document of each component stays.

    Edge cases: rows with equal doc_id and text become one; rows of a kept doc_id with different texts
    all stay; null doc_ids stay; null and empty texts link with nothing and stay; an empty table gives
    no rows.
    """
    kept = near_duplicates(docs, o).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__kept_id")).distinct()
    named, key = docs.where("doc_id IS NOT NULL"), F.xxhash64("text")
    repeated = named.select(F.col("doc_id").alias("__again_id"), key.alias("__again_hash")).groupBy("__again_id", "__again_hash").count().where("count > 1").select("__again_id", "__again_hash")
    repeated = Workspace(docs.sparkSession, "near").put(repeated, "repeated")
    out = named.join(kept.hint("shuffle_hash"), F.col("doc_id") == F.col("__kept_id"), "left_semi")
    if repeated.limit(1).count():
        same = (F.col("doc_id") == F.col("__again_id")) & (key == F.col("__again_hash"))
        out = out.join(repeated, same, "left_anti").unionAll(out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))
    return out.unionAll(docs.where("doc_id IS NULL"))
