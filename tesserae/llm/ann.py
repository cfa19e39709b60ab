"""Approximate nearest neighbours by largest inner product on robust-pruned directed graphs.

Equal vectors are one class, of which only the smallest ids matter, so copies neither clog a graph
nor crowd a result.  Classes are dealt by hash into shards of about ``shard`` vectors.  A shard's
graph grows in batches: a greedy beam search from the centre proposes neighbours of each new vector,
robust pruning keeps a candidate only if no kept one is closer to it by the factor ``alpha``, and
the reverse edges are pruned the same way where a node has too many.  Query vectors go to the shards:
a task gets one shard, once, and then blocks of queries stream past it, so a shard's vectors and
edges are moved once for ``blocks`` query blocks; beam search answers each query in every shard, and
the best of all shards are merged.

Largest inner product becomes smallest distance by one further component, sqrt(M^2 - |x|^2) for
vectors and 0 for queries, with M the largest norm.  Reported scores are inner products of the
original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import Workspace, small_batches


@dataclass(frozen=True)
class Options:
    k: int = 20
    shard: int = 8192
    degree: int = 32
    slack: int = 48  # a node's edges before they are pruned again
    build_beam: int = 64
    search_beam: int = 128
    width: int = 4  # nodes expanded in each step of a search
    alpha: float = 1.2
    batch: int = 512
    query_block: int = 1024
    blocks: int = 32  # query blocks that one task searches in its shard
    seed: int = 7


class Graph:
    """A directed graph over ``x`` (rows already extended by the norm component)."""

    def __init__(self, x: np.ndarray, o: Options, edges: np.ndarray | None = None, start: int = 0):
        self.x, self.o, self.start = x.astype(np.float32), o, start
        self.sq = (self.x * self.x).sum(1)
        self.edges = np.full((len(x), o.slack), -1, np.int32) if edges is None else edges

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries in step: the ``beam`` nearest nodes found (-1 if fewer) and their distances, less |q|^2."""
        n, w = len(q), self.o.width
        q = q.astype(np.float32)
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, beam), -1, np.int32)
        dist = np.full((n, beam), np.inf, np.float32)
        done = np.ones((n, beam), bool)
        ids[:, 0] = self.start
        dist[:, 0] = self.sq[self.start] - 2 * (q @ self.x[self.start])
        done[:, 0] = False
        seen[:, self.start] = True
        active = np.arange(n)
        while len(active):
            open_ = ~done[active]
            rank = np.cumsum(open_, 1)
            take = open_ & (rank <= w)
            row, col = np.nonzero(take)
            done[active[row], col] = True
            slot = rank[row, col] - 1
            nxt = np.full((len(active), w, self.o.slack), -1, np.int32)
            nxt[row, slot] = self.edges[ids[active[row], col]]
            nxt = np.sort(nxt.reshape(len(active), -1), 1)
            fresh = nxt >= 0
            fresh[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            r, c = np.nonzero(fresh)
            node = nxt[r, c]
            new = ~seen[active[r], node]
            r, node = r[new], node[new]
            seen[active[r], node] = True
            d = self.sq[node] - 2 * np.einsum("ij,ij->i", q[active[r]], self.x[node])
            count = np.bincount(r, minlength=len(active))
            most = int(count.max()) if len(count) else 0
            if most:
                place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
                add_i = np.full((len(active), most), -1, np.int32)
                add_d = np.full((len(active), most), np.inf, np.float32)
                add_i[r, place], add_d[r, place] = node, d
                all_i = np.concatenate([ids[active], add_i], 1)
                all_d = np.concatenate([dist[active], add_d], 1)
                all_f = np.concatenate([done[active], add_i < 0], 1)
                top = np.argsort(all_d, 1, kind="stable")[:, :beam]
                ids[active] = np.take_along_axis(all_i, top, 1)
                dist[active] = np.take_along_axis(all_d, top, 1)
                done[active] = np.take_along_axis(all_f, top, 1)
            active = active[(~done[active]).any(1)]
        return ids, dist

    def prune(self, nodes: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Robust pruning of the candidates (-1: none) of each node to at most ``degree`` edges."""
        o = self.o
        cand = np.where(cand == nodes[:, None], -1, cand)
        cand = np.sort(cand, 1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        g = self.x[np.maximum(cand, 0)]
        d = self.sq[np.maximum(cand, 0)] + self.sq[nodes][:, None] - 2 * np.einsum("bd,bcd->bc", self.x[nodes], g)
        d = np.where(cand < 0, np.inf, d)
        by = np.argsort(d, 1, kind="stable")
        cand, d, g = np.take_along_axis(cand, by, 1), np.take_along_axis(d, by, 1), np.take_along_axis(g, by[:, :, None], 1)
        sq = self.sq[np.maximum(cand, 0)]
        alive = cand >= 0
        out = np.full((len(nodes), o.slack), -1, np.int32)
        rows = np.arange(len(nodes))
        for k in range(o.degree):
            some = alive.any(1)
            if not some.any():
                break
            pick = alive.argmax(1)
            out[some, k] = cand[rows, pick][some]
            between = sq[rows, pick][:, None] + sq - 2 * np.einsum("bd,bcd->bc", g[rows, pick], g)
            alive &= o.alpha * o.alpha * between > d
            alive[rows, pick] = False
        return out

    def link_back(self, nodes: np.ndarray) -> None:
        """Adds the reverse of the nodes' edges, pruning where a list overflows."""
        to = self.edges[nodes]
        src = np.repeat(nodes, to.shape[1])
        dst = to.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        target, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        incoming = np.full((len(target), int(count.max()) if len(count) else 0), -1, np.int32)
        incoming[np.repeat(np.arange(len(target)), count), place] = src
        have = (self.edges[target] >= 0).sum(1)
        fits = have + count <= self.o.slack
        for group, full in ((fits, False), (~fits, True)):
            t = target[group]
            if not len(t):
                continue
            inc = incoming[group]
            if full:
                for s in range(0, len(t), 1024):
                    cand = np.concatenate([self.edges[t[s : s + 1024]], inc[s : s + 1024]], 1)
                    self.edges[t[s : s + 1024]] = self.prune(t[s : s + 1024], cand)
            else:
                r, c = np.nonzero(inc >= 0)
                self.edges[t[r], have[group][r] + c] = inc[r, c]

    @classmethod
    def build(cls, x: np.ndarray, o: Options) -> Graph:
        rng = np.random.default_rng(o.seed)
        start = int(((x - x.mean(0)) ** 2).sum(1).argmin())
        self = cls(x, o, start=start)
        order = rng.permutation(len(x))
        order = np.concatenate([[start], order[order != start]])
        at = min(len(x), o.batch)
        head = order[:at]
        for s in range(0, at, 128):
            self.edges[head[s : s + 128]] = self.prune(head[s : s + 128], np.broadcast_to(head, (len(head[s : s + 128]), at)).astype(np.int32))
        self.link_back(head)
        while at < len(x):
            step = order[at : at + o.batch]
            cand, _ = self.search(self.x[step], o.build_beam)
            self.edges[step] = self.prune(step, cand)
            self.link_back(step)
            at += len(step)
        return self


def usable(v: Column) -> Column:
    """Neither null nor zero nor holding null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, o: Options = Options()) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to k rows of largest inner product for every row of ``vectors`` where ``is_query`` holds.

    ``vectors`` has vec_id and embedding.  Ties go to the smaller vec_id; rows with the query's own
    vec_id are left out.  Unusable vectors (see :func:`usable`) and null vec_ids take no part; vectors
    of another length than the query's are not candidates; repeated rows are one row; further columns
    are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select("vec_id", v.alias("v"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    with small_batches(spark, 4):
        # the k + 1 smallest ids of each distinct vector; Spark limits groups before it shuffles them
        by = Window.partitionBy("v").orderBy("vec_id")
        few = rows.groupBy("v", "vec_id").agg(F.max("is_query").alias("is_query")).withColumn("n", F.row_number().over(by)).where(F.col("n") <= o.k + 1)
        members = ws.put(few.withColumn("class", F.min("vec_id").over(Window.partitionBy("v"))).select("class", "vec_id", "n", "v"), "members")
        classes = members.where("n = 1").select("class", "v", F.size("v").alias("dim"))
        asked = rows.where("is_query").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q_v")).distinct()
        asked = ws.put(asked.join(classes, F.col("q_v") == F.col("v")).select("query_id", F.col("class").alias("q_class")), "asked")
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        stats = {r.dim: (max(1, -(-r.n // o.shard)), r.sq) for r in classes.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("sq")).collect()}
        if not stats:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
        sizes = F.create_map(*[x for d, (n, _) in stats.items() for x in (F.lit(d), F.lit(n))])
        shard = F.pmod(F.xxhash64("class"), sizes[F.col("dim")]).cast("int")

        def build(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            p = p.sort_values("class")
            x = np.stack(p["v"].to_numpy()).astype(np.float64)
            extra = np.sqrt(np.maximum(0, stats[int(key[0])][1] - (x * x).sum(1)))
            g = Graph.build(np.column_stack([x, extra]), o)
            return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "start": [g.start], "ids": [p["class"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "edges": [g.edges.tobytes()]})

        shards = classes.withColumn("shard", shard).groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, start int, ids binary, x binary, edges binary")
        shards = ws.put(shards, "shards")

        # the distinct query vectors in blocks of about query_block, each for every shard
        wanted = classes.join(asked.select("q_class").distinct(), F.col("class") == F.col("q_class"), "left_semi")
        n_queries = wanted.count()
        block = F.pmod(F.xxhash64("class", F.lit(1)), F.lit(max(1, -(-n_queries // o.query_block))))
        blocks = wanted.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("class", "v")).alias("q"))
        parts = max(1, -(-n_queries // (o.query_block * o.blocks)))
        part = F.pmod(F.col("block"), F.lit(parts)).cast("int").alias("part")
        blocks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), sizes[F.col("dim")] - 1)))
        queries = blocks.select("dim", "shard", part, F.col("block").cast("int").alias("block"), F.lit(None).cast(shards.schema["start"].dataType).alias("start"), *(F.lit(None).cast("binary").alias(c) for c in ("ids", "x", "edges")), "q")
        held = shards.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(-1).alias("block"), "start", "ids", "x", "edges", F.lit(None).cast(blocks.schema["q"].dataType).alias("q"))
        # the shard sorts before its query blocks
        work = held.unionAll(queries).repartition("dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", "block")

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = ids = x = None
            for b in batches:
                for r in b.to_pylist():
                    if r["block"] < 0:
                        ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["x"]).reshape(-1, r["dim"])
                        extra = np.sqrt(np.maximum(0, stats[r["dim"]][1] - (x * x).sum(1)))
                        g = Graph(np.column_stack([x, extra]), o, np.frombuffer(r["edges"], np.int32).reshape(len(ids), o.slack), r["start"])
                        continue
                    q_ids, q = np.array([t["class"] for t in r["q"]], np.int64), np.array([t["v"] for t in r["q"]])
                    for s in range(0, len(q), 256):
                        part = q[s : s + 256]
                        found, _ = g.search(np.column_stack([part, np.zeros(len(part))]), max(o.search_beam, o.k + 1))
                        ok = found >= 0
                        score = np.where(ok, np.einsum("qd,qcd->qc", part, x[np.maximum(found, 0)]), -np.inf)
                        order = np.lexsort((np.where(ok, ids[np.maximum(found, 0)], np.iinfo(np.int64).max), -score))[:, : o.k + 1]
                        rr = np.repeat(np.arange(len(part)), order.shape[1])
                        cc = order.ravel()
                        keep = ok[rr, cc]
                        rr, cc = rr[keep], cc[keep]
                        yield pa.RecordBatch.from_arrays([pa.array(q_ids[s : s + 256][rr]), pa.array(ids[found[rr, cc]]), pa.array(score[rr, cc])], names=["q_class", "c_class", "score"])

        found = work.select("dim", "block", "start", "ids", "x", "edges", "q").mapInArrow(answer, "q_class bigint, c_class bigint, score double")
        found = ws.put(found, "found")
        ws.drop(shards)
    best = Window.partitionBy("q_class").orderBy(F.col("score").desc(), F.col("c_class"))
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= o.k + 1).drop("n")
    one = Window.partitionBy("q_class").orderBy(F.col("score").desc(), F.col("vec_id"))
    ids = top.join(members.select(F.col("class").alias("m_class"), "vec_id"), F.col("c_class") == F.col("m_class"))
    ids = ids.withColumn("n", F.row_number().over(one)).where(F.col("n") <= o.k + 1).select(F.col("q_class").alias("f_class"), "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    out = asked.join(ids, F.col("q_class") == F.col("f_class")).where(F.col("vec_id") != F.col("query_id")).withColumn("rank", rank)
    return out.where(F.col("rank") <= o.k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
