"""The engine's operators as queries over the test tables, each beside SQL that gives the same rows.

``embeddings`` is a 2-D array (vec_id, element); tables with a dense key are 1-D arrays of records.
Queries on tables read them whole; selections are made on the table's shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .array import ArrayFrame, VectorRows, from_records
from .functions import nested, scale_offset, text, transform
from .functions import records as records_
from .functions.convert import saturating, saturating_array
from .operators import chunks, mutation, namespace, selections, virtual
from .plans.selection import Combined, Everything, Hyperslab, Nothing, Points, Selection, Slices, Span, coordinates, from_index
from .shape import Shape
from .sources import binary, codecs
from .sources.scratch import scratch
from .sources.store import DatasetOptions, Store
from .streaming import growth

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The 2-D array in SQL.
E = "(SELECT vec_id AS d0, (i - 1)::BIGINT AS d1, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> VectorRows:
    df = table(spark, sf_dir, "embeddings")
    return VectorRows(df, "vec_id", "embedding", Shape((df.count(), 64)))


def matrix(spark: SparkSession, sf_dir: str) -> ArrayFrame:
    return vectors(spark, sf_dir).array()


def records(spark: SparkSession, sf_dir: str, name: str, key: str) -> ArrayFrame:
    df = table(spark, sf_dir, name)
    return from_records(df, key, df.count())


def sets(spark: SparkSession, sf_dir: str) -> tuple[Shape, Selection, Selection]:
    """The shape of the 2-D array, and the left and right sets of the set algebra queries: every third column, and all whole blocks of 2 x 3."""
    shape = vectors(spark, sf_dir).shape
    n, m = shape.dims
    return shape, Slices((0, None), (0, None, 3)), Hyperslab((1, 3, n // 3, 2), (0, 4, (m + 1) // 4, 3))


ROWS_SQL = "(SELECT a AS d0, b AS d1 FROM range((SELECT count(*) FROM embeddings)) x(a), range(0, 64, 3) y(b))"
BLOCKS_SQL = "(SELECT a AS d0, b AS d1 FROM range((SELECT count(*) FROM embeddings)) x(a), range(64) y(b) WHERE a >= 1 AND (a - 1) % 3 < 2 AND (a - 1) // 3 < (SELECT count(*) FROM embeddings) // 3 AND b % 4 < 3)"


# scans


@query("src_05_scan_coords", f"SELECT d0, d1, value FROM {E}")
def scan_coords(spark, sf_dir):
    return matrix(spark, sf_dir).read()


@query("src_06_raw_bytes", "SELECT o_orderkey AS d0, array_to_string([substr(lpad(lower(to_hex(o_orderkey)), 16, '0'), 17 - 2 * i, 2) for i in range(1, 9)], '') AS raw FROM orders")
def raw_bytes(spark, sf_dir):
    """Little-endian bytes of a bigint array, as hex."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"))
    return a.select("d0", F.lower(F.array_join(F.reverse(F.split(F.regexp_replace(F.lpad(F.hex("d0"), 16, "0"), "(..)(?!$)", "$1,"), ",")), "")).alias("raw"))


@query("src_08_scalar", f"SELECT d0, d1, value FROM {E} WHERE d0 = 123 AND d1 = 45")
def scalar(spark, sf_dir):
    return vectors(spark, sf_dir).read(Slices((123, 124), (45, 46)))


@query("src_09_row_vectors", "SELECT vec_id AS d0, 64::BIGINT AS n, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last FROM embeddings")
def row_vectors(spark, sf_dir):
    v = matrix(spark, sf_dir).vectors()
    return v.select("d0", F.size("values").cast("bigint").alias("n"), F.element_at("values", 1).alias("first"), F.element_at("values", -1).alias("last"))


@query("src_10_strings", "SELECT c_custkey AS d0, rtrim(c_mktsegment) AS value FROM customer")
def strings(spark, sf_dir):
    """Fixed-length, space-padded strings, written and read again."""
    a = records(spark, sf_dir, "customer", "c_custkey")
    return a.df.select("d0", text.fixed(text.padded(F.col("c_mktsegment"), 16, text.SPACE_PADDED), text.SPACE_PADDED).alias("value"))


@query("src_13_chunked_round_trip", f"SELECT d0, d1, value FROM {E}")
def chunked(spark, sf_dir):
    """Into chunk form and back."""
    a = ArrayFrame(matrix(spark, sf_dir).df, matrix(spark, sf_dir).shape, chunk=(100, 16))
    return chunks.from_chunks(chunks.to_chunks(a), a).elements()


def _container(name: str, **how) -> None:
    """An array written as container files by tasks and read again."""

    @query(name, "SELECT o_orderkey AS d0, o_totalprice AS value FROM orders")
    def run(spark, sf_dir):
        return binary.from_containers(binary.to_containers(prices(spark, sf_dir).df, 5000, **how))


PACKED = (codecs.Filter("shuffle"), codecs.Filter("deflate", {"level": 1}), codecs.Filter("fletcher32"))
_container("src_14_btree_v1", chunk=512, filters=PACKED, old=True)
_container("src_15_single_chunk", chunk=5000, filters=PACKED)
_container("src_17_fixed_array", chunk=512, filters=PACKED)
_container("src_18_extensible_array", chunk=64, growable=1, filters=PACKED)
_container("src_19_btree_v2", chunk=512, growable=2, filters=PACKED)



@query("src_01_container_tree", "SELECT f AS file, '/data' AS path, 'hard' AS link, 'dataset' AS kind, '[' || least(5000, (SELECT count(*) FROM orders) - 5000 * f) || ']' AS shape, 'double' AS type, 'fixed array' AS layout, 'shuffle,deflate,fletcher32' AS filters FROM range(((SELECT count(*) FROM orders) + 4999) // 5000) t(f)")
def container_tree(spark, sf_dir):
    """What is in each container file."""
    return binary.trees(binary.to_containers(prices(spark, sf_dir).df, 5000, chunk=500, filters=PACKED))


@query("src_03_growth_append", "SELECT event_id AS d0, ts, value FROM events")
def growth_append(spark, sf_dir):
    """A growing array written as a stream of appended files, exactly once, and read again."""
    root = scratch(spark, "growth")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"), "ts", "value")
    e.repartitionByRange(4, "d0").write.parquet(f"{root}/in")
    stream = growth.read_growth(spark, f"{root}/in", e.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    growth.append(stream, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{root}/out")


@query("src_03b_growth_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def growth_windows(spark, sf_dir):
    """The windows of the stream operator, over what has arrived."""
    w = growth.windowed(table(spark, sf_dir, "events"), "ts", "value", "1 hour", "1 hour", by="event_type")
    return w.select("start", "event_type", "n")


SPARSE = "value > 0.2"


@query("src_20_sparse_fill", f"SELECT d0, d1, CASE WHEN {SPARSE} THEN value ELSE -7 END AS value FROM {E}")
def sparse_fill(spark, sf_dir):
    """Absent elements read as the fill value."""
    from .array import filled

    a = matrix(spark, sf_dir)
    return filled(ArrayFrame(a.df.where(SPARSE), a.shape, fill=-7.0)).elements()


@query("src_21_external_pieces", "SELECT o_orderkey AS d0, o_totalprice AS value FROM orders")
def external_pieces(spark, sf_dir):
    """One array over several stored pieces, in order."""
    o = table(spark, sf_dir, "orders")
    n = o.count()
    pieces = [(0, n // 3), (n // 3, n // 2), (n // 2, n)]
    parts = [o.where(F.col("o_orderkey").between(a, b - 1)).select((F.col("o_orderkey") - a).alias("at"), "o_totalprice", F.lit(a).cast("bigint").alias("base")) for a, b in pieces]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select((F.col("base") + F.col("at")).alias("d0"), F.col("o_totalprice").alias("value"))


@query("src_25_chunk_catalog", f"SELECT d0 // 100 AS c0, d1 // 16 AS c1, count(*) AS n, min(d0 * 64 + d1) AS first, max(d0 * 64 + d1) AS last FROM {E} WHERE {SPARSE} GROUP BY ALL")
def chunk_catalog(spark, sf_dir):
    a = matrix(spark, sf_dir)
    return chunks.catalogue(ArrayFrame(a.df.where(SPARSE), a.shape, chunk=(100, 16)))


@query("src_26_space_status", f"SELECT count(*) AS n_chunks, ((SELECT count(*) FROM embeddings) + 9) // 10 * 8 AS expected, CASE WHEN count(*) = 0 THEN 'not allocated' WHEN count(*) < ((SELECT count(*) FROM embeddings) + 9) // 10 * 8 THEN 'part allocated' ELSE 'allocated' END AS status FROM (SELECT DISTINCT d0 // 10, d1 // 8 FROM {E} WHERE value > 0.45)")
def space_status(spark, sf_dir):
    a = matrix(spark, sf_dir)
    return chunks.space_status(ArrayFrame(a.df.where("value > 0.45"), a.shape, chunk=(10, 8)))


@query("src_27_metadata", "SELECT 'embeddings' AS name, 2::BIGINT AS rank, (SELECT count(*) FROM embeddings) AS dim0, (SELECT max(len(embedding)) FROM embeddings)::BIGINT AS dim1, (SELECT sum(len(embedding)) FROM embeddings)::BIGINT AS size")
def metadata(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return spark.range(1).select(F.lit("embeddings").alias("name"), *[F.lit(x).cast("bigint").alias(n) for n, x in (("rank", v.shape.rank), ("dim0", v.shape.dims[0]), ("dim1", v.shape.dims[1]), ("size", v.shape.size))])


# selections


@query("sel_01_none", f"SELECT d0, d1, value FROM {E} WHERE false")
def sel_none(spark, sf_dir):
    return matrix(spark, sf_dir).read(Nothing())


@query("sel_02_all", f"SELECT d0, d1, value FROM {E}")
def sel_all(spark, sf_dir):
    return matrix(spark, sf_dir).read(Everything())


POINTS = ((7, 3), (0, 0), (499, 63), (12, 40))
TWICE = ((7, 3), (0, 0), (7, 3), (12, 40), (0, 0))


def points_sql(p) -> str:
    rows = ", ".join(f"({k}, {a}, {b})" for k, (a, b) in enumerate(p))
    return f"SELECT p.pos::BIGINT AS pos, e.d0, e.d1, e.value FROM (VALUES {rows}) p(pos, a, b) JOIN {E} e ON e.d0 = p.a AND e.d1 = p.b"


@query("sel_03_points", points_sql(POINTS))
def sel_points(spark, sf_dir):
    return matrix(spark, sf_dir).read(Points(POINTS))


@query("sel_03b_points_dup", points_sql(TWICE))
def sel_points_twice(spark, sf_dir):
    return matrix(spark, sf_dir).read(Points(TWICE))


@query("sel_04_hyperslab", f"SELECT d0, d1, value FROM {E} WHERE d0 >= 2 AND d0 <= 43 AND (d0 - 2) % 10 < 2 AND d1 >= 1 AND d1 <= 18 AND (d1 - 1) % 8 < 2")
def sel_hyperslab(spark, sf_dir):
    return vectors(spark, sf_dir).read(Hyperslab((2, 10, 5, 2), (1, 8, 3, 2)))


@query("sel_04b_overlapping_hyperslab", f"WITH k AS (SELECT i AS k, 5 + i // 4 * 2 + i % 4 AS a FROM range(12) t(i)), c AS (SELECT i AS j, 60 + i AS b FROM range(2) t(i)) SELECT (k * 2 + j)::BIGINT AS pos, e.d0, e.d1, e.value FROM k, c, {E} e WHERE e.d0 = k.a AND e.d1 = c.b")
def sel_overlapping(spark, sf_dir):
    return matrix(spark, sf_dir).read(Hyperslab((5, 2, 3, 4), (60, 2, 1, 2)))


@query("sel_05_slice", f"SELECT d0, d1, value FROM {E} WHERE d0 >= 100 AND d0 < 140 AND d1 >= 8 AND d1 < 24")
def sel_slice(spark, sf_dir):
    return vectors(spark, sf_dir).read(Slices((100, 140), (8, 24)))


@query("sel_05b_stepped", f"SELECT d0, d1, value FROM {E} WHERE d0 >= 3 AND d0 < 300 AND (d0 - 3) % 7 = 0 AND d1 >= 1 AND (d1 - 1) % 5 = 0")
def sel_stepped(spark, sf_dir):
    return vectors(spark, sf_dir).read(Slices((3, 300, 7), (1, None, 5)))


@query("sel_06_open_ranges", f"SELECT d0, d1, value FROM {E} WHERE d0 >= 450 AND d1 < 3")
def sel_open(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.read(from_index((slice(450, None), slice(None, 3)), v.shape))


@query("sel_07_records", "SELECT o_orderkey AS d0, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1100 AND (o_orderkey - 100) % 3 = 0")
def sel_records(spark, sf_dir):
    return records(spark, sf_dir, "orders", "o_orderkey").read(Slices((100, 1100, 3))).select("d0", "o_totalprice", "o_orderstatus")


@query("sel_08_cell", f"SELECT d0, d1, value FROM {E} WHERE d0 = 17 AND d1 = 63")
def sel_cell(spark, sf_dir):
    return matrix(spark, sf_dir).cell(17, 63)


@query("sel_09_output_shape", "SELECT s.* FROM (SELECT max(vec_id) + 1 AS n, max(len(embedding)) AS m FROM embeddings), LATERAL (VALUES ('none', 0, 0), ('slices', ((n + 3) // 7)::INT, ((m + 3) // 5)::INT), ('hyperslab', 10, 6), ('points', 4, NULL)) s(selection, n0, n1)")
def sel_output_shape(spark, sf_dir):
    shape = vectors(spark, sf_dir).shape
    rows = []
    for s in (Nothing(), Slices((3, None, 7), (1, None, 5)), Hyperslab((2, 10, 5, 2), (1, 8, 3, 2)), Points(POINTS)):
        n = s.output_shape(shape)
        rows.append((s.kind, n[0], n[1] if len(n) > 1 else (0 if s.kind == "none" else None)))
    return spark.createDataFrame(rows, "selection string, n0 int, n1 int")


@query("sel_10_count", f"SELECT count(*) AS n FROM {BLOCKS_SQL}")
def sel_count(spark, sf_dir):
    shape, _, blocks = sets(spark, sf_dir)
    return selections.count(spark, blocks, shape)


@query("sel_12_bounds", f"SELECT min(d0) AS lo0, max(d0) AS hi0, min(d1) AS lo1, max(d1) AS hi1 FROM {E} WHERE value > 0.4")
def sel_bounds(spark, sf_dir):
    return selections.bounds(matrix(spark, sf_dir).df.where("value > 0.4"), 2)


@query("sel_13_linear_bounds", f"SELECT min(d0 * 64 + d1) AS first, max(d0 * 64 + d1) AS last, count(*) AS n, max(d0 * 64 + d1) - min(d0 * 64 + d1) + 1 = count(*) AS contiguous FROM {E} WHERE d0 >= 5 AND d0 < 9")
def sel_linear_bounds(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return selections.linear_bounds(v.read(Slices((5, 9), (0, None))), v.shape)


@query("sel_15_blocks", "SELECT a * 3 + 1 AS lo0, a * 3 + 2 AS hi0, b * 4 AS lo1, b * 4 + 2 AS hi1 FROM range((SELECT count(*) FROM embeddings) // 3) x(a), range(16) y(b)")
def sel_blocks(spark, sf_dir):
    shape, _, blocks = sets(spark, sf_dir)
    return spark.createDataFrame([(lo[0], hi[0], lo[1], hi[1]) for lo, hi in blocks.blocks(shape)], "lo0 bigint, hi0 bigint, lo1 bigint, hi1 bigint")


@query("sel_17_iterate", f"SELECT row_number() OVER (ORDER BY d0, d1) - 1 AS pos, d0, d1 FROM {BLOCKS_SQL}")
def sel_iterate(spark, sf_dir):
    shape, _, blocks = sets(spark, sf_dir)
    return coordinates(spark, blocks, shape)


def _set_query(name: str, op: str, sql: str) -> None:
    @query(name, f"SELECT d0, d1 FROM ({sql})")
    def run(spark, sf_dir):
        shape, rows, blocks = sets(spark, sf_dir)
        return coordinates(spark, Combined(op, rows, blocks), shape).select("d0", "d1")


_set_query("sel_18_union", "or", f"SELECT * FROM {ROWS_SQL} UNION SELECT * FROM {BLOCKS_SQL}")
_set_query("sel_19_intersect", "and", f"SELECT * FROM {ROWS_SQL} INTERSECT SELECT * FROM {BLOCKS_SQL}")
_set_query("sel_20_xor", "xor", f"(SELECT * FROM {ROWS_SQL} EXCEPT SELECT * FROM {BLOCKS_SQL}) UNION (SELECT * FROM {BLOCKS_SQL} EXCEPT SELECT * FROM {ROWS_SQL})")
_set_query("sel_21_difference", "and_not", f"SELECT * FROM {ROWS_SQL} EXCEPT SELECT * FROM {BLOCKS_SQL}")


@query("sel_18b_union_read", f"SELECT d0, d1, value FROM {E} WHERE (d0 >= 10 AND d0 < 50 AND d1 < 4) OR (d0 >= 40 AND d0 < 60 AND d1 % 8 = 0)")
def sel_union_read(spark, sf_dir):
    """A union of selections read from the data: one predicate, no set is built."""
    return matrix(spark, sf_dir).read(Slices((10, 50), (0, 4)) | Slices((40, 60), (0, None, 8)))


@query("sel_23_project", f"SELECT DISTINCT d1 AS d0 FROM {E} WHERE value > 0.43")
def sel_project(spark, sf_dir):
    return selections.project(matrix(spark, sf_dir).df.where("value > 0.43"), 2, [1])


@query("sel_24_project_intersection", f"SELECT DISTINCT d0 FROM (SELECT d0, d1 FROM {E} WHERE value > 0.1 INTERSECT SELECT d0, d1 FROM {E} WHERE d1 >= 30 AND d1 < 40 AND d0 % 3 = 0)")
def sel_project_intersection(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return selections.project_intersection(matrix(spark, sf_dir).df.where("value > 0.1"), v.read(Slices((0, None, 3), (30, 40))), 2, [0])


@query("sel_25_intersects_block", f"SELECT count(*) > 0 AS hit FROM {E} WHERE value > 0.3 AND d0 BETWEEN 200 AND 260 AND d1 BETWEEN 5 AND 30")
def sel_intersects(spark, sf_dir):
    return selections.intersects_block(matrix(spark, sf_dir).df.where("value > 0.3"), (200, 5), (260, 30))


@query("sel_26_shift", f"SELECT d0 + 4 AS d0, d1 - 0 AS d1 FROM {BLOCKS_SQL}")
def sel_shift(spark, sf_dir):
    shape, _, blocks = sets(spark, sf_dir)
    return selections.shift(coordinates(spark, blocks, shape), blocks, (4, 0)).select("d0", "d1")


@query("sel_27_clip_merge", f"SELECT d0, d1 FROM (SELECT * FROM {ROWS_SQL} UNION SELECT * FROM {BLOCKS_SQL}) WHERE d0 BETWEEN 1 AND 300 AND d1 BETWEEN 2 AND 60")
def sel_clip(spark, sf_dir):
    shape, rows, blocks = sets(spark, sf_dir)
    both = selections.merge(coordinates(spark, rows, shape).drop("pos"), coordinates(spark, blocks, shape).drop("pos"))
    return selections.clip(both, (1, 2), (300, 60))


@query("sel_28_non_unlimited", f"SELECT count(DISTINCT d1) AS n FROM {E} WHERE value > 0.43")
def sel_non_unlimited(spark, sf_dir):
    a = matrix(spark, sf_dir)
    return selections.count_bounded_axes(a.df.where("value > 0.43"), Shape(a.shape.dims, (None, 64)))


@query("sel_29_fill", f"SELECT d0, d1, CASE WHEN d0 >= 10 AND d0 < 20 AND d1 % 2 = 0 THEN 9.5 ELSE value END AS value FROM {E}")
def sel_fill(spark, sf_dir):
    return mutation.fill_selection(matrix(spark, sf_dir), Slices((10, 20), (0, None, 2)), 9.5).elements()


@query("sel_31_encode", "SELECT d0, d1 FROM " + BLOCKS_SQL)
def sel_encode(spark, sf_dir):
    shape, _, blocks = sets(spark, sf_dir)
    return coordinates(spark, Selection.decode(blocks.encode()), shape).select("d0", "d1")


# virtual arrays


def prices(spark, sf_dir) -> ArrayFrame:
    o = table(spark, sf_dir, "orders")
    return ArrayFrame(o.select(F.col("o_orderkey").alias("d0"), F.col("o_totalprice").alias("value")), Shape((o.count(),)))


@query("vds_02_overlap", "SELECT a.o_orderkey AS d0, coalesce(b.o_totalprice, a.o_totalprice) AS value FROM orders a LEFT JOIN orders b ON a.o_orderkey BETWEEN 200 AND 499 AND b.o_orderkey = a.o_orderkey + 700")
def vds_overlap(spark, sf_dir):
    p = prices(spark, sf_dir)
    m = (virtual.Mapping(p, Everything(), Everything()), virtual.Mapping(p, Slices((900, 1200)), Slices((200, 500))))
    return virtual.VirtualArray(p.shape, m, -1.0).read().elements()


@query("vds_02b_fill_gap", f"SELECT a AS d0, b AS d1, coalesce(e.value, -7) AS value FROM range(4) x(a), range(6) y(b) LEFT JOIN {E} e ON a BETWEEN 1 AND 2 AND b BETWEEN 2 AND 4 AND e.d0 = a + 99 AND e.d1 = b + 8")
def vds_fill_gap(spark, sf_dir):
    m = virtual.Mapping(matrix(spark, sf_dir), Slices((100, 102), (10, 13)), Slices((1, 3), (2, 5)))
    return virtual.VirtualArray(Shape((4, 6)), (m,), -7.0).read().elements()


@query("vds_03_affine_remap", "SELECT (o_orderkey - 10) // 20 * 30 + (o_orderkey - 10) % 20 + 5 AS d0, o_totalprice AS value FROM orders WHERE o_orderkey BETWEEN 10 AND 1009 AND (o_orderkey - 10) % 20 < 8")
def vds_affine(spark, sf_dir):
    m = virtual.Mapping(prices(spark, sf_dir), Hyperslab((10, 20, 50, 8)), Hyperslab((5, 30, 50, 8)))
    return virtual.VirtualArray(Shape((1600,)), (m,), 0.0).elements()


PAIRS = (((21, 1), (0, 3)), ((5, 60), (1, 1)), ((5, 60), (3, 0)))


@query("vds_03b_point_pairing", f"SELECT a AS d0, b AS d1, coalesce(e.value, -2) AS value FROM range(4) x(a), range(4) y(b) LEFT JOIN (VALUES (21, 1, 0, 3), (5, 60, 1, 1), (5, 60, 3, 0)) p(s0, s1, t0, t1) ON p.t0 = a AND p.t1 = b LEFT JOIN {E} e ON e.d0 = p.s0 AND e.d1 = p.s1")
def vds_pairing(spark, sf_dir):
    return virtual.VirtualArray(Shape((4, 4)), (virtual.points(matrix(spark, sf_dir), PAIRS),), -2.0).read().elements()


@query("vds_05_unlimited", "SELECT (o_orderkey - 3) // 100 * 10 + (o_orderkey - 3) % 100 AS d0, o_totalprice AS value FROM orders WHERE o_orderkey >= 3 AND (o_orderkey - 3) % 100 < 10")
def vds_unlimited(spark, sf_dir):
    """Blocks without end: as many as the source has."""
    p = prices(spark, sf_dir)
    src = Hyperslab(Span(3, 100, None, 10))
    n = src.bounded(p.shape).spans[0].count
    m = virtual.Mapping(p, src, Hyperslab(Span(0, 10, n, 10)))
    return virtual.VirtualArray(Shape((n * 10,)), (m,), 0.0).elements()


@query("vds_06_irregular", f"SELECT a AS d0, b AS d1, coalesce(e.value, -2) AS value FROM range(4) x(a), range(4) y(b) LEFT JOIN {E} e ON e.d0 = a AND e.d1 = b AND ((a = 0 AND b IN (1, 2)) OR (a = 2 AND b IN (0, 1)))")
def vds_irregular(spark, sf_dir):
    blocks = [((0, 1), (0, 2)), ((2, 0), (2, 1))]
    return virtual.VirtualArray(Shape((4, 4)), tuple(virtual.irregular(matrix(spark, sf_dir), blocks, blocks)), -2.0).read().elements()


def _extent(view: str, f: str):
    @query(f"vds_07{'' if view == 'last_available' else 'b'}_{view}", f"SELECT {f}(n)::BIGINT AS extent FROM (SELECT count(*) AS n FROM orders UNION ALL SELECT count(*) FROM customer UNION ALL SELECT count(*) FROM part)")
    def run(spark, sf_dir):
        lengths = [table(spark, sf_dir, t).count() for t in ("orders", "customer", "part")]
        return spark.range(1).select(F.lit(virtual.extent(lengths, view)).cast("bigint").alias("extent"))


_extent("last_available", "max")
_extent("first_missing", "min")


@query("vds_09_missing_filled", "SELECT i AS d0, CASE WHEN i < 50 THEN o_totalprice ELSE -1 END AS value FROM range(100) t(i) JOIN orders ON o_orderkey = i")
def vds_missing(spark, sf_dir):
    """A mapping whose source is not there leaves the fill value."""
    m = (virtual.Mapping(prices(spark, sf_dir), Slices((0, 50)), Slices((0, 50))), virtual.Mapping(None, Slices((0, 50)), Slices((50, 100))))
    return virtual.VirtualArray(Shape((100,)), m, -1.0, missing="fill").read().elements()


@query("vds_10_block_files", "SELECT i AS d0, CASE WHEN i // 50 IN (0, 3) THEN o_totalprice ELSE -1 END AS value FROM range(200) t(i) LEFT JOIN orders ON o_orderkey = i % 50 + 100 * (i // 50)")
def vds_block_files(spark, sf_dir):
    """Numbered sources found by name; blocks 1 and 2 are missing."""
    p = prices(spark, sf_dir)
    names = ["f-0.part", "f-3.part", "f-x.part", "f-03.part"]
    found = [(b, ArrayFrame(p.df.where(F.col("d0").between(100 * b, 100 * b + 49)).select((F.col("d0") - 100 * b).alias("d0"), "value"), Shape((50,)))) for b, _ in virtual.expand_name("f-%b.part", names)]
    m = virtual.block_mappings(found, Everything(), Hyperslab(Span(0, 50, None, 50)))
    return virtual.VirtualArray(Shape((200,)), tuple(m), -1.0).read().elements()


@query("vds_13_convert", "SELECT o_orderkey AS d0, least(greatest(trunc(o_totalprice), -32768), 32767)::SMALLINT AS value FROM orders")
def vds_convert(spark, sf_dir):
    p = prices(spark, sf_dir)
    m = virtual.Mapping(p, Everything(), Everything(), ("f64", "i16"))
    return virtual.VirtualArray(p.shape, (m,), 0).elements()


# projections


@query("prj_01_field", "SELECT o_orderkey AS d0, o_totalprice FROM orders")
def prj_field(spark, sf_dir):
    return records(spark, sf_dir, "orders", "o_orderkey").df.select("d0", "o_totalprice")


@query("prj_03_nested", "SELECT p_partkey AS d0, p_size AS size, p_retailprice AS price, p_brand[1] AS initial FROM part")
def prj_nested(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d0"), F.struct(F.struct(F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")).alias("inner"), F.split("p_brand", "").alias("letters")).alias("rec"))
    return p.select("d0", "rec.inner.size", "rec.inner.price", F.element_at("rec.letters", 1).alias("initial"))


@query("prj_02_raw_field", "SELECT p_partkey AS d0, lower(to_hex(p_size)) AS raw FROM part")
def prj_raw(spark, sf_dir):
    """A field as it is stored, after a strict check of its type."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("d0"), F.struct("p_size", "p_retailprice").alias("rec"))
    return p.select("d0", F.lower(F.hex(records_.read_field(p, "rec.p_size", "int"))).alias("raw"))


@query("prj_04_fields", "SELECT column_name AS name, (row_number() OVER () - 1)::BIGINT AS at FROM (DESCRIBE orders)")
def prj_fields(spark, sf_dir):
    return spark.createDataFrame([(f.name, i) for i, f in enumerate(table(spark, sf_dir, "orders").schema.fields)], "name string, at bigint")


# conversion and transforms


@query("cnv_02_int_clamp", "SELECT o_orderkey AS d0, least(greatest(o_custkey * 7 - 500, -128), 127)::TINYINT AS i8, least(greatest(o_custkey * 7 - 500, 0), 255)::SMALLINT AS u8, least(greatest(o_custkey * 100 - 500, -32768), 32767)::SMALLINT AS i16 FROM orders")
def cnv_int(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    x = F.col("o_custkey") * 7 - 500
    return o.select(F.col("o_orderkey").alias("d0"), saturating(x, "i64", "i8").alias("i8"), saturating(x, "i64", "u8").alias("u8"), saturating(F.col("o_custkey") * 100 - 500, "i64", "i16").alias("i16"))


@query("cnv_03_neg_to_unsigned", "SELECT o_orderkey AS d0, greatest(o_orderkey - 700, 0)::BIGINT AS u32, greatest(o_orderkey - 700, 0)::DECIMAL(20,0) AS u64 FROM orders")
def cnv_unsigned(spark, sf_dir):
    x = F.col("o_orderkey") - 700
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), saturating(x, "i64", "u32").alias("u32"), saturating(x, "i64", "u64").alias("u64"))


@query("cnv_04_int_to_float", "SELECT o_orderkey AS d0, (o_orderkey * 16777217)::DOUBLE AS f64, ((o_orderkey * 16777217)::DOUBLE)::FLOAT::DOUBLE AS f32 FROM orders")
def cnv_float(spark, sf_dir):
    x = F.col("o_orderkey") * 16777217
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), saturating(x, "i64", "f64").alias("f64"), saturating(x, "i64", "f32").cast("double").alias("f32"))


FLOAT_SQL = "CASE WHEN o_orderkey % 50 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 50 = 1 THEN 'Infinity'::DOUBLE WHEN o_orderkey % 50 = 2 THEN '-Infinity'::DOUBLE ELSE o_totalprice - 100000 END"


@query("cnv_06_float_to_int", f"SELECT o_orderkey AS d0, CASE WHEN isnan(x) THEN 0 ELSE least(greatest(trunc(x), -32768), 32767) END::SMALLINT AS i16, CASE WHEN isnan(x) THEN 0 ELSE least(greatest(trunc(x), 0), 255) END::SMALLINT AS u8 FROM (SELECT o_orderkey, {FLOAT_SQL} AS x FROM orders)")
def cnv_float_to_int(spark, sf_dir):
    k = F.col("o_orderkey") % 50
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, float("-inf")).otherwise(F.col("o_totalprice") - 100000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), saturating(x, "f64", "i16").alias("i16"), saturating(x, "f64", "u8").alias("u8"))


@query("cnv_10_array", "SELECT vec_id AS d0, (i - 1)::BIGINT AS d1, least(greatest(trunc(embedding[i]::DOUBLE * 1000), -128), 127)::TINYINT AS value FROM embeddings, range(1, 65) t(i)")
def cnv_array(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = saturating_array(F.transform("embedding", lambda x: x.cast("double") * 1000), "f64", "i8")
    return e.select(F.col("vec_id").alias("d0"), F.posexplode(a).alias("d1", "value")).select("d0", F.col("d1").cast("bigint").alias("d1"), "value")


@query("xfm_02_eval", "SELECT o_orderkey AS d0, (o_totalprice - 32.0) * 5.0 / 9.0 AS value FROM orders")
def xfm_eval(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), transform.apply("(x - 32) * 5 / 9", F.col("o_totalprice")).alias("value"))


@query("xfm_03_folded", "SELECT o_orderkey AS d0, -(o_totalprice) + 14.0 AS value FROM orders")
def xfm_folded(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), transform.apply("-x + (2 + 3 * 4)", F.col("o_totalprice")).alias("value"))


# strings, enumerations, bits, arrays, maps


@query("str_01_fixed", "SELECT c_custkey AS d0, c_name AS nul_padded, c_mktsegment AS space_padded, c_mktsegment || '   ' AS kept FROM customer")
def str_fixed(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("d0"), text.fixed(text.padded(F.col("c_name"), 32)).alias("nul_padded"), text.fixed(F.concat("c_mktsegment", F.lit(" \t ")), text.SPACE_PADDED).alias("space_padded"), text.fixed(F.concat("c_mktsegment", F.lit("   \0x")), text.NUL_PADDED).alias("kept"))


@query("str_02_vlen", "SELECT event_id AS d0, CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END AS value FROM events")
def str_variable(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("d0"), text.variable(F.when(F.col("event_id") % 7 != 0, F.concat("event_type", F.lit("\0\0")))).alias("value"))


@query("str_04_canonical_path", "SELECT page_id AS d0, '/' || page_id::VARCHAR || '/x' AS path, '/y' AS above FROM pages")
def str_path(spark, sf_dir):
    p = F.concat(F.lit("//"), F.col("page_id").cast("string"), F.lit("/./b//../x/"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("d0"), text.canonical_column(p).alias("path"), text.canonical_column(F.concat(p, F.lit("/../../../../y"))).alias("above"))


MEMBERS = {"F": 1, "O": 258, "P": 4095}


@query("enm_nameof", "SELECT o_orderkey AS d0, CASE o_orderkey % 5 WHEN 0 THEN 'F' WHEN 1 THEN 'O' WHEN 2 THEN 'P' END AS name FROM orders")
def enm_name(spark, sf_dir):
    v = F.element_at(F.array(*[F.lit(x) for x in (1, 258, 4095, 7, 0)]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), nested.enum_name(v, MEMBERS).alias("name"))


@query("enm_valueof", "SELECT o_orderkey AS d0, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 258 WHEN 'P' THEN 4095 END::BIGINT AS value FROM orders")
def enm_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), nested.enum_value(F.col("o_orderstatus"), MEMBERS).alias("value"))


@query("bit_mask", "SELECT o_orderkey AS d0, (o_orderkey >> 3) & 31 AS field, o_orderkey | 240 AS set_on, o_orderkey & ~240 AS set_off, CASE WHEN (o_orderkey & 31) >= 16 THEN (o_orderkey & 31) - 32 ELSE o_orderkey & 31 END AS signed FROM orders")
def bit_mask(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("d0"), nested.bit_field(k, 3, 5).alias("field"), nested.set_bits(k, 4, 4, True).alias("set_on"), nested.set_bits(k, 4, 4, False).alias("set_off"), nested.sign_extended(k, 5).alias("signed"))


@query("bit_find", "SELECT o_orderkey AS d0, coalesce((SELECT min(i) FROM range(8) t(i) WHERE (o_orderkey >> i) & 1 = 1), -1)::INT AS low, coalesce((SELECT max(i) FROM range(8) t(i) WHERE (o_orderkey >> i) & 1 = 1), -1)::INT AS high FROM orders")
def bit_find(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("d0"), nested.find_bit(k, 8, True).alias("low"), nested.find_bit(k, 8, True, from_low=False).alias("high"))


@query("bit_arithmetic", "SELECT o_orderkey AS d0, (o_orderkey & ~240) | (((((o_orderkey >> 4) & 15) + 1) & 15) << 4) AS incremented, (o_orderkey & ~240) | ((-((o_orderkey >> 4) & 15) & 15) << 4) AS negated, (o_orderkey & ~240) | (((((o_orderkey >> 4) & 15) << 2) & 15) << 4) AS shifted, (5 & ~12) | (((o_orderkey >> 6) & 3) << 2) AS copied FROM orders")
def bit_arithmetic(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("d0"), nested.bit_add(k, 1, 4, 4).alias("incremented"), nested.bit_negate(k, 4, 4).alias("negated"), nested.bit_shift(k, 2, 4, 4).alias("shifted"), nested.bit_copy(F.lit(5), 2, k, 6, 2).alias("copied")
    )


@query("arr_flatten", "SELECT vec_id AS d0, (i - 1)::BIGINT AS at, embedding[i]::DOUBLE AS value FROM embeddings, range(1, 65) t(i)")
def arr_flatten(spark, sf_dir):
    a = nested.flattened(nested.reshaped(F.col("embedding"), (4, 4, 4)), 3)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), F.posexplode(a).alias("at", "value")).select("d0", F.col("at").cast("bigint").alias("at"), F.col("value").cast("double").alias("value"))


@query("arr_dims", "SELECT vec_id AS d0, 2::BIGINT AS n0, 8::BIGINT AS n1, 4::BIGINT AS n2, embedding[1 + 32 + 3 * 4 + 2]::DOUBLE AS cell FROM embeddings")
def arr_dims(spark, sf_dir):
    a = nested.reshaped(F.col("embedding"), (2, 8, 4))
    n = nested.dims(a, 3)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("d0"), *[x.alias(f"n{i}") for i, x in enumerate(n)], a[1][3][2].cast("double").alias("cell"))


@query("vln_lengths", "SELECT c_custkey AS d0, count(o_orderkey) AS n, coalesce(sum(o_orderkey), 0)::BIGINT AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def vln_lengths(spark, sf_dir):
    """Variable-length sequences of different lengths, empty ones included."""
    seq = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.collect_list("o_orderkey").alias("seq"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("d0")).join(seq, F.col("d0") == F.col("k"), "left")
    return c.select("d0", nested.lengths(F.col("seq")).alias("n"), F.coalesce(F.aggregate("seq", F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0)).alias("total"))


def _maps(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in ("b", "a", "c")]), F.array("user_id", F.col("event_id"), F.lit(5).cast("bigint")))
    return e.select(F.col("event_id").alias("d0"), m.alias("m"))


@query("map_get", "SELECT event_id AS d0, user_id AS b, NULL::BIGINT AS missing, true AS has_a, 3::BIGINT AS n, event_id + 1 AS put, 2::BIGINT AS left_over FROM events")
def map_get(spark, sf_dir):
    m = F.col("m")
    put = nested.map_put(m, F.lit("a"), F.col("d0") + 1)
    return _maps(spark, sf_dir).select("d0", m["b"].alias("b"), F.try_element_at(m, F.lit("z")).alias("missing"), F.map_contains_key(m, "a").alias("has_a"), F.size(m).cast("bigint").alias("n"), put["a"].alias("put"), F.size(nested.map_delete(m, F.lit("c"))).cast("bigint").alias("left_over"))


@query("map_iterate", "SELECT event_id AS d0, k AS key, v AS value FROM (SELECT event_id, unnest(['b', 'c']) AS k, unnest([user_id, 5]) AS v FROM events)")
def map_iterate(spark, sf_dir):
    """Entries in key order, from the second on."""
    return _maps(spark, sf_dir).select("d0", F.inline(nested.map_entries_from(F.col("m"), 1)))


# codecs


@query("flt_07_scaleoffset_int", "WITH c AS (SELECT o_orderkey AS d0, o_orderkey // 100 AS c0, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey END AS value FROM orders), b AS (SELECT *, min(value) FILTER (value <> -1) OVER (PARTITION BY c0) AS base, max(value) FILTER (value <> -1) OVER (PARTITION BY c0) - min(value) FILTER (value <> -1) OVER (PARTITION BY c0) AS span FROM c) SELECT d0, base, CASE WHEN span = 0 THEN 1 ELSE length(bin(span + 1)) END::INT AS bits, CASE WHEN value = -1 THEN (1 << CASE WHEN span = 0 THEN 1 ELSE length(bin(span + 1)) END) - 1 ELSE value - base END::BIGINT AS packed, value AS unpacked FROM b")
def flt_scale_offset(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    a = o.select(k.alias("d0"), F.call_function("div", k, F.lit(100).cast("bigint")).alias("c0"), F.when(k % 11 == 0, F.lit(-1).cast("bigint")).otherwise(F.col("o_custkey")).alias("value"))
    packed = scale_offset.unpack_integers(scale_offset.pack_integers(a, ["c0"], fill=-1), fill=-1)
    return packed.select("d0", "base", "bits", "packed", "unpacked")


@query("flt_08_scaleoffset_float", "WITH c AS (SELECT o_orderkey AS d0, o_totalprice AS value, min(o_totalprice) OVER (PARTITION BY o_orderkey // 100) AS base FROM orders), p AS (SELECT d0, base, value, floor((value - base) * 100.0::DOUBLE + 0.5::DOUBLE)::BIGINT AS packed FROM c) SELECT d0, base, packed, packed / 100.0::DOUBLE + base AS unpacked FROM p")
def flt_scale_offset_float(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("d0"), F.call_function("div", F.col("o_orderkey"), F.lit(100).cast("bigint")).alias("c0"), F.col("o_totalprice").alias("value"))
    return scale_offset.unpack_floats(scale_offset.pack_floats(o, ["c0"], 2), 2).select("d0", "base", "packed", "unpacked")


def _byte_chunks(spark, sf_dir) -> DataFrame:
    """Chunks of 100 keys as bytes."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.call_function("div", F.col("o_orderkey"), F.lit(100).cast("bigint")).alias("c0"))
    raw = F.encode(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: F.lpad(x.cast("string"), 8, "0")), ""), "utf-8")
    return o.groupBy("c0").agg(raw.alias("bytes")).withColumn("size", F.length("bytes")).withColumn("mask", F.lit(0))


@query("flt_01_pipeline", "SELECT c0, sha256(string_agg(lpad(o_orderkey::VARCHAR, 8, '0'), '' ORDER BY o_orderkey)) AS sha FROM (SELECT o_orderkey // 100 AS c0, o_orderkey FROM orders) GROUP BY c0")
def flt_pipeline(spark, sf_dir):
    """Chunks through shuffle, deflate and checksum, and back."""
    p = codecs.Pipeline((codecs.Filter("shuffle", {"size": 8}), codecs.Filter("deflate", {"level": 4}), codecs.Filter("fletcher32")))
    out = codecs.decode_chunks(codecs.encode_chunks(_byte_chunks(spark, sf_dir), p), p)
    return out.select("c0", F.sha2("bytes", 256).alias("sha"))


@query("flt_03_shuffle", "SELECT c0, string_agg(hex(substr(s, b::INT, 1)), '' ORDER BY b, o_orderkey) AS shuffled FROM (SELECT o_orderkey // 100 AS c0, o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') AS s FROM orders), range(1, 9) t(b) GROUP BY c0")
def flt_shuffle(spark, sf_dir):
    return codecs.encode_chunks(_byte_chunks(spark, sf_dir), codecs.Pipeline((codecs.Filter("shuffle", {"size": 8}),))).select("c0", F.hex("bytes").alias("shuffled"))


@query(
    "flt_04_fletcher32",
    """WITH w AS (SELECT o_orderkey // 100 AS c0, (o_orderkey % 100) * 4 + b AS i, ascii(substr(s, (2 * b + 1)::INT, 1)) * 256 + ascii(substr(s, (2 * b + 2)::INT, 1)) AS v FROM (SELECT o_orderkey, lpad(o_orderkey::VARCHAR, 8, '0') AS s FROM orders), range(4) t(b)),
    c AS (SELECT c0, sum(v) % 65535 AS a, sum((n - i) * v) % 65535 AS b FROM (SELECT *, count(*) OVER (PARTITION BY c0) AS n FROM w) GROUP BY c0)
    SELECT c0, format('{:02X}{:02X}{:02X}{:02X}', (a % 256)::INT, (a // 256)::INT, (b % 256)::INT, (b // 256)::INT) AS checksum FROM c""",
)
def flt_checksum(spark, sf_dir):
    return codecs.encode_chunks(_byte_chunks(spark, sf_dir), codecs.Pipeline((codecs.Filter("fletcher32"),))).select("c0", F.expr("right(hex(bytes), 8)").alias("checksum"))


@query("flt_04b_verified", "SELECT o_orderkey // 100 AS c0, count(*) * 8 AS n FROM orders GROUP BY ALL")
def flt_verified(spark, sf_dir):
    """Checksums verified and taken off."""
    p = codecs.Pipeline((codecs.Filter("fletcher32"),))
    return codecs.decode_chunks(codecs.encode_chunks(_byte_chunks(spark, sf_dir), p), p).select("c0", F.length("bytes").cast("bigint").alias("n"))


@query("flt_05_lzf", "SELECT c0, sha256(string_agg(lpad(o_orderkey::VARCHAR, 8, '0'), '' ORDER BY o_orderkey)) AS sha, true AS smaller FROM (SELECT o_orderkey // 100 AS c0, o_orderkey FROM orders) GROUP BY c0")
def flt_lzf(spark, sf_dir):
    """Chunks packed to LZF tokens and unpacked again."""
    packed = codecs.encode_chunks(_byte_chunks(spark, sf_dir), codecs.Pipeline((codecs.Filter("lzf"),))).withColumn("smaller", F.length("bytes") < F.col("size"))
    sized = codecs._over_rows(packed, "bytes", lambda r: codecs.unlzf(r["bytes"], r["size"]), ["bytes", "size"])
    return sized.select("c0", F.sha2("bytes", 256).alias("sha"), "smaller")


@query("flt_06_nbit", "SELECT o_orderkey AS d0, o_custkey AS value, ((count(*) OVER (PARTITION BY o_orderkey // 100) * 37 + 7) // 8)::BIGINT AS packed FROM orders")
def flt_nbit(spark, sf_dir):
    """37 of the 64 bits of every number kept, and the numbers restored."""
    used = [codecs.Bits(8, 37)]

    def both(p):
        import numpy as np

        p = p.sort_values("o_orderkey")
        data = codecs.nbit_pack(p["o_custkey"].to_numpy("<i8").tobytes(), used)
        value = np.frombuffer(codecs.nbit_unpack(data, used, len(p)), "<i8")
        return p.assign(value=value, packed=len(data)).rename(columns={"o_orderkey": "d0"})[["d0", "value", "packed"]]

    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.groupBy(F.call_function("div", F.col("o_orderkey"), F.lit(100).cast("bigint"))).applyInPandas(both, "d0 bigint, value bigint, packed bigint")


# namespace


def tree(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions as groups under the root, nations as datasets under them, and attributes of both."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    root = r.select(F.lit(0).cast("bigint").alias("parent"), F.col("r_name").alias("name"), F.lit("hard").alias("kind"), (F.col("r_regionkey") + 1).cast("bigint").cast("string").alias("target"), F.lit(None).cast("string").alias("target_file"), (10 - F.col("r_regionkey")).cast("bigint").alias("creation_order"))
    leaf = n.select((F.col("n_regionkey") + 1).cast("bigint").alias("parent"), F.col("n_name").alias("name"), F.lit("hard").alias("kind"), (F.col("n_nationkey") + 100).cast("bigint").cast("string").alias("target"), F.lit(None).cast("string").alias("target_file"), F.col("n_nationkey").cast("bigint").alias("creation_order"))
    objects = r.select((F.col("r_regionkey") + 1).cast("bigint").alias("object"), F.lit("group").alias("kind")).unionAll(n.select((F.col("n_nationkey") + 100).cast("bigint"), F.lit("dataset"))).unionAll(spark.range(1).select("id", F.lit("group")))
    attrs = n.select((F.col("n_regionkey") + 1).cast("bigint").alias("owner"), F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("name"), (100 - F.col("n_nationkey")).cast("bigint").alias("creation_order"), F.lit("string").alias("dtype"), F.col("n_name").alias("value"))
    return root.unionAll(leaf), objects, attrs


@query("ns_01_resolve", "SELECT 'nation' AS what, n_nationkey + 100 AS object FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_nationkey = (SELECT min(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')")
def ns_resolve(spark, sf_dir):
    links, objects, attrs = tree(spark, sf_dir)
    asia = links.where("parent = 0 AND name = 'ASIA'").select(F.col("target").cast("bigint").alias("p"))
    first = links.join(asia, F.col("parent") == F.col("p")).orderBy("creation_order").first().name
    _, obj = namespace.Namespace(links, objects, attrs).resolve(f"/AFRICA/../ASIA/./{first}")
    return spark.range(1).select(F.lit("nation").alias("what"), F.lit(obj).cast("int").alias("object"))


@query("ns_03_members", "SELECT r_name AS name, 'hard' AS kind, (r_regionkey + 1)::VARCHAR AS target FROM region")
def ns_members(spark, sf_dir):
    return namespace.members(tree(spark, sf_dir)[0], 0)


@query("ns_04_creation_order", "SELECT row_number() OVER (ORDER BY r_regionkey DESC) - 1 AS at, r_name AS name FROM region")
def ns_creation(spark, sf_dir):
    return namespace.by_creation(tree(spark, sf_dir)[0], 0)


@query("ns_05_children", "SELECT n_name AS name, (n_nationkey + 100)::BIGINT AS object FROM nation WHERE n_regionkey = 2")
def ns_children(spark, sf_dir):
    links, objects, _ = tree(spark, sf_dir)
    return namespace.children(links, objects, 3, "dataset")


@query("ns_06_link_at", "SELECT n_name AS name, (n_nationkey + 100)::VARCHAR AS target FROM nation WHERE n_regionkey = 1 ORDER BY n_name LIMIT 1 OFFSET 2")
def ns_link_at(spark, sf_dir):
    return namespace.link_at(tree(spark, sf_dir)[0], 2, 2).select("name", "target")


@query("ns_08_exists", "SELECT count(*) > 0 AS found FROM region WHERE r_name = 'EUROPE'")
def ns_exists(spark, sf_dir):
    return namespace.exists(tree(spark, sf_dir)[0], 0, "EUROPE")


@query("ns_09_attrs", "SELECT row_number() OVER (ORDER BY n_nationkey DESC) - 1 AS at, 'a' || n_nationkey AS name, 'string' AS dtype, n_name AS value FROM nation WHERE n_regionkey = 3")
def ns_attrs(spark, sf_dir):
    return namespace.attributes(tree(spark, sf_dir)[2], 4, by="creation")


@query("ns_07_link_counts", "SELECT (r_regionkey + 1)::BIGINT AS object, 1::BIGINT AS n FROM region UNION ALL SELECT n_nationkey + 100, 1 FROM nation")
def ns_link_counts(spark, sf_dir):
    return namespace.link_counts(tree(spark, sf_dir)[0])


# sinks


@query("snk_13_index_choice", "SELECT s, CASE WHEN s <= 100 THEN 'single chunk' ELSE 'fixed array' END AS fixed, 'extensible array' AS one, 'b-tree v2' AS two FROM (SELECT c_custkey + 1 AS s FROM customer)")
def snk_index(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("s"))
    n, none = F.col("s"), F.lit(None).cast("bigint")
    return s.select("s", chunks.index_kind_column([n], [n], (100,)).alias("fixed"), chunks.index_kind_column([n], [none], (100,)).alias("one"), chunks.index_kind_column([n, n], [none, none], (100, 10)).alias("two"))


def _resizable(spark, sf_dir) -> ArrayFrame:
    a = matrix(spark, sf_dir)
    return ArrayFrame(a.df, Shape(a.shape.dims, (None, None)), chunk=(100, 16), fill=-5.0)


@query("snk_14_shrink", f"SELECT d0, d1, value FROM {E} WHERE d0 < 130 AND d1 < 20")
def snk_shrink(spark, sf_dir):
    return mutation.resize(_resizable(spark, sf_dir), (130, 20)).elements()


@query("snk_14b_grow_fill", f"SELECT a AS d0, b AS d1, coalesce(e.value, -5) AS value FROM range(140) x(a), range(24) y(b) LEFT JOIN {E} e ON e.d0 = a AND e.d1 = b AND a < 130 AND b < 20")
def snk_grow(spark, sf_dir):
    """Shrunk, then grown: what was cut off stays gone."""
    return mutation.grown(mutation.resize(_resizable(spark, sf_dir), (130, 20)), (140, 24)).elements()


@query("snk_15_write_chunk", f"SELECT d0, d1, CASE WHEN d0 BETWEEN 100 AND 199 AND d1 BETWEEN 16 AND 31 THEN (d0 * 1000 + d1)::DOUBLE ELSE value END AS value FROM {E}")
def snk_write_chunk(spark, sf_dir):
    new = coordinates(spark, Slices((100, 200), (16, 32)), vectors(spark, sf_dir).shape).select("d0", "d1", (F.col("d0") * 1000 + F.col("d1")).cast("double").alias("value"))
    return mutation.write_chunk(_resizable(spark, sf_dir), (100, 16), new).elements()


@query("snk_15b_write_chunks", f"SELECT d0, d1, CASE WHEN d0 BETWEEN 100 AND 199 AND d1 BETWEEN 16 AND 47 THEN 0.0 ELSE value END AS value FROM {E}")
def snk_write_chunks(spark, sf_dir):
    """Every chunk that the new elements touch is replaced."""
    new = coordinates(spark, Slices((100, 200), (16, 48)), vectors(spark, sf_dir).shape).select("d0", "d1", F.lit(0.0).alias("value"))
    return mutation.write_chunks(_resizable(spark, sf_dir), new).elements()


# stores: what is written is read again from the shared folder


def _store(spark, sf_dir) -> Store:
    s = Store(spark, scratch(spark, "store"), "x")
    s.create_group("/run")
    return s


@query("snk_04_store_write", f"SELECT d0, d1, value FROM {E}")
def snk_store_write(spark, sf_dir):
    s = _store(spark, sf_dir)
    s.write("/run/embeddings", matrix(spark, sf_dir), DatasetOptions(chunk=(100, 64)))
    return s.read("/run/embeddings").elements()


@query("snk_04b_store_select", f"SELECT d0, d1, value FROM {E} WHERE d0 >= 150 AND d0 < 350 AND (d0 - 150) % 2 = 0 AND d1 >= 10 AND d1 < 20")
def snk_store_select(spark, sf_dir):
    """A selection that lists only the chunk folders of its bounding box."""
    s = _store(spark, sf_dir)
    s.write("/run/embeddings", matrix(spark, sf_dir), DatasetOptions(chunk=(100, 64)))
    return s.select("/run/embeddings", Slices((150, 350, 2), (10, 20)))


@query("snk_05_fill_only", "SELECT o_orderkey AS d0, -5::BIGINT AS value FROM orders")
def snk_fill_only(spark, sf_dir):
    """A dataset without elements reads as its fill value."""
    from .array import filled

    s = _store(spark, sf_dir)
    empty = spark.createDataFrame([], "d0 bigint, value bigint")
    s.write("/run/empty", ArrayFrame(empty, prices(spark, sf_dir).shape, fill=-5))
    return filled(s.read("/run/empty")).elements()


@query("snk_06_sparse_chunks", f"SELECT d0, d1, CASE WHEN (d0 // 100) % 2 = 0 THEN value ELSE 0 END AS value FROM {E}")
def snk_sparse(spark, sf_dir):
    """Only every other chunk is stored."""
    from .array import filled

    s, a = _store(spark, sf_dir), matrix(spark, sf_dir)
    some = a.df.where(F.call_function("div", F.col("d0"), F.lit(100).cast("bigint")) % 2 == 0)
    s.write("/run/sparse", ArrayFrame(some, a.shape, fill=0.0), DatasetOptions(chunk=(100, 64)))
    return filled(s.read("/run/sparse")).elements()


@query("snk_14c_store_resize", f"SELECT d0, d1, value FROM {E} WHERE d0 < 130")
def snk_store_resize(spark, sf_dir):
    """Shrunk and grown again in storage: what was cut off is gone."""
    s, a = _store(spark, sf_dir), matrix(spark, sf_dir)
    s.write("/run/grow", a, DatasetOptions(chunk=(100, 64), max_dims=(None, 64)))
    s.resize("/run/grow", (130, 64))
    s.resize("/run/grow", a.shape.dims)
    return s.read("/run/grow").elements()


@query("snk_15c_store_overwrite", f"SELECT d0, d1, CASE WHEN d0 BETWEEN 120 AND 129 THEN 1.5 ELSE value END AS value FROM {E}")
def snk_store_overwrite(spark, sf_dir):
    """Elements are replaced by rewriting the chunk folders that hold them."""
    s, a = _store(spark, sf_dir), matrix(spark, sf_dir)
    s.write("/run/data", a, DatasetOptions(chunk=(100, 64)))
    s.write_elements("/run/data", a.df.where(F.col("d0").between(120, 129)).withColumn("value", F.lit(1.5)))
    return s.read("/run/data").elements()


@query("snk_16_attributes", "SELECT 'new' AS name, '[' || count(*) || ', 64]' AS value FROM embeddings UNION ALL SELECT n_name, n_nationkey::VARCHAR FROM nation WHERE n_nationkey > 0")
def snk_attributes(spark, sf_dir):
    """Attributes written together and one by one, renamed and deleted."""
    s = _store(spark, sf_dir)
    nations = {r.n_name: r.n_nationkey for r in table(spark, sf_dir, "nation").collect()}
    s.set_attrs("/run", nations)
    s.set_attr("/run", "old", list(vectors(spark, sf_dir).shape.dims))
    s.rename_attr("/run", "old", "new")
    s.delete_attr("/run", next(n for n, k in nations.items() if k == 0))
    return s.table("attrs").select("name", "value")


@query("snk_18_links", "SELECT n_name AS name, 'hard' AS kind FROM nation WHERE n_nationkey > 1 UNION ALL SELECT 'alias', 'soft' UNION ALL SELECT 'moved', 'hard'")
def snk_links(spark, sf_dir):
    """Links made together and one by one, moved and removed."""
    s = _store(spark, sf_dir)
    nations = [r.n_name for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    s.link_many([(f"/{n}", "/run") for n in nations])
    s.link_soft("/alias", "/run")
    s.move("/run", "/moved")
    for n in nations[:2]:
        s.unlink(f"/{n}")
    return s.namespace.list("/").select("name", "kind")


from . import stored_queries  # noqa: E402, F401  adds its queries
