"""Queries over container files that tasks write from the tables and read again: layouts, types, attributes, links, settings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .array import ArrayFrame
from .operators import virtual
from .plans.selection import Everything, Hyperslab, Slices, Span
from .queries import E, matrix, prices, query, table, vectors
from .shape import Shape
from .sources import binary, codecs
from .sources.container import Dataset
from .sources.container_writer import Enum
from .sources.scratch import scratch
from .sources.store import DatasetOptions, Store

PACKED = (codecs.Filter("shuffle"), codecs.Filter("deflate", {"level": 1}), codecs.Filter("fletcher32"))


def orders(spark, sf_dir, write, **how):
    """Containers of 500 orders each."""
    o = table(spark, sf_dir, "orders").withColumn("part", F.call_function("div", F.col("o_orderkey"), F.lit(500).cast("bigint")))
    return binary.build(o, "part", "o_orderkey", write, **how)


def customers(spark, sf_dir, write, **how):
    """Containers of 100 customers each."""
    c = table(spark, sf_dir, "customer").withColumn("part", F.call_function("div", F.col("c_custkey"), F.lit(100).cast("bigint")))
    return binary.build(c, "part", "c_custkey", write, **how)


def numbered(c, k, path, size):
    """(place in the table, value) of a 1-D dataset in file ``k``."""
    return ((k * size + i, v) for i, v in enumerate(c.dataset(path).numpy_order()))


# layouts


def _layout(name: str, layout: str, **how) -> None:
    @query(name, f"SELECT o_orderkey AS d0, o_totalprice AS value, '{layout}' AS layout FROM orders")
    def run(spark, sf_dir):
        files = orders(spark, sf_dir, lambda w, p: w.dataset("/x", p["o_totalprice"].to_numpy(), **how))

        def read(c, k):
            kind = c.dataset("/x").layout["kind"]
            return ((d, v, kind) for d, v in numbered(c, k, "/x", 500))

        return binary.scan(files, read, "d0 bigint, value double, layout string")


_layout("src_11_compact", "compact", compact=True)
_layout("src_12_contiguous", "contiguous")


@query("src_28_dataset_settings", "SELECT o_orderkey // 500 AS file, '[' || count(*) || ']' AS dims, '[64]' AS chunk, 'shuffle,deflate,fletcher32' AS filters, -1.5::DOUBLE AS fill, ((count(*) + 63) // 64)::BIGINT AS chunks, 8::BIGINT AS element_size, 'allocated' AS status FROM orders GROUP BY ALL")
def dataset_settings(spark, sf_dir):
    """How a dataset is stored, from its header."""
    files = orders(spark, sf_dir, lambda w, p: w.dataset("/x", p["o_totalprice"].to_numpy(), chunk=(64,), filters=PACKED, fill=-1.5))

    def read(c, k):
        d = c.dataset("/x").describe()
        yield k, str(list(d["dims"])), str(list(d["chunk"])), ",".join(d["filters"]), float(d["fill"]), d["chunks"], d["element_size"], d["status"]

    return binary.scan(files, read, "file bigint, dims string, chunk string, filters string, fill double, chunks bigint, element_size bigint, status string")


@query("src_29_file_info", "SELECT c_custkey // 100 AS file, count(DISTINCT c_mktsegment) + 1 AS groups, count(DISTINCT c_mktsegment) AS datasets, 8::BIGINT AS offset_size, 2::BIGINT AS version FROM customer GROUP BY ALL")
def file_info(spark, sf_dir):
    """What the superblock and the tree say about each file."""

    def read(c, k):
        i = c.info()
        yield k, i["groups"], i["datasets"], i["offset_size"], i["version"]

    return binary.scan(customers(spark, sf_dir, _segments), read, "file bigint, groups bigint, datasets bigint, offset_size bigint, version bigint")


def _segments(w, p) -> None:
    for name, rows in p.groupby("c_mktsegment"):
        w.group(f"/{name}")
        w.dataset(f"/{name}/balance", rows["c_acctbal"].to_numpy())


# sinks


@query("snk_03_builder_options", "SELECT o_orderkey AS d0, CASE WHEN (o_orderkey % 500) // 50 % 2 = 0 THEN o_custkey ELSE -9 END::BIGINT AS value FROM orders")
def builder_options(spark, sf_dir):
    """Chunks, filters, a fill value and a growable axis together; only even chunks are stored."""

    def write(w, p):
        w.dataset("/x", p["o_custkey"].to_numpy("<i8"), chunk=(50,), max_dims=(None,), filters=PACKED, fill=-9, only=[(i,) for i in range(0, 10, 2)])

    return binary.scan(orders(spark, sf_dir, write), lambda c, k: numbered(c, k, "/x", 500), "d0 bigint, value bigint")


@query("snk_07_raw_bytes", "SELECT o_orderkey AS d0, array_to_string([substr(lpad(lower(to_hex(o_custkey)), 16, '0'), 17 - 2 * i, 2) for i in range(1, 9)], '') AS raw FROM orders")
def raw_with_type(spark, sf_dir):
    """Bytes written with an explicit opaque type."""
    files = orders(spark, sf_dir, lambda w, p: w.dataset("/x", np.frombuffer(p["o_custkey"].to_numpy("<i8").tobytes(), "V8"), np.dtype("V8")))
    return binary.scan(files, lambda c, k: ((d, v.hex()) for d, v in numbered(c, k, "/x", 500)), "d0 bigint, raw string")


@query("snk_08_scalars", "SELECT c_custkey // 100 AS file, count(*) AS n, max(c_acctbal) AS most FROM customer GROUP BY ALL")
def scalars(spark, sf_dir):
    def write(w, p):
        w.dataset("/n", np.int64(len(p)))
        w.dataset("/most", np.float64(p["c_acctbal"].max()))

    return binary.scan(customers(spark, sf_dir, write), lambda c, k: iter([(k, c.dataset("/n").numpy_order()[0], c.dataset("/most").numpy_order()[0])]), "file bigint, n bigint, most double")


@query("snk_09_fixed_strings", "SELECT c_custkey AS d0, c_name AS value, 24::BIGINT AS size FROM customer")
def fixed_strings(spark, sf_dir):
    files = customers(spark, sf_dir, lambda w, p: w.dataset("/x", p["c_name"].to_numpy().astype("S24")))

    def read(c, k):
        size = c.dataset("/x").type.size
        return ((d, v, size) for d, v in numbered(c, k, "/x", 100))

    return binary.scan(files, read, "d0 bigint, value string, size bigint")


@query("snk_10_variable_strings", "SELECT c_custkey AS d0, c_mktsegment || ' é ' || c_name AS value FROM customer")
def variable_strings(spark, sf_dir):
    files = customers(spark, sf_dir, lambda w, p: w.dataset("/x", (p["c_mktsegment"] + " é " + p["c_name"]).to_numpy(object)))
    return binary.scan(files, lambda c, k: numbered(c, k, "/x", 100), "d0 bigint, value string")


@query("snk_12_links", "SELECT c_custkey // 100 AS file, path, kind, sum(c_custkey)::BIGINT AS total FROM customer, (VALUES ('/data', 'hard'), ('/g/twin', 'hard'), ('/alias', 'soft')) t(path, kind) GROUP BY ALL")
def links(spark, sf_dir):
    """One dataset through its own, a second hard and a soft link."""

    def write(w, p):
        w.group("/g")
        w.dataset("/data", p["c_custkey"].to_numpy("<i8"))
        w.hard("/g/twin", "/data")
        w.soft("/alias", "/data")

    return binary.scan(customers(spark, sf_dir, write), lambda c, k: ((k, p, kind, sum(c.dataset(p).numpy_order())) for p, kind, _, _ in c.walk() if p != "/g"), "file bigint, path string, kind string, total bigint")


@query("src_02_store_modes", f"SELECT d0, d1, value FROM {E} UNION ALL SELECT d0, d1, -value FROM {E} WHERE d0 < 100")
def store_modes(spark, sf_dir):
    """A store made exclusively, opened to add a dataset, and opened for reading."""
    root = scratch(spark, "modes")
    a = matrix(spark, sf_dir)
    Store(spark, root, "x").write("/first", a, DatasetOptions(chunk=(100, 64)))
    Store(spark, root, "a").write("/second", ArrayFrame(a.df.where("d0 < 100").withColumn("value", -F.col("value")), Shape((100, 64))))
    s = Store(spark, root, "r")
    return s.read("/first").elements().unionByName(s.read("/second").elements())


@query("snk_17_in_existing_group", "SELECT o_orderkey AS d0, o_totalprice AS value FROM orders")
def in_existing(spark, sf_dir):
    """A dataset written into a group of a store that was there."""
    root = scratch(spark, "existing")
    Store(spark, root, "w").create_group("/g")
    Store(spark, root, "a").write("/g/x", prices(spark, sf_dir))
    return Store(spark, root).read("/g/x").elements()


@query("snk_14d_grow_in_storage", f"SELECT d0, d1, value FROM {E} UNION ALL SELECT (SELECT count(*) FROM embeddings) + a, b, 0.5 FROM range(50) x(a), range(64) y(b)")
def grow_in_storage(spark, sf_dir):
    """An array resized to hold more rows, which are then written."""
    s, a = Store(spark, scratch(spark, "grow"), "x"), matrix(spark, sf_dir)
    n = a.shape.dims[0]
    s.write("/x", a, DatasetOptions(chunk=(100, 64), max_dims=(None, 64)))
    s.resize("/x", (n + 50, 64))
    more = spark.range(50 * 64).select((F.lit(n) + F.call_function("div", F.col("id"), F.lit(64).cast("bigint"))).alias("d0"), (F.col("id") % 64).alias("d1"), F.lit(0.5).alias("value"))
    s.write_elements("/x", more)
    return s.read("/x").elements()


# types


@query("cnv_05_float_widths", "SELECT o_orderkey AS d0, o_totalprice::FLOAT::DOUBLE AS value FROM orders")
def float_widths(spark, sf_dir):
    """Doubles stored as single floats, read as doubles."""
    files = orders(spark, sf_dir, lambda w, p: w.dataset("/x", p["o_totalprice"].to_numpy("<f4")))
    return binary.scan(files, lambda c, k: ((d, float(v)) for d, v in numbered(c, k, "/x", 500)), "d0 bigint, value double")


@query("cnv_08_big_endian", "SELECT o_orderkey AS d0, o_totalprice AS price, o_custkey AS customer FROM orders")
def big_endian(spark, sf_dir):
    """Numbers stored with the high byte first."""

    def write(w, p):
        w.dataset("/price", p["o_totalprice"].to_numpy(">f8"), chunk=(100,), filters=PACKED)
        w.dataset("/customer", p["o_custkey"].to_numpy(">i4"))

    return binary.scan(orders(spark, sf_dir, write), lambda c, k: ((d, v, int(x)) for (d, v), x in zip(numbered(c, k, "/price", 500), c.dataset("/customer").numpy_order())), "d0 bigint, price double, customer bigint")


STATUS = (("F", 1), ("O", 258), ("P", 4095))


@query("cnv_09_enum_numbers", "SELECT o_orderkey AS d0, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 258 ELSE 4095 END::BIGINT AS number, o_orderstatus AS name FROM orders")
def enum_numbers(spark, sf_dir):
    """An enumeration read as its integers, named by the stored members."""
    files = orders(spark, sf_dir, lambda w, p: w.dataset("/x", p["o_orderstatus"].map(dict(STATUS)).to_numpy(">u2"), Enum(np.dtype(">u2"), STATUS)))

    def read(c, k):
        names = {v: n for n, v in c.dataset("/x").type.members}
        return ((d, int(v), names[v]) for d, v in numbered(c, k, "/x", 500))

    return binary.scan(files, read, "d0 bigint, number bigint, name string")


@query("prj_05_member_of_stored_record", "SELECT o_orderkey AS d0, o_totalprice AS price, 8::BIGINT AS place FROM orders")
def stored_member(spark, sf_dir):
    """One field of stored records, found by its name."""
    kind = np.dtype([("customer", "<i8"), ("price", "<f8"), ("status", "S1")])

    def write(w, p):
        rec = np.zeros(len(p), kind)
        rec["customer"], rec["price"], rec["status"] = p["o_custkey"], p["o_totalprice"], p["o_orderstatus"].to_numpy().astype("S1")
        w.dataset("/x", rec, chunk=(64,), filters=PACKED)

    def read(c, k):
        place = next(at for name, at, _ in c.dataset("/x").type.members if name == "price")
        return ((d, v["price"], place) for d, v in numbered(c, k, "/x", 500))

    return binary.scan(orders(spark, sf_dir, write), read, "d0 bigint, price double, place bigint")


@query("str_03_string_types", "SELECT c_custkey // 100 AS file, 'fixed' AS name, 'string' AS kind, 24::BIGINT AS size FROM customer GROUP BY ALL UNION ALL SELECT c_custkey // 100, 'variable', 'vstring', 16 FROM customer GROUP BY ALL")
def string_types(spark, sf_dir):
    """Stored string types: fixed or variable, and their bytes."""

    def write(w, p):
        w.dataset("/fixed", p["c_name"].to_numpy().astype("S24"))
        w.dataset("/variable", p["c_name"].to_numpy(object))

    return binary.scan(customers(spark, sf_dir, write), lambda c, k: ((k, p[1:], Dataset(c, t).type.kind, Dataset(c, t).type.size) for p, _, _, t in c.walk()), "file bigint, name string, kind string, size bigint")


# attributes


def _attributes(w, p) -> None:
    w.group("/g")
    w.attr("/g", "n", np.int32(len(p)))
    w.attr("/g", "range", np.array([p["c_acctbal"].min(), p["c_acctbal"].max()]))
    w.attr("/g", "rich", np.int8(p["c_acctbal"].max() > 9000))
    w.attr("/g", "first", p["c_name"].iloc[0])
    w.attr("/g", "segments", sorted(set(p["c_mktsegment"])))


@query("ns_10_typed_attributes", "SELECT c_custkey // 100 AS file, count(*) AS n, count(*)::DOUBLE AS n_float, min(c_acctbal) AS low, trunc(max(c_acctbal))::BIGINT AS high, least(trunc(max(c_acctbal)), 127)::BIGINT AS high_i8 FROM customer GROUP BY ALL")
def typed_attributes(spark, sf_dir):
    """Attributes read as other number types than they are stored in; what does not fit saturates."""

    def read(c, k):
        g = lambda name, kind=None: c.attribute("/g", name, kind)
        yield k, g("n", "i64"), g("n", "f64"), g("range")[0], g("range", "i64")[1], g("range", "i8")[1]

    return binary.scan(customers(spark, sf_dir, _attributes), read, "file bigint, n bigint, n_float double, low double, high bigint, high_i8 bigint")


@query("ns_11_string_attributes", "SELECT c_custkey // 100 AS file, arg_min(c_name, c_custkey) AS first, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY ALL")
def string_attributes(spark, sf_dir):
    return binary.scan(customers(spark, sf_dir, _attributes), lambda c, k: iter([(k, c.attribute("/g", "first", "string"), ",".join(c.attribute("/g", "segments", "string")))]), "file bigint, first string, segments string")


@query("ns_12_boolean_attributes", "SELECT c_custkey // 100 AS file, max(c_acctbal) > 9000 AS rich FROM customer GROUP BY ALL")
def boolean_attributes(spark, sf_dir):
    return binary.scan(customers(spark, sf_dir, _attributes), lambda c, k: iter([(k, c.attribute("/g", "rich", "bool"))]), "file bigint, rich boolean")


@query("snk_11_attributes_of_datasets", "SELECT c_custkey // 100 AS file, 'x' || i AS name, (c_custkey // 100) * 10 + i AS value FROM (SELECT DISTINCT c_custkey // 100 * 100 AS c_custkey FROM customer), range(12) t(i)")
def dataset_attributes(spark, sf_dir):
    """Many attributes of one dataset."""

    def write(w, p):
        w.dataset("/d", p["c_custkey"].to_numpy("<i8"))
        for i in range(12):
            w.attr("/d", f"x{i}", np.int64(p["c_custkey"].iloc[0] // 100 * 10 + i))

    return binary.scan(customers(spark, sf_dir, write), lambda c, k: ((k, n, v) for n, v in c.attributes("/d").items()), "file bigint, name string, value bigint")


# names


@query("ns_02_kinds", "SELECT DISTINCT c_custkey // 100 AS file, '/' || c_mktsegment AS path, 'group' AS kind FROM customer UNION SELECT c_custkey // 100, '/' || c_mktsegment || '/balance', 'dataset' FROM customer")
def kinds(spark, sf_dir):
    """Every object below the root, opened by its kind."""
    return binary.scan(customers(spark, sf_dir, _segments), lambda c, k: ((k, p, kind) for p, _, kind, _ in c.walk()), "file bigint, path string, kind string")


def _member_names(name: str, dense: bool, **how) -> None:
    @query(name, "SELECT c_custkey // 100 AS file, lpad(c_custkey::VARCHAR, 8, '0') AS name, c_custkey // 100 AS value FROM customer")
    def run(spark, sf_dir):
        def write(w, p):
            w.group("/many", dense=dense)
            w.dataset("/x", np.array([p["c_custkey"].iloc[0] // 100], "<i8"))
            for key in p["c_custkey"]:
                w.hard(f"/many/{key:08d}", "/x")

        def read(c, k):
            value = int(c.dataset("/x").numpy_order()[0])
            return ((k, x.name, value) for x in c.links(c.resolve("/many")[1]))

        return binary.scan(customers(spark, sf_dir, write, **how), read, "file bigint, name string, value bigint")


_member_names("ns_14_symbol_tables", False, old=True)
_member_names("ns_15_dense_groups", True)


@query("ns_16_visit", "SELECT c_mktsegment AS name, sum(c_acctbal)::DECIMAL(18, 2)::DOUBLE AS total, count(*) AS n FROM customer GROUP BY ALL")
def visit(spark, sf_dir):
    """All datasets of all files visited, and gathered by the group they are in."""

    def read(c, k):
        for path, _, kind, target in c.walk():
            if kind == "dataset":
                yield from ((path.split("/")[1], v) for v in Dataset(c, target).numpy_order())

    rows = binary.scan(customers(spark, sf_dir, _segments), read, "name string, value double")
    return rows.groupBy("name").agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").cast("double").alias("total"), F.count("*").alias("n"))


# selections


@query("sel_32_normalise", f"SELECT d0, d1, value FROM {E} WHERE d0 >= 4 AND (d0 - 4) % 6 = 0 AND d1 >= 8 AND d1 < 24")
def normalise(spark, sf_dir):
    """A hyperslab read as the slices it equals."""
    v = vectors(spark, sf_dir)
    return v.read(Hyperslab(Span(4, 6, None, 1), Span(8, 4, 4, 4)).slices(v.shape))


@query("sel_22_combined_steps", f"SELECT d0, d1, value FROM {E} WHERE ((d0 < 50 AND d1 < 20) OR (d0 >= 30 AND d0 < 90 AND d1 >= 10)) AND NOT (d0 % 2 = 1) AND d1 < 40")
def combined_steps(spark, sf_dir):
    """A selection modified step by step: united, cut down, intersected."""
    v = vectors(spark, sf_dir)
    s = Slices((0, 50), (0, 20)) | Slices((30, 90), (10, None))
    s = s - Slices((1, None, 2), (0, None))
    return v.array().read(s & Slices((0, None), (0, 40)))


@query("sel_11_validity", "SELECT v.* FROM (SELECT count(*) AS n FROM embeddings), LATERAL (VALUES ('inside', true), ('past the end', false), ('another rank', false), ('step 0', false)) v(selection, valid)")
def validity(spark, sf_dir):
    """Which selections fit the array."""
    shape = vectors(spark, sf_dir).shape
    n = shape.dims[0]
    out = []
    for name, s in (("inside", Slices((0, n), (0, 64))), ("past the end", Slices((0, n + 1), (0, 64))), ("another rank", Slices((0, n))), ("step 0", Slices((0, n, 0), (0, 64)))):
        try:
            s.validate(shape)
            out.append((name, True))
        except IndexError:
            out.append((name, False))
    return spark.createDataFrame(out, "selection string, valid boolean")


# virtual arrays


@query("vds_01_mapping_lists", "SELECT o_orderkey // 500 AS file, (o_orderkey % 500) // 100 AS at, 'part-' || (o_orderkey % 500) // 100 AS source, '/data' AS dataset, (o_orderkey % 500) // 100 * 100 AS first, 100::BIGINT AS n FROM orders GROUP BY ALL")
def mapping_lists(spark, sf_dir):
    """The mappings of virtual datasets, as stored."""

    def write(w, p):
        parts = -(-len(p) // 100)
        w.virtual_dataset("/v", "<f8", (100 * parts,), [(f"part-{i}", "/data", Everything(), Hyperslab((100 * i, 1, 1, 100))) for i in range(parts)])

    def read(c, k):
        for at, (file, name, _, dst) in enumerate(c.dataset("/v").mappings()):
            yield k, at, file, name, dst.spans[0].start, dst.spans[0].size

    return binary.scan(orders(spark, sf_dir, write), read, "file bigint, at bigint, source string, dataset string, first bigint, n bigint")


@query("vds_11_first_missing", "SELECT o_orderkey AS d0, o_totalprice AS value FROM orders WHERE o_orderkey < 2000")
def first_missing(spark, sf_dir):
    """Numbered blocks of a thousand, of which number 2 is not there: what lies behind the gap does not count."""
    p = prices(spark, sf_dir)
    block = lambda b: ArrayFrame(p.df.where(F.col("d0").between(1000 * b, 1000 * b + 999)).withColumn("d0", F.col("d0") - 1000 * b), Shape((1000,)))
    m = virtual.block_mappings([(b, block(b)) for b in (0, 1, 3)], Everything(), Hyperslab(Span(0, 1000, None, 1000)), "first_missing")
    ends = [x.dst.spans[0].last + 1 for x in m]
    return virtual.VirtualArray(Shape((max(ends),)), tuple(m), -1.0).read().elements().where("value <> -1.0")


@query("vds_16_outside", "SELECT o_orderkey + 500 AS d0, o_totalprice AS value FROM orders WHERE o_orderkey + 500 < (SELECT count(*) FROM orders)")
def outside(spark, sf_dir):
    """Source elements that would land outside the array are left out."""
    p = prices(spark, sf_dir)
    n = p.shape.dims[0]
    m = virtual.Mapping(p, Slices((0, n)), Hyperslab((500, 1, 1, n)))
    return virtual.VirtualArray(Shape((n,)), (m,), -1.0).read().elements().where("value <> -1.0")
