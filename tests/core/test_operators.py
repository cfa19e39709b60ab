"""Conversion, transforms, strings, codecs, virtual arrays, chunks, namespace, store and streams on golden values."""

import dataclasses
import enum
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.array import ArrayFrame
from tesserae.errors import FormatError, SelectionError, UnsupportedError
from tesserae.functions import nested, records, text, transform
from tesserae.functions.convert import saturating
from tesserae.operators import chunks, mutation, namespace, virtual
from tesserae.plans.selection import Everything, Hyperslab, Points, Slices, Span
from tesserae.shape import Shape
from tesserae.sources import codecs
from tesserae.sources.store import DatasetOptions, Store
from tesserae.streaming import growth

I16 = [-129, -1, 0, 1, 127, 128, 255, 256, 32767]
FLOATS = [-math.inf, -129.75, -1.5, -0.0, 0.0, 1.5, 127.25, 128.75, math.inf, math.nan]


def converted(spark, values, kind, source, target):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(saturating(F.col("v"), source, target)).collect()]


def test_conversion_vectors(spark):
    assert converted(spark, I16, "smallint", "i16", "i8") == [-128, -1, 0, 1, 127, 127, 127, 127, 127]
    assert converted(spark, I16, "smallint", "i16", "u8") == [0, 0, 0, 1, 127, 128, 255, 255, 255]
    assert converted(spark, I16, "smallint", "i16", "i32") == I16
    u = [0, 1, 127, 128, 255, 256, 32767, 32768, 65535]
    assert converted(spark, u, "int", "u16", "i8") == [0, 1] + [127] * 7
    assert converted(spark, u, "int", "u16", "u8") == [0, 1, 127, 128, 255, 255, 255, 255, 255]
    assert converted(spark, FLOATS, "double", "f64", "i8") == [-128, -128, -1, 0, 0, 1, 127, 127, 127, 0]
    assert converted(spark, FLOATS, "double", "f64", "u8") == [0, 0, 0, 0, 0, 1, 127, 128, 255, 0]
    assert converted(spark, FLOATS, "float", "f32", "i16") == [-32768, -129, -1, 0, 0, 1, 127, 128, 32767, 0]
    assert converted(spark, FLOATS, "double", "f64", "u16") == [0, 0, 0, 0, 0, 1, 127, 128, 65535, 0]
    big = [-(2**63), 2**63 - 1, 0]
    assert [int(x) for x in converted(spark, big, "bigint", "i64", "u64")] == [0, 2**63 - 1, 0]
    assert converted(spark, [1e30, -1e30, 9.2e18], "double", "f64", "i64") == [2**63 - 1, -(2**63), 9200000000000000000]
    assert [int(x) for x in converted(spark, [1e30, -1.0, 1.8e19, 2.9], "double", "f64", "u64")] == [2**64 - 1, 0, 18000000000000000000, 2]
    with pytest.raises(UnsupportedError):
        saturating(F.lit("x"), "string", "i8")


def test_transforms(spark):
    df = spark.range(1, 4)
    for t, f in (("x", lambda x: x), ("(x*1.8)+32", lambda x: x * 1.8 + 32), ("-X/4 - -2e1", lambda x: -x / 4 + 20), ("2*(3+4)-x*x", lambda x: 14 - x * x), ("--x", lambda x: x), (".5*x", lambda x: 0.5 * x)):
        assert [r[0] for r in df.select(transform.apply(t, F.col("id"))).collect()] == [f(x) for x in (1, 2, 3)]
        assert transform.parse(t).evaluate(3) == f(3)
    for bad in ("", "x+", "(x", "x)", "y", "2 3", "*x", "x**2"):
        with pytest.raises(FormatError):
            transform.parse(bad)
    assert transform.parse("2*3+x").folded().args[0].value == 6
    with pytest.raises(Exception, match="division by zero"):
        df.select(transform.apply("1/(x-2)", F.col("id"))).collect()
    with pytest.raises(FormatError):
        transform.parse("1/(x-2)").evaluate(2)


def test_strings(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.fixed(F.lit("hi\0zz  "))) == "hi" and get(text.fixed(F.lit("a b \t "), text.SPACE_PADDED)) == "a b"
    assert get(text.fixed(F.lit("trail "), text.NUL_PADDED)) == "trail "
    assert get(text.variable(F.lit("x\0y\0\0"))) == "x\0y" and get(text.variable(F.lit(None).cast("string"))) == ""
    assert get(text.padded(F.lit("猫"), 5)) == "猫\0\0"
    with pytest.raises(Exception, match="over 2 bytes"):
        get(text.padded(F.lit("猫"), 2))
    for p in ("/a/b", "a//b/./c/..", "/../..", "", "/a/../../b/"):
        assert get(text.canonical_column(F.lit(p))) == text.canonical(p)
    assert text.canonical("a//b/./c/..") == "/a/b" and text.canonical("/../..") == "/"


def test_nested(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    m = {"LOW": 1, "MID": 258, "HIGH": 4095}
    assert [get(nested.enum_name(F.lit(v), m)) for v in (1, 258, 4095, 5)] == ["LOW", "MID", "HIGH", None]
    assert get(nested.enum_value(F.lit("MID"), m)) == 258
    a = F.array(*[F.lit(i) for i in range(12)])
    assert get(nested.reshaped(a, (2, 3, 2))) == np.arange(12).reshape(2, 3, 2).tolist()
    assert get(nested.flattened(nested.reshaped(a, (2, 3, 2)), 3)) == list(range(12))
    with pytest.raises(Exception, match="elements expected"):
        get(nested.reshaped(a, (5, 2)))
    assert get(nested.sign_extended(F.lit(0b1111), 4)) == -1 and get(nested.find_bit(F.lit(0b1011), 8, False)) == 2
    mp = F.create_map(F.lit("b"), F.lit(1), F.lit("a"), F.lit(2))
    assert [tuple(e) for e in get(nested.map_entries_from(mp))] == [("a", 2), ("b", 1)]
    assert get(nested.map_delete(nested.map_put(mp, F.lit("a"), F.lit(9)), F.lit("b"))) == {"a": 9}


def lzf_literals(b):
    return b"".join(bytes([len(b[i : i + 32]) - 1]) + b[i : i + 32] for i in range(0, len(b), 32))


def test_codecs():
    r = random.Random(1)
    for n in (0, 1, 7, 64, 4097):
        b = r.randbytes(n)
        for size in (1, 2, 4, 8):
            assert codecs.unshuffle(codecs.shuffle(b, size), size) == b
        assert codecs.inflate(codecs.deflate(b), n) == b
        assert codecs.check_checksum(codecs.add_checksum(b)) == b
        assert codecs.unlzf(lzf_literals(b), n) == b
    assert codecs.shuffle(bytes(range(10)), 4) == bytes([0, 4, 1, 5, 2, 6, 3, 7, 8, 9])
    assert codecs.unlzf(b"\x02abc" + bytes([(1 << 5) | 0, 2]) + bytes([(7 << 5) | 0, 3, 0]), 18) == b"abcabc" + b"c" * 12
    c = codecs.add_checksum(b"abcdef")
    with pytest.raises(FormatError):
        codecs.check_checksum(b"x" + c[1:])
    swapped = bytes(c[:-4]) + bytes([c[-3], c[-4], c[-1], c[-2]])
    assert codecs.check_checksum(swapped) == b"abcdef"
    with pytest.raises(FormatError):
        codecs.inflate(zlib.compress(b"x") + b"y")
    assert codecs.lookup3(b"") == 0xDEADBEEF and codecs.lookup3(b"Four score and seven years ago") == 0x17770551
    v = np.array([-120, -5, 7, 127], np.int16)
    members = [codecs.Bits(2, 12)]
    back = np.frombuffer(codecs.nbit_unpack(codecs.nbit_pack(v.tobytes(), members), members, 4), np.uint16)
    assert back.tolist() == [x & 0xFFF for x in v.tolist()]
    rec = np.array([(5, 9, 1.5), (31, 1, -2.25)], [("code", "<i2"), ("count", ">u2"), ("score", "<f4")])
    members = [codecs.Bits(2, 6), codecs.Bits(2, 16, 0, True), codecs.Bits(4, 32)]
    assert codecs.nbit_unpack(codecs.nbit_pack(rec.tobytes(), members), members, 2) == rec.tobytes()
    low, bits, packed = codecs.scale_offset_pack(np.array([-42] * 8))
    assert (low, bits, packed) == (-42, 0, b"") and codecs.scale_offset_unpack(low, bits, packed, 8) == [-42] * 8
    low, bits, packed = codecs.scale_offset_pack(np.array([5, -9, 127, -120]), fill=-9)
    assert codecs.scale_offset_unpack(low, bits, packed, 4, fill=-9) == [5, -9, 127, -120]
    x = np.arange(40) / 10 + 1.25
    assert np.allclose(codecs.scale_offset_unpack_floats(*codecs.scale_offset_pack_floats(x, 2), 40, 2), x, atol=0.005)


def test_pipeline(spark):
    p = codecs.Pipeline((codecs.Filter("shuffle", {"size": 4}), codecs.Filter("deflate"), codecs.Filter("fletcher32")))
    data = np.arange(16401, dtype=np.int32).tobytes()
    assert p.decode(p.encode(data), len(data)) == data
    # bits 0 and 2: shuffle and checksum were not applied
    assert p.decode(codecs.deflate(data), len(data), 0b101) == data
    for bad in (lambda: p.decode(data, len(data), 0b1000), lambda: p.decode(p.encode(data), 3), lambda: codecs.Pipeline((codecs.Filter("x"),) * 33)):
        with pytest.raises(FormatError):
            bad()
    with pytest.raises(UnsupportedError):
        codecs.Pipeline((codecs.Filter("szip"),)).decode(b"", 0)
    assert codecs.Pipeline((codecs.Filter("szip"),)).decode(b"ab", 2, 1) == b"ab"
    assert [f.name for f in p.delete("deflate").filters] == ["shuffle", "fletcher32"]
    rows = spark.createDataFrame([(i, bytearray(os.urandom(40)), 40, 0) for i in range(5)], "i int, bytes binary, size int, mask int")
    back = codecs.decode_chunks(codecs.encode_chunks(rows, p), p)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def line(spark, values, **more):
    return ArrayFrame(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "d0 bigint, value double"), Shape((len(values),)), **more)


def plane(spark, values, **more):
    a = np.asarray(values, float)
    return ArrayFrame(spark.createDataFrame([(*map(int, at), a[at].item()) for at in np.ndindex(a.shape)], "d0 bigint, d1 bigint, value double"), Shape(a.shape), **more)


def test_virtual_arrays(spark):
    a, b = line(spark, [1, 2, 3, 4]), line(spark, [9, 8])
    v = virtual.VirtualArray(Shape((4,)), (virtual.Mapping(a, Everything(), Everything()), virtual.Mapping(b, Everything(), Slices((1, 3)))), 0.0)
    assert v.read().numpy().tolist() == [1, 9, 8, 4]
    gap = virtual.VirtualArray(Shape((4, 6)), (virtual.Mapping(plane(spark, np.arange(6).reshape(2, 3)), Everything(), Slices((1, 3), (2, 5))),), -7.0)
    want = np.full((4, 6), -7.0)
    want[1:3, 2:5] = np.arange(6).reshape(2, 3)
    assert (gap.read().numpy() == want).all()
    s = plane(spark, np.arange(16).reshape(4, 4))
    blocks = [((0, 1), (0, 2)), ((2, 0), (2, 1))]
    got = virtual.VirtualArray(Shape((4, 4)), tuple(virtual.irregular(s, blocks, blocks)), -2.0).read().numpy()
    want = np.full((4, 4), -2.0)
    want[0, 1:3], want[2, 0:2] = [1, 2], [8, 9]
    assert (got == want).all()
    pair = virtual.VirtualArray(Shape((4, 4)), (virtual.points(s, [((2, 1), (0, 3))]),), -2.0).read().numpy()
    assert pair[0, 3] == 9 and (pair == -2).sum() == 15
    flat = virtual.VirtualArray(Shape((2, 3)), (virtual.Mapping(line(spark, range(6)), Everything(), Everything()),), 0.0)
    assert flat.read().numpy().tolist() == [[0, 1, 2], [3, 4, 5]]
    scattered = virtual.VirtualArray(Shape((10,)), (virtual.Mapping(line(spark, range(4)), Everything(), Hyperslab((1, 5, 2, 2))),), -1.0)
    assert scattered.read().numpy().tolist() == [-1, 0, 1, -1, -1, -1, 2, 3, -1, -1]
    with pytest.raises(SelectionError):
        virtual.VirtualArray(Shape((3,)), (virtual.Mapping(a, Everything(), Everything()),), 0.0).read()
    with pytest.raises(FormatError):
        virtual.VirtualArray(Shape((3,)), (virtual.Mapping(None, Everything(), Everything()),), 0.0).read()


def test_block_sources(spark):
    assert virtual.expand_name("f-%b.x", ["f-0.x", "f-3.x", "f-03.x", "f-a.x", "g-1.x"]) == [(0, "f-0.x"), (3, "f-3.x")]
    assert virtual.expand_name("%%%b", ["%7"]) == [(7, "%7")]
    with pytest.raises(FormatError):
        virtual.expand_name("f-%d", [])
    found = [(b, line(spark, [b] * 5)) for b in (0, 1, 3)]
    first = Hyperslab(Span(0, 5, None, 5))
    m = virtual.block_mappings(found, Everything(), first)
    assert virtual.VirtualArray(Shape((20,)), tuple(m), -1.0).read().numpy().tolist() == [0] * 5 + [1] * 5 + [-1] * 5 + [3] * 5
    assert len(virtual.block_mappings(found, Everything(), first, "first_missing")) == 2
    assert virtual.extent([4, 9], "last_available") == 9 and virtual.extent([4, 9], "first_missing") == 4
    there = {"/d/a", "/v/b", "/abs"}.__contains__
    find = lambda n, **k: virtual.resolve_source(n, here="/d/file", exists=there, **k)
    assert (find("."), find("a"), find("/abs"), find("x/b", prefix="/v"), find("b", env_prefix="/q:${ORIGIN}/../v"), find("zz")) == ("/d/file", "/d/a", "/abs", "/v/b", None, None)


def test_chunks(spark):
    x = np.arange(140).reshape(5, 7, 4)
    rows = [(*map(int, at), int(x[at])) for at in np.ndindex(x.shape)]
    a = ArrayFrame(spark.createDataFrame(rows, "d0 bigint, d1 bigint, d2 bigint, value bigint"), Shape((5, 7, 4)), chunk=(2, 3, 2))
    assert chunks.expected_chunks(a) == 18 and chunks.catalogue(a).count() == 18
    packed = chunks.to_chunks(a)
    assert (chunks.from_chunks(packed, a).numpy() == x).all()
    s = Slices((2, 4), (0, 2), (1, 2))
    few = chunks.from_chunks(chunks.pruned(packed, s, a.shape, a.chunk), a)
    assert chunks.pruned(packed, s, a.shape, a.chunk).count() == 1 and {r.value for r in few.read(s).collect()} == set(x[2:4, 0:2, 1:2].ravel().tolist())
    status = lambda f: chunks.space_status(a.with_df(f)).first().status
    assert (status(a.df), status(a.df.where("d0 < 2")), status(a.df.limit(0))) == ("allocated", "part allocated", "not allocated")
    kinds = [chunks.index_kind(s, (10,) * s.rank) for s in (Shape((10,)), Shape((11,)), Shape((11,), (None,)), Shape((11,), (20,)), Shape((1, 1), (None, None)))]
    assert kinds == ["single chunk", "fixed array", "extensible array", "b-tree v2", "b-tree v2"]


def test_mutation(spark):
    x = np.arange(24).reshape(4, 6)
    a = plane(spark, x, chunk=(2, 3), fill=-1.0)
    a = ArrayFrame(a.df, Shape((4, 6), (None, 6)), chunk=(2, 3), fill=-1.0)
    small = mutation.resize(a, (3, 4))
    assert (small.numpy() == x[:3, :4]).all()
    back = mutation.grown(small, (4, 6)).numpy()
    want = np.full((4, 6), -1.0)
    want[:3, :4] = x[:3, :4]
    assert (back == want).all()
    for bad in ((4, 7), (4,)):
        with pytest.raises(FormatError):
            mutation.resize(a, bad)
    with pytest.raises(UnsupportedError):
        mutation.resize(line(spark, [1]), (2,))
    new = spark.createDataFrame([(2, 3, 100.0), (3, 5, 101.0)], "d0 bigint, d1 bigint, value double")
    got = mutation.write_chunk(a, (2, 3), new).elements().where("value >= 100 OR d0 < 2").count()
    assert got == 14
    with pytest.raises(FormatError):
        mutation.write_chunk(a, (1, 3), new)


def test_namespace(spark):
    links = spark.createDataFrame(
        [(0, "g", "hard", "1", None, 2), (0, "s", "soft", "/g/d", None, 1), (1, "d", "hard", "2", None, 1), (1, "loop", "soft", "loop", None, 2), (1, "up", "soft", "../g", None, 3), (0, "e", "external", "/d", "other", 3), (0, "u", "user", "", None, 4)],
        namespace.LINKS,
    )
    objects = spark.createDataFrame([(0, "group"), (1, "group"), (2, "dataset")], namespace.OBJECTS)
    other = namespace.Namespace(spark.createDataFrame([(0, "d", "hard", "7", None, 1)], namespace.LINKS), spark.createDataFrame([(0, "group"), (7, "dataset")], namespace.OBJECTS), name="other")
    ns = namespace.Namespace(links, objects, open_file=lambda f: other)
    assert [ns.resolve(p)[1] for p in ("/", "/g/d", "s", "/g/../g/./d", "/g/up/d", "/e")] == [0, 2, 2, 2, 2, 7]
    for bad, kind in (("/nope", FormatError), ("/g/loop", FormatError), ("/u", UnsupportedError), ("/" + "x" * 1025, FormatError)):
        with pytest.raises(kind):
            ns.resolve(bad)
    assert ns.open("/g", "group") == 1
    with pytest.raises(FormatError):
        ns.open("/g", "dataset")
    assert [r.name for r in ns.list("/g").collect()] == ["d", "loop", "up"]
    assert [r.name for r in namespace.by_creation(links, 0).orderBy("at").collect()] == ["s", "g", "e", "u"]


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    s = Store(spark, root, "x")
    with pytest.raises(FormatError):
        Store(spark, root, "x")
    s.create_group("/run")
    x = np.arange(60).reshape(10, 6)
    a = plane(spark, x, fill=-9.0)
    s.write("/run/data", a, DatasetOptions(chunk=(3, 4), max_dims=(None, 6), attrs={"unit": "m", "scale": [1, 2]}))
    s.link_soft("/alias", "/run/data")
    s.link_hard("/twin", "/run/data")
    r = Store(spark, root)
    assert (r.read("/alias").numpy() == x).all() and r.attr("/twin", "scale") == [1, 2] and r.describe("/twin")["index"] == "extensible array"
    assert [t.value for t in r.select("/run/data", Slices((4, 6), (0, 2))).orderBy("d0", "d1").collect()] == x[4:6, :2].ravel().tolist()
    with pytest.raises(UnsupportedError):
        r.create_group("/no")
    s.write_elements("/run/data", spark.createDataFrame([(4, 1, -1.0)], "d0 bigint, d1 bigint, value double"))
    y = x.astype(float)
    y[4, 1] = -1
    assert (s.read("/twin").numpy() == y).all()
    s.resize("/run/data", (5, 6))
    s.resize("/run/data", (7, 6))
    want = np.full((7, 6), -9.0)
    want[:5] = y[:5]
    assert (s.read("/run/data").numpy() == want).all()
    s.rename_attr("/run/data", "unit", "units")
    s.delete_attr("/run/data", "scale")
    assert s.attr("/run/data", "units") == "m"
    with pytest.raises(FormatError):
        s.set_attr("/run/data", "units", "km")
    s.move("/run/data", "/moved")
    s.unlink("/moved")
    assert s.read("/twin").shape.dims == (7, 6)
    s.unlink("/twin")
    assert not os.path.exists(f"{root}/data/2/elements") and s.table("objects").count() == 2
    with pytest.raises(FormatError):
        s.read("/alias")
    other = Store(spark, str(tmp_path / "other"), "w")
    other.link_external("/far", "store", "/run")
    assert other.namespace.resolve("/far")[1] == 1


def test_growth_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).select(F.col("id").alias("d0"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(src)
    schema = "d0 bigint, ts timestamp, value double"
    growth.append(growth.read_growth(spark, src, schema), out, str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(out).count() == 30
    q = growth.extent(growth.read_growth(spark, src, schema)).writeStream.format("memory").queryName("extent").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("extent").first().n == 30
    w = growth.windowed(growth.read_growth(spark, src, schema, 10), "ts", "value", "1 hour", "10 minutes")
    q = w.writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").groupBy("start").agg(F.max("total").alias("t")).agg(F.sum("t")).first()[0] == 30.0


class Level(enum.Enum):
    LOW = 1


@dataclasses.dataclass
class Inner:
    a: int
    b: float


@dataclasses.dataclass
class Record:
    inner: Inner
    tags: list[str]
    level: Level
    small: int = dataclasses.field(default=0, metadata={"type": "u16", "rename": "n"})


def test_records(spark):
    t = records.struct_of(Record)
    assert t.simpleString() == "struct<inner:struct<a:bigint,b:double>,tags:array<string>,level:bigint,n:int>"
    assert records.member_index(t, "n") == 3
    df = spark.createDataFrame([((1, 2.5), ["x"], 1, 7)], t)
    assert df.select(records.read_field(df, "inner.b", "double")).first()[0] == 2.5
    for path, kind in (("inner.b", "float"), ("inner.c", "double"), ("n.x", "int")):
        with pytest.raises(FormatError):
            records.read_field(df, path, kind)
    with pytest.raises(UnsupportedError):
        records.struct_of(int)


def test_bits(spark):
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(nested.bit_add(F.lit(0b1111_0101), 1, 4, 4)) == 0b0000_0101
    assert get(nested.bit_add(F.lit(0), -1, 0, 8)) == 255
    assert get(nested.bit_negate(F.lit(0b0011), 0, 4)) == 0b1101
    assert get(nested.bit_shift(F.lit(0b1011_0001), -2, 4, 4)) == 0b0010_0001
    assert get(nested.bit_copy(F.lit(0), 4, F.lit(0b110), 1, 2)) == 0b11_0000
    assert [get(nested.bytes_compare(F.lit(a), F.lit(b))) for a, b in ((b"a", b"b"), (b"b", b"b"), (b"\xff", b"b"))] == [-1, 0, 1]
