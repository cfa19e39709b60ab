"""Containers written and read again, through every layout, index and old and new structures."""

import os
import random

import numpy as np
import pytest

from tesserae.errors import FormatError, UnsupportedError
from tesserae.plans.selection import Everything, Hyperslab, Points, Slices, Span
from tesserae.sources import codecs, datasource
from tesserae.sources.container import Container
from tesserae.sources.container_writer import ContainerWriter, Enum, Sequence_, VString

ZIP = (codecs.Filter("shuffle"), codecs.Filter("deflate", {"level": 4}), codecs.Filter("fletcher32"))


def fill(w):
    w.group("/g")
    w.dataset("/g/line", np.arange(100, dtype="<i4"), chunk=(10,))
    w.dataset("/g/zip", np.arange(16401, dtype="<i4") * 5 - 11, chunk=(2048,), filters=ZIP)
    w.dataset("/g/one", np.arange(12, dtype=">i2").reshape(3, 4), chunk=(3, 4), filters=ZIP)
    w.dataset("/g/cube", np.arange(140, dtype="<i4").reshape(5, 7, 4), chunk=(2, 3, 2))
    w.dataset("/flat", np.linspace(0, 1, 7))
    w.dataset("/tiny", np.array([1.5, -2.5], ">f4"), compact=True)
    w.dataset("/scalar", np.float64(2.25))
    w.dataset("/names", np.array(["", "猫", "alpha", "x" * 300], object))
    w.dataset("/fixed", np.array([b"hi", b"a b", b"trail"], "S8"))
    rec = np.zeros(3, np.dtype({"names": ["x", "y", "label"], "formats": ["<f8", "<f8", ">i4"], "offsets": [0, 8, 16], "itemsize": 24}))
    rec["x"], rec["label"] = [1, 3, 5], [7, 8, 9]
    w.dataset("/points", rec)
    w.dataset("/grids", np.arange(12, dtype="<i2").reshape(2, 2, 3), np.dtype(("<i2", (2, 3))), dims=(2,))
    w.dataset("/kinds", np.array([1, 258, 4095], ">u2"), Enum(np.dtype(">u2"), (("LOW", 1), ("MID", 258), ("HIGH", 4095))))
    seq = np.empty(3, object)
    seq[:] = [[1, 2], [], [5, 6, 7]]
    w.dataset("/seqs", seq, Sequence_(np.dtype("<i4")))
    w.dataset("/never", None, np.dtype("<i4"), dims=(4,), fill=-5)
    sparse = np.zeros((4, 6), "<i4")
    sparse[:2, :3] = np.arange(6).reshape(2, 3)
    w.dataset("/sparse", sparse, chunk=(2, 3), fill=-7, only=[(0, 0)])
    w.soft("/alias", "/g/line")
    w.hard("/g/twin", "/flat")
    w.attr("/g", "unit", "metre")
    w.attr("/g", "range", np.array([1, 2], "<i8"))
    w.attr("/flat", "labels", ["a", "猫"])


@pytest.mark.parametrize("old", [False, True])
@pytest.mark.parametrize("userblock", [0, 512])
def test_round_trip(tmp_path, old, userblock):
    path = str(tmp_path / "f")
    with ContainerWriter(path, old=old, userblock=userblock) as w:
        fill(w)
    c = Container(path)
    get = lambda p: c.dataset(p).numpy_order()
    assert c.userblock == userblock and c.version == (0 if old else 2)
    assert get("/g/line") == get("/alias") == list(range(100))
    assert get("/g/zip") == [i * 5 - 11 for i in range(16401)]
    assert get("/g/one") == list(range(12)) and get("/g/cube") == list(range(140))
    assert get("/flat") == get("/g/twin") == np.linspace(0, 1, 7).tolist()
    assert get("/tiny") == [1.5, -2.5] and get("/scalar") == [2.25]
    assert get("/names") == ["", "猫", "alpha", "x" * 300] and get("/fixed") == ["hi", "a b", "trail"]
    assert [(r["x"], r["label"]) for r in get("/points")] == [(1, 7), (3, 8), (5, 9)]
    assert get("/grids") == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11]]
    assert get("/kinds") == [1, 258, 4095] and c.dataset("/kinds").type.members == (("LOW", 1), ("MID", 258), ("HIGH", 4095))
    assert get("/seqs") == [[1, 2], [], [5, 6, 7]] and get("/never") == [-5] * 4
    assert get("/sparse") == [0, 1, 2, -7, -7, -7, 3, 4, 5, -7, -7, -7] + [-7] * 12
    assert c.attributes("/g") == {"unit": "metre", "range": [1, 2]} and c.attributes("/flat") == {"labels": ["a", "猫"]}
    kinds = {p: k for p, _, k, _ in c.walk()}
    assert kinds["/g"] == "group" and kinds["/g/line"] == "dataset" and kinds["/alias"] == ""
    assert c.dataset("/g/line").layout["index"] == ("b-tree v1" if old else "fixed array")


@pytest.mark.parametrize("filters", [(), ZIP])
def test_chunk_indexes(tmp_path, filters):
    path = str(tmp_path / "f")
    x = np.arange(4096, dtype="<i4")
    y = np.arange(35 * 8, dtype="<i4").reshape(35, 8)
    z = np.arange(160 * 4, dtype="<i2").reshape(160, 4)
    some = [(i,) for i in (0, 3, 4, 19, 20, 51, 52, 1000, 2048, 4095)]
    with ContainerWriter(path) as w:
        w.dataset("/paged", x, chunk=(1,), filters=filters, fill=-3)
        w.dataset("/paged_sparse", x, chunk=(1,), filters=filters, fill=-3, only=[(0,), (2048,), (4095,)])
        w.dataset("/grow", x, chunk=(1,), max_dims=(None,), filters=filters, fill=-4)
        w.dataset("/grow_sparse", x, chunk=(1,), max_dims=(None,), filters=filters, fill=-4, only=some)
        w.dataset("/grow2", y, chunk=(2, 3), max_dims=(None, 8), filters=filters)
        w.dataset("/grow_second", y, chunk=(2, 3), max_dims=(35, None), filters=filters)
        w.dataset("/both", z, chunk=(1, 1), max_dims=(None, None), filters=filters)
        w.dataset("/both_small", y, chunk=(4, 4), max_dims=(None, None), filters=filters)
    c = Container(path)
    get = lambda p: c.dataset(p).numpy_order()
    assert get("/paged") == get("/grow") == x.tolist()
    assert {i: v for i, v in enumerate(get("/paged_sparse")) if v != -3} == {i: i for i in (0, 2048, 4095)}
    assert {i: v for i, v in enumerate(get("/grow_sparse")) if v != -4} == {i: i for (i,) in some}
    assert get("/grow2") == get("/grow_second") == get("/both_small") == y.ravel().tolist() and get("/both") == z.ravel().tolist()
    assert [c.dataset(p).layout["index"] for p in ("/paged", "/grow", "/both")] == ["fixed array", "extensible array", "b-tree v2"]


def test_dense_groups(tmp_path):
    path = str(tmp_path / "f")
    with ContainerWriter(path) as w:
        w.group("/many", dense=True)
        w.dataset("/x", np.arange(3))
        for k in range(900):
            w.hard(f"/many/{k:04d}", "/x")
        w.group("/few", dense=True)
        w.soft("/few/é", "/x")
        for k in range(40):
            w.attr("/few", f"a{k}", np.array([k, k + 100], "<i8"))
    c = Container(path)
    assert sorted(x.name for x in c.links(c.resolve("/many")[1])) == [f"{k:04d}" for k in range(900)]
    assert c.dataset("/many/0899").numpy_order() == c.dataset("/few/é").numpy_order() == [0, 1, 2]
    assert c.attributes("/few") == {f"a{k}": [k, k + 100] for k in range(40)}


def test_descriptions(tmp_path):
    path = str(tmp_path / "f")
    with ContainerWriter(path, userblock=512) as w:
        fill(w)
    c = Container(path)
    info = c.info()
    assert (info["userblock"], info["groups"], info["version"], info["bytes"], info["free"]) == (512, 2, 2, os.path.getsize(path), 0)
    of = lambda p: c.dataset(p).describe()
    assert [of(p)["status"] for p in ("/sparse", "/never", "/flat", "/tiny")] == ["part allocated", "not allocated", "allocated", "allocated"]
    d = of("/g/zip")
    assert (d["dims"], d["chunk"], d["filters"], d["chunks"], d["expected"]) == ((16401,), (2048,), ["shuffle", "deflate", "fletcher32"], 9, 9)
    assert of("/sparse")["fill"] == -7


def test_links_between_files_and_circles(tmp_path):
    with ContainerWriter(str(tmp_path / "a")) as w:
        w.external("/far", "b", "/d")
        w.soft("/loop", "/loop")
        w.soft("/gone", "/nowhere")
    with ContainerWriter(str(tmp_path / "b")) as w:
        w.dataset("/d", np.arange(2))
    c = Container(str(tmp_path / "a"))
    assert c.dataset("/far").numpy_order() == [0, 1]
    for bad in ("/loop", "/gone"):
        with pytest.raises(FormatError):
            c.resolve(bad)


def test_damage_is_an_error(tmp_path):
    path = str(tmp_path / "f")
    with ContainerWriter(path) as w:
        fill(w)
    good = open(path, "rb").read()
    r = random.Random(3)
    broken = str(tmp_path / "g")
    for _ in range(150):
        b = bytearray(good)
        if r.random() < 0.3:
            b = b[: r.randrange(len(b))]
        else:
            for _ in range(r.randint(1, 4)):
                b[r.randrange(len(b))] = r.randrange(256)
        open(broken, "wb").write(bytes(b))
        try:
            c = Container(broken)
            for p, _, kind, _ in c.walk():
                if kind == "dataset":
                    c.dataset(p).numpy_order()
        except (FormatError, UnsupportedError, UnicodeDecodeError):
            pass
    flipped = bytearray(good)
    at = good.index(b"OHDR") + 8
    flipped[at] ^= 1
    open(broken, "wb").write(bytes(flipped))
    with pytest.raises(FormatError):
        list(Container(broken).walk())
    open(broken, "wb").write(b"nothing here")
    with pytest.raises(FormatError):
        Container(broken)


def test_writer_checks(tmp_path):
    path = str(tmp_path / "f")
    with ContainerWriter(path) as w:
        w.dataset("/x", np.arange(3))
        for bad in (lambda: w.dataset("/x", np.arange(2)), lambda: w.group("/a/b"), lambda: w.dataset("/y", np.arange(3), filters=ZIP), lambda: w.dataset("/y", np.arange(3), max_dims=(None,)), lambda: w.dataset("/y", None), lambda: w.attr("/x", "a", 1) or w.attr("/x", "a", 2)):
            with pytest.raises(FormatError):
                bad()
    with pytest.raises(FileExistsError):
        ContainerWriter(path, exclusive=True)
    assert VString() == VString() and os.path.getsize(path) > 0


def test_data_source(spark, tmp_path):
    path = str(tmp_path / "f")
    with ContainerWriter(path) as w:
        fill(w)
    datasource.register(spark)
    read = lambda **o: spark.read.format("tesserae_container").options(path=path, **o).load()
    cube = read(dataset="/g/cube", pieces="2")
    assert sorted(map(tuple, cube.collect())) == [(*at, i) for i, at in enumerate(np.ndindex(5, 7, 4))]
    assert cube.where("d0 >= 4 AND d1 = 6").count() == 4
    # two scans of one frame, filtered differently
    line = read(dataset="/g/line")
    assert line.where("d0 < 20").unionAll(line.where("d0 >= 70")).count() == 50
    assert cube.where("d0 = 0").unionAll(cube.where("d0 >= 3")).count() == 28 * 3
    corner = read(dataset="/g/cube", pieces="2", low="4,6,0", high="4,6,3")
    assert corner.rdd.getNumPartitions() == 1 and corner.where("d0 >= 4 AND d1 = 6").count() == 4
    some = datasource.read(spark, path, "/g/zip", Slices((5000, 9000, 7)))
    assert sorted((r.d0, r.value) for r in some.collect()) == [(i, i * 5 - 11) for i in range(5000, 9000, 7)]
    assert datasource.array(spark, path, "/flat", Slices((2, 4))).df.count() == 2 and read(dataset="/flat", span="3").rdd.getNumPartitions() == 3
    empty = read(dataset="/never")
    assert [tuple(r) for r in empty.orderBy("d0").collect()] == [(i, -5) for i in range(4)]
    sparse = {(r.d0, r.d1): r.value for r in read(dataset="/sparse").collect()}
    assert len(sparse) == 24 and sparse[1, 2] == 5 and sparse[3, 3] == -7
    assert read(dataset="/sparse", fill="false").count() == 6
    assert [(r.x, r.label) for r in read(dataset="/points").orderBy("d0").collect()] == [(1.0, 7), (3.0, 8), (5.0, 9)]
    assert [r.value for r in read(dataset="/names").orderBy("d0").collect()] == ["", "猫", "alpha", "x" * 300]
    assert [r.value for r in read(dataset="/seqs").orderBy("d0").collect()] == [[1, 2], [], [5, 6, 7]]
    assert read(dataset="/tiny").count() == 2 and read(dataset="/scalar").first().value == 2.25
    tree = {r.path: r for r in read().collect()}
    assert tree["/g/zip"].filters == "shuffle,deflate,fletcher32" and tree["/g/zip"].shape == "[16401]" and tree["/alias"].link == "soft"


def test_raw_data_in_other_files(spark, tmp_path):
    path = str(tmp_path / "f")
    (tmp_path / "raw").write_bytes(b"xx" + np.array([1, 2], "<i4").tobytes())
    (tmp_path / "more").write_bytes(np.array([3, 4, 9], "<i4").tobytes())
    with ContainerWriter(path) as w:
        w.external_dataset("/e", "<i4", (4,), [("raw", 2, 8), ("more", 0, 12)])
        w.external_dataset("/short", "<i4", (9,), [("raw", 2, 8)])
    datasource.register(spark)
    assert Container(path).dataset("/e").numpy_order() == [1, 2, 3, 4]
    assert [r.value for r in spark.read.format("tesserae_container").options(path=path, dataset="/e").load().orderBy("d0").collect()] == [1, 2, 3, 4]
    with pytest.raises(FormatError):
        Container(path).dataset("/short").numpy_order()


def test_virtual_datasets_in_files(spark, tmp_path):
    x = np.arange(16, dtype="<f8").reshape(4, 4)
    with ContainerWriter(str(tmp_path / "src")) as w:
        w.dataset("/A", x)
        w.dataset("/row", np.array([1.0, 2, 3, 4]))
        w.dataset("/two", np.array([9.0, 8]))
    for b in (0, 1, 3):
        with ContainerWriter(str(tmp_path / f"part-{b}")) as w:
            w.dataset("/A", np.full((2, 3), float(b)))
    path = str(tmp_path / "v")
    blocks = [((0, 1), (0, 2)), ((2, 0), (2, 1))]
    grow = Hyperslab(Span(0, 2, None, 2), Span(0, 3, 1, 3))
    with ContainerWriter(path) as w:
        w.virtual_dataset("/overlap", "<f8", (4,), [("src", "/row", Everything(), Everything()), ("src", "/two", Everything(), Slices((1, 3)))], fill=0.0)
        w.virtual_dataset("/blocks", "<f8", (4, 4), [("src", "/A", blocks, blocks)], fill=-2.0)
        w.virtual_dataset("/points", "<f8", (4, 4), [("src", "/A", Points([(2, 1)]), Points([(0, 3)]))], fill=-2.0)
        w.virtual_dataset("/numbered", "<f8", (0, 3), [("part-%b", "/A", Everything(), grow)], fill=-1.0, max_dims=(None, 3))
        w.virtual_dataset("/lost", "<f8", (4,), [("nowhere", "/row", Everything(), Everything())], fill=-3.0)
    datasource.register(spark)
    get = lambda n, **k: datasource.virtual_array(spark, path, n, **k).read().numpy().tolist()
    assert get("/overlap") == [1, 9, 8, 4]
    want = np.full((4, 4), -2.0)
    want[0, 1:3], want[2, 0:2] = [1, 2], [8, 9]
    assert get("/blocks") == want.tolist()
    want[:] = -2
    want[0, 3] = 9
    assert get("/points") == want.tolist()
    rows = lambda *b: [[float(k)] * 3 for k in b for _ in range(2)]
    assert get("/numbered") == rows(0, 1, -1, 3) and get("/numbered", view="first_missing") == rows(0, 1)
    with pytest.raises(FormatError):
        get("/lost")
