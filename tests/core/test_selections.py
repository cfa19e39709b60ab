"""Selections against numpy and golden values."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.array import ArrayFrame, filled, grid
from tesserae.errors import SelectionError, UnsupportedError
from tesserae.operators import selections as ops
from tesserae.plans.selection import Everything, Hyperslab, Nothing, Points, Selection, Slices, Span, coordinates, from_index
from tesserae.shape import Shape


def array(spark, values, **more):
    a = np.asarray(values)
    rows = [(*map(int, at), a[at].item()) for at in np.ndindex(a.shape)]
    ddl = ", ".join([f"d{i} bigint" for i in range(a.ndim)] + ["value bigint"])
    return ArrayFrame(spark.createDataFrame(rows, ddl), Shape(a.shape), **more)


def ordered(df):
    cols = ["pos"] if "pos" in df.columns else [c for c in df.columns if c[0] == "d"]
    return [r.value for r in df.orderBy(*cols).collect()]


@pytest.fixture(scope="module")
def line(spark):
    return array(spark, [1, 2, 3, 4, 5])


@pytest.fixture(scope="module")
def plane(spark):
    return array(spark, [[1, 2, 3], [4, 5, 6]])


def test_golden_reads(line, plane):
    assert ordered(line.read(Slices((0, 5, 2)))) == [1, 3, 5]
    assert ordered(line.read(Points([(4,), (0,), (2,)]))) == [5, 1, 3]
    assert ordered(line.read(Hyperslab((0, 3, 2, 2)))) == [1, 2, 4, 5]
    assert ordered(plane[1:, :2]) == [4, 5]
    assert ordered(plane.read(Slices((0, 2), (0, 3, 2)))) == [1, 3, 4, 6]
    assert ordered(plane.read(Points([(1, 2), (0, 0), (1, 1)]))) == [6, 1, 5]
    assert ordered(plane.read(Points([(1, 2), (1, 2), (0, 1), (1, 0)]))) == [6, 6, 2, 4]
    assert ordered(plane.read(Hyperslab((0, 1, 2, 1), (0, 2, 2, 1)))) == [1, 3, 4, 6]
    assert ordered(plane.read(Nothing())) == [] and ordered(plane.cell(1, 0)) == [4]
    assert plane.numpy().tolist() == [[1, 2, 3], [4, 5, 6]]
    assert [r["values"] for r in plane.vectors().orderBy("d0").collect()] == [[1, 2, 3], [4, 5, 6]]


def test_set_algebra(spark):
    shape = Shape((2, 3))
    left, right = Slices((0, 2), (0, 3, 2)), Points([(0, 1), (1, 2)])
    cells = lambda s: {f"{r.d0}{r.d1}" for r in coordinates(spark, s, shape).collect()}
    assert cells(left | right) == {"00", "01", "02", "10", "12"}
    assert cells(left & right) == {"12"}
    assert cells(left ^ right) == {"00", "01", "02", "10"}
    assert cells(left - right) == {"00", "02", "10"}
    coords = coordinates(spark, left, shape)
    assert {r.d0 for r in ops.project(coords, 2, [0]).collect()} == {0, 1}
    assert {r.d0 for r in ops.project(coords, 2, [1]).collect()} == {0, 2}
    assert {(r.d0, r.d1) for r in ops.project(coords, 2, [1, 0]).collect()} == {(0, 0), (0, 1), (2, 0), (2, 1)}
    with pytest.raises(SelectionError):
        ops.project(coords, 2, [2])
    for s in (left, right, left | right, Hyperslab((0, 1, 2, 1), Span(0, 2, None, 1)), Nothing(), Everything()):
        assert Selection.decode(s.encode()) == s


def test_linear_bounds(spark):
    shape = Shape((3, 4))
    of = lambda s: tuple(ops.linear_bounds(coordinates(spark, s, shape), shape).first())
    assert of(Everything()) == (0, 11, 12, True)
    assert of(Slices((1, 2), (0, 4))) == (4, 7, 4, True)
    assert of(Slices((0, 3), (1, 2))) == (1, 9, 3, False)
    assert of(Points([(0, 2), (0, 1), (0, 3)])) == (1, 3, 3, True)
    assert of(Points([(0, 1), (0, 1)])) == (1, 1, 2, False)
    assert of(Nothing()) == (None, None, 0, False)


def test_errors(spark, line, plane):
    for s in (Points([(5,)]), Points([(0, 0)]), Slices((0, 6)), Hyperslab((0, 3, 2, 3)), Slices((0, 5, 0))):
        with pytest.raises(SelectionError):
            line.read(s)
    for bad in ((0, 0, 1, 1), (0, 1, 1, 0)):
        with pytest.raises(SelectionError):
            Span(*bad)
    assert ordered(line.read(Hyperslab((0, 0, 0, 0)))) == []
    with pytest.raises(UnsupportedError):
        ops.shift(coordinates(spark, Everything(), plane.shape), Everything(), (1, 0))
    low = ops.shift(coordinates(spark, Slices((0, 2), (0, 3)), plane.shape), Slices((0, 2), (0, 3)), (-1, 0))
    with pytest.raises(Exception, match="below 0"):
        low.collect()


def test_overlapping_blocks(spark):
    a = array(spark, range(10))
    assert ordered(a.read(Hyperslab((0, 1, 3, 2)))) == [0, 1, 1, 2, 2, 3]


def test_no_cap_on_selected_elements(spark):
    n = 1200
    s = Slices((0, n), (0, n)) - Slices((5, 6), (0, n))
    assert coordinates(spark, s, Shape((n, n))).count() == n * n - n


def test_scalar_null_and_fill(spark):
    one = ArrayFrame(spark.createDataFrame([(42,)], "value bigint"), Shape.scalar())
    assert one.numpy() == 42 and one.shape.size == 1
    assert Shape.null().size == 0 and grid(spark, Shape.null()).count() == 0
    a = ArrayFrame(spark.createDataFrame([(0, 2, 5)], "d0 bigint, d1 bigint, value bigint"), Shape((2, 3)), fill=-7)
    assert filled(a).numpy().tolist() == [[-7, -7, 5], [-7, -7, -7]]
    assert a.numpy().tolist() == [[-7, -7, 5], [-7, -7, -7]]


SHAPE = (7, 9)


@st.composite
def boxes(draw):
    out = []
    for d in SHAPE:
        block = draw(st.integers(1, 3))
        stride = draw(st.integers(1, 4))
        start = draw(st.integers(0, d - block))
        count = draw(st.integers(0, 1 + (d - block - start) // stride))
        out.append((start, stride, count, block))
    return Hyperslab(*out)


@settings(max_examples=12, deadline=None)
@given(boxes(), boxes())
def test_blocks_against_numpy(spark, a, b):
    shape, x = Shape(SHAPE), np.arange(63).reshape(SHAPE)
    index = lambda h: np.ix_(*[[s.index(k) for k in range(s.size)] for s in h.spans])
    frame = array(spark, x)
    assert ordered(frame.read(a)) == x[index(a)].ravel().tolist()
    mask = [np.zeros(SHAPE, bool), np.zeros(SHAPE, bool)]
    mask[0][index(a)] = True
    mask[1][index(b)] = True
    for s, m in ((a | b, mask[0] | mask[1]), (a & b, mask[0] & mask[1]), (a ^ b, mask[0] ^ mask[1]), (a - b, mask[0] & ~mask[1])):
        assert ordered(frame.read(s)) == x[m].tolist()
        assert coordinates(spark, s, shape).count() == m.sum()
    if a.bounds(shape):
        at = np.argwhere(mask[0])
        assert a.bounds(shape) == (tuple(at.min(0)), tuple(at.max(0)))


@settings(max_examples=40, deadline=None)
@given(st.tuples(*[st.tuples(st.integers(0, d), st.integers(0, d), st.integers(1, 4)) for d in SHAPE]))
def test_slice_shapes(r):
    s = Slices(*r)
    assert s.output_shape(Shape(SHAPE)) == np.zeros(SHAPE)[tuple(slice(*x) for x in r)].shape
    assert s.hyperslab(Shape(SHAPE)).output_shape(Shape(SHAPE)) == s.output_shape(Shape(SHAPE))


def test_index_notation():
    shape = Shape((4, 5, 6))
    assert from_index(slice(None), shape) == Everything()
    assert from_index((2, ..., slice(1, None, 2)), shape).output_shape(shape) == (1, 5, 3)
    assert from_index((slice(1, 3),), shape).output_shape(shape) == (2, 5, 6)


def test_predicates_reach_the_scan(spark, tiny):
    from tesserae.array import VectorRows

    v = VectorRows(spark.read.parquet(f"{tiny}/embeddings.parquet"), "vec_id", "embedding", Shape((500, 64)))
    plan = v.read(Hyperslab((2, 10, 5, 2), (1, 8, 3, 2)))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(vec_id,2)" in plan and "LessThanOrEqual(vec_id,43)" in plan and "Exchange" not in plan
    assert F is not None
