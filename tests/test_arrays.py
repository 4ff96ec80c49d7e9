import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.errors import EvaluationError, VariableRefused
from lanewise.operators.nd import NdSpec, compile_nd
from lanewise.sources.arrays import from_arrays, index_range


def test_valid_items_of_all_blocks(spark):
    spec = NdSpec((310, 305, 299), (200, 180, 170), (90, 90, 90))
    rows = spec.grid(spark).collect()
    assert sum(r.valid for r in rows) == spec.size
    for r in rows[::7]:
        assert r.valid == spec.valid_items(r.chunk, r.block)


def test_padded_outputs(spark):
    spec = NdSpec((3, 5), (2, 4), (1, 3))
    assert spec.valid_items(3, 0) == 1
    df = index_range(spark, spec).withColumn("x", F.col("idx").cast("double"))
    got = {(r.chunk, r.block, r["item"]): r.v for r in compile_nd("x + 1", df.schema, spec).padded(df, "idx", "v").collect()}
    assert len(got) == 4 * 4 * 3
    assert [got[3, 0, i] for i in range(3)] == [15.0, 0.0, 0.0]


def test_index_symbols(spark):
    spec = NdSpec((3, 4, 5), (2, 3, 4), (2, 2, 3))
    df = index_range(spark, spec)
    kernel = compile_nd("def k():\n    return _i0 + _i1 + _i2 + _n0 + _n1 + _n2 + _ndim + _i5 + _n5\n", {}, spec)
    got = [r.result for r in kernel.apply(df, "idx").orderBy("idx").collect()]
    assert got == [i + j + k + 3 + 4 + 5 + 3 + 1 for i in range(3) for j in range(4) for k in range(5)]
    ramp = compile_nd("def k():\n    return _i0 * _n1 * _n2 + _i1 * _n2 + _i2\n", {}, spec)
    assert ramp.apply(df, "idx").filter("result <> idx").count() == 0


def test_block_reductions(spark):
    spec = NdSpec((3,), (3,), (2,))
    df = from_arrays(spark, {"x": np.array([0, 2, 3], np.int32)})
    for text, want in {"sum(x)": [2, 3], "sum(x > 1)": [1, 1], "any(x == 2)": [True, False], "all(x == 2)": [False, False], "mean(x)": [1.0, 3.0]}.items():
        assert [r.result for r in compile_nd(text, df.schema, spec).blocks(df, "idx").orderBy("block").collect()] == want, text
    mixed = compile_nd("x - min(x)", df.schema, spec).apply(df, "idx")
    assert [r.result for r in mixed.orderBy("idx").collect()] == [0, 2, 0]


def test_kernel_reductions_cover_a_block(spark):
    spec = NdSpec((6,), (6,), (2,))
    df = from_arrays(spark, {"x": np.array([1.0, 5.0, 2.0, 9.0, 4.0, 4.0])})
    kernel = compile_nd("def k(x):\n    top = max(x)\n    if any(x > 8):\n        y = x / top\n    else:\n        y = x - top\n    return y\n", df.schema, spec)
    assert [r.result for r in kernel.apply(df, "idx").orderBy("idx").collect()] == [-4.0, 0.0, 2 / 9, 1.0, 0.0, 0.0]


def test_blocks_without_elements(spark):
    spec = NdSpec((3,), (4,), (2,))
    assert spec.valid_items(0, 1) == 1
    wide = NdSpec((5,), (4,), (2,))
    df = from_arrays(spark, {"x": np.ones(5)})
    rows = {(r.chunk, r.block): r for r in compile_nd("mean(x)", df.schema, wide).blocks(df, "idx").collect()}
    assert rows[1, 1].valid == 0 and math.isnan(rows[1, 1].result)
    rows = {(r.chunk, r.block): r for r in compile_nd("prod(x) + min(x)", df.schema, wide).blocks(df, "idx").collect()}
    assert rows[1, 1].result == 0.0 and rows[1, 0].result == 2.0


def test_refused(spark):
    with pytest.raises(VariableRefused):
        NdSpec((3,), (0,), (1,))
    with pytest.raises(VariableRefused):
        NdSpec((3, 3), (1,), (1,))
    with pytest.raises(EvaluationError):
        NdSpec((0, 3), (1, 1), (1, 1)).valid_items(0, 0)
    with pytest.raises(EvaluationError):
        NdSpec((3,), (3,), (2,)).valid_items(0, 5)


def test_array_round_trip(spark):
    arrays = {"u": np.array([0, 255], np.uint8), "w": np.array([0, 2**64 - 1], np.uint64), "f": np.array([1.5, math.nan], np.float32), "z": np.array([1 + 2j, 3], np.complex64), "s": np.array(["a", "bc"], "<U4"), "b": np.array([b"x", b""], "S2")}
    rows = from_arrays(spark, arrays).orderBy("idx").collect()
    assert [r.u for r in rows] == [0, 255] and int(rows[1].w) == 2**64 - 1 and math.isnan(rows[1].f) and rows[0].z["im"] == 2 and rows[1].s == "bc" and bytes(rows[0].b) == b"x"
