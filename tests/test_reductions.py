import math

import numpy as np
import pytest

from lanewise.api import agg, compile, evaluate
from lanewise.errors import ReductionRefused
from lanewise.operators.vector import reduce
from lanewise import dtypes as D
from lanewise.sources.arrays import from_arrays

KINDS = ["bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64"]
NAMES = ["sum", "mean", "prod", "min", "max", "any", "all"]


@pytest.mark.parametrize("kind", KINDS)
def test_all_types(spark, kind):
    x = np.array([1, 2, 3, 4, 100, 7], kind)
    df = from_arrays(spark, {"x": x}).repartition(3)
    row = df.agg(*[agg(f"{n}(x)", df.schema).alias(n) for n in NAMES]).first()
    for n in NAMES:
        assert float(row[n]) == pytest.approx(float(reduce(n, x, D.dtype(kind))), rel=1e-6), (kind, n)


@pytest.mark.parametrize("kind", KINDS)
def test_empty(spark, kind):
    df = from_arrays(spark, {"x": np.array([1], kind)}).filter("idx < 0")
    row = df.agg(*[agg(f"{n}(x)", df.schema).alias(n) for n in NAMES]).first()
    for n in NAMES:
        want = float(reduce(n, np.zeros(0, kind), D.dtype(kind)))
        got = float(row[n])
        assert got == want or math.isnan(got) and math.isnan(want), (kind, n)


def test_nan_propagates(spark):
    for kind in ("float32", "float64"):
        df = from_arrays(spark, {"x": np.array([1, math.nan, 2], kind)})
        row = df.agg(*[agg(f"{n}(x)", df.schema).alias(n) for n in ("min", "max", "sum", "mean")], agg("any(x)", df.schema).alias("any")).first()
        assert all(math.isnan(row[n]) for n in ("min", "max", "sum", "mean")) and row["any"]


@pytest.mark.parametrize("kind", ["int64", "uint64", "int32"])
def test_wrapping_sum_and_product(spark, kind):
    x = np.array([3, 5, 2**31 - 1, 7, 11, 2**31 - 3, 12, -9 if kind != "uint64" else 9] * 3, kind)
    df = from_arrays(spark, {"x": x}).repartition(4)
    row = df.agg(agg("prod(x)", df.schema).alias("p"), agg("sum(x)", df.schema).alias("s")).first()
    with np.errstate(over="ignore"):
        wide = np.uint64 if kind == "uint64" else np.int64
        assert int(row.p) == int(np.prod(x.astype(wide))) and int(row.s) == int(np.sum(x.astype(wide)))


def test_inside_expressions(spark):
    df = from_arrays(spark, {"x": np.array([1.0, 2.0, 3.0])})
    assert [r.result for r in evaluate(df, "x + sum(x)").orderBy("idx").collect()] == [7.0, 8.0, 9.0]
    assert evaluate(df, "sum(x) + min(x)").collect()[0].result == 7.0
    assert compile("sum(x) + min(x)", df.schema).is_scalar and not compile("x + sum(x)", df.schema).is_scalar
    assert evaluate(df, "sum(x > 1)").first().result == 2


def test_conditional_sum(spark):
    i = np.arange(1000)
    a, b = (i / 999).astype(np.float32), ((999 - i) / 999).astype(np.float32)
    df = from_arrays(spark, {"a": a, "b": b})
    assert evaluate(df, "sum(where(a < b, b, a))").first().result == pytest.approx(float(np.where(a < b, b, a).astype(float).sum()), rel=1e-6)


def test_groups(spark):
    df = from_arrays(spark, {"k": np.array([0, 0, 1], np.int32), "x": np.array([1.0, 2.0, 5.0])})
    got = {r.k: r.s for r in df.groupBy("k").agg(agg("sum(x * 2) + max(x)", df.schema).alias("s")).collect()}
    assert got == {0: 8.0, 1: 15.0}


def test_refused():
    for text in ("sum(sum(x))", "sum(x + min(x))"):
        with pytest.raises(ReductionRefused):
            compile(text, {"x": "float64"})
    with pytest.raises(Exception):
        compile("sum(s)", {"s": "str"})
    with pytest.raises(ReductionRefused):
        compile("x + sum(x)", {"x": "float64"}).aggregate()
