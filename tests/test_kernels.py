import math

import numpy as np
import pytest

from lanewise import dtypes as D
from lanewise.api import Udf, compile
from lanewise.errors import EvaluationError, ExpressionError
from lanewise.operators.kernel import Masks
from lanewise.sources.arrays import from_arrays, index_range


def run(spark, text, index=None, udfs=None, **arrays):
    df = from_arrays(spark, {k: np.asarray(v) for k, v in arrays.items()})
    return [r.result for r in compile(text, df.schema, udfs=udfs).apply(df, index=index).orderBy("idx").collect()]


BRANCHES = """
# me:fp=strict
def k(x):
    if x > 0:
        y = x
    elif x == 0:
        y = 1
    else:
        y = -x
    return y
"""
LANE_BREAK = "def k(x):\n    acc = 0.0\n    for i in range(5):\n        if x < 0:\n            break\n        if x == 5:\n            continue\n        acc += x\n    return acc\n"


def test_branches(spark):
    assert run(spark, BRANCHES, x=[-1.0, 2.0, 0.0, math.nan])[:3] == [1.0, 2.0, 1.0]


def test_break_and_continue_by_lane(spark):
    assert run(spark, LANE_BREAK, x=[-1.0, 2.0, 5.0, 0.0]) == [0.0, 10.0, 0.0, 0.0]


def test_both_evaluators_agree(spark):
    x = np.array([-1.0, 2.0, 5.0, 0.0, 7.5])
    for text in (BRANCHES, LANE_BREAK):
        kernel = compile(text, {"x": "float64"})
        columns = run(spark, text, x=x)
        assert columns == Masks(kernel, len(x), {"x": x}, None, 100).run().tolist()


def test_global_condition_in_a_loop(spark):
    text = "def k(x):\n    acc = 0.0\n    for i in range(4):\n        acc += 1\n        if any(x > 0):\n            break\n    return acc\n"
    assert run(spark, text, x=[-1.0, 2.0, -3.0, 0.0]) == [1.0] * 4


def test_reduction_of_changing_values_steps_all_rows(spark):
    text = "def k(x):\n    z = x\n    for i in range(20):\n        if all(z > 100):\n            break\n        z = z * 2 + 1\n    return z\n"
    x, z = np.array([1.0, 2.0, 5.0, 0.0]), np.array([1.0, 2.0, 5.0, 0.0])
    for _ in range(20):
        if (z > 100).all():
            break
        z = z * 2 + 1
    assert run(spark, text, x=x) == z.tolist()


def test_while_and_its_limit(spark, monkeypatch):
    text = "def k(x):\n    n = 0\n    while x > n:\n        n += 1\n    return n\n"
    assert run(spark, text, x=[3.0, 0.0, 70.0]) == [3.0, 0.0, 70.0]
    monkeypatch.setenv("LANEWISE_WHILE_LIMIT", "10")
    with pytest.raises(Exception, match="iterations"):
        run(spark, text, x=[70.0])


def test_ranges_by_lane(spark):
    text = "def k(n, m):\n    acc = n * 0\n    for i in range(n, m, 2):\n        acc += i\n    return acc\n"
    assert run(spark, text, n=np.array([0, 5, 3], np.int64), m=np.array([10, 5, 4], np.int64)) == [20, 0, 3]
    with pytest.raises(Exception, match="step of 0"):
        run(spark, "def k(n):\n    acc = n\n    for i in range(0, 100, n):\n        acc += i\n    return acc\n", n=np.array([0, 1], np.int64))


def test_casts_and_locals(spark):
    assert run(spark, "def k(x):\n    a = int(x)\n    b = bool(a)\n    c = float(a) / 2\n    return c + b\n", x=[3.7, -0.5]) == [2.5, 0.0]
    assert run(spark, "def k(x):\n    y = x\n    y -= 1\n    y *= 3\n    y //= 2\n    return y\n", x=[4.0, 2.0]) == [4.0, 1.0]


def test_text_kernels(spark):
    text = "def k(a):\n    if contains(a, 'yes'):\n        return 'positive: ' + a\n    return a\n"
    assert run(spark, text, a=np.array(["yes x", "no", "yes y"], "<U8")) == ["positive: yes x", "no", "positive: yes y"]
    assert compile(text, {"a": "str[8]"}).dtype.width == 18
    assert run(spark, "def k(name):\n    if name:\n        return 1\n    return 0\n", name=np.array(["alpha", "b", "", "z"], "<U8")) == [1, 1, 0, 1]


def test_missing_return(spark):
    text = "def k(x):\n    if x > 0:\n        return x\n"
    assert run(spark, text, x=[1.0, 2.0]) == [1.0, 2.0]
    with pytest.raises(Exception, match="without a return"):
        run(spark, text, x=[1.0, -2.0])


def test_udf_in_a_loop(spark):
    twice = Udf("twice", lambda s: s * 2, D.FLOAT64, 1)
    text = "def k(x):\n    y = x\n    while y < 100:\n        y = twice(y)\n    return y\n"
    assert run(spark, text, x=[1.0, 30.0], udfs=[twice]) == [128.0, 120.0]


def test_index_symbols(spark):
    df = index_range(spark, 4)
    kernel = compile("def k():\n    return _flat_idx * 10 + _n0 + _ndim\n", {})
    assert [r.result for r in kernel.apply(df, index="idx").orderBy("idx").collect()] == [5, 15, 25, 35]
    with pytest.raises(Exception, match="flat index"):
        kernel.apply(df)


def test_print(spark, capsys):
    run(spark, "def k(x):\n    print('total {} of {}', sum(x), 2)\n    print('plain')\n    return x\n", x=[1.0, 2.0])
    assert capsys.readouterr().out.splitlines() == ["total 3.0 of 2.0", "plain"]
    with pytest.raises(EvaluationError):
        run(spark, "def k(x):\n    print(x)\n    return x\n", x=[1.0, 2.0])


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(0, None), (1, 2.0)], "idx bigint, x double")
    for text in (BRANCHES, "def k(x):\n    y = x\n    while y < 9:\n        y += 1\n    return y\n"):
        assert compile(text, df.schema).apply(df).orderBy("idx").first().result is None


def test_nulls_whatever_the_loop(spark):
    """A null in any parameter, read or not, gives null; unrolled or interpreted, with or without branches."""
    df = spark.createDataFrame([(0, 1.0, None), (1, 2.0, 5.0), (2, None, 5.0)], "idx bigint, x double, y double")
    for trips in (2, 60):
        out = compile(f"def k(x, y):\n    n = 0.0\n    for i in range({trips}):\n        if x < 0:\n            n += y\n        n += 1\n    return n\n", df.schema).apply(df)
        assert [r.result for r in out.orderBy("idx").collect()] == [None, trips, None]
    out = compile("def k(x, y):\n    if x > 0:\n        return x\n    return y\n", df.schema).apply(df)
    assert [r.result for r in out.orderBy("idx").collect()] == [None, 2.0, None]


def test_print_in_branches(spark, capsys):
    text = "def k(x):\n    if x > 5:\n        print('high {}', max(x))\n    else:\n        print('low')\n    y = 0.0\n    while y < x:\n        y += 1\n    return y\n"
    run(spark, text, x=[1.0, 2.0])
    assert capsys.readouterr().out.splitlines() == ["low"]
    run(spark, text, x=[1.0, 7.0])
    assert capsys.readouterr().out.splitlines() == ["high 7.0", "low"]


@pytest.mark.parametrize(
    "text",
    [
        "def k(x):\n    y = x; z = y\n    return z\n", "def k(x):\n    if x > 0:\n        y = sum(x)\n    return x\n", "def k(x):\n    for i in range(3):\n        y = max(x)\n    return x\n",
        "def k(x):\n    x = 1\n    return x\n", "def k(x):\n    y = x\n", "def k(x):\n    return x\n    def j(y):\n        return y\n", "def k(x, x):\n    return x\n", "def k(x):\n    break\n    return x\n",
        "def k(x):\n    y = 1.5\n    y = x > 0\n    return y\n", "def k(x):\n    if x > 0:\n        return x > 0\n    return x\n", "def k(x):\n    for i in range():\n        y = 1\n    return x\n",
        "def k(x):\n    print('{} {}', 1)\n    return x\n", "# me:fp=loose\ndef k(x):\n    return x\n", "# me:fp=fast\n# me:fp=fast\ndef k(x):\n    return x\n", "def k(x):\nreturn x\n", "def k(x):\n    else:\n        y = 1\n    return x\n",
        "def k(x):\n    _n0 = 1\n    return x\n", "def k(x):\n    while x > 0:\n    return x\n", "def k(x):\n    return x\ny = 1\n", "def k(x):\n    for x in range(3):\n        y = 1\n    return x\n", "def k(z):\n    return z\n", "def k(x):\n    break if x > 0\n    return x\n",
    ],
)
def test_refused(text):
    with pytest.raises(ExpressionError):
        compile(text, {"x": "float64"})


def test_trailing_semicolon_is_fine(spark):
    assert run(spark, "def k(x):\n    y = x + 1;\n    return y\n", x=[1.0]) == [2.0]


def test_mandelbrot_agrees_with_numpy(spark):
    text = "def k(cr, ci):\n    zr = 0.0\n    zi = 0.0\n    n = 0.0\n    for i in range(100):\n        if zr*zr + zi*zi > 4:\n            break\n        t = zr*zr - zi*zi + cr\n        zi = 2*zr*zi + ci\n        zr = t\n        n += 1\n    return n\n"
    cr, ci = (g.ravel() for g in np.meshgrid(np.linspace(-2, 1, 24), np.linspace(-1, 1, 16)))
    z, n, live = np.zeros(len(cr), complex), np.zeros(len(cr)), np.ones(len(cr), bool)
    for _ in range(100):
        live &= ~(z.real**2 + z.imag**2 > 4)
        z = np.where(live, z * z + (cr + 1j * ci), z)
        n += live
    assert run(spark, text, cr=cr, ci=ci) == n.tolist()
