import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise import dtypes as D
from lanewise.api import Udf, agg, compile, evaluate, where
from lanewise.errors import ComplexRefused, ExpressionError, ReductionRefused, SyntaxRefused, TypeRefused, VariableRefused
from lanewise.functions import special
from lanewise.operators.vector import Vector
from lanewise.sources.arrays import from_arrays

NAN, INF = math.nan, math.inf


def values(df, text, out="auto", udfs=None, index="idx"):
    return [r["result"] for r in evaluate(df, text, out=out, udfs=udfs).orderBy(index).collect()]


def frame(spark, **arrays):
    return from_arrays(spark, {k: np.asarray(v) for k, v in arrays.items()})


def same(got, want):
    return all((a is None and b is None) or (isinstance(b, float) and math.isnan(b) and math.isnan(a)) or a == pytest.approx(b, rel=1e-12, abs=1e-300) for a, b in zip(got, want, strict=True))


def test_precedence(spark):
    one = spark.range(1).toDF("idx")
    for text, want in {
        "-2**2": 4, "2**3**2": 64, "2 + 3 * 4": 14, "1 < 2 < 1": False, "7 & 3 == 3": 1, "1 | 2 ^ 3 & 2": 1, "10 - 4 - 3": 3, "not 0 == 0": False, "~0": -1, "1 << 2 + 1": 8, "(1, 5)": 5, "7 / 2": 3, "7 / 2.0": 3.5, "-7 % 3": -1, "sqrt 16.0 + 1": 5.0, "sin(0.0)**2 + cos(0.0)**2": 1.0,
    }.items():
        got = evaluate(one, text).first()["result"]
        assert (bool(got) if isinstance(want, bool) else got) == want, text


@pytest.mark.parametrize("text", ["1 +", "(1", "foo", "atan2(1)", "'abc", "a $ b", "1 2", "fmax(1, 2, 3)", "'\\q' == 'x'"])
def test_refused_syntax(text):
    with pytest.raises(SyntaxRefused):
        compile(text, {"a": "int32", "b": "int32"})


def test_modes_of_types():
    assert compile("a + b", {"a": "int32", "b": "float64"}).dtype == D.FLOAT64
    assert compile("a + b", {"a": "auto", "b": "auto"}, "float32").dtype == D.FLOAT32
    assert compile("a + b", {"a": "int32", "b": "float64"}, "float32").dtype == D.FLOAT32
    with pytest.raises(VariableRefused):
        compile("a + b", {"a": "auto", "b": "auto"})
    with pytest.raises(VariableRefused):
        compile("a + b", {"a": "auto", "b": "int32"}, "int32")


def test_literals_lean_to_the_first_variable():
    assert compile("a + 1", {"a": "int8"}).dtype == D.INT8
    assert compile("a + 1.5", {"a": "int8"}).dtype == D.FLOAT64
    assert compile("a * 2.5", {"a": "float32"}).dtype == D.FLOAT32
    assert compile("a + 3000000000", {"a": "int32"}).dtype == D.INT64
    assert compile("1 + 1", {}).dtype == D.INT32


def test_result_types():
    names = {"i": "int32", "f": "float32", "d": "float64", "b": "bool", "u": "uint8", "z": "complex64"}
    for text, want in {
        "log(i)": "float64", "ceil(i)": "int32", "log(f)": "float32", "i < d": "bool", "where(b, i, f)": "float64", "hypot(i, i)": "int32", "sum(i)": "int64", "sum(u)": "uint64", "sum(f)": "float32",
        "mean(f)": "float64", "mean(z)": "complex128", "min(u)": "uint8", "any(d)": "bool", "abs(z)": "float32", "b & b": "bool", "b and i": "bool", "prod(b)": "int64", "real(z)": "float32", "-u": "uint8",
    }.items():
        assert compile(text, {k: v for k, v in names.items() if k in text or True}).dtype.name == want, text


def test_bit_operators(spark):
    a, b = [15, 7, 255, 128, 0, 12, 3, 6, 9, 31], [7, 15, 15, 64, 0, 10, 1, 2, 3, 16]
    df = frame(spark, a=np.array(a, np.int32), b=np.array(b, np.int32))
    assert values(df, "a & b") == [x & y for x, y in zip(a, b)]
    assert values(df, "a | b") == [x | y for x, y in zip(a, b)]
    assert values(df, "a ^ b") == [x ^ y for x, y in zip(a, b)]
    s = frame(spark, a=np.array([1, 2, 3, 4, 5, 8, 16, 32, 64, 128], np.int32), b=np.array([1, 2, 3, 1, 2, 1, 1, 1, 1, 1], np.int32))
    assert values(s, "a << b") == [2, 8, 24, 8, 20, 16, 32, 64, 128, 256]
    assert values(s, "a >> b") == [0, 0, 0, 2, 1, 4, 8, 16, 32, 64]


def test_bool_operators(spark):
    a, b = [True, False, True, False], [True, True, False, False]
    df = frame(spark, a=np.array(a), b=np.array(b))
    assert values(df, "a & b") == [True, False, False, False]
    assert values(df, "a ^ b") == [False, True, True, False]
    assert values(df, "~a") == [False, True, False, True]
    assert values(df, "a or not b") == [True, False, True, True]


EDGES = [0.0, -0.0, 1.0, -1.0, 2.5, -2.5, INF, -INF, NAN, 1e300]


def test_ieee_pairs_against_numpy(spark):
    """Every pair of edge values, for each operator, against the NumPy evaluator."""
    a, b = map(np.array, zip(*[(x, y) for x in EDGES for y in EDGES]))
    df = frame(spark, a=a, b=b)
    for text in ["a / b", "a % b", "a + b", "a - b", "a * b", "a < b", "a <= b", "a > b", "a >= b", "a == b", "a != b", "fmax(a, b)", "fmin(a, b)", "fdim(a, b)", "hypot(a, b)", "copysign(a, b)", "where(a > b, a, b)", "a and b", "not a", "log(a)", "log1p(a)", "log2(a)", "log10(a)", "floor(a)", "ceil(a)", "trunc(a)", "round(a)", "rint(a)", "sign(a)", "sqrt(a)", "cbrt(a)", "abs(a)", "exp(a)", "expm1(a)", "acos(a)", "atanh(a)", "acosh(a)"]:
        compiled = compile(text, df.schema)
        with np.errstate(all="ignore"):
            want = Vector(len(a), {"a": a, "b": b}).run(compiled.tree).tolist()
        assert same(values(df, text), want), text


def test_copysign_keeps_the_sign_of_zero(spark):
    df = frame(spark, a=np.array([1.0, -0.0, INF, -INF]))
    got = values(df, "copysign(3.0, a)")
    assert got == [3.0, -3.0, 3.0, -3.0]
    assert [str(x) for x in values(df, "copysign(0.0, a)")] == ["0.0", "-0.0", "0.0", "-0.0"]


@pytest.mark.parametrize("kind", ["int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64"])
def test_integers_wrap_like_numpy(spark, kind):
    low, high = D.limits(D.dtype(kind))
    edge = np.array([low, high, 0, 1, 2, 7, high // 2, max(low, -3) if low < 0 else 3], kind)
    a, b = map(np.array, zip(*[(x, y) for x in edge for y in edge]))
    df = frame(spark, a=a.astype(kind), b=b.astype(kind))
    for text in ["a + b", "a - b", "a * b", "-a", "a / b", "a & b", "a | b", "a ^ b", "~a", "a < b", "a == b", "abs(a)", "a ** 2"]:
        compiled = compile(text, df.schema)
        with np.errstate(all="ignore"):
            want = Vector(len(a), {"a": a.astype(kind), "b": b.astype(kind)}).run(compiled.tree).tolist()
        assert [int(x) for x in values(df, text)] == [int(x) for x in want], (kind, text)


def test_conversions(spark):
    df = frame(spark, x=np.array([1.9, -1.9, 300.0, -300.0, 1e20, NAN, 0.0]))
    assert values(df, "x", "int32") == [1, -1, 300, -300, 2147483647, 0, 0]
    assert values(df, "x", "int8") == [1, -1, 127, -128, 127, 0, 0]
    assert values(df, "x", "uint8") == [1, 0, 255, 0, 255, 0, 0]
    assert values(df, "x", "int64")[4] == 9223372036854775807
    assert values(df, "x", "bool") == [True, True, True, True, True, True, False]
    whole = frame(spark, i=np.array([300, -1, 70000], np.int32))
    assert values(whole, "i", "int8") == [44, -1, 112]
    assert values(whole, "i", "uint16") == [300, 65535, 4464]


def test_nulls_pass_through(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, 2.0, None), (2, 3.0, 0.0)], "idx bigint, a double, b double")
    for text in ["a + b", "a / b", "a % b", "log(a) * b", "where(a > b, a, b)", "fmax(a, b)", "erf(a) + b", "sign(a) + b", "copysign(a, b)"]:
        assert values(df, text)[:2] == [None, None], text


def test_floats_of_32_bits(spark):
    """Neighbours, and sums of products rounded once, as floats have them."""
    r = np.random.default_rng(4)
    a, b, c = (r.normal(size=400).astype(np.float32) * np.float32(10) ** r.integers(-3, 4, 400).astype(np.float32) for _ in range(3))
    df = frame(spark, a=a, b=b, c=c)
    assert values(df, "nextafter(a, b)") == np.nextafter(a, b).tolist()
    exact = [np.float32(v) for v in (rounded_once(Fraction(float(x)) * Fraction(float(y)) + Fraction(float(z))) for x, y, z in zip(a, b, c))]
    assert values(df, "fma(a, b, c)") == [float(v) for v in exact]
    names = {k: D.dtype("float32") for k in "abc"}
    for text in ("nextafter(a, b)", "fma(a, b, c)", "remainder(a, b)"):
        tree = compile(text, names).tree
        assert Vector(400, {"a": a, "b": b, "c": c}).run(tree).tolist() == values(df, text), text


def test_remainder_of_doubles(spark):
    sizes = [0.0, -0.0, 5e-324, 1e-310, 0.5, 1.0, 1.5, 2.5, -3.5, 7.0, 1e17, 1.7e308, -1.7e308, INF, -INF, NAN]
    a, b = (np.array(v) for v in zip(*[(x, y) for x in sizes for y in sizes]))
    df = frame(spark, a=a, b=b)
    want = [NAN if math.isnan(x) or math.isnan(y) or math.isinf(x) or y == 0 else math.remainder(x, y) for x, y in zip(a.tolist(), b.tolist())]
    got = values(df, "remainder(a, b)")
    assert all((math.isnan(g) and math.isnan(w)) or (g == w and math.copysign(1, g) == math.copysign(1, w)) for g, w in zip(got, want)), [x for x in zip(a, b, got, want) if x[2] != x[3]][:5]


def rounded_once(x):
    """The float of 24 bits nearest to a fraction, ties to even."""
    if not x:
        return 0.0
    scale = 0
    while abs(x) * Fraction(2) ** scale < 1 << 23:
        scale += 1
    while abs(x) * Fraction(2) ** scale >= 1 << 24:
        scale -= 1
    return float(Fraction(round(x * Fraction(2) ** scale)) / Fraction(2) ** scale)


def test_special_functions(spark):
    x = [-2.5, -1.0, -0.0, 0.0, 0.5, 3.0, 171.0, 172.0, INF, -INF, NAN]
    df = frame(spark, x=np.array(x))
    for name in ("erf", "erfc", "lgamma", "tgamma"):
        assert same(values(df, f"{name}(x)"), special.VECTOR[name](np.array(x))), name
    assert same(special.VECTOR["tgamma"](np.array(x)), [math.gamma(-2.5), NAN, -INF, INF, math.gamma(0.5), 2.0, math.gamma(171.0), INF, INF, NAN, NAN])
    assert same(special.VECTOR["lgamma"](np.array(x)), [math.lgamma(-2.5), INF, INF, INF, math.lgamma(0.5), math.log(2.0), math.lgamma(171.0), math.lgamma(172.0), INF, INF, NAN])
    ramp = np.concatenate([np.linspace(-7, 7, 501), [0.46875, 4.0, 26.0, 30.0]])
    df = frame(spark, x=ramp)
    for name, exact in (("erf", math.erf), ("erfc", math.erfc)):
        assert same(values(df, f"{name}(x)"), [exact(v) for v in ramp]), name
    pairs = [(5, 2, 10), (10, 3, 120), (8, 3, 56), (6, 2, 15), (7, 3, 35), (9, 4, 126), (4, 2, 6), (12, 5, 792), (15, 7, 6435), (20, 10, 184756)]
    df = frame(spark, n=np.array([float(p[0]) for p in pairs]), r=np.array([float(p[1]) for p in pairs]))
    assert values(df, "ncr(n, r)") == [float(p[2]) for p in pairs]
    assert values(df, "npr(n, 1.0)") == [float(p[0]) for p in pairs]
    f = frame(spark, n=np.array([0.0, 5.9, 20.0, 21.0, -1.0]))
    assert same(values(f, "fac(n)"), [1.0, 120.0, 2432902008176640000.0, INF, NAN])


def test_java_backed_functions(spark):
    df = frame(spark, x=np.array([5.0, -5.0, 2.5]))
    assert values(df, "remainder(x, 3.0)") == [-1.0, 1.0, -0.5]
    assert values(df, "nextafter(x, 100.0)") == [math.nextafter(v, 100) for v in (5.0, -5.0, 2.5)]
    assert values(df, "fma(x, 2.0, 1.0)") == [11.0, -9.0, 6.0]
    assert values(df, "ldexp(x, 2.0)") == [20.0, -20.0, 10.0]


def test_rewrites():
    assert compile("x**2", {"x": "float64"}).tree.op == "mul"
    assert compile("x + (-2)", {"x": "uint8"}).tree.op == "sub"
    assert compile("1 + 2", {}).tree.op == "const"


def test_complex(spark):
    z = np.array([3 + 4j, 1 + 1j, -2 + 0.5j, 0.25 - 3j, 5, -1.5 - 2.5j, 2j, 7 - 1j, -0.5 + 0.5j, 2.5 + 3.7j])
    df = frame(spark, z=z)
    as_complex = lambda xs: np.array([complex(x["re"], x["im"]) for x in xs])
    for text, want in {"1.0 / z": 1 / z, "z / 2.0": z / 2, "z * z": z * z, "conj(z)": z.conj(), "sqrt(z)": np.sqrt(z), "-z": -z, "z ** 3.0": z**3, "z - 1.0": z - 1}.items():
        assert np.allclose(as_complex(values(df, text)), want, rtol=1e-12), text
    assert np.allclose(values(df, "abs(z)"), np.abs(z)) and values(df, "imag(z)") == z.imag.tolist()
    row = df.agg(agg("sum(z)", df.schema).alias("s"), agg("mean(z)", df.schema).alias("m"), agg("prod(z)", df.schema).alias("p")).first()
    for got, want in ((row.s, z.sum()), (row.m, z.mean()), (row.p, z.prod())):
        assert np.allclose(complex(got["re"], got["im"]), want, rtol=1e-9)
    with pytest.raises(ComplexRefused):
        compile("z < z", df.schema)
    with pytest.raises(ReductionRefused):
        compile("min(z)", df.schema)


def test_udfs(spark):
    df = frame(spark, x=np.array([-0.5, 0.0, 0.25, 1.0, 1.5]))
    clamp = Udf("clamp01", lambda s: s.clip(0, 1), D.FLOAT64, 1)
    assert values(df, "clamp01(x)", udfs=[clamp]) == [0.0, 0.0, 0.25, 1.0, 1.0]
    scale = Udf("scale", (lambda k: lambda c: c * F.lit(k))(2.5), D.FLOAT64, 1, vector=False)
    assert values(df, "scale(x) + 1", udfs=[scale]) == [-0.25, 1.0, 1.625, 3.5, 4.75]
    shadow = Udf("sin", lambda s: s * 0 + 7, D.INT32, 1)
    assert values(df, "sin(x)", udfs=[shadow]) == [7] * 5


def test_long_and_deep_expressions(spark):
    """Plans grow with the text, not with the power of its depth."""
    x = np.array([2**63 - 1, -(2**63), 5, 0])
    df = frame(spark, x=x, y=np.array([3.5, -0.0, 1e300, NAN]))
    with np.errstate(all="ignore"):
        for text in [" + ".join(["x"] * 40), "-(x - x * 3) - -x * x", "x * x * x * x * x * x", " - ".join(["x * 7"] * 12)]:
            compiled = compile(text, df.schema)
            assert values(df, text) == Vector(4, {"x": x}).run(compiled.tree).tolist(), text
        y = np.array([3.5, -0.0, 1e300, NAN])
        for text in ["y" + " / (1 + y" * 9 + ")" * 9, "y / y" + " / y % 3" * 8, "log(1 + " * 10 + "abs(y)" + ")" * 10, "floor(y / 3) + fmax(fmax(fmax(fmax(y, 1), y / 2), 3), -y)"]:
            compiled = compile(text, df.schema)
            assert same(values(df, text), Vector(4, {"y": y}).run(compiled.tree).tolist()), text


def test_errors_have_codes():
    for text, names, code in (("1 +", {}, -2), ("a", {"a": "auto"}, -7), ("a + b", {"a": "auto", "b": "int8"}, -7), ("sum(sum(a))", {"a": "int8"}, -5), ("z < z", {"z": "complex64"}, -4), ("sin(s)", {"s": "str"}, -8)):
        with pytest.raises(ExpressionError) as e:
            compile(text, names)
        assert e.value.code == code
    with pytest.raises(ExpressionError) as e:
        compile("a + b", {"a": "auto", "b": "int8"}, "float64")
    assert e.value.code == -6
    with pytest.raises(SyntaxRefused) as e:
        compile("1 + $", {})
    assert e.value.position == 4


def test_explain():
    assert compile("a + 1", {"a": "int8"}).explain().splitlines() == ["add: int8", "  var a: int8", "  1: int8"]


def test_filter_and_composition(spark):
    df = frame(spark, x=np.arange(10.0))
    assert where(df, "x > mean(x)").count() == 5
    assert where(df, "x > 7").count() == 2
    with pytest.raises(TypeRefused):
        where(df, "x + 1")
    plan = compile("x > 7", df.schema).filter(df)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_pushdown_reaches_the_scan(spark, tmp_path):
    frame(spark, x=np.arange(100.0), y=np.arange(100.0)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = where(df, "x > 7").select("x")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,7.0)" in plan and "ReadSchema: struct<x:double>" in plan


def test_result_does_not_depend_on_partitions(spark):
    n = 40_000
    df = spark.range(n).select(F.col("id").alias("idx"), (F.col("id") * 0.1).alias("a"), ((n - F.col("id")) * 0.05).alias("b"))
    one, many = (evaluate(df.repartition(k), "sqrt(a*a + b*b) - min(a)").agg(F.sum("result"), F.max("result")).first() for k in (1, 16))
    assert one[0] == pytest.approx(many[0], rel=1e-12) and one[1] == many[1]


def test_integers_that_meet_in_doubles_wrap_in_an_integer_output(spark):
    """A literal of an unsigned output is unsigned, and meets int64 in float64 only."""
    keys = np.array([0, 21845, 21846, -1, 899_999, 2**61 + 5, -(2**63)], np.int64)
    df = frame(spark, k=keys, u=np.array([1, 2, 3, 4, 255, 6, 7], np.uint8))
    k, u = keys.tolist(), [1, 2, 3, 4, 255, 6, 7]
    for text, kind, want in [
        ("k * 3", "uint16", [x * 3 for x in k]), ("-(k + 7) * u", "uint8", [-(x + 7) * y for x, y in zip(k, u)]), ("where(u > 2, k, u) - 1", "uint32", [(x if y > 2 else y) - 1 for x, y in zip(k, u)]),
        ("k ** 2", "uint16", [x * x for x in k]), ("def f(k):\n    return k * 3\n", "uint16", [x * 3 for x in k]), ("def f(k):\n    n = 0\n    while n < 2:\n        n += 1\n    return k * 3\n", "uint16", [x * 3 for x in k]),
    ]:
        assert values(df, text, kind) == [x % (1 << int(kind[4:])) for x in want], text
    assert values(df, "k * 3.0", "uint16") == [0, 65535, 65535, 0, 65535, 65535, 0]
    assert compile("k * 3", {"k": "int64"}, "float64").tree.op == "mul" and compile("k + u", {"k": "int64", "u": "uint8"}).dtype == D.FLOAT64
