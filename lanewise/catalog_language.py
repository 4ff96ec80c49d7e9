"""Further registered queries: statements and refusals of the language, types of every size, callers' functions."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import dtypes as D
from lanewise.api import Udf, agg, compile, version
from lanewise.catalog import LINE, kernel, register, rounded, rows, table, totals
from lanewise.errors import EvaluationError, ExpressionError
from lanewise.sources.arrays import data_bound, index_range, varlen


def values(spark: SparkSession, found: list[tuple], names: str) -> DataFrame:
    return spark.createDataFrame(found, names)


def listed(name: str, names: str, find, want: list[tuple]) -> None:
    """A query of rows that ``find`` makes from a session, beside SQL that states them."""
    columns = ", ".join(c.split()[0] for c in names.split(", "))
    shown = ", ".join("(" + ", ".join("NULL" if v is None else f"{v}::BIGINT" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in want)
    register(name, lambda spark, sf_dir: values(spark, find(spark), names), f"SELECT * FROM (VALUES {shown}) t({columns})")


# Constants, lists, kernels' statements

rows("constants_and_lists", "lineitem", LINE, {"p": "pi * l_tax", "x": "e ** 2.0 + l_tax", "last": "(l_tax, l_discount, l_quantity * 2)"}, {"p": "pi() * l_tax", "x": "exp(2) + l_tax", "last": "l_quantity * 2"}, digits=6)
kernel(
    "kernel_header", "lineitem", LINE,
    "# me:fp=strict\n# me:compiler=tcc\ndef k(l_quantity,\n      l_tax):\n    # the sum, doubled\n    y = (l_quantity +\n         l_tax);\n    return y * 2;\n",
    "SELECT l_orderkey, l_linenumber, round((l_quantity + l_tax) * 2, 6) AS result FROM lineitem",
)
kernel(
    "kernel_augmented", "lineitem", LINE,
    "def k(l_quantity, l_tax):\n    y = l_quantity * 7.0\n    y -= l_tax\n    y *= 3 - 1\n    y //= 4\n    y += 0.5\n    return y\n",
    "SELECT l_orderkey, l_linenumber, floor((l_quantity * 7.0::DOUBLE - l_tax) * 2 / 4) + 0.5::DOUBLE AS result FROM lineitem",
)
kernel(
    "kernel_augmented_whole", "lineitem", LINE,
    "def k(l_linenumber):\n    y = l_linenumber * 5\n    y //= 3\n    y *= y - 9\n    return y\n",
    "SELECT l_orderkey, l_linenumber, ((l_linenumber * 5 // 3) * (l_linenumber * 5 // 3 - 9))::INT AS result FROM lineitem",
)
kernel(
    "kernel_expression_statement", "lineitem", LINE,
    "def k(l_quantity, l_tax):\n    l_quantity * 100\n    if l_tax > 0.03:\n        l_tax\n        return l_quantity\n    return l_tax\n",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.03::DOUBLE THEN l_quantity ELSE l_tax END AS result FROM lineitem",
)
kernel(
    "kernel_casts", "customer", ("c_custkey",),
    "def k(c_acctbal, c_custkey):\n    n = int(c_acctbal)\n    f = float(c_custkey) / 2\n    b = bool(n % int(10))\n    if b:\n        return float(n) + f\n    return f\n",
    "SELECT c_custkey, round(CASE WHEN trunc(c_acctbal)::BIGINT % 10 <> 0 THEN trunc(c_acctbal) ELSE 0 END + c_custkey / 2, 6) AS result FROM customer",
)
kernel(
    "kernel_text_truth", "orders", ("o_orderkey",),
    "def k(o_orderstatus, o_orderpriority):\n    rest = removeprefix(o_orderpriority, '1-URGENT')\n    if rest:\n        if removeprefix(o_orderstatus, 'O'):\n            return 1\n        return 2\n    return 0\n",
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END::INT AS result FROM orders",
)
kernel(
    "kernel_nested_continue", "lineitem", LINE,
    "def k(l_linenumber, l_quantity):\n    acc = 0.0\n    i = 0\n    while i < l_linenumber:\n        i += 1\n        if i == 2:\n            continue\n        for j in range(i, 0, -1):\n            if j > 3:\n                break\n            acc += j\n    return acc\n",
    """SELECT l_orderkey, l_linenumber, (SELECT coalesce(sum(CASE WHEN i = 2 OR i > 3 THEN 0 ELSE i * (i + 1) // 2 END), 0)::DOUBLE FROM range(1, 8) t(i) WHERE i <= l_linenumber) AS result FROM lineitem""",
)


def _kernel_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loops below and above the limit of unrolling, over rows of which some have nulls."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("x"), F.when(F.col("c_custkey") % 5 > 0, F.lit(2.0)).alias("y"))
    for name, trips in (("few", 3), ("many", 70)):
        df = compile(f"def k(x, y):\n    n = 0.0\n    for i in range({trips}):\n        if x < 0:\n            n += y\n        n += 1\n    return n\n", df.schema).apply(df, name)
    return df.select("c_custkey", "few", "many")


register(
    "kernel_nulls", _kernel_nulls,
    "SELECT c_custkey, " + ", ".join(f"CASE WHEN c_custkey % 3 > 0 AND c_custkey % 5 > 0 THEN CASE WHEN c_acctbal < 0 THEN {3 * n} ELSE {n} END END::DOUBLE AS {k}" for k, n in (("few", 3), ("many", 70))) + " FROM customer",
)


def _kernel_print(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kernels print: whole values, in the order of statements, under the mask of the rows."""
    df = table(spark, sf_dir, "customer")
    text = "def k(c_acctbal, c_custkey):\n    print('{} rows of {{}} {}', sum(c_custkey >= 0), 7)\n    if c_custkey < 0:\n        print('never')\n    print(min(c_custkey))\n    return c_acctbal\n"
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        compile(text, df.schema).apply(df)
    return values(spark, list(enumerate(out.getvalue().splitlines())), "line bigint, printed string")


register("kernel_print", _kernel_print, "SELECT 0::BIGINT AS line, count(*) || ' rows of {} 7.0' AS printed FROM customer UNION ALL SELECT 1::BIGINT, min(c_custkey)::VARCHAR FROM customer")


def _flat_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compile("def k():\n    return _flat_idx * 3 + _n0 + _i0\n", {}).apply(index_range(spark, 500), "v", "idx")
    return out.select("idx", "v")


register("kernel_flat_index", _flat_index, "SELECT range AS idx, range * 4 + 500 AS v FROM range(500)")

# What is refused, with the codes

_REFUSED = {
    "open bracket": ("sin(x", None), "no operand": ("x +", None), "unknown name": ("x + q", None), "reduction of a reduction": ("sum(mean(x))", None), "text and number": ("'a' + x", None),
    "a reserved name": ("def k(x):\n    print = 1\n    return x\n", None), "a place as a name": ("def k(x):\n    _i0 = 1\n    return x\n", None), "an input assigned": ("def k(x):\n    x = 1\n    return x\n", None),
    "no return": ("def k(x):\n    y = x\n", None), "two statements a line": ("def k(x):\n    y = x; z = y\n    return z\n", None), "a reduction in a branch": ("def k(x):\n    if x > 0:\n        y = sum(x)\n    return x\n", None),
    "break outside": ("def k(x):\n    break\n    return x\n", None), "returns of two types": ("def k(x):\n    if x > 0:\n        return x > 0\n    return x\n", None), "a pragma unknown": ("# me:fp=loose\ndef k(x):\n    return x\n", None),
    "a function named as a builtin": ("def k(x):\n    return sin(x)\n", "sin"), "a function named int": ("def k(x):\n    return int(x)\n", "int"), "a local named as a function": ("def k(x):\n    f = 1\n    return f(x)\n", "f"),
}


def _refusals(spark: SparkSession) -> list[tuple]:
    out = []
    for case, (text, function) in _REFUSED.items():
        udfs = [Udf(function, lambda v: v, D.dtype("float64"), 1)] if function else None
        try:
            compile(text, {"x": "float64"}, udfs=udfs)
            out.append((case, "accepted", 0))
        except ExpressionError as e:
            out.append((case, "refused", e.code))
    for case, names, kind in (("some without type", {"x": "float64", "y": "auto"}, "auto"), ("no type at all", {"x": "auto"}, "auto")):
        try:
            compile("x", names, kind)
        except ExpressionError as e:
            out.append((case, "refused", e.code))
    return out


_CODES = {"open bracket": -2, "no operand": -2, "reduction of a reduction": -5, "text and number": -8, "a reduction in a branch": -5, "returns of two types": -8, "a function named as a builtin": -3, "a function named int": -3}
listed("refusals", "subject string, outcome string, code bigint", _refusals, [*[(k, "refused", _CODES.get(k, -2)) for k in _REFUSED], ("some without type", "refused", -7), ("no type at all", "refused", -7)])


def _evaluation_errors(spark: SparkSession) -> list[tuple]:
    df, out = spark.range(3).select(F.col("id").cast("double").alias("x")), []
    cases = {"a lane without return": "def k(x):\n    if x > 1:\n        return x\n", "a step of zero": "def k(x):\n    n = x\n    for i in range(0, 9, 0):\n        n += 1\n    return n\n"}
    for case, text in cases.items():
        try:
            compile(text, df.schema).apply(df).collect()
            out.append((case, "value", 0))
        except EvaluationError as e:
            out.append((case, "error", e.code))
        except Exception as e:  # noqa: BLE001  an executor's error
            out.append((case, "error" if "without a return" in str(e) else "other", EvaluationError.code))
    try:
        compile("x + y", {"x": "float64", "y": "float64"}).apply(df)
    except EvaluationError as e:
        out.append(("a column that is missing", "error", e.code))
    return out


listed("evaluation_errors", "subject string, outcome string, code bigint", _evaluation_errors, [("a lane without return", "error", -5), ("a step of zero", "error", -5), ("a column that is missing", "error", -4)])

# Descriptions of compiled expressions

_TYPED = {"a + b": ("int64", 8), "a / 2": ("int32", 4), "sum(a)": ("int64", 8), "mean(a)": ("float64", 8), "f * f": ("float32", 4), "s + '!'": (None, 12), "a > b": ("bool", 1), "real(z)": ("float32", 4), "z * z": ("complex64", 8)}


def _types(spark: SparkSession) -> list[tuple]:
    names = {"a": "int32", "b": "int64", "f": "float32", "z": "complex64", "s": "str[2]"}
    out = []
    for text, (kind, _) in _TYPED.items():
        c = compile(text, names)
        out.append((text, str(c.dtype) if kind else "text", c.itemsize))
    return out


listed("types_and_sizes", "subject string, dtype string, itemsize bigint", _types, [(k, t or "text", n) for k, (t, n) in _TYPED.items()])
listed("explained", "place bigint, node string", lambda spark: list(enumerate(compile("a * 2 + 1 > b", {"a": "int32", "b": "float64"}).explain().splitlines())), [(0, "gt: bool"), (1, "  cast: float64"), (2, "    add: int32"), (3, "      mul: int32"), (4, "        var a: int32"), (5, "        2: int32"), (6, "      1: int32"), (7, "  var b: float64")])
listed("accepted_options", "subject string, outcome string", lambda spark: [("version", "three numbers" if len(version().split(".")) == 3 else version()), ("options", str(compile("x + 1", {"x": "int32"}, simd="off", accuracy="1ulp", jit="cc").dtype))], [("version", "three numbers"), ("options", "int32")])


def _varlen_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of text as Arrow lays it out, and the most that a width of text allows."""
    df = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    offsets, data = varlen(df, "n_name", "k")
    bounds = [data_bound(D.dtype(t), len(offsets) - 1) for t in ("str[8]", "bytes[8]", "float64")]
    return values(spark, [(len(data), int(offsets[-1]), *bounds)], "bytes bigint, last bigint, of_text bigint, of_bytes bigint, of_numbers bigint")


register("varlen_bound", _varlen_bound, "SELECT sum(octet_length(n_name::BLOB))::BIGINT AS bytes, sum(octet_length(n_name::BLOB))::BIGINT AS last, count(*) * 32 AS of_text, count(*) * 8 AS of_bytes, 0::BIGINT AS of_numbers FROM nation")

# Types of every size

_WRAP = "((({x}) % {m} + {m} + {h}) % {m} - {h})"


def wrapped(x: str, kind: str) -> str:
    """SQL of an integer wrapped to a type's bits."""
    bits, signed = int(kind.lstrip("uint")), not kind.startswith("u")
    return _WRAP.format(x=f"({x})::HUGEINT", m=f"{1 << bits}::HUGEINT", h=f"{(1 << bits - 1) if signed else 0}::HUGEINT")


def _float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("float").alias("x"), (F.col("c_custkey") * 0.37).cast("float").alias("y"))
    texts = {"s": "x + y", "d": "x - 0.1", "p": "x * y", "q": "x / y", "a": "fmax(x, y)", "m": "fmod(x, 7)", "n": "nextafter(x, y)", "f": "fma(x, y, 0.1)", "t": "remainder(x, 7)", "g": "x >= y"}
    return df.select("c_custkey", *[compile(t, df.schema).column().alias(k) for k, t in texts.items()])


register(
    "float32_arithmetic", _float32,
    """WITH v AS (SELECT c_custkey, c_acctbal::FLOAT AS x, (c_custkey * 0.37::DOUBLE)::FLOAT AS y FROM customer)
       SELECT c_custkey, (x + y)::FLOAT AS s, (x - 0.1::FLOAT)::FLOAT AS d, (x * y)::FLOAT AS p, (x::DOUBLE / y::DOUBLE)::FLOAT AS q, greatest(x, y) AS a, (x::DOUBLE - 7 * trunc(x::DOUBLE / 7))::FLOAT AS m,
       nextafter(x, y) AS n, (x::DOUBLE * y::DOUBLE + 0.1::FLOAT::DOUBLE)::FLOAT AS f, (x::DOUBLE - 7 * round_even(x::DOUBLE / 7, 0))::FLOAT AS t, x >= y AS g FROM v""",
)


def _small_integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*LINE, F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"))
    out = []
    for kind in ("int8", "int16", "uint8", "uint16", "uint32"):
        names = {"k": kind, "n": kind}
        narrow = {c: compile(c, {c: "int64"}, kind).column() for c in ("k", "n")}
        for label, text in (("mul", "k * n * 17"), ("sub", "n - k"), ("div", "k / (n + 1)"), ("inv", "~k")):
            out.append(compile(text, names).column(narrow).cast("long").alias(f"{kind}_{label}"))
    return df.select(*LINE, *out)


def _small_sql() -> str:
    parts = []
    for kind in ("int8", "int16", "uint8", "uint16", "uint32"):
        k, n = wrapped("l_orderkey", kind), wrapped("l_linenumber", kind)
        for label, x in (("mul", f"{k} * {n} * 17"), ("sub", f"{n} - {k}"), ("div", f"{k} // ({n} + 1)"), ("inv", f"-1 - {k}")):
            parts.append(f"{wrapped(x, kind)}::BIGINT AS {kind}_{label}")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(parts)} FROM lineitem"


register("small_integers", _small_integers, _small_sql())

_KINDS = ["bool", "int8", "int16", "int32", "int64", "uint8", "uint16", "uint32", "uint64", "float32", "float64"]


def _cast_sql(x: str, a: str, b: str) -> str:
    """SQL of a value of type a as type b; integers as HUGEINT."""
    if a == b:
        return x
    if b == "bool":
        return f"({x}) <> 0"
    if a == "bool":
        x, a = f"CASE WHEN {x} THEN 1 ELSE 0 END", "int8"
    if b.startswith("float"):
        return f"({x})::{'FLOAT' if b == 'float32' else 'DOUBLE'}"
    if a.startswith("float"):
        bits, signed = int(b.lstrip("uint")), not b.startswith("u")
        low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if signed else (0, (1 << bits) - 1)
        return f"least(greatest(trunc(({x})::DOUBLE)::HUGEINT, {low}::HUGEINT), {high}::HUGEINT)"
    return wrapped(x, b)


def _all_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number type to every other: balances and keys, beyond the ends of the small types."""
    df = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") * 7).alias("v"))
    out = []
    for a in _KINDS:
        x = compile("v", {"v": "float64"}, a).column()
        for b in _KINDS:
            c = compile("x", {"x": a}, b).column({"x": x})
            out.append((c if b in ("bool", "float32", "float64") else c.cast("decimal(20,0)").cast("string")).alias(f"{a}_{b}"))
    return df.select("c_custkey", *out)


def _all_casts_sql() -> str:
    inner = ", ".join(f"{_cast_sql('v', 'float64', a)} AS x_{a}" for a in _KINDS)
    outer = ", ".join(f"{_cast_sql(f'x_{a}', a, b)}{'' if b in ('bool', 'float32', 'float64') else '::VARCHAR'} AS {a}_{b}" for a in _KINDS for b in _KINDS)
    return f"SELECT c_custkey, {outer} FROM (SELECT c_custkey, {inner} FROM (SELECT c_custkey, c_acctbal * 7 AS v FROM customer))"


register("output_casts_all", _all_casts, _all_casts_sql())


def _complex_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers to complex ones and back, in both sizes, with sums, differences and powers."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.struct(F.col("c_acctbal").cast("float").alias("re"), F.lit(2.0).cast("float").alias("im")).alias("z"))
    names = {"c_acctbal": "float64", "c_custkey": "int64", "z": "complex64"}
    texts = {"up": ("c_acctbal", "complex128"), "wide": ("z", "complex128"), "add": ("z + z", "auto"), "sub": ("z - 1.5", "auto"), "mul": ("z * z", "auto"), "sq": ("z ** 2", "complex128"), "neg": ("-conj(z)", "auto")}
    df = df.select("c_custkey", *[compile(t, {k: v for k, v in names.items() if k in t}, kind).column().alias(k) for k, (t, kind) in texts.items()])
    parts = [F.col(f"{k}.{p}").cast("double").alias(f"{k}_{p}") for k in ("up", "wide", "add", "sub", "neg") for p in ("re", "im")]
    return df.select("c_custkey", *parts, *[rounded(F.col(f"{k}.{p}").cast("double") / 1e6, 3).alias(f"{k}_{p}") for k in ("mul", "sq") for p in ("re", "im")])


register(
    "complex_casts", _complex_casts,
    """WITH v AS (SELECT c_custkey, c_acctbal AS b, c_acctbal::FLOAT AS a FROM customer)
       SELECT c_custkey, b AS up_re, 0.0::DOUBLE AS up_im, a::DOUBLE AS wide_re, 2.0::DOUBLE AS wide_im, (a + a)::FLOAT::DOUBLE AS add_re, 4.0::DOUBLE AS add_im,
       (a::DOUBLE - 1.5)::FLOAT::DOUBLE AS sub_re, 2.0::DOUBLE AS sub_im, (-a)::DOUBLE AS neg_re, 2.0::DOUBLE AS neg_im, round((a::DOUBLE * a - 4)::FLOAT::DOUBLE / 1e6, 3) + 0.0 AS mul_re, round((4 * a::DOUBLE)::FLOAT::DOUBLE / 1e6, 3) + 0.0 AS mul_im,
       round((a::DOUBLE * a - 4) / 1e6, 3) + 0.0 AS sq_re, round(4 * a::DOUBLE / 1e6, 3) + 0.0 AS sq_im FROM v""",
)


def _complex_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", F.struct(F.col("l_quantity").alias("re"), (F.col("l_tax") - 0.04).alias("im")).alias("z"))
    texts = {"s": "sum(z)", "m": "mean(z)", "a": "sum(abs(z))", "any": "any(z)"}
    out = df.groupBy("l_returnflag").agg(*[agg(t, df.schema).alias(k) for k, t in texts.items()])
    return out.select("l_returnflag", *[rounded(f"{k}.{p}", 4).alias(f"{k}_{p}") for k in ("s", "m") for p in ("re", "im")], rounded("a", 3).alias("a"), F.col("any").alias("found"))


register(
    "complex_reductions", _complex_reductions,
    """SELECT l_returnflag, round(sum(l_quantity), 4) AS s_re, round(sum(l_tax - 0.04), 4) + 0.0 AS s_im, round(avg(l_quantity), 4) AS m_re, round(avg(l_tax - 0.04), 4) + 0.0 AS m_im,
       round(sum(sqrt(l_quantity * l_quantity + (l_tax - 0.04) * (l_tax - 0.04))), 3) AS a, true AS found FROM lineitem GROUP BY 1""",
)

# Functions of the caller, of all arities

_REAL = D.dtype("float64")


def _of(n: int, vector: bool) -> Udf:
    name = f"{'s' if vector else 'c'}{n}"
    if vector:
        return Udf(name, lambda *x: sum((i + 1) * v for i, v in enumerate(x)) if x else 4.0, _REAL, n)
    return Udf(name, lambda *x: sum(((i + 1) * v for i, v in enumerate(x)), F.lit(0.0)) if x else F.lit(4.0), _REAL, n, vector=False)


_ARGS = ["l_tax", "l_discount", "l_quantity", "1.5", "l_tax", "l_quantity", "2"]
rows(
    "udf_arities", "lineitem", LINE,
    {f"{k}{n}": f"{k}{n}({', '.join(_ARGS[:n])}) + l_tax" for n in range(8) for k in "sc"},
    {f"{k}{n}": " + ".join([*[f"{i + 1} * {a}" for i, a in enumerate(_ARGS[:n])], "l_tax"] if n else ["4.0", "l_tax"]) for n in range(8) for k in "sc"},
    digits=6, udfs=[_of(n, v) for n in range(8) for v in (True, False)],
)


def _udf_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions inside loops, one of them not pure."""
    df = table(spark, sf_dir, "lineitem")
    udfs = [Udf("half", lambda x: x / 2, _REAL, 1), Udf("either", lambda x, y: x.where(x > y, y), _REAL, 2, pure=False)]
    text = "def k(l_quantity, l_tax):\n    x = l_quantity\n    n = 0.0\n    while x > 1:\n        x = half(x)\n        n += 1\n    return either(n, l_tax)\n"
    out = compile(text, df.schema, udfs=udfs).apply(df, "v")
    return compile("either(l_tax, l_discount)", df.schema, udfs=udfs).apply(out, "w").select(*LINE, "v", "w")


register("udf_in_kernel", _udf_kernel, "SELECT l_orderkey, l_linenumber, greatest(ceil(log2(l_quantity)), l_tax)::DOUBLE AS v, greatest(l_tax, l_discount) AS w FROM lineitem")

# Stronger checks of single functions


def _erf_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    texts = {"f": "erf(l_quantity / 16 - 1.5)", "c": "erfc(l_quantity / 16 - 1.5)"}
    return df.select(*LINE, *[rounded(compile(t, df.schema).column(), 10).alias(k) for k, t in texts.items()])


register(
    "erf_series", _erf_series,
    """WITH RECURSIVE t AS (SELECT DISTINCT l_quantity, l_quantity / 16 - 1.5::DOUBLE AS x, 0 AS n, l_quantity / 16 - 1.5::DOUBLE AS term, l_quantity / 16 - 1.5::DOUBLE AS total FROM lineitem
       UNION ALL SELECT l_quantity, x, n + 1, term * 2 * x * x / (2 * n + 3), total + term * 2 * x * x / (2 * n + 3) FROM t WHERE n < 60),
       e AS (SELECT l_quantity, 2 / sqrt(pi()) * exp(-x * x) * total AS v FROM t WHERE n = 60)
       SELECT l_orderkey, l_linenumber, round(v, 10) + 0.0 AS f, round(1 - v, 10) + 0.0 AS c FROM lineitem JOIN e USING (l_quantity)""",
)


def _product_wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.groupBy("l_orderkey").agg(agg("prod(l_orderkey * 2 + 1)", df.schema).alias("odd"), agg("prod(l_orderkey * 6)", df.schema).alias("even"), rounded(agg("prod(1 + l_tax)", df.schema), 6).alias("real"))


register(
    "product_wrapped", _product_wrapped,
    f"""SELECT l_orderkey, {wrapped("list_reduce(list((l_orderkey * 2 + 1)::HUGEINT), lambda a, b: (a * b) % 18446744073709551616)", "int64")}::BIGINT AS odd,
        {wrapped("list_reduce(list((l_orderkey * 6)::HUGEINT), lambda a, b: (a * b) % 18446744073709551616)", "int64")}::BIGINT AS even, round(product(1 + l_tax), 6) AS real FROM lineitem GROUP BY 1""",
)
rows(
    "special_domain", "customer", ("c_custkey",),
    {"f": "fac(c_custkey % 25 + 0.0)", "n": "ncr(c_custkey % 70 + 0.0, 3.0)", "p": "npr(c_custkey % 40 + 0.0, 2.0)", "u": "tgamma(c_custkey % 18 + 1.0)"},
    {"f": "CASE WHEN c_custkey % 25 < 21 THEN factorial((c_custkey % 25)::INT)::DOUBLE ELSE 'inf'::DOUBLE END", "n": "CASE WHEN c_custkey % 70 < 3 THEN 'nan'::DOUBLE ELSE ((c_custkey % 70) * (c_custkey % 70 - 1) * (c_custkey % 70 - 2) // 6)::DOUBLE END", "p": "CASE WHEN c_custkey % 40 < 2 THEN 'nan'::DOUBLE ELSE ((c_custkey % 40) * (c_custkey % 40 - 1))::DOUBLE END", "u": "factorial((c_custkey % 18)::INT)::DOUBLE"},
)
totals("sums_of_types", "orders", {"w": "sum(o_orderkey * 4611686018427387904)", "n": "sum(o_totalprice > 1000)", "hi": "max(o_orderkey * 3)", "m": "mean(o_orderkey)"}, {"w": "((sum(o_orderkey::HUGEINT * 4611686018427387904 % 18446744073709551616) + 9223372036854775808) % 18446744073709551616 - 9223372036854775808::HUGEINT)::BIGINT", "n": "count(*) FILTER (o_totalprice > 1000)", "hi": "max(o_orderkey * 3)", "m": "round(avg(o_orderkey), 4)"})
