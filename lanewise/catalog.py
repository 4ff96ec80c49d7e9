"""Registered queries over the test tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.api import Udf, agg, compile
from lanewise.operators.nd import NdSpec, compile_nd
from lanewise.sources.arrays import index_range, with_offsets
from lanewise.sources.checkpoint import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE = ("l_orderkey", "l_linenumber")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Halves away from zero, in doubles as SQL engines do it; Spark's own goes through decimals."""
    x, scale = F.col(c) if isinstance(c, str) else c, 10.0**digits
    whole = F.floor(F.abs(x) * scale + 0.5).cast("double")
    return F.when(F.abs(x) < 4e18 / scale, F.signum(x) * whole / scale + 0.0).otherwise(x.cast("double"))


def kind(c: str) -> Column:
    """What sort of number a double is, as NaN and infinities don't compare well elsewhere."""
    x = F.col(c)
    return F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").otherwise("finite")


def rows(name: str, source: str, keys: tuple[str, ...], exprs: dict[str, str], sql: dict[str, str], types: dict[str, str] | None = None, digits: int | None = None, udfs: list[Udf] | None = None) -> None:
    """A query of row-wise expressions over a table, beside SQL for each."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        columns = []
        for out, text in exprs.items():
            compiled = compile(text, types or df.schema, udfs=udfs)
            c = compiled.column()
            columns.append((rounded(c, digits) if digits is not None and compiled.dtype.kind == "f" else c).alias(out))
        return df.select(*keys, *columns)

    wrap = lambda s: f"round({s}, {digits})" if digits is not None else s
    shown = [f"{s if s.startswith('!') else wrap(s)} AS {out}".lstrip("!") for out, s in sql.items()]
    register(name, query, f"SELECT {', '.join([*keys, *shown])} FROM {source}")


def totals(name: str, source: str, exprs: dict[str, str], sql: dict[str, str], by: tuple[str, ...] = (), digits: int | None = 4) -> None:
    """A query of reductions over a table or its groups."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        out = []
        for k, text in exprs.items():
            c = agg(text, df.schema)
            out.append((rounded(c, digits) if compile(text, df.schema).dtype.kind == "f" and digits is not None else c).alias(k))
        return df.groupBy(*by).agg(*out)

    shown = ", ".join([*by, *[f"{s} AS {k}" for k, s in sql.items()]])
    register(name, query, f"SELECT {shown} FROM {source}" + (f" GROUP BY {', '.join(by)}" if by else ""))


# Arithmetic, comparison and logic

totals("arith_revenue", "lineitem", {"revenue": "sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))"}, {"revenue": "round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2)"}, digits=2)
rows("arith_rows", "lineitem", LINE, {"charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "net": "-l_discount + +l_tax"}, {"charge": "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "net": "-l_discount + l_tax"}, digits=6)
rows(
    "type_promotion_mixed", "lineitem", LINE,
    {"wide": "l_orderkey + l_linenumber", "real": "l_linenumber + l_quantity", "whole": "l_linenumber * 2 - 1"},
    {"wide": "l_orderkey + l_linenumber", "real": "l_linenumber + l_quantity", "whole": "(l_linenumber * 2 - 1)::INT"},
)
rows("int_division", "lineitem", LINE, {"q": "l_orderkey / l_linenumber", "z": "l_orderkey / (l_linenumber - 3)", "n": "(0 - l_orderkey) / l_linenumber"}, {"q": "l_orderkey // l_linenumber", "z": "CASE WHEN l_linenumber = 3 THEN 0 ELSE l_orderkey // (l_linenumber - 3) END", "n": "-l_orderkey // l_linenumber"})
rows("float_division", "lineitem", LINE, {"r": "l_tax / (l_discount + 0.01)"}, {"r": "l_tax / (l_discount + 0.01)"}, digits=6)
rows("modulo", "lineitem", LINE, {"whole": "l_orderkey % 7", "real": "(l_quantity - 25) % 3.5 + 0"}, {"whole": "l_orderkey % 7", "real": "(l_quantity - 25) - 3.5 * trunc((l_quantity - 25) / 3.5) + 0.0"}, digits=None)
rows("pow_square", "lineitem", LINE, {"sq": "l_quantity ** 2", "cube": "l_linenumber ** 3", "left": "2.0 ** 3.0 ** 2.0 + l_tax * 0", "sign": "-l_linenumber ** 2"}, {"sq": "l_quantity * l_quantity", "cube": "(l_linenumber ** 3)::INT", "left": "64.0 + l_tax * 0", "sign": "(l_linenumber * l_linenumber)::INT"})
rows("bitwise_keys", "orders", ("o_orderkey",), {"a": "o_orderkey & 255", "o": "o_orderkey | 7", "x": "o_orderkey ^ 85", "n": "~o_orderkey"}, {"a": "o_orderkey & 255", "o": "o_orderkey | 7", "x": "xor(o_orderkey, 85)", "n": "~o_orderkey"})
rows("shift_keys", "lineitem", LINE, {"left": "l_orderkey << 3", "right": "l_orderkey >> 2", "gone": "l_linenumber << 33"}, {"left": "l_orderkey * 8", "right": "l_orderkey >> 2", "gone": "0"})
rows(
    "compare_mask", "lineitem", LINE,
    {"lt": "l_discount < l_tax", "ge": "l_quantity >= 25", "eq": "l_discount == 0.05", "ne": "l_linenumber != 3", "chain": "1 < l_linenumber < 1"},
    {"lt": "l_discount < l_tax", "ge": "l_quantity >= 25", "eq": "l_discount = 0.05::DOUBLE", "ne": "l_linenumber <> 3", "chain": "l_linenumber <= 1"},
)
rows("logical_mix", "lineitem", LINE, {"m": "l_quantity > 30 and not l_discount > 0.05 || l_tax == 0", "b": "(l_quantity > 30) ^ (l_tax > 0.04)", "t": "l_linenumber - 1 && l_quantity"}, {"m": "(l_quantity > 30 AND NOT l_discount > 0.05::DOUBLE) OR l_tax = 0", "b": "(l_quantity > 30) <> (l_tax > 0.04::DOUBLE)", "t": "l_linenumber <> 1 AND l_quantity <> 0"})
rows("where_tier", "part", ("p_partkey",), {"tier": "where(p_size > 40, 3, where(p_size > 20, 2, 1))", "price": "where((p_size > 10 and p_retailprice > 1000), p_retailprice * 0.5, p_size)"}, {"tier": "CASE WHEN p_size > 40 THEN 3 WHEN p_size > 20 THEN 2 ELSE 1 END", "price": "CASE WHEN p_size > 10 AND p_retailprice > 1000 THEN p_retailprice * 0.5 ELSE p_size::DOUBLE END"})
rows("int_wrap", "lineitem", LINE, {"w": "l_linenumber * 1000000000", "s": "l_linenumber + 2147483647"}, {"w": "((l_linenumber::HUGEINT * 1000000000 + 2147483648) % 4294967296 - 2147483648)::INT", "s": "((l_linenumber::HUGEINT + 2147483647 + 2147483648) % 4294967296 - 2147483648)::INT"})
rows("long_wrap", "orders", ("o_orderkey",), {"m": "o_orderkey * 9000000000000000 * 1024"}, {"m": "((o_orderkey::HUGEINT * 9000000000000000 * 1024 + 9223372036854775808) % 18446744073709551616 - CASE WHEN 1=1 THEN 9223372036854775808::HUGEINT END)::BIGINT"})
rows("unsigned_wrap", "part", ("p_partkey",), {"u8": "p_size * 9", "neg": "0 - p_size"}, {"u8": "(p_size * 9 % 256)::SMALLINT", "neg": "((256 - p_size) % 256)::SMALLINT"}, types={"p_size": "uint8"})


def _unsigned_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    texts = {"u": "o_orderkey * 4611686018427387904 - 1", "n": "~o_orderkey", "s": "o_orderkey << 60"}
    return df.select("o_orderkey", *[compile(t, {"o_orderkey": "uint64"}).column().cast("string").alias(k) for k, t in texts.items()])


register(
    "unsigned_long", _unsigned_long,
    """SELECT o_orderkey, ((o_orderkey::HUGEINT * 4611686018427387904 - 1 + 18446744073709551616) % 18446744073709551616)::VARCHAR AS u,
       (18446744073709551615::HUGEINT - o_orderkey)::VARCHAR AS n, (o_orderkey::HUGEINT * 1152921504606846976 % 18446744073709551616)::VARCHAR AS s FROM orders""",
)

# Functions

rows("trig_identity", "lineitem", LINE, {"one": "sin(l_quantity)**2 + cos(l_quantity)**2", "tan": "tan(l_tax) - sin(l_tax) / cos(l_tax)"}, {"one": "sin(l_quantity)**2 + cos(l_quantity)**2", "tan": "0.0::DOUBLE * l_tax"}, digits=6)
rows(
    "trig_functions", "lineitem", LINE,
    {"a": "arcsin(l_discount)", "b": "acos(l_tax)", "c": "atan(l_quantity)", "d": "arctan2(l_quantity, l_tax)", "e": "hypot(l_tax, l_discount)", "f": "sinpi(l_tax)", "g": "cospi(l_tax)"},
    {"a": "asin(l_discount)", "b": "acos(l_tax)", "c": "atan(l_quantity)", "d": "atan2(l_quantity, l_tax)", "e": "sqrt(l_tax * l_tax + l_discount * l_discount)", "f": "sin(pi() * l_tax)", "g": "cos(pi() * l_tax)"}, digits=6,
)
rows(
    "hyperbolic", "lineitem", LINE,
    {"a": "sinh(l_tax)", "b": "cosh l_tax", "c": "tanh(l_discount)", "d": "asinh(l_quantity)", "e": "arccosh(l_quantity + 1)", "f": "atanh(l_discount)"},
    {"a": "sinh(l_tax)", "b": "cosh(l_tax)", "c": "tanh(l_discount)", "d": "asinh(l_quantity)", "e": "acosh(l_quantity + 1)", "f": "atanh(l_discount)"}, digits=6,
)
rows(
    "exp_log", "lineitem", LINE,
    {"a": "exp(l_tax)", "b": "exp2(l_tax)", "c": "exp10(l_tax)", "d": "expm1(l_tax)", "e": "log(l_quantity)", "f": "log2(l_quantity)", "g": "log10(l_quantity)", "h": "log1p(l_tax)", "i": "sqrt(l_quantity)", "j": "cbrt(l_quantity)", "k": "logaddexp(l_tax, l_discount)"},
    {"a": "exp(l_tax)", "b": "pow(2, l_tax)", "c": "pow(10, l_tax)", "d": "exp(l_tax) - 1", "e": "ln(l_quantity)", "f": "log2(l_quantity)", "g": "log10(l_quantity)", "h": "ln(1 + l_tax)", "i": "sqrt(l_quantity)", "j": "cbrt(l_quantity)", "k": "ln(exp(l_tax) + exp(l_discount))"}, digits=6,
)
rows(
    "rounding_family", "customer", ("c_custkey",),
    {"fl": "floor(c_acctbal)", "ce": "ceil(c_acctbal)", "tr": "trunc(c_acctbal)", "ri": "rint(c_acctbal * 0.5)", "ro": "round(c_acctbal)", "si": "sign(c_acctbal)", "ab": "abs(c_acctbal)", "sq": "square(c_acctbal)"},
    {"fl": "floor(c_acctbal)", "ce": "ceil(c_acctbal)", "tr": "trunc(c_acctbal)", "ri": "round_even(c_acctbal * 0.5, 0)", "ro": "round(c_acctbal, 0)", "si": "sign(c_acctbal)::DOUBLE", "ab": "abs(c_acctbal)", "sq": "c_acctbal * c_acctbal"}, digits=6,
)
rows(
    "two_argument", "lineitem", LINE,
    {"mx": "fmax(l_tax, l_discount)", "mn": "fmin(l_tax, l_discount)", "cs": "copysign(l_quantity, l_tax - l_discount - 0.001)", "fd": "fdim(l_tax, l_discount)", "rm": "remainder(l_quantity, 7)", "ma": "fma(l_quantity, 2, l_tax)", "ld": "ldexp(l_tax, 3)", "fm": "fmod(l_quantity, 7)"},
    {"mx": "greatest(l_tax, l_discount)", "mn": "least(l_tax, l_discount)", "cs": "CASE WHEN l_tax - l_discount - 0.001 < 0 THEN -l_quantity ELSE l_quantity END", "fd": "greatest(l_tax - l_discount, 0)", "rm": "l_quantity - 7 * round_even(l_quantity / 7, 0)", "ma": "l_quantity * 2 + l_tax", "ld": "l_tax * 8", "fm": "fmod(l_quantity, 7)"}, digits=6,
)
rows("combinatorics", "lineitem", LINE, {"c": "ncr(l_linenumber + 3.0, 2.0)", "p": "npr(l_linenumber + 3.0, 2.0)", "f": "fac(l_linenumber + 0.0)"}, {"c": "((l_linenumber + 3) * (l_linenumber + 2) / 2)::DOUBLE", "p": "((l_linenumber + 3) * (l_linenumber + 2))::DOUBLE", "f": "factorial(l_linenumber)::DOUBLE"})
rows("gamma_functions", "lineitem", LINE, {"lg": "lgamma(l_quantity)", "tg": "tgamma(l_tax + 1.5)"}, {"lg": "lgamma(l_quantity)", "tg": "gamma(l_tax + 1.5)"}, digits=6)
rows("next_after", "lineitem", LINE, {"up": "nextafter(l_quantity, 1000.0)"}, {"up": "nextafter(l_quantity, 1000.0::DOUBLE)"})


def _error_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.select(*LINE, *[rounded(compile(t, df.schema).column()).alias(k) for k, t in {"one": "erf(l_tax) + erfc(l_tax)", "odd": "erf(l_tax) + erf(-l_tax)"}.items()])


register("error_functions", _error_functions, "SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS one, 0.0::DOUBLE AS odd FROM lineitem")


def _log_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    for name, text in {"l": "log(c_acctbal)", "s": "sqrt(c_acctbal)", "z": "log(c_acctbal * 0)", "d": "c_acctbal / 0", "p": "log1p(c_acctbal)"}.items():
        df = compile(text, df.schema).apply(df, name)
    return df.select("c_custkey", *[kind(c).alias(f"{c}_kind") for c in "lszdp"])


_SIGNED = "CASE WHEN c_acctbal {low} THEN '{a}' WHEN c_acctbal {at} THEN '{b}' ELSE '{c}' END"
register(
    "log_domain", _log_domain,
    "SELECT c_custkey, " + ", ".join([
        _SIGNED.format(low="< 0", a="nan", at="= 0", b="-inf", c="finite") + " AS l_kind",
        _SIGNED.format(low="< 0", a="nan", at="= 0", b="finite", c="finite") + " AS s_kind",
        "'-inf' AS z_kind",
        _SIGNED.format(low="< 0", a="-inf", at="= 0", b="nan", c="inf") + " AS d_kind",
        _SIGNED.format(low="< -1", a="nan", at="= -1", b="-inf", c="finite") + " AS p_kind",
    ]) + " FROM customer",
)

# Reductions

totals(
    "sum_mean_prod", "lineitem",
    {"s": "sum(l_quantity)", "m": "mean(l_discount)", "n": "sum(l_linenumber)", "lo": "min(l_tax)", "hi": "max(l_extendedprice)", "p": "prod(1 + l_tax * l_discount / 1000)", "both": "sum(l_tax) + min(l_quantity) * 2"},
    {"s": "round(sum(l_quantity), 4)", "m": "round(avg(l_discount), 4)", "n": "sum(l_linenumber)::BIGINT", "lo": "round(min(l_tax), 4)", "hi": "round(max(l_extendedprice), 4)", "p": "round(product(1 + l_tax * l_discount / 1000), 4)", "both": "round(sum(l_tax) + min(l_quantity) * 2, 4)"},
)
totals(
    "any_all_predicate", "lineitem", {"a": "any(l_quantity > 49)", "b": "all(l_quantity > 49)", "c": "all(l_tax)", "n": "sum(l_quantity > 10)"},
    {"a": "bool_or(l_quantity > 49)", "b": "bool_and(l_quantity > 49)", "c": "bool_and(l_tax <> 0)", "n": "sum((l_quantity > 10)::INT)::BIGINT"},
)
totals(
    "grouped_reduction", "lineitem",
    {"s": "sum(l_extendedprice * l_discount)", "m": "mean(l_quantity)", "w": "sum(where(l_tax > 0.04, l_quantity, 0))", "hi": "max(l_linenumber)", "any9": "any(l_discount > 0.09)"},
    {"s": "round(sum(l_extendedprice * l_discount), 2)", "m": "round(avg(l_quantity), 2)", "w": "round(sum(CASE WHEN l_tax > 0.04::DOUBLE THEN l_quantity ELSE 0 END), 2)", "hi": "max(l_linenumber)", "any9": "bool_or(l_discount > 0.09::DOUBLE)"},
    by=("l_returnflag", "l_linestatus"), digits=2,
)
totals("grouped_product", "lineitem", {"p": "prod(l_linenumber)"}, {"p": "product(l_linenumber)::BIGINT"}, by=("l_orderkey",))


def _min_max_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    both = df.agg(agg("min(log(c_acctbal))", df.schema).alias("lo"), agg("max(log(c_acctbal))", df.schema).alias("hi"), agg("sum(sqrt(c_acctbal))", df.schema).alias("s"))
    return both.select(*[kind(c).alias(c) for c in ("lo", "hi", "s")])


register("min_max_nan", _min_max_nan, "SELECT CASE WHEN bool_or(c_acctbal < 0) THEN 'nan' ELSE 'finite' END AS lo, CASE WHEN bool_or(c_acctbal < 0) THEN 'nan' ELSE 'finite' END AS hi, CASE WHEN bool_or(c_acctbal < 0) THEN 'nan' ELSE 'finite' END AS s FROM customer")


def _empty_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").filter("l_quantity < 0")
    texts = {"s": "sum(l_linenumber)", "p": "prod(l_linenumber)", "lo": "min(l_linenumber)", "hi": "max(l_linenumber)", "a": "any(l_linenumber)", "b": "all(l_linenumber)"}
    out = df.agg(*[agg(t, df.schema).alias(k) for k, t in texts.items()], agg("mean(l_tax)", df.schema).alias("m"), agg("min(l_tax)", df.schema).alias("f"))
    return out.withColumns({"m": kind("m"), "f": kind("f")})


register("empty_reductions", _empty_reductions, "SELECT 0::BIGINT AS s, 1::BIGINT AS p, 2147483647 AS lo, -2147483648 AS hi, false AS a, true AS b, 'nan' AS m, 'inf' AS f")


def _broadcast_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*LINE, "l_quantity", "l_extendedprice")
    df = compile("l_quantity - mean(l_quantity)", df.schema).apply(df, "centred")
    df = compile("(l_extendedprice - min(l_extendedprice)) / (max(l_extendedprice) - min(l_extendedprice))", df.schema).apply(df, "scaled")
    return df.select(*LINE, rounded("centred").alias("centred"), rounded("scaled").alias("scaled"))


register("broadcast_reduction", _broadcast_reduction, "SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (), 6) AS centred, round((l_extendedprice - min(l_extendedprice) OVER ()) / (max(l_extendedprice) OVER () - min(l_extendedprice) OVER ()), 6) AS scaled FROM lineitem")


def _filter_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return compile("l_quantity > mean(l_quantity) and l_discount < 0.03", df.schema).filter(df.select(*LINE, "l_quantity", "l_discount")).select(*LINE)


register("filter_mask", _filter_mask, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem) AND l_discount < 0.03::DOUBLE")

# Text and bytes

rows("str_concat", "part", ("p_partkey",), {"s": "p_brand + ' / ' + p_type"}, {"s": "p_brand || ' / ' || p_type"})
rows("str_case", "part", ("p_partkey",), {"lo": "lower(p_type)", "up": "upper(p_name)"}, {"lo": "lower(p_type)", "up": "upper(p_name)"})
rows("str_strip", "part", ("p_partkey",), {"b": "strip('\\t ' + p_name + ' \\n')", "l": "lstrip('  ' + p_name + ' ')", "r": "rstrip(' ' + p_name + '  ')"}, {"b": "trim(p_name, chr(9) || chr(10) || ' ')", "l": "ltrim('  ' || p_name || ' ')", "r": "rtrim(' ' || p_name || '  ')"})
rows(
    "str_affixes", "orders", ("o_orderkey",), {"p": "removeprefix(o_orderpriority, '1-')", "s": "removesuffix(o_orderpriority, 'URGENT')"},
    {"p": "CASE WHEN starts_with(o_orderpriority, '1-') THEN substr(o_orderpriority, 3) ELSE o_orderpriority END", "s": "CASE WHEN ends_with(o_orderpriority, 'URGENT') THEN left(o_orderpriority, length(o_orderpriority) - 6) ELSE o_orderpriority END"},
)
rows("str_replace", "part", ("p_partkey",), {"r": "replace(p_name, 'e', 'E!')", "d": "replace(p_type, 'A', '')"}, {"r": "replace(p_name, 'e', 'E!')", "d": "replace(p_type, 'A', '')"})
rows("str_substr", "part", ("p_partkey",), {"a": "substr(p_name, 1, 3)", "b": "substr(p_name, -2, 2)", "c": "substr(p_brand, -99, 2)"}, {"a": "substr(p_name, 2, 3)", "b": "substr(p_name, greatest(length(p_name) - 2, 0) + 1, 2)", "c": "substr(p_brand, 1, 2)"})
rows(
    "str_split_part", "orders", ("o_orderkey",), {"h": "split_part(o_orderpriority, '-', 0)", "t": "split_part(o_orderpriority, '-', 1)", "n": "split_part(o_orderpriority, '~', 1)"},
    {"h": "CASE WHEN instr(o_orderpriority, '-') = 0 THEN o_orderpriority ELSE substr(o_orderpriority, 1, instr(o_orderpriority, '-') - 1) END", "t": "CASE WHEN instr(o_orderpriority, '-') = 0 THEN '' ELSE substr(o_orderpriority, instr(o_orderpriority, '-') + 1) END", "n": "''"},
)
rows("str_predicates", "part", ("p_partkey",), {"s": "startswith(p_type, 'S')", "e": "endswith(p_type, 'L')", "c": "contains(lower(p_name), 'an')", "eq": "p_brand == 'Brand#11'", "ne": "p_brand != 'Brand#11'"}, {"s": "starts_with(p_type, 'S')", "e": "ends_with(p_type, 'L')", "c": "contains(lower(p_name), 'an')", "eq": "p_brand = 'Brand#11'", "ne": "p_brand <> 'Brand#11'"})


def _bytes_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.encode("c_mktsegment", "UTF-8").alias("seg"))
    for name, text in {"lo": "lower(seg)", "cat": "seg + b'!'", "cut": "substr(seg, 1, 3)"}.items():
        df = compile(text, df.schema).apply(df, name)
    return df.select("c_custkey", *[F.decode(c, "UTF-8").alias(c) for c in ("lo", "cat", "cut")])


register("bytes_ops", _bytes_ops, "SELECT c_custkey, lower(c_mktsegment) AS lo, c_mktsegment || '!' AS cat, substr(c_mktsegment, 2, 3) AS cut FROM customer")


def _varlen_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part")
    df = compile("'kind=' + p_type", df.schema).apply(df.select("p_partkey", "p_type"), "kind")
    return with_offsets(df.select("p_partkey", "kind"), "kind", "p_partkey")


register("varlen_offsets", _varlen_offsets, "SELECT p_partkey, kind, (e - octet_length(kind::BLOB))::BIGINT AS start, e::BIGINT AS stop FROM (SELECT p_partkey, 'kind=' || p_type AS kind, sum(octet_length(('kind=' || p_type)::BLOB)) OVER (ORDER BY p_partkey) AS e FROM part)")

# Types of the output, functions of the caller, complex numbers


def _output_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    out = {"i": ("c_acctbal / 3", "int32"), "b": ("c_acctbal", "int8"), "f": ("c_acctbal * 2", "float32"), "u": ("c_custkey * 3", "uint16"), "t": ("c_acctbal", "bool")}
    return df.select("c_custkey", *[compile(text, df.schema, t).column().alias(k) for k, (text, t) in out.items()])


register("output_cast", _output_cast, "SELECT c_custkey, trunc(c_acctbal / 3)::INT AS i, least(greatest(trunc(c_acctbal), -128), 127)::TINYINT AS b, (c_acctbal * 2)::FLOAT AS f, (c_custkey * 3 % 65536)::INT AS u, c_acctbal <> 0 AS t FROM customer")


def _scale(context: float) -> Callable:
    return lambda x: x * context


rows(
    "udf_clamp", "lineitem", LINE, {"c": "clamp01(l_tax * 30 - 1)", "s": "scale(l_quantity) + 1"},
    {"c": "least(greatest(l_tax * 30 - 1, 0), 1)", "s": "l_quantity * 2.5 + 1"}, digits=6,
    udfs=[Udf("clamp01", lambda x: x.clip(0.0, 1.0), compile("1.0", {}, "float64").dtype, 1), Udf("scale", _scale(2.5), compile("1.0", {}, "float64").dtype, 1, vector=False)],
)


def _complex_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").select(*LINE, F.struct(F.col("l_quantity").alias("re"), F.col("l_tax").alias("im")).alias("z"), F.struct(F.col("l_tax").alias("re"), F.lit(-2.0).alias("im")).alias("w"))
    for name, text in {"m": "abs(z)", "p": "z * w", "q": "z / w", "c": "real(conj(z)) - imag(z)", "s": "sqrt(w)"}.items():
        df = compile(text, df.schema).apply(df, name)
    return df.select(*LINE, rounded("m").alias("m"), *[rounded(f"{k}.{p}").alias(f"{k}_{p}") for k in "pqs" for p in ("re", "im")], rounded("c").alias("c"))


register(
    "complex_arithmetic", _complex_arithmetic,
    """SELECT l_orderkey, l_linenumber, round(sqrt(a*a + b*b), 6) AS m, round(a*c + 2*b, 6) AS p_re, round(-2*a + b*c, 6) AS p_im,
       round((a*c - 2*b) / (c*c + 4), 6) AS q_re, round((b*c + 2*a) / (c*c + 4), 6) AS q_im, round(sqrt((sqrt(c*c + 4) + c) / 2), 6) AS s_re,
       round(-sqrt((sqrt(c*c + 4) - c) / 2), 6) AS s_im, round(a - b, 6) AS c
       FROM (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_tax AS b, l_tax AS c FROM lineitem)""",
)

# Kernels


def kernel(name: str, source: str, keys: tuple[str, ...], text: str, sql: str | None, digits: int | None = 6, index: str | None = None) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, source)
        compiled = compile(text, df.schema)
        out = compiled.apply(df, "result", index)
        return out.select(*keys, (rounded("result", digits) if compiled.dtype.kind == "f" else F.col("result")).alias("result"))

    register(name, query, sql)


kernel(
    "kernel_if_elif", "customer", ("c_custkey",),
    "def k(c_acctbal):\n    if c_acctbal > 5000:\n        y = c_acctbal * 0.9\n    elif c_acctbal > 0:\n        y = c_acctbal\n    else:\n        y = 0 - c_acctbal\n    return y\n",
    "SELECT c_custkey, round(CASE WHEN c_acctbal > 5000 THEN c_acctbal * 0.9 WHEN c_acctbal > 0 THEN c_acctbal ELSE -c_acctbal END, 6) AS result FROM customer",
)
kernel(
    "kernel_for_unrolled", "lineitem", LINE,
    "def k(l_quantity, l_tax):\n    acc = 0.0\n    for i in range(4):\n        if l_quantity < 10:\n            break\n        acc += l_quantity * l_tax + i\n    return acc\n",
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity < 10 THEN 0 ELSE 4 * l_quantity * l_tax + 6 END, 6) AS result FROM lineitem",
)
kernel(
    "kernel_while_mask", "lineitem", LINE,
    "def k(l_quantity):\n    x = l_quantity\n    n = 0\n    while x > 1:\n        x /= 2\n        n += 1\n    return n\n",
    "SELECT l_orderkey, l_linenumber, greatest(ceil(log2(l_quantity)), 0)::DOUBLE AS result FROM lineitem",
)
kernel(
    "kernel_lane_range", "lineitem", LINE,
    "def k(l_orderkey, l_linenumber):\n    acc = l_orderkey * 0\n    for i in range(l_linenumber):\n        if i == 5:\n            continue\n        acc += i\n    return acc\n",
    "SELECT l_orderkey, l_linenumber, (l_linenumber * (l_linenumber - 1) // 2 - CASE WHEN l_linenumber > 5 THEN 5 ELSE 0 END)::BIGINT AS result FROM lineitem",
)
kernel(
    "kernel_reduction_condition", "lineitem", LINE,
    "def k(l_quantity, l_tax):\n    top = max(l_quantity)\n    if any(l_tax > 0.07):\n        y = l_quantity / top\n    else:\n        y = l_tax\n    return y\n",
    "SELECT l_orderkey, l_linenumber, round(CASE WHEN (SELECT bool_or(l_tax > 0.07::DOUBLE) FROM lineitem) THEN l_quantity / (SELECT max(l_quantity) FROM lineitem) ELSE l_tax END, 6) AS result FROM lineitem",
)
kernel(
    "kernel_strings", "orders", ("o_orderkey",),
    "def k(o_orderpriority, o_orderstatus):\n    base = 'status=' + o_orderstatus\n    if contains(o_orderpriority, '-'):\n        return base + ', ' + lower(split_part(o_orderpriority, '-', 1))\n    return base\n",
    "SELECT o_orderkey, 'status=' || o_orderstatus || CASE WHEN contains(o_orderpriority, '-') THEN ', ' || lower(substr(o_orderpriority, instr(o_orderpriority, '-') + 1)) ELSE '' END AS result FROM orders",
)
kernel(
    "kernel_option_price", "part", ("p_partkey",),
    "def price(p_retailprice, p_size):\n    s = p_retailprice / 100\n    x = 10.0 + p_size * 0.1\n    v = 0.3\n    d1 = (log(s / x) + 0.065) / v\n    d2 = d1 - v\n    k1 = 1 / (1 + 0.2316419 * abs(d1))\n    c1 = 1 - exp(-d1 * d1 / 2) * 0.39894228 * k1 * (0.31938153 + k1 * (-0.356563782 + k1 * 1.781477937))\n    if d1 < 0:\n        c1 = 1 - c1\n    k2 = 1 / (1 + 0.2316419 * abs(d2))\n    c2 = 1 - exp(-d2 * d2 / 2) * 0.39894228 * k2 * (0.31938153 + k2 * (-0.356563782 + k2 * 1.781477937))\n    if d2 < 0:\n        c2 = 1 - c2\n    return s * c1 - x * exp(-0.02) * c2\n",
    """WITH a AS (SELECT p_partkey, p_retailprice / 100 AS s, 10.0::DOUBLE + p_size * 0.1::DOUBLE AS x FROM part),
       b AS (SELECT *, (ln(s / x) + 0.065) / 0.3 AS d1, (ln(s / x) + 0.065) / 0.3 - 0.3 AS d2 FROM a),
       c AS (SELECT *, 1 / (1 + 0.2316419 * abs(d1)) AS k1, 1 / (1 + 0.2316419 * abs(d2)) AS k2 FROM b),
       e AS (SELECT *, 1 - exp(-d1 * d1 / 2) * 0.39894228 * k1 * (0.31938153 + k1 * (-0.356563782 + k1 * 1.781477937)) AS n1,
                    1 - exp(-d2 * d2 / 2) * 0.39894228 * k2 * (0.31938153 + k2 * (-0.356563782 + k2 * 1.781477937)) AS n2 FROM c)
       SELECT p_partkey, round(s * CASE WHEN d1 < 0 THEN 1 - n1 ELSE n1 END - x * exp(-0.02) * CASE WHEN d2 < 0 THEN 1 - n2 ELSE n2 END, 5) AS result FROM e""",
    digits=5,
)

_MANDELBROT = """
def escape(cr, ci):
    zr = 0.0
    zi = 0.0
    n = 0.0
    for i in range(60):
        if zr * zr + zi * zi > 4:
            break
        t = zr * zr - zi * zi + cr
        zi = 2 * zr * zi + ci
        zr = t
        n += 1
    return n
"""


def _mandelbrot(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = index_range(spark, 48 * 32).select("idx", ((F.col("idx") % 48) / 16.0 - 2.0).alias("cr"), (F.call_function("div", F.col("idx"), F.lit(48)) / 16.0 - 1.0).alias("ci"))
    return compile(_MANDELBROT, grid.schema).apply(grid, "n").select("idx", "n")


register(
    "kernel_mandelbrot", _mandelbrot,
    """WITH RECURSIVE g AS (SELECT range AS idx, (range % 48) / 16.0::DOUBLE - 2.0 AS cr, (range // 48) / 16.0::DOUBLE - 1.0 AS ci FROM range(1536)),
       z AS (SELECT idx, cr, ci, 0.0::DOUBLE AS zr, 0.0::DOUBLE AS zi, 0 AS n FROM g
             UNION ALL SELECT idx, cr, ci, zr * zr - zi * zi + cr, 2 * zr * zi + ci, n + 1 FROM z WHERE n < 60 AND zr * zr + zi * zi <= 4)
       SELECT idx, max(n)::DOUBLE AS n FROM z GROUP BY idx""",
)

# Arrays

_SPEC = NdSpec((7, 9), (4, 5), (3, 2))


def _nd_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index_range(spark, _SPEC)
    out = compile_nd("def k():\n    return _i0 * 100 + _i1 * 10 + _n1 + _ndim\n", {}, _SPEC).apply(df, "idx", "code")
    return _SPEC.located(out, "idx")


register(
    "nd_coords", _nd_coords,
    """SELECT range AS idx, (range // 9 * 100 + range % 9 * 10 + 9 + 2)::BIGINT AS code, (range // 9 // 4 * 2 + range % 9 // 5)::BIGINT AS chunk,
       (range // 9 % 4 // 3 * 3 + range % 9 % 5 // 2)::BIGINT AS block, (range // 9 % 4 % 3 * 2 + range % 9 % 5 % 2)::BIGINT AS item FROM range(63)""",
)
register(
    "nd_valid_items", lambda spark, sf_dir: _SPEC.grid(spark),
    """SELECT c.range AS chunk, b.range AS block, (greatest(least(3, 4 - b.range // 3 * 3, 7 - c.range // 2 * 4 - b.range // 3 * 3), 0)
       * greatest(least(2, 5 - b.range % 3 * 2, 9 - c.range % 2 * 5 - b.range % 3 * 2), 0))::BIGINT AS valid FROM range(4) c, range(6) b""",
)


def _nd_block_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 63).alias("idx"), "o_totalprice").groupBy("idx").agg(F.sum("o_totalprice").alias("x"))
    compiled = compile_nd("sum(x)", df.schema, _SPEC)
    return compiled.blocks(df, "idx", "total").select("chunk", "block", rounded("total", 2).alias("total"))


register(
    "nd_block_sum", _nd_block_sum,
    """WITH v AS (SELECT o_orderkey % 63 AS i, sum(o_totalprice) AS x FROM orders GROUP BY 1),
       s AS (SELECT i // 9 // 4 * 2 + i % 9 // 5 AS chunk, i // 9 % 4 // 3 * 3 + i % 9 % 5 // 2 AS block, sum(x) AS t FROM v GROUP BY 1, 2)
       SELECT c.range AS chunk, b.range AS block, round(coalesce(t, 0), 2) AS total FROM range(4) c CROSS JOIN range(6) b LEFT JOIN s ON s.chunk = c.range AND s.block = b.range""",
)


def _nd_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = index_range(spark, _SPEC).withColumn("x", F.col("idx") * 2 + 1)
    return compile_nd("x * x", df.schema, _SPEC).padded(df, "idx", "v")


register(
    "nd_padded", _nd_padded,
    """WITH v AS (SELECT range AS i, (range * 2 + 1) * (range * 2 + 1) AS v FROM range(63)),
       p AS (SELECT i // 9 // 4 * 2 + i % 9 // 5 AS chunk, i // 9 % 4 // 3 * 3 + i % 9 % 5 // 2 AS block, i // 9 % 4 % 3 * 2 + i % 9 % 5 % 2 AS item, v FROM v)
       SELECT c.range AS chunk, b.range AS block, k.range AS item, coalesce(p.v, 0)::BIGINT AS v
       FROM range(4) c CROSS JOIN range(6) b CROSS JOIN range(6) k LEFT JOIN p ON p.chunk = c.range AND p.block = b.range AND p.item = k.range""",
)


def _vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions over the items of arrays, a row an array."""
    square, size = compile("x * x", {"x": "float32"}), compile("abs(x)", {"x": "float32"})
    norm = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + square.column({"x": x}))
    top = F.array_max(F.transform("embedding", lambda x: size.column({"x": x})))
    return table(spark, sf_dir, "embeddings").select("vec_id", rounded(norm, 3).alias("norm2"), F.round(top, 3).cast("double").alias("top"))


register("vector_norms", _vector_norms, "SELECT vec_id, round(sum((x * x)::FLOAT::DOUBLE), 3) AS norm2, round(max(abs(x)), 3)::DOUBLE AS top FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")

# Streams


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a stream of the events table, run to its end."""
    from lanewise.streaming import apply, to_table, windowed

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = apply(stream.withColumn("ts", F.col("ts").cast("timestamp")), "value * 2 + 1", "v")
    out = windowed(stream, "sum(v) + any(v > 100)", "ts", "1 day", "30 days", keys=("event_type",), name="total")
    found = to_table(out, f"{shared_folder(spark)}/streamed-{uuid.uuid4().hex}")
    return found.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", rounded("total", 2).alias("total"))


register("streaming_windowed", _streamed, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value * 2 + 1) + bool_or(value * 2 + 1 > 100)::INT, 2) AS total FROM events GROUP BY 1, 2")

from lanewise import catalog_language  # noqa: E402, F401  registers further queries
