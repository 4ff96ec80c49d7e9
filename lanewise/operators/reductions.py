"""Whole-input reductions as aggregate Columns, with NumPy's identities and NaN rules."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import dtypes as D
from lanewise.dtypes import DType
from lanewise.functions import ieee
from lanewise.plans.typed import reduced


def identity(name: str, t: DType) -> object:
    """What a reduction of nothing gives."""
    if name in ("sum", "any"):
        return 0
    if name in ("prod", "all"):
        return 1
    if name == "mean":
        return math.nan
    if t.kind == "b":
        return name == "min"
    if t.kind == "f":
        return math.inf if name == "min" else -math.inf
    return D.limits(t)[1 if name == "min" else 0]


_FIVES = [pow(5, -(1 << j), 1 << 64) for j in range(62)]


def _factors(x: pd.Series) -> pd.DataFrame:
    """Of integers as 64 unsigned bits: factors of two (64 for zero), and of the odd part k and the
    sign with +-(5 ** k) modulo 2 ** 64; one bit of k after the other."""
    u = x.to_numpy(np.int64).view(np.uint64)
    low = np.where(u == 0, np.uint64(1), u & (~u + np.uint64(1)))
    twos = np.where(u == 0, 64, np.bitwise_count(low - np.uint64(1))).astype(np.int64)
    u = np.where(u == 0, np.uint64(1), u // low)
    values, inverse = np.unique(u, return_inverse=True)
    turns = values & np.uint64(3) == 3
    u, k = np.where(turns, ~values + np.uint64(1), values), np.zeros(len(values), np.int64)
    for j, back in enumerate(_FIVES):
        set_ = (u >> np.uint64(j + 2)) & np.uint64(1) == 1
        k[set_] |= 1 << j
        u = np.where(set_, u * np.uint64(back), u)
    return pd.DataFrame({"k": k[inverse], "twos": twos, "turns": turns[inverse].astype(np.int64)})


def _rebuilt(k: pd.Series, twos: pd.Series, turns: pd.Series) -> pd.Series:
    """+-(5 ** k) * 2 ** twos modulo 2 ** 64, by squaring."""
    exponent = np.array([int(a) % (1 << 62) for a in k], np.uint64)
    out, power = np.ones(len(exponent), np.uint64), 5
    for j in range(62):
        out = np.where((exponent >> np.uint64(j)) & np.uint64(1) == 1, out * np.uint64(power), out)
        power = power * power % (1 << 64)
    out = np.where(turns.to_numpy(np.int64) % 2 == 1, ~out + np.uint64(1), out)
    shift = np.minimum(twos.to_numpy(np.int64), 64).astype(np.uint64)
    out = np.where(shift < 64, out << np.minimum(shift, np.uint64(63)), np.uint64(0))
    return pd.Series([str(v) for v in out.tolist()])


def _integer_product(x: Column, t: DType, out: DType) -> Column:
    """Wrapping product. Odd numbers modulo 2 ** 64 are powers of five, perhaps negated, so the
    product of any number of rows is three sums, which Spark adds up partially like any others."""
    bits = ieee.as_signed(x) if t == D.UINT64 else x.cast("long")
    bits = F.coalesce(bits, F.lit(1))
    factors = F.pandas_udf(_factors, "k bigint, twos bigint, turns bigint")(bits)
    k = F.sum(factors["k"].cast("decimal(20,0)")).cast("string")
    twos, turns = F.sum(factors["twos"]), F.sum(factors["turns"])
    rebuilt = F.pandas_udf(_rebuilt, "string")(F.coalesce(k, F.lit("0")), F.coalesce(twos, F.lit(0)), F.coalesce(turns, F.lit(0)))
    return ieee.cast(rebuilt.cast("decimal(20,0)"), D.UINT64, out)


def wrapped_sum(x: Column, t: DType) -> Column:
    """Sum of 64-bit integers that wraps, by way of decimals."""
    total = F.sum(x.cast("decimal(20,0)")).cast("decimal(38,0)")
    two64 = ieee.two_to(64)
    low = F.pmod(total, two64)
    if t.kind == "u":
        return low.cast(D.spark_type(D.UINT64))
    return F.when(low >= ieee.two_to(63), low - two64).otherwise(low).cast("long")


def aggregate(name: str, x: Column, t: DType) -> Column:
    """The aggregate of a column of type t; usable in ``agg`` with or without groups."""
    out = reduced(name, t)
    if t.kind == "c":
        return _complex(name, x, out)
    empty = ieee.literal(identity(name, t), out)
    if name in ("any", "all"):
        found = (F.bool_or if name == "any" else F.bool_and)(ieee.truthy(x, t))
    elif name == "mean":
        found = F.avg(ieee.cast(x, t, D.FLOAT64))
    elif name in ("min", "max"):
        found = (F.min if name == "min" else F.max)(x)
        if t.kind == "b":
            found = (F.bool_and if name == "min" else F.bool_or)(x)
        elif t.kind == "f" and name == "min":
            # Spark's minimum passes over NaN, its maximum does not
            found = F.when(F.bool_or(F.isnan(x)), ieee.literal(math.nan, t)).otherwise(found)
    elif name == "sum":
        if t.kind == "f":
            found = F.sum(x.cast("double")).cast(D.spark_type(out))
        elif t.bits < 64:
            found = F.sum(ieee.cast(x, t, D.INT64)).cast(D.spark_type(out))
        else:
            found = wrapped_sum(x, out)
    elif t.kind == "f":
        found = F.product(x.cast("double")).cast(D.spark_type(out))
    elif t.kind == "b":
        found = F.bool_and(x).cast("int").cast("long")
    else:
        return _integer_product(x, t, out)
    return F.coalesce(found, empty)


def _complex(name: str, z: Column, out: DType) -> Column:
    re, im = z["re"].cast("double"), z["im"].cast("double")
    part = "float" if out.bits == 64 else "double"
    if name in ("any", "all"):
        found = (F.bool_or if name == "any" else F.bool_and)((re != 0) | (im != 0))
        return F.coalesce(found, F.lit(name == "all"))
    if name == "prod":
        size, angle = F.product(F.hypot(re, im)), F.sum(F.atan2(im, re))
        a, b = F.coalesce(size * F.cos(angle), F.lit(1.0)), F.coalesce(size * F.sin(angle), F.lit(0.0))
    else:
        f, empty = (F.sum, 0.0) if name == "sum" else (F.avg, math.nan)
        a, b = F.coalesce(f(re), F.lit(empty)), F.coalesce(f(im), F.lit(empty))
    return F.struct(a.cast(part).alias("re"), b.cast(part).alias("im"))
