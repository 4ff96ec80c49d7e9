"""Functions that Spark has no expression for: over whole Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


# The published rational approximations of erf by Cody (1969), numerators and
# denominators by falling powers.
_SMALL = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
_MIDDLE = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
_LARGE = (
    (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4),
    (1.0, 2.56852019228982242, 1.87295284992346047, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3),
)


def _ratio(x: np.ndarray, parts: tuple[tuple[float, ...], tuple[float, ...]]) -> np.ndarray:
    above, below = (0.0 * x + p[0] for p in parts)
    for a, b in zip(parts[0][1:], parts[1][1:]):
        above, below = above * x + a, below * x + b
    return above / below


def _tail(y: np.ndarray) -> np.ndarray:
    """erfc of y above 0.46875; the square is split so that its exponential keeps all digits."""
    near = np.floor(y * 16.0) / 16.0
    inverse = 1.0 / (y * y)
    far = (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, _LARGE)) / y
    return np.exp(-near * near) * np.exp((near - y) * (near + y)) * np.where(y <= 4.0, _ratio(y, _MIDDLE), far)


def _erfs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """erf and erfc."""
    with np.errstate(all="ignore"):
        y = np.abs(x)
        small = x * _ratio(np.minimum(y, 1) ** 2, _SMALL)
        z = np.clip(y, 0.46875, 30.0)
        tail = np.where(np.isnan(x), x, _tail(z))
        return np.where(y <= 0.46875, small, np.copysign(1 - tail, x)), np.where(y <= 0.46875, 1 - small, np.where(x < 0, 2 - tail, tail))


def factorial_column(n: Column) -> Column:
    """NaN outside the domain, infinite from 21 on."""
    return F.when(F.isnan(n) | (n < 0), math.nan).when(n < 21, F.factorial(n.cast("int")).cast("double")).when(n.isNotNull(), math.inf)


def lgamma(x: np.ndarray) -> np.ndarray:
    """Infinite at the poles, as in C."""
    pole = np.isinf(x) | ((x <= 0) & (x == np.floor(x)))
    out = np.fromiter(map(math.lgamma, np.where(pole, 1.0, x).tolist()), float, len(x))
    out[pole] = math.inf
    return out


def tgamma(x: np.ndarray) -> np.ndarray:
    """C's values where Python raises: poles, overflow, and minus infinity."""
    odd = np.isnan(x) | ((x <= 0) & (x == np.floor(x))) | (x > 171.7) | np.isinf(x)
    out = np.fromiter(map(math.gamma, np.where(odd, 1.0, x).tolist()), float, len(x))
    out[odd] = np.select([x[odd] == 0, x[odd] < 0], [np.copysign(math.inf, x[odd]), math.nan], np.where(np.isnan(x[odd]), math.nan, math.inf))
    return out


def choose(n: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Combinations of whole parts; NaN outside the domain, infinite beyond 64 bits unsigned."""
    with np.errstate(all="ignore"):
        inside = (n >= 0) & (r >= 0) & (n >= r)
        huge = inside & (n >= 2.0**64)
        fits = inside & ~huge
        whole, part = (np.where(fits, v, 0).astype(np.uint64) for v in (n, r))
        part = np.minimum(part, whole - part)
        # from 34 on both sides of the middle, all are beyond 64 bits
        out, over = np.ones(len(n), np.uint64), part >= 34
        for i in range(1, int(part[~over].max(initial=0)) + 1):
            on = (part >= i) & ~over
            factor, divisor = np.where(on, whole - part + np.uint64(i), 1).astype(np.uint64), np.uint64(i)
            common = np.gcd(out, divisor)
            factor //= divisor // common
            quotient = out // common
            over |= on & (quotient > np.uint64(0xFFFFFFFFFFFFFFFF) // np.maximum(factor, 1))
            out = np.where(on & ~over, quotient * factor, out)
        found = np.where(over, math.inf, out.astype(float))
        found = np.where(huge, np.where(np.floor(np.minimum(r, n - r)) == 0, 1.0, math.inf), found)
        return np.where(inside, found, math.nan)


def factorial(n: np.ndarray) -> np.ndarray:
    table = np.array([float(math.factorial(i)) for i in range(21)])
    known = (n >= 0) & (n < 21)
    return np.where(known, table[np.where(known, n, 0).astype(np.int64)], np.where(n >= 21, math.inf, math.nan))


VECTOR = {"erf": lambda x: _erfs(x)[0], "erfc": lambda x: _erfs(x)[1], "lgamma": lgamma, "tgamma": tgamma, "ncr": choose, "fac": factorial}


def over_arrow(f: Callable, result: str = "double", pure: bool = True):
    """A UDF over Arrow arrays of doubles from a function of NumPy arrays; NaN stays NaN."""

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array(np.asarray(f(*[c.to_numpy(zero_copy_only=False) for c in columns]), dtype=float))

    # arrow_udf takes the number of columns from the function it wraps
    wrapped = {1: lambda a: run(a), 2: lambda a, b: run(a, b), 3: lambda a, b, c: run(a, b, c)}
    count = f.__lanes__ if hasattr(f, "__lanes__") else 1
    if count not in wrapped:
        names = ", ".join(f"a{i}" for i in range(count))
        wrapped[count] = eval(f"lambda {names}: run({names})", {"run": run})  # noqa: S307
    udf = F.arrow_udf(wrapped[count], result)
    return udf if pure else udf.asNondeterministic()


def call(name: str, *args: Column) -> Column:
    """The function; null for null."""
    f = VECTOR[name]

    def lanes(*x: np.ndarray) -> np.ndarray:
        return f(*x) if len(x[0]) else np.zeros(0)

    lanes.__lanes__ = len(args)
    null = args[0].isNull()
    for a in args[1:]:
        null = null | a.isNull()
    return F.when(~null, over_arrow(lanes)(*args))
