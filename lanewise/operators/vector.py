"""The same typed trees over NumPy arrays: the evaluator of loops, and the oracle of the Columns."""

from __future__ import annotations

import math

import numpy as np

from lanewise import dtypes as D
from lanewise.dtypes import DType
from lanewise.errors import EvaluationError
from lanewise.functions import special
from lanewise.functions.text import ASCII_SPACE, UNICODE_SPACE
from lanewise.plans.typed import Typed

_UNARY = {
    "acos": np.arccos, "acosh": np.arccosh, "asin": np.arcsin, "asinh": np.arcsinh, "atan": np.arctan, "atanh": np.arctanh, "cbrt": np.cbrt,
    "cos": np.cos, "cosh": np.cosh, "exp": np.exp, "exp2": np.exp2, "expm1": np.expm1, "sin": np.sin, "sinh": np.sinh, "sqrt": np.sqrt,
    "tan": np.tan, "tanh": np.tanh, "ln": np.log, "log10": np.log10, "log2": np.log2, "log1p": np.log1p, "ceil": np.ceil, "floor": np.floor,
    "rint": np.rint, "trunc": np.trunc, "exp10": lambda x: np.power(10.0, x), "sinpi": lambda x: np.sin(math.pi * x), "cospi": lambda x: np.cos(math.pi * x),
    "round": lambda x: np.where(np.abs(x) < 2.0**52, np.copysign(np.floor(np.abs(x)) + (np.abs(x) - np.floor(np.abs(x)) >= 0.5), x), x),
    "sign": lambda x: np.where(np.isnan(x), x, np.sign(x)),
}


def _remainder(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda x, y: math.nan if y == 0 or math.isnan(y) or not math.isfinite(x) else math.remainder(x, y), otypes=[float])(a, b)


def _fdim(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(a) | np.isnan(b), np.nan, np.where(a > b, a - b, 0.0))


_BINARY = {
    "atan2": np.arctan2, "copysign": np.copysign, "fmax": np.fmax, "fmin": np.fmin, "hypot": np.hypot, "logaddexp": np.logaddexp, "nextafter": np.nextafter,
    "fmod": np.fmod, "mod": np.fmod, "pow": np.power, "remainder": _remainder, "fdim": _fdim, "ldexp": lambda x, e: np.ldexp(x, e.astype(np.int32)),
    "npr": lambda n, r: special.VECTOR["ncr"](n, r) * special.VECTOR["fac"](r),
}
_COMPARE = {"lt": np.less, "le": np.less_equal, "gt": np.greater, "ge": np.greater_equal, "eq": np.equal, "ne": np.not_equal}


def cast(x: np.ndarray, a: DType, b: DType) -> np.ndarray:
    if a == b:
        return x
    if a.kind == "c" and b.kind not in "cb":
        x = x.real
    if b.kind == "b":
        return x != 0
    if a.kind in "fc" and b.is_whole:
        low, high = D.limits(b)
        whole = np.trunc(np.where(np.isnan(x), 0, x))
        inside = np.clip(whole, float(low), float(high))
        out = np.where((inside < float(high)) & (inside > float(low)), inside, 0).astype(D.numpy_dtype(b))
        return np.where(whole >= float(high), np.array(high, out.dtype), np.where(whole <= float(low), np.array(low, out.dtype), out))
    return x.astype(D.numpy_dtype(b))


class Vector:
    """Evaluates trees over arrays of n lanes; ``values`` has each variable's array or scalar."""

    def __init__(self, n: int, values: dict[str, np.ndarray], reductions: dict[str, object] | None = None):
        self.n, self.values, self.reductions = n, values, reductions

    def run(self, t: Typed) -> np.ndarray:
        with np.errstate(all="ignore"):
            return self.eval(t)

    def eval(self, t: Typed) -> np.ndarray:
        kind = D.numpy_dtype(t.dtype) if not t.dtype.is_text else object
        if t.op == "const":
            value = t.value
            if t.dtype.is_whole:
                low, high = D.limits(t.dtype)
                value = (int(value) - low) % (high - low + 1) + low
            return np.full(self.n, value, kind)
        if t.op == "var":
            return self.values[t.value]
        if t.op == "reduce":
            if self.reductions is None:
                return np.full(self.n, reduce(t.value, self.eval(t.args[0]), t.args[0].dtype), kind)
            return np.full(self.n, self.reductions[str(t)], kind)
        a = [self.eval(x) for x in t.args]
        types = [x.dtype for x in t.args]
        if t.op == "cast":
            return cast(a[0], types[0], t.dtype)
        if t.op == "where":
            return np.where(*a)
        if t.op == "udf":
            return self.udf(t, a, types)
        if t.op in ("and", "or", "not"):
            return {"and": np.logical_and, "or": np.logical_or, "not": np.logical_not}[t.op](*a)
        if t.op in _COMPARE:
            return _COMPARE[t.op](*a)
        if any(x.is_text for x in types):
            return self.text(t, a, types)
        if t.dtype.kind == "b":
            return self.number(t, [x.astype(np.int8) for x in a], D.INT8) != 0
        return self.number(t, a, types[0])

    def number(self, t: Typed, a: list[np.ndarray], of: DType) -> np.ndarray:
        op, out = t.op, t.dtype
        if op in ("add", "sub", "mul"):
            return {"add": np.add, "sub": np.subtract, "mul": np.multiply}[op](*a)
        if op == "neg":
            return np.negative(a[0])
        if op in ("bitand", "bitor", "bitxor"):
            return {"bitand": np.bitwise_and, "bitor": np.bitwise_or, "bitxor": np.bitwise_xor}[op](*a)
        if op == "bitnot":
            return np.invert(a[0])
        if op in ("shl", "shr"):
            x, n = a[0].astype(np.int64), a[1].astype(np.int64) & 63
            return (np.left_shift if op == "shl" else np.right_shift)(x, n).astype(a[0].dtype)
        if op in ("real", "imag", "abs", "conj"):
            if op == "abs" and of.kind == "u":
                return a[0]
            return {"real": np.real, "imag": np.imag, "abs": np.abs, "conj": np.conj}[op](a[0]).astype(D.numpy_dtype(out))
        if of.is_whole:
            if op == "div":
                return self.whole_divide(*a)
            if op in ("floor", "ceil", "round", "trunc", "rint"):
                return a[0]
        if of.kind == "c":
            return {"div": np.divide, "pow": np.power, "sqrt": np.sqrt}[op](*a)
        if op == "nextafter" and out == D.FLOAT32:
            return np.nextafter(a[0], a[1])
        x = [v.astype(np.float64) for v in a]
        if op == "fma" and out == D.FLOAT32:
            return _fma32(*x)
        if op == "div":
            found = np.divide(*x)
        elif op == "fma":
            found = np.vectorize(_fma, otypes=[float])(*x)
        else:
            found = _UNARY[op](x[0]) if op in _UNARY else _BINARY[op](*x) if op in _BINARY else special.VECTOR[op](*x)
        return cast(found, D.FLOAT64, out)

    @staticmethod
    def whole_divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        safe = np.where(b == 0, np.ones_like(b), b)
        if a.dtype.kind == "u":
            out = a // safe
        else:
            out = a // safe
            out = out + ((out < 0) & (a % safe != 0)).astype(a.dtype)
            out = np.where(safe == -1, np.negative(a), out)
        return np.where(b == 0, np.zeros_like(a), out).astype(a.dtype)

    def udf(self, t: Typed, a: list[np.ndarray], types: list[DType]) -> np.ndarray:
        import pandas as pd

        if not t.value.vector:
            raise EvaluationError("a Column function inside a loop; register it over Series")
        x = [pd.Series(v if k.is_text else v.astype(np.float64)) for v, k in zip(a, types)]
        return cast(np.asarray(t.value.apply(*x), dtype=float), D.FLOAT64, t.dtype)

    def text(self, t: Typed, a: list[np.ndarray], types: list[DType]) -> np.ndarray:
        raw = types[0].kind == "S"
        width = t.dtype.width
        if t.op in ("text_eq", "text_ne", "filled", "startswith", "endswith", "contains"):
            test = {"text_eq": lambda x, y: x == y, "text_ne": lambda x, y: x != y, "filled": lambda x: len(x) > 0, "startswith": lambda x, y: x.startswith(y), "endswith": lambda x, y: x.endswith(y), "contains": lambda x, y: y in x}[t.op]
            return np.array([test(*v) for v in zip(*a)], bool)
        space = ASCII_SPACE.encode() if raw else UNICODE_SPACE

        def substr(x):
            start, count = t.value
            start = max(len(x) + start, 0) if start < 0 else start
            return x[start : start + max(count, 0)]

        def part(x, mark):
            head, found, tail = x.partition(mark)
            return head if t.value <= 0 else tail

        change = {
            "concat": lambda x, y: x + y, "lower": lambda x: x.lower() if raw else "".join(c.lower() for c in x)[:width], "upper": lambda x: x.upper() if raw else x.upper()[:width],
            "strip": lambda x: x.strip(space), "lstrip": lambda x: x.lstrip(space), "rstrip": lambda x: x.rstrip(space), "removeprefix": lambda x, p: x.removeprefix(p),
            "removesuffix": lambda x, p: x.removesuffix(p), "replace": lambda x, o, n: x.replace(o, n), "substr": substr, "split_part": part, "cut": lambda x: x[:width],
        }[t.op]
        out = np.empty(self.n, object)
        out[:] = [change(*v) for v in zip(*a)]
        return out


def _fma(x: float, y: float, z: float) -> float:
    if not (math.isfinite(x) and math.isfinite(y) and math.isfinite(z)):
        return x * y + z
    from fractions import Fraction

    exact = Fraction(x) * Fraction(y) + Fraction(z)
    try:
        return float(exact) if exact else x * y + z
    except OverflowError:
        return math.copysign(math.inf, exact)


def _fma32(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """x * y + z of floats, rounded once: the product is exact in doubles, and a sum that isn't is made
    odd, so that rounding it again to a float goes the right way."""
    product = x * y
    total = product + z
    back = total - product
    lost = (product - (total - back)) + (z - back)
    odd = total.view(np.int64) & 1
    toward = np.where(lost > 0, np.inf, -np.inf)
    return np.where(np.isfinite(total) & (lost != 0) & (odd == 0), np.nextafter(total, toward), total).astype(np.float32)


def reduce(name: str, x: np.ndarray, t: DType) -> object:
    """A reduction of an array, with the identities of an empty one."""
    from lanewise.operators.reductions import identity
    from lanewise.plans.typed import reduced

    out = D.numpy_dtype(reduced(name, t))
    if not len(x):
        return np.array(complex(math.nan, math.nan) if name == "mean" and t.kind == "c" else identity(name, t)).astype(out)[()]
    wide = np.complex128 if t.kind == "c" else np.float64 if t.kind == "f" else out
    if name in ("any", "all"):
        return {"any": np.any, "all": np.all}[name](x != 0)
    if name in ("min", "max"):
        return {"min": np.min, "max": np.max}[name](x)
    if name == "mean":
        return x.astype(np.complex128 if t.kind == "c" else np.float64).mean()
    return {"sum": np.sum, "prod": np.prod}[name](x.astype(wide)).astype(out)
