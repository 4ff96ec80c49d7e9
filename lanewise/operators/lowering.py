"""From typed trees to Spark Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import dtypes as D
from lanewise.dtypes import DType
from lanewise.errors import EvaluationError
from lanewise.functions import complex as C
from lanewise.functions import ieee, special
from lanewise.functions.text import Text
from lanewise.plans.typed import COMPARISONS, Typed, constant

_SIMPLE: dict[str, Callable[[Column], Column]] = {
    "acos": F.acos, "acosh": F.acosh, "asin": F.asin, "asinh": F.asinh, "atan": F.atan, "atanh": F.atanh, "cbrt": F.cbrt,
    "cos": F.cos, "cosh": F.cosh, "exp": F.exp, "expm1": F.expm1, "sin": F.sin, "sinh": F.sinh, "sqrt": F.sqrt, "tan": F.tan, "tanh": F.tanh,
    "ln": ieee.ln, "log10": ieee.log10, "log2": ieee.log2, "log1p": ieee.log1p,
    "exp2": lambda x: F.pow(F.lit(2.0), x), "exp10": lambda x: F.pow(F.lit(10.0), x),
    "sinpi": lambda x: F.sin(F.lit(math.pi) * x), "cospi": lambda x: F.cos(F.lit(math.pi) * x),
    "fac": special.factorial_column,
    "ceil": ieee.ceil, "floor": ieee.floor, "rint": F.rint, "round": ieee.half_away, "trunc": ieee.trunc, "sign": ieee.sign, "abs": F.abs,
}


def _java(name: str, *x: Column, kind: str = "double") -> Column:
    """A method of Java's Math; of floats, its overload for floats."""
    whole = x[0].isNotNull()
    for a in x[1:]:
        whole = whole & a.isNotNull()
    return F.when(whole, F.reflect(F.lit("java.lang.Math"), F.lit(name), *x).cast(kind))


def _logaddexp(a: Column, b: Column) -> Column:
    top, low = ieee.fmax(a, b), ieee.fmin(a, b)
    return F.when(F.isnan(a) | F.isnan(b), ieee.NAN).when(a == b, a + math.log(2)).otherwise(top + F.log1p(F.exp(low - top)))


def _ldexp(x: Column, e: Column) -> Column:
    """By two factors, as one alone may be out of range where the result is not."""
    e = ieee.cast(e, D.FLOAT64, D.INT32).cast("double")
    half = ieee.trunc(e / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)


_DOUBLE: dict[str, Callable[[Column, Column], Column]] = {
    "atan2": F.atan2, "copysign": ieee.copysign, "fdim": ieee.fdim, "fmax": ieee.fmax, "fmin": ieee.fmin, "hypot": F.hypot, "ldexp": _ldexp,
    "logaddexp": _logaddexp, "pow": F.pow, "npr": lambda n, r: special.call("ncr", n, r) * special.factorial_column(r),
    "nextafter": lambda a, b: _java("nextAfter", a, b), "remainder": ieee.remainder,
}


#: Operators whose Columns hold their operands once; those of the others repeat them.
_ONCE = {"and", "or", "not", "where", "lt", "le", "gt", "ge", "eq", "ne", "cast", "neg", "const", "var", "reduce", "udf"}
_ONCE |= {"exp", "sin", "cos", "tan", "sqrt", "asin", "acos", "atan", "sinh", "cosh", "tanh", "cbrt", "expm1", "exp2", "exp10", "atan2", "hypot", "pow"}
#: Nodes of an operand from which on it is bound to a name instead of being repeated.
_LARGE = 120


class Lowering:
    """Builds Columns. ``columns`` gives each variable's Column, ``reduction`` that of a reduction node."""

    def __init__(self, columns: Callable[[str], Column], reduction: Callable[[Typed], Column] | None = None):
        self.columns, self.reduction = columns, reduction
        self.weights: dict[int, int] = {}

    def repeats(self, n: Typed) -> int:
        """About how often the Column of a node holds its operands."""
        t = n.dtype
        if n.op in ("add", "sub", "mul"):
            return 1 if t.kind in "fb" or t.kind in "iu" and t.bits < 64 else 2 if n.op != "mul" else 4
        return 1 if n.op in _ONCE or any(a.dtype.is_text for a in n.args) else 4

    def weight(self, n: Typed) -> int:
        """About how many nodes the Column of n has."""
        if id(n) not in self.weights:
            inner = sum(self.weight(a) for a in n.args)
            self.weights[id(n)] = 1 + (inner if inner > _LARGE else inner * self.repeats(n))
        return self.weights[id(n)]

    def terms(self, n: Typed, sign: int) -> list[tuple[int, Column]]:
        """A sum of 64-bit integers as its terms, which may wrap in any order."""
        if n.dtype == D.INT64 and n.op in ("add", "sub"):
            return self.terms(n.args[0], sign) + self.terms(n.args[1], sign if n.op == "add" else -sign)
        if n.dtype == D.INT64 and n.op == "neg":
            return self.terms(n.args[0], -sign)
        return [(sign, self.lower(n))]

    def lower(self, n: Typed) -> Column:
        t = n.dtype
        if n.op == "const":
            return ieee.literal(n.value, t)
        if n.op == "var":
            return self.columns(n.value)
        if n.op == "reduce":
            if self.reduction is None:
                raise EvaluationError("a reduction has no value for a single row; apply the expression to a DataFrame")
            return self.reduction(n)
        types = [a.dtype for a in n.args]
        if t == D.INT64 and n.op in ("add", "sub", "neg"):
            return ieee.long_sum(self.terms(n, 1))
        args = [self.lower(a) for a in n.args]
        if sum(self.weight(a) for a in n.args) > _LARGE and self.repeats(n) > 1 and not self.in_python(n):
            # a lambda binds the operands once; it costs generated code for this node only
            one = F.array(F.struct(*[a.alias(f"a{i}") for i, a in enumerate(args)]))
            return F.element_at(F.transform(one, lambda s: self.operation(n, [s[f"a{i}"] for i in range(len(args))], types)), 1)
        return self.operation(n, args, types)

    def in_python(self, n: Typed) -> bool:
        return n.op in ("erf", "erfc", "lgamma", "tgamma", "ncr", "npr", "udf")

    def operation(self, n: Typed, args: list[Column], types: list[DType]) -> Column:
        t = n.dtype
        if n.op == "cast":
            return ieee.cast(args[0], types[0], t)
        if n.op == "udf":
            return self.udf(n, args, types)
        if n.op == "where":
            return F.when(args[0], args[1]).when(args[0].isNotNull(), args[2])
        if n.op in ("and", "or", "not"):
            return ~args[0] if n.op == "not" else args[0] & args[1] if n.op == "and" else args[0] | args[1]
        if n.op in COMPARISONS:
            if types[0].kind == "c":
                same = (args[0]["re"] == args[1]["re"]) & (args[0]["im"] == args[1]["im"])
                return same if n.op == "eq" else ~same
            return ieee.compare(n.op, *args, real=types[0].kind == "f")
        if any(x.is_text for x in types):
            return self.text(n, args, types)
        if any(x.kind == "c" for x in types):
            return self.complex(n, args, types[0])
        if t.kind == "b" and n.op in ("add", "sub", "mul", "div", "mod", "pow", "neg"):
            # numbers of eight bits, true again if not zero
            return self.arithmetic(n, [a.cast("int").cast("byte") for a in args], D.INT8) != 0
        return self.arithmetic(n, args, t)

    def arithmetic(self, n: Typed, args: list[Column], t: DType) -> Column:
        op, divisor = n.op, constant(n.args[1]) if len(n.args) == 2 else None
        if op in ("bitand", "bitor", "bitxor"):
            return ieee.bits(op, *args, t)
        if op in ("shl", "shr"):
            return ieee.shift(op, *args, t)
        if op == "bitnot":
            return ieee.as_unsigned(F.bitwise_not(ieee.as_signed(args[0]))) if t == D.UINT64 else ieee.fit(F.bitwise_not(args[0].cast("long")), t)
        if op == "conj" or op == "real":
            return args[0]
        if op == "imag":
            return F.when(args[0].isNotNull(), ieee.literal(0, t))
        if t.is_whole:
            whole = self.whole(op, args, t, divisor)
            if whole is not None:
                return whole
        if t == D.FLOAT32 and op in ("add", "sub", "mul"):
            return args[0] + args[1] if op == "add" else args[0] - args[1] if op == "sub" else args[0] * args[1]
        if t == D.FLOAT32 and op == "nextafter":
            return _java("nextAfter", args[0], args[1].cast("double"), kind="float")
        if t == D.FLOAT32 and op == "fma":
            return _java("fma", *args, kind="float")
        x = [ieee.cast(a, t, D.FLOAT64) for a in args]
        return ieee.cast(self.real(op, x, divisor), D.FLOAT64, t)

    def whole(self, op: str, args: list[Column], t: DType, divisor: float | None) -> Column | None:
        """Operations that stay with integers; the others go through doubles."""
        if op in ("add", "sub", "mul"):
            return ieee.whole(op, *args, t)
        if op == "neg":
            return ieee.negate(args[0], t)
        if op == "div":
            return ieee.whole_divide(*args, t)
        if op in ("floor", "ceil", "round", "trunc", "rint"):
            return args[0]
        if op == "abs":
            return args[0] if t.kind == "u" else F.when(args[0] < 0, ieee.negate(args[0], t)).otherwise(args[0])
        if op == "mod" and divisor and t.bits < 64:
            return (args[0].cast("long") % int(divisor)).cast(D.spark_type(t))
        return None

    def real(self, op: str, x: list[Column], divisor: float | None) -> Column:
        if op == "add":
            return x[0] + x[1]
        if op == "sub":
            return x[0] - x[1]
        if op == "mul":
            return x[0] * x[1]
        if op == "neg":
            return -x[0]
        if op == "div":
            return ieee.divide(*x, divisor)
        if op in ("mod", "fmod"):
            return ieee.fmod(*x, divisor)
        if op == "fma":
            return _java("fma", *x)
        if op in _SIMPLE:
            return _SIMPLE[op](x[0])
        if op in _DOUBLE:
            return _DOUBLE[op](*x)
        return special.call(op, *x)

    def complex(self, n: Typed, args: list[Column], t: DType) -> Column:
        if n.op in ("add", "sub", "mul", "div", "pow"):
            return C.binary(n.op, *args, n.dtype)
        if n.op == "abs":
            return ieee.cast(C.modulus(args[0]), D.FLOAT64, n.dtype)
        if n.op in ("real", "imag"):
            return args[0]["re" if n.op == "real" else "im"]
        return {"neg": C.negate, "conj": C.conj, "sqrt": C.sqrt}[n.op](args[0], n.dtype)

    def text(self, n: Typed, args: list[Column], types: list[DType]) -> Column:
        if n.op == "text_eq":
            return args[0] == args[1]
        if n.op == "text_ne":
            return args[0] != args[1]
        family = Text(types[0].kind)
        args = [family.read(a) if x.is_text else a for a, x in zip(args, types)]
        if n.op == "filled":
            return F.length(args[0]) > 0
        if n.op in ("startswith", "endswith", "contains"):
            return getattr(F, n.op)(*args)
        if n.op == "cut":
            return family.write(family.width(args[0], n.dtype.width))
        if n.op == "concat":
            return family.write(F.concat(*args))
        if n.op in ("substr", "split_part"):
            more = n.value if n.op == "substr" else (n.value,)
            return family.write(getattr(family, n.op)(*args, *more))
        out = getattr(family, n.op)(*args)
        # changing case may lengthen text, which then loses its end
        return family.write(family.width(out, n.dtype.width) if n.op in ("lower", "upper") else out)

    def udf(self, n: Typed, args: list[Column], types: list[DType]) -> Column:
        doubles = [a if x.is_text else ieee.cast(a, x, D.FLOAT64) for a, x in zip(args, types)]
        udf = n.value
        if not udf.vector:
            return ieee.cast(udf.apply(*doubles), D.FLOAT64, n.dtype)
        if not doubles:
            return ieee.literal(float(udf.apply()), n.dtype)

        def lanes(*x):
            return udf.apply(*[pd.Series(v) for v in x]) if len(x[0]) else []

        lanes.__lanes__ = len(doubles)
        null = doubles[0].isNull()
        for d in doubles[1:]:
            null = null | d.isNull()
        return ieee.cast(F.when(~null, special.over_arrow(lanes, pure=udf.pure)(*doubles)), D.FLOAT64, n.dtype)
