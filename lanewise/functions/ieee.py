"""Column helpers with the arithmetic of C and IEEE 754, whatever spark.sql.ansi.enabled is.

Each returns null for null operands. Operands used more than once are repeated in the expression;
Spark's generated code evaluates equal subexpressions once, and the lowering binds large operands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import dtypes as D
from lanewise.dtypes import DType

NAN, INF = math.nan, math.inf


def spark(t: DType):
    return D.spark_type(t)


def negative(x: Column) -> Column:
    """The sign bit; zeros tell theirs by their reciprocal."""
    return (x < 0) | ((x == 0) & (F.pow(x, F.lit(-1.0)) < 0))


def divide(a: Column, b: Column, divisor: float | None = None) -> Column:
    """a / b of doubles; divisor: its value if b is a constant."""
    if divisor is not None and divisor != 0 and not math.isnan(divisor):
        return a / b
    both = a.isNotNull() & b.isNotNull()
    return F.when(b != 0, F.try_divide(a, b)).when(both & (F.isnan(a) | (a == 0)), NAN).when(both & (negative(a) == negative(b)), INF).when(both, -INF)


def fmod(a: Column, b: Column, divisor: float | None = None) -> Column:
    """The remainder with the dividend's sign."""
    if divisor is not None and divisor != 0 and not math.isnan(divisor):
        return a % b
    return F.when((b == 0) & a.isNotNull(), NAN).otherwise(F.try_mod(a, b))


def remainder(a: Column, b: Column) -> Column:
    """a less the nearest multiple of b, the even one of two; exact, as all its subtractions are."""
    size = F.abs(b)
    rest = F.try_mod(F.abs(a), size + size)
    once = rest - size
    near = F.when(rest <= size - rest, rest).when(once >= size - once, once - size).otherwise(once)
    out = F.when(negative(a), -near).otherwise(near)
    odd = (b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF)
    return F.when(odd & a.isNotNull() & b.isNotNull(), NAN).when(size == INF, a).when(a.isNotNull() & b.isNotNull(), out)


def _log(f, x: Column) -> Column:
    return F.when(x > 0, f(x)).when(x == 0, -INF).when(x.isNotNull(), NAN)


def ln(x: Column) -> Column:
    return _log(F.log, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def log1p(x: Column) -> Column:
    return F.when(x > -1, F.log1p(x)).when(x == -1, -INF).when(x.isNotNull(), NAN)


_WHOLE = float(1 << 52)


def rounding(f, x: Column) -> Column:
    """f of doubles that have a fraction; larger ones, infinities and NaN as they are."""
    return F.when(F.abs(x) < _WHOLE, f(x).cast("double")).otherwise(x)


def floor(x: Column) -> Column:
    return rounding(F.floor, x)


def ceil(x: Column) -> Column:
    return rounding(F.ceil, x)


def trunc(x: Column) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def half_away(x: Column) -> Column:
    """Round, halves away from zero."""
    up = F.when(F.abs(x) - F.floor(F.abs(x)).cast("double") >= 0.5, 1.0).otherwise(0.0)
    return F.when(F.abs(x) < _WHOLE, F.signum(x) * (F.floor(F.abs(x)).cast("double") + up)).otherwise(x)


def sign(x: Column) -> Column:
    return F.when(F.isnan(x), x).when(x > 0, 1.0).when(x < 0, -1.0).when(x.isNotNull(), 0.0)


def copysign(a: Column, b: Column) -> Column:
    return F.when(negative(b), -F.abs(a)).when(b.isNotNull(), F.abs(a))


def fmax(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def fmin(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def fdim(a: Column, b: Column) -> Column:
    return F.when(F.isnan(a) | F.isnan(b), NAN).when(a > b, a - b).when(a.isNotNull() & b.isNotNull(), 0.0)


def compare(op: str, a: Column, b: Column, real: bool) -> Column:
    """Comparison; of floats (real), NaN is neither equal to, nor less or greater than anything."""
    plain = {"lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b, "eq": a == b, "ne": a != b}[op]
    if not real:
        return plain
    if op in ("lt", "le"):
        return plain & ~F.isnan(b)
    if op == "ne":
        return plain | F.isnan(a)
    return plain & ~F.isnan(a)


def truthy(x: Column, t: DType) -> Column:
    if t.kind == "b":
        return x
    if t.kind == "c":
        return (x["re"] != 0) | (x["im"] != 0)
    return x != 0


# Integers

_LOW = (1 << 32) - 1
_DECIMAL = "decimal(38,0)"


def two_to(n: int) -> Column:
    """2 ** n as a wide decimal."""
    return F.lit(str(1 << n)).cast(_DECIMAL)


def fit(x: Column, t: DType) -> Column:
    """A bigint (a wide decimal for 64 unsigned bits) wrapped to the integers of t."""
    if t == D.UINT64:
        return F.pmod(x.cast(_DECIMAL), two_to(64)).cast(spark(t))
    if t.kind == "u":
        return x.bitwiseAND((1 << t.bits) - 1).cast(spark(t))
    if t.bits == 64:
        return x
    return F.shiftright(F.shiftleft(x, 64 - t.bits), 64 - t.bits).cast(spark(t))


def long_sum(terms: list[tuple[int, Column]]) -> Column:
    """The wrapping sum of bigints with signs: added one to the next, and where that overflows as decimals."""
    plain = None
    for sign, x in terms:
        if plain is None:
            plain = x if sign > 0 else F.try_subtract(F.lit(0).cast("long"), x)
        else:
            plain = F.try_add(plain, x) if sign > 0 else F.try_subtract(plain, x)
    wide = None
    for sign, x in terms:
        x = x.cast(_DECIMAL)
        wide = (x if sign > 0 else -x) if wide is None else (wide + x if sign > 0 else wide - x).cast(_DECIMAL)
    return F.coalesce(plain, (F.pmod(wide + two_to(63), two_to(64)) - two_to(63)).cast("long"))


def _long_multiply(a: Column, b: Column) -> Column:
    """Products of 32-bit halves, added without overflow."""
    low_a, low_b, high_a, high_b = a.bitwiseAND(_LOW), b.bitwiseAND(_LOW), F.shiftright(a, 32), F.shiftright(b, 32)
    top, bottom = F.shiftright(low_b, 16), low_b.bitwiseAND(0xFFFF)
    middle = (high_a * low_b).bitwiseAND(_LOW) + (low_a * high_b).bitwiseAND(_LOW)
    first = F.shiftleft(low_a * top, 16)
    slow = long_sum([(1, first), (1, low_a * bottom), (1, F.shiftleft(middle, 32))])
    return F.coalesce(F.try_multiply(a, b), slow)


def _unsigned_multiply(a: Column, b: Column) -> Column:
    a, b = a.cast(_DECIMAL), b.cast(_DECIMAL)
    half = two_to(32)
    # the quotient of a multiple is exact; that of b itself would be rounded
    high, low = ((b - b % half) / half).cast("decimal(10,0)"), (b % half).cast("decimal(10,0)")
    a20 = a.cast("decimal(20,0)")
    return F.pmod((a20 * high).cast(_DECIMAL) % half * half + (a20 * low).cast(_DECIMAL), two_to(64))


def whole(op: str, a: Column, b: Column, t: DType) -> Column:
    """add, sub or mul of integers of t, wrapping."""
    if t == D.UINT64:
        if op == "mul":
            return _unsigned_multiply(a, b).cast(spark(t))
        a, b = a.cast(_DECIMAL), b.cast(_DECIMAL)
        return fit(a + b if op == "add" else a - b, t)
    a, b = a.cast("long"), b.cast("long")
    if t.bits == 64:
        return _long_multiply(a, b) if op == "mul" else long_sum([(1, a), (1 if op == "add" else -1, b)])
    if op == "mul":
        return fit(_long_multiply(a, b) if t.bits == 32 and t.kind == "u" else a * b, t)
    return fit(a + b if op == "add" else a - b, t)


def negate(a: Column, t: DType) -> Column:
    if t == D.UINT64:
        return fit(-a.cast(_DECIMAL), t)
    return long_sum([(-1, a)]) if t.bits == 64 else fit(-a.cast("long"), t)


def whole_divide(a: Column, b: Column, t: DType) -> Column:
    """The quotient cut towards zero; 0 for a zero divisor."""
    zero = F.lit(0).cast(spark(t))
    if t == D.UINT64:
        a, b = a.cast(_DECIMAL), b.cast(_DECIMAL)
        return F.when(b == 0, zero).when(a.isNotNull() & b.isNotNull(), ((a - a % F.when(b == 0, F.lit(1)).otherwise(b)) / F.when(b == 0, F.lit(1)).otherwise(b)).cast(spark(t)))
    a, b = a.cast("long"), b.cast("long")
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    quotient = F.call_function("div", a, F.when(safe == -1, F.lit(1)).otherwise(safe))
    return F.when((b == 0) & a.isNotNull(), zero).when(b == -1, negate(a, t).cast(spark(t))).otherwise(fit(quotient, t))


def bits(op: str, a: Column, b: Column, t: DType) -> Column:
    if t == D.UINT64:
        a, b = as_signed(a), as_signed(b)
        return as_unsigned({"bitand": a.bitwiseAND(b), "bitor": a.bitwiseOR(b), "bitxor": a.bitwiseXOR(b)}[op])
    return {"bitand": a.bitwiseAND(b), "bitor": a.bitwiseOR(b), "bitxor": a.bitwiseXOR(b)}[op]


def as_signed(x: Column) -> Column:
    """The same 64 bits as a bigint."""
    d = x.cast(_DECIMAL)
    return F.when(d >= two_to(63), (d - two_to(64))).otherwise(d).cast("long")


def as_unsigned(x: Column) -> Column:
    return F.pmod(x.cast(_DECIMAL), two_to(64)).cast(spark(D.UINT64))


def shift(op: str, a: Column, b: Column, t: DType) -> Column:
    """Shifts in 64 bits, then wrapped; counts are taken modulo 64."""
    x = as_signed(a) if t == D.UINT64 else a.cast("long")
    n = (as_signed(b) if t == D.UINT64 else b.cast("long")).bitwiseAND(63).cast("int")
    out = F.call_function("shiftleft" if op == "shl" else "shiftright", x, n)
    return as_unsigned(out) if t == D.UINT64 else fit(out, t)


# Conversions


def cast(x: Column, a: DType, b: DType) -> Column:
    """The C conversion; a float beyond an integer type's range gives its nearest end, NaN gives 0."""
    if a == b:
        return x
    if b.kind == "c":
        if a.kind == "c":
            parts = x["re"], x["im"]
        else:
            parts = cast(x, a, D.FLOAT64), F.when(x.isNotNull(), F.lit(0.0))
        part = "float" if b.bits == 64 else "double"
        return F.when(x.isNotNull(), F.struct(parts[0].cast(part).alias("re"), parts[1].cast(part).alias("im")))
    if a.kind == "c":
        return cast(x["re"], D.FLOAT32 if a.bits == 64 else D.FLOAT64, b)
    if b.kind == "b":
        return truthy(x, a)
    if b.kind == "f":
        return x.cast("int").cast(spark(b)) if a.kind == "b" else x.cast(spark(b))
    if a.kind == "b":
        return x.cast("int").cast(spark(b))
    if a.kind == "f":
        low, high = D.limits(b)
        x = x.cast("double")
        if b.bits == 64:
            # the largest double below the end of the type's range
            inside = F.when(x >= float(high), F.lit(str(high)).cast("decimal(20,0)")).when(x <= float(low), F.lit(str(low)).cast("decimal(20,0)"))
            return F.when(F.isnan(x), F.lit(0).cast("decimal(20,0)")).otherwise(inside.otherwise(trunc(x).cast("decimal(20,0)"))).cast(spark(b))
        return F.when(F.isnan(x), F.lit(0)).otherwise(F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))).cast("long")).cast(spark(b))
    if b == D.UINT64:
        return fit(x, b)
    return fit(as_signed(x) if a == D.UINT64 else x.cast("long"), b)


def literal(value: object, t: DType) -> Column:
    if t.kind == "c":
        v = complex(value)
        part = "float" if t.bits == 64 else "double"
        return F.struct(F.lit(v.real).cast(part).alias("re"), F.lit(v.imag).cast(part).alias("im"))
    if t.is_text:
        return F.lit(value if t.kind == "U" else bytearray(value))
    if t.kind == "b":
        return F.lit(bool(value))
    if t.is_whole:
        low, high = D.limits(t)
        wrapped = (int(value) - low) % (high - low + 1) + low
        return F.lit(str(wrapped)).cast(spark(t)) if t == D.UINT64 else F.lit(wrapped).cast(spark(t))
    return F.lit(float(value)).cast(spark(t))
