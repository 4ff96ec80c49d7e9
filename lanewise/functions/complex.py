"""Complex numbers as structs of re and im."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.dtypes import DType
from lanewise.functions import ieee


def parts(z: Column) -> tuple[Column, Column]:
    return z["re"].cast("double"), z["im"].cast("double")


def make(re: Column, im: Column, t: DType, *of: Column) -> Column:
    """The number with these parts; null if one of the numbers it is made of is null."""
    part = "float" if t.bits == 64 else "double"
    whole = of[0].isNotNull()
    for z in of[1:]:
        whole = whole & z.isNotNull()
    return F.when(whole, F.struct(re.cast(part).alias("re"), im.cast(part).alias("im")))


def modulus(z: Column) -> Column:
    return F.hypot(*parts(z))


def binary(op: str, x: Column, y: Column, t: DType) -> Column:
    (a, b), (c, d) = parts(x), parts(y)
    if op == "add":
        return make(a + c, b + d, t, x, y)
    if op == "sub":
        return make(a - c, b - d, t, x, y)
    if op == "mul":
        return make(a * c - b * d, a * d + b * c, t, x, y)
    if op == "div":
        square = c * c + d * d
        # scaled by the divisor's larger part where squares over- or underflow; without one, IEEE division by zero
        scale = F.greatest(F.abs(c), F.abs(d))
        p, q = F.try_divide(c, scale), F.try_divide(d, scale)
        below = scale * (p * p + q * q)
        plain = (square > 1e-280) & (square < 1e280)
        part = lambda above, scaled, alone: F.when(plain, F.try_divide(above, square)).when(scale > 0, F.try_divide(scaled, below)).otherwise(ieee.divide(alone, scale))
        return make(part(a * c + b * d, a * p + b * q, a), part(b * c - a * d, b * p - a * q, b), t, x, y)
    return power(x, y, t)


def power(x: Column, y: Column, t: DType) -> Column:
    """exp(y log x); 0 to the power of 0 is 1."""
    (a, b), (c, d) = parts(x), parts(y)
    size, angle = F.hypot(a, b), F.atan2(b, a)
    log = ieee.ln(size)
    grown = F.exp(c * log - d * angle)
    turned = d * log + c * angle
    zero = size == 0
    re = F.when(zero, F.when((c == 0) & (d == 0), 1.0).otherwise(0.0)).otherwise(grown * F.cos(turned))
    im = F.when(zero, 0.0).otherwise(grown * F.sin(turned))
    return make(re, im, t, x, y)


def negate(z: Column, t: DType) -> Column:
    a, b = parts(z)
    return make(-a, -b, t, z)


def conj(z: Column, t: DType) -> Column:
    a, b = parts(z)
    return make(a, -b, t, z)


def sqrt(z: Column, t: DType) -> Column:
    """The root in the right half plane."""
    a, b = parts(z)
    size = F.hypot(a, b)
    re, im = F.sqrt((size + a) / 2), F.sqrt(F.greatest((size - a) / 2, F.lit(0.0)))
    return make(re, F.when(ieee.negative(b), -im).otherwise(im), t, z)
