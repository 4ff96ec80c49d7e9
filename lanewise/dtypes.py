"""Element types: promotion, storage in Spark and in NumPy, and the width of fixed-width text."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import types as T

from lanewise.errors import TypeRefused


@dataclass(frozen=True)
class DType:
    """kind: b(ool), i(nt), u(nsigned), f(loat), c(omplex), S (bytes), U (text) or a (to be inferred).

    ``bits`` is the size of an element; ``width`` the most bytes or code points of text, or None if
    there is no such bound.
    """

    kind: str
    bits: int = 0
    width: int | None = None

    @property
    def name(self) -> str:
        names = {"b": "bool", "i": f"int{self.bits}", "u": f"uint{self.bits}", "f": f"float{self.bits}", "c": f"complex{self.bits}", "S": "bytes", "U": "str", "a": "auto"}
        return names[self.kind]

    @property
    def is_text(self) -> bool:
        return self.kind in "SU"

    @property
    def is_whole(self) -> bool:
        return self.kind in "iu"

    @property
    def is_number(self) -> bool:
        return self.kind in "biufc"

    @property
    def itemsize(self) -> int | None:
        """Bytes of an element; of text, of its full width (None without a bound)."""
        if self.is_text:
            return None if self.width is None else self.width * (4 if self.kind == "U" else 1)
        return max(1, self.bits // 8)

    def wide(self, width: int | None) -> DType:
        return replace(self, width=width)

    def __str__(self) -> str:
        return self.name if self.width is None else f"{self.name}[{self.width}]"


AUTO, BOOL = DType("a"), DType("b", 8)
INT8, INT16, INT32, INT64 = (DType("i", n) for n in (8, 16, 32, 64))
UINT8, UINT16, UINT32, UINT64 = (DType("u", n) for n in (8, 16, 32, 64))
FLOAT32, FLOAT64 = DType("f", 32), DType("f", 64)
COMPLEX64, COMPLEX128 = DType("c", 64), DType("c", 128)
BYTES, STRING = DType("S"), DType("U")

NUMBERS = [BOOL, INT8, INT16, INT32, INT64, UINT8, UINT16, UINT32, UINT64, FLOAT32, FLOAT64, COMPLEX64, COMPLEX128]
BY_NAME = {t.name: t for t in [*NUMBERS, BYTES, STRING, AUTO]} | {"string": STRING, "binary": BYTES, "float": FLOAT32, "double": FLOAT64}


def dtype(of: DType | str) -> DType:
    """A type from its name; text may have a width, as in str[36]."""
    if isinstance(of, DType):
        return of
    name, _, width = of.partition("[")
    if name not in BY_NAME:
        raise TypeRefused(f"unknown dtype {of!r}")
    return BY_NAME[name].wide(int(width.rstrip("]"))) if width else BY_NAME[name]


def promote(a: DType, b: DType) -> DType:
    """The type that values of two types meet in.

    bool gives way. Of one signedness the wider wins; signed with unsigned needs twice the wider
    one's bits, and where there are none that wide, float64. Single precision holds up to 16 bits
    of integer; beyond, float and complex double.
    """
    if a.is_text or b.is_text:
        if a.is_text and b.is_text and a.kind != b.kind:
            raise TypeRefused("bytes and text do not mix")
        return a if a.is_text else b
    if a.kind == "b" or b.kind == "b":
        return b if a.kind == "b" else a
    if a.is_whole and b.is_whole:
        if a.kind == b.kind:
            return a if a.bits >= b.bits else b
        bits = 2 * max(a.bits, b.bits)
        return DType("i", bits) if bits <= 64 else FLOAT64
    single = all(t.is_whole and t.bits <= 16 or t in (FLOAT32, COMPLEX64) for t in (a, b))
    if "c" in (a.kind, b.kind):
        return COMPLEX64 if single else COMPLEX128
    return FLOAT32 if single else FLOAT64


def float_math(t: DType) -> DType:
    """What a function of real analysis returns: integers and bool become float64."""
    return FLOAT64 if t.kind in "biu" else t


def spark_type(t: DType) -> T.DataType:
    """The column type that holds t: unsigned integers take the next wider signed one."""
    if t.kind == "c":
        part = T.FloatType() if t.bits == 64 else T.DoubleType()
        return T.StructType([T.StructField("re", part), T.StructField("im", part)])
    signed = {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}
    unsigned = {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}
    simple = {"b": T.BooleanType(), "S": T.BinaryType(), "U": T.StringType()}
    if t.kind in simple:
        return simple[t.kind]
    if t.kind == "f":
        return T.FloatType() if t.bits == 32 else T.DoubleType()
    return (signed if t.kind == "i" else unsigned)[t.bits]


def metadata(t: DType) -> dict:
    """Field metadata that tells t apart from other types of its column type."""
    return {"dtype": t.name} | ({} if t.width is None else {"width": t.width})


def of_field(field: T.StructField) -> DType:
    """The type of a column: its metadata if any, else the natural one."""
    if "dtype" in (field.metadata or {}):
        return dtype(field.metadata["dtype"]).wide(field.metadata.get("width"))
    kinds = [
        (T.BooleanType, BOOL), (T.ByteType, INT8), (T.ShortType, INT16), (T.IntegerType, INT32), (T.LongType, INT64),
        (T.FloatType, FLOAT32), (T.DoubleType, FLOAT64), (T.StringType, STRING), (T.BinaryType, BYTES),
    ]
    for kind, found in kinds:
        if isinstance(field.dataType, kind):
            return found
    if isinstance(field.dataType, T.StructType) and [f.name for f in field.dataType.fields] == ["re", "im"]:
        return COMPLEX64 if isinstance(field.dataType["re"].dataType, T.FloatType) else COMPLEX128
    if isinstance(field.dataType, T.DecimalType) and (field.dataType.precision, field.dataType.scale) == (20, 0):
        return UINT64
    raise TypeRefused(f"column {field.name} has type {field.dataType.simpleString()}, which expressions cannot use")


def numpy_dtype(t: DType) -> np.dtype:
    if t.kind == "U":
        return np.dtype(f"<U{t.width}") if t.width else np.dtype(object)
    if t.kind == "S":
        return np.dtype(f"S{t.width}") if t.width else np.dtype(object)
    return np.dtype(t.name)


def from_numpy(of: np.dtype | type | str) -> DType:
    """The type of a NumPy dtype; float16, long doubles and others are refused."""
    d = np.dtype(of)
    if d.kind == "U":
        return STRING.wide(d.itemsize // 4)
    if d.kind == "S":
        return BYTES.wide(d.itemsize)
    if d.name in BY_NAME and BY_NAME[d.name].is_number:
        return BY_NAME[d.name]
    raise TypeRefused(f"NumPy dtype {d.name} has no counterpart")


def limits(t: DType) -> tuple[int, int]:
    """Least and largest integer of a whole type."""
    return (-(1 << (t.bits - 1)), (1 << (t.bits - 1)) - 1) if t.kind == "i" else (0, (1 << t.bits) - 1)
