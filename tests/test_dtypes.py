import numpy as np
import pytest

from lanewise import dtypes as D
from lanewise.errors import TypeRefused


def test_promotion_of_signed_and_unsigned():
    cases = {
        ("int8", "uint8"): "int16", ("int8", "uint16"): "int32", ("int16", "uint8"): "int32", ("int16", "uint16"): "int32", ("int32", "uint8"): "int64",
        ("int32", "uint32"): "int64", ("int64", "uint8"): "float64", ("int8", "uint64"): "float64", ("uint8", "uint32"): "uint32", ("bool", "int16"): "int16",
        ("float32", "int16"): "float32", ("float32", "int32"): "float64", ("float32", "uint64"): "float64", ("complex64", "int32"): "complex128",
        ("complex64", "int16"): "complex64", ("complex64", "float64"): "complex128",
    }
    for (a, b), c in cases.items():
        assert D.promote(D.dtype(a), D.dtype(b)).name == c == D.promote(D.dtype(b), D.dtype(a)).name


def test_promotion_is_symmetric_and_idempotent():
    for a in D.NUMBERS:
        assert D.promote(a, a) == a
        for b in D.NUMBERS:
            assert D.promote(a, b) == D.promote(b, a)


def test_text_does_not_mix():
    with pytest.raises(TypeRefused):
        D.promote(D.BYTES, D.STRING)


def test_numpy_bridge():
    assert D.from_numpy("<U7") == D.STRING.wide(7)
    assert D.from_numpy("S3") == D.BYTES.wide(3)
    for name in ("bool", "int8", "uint64", "float32", "complex128"):
        assert D.from_numpy(name).name == name
        assert D.numpy_dtype(D.dtype(name)) == np.dtype(name)
    with pytest.raises(TypeRefused):
        D.from_numpy("float16")


def test_itemsize():
    assert D.dtype("str[5]").itemsize == 20 and D.dtype("bytes[5]").itemsize == 5 and D.COMPLEX64.itemsize == 8 and D.BOOL.itemsize == 1
