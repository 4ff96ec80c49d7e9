import numpy as np
import pytest

from lanewise.api import compile, evaluate
from lanewise.errors import SyntaxRefused, TypeRefused
from lanewise.sources.arrays import data_bound, from_arrays, valid_text, varlen, with_offsets


def got(spark, values, text, width=None, kind="U"):
    a = np.array(values, f"<{kind}{width}" if width and kind == "U" else f"{kind}{width}" if width else None)
    return [r.result for r in evaluate(from_arrays(spark, {"a": a}), text).orderBy("idx").collect()]


def test_predicates(spark):
    names = ["alpha", "beta", "alp", ""]
    assert got(spark, names, "a == 'alpha'", 8) == [True, False, False, False]
    assert got(spark, names, "a != 'alpha'", 8) == [False, True, True, True]
    assert got(spark, names, "startswith(a, 'al')", 8) == [True, False, True, False]
    assert got(spark, names, "endswith(a, 'a')", 8) == [True, True, False, False]
    assert got(spark, names, "contains(a, 'et')", 8) == [False, True, False, False]
    assert got(spark, names, "startswith(a, '')", 8) == [True] * 4


def test_strip(spark):
    pads = ["  pad  ", "left  ", "  right", "none", "\u2003x\u00a0"]
    assert got(spark, pads, "strip(a)", 10) == ["pad", "left", "right", "none", "x"]
    assert got(spark, pads, "lstrip(a)", 10) == ["pad  ", "left  ", "right", "none", "x\u00a0"]
    assert got(spark, pads, "rstrip(a)", 10) == ["  pad", "left", "  right", "none", "\u2003x"]


def test_affixes_parts_and_pieces(spark):
    assert got(spark, ["double room", "suite", "single room", "room"], "removesuffix(a, ' room')", 14) == ["double", "suite", "single", "room"]
    assert got(spark, ["pre_a", "pre_b", "c", "pre_"], "removeprefix(a, 'pre_')", 8) == ["a", "b", "c", ""]
    views = ["loft with view", "plain", "a with b with c", " with x"]
    assert got(spark, views, "split_part(a, ' with ', 0)", 18) == ["loft", "plain", "a", ""]
    assert got(spark, views, "split_part(a, ' with ', 1)", 18) == ["view", "", "b with c", "x"]
    assert got(spark, ["a-b-c", "no", "---", ""], "replace(a, '-', '+')", 8) == ["a+b+c", "no", "+++", ""]
    assert got(spark, ["aaa"], "replace(a, 'aa', 'b')", 8) == ["ba"]
    some = ["abcdef", "ab", "", "xyz"]
    assert got(spark, some, "substr(a, 1, 3)", 8) == ["bcd", "b", "", "yz"]
    assert got(spark, some, "substr(a, -2, 2)", 8) == ["ef", "ab", "", "yz"]
    assert got(spark, some, "substr(a, -9, 2)", 8) == ["ab", "ab", "", "xy"]
    assert got(spark, some, "substr(a, 1, -3)", 8) == [""] * 4


def test_case_and_widths(spark):
    assert got(spark, ["straße"], "upper(a)", 8) == ["STRASSE"]
    assert got(spark, ["straße"], "upper(a)", 6) == ["STRASS"]
    assert got(spark, ["ΑΣ", "Ab"], "lower(a)", 4) == ["ας".replace("ς", "σ"), "ab"]
    assert compile("a + b", {"a": "str[8]", "b": "str[6]"}).dtype.width == 14
    assert compile("replace(a, '-', '+++')", {"a": "str[4]"}).dtype.width == 12
    assert compile("substr(a, 0, 3)", {"a": "str[8]"}).dtype.width == 3
    assert compile("a + '!'", {"a": "str[3]"}).itemsize == 16


def test_nested_expression(spark):
    rooms = ["Cozy Loft With City View", "Small Single Room", "Studio", "Double Room"]
    want = ["room_type=cozy loft with city view", "room_type=small single", "room_type=studio", "room_type=double"]
    assert got(spark, rooms, "'room_type=' + removesuffix(lower(a), ' room')", 32) == want


def test_escapes(spark):
    assert got(spark, ["a\tb", "é"], "a == 'a\\tb' or a == '\\u00e9'", 4) == [True, True]
    with pytest.raises(SyntaxRefused):
        compile("a == '\\x41'", {"a": "str"})


def test_bytes(spark):
    values = [b"foo", b"Hello", b" pad  "]
    assert [bytes(x) for x in got(spark, values, "upper(a) + b'!'", 8, "S")] == [b"FOO!", b"HELLO!", b" PAD  !"]
    assert [bytes(x) for x in got(spark, values, "strip(a)", 8, "S")] == [b"foo", b"Hello", b"pad"]
    assert got(spark, values, "a == 'foo'", 8, "S") == [True, False, False]
    with pytest.raises(TypeRefused):
        compile("a + b", {"a": "bytes[3]", "b": "str[3]"})
    with pytest.raises(TypeRefused):
        compile("a == 'é'", {"a": "bytes[3]"})


@pytest.mark.parametrize("text", ["a + 1", "a < 'x'", "sum(a)", "where(a, 1, 2)", "replace(a, '', 'x')", "substr(a, n, 1)", "sin(a)", "a * a"])
def test_refused(text):
    with pytest.raises(Exception) as e:
        compile(text, {"a": "str[4]", "n": "int32"})
    assert getattr(e.value, "code", None) is not None


def test_arrow_layout(spark):
    df = from_arrays(spark, {"a": np.array(["home", "room", "", "loft"], "<U8")})
    out = evaluate(df, "'kind=' + a")
    offsets, blob = varlen(out, "result", "idx")
    assert blob == b"kind=homekind=roomkind=kind=loft" and offsets.tolist() == [0, 9, 18, 23, 32]
    spans = with_offsets(out, "result", "idx").orderBy("idx").collect()
    assert [(r.start, r.stop) for r in spans] == [(0, 9), (9, 18), (18, 23), (23, 32)]
    wide = from_arrays(spark, {"a": np.array(["é", "€", "😀", "z"], "<U4")})
    assert varlen(evaluate(wide, "a + '!'"), "result", "idx")[0].tolist() == [0, 3, 7, 12, 14]
    assert valid_text("a\ud800") == "a\ufffd"
    assert data_bound(compile("a + '!'", {"a": "str[3]"}).dtype, 10) == 160 and data_bound(compile("1", {}).dtype, 10) == 0
