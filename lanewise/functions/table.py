"""The builtin functions: how many arguments they take and how their result is typed."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Function:
    name: str
    arity: int
    #: analysis: integers become float64. same: the arguments' common type. reduce, text, test,
    #: where, part, constant: as their names say.
    typing: str = "same"


def _table() -> dict[str, Function]:
    out: dict[str, Function] = {}

    def add(names: str, arity: int, typing: str = "same") -> None:
        for name in names.split():
            out[name] = Function(name, arity, typing)

    add("acos acosh asin asinh atan atanh cbrt cos cosh cospi erf erfc exp exp10 exp2 expm1", 1, "analysis")
    add("lgamma ln log10 log1p log2 sin sinh sinpi sqrt tan tanh tgamma", 1, "analysis")
    add("ceil conj fac floor rint round sign square trunc", 1)
    add("abs imag real", 1, "part")
    add("atan2 copysign fdim fmax fmin fmod hypot ldexp logaddexp ncr nextafter npr pow remainder", 2)
    add("fma", 3)
    add("where", 3, "where")
    add("e pi", 0, "constant")
    add("sum mean prod min max any all", 1, "reduce")
    add("startswith endswith contains", 2, "test")
    add("lower upper strip lstrip rstrip", 1, "text")
    add("removeprefix removesuffix", 2, "text")
    add("replace substr split_part", 3, "text")
    spellings = {"arc" + f[1:]: f for f in ("acos", "acosh", "asin", "asinh", "atan", "atanh", "atan2")}
    for other, name in {**spellings, "log": "ln", "power": "pow"}.items():
        out[other] = Function(name, out[name].arity, out[name].typing)
    return out


FUNCTIONS = _table()
