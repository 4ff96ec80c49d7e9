"""Compiling expressions and kernels, and applying them to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanewise import __version__
from lanewise import dtypes as D
from lanewise.dtypes import DType
from lanewise.errors import BindingError, ReductionRefused, TypeRefused, VariableRefused, VariablesMixed, VariableUntyped
from lanewise.functions import ieee
from lanewise.operators import reductions
from lanewise.operators.lowering import Lowering
from lanewise.plans.grammar import parse
from lanewise.plans.typed import Typed, Udf, type_tree

MAX_VARIABLES = 128


def variables(of: StructType | dict[str, DType | str], out: DType) -> dict[str, DType]:
    """Names and types; either all are typed, or an output type is given and all are AUTO."""
    names = {f.name: D.of_field(f) for f in of.fields} if isinstance(of, StructType) else {k: D.dtype(v) for k, v in of.items()}
    if len(names) > MAX_VARIABLES:
        raise VariableRefused(f"more than {MAX_VARIABLES} variables")
    open_ = [k for k, t in names.items() if t.kind == "a"]
    if out.kind == "a" and open_:
        raise VariableUntyped(f"{open_[0]} has no type, and neither has the output")
    if open_ and len(open_) < len(names):
        raise VariablesMixed("some variables have a type and others none")
    return {k: out for k in names} if open_ else names


def named_only(text: str, of: StructType | dict) -> StructType | dict:
    """The fields that the text names, so that columns of other types do no harm."""
    import re

    if not isinstance(of, StructType):
        return of
    used = set(re.findall(r"[A-Za-z_]\w*", text))
    return StructType([f for f in of.fields if f.name in used])


@dataclass
class Compiled:
    """A typed expression. ``dtype`` is its output type, ``names`` the variables it may use."""

    text: str
    tree: Typed
    names: dict[str, DType]
    udfs: dict[str, Udf] = field(default_factory=dict)

    @property
    def dtype(self) -> DType:
        return self.tree.dtype

    @property
    def itemsize(self) -> int | None:
        return self.dtype.itemsize

    @property
    def is_scalar(self) -> bool:
        """Whether the result is one value for the whole input."""
        return self.tree.is_scalar

    def __str__(self) -> str:
        return f"{self.text} = {self.tree}"

    def explain(self) -> str:
        """The typed tree, a node a line."""

        def lines(n: Typed, depth: int) -> list[str]:
            head = repr(n.value) if n.op == "const" else f"{n.op} {n.value}" if n.value is not None and n.op != "udf" else n.op
            return ["  " * depth + f"{head}: {n.dtype}", *[x for a in n.args for x in lines(a, depth + 1)]]

        return "\n".join(lines(self.tree, 0))

    def stored(self, name: str) -> Column:
        """A variable's column in the storage of its type."""
        t = self.names[name]
        column = F.col(f"`{name}`")
        return column if t.is_text or t.kind == "c" else column.cast(D.spark_type(t))

    def column(self, columns: dict[str, Column] | None = None, reduction: Callable[[Typed], Column] | None = None) -> Column:
        """The Column of a row-wise expression, for use in any DataFrame operation."""
        given = columns or {}
        return Lowering(lambda n: given[n] if n in given else self.stored(n), reduction).lower(self.tree)

    def check(self, df: DataFrame) -> None:
        missing = {n.value for n in self.tree.walk() if n.op == "var"} - set(df.columns)
        if missing:
            raise BindingError(f"no column {sorted(missing)[0]!r}")

    def aggregate(self) -> Column:
        """The Column of a scalar expression over reductions, for ``agg`` with or without groups."""
        if not self.is_scalar:
            raise ReductionRefused("not a single value: it has variables outside of reductions")
        return self.column(reduction=self.reduce)

    def reduce(self, n: Typed) -> Column:
        inner = Lowering(self.stored).lower(n.args[0])
        return reductions.aggregate(n.value, inner, n.args[0].dtype)

    def apply(self, df: DataFrame, name: str = "result") -> DataFrame:
        """df with the result as a column; one row with it alone if the result is one value.

        Reductions inside a row-wise expression cover all of df: each distinct one is an aggregate
        of one pass over it, whose single row becomes scalar subqueries of the projection.
        """
        self.check(df)
        meta = D.metadata(self.dtype)
        if self.is_scalar:
            return df.agg(self.aggregate().alias(name)).withMetadata(name, meta)
        if not self.tree.has_reduction:
            return df.withColumn(name, self.column()).withMetadata(name, meta)
        found: dict[str, tuple[str, Typed]] = {}
        for n in self.tree.walk():
            if n.op == "reduce":
                found.setdefault(str(n), (f"_reduced{len(found)}", n))
        totals = df.agg(*[self.reduce(n).alias(k) for k, n in found.values()])
        packed = totals.select(F.struct(*[k for k, _ in found.values()]).alias("all")).scalar()
        return df.withColumn(name, self.column(reduction=lambda n: packed[found[str(n)][0]])).withMetadata(name, meta)

    def filter(self, df: DataFrame) -> DataFrame:
        """The rows for which the result is true."""
        if self.dtype.kind != "b":
            raise TypeRefused(f"a filter needs bool, not {self.dtype}")
        self.check(df)
        if not self.tree.has_reduction:
            return df.filter(self.column())
        return self.apply(df, "_kept").filter("_kept").drop("_kept")


def compile(text: str, names: StructType | dict[str, DType | str], out: DType | str = D.AUTO, udfs: list[Udf] | None = None, **ignored: object):
    """Compiles an expression, or a kernel if the text is one.

    names: variables and types, or a schema of which columns are taken as named. out: the output
    type; AUTO infers it. Options that only steer another evaluator's speed (SIMD, accuracy class,
    JIT mode) are accepted as keywords and make no difference.
    """
    from lanewise.operators.kernel import compile_kernel
    from lanewise.plans.kernel_grammar import looks_like_kernel

    out = D.dtype(out)
    own = {u.name: u for u in udfs or []}
    names = variables(named_only(text, names), out)
    if looks_like_kernel(text):
        return compile_kernel(text, names, out, own)
    tree = type_tree(parse(text, set(names), {k: u.arity for k, u in own.items()}), names, out, own)
    return Compiled(text, tree, names, own)


def evaluate(df: DataFrame, text: str, name: str = "result", out: DType | str = D.AUTO, udfs: list[Udf] | None = None) -> DataFrame:
    """Compiles against df's columns and applies to df."""
    return compile(text, df.schema, out, udfs).apply(df, name)


def agg(text: str, names: StructType | dict[str, DType | str], out: DType | str = D.AUTO) -> Column:
    """A scalar expression over reductions as an aggregate Column: ``df.groupBy(k).agg(agg("sum(x*y)", df.schema))``."""
    return compile(text, names, out).aggregate()


def where(df: DataFrame, text: str) -> DataFrame:
    """The rows of df for which the expression is true."""
    return compile(text, df.schema).filter(df)


def version() -> str:
    return __version__


__all__ = ["Compiled", "Udf", "agg", "compile", "evaluate", "ieee", "variables", "version", "where"]
