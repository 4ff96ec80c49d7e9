"""Kernels: typed statements, run as predicated Columns or, for loops, lane by mask in Arrow batches."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import dtypes as D
from lanewise.dtypes import DType
from lanewise.errors import BindingError, EvaluationError, ExpressionError, ReductionRefused, SyntaxRefused, TypeRefused, VariableRefused
from lanewise.functions import ieee
from lanewise.functions.table import FUNCTIONS
from lanewise.operators import reductions
from lanewise.operators.lowering import Lowering
from lanewise.operators.vector import Vector
from lanewise.plans.grammar import Parser
from lanewise.plans.kernel_grammar import Statement, parse_kernel
from lanewise.plans.typed import CASTS, Typed, Typer, Udf, convert
from lanewise.sources.checkpoint import cut

WHILE_LIMIT = "LANEWISE_WHILE_LIMIT"
MAX_DIMS = 8
#: Loops of constant trip counts are unrolled up to so many statements in all.
UNROLLED = 48
_ND = re.compile(r"_i\d+|_n\d+|_ndim|_flat_idx")
RESERVED = {"print", "int", "float", "bool", "def", "return"}


def while_limit() -> int:
    """Iterations after which a while loop is given up; none at 0 or below."""
    return int(os.environ.get(WHILE_LIMIT, "10000000"))


@dataclass
class Step:
    """A statement with typed expressions."""

    kind: str
    line: int
    name: str = ""
    trees: list[Typed] = field(default_factory=list)
    body: list[Step] = field(default_factory=list)
    arms: list[tuple[Typed | None, list[Step]]] = field(default_factory=list)
    text: str = ""

    def walk(self) -> Iterator[Step]:
        yield self
        for s in [*self.body, *[s for _, arm in self.arms for s in arm]]:
            yield from s.walk()

    def all_trees(self) -> list[Typed]:
        return [*self.trees, *[c for c, _ in self.arms if c is not None]]


class Compiler:
    def __init__(self, names: dict[str, DType], out: DType, udfs: dict[str, Udf]):
        self.inputs, self.out, self.udfs = names, out, udfs
        self.types = dict(names)
        self.locals: dict[str, DType] = {}
        self.returns: list[Typed] = []
        first = next((t for t in names.values() if t.is_number), D.AUTO)
        self.target = out if out.is_number else first
        self.used: set[str] = set()

    def expr(self, text: str, line: int) -> Typed:
        symbols = {s: D.INT64 for s in _ND.findall(text)}
        names = {**symbols, **self.types}
        try:
            node = Parser(text, set(names), {u: f.arity for u, f in self.udfs.items()} | dict.fromkeys(CASTS, 1)).whole()
            tree = Typer(names, self.target, self.udfs).typed(node)
        except ExpressionError as e:
            raise type(e)(f"line {line}: {e}") from None
        self.used |= {n.value for n in tree.walk() if n.op == "var" and n.value in symbols and n.value not in self.types}
        return tree

    def block(self, statements: list[Statement], loops: int, masked: bool) -> list[Step]:
        return [self.step(s, loops, masked) for s in statements]

    def step(self, s: Statement, loops: int, masked: bool) -> Step:
        out = Step(s.kind, s.line, s.name)
        if s.kind == "if":
            for condition, arm in s.arms:
                out.arms.append((self.condition(condition, s.line) if condition else None, self.block(arm, loops, True)))
            return out
        if s.kind == "while":
            out.trees = [self.condition(s.exprs[0], s.line)]
            out.body = self.block(s.body, loops + 1, True)
            return out
        if s.kind == "for":
            return self.for_loop(s, out, loops)
        if s.kind in ("break", "continue"):
            if not loops:
                raise SyntaxRefused(f"line {s.line}: {s.kind} outside of a loop")
            return out
        if s.kind == "print":
            return self.printed(s, out)
        tree = self.expr(s.exprs[0], s.line)
        if masked and tree.has_reduction:
            raise ReductionRefused(f"line {s.line}: a reduction in the body of a branch or loop")
        out.trees = [tree]
        if s.kind == "assign":
            self.assign(s, tree)
        elif s.kind == "return":
            self.returns.append(tree)
        return out

    def condition(self, text: str, line: int) -> Typed:
        return convert(self.expr(text, line), D.BOOL)

    def assign(self, s: Statement, tree: Typed) -> None:
        name = s.name
        if name in self.inputs:
            raise SyntaxRefused(f"line {s.line}: {name} is an input")
        self.fresh_name(name, s.line)
        if name in self.locals:
            old = self.locals[name]
            wider = tree.dtype.is_text and old.width is not None and (tree.dtype.width is None or tree.dtype.width > old.width)
            if (old.kind, old.bits) != (tree.dtype.kind, tree.dtype.bits) or wider:
                raise TypeRefused(f"line {s.line}: {name} is {old}, not {tree.dtype}")
        else:
            self.locals[name] = self.types[name] = tree.dtype

    def fresh_name(self, name: str, line: int) -> None:
        if name in RESERVED or _ND.fullmatch(name) or name in self.udfs or name in ("and", "or", "not"):
            raise SyntaxRefused(f"line {line}: {name} is reserved")

    def for_loop(self, s: Statement, out: Step, loops: int) -> Step:
        bounds = [convert(self.expr(e, s.line), D.INT64) for e in s.exprs]
        if any(b.has_reduction for b in bounds) and loops:
            raise ReductionRefused(f"line {s.line}: a reduction in a loop")
        zero, one = Typed("const", D.INT64, value=0), Typed("const", D.INT64, value=1)
        out.trees = [zero, bounds[0], one] if len(bounds) == 1 else [*bounds, one] if len(bounds) == 2 else bounds
        self.fresh_name(s.name, s.line)
        if s.name in self.types:
            raise SyntaxRefused(f"line {s.line}: {s.name} is in use")
        self.types[s.name] = D.INT64
        out.body = self.block(s.body, loops + 1, True)
        del self.types[s.name]
        return out

    def printed(self, s: Statement, out: Step) -> Step:
        args = list(s.exprs)
        literal = re.fullmatch(r"""b?(['"])(.*)\1""", args[0], re.DOTALL)
        form = literal[2] if literal else ""
        args = args[1:] if literal else args
        marks = len(re.findall(r"\{\}", form.replace("{{", "").replace("}}", "")))
        if not marks:
            form = " ".join([form] * bool(form) + ["{}"] * len(args))
        elif marks != len(args):
            raise SyntaxRefused(f"line {s.line}: {marks} placeholders for {len(args)} values")
        out.text, out.trees = form, [self.expr(a, s.line) for a in args]
        return out


def always_returns(steps: list[Step]) -> bool:
    for s in steps:
        if s.kind == "return":
            return True
        if s.kind == "if" and s.arms[-1][0] is None and all(always_returns(arm) for _, arm in s.arms):
            return True
    return False


def compile_kernel(text: str, names: dict[str, DType], out: DType, udfs: dict[str, Udf]) -> Kernel:
    program = parse_kernel(text)
    if set(program.params) != set(names) and not set(program.params) <= set(names):
        raise VariableRefused(f"parameters {program.params} are not the variables {sorted(names)}")
    names = {p: names[p] for p in program.params}
    for name, udf in udfs.items():
        if udf.dtype.kind in "aSU" or name in FUNCTIONS or name in RESERVED or name in names:
            raise VariableRefused(f"function {name!r} needs a type and a name of its own")
    for p in names:
        if p in RESERVED or _ND.fullmatch(p):
            raise SyntaxRefused(f"parameter {p} is reserved")
    compiler = Compiler(names, out, udfs)
    steps = compiler.block(program.body, 0, False)
    if not compiler.returns:
        raise SyntaxRefused("the kernel returns nothing")
    first = compiler.returns[0].dtype
    for r in compiler.returns:
        if (r.dtype.kind, r.dtype.bits) != (first.kind, first.bits):
            raise TypeRefused(f"returns {first} and {r.dtype}")
    if first.is_text:
        widths = [r.dtype.width for r in compiler.returns]
        first = first.wide(None if None in widths else max(widths))
    result = out if out.is_number else first
    if result.is_whole and all(r.whole for r in compiler.returns):
        for s in (s for step in steps for s in step.walk() if s.kind == "return"):
            s.trees = [s.trees[0].whole]
        first = D.INT64
    return Kernel(text, program.name, names, compiler.locals, steps, first, result, udfs, compiler.used)


@dataclass
class Kernel:
    """A compiled kernel. ``own`` is the type of its returns, ``dtype`` that of the output."""

    text: str
    name: str
    names: dict[str, DType]
    locals: dict[str, DType]
    steps: list[Step]
    own: DType
    dtype: DType
    udfs: dict[str, Udf]
    symbols: set[str]

    @property
    def itemsize(self) -> int | None:
        return self.dtype.itemsize

    @property
    def is_scalar(self) -> bool:
        return False

    def every(self) -> Iterator[Step]:
        for s in self.steps:
            yield from s.walk()

    def trips(self, s: Step) -> range | None:
        """The values of a for loop with constant bounds."""
        values = [t.value if t.op == "const" else -t.args[0].value if t.op == "neg" and t.args[0].op == "const" else None for t in s.trees]
        if None in values:
            return None
        if values[2] == 0:
            raise EvaluationError("a range with a step of 0")
        return range(*map(int, values))

    def unrolled(self, steps: list[Step]) -> float:
        """Statements when all loops are unrolled; infinite if one cannot be."""
        total = 0.0
        for s in steps:
            inner = self.unrolled(s.body) + sum(self.unrolled(a) for _, a in s.arms)
            if s.kind == "while":
                return float("inf")
            if s.kind == "for":
                trips = self.trips(s)
                if trips is None:
                    return float("inf")
                inner *= len(trips)
            total += 1 + inner
        return total

    @property
    def driven(self) -> bool:
        """Whether loops have to be stepped for all rows at once: a condition in one reduces locals."""
        loops = [s for s in self.every() if s.kind in ("for", "while")]
        changing = {x.name for s in loops for x in s.walk()}
        for s in loops:
            for inner in s.walk():
                for t in inner.all_trees():
                    if any(n.op == "reduce" and any(m.op == "var" and m.value in changing for m in n.walk()) for n in t.walk()):
                        return True
        return any(inner.kind == "print" for s in loops for inner in s.walk())

    def symbol_columns(self, df: DataFrame, index: Column | str | None, nd=None) -> dict[str, Column]:
        """Columns of the index symbols that the kernel uses."""
        out: dict[str, Column] = {}
        if not self.symbols:
            return out
        flat = F.col(index) if isinstance(index, str) else index
        needs_index = any(s == "_flat_idx" or s.startswith("_i") for s in self.symbols)
        if needs_index and flat is None:
            raise BindingError("the kernel uses places: name the column that holds each row's flat index")
        for s in self.symbols:
            if s == "_ndim":
                out[s] = F.lit(nd.ndim if nd else 1).cast("long")
            elif s == "_flat_idx":
                out[s] = flat.cast("long")
            elif s.startswith("_n"):
                d = int(s[2:])
                if nd:
                    out[s] = F.lit(nd.shape[d] if d < nd.ndim else 1).cast("long")
                else:
                    out[s] = df.agg(F.count("*")).scalar() if d == 0 else F.lit(1).cast("long")
            else:
                d = int(s[2:])
                if nd:
                    out[s] = nd.coordinate(flat, d)
                else:
                    out[s] = flat.cast("long") if d == 0 else F.lit(0).cast("long")
        return out

    def apply(self, df: DataFrame, name: str = "result", index: Column | str | None = None, nd=None) -> DataFrame:
        """df with the kernel's result for each row as a column.

        Kernels without loops, or with a few constant trips, become Columns. Other loops run as a
        NumPy interpreter over Arrow batches, which sees only the kernel's inputs. Loops whose
        conditions reduce changing values over all rows, or which print, are stepped from the driver.
        A row with a null in any parameter has a null result, however the kernel is run.
        """
        missing = set(self.names) - set(df.columns)
        if missing:
            raise BindingError(f"no column {sorted(missing)[0]!r}")
        symbols = self.symbol_columns(df, index, nd)
        if self.driven or self.unrolled(self.steps) <= UNROLLED or any(s.kind == "print" for s in self.every()):
            out = Lanes(self, df, symbols, index, nd).run(name)
        else:
            out = self.interpreted(df, name, symbols, index, nd)
        return out.withMetadata(name, D.metadata(self.dtype))

    def stored(self, name: str) -> Column:
        t = self.names[name]
        return F.col(f"`{name}`") if t.is_text or t.kind == "c" else F.col(f"`{name}`").cast(D.spark_type(t))

    def interpreted(self, df: DataFrame, name: str, symbols: dict[str, Column], index: Column | str | None = None, nd=None) -> DataFrame:
        """Loops as masks over batches; reductions of inputs become constants beforehand."""
        found: dict[str, Typed] = {}
        for s in self.every():
            for t in s.all_trees():
                for n in t.walk():
                    if n.op == "reduce":
                        if nd or any(m.op == "var" and m.value in self.locals for m in n.walk()):
                            return Lanes(self, df, symbols, index, nd).run(name)
                        found[str(n)] = n
        values: dict[str, object] = {}
        if found:
            lower = Lowering(lambda v: symbols[v] if v in symbols else self.stored(v))
            row = df.agg(*[reductions.aggregate(n.value, lower.lower(n.args[0]), n.args[0].dtype).alias(f"r{i}") for i, n in enumerate(found.values())]).first()
            values = {k: complex(row[i]["re"], row[i]["im"]) if n.dtype.kind == "c" else row[i] for i, (k, n) in enumerate(found.items())}
        inputs = [*self.names, *symbols]
        run = F.arrow_udf(_interpreter(self, inputs, values, while_limit()), D.spark_type(self.dtype))
        if any(n.op == "udf" and not n.value.pure for s in self.every() for t in s.all_trees() for n in t.walk()):
            run = run.asNondeterministic()
        # a row without inputs still is a lane
        columns = [symbols[n] if n in symbols else self.stored(n) for n in inputs] or [F.lit(0).cast("long")]
        return df.withColumn(name, run(F.struct(*[c.alias(f"a{i}") for i, c in enumerate(columns)])))


def _to_numpy(column: pa.Array, t: DType) -> np.ndarray:
    if t.kind == "c":
        re, im = (np.asarray(column.field(k).to_pylist(), float) for k in ("re", "im"))
        return (re + 1j * im).astype(D.numpy_dtype(t))
    if t.is_text:
        out = np.empty(len(column), object)
        out[:] = column.to_pylist()
        return out
    if t == D.UINT64:
        return np.array([int(v) for v in column.to_pylist()], np.uint64)
    return column.to_numpy(zero_copy_only=False).astype(D.numpy_dtype(t))


def _to_arrow(x: np.ndarray, t: DType, null: np.ndarray) -> pa.Array:
    if t.kind == "c":
        part = pa.float32() if t.bits == 64 else pa.float64()
        both = pa.StructArray.from_arrays([pa.array(x.real, part), pa.array(x.imag, part)], ["re", "im"])
        return both if not null.any() else pa.array([None if n else v for v, n in zip(both.to_pylist(), null)], both.type)
    if t == D.UINT64:
        from decimal import Decimal

        return pa.array([None if n else Decimal(int(v)) for v, n in zip(x, null)], pa.decimal128(20, 0))
    kinds = {"b": pa.bool_(), "S": pa.binary(), "U": pa.string()}
    kind = kinds.get(t.kind) or pa.from_numpy_dtype(D.numpy_dtype(t) if t.kind != "u" else np.dtype({8: "int16", 16: "int32", 32: "int64"}[t.bits]))
    if t.is_text:
        return pa.array([None if n else v for v, n in zip(x.tolist(), null)], kind)
    return pa.array(x, kind, mask=null)


def _interpreter(kernel: Kernel, inputs: list[str], values: dict[str, object], limit: int) -> Callable:
    """A function of a struct of the inputs, so that no other column leaves the JVM."""
    types = [kernel.names.get(n, D.INT64) for n in inputs]

    def run(rows: pa.Array) -> pa.Array:
        columns = rows.flatten()[: len(inputs)]
        null = np.zeros(len(rows), bool)
        for c in columns:
            null |= c.is_null().to_numpy(zero_copy_only=False)
        whole = pa.array(~null)
        arrays = {n: _to_numpy(c.filter(whole) if null.any() else c, t) for n, c, t in zip(inputs, columns, types)}
        result = Masks(kernel, int((~null).sum()), arrays, values, limit).run()
        full = np.zeros(len(rows), result.dtype if not kernel.dtype.is_text else object)
        full[~null] = result
        return _to_arrow(full, kernel.dtype, null)

    def interpret(rows: pa.Array) -> pa.Array:
        return run(rows)

    return interpret


class Masks:
    """Runs a kernel over arrays of lanes: each statement for all lanes, stored where its mask is set."""

    def __init__(self, kernel: Kernel, n: int, arrays: dict[str, np.ndarray], values: dict[str, object] | None, limit: int):
        self.kernel, self.n, self.limit = kernel, n, limit
        self.vector = Vector(n, dict(arrays), values)
        self.returned = np.zeros(n, bool)
        self.result = np.zeros(n, object if kernel.own.is_text else D.numpy_dtype(kernel.own))
        self.loops: list[dict[str, np.ndarray]] = []

    def run(self) -> np.ndarray:
        self.block(self.kernel.steps, np.ones(self.n, bool))
        if not self.returned.all():
            raise EvaluationError("a lane ended without a return")
        from lanewise.operators.vector import cast

        return self.result if self.kernel.own.is_text else cast(self.result, self.kernel.own, self.kernel.dtype)

    def alive(self, mask: np.ndarray) -> np.ndarray:
        mask = mask & ~self.returned
        for loop in self.loops:
            mask = mask & ~loop["left"] & ~loop["skipped"]
        return mask

    def block(self, steps: list[Step], mask: np.ndarray) -> None:
        for s in steps:
            mask = self.alive(mask)
            if not mask.any():
                return
            self.step(s, mask)

    def step(self, s: Step, mask: np.ndarray) -> None:
        if s.kind == "assign":
            self.store(s.name, self.vector.run(s.trees[0]), mask)
        elif s.kind == "return":
            value = self.vector.run(s.trees[0])
            self.result[mask] = value[mask]
            self.returned |= mask
        elif s.kind == "if":
            left = mask
            for condition, arm in s.arms:
                hit = left if condition is None else left & self.vector.run(condition)
                self.block(arm, hit)
                left = left & ~hit
        elif s.kind in ("break", "continue"):
            self.loops[-1]["left" if s.kind == "break" else "skipped"] |= mask
        elif s.kind == "while":
            self.while_loop(s, mask)
        elif s.kind == "for":
            self.for_loop(s, mask)

    def store(self, name: str, value: np.ndarray, mask: np.ndarray) -> None:
        old = self.vector.values.get(name)
        if mask.all() or old is None:
            self.vector.values[name] = value
        else:
            self.vector.values[name] = np.where(mask, value, old)

    def while_loop(self, s: Step, mask: np.ndarray) -> None:
        loop = {"left": np.zeros(self.n, bool), "skipped": np.zeros(self.n, bool)}
        self.loops.append(loop)
        rounds = 0
        while True:
            loop["skipped"][:] = False
            mask = self.alive(mask)
            mask = mask & self.vector.run(s.trees[0]) if mask.any() else mask
            if not mask.any():
                break
            rounds += 1
            if 0 < self.limit < rounds:
                raise EvaluationError(f"a while loop passed {self.limit} iterations")
            self.block(s.body, mask)
        self.loops.pop()

    def for_loop(self, s: Step, mask: np.ndarray) -> None:
        start, stop, stride = (self.vector.run(t) for t in s.trees)
        if (stride[mask] == 0).any():
            raise EvaluationError("a range with a step of 0")
        loop = {"left": np.zeros(self.n, bool), "skipped": np.zeros(self.n, bool)}
        self.loops.append(loop)
        value = start.copy()
        while True:
            loop["skipped"][:] = False
            mask = self.alive(mask) & np.where(stride > 0, value < stop, value > stop)
            if not mask.any():
                break
            self.vector.values[s.name] = np.where(mask, value, 0)
            self.block(s.body, mask)
            value = value + stride
        self.loops.pop()
        self.vector.values.pop(s.name, None)


class Lanes:
    """Runs a kernel as Columns of a DataFrame. Masks are Columns too; None stands for all lanes.

    Over an array (nd), a reduction covers the lanes of a block, else all lanes.
    """

    def __init__(self, kernel: Kernel, df: DataFrame, symbols: dict[str, Column], index: Column | str | None = None, nd=None):
        self.kernel, self.before = kernel, df.columns
        self.serial = 0
        self.blocks: list[str] = []
        if nd and any(n.op == "reduce" for s in kernel.every() for t in s.all_trees() for n in t.walk()):
            flat = F.col(index) if isinstance(index, str) else index
            self.blocks = [self.label(), self.label()]
            df = df.withColumns(dict(zip(self.blocks, (nd.chunk_of(flat), nd.block_of(flat)))))
        self.env: dict[str, str] = {}
        inputs = {n: kernel.stored(n) for n in kernel.names} | symbols
        fresh = {self.label(): (n, c) for n, c in inputs.items()}
        self.df = df.select("*", *[c.alias(k) for k, (_, c) in fresh.items()])
        self.env = {n: k for k, (n, _) in fresh.items()}
        self.inputs = list(fresh)
        self.returned: str | None = None
        self.result: str | None = None
        self.all_returned = False
        self.loops: list[dict[str, str | None]] = []

    def label(self) -> str:
        self.serial += 1
        return f"_lane{self.serial}"

    def column(self, name: str) -> Column:
        if name not in self.env:
            t = self.kernel.locals[name]
            return F.lit(None).cast(D.spark_type(t))
        return F.col(self.env[name])

    def bind(self, **columns: Column) -> None:
        """New columns for names, one projection for all."""
        labels = {n: self.label() for n in columns}
        self.df = self.df.withColumns({labels[n]: c for n, c in columns.items()})
        self.env.update(labels)

    def named(self, c: Column) -> str:
        label = self.label()
        self.df = self.df.withColumn(label, c)
        return label

    def lower(self, t: Typed) -> Column:
        return Lowering(self.column, self.reduce).lower(t)

    def reduce(self, n: Typed) -> Column:
        inner = Lowering(self.column).lower(n.args[0])
        if self.blocks:
            label = self.label()
            totals = self.df.groupBy(*self.blocks).agg(reductions.aggregate(n.value, inner, n.args[0].dtype).alias(label))
            self.df = self.df.join(totals, self.blocks)
            return F.col(label)
        total = self.df.agg(reductions.aggregate(n.value, inner, n.args[0].dtype).alias("r"))
        if not self.kernel.driven:
            return total.scalar()
        # a loop would nest one subquery in the next; its values are known round by round
        value = total.first()["r"]
        return ieee.literal(complex(value["re"], value["im"]) if n.dtype.kind == "c" else value, n.dtype)

    def alive(self, mask: Column | None) -> Column | None:
        for label in [self.returned, *[x for loop in self.loops for x in (loop["left"], loop["skipped"])]]:
            if label:
                mask = ~F.col(label) if mask is None else mask & ~F.col(label)
        return mask

    def run(self, name: str) -> DataFrame:
        self.block(self.kernel.steps, None)
        out = F.col(self.result)
        if not self.kernel.own.is_text:
            out = ieee.cast(out, self.kernel.own, self.kernel.dtype)
        known = self.known()
        if not always_returns(self.kernel.steps):
            lost = ~F.coalesce(F.col(self.returned), F.lit(False))
            lost = lost if known is None else known & lost
            out = F.when(lost, F.raise_error(F.lit("a lane ended without a return"))).otherwise(out)
        if known is not None:
            out = F.when(known, out)
        kept = [F.col(f"`{c}`") for c in self.before if c != name]
        return self.df.select(*kept, out.cast(D.spark_type(self.kernel.dtype)).alias(name))

    def known(self) -> Column | None:
        """The rows without a null input: like a batch of the interpreter, others have no result."""
        out = None
        for label in self.inputs:
            out = F.col(label).isNotNull() if out is None else out & F.col(label).isNotNull()
        return out

    def block(self, steps: list[Step], mask: Column | None) -> None:
        for s in steps:
            if self.all_returned:
                return
            self.step(s, self.alive(mask), mask)

    def step(self, s: Step, live: Column | None, mask: Column | None) -> None:
        if s.kind == "assign":
            value = self.lower(s.trees[0])
            self.bind(**{s.name: value if live is None else F.when(live, value).otherwise(self.column(s.name))})
        elif s.kind == "return":
            value = self.lower(s.trees[0])
            old = F.col(self.result) if self.result else F.lit(None).cast(D.spark_type(self.kernel.own))
            self.result = self.named(value if live is None else F.when(live, value).otherwise(old))
            if live is None:
                self.all_returned = True
            else:
                self.returned = self.named(F.coalesce(live, F.lit(False)) | (F.col(self.returned) if self.returned else F.lit(False)))
        elif s.kind == "print":
            self.print(s, live)
        elif s.kind == "if":
            self.branch(s, live)
        elif s.kind in ("break", "continue"):
            which = "left" if s.kind == "break" else "skipped"
            old = self.loops[-1][which]
            hit = F.lit(True) if live is None else F.coalesce(live, F.lit(False))
            self.loops[-1][which] = self.named(hit | F.col(old) if old else hit)
        elif s.kind in ("for", "while"):
            self.loop(s, live)

    def branch(self, s: Step, live: Column | None) -> None:
        # masks are bound before the arms run, as arms change what conditions read
        left = None if live is None else self.named(live)
        for condition, arm in s.arms:
            here = F.col(left) if left else None
            if condition is None:
                self.block(arm, here)
                return
            test = self.lower(condition)
            hit = self.named(F.coalesce(test if here is None else here & test, F.lit(False)))
            rest = self.named(F.coalesce((F.lit(True) if here is None else here) & ~test, F.lit(False)))
            self.block(arm, F.col(hit))
            left = rest

    def loop(self, s: Step, live: Column | None) -> None:
        own: dict[str, str | None] = {"left": None, "skipped": None}
        trips = self.kernel.trips(s) if s.kind == "for" else None
        start_mask = self.named(live) if live is not None else None
        bounds: list[str] = []
        if s.kind == "for" and trips is None:
            bounds = [self.named(self.lower(t)) for t in s.trees]
            wrong = F.col(bounds[2]) == 0
            if self.df.filter(wrong if start_mask is None else wrong & F.col(start_mask)).take(1):
                raise EvaluationError("a range with a step of 0")
        self.loops.append(own)
        limit, rounds = while_limit(), 0
        asks = self.kernel.driven or trips is None
        value = bounds[0] if bounds else None
        for trip in trips if trips is not None else iter(int, 1):
            own["skipped"] = None
            mask = self.alive(F.col(start_mask) if start_mask else None)
            if s.kind == "while":
                test = self.lower(s.trees[0])
                mask = test if mask is None else mask & test
                start_mask = self.named(F.coalesce(mask, F.lit(False)))
                mask = F.col(start_mask)
            elif bounds:
                at, stop, stride = F.col(value), F.col(bounds[1]), F.col(bounds[2])
                inside = F.when(stride > 0, at < stop).otherwise(at > stop)
                mask = inside if mask is None else mask & inside
            rounds += 1
            if rounds % 8 == 0:
                self.df = cut(self.df)
            if asks and mask is not None and not self.df.filter(mask).take(1):
                break
            if s.kind == "while" and 0 < limit < rounds:
                raise EvaluationError(f"a while loop passed {limit} iterations")
            if s.kind == "for":
                now = F.lit(trip).cast("long") if trips is not None else F.col(value)
                self.bind(**{s.name: now if mask is None else F.when(mask, now).otherwise(F.lit(0).cast("long"))})
            self.block(s.body, mask)
            if self.all_returned:
                break
            if bounds:
                value = self.named(F.col(value) + F.col(bounds[2]))
        self.loops.pop()
        self.env.pop(s.name, None)

    def print(self, s: Step, live: Column | None) -> None:
        """Prints from the driver, if any row without nulls is here; what is printed must be one value
        for these rows."""
        known = self.known()
        here = live if known is None else known if live is None else known & live
        rows = self.df if here is None else self.df.filter(here)
        columns = [self.lower(t) for t in s.trees]
        row = rows.agg(F.count("*"), *[F.any_value(c) for c in columns], *[F.count_distinct(c) for c in columns]).first()
        n = len(columns)
        if not row[0]:
            return
        if any(x > 1 for x in row[1 + n :]):
            raise EvaluationError(f"line {s.line}: print of a value that differs between rows")
        print(s.text.format(*row[1 : 1 + n]))
