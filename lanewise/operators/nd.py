"""N-dimensional arrays in chunks and blocks, held as rows of a flat index and values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import dtypes as D
from lanewise.errors import EvaluationError, ReductionRefused, VariableRefused
from lanewise.operators.kernel import Kernel
from lanewise.operators.reductions import identity

MAX_NDIM = 64


@dataclass(frozen=True)
class NdSpec:
    """An array of ``shape`` in C order, cut into chunks, and chunks into blocks; the last ones of a
    dimension may reach beyond what they are cut from."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    blocks: tuple[int, ...]

    def __post_init__(self) -> None:
        if not 1 <= len(self.shape) <= MAX_NDIM or not len(self.shape) == len(self.chunks) == len(self.blocks):
            raise VariableRefused("shape, chunks and blocks need as many dimensions, 1 to 64")
        if min(self.chunks) <= 0 or min(self.blocks) <= 0:
            raise VariableRefused("chunks and blocks must not be empty")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def block_items(self) -> int:
        return math.prod(self.blocks)

    @property
    def chunk_grid(self) -> tuple[int, ...]:
        return tuple(-(-s // c) for s, c in zip(self.shape, self.chunks))

    @property
    def block_grid(self) -> tuple[int, ...]:
        return tuple(-(-c // b) for c, b in zip(self.chunks, self.blocks))

    @staticmethod
    def strides(of: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(math.prod(of[d + 1 :]) for d in range(len(of)))

    def checked(self) -> NdSpec:
        if min(self.shape) <= 0:
            raise EvaluationError("a dimension of size 0")
        return self

    def valid_items(self, chunk: int, block: int) -> int:
        """Elements of the array in a block of a chunk."""
        self.checked()
        if not 0 <= chunk < math.prod(self.chunk_grid) or not 0 <= block < math.prod(self.block_grid):
            raise EvaluationError(f"no chunk {chunk} with a block {block}")
        total = 1
        for d in range(self.ndim):
            c = chunk // self.strides(self.chunk_grid)[d] % self.chunk_grid[d]
            b = block // self.strides(self.block_grid)[d] % self.block_grid[d]
            start = b * self.blocks[d]
            in_chunk = min(self.blocks[d], self.chunks[d] - start)
            in_shape = self.shape[d] - c * self.chunks[d] - start
            total *= max(0, min(in_chunk, in_shape))
        return total

    # Columns of a flat index

    def coordinate(self, flat: Column, d: int) -> Column:
        """Place along a dimension; 0 beyond the last."""
        if d >= self.ndim:
            return F.lit(0).cast("long")
        return F.call_function("div", flat.cast("long"), F.lit(self.strides(self.shape)[d])) % F.lit(self.shape[d])

    def _numbered(self, digits: list[Column], grid: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for digit, stride in zip(digits, self.strides(grid)):
            out = out + digit * stride
        return out

    def chunk_of(self, flat: Column) -> Column:
        return self._numbered([F.call_function("div", self.coordinate(flat, d), F.lit(c)) for d, c in enumerate(self.chunks)], self.chunk_grid)

    def block_of(self, flat: Column) -> Column:
        inside = [self.coordinate(flat, d) % c for d, c in enumerate(self.chunks)]
        return self._numbered([F.call_function("div", x, F.lit(b)) for x, b in zip(inside, self.blocks)], self.block_grid)

    def item_of(self, flat: Column) -> Column:
        """Place inside the block, in C order of the block's shape."""
        inside = [self.coordinate(flat, d) % c % b for d, (c, b) in enumerate(zip(self.chunks, self.blocks))]
        return self._numbered(inside, self.blocks)

    def located(self, df: DataFrame, index: str) -> DataFrame:
        """df with columns chunk, block and item."""
        flat = F.col(index)
        return df.withColumns({"chunk": self.chunk_of(flat), "block": self.block_of(flat), "item": self.item_of(flat)})

    def grid(self, spark: SparkSession) -> DataFrame:
        """All blocks: chunk, block, and valid (their elements in the array)."""
        self.checked()
        n_blocks = math.prod(self.block_grid)
        out = spark.range(math.prod(self.chunk_grid) * n_blocks).select(
            F.call_function("div", F.col("id"), F.lit(n_blocks)).alias("chunk"), (F.col("id") % n_blocks).alias("block")
        )
        valid = F.lit(1).cast("long")
        for d in range(self.ndim):
            c = F.call_function("div", F.col("chunk"), F.lit(self.strides(self.chunk_grid)[d])) % self.chunk_grid[d]
            start = F.call_function("div", F.col("block"), F.lit(self.strides(self.block_grid)[d])) % self.block_grid[d] * self.blocks[d]
            inside = F.least(F.lit(self.blocks[d]), F.lit(self.chunks[d]) - start, F.lit(self.shape[d]) - c * self.chunks[d] - start)
            valid = valid * F.greatest(inside, F.lit(0))
        return out.withColumn("valid", valid)


@dataclass
class NdCompiled:
    """An expression or kernel over an array."""

    compiled: object
    spec: NdSpec

    @property
    def dtype(self) -> D.DType:
        return self.compiled.dtype

    @property
    def is_scalar(self) -> bool:
        return self.compiled.is_scalar

    def apply(self, df: DataFrame, index: str, name: str = "result") -> DataFrame:
        """df (one row for each element) with the result of each element."""
        self.spec.checked()
        if isinstance(self.compiled, Kernel):
            return self.compiled.apply(df, name, index, self.spec)
        if self.is_scalar or self.compiled.tree.has_reduction:
            return self.by_block(df, index, name)
        return self.compiled.apply(df, name)

    def by_block(self, df: DataFrame, index: str, name: str) -> DataFrame:
        """Reductions of each block: one row for each block if that is all, else joined to its elements."""
        located = self.spec.located(df, index)
        if self.is_scalar:
            return self.blocks(df, index, name)
        found: dict[str, tuple[str, object]] = {}
        for n in self.compiled.tree.walk():
            if n.op == "reduce":
                found.setdefault(str(n), (f"_reduced{len(found)}", n))
        totals = located.groupBy("chunk", "block").agg(*[self.compiled.reduce(n).alias(k) for k, n in found.values()])
        joined = located.join(totals, ["chunk", "block"])
        joined = joined.withColumn(name, self.compiled.column(reduction=lambda n: F.col(found[str(n)][0])))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)

    def blocks(self, df: DataFrame, index: str, name: str = "result") -> DataFrame:
        """chunk, block, valid and the value of each block of the grid. A block without elements has
        0, as if it were filled with nothing; its mean is NaN."""
        if isinstance(self.compiled, Kernel) or not self.is_scalar:
            raise ReductionRefused("blocks have single values only of reductions")
        grid = self.spec.grid(df.sparkSession)
        found = self.spec.located(df, index).groupBy("chunk", "block").agg(self.compiled.aggregate().alias(name))
        out = grid.join(found, ["chunk", "block"], "left")
        root = self.compiled.tree
        while root.op == "cast":
            root = root.args[0]
        mean = root.op == "reduce" and root.value == "mean"
        from lanewise.functions import ieee

        empty = ieee.literal(identity("mean", D.FLOAT64) if mean else 0, self.dtype)
        return out.select("chunk", "block", "valid", F.when(F.col("valid") > 0, F.col(name)).otherwise(empty).alias(name))

    def padded(self, df: DataFrame, index: str, name: str = "result") -> DataFrame:
        """chunk, block, item and value of every place of every block; places beyond the array hold 0."""
        from lanewise.functions import ieee

        values = self.spec.located(self.apply(df, index, name), index).select("chunk", "block", "item", F.col(name))
        places = self.spec.grid(df.sparkSession).select("chunk", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.spec.block_items - 1).cast("long"))).alias("item"))
        joined = places.join(values.withColumn("_there", F.lit(True)), ["chunk", "block", "item"], "left")
        empty = F.lit("") if self.dtype.is_text else ieee.literal(0, self.dtype)
        return joined.select("chunk", "block", "item", F.when(F.col("_there"), F.col(name)).otherwise(empty).alias(name))


def compile_nd(text: str, names, spec: NdSpec, out: D.DType | str = D.AUTO, udfs=None, **ignored: object) -> NdCompiled:
    """Compiles over an array; see api.compile."""
    from lanewise.api import compile

    return NdCompiled(compile(text, names, out, udfs), spec)
