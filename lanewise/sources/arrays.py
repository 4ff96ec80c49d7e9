"""Arrays as DataFrames: index ranges, NumPy arrays, and text as Arrow offsets and bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from lanewise import dtypes as D
from lanewise.errors import TypeRefused
from lanewise.operators.kernel import _to_arrow
from lanewise.operators.nd import NdSpec
from lanewise.sources.checkpoint import cut


def index_range(spark: SparkSession, size: int | NdSpec, name: str = "idx", partitions: int | None = None) -> DataFrame:
    """The flat indices of an array; generated on the executors."""
    n = size.size if isinstance(size, NdSpec) else size
    return spark.range(0, n, 1, partitions).toDF(name)


def from_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], index: str = "idx") -> DataFrame:
    """Equally long one-dimensional arrays as columns, with their dtypes as metadata and an index."""
    size = {len(a) for a in arrays.values()}
    if len(size) > 1:
        raise TypeRefused("arrays of different lengths")
    n = size.pop() if size else 0
    types = {k: D.from_numpy(a.dtype) for k, a in arrays.items()}
    columns = [pa.array(np.arange(n))]
    for k, a in arrays.items():
        x = np.array([v.rstrip("\0") if types[k].kind == "U" else v for v in a.tolist()], object) if types[k].is_text else a
        columns.append(_to_arrow(x, types[k], np.zeros(n, bool)))
    table = pa.table(columns, names=[index, *arrays])
    schema = StructType([StructField(index, LongType()), *[StructField(k, D.spark_type(t), metadata=D.metadata(t)) for k, t in types.items()]])
    plain = spark.createDataFrame(table)
    out = plain.select(F.col(index), *[F.col(k).cast(D.spark_type(t)).alias(k) for k, t in types.items()])
    for field in schema.fields[1:]:
        out = out.withMetadata(field.name, field.metadata)
    return out


def valid_text(text: str) -> str:
    """Code points that UTF-8 cannot hold become U+FFFD."""
    return "".join("�" if 0xD800 <= ord(c) <= 0xDFFF else c for c in text)


def varlen(df: DataFrame, column: str, order: str) -> tuple[np.ndarray, bytes]:
    """A text or bytes column as Arrow lays it out: n + 1 offsets (int64) and the bytes, in an order.

    For results that fit the driver; a DataFrame's own column is the distributed form.
    """
    rows = df.orderBy(order).select(column).toArrow().column(0)
    parts = [b"" if v is None else v if isinstance(v, bytes) else valid_text(v).encode() for v in rows.to_pylist()]
    return np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64), b"".join(parts)


#: Rows of a range whose running sums one task makes.
RANGE_ROWS = 100_000


def with_offsets(df: DataFrame, column: str, order: str) -> DataFrame:
    """df with start and stop of each value in the concatenation of all, in the order of a column.

    Rows go into ranges of that order by sampled cut points, about RANGE_ROWS to a range however
    many there are; running sums go by ranges first, so no single task sums all rows. Rows of equal
    order stand in any order."""
    ranges = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS)
    sized = df.withColumn("_n", F.coalesce(F.octet_length(column), F.lit(0)).cast("long"))
    sized = cut(sized.repartitionByRange(ranges, order).withColumn("_b", F.spark_partition_id()))
    whole = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sized.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(whole), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = sized.join(sums, "_b").withColumn("stop", F.col("_before") + F.sum("_n").over(inside))
    return out.withColumn("start", F.col("stop") - F.col("_n")).select(*df.columns, "start", "stop")


def data_bound(t: D.DType, rows: int) -> int:
    """The most bytes that so many values of a text type take: 0 for other types."""
    if not t.is_text or t.itemsize is None:
        return 0
    return t.itemsize * rows
