"""Expressions over streaming DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.api import Compiled, agg, compile
from lanewise.errors import ReductionRefused


def apply(stream: DataFrame, text: str, name: str = "result", udfs: list | None = None) -> DataFrame:
    """A row-wise expression on a stream: a projection without state."""
    compiled = compile(text, stream.schema, udfs=udfs)
    if not isinstance(compiled, Compiled) or compiled.tree.has_reduction:
        raise ReductionRefused("a stream has no end to reduce to; use windowed()")
    return compiled.apply(stream, name)


def windowed(stream: DataFrame, text: str, time: str, length: str, late: str, slide: str | None = None, keys: tuple[str, ...] = (), name: str = "result") -> DataFrame:
    """Reductions of each time window (and key): window, keys and the value.

    ``late`` bounds how long a window stays open for late rows, and so the state kept.
    """
    value = agg(text, stream.schema)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(value.alias(name))


def to_table(result: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of windows over all that its source holds now; the windows as a table in a folder
    that all executors share."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/windows")

    run = result.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(save).start()
    run.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(f"{folder}/windows")
