"""Reading the tables of a scale directory, and cutting lineage safely."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    A folder of this machine is used only where that setting is missing and the session is local,
    as in tests.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lanewise-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns it without its lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, which columns that repeat values fill far less than
    rows of a checkpoint; deleted when the application ends."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/table-{uuid.uuid4().hex}")
    df.write.parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(path.toString())


#: Rows up to which a narrow table may be sent to every executor.
SMALL_ROWS = 100_000


_BLOCK = 1 << 13


def _block_map(table: pa.Table) -> pa.Table:
    bits = np.zeros(_BLOCK, bool)
    bits[table["place"].to_numpy()] = True
    return pa.table([table["block"].slice(0, 1), pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["block", "bits"])


def bit_map(slots: Column, df: DataFrame, size: int) -> np.ndarray:
    """A bit map of a fixed size with the slots of df's rows set. Blocks of it are made by the
    executors, so the driver gets size / 8 bytes at most however many rows there are."""
    places = df.select(F.shiftright(slots, 13).alias("block"), slots.bitwiseAND(_BLOCK - 1).alias("place")).distinct()
    out = np.zeros(max(size, _BLOCK) // 8, np.uint8)
    for row in places.groupBy("block").applyInArrow(_block_map, "block bigint, bits binary").collect():
        out[row.block * _BLOCK // 8 : (row.block + 1) * _BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return np.unpackbits(out).view(bool)


def in_ranges(df: DataFrame, parts: int, order: list[str], name: str) -> DataFrame:
    """df in ``parts`` ranges of ``order`` by sampled cut points, at least as many as shuffles have
    partitions, written with the range's number in the column ``name``."""
    parts = max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return cut(df.repartitionByRange(parts, *order).withColumn(name, F.spark_partition_id().cast("long")))


#: Ranges whose sums one window task adds up.
RUN = 4096


def earlier_sums(df: DataFrame, place: str, value: str, name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """(within, place, name): for each place (a whole number) the sum of the values at smaller ones,
    for each value of ``within`` by itself. Sums go up in runs of places, so no task reads them all."""
    some = df.groupBy(*within, place).agg(F.sum(value).alias("_sum")).withColumn("_run", F.floor(F.col(place) / RUN))
    upto = lambda w: F.coalesce(F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = some.groupBy(*within, "_run").agg(F.sum("_sum").alias("_sum"))
    runs = runs.select(*[F.col(c).alias(f"_{c}") for c in within], F.col("_run").alias("_of"), upto(Window.partitionBy(*within).orderBy("_run")).alias("_before"))
    inside = some.withColumn("_inside", upto(Window.partitionBy(*within, "_run").orderBy(place)))
    same = F.col("_run") == F.col("_of")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    return inside.join(runs, same).select(*within, place, (F.col("_before") + F.col("_inside")).alias(name))


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """df, written and marked for broadcast if it has no more than SMALL_ROWS rows; for narrow tables."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df
