import uuid

import pytest
from pyspark.sql import functions as F

from lanewise.errors import ReductionRefused
from lanewise.streaming import apply, windowed


def test_rows_and_windows(spark, tmp_path):
    df = spark.range(100).select((F.timestamp_seconds(F.col("id") * 60)).alias("ts"), (F.col("id") * 1.0).alias("x"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(ReductionRefused):
        apply(stream, "x - mean(x)")
    out = windowed(apply(stream, "x * 2", "y"), "sum(y)", "ts", "1 hour", "1 hour", name="total")
    name = f"t{uuid.uuid4().hex}"
    query = out.writeStream.outputMode("complete").format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    assert [r.total for r in spark.table(name).orderBy("window").collect()] == [2.0 * sum(range(60)), 2.0 * sum(range(60, 100))]
