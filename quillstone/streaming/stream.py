"""Structured Streaming ingestion: the batch plans on files as they arrive."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='quillstone-stream-')}"


def file_stream(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """Files called ``name`` (a glob) in ``folder``, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def distinct_stream(spark: SparkSession, folder: str, name: str, schema: StructType, keys: Sequence[str]) -> DataFrame:
    """First rows of each key of a file stream."""
    return file_stream(spark, folder, name, schema).select(*keys).dropDuplicates(list(keys))


def windowed(stream: DataFrame, at: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts by tumbling window; rows later than ``late`` are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))


def available_now(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all files present and return what it wrote, as a table.

    ``complete`` results are written whole by each micro-batch over the one before.
    """
    root = _root(spark)
    out = f"{root}/out"
    write = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        write = write.format("parquet").option("path", out)
    else:
        write = write.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out))
    write.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], state: str) -> None:
    """Apply a batch plan to every micro-batch; the sink sees (result, batch number) and can be idempotent."""
    q = stream.writeStream.foreachBatch(lambda df, n: sink(plan(df), n)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
