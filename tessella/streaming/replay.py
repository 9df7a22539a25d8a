"""Tables replayed as streams: slices of time, one micro-batch after the other."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.streaming.state import PARTITIONS, state_store

#: A partition of state costs some tenths of a second of each micro-batch, whatever it holds; so many rows of a replayed table are worth one.
STATE_ROWS = 250_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a session on this machine may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tessella-replay-")
    return f"{root.rstrip('/')}/replay-{uuid.uuid4().hex}"


def replayed(rows: DataFrame, stream: Callable[[DataFrame], DataFrame], *, time: str, slices: int = 4) -> DataFrame:
    """What a stream gives for ``rows`` that come in slices of equal time, earliest first; all of it, as a written table.

    The stream starts anew from its checkpoint for each slice, as after a failure.
    Its state has as many partitions as the rows need and at least one a core,
    but no more than the session shuffles to.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    low, high, n = rows.agg(F.min(time), F.max(time), F.count("*")).first()
    partitions = min(int(spark.conf.get(PARTITIONS)), max(spark.sparkContext.defaultParallelism, -(-n // STATE_ROWS)))
    if low is None:
        low = high = 0.0
    place = F.least(F.floor((F.col(time) - low) / ((high - low) / slices)), F.lit(slices - 1)) if high > low else F.lit(0)
    dealt = rows.withColumn("_slice", place.cast("int"))
    dealt.write.partitionBy("_slice").parquet(f"{folder}/slices")
    with state_store(spark, partitions):
        for k in range(slices):
            spark.read.schema(dealt.schema).parquet(f"{folder}/slices").where(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(f"{folder}/in")
            made = stream(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
            run = made.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")
