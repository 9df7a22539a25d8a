"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a local master can do without; it gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs here go when it ends, as its result is a table by then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Workspace:
    """Tables of one run of an operator.

    A written table cuts the lineage: what follows reads files that outlive
    any executor.  The tables go when the driver exits, as results still read
    them until then; ``drop`` removes them earlier.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.path}/{name}"
        with _shuffles_end_with_the_write(self.spark):
            df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove one table, or the whole workspace."""
        context = self.spark.sparkContext
        if context._jsc is None or context._jsc.sc().isStopped():
            return
        target = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
