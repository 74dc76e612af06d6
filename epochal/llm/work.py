"""Tables between the steps of an operator, in the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset on one machine (tests), one of our own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="epochal-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


BATCH_ROWS = "2000"


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel to the workers 2000 at a time, unless the session asks for another number than Spark's own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, BATCH_ROWS)


class Work:
    """Names, writes and removes the tables of one operator call.

    ``cut`` ends a lineage: after it, a lost executor costs a reread, not a recomputation.
    Tables that the returned DataFrame still reads stay until the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)
        self._n = 0

    def path(self, name: str = "part") -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "part") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str | None = None) -> None:
        """Remove one table, or all of this call's."""
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path or self.root)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # at exit the JVM may have ended first; the folder's owner then clears it
            if path is not None:
                raise

    def drop_table(self, df: DataFrame) -> None:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            self.drop(path)
