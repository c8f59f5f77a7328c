"""Written intermediate tables that cut lineage and survive the loss of executors.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only where
that is unset (tests, a laptop) a local folder is made.  Every table is removed
when the JVM ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Workspace:
    """One operator run's written tables."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        self._fs.deleteOnExit(path)
        self._path = jvm.org.apache.hadoop.fs.Path

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Run ``df``, keep it under ``name`` and return a reader of the written rows."""
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def append(self, df: DataFrame, name: str, part: int) -> DataFrame:
        """Like :meth:`write`, as one part of the table ``name``; returns a reader of all parts so far."""
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/part={part}")
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").drop("part")

    def drop(self, name: str) -> None:
        """Remove a table that nothing will read again."""
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
