"""File listings that arrive as a stream, turned into change sets batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.incremental import change_set

LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("content_sha256", T.StringType())])


def follow_listings(spark: SparkSession, source: str, state: str, changes: str, checkpoint: str) -> StreamingQuery:
    """Compare each arriving listing (a batch of Parquet files) with the one before; append what differs.

    ``state`` keeps the last listing, ``changes`` gets (path, change, batch_id).  A
    batch that runs again after a failure overwrites its own output.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        now = batch.dropDuplicates(["path"])
        before = f"{state}/{batch_id - 1}"
        fs = path(before).getFileSystem(session.sparkContext._jsc.hadoopConfiguration())
        old = session.read.schema(LISTING).parquet(before) if fs.exists(path(before)) else session.createDataFrame([], LISTING)
        now.write.mode("overwrite").parquet(f"{state}/{batch_id}")
        change_set(old, now, ["path"], "content_sha256").where("change <> 'unchanged'").write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")

    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
