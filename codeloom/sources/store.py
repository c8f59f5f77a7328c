"""Versioned snapshots of an index: each version is a folder of Parquet tables and has a pointer of its own.

The current version is the greatest with a whole pointer, which is written after
all tables; nothing is replaced, so a write that stops anywhere leaves the index
as it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
TABLES = ("files", "symbols", "code_units", "relations")


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        """The current version, None before the first; an index of another schema is refused."""
        whole = self._fs.globStatus(self._path(f"{self.root}/pointer.*/_SUCCESS")) or []
        versions = [int(x.getPath().getParent().getName().rpartition(".")[2]) for x in whole]
        if not versions:
            return None
        schema = self.spark.read.text(f"{self.root}/pointer.{max(versions)}").first()[0]
        if int(schema) != SCHEMA_VERSION:
            raise ValueError(f"the index has schema version {schema}, this library reads {SCHEMA_VERSION}; write it anew with full=True")
        return max(versions)

    def _point(self, version: int) -> None:
        self.spark.range(1).select(F.lit(str(SCHEMA_VERSION)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.root}/pointer.{version}")

    def write(self, tables: dict[str, DataFrame]) -> int:
        """Write all tables as the next version and make it current."""
        missing = set(TABLES) - set(tables)
        if missing:
            raise ValueError(f"missing tables: {sorted(missing)}")
        repeated = tables["symbols"].groupBy("qualified_name").count().where("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"symbol defined more than once: {repeated[0]['qualified_name']}")
        version = (self.current() or 0) + 1
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{self.root}/v{version}/{name}")
        self._point(version)
        return version

    def read(self, name: str) -> DataFrame:
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no index under {self.root}")
        return self.spark.read.parquet(f"{self.root}/v{version}/{name}")

    def write_vectors(self, vectors: DataFrame) -> None:
        """Write the vectors of the current version; they become current when all are written."""
        version = self.current()
        if version is None:
            raise FileNotFoundError(f"no index under {self.root}")
        count = (max((int(n) for n in self._vector_folders()), default=0)) + 1
        staged = f"{self.root}/_vectors.{count}"
        vectors.write.mode("overwrite").parquet(staged)
        self._validate(self.spark.read.parquet(staged), self.read("code_units"))
        self._fs.rename(self._path(staged), self._path(f"{self.root}/vectors.{count}"))

    def _validate(self, vectors: DataFrame, units: DataFrame) -> None:
        """Refuse vectors that are not one finite vector of one model and dimension for each unit."""
        norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        seen = vectors.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("qualified_name").alias("names"), F.countDistinct("model_id").alias("models"), F.countDistinct(F.size("vector")).alias("dimensions"),
            F.count_if(norm.isNull() | F.isnan(norm) | (norm <= 0) | (norm == F.lit(float("inf")))).alias("unusable"),
        ).first()
        stray = vectors.select("qualified_name").exceptAll(units.select("qualified_name")).isEmpty() and units.count() == seen["n"]
        if seen["names"] != seen["n"] or seen["models"] > 1 or seen["dimensions"] > 1 or seen["unusable"] or not stray:
            raise ValueError(f"the vectors do not fit the index: {seen.asDict()}")

    def _vector_folders(self) -> list[str]:
        found = self._fs.globStatus(self._path(f"{self.root}/vectors.*"))
        return [s.getPath().getName().rpartition(".")[2] for s in found or []]

    def read_vectors(self) -> DataFrame:
        """(qualified_name, model_id, fingerprint, vector) written last; none before the first."""
        schema = "qualified_name string, model_id string, fingerprint string, vector array<float>"
        folders = self._vector_folders()
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/vectors.{max(map(int, folders))}")
