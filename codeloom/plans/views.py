"""Clean, current views of the delivered tables: one row per key, names trimmed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.cleaning import relative_path, status, trimmed
from codeloom.functions.text import base_name
from codeloom.operators.latest import latest_by
from codeloom.sources.tables import table

SPAN = ["start_line", "end_line", "start_byte", "end_byte"]


def symbols_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qualified_name, path, name, kind, span, signature, parent): the latest reading of each symbol."""
    rows = table(spark, sf_dir, "symbols").select(
        trimmed(F.col("qualified_name")).alias("qualified_name"),
        trimmed(F.col("path")).alias("path"),
        trimmed(F.col("name")).alias("name"),
        status(F.col("kind")).alias("kind"),
        *SPAN,
        "signature",
        trimmed(F.col("parent_qualified_name")).alias("parent"),
        "loaded_at",
    )
    return latest_by(rows.where("qualified_name is not null"), ["qualified_name"], "loaded_at", ["path", "name", "kind", *SPAN, "signature", "parent"])


def units_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returnable units: the latest text of each symbol that has one; kind and signature are the symbol's."""
    rows = table(spark, sf_dir, "code_units").select(
        trimmed(F.col("qualified_name")).alias("qualified_name"), trimmed(F.col("path")).alias("unit_path"), F.coalesce("source_text", F.lit("")).alias("source_text"), *SPAN, "loaded_at"
    )
    units = latest_by(rows.where("qualified_name is not null"), ["qualified_name"], "loaded_at", ["unit_path", "source_text", *SPAN])
    symbols = symbols_now(spark, sf_dir).select("qualified_name", "name", "kind", "signature")
    return units.join(symbols, "qualified_name").withColumnRenamed("unit_path", "path")


def search_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`units_now` with the module_name that the latest listing gives their file."""
    rows = table(spark, sf_dir, "files").select(relative_path(F.col("path")).alias("file"), trimmed(F.col("module_name")).alias("module_name"), "loaded_at")
    modules = latest_by(rows.where("file is not null"), ["file"], "loaded_at", ["module_name"])
    units = units_now(spark, sf_dir)
    return units.withColumn("file", relative_path(F.col("path"))).join(modules, "file", "left").drop("file")


def edges_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(relation_id, kind, source, target, target_text, resolution, path, start_byte, end_byte), each id once."""
    rows = table(spark, sf_dir, "relations").select(
        "relation_id",
        status(F.col("kind")).alias("kind"),
        trimmed(F.col("source_qualified_name")).alias("source"),
        trimmed(F.col("target_qualified_name")).alias("target"),
        trimmed(F.col("target_text")).alias("target_text"),
        status(F.col("resolution")).alias("resolution"),
        trimmed(F.col("path")).alias("path"),
        "start_byte",
        "end_byte",
        "loaded_at",
    )
    values = ["kind", "source", "target", "target_text", "resolution", "path", "start_byte", "end_byte"]
    return latest_by(rows.where("relation_id is not null"), ["relation_id"], "loaded_at", values)


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, model_id, qualified_name, vector): usable vectors (64 finite numbers, not all zero)."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = (F.size("vector") == 64) & finite & F.exists("vector", lambda x: x != 0)
    return table(spark, sf_dir, "reuse_vectors").where(usable).select("vec_id", "model_id", trimmed(F.col("qualified_name")).alias("qualified_name"), "vector")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, text, model_id, vector, gold): the stated query set, every vector whose id is divisible by 100."""
    rows = unit_vectors(spark, sf_dir).where("vec_id % 100 = 0 and qualified_name is not null")
    return rows.select(F.col("vec_id").alias("query_id"), base_name(F.col("qualified_name")).alias("text"), "model_id", "vector", F.col("qualified_name").alias("gold"))
