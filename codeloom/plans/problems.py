"""Queries of the general problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.cleaning import hex_digest, relative_path, status, trimmed
from codeloom.operators.hierarchy import build_hierarchy, descendants
from codeloom.operators.latest import latest_by
from codeloom.operators.snapshots import snapshot_changes
from codeloom.sources.tables import table
from codeloom.streaming.orphans import OrphanState, update_orphans


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    complete = table(spark, sf_dir, "deliveries").where(status(F.col("status")) == "complete")
    complete = complete.select(trimmed(F.col("repo")).alias("scope"), F.col("snapshot_id").alias("snapshot"))
    changes = snapshot_changes(
        table(spark, sf_dir, "files"),
        complete,
        scope=trimmed(F.col("repo")),
        snapshot=F.col("snapshot_id"),
        key=relative_path(F.col("path")),
        digest=hex_digest(F.col("content_sha256")),
        version=F.col("loaded_at"),
    )
    return changes.select(F.col("scope").alias("repo"), F.col("key").alias("path"), F.col("snapshot").alias("snapshot_id"), "change")


def p1_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per repository and delivery."""
    found = p1_found(spark, sf_dir)
    return found.groupBy("repo", "snapshot_id", "change").agg(F.count(F.lit(1)).alias("n_files"))


def _orphans(spark: SparkSession, sf_dir: str) -> OrphanState:
    relations = table(spark, sf_dir, "relations")
    references = relations.where(status(F.col("resolution")).isin("resolved", "probable")).select(
        F.col("relation_id").alias("ref_id"),
        F.coalesce(trimmed(F.col("target_qualified_name")), trimmed(F.col("target_text"))).alias("target"),
        F.col("recorded_at").alias("at"),
        F.col("loaded_at").alias("arrival"),
        status(F.col("kind")).alias("kind"),
    )
    symbols = table(spark, sf_dir, "symbols").select(
        F.lit("symbols").alias("source"),
        trimmed(F.col("qualified_name")).alias("name"),
        F.col("first_seen_at").alias("start"),
        F.col("deleted_at").alias("end"),
        F.col("loaded_at").alias("arrival"),
    )
    external = table(spark, sf_dir, "external_symbols").select(
        F.lit("external_symbols").alias("source"),
        trimmed(F.col("qualified_name")).alias("name"),
        F.col("available_from").alias("start"),
        F.col("withdrawn_at").alias("end"),
        F.lit(None).cast("timestamp_ntz").alias("arrival"),
    )
    arrival = F.col("arrival").cast("timestamp")
    return update_orphans(None, references.withColumn("arrival", arrival), symbols.unionByName(external).withColumn("arrival", arrival), keep=("kind",))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).current().select(F.col("ref_id").alias("relation_id"), "reason")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per kind and month of reference."""
    state = _orphans(spark, sf_dir)
    found = state.current().join(state.references.select("ref_id", "kind", "at"), "ref_id")
    month = F.date_format(F.col("at").cast("timestamp"), "yyyy-MM")
    return found.groupBy(F.lit("relations").alias("table_name"), "kind", month.alias("month"), "reason").agg(F.count(F.lit(1)).alias("n_orphans"))


def p3_open_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans open after each month of arrival."""
    month = F.format_string("%04d-%02d", F.floor(F.col("month") / 12), F.col("month") % 12 + 1).alias("month")
    return _orphans(spark, sf_dir).counts("kind").select(month, "kind", "reason", "n_open")


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "symbols").select(
        trimmed(F.col("qualified_name")).alias("name"), trimmed(F.col("parent_qualified_name")).alias("parent"), "loaded_at"
    )
    return latest_by(symbols.where("name is not null"), ["name"], "loaded_at", ["parent"])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = build_hierarchy(_links(spark, sf_dir)).where("status <> 'rooted'")
    return tree.select(F.col("name").alias("qualified_name"), "status", "top", "steps")


def p6_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth and root of every symbol whose chain ends at a root."""
    tree = build_hierarchy(_links(spark, sf_dir), paths=True).where("status = 'rooted'")
    return tree.select(F.col("name").alias("qualified_name"), F.array_join("path", " > ").alias("path"), F.col("steps").alias("depth"), F.col("top").alias("root"))


def p6_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ancestor-descendant pair with its distance."""
    return descendants(build_hierarchy(_links(spark, sf_dir), paths=True))


QUERIES = {f.__name__: f for f in (p1_found, p1_change_counts, p3_found, p3_counts, p3_open_by_period, p6_found, p6_paths, p6_descendants)}
