"""Incremental maintenance: change sets, resolution surfaces, merges and work counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def change_set(old: DataFrame, new: DataFrame, key: list[str], digest: str) -> DataFrame:
    """(key..., change) of two listings: added, deleted, changed or unchanged by their digests (null equals null)."""
    a = old.select(*key, F.col(digest).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(*key, F.col(digest).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(*key, change.alias("change"))


def surface_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the resolution surface (qualified_name, name, kind, parent) in one reading only, with the side."""
    surface = ["qualified_name", "name", "kind", "parent"]
    gone = old.select(*surface).exceptAll(new.select(*surface)).withColumn("side", F.lit("old"))
    return gone.unionAll(new.select(*surface).exceptAll(old.select(*surface)).withColumn("side", F.lit("new")))


def merge(old: DataFrame, fresh: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """``old`` without the rows of touched keys, and ``fresh``."""
    return old.join(touched.select(key), key, "left_anti").unionByName(fresh)


def work_counts(changes: DataFrame, by: list[str]) -> DataFrame:
    """Files analysed and left alone per ``by``."""
    count = {c: F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("added", "changed", "deleted", "unchanged")}
    return changes.groupBy(*by).agg(F.count_if(F.col("change").isin("added", "changed")).alias("n_analysed"), *count.values())
