"""Equi-joins whose left side may have hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_keys(df: DataFrame, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Keys that hold more than one partition's fair share of the rows, with how many salts each needs.

    At most ``partitions`` keys can hold more than ``1 / partitions`` of the rows,
    so the result has a proven bound and may be broadcast.
    """
    spark = df.sparkSession
    parts = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (
        counts.join(F.broadcast(total))
        .filter((F.col("_n") * parts > F.col("_total")) & (F.col("_n") > 1000))
        .select(*keys, F.ceil(F.col("_n") * parts / F.col("_total")).cast("int").alias("_salts"))
    )


def with_salt(df: DataFrame, keys: Sequence[str], hot: DataFrame, spread: str) -> DataFrame:
    """Left side: ``_salt`` is 0 but for hot keys, whose rows are spread by ``spread``."""
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(F.xxhash64(spread), F.col("_salts"))).otherwise(F.lit(0))
    return df.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt.cast("int")).drop("_salts")


def with_copies(df: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """Right side (few rows per key): a copy for each salt of a hot key."""
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    return df.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.explode(copies)).drop("_salts")


def found_hot(hot: DataFrame) -> DataFrame | None:
    """A written :func:`hot_keys`, or None if no key is hot."""
    return None if hot.isEmpty() else hot


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], hot: DataFrame | None, spread: str, how: str = "inner") -> DataFrame:
    """``left`` join ``right`` on ``keys`` where ``hot`` (from :func:`found_hot`) lists the skewed keys of ``left``."""
    if hot is None:
        return left.join(right, list(keys), how)
    joined = with_salt(left, keys, hot, spread).join(with_copies(right, keys, hot), [*keys, "_salt"], how)
    return joined.drop("_salt")
