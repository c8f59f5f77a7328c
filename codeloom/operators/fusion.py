"""Reciprocal-rank fusion of ranked lists, for a batch of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60


def fuse(lists: list[tuple[str, DataFrame]], limit: int | None = None, k: int = RRF_K) -> DataFrame:
    """(query_id, item, score, rank, contributions) of named lists (query_id, item, rank).

    score is the sum of ``1 / (k + rank)`` in the order of the lists; ties go to
    the smaller item.  contributions holds (position, source, rank, part) of each list.
    """
    rows = reduce(
        DataFrame.unionAll,
        [df.select("query_id", "item", F.lit(i).alias("position"), F.lit(name).alias("source"), F.col("rank").cast("int").alias("list_rank")) for i, (name, df) in enumerate(lists)],
    )
    parts = rows.withColumn("part", 1.0 / (F.lit(k) + F.col("list_rank")))
    fused = parts.groupBy("query_id", "item").agg(F.array_sort(F.collect_list(F.struct("position", "source", "list_rank", "part"))).alias("contributions"))
    score = F.round(F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["part"]), 9)
    ranked = fused.withColumn("score", score).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "item")))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
