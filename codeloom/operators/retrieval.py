"""The retrieval ladder for a batch of queries: lexical, dense, hybrid, graph, reranked.

Ranked lists are DataFrames (query_id, item, rank); ``item`` is a qualified name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.dense import dense_search
from codeloom.operators.fusion import RRF_K, fuse
from codeloom.operators.lexical import lexical_search, with_path_prefix
from codeloom.sources.workspace import Workspace

SEEDS = 10
CHANNELS = ("calls", "references", "inherits", "contains")
COLUMNS = ("qualified_name", "name", "signature", "source_text", "module_name", "path", "kind")


def hybrid_depth(limit: int) -> int:
    return max(50, 5 * limit)


def base_pool(limit: int) -> int:
    return max(10, limit)


def rerank_depth(limit: int) -> int:
    return max(20, 5 * limit)


@dataclass
class Corpus:
    """units: qualified_name, name, kind, path, module_name, signature, source_text; vectors: qualified_name, model_id,
    vector; edges: kind, source, target, resolution.

    ``kind`` and ``path_prefix`` restrict what every list of the ladder may hold, before it is cut at its depth;
    statistics cover all units.  As in the surveyed engine, the lexical list ignores ASCII case in the prefix.
    """

    units: DataFrame
    vectors: DataFrame
    edges: DataFrame
    kind: str | None = None
    path_prefix: str | None = None

    def __post_init__(self) -> None:
        self.work = Workspace(self.units.sparkSession, "retrieval")
        self._lists: dict[tuple[str, int], DataFrame] = {}

    def _allowed(self, ignore_case: bool = False) -> DataFrame:
        """Units that the filters let through."""
        units = self.units if self.kind is None else self.units.where(F.col("kind") == self.kind)
        return units if self.path_prefix is None else with_path_prefix(units, self.path_prefix, ignore_case)

    def _kept(self, name: str, depth: int, make) -> DataFrame:
        if (name, depth) not in self._lists:
            self._lists[name, depth] = self.work.write(make(), f"{name}{depth}")
        return self._lists[name, depth]

    def _cut(self, name: str, depth: int, make) -> DataFrame:
        """A list whose ranks do not depend on its depth: a deeper one that was kept is cut."""
        kept = [d for n, d in self._lists if n == name and d >= depth]
        if kept:
            return self._lists[name, min(kept)].where(F.col("rank") <= depth)
        return self._kept(name, depth, make)

    def lexical(self, queries: DataFrame, depth: int) -> DataFrame:
        def run() -> DataFrame:
            filtered = self.kind is not None or self.path_prefix is not None
            keep = self._allowed(ignore_case=True).select("qualified_name") if filtered else None
            hits = lexical_search(queries, self.units, "qualified_name", COLUMNS, depth, keep=keep)
            return hits.select("query_id", F.col("qualified_name").alias("item"), "rank", "score")

        return self._cut("lexical", depth, run)

    def dense(self, queries: DataFrame, depth: int) -> DataFrame:
        """Vectors of names that are no returnable unit any more are left out before ranking; blank queries find nothing."""

        def run() -> DataFrame:
            fresh = self.vectors.join(self._allowed().select("qualified_name"), "qualified_name", "left_semi")
            hits = dense_search(
                queries.where(F.length(F.trim("text")) > 0).select("query_id", F.col("model_id").alias("group"), "vector"),
                fresh.select(F.col("qualified_name").alias("item"), F.col("model_id").alias("group"), "vector"),
                depth,
            )
            return hits.select("query_id", "item", "rank", F.col("cosine").alias("score"))

        return self._cut("dense", depth, run)

    def hybrid(self, queries: DataFrame, limit: int) -> DataFrame:
        depth = hybrid_depth(limit)
        return fuse([("lexical", self.lexical(queries, depth)), ("dense", self.dense(queries, depth))], limit)

    def _seeds(self, queries: DataFrame, pool: int) -> DataFrame:
        hybrid = self._kept("hybrid", pool, lambda: self.hybrid(queries, pool).select("query_id", "item", "rank", "score"))
        return hybrid.where(F.col("rank") <= SEEDS)

    def evidence(self, queries: DataFrame, pool: int) -> DataFrame:
        """(query_id, seed, seed_rank, item, kind, direction): distinct resolved links of seeds with other units."""
        seeds = self._seeds(queries, pool).select("query_id", F.col("item").alias("seed"), F.col("rank").alias("seed_rank"))
        links = self.edges.where((F.col("resolution") == "resolved") & F.col("kind").isin(*CHANNELS)).select("kind", "source", "target").distinct()
        out = seeds.join(links, F.col("seed") == F.col("source")).select("query_id", "seed", "seed_rank", F.col("target").alias("item"), "kind", F.lit("seed_to_candidate").alias("direction"))
        back = seeds.join(links, F.col("seed") == F.col("target")).select("query_id", "seed", "seed_rank", F.col("source").alias("item"), "kind", F.lit("candidate_to_seed").alias("direction"))
        found = out.unionAll(back).where("item is not null and item <> seed").distinct()
        return found.join(self._allowed().select(F.col("qualified_name").alias("item")), "item", "left_semi")

    def support(self, queries: DataFrame, pool: int) -> DataFrame:
        """(query_id, item, support, rank): units next to seeds, by the sum of 1 / (60 + rank) over distinct seeds."""
        pairs = self.evidence(queries, pool).select("query_id", "item", "seed_rank").distinct()
        total = pairs.groupBy("query_id", "item").agg(F.round(F.sum(1.0 / (RRF_K + F.col("seed_rank"))), 9).alias("support"))
        return total.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("support"), "item")))

    def graph(self, queries: DataFrame, limit: int) -> DataFrame:
        pool = base_pool(limit)
        self._seeds(queries, pool)
        hybrid = self._lists["hybrid", pool]
        return fuse([("hybrid", hybrid), ("structural", self.support(queries, pool))], limit)

    def channels(self, queries: DataFrame, limit: int) -> DataFrame:
        """(query_id, kind, item, support, rank): per relation kind, the ranking of the candidates."""
        pool = rerank_depth(limit)
        candidates = self._kept("graph", pool, lambda: self.graph(queries, pool).select("query_id", "item", "rank", "score"))
        pairs = self.evidence(queries, base_pool(pool)).join(candidates.select("query_id", "item"), ["query_id", "item"], "left_semi")
        pairs = pairs.select("query_id", "kind", "item", "seed_rank").distinct()
        total = pairs.groupBy("query_id", "kind", "item").agg(F.round(F.sum(1.0 / (RRF_K + F.col("seed_rank"))), 9).alias("support"))
        return total.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "kind").orderBy(F.desc("support"), "item")))

    def reranked(self, queries: DataFrame, limit: int) -> DataFrame:
        """(query_id, item, original_rank, rank, rank_delta, score, contributions)."""
        pool = rerank_depth(limit)
        channels = self._kept("channels", pool, lambda: self.channels(queries, limit))
        base = self._lists["graph", pool]
        lists = [("graph_base", base), *[(kind, channels.where(F.col("kind") == kind)) for kind in CHANNELS]]
        fused = fuse(lists).select("query_id", "item", "score", "contributions")
        joined = fused.join(base.select("query_id", "item", F.col("rank").alias("original_rank")), ["query_id", "item"])
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "original_rank", "item"))
        ranked = joined.withColumn("rank", rank).where(F.col("rank") <= limit)
        return ranked.withColumn("rank_delta", F.col("original_rank") - F.col("rank"))
