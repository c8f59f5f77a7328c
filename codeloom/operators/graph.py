"""Directed, labelled multigraph of symbols: edges (kind, source, target, resolution) and nodes (name)."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.sources.workspace import Workspace

KINDS = ("contains", "imports", "references", "calls", "inherits")
STATUSES = ("resolved", "probable", "unresolved")
FOLLOWED = ("resolved", "probable")


def followable(edges: DataFrame, nodes: DataFrame, statuses: tuple[str, ...] = FOLLOWED) -> DataFrame:
    """Edges of the given statuses whose source and target are nodes."""
    kept = edges.where(F.col("resolution").isin(*statuses) & F.col("target").isNotNull() & F.col("source").isNotNull())
    names = nodes.select("name")
    return kept.join(names, F.col("target") == F.col("name"), "left_semi").join(names, F.col("source") == F.col("name"), "left_semi")


def related(edges: DataFrame, names: DataFrame, direction: str = "outgoing", kinds: Collection[str] | None = None, statuses: Collection[str] | None = None) -> DataFrame:
    """Edges that leave (``outgoing``, dangling ones too) or reach (``incoming``) the nodes of ``names`` (name).

    None lets every kind or status through, an empty collection none.
    """
    for column, wanted in (("kind", kinds), ("resolution", statuses)):
        if wanted is not None:
            edges = edges.where(F.col(column).isin(*wanted)) if wanted else edges.limit(0)
    end = {"outgoing": "source", "incoming": "target"}[direction]
    return edges.join(names.select(F.col("name").alias(end)).distinct(), end, "left_semi")


def summary(edges: DataFrame) -> DataFrame:
    """(kind, resolution, n_edges) for all kinds and statuses, zeros too."""
    spark = edges.sparkSession
    every = spark.createDataFrame([(k, s) for k in KINDS for s in STATUSES], "kind string, resolution string")
    counts = edges.groupBy("kind", "resolution").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, ["kind", "resolution"], "left").select("kind", "resolution", F.coalesce("n", F.lit(0)).alias("n_edges"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, n_out, n_in): all outgoing edges, incoming ones only if followable."""
    out = edges.groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n_out"))
    incoming = followable(edges, nodes).groupBy(F.col("target").alias("name")).agg(F.count(F.lit(1)).alias("n_in"))
    return nodes.select("name").join(out, "name", "left").join(incoming, "name", "left").select("name", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "both") -> DataFrame:
    """(name, neighbour): distinct ends of followable edges; a self-loop yields the node itself."""
    kept = followable(edges, nodes)
    forward = kept.select(F.col("source").alias("name"), F.col("target").alias("neighbour"))
    backward = kept.select(F.col("target").alias("name"), F.col("source").alias("neighbour"))
    return {"outgoing": forward, "incoming": backward, "both": forward.unionAll(backward)}[direction].distinct()


def reach(seeds: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """(seed, name, distance): nodes within ``max_depth`` links (name, neighbour) of each seed, seeds at 0.

    Breadth first: a level is joined with the links, what was seen before is
    dropped, and each level is written, so lineage stays short and cycles end.
    """
    work = Workspace(seeds.sparkSession, "reach")
    links = work.write(links.select("name", "neighbour"), "links")
    level = seeds.select("seed", F.col("seed").alias("name"), F.lit(0).alias("distance")).distinct()
    seen = work.append(level, "seen", 0)
    for depth in range(1, max_depth + 1):
        frontier = seen.where(F.col("distance") == depth - 1)
        found = frontier.join(links, "name").select("seed", F.col("neighbour").alias("name")).distinct()
        found = found.join(seen.select("seed", "name"), ["seed", "name"], "left_anti")
        seen = work.append(found.select("seed", "name", F.lit(depth).alias("distance")), "seen", depth)
        if seen.where(F.col("distance") == depth).isEmpty():
            break
    return seen


def shortest_distances(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, max_depth: int) -> DataFrame:
    """(source, target, distance): fewest outgoing hops over followable edges; 0 from a node to itself, null if
    unreachable within ``max_depth``.  ``pairs``: source, target; pairs with an unknown node are left out."""
    names = nodes.select("name")
    known = pairs.select("source", "target").distinct().join(names, F.col("source") == F.col("name"), "left_semi").join(names, F.col("target") == F.col("name"), "left_semi")
    seen = reach(known.select(F.col("source").alias("seed")).distinct(), neighbours(edges, nodes, "outgoing"), max_depth)
    return known.join(seen.select(F.col("seed").alias("source"), F.col("name").alias("target"), "distance"), ["source", "target"], "left")


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Edges without repeats of all eight identifying columns."""
    return edges.dropDuplicates(["kind", "source", "target", "target_text", "resolution", "path", "start_byte", "end_byte"])


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(target, n_edges): targets of resolved or probable edges that are no nodes."""
    kept = edges.where(F.col("resolution").isin(*FOLLOWED) & F.col("target").isNotNull())
    lost = kept.join(nodes.select(F.col("name").alias("target")), "target", "left_anti")
    return lost.groupBy("target").agg(F.count(F.lit(1)).alias("n_edges"))
