"""Exact cosine search of a stated query set, norms, fingerprints and vector reuse."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.text import dense_document

#: Rows of a block of queries or vectors; scores held at once.
BLOCK = 65_536
_CELLS = 8_000_000


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _blocked(rows: DataFrame, key: str, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """Rows in the block ``own`` of their group, once for each block ``other``."""
    at = F.pmod(F.xxhash64(key), F.col(f"n_{own}")).cast("int").alias(own)
    return rows.join(sizes, "group").select(*rows.columns, at, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)).alias(other))


def dense_search(queries: DataFrame, vectors: DataFrame, limit: int, block: int = BLOCK) -> DataFrame:
    """(query_id, item, cosine, rank): the ``limit`` vectors of the query's group most similar to it.

    ``queries``: query_id, group, vector; ``vectors``: item, group, vector, all of
    one dimension and not zero.  The queries are a stated set and held against all
    rows: both are cut into blocks of ``block`` rows per group, each pair of blocks
    is one task's and keeps its own best, so only those are shuffled on.  Ties (at
    six decimals) go to the smaller item.
    """
    schema = f"query_id {dict(queries.dtypes)['query_id']}, item {dict(vectors.dtypes)['item']}, cosine double"
    queries = queries.select("query_id", "group", "vector").toDF("query_id", "group", "vector")
    vectors = vectors.select("item", "group", "vector").toDF("item", "group", "vector")

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    sizes = blocks(queries, "n_qb").join(blocks(vectors, "n_vb"), "group")

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or held.empty:
            return pd.DataFrame({"query_id": asked["query_id"][:0], "item": held["item"][:0], "cosine": pd.Series(dtype=float)})
        held = held.sort_values("item")
        items, x, q = held["item"].to_numpy(), _unit(held["vector"]).T, _unit(asked["vector"])
        ids, out, step = asked["query_id"].to_numpy(), [], max(1, _CELLS // len(held))
        for a in range(0, len(ids), step):
            cosine = np.round(q[a : a + step] @ x, 6)
            top = np.argsort(-cosine, axis=1, kind="stable")[:, :limit]
            out.append(pd.DataFrame({"query_id": np.repeat(ids[a : a + step], top.shape[1]), "item": items[top].ravel(), "cosine": np.take_along_axis(cosine, top, 1).ravel()}))
        return pd.concat(out, ignore_index=True)

    cell = ["group", "qb", "vb"]
    asked, held = _blocked(queries, "query_id", "qb", "vb", sizes), _blocked(vectors, "item", "vb", "qb", sizes)
    asked, held = asked.toDF(*asked.columns), held.toDF(*held.columns)  # both may stem from one table
    best = asked.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInPandas(search, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("cosine"), "item"))
    return best.withColumn("rank", rank).where(F.col("rank") <= limit)


def vector_norms(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, dimension, norm, usable): L2 norm and whether the vector can be normalised."""
    squares = F.aggregate(F.transform(column, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    norm = F.round(F.sqrt(squares), 5)
    return vectors.select(key, F.size(column).alias("dimension"), norm.alias("norm"), (norm.isNotNull() & ~F.isnan(norm) & (norm > 0) & (norm < F.lit(float("inf")))).alias("usable"))


def unit_fingerprints(units: DataFrame) -> DataFrame:
    """(qualified_name, fingerprint) of the text that is embedded for each unit."""
    return units.select("qualified_name", F.sha2(dense_document(F.col("qualified_name"), F.col("signature"), F.col("source_text")), 256).alias("fingerprint"))


def corpus_fingerprint(fingerprints: DataFrame) -> DataFrame:
    """One row (n_units, fingerprint) that changes with any unit, whatever the order of the rows.

    The eight 32-bit words of the units' digests are summed, which combines
    map-side, and the sums are hashed.
    """
    row = F.sha2(F.concat_ws(":", F.octet_length("qualified_name").cast("string"), "qualified_name", "fingerprint"), 256)
    words = [F.conv(F.substring(row, 8 * i + 1, 8), 16, 10).cast("decimal(20,0)") for i in range(8)]
    sums = fingerprints.agg(F.count(F.lit(1)).alias("n_units"), *[F.coalesce(F.sum(w), F.lit(0)).alias(f"w{i}") for i, w in enumerate(words)])
    return sums.select("n_units", F.sha2(F.concat_ws(",", *[F.col(f"w{i}").cast("decimal(38,0)").cast("string") for i in range(8)]), 256).alias("fingerprint"))


def reuse_plan(fingerprints: DataFrame, vectors: DataFrame) -> DataFrame:
    """(qualified_name, action): ``reuse`` a vector of the same name and text, else ``embed``; vectors of
    names that are gone are listed as ``drop``.  ``vectors``: qualified_name, doc_fingerprint; null names are ignored."""
    held = vectors.where("qualified_name is not null").groupBy("qualified_name").agg(F.collect_set("doc_fingerprint").alias("held"))
    both = fingerprints.join(held, "qualified_name", "full_outer")
    action = F.when(F.col("fingerprint").isNull(), "drop").when(F.array_contains(F.coalesce("held", F.array().cast("array<string>")), F.col("fingerprint")), "reuse").otherwise("embed")
    return both.select("qualified_name", action.alias("action"))
