"""Phrase BM25 for a batch of queries.

A query is split at white space into chunks, each a phrase of tokens that must
follow one another within one column.  Grams of the phrase lengths that occur are
matched by an equi-join, so no positions are compared and no document meets a
query that shares nothing with it.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.text import search_tokens
from codeloom.sources.workspace import Workspace

K1, B = 1.2, 0.75
_BREAK = "\u0001"


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, chunk, phrase, length) of (query_id, text); chunks without tokens are left out."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    chunks = queries.select("query_id", F.posexplode(F.split(text, " ")).alias("chunk", "part"))
    tokens = search_tokens(F.regexp_replace("part", r'^"(.*)"$', "$1"))
    return chunks.select("query_id", "chunk", tokens.alias("t")).where(F.size("t") > 0).select("query_id", "chunk", F.array_join("t", " ").alias("phrase"), F.size("t").alias("length"))


def tokenized(docs: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, tokens, dl): tokens of all columns with a break between columns; dl counts tokens only."""
    parts = [search_tokens(F.col(c)) for c in columns]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.array(F.lit(_BREAK)), p)
    return docs.select(key, joined.alias("tokens")).withColumn("dl", F.size("tokens") - (len(columns) - 1))


def _grams(n: int):
    """All runs of ``n`` tokens; empty where there are fewer."""
    grams = F.col("tokens")
    for k in range(2, n + 1):
        after = F.slice("tokens", F.lit(k), F.greatest(F.size("tokens") - (k - 1), F.lit(0)))
        grams = F.zip_with(F.slice(grams, F.lit(1), F.greatest(F.size("tokens") - (k - 1), F.lit(0))), after, lambda x, y: F.concat(x, F.lit(" "), y))
    return grams


def phrase_hits(tokens: DataFrame, key: str, phrases: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """(key, phrase, tf, dl) of the documents that hold a phrase."""
    grams = tokens.select(key, "dl", F.explode(F.concat(*[_grams(n) for n in lengths])).alias("phrase"))
    hits = grams.join(phrases.select("phrase").distinct(), "phrase")
    return hits.groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def lexical_search(queries: DataFrame, docs: DataFrame, key: str, columns: Sequence[str], limit: int, keep: DataFrame | None = None) -> DataFrame:
    """(query_id, key, score, rank): the ``limit`` best documents of each query, ties by key.

    Statistics cover all documents; ``keep`` (key) only filters what is returned.
    Repeated chunks of a query count again.  Empty queries and phrases without
    hits give no rows.
    """
    phrases = query_phrases(queries)
    lengths = [r["length"] for r in phrases.select("length").distinct().orderBy("length").collect()]  # a handful
    if not lengths:
        return queries.limit(0).select("query_id", F.lit("").alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    tokens = Workspace(queries.sparkSession, "lexical").write(tokenized(docs, key, columns), "tokens")
    whole = tokens.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_dl"))
    hits = phrase_hits(tokens, key, phrases, lengths)
    frequency = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = frequency.join(F.broadcast(whole)).select("phrase", "avg_dl", F.when(idf > 0, idf).otherwise(F.lit(1e-6)).alias("idf"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = hits.join(weights, "phrase").select(key, "phrase", (F.col("idf") * tf).alias("part"))
    if keep is not None:
        scored = scored.join(keep.select(key), key, "left_semi")
    scores = phrases.select("query_id", "phrase").join(scored, "phrase").groupBy("query_id", key).agg(F.round(F.sum("part"), 6).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank).where(F.col("rank") <= limit)


def token_statistics(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(token, df, cf): documents and occurrences of each token."""
    tokens = docs.select(key, F.explode(search_tokens(F.col(column))).alias("token"))
    per_doc = tokens.groupBy("token", key).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("cf"))


def with_path_prefix(docs: DataFrame, prefix: str, ignore_case: bool) -> DataFrame:
    """Documents whose path starts with ``prefix`` (wildcards are literal); null paths never do.  Case is that of ASCII."""
    prefix = prefix.replace("\\", "/")
    if ignore_case:
        lower = prefix.translate({ord(c): c.lower() for c in ascii_uppercase})
        return docs.where(F.translate("path", ascii_uppercase, ascii_uppercase.lower()).startswith(lower))
    return docs.where(F.col("path").startswith(prefix))
