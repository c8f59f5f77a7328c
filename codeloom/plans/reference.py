"""Queries of the retrieval engine's own operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.cleaning import hex_digest, relative_path, status, trimmed
from codeloom.functions.text import code_tokens, preview
from codeloom.operators import context, dense, evaluation, graph, incremental, lexical, resolve
from codeloom.operators.extract_cpp import cpp_facts, resolve_cpp
from codeloom.operators.extract_cpp import cpp_symbols as extract_cpp
from codeloom.operators.extract_python import python_facts, resolve_python
from codeloom.operators.extract_python import python_symbols as extract_python
from codeloom.operators.fusion import fuse
from codeloom.operators.latest import latest_by
from codeloom.operators.retrieval import COLUMNS, Corpus
from codeloom.plans.views import edges_now, search_queries, search_units, symbols_now, unit_vectors, units_now
from codeloom.sources.repository import CPP_FILES
from codeloom.sources.tables import table

MODES = ("lexical", "dense", "hybrid", "graph", "reranked")
LIMIT = 10
BUDGET = 2048


def _corpus(spark: SparkSession, d: str, **filters: str) -> tuple[Corpus, DataFrame]:
    corpus = Corpus(search_units(spark, d), unit_vectors(spark, d), edges_now(spark, d), **filters)
    corpus.units = corpus.work.write(corpus.units, "units")
    return corpus, corpus.work.write(search_queries(spark, d), "queries")


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return symbols_now(spark, d).select(F.col("qualified_name").alias("name"))


def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.lexical_search(search_queries(spark, d), search_units(spark, d), "qualified_name", COLUMNS, LIMIT)
    return hits.select("query_id", "qualified_name", "score", "rank")


def lexical_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same names searched in the texts of documents."""
    hits = lexical.lexical_search(search_queries(spark, d), table(spark, d, "documents"), "doc_id", ["text"], LIMIT)
    return hits.select("query_id", "doc_id", "score", "rank")


def lexical_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Statistics over all units, results only methods under src (ASCII case ignored)."""
    units = search_units(spark, d)
    keep = lexical.with_path_prefix(units.where("kind = 'method'"), "SRC/", ignore_case=True)
    return lexical.lexical_search(search_queries(spark, d), units, "qualified_name", COLUMNS, LIMIT, keep=keep).select("query_id", "qualified_name", "score", "rank")


def all_token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Document and collection frequency of every token."""
    return lexical.token_statistics(table(spark, d, "documents"), "doc_id", "text")


def token_statistics(spark: SparkSession, d: str) -> DataFrame:
    """The 50 most frequent tokens; :func:`all_token_statistics` has them all."""
    stats = lexical.token_statistics(table(spark, d, "documents"), "doc_id", "text")
    return stats.orderBy(F.desc("cf"), "token").limit(50)


def path_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    """Units under a prefix per kind, with and without regard to case."""
    units = units_now(spark, d)
    strict = lexical.with_path_prefix(units, "src/", False).select("kind", F.lit("strict").alias("rule"))
    loose = lexical.with_path_prefix(units, "SRC/", True).select("kind", F.lit("loose").alias("rule"))
    return strict.unionAll(loose).groupBy("kind", "rule").agg(F.count(F.lit(1)).alias("n_units"))


def dense_search(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.lit("all").alias("group"), F.col("embedding").alias("vector"))
    queries = vectors.where("item % 100 = 0").withColumnRenamed("item", "query_id")
    return dense.dense_search(queries, vectors, LIMIT).select("query_id", F.col("item").alias("vec_id"), "cosine", "rank")


def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Only vectors of the query's label compete."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("label").alias("group"), F.col("embedding").alias("vector"))
    queries = vectors.where("item % 100 = 0").withColumnRenamed("item", "query_id")
    return dense.dense_search(queries, vectors, LIMIT).select("query_id", F.col("item").alias("vec_id"), "cosine", "rank")


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    return dense.vector_norms(table(spark, d, "embeddings"), "vec_id", "embedding")


def unit_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return dense.unit_fingerprints(units_now(spark, d))


def corpus_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return dense.corpus_fingerprint(dense.unit_fingerprints(units_now(spark, d)))


def vector_reuse(spark: SparkSession, d: str) -> DataFrame:
    held = table(spark, d, "reuse_vectors").select(trimmed(F.col("qualified_name")).alias("qualified_name"), F.lower("doc_fingerprint").alias("doc_fingerprint"))
    return dense.reuse_plan(dense.unit_fingerprints(units_now(spark, d)), held)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Orders ranked by price and by size of each customer, fused."""
    orders = table(spark, d, "orders").join(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity")), "o_orderkey")
    rows = orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), "o_totalprice", "quantity")
    by_price = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("o_totalprice"), "item")))
    by_size = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("quantity"), "item")))
    return fuse([("price", by_price), ("size", by_size)], 3).select("query_id", "item", F.round("score", 6).alias("score"), "rank")


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    return corpus.hybrid(queries, LIMIT).select("query_id", "item", "score", "rank")


def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Functions under src only: both lists are filtered before they are cut."""
    corpus, queries = _corpus(spark, d, kind="function", path_prefix="src/")
    return corpus.hybrid(queries, LIMIT).select("query_id", "item", "score", "rank")


def graph_filtered(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d, kind="method", path_prefix="src/")
    return corpus.graph(queries, LIMIT).select("query_id", "item", "score", "rank")


def graph_search(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    return corpus.graph(queries, LIMIT).select("query_id", "item", "score", "rank")


def graph_support(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    return corpus.support(queries, LIMIT).select("query_id", "item", "support", "rank")


def relation_evidence(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    return corpus.evidence(queries, LIMIT)


def channel_rankings(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    return corpus.channels(queries, LIMIT)


def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    return corpus.reranked(queries, LIMIT).select("query_id", "item", "score", "original_rank", "rank", "rank_delta")


def rerank_contributions(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    ranked = corpus.reranked(queries, LIMIT).select("query_id", "item", F.explode("contributions").alias("c"))
    return ranked.select("query_id", "item", "c.source", "c.list_rank", F.round("c.part", 9).alias("part"))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    ranked = corpus.reranked(queries, context.CANDIDATES).select("query_id", "item", "rank")
    units = corpus.units.withColumnRenamed("qualified_name", "item")
    text = context.block_text(*[F.col(c) for c in ("item", "kind", "path", "start_line", "end_line", "source_text")])
    candidates = ranked.join(units, "item").select("query_id", "item", "rank", "path", "start_byte", "end_byte", text.alias("text"))
    return context.pack_context(candidates, BUDGET)


def span_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    return context.span_overlaps(units_now(spark, d))


def unit_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return units_now(spark, d).select("qualified_name", code_tokens(F.col("source_text")).alias("tokens"))


def unit_previews(spark: SparkSession, d: str) -> DataFrame:
    return units_now(spark, d).select("qualified_name", preview(F.col("source_text")).alias("preview"))


def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    return graph.summary(edges_now(spark, d))


def graph_degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges_now(spark, d), _nodes(spark, d))


def graph_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(edges_now(spark, d), _nodes(spark, d))


def graph_reach(spark: SparkSession, d: str) -> DataFrame:
    """Everything within three outgoing hops of the query set's symbols."""
    nodes = _nodes(spark, d)
    seeds = search_queries(spark, d).select(F.col("gold").alias("name")).distinct().join(nodes, "name", "left_semi").withColumnRenamed("name", "seed")
    return graph.reach(seeds, graph.neighbours(edges_now(spark, d), nodes, "outgoing"), 3)


def graph_related(spark: SparkSession, d: str) -> DataFrame:
    """Calls and base classes of the query set's symbols, and what is resolved to them."""
    edges = edges_now(spark, d)
    golds = search_queries(spark, d).select(F.col("gold").alias("name"))
    out = graph.related(edges, golds, "outgoing", kinds=("calls", "inherits")).withColumn("target", F.coalesce("target", "target_text"))
    into = graph.related(edges, golds, "incoming", statuses=("resolved",))
    columns = ["relation_id", "kind", "source", "target", "resolution"]
    return out.select(F.lit("outgoing").alias("direction"), *columns).unionAll(into.select(F.lit("incoming").alias("direction"), *columns))


def graph_shortest_distance(spark: SparkSession, d: str) -> DataFrame:
    """Outgoing hops, up to four, from the parent's parent of each symbol of the query set to the symbol."""
    symbols = symbols_now(spark, d)
    up = symbols.select(F.col("qualified_name").alias("parent"), F.col("parent").alias("source"))
    pairs = search_queries(spark, d).select(F.col("gold").alias("qualified_name")).distinct().join(symbols, "qualified_name").join(up, "parent").select("source", F.col("qualified_name").alias("target"))
    return graph.shortest_distances(pairs, edges_now(spark, d), _nodes(spark, d), 4)


def graph_distance_to_module(spark: SparkSession, d: str) -> DataFrame:
    """Fewest incoming hops from each symbol of the query set to a module, up to six."""
    symbols = symbols_now(spark, d)
    nodes = symbols.select(F.col("qualified_name").alias("name"))
    seeds = search_queries(spark, d).select(F.col("gold").alias("name")).distinct().join(nodes, "name", "left_semi").withColumnRenamed("name", "seed")
    seen = graph.reach(seeds, graph.neighbours(edges_now(spark, d), nodes, "incoming"), 6)
    modules = symbols.where("kind = 'module'").select(F.col("qualified_name").alias("name"))
    return seen.join(modules, "name", "left_semi").groupBy("seed").agg(F.min("distance").alias("distance"))


def graph_canonical_edges(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges with their canonical position among the edges of their source."""
    edges = graph.canonical_edges(edges_now(spark, d)).where("source is not null")
    order = ["kind", "target_text", F.coalesce("target", F.lit("")), "path", F.coalesce("start_byte", F.lit(-1)), F.coalesce("end_byte", F.lit(-1)), "resolution"]
    position = F.row_number().over(W.partitionBy("source").orderBy(*order))
    return edges.select("source", "kind", "target", "target_text", "resolution", position.alias("position"))


def graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(edges_now(spark, d), _nodes(spark, d))


def contains_edges(spark: SparkSession, d: str) -> DataFrame:
    return resolve.contains_edges(symbols_now(spark, d))


def duplicate_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Names of symbols that several readings place in different files or lines."""
    rows = table(spark, d, "symbols").select(trimmed(F.col("qualified_name")).alias("qualified_name"), F.concat_ws(":", trimmed(F.col("path")), F.col("start_line").cast("string")).alias("path"))
    return resolve.duplicate_names(rows.where("qualified_name is not null"))


def resolve_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = edges_now(spark, d).select(F.col("relation_id").alias("fact_id"), "source", "target_text")
    return resolve.resolve_facts(facts, symbols_now(spark, d))


def unique_stems(spark: SparkSession, d: str) -> DataFrame:
    return resolve.unique_stems(symbols_now(spark, d))


def scope_walk(spark: SparkSession, d: str) -> DataFrame:
    facts = edges_now(spark, d).where("kind <> 'contains' and source is not null and target_text is not null")
    return resolve.scope_walk(facts.select(F.col("relation_id").alias("fact_id"), "source", "target_text"), symbols_now(spark, d))


def returnable_units(spark: SparkSession, d: str) -> DataFrame:
    return units_now(spark, d).select("qualified_name", "name", "kind", "path", "signature", F.sha2("source_text", 256).alias("source_sha256"), "start_line", "end_line")


def per_file_view(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and units of each file, as counts and a digest of the names that combines map-side in any order."""
    word = F.conv(F.substring(F.sha2("qualified_name", 256), 1, 13), 16, 10).cast("decimal(20,0)")
    symbols = symbols_now(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"), F.sum(word).cast("string").alias("names_digest"))
    units = units_now(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("n_units"))
    return symbols.join(units, "path", "left").select("path", "n_symbols", "names_digest", F.coalesce("n_units", F.lit(0)).alias("n_units"))


def table_counts(spark: SparkSession, d: str) -> DataFrame:
    names = ("files", "file_contents", "symbols", "code_units", "relations")
    out = None
    for n in names:
        part = table(spark, d, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        out = part if out is None else out.unionAll(part)
    return out


def _listing(spark: SparkSession, d: str, back: int) -> DataFrame:
    """(repo, path, digest, language_id): the repository's last complete delivery but ``back``."""
    deliveries = table(spark, d, "deliveries").where(status(F.col("status")) == "complete").select("repo", "snapshot_id").distinct()
    nth = F.row_number().over(W.partitionBy("repo").orderBy(F.desc("snapshot_id")))
    chosen = deliveries.withColumn("n", nth).where(F.col("n") == back + 1).select("repo", "snapshot_id")
    rows = table(spark, d, "files").join(chosen, ["repo", "snapshot_id"])
    rows = rows.select("repo", relative_path(F.col("path")).alias("path"), hex_digest(F.col("content_sha256")).alias("digest"), status(F.col("language_id")).alias("language_id"), "loaded_at")
    return latest_by(rows.where("path is not null"), ["repo", "path"], "loaded_at", ["digest", "language_id"])


def change_set(spark: SparkSession, d: str) -> DataFrame:
    """The last complete delivery of each repository against the one before."""
    return incremental.change_set(_listing(spark, d, 1), _listing(spark, d, 0), ["repo", "path"], "digest")


def work_counts(spark: SparkSession, d: str) -> DataFrame:
    return incremental.work_counts(change_set(spark, d), ["repo"])


def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    """The older listing brought up to date from touched files only; it equals the newer one."""
    old, new = _listing(spark, d, 1), _listing(spark, d, 0)
    key = F.concat_ws(" ", "repo", "path")
    changes = incremental.change_set(old, new, ["repo", "path"], "digest").where("change <> 'unchanged'").select(key.alias("file"))
    fresh = new.withColumn("file", key).join(changes, "file", "left_semi")
    return incremental.merge(old.withColumn("file", key), fresh, changes, "file").select("repo", "path", "digest")


def surface_changes(spark: SparkSession, d: str) -> DataFrame:
    """Symbols known before 2024-10 against all that are known now."""
    rows = table(spark, d, "symbols").select(
        trimmed(F.col("qualified_name")).alias("qualified_name"), trimmed(F.col("name")).alias("name"), status(F.col("kind")).alias("kind"), trimmed(F.col("parent_qualified_name")).alias("parent"), "loaded_at"
    ).where("qualified_name is not null")
    values = ["name", "kind", "parent"]
    old = latest_by(rows.where("loaded_at < timestamp_ntz'2024-10-01 00:00:00'"), ["qualified_name"], "loaded_at", values)
    return incremental.surface_changes(old, latest_by(rows, ["qualified_name"], "loaded_at", values))


def language_mix(spark: SparkSession, d: str) -> DataFrame:
    """Languages per repository; an index of one language must refuse repositories with several."""
    rows = _listing(spark, d, 0).groupBy("repo").agg(F.count_distinct("language_id").alias("n_languages"), F.count(F.lit(1)).alias("n_files"))
    return rows.select("repo", "n_languages", "n_files", (F.col("n_languages") > 1).alias("mixed"))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    corpus, queries = _corpus(spark, d)
    # The deepest first: the lexical and the dense list are then made once and cut by rank.
    lists = {mode: getattr(corpus, mode)(queries, LIMIT) for mode in reversed(MODES)}
    ranked = None
    for mode, df in lists.items():
        part = df.select("query_id", F.lit(mode).alias("mode"), "item", "rank")
        ranked = part if ranked is None else ranked.unionAll(part)
    gold = queries.select("query_id", F.col("gold").alias("item"))
    return evaluation.first_relevant(queries.select("query_id", F.col("model_id").alias("category")), ranked, gold, MODES)


def first_relevant_ranks(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).withColumn("rank", F.col("rank").cast("double"))


def ranking_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_ranks(spark, d))


def ranking_pairs(spark: SparkSession, d: str) -> DataFrame:
    ranks = _ranks(spark, d)
    kept = ranks.select("query_id", "category", "mode", "rank")
    return evaluation.pairwise(kept, [("graph", "hybrid"), ("reranked", "graph")])


def gold_missing(spark: SparkSession, d: str) -> DataFrame:
    gold = search_queries(spark, d).select("query_id", F.col("gold").alias("item"))
    return evaluation.missing_gold(gold, units_now(spark, d))


def _texts(spark: SparkSession, d: str, *extensions: str) -> DataFrame:
    files = table(spark, d, "file_contents").select(relative_path(F.col("path")).alias("path"), F.regexp_replace("content", "^\ufeff", "").alias("content"))
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))


def python_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract_python(_texts(spark, d, "py")).drop("source_text")


def python_relations(spark: SparkSession, d: str) -> DataFrame:
    """Imports, calls, uses and base classes of the checked-out files, resolved against their symbols."""
    files = _texts(spark, d, "py")
    return resolve_python(python_facts(files), extract_python(files))


def cpp_symbols(spark: SparkSession, d: str) -> DataFrame:
    return extract_cpp(_texts(spark, d, *CPP_FILES))


def cpp_relations(spark: SparkSession, d: str) -> DataFrame:
    """Includes, base classes and calls of the checked-out files, resolved against their symbols."""
    files = _texts(spark, d, *CPP_FILES)
    return resolve_cpp(cpp_facts(files), extract_cpp(files))


_ALL = (
    lexical_search, lexical_documents, lexical_filtered, all_token_statistics, token_statistics, path_prefix_counts, dense_search, dense_filtered, vector_norms, unit_fingerprints, corpus_fingerprint, vector_reuse,
    rrf_fusion, hybrid_search, hybrid_filtered, graph_search, graph_filtered, graph_support, relation_evidence, channel_rankings, reranked_search, rerank_contributions, context_pack, span_overlap_pairs, unit_token_counts,
    unit_previews, graph_summary, graph_degrees, graph_neighbours, graph_reach, graph_related, graph_shortest_distance, graph_distance_to_module, graph_canonical_edges, graph_dangling, contains_edges, duplicate_symbols, resolve_facts,
    unique_stems, scope_walk, returnable_units, per_file_view, table_counts, change_set, work_counts, incremental_merge, surface_changes, language_mix, first_relevant_ranks, ranking_metrics,
    ranking_pairs, gold_missing, python_symbols, python_relations, cpp_symbols, cpp_relations,
)
QUERIES = {f.__name__: f for f in _ALL}
