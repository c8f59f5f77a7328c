"""Queries of the training-data problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.cleaning import status, trimmed
from codeloom.llm.docpairs import documented_functions
from codeloom.llm.leakage import leaked_items
from codeloom.llm.neighbours import nearest_neighbours, similar_pairs
from codeloom.llm.packing import pack_windows, token_count, window_report
from codeloom.llm.quality import document_statistics, label_documents, not_prose
from codeloom.llm.syntax_check import check_files, error_rates
from codeloom.operators.dense import dense_search
from codeloom.operators.latest import latest_by
from codeloom.sources.tables import table

FLOOR = 0.9


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = check_files(table(spark, sf_dir, "file_contents")).where("has_syntax_errors and file_id is not null")
    return found.select("file_id").distinct()


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of every file, with the failing token."""
    return check_files(table(spark, sf_dir, "file_contents"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_rates(check_files(table(spark, sf_dir, "file_contents")))


def _documented(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = trimmed(F.col("qualified_name")).alias("qualified_name")
    units = table(spark, sf_dir, "code_units").select(name, "path", "source_text", F.col("loaded_at").alias("version"))
    kinds = table(spark, sf_dir, "symbols").select(name, status(F.col("kind")).alias("kind"), F.col("loaded_at").alias("version"))
    return documented_functions(units, kinds)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation is what stands in its place; comments that are only linked by tags and nearness are not."""
    return _documented(spark, sf_dir).where("in_place").select("qualified_name")


def p4_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and description of each function documented in earnest, also by a comment out of place that is linked to it."""
    units = table(spark, sf_dir, "code_units").select(trimmed(F.col("qualified_name")).alias("qualified_name"), "loaded_at", "source_text")
    code = latest_by(units.where("qualified_name is not null"), ["qualified_name"], "loaded_at", ["source_text"])
    return _documented(spark, sf_dir).join(code, "qualified_name").select("qualified_name", F.col("source_text").alias("code"), "description", "in_place")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(nearest_neighbours(table(spark, sf_dir, "reuse_vectors"), floor=FLOOR), FLOOR)


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of each usable vector, with their names."""
    vectors = table(spark, sf_dir, "reuse_vectors")
    names = vectors.where("vec_id is not null").groupBy("vec_id").agg(F.min(trimmed(F.col("qualified_name"))).alias("name"))
    near = nearest_neighbours(vectors)
    near = near.join(names.withColumnRenamed("name", "qualified_name"), "vec_id", "left")
    near = near.join(names.select(F.col("vec_id").alias("neighbour"), F.col("name").alias("neighbour_name")), "neighbour", "left")
    return near.select("vec_id", "qualified_name", "rank", "neighbour", "neighbour_name", F.round("cosine", 6).alias("cosine"))


def _exact_five(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every query id divisible by 100 (query_id, group, vector) and its five nearest among all rows (query_id, item, cosine)."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.where((F.size("vector") == 64) & finite & F.exists("vector", lambda x: x != 0) & F.col("model_id").isNotNull())
    items = usable.select(F.col("vec_id").alias("item"), F.col("model_id").alias("group"), "vector")
    queries = items.where("item % 100 = 0").withColumnRenamed("item", "query_id")
    exact = dense_search(queries, items, 6).where("query_id <> item").withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).where("place <= 5")
    return queries, exact


def p5_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the five nearest that the index finds (with p5_found's setting), for every query id divisible by 100 against all rows."""
    vectors = table(spark, sf_dir, "reuse_vectors")
    queries, exact = _exact_five(vectors)
    near = nearest_neighbours(vectors).select(F.col("vec_id").alias("query_id"), F.col("neighbour").alias("item"), F.lit(1).alias("hit"))
    both = exact.join(near, ["query_id", "item"], "left").join(queries.select("query_id", F.col("group").alias("model_id")), "query_id")
    return both.groupBy("model_id").agg(F.countDistinct("query_id").alias("n_queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def p5_recall_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether :func:`p5_recall` reaches nine tenths."""
    return p5_recall(spark, sf_dir).select("model_id", "n_queries", (F.col("recall") >= 0.9).alias("reached"))


def p5_found_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the pairs above 0.9 of every query id divisible by 100 that p5_found lists, by exact search."""
    queries, exact = _exact_five(table(spark, sf_dir, "reuse_vectors"))
    pairs = exact.where("cosine > 0.9").select("query_id", F.least("query_id", "item").alias("vec_a"), F.greatest("query_id", "item").alias("vec_b"))
    pairs = pairs.join(p5_found(spark, sf_dir).withColumn("hit", F.lit(1)), ["vec_a", "vec_b"], "left").select("query_id", F.coalesce("hit", F.lit(0)).alias("hit"))
    both = queries.select("query_id", F.col("group").alias("model_id")).join(pairs, "query_id", "left")
    return both.groupBy("model_id").agg(F.count("hit").alias("n_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found"), F.round(F.avg("hit"), 6).alias("recall"))


def p7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(token_count(F.col("text")), F.lit(0)).cast("long").alias("tokens"))


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window for each document (or part) and budget."""
    return pack_windows(p7_token_counts(spark, sf_dir), table(spark, sf_dir, "budgets").withColumnRenamed("capacity_tokens", "capacity"))


def p7_window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_report(p7_windows(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items by category with the number of documents that hold each."""
    found = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))
    return found.join(table(spark, sf_dir, "eval_items").select("item_id", "category"), "item_id").select("item_id", "category", "n_documents")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_prose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels"))


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document, in any language."""
    stats = document_statistics(table(spark, sf_dir, "documents"))
    return stats.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in stats.dtypes])


def p9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture's label of every natural-language document."""
    return label_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "doc_labels")).select("doc_id", "label")


QUERIES = {f.__name__: f for f in (p2_found, p2_flags, p2_rates, p4_found, p4_pairs, p5_found, p5_neighbours, p5_recall, p5_recall_floor, p5_found_recall, p7_windows, p7_token_counts, p7_window_report, p8_found, p8_item_report, p9_found, p9_statistics, p9_labels)}
