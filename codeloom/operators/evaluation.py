"""Ranking quality of several modes against gold items."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP = 10


def first_relevant(queries: DataFrame, ranked: DataFrame, gold: DataFrame, modes: tuple[str, ...]) -> DataFrame:
    """(query_id, category, mode, rank): the best rank of a gold item within the top ten, null if none.

    ``queries``: query_id, category; ``ranked``: query_id, mode, item, rank; ``gold``: query_id, item.
    """
    every = queries.select("query_id", "category", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    hits = ranked.where(F.col("rank") <= TOP).join(gold, ["query_id", "item"]).groupBy("query_id", "mode").agg(F.min("rank").alias("rank"))
    return every.join(hits, ["query_id", "mode"], "left").select("query_id", "category", "mode", "rank")


def repeated_items(ranked: DataFrame) -> DataFrame:
    """(query_id, mode, item, n) of ranked lists that hold an item more than once, which no mode may."""
    return ranked.groupBy("query_id", "mode", "item").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def metrics(ranks: DataFrame) -> DataFrame:
    """(category, mode, n_queries, hit_1, hit_5, hit_10, mrr_10) per category and over all (category ``all``)."""

    def hit(k: int):
        return F.round(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), 6).alias(f"hit_{k}")

    levels = ranks.select(F.explode(F.array(F.lit("all"), F.coalesce("category", F.lit("none")))).alias("category"), "mode", "rank")
    return levels.groupBy("category", "mode").agg(F.count(F.lit(1)).alias("n_queries"), hit(1), hit(5), hit(10), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr_10"))


def pairwise(ranks: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(mode_a, mode_b, wins, ties, losses) of a over b; no rank is worse than any, both without tie."""
    spark = ranks.sparkSession
    wanted = spark.createDataFrame(pairs, "mode_a string, mode_b string")
    a = ranks.select("query_id", F.col("mode").alias("mode_a"), F.coalesce("rank", F.lit(1 << 30)).alias("a"))
    b = ranks.select("query_id", F.col("mode").alias("mode_b"), F.coalesce("rank", F.lit(1 << 30)).alias("b"))
    both = a.join(F.broadcast(wanted), "mode_a").join(b, ["query_id", "mode_b"])
    return both.groupBy("mode_a", "mode_b").agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") == F.col("b")).alias("ties"), F.count_if(F.col("a") > F.col("b")).alias("losses"))


def missing_gold(gold: DataFrame, units: DataFrame) -> DataFrame:
    """Gold items that are not indexed."""
    return gold.join(units.select(F.col("qualified_name").alias("item")), "item", "left_anti").select("query_id", "item")


CATEGORIES = ("lexical", "behavioral", "calls", "inheritance")


#: What a complete benchmark holds.
COMPLETE = {"language": "python", "n_queries": 24, "per_category": 6, "n_showcases": 2}


def load_benchmark(spark: SparkSession, path: str, complete: bool = False) -> DataFrame:
    """(query_id, category, text, gold, showcase) of a benchmark file, one row per gold item.

    The file is one JSON object with version 1 and queries of unique ids, known
    categories, text that is not blank, and at least one gold item, none twice.
    ``complete`` also asks for the language, the number of queries of each category
    and the number of showcases in :data:`COMPLETE`.
    """
    raw = spark.read.option("multiLine", "true").json(path)
    if raw.select("benchmark_version").collect() != [(1,)]:
        raise ValueError("only benchmark version 1 can be read")
    queries = raw.select(F.explode("queries").alias("q")).select(F.col("q.id").alias("query_id"), F.col("q.category").alias("category"), F.col("q.query").alias("text"), F.col("q.relevant_qnames").alias("gold"), F.coalesce("q.showcase", F.lit(False)).alias("showcase"))
    blank = (F.col("query_id").isNull()) | (F.trim(F.coalesce("text", F.lit(""))) == "") | ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False))
    no_gold = F.coalesce(F.size("gold"), F.lit(0)) < 1
    twice = F.size(F.array_distinct("gold")) != F.size("gold")
    wrong = queries.agg(F.count_if(blank | no_gold | twice).alias("bad"), (F.count(F.lit(1)) - F.countDistinct("query_id")).alias("repeated")).first()
    if wrong["bad"] or wrong["repeated"]:
        raise ValueError(f"{wrong['bad']} queries are incomplete, {wrong['repeated']} ids are repeated")
    if complete:
        shown = queries.agg(F.count(F.lit(1)).alias("n"), F.count_if("showcase").alias("shown")).first()
        per = {r["category"]: r["count"] for r in queries.groupBy("category").count().collect()}
        language = raw.select("language").first()[0]
        if language != COMPLETE["language"] or shown["n"] != COMPLETE["n_queries"] or shown["shown"] != COMPLETE["n_showcases"] or per != dict.fromkeys(CATEGORIES, COMPLETE["per_category"]):
            raise ValueError(f"not a complete benchmark: {language}, {shown['n']} queries {per}, {shown['shown']} showcases")
    return queries.withColumn("gold", F.explode("gold"))


def json_report(metrics_rows: DataFrame, ranks: DataFrame, showcases: DataFrame) -> str:
    """Metrics to four decimals, ranks (null for none) and what the modes listed for the showcases (query_id, mode,
    item, rank), in a fixed order, as one JSON object."""
    rounded = [F.format_number(c, 4).alias(c) for c in ("hit_1", "hit_5", "hit_10", "mrr_10")]

    def rows(df: DataFrame, *order: str) -> list[dict]:
        return [r.asDict() for r in df.orderBy(*order).toLocalIterator()]

    parts = {
        "metrics": rows(metrics_rows.select("category", "mode", "n_queries", *rounded), "category", "mode"),
        "ranks": rows(ranks.select("query_id", "category", "mode", "rank"), "query_id", "mode"),
        "showcases": rows(showcases.select("query_id", "mode", "rank", "item"), "query_id", "mode", "rank"),
    }
    return json.dumps(parts, ensure_ascii=False, indent=1, sort_keys=True) + "\n"


def markdown_report(metrics_rows: DataFrame, ranks: DataFrame) -> str:
    """Metrics per category and mode, and the ranks per query (a dash for none), as Markdown."""
    lines = ["| category | mode | queries | Hit@1 | Hit@5 | Hit@10 | MRR@10 |", "|---|---|---:|---:|---:|---:|---:|"]
    for r in metrics_rows.orderBy("category", "mode").toLocalIterator():
        lines.append(f"| {r['category']} | {r['mode']} | {r['n_queries']} | {r['hit_1']:.4f} | {r['hit_5']:.4f} | {r['hit_10']:.4f} | {r['mrr_10']:.4f} |")
    lines += ["", "| query | mode | rank |", "|---|---|---:|"]
    for r in ranks.orderBy("query_id", "mode").toLocalIterator():
        lines.append(f"| {r['query_id']} | {r['mode']} | {'—' if r['rank'] is None else r['rank']} |")
    return "\n".join(lines) + "\n"
