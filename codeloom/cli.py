"""Command line: index a repository, search it, look at its graph, compile a context.

    python -m codeloom.cli index PATH --index DIR [--full] [--language python|cpp]
    python -m codeloom.cli inspect FILE
    python -m codeloom.cli embed DIR
    python -m codeloom.cli search DIR QUERY [--mode lexical|dense|hybrid|graph|reranked] [--limit N] [--kind KIND] [--path-prefix PREFIX] [--explain]
    python -m codeloom.cli graph DIR [SYMBOL]
    python -m codeloom.cli context DIR QUERY --budget N [--kind KIND] [--path-prefix PREFIX]
    python -m codeloom.cli benchmark DIR FILE [--json] [--complete]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import preview
from codeloom.operators import context, evaluation, graph
from codeloom.operators.embedding import HashedWords, embed_units
from codeloom.operators.extract_cpp import cpp_symbols
from codeloom.operators.extract_python import python_symbols
from codeloom.operators.retrieval import Corpus
from codeloom.plans.indexing import index_repository
from codeloom.session import local_session
from codeloom.sources.repository import CPP_FILES, PYTHON_FILES, scan_repository
from codeloom.sources.store import IndexStore


PROVIDER = HashedWords()


def corpus_of(spark: SparkSession, index: str, **filters: str | None) -> Corpus:
    """The corpus of an index; before ``embed`` the dense list is empty and the ladder still works."""
    store = IndexStore(spark, index)
    symbols = store.read("symbols")
    units = store.read("code_units").join(symbols.select("qualified_name", "name", "signature"), "qualified_name")
    units = units.join(symbols.where("kind = 'module'").select("path", F.col("qualified_name").alias("module_name")), "path", "left")
    vectors = store.read_vectors()
    return Corpus(units, vectors, store.read("relations"), **filters)


def search(corpus: Corpus, texts: list[tuple[int, str]], mode: str, limit: int, explain: bool = False) -> DataFrame:
    """(query_id, item, rank, score) and, to explain modes that fuse lists, what each list contributed."""
    spark = corpus.units.sparkSession
    rows = [(i, t, PROVIDER.model_id, PROVIDER.embed_query(t).tolist()) for i, t in texts]
    queries = spark.createDataFrame(rows, "query_id long, text string, model_id string, vector array<float>")
    hits = getattr(corpus, mode)(queries, limit)
    return hits.select("query_id", "item", "rank", "score", *(["contributions"] if explain and "contributions" in hits.columns else []))


def embed(spark: SparkSession, index: str) -> int:
    """Embed what has no vector yet; returns the number of vectors."""
    store = IndexStore(spark, index)
    corpus = corpus_of(spark, index)
    store.write_vectors(embed_units(corpus.units, PROVIDER, corpus.vectors))
    return store.read_vectors().count()


def benchmark(spark: SparkSession, index: str, path: str, as_json: bool = False, complete: bool = False) -> str:
    """Ranks and metrics of all modes over a benchmark file, as Markdown or JSON."""
    corpus = corpus_of(spark, index)
    rows = evaluation.load_benchmark(spark, path, complete)
    names = {r["query_id"]: i for i, r in enumerate(rows.select("query_id").distinct().orderBy("query_id").collect())}
    ids = spark.createDataFrame(list(names.items()), "name string, query_id long")
    rows = rows.withColumnRenamed("query_id", "name").join(ids, "name")
    gold = rows.select("query_id", F.col("gold").alias("item"))
    lost = evaluation.missing_gold(gold, corpus.units).limit(1).collect()
    if lost:
        raise ValueError(f"gold item is not indexed: {lost[0]['item']}")
    texts = [(r["query_id"], r["text"]) for r in rows.select("query_id", "text").distinct().collect()]
    modes = ("lexical", "dense", "hybrid", "graph", "reranked")
    ranked = None
    for mode in reversed(modes):
        part = search(corpus, texts, mode, evaluation.TOP).select("query_id", F.lit(mode).alias("mode"), "item", "rank")
        ranked = part if ranked is None else ranked.unionAll(part)
    ranks = evaluation.first_relevant(rows.select("query_id", "category").distinct(), ranked, gold, modes)
    twice = evaluation.repeated_items(ranked).limit(1).collect()
    if twice:
        raise ValueError(f"a ranking lists {twice[0]['item']} more than once")
    named = ranks.join(ids, "query_id").drop("query_id").withColumnRenamed("name", "query_id")
    if not as_json:
        return evaluation.markdown_report(evaluation.metrics(ranks), named)
    shown = ranked.join(rows.where("showcase").select("query_id").distinct(), "query_id", "left_semi")
    return evaluation.json_report(evaluation.metrics(ranks), named, shown.join(ids, "query_id").drop("query_id").withColumnRenamed("name", "query_id"))


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(row.asDict(), ensure_ascii=False))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("path")
    index.add_argument("--index", required=True)
    index.add_argument("--full", action="store_true")
    index.add_argument("--language", default="python", choices=["python", "cpp"])
    commands.add_parser("inspect").add_argument("file")
    commands.add_parser("embed").add_argument("index")
    bench = commands.add_parser("benchmark")
    bench.add_argument("index")
    bench.add_argument("file")
    bench.add_argument("--json", action="store_true")
    bench.add_argument("--complete", action="store_true")
    for name in ("search", "context", "graph"):
        c = commands.add_parser(name)
        c.add_argument("index")
        c.add_argument("query", nargs="?" if name == "graph" else None)
        if name == "search":
            c.add_argument("--mode", default="lexical", choices=["lexical", "dense", "hybrid", "graph", "reranked"])
            c.add_argument("--limit", type=int, default=10)
            c.add_argument("--explain", action="store_true")
        if name != "graph":
            c.add_argument("--kind")
            c.add_argument("--path-prefix")
        if name == "context":
            c.add_argument("--budget", type=int, required=True)
    args = parser.parse_args(argv)
    spark = local_session()
    if args.command == "index":
        print(json.dumps(index_repository(spark, args.path, args.index, full=args.full, language=args.language)))
        return
    if args.command == "inspect":
        language = "cpp" if args.file.rpartition(".")[2].lower() in CPP_FILES else "python"
        symbols = (python_symbols if language == "python" else cpp_symbols)(scan_repository(spark, args.file, (*PYTHON_FILES, *CPP_FILES)))
        _show(symbols.select("kind", "qualified_name", "signature", "start_line", "end_line").orderBy("start_line", "qualified_name"))
        return
    if args.command == "embed":
        print(json.dumps({"vectors": embed(spark, args.index)}))
        return
    if args.command == "benchmark":
        print(benchmark(spark, args.index, args.file, args.json, args.complete))
        return
    store = IndexStore(spark, args.index)
    if args.command == "graph":
        edges = store.read("relations")
        if args.query is None:
            _show(graph.summary(edges).orderBy("kind", "resolution"))
        else:
            _show(edges.where((F.col("source") == args.query) | (F.col("target") == args.query)).select("kind", "source", F.coalesce("target", "target_text").alias("target"), "resolution"))
        return
    corpus = corpus_of(spark, args.index, kind=args.kind, path_prefix=args.path_prefix)
    units = corpus.units.withColumnRenamed("qualified_name", "item")
    if args.command == "search":
        hits = search(corpus, [(0, args.query)], args.mode, args.limit, args.explain)
        shown = [F.to_json("contributions").alias("contributions")] if "contributions" in hits.columns else []
        _show(hits.join(units, "item").select("rank", "score", *shown, "item", "kind", "path", "start_line", preview(F.col("source_text")).alias("preview")).orderBy("rank"))
    else:
        ranked = search(corpus, [(0, args.query)], "reranked", context.CANDIDATES).join(units, "item")
        text = context.block_text(*[F.col(c) for c in ("item", "kind", "path", "start_line", "end_line", "source_text")])
        _show(context.pack_context(ranked.withColumn("text", text), args.budget).orderBy("rank"))


if __name__ == "__main__":
    main()
