"""Full and incremental indexing of a repository into an :class:`IndexStore`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.extract_cpp import cpp_facts, cpp_symbols, resolve_cpp
from codeloom.operators.extract_python import python_facts, python_symbols, resolve_python
from codeloom.operators.incremental import change_set, merge, surface_changes
from codeloom.operators.resolve import contains_edges
from codeloom.sources.repository import CPP_FILES, PYTHON_FILES, scan_repository
from codeloom.sources.store import IndexStore
from codeloom.sources.workspace import Workspace

UNITS = ["path", "qualified_name", "kind", "source_text", "start_line", "end_line", "start_byte", "end_byte"]
SUFFIXES = {"python": PYTHON_FILES, "cpp": CPP_FILES}


def _symbols(files: DataFrame, language: str) -> DataFrame:
    """Symbols with the source_text of those that are code units."""
    if language == "python":
        return python_symbols(files)
    read = files.select("path", F.encode(F.regexp_replace("content", "\r\n", "\n"), "utf-8").alias("bytes"))
    text = F.decode(F.substring(F.col("bytes"), F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")), "utf-8")
    symbols = cpp_symbols(files).join(read, "path")
    return symbols.withColumn("source_text", F.when(F.col("kind").isin("class", "function", "method"), text)).drop("bytes")


def _relations(files: DataFrame, symbols: DataFrame, language: str) -> DataFrame:
    edges = resolve_python(python_facts(files), symbols) if language == "python" else resolve_cpp(cpp_facts(files), symbols)
    last = F.element_at(F.split("target", r"\."), -1) if language == "python" else F.col("target")
    contains = contains_edges(symbols).select("path", F.lit("contains").alias("kind"), "source", "target", last.alias("target_text"), F.lit("resolved").alias("resolution"))
    return edges.unionByName(contains, allowMissingColumns=True)


def _work(store: IndexStore, mode: str, changes: dict[str, int], **work: int) -> dict[str, int | str]:
    """The counters of a run: what was done and what the index holds."""
    held = {name: store.read(name).count() for name in ("files", "symbols", "code_units", "relations")}
    counts = {f"files_{c}": changes.get(c, 0) for c in ("added", "changed", "deleted", "unchanged")}
    return {"mode": mode, **counts, **work, **held, "searchable_units": held["code_units"]}


def index_repository(spark: SparkSession, root: str, index: str, full: bool = False, language: str = "python") -> dict[str, int | str]:
    """Bring the index of the files of one language under ``root`` up to date; returns counters of the work.

    Only added and changed files are read again.  If names, kinds or parents of
    symbols changed anywhere, the relations of all files are resolved anew, else
    only those of touched files; the result equals a full index.  An index of
    another language is refused unless it is written anew with ``full``.
    """
    store, work = IndexStore(spark, index), Workspace(spark, "index")
    files = work.write(scan_repository(spark, root, SUFFIXES[language]).withColumn("language_id", F.lit(language)), "files")
    listing = files.select("path", "content_sha256", "language_id")
    version = None if full else store.current()
    if version is None:
        symbols = work.write(_symbols(files, language), "symbols")
        tables = {"files": listing, "symbols": symbols.drop("source_text", "has_syntax_errors"), "code_units": symbols.where("source_text is not null").select(*UNITS), "relations": _relations(files, symbols, language)}
        store.write(tables)
        n, units = files.count(), tables["code_units"].count()
        return _work(store, "full", {"added": n}, files_analyzed=n, relation_files_recomputed=n, symbols_rewritten=symbols.count(), code_units_rewritten=units)
    old = store.read("files")
    other = old.where(F.col("language_id") != language).limit(1).collect()
    if other:
        raise ValueError(f"the index holds {other[0]['language_id']} files; index {language} with full=True or elsewhere")
    everything = work.write(change_set(old, files, ["path"], "content_sha256"), "changes")
    counted = {r["change"]: r["count"] for r in everything.groupBy("change").count().collect()}
    changes = everything.where("change <> 'unchanged'")
    if set(counted) <= {"unchanged"}:
        return _work(store, "noop", counted, files_analyzed=0, relation_files_recomputed=0, symbols_rewritten=0, code_units_rewritten=0)
    touched = work.write(files.join(changes, "path", "left_semi"), "touched")
    fresh = work.write(_symbols(touched, language), "fresh")
    old_symbols = store.read("symbols")
    symbols = work.write(merge(old_symbols, fresh.select(*old_symbols.columns), changes, "path"), "symbols")
    new_units = fresh.where("source_text is not null").select(*UNITS)
    units = merge(store.read("code_units"), new_units, changes, "path")
    wide = not surface_changes(old_symbols, symbols).isEmpty()
    again = files if wide else touched
    relations = _relations(again, symbols, language)
    if not wide:
        relations = merge(store.read("relations"), relations.join(touched, "path", "left_semi"), changes, "path")
    store.write({"files": listing, "symbols": symbols, "code_units": units, "relations": relations})
    return _work(store, "incremental", counted, files_analyzed=touched.count(), relation_files_recomputed=again.count(), symbols_rewritten=fresh.count(), code_units_rewritten=new_units.count())
