"""Resolution of reference facts against the symbols, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import base_name


def contains_edges(symbols: DataFrame) -> DataFrame:
    """(source, target, path): one resolved edge per parent and child."""
    return symbols.where("parent is not null").select(F.col("parent").alias("source"), F.col("qualified_name").alias("target"), "path").dropDuplicates(["source", "target"])


def duplicate_names(symbols: DataFrame) -> DataFrame:
    """(qualified_name, n_paths): names that more than one file defines."""
    return symbols.groupBy("qualified_name").agg(F.countDistinct("path").alias("n_paths")).where("n_paths > 1")


def resolve_facts(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(fact_id, target, resolution): resolved if the text is a symbol, probable if it is a member of the source's parent.

    ``facts``: fact_id, source, target_text.  Unknown targets keep null and ``unresolved``.
    """
    names = symbols.select("qualified_name", "parent")
    own = names.select(F.col("qualified_name").alias("source"), F.col("parent").alias("scope"))
    direct = names.select(F.col("qualified_name").alias("target_text"), F.col("qualified_name").alias("direct"))
    separator = F.when(F.col("scope").contains("::"), F.lit("::")).otherwise(F.lit("."))
    found = facts.join(own, "source", "left").withColumn("member", F.concat("scope", separator, "target_text")).join(direct, "target_text", "left")
    member = names.select(F.col("qualified_name").alias("member"), F.col("qualified_name").alias("in_scope"))
    found = found.join(member, "member", "left")
    status = F.when(F.col("direct").isNotNull(), "resolved").when(F.col("in_scope").isNotNull(), "probable").otherwise("unresolved")
    return found.select("fact_id", F.coalesce("direct", "in_scope").alias("target"), status.alias("resolution"))


def unique_stems(symbols: DataFrame) -> DataFrame:
    """(stem, n_symbols, qualified_name): callables by their name without scope and parameters; the name only if unique."""
    rows = symbols.where(F.col("kind").isin("function", "method")).select(base_name(F.col("qualified_name")).alias("stem"), "qualified_name")
    counts = rows.groupBy("stem").agg(F.count(F.lit(1)).alias("n_symbols"), F.min("qualified_name").alias("least"))
    return counts.select("stem", "n_symbols", F.when(F.col("n_symbols") == 1, F.col("least")).alias("qualified_name"))


def scopes(name: Column, separator: str) -> Column:
    """The enclosing scopes of a qualified name, innermost first, and the empty scope at the end."""
    parts = F.split(F.regexp_replace(name, r"\(.*$", ""), "::" if separator == "::" else r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda depth: F.array_join(F.slice(parts, 1, n - depth), separator))


def scope_walk(facts: DataFrame, symbols: DataFrame) -> DataFrame:
    """(fact_id, depth, n_matches, target): walk the source's scopes outwards to the first that holds the name.

    Resolved (target) only if that level has exactly one match.
    """
    stem = F.regexp_replace(F.col("qualified_name"), r"\(.*$", "")
    known = symbols.select(stem.alias("candidate"), "qualified_name")

    def walk(rows: DataFrame, separator: str) -> DataFrame:
        levels = rows.select("fact_id", "target_text", F.posexplode(scopes(F.col("source"), separator)).alias("depth", "scope"))
        return levels.select("fact_id", "depth", F.when(F.col("scope") == "", F.col("target_text")).otherwise(F.concat("scope", F.lit(separator), "target_text")).alias("candidate"))

    cpp = F.coalesce(F.col("source").contains("::"), F.lit(False))
    walked = walk(facts.where(cpp), "::").unionAll(walk(facts.where(~cpp), "."))
    level = walked.join(known, "candidate").groupBy("fact_id", "depth").agg(F.count(F.lit(1)).alias("n_matches"), F.min("qualified_name").alias("least"))
    first = level.groupBy("fact_id").agg(F.min(F.struct("depth", "n_matches", "least")).alias("f"))
    return first.select("fact_id", F.col("f.depth").alias("depth"), F.col("f.n_matches").alias("n_matches"), F.when(F.col("f.n_matches") == 1, F.col("f.least")).alias("target"))
