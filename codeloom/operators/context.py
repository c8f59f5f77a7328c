"""Greedy packing of ranked units into a token budget, one fold per query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import code_tokens

CANDIDATES = 20


#: The lines of a block around a unit's name, kind, place and source.
BLOCK = ("=== CODE UNIT ===\nsymbol: ", "\nkind: ", "\nlocation: ", "\ncode:\n", "\n=== END CODE UNIT ===\n")


def block_text(name: Column, kind: Column, path: Column, start: Column, end: Column, source: Column) -> Column:
    """How a unit is shown: its name, kind and place (path:Lfirst-last), then its source."""

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    place = F.concat(text(path), F.lit(":L"), text(start), F.lit("-"), text(end))
    a, b, c, d, e = (F.lit(x) for x in BLOCK)
    return F.concat(a, name, b, text(kind), c, place, d, text(source), e)


def overlaps(a: Column, b: Column) -> Column:
    """Half-open byte spans of one file that share a byte; touching spans do not, null spans never."""
    hit = (a["path"] == b["path"]) & (a["start_byte"] < b["end_byte"]) & (b["start_byte"] < a["end_byte"])
    return F.coalesce(hit, F.lit(False))


def span_overlaps(units: DataFrame, bin_bytes: int = 4096) -> DataFrame:
    """(a, b): pairs of units of one file whose spans overlap, smaller name first.

    Where two spans overlap, the later start lies in both: each span is met, in the
    bin of its start, by those that cover this bin of the file, and by no others.
    """
    spans = units.where("path is not null and start_byte is not null and end_byte is not null").select("qualified_name", "path", "start_byte", "end_byte")
    last = F.greatest(F.col("start_byte"), F.col("end_byte") - 1)
    x = spans.select(F.col("qualified_name").alias("a"), "path", F.struct("path", "start_byte", "end_byte").alias("x"), F.explode(F.sequence(F.floor(F.col("start_byte") / bin_bytes), F.floor(last / bin_bytes))).alias("bin"))
    y = spans.select(F.col("qualified_name").alias("b"), "path", F.struct("path", "start_byte", "end_byte").alias("y"), F.floor(F.col("start_byte") / bin_bytes).alias("bin"))
    earlier = F.struct(F.col("x.start_byte"), F.col("a")) < F.struct(F.col("y.start_byte"), F.col("b"))
    met = x.join(y, ["path", "bin"]).where((F.col("a") != F.col("b")) & earlier & overlaps(F.col("x"), F.col("y")))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def joined_context(packed: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, text): the selected blocks of each query in rank order, a blank line between them.

    ``packed``: from :func:`pack_context`; ``texts``: query_id, item, text.
    """
    chosen = packed.where("decision = 'selected'").join(texts.select("query_id", "item", "text"), ["query_id", "item"])
    blocks = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return chosen.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda x: x["text"]), "\n").alias("text"))


def pack_context(candidates: DataFrame, budget: int, counter: Callable[[Column], Column] = code_tokens) -> DataFrame:
    """(query_id, item, rank, tokens, decision, used): decisions in rank order.

    ``candidates``: query_id, item, rank, path, start_byte, end_byte, text; at most
    some tens per query.  A name seen before is ``duplicate``, a span that overlaps
    a selected one ``overlap``, a block above the budget ``oversized``, one that
    no longer fits ``budget``; later smaller blocks may still be ``selected``.
    used is the total after the decision.  ``counter`` gives the whole number of
    tokens of a text, not negative; anything else ends the query with an error.
    """
    if isinstance(budget, bool) or not isinstance(budget, int) or budget < 0:
        raise ValueError("the budget must be a whole number that is not negative")
    counted = candidates.withColumn("tokens", counter(F.col("text")))
    if dict(counted.dtypes)["tokens"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("a counter must give whole numbers")
    wrong = F.raise_error(F.lit("a counter must not give null or negative numbers"))
    candidates = counted.withColumn("tokens", F.when(F.col("tokens") >= 0, F.col("tokens").cast("int")).otherwise(wrong.cast("int")))
    row = F.struct("rank", "item", "path", "start_byte", "end_byte", "tokens")
    rows = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    seen = "array<struct<path:string,start_byte:int,end_byte:int>>"
    out = "array<struct<item:string,rank:int,tokens:int,decision:string,used:int>>"
    start = F.struct(
        F.lit(0).alias("used"), F.array().cast("array<string>").alias("names"), F.array().cast(seen).alias("spans"), F.array().cast(out).alias("out")
    )

    def step(state: Column, x: Column) -> Column:
        decision = (
            F.when(F.array_contains(state["names"], x["item"]), "duplicate")
            .when(F.exists(state["spans"], lambda s: overlaps(s, x)), "overlap")
            .when(x["tokens"] > budget, "oversized")
            .when(state["used"] + x["tokens"] > budget, "budget")
            .otherwise("selected")
        )
        chosen = decision == "selected"
        used = state["used"] + F.when(chosen, x["tokens"]).otherwise(0)
        span = F.array(F.struct(x["path"].alias("path"), x["start_byte"].cast("int").alias("start_byte"), x["end_byte"].cast("int").alias("end_byte")))
        done = F.array(F.struct(x["item"].alias("item"), x["rank"].cast("int").alias("rank"), x["tokens"].alias("tokens"), decision.alias("decision"), used.alias("used")))
        return F.struct(
            used.alias("used"),
            F.when(chosen, F.array_append(state["names"], x["item"])).otherwise(state["names"]).alias("names"),
            F.when(chosen, F.concat(state["spans"], span.cast(seen))).otherwise(state["spans"]).alias("spans"),
            F.concat(state["out"], done.cast(out)).alias("out"),
        )

    folded = rows.select("query_id", F.aggregate("rows", start, step)["out"].alias("out"))
    return folded.select("query_id", F.inline("out"))
