"""Filling windows of fixed capacity: minimum bin slack over the multiset of lengths.

Lengths of pieces are integers below the capacity, so the whole collection is a
histogram of at most ``capacity - 1`` counts however many documents there are.
Per capacity one plan is made from that histogram: the longest remaining length
opens a window, a bitset subset-sum over the remaining lengths finds the fill
closest to capacity, backtracking gives how many of each length it takes, and the
same fill is repeated as often as the counts allow.  Documents then find their
window by their rank among pieces of equal length.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.sources.workspace import Workspace

#: A token is a name, a number, or any other single character that is not white space.
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\s\x{1c}-\x{1f}]"
ROWS_PER_BUCKET = 1_000_000
_PLAN = "budget_name string, capacity int, length int, first_rank long, last_rank long, per_window long, first_window long, n_windows long"


def token_count(text: Column) -> Column:
    """Tokens of a text; white space is Unicode's."""
    return F.regexp_count(text, F.lit("(?U)" + TOKEN))


def closest_fill(counts: dict[int, int], order: list[int], target: int) -> dict[int, int]:
    """How many of each length (``order``: descending) make the greatest sum of at most ``target``."""
    reach, mask = 1, (1 << (target + 1)) - 1
    stages: list[tuple[int, int, int]] = []
    for length in order:
        if length > target or not counts[length]:
            continue
        stages.append((length, counts[length], reach))
        left, step = min(counts[length], target // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left, step = left - take, step * 2
        if reach >> target & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, available, before in reversed(stages):
        n = 0
        while not (before >> at) & 1:
            at, n = at - length, n + 1
            assert n <= available
        if n:
            used[length] = n
    return used


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fills (length -> how many) with the number of windows of each, until nothing remains."""
    counts = dict(counts)
    order = sorted(counts, reverse=True)
    plan, head = [], 0
    while head < len(order):
        longest = order[head]
        if not counts[longest]:
            head += 1
            continue
        counts[longest] -= 1
        used = closest_fill(counts, order[head:], capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in used.items())
        for length, n in used.items():
            counts[length] -= n * times
        plan.append((used, times))
        if len(order) > 64 and sum(1 for x in order[head:] if not counts[x]) * 2 > len(order) - head:
            order, head = [x for x in order[head:] if counts[x]], 0
    return plan


def _plan_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    name, capacity = pdf["budget_name"].iloc[0], int(pdf["capacity"].iloc[0])
    rows, window = [], 0
    taken: dict[int, int] = {}
    for used, times in plan_windows(dict(zip(pdf["length"].tolist(), pdf["n"].tolist())), capacity):
        for length, n in used.items():
            first = taken.get(length, 0)
            taken[length] = first + n * times
            rows.append((name, capacity, length, first, first + n * times, n, window, times))
        window += times
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _PLAN.split(", ")])


def pack_windows(sizes: DataFrame, budgets: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(budget_name, capacity, doc_id, part, window_id, tokens): a window for every document and budget.

    ``sizes``: doc_id, tokens (null counts as 0); ``budgets``: budget_name,
    capacity (positive; others are left out, equal rows count once).  A document
    is cut only if it exceeds the capacity: into parts that fill windows of their
    own and a last part that is packed with others.  Documents without tokens take
    no room and are spread over the windows.  Every row is packed, also rows that
    repeat a doc_id or have none.  Window ids count from 0 per budget.
    """
    spark = sizes.sparkSession
    work = Workspace(spark, "packing")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sizes.count() // rows_per_bucket))
    docs = sizes.select("doc_id", F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
    docs = work.write(docs.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(buckets)).cast("int")), "docs")
    limits = budgets.where("capacity > 0 and budget_name is not null").select("budget_name", F.col("capacity").cast("int").alias("capacity")).distinct()
    limits = [(r["budget_name"], r["capacity"]) for r in limits.orderBy("budget_name", "capacity").collect()]
    if not limits:
        return docs.limit(0).select(
            F.lit("").alias("budget_name"), F.lit(0).alias("capacity"), "doc_id", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("window_id"), "tokens"
        )
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(c).alias("capacity")) for n, c in limits])).alias("b")
    pieces = docs.select("*", each).select("doc_id", "bucket", "tokens", "b.*")
    pieces = pieces.withColumn("whole", F.floor(F.col("tokens") / F.col("capacity"))).withColumn("length", (F.col("tokens") % F.col("capacity")).cast("int"))

    cell = ["budget_name", "capacity", "length", "bucket"]
    counts = work.write(pieces.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")), "counts")
    histogram = counts.where("length > 0").groupBy("budget_name", "capacity", "length").agg(F.sum("n").alias("n"))
    plan = work.write(histogram.groupBy("budget_name", "capacity").applyInPandas(_plan_rows, _PLAN), "plan")

    # Rank among pieces of equal length: an offset per cell and a row number within it.  Whole windows are summed per
    # length first, so that no task sees more than the cells of one length or the lengths of one budget.
    before = W.partitionBy("budget_name", "capacity", "length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    per_length = counts.groupBy("budget_name", "capacity", "length").agg(F.sum("whole").alias("whole"))
    shorter = W.partitionBy("budget_name", "capacity").orderBy("length").rowsBetween(W.unboundedPreceding, -1)
    starts = per_length.select("budget_name", "capacity", "length", F.coalesce(F.sum("whole").over(shorter), F.lit(0)).alias("whole_start"))
    offsets = counts.select(*cell, "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("whole_before"))
    offsets = offsets.join(starts.hint("merge"), ["budget_name", "capacity", "length"]).withColumn("whole_offset", F.col("whole_before") + F.col("whole_start"))
    # A cell takes only the ranges of the plan that its own ranks fall into.
    overlap = (F.col("first_rank") < F.col("offset") + F.col("n")) & (F.col("offset") < F.col("last_rank"))
    ranges = offsets.join(plan.hint("merge"), ["budget_name", "capacity", "length"]).where(overlap)
    ranges = ranges.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct("first_rank", "last_rank", "per_window", "first_window"))).alias("ranges"))
    offsets = offsets.select(*cell, "offset", "whole_offset").join(ranges.hint("merge"), cell, "left")
    offsets = work.write(offsets, "offsets")
    within = W.partitionBy(*cell).orderBy("doc_id", "tokens")
    upto = within.rowsBetween(W.unboundedPreceding, -1)
    ranked = pieces.select("*", (F.row_number().over(within) - 1).alias("row"), F.coalesce(F.sum("whole").over(upto), F.lit(0)).alias("whole_row"))
    # Pieces are partitioned and sorted by cell already; the cells grow with the documents and are merged, not broadcast.
    ranked = ranked.join(offsets.hint("merge"), cell).withColumn("rank", F.col("row") + F.col("offset")).withColumn("whole_rank", F.col("whole_row") + F.col("whole_offset"))

    # One row per budget.
    total = plan.groupBy("budget_name", "capacity").agg(F.max(F.col("first_window") + F.col("n_windows")).alias("n_packed"))
    placed = ranked.join(F.broadcast(total), ["budget_name", "capacity"], "left")
    hit = F.element_at(F.filter("ranges", lambda r: (r["first_rank"] <= F.col("rank")) & (F.col("rank") < r["last_rank"])), 1)
    packed = F.coalesce("n_packed", F.lit(0))
    placed = placed.withColumn("hit", F.when(F.col("length") > 0, hit)).withColumn(
        "last_window",
        F.when(F.col("length") > 0, F.col("hit.first_window") + F.floor((F.col("rank") - F.col("hit.first_rank")) / F.col("hit.per_window")))
        .when(F.col("tokens") == 0, F.when(packed > 0, F.col("rank") % packed).otherwise(F.lit(0))),
    )
    last = placed.where((F.col("length") > 0) | (F.col("tokens") == 0)).select(
        "budget_name", "capacity", "doc_id", F.col("whole").cast("long").alias("part"), F.col("last_window").cast("long").alias("window_id"), F.col("length").cast("long").alias("tokens")
    )
    full = placed.where("whole > 0").select(
        "budget_name", "capacity", "doc_id", packed.alias("packed"), "whole_rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("part")
    )
    full = full.select("budget_name", "capacity", "doc_id", "part", (F.col("packed") + F.col("whole_rank") + F.col("part")).cast("long").alias("window_id"), F.col("capacity").cast("long").alias("tokens"))
    return last.unionAll(full)


def window_report(windows: DataFrame) -> DataFrame:
    """Per budget: windows used, tokens, the least number of windows possible, and the share of room filled."""
    used = windows.groupBy("budget_name", "capacity").agg(F.countDistinct("window_id").alias("n_windows"), F.sum("tokens").alias("n_tokens"))
    return used.select(
        "budget_name",
        "capacity",
        "n_windows",
        "n_tokens",
        F.ceil(F.col("n_tokens") / F.col("capacity")).alias("least_windows"),
        F.round(F.col("n_tokens") / (F.col("n_windows") * F.col("capacity")), 6).alias("filled"),
    )
