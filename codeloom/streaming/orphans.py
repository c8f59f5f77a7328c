"""References to records that do not exist, kept incrementally.

Two feeds arrive: versions of parent records (a key with the time its life starts
and ends) and references (a key and the time of reference).  State is keyed by a
128-bit hash of the referenced name and outlives the run:

* the parent index, one row per key with the life that each source gives it;
* the references, which later arrivals of their parents judge again;
* a log of verdicts by calendar month of arrival.

``update_orphans`` takes a state and what arrived since and returns the next one.
New references probe the index and are logged with a reason if their target is
not alive at the time of reference.  Known ones whose parent arrived, was deleted
or was corrected are judged again, which resolves waiting orphans and reopens
others.  What arrived may span any number of months: the index then gives a key's
lives after each of them, so one update over a year leaves the same log as twelve.
The latest verdict of a reference holds.  Hot names are salted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.operators.skew import hot_keys, with_copies, with_salt
from codeloom.sources.workspace import Workspace

KEY = ["k1", "k2"]
TABLES = ("index", "references", "verdicts", "months")


def _key(name: Column) -> list[Column]:
    return [F.xxhash64(name).alias("k1"), F.xxhash64(F.lit("k2"), name).alias("k2")]


def _verdict(lives: Column, at: Column) -> Column:
    """null: alive at the time of reference; else missing, late or deleted."""

    def begun(x: Column) -> Column:
        return x["start"].isNull() | (at >= x["start"])

    def ended(x: Column) -> Column:
        return x["end"].isNotNull() & (at >= x["end"])

    return (
        F.when(lives.isNull(), F.lit("missing"))
        .when(F.exists(lives, lambda x: begun(x) & ~ended(x)), F.lit(None).cast("string"))
        .when(F.exists(lives, ended), F.lit("deleted"))
        .otherwise(F.lit("late"))
    )


@dataclass
class OrphanState:
    """``index`` (k1, k2, lives), ``references`` (ref_id, k1, k2, no_target, at, month, kept columns), ``verdicts``
    (ref_id, month, reason or null) and ``months`` (first, last), all written tables."""

    index: DataFrame
    references: DataFrame
    verdicts: DataFrame
    first: int
    last: int

    def save(self, folder: str) -> None:
        """Write the state to a new ``folder``; the months come last, so a folder that has them is whole."""
        spark = self.index.sparkSession
        self.index.write.parquet(f"{folder}/index")
        self.references.write.parquet(f"{folder}/references")
        self.verdicts.write.parquet(f"{folder}/verdicts")
        spark.range(1).select(F.lit(self.first).alias("first"), F.lit(self.last).alias("last")).write.parquet(f"{folder}/months")

    @staticmethod
    def load(spark: SparkSession, folder: str) -> OrphanState:
        index, references, verdicts, months = (spark.read.parquet(f"{folder}/{name}") for name in TABLES)
        span = months.first()
        return OrphanState(index, references, verdicts, span["first"], span["last"])

    def open_at(self, month: int) -> DataFrame:
        """(ref_id, reason) of the references that are orphans after ``month``."""
        seen = self.verdicts.where(F.col("month") <= month)
        last = seen.groupBy("ref_id").agg(F.max(F.struct("month", F.coalesce("reason", F.lit("")).alias("reason"))).alias("last"))
        return last.select("ref_id", "last.reason").where("reason <> ''")

    def current(self) -> DataFrame:
        return self.open_at(self.last)

    def counts(self, *by: str) -> DataFrame:
        """(month, *by, reason, n_open) after each month; ``by`` are reference columns."""
        until = F.coalesce(F.lead("month").over(W.partitionBy("ref_id").orderBy("month")) - 1, F.lit(self.last))
        rows = self.verdicts.withColumn("until", until).where("reason is not null and until >= month")
        if by:
            rows = rows.join(self.references.select("ref_id", *by), "ref_id")
        # Equal spans are counted before they are spread over their months.
        rows = rows.groupBy("month", "until", *by, "reason").agg(F.count(F.lit(1)).alias("n"))
        months = F.explode(F.sequence(F.col("month"), F.col("until")))
        return rows.withColumn("month", months).groupBy("month", *by, "reason").agg(F.sum("n").alias("n_open"))


def month_number(at: Column) -> Column:
    """Months since the year 0."""
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def _steps(lives: Column, before: int) -> Column:
    """(month, lives): what holds of a key after each month that ``lives`` arrived in, in order.

    ``lives`` holds one life per source and month, those known before the update
    under the month ``before``.
    """

    def after(month: Column) -> Column:
        known = F.filter(lives, lambda x: x["month"] <= month)
        sources = F.array_distinct(F.transform(known, lambda x: x["source"]))
        return F.transform(sources, lambda s: F.array_max(F.filter(known, lambda x: x["source"].eqNullSafe(s))))

    months = F.array_sort(F.array_distinct(F.transform(lives, lambda x: x["month"])))
    changed = F.transform(months, lambda p: F.struct(p.alias("month"), after(p).alias("lives")))
    unchanged = F.array(F.struct(F.lit(before).alias("month"), lives.alias("lives")))
    several = F.exists(lives, lambda x: x["month"] > before) & (F.size(lives) > 1)
    single = F.array(F.struct(lives[0]["month"].alias("month"), lives.alias("lives")))
    return F.when(several, changed).when(F.size(lives) == 1, single).otherwise(unchanged)


def update_orphans(state: OrphanState | None, references: DataFrame, parents: DataFrame, *, keep: tuple[str, ...] = ()) -> OrphanState:
    """The state after what arrived since ``state`` (None: nothing before).

    ``references``: ref_id, target, at, arrival and the columns of ``keep``; rows
    repeated under one ref_id count once (the latest arrival holds, the first one
    dates it; an id that the state knows keeps its row), rows without ref_id are
    left out, a null target is missing and a null ``at`` is never late or deleted
    for a parent that exists.  ``parents``: source, name, start, end, arrival; of
    several versions of a name from one source the latest arrival holds (ties:
    greatest life), rows without a name are left out, a null start has always
    begun and a null end never ends.  Names from different sources both count.
    Verdicts are dated by the calendar month of arrival; unknown arrivals belong
    to the first month, and what arrives under a month before the state's last one
    belongs to that.  Empty feeds leave the state's verdicts as they are.
    """
    spark = references.sparkSession
    work = Workspace(spark, "orphans")
    span = references.select("arrival").unionAll(parents.select("arrival")).agg(F.min(month_number(F.col("arrival"))).alias("lo"), F.max(month_number(F.col("arrival"))).alias("hi")).first()
    lo, hi = (span["lo"] or 0), (span["hi"] or 0)
    if state is not None:
        lo, hi = state.last, max(state.last, hi)
    before = lo - 1  # the month of what was known before: below all that arrives now

    def month(column: str) -> Column:
        return F.greatest(F.coalesce(month_number(F.col(column)), F.lit(lo)), F.lit(lo))

    # Names become hashes before anything is shuffled.
    row = F.struct("arrival", *_key(F.col("target")), F.col("target").isNull().alias("no_target"), "at", *keep)
    refs = references.where("ref_id is not null").select("ref_id", row.alias("row")).groupBy("ref_id").agg(F.max("row").alias("row"), F.min("row.arrival").alias("first"))
    refs = refs.select("ref_id", "row.k1", "row.k2", "row.no_target", "row.at", *[f"row.{c}" for c in keep], month("first").alias("month"))
    if state is not None:
        refs = refs.join(state.references.select("ref_id"), "ref_id", "left_anti")
    refs = work.write(refs, "new")
    every = refs if state is None else refs.unionByName(state.references)
    hot = work.write(hot_keys(every.where("not no_target"), KEY), "hot")

    life = ["arrival", "start", "end"]
    versions = parents.where("name is not null").select(*_key(F.col("name")), "source", F.struct(*life).alias("life"), month("arrival").alias("month"))
    if state is not None:
        known = state.index.select(*KEY, F.explode("lives").alias("life"))
        versions = versions.unionAll(known.select(*KEY, "life.source", F.struct(*[f"life.{c}" for c in life]).alias("life"), F.lit(before).alias("month")))
    # The latest version per key, source and month; a key is touched if a version arrived.
    merged = versions.groupBy(*KEY, "source", "month").agg(F.max("life").alias("life"))
    merged = merged.groupBy(*KEY).agg(F.collect_list(F.struct(*[f"life.{c}" for c in life], "source", "month")).alias("lives"), (F.max("month") > before).alias("fresh"))
    steps = work.write(merged.select(*KEY, _steps(F.col("lives"), before).alias("steps"), "fresh"), "steps")
    index = steps.select(*KEY, F.element_at("steps", -1)["lives"].alias("lives"))

    copies = with_copies(steps, KEY, hot)
    # New ones are judged on arrival, and all again after each later month that touched their target.
    new = with_salt(refs, KEY, hot, "ref_id").join(copies, [*KEY, "_salt"], "left").withColumn("steps", F.when(~F.col("no_target"), F.col("steps")))
    if state is not None:
        old = with_salt(state.references.where("not no_target"), KEY, hot, "ref_id").join(copies.where("fresh"), [*KEY, "_salt"])
        old = old.select("ref_id", "at", F.lit(before).alias("month"), "steps", F.lit(False).alias("fresh_ref"))
    judged = new.select("ref_id", "at", "month", "steps", F.lit(True).alias("fresh_ref"))
    if state is not None:
        judged = judged.unionAll(old)
    on_arrival = F.try_element_at(F.filter("steps", lambda s: s["month"] <= F.col("month")), F.lit(-1))["lives"]
    first = F.struct(F.col("month").alias("month"), _verdict(on_arrival, F.col("at")).alias("reason"))
    later = F.transform(F.filter("steps", lambda s: (s["month"] > F.col("month")) & (s["month"] > before)), lambda s: F.struct(s["month"].alias("month"), _verdict(s["lives"], F.col("at")).alias("reason")))
    firsts = F.when(F.col("fresh_ref") & first["reason"].isNotNull(), F.array(first)).otherwise(F.array().cast("array<struct<month:int,reason:string>>"))
    verdicts = judged.select("ref_id", F.explode(F.concat(firsts, F.coalesce(later, F.array().cast("array<struct<month:int,reason:string>>")))).alias("v")).select("ref_id", "v.month", "v.reason")
    log = work.write(verdicts, "verdicts")
    if state is not None:
        log = state.verdicts.unionByName(log)
    return OrphanState(index, every, log, state.first if state else lo, hi)
