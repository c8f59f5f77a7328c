"""Parent-child links to full hierarchies by tree contraction.

Each round rakes all leaves and compresses unary chains (a node with one child
whose hash is a local maximum hands its child to its own parent), recording what
it removed.  Every tree shrinks to its root in a logarithmic number of rounds;
what never ends, a core of self-loops, are the cycles.  The records are then
reversed: each removed node takes root, depth and path from the node it hung on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from codeloom.operators.skew import found_hot, hot_keys, salted_join
from codeloom.sources.workspace import Workspace

ROOT, BROKEN, CYCLE = "rooted", "broken", "cycle"


def _rank(node: Column) -> Column:
    return F.xxhash64(node)


def _above(a: Column, b: Column) -> Column:
    """A strict order of nodes that looks random along a chain."""
    return (_rank(a) > _rank(b)) | ((_rank(a) == _rank(b)) & (a > b))


def _lifted(step: DataFrame, paths: bool) -> DataFrame:
    """The rows of a round with children of compressed nodes handed to the node above."""
    up = step.where("act = 'compress'").select(
        F.col("child").alias("v"), F.col("p").alias("up"), F.col("w").alias("up_w"), *([F.col("seg").alias("up_seg")] if paths else [])
    )
    seg = [F.when(F.col("up_seg").isNull(), F.col("seg")).otherwise(F.concat("up_seg", "seg")).alias("seg")] if paths else []
    return step.join(up, "v", "left").select(
        "v", F.coalesce("up", "p").alias("p"), (F.col("w") + F.coalesce("up_w", F.lit(0))).alias("w"), *seg, "child", "act"
    )


def build_hierarchy(links: DataFrame, paths: bool = False) -> DataFrame:
    """Resolve ``links`` (name, parent) to (name, status, top, steps[, path]).

    status is ``rooted`` (top is the root), ``broken`` (the chain ends at a name
    that is not a node: top is that name), ``on_cycle`` or ``below_cycle`` (top is
    the smallest name of the cycle).  steps counts parent links up to the top, for
    cycles up to the first node on the cycle.  With ``paths``, path is the array
    of names from the top down to the node, null for cycles.

    Names must be clean; a null name is no node, a null parent makes a root.  A
    name given several times keeps its greatest parent (null counts as least), a
    node that is its own parent is a cycle.  Extra columns are ignored; an empty
    table gives no rows.
    """
    spark = links.sparkSession
    work = Workspace(spark, "hierarchy")
    nodes = links.where("name is not null").groupBy("name").agg(F.max("parent").alias("parent"))
    nodes = work.write(nodes.select(F.monotonically_increasing_id().alias("id"), "name", "parent"), "nodes")

    ids = nodes.select(F.col("id").alias("p"), F.col("name").alias("parent"))
    hot = found_hot(work.write(hot_keys(nodes.where("parent is not null"), ["parent"]), "hot_names"))
    children = salted_join(nodes.where("parent is not null"), ids, ["parent"], hot, "id", "left")
    segment = [F.array("name").alias("seg")] if paths else []
    edges = work.write(children.select(F.col("id").alias("v"), "p", "parent", F.lit(1).alias("w"), *segment), "edges")
    broken = edges.where("p is null").select(F.col("v").alias("id"), F.lit(BROKEN).alias("kind"), F.col("v").alias("anchor"), F.lit(1).alias("steps"), F.lit(False).alias("on_cycle"))
    live = edges.where("p is not null").drop("parent")
    hot_ids = found_hot(work.write(hot_keys(live, ["p"]), "hot_ids"))

    rounds = []
    while True:
        k = len(rounds)
        under = live.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("child")).withColumnRenamed("p", "v")
        unary = (F.col("n") == 1) & (F.col("v") != F.col("p")) & _above(F.col("v"), F.col("child")) & _above(F.col("v"), F.col("p"))
        act = F.when(F.col("n").isNull(), F.lit("rake")).when(unary, F.lit("compress")).otherwise(F.lit("keep"))
        seen = Observation()
        step = live.join(under, "v", "left").withColumn("act", act).drop("n").observe(seen, F.count_if(F.col("act") != "keep").alias("removed"))
        step = work.write(step, f"round{k}")
        if not seen.get.get("removed"):
            break
        rounds.append(step)
        live = _lifted(step, paths).where("act = 'keep'").drop("act", "child")

    core = step.where("act = 'keep'").select(F.col("v").alias("id"), F.lit(CYCLE).alias("kind"), F.col("v").alias("anchor"), F.lit(0).alias("steps"), F.lit(True).alias("on_cycle"))
    roots = nodes.where("parent is null").select("id", F.lit(ROOT).alias("kind"), F.col("id").alias("anchor"), F.lit(0).alias("steps"), F.lit(False).alias("on_cycle"))
    placed = roots.unionAll(broken).unionAll(core)
    if paths:
        names = nodes.select("id", F.array("name").alias("path"))
        top = nodes.join(broken.select("id"), "id").select("id", F.array("parent", "name").alias("path"))
        placed = placed.where(F.col("kind") == ROOT).join(names, "id").unionAll(placed.where(F.col("kind") == BROKEN).join(top, "id")).unionAll(
            placed.where(F.col("kind") == CYCLE).withColumn("path", F.lit(None).cast("array<string>"))
        )
    placed = work.append(placed, "placed", len(rounds))

    down = [F.col("id").alias("p"), "kind", "anchor", "steps", *(["path"] if paths else [])]
    hung = [
        F.col("v").alias("id"),
        "kind",
        "anchor",
        F.when(F.col("on_v"), F.lit(0)).otherwise(F.col("steps") + F.col("w")).cast("int").alias("steps"),
        F.col("on_v").alias("on_cycle"),
        *([F.when(F.col("kind") != CYCLE, F.concat("path", "seg")).alias("path")] if paths else []),
    ]
    for k in reversed(range(len(rounds))):
        # A compressed node is on a cycle exactly if the only child it had is.
        by_child = placed.where("on_cycle").select(F.col("id").alias("child"), F.lit(True).alias("on_v"))
        removed = _lifted(rounds[k], paths).where("act <> 'keep'")
        removed = removed.join(by_child, "child", "left").withColumn("on_v", F.coalesce("on_v", F.lit(False)))
        back = salted_join(removed, placed.select(*down), ["p"], hot_ids, "v")
        placed = work.append(back.select(*hung), "placed", k)

    # The anchor's name: a root's own, a broken chain's missing parent, a cycle's smallest.
    tops = nodes.select(F.col("id").alias("anchor"), F.col("name").alias("own"), F.col("parent").alias("missing"))
    on = placed.where("on_cycle").select("id", "anchor").join(nodes.select("id", "name"), "id")
    least = on.groupBy("anchor").agg(F.min("name").alias("least"))
    used = placed.select("anchor", "kind").distinct().join(tops, "anchor").join(least, "anchor", "left")
    used = used.select("anchor", F.when(F.col("kind") == CYCLE, F.col("least")).when(F.col("kind") == BROKEN, F.col("missing")).otherwise(F.col("own")).alias("top"))
    used = work.write(used, "tops")
    hot_tops = found_hot(work.write(hot_keys(placed, ["anchor"]), "hot_tops"))
    out = salted_join(placed, used, ["anchor"], hot_tops, "id").join(nodes.select("id", "name"), "id")
    state = F.when(F.col("on_cycle"), F.lit("on_cycle")).when(F.col("kind") == CYCLE, F.lit("below_cycle")).otherwise(F.col("kind"))
    return out.select("name", state.alias("status"), "top", F.col("steps").cast("int").alias("steps"), *(["path"] if paths else []))


def descendants(hierarchy: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) of all nodes with a path, from :func:`build_hierarchy` with paths.

    A broken chain's missing name is no node and not listed as an ancestor.
    """
    nodes = hierarchy.where("path is not null").select("name", F.when(F.col("status") == BROKEN, F.expr("slice(path, 2, greatest(size(path) - 1, 0))")).otherwise(F.col("path")).alias("path"))
    pairs = nodes.select(F.posexplode("path").alias("at", "ancestor"), F.col("name").alias("descendant"), F.size("path").alias("n"))
    return pairs.where("at < n - 1").select("ancestor", "descendant", (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))
