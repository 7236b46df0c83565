"""Parent chains of hierarchies that know only each node's parent, by pointer doubling."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def _jumps(links: DataFrame) -> list[DataFrame]:
    """Tables (id, up) of steps over 1, 2, 4, ... parents, until nobody has an ancestor that far.

    A chain of d links needs log2(d) + 1 joins. A step over more links than there are can only exist on a ring, which is an error.
    """
    one = cut(links.where("id IS NOT NULL AND parent_id IS NOT NULL").select(F.col("id").cast("bigint"), F.col("parent_id").cast("bigint").alias("up")).distinct())
    most, jumps = one.count(), []
    while not one.isEmpty():
        if 1 << len(jumps) > most:
            raise ValueError("category hierarchy is cyclic")
        jumps.append(one)
        one = cut(one.join(one.select(F.col("id").alias("up"), F.col("up").alias("_far")), "up").select("id", F.col("_far").alias("up")).distinct())
    return jumps


def ancestors(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of each `starts` id: itself at distance 0, then every parent up to its root. `links` are (id, parent_id).

    Each distance is a sum of different powers of two, so every pair is made by one path through the jump tables and no round repeats another's work.
    """
    reach = starts.select(F.col("id").cast("bigint")).where("id IS NOT NULL").distinct().select("id", F.col("id").alias("ancestor"), F.lit(0).cast("bigint").alias("distance"))
    jumps = _jumps(links)
    for k, jump in enumerate(jumps):
        step = jump.select(F.col("id").alias("ancestor"), "up")
        further = reach.join(step, "ancestor").select("id", F.col("up").alias("ancestor"), (F.col("distance") + (1 << k)).alias("distance"))
        # The last round is read by the caller only.
        reach = reach.unionByName(cut(further) if k + 1 < len(jumps) else further)
    return reach


def _links(categories: DataFrame) -> DataFrame:
    """(id, parent_id) of categories whose parent is in the table."""
    known = categories.select(F.col("id").cast("bigint").alias("parent_id")).distinct()
    return categories.select(F.col("id").cast("bigint").alias("id"), F.col("parent_id").cast("bigint").alias("parent_id")).join(known, "parent_id", "left_semi")


# G14
def root_paths_by_parent(categories: DataFrame) -> DataFrame:
    """(id, step, ancestor, name): every ancestor of every category from its root (step 1) down to itself, by `parent_id` alone.

    A category whose parent is not in the table is a root.
    """
    up = cut(ancestors(_links(categories), categories))
    depth = up.groupBy("id").agg(F.max("distance").alias("_depth"))
    named = categories.select(F.col("id").cast("bigint").alias("ancestor"), "name")
    return up.join(depth, "id").join(named, "ancestor").select("id", (F.col("_depth") - F.col("distance") + 1).alias("step"), "ancestor", "name")


def roots(categories: DataFrame) -> DataFrame:
    """(id, root, depth) of every category; a root has depth 1.

    Each category holds one row: the step to its root or, if that is farther, over the 1, 2, 4, ... next parents. A round joins the steps that have not ended with
    the steps from where they lead, so a chain of depth d takes log2(d) rounds and no round lists ancestors. With several parents there is a row for each
    ancestor so far away, and the farthest root counts.
    """
    ids = categories.select(F.col("id").cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    links = cut(_links(categories).where("id IS NOT NULL").distinct())
    most, tree = links.count(), links.groupBy("id").count().where("count > 1").isEmpty()
    root = F.col("parent_id").isNull()
    state = cut(ids.join(links, "id", "left").select("id", F.coalesce("parent_id", "id").alias("up"), F.when(root, 0).otherwise(1).cast("bigint").alias("distance"), root.alias("done")))
    rounds = 0
    while not state.where("NOT done").isEmpty():
        # A step over more links than there are can only exist on a ring.
        if 1 << rounds > most:
            raise ValueError("category hierarchy is cyclic")
        onward = state.select(F.col("id").alias("up"), F.col("up").alias("_far"), F.col("distance").alias("_more"), F.col("done").alias("_done"))
        moved = state.where("NOT done").select("id", "up", "distance").join(onward, "up").select(
            "id", F.col("_far").alias("up"), (F.col("distance") + F.col("_more")).alias("distance"), F.col("_done").alias("done"))
        state = cut(state.where("done").unionByName(moved if tree else moved.distinct()))
        rounds += 1
    return state.groupBy("id").agg(F.max_by("up", "distance").alias("root"), (F.max("distance") + 1).alias("depth"))
