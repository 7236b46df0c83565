"""Merkle manifest of a dataset by slot pivot: one tree per group, their roots under one root, and a proof for every row.

Each level is one conditional aggregate that spreads a parent's children into `fanout` columns. The columns joined give the parent's hash, and the columns
without a child's own one are its siblings. Levels are climbed several at a time inside blocks of at most `fanout ** LEVELS` neighbours, which one shuffle by block
brings together, so a hot group is split into many blocks and no task holds a group. A first climb takes hashes only and leaves one row per block; a second one carries
the rows of a block upwards, where the proof of the block itself is joined.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Levels that are climbed inside one block.
LEVELS = 6
_STEP = "array<struct<left:string,right:string>>"


def hashed(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of values, each as `-` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds `at`, the gapless number from 0 of each row in its group, and `n`, the rows of the group.

    Rows are sorted by ranges, so a group may fill any number of tasks, and numbered by counts of the sorted parts. Equal rows are told apart by a copy number.
    """
    names = rows.columns
    copies = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("copies_")).withColumn("copy_", F.explode(F.sequence(F.lit(1).cast("long"), "copies_")))
    keys = [group, *order, "copy_"]
    placed = copies.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        *names, F.spark_partition_id().alias("part_"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("in_"))
    placed = stored(placed, "merkle-sorted")
    parts = placed.groupBy(group, "part_").agg(F.min("in_").alias("first_"), F.count(F.lit(1)).alias("rows_"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(group, "part_", (F.coalesce(F.sum("rows_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"), F.sum("rows_").over(whole).alias("n"))
    return placed.join(parts, [group, "part_"]).withColumn("at", F.col("in_") + F.col("shift_")).drop("part_", "in_", "shift_")


def _whole(column: Column, by: int) -> Column:
    return F.floor(column / by).cast("long")


def _grown(members: Column, many: Column, left: Column, right: Column) -> Column:
    """Members of a child, one step further up; a node that is alone on its level stays as it is."""
    step = F.array(F.struct(left.alias("left"), right.alias("right")))
    return F.transform(members, lambda m: F.struct(m["load"].alias("load"), F.when(many, F.concat(m["path"], step)).otherwise(m["path"]).alias("path")))


def _climb(nodes: DataFrame, fanout: int, levels: int, load: bool) -> DataFrame:
    """`levels` levels up: (g, at, n, h) of the blocks, with `members` (load, path inside the block) if `load`."""
    rows = nodes.withColumn("block", _whole(F.col("at"), fanout ** levels))
    if load:
        rows = rows.withColumn("members", F.array(F.struct("load", F.array().cast(_STEP).alias("path"))))
    kept = ["h", "members"] if load else ["h"]
    rows = rows.select("g", "block", "at", "n", *kept).repartition("g", "block")
    for _ in range(levels):
        slot = F.col("at") % fanout
        spread = [F.first(F.when(slot == s, F.struct(*kept)), ignorenulls=True).alias(f"c{s}") for s in range(fanout)]
        rows = rows.groupBy("g", "block", _whole(F.col("at"), fanout).alias("at")).agg(F.min("n").alias("was"), *spread)
        hashes = [F.col(f"c{s}.h") for s in range(fanout)]
        many = F.col("was") > 1
        out = [F.when(many, F.sha2(F.concat_ws("", *hashes), 256)).otherwise(F.col("c0.h")).alias("h")]
        if load:
            none = F.filter("c0.members", lambda m: F.lit(False))
            grown = [F.coalesce(_grown(F.col(f"c{s}.members"), many, F.concat_ws("", *hashes[:s]), F.concat_ws("", *hashes[s + 1:])), none) for s in range(fanout)]
            out.append(F.concat(*grown).alias("members"))
        rows = rows.select("g", "block", "at", _whole(F.col("was") + (fanout - 1), fanout).alias("n"), *out)
    return rows.drop("block")


def _stages(nodes: DataFrame, fanout: int) -> list[tuple[DataFrame, int]]:
    """The nodes (g, at, n, h, load) and the blocks above them up to one node per group, each with the levels to the next. Empty for no nodes."""
    most = nodes.agg(F.max("n")).first()[0]
    stages = []
    while most:
        levels = next(k for k in range(LEVELS + 1) if k == LEVELS or fanout ** k >= most)
        stages.append((nodes, levels))
        if most == 1:
            break
        nodes = stored(_climb(nodes, fanout, levels, False), "merkle-blocks").withColumn("load", F.col("at"))
        most = -(-most // fanout ** levels)
    return stages


def _paths(stages: list[tuple[DataFrame, int]], outer: DataFrame, fanout: int) -> DataFrame:
    """(load, path, ...) of the lowest stage. `outer` (g, at, path, ...) holds the path above each group's last node and columns for all rows below it."""
    if len(stages) == 1:
        return stages[0][0].join(outer, ["g", "at"]).drop("g", "at", "n", "h")
    rest = [c for c in outer.columns if c not in ("g", "at", "path")]
    for depth in reversed(range(len(stages) - 1)):
        nodes, levels = stages[depth]
        blocks = _climb(nodes, fanout, levels, True).drop("n", "h").join(outer.withColumnRenamed("path", "above"), ["g", "at"])
        members = blocks.select("g", F.explode("members").alias("m"), "above", *rest)
        outer = members.select("g", F.col("m.load").alias("at"), F.concat("m.path", "above").alias("path"), *rest)
        if depth:
            outer = stored(outer, "merkle-paths")
    return outer.withColumnRenamed("at", "load").drop("g")


def manifest(
    docs: DataFrame, fields: list[str], key: str = "doc_id", group: str = "lang", fanout: int = 2, altered: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per row of `docs`: its key, leaf, subroot, root, path, proof_sha256, folded_root and verified.

    A leaf is the hash of `fields`. In each group the leaves ascend by `key`, nulls first and ties by leaf; every `fanout` consecutive nodes become the hash of their joined
    digests until one is left, a run that is shorter (even of one node) likewise. Groups ascend by name, null first, and their subroots give the root in the same way.
    `path` lists each level's siblings on the left and on the right, from the leaf to the root. `altered` has other values of some fields: the folded root is computed from them
    and the original siblings, so `verified` tells whether the row is still the one in the manifest.

    Null fields are `-`; null keys and groups take part; repeated rows are leaves of their own with proofs of their own. A single row is its own root, with an empty path.
    An empty table has no rows. Other columns are ignored.
    """
    altered = altered or {}
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(v) for c, v in altered.items()], F.lit(False))
    name = F.col(group).cast("string")
    leaves = docs.select(
        F.when(name.isNull(), "n").otherwise(F.concat(F.lit("v"), name)).alias("g"), F.col(key).alias("key"), hashed([F.col(c) for c in fields]).alias("h"),
        F.when(changed, hashed([altered.get(c, F.col(c)) for c in fields])).alias("other"))
    nodes = numbered(leaves, "g", ["key", "h", "other"]).select("g", "at", "n", "h", F.struct("key", F.col("h").alias("leaf"), "other").alias("load"))
    stages = _stages(nodes, fanout)
    empty = F.array().cast(_STEP)
    if not stages:
        found = nodes.select("load", empty.alias("path"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    else:
        tops = stages[-1][0].select("g", "at", "h")
        subroots = numbered(tops.select(F.lit("").alias("all_"), "g", "h"), "all_", ["g"]).select(F.lit("").alias("g"), "at", "n", "h", F.col("g").alias("load"))
        over = _stages(subroots, fanout)
        roots = _paths(over, over[-1][0].select("g", "at", empty.alias("path"), F.col("h").alias("root")), fanout).withColumnRenamed("load", "g")
        roots = stored(roots, "merkle-subroots")
        found = _paths(stages, tops.join(roots, "g").withColumnRenamed("h", "subroot"), fanout)
    folded = F.aggregate("path", F.coalesce("load.other", "load.leaf"), lambda at, step: F.sha2(F.concat(step["left"], at, step["right"]), 256))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    return found.select(
        F.col("load.key").alias(key), F.col("load.leaf").alias("leaf"), "subroot", "root", "path", F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
