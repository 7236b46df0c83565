"""Shards of even bytes for indivisible groups by Karmarkar-Karp differencing over a bounded list of items.

A partial partition is a vector of `shards` byte sums. Differencing takes the two partial partitions with the largest spread
and adds them in opposite order, until one is left. It runs in one task on items of bounded number, whatever the input: each group large enough to matter
to a shard, bundles of small groups dealt by hash, and a few thousand small groups by themselves, which even out what the bundles leave.
"""
from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def difference(sums: np.ndarray) -> np.ndarray:
    """Shard of each entry of each partial partition (one per row of `sums`) after differencing them all into one."""
    n, k = sums.shape
    order = np.argsort(sums, axis=1, kind="stable")[:, ::-1]
    vectors = [row[o] for row, o in zip(sums, order, strict=True)]
    heap = [(int(v[-1] - v[0]), i) for i, v in enumerate(vectors)]
    heapq.heapify(heap)
    parent: list[tuple[int, np.ndarray]] = [(-1, np.zeros(0))] * (2 * n - 1)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        total = vectors[a] + vectors[b][::-1]
        by = np.argsort(-total, kind="stable")
        place = np.empty(k, dtype=np.int64)
        place[by] = np.arange(k)
        parent[a], parent[b] = (len(vectors), place), (len(vectors), place[::-1])
        vectors[a] = vectors[b] = None
        vectors.append(total[by])
        heapq.heappush(heap, (int(vectors[-1][-1] - vectors[-1][0]), len(vectors) - 1))
    final: list[np.ndarray] = [np.arange(k)] * (2 * n - 1)
    for i in range(2 * n - 3, -1, -1):
        up, place = parent[i]
        final[i] = final[up][place]
    out = np.empty((n, k), dtype=np.int64)
    for i in range(n):
        out[i, order[i]] = final[i]
    return out


def _dealt(shards: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending"), ("item", "ascending")])
        sizes = np.zeros((table.num_rows, shards), dtype=np.int64)
        sizes[:, 0] = table.column("size").to_numpy()
        return pa.table({"item": table.column("item"), "shard": pa.array(difference(sizes)[:, 0], pa.int32())})

    return run


def even_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, large: int = 64, bundles: int = 4096, singles: int = 4096, rows_per_run: int = 100_000) -> DataFrame:
    """Deal all rows to `shards` shards of nearly equal bytes; rows of equal text stay together.

    Returns one row per input row: the id column, `size` (UTF-8 bytes plus `overhead`), `text_crc32`, `shard` and `slot` (gapless
    from 0 in each shard). A null text counts no bytes and has the checksum of an empty one, but is a group of its own.
    A group of at least 1 / `large` of a shard is an item of its own; others are single items while there are no more than about `singles`, else they are dealt to
    `bundles` and as many singles by hash. A group is never split: one larger than a fair share fills a shard by itself and the others are evened among themselves.
    Ids may be null or repeat: each row gets a slot of its own. Other columns are not carried.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id_"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size_"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("crc_"),
        F.coalesce(F.md5(text), F.lit("")).alias("gid"))
    rows = stored(rows, "shard-rows")
    groups = stored(rows.groupBy("gid").agg(F.sum("size_").alias("size")), "shard-groups")
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    alone = (F.col("size") * large * shards >= total) | (F.pmod(F.xxhash64("gid"), F.lit(max(n, 1))) < singles)
    groups = groups.withColumn("item", F.when(alone, F.concat(F.lit("g"), "gid")).otherwise(F.concat(F.lit("b"), F.pmod(F.xxhash64(F.lit(1), "gid"), F.lit(bundles)))))
    items = groups.groupBy("item").agg(F.sum("size").alias("size"))
    dealt = stored(items.groupBy(F.lit(0).alias("one")).applyInArrow(_dealt(shards), "item string, shard int"), "shard-items")
    at = groups.select("gid", "item").join(dealt, "item").select("gid", "shard")
    placed = stored(rows.join(at, "gid"), "shard-placed")
    # Slots: each shard is cut into runs by a hash of the row; runs are numbered apart and shifted by the rows before them.
    runs = -(-placed.count() // (shards * rows_per_run)) * 4 or 1
    placed = placed.withColumn("run", F.pmod(F.xxhash64("id_", "gid"), F.lit(runs)))
    before = placed.groupBy("shard", "run").agg(F.count("*").alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)))
    own = Window.partitionBy("shard", "run").orderBy("id_", "gid")
    return placed.withColumn("k", F.row_number().over(own)).join(before, ["shard", "run"]).select(
        F.col("id_").alias(id_col), F.col("size_").alias("size"), F.col("crc_").alias("text_crc32"), "shard",
        (F.col("k") - 1 + F.coalesce("before", F.lit(0))).cast("long").alias("slot"))
