"""Exact top-k inner products by MaxScore over quantised vectors.

A dimension with a sign is a term; its postings are the column of a block of vectors, its bound the largest positive product in that
block. For a query, the terms with the smallest bounds whose sum stays below the current k-th score are non-essential: no
vector that scores in them alone can enter. The other columns are traversed for all vectors, and the non-essential ones
are probed from the largest bound down, only for vectors that can still reach the k-th score. Shards are merged by rank.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float = 256.0) -> DataFrame:
    """(id, v, copies) of vectors without null, NaN or infinite components; equal rows are counted."""
    x = F.col(vector_col)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & sound)
    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")).groupBy("id", "v").agg(F.count(F.lit(1)).alias("copies"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    column = column.combine_chunks()
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def max_score(queries: np.ndarray, query_ids: np.ndarray, keys: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, span: int = 1024, chunk: int = 8) -> list[tuple[int, int, int, int]]:
    """(query id, query key, vector id, score) of the k best vectors for each query, none of its own id; ties go to smaller ids."""
    width = vectors.shape[1]
    exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * width < 2**52
    kind = np.float64 if exact else np.int64
    order = np.argsort(ids, kind="stable")
    vectors, ids, queries = vectors[order].astype(kind), ids[order], queries.astype(kind)
    blocks = [(np.asfortranarray(vectors[b:b + span]), ids[b:b + span]) for b in range(0, len(ids), span)]
    above = [(np.maximum(v.max(axis=0), 0), np.maximum(-v.min(axis=0), 0)) for v, _ in blocks]
    out = []
    for q, own, key in zip(queries, query_ids, keys, strict=True):
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
        for (v, names), (up, down) in zip(blocks, above, strict=True):
            bounds = np.where(q > 0, q * up, -q * down)
            by = np.argsort(bounds)
            sums = np.cumsum(bounds[by])
            least = best[-1] if len(best) == k else None
            cut = 0 if least is None else int(np.searchsorted(sums, least, side="left"))
            if cut == width:
                continue
            essential = by[cut:]
            rest = sums[cut - 1] if cut else 0
            score = v[:, essential] @ q[essential] if cut else v @ q
            alive = np.flatnonzero(names != own) if least is None else np.flatnonzero((score + rest >= least) & (names != own))
            score = score[alive]
            while cut and len(alive):
                low = max(0, cut - chunk)
                terms = by[low:cut]
                score = score + v[np.ix_(alive, terms)] @ q[terms]
                cut, rest = low, sums[low - 1] if low else 0
                keep = score + rest >= least
                alive, score = alive[keep], score[keep]
            if len(alive):
                best_ids, best = np.concatenate((best_ids, names[alive])), np.concatenate((best, score))
                top = np.lexsort((best_ids, -best))[:k]
                best_ids, best = best_ids[top], best[top]
        out += [(int(own), int(key), int(i), int(s)) for i, s in zip(best_ids, best, strict=True)]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 4096, query_rows: int = 2048) -> DataFrame:
    """The k rows of `vectors` with the highest inner product for each row of `queries`, the query's own id excepted.

    Components are floor(256 * x). Returns `query_id`, `rank` (from 1), `vec_id` and `score`; fewer than k rows if there are fewer candidates.
    Vectors that are null, empty or hold null or non-finite components take no part, nor do rows without id; a shorter vector ends in zeros. Rows that repeat an id
    are candidates and queries of their own: each query row has its list, without the rows of its id; equal rows follow each other. Scores are exact up to 63 bits. Blocks of queries meet shards of vectors, both of
    bounded size, so each vector is sent once per block of queries; other columns are not carried.
    """
    base = stored(quantised(vectors, id_col, vector_col), "top-vectors")
    asked = stored(quantised(queries, id_col, vector_col), "top-queries")
    n, m = base.agg(F.coalesce(F.sum(F.least("copies", F.lit(k))), F.lit(0))).first()[0], asked.count()
    width = max(x.agg(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0] for x in (base, asked))
    shards, blocks = -(-n // shard_rows) or 1, -(-m // query_rows) or 1
    parts_of = lambda c, count: F.pmod(F.xxhash64("id", "v", c), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    # No list has more than k copies of a row, and all copies of a query have the same list.
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k))))
    left = base.select("id", "v", copies.alias("copy")).select("id", "v", parts_of("copy", shards).alias("shard"), every(blocks).alias("block"))
    right = asked.select("id", "v", "copies", F.xxhash64("v").alias("key"), parts_of(F.lit(0), blocks).alias("block"))
    sent = right.select("id", "v", "key", "block", every(shards).alias("shard"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            found = max_score(_matrix(b.column("v"), width), b.column("id").to_numpy(), b.column("key").to_numpy(), _matrix(a.column("v"), width), a.column("id").to_numpy(), k)
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "key", "vec_id", "score"])

    best = left.groupBy("block", "shard").cogroup(sent.groupBy("block", "shard")).applyInArrow(run, "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    lists = best.withColumn("rank", rank).where(F.col("rank") <= k)
    several = right.where("copies > 1").select(F.col("id").alias("query_id"), "key", "copies")
    lists = lists.join(several, ["query_id", "key"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1)))))
    return lists.select("query_id", "rank", "vec_id", "score")
