"""Best-window scores, pairwise alignment and consensus."""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S

# The Arrow function travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# DNA alignment scores.
MATCH, MISMATCH, GAP = 2, -1, -2


def _scorer(text, ref: str):
    def score(i):
        terms = [F.when((F.length(text) >= i + j) & ~S.fits(text, i + j, c), 1).otherwise(0) for j, c in enumerate(ref)]
        return F.struct(S.total(terms).alias("best_mm"), i.alias("best_at"))

    return score


# M14
def best_windows(targets: DataFrame, references: dict[str, str], seq: str = "target_seq") -> DataFrame:
    """Fewest IUPAC mismatches of each reference over all windows of each target, leftmost on ties.

    A target shorter than the reference is compared over its own length. The windows of one
    target are ranked inside its row, so no shuffle is needed. References that a filter leaves out are not scored.
    """
    text, on = F.col(seq).cast("binary"), F.col("reference")
    named, best = [], []
    for name, raw in references.items():
        ref = S.check_pattern(raw)
        last = F.greatest(F.length(text) - (len(ref) - 1), F.lit(1))
        named.append(F.struct(F.lit(name).alias("reference"), F.lit(ref).alias("ref_seq")))
        best.append((on == name, F.array_min(F.transform(F.sequence(F.lit(1), last), _scorer(text, ref)))))
    # Scores come after the references, so that a filter on these comes first.
    rows = targets.select(*targets.columns, F.inline(F.array(*named))).withColumn("_best", S.by_case(best))
    return rows.select(
        *targets.columns, "reference", "ref_seq", F.col("_best.best_mm").alias("best_mm"), F.col("_best.best_at").alias("best_at"),
    ).withColumn("best_window", F.substring(F.col(seq), F.col("best_at"), F.length("ref_seq")))


# W3
def top_targets(scored: DataFrame, n: int = 100, name: str = "name") -> DataFrame:
    """The n best targets of each reference by (mismatches, name in text order).

    `row_number() <= n` lets Spark keep n rows per reference in every task before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("reference").orderBy("best_mm", name)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


# Cells of the tables held at once: 64 MB of int32, or 16 MB of moves.
_CELLS = 1 << 24
# Cells of one row of all pairs of a group; a few such rows stay in a core's cache.
_ROW = 1 << 16


def _padded(texts: list[str], fill: int) -> np.ndarray:
    width = max(1, *map(len, texts))
    flat = b"".join(t.encode().ljust(width, bytes([fill])) for t in texts)
    return np.frombuffer(flat, dtype=np.uint8).reshape(len(texts), width)


def _align_group(a: list[str], b: list[str]) -> list[tuple[str, str, int]]:
    """Align many pairs at once: every step works on one row (or one move) of all of them.

    Pairs lie side by side along the last axis. Two rows of scores and the moves (0 diagonal, 1 up, 2 left) are all that is held.
    """
    x, y = (np.ascontiguousarray(_padded(t, f).T) for t, f in ((a, 0), (b, 1)))
    (n, count), m = x.shape, y.shape[0]
    # The slope is taken out of scores of at most MATCH a letter.
    kind = np.int16 if 4 * (n + m + 1) < 1 << 15 else np.int32
    slope = (np.arange(m + 1) * GAP).astype(kind)[:, None]
    len_a, len_b, r = np.array([len(t) for t in a]), np.array([len(t) for t in b]), np.arange(count)
    score = np.zeros(count, dtype=np.int64)
    above = np.repeat(slope, count, axis=1)
    row = np.empty_like(above)
    moves = np.empty((n + 1, m + 1, count), dtype=np.uint8)
    moves[0], moves[1:, 0] = 2, 1
    for i in range(n + 1):
        if i:
            step = (y == x[i - 1]).astype(kind)
            step *= MATCH - MISMATCH
            step += MISMATCH
            step += above[:-1]
            up = above[1:] + kind(GAP)
            row[0] = i * GAP
            np.maximum(step, up, out=row[1:])
            # A run of gaps in `a` is a running maximum once the gap slope is taken out.
            row -= slope
            np.maximum.accumulate(row, axis=0, out=row)
            row += slope
            other = row[1:] != step
            np.add(other, other & (row[1:] != up), out=moves[i, 1:], dtype=np.uint8)
            above, row = row, above
        ends = np.flatnonzero(len_a == i)
        score[ends] = above[len_b[ends], ends]
    flat, letters_a, letters_b = moves.reshape(-1), x.reshape(-1), y.reshape(-1)
    # Places in the flat tables; a step in `a` or `b` is a fixed stride.
    i, j = len_a * count, len_b * count
    top = np.full((n + m, count), ord("-"), dtype=np.uint8)
    bottom = top.copy()
    used = np.zeros(count, dtype=np.int64)
    at = n + m
    while True:
        live = (i > 0) | (j > 0)
        if not live.any():
            break
        at -= 1
        used += live
        move = flat[i * (m + 1) + j + r]
        in_a, in_b = live & (move != 2), live & (move != 1)
        i -= in_a * count
        j -= in_b * count
        np.copyto(top[at], letters_a[np.minimum(i + r, n * count - 1)], where=in_a)
        np.copyto(bottom[at], letters_b[np.minimum(j + r, m * count - 1)], where=in_b)
    end = n + m
    top, bottom = np.ascontiguousarray(top.T), np.ascontiguousarray(bottom.T)
    return [
        (top[k, end - used[k]:].tobytes().decode(), bottom[k, end - used[k]:].tobytes().decode(), int(score[k]))
        for k in range(count)
    ]


def _next_row(above: np.ndarray, letter: int, y: np.ndarray, slope: np.ndarray) -> np.ndarray:
    row = np.empty_like(above)
    row[0] = above[0] + GAP
    row[1:] = np.maximum(above[:-1] + np.where(y == letter, MATCH, MISMATCH), above[1:] + GAP)
    row -= slope
    np.maximum.accumulate(row, out=row)
    row += slope
    return row


def _trace(x: np.ndarray, y: np.ndarray, top: np.ndarray) -> tuple[list[int], int]:
    """Moves (0 diagonal, 1 up, 2 left) from the last cell up to the row `top`, and the column where that is met.

    A table of up to `_CELLS` cells is held whole. A larger one keeps the rows at 16 cuts only and is traced strip by strip from the last, each computed
    again from the row above it and only as wide as the path has come, so memory grows with the width and not with the product.
    """
    slope = np.arange(len(y) + 1, dtype=np.int32) * GAP
    if len(x) > 1 and (len(x) + 1) * (len(y) + 1) > _CELLS:
        cuts = np.unique(np.linspace(0, len(x), min(len(x), 16) + 1).astype(np.int64))
        rows, row = [top], top
        for a, b in zip(cuts[:-2], cuts[1:-1]):
            for letter in x[a:b]:
                row = _next_row(row, letter, y, slope)
            rows.append(row)
        moves: list[int] = []
        j = len(y)
        for k in range(len(rows) - 1, -1, -1):
            part, j = _trace(x[cuts[k]:cuts[k + 1]], y[:j], rows[k][:j + 1])
            moves += part
        return moves, j
    table = np.empty((len(x) + 1, len(y) + 1), dtype=np.int32)
    table[0] = top
    for i, letter in enumerate(x):
        table[i + 1] = _next_row(table[i], letter, y, slope)
    moves, i, j = [], len(x), len(y)
    while i > 0:
        here = table[i, j]
        if j > 0 and here == table[i - 1, j - 1] + (MATCH if x[i - 1] == y[j - 1] else MISMATCH):
            moves.append(0)
            i, j = i - 1, j - 1
        elif j == 0 or here == table[i - 1, j] + GAP:
            moves.append(1)
            i -= 1
        else:
            moves.append(2)
            j -= 1
    return moves, j


def _align_long(a: str, b: str) -> tuple[str, str, int]:
    """The alignment of `_align_group` for one pair whose table is too large to hold."""
    x, y = (np.frombuffer(t.encode(), dtype=np.uint8) for t in (a, b))
    moves, j = _trace(x, y, np.arange(len(y) + 1, dtype=np.int32) * GAP)
    way = np.array(moves + [2] * j, dtype=np.uint8)[::-1]
    top, bottom = np.full(len(way), ord("-"), dtype=np.uint8), np.full(len(way), ord("-"), dtype=np.uint8)
    top[way != 2], bottom[way != 1] = x, y
    score = int(np.where(way != 0, GAP, np.where(top == bottom, MATCH, MISMATCH)).sum())
    return top.tobytes().decode(), bottom.tobytes().decode(), score


def _align_all(a: list[str], b: list[str]) -> list[tuple[str, str, int]]:
    """Pairs of similar length go together; a group stays within `_CELLS` and its rows within `_ROW`, and a pair beyond the former goes alone."""
    order = sorted(range(len(a)), key=lambda k: (len(a[k]), len(b[k])))
    out: list = [None] * len(a)
    group: list[int] = []
    wide = 0
    for k in order:
        if (len(a[k]) + 1) * (len(b[k]) + 1) > _CELLS:
            out[k] = _align_long(a[k], b[k])
            continue
        reach = max(wide, len(b[k]))
        row = (len(group) + 1) * (reach + 1)
        if group and (row * (len(a[k]) + 1) > _CELLS or row > _ROW):
            for g, res in zip(group, _align_group([a[g] for g in group], [b[g] for g in group])):
                out[g] = res
            group, reach = [], len(b[k])
        group.append(k)
        wide = reach
    if group:
        for g, res in zip(group, _align_group([a[g] for g in group], [b[g] for g in group])):
            out[g] = res
    return out


_ALIGNED = T.StructType([
    T.StructField("aligned_a", T.StringType()), T.StructField("aligned_b", T.StringType()),
    T.StructField("score", T.IntegerType())])


@F.pandas_udf(_ALIGNED)
def _align_batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(_align_all(list(a), list(b)), columns=["aligned_a", "aligned_b", "score"])


# M16
def pairwise_align(pairs: DataFrame, a: str = "seq_a", b: str = "seq_b", spread: int | None = None) -> DataFrame:
    """Global alignment of each row's two sequences; adds aligned_a, aligned_b, score.

    The cost of a row grows with the product of its lengths; its memory only up to `_CELLS` cells, and with the length of `b` beyond that. `spread` shuffles the rows into
    that many round-robin partitions when long pairs are clustered in the input.
    """
    rows = pairs.repartition(spread) if spread else pairs
    return rows.withColumn("_x", _align_batch(F.upper(a), F.upper(b))).select(*pairs.columns, "_x.*")


# M17
def consensus(aligned: DataFrame, group: str = "group_id", seq: str = "aligned_seq") -> DataFrame:
    """Most frequent base per alignment column, ties in A, T, G, C order, gaps ignored."""
    letters = aligned.select(group, F.posexplode(F.split(F.col(seq), "")).alias("at", "base")).where(F.col("base") != "")
    counts = letters.groupBy(group, "at").agg(*[F.count_if(F.col("base") == b).alias(b) for b in "ATGC"])
    most = F.greatest("A", "T", "G", "C")
    picked = counts.select(group, "at", F.when(F.col("A") == most, "A").when(F.col("T") == most, "T")
                           .when(F.col("G") == most, "G").otherwise("C").alias("base"))
    # One element per alignment column, however many rows were aligned.
    cols = F.array_sort(F.collect_list(F.struct("at", "base")))
    return picked.groupBy(group).agg(F.array_join(F.transform(cols, lambda c: c["base"]), "").alias("consensus"))
