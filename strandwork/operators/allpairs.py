"""Walks from all nodes of a graph at once, in the memory of each task.

The work of these is nodes x edges, so a graph for which it can end at all is small itself: every task holds the edges and takes blocks of sources
(or slices of the sketches), and no state of a pair ever reaches a disk. Neighbours of a row of bits or registers are merged in numpy.
"""
from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The Arrow functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Levels (source x node) of a block of shortest paths, bytes of a row of bits or registers, and rows merged at once.
CELLS, WIDE, ROWS = 1 << 24, 128, 4096
#: Neighbours that are merged side by side; those of a node with more are merged one node at a time.
SLOTS = 64
#: Levels of a sketch that a task holds at once, and nodes in a row of its results.
LEVELS, PART = 32, 1024


class Graph(NamedTuple):
    """Neighbours near[first[v]:first[v + 1]] of each place v, most neighbours first, and the node number that has this place."""

    first: np.ndarray
    near: np.ndarray
    no: np.ndarray

    def edges_of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in `near` of the edges of `rows`, where each row's begin among them, and their numbers."""
        many = self.first[rows + 1] - self.first[rows]
        begin = np.cumsum(many) - many
        at = np.arange(int(many.sum()))
        at += np.repeat(self.first[rows] - begin, many)
        return at, begin, many

    def touched(self, rows: np.ndarray) -> np.ndarray:
        """Places next to any of `rows`, ascending."""
        if len(rows) * 8 >= len(self.no):
            return np.arange(len(self.no))
        mark = np.zeros(len(self.no), dtype=bool)
        mark[self.near[self.edges_of(rows)[0]]] = True
        return np.flatnonzero(mark)


def hold(both: DataFrame, size: int) -> Graph:
    """The edges (src, dst) between numbers below `size`, both ways, with 4 bytes an edge and 12 a node."""
    table = both.select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst")).toArrow()
    src, dst = (table[c].to_numpy() for c in ("src", "dst"))
    many = np.bincount(src, minlength=size)
    no = np.argsort(-many, kind="stable").astype(np.int32)
    place = np.empty(size, dtype=np.int32)
    place[no] = np.arange(size, dtype=np.int32)
    src, dst = place[src], place[dst]
    first = np.concatenate(([0], np.cumsum(many[no])))
    return Graph(first, dst[np.lexsort((dst, src))], no)


def _sent(spark: SparkSession, graph: Graph) -> Broadcast:
    """A broadcast holds plain arrays, since workers have no classes of this package."""
    return spark.sparkContext.broadcast(tuple(graph))


def _opened(held: Broadcast) -> Graph:
    first, near, no = held.value
    return Graph(first, near.astype(np.intp), no)


def _at(values: np.ndarray, places: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Rows of `values` at `places`, which are known to be within it: without a check for that, numpy copies them several times as fast."""
    return np.take(values, places, axis=0, out=out, mode="clip")


def _merged(merge: np.ufunc, state: np.ndarray, g: Graph, rows: np.ndarray) -> np.ndarray:
    """Rows of `state` merged with those of their neighbours. `rows` ascend."""
    out, room = _at(state, rows), np.empty((len(rows), *state.shape[1:]), dtype=state.dtype)
    many, begin = g.first[rows + 1] - g.first[rows], g.first[rows]
    for j in range(min(int(many[0]), SLOTS)):
        k = int(np.searchsorted(-many, -j))
        merge(out[:k], _at(state, _at(g.near, begin[:k] + j), room[:k]), out=out[:k])
    for i in range(int(np.searchsorted(-many, -SLOTS))):
        for b in range(int(begin[i]) + SLOTS, int(begin[i] + many[i]), ROWS):
            merge(out[i], merge.reduce(_at(state, g.near[b:min(b + ROWS, int(begin[i] + many[i]))]), axis=0), out=out[i])
    return out


def _rounds(max_depth: int | None) -> Iterator[int]:
    d = 1
    while max_depth is None or d <= max_depth:
        yield d
        d += 1


def _levels(g: Graph, sources: np.ndarray, max_depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(d, rows, bits): the places that some sources, a bit each, reach first after d steps, some places at a time.

    Bits of all sources within d steps are united with the neighbours', and change when the whole level is known.
    """
    b = np.arange(len(sources))
    ball = np.zeros((len(g.no), -(-len(sources) // 64)), dtype=np.uint64)
    np.bitwise_or.at(ball, (sources, b >> 6), np.uint64(1) << (b & 63).astype(np.uint64))
    fresh = np.empty_like(ball)
    left, grew = np.full(len(g.no), len(sources)), sources
    left[sources] -= 1
    for d in _rounds(max_depth):
        rows, found = g.touched(grew), []
        rows = rows[_at(left, rows) > 0]
        for a in range(0, len(rows), ROWS):
            these = rows[a:a + ROWS]
            bits = np.bitwise_xor(_merged(np.bitwise_or, ball, g, these), _at(ball, these), out=fresh[a:a + ROWS][:len(these)])
            many = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            left[these] -= many
            found.append(these[many > 0])
            if len(found[-1]):
                yield d, found[-1], bits if len(found[-1]) == len(these) else bits[many > 0]
        for a in range(0, len(rows), ROWS):
            ball[rows[a:a + ROWS]] ^= fresh[a:a + ROWS][:len(rows) - a]
        grew = np.concatenate(found) if found else rows
        if not len(grew):
            break


def _near_block(g: Graph, sources: np.ndarray, max_depth: int | None) -> np.ndarray:
    """The sum of 1/distance of each place to `sources`."""
    out = np.zeros(len(g.no))
    for d, rows, bits in _levels(g, sources, max_depth):
        out[rows] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64) / d
    return out


def _path_block(g: Graph, sources: np.ndarray, max_depth: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(betweenness, closeness) of each place as far as `sources` give them.

    Levels of all sources are found together. For each source then, the edges from one level to the next are sorted by level; numbers of paths
    go forth along them, and shares come back along the same.
    """
    n, out, close = len(g.no), np.zeros(len(g.no)), np.zeros(len(g.no))
    # A level counts from 1 at the source; 0 is out of reach.
    level = np.zeros((n, 64 * -(-len(sources) // 64)), dtype=np.uint8)
    level[sources, np.arange(len(sources))] = 1
    for d, rows, bits in _levels(g, sources, max_depth):
        if d == 254 and level.dtype == np.uint8:
            level = level.astype(np.int32)
        level[rows] += np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little") * level.dtype.type(d + 1)
        close[rows] += np.bitwise_count(bits).sum(axis=1, dtype=np.int64) / d
    many = np.diff(g.first)
    mine = np.repeat(np.arange(n), many)
    for source, mark in zip(sources, np.ascontiguousarray(level.T)):
        here = _at(mark, g.near)
        edge = np.flatnonzero((np.repeat(mark, many) - here == 1) & (here > 0))
        here = _at(here, edge)
        edge = _at(edge, np.argsort(here, kind="stable"))
        u, v, ends = _at(g.near, edge), _at(mine, edge), np.cumsum(np.bincount(here))
        paths, share = np.zeros(n), np.zeros(n)
        paths[source] = 1.0
        for a, b in zip(ends[:-1], ends[1:]):
            np.add.at(paths, v[a:b], _at(paths, u[a:b]))
        each = np.divide(1.0, paths, out=np.zeros(n), where=paths > 0)
        for a, b in zip(ends[-2::-1], ends[:0:-1]):
            np.add.at(share, u[a:b], _at(share, v[a:b]) + _at(each, v[a:b]))
        share *= paths
        share[source] = 0.0
        out += share
    return out, close


def _rows(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for a in range(0, size, 1 << 16):
        yield pa.RecordBatch.from_pydict({c: v[a:a + (1 << 16)] for c, v in columns.items()})


def _tasks(spark: SparkSession, blocks: int, waves: int) -> DataFrame:
    tasks = max(1, min(blocks, waves * spark.sparkContext.defaultParallelism))
    return spark.range(0, tasks, 1, tasks).select("id", F.lit(tasks).alias("tasks"))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def betweenness(spark: SparkSession, graph: Graph, sources: np.ndarray, max_depth: int | None) -> DataFrame:
    """(no, betweenness, closeness) as far as the node numbers `sources` give them, a row for each task and node."""
    block = 64 * max(1, min(8, CELLS // (64 * len(graph.no))))
    held, numbers = _sent(spark, graph), spark.sparkContext.broadcast(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _opened(held)
        starts = np.flatnonzero(np.isin(g.no, numbers.value))
        for task, tasks in _numbers(batches):
            mine, out, close = starts[task::tasks], np.zeros(len(g.no)), np.zeros(len(g.no))
            for a in range(0, len(mine), block):
                got = _path_block(g, mine[a:a + block], max_depth)
                out += got[0]
                close += got[1]
            yield from _rows({"no": g.no.astype(np.int64), "betweenness": out, "closeness": close})

    return _tasks(spark, -(-len(sources) // 64), 4).mapInArrow(run, "no long, betweenness double, closeness double")


def closeness(spark: SparkSession, graph: Graph, max_depth: int | None) -> DataFrame:
    """(no, closeness) of all nodes, a row for each task and node."""
    held = _sent(spark, graph)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _opened(held)
        for task, tasks in _numbers(batches):
            mine, out = np.arange(task, len(g.no), tasks), np.zeros(len(g.no))
            for a in range(0, len(mine), 8 * WIDE):
                out += _near_block(g, mine[a:a + 8 * WIDE], max_depth)
            yield from _rows({"no": g.no.astype(np.int64), "closeness": out})

    return _tasks(spark, -(-len(graph.no) // (8 * WIDE)), 4).mapInArrow(run, "no long, closeness double")


def _changes(g: Graph, state: np.ndarray, max_depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(d, rows, sums, zeros): how the registers of the nodes within d steps change the sum of 2^-register over those in use, and the number of those that are not.

    Registers take the highest of the neighbours', and change when the whole level is known. Depth 0 has the nodes themselves.
    """
    worth = np.concatenate(([0.0], 0.5 ** np.arange(1, 256)))
    fresh = np.empty_like(state)
    sums, zeros = np.empty(len(g.no)), np.empty(len(g.no), dtype=np.int32)
    grew = every = np.arange(len(g.no))
    for a in range(0, len(every), ROWS):
        sums[a:a + ROWS], zeros[a:a + ROWS] = _at(worth, state[a:a + ROWS]).sum(axis=1), (state[a:a + ROWS] == 0).sum(axis=1)
    yield 0, every, sums.copy(), zeros.copy()
    for d in _rounds(max_depth):
        rows, found = g.touched(grew), []
        for a in range(0, len(rows), ROWS):
            these = rows[a:a + ROWS]
            got = fresh[a:a + ROWS][:len(these)]
            got[:] = _merged(np.maximum, state, g, these)
            more = np.flatnonzero((got != _at(state, these)).any(axis=1))
            if len(more):
                found.append(these[more])
                s, z = _at(worth, got[more]).sum(axis=1), (got[more] == 0).sum(axis=1, dtype=np.int32)
                yield d, found[-1], s - sums[found[-1]], z - zeros[found[-1]]
                sums[found[-1]], zeros[found[-1]] = s, z
        for a in range(0, len(rows), ROWS):
            state[rows[a:a + ROWS]] = fresh[a:a + ROWS][:len(rows) - a]
        if not found:
            break
        grew = np.concatenate(found)


def _sizes(sums: np.ndarray, zeros: np.ndarray, registers: int, nodes: int) -> np.ndarray:
    """Numbers of distinct nodes by Ertl's estimate; where each node has a register of its own, the registers in use are counted."""
    if nodes <= registers:
        return (registers - zeros).astype(float)
    x = np.arange(registers) / registers
    few, power = x.copy(), 1.0
    while x[-1] > 1e-300:
        x = x * x
        few += x * power
        power *= 2
    return registers * registers / (2 * np.log(2) * (registers * few[np.minimum(zeros, registers - 1)] + sums))


def closeness_by_sketch(spark: SparkSession, graph: Graph, hashes: np.ndarray, max_depth: int | None, log_k: int) -> DataFrame:
    """(no, closeness) of all nodes, estimated from a sketch of 2^`log_k` registers of the nodes within d steps; `hashes` are 64 bits by node number.

    A register depends on the same register of the neighbours only, so tasks take slices of them and give, for each level and node, what its slices add to the
    estimate. Up to as many nodes as registers, each node has its own and the result is exact.
    """
    registers, nodes = 1 << log_k, len(graph.no)
    held, coded = _sent(spark, graph), spark.sparkContext.broadcast(hashes)
    kind = "part int, depth int, levels int, sums binary, zeros binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _opened(held)
        h = coded.value[g.no].view(np.uint64)
        own = g.no.astype(np.int64) if nodes <= registers else (h & np.uint64(registers - 1)).astype(np.int64)
        # The place of the lowest bit that is set, above those that chose the register.
        rest = (h >> np.uint64(log_k)) | np.uint64(1 << (63 - log_k))
        rank = (np.bitwise_count((rest & (~rest + np.uint64(1))) - np.uint64(1)) + 1).astype(np.uint8)

        def given(depth: int, kept: list) -> Iterator[pa.RecordBatch]:
            for a in range(0, nodes, PART):
                sums, zeros = (np.stack([x[i][a:a + PART] for x in kept]) for i in (0, 1))
                yield pa.RecordBatch.from_pydict({"part": pa.array([a // PART], pa.int32()), "depth": pa.array([depth], pa.int32()), "levels": pa.array([len(kept)], pa.int32()),
                                                  "sums": pa.array([sums.tobytes()]), "zeros": pa.array([zeros.tobytes()])})

        for task, tasks in _numbers(batches):
            # Most graphs end within LEVELS, and all slices of a task are added up before any is given.
            base, kept = 0, []
            for low in range(task * WIDE, registers, tasks * WIDE):
                wide = min(WIDE, registers - low)
                state, own_here = np.zeros((nodes, wide), dtype=np.uint8), np.flatnonzero((own >= low) & (own < low + wide))
                state[own_here, own[own_here] - low] = rank[own_here]
                for d, rows, sums, zeros in _changes(g, state, max_depth):
                    if not base <= d < base + LEVELS:
                        yield from given(base, kept)
                        base, kept = d // LEVELS * LEVELS, []
                    while len(kept) <= d - base:
                        kept.append((np.zeros(nodes), np.zeros(nodes, dtype=np.int32)))
                    kept[d - base][0][rows] += sums
                    kept[d - base][1][rows] += zeros
            yield from given(base, kept)

    def combine(part: pa.Table) -> pa.Table:
        a = part["part"][0].as_py() * PART
        no = held.value[2][a:a + PART]
        deep = max(d + n for d, n in zip(part["depth"].to_pylist(), part["levels"].to_pylist()))
        sums, zeros = np.zeros((deep, len(no))), np.zeros((deep, len(no)), dtype=np.int64)
        for row in part.to_pylist():
            here = slice(row["depth"], row["depth"] + row["levels"])
            sums[here] += np.frombuffer(row["sums"]).reshape(-1, len(no))
            zeros[here] += np.frombuffer(row["zeros"], dtype=np.int32).reshape(-1, len(no))
        size = _sizes(np.cumsum(sums, axis=0), np.cumsum(zeros, axis=0), registers, nodes)
        size[0] = 1.0
        more = np.diff(np.maximum.accumulate(size, axis=0), axis=0)
        return pa.table({"no": no.astype(np.int64), "closeness": (more / np.arange(1, deep)[:, None]).sum(axis=0)})

    return _tasks(spark, -(-registers // WIDE), 1).mapInArrow(run, kind).groupBy("part").applyInArrow(combine, "no long, closeness double")
