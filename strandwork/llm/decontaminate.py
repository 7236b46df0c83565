"""Benchmark decontamination by the q-gram lemma in diagonal bands, verified by banded alignment.

An item of m characters that occurs with at most e edits shares at least m - q + 1 - q * e q-grams with the text, all of them on
diagonals (place in the text minus place in the item) that lie within e of each other. Shared q-grams are counted in bands of 2 (e + 1)
diagonals, each overlapping the next by half, so one band holds them all. Bands that reach the bound are aligned. The text never
leaves its task: items are indexed in blocks of bounded size and each block passes over the documents once.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, code_points, flat, inside, mixed, pieces

_TABLE = 22


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points with A-Z lower-cased and ASCII white space as a space, the first of each text, and each one's first byte."""
    data, offsets = flat(texts, lower=True)
    lead, code = code_points(data, offsets)
    code[(code >= 9) & (code <= 13)] = 32
    return code, np.searchsorted(lead, offsets), lead


def rolled(values: np.ndarray, q: int, factor: int = 0x01000193) -> np.ndarray:
    """A 32-bit hash of each q consecutive values, by doubling."""
    h = values.astype(np.uint32) * np.uint32(0x9E3779B1)
    out, have, power = h, 1, factor
    for bit in bin(q)[3:]:
        out = out[:max(0, len(out) - have)] * np.uint32(power) + out[have:]
        have, power = 2 * have, power * power % 2**32
        if bit == "1":
            size = max(0, len(out) - 1)
            out = out[:size] * np.uint32(factor) + h[have:have + size]
            have, power = have + 1, power * factor % 2**32
    return out


class Index:
    """q-grams of items that all allow at least one shared q-gram within their budget of `error` edits a character."""

    def __init__(self, texts: list[str], q: int, error: float):
        self.q = q
        self.code, self.first, _ = folded(pa.array(texts, pa.string()))
        self.lengths = np.diff(self.first)
        self.edits = (self.lengths * error).astype(np.int64)
        self.needed = self.lengths - q + 1 - q * self.edits
        at, _ = inside(self.first, q)
        grams = self._exact(self.code, at)
        item = np.searchsorted(self.first, at, side="right") - 1
        order = np.argsort(grams, kind="stable")
        self.grams, begins = np.unique(grams[order], return_index=True)
        self.begins = np.append(begins, len(order))
        self.item, self.place = item[order], (at - self.first[item])[order]
        self.seen = np.zeros(1 << _TABLE, dtype=bool)
        self.seen[rolled(self.code, q)[at] >> np.uint32(32 - _TABLE)] = True

    def _exact(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """64-bit hashes of the q-grams at some places."""
        g = np.zeros(len(at), dtype=U64)
        for j in range(self.q):
            g = g * U64(0x9E3779B97F4A7C15) + mixed(code[at + j].astype(U64))
        return g

    def candidates(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and lowest diagonal of each band that reaches the bound, and whether the item stands there as it is (then on that diagonal)."""
        none = np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.seen[rolled(code, self.q) >> np.uint32(32 - _TABLE)])
        text = np.searchsorted(first, at, side="right") - 1
        keep = at + self.q <= first[text + 1]
        at, text = at[keep], text[keep]
        if not len(at) or not len(self.grams):
            return none, none, none, none.astype(bool)
        grams = self._exact(code, at)
        slot = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[slot] == grams
        slot, at, text = slot[hit], at[hit], text[hit]
        counts = self.begins[slot + 1] - self.begins[slot]
        flatten = np.arange(counts.sum()) + np.repeat(self.begins[slot] - (np.cumsum(counts) - counts), counts)
        text = np.repeat(text, counts)
        item = self.item[flatten]
        diagonal = np.repeat(at, counts) - first[text] - self.place[flatten]
        # All q-grams of an item on one diagonal: it stands there as it is.
        t, i, d, n = _counted(text, item, diagonal)
        whole = n >= self.lengths[i] - self.q + 1
        t, i, d = t[whole], i[whole], d[whole]
        done = np.unique(t * len(self.lengths) + i)
        rest = ~np.isin(text * len(self.lengths) + item, done)
        text, item, diagonal = text[rest], item[rest], diagonal[rest]
        width = self.edits[item] + 1
        band = diagonal // width
        t2, i2, b2, n2 = _counted(np.tile(text, 2), np.tile(item, 2), np.concatenate([band, band - 1]))
        enough = n2 >= self.needed[i2]
        t2, i2, b2 = t2[enough], i2[enough], b2[enough]
        exact = np.arange(len(t) + len(t2)) < len(t)
        return np.concatenate([t, t2]), np.concatenate([i, i2]), np.concatenate([d, b2 * (self.edits[i2] + 1)]), exact

    def aligned(self, code: np.ndarray, first: np.ndarray, text: np.ndarray, item: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of each item in its text within its band, and the end of the best place; all candidates step together."""
        best, end = np.full(len(text), 1 << 30), np.zeros(len(text), dtype=np.int64)
        order = np.argsort(self.lengths[item], kind="stable")
        for part in np.array_split(order, -(-len(order) // 2048)) if len(order) else []:
            one, base, size = item[part], first[text[part]][:, None], np.diff(first)[text[part]][:, None]
            edits, length = self.edits[one], self.lengths[one]
            diagonals = np.arange(4 * int(edits.max()) + 2, dtype=np.int64)
            start = (low[part] - edits)[:, None]
            far = np.int64(1 << 20)
            outside = diagonals >= (4 * edits + 2)[:, None]
            place = start + diagonals
            cost = np.where((place < 0) | (place > size) | outside, far, 0)
            live = 0
            for i in range(int(length.max())):
                # Candidates are in order of length: those whose item has ended give their result and go.
                stop = int(np.searchsorted(length, i, side="right"))
                if stop > live:
                    self._ended(cost[:stop - live], start[live:stop], length[live:stop], part[live:stop], best, end)
                    cost, live = cost[stop - live:], stop
                sign = self.code[self.first[one[live:]] + i][:, None]
                j = start[live:] + diagonals + i
                there = (j >= 0) & (j < size[live:])
                same = code[np.clip(base[live:] + j, 0, len(code) - 1)] == sign
                step = np.where(there, cost + ~same, far)
                step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
                # A place outside the text or the band cannot be reached.
                barred = (j < -1) | (j >= size[live:]) | outside[live:]
                step[barred] = far
                cost = np.minimum.accumulate(step - diagonals, axis=1) + diagonals
                cost[barred] = far
            self._ended(cost, start[live:], length[live:], part[live:], best, end)
        return best, end

    @staticmethod
    def _ended(cost: np.ndarray, start: np.ndarray, length: np.ndarray, part: np.ndarray, best: np.ndarray, end: np.ndarray) -> None:
        least = cost.argmin(axis=1)
        best[part] = cost[np.arange(len(part)), least]
        end[part] = start[:, 0] + least + length

    def found(self, texts: pa.Array) -> list[dict[int, tuple[int, int]]]:
        """For each text the items that it holds: edits and the end of the place, in characters."""
        code, first, _ = folded(texts)
        out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(texts))]
        text, item, low, exact = self.candidates(code, first)
        edits, end = np.zeros(len(text), dtype=np.int64), low + self.lengths[item]
        edits[~exact], end[~exact] = self.aligned(code, first, text[~exact], item[~exact], low[~exact])
        for t, i, e, z in zip(text.tolist(), item.tolist(), edits.tolist(), end.tolist(), strict=True):
            if e <= self.edits[i] and (i not in out[t] or (e, z) < out[t][i]):
                out[t][i] = (e, z)
        return out


class Block:
    """A block of items, indexed by the longest grams up to `q` of which a place within the budget must share one: m >= q * (budget + 1)."""

    def __init__(self, ids: list[int], texts: list[str], q: int, error: float):
        sizes = np.diff(folded(pa.array(texts, pa.string()))[1])
        grams = np.minimum(sizes // ((sizes * error).astype(np.int64) + 1), q)
        self.ids, self.parts = ids, []
        for size in np.unique(grams[grams > 0]).tolist():
            own = np.flatnonzero(grams == size)
            self.parts.append((own, Index([texts[i] for i in own], size, error)))

    def found(self, texts: pa.Array) -> list[dict[int, tuple[int, int]]]:
        out: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(texts))]
        for own, index in self.parts:
            for all_, some in zip(out, index.found(texts), strict=True):
                all_.update((int(own[i]), x) for i, x in some.items())
        return out


def _counted(*columns: np.ndarray) -> list[np.ndarray]:
    """Distinct rows of the columns, sorted, and how often each occurs. The columns are packed into one number, which is sorted."""
    if not len(columns[0]):
        return [*columns, np.zeros(0, dtype=np.int64)]
    lows = [int(c.min()) for c in columns]
    spans = [int(c.max()) - low + 1 for c, low in zip(columns, lows, strict=True)]
    room = 1
    for span in spans:
        room *= span
    if room >= 2**62:
        rows, counts = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
        return [*rows.T, counts]
    key = np.zeros(len(columns[0]), dtype=np.int64)
    for c, low, span in zip(columns, lows, spans, strict=True):
        key = key * span + (c - low)
    key, counts = np.unique(key, return_counts=True)
    out = []
    for low, span in zip(reversed(lows), reversed(spans), strict=True):
        out.append(key % span + low)
        key = key // span
    return [*reversed(out), counts]


def blocks_of(benchmark: DataFrame, block_chars: int, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of about `block_chars` characters; the driver holds one block. Null texts and null ids are left out."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL").distinct()
    chars = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    count = -(-chars // block_chars)
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k).orderBy("id", "text").collect()
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows]


def contamination(docs: DataFrame, benchmark: DataFrame, q: int = 8, error: float = 0.1, block_chars: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: the id column, `contaminated`, and arrays `item_ids`, `edits` and `ends`.

    An item of m characters is found where it occurs with at most error * m edits (characters inserted, deleted or replaced), rounded down, after
    lower-casing A-Z and taking each ASCII white space as a space; `ends` is where its best place ends, in characters. Items too short for grams of q characters
    are found by shorter ones, down to one character; an empty item is never found. Null and empty texts hold nothing; ids may be null or repeat; other columns are not carried.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"), F.expr("cast(array() as array<struct<item:bigint,edits:bigint,end:bigint>>)").alias("found_"))
    schema = f"id_ {kind}, text_ string, found_ array<struct<item:bigint,edits:bigint,end:bigint>>"
    for ids, texts in blocks_of(benchmark, block_chars, item_col, item_text_col):

        def run(batches: Iterator[pa.RecordBatch], ids=ids, texts=texts) -> Iterator[pa.RecordBatch]:
            index = Block(ids, texts, q, error)
            for batch in batches:
                for part in pieces(batch, 1, 1 << 20):
                    more = [[{"item": ids[i], "edits": e, "end": z} for i, (e, z) in sorted(x.items())] for x in index.found(part.column(1))]
                    if any(more):
                        own = pa.array([a + b for a, b in zip(part.column(2).to_pylist(), more, strict=True)], part.column(2).type)
                    else:
                        own = part.column(2)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), own], ["id_", "text_", "found_"])

        rows = rows.mapInArrow(run, schema)
    found = F.array_sort("found_")
    return rows.select(F.col("id_").alias(id_col), (F.size("found_") > 0).alias("contaminated"), found["item"].alias("item_ids"), found["edits"].alias("edits"), found["end"].alias("ends"))


def clean(docs: DataFrame, benchmark: DataFrame, q: int = 8, error: float = 0.1, block_chars: int = 1 << 20, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all columns, that hold no item of `benchmark`."""
    for ids, texts in blocks_of(benchmark, block_chars, "item_id", "text"):
        docs = docs.where(_free(ids, texts, q, error)(F.col(text_col).cast("string")))
    return docs


def _free(ids: list[int], texts: list[str], q: int, error: float):
    """A column function that tells whether a text holds none of the items; they are indexed once in a worker's task."""
    made: list[Block] = []

    @F.arrow_udf("boolean")
    def free(column: pa.Array) -> pa.Array:
        if not made:
            made.append(Block(ids, texts, q, error))
        rows = pa.RecordBatch.from_arrays([column], ["text"])
        return pa.array([not x for part in pieces(rows, 0, 1 << 20) for x in made[0].found(part.column(0))], pa.bool_())

    return free
