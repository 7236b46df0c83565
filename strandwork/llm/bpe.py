"""Byte-level BPE: a segment tree over byte positions keeps the leftmost pair of minimum rank.

Each position of a piece is a leaf that holds the rank of the pair which begins there, and the root is the next merge. A
merge changes the leaves of its two live neighbours and of the position that went, each by one walk to the root, so a piece
of n bytes takes O(n log n) steps. `merge` does this for one long piece, `Codec._merge_short` for all distinct short pieces of
a batch side by side: one tree per row of a matrix, one numpy step per tree level.
"""
from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, flat, pieces, word_hashes

_NONE = np.int32(2**31 - 1)
_SHORT = 64
_LETTER, _NUMBER, _BLANK, _OTHER = 1, 2, 3, 0


@lru_cache(maxsize=4)
def load_ranks(path: str) -> tuple[dict[bytes, int], int]:
    """Ranks by token of a rank file, and the length of the longest token."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return ranks, max(map(len, ranks))


@lru_cache(maxsize=1)
def letter_classes() -> np.ndarray:
    """The class of each code point: letter, number, white space or other."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_BLANK, r"\s")):
        found = "".join(regex.findall(pattern, every))
        kinds[np.frombuffer(found.encode("utf-32-le"), dtype="<u4")] = kind
    return kinds


def merge(piece: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """Token ids of one piece of any length."""
    n = len(piece)
    whole = ranks.get(piece) if n <= longest else None
    if whole is not None:
        return [whole]
    none = int(_NONE)
    get, size = ranks.get, 1 << max(0, (n - 1).bit_length())
    tree = [none] * (2 * size)
    tree[size:size + n - 1] = [get(piece[i:i + 2], none) for i in range(n - 1)]
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    while tree[1] < none:
        least, at = tree[1], 1
        while at < size:
            at *= 2
            if tree[at] != least:
                at += 1
        at -= size
        gone = following[at]
        end = following[at] = following[gone]
        changes = [(gone, none), (at, none)]
        if end < n:
            previous[end] = at
            stop = following[end]
            if stop - at <= longest:
                changes[1] = (at, get(piece[at:stop], none))
        before = previous[at]
        if before >= 0:
            changes.append((before, get(piece[before:end], none) if end - before <= longest else none))
        for leaf, rank in changes:
            leaf += size
            tree[leaf] = rank
            while leaf > 1:
                leaf >>= 1
                tree[leaf] = min(tree[2 * leaf], tree[2 * leaf + 1])
    ids, at = [], 0
    while at < n:
        ids.append(ranks[piece[at:following[at]]])
        at = following[at]
    return ids


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each piece of each text, by the rules of the public pattern, and the number of pieces before each text.

    A piece is a contraction, a run of letters, of numbers or of other signs with one blank before it, or white space. Of
    several blanks before a sign, the last one goes with the sign if it is a space and stands alone if not.
    """
    lead, code = code_points(data, offsets)
    n = len(code)
    edge = np.zeros(n + 1, dtype=bool)
    edge[np.searchsorted(lead, offsets)] = True
    edge[n] = True
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    kind = letter_classes()[code]
    change = edge.copy()
    change[1:n] |= kind[1:] != kind[:-1]
    begin = change[:n].copy()
    # The last blank of a run that a sign follows in the same text begins a piece.
    blank = kind == _BLANK
    last = np.flatnonzero(blank & change[1:] & ~edge[1:])
    begin[last] = True
    # A space takes the sign behind it along.
    begin[last[code[last] == 32] + 1] = False
    # Contractions: an apostrophe that begins a piece, alone among signs, with its letters behind it.
    quote = np.flatnonzero((code[:n - 1] == 39) & begin[:n - 1] & (kind[1:] == _LETTER) & ~edge[1:n])
    if len(quote):
        one = code[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], code[np.minimum(quote + 2, n - 1)], 0)
        length = np.where(np.isin(one, [115, 116, 109, 100]), 2, 0)
        for a, b in ((114, 101), (118, 101), (108, 108)):
            length = np.where((one == a) & (two == b), 3, length)
        short = quote[length > 0]
        begin[short + 1] = False
        stop = short + length[length > 0]
        begin[stop[stop < n]] = True
    at = np.flatnonzero(begin)
    starts = lead[at]
    return starts, np.searchsorted(starts, offsets)


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str, public: bool):
        self.ranks, self.longest = load_ranks(path)
        top = max(self.ranks.values()) + 1
        tokens: list[bytes] = [b""] * top
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.data = np.frombuffer(b"".join(tokens) + bytes(8), dtype=np.uint8)
        hashes = word_hashes(self.data, self.begins, self.begins + self.lengths)
        self.whole_ids = np.argsort(hashes).astype(np.int32)
        self.whole = hashes[self.whole_ids]
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.find = None if public else regex.compile(pattern).finditer
        pairs = [(self.ranks[t[:k]] << 32 | self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        self.bits = max(10, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, _NONE, dtype=np.int32)
        left = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        slots = self._slots(left[:, 0])
        while len(left):  # linear probing, one step of all pairs at a time
            free = np.flatnonzero(self.keys[slots] < 0)
            take = free[np.unique(slots[free], return_index=True)[1]]
            self.keys[slots[take]], self.values[slots[take]] = left[take, 0], left[take, 1]
            keep = np.ones(len(left), dtype=bool)
            keep[take] = False
            left, slots = left[keep], (slots[keep] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, or none."""
        keys = a.astype(np.int64) << 32 | b
        out, at, slots = np.full(len(keys), _NONE, dtype=np.int32), np.arange(len(keys)), self._slots(keys)
        while len(at):
            seen = self.keys[slots]
            hit = seen == keys[at]
            out[at[hit]] = self.values[slots[hit]]
            more = ~hit & (seen >= 0)
            at, slots = at[more], (slots[more] + 1) & ((1 << self.bits) - 1)
        return out

    def _merge_short(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their counts of pieces of at most `size` bytes, one tree per row."""
        rows, width = len(starts), 2 * size
        column = np.arange(size)
        token = self.single[data[starts[:, None] + np.minimum(column, lengths[:, None] - 1)]].ravel()
        live = column < lengths[:, None]
        tree = np.full((rows, width), _NONE, dtype=np.int32)
        row, place = np.nonzero(live[:, 1:])
        tree[row, size + place] = self.pair_ranks(token[row * size + place], token[row * size + place + 1])
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        tree, live = tree.ravel(), live.ravel()
        following = np.broadcast_to(np.arange(1, size + 1, dtype=np.int64), (rows, size)).copy().ravel()
        previous = following - 2

        def put(base: np.ndarray, leaf: np.ndarray, rank: np.ndarray | np.int32) -> None:
            leaf = leaf + size
            tree[base + leaf] = rank
            while leaf[0] > 1:
                up = leaf >> 1
                tree[base + up] = np.minimum(tree[base + leaf], tree[base + (leaf ^ 1)])
                leaf = up

        active = np.arange(rows)
        while True:
            active = active[tree[active * width + 1] < _NONE]
            if not len(active):
                break
            base, cell = active * width, active * size
            least = tree[base + 1]
            at = np.ones(len(active), dtype=np.int64)
            while at[0] < size:
                at *= 2
                at += tree[base + at] != least
            at -= size
            gone = following[cell + at]
            end = following[cell + gone]
            following[cell + at] = end
            token[cell + at] = least
            live[cell + gone] = False
            more = np.flatnonzero(end < lengths[active])
            previous[cell[more] + end[more]] = at[more]
            put(base, gone, _NONE)
            rank = np.full(len(active), _NONE, dtype=np.int32)
            rank[more] = self.pair_ranks(token[cell[more] + at[more]], token[cell[more] + end[more]])
            put(base, at, rank)
            before = previous[cell + at]
            some = np.flatnonzero(before >= 0)
            if len(some):
                put(base[some], before[some], self.pair_ranks(token[cell[some] + before[some]], token[cell[some] + at[some]]))
        return token[live], live.reshape(rows, size).sum(axis=1)

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one after the other, and the number of ids of each."""
        lengths = ends - starts
        place = np.minimum(np.searchsorted(self.whole, hashes), len(self.whole) - 1)
        known = self.whole[place] == hashes
        counts = np.zeros(len(starts), dtype=np.int64)
        counts[known] = 1
        parts = [(np.flatnonzero(known), self.whole_ids[place[known]])]
        size = 2
        while size <= _SHORT:
            these = np.flatnonzero(~known & (lengths <= size) & (lengths > (size // 2 if size > 2 else 0)))
            if len(these):
                ids, counts[these] = self._merge_short(data, starts[these], lengths[these], size)
                parts.append((these, ids))
            size *= 2
        for i in np.flatnonzero(~known & (lengths > _SHORT)):
            ids = np.array(merge(data[starts[i]:ends[i]].tobytes(), self.ranks, self.longest), dtype=np.int32)
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        begins = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), dtype=np.uint32)
        for these, ids in parts:
            own = counts[these]
            out[np.arange(len(ids)) + np.repeat(begins[these] - (np.cumsum(own) - own), own)] = ids
        return out, counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offset of each text's ids."""
        if self.find is None:
            starts, first = split(data, offsets)
            ends = np.append(starts[1:], offsets[-1])
        else:
            starts, ends, first = self._found(data, offsets)
        hashes = word_hashes(data, starts, ends)
        distinct, sample, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ids, counts = self.merged(data, starts[sample], ends[sample], distinct)
        own = counts[inverse]
        stops = np.cumsum(own)
        begins = np.cumsum(counts) - counts
        total = int(stops[-1]) if len(stops) else 0
        return ids[np.arange(total) + np.repeat(begins[inverse] - (stops - own), own)], np.concatenate(([0], stops))[first]

    def _found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of another pattern."""
        starts, ends, first = [], [], [0]
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            text = data[a:b].tobytes().decode()
            wide = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text]))) + a
            spans = [m.span() for m in self.find(text) if m.end() > m.start()]
            starts += [wide[s] for s, _ in spans]
            ends += [wide[e] for _, e in spans]
            first.append(len(starts))
        return np.array(starts, dtype=np.int64), np.array(ends, dtype=np.int64), np.array(first)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the offset of each text's bytes."""
        lengths = self.lengths[ids]
        stops = np.concatenate(([0], np.cumsum(lengths)))
        return self.data[np.arange(stops[-1]) + np.repeat(self.begins[ids] - stops[:-1], lengths)], stops[offsets]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str, public: bool) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern, public)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column over one run of bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode the ids again.

    Returns one row per input row: the id column, `n_tokens`, `ids` (binary: little-endian unsigned 32-bit integers) and
    `decoded` (binary). A null or empty text has no ids and no bytes. Ids may be null or repeat; other columns are not carried,
    so their names cannot clash; an empty table gives an empty one. `path` names a rank file that every executor can open.
    `pattern` splits the text; without it the public pattern of these rank files is applied column-wise (`split`).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path, pattern or "", pattern is None)
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                data, offsets = flat(part.column(1))
                ids, bounds = code.encode(data, offsets)
                text, text_bounds = code.decode(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(bounds)), binary(ids.astype("<u4"), 4 * bounds), binary(text, text_bounds)],
                    [id_col, "n_tokens", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text_"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary, decoded binary")
