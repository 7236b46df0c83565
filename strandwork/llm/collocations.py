"""Phrase collocations by best-first branch and bound over growing phrases.

The score of a phrase is 1000 * a * n / (l * r) for its worst cut. The part after a cut occurs at least as often as the phrase, so no phrase scores above
1000 * n / f(first part): prefix counts bound all that can grow from a prefix. First words are the branches, the rarest have the highest bounds. Each round expands the
branches with the best bounds of every group (language) at once, one word at a time and only from prefixes that are frequent themselves, and scores what it finds exactly.
A group is settled when no open branch can reach its `top`-th surviving score, ties included.

The corpus is kept as 64-bit word hashes (the group mixed in), in which words below the least count are breaks, as no phrase can hold them. Sets of words and prefixes reach
the tasks as bit filters of a fixed size. A filter may let more through; such phrases get exact counts too, or fall out of the joins that follow, so results are exact
but for collisions of 64-bit hashes. Counts are summed in each task before the shuffle, so neither a hot group nor a hot phrase gathers in one task.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, flat, mixed, pieces, stored, word_hashes

#: Size of a filter in bits, whatever the number of its members; 2 MB in each task.
FILTER_BITS = 1 << 24
_PROBES = (0, 20, 39)
_GRAM = U64(0x9E3779B97F4A7C17)
_HELD = 1 << 20
_ROW, _LINE = 1 << 9, 1 << 18
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


class _Sums:
    """Rows of int64 columns, summed up by their first one. `ops` says how the others are merged."""

    def __init__(self, names: list[str], ops: list[str]):
        self.names, self.ops, self.parts, self.held = names, ops, [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(self._merged([c.view(np.int64) for c in columns]))
            self.held += len(self.parts[-1][0])

    def _merged(self, columns: list[np.ndarray]) -> list[np.ndarray]:
        order = np.argsort(columns[0], kind="stable")
        keys = columns[0][order]
        at = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
        ways = {"sum": np.add.reduceat, "min": np.minimum.reduceat, "max": np.maximum.reduceat, "any": lambda c, a: c[a]}
        return [keys[at], *[ways[op](c[order], at) for op, c in zip(self.ops, columns[1:], strict=True)]]

    def take(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        """All rows, if more than `least` are held."""
        if self.parts and self.held > least:
            rows = self._merged([np.concatenate(c) for c in zip(*self.parts, strict=True)])
            if least and 2 * len(rows[0]) < least:
                self.parts, self.held = [rows], len(rows[0])
                return
            self.parts, self.held = [], 0
            for i in range(0, len(rows[0]), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(c[i:i + (1 << 18)]) for c in rows], names=self.names)


def _tokens(groups: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Bytes; start, end, hash and group code of each word; whether a piece begins with it; the groups."""
    data, offsets = flat(texts, lower=True)
    size = int(offsets[-1])
    kind = _KIND[data[:size]]
    solid = kind == 0
    ahead = np.zeros(size, dtype=bool)
    ahead[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < size)]
    ahead[inner] = False
    starts = np.flatnonzero(solid & ~ahead)
    behind = np.zeros(size, dtype=bool)
    behind[:-1] = solid[1:]
    behind[inner - 1] = False
    ends = np.flatnonzero(solid & ~behind) + 1
    breaks = np.zeros(size + 1, dtype=np.int32)
    np.cumsum(kind == 2, out=breaks[1:])
    doc = np.searchsorted(offsets, starts, side="right") - 1
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (breaks[starts[1:]] != breaks[starts[:-1]]) | (doc[1:] != doc[:-1])
    coded = groups.dictionary_encode()
    names, code = coded.dictionary, np.asarray(coded.indices.to_numpy(zero_copy_only=False), dtype=np.int64)
    bytes_, bounds = flat(names)
    # Mixed once more: a plain hash would make word `es` of group `de` equal to word `de` of group `es`.
    seeds = mixed(word_hashes(bytes_, bounds[:-1], bounds[1:]) * _GRAM)
    code = code[doc]
    hashes = mixed(word_hashes(data, starts, ends) ^ (seeds[code] if len(seeds) else U64(0)))
    hashes[hashes == 0] = 1
    return data, starts, ends, hashes, code, fresh, names


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, word, c) of each distinct word of a batch; a null word has the number of all words."""
    for batch in batches:
        for part in pieces(batch, 1, 4 << 20):
            data, starts, ends, hashes, code, _, names = _tokens(part.column(0), part.column(1))
            if not len(starts):
                continue
            _, first, counts = np.unique(hashes, return_index=True, return_counts=True)
            sizes = ends[first] - starts[first]
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            places = np.arange(bounds[-1]) + np.repeat(starts[first] - bounds[:-1], sizes)
            words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[places])))
            of = np.bincount(code, minlength=len(names))
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([names.take(pa.array(code[first])), names]).cast(pa.string()),
                pa.concat_arrays([pa.array(hashes[first].view(np.int64)), pa.nulls(len(names), pa.int64())]),
                pa.concat_arrays([words.cast(pa.string()), pa.nulls(len(names), pa.string())]),
                pa.array(np.concatenate((counts, of)))], names=["g", "h", "word", "c"])


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for shift in _PROBES:
        bit = (hashes >> U64(shift)) & U64(FILTER_BITS - 1)
        out &= ((bits[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1)).astype(bool)
    return out


def _filter(rows: DataFrame, column: str = "h") -> Broadcast:
    """A bit filter of a column of hashes. The driver gets at most FILTER_BITS / 64 rows."""
    h = F.col(column)
    bits = rows.select(F.explode(F.array(*[F.shiftrightunsigned(h, s).bitwiseAND(FILTER_BITS - 1) for s in _PROBES])).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("v")).toArrow()
    out = np.zeros(FILTER_BITS // 64, dtype=U64)
    out[words["at"].to_numpy()] = words["v"].to_numpy().view(U64)
    return rows.sparkSession.sparkContext.broadcast(out)


def _coded(known: Broadcast) -> Callable:
    """Texts as hashes of known words; one 0 stands for any break and for words that are not known.

    A row ends at a break behind some _ROW words, so that readers, which count rows, hold few bytes at once.
    """
    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1, 2 << 20):
                *_, hashes, _, fresh, _ = _tokens(part.column(0), part.column(1))
                hashes = np.where(_passes(known.value, hashes), hashes, U64(0))
                # Each word takes two places, a break or nothing and itself.
                line = np.zeros(2 * len(hashes) + 1, dtype=U64)
                line[1::2] = hashes
                keep = np.ones(len(line), dtype=bool)
                keep[:-1:2] = fresh
                line = line[keep]
                line = np.concatenate((line[(line != 0) | np.concatenate(([True], line[:-1] != 0))], np.zeros(1, dtype=U64)))
                ends = np.flatnonzero(line == 0) + 1
                ends = ends[np.concatenate((ends[1:] // _ROW != ends[:-1] // _ROW, [True]))]
                bounds = (np.concatenate(([0], ends)) * 8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(line)])], names=["t"])
    return run


def _grams(line: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words, and which runs hold no break."""
    count = max(0, len(line) - size + 1)
    h, whole = line[:count], line[:count] != 0
    for j in range(1, size):
        h = mixed(h * _GRAM + line[j:j + count])
        whole = whole & (line[j:j + count] != 0)
    return h, whole


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Neighbouring rows as one array, some _LINE words at a time. Each row ends with a break."""
    for batch in batches:
        for part in pieces(batch, 0, 8 * _LINE):
            values = part.column(0)
            bounds = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset:values.offset + len(values) + 1]
            yield np.frombuffer(values.buffers()[2], dtype=np.uint8)[bounds[0]:bounds[-1]].view(U64)


def _grown(size: int, prefixes: Broadcast) -> Callable:
    """Counts of all phrases of `size` words that begin with a known prefix."""
    def run(batches):
        sums = _Sums(["h", "p", "w", "c"], ["any", "any", "sum"])
        for line in _lines(batches):
            head, _ = _grams(line, size - 1)
            _, whole = _grams(line, size)
            at = np.flatnonzero(whole)
            at = at[_passes(prefixes.value, head[at])]
            head, last = head[at], line[at + size - 1]
            sums.add(mixed(head * _GRAM + last), head, last, np.ones(len(at), dtype=np.int64))
            yield from sums.take(_HELD)
        yield from sums.take()
    return run


def _settled(longest: int, wanted: Broadcast) -> Callable:
    """Counts of wanted phrases and the least and greatest word before and behind them, 0 where there is none."""
    def run(batches):
        sums = _Sums(["h", "c", "p0", "p1", "n0", "n1"], ["sum", "min", "max", "min", "max"])
        for line in _lines(batches):
            if not len(line):
                continue
            edged = np.concatenate(([U64(0)], line, [U64(0)]))
            for size in range(2, longest):
                h, whole = _grams(line, size)
                at = np.flatnonzero(whole)
                at = at[_passes(wanted.value, h[at])]
                before, behind = edged[at], edged[at + size + 1]
                sums.add(h[at], np.ones(len(at), dtype=np.int64), before, before, behind, behind)
            yield from sums.take(_HELD)
        yield from sums.take()
    return run


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k, s): the hash of what is left of a phrase behind its first k words, for rests of two words and more."""
    for batch in batches:
        words = batch.column(1)
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        every, begins = words.flatten().to_numpy().view(U64), np.concatenate(([0], np.cumsum(sizes)))
        own = batch.column(0).to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            for k in range(1, int(size) - 1):
                h = every[begins[rows] + k]
                for j in range(k + 1, int(size)):
                    h = mixed(h * _GRAM + every[begins[rows] + j])
                yield pa.RecordBatch.from_arrays([pa.array(own[rows]), pa.array(np.full(len(rows), k, dtype=np.int32)), pa.array(h.view(np.int64))], names=["h", "k", "s"])


def _score(a: str, n: str, l_: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)); the products have up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    over, under = wide(F.lit(1000) * F.col(a)) * wide(F.col(n)), wide(l_) * wide(r)
    return F.floor(F.try_divide(over - over % under, under)).cast("long")


def _first_round(words: DataFrame, totals: DataFrame) -> DataFrame:
    """(g, n, low, high, half, most, tau): round 1 takes first words with up to about an eighth of all words of a group, round 2 half of them, round 3 the rest."""
    step = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("f")))).cast("long").alias("upto")
    by = words.groupBy("g", step).agg(F.sum("f").alias("m"), F.max("f").alias("most")).join(totals, "g")
    sums = by.withColumn("m", F.sum("m").over(Window.partitionBy("g").orderBy("upto")))
    reach = lambda part: F.coalesce(F.max(F.when(F.col("m") * part <= F.col("n"), F.col("upto"))), F.min("upto"))
    return sums.groupBy("g", "n").agg(F.lit(0).cast("long").alias("low"), reach(8).alias("high"), reach(2).alias("half"), F.max("most").alias("most"),
                                      F.lit(None).cast("long").alias("tau"))


def _round(tokens: DataFrame, words: DataFrame, state: DataFrame, least: int, longest: int) -> DataFrame:
    """Exact scores of all surviving phrases whose first word lies in this round's range and whose bound reaches the group's score to beat."""
    active = words.join(state, "g").where("f > low AND f <= high")
    rows = stored(active.select("h", "g", "n", "tau", F.array("h").alias("words"), F.array().cast("array<long>").alias("ls"), F.col("f").alias("a")), "phrase-1")
    last = words.select(F.col("h").alias("w"), F.col("f").alias("last"))
    levels = []
    for size in range(2, longest + 1):
        counts = tokens.mapInArrow(_grown(size, _filter(rows)), "h long, p long, w long, c long").groupBy("h", "p", "w").agg(F.sum("c").alias("c")).where(F.col("c") >= least)
        heads = rows.select(F.col("h").alias("p"), "g", "n", "tau", "words", "ls", "a")
        grown = counts.join(heads, "p").join(last, "w").select(
            "h", "g", "n", "tau", F.concat("words", F.array("w")).alias("words"), F.concat("ls", F.array("a")).alias("ls"), F.col("c").alias("a"), "last")
        rows = stored(grown, f"phrase-{size}")
        levels.append(rows)
        if rows.isEmpty():
            break
    every = levels[0]
    for level in levels[1:]:
        every = every.union(level)
    bound = F.least(_score("a", "n", F.element_at("ls", -1), F.col("last")), F.expr("1000 * n div ls[0]"))
    open_ = every.where(F.col("tau").isNull() | (bound >= F.col("tau")))
    cuts = stored(open_.select("h", "words").mapInArrow(_suffixes, "h long, k int, s long"), "phrase-cuts")
    wanted = _filter(cuts.select(F.col("s").alias("h")).union(open_.where(F.size("words") < longest).select("h")))
    met = tokens.mapInArrow(_settled(longest, wanted), "h long, c long, p0 long, p1 long, n0 long, n1 long").groupBy("h").agg(
        F.sum("c").alias("c"), F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.min("n0").alias("n0"), F.max("n1").alias("n1"))
    met = stored(met, "phrase-met")
    rests = cuts.join(met.select(F.col("h").alias("s"), "c"), "s").groupBy("h").agg(F.collect_list(F.struct("k", F.col("c").alias("r"))).alias("rests"))
    # A phrase that always has the same word before or behind it is held by a longer one as often as it occurs.
    held = met.where("(p0 = p1 AND p0 <> 0) OR (n0 = n1 AND n0 <> 0)").select("h")
    alive = open_.where(F.size("words") == longest).union(open_.where(F.size("words") < longest).join(held, "h", "left_anti"))
    cut = F.array(F.struct((F.size("words") - 1).alias("k"), F.col("last").alias("r")))
    tried = alive.join(rests, "h", "left").withColumn("cut", F.explode(F.when(F.col("rests").isNull(), cut).otherwise(F.concat("rests", cut))))
    tried = tried.select("h", "g", "n", "words", "a", "cut.k", F.element_at("ls", F.col("cut.k")).alias("l"), "cut.r").withColumn("score", _score("a", "n", F.col("l"), F.col("r")))
    best = tried.groupBy("h").agg(F.min(F.struct("score", "k", "l", "r", "g", "n", "a", "words")).alias("b"))
    return stored(best.select("h", "b.*"), "phrase-scored")


def _ranked(found: DataFrame, top: int, *order: Column) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, text: str = "text", group: str = "lang", least: int = 100, top: int = 2000, longest: int = 5) -> DataFrame:
    """The `top` phrases of 2 to `longest` words in each group: rank, phrase, a, l, r, n and score, with `group` as the first column.

    Texts are lower-cased (A-Z) and split at `.,;:!?` and line ends into pieces, these at blanks and tabs into words. Candidates occur at least `least` times; those
    inside a longer candidate that occurs as often are dropped. The score is that of the worst cut, ties to the shortest first part; ranks go by score, count, then phrase.

    A null group is `und`, a null or empty text has no words, repeated rows count each time, and an empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(group).cast("string"), F.lit("und")).alias("g"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(_count_words, "g string, h long, word string, c long").groupBy("g", "h", "word").agg(F.sum("c").alias("f"))
    counted = stored(counted.where((F.col("f") >= least) | F.col("word").isNull()), "phrase-words")
    totals = counted.where("word IS NULL").select("g", F.col("f").alias("n"))
    words = counted.where((F.col("f") >= least) & F.col("word").isNotNull())
    tokens = stored(rows.mapInArrow(_coded(_filter(words)), "t binary"), "phrase-tokens")
    state, found = stored(_first_round(words, totals), "phrase-state"), None
    while True:
        open_ = state.where("low < high")
        if open_.isEmpty():
            break
        scored = _round(tokens, words, open_, least, longest)
        found = scored if found is None else found.union(scored)
        beaten = _ranked(found.select("g", "score"), top, F.desc("score")).groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("new"))
        tau = F.when(F.col("m") >= top, F.col("new"))
        # A first word that occurs more often than this cannot begin a phrase with such a score. A round that half of the words would not widen goes on to all of them.
        need = F.when(tau.isNotNull(), F.least("most", F.expr("1000 * n div greatest(new, 1)"))).otherwise(F.when(F.col("half") > F.col("high"), F.least("most", "half")).otherwise(F.col("most")))
        state = stored(state.join(beaten, "g", "left").select(
            "g", "n", F.col("high").alias("low"), F.greatest("high", need).alias("high"), "half", "most", tau.alias("tau")), "phrase-state")
    if found is None:
        found = rows.sparkSession.createDataFrame([], "h long, score long, k int, l long, r long, g string, n long, a long, words array<long>")
    near = found.join(state.select("g", F.col("tau").alias("t")), "g").where(F.col("t").isNull() | (F.col("score") >= F.col("t"))).drop("t")
    spelled = near.select("h", F.posexplode("words").alias("at", "w")).join(words.select(F.col("h").alias("w"), "word"), "w").groupBy("h").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    out = _ranked(near.join(spelled, "h"), top, F.desc("score"), F.desc("a"), F.col("phrase"))
    return out.select(F.col("g").alias(group), "rank", "phrase", "a", "l", "r", "n", "score")
