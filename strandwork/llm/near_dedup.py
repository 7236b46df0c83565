"""MinHash near-duplicates with tensored banding and full verification.

Two small collections of r-wise minhash tuples are computed per document; the table keys are all pairs of a tuple of the
first and one of the second. With m tuples in each there are m * m keys from 2 * m * r minhashes, where plain banding takes
2 * m * m * r. Two sets of similarity s share a key with probability (1 - (1 - s^r)^m)^2.

Equal sets are one class from the start. In a bucket, members are first compared with its head (a star), which settles most of a large group of
copies with one row per member. Members of one bucket that are still in different components are then compared in blocks of bounded size, each
pair in the first bucket that it shares; blocks give back only the links of a spanning forest, so no row stands for a pair that is not linked.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import binary
from .common import U64, flat, gram_hashes, inside, mixed, pieces, stored, word_bounds, word_hashes
from .components import components


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and their offsets."""
    data, offsets = flat(texts, lower=True)
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    at, begins = inside(first, size)
    grams = gram_hashes(words, size)[at]
    sets = []
    for i in range(len(texts)):
        if begins[i + 1] > begins[i]:
            sets.append(np.unique(grams[begins[i]:begins[i + 1]]))
        elif first[i + 1] > first[i]:
            whole = words[first[i]:first[i + 1]]
            sets.append(mixed(gram_hashes(whole, len(whole)) + U64(len(whole))))
        else:
            sets.append(np.zeros(0, dtype=U64))
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, dtype=U64), bounds


def _print(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of each non-empty set."""
    if not len(begins):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    one = mixed(np.add.reduceat(mixed(values + U64(7)), begins))
    return one.view(np.int64), np.bitwise_xor.reduceat(mixed(values + U64(13)), begins).view(np.int64)


def _signatures(size: int, m: int, r: int, extra: list[str], seed: int = 5):
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, 2 * m * r, dtype=np.uint64) * U64(2) + U64(1)
    terms = rng.integers(0, 2**63, 2 * m * r, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                values, bounds = shingle_sets(part.column(1), size)
                counts = np.diff(bounds)
                full = np.flatnonzero(counts)
                begins = bounds[full]
                halves = np.zeros((2 * m, len(full)), dtype=U64)
                for k in range(2 * m * r if len(full) else 0):
                    low = np.minimum.reduceat(values * factors[k] + terms[k], begins)
                    halves[k // r] = mixed(halves[k // r] * U64(0x9E3779B97F4A7C15) + low + U64(k))
                prints = np.zeros((2, part.num_rows), dtype=np.int64)
                prints[:, full] = _print(values, begins)
                flatten = np.ascontiguousarray(halves.T).view(np.int64)
                lists = np.zeros(part.num_rows + 1, dtype=np.int32)
                lists[1:] = np.cumsum(np.where(counts > 0, m, 0))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts), pa.array(prints[0]), pa.array(prints[1]),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(flatten[:, :m].ravel())),
                     pa.ListArray.from_arrays(pa.array(lists), pa.array(flatten[:, m:].ravel())), *part.columns[2:]],
                    ["id", "n", "f1", "f2", "a", "b", *extra])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                values, bounds = shingle_sets(part.column(1), size)
                full = np.flatnonzero(np.diff(bounds))
                right = np.zeros(part.num_rows, dtype=bool)
                right[full] = _print(values, bounds[full])[0] == part.column(2).to_numpy()[full]
                out = pa.RecordBatch.from_arrays([part.column(0), binary(values.astype("<u8"), 8 * bounds)], ["node", "elements"])
                yield out.filter(pa.array(right))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype="<u8") for c in (2, 3))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[place] == small).sum())
                keep[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def _fine(table: pa.Table, m: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each cell (bucket and pair of blocks): its rows, and the pairs x, y of places in them that are to be compared here, by x.

    A pair is compared in the first bucket it shares, between different components, if its sizes allow a link.
    """
    key, p, q, node, label, n = (table.column(c).to_numpy() for c in ("key", "p", "q", "node", "label", "n"))
    one, two = (table.column(c).combine_chunks().flatten().to_numpy().reshape(-1, m) for c in "ab")
    order = np.lexsort((node, q, p, key))
    edge = np.flatnonzero(np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (p[order][1:] != p[order][:-1]) | (q[order][1:] != q[order][:-1]))))
    for rows in np.split(order, edge[1:]):
        if len(rows) < 2 or (label[rows] == label[rows[0]]).all():
            continue
        # The place of this bucket among the tuples: all its rows agree there.
        at = tuple(int(np.flatnonzero((c[rows] == c[rows[0]]).all(axis=0))[0]) for c in (one, two))
        for x in range(len(rows) - 1):
            y = np.arange(x + 1, len(rows))
            a, b = rows[x], rows[y]
            fits = (label[b] != label[a]) & (100 * np.minimum(n[b], n[a]) >= percent * np.maximum(n[b], n[a]))
            y = y[fits]
            b = rows[y]
            first = [((c[b] == c[a]).argmax(axis=1) == k) for c, k in zip((one, two), at, strict=True)]
            y = y[first[0] & first[1]]
            if len(y):
                yield rows, np.array([x]), y, node


def _needed(m: int, percent: int):
    """Which rows of which cells have a pair to compare."""
    def run(table: pa.Table) -> pa.Table:
        keep = np.zeros(table.num_rows, dtype=bool)
        for rows, x, y, _ in _fine(table, m, percent):
            keep[rows[x]] = keep[rows[y]] = True
        return table.filter(pa.array(keep)).select(["key", "p", "q", "node"])

    return run


def _linked(m: int, percent: int):
    """Links of a spanning forest of each cell."""
    def run(table: pa.Table) -> pa.Table:
        elements = table.column("elements").combine_chunks()
        sets = [np.frombuffer(x.as_buffer(), dtype="<u8") for x in elements]
        found: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        held, values, begins = None, None, None
        for rows, x, y, node in _fine(table, m, percent):
            if held is not rows:
                held, values = rows, np.concatenate([sets[r] for r in rows])
                begins = np.concatenate(([0], np.cumsum([len(sets[r]) for r in rows])))
            own = sets[rows[x[0]]]
            if len(y) * 4 > len(rows):
                place = np.minimum(np.searchsorted(own, values), len(own) - 1)
                common = np.add.reduceat((own[place] == values).astype(np.int64), begins[:-1])[y]
            else:
                common = np.array([np.count_nonzero(own[np.minimum(np.searchsorted(own, sets[r]), len(own) - 1)] == sets[r]) for r in rows[y]])
            total = len(own) + np.diff(begins)[y] - common
            for z in y[100 * common >= percent * total]:
                a, b = root(int(node[rows[x[0]]])), root(int(node[rows[z]]))
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    found.append((int(node[rows[x[0]]]), int(node[rows[z]])))
        columns = list(zip(*found, strict=True)) or [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 2, percent: int = 80, m: int = 11, r: int = 2, block: int = 2048, tell_texts: bool = False) -> DataFrame:
    """Link documents whose sets of distinct `size`-word shingles have 100 * common >= `percent` * union.

    Words are runs of other than ASCII white space, with A-Z lower-cased; a text of fewer words is one shingle; one without words or a
    null one has an empty set and is linked with nothing. Returns one row per input row: the id column, `n_shingles`,
    `component_id` (smallest id reachable) and `kept`. Rows that repeat an id are linked by their own texts. A row without id takes no
    part: its component and `kept` are null. Other columns are not carried. Sets are held as 64-bit shingle hashes.

    With `tell_texts` there are two more columns: `text_key`, the xxhash64 of the text, and `component`, which tells components of one `component_id`
    apart (an id with several texts can be the smallest of several components); it is null for rows that are linked with nothing.

    Every pair that shares a key is either confirmed on full sets or joined by confirmed links of others. The chance that a pair at exactly
    the threshold shares no key is 2 * (1 - s^r)^m, 1.5e-5 for the defaults, and falls fast above it.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds, extra = "id long, n long, f1 long, f2 long, a array<long>, b array<long>", ["text_key"] if tell_texts else []
    keyed = rows.select("*", *(F.xxhash64("text").alias(c) for c in extra))
    signed = stored(keyed.mapInArrow(_signatures(size, m, r, extra), ", ".join([kinds, *(f"{c} long" for c in extra)])), "near-signatures")
    classes = signed.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"))
    # A class is named by its smallest id; if an id has several texts, by a negative name of its own.
    again = F.row_number().over(Window.partitionBy("rep").orderBy("f1", "f2")) > 1
    classes = classes.withColumn("node", F.when(again, -F.shiftrightunsigned(F.xxhash64("f1", "f2"), 1) - 1).otherwise(F.col("rep")))
    members = stored(signed.join(classes, ["f1", "f2", "n"]).where("id IS NOT NULL").select("id", "node", "rep", "n", "f1", "a", "b", *extra), "near-members")
    nodes = members.where("id = rep").dropDuplicates(["node"])
    keys = nodes.select("node", "b", F.explode("a").alias("x")).select("node", "x", F.explode("b").alias("y")).select("node", F.xxhash64("x", "y").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("count")).where("count > 1").select("key", "head")
    buckets = stored(keys.join(shared, "key").select("key", "node", "head"), "near-buckets")
    sizes = nodes.select("node", "n", "f1", "rep")
    wanted = buckets.select("node").distinct().join(sizes, "node")
    texts = rows.join(wanted.select(F.col("rep").alias("id"), "node", "f1"), "id").select("node", "text", "f1")
    sets = stored(texts.mapInArrow(_sets(size), "node long, elements binary"), "near-sets")
    elements = sets.withColumn("n", F.octet_length("elements") / 8)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links. Sizes alone rule many out before sets are read."""
        n = elements.select("node", "n")
        near = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
        full = near.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a").select("a", "b", "x", "y")
        return full.mapInArrow(_confirm(percent), "a long, b long")

    star = stored(buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    found = components(confirmed(star), "near-components")
    # What is left: buckets whose members are in several components, in pairs of blocks.
    labelled = buckets.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("count")).where("lo < hi")
    parts = F.ceil(F.col("count") / block).cast("int")
    open_ = labelled.join(open_keys.select("key", parts.alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    open_ = open_.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    open_ = stored(open_.select("key", "node", "label", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")), "near-open")
    rows_open = open_.count()
    if rows_open:
        coarse = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_open // 5_000))
        task = F.pmod(F.xxhash64("key", "p", "q"), F.lit(coarse)).alias("task")
        sketches = nodes.select("node", "n", "a", "b")
        cells = open_.join(sketches, "node").select(task, "key", "p", "q", "node", "label", "n", "a", "b")
        needed = stored(cells.groupBy("task").applyInArrow(_needed(m, percent), "key long, p int, q int, node long"), "near-needed")
        full = needed.join(open_, ["key", "p", "q", "node"]).join(sketches, "node").join(sets, "node")
        full = full.select(task, "key", "p", "q", "node", "label", "n", "a", "b", "elements")
        more = stored(full.groupBy("task").applyInArrow(_linked(m, percent), "a long, b long").distinct(), "near-more")
        if not more.isEmpty():
            found = components(more.union(found.toDF("a", "b")), "near-components")
    named = found.join(sizes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    final = found.join(named, "component").select("node", "component_id", "component")
    apart = [F.coalesce("component", "node").alias("component")] if tell_texts else []
    placed = members.select("id", "n", "rep", "node", *extra).join(final, "node", "left").select("id", "n", F.coalesce("component_id", "rep").alias("component_id"), *extra, *apart)
    alone = signed.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"), *extra, *([F.lit(None).cast("long").alias("component")] if tell_texts else []))
    names = [*extra, "component"] if tell_texts else []
    return placed.union(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"), *names)
