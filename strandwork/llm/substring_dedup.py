"""Repeated word spans across documents by a De Bruijn graph of word k-mers, compacted along source coordinates.

A window of k words is an edge between the (k - 1)-mers that begin and end it. Only edges that occur in two documents matter, so
the graph is cut down first: each window has an anchor (the least hash of its short grams), neighbouring windows mostly share it, and
only windows whose anchor occurs in two documents go on. These are sent as runs under their anchor, where equal edges meet. A run of
edges that follow each other both in a document and in the first document that has them is a nonbranching path and is
compacted to one row with both coordinates; a Spark join brings the rows of a document together, and pieces whose source coordinates
continue each other become one long span.

Each task combines before it sends: of equal windows in a batch only the first document's goes out, so a passage in a third of all documents costs one
entry per batch. If that document's id has several texts, each text sends its own.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat, gram_hashes, inside, mixed, pieces, word_bounds, word_hashes

_SPAN = "doc long, tag long, pos int, len int, src_doc long, src_pos int"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _windows(texts: pa.Array, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor, text and place of each window of the texts."""
    data, offsets = flat(texts)
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    at, _ = inside(first, k)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none.view(U64), none.view(U64), none, none
    row = np.searchsorted(first, at, side="right") - 1
    anchors = _least(gram_hashes(words, gram), k - gram + 1)
    return gram_hashes(words, k)[at], anchors[at], row, at - first[row]


def _edges(*columns: np.ndarray) -> np.ndarray:
    """Places at which any of the sorted columns changes, with 0 (none if empty)."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, dtype=np.int64)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _bytes(array: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([array[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())


def _read(table: pa.Table, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in table.column(column)), dtype=kind)


def _send_anchors(k: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, 4 << 20):
                _, anchors, row, _ = _windows(part.column(2), k, gram)
                runs = _edges(anchors, row)
                anchors, row = anchors[runs], row[runs]
                docs, tags = part.column(0).to_numpy()[row], part.column(1).to_numpy()[row]
                order = np.lexsort((tags, docs, anchors))
                anchors, docs, tags = anchors[order], docs[order], tags[order]
                once = _edges(anchors, docs, tags)
                anchors, docs, tags = anchors[once], docs[once], tags[once]
                groups = _edges(anchors)
                sizes = np.diff(np.append(groups, len(anchors)))
                # An anchor that the batch alone shows to repeat is sent once and marked; all its texts pass through. Of others each text is sent.
                local = np.repeat(docs[groups] != docs[groups + sizes - 1], sizes)
                head = np.zeros(len(anchors), dtype=bool)
                head[groups] = True
                bucket = (anchors % U64(buckets)).astype(np.int64)
                every = np.arange(buckets + 1)

                def dealt(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                    at = np.flatnonzero(chosen)
                    at = at[np.argsort(bucket[at], kind="stable")]
                    return at, np.searchsorted(bucket[at], every)

                (sent, cuts), (through, cuts2) = dealt(head | ~local), dealt(local)
                full = np.flatnonzero(np.diff(cuts) > 0)
                out = [pa.array(every[:-1].astype(np.int32)), *(_bytes(c[sent], cuts) for c in (anchors, docs, tags, local)), *(_bytes(c[through], cuts2) for c in (anchors, docs, tags))]
                yield pa.RecordBatch.from_arrays(out, ["bucket", "anchors", "docs", "tags", "many", "known", "known_docs", "known_tags"]).take(pa.array(full))

    return run


def _match_anchors(table: pa.Table) -> pa.Table:
    """Each text (doc, tag) with its anchors that also occur under another id. Several texts of one id alone are no repeat."""
    anchors, docs, tags, many = _read(table, "anchors", "<u8"), _read(table, "docs", "<i8"), _read(table, "tags", "<i8"), _read(table, "many", "?")
    order = np.argsort(anchors, kind="stable")
    anchors, docs, tags, many = anchors[order], docs[order], tags[order], many[order]
    groups = _edges(anchors)
    repeats = np.zeros(0, dtype=bool)
    if len(groups):
        several = (np.minimum.reduceat(docs, groups) != np.maximum.reduceat(docs, groups)) | np.logical_or.reduceat(many, groups)
        repeats = np.repeat(several, np.diff(np.append(groups, len(anchors)))) & ~many
    doc = np.concatenate((docs[repeats], _read(table, "known_docs", "<i8")))
    tag = np.concatenate((tags[repeats], _read(table, "known_tags", "<i8")))
    anchor = np.concatenate((anchors[repeats], _read(table, "known", "<u8")))
    return pa.table({"doc": doc, "tag": tag, "anchor": anchor.view(np.int64)})


def _spans(doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, src_doc: np.ndarray, src_pos: np.ndarray) -> list[np.ndarray]:
    """Compact edges to paths: columns doc, tag, pos, number of edges, source document and place."""
    order = np.lexsort((pos, tag, doc))
    doc, tag, pos, src_doc, src_pos = (x[order] for x in (doc, tag, pos, src_doc, src_pos))
    begin = _edges(doc, tag, pos - np.arange(len(pos)), src_doc, src_pos - np.arange(len(pos)))
    return [doc[begin], tag[begin], pos[begin], np.diff(np.append(begin, len(pos))), src_doc[begin], src_pos[begin]]


def _first_owner(hashes: np.ndarray, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by window, document, text and place, and for each place in that order the first of its window."""
    order = np.lexsort((pos, tag, doc, hashes))
    groups = _edges(hashes[order])
    return order, np.repeat(groups, np.diff(np.append(groups, len(order))))


def _send_windows(k: int, gram: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2, 4 << 20):
                ids, tags = part.column(0).to_numpy(), part.column(1).to_numpy()
                hashes, anchors, row, pos = _windows(part.column(2), k, gram)
                lists = part.column(3)
                wanted = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(lists.offsets)))
                named = lambda a, r: mixed(a ^ (r.astype(U64) * U64(0x9E3779B97F4A7C15)))
                keep = np.isin(named(anchors, row), named(np.ascontiguousarray(lists.flatten().to_numpy()).view(U64), wanted))
                hashes, anchors, row, pos = hashes[keep], anchors[keep], row[keep], pos[keep]
                doc, tag = ids[row], tags[row]
                order, owner = _first_owner(hashes, doc, tag, pos)
                first = order[owner]
                told = np.flatnonzero(doc[order] > doc[first])
                spans = _spans(doc[order[told]], tag[order[told]], pos[order[told]], doc[first[told]], pos[first[told]])
                # The first of each window in each text of its smallest id goes out, in runs of one anchor.
                each = _edges(hashes[order], doc[order], tag[order])
                own = np.sort(order[each[doc[order[each]] == doc[first[each]]]])
                begin = _edges(row[own], pos[own] - np.arange(len(own)), anchors[own])
                lengths = np.diff(np.append(begin, len(own)))
                bucket = (anchors[own[begin]] % U64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                head, lengths, bucket = own[begin[by]], lengths[by], bucket[by]
                stops = np.cumsum(lengths)
                flatten = np.arange(stops[-1] if len(stops) else 0) + np.repeat(begin[by] - (stops - lengths), lengths)
                every = np.arange(buckets + 1)
                cuts = np.searchsorted(bucket, every)
                wide = np.concatenate(([0], stops))[cuts]
                side = np.argsort(spans[0] % buckets, kind="stable")
                spans = [s[side] for s in spans]
                cuts2 = np.searchsorted(spans[0] % buckets, every)
                full = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(cuts2) > 0))
                kinds = ("<i8", "<i8", "<i4", "<i4", "<i8", "<i4")
                out = [pa.array(every[:-1].astype(np.int32)), _bytes(hashes[own][flatten], wide), _bytes(doc[head], cuts), _bytes(tags[row[head]].astype("<i8"), cuts), _bytes(pos[head].astype("<i4"), cuts), _bytes(lengths.astype("<i4"), cuts)]
                out += [_bytes(s.astype(kind), cuts2) for s, kind in zip(spans, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(out, ["bucket", "hashes", "docs", "tags", "places", "lengths", *(f"s{i}" for i in range(6))]).take(pa.array(full))

    return run


def _match_windows(table: pa.Table) -> pa.Table:
    lengths = _read(table, "lengths", "<i4").astype(np.int64)
    hashes = _read(table, "hashes", "<u8")
    doc, tag, pos = (np.repeat(_read(table, c, kind).astype(np.int64), lengths) for c, kind in (("docs", "<i8"), ("tags", "<i8"), ("places", "<i4")))
    pos = pos + np.arange(len(pos)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order, owner = _first_owner(hashes, doc, tag, pos)
    told = np.flatnonzero(doc[order] > doc[order[owner]])
    at, first = order[told], order[owner[told]]
    spans = _spans(doc[at], tag[at], pos[at], doc[first], pos[first])
    kinds = ("<i8", "<i8", "<i4", "<i4", "<i8", "<i4")
    names = ("doc", "tag", "pos", "len", "src_doc", "src_pos")
    return pa.table({n: np.concatenate((s.astype(kind), _read(table, f"s{i}", kind))) for i, (n, s, kind) in enumerate(zip(names, spans, kinds, strict=True))})


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns doc, tag (a 64-bit hash that tells texts of one id apart) and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"))


def repeated_paths(docs: DataFrame, k: int = 13, gram: int = 4, bucket_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compacted paths (doc, tag, pos, len, src_doc, src_pos): `len` windows of k words from word `pos` of `doc` also begin, in the same order, from
    word `src_pos` of `src_doc`, a smaller id. Of the places of one window in a document at least the first is told."""
    rows = _keyed(docs, id_col, text_col).where("doc IS NOT NULL")
    spark = docs.sparkSession
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // bucket_bytes))
    anchors = rows.mapInArrow(_send_anchors(k, gram, buckets), "bucket int, anchors binary, docs binary, tags binary, many binary, known binary, known_docs binary, known_tags binary")
    repeats = anchors.groupBy("bucket").applyInArrow(_match_anchors, "doc long, tag long, anchor long")
    # One list for each different text, with no more entries than the text has anchors, however many rows and batches hold it.
    wanted = repeats.groupBy("doc", "tag").agg(F.collect_set("anchor").alias("anchors"))
    found = rows.join(wanted, ["doc", "tag"]).select("doc", "tag", "text", "anchors")
    sent = found.mapInArrow(_send_windows(k, gram, buckets), "bucket int, hashes binary, docs binary, tags binary, places binary, lengths binary, s0 binary, s1 binary, s2 binary, s3 binary, s4 binary, s5 binary")
    return sent.groupBy("bucket").applyInArrow(_match_windows, _SPAN)


def remove_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Remove each word covered by a window of k words that also begins in a document of smaller id.

    Words are runs of other than ASCII white space. Returns one row per input row: the id column, `n_words`, `n_removed`, `kept` (the other words, joined by one space) and
    `spans`, the long repeated spans (pos, len in words, src_doc, src_pos). Windows are judged on the input. A null text has no words; rows of equal id
    are judged apart and do not remove each other's words; a row without id keeps its words and removes none. Other columns are not
    carried. Windows are compared by 64-bit hash.
    """
    paths = repeated_paths(docs, k, id_col=id_col, text_col=text_col, **options)
    listed = paths.groupBy("doc", "tag").agg(F.collect_set(F.struct("pos", "len", "src_doc", "src_pos")).alias("paths"))
    every = _keyed(docs, id_col, text_col)
    # Rows with an id go through the same shuffle as in `repeated_paths`, which Spark makes once.
    rows = every.where("doc IS NOT NULL").join(listed, ["doc", "tag"], "left").select("doc", "text", "paths")
    rows = rows.union(every.where("doc IS NULL").select("doc", "text", F.lit(None).cast(listed.schema["paths"].dataType)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 4 << 20):
                texts, lists = part.column(1), part.column(2)
                data, offsets = flat(texts)
                starts, ends, first = word_bounds(data, offsets)
                counts = np.diff(first)
                gone = np.zeros(len(starts), dtype=bool)
                words = word_hashes(data, starts, ends) if lists.null_count < len(lists) else None
                spans: list[list[dict]] = []
                for i in range(part.num_rows):
                    if not lists[i].is_valid:
                        spans.append([])
                        continue
                    inner = lists[i].values
                    pos, length, src_doc, src_pos = (inner.field(j).to_numpy().astype(np.int64) for j in range(4))
                    own = gram_hashes(words[first[i]:first[i + 1]], k)
                    told = np.zeros(len(own) + 1, dtype=np.int64)
                    np.add.at(told, pos, 1)
                    np.add.at(told, pos + length, -1)
                    told = np.cumsum(told[:-1]) > 0
                    told |= np.isin(own, own[told])
                    cover = np.zeros(counts[i] + 1, dtype=np.int64)
                    at = np.flatnonzero(told)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + k, -1)
                    gone[first[i]:first[i + 1]] = np.cumsum(cover[:-1]) > 0
                    spans.append(_joined(pos, length, src_doc, src_pos, k))
                kept = []
                for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    every = data[offsets[i]:offsets[i + 1]].tobytes().split()
                    stay = np.flatnonzero(~gone[a:b])
                    kept.append((b" ".join(every) if len(stay) == len(every) else b" ".join([every[j] for j in stay])).decode())
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(first[:-1], len(gone))) * (counts > 0)
                kind = pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int64()), ("src_doc", pa.int64()), ("src_pos", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts), pa.array(removed), pa.array(kept, pa.string()), pa.array(spans, kind)], [id_col, "n_words", "n_removed", "kept", "spans"])

    return rows.mapInArrow(run, f"`{id_col}` long, n_words long, n_removed long, kept string, spans array<struct<pos:long,len:long,src_doc:long,src_pos:long>>")


def _joined(pos: np.ndarray, length: np.ndarray, src_doc: np.ndarray, src_pos: np.ndarray, k: int) -> list[dict]:
    """Join path pieces whose coordinates continue each other in both documents; lengths in words."""
    order = np.lexsort((src_pos, src_doc, length, pos))
    pos, length, src_doc, src_pos = pos[order], length[order], src_doc[order], src_pos[order]
    fresh = np.ones(len(pos), dtype=bool)
    fresh[1:] = (pos[1:] != pos[:-1] + length[:-1]) | (src_doc[1:] != src_doc[:-1]) | (src_pos[1:] != src_pos[:-1] + length[:-1])
    begin = np.flatnonzero(fresh)
    total = np.add.reduceat(length, begin) + k - 1
    return [{"pos": int(p), "len": int(n), "src_doc": int(d), "src_pos": int(s)} for p, n, d, s in zip(pos[begin], total, src_doc[begin], src_pos[begin], strict=True)]
