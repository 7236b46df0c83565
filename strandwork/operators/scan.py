"""Sequence scans: contigs -> chunks -> windows -> hits.

A contig is cut into fixed cores; each chunk carries the bases that windows
starting in its core need beyond it, so a hit belongs to exactly one chunk and
none is lost at an edge. All window tests are evaluated in generated code on
BINARY slices, and a selective exact motif first drops whole chunks by `rlike`.

Contigs come in either of two forms, and every scan takes both: rows that hold a whole
contig (contig_id, seq), or pieces of any size (contig_id, contig_len, at, bases), `at` being
the number of bases before the piece. Pieces are what `sources.fasta.read_pieces` gives for
files of any size; their chunks are put together from neighbouring pieces by one shuffle,
so no row or task ever holds a contig.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..session import cut

CORE = 1 << 16
HIT_KEYS = ["contig_id", "start", "end", "strand"]


def in_pieces(contigs: DataFrame) -> bool:
    return "seq" not in contigs.columns


def whole_contigs(contigs: DataFrame, least: int, carry: list[str] | None = None) -> DataFrame:
    """contig_id, contig_len, whole (the bases as BINARY) of contigs with at least `least` bases.

    The one-element explode keeps the length test above the expression that makes `seq`. Pushed
    below it, the test would parse or clean every sequence a second time.
    """
    one = contigs.select("contig_id", *(carry or []), F.explode(F.array(F.col("seq").cast("binary"))).alias("whole"))
    return one.withColumn("contig_len", F.length("whole")).where(F.col("contig_len") >= least)


def with_bases(contigs: DataFrame, change) -> DataFrame:
    """The contigs with `change` applied to their bases, in either form; it must keep every base's place."""
    name = "bases" if in_pieces(contigs) else "seq"
    return contigs.withColumn(name, change(F.col(name)))


def both_strands(contigs: DataFrame) -> DataFrame:
    """Every contig as read on each strand, with the column `strand`; places are those of that strand."""
    two = contigs.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    minus = F.col("strand") == "-"
    if not in_pieces(contigs):
        return two.withColumn("seq", F.when(minus, S.reverse_complement("seq")).otherwise(F.col("seq")))
    mirrored = F.col("contig_len") - F.col("at") - F.length("bases")
    return two.withColumns({"at": F.when(minus, mirrored).otherwise(F.col("at")),
                            "bases": F.when(minus, S.reverse_complement("bases")).otherwise(F.col("bases"))})


def region_of(contigs: DataFrame, start: int, end: int | None) -> DataFrame:
    """contig_id and the bases [start, end] (1-based; to the contig's end by default) in the form of `contigs`."""
    if not in_pieces(contigs):
        seq = F.substring("seq", start, end - start + 1) if end else F.expr(f"substring(seq, {start})")
        return contigs.select("contig_id", seq.alias("seq"))
    last = F.least(F.lit(end).cast("bigint"), F.col("contig_len")) if end else F.col("contig_len")
    first = F.greatest(F.lit(start - 1).cast("bigint") - F.col("at"), F.lit(0))
    kept = F.least(last - F.col("at"), F.length("bases").cast("bigint")) - first
    return contigs.where(kept > 0).select(
        "contig_id", (last - (start - 1)).alias("contig_len"), (F.col("at") + first - (start - 1)).alias("at"),
        F.substring("bases", (first + 1).cast("int"), kept.cast("int")).alias("bases"))


def _cores(contigs: DataFrame, window: int, core: int, left: int, right: int, carry: list[str]) -> DataFrame:
    """Chunks with `left` bases before their core and `right` behind it: contig_id, carry, contig_len, offset, cut (bases before the chunk), bases."""
    kept = ["contig_id", *carry, "contig_len"]
    if not in_pieces(contigs):
        return (
            whole_contigs(contigs, window, carry)
            .select(*kept, "whole", F.explode(F.sequence(F.lit(0), F.col("contig_len") - window, F.lit(core))).alias("offset"))
            .withColumn("cut", F.greatest(F.col("offset") - left, F.lit(0)))
            .select(*kept, "offset", "cut", F.substring("whole", F.col("cut") + 1, F.col("offset") - F.col("cut") + (core + right)).alias("bases"))
        )
    size = F.length("bases").cast("bigint")
    low = F.greatest(F.floor((F.col("at") - right) / core), F.lit(0)).cast("bigint")
    high = F.least(F.floor((F.col("at") + size - 1 + left) / core), F.floor((F.col("contig_len") - window) / core)).cast("bigint")
    begin = F.greatest(F.col("at"), F.col("offset") - left)
    end = F.least(F.col("at") + size, F.col("offset") + (core + right))
    parts = (
        contigs.where((size > 0) & (F.col("contig_len") >= window)).withColumn("low", low).withColumn("high", high).where("low <= high")
        .withColumn("core_no", F.explode(F.sequence("low", "high"))).withColumn("offset", F.col("core_no") * core)
        .select(*kept, "offset", F.struct(begin.alias("begin"), F.substring(
            "bases", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("part")).alias("p"))
    )
    put = F.array_join(F.array_sort(F.collect_list("p"))["part"], "").cast("binary")
    return parts.groupBy(*kept, "offset").agg(put.alias("bases")).withColumn(
        "cut", F.greatest(F.col("offset") - left, F.lit(0).cast("bigint")))


def chunk(contigs: DataFrame, window: int, core: int = CORE, reach: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """One row per core of every contig that holds at least one window.

    Columns: contig_id, contig_len, offset (bases before the chunk), bases (BINARY), and the `carry`
    columns. A chunk extends `reach` - 1 bases past its core (`window` - 1 by default).
    """
    return _cores(contigs, window, core, 0, (reach or window) - 1, carry or []).drop("cut")


def _positions(chunks: DataFrame, window: int) -> DataFrame:
    """One row per window start inside each chunk; `at` is 1-based within the chunk."""
    return chunks.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("bases") - (window - 1))))


def padded_chunks(contigs: DataFrame, window: int, left: int, right: int, core: int = 4096) -> DataFrame:
    """Chunks that carry `left` bases before their core and `right` after it; `cut` bases precede a chunk."""
    return _cores(contigs, window, core, left, right, [])


def with_other_strand(chunks: DataFrame) -> DataFrame:
    """Adds the chunk's reverse complement, so that '-' windows are slices too."""
    return chunks.withColumn("rc_bases", S.reverse_complement(F.col("bases").cast("string")).cast("binary"))


def oriented(strand: Column, at: Column, width: Column) -> Column:
    """The window at `at` as read on its strand."""
    mirror = F.length("rc_bases") - at - width + 2
    return F.when(strand == "+", F.substring("bases", at, width)).otherwise(
        F.substring("rc_bases", mirror, width)).cast("string")


def _tile(patterns: list[str]) -> int | None:
    """Chunk size at which the rarest-case `rlike` prefilter skips most chunks, if any."""
    rate = sum(math.prod(len(S.IUPAC[c]) / 4 for c in p) for p in patterns)
    size = int(0.25 / rate)
    return min(size, CORE) if size >= 512 else None


def motif_hits(
    contigs: DataFrame, pattern: str, max_mismatches: int = 0, strand_policy: str = "both",
) -> DataFrame:
    """M1, M2, M3: windows of both strands within `max_mismatches` of an IUPAC pattern.

    Overlapping hits are kept. `strand_policy='both'` always reports the reverse strand;
    `'skip_palindrome'` leaves it out when the pattern is its own reverse complement.
    A '-' row reports the reverse complement of the forward window.
    """
    pattern = S.check_pattern(pattern)
    if strand_policy not in ("both", "skip_palindrome"):
        raise ValueError(f"unknown strand policy {strand_policy!r}")
    rc = S.reverse_complement_text(pattern)
    width = len(pattern)
    bases, at = F.col("bases"), F.col("at")
    strands = [("+", pattern)]
    if strand_policy == "both" or rc != pattern:
        strands.append(("-", rc))

    tile = _tile([p for _, p in strands]) if max_mismatches == 0 else None
    chunks = chunk(contigs, width, tile or CORE)
    if tile:
        either = "|".join(sorted({S.iupac_regex(p) for _, p in strands}))
        chunks = chunks.where(bases.cast("string").rlike(either))
    spots = _positions(with_other_strand(chunks), width)

    if max_mismatches == 0:
        tests = [(s, F.lit(0), S.matches_at(bases, at, p)) for s, p in strands]
    else:
        tests = [(s, c, c <= max_mismatches) for s, c in ((s, S.mismatches_at(bases, at, p)) for s, p in strands)]
    any_hit = S.either([ok for _, _, ok in tests])
    on = F.col("strand")
    # The strand is exploded only at positions that hit, and tested again there.
    found = spots.where(any_hit).withColumn("strand", F.explode(F.array(*[F.lit(s) for s, _, _ in tests])))
    found = found.where(S.by_case([(on == s, ok) for s, _, ok in tests]))
    return found.select(
        "contig_id", (F.col("offset") + at).cast("bigint").alias("start"),
        (F.col("offset") + at + (width - 1)).cast("bigint").alias("end"), "strand", F.lit(pattern).alias("pattern"),
        oriented(on, at, F.lit(width)).alias("found_seq"),
        S.by_case([(on == s, count) for s, count, _ in tests]).cast("int").alias("mismatches"),
    )


def with_rev_comp(hits: DataFrame) -> DataFrame:
    """The E. coli hit form: adds the reverse complement of the reported sequence."""
    return hits.withColumn("rev_comp", S.reverse_complement("found_seq"))


def _states(steps: Column, before: Column, free: Column) -> Column:
    """Entry state of each (no, table) of a sorted list, walked from block `before` with the state `free`; a missing block lets every state end."""
    none = F.expr("cast(array() as array<struct<no:bigint,free:int>>)")

    def enter(acc: Column, t: Column) -> Column:
        now = F.when(acc["no"] == t["no"] - 1, acc["free"]).otherwise(F.lit(0))
        return F.struct(t["no"].alias("no"), t["table"][now].alias("free"), F.array_append(acc["all"], F.struct(t["no"].alias("no"), now.alias("free"))).alias("all"))

    return F.aggregate(steps, F.struct(before.cast("bigint").alias("no"), free.cast("int").alias("free"), none.alias("all")), enter)["all"]


def _handed_over(blocks: DataFrame, width: int, core: int, group: int) -> DataFrame:
    """(contig_id, strand, no, free): the first offset of each block with hits at which a hit may begin.

    A kept hit forbids the `width` - 1 starts behind it, some of which may lie in the next block. A block's table leads from
    each entry offset (0 to width - 1) to the exit offset. The tables of `group` neighbouring blocks are composed to one; these few
    are walked for each contig and strand, then the blocks of every group from the group's own entry.
    """
    line = ["contig_id", "strand"]
    entries = F.sequence(F.lit(0), F.lit(width - 1))

    def leave(e: Column) -> Column:
        free = F.aggregate("hits", e, lambda at, h: F.when(h["at"] >= at, h["at"] + width).otherwise(at))
        return F.greatest(free - core, F.lit(0))

    tables = blocks.select(*line, "no", F.transform(entries, leave).alias("table")).withColumn("super", F.floor(F.col("no") / group).cast("bigint"))
    inner = tables.groupBy(*line, "super").agg(F.array_sort(F.collect_list(F.struct("no", "table"))).alias("steps"))

    def compose(acc: Column, t: Column) -> Column:
        now = F.transform(acc["state"], lambda e: F.when(acc["no"] == t["no"] - 1, e).otherwise(F.lit(0)))
        return F.struct(t["no"].alias("no"), F.transform(now, lambda e: t["table"][e]).alias("state"))

    whole = F.aggregate("steps", F.struct((F.col("super") * group - 1).alias("no"), entries.alias("state")), compose)
    # A group whose last block has no hits lets every state end.
    whole = F.when(whole["no"] == F.col("super") * group + (group - 1), whole["state"]).otherwise(F.transform(entries, lambda e: F.lit(0)))
    supers = inner.select(*line, F.struct(F.col("super").alias("no"), whole.alias("table")).alias("s")).groupBy(*line).agg(F.array_sort(F.collect_list("s")).alias("steps"))
    starts = supers.select(*line, F.inline(_states(F.col("steps"), F.lit(-1), F.lit(0)))).withColumnRenamed("no", "super")
    return inner.join(starts, [*line, "super"]).select(*line, F.inline(_states(F.col("steps"), F.col("super") * group - 1, F.col("free"))))


def motif_hits_nonoverlapping(contigs: DataFrame, pattern: str, core: int = CORE, group: int = 256) -> DataFrame:
    """M1 parity form: left-to-right non-overlapping exact hits per strand.

    Which hits survive depends on every earlier one, so blocks of `core` starts hand their state over by small tables
    (`_handed_over`); no row, array or window covers a contig.
    """
    pattern = S.check_pattern(pattern)
    width = len(pattern)
    core = max(core, width)
    hit = F.struct(((F.col("start") - 1) % core).cast("int").alias("at"), "found_seq")
    blocks = cut(motif_hits(contigs, pattern).withColumn("no", F.floor((F.col("start") - 1) / core).cast("bigint")).groupBy(
        "contig_id", "strand", "no").agg(F.array_sort(F.collect_list(hit)).alias("hits")))
    none = F.expr("cast(array() as array<struct<at:int,found_seq:string>>)")
    walk = F.aggregate("hits", F.struct(F.col("free").alias("free"), none.alias("kept")), lambda acc, h: F.when(
        h["at"] >= acc["free"], F.struct((h["at"] + width).alias("free"), F.array_append(acc["kept"], h).alias("kept"))).otherwise(acc))
    kept = blocks.join(_handed_over(blocks, width, core, group), ["contig_id", "strand", "no"]).select("contig_id", "strand", "no", F.inline(walk["kept"]))
    start = (F.col("no") * core + F.col("at") + 1).cast("bigint")
    return kept.select("contig_id", start.alias("start"), (start + (width - 1)).alias("end"), "strand", F.lit(pattern).alias("pattern"), "found_seq", F.lit(0).alias("mismatches"))


def batch_motif_hits(
    contigs: DataFrame, queries: dict[str, str], max_mismatches: int = 0,
    strand_policy: str = "skip_palindrome",
) -> DataFrame:
    """M7: several literal queries in a single pass over the genome.

    Rows are tagged with the query's whole header. Use `batch_motif_join` when the queries are a table.
    """
    tests = []
    for name, raw in queries.items():
        pattern = S.check_pattern(raw)
        rc = S.reverse_complement_text(pattern)
        tests.append((name, "+", pattern, pattern))
        if strand_policy == "both" or rc != pattern:
            tests.append((name, "-", pattern, rc))
    longest = max(len(t[2]) for t in tests)
    shortest = min(len(t[2]) for t in tests)
    bases, at = F.col("bases"), F.col("at")
    pos = F.col("offset") + at
    # The last windows of a contig are shorter than the longest query, so chunks are cut
    # for the shortest one and carry the difference.
    chunks = chunk(contigs, shortest, CORE, longest)
    spots = with_other_strand(chunks).withColumn("at", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(CORE), F.col("contig_len") - F.col("offset") - (shortest - 1)))))
    rows = []
    for i, (name, strand, pattern, scanned) in enumerate(tests):
        count = F.lit(0) if max_mismatches == 0 else S.mismatches_at(bases, at, scanned)
        ok = S.matches_at(bases, at, scanned) if max_mismatches == 0 else count <= max_mismatches
        rows.append((i, name, strand, pattern, count, (pos + (len(pattern) - 1) <= F.col("contig_len")) & ok))
    which = F.col("which")
    found = spots.where(S.either([r[5] for r in rows])).withColumn("which", F.explode(F.array(*[F.lit(r[0]) for r in rows])))
    found = found.where(S.by_case([(which == r[0], r[5]) for r in rows]))
    pick = lambda j: S.by_case([(which == r[0], F.lit(r[j])) for r in rows])
    found = found.select(
        pick(1).alias("query"), "contig_id", pos.cast("bigint").alias("start"), pick(2).alias("strand"),
        pick(3).alias("pattern"), S.by_case([(which == r[0], r[4]) for r in rows]).cast("int").alias("mismatches"),
        "bases", "rc_bases", "at")
    width = F.length("pattern")
    return found.select(
        "query", "contig_id", "start", (F.col("start") + width - 1).cast("bigint").alias("end"), "strand", "pattern",
        oriented(F.col("strand"), at, width).alias("found_seq"), "mismatches")


#: A seed of this many letters meets a random position with probability 4 ** -8; spelled out it has 65,536 forms at most.
LONGEST_SEED = 8


def batch_motif_join(
    contigs: DataFrame, queries: DataFrame, max_mismatches: int = 0, seed: int | None = None,
    strand_policy: str = "skip_palindrome",
) -> DataFrame:
    """M7 for a table of queries (query, pattern): a seeded equi-join, not a product.

    A window with at most k mismatches leaves one of k+1 disjoint pieces of the pattern
    intact. Each piece's first `seed` letters, with ambiguity codes spelled out, become join
    keys against the genome's k-mers; candidates are then verified in full. Unless given, `seed` is the whole piece of the
    shortest pattern, at most `LONGEST_SEED` letters, so that chance candidates are few and keys many. Every pattern
    needs at least (k+1)*seed letters; shorter ones raise at run time.
    """
    k = max_mismatches
    if seed is None:
        shortest = queries.agg(F.min(F.length("pattern"))).first()[0] or 0
        seed = max(1, min(LONGEST_SEED, shortest // (k + 1)))
    spelled = F.create_map(*[F.lit(x) for c, b in S.IUPAC.items() for x in (F.lit(c), F.array(*map(F.lit, b)))])
    q = queries.select(
        "query", F.upper("pattern").alias("pattern"),
    ).withColumn("rc", S.reverse_complement("pattern")).select(
        "query", "pattern",
        F.explode(F.array_compact(F.array(
            F.struct(F.lit("+").alias("strand"), F.col("pattern").alias("scanned")),
            F.when(F.lit(strand_policy == "both") | (F.col("rc") != F.col("pattern")),
                   F.struct(F.lit("-").alias("strand"), F.col("rc").alias("scanned"))),
        ))).alias("s"),
    ).select("query", "pattern", "s.strand", "s.scanned")
    piece = F.floor(F.length("scanned") / (k + 1)).cast("int")
    q = q.withColumn("piece", F.when(piece >= seed, piece).otherwise(
        F.raise_error(F.concat(F.lit("pattern too short for its seeds: "), F.col("pattern"))).cast("int")))
    seeds = q.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k)))).withColumn(
        "lead", F.col("j") * F.col("piece")
    ).withColumn("kmer", F.explode(F.aggregate(
        F.transform(F.split(F.substring("scanned", F.col("lead") + 1, F.lit(seed)), ""), lambda c: spelled[c]),
        F.array(F.lit("")),
        lambda acc, letters: F.flatten(F.transform(acc, lambda a: F.transform(letters, lambda b: F.concat(a, b)))),
    ))).select("query", "pattern", "strand", "scanned", "lead", "kmer")

    # Only positions travel to the join; the windows of candidates are cut afterwards.
    spots = (
        padded_chunks(contigs, seed, 0, seed)
        .withColumn("pos", F.explode(F.sequence(
            F.col("offset") + 1, F.least(F.col("offset") + 4096, F.col("contig_len") - (seed - 1)))))
        .select("contig_id", "contig_len", "pos",
                F.substring("bases", (F.col("pos") - F.col("cut")).cast("int"), F.lit(seed)).cast("string").alias("kmer"))
    )
    start = (F.col("pos") - F.col("lead")).cast("bigint")
    end = (start + F.length("scanned") - 1).cast("bigint")
    # What follows from the pattern is made again afterwards; candidates are many and travel twice.
    cand = spots.join(seeds, "kmer").where((start >= 1) & (end <= F.col("contig_len"))).select(
        "query", "contig_id", start.alias("start"), "strand", "pattern").distinct()
    end = (F.col("start") + F.length("pattern") - 1).cast("bigint")
    cand = fetch_region(cand, contigs, F.col("start"), end, "window").withColumns({
        "end": end, "scanned": F.when(F.col("strand") == "+", F.col("pattern")).otherwise(S.reverse_complement("pattern"))})
    hits = cand.withColumn("mismatches", S.mismatch_count("scanned", "window")).where(F.col("mismatches") <= k)
    return hits.select(
        "query", "contig_id", "start", "end", "strand", "pattern",
        F.when(F.col("strand") == "+", F.col("window")).otherwise(S.reverse_complement("window")).alias("found_seq"),
        "mismatches",
    )


def pattern_palindromes(contigs: DataFrame, pattern: str, max_mismatches: int = 0) -> DataFrame:
    """M4: pattern hits that are palindromic within k, one row per locus, 1-based.

    `mismatches` counts pattern positions that differ letter by letter, so an
    ambiguity code in the pattern always counts.
    """
    pattern = S.check_pattern(pattern)
    width = len(pattern)
    bases, at = F.col("bases"), F.col("at")
    hit = _positions(chunk(contigs, width), width).where(S.matches_at(bases, at, pattern))
    letters = S.total([
        F.when(S.base_at(bases, at + i) == F.lit(c.encode()), 0).otherwise(1) for i, c in enumerate(pattern)
    ])
    return hit.select(
        "contig_id", (F.col("offset") + at).cast("bigint").alias("start"),
        (F.col("offset") + at + (width - 1)).cast("bigint").alias("end"),
        F.lit(pattern).alias("pattern"), F.substring("bases", at, F.lit(width)).cast("string").alias("found_seq"),
        letters.cast("int").alias("mismatches"),
    ).where(S.palindrome_mismatches("found_seq") <= max_mismatches)


def region_palindromes(
    contigs: DataFrame, start: int = 1, end: int | None = None, min_length: int = 6,
    max_length: int = 30, max_mismatches: int = 0,
) -> DataFrame:
    """M5: every palindromic window of the region, nested ones included, on both strands.

    A window is a palindrome on one strand exactly when it is on the other, so one test
    serves both rows; the '-' row reports the reverse complement.
    """
    region = region_of(contigs, start, end)
    # Longer windows need bases past the ones the shortest window does.
    chunks = with_other_strand(chunk(region, min_length, 4096, max_length))
    bases, rc, at, size = F.col("bases"), F.col("rc_bases"), F.col("at"), F.col("size")
    spots = (
        chunks.withColumn("size", F.explode(F.sequence(F.lit(min_length), F.lit(max_length))))
        .where(F.length("bases") >= size)
        .withColumn("at", F.explode(F.sequence(F.lit(1), F.least(F.lit(4096), F.length("bases") - size + 1))))
    )
    if max_mismatches == 0:
        half = F.floor(size / 2).cast("int")
        spots = spots.where(
            F.substring(bases, at, half) == F.substring(rc, F.length("bases") - at - size + 2, half))
        count = F.lit(0)
    else:
        count = S.palindrome_mismatches_at(bases, rc, at, size, max_length)
        spots = spots.where(count <= max_mismatches)
    on = F.col("strand")
    return spots.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-")))).select(
        "contig_id", (F.col("offset") + at + (start - 1)).cast("bigint").alias("start"),
        (F.col("offset") + at + size + (start - 2)).cast("bigint").alias("end"), "strand",
        F.lit("Palindrome").alias("pattern"), oriented(on, at, size).alias("found_seq"),
        count.cast("int").alias("mismatches"),
    )


def fetch_region(
    rows: DataFrame, contigs: DataFrame, first: Column, last: Column, out: str = "region_seq", core: int = 4096,
) -> DataFrame:
    """Add the bases [first, last] (1-based, clipped to the contig) to each row, whatever their number, and contig_len.

    A region is cut from each chunk that it touches and put together in chunk order, so no row
    ever meets its whole contig. Equal regions are read once; rows of unknown contigs drop out.
    Chunk 0 is asked for as well: every contig has it, and it knows the contig's length.
    Both joins are merges: Spark takes rows and chunks for as small as their compressed files and would send them all through the driver.
    """
    chunks = chunk(contigs, 1, core).withColumn("chunk_no", F.floor(F.col("offset") / core).cast("bigint"))
    keyed = rows.withColumns({"_first": F.greatest(first, F.lit(1)).cast("bigint"), "_last": last.cast("bigint")})
    at = ["contig_id", "_first", "_last"]
    begin = F.greatest(F.col("_first") - F.col("offset"), F.lit(1))
    end = F.least(F.col("_last") - F.col("offset"), F.lit(core))
    zero = F.array(F.lit(0).cast("bigint"))
    numbers = F.when(F.col("_first") <= F.col("_last"), F.array_union(zero, F.sequence(
        F.floor((F.col("_first") - 1) / core).cast("bigint"), F.floor((F.col("_last") - 1) / core).cast("bigint")))).otherwise(zero)
    pieces = (
        keyed.select(at).distinct().withColumn("chunk_no", F.explode(numbers)).join(chunks.hint("merge"), ["contig_id", "chunk_no"])
        .select(*at, "contig_len", F.struct("chunk_no", F.when(end >= begin, F.substring(
            "bases", begin.cast("int"), (end - begin + 1).cast("int")).cast("string")).otherwise("").alias("part")).alias("p"))
    )
    whole = pieces.groupBy(at).agg(F.array_join(F.array_sort(F.collect_list("p"))["part"], "").alias(out), F.max("contig_len").alias("contig_len"))
    return keyed.drop("contig_len").hint("merge").join(whole, at).withColumn("_last", F.least("_last", "contig_len"))


def palindrome_context(hits: DataFrame, contigs: DataFrame, context: int, max_mismatches: int = 0) -> DataFrame:
    """M6: extend each hit by `context` bases on both sides and test the whole."""
    wide = fetch_region(hits, contigs, F.col("start") - context, F.col("end") + context, "context_seq")
    flag = S.is_palindrome("context_seq", max_mismatches)
    return wide.withColumn("is_palindrome", flag).withColumn(
        "palindrome_seq", F.when(F.col("is_palindrome"), F.col("context_seq")).otherwise("")
    ).drop("_first", "_last", "contig_len")


def flanked_targets(hits: DataFrame, contigs: DataFrame, left: int, right: int) -> DataFrame:
    """Strand-aware flanks around each hit, with the 0-based half-open label."""
    minus = F.col("strand") == "-"
    up = F.when(minus, right).otherwise(left)
    down = F.when(minus, left).otherwise(right)
    wide = fetch_region(hits, contigs, F.col("start") - up, F.col("end") + down, "flanked")
    return wide.withColumn("target_seq", F.when(minus, S.reverse_complement("flanked")).otherwise(F.col("flanked"))) \
        .withColumn("coordinates", F.concat_ws("-", F.col("_first") - 1, F.col("_last"))) \
        .drop("flanked", "_first", "_last", "contig_len")


def genome_bins(lengths: DataFrame, size: int = 10_000) -> DataFrame:
    """Fixed-size 1-based bins of each contig (contig_id, contig_len); the last may be short."""
    first = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("contig_len").cast("bigint"), F.lit(size).cast("bigint")))
    return lengths.where(F.col("contig_len") >= 1).select("contig_id", "contig_len", first.alias("bin_start")).select(
        "contig_id", F.floor((F.col("bin_start") - 1) / size).cast("bigint").alias("bin_no"), "bin_start",
        F.least(F.col("bin_start") + (size - 1), F.col("contig_len")).cast("bigint").alias("bin_end"))
