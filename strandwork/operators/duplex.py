"""Small-RNA duplex search with G-U wobble.

Every sRNA window is compared with every genome window of the same length on both
strands. Because each position must pair, the first bases of an sRNA window fix a
short list of genome k-mers, so the comparison is an equi-join on those k-mers
followed by a full check, not a product of the two window sets.
"""
from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequence as S
from .scan import both_strands, chunk, fetch_region, padded_chunks, with_bases

# The Arrow function travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CORE = 4096


def srna_seeds(srnas: DataFrame, seed: int, wobble: bool = True) -> DataFrame:
    """Genome k-mers that pair with each sRNA k-mer base by base (srna_id, srna, s_start, kmer)."""
    partners = {"A": ["T"], "C": ["G"], "G": ["C", "T"] if wobble else ["C"], "T": ["A", "G"] if wobble else ["A"]}
    pairs = F.create_map(*[F.lit(x) for b, o in partners.items() for x in (F.lit(b), F.array(*map(F.lit, o)))])
    base = (
        srnas.select("srna_id", S.to_dna("srna").alias("srna"))
        .where(F.col("srna").rlike("^[ACGT]+$") & (F.length("srna") >= seed))
        .withColumn("s_start", F.explode(F.sequence(F.lit(1), F.length("srna") - (seed - 1))))
    )
    spelled = F.aggregate(
        F.transform(F.split(F.substring("srna", F.col("s_start"), F.lit(seed)), ""), lambda c: pairs[c]),
        F.array(F.lit("")),
        lambda acc, opts: F.flatten(F.transform(acc, lambda a: F.transform(opts, lambda o: F.concat(a, o)))),
    )
    return base.select("srna_id", "srna", "s_start", F.explode(spelled).alias("kmer"))


def _exact_seeds(srnas: DataFrame, seed: int, carry: list[str] | None = None) -> DataFrame:
    """srna_id, `carry` (of srna), s_start and seed_rc of each k-mer.

    k-mers are slices of chunks of bytes, at equal cost wherever they lie in a sequence, and a chunk is turned around once for all of them.
    """
    # Places count characters, and no character of several bytes is part of a seed.
    plain = F.when(F.octet_length("srna") == F.length("srna"), F.col("srna")).otherwise(F.regexp_replace("srna", r"[^\x00-\x7F]", "?"))
    rows = srnas.select(F.col("srna_id").alias("contig_id"), F.upper("srna").alias("srna")).withColumn("seq", plain)
    text, at = F.col("bases").cast("string"), F.col("at")
    chunks = chunk(rows, seed, CORE, None, carry).withColumns({"clean": text.rlike(S.RNA_PATTERN), "rc": S.reverse_complement(S.to_dna(text)).cast("binary")})
    spots = chunks.withColumn("at", F.explode(F.sequence(F.lit(1), F.length("bases") - (seed - 1))))
    spots = spots.where(F.col("clean") | F.substring("bases", at, F.lit(seed)).cast("string").rlike(S.RNA_PATTERN))
    return spots.select(
        F.col("contig_id").alias("srna_id"), *(carry or []), (F.col("offset") + at).cast("int").alias("s_start"),
        F.substring("rc", F.length("rc") - at - (seed - 2), F.lit(seed)).cast("string").alias("seed_rc"))


# M10
def seed_index(srnas: DataFrame, seed: int) -> DataFrame:
    """Reverse complement of each sRNA k-mer and its position; k-mers with other letters are skipped."""
    return _exact_seeds(srnas, seed)


def _oriented_kmers(contigs: DataFrame, seed: int, reach: int) -> DataFrame:
    """k-mers of both strands in the coordinates of each strand, with the bases that follow."""
    chunks = chunk(both_strands(contigs), seed, CORE, reach, ["strand"])
    at = F.explode(F.sequence(F.lit(1), F.least(F.lit(CORE), F.col("contig_len") - F.col("offset") - (seed - 1))))
    return chunks.withColumn("at", at).select(
        "contig_id", "contig_len", "strand", (F.col("offset") + F.col("at")).alias("pos"),
        F.substring("bases", F.col("at"), F.lit(seed)).cast("string").alias("kmer"),
        F.substring("bases", F.col("at"), F.lit(reach)).cast("string").alias("ahead"),
    )


def _pair_counts(a: Column, b: Column) -> tuple[Column, Column]:
    """(positions that neither pair nor wobble, wobble positions) of two equally long strings."""
    both = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.concat(x, y))
    bad = F.size(F.filter(both, lambda p: ~p.isin(*S.WATSON_CRICK, *S.WOBBLE)))
    gu = F.size(F.filter(both, lambda p: p.isin(*S.WOBBLE)))
    return bad, gu


# M9
def window_sizes(text: str | None, default: int = 14) -> list[int]:
    """`8-14` or `8,10,12`; nothing means the default size."""
    if not text:
        return [default]
    if "-" in text:
        low, high = sorted(int(x) for x in text.split("-", 1))
        return list(range(low, high + 1))
    return sorted({int(x) for x in text.split(",") if x.strip()})


# M8, M9
def duplex_hits(
    contigs: DataFrame, srnas: DataFrame, windows: list[int], max_gu: int = 2, seed: int | None = None,
) -> DataFrame:
    """All fixed-length duplex windows of each size in `windows`, on both strands.

    `gu_seed` counts wobbles against the scanned strand and `gu_reported` against the
    forward target sequence, which is what a '-' row shows; both obey `max_gu`.
    Coordinates are 1-based on the forward strand.
    """
    sizes = sorted({w for w in windows if w > 0})
    seed = min(seed or 8, sizes[0])
    spots = _oriented_kmers(with_bases(contigs, S.to_dna), seed, sizes[-1])
    cand = spots.join(srna_seeds(srnas, seed), "kmer").withColumn(
        "window", F.explode(F.array(*[F.lit(w) for w in sizes])))
    w = F.col("window")
    cand = cand.where(
        (F.col("pos") + w - 1 <= F.col("contig_len")) & (F.col("s_start") + w - 1 <= F.length("srna"))
    ).select(
        "contig_id", "srna_id", "window", "strand", "s_start", "contig_len", "pos",
        F.substring("srna", F.col("s_start"), w).alias("srna_seq"),
        F.substring("ahead", F.lit(1), w).alias("scanned"),
    )
    bad, gu = _pair_counts(F.col("srna_seq"), F.col("scanned"))
    hit = cand.withColumns({"bad": bad, "gu_seed": gu}).where((F.col("bad") == 0) & (F.col("gu_seed") <= max_gu))
    minus = F.col("strand") == "-"
    hit = hit.withColumn("target_seq", F.when(minus, S.reverse_complement("scanned")).otherwise(F.col("scanned")))
    _, shown = _pair_counts(F.col("srna_seq"), F.col("target_seq"))
    first = F.when(minus, F.col("contig_len") - F.col("pos") - w + 2).otherwise(F.col("pos"))
    return hit.withColumn("gu_reported", shown).where(F.col("gu_reported") <= max_gu).select(
        "contig_id", "srna_id", "window", F.col("s_start").cast("bigint").alias("srna_start"),
        (F.col("s_start") + w - 1).cast("bigint").alias("srna_end"), "gu_seed", "gu_reported", "strand",
        first.cast("bigint").alias("start"), (first + w - 1).cast("bigint").alias("end"), "srna_seq", "target_seq",
        F.when(minus, F.col("scanned")).otherwise(F.col("target_seq")).alias("genome_forward"),
        F.when(minus, F.col("target_seq")).otherwise(S.reverse_complement("target_seq")).alias("genome_revcomp"),
    )


# M12
def dedupe_duplex(hits: DataFrame) -> DataFrame:
    """One row per (sRNA region, G-U count, sequences, target region): smallest window, '+' first."""
    key = ["contig_id", "srna_id", "srna_start", "srna_end", "gu_reported", "srna_seq", "start", "end", "target_seq"]
    rest = [c for c in hits.columns if c not in key]
    rank = F.struct(F.col("window"), (F.col("strand") == "-").alias("minus"), *[F.col(c).alias(f"r_{c}") for c in rest])
    kept = hits.groupBy(*key).agg(F.min(rank).alias("best"))
    return kept.select(*[(f"best.r_{c}" if c in rest else c) for c in hits.columns]).toDF(*hits.columns)


def duplex_table(located: DataFrame) -> DataFrame:
    """The export columns of the duplex report, from deduplicated hits with a `location`."""
    return located.select(
        F.col("window").alias("Window"), F.col("srna_start").alias("Start"), F.col("srna_end").alias("End"),
        F.col("gu_reported").alias("Wobble"), F.col("strand").alias("Strand"),
        F.col("srna_seq").alias("sRNA Sequence"), F.col("target_seq").alias("Target Sequence"),
        F.format_string("%s [%d,%d]", "location", "start", "end").alias("Location"),
    )


_EXTENT = T.StructType([
    T.StructField(n, T.IntegerType()) for n in ("srna_left", "srna_right", "target_left", "target_right")])
_PAIRS = {("A", "T"): 0, ("T", "A"): 0, ("C", "G"): 0, ("G", "C"): 0, ("G", "T"): 1, ("T", "G"): 1}


_COST = np.full((256, 256), 1 << 20, dtype=np.int64)
for (_a, _b), _c in _PAIRS.items():
    _COST[ord(_a), ord(_b)] = _c


def _letters(texts: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each text as a row of a matrix, and the lengths."""
    raw = [t.encode() for t in texts]
    width = max(map(len, raw), default=0)
    rows = np.frombuffer(b"".join(t.ljust(width, b" ") for t in raw), dtype=np.uint8).reshape(len(raw), width)
    return rows, np.array([len(t) for t in raw], dtype=np.int64)


def _walk(srna: tuple, target: tuple, i: np.ndarray, j: np.ndarray, di: int, left: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the steps that pair from (i, j) moving apart antiparallel, and the wobble budget left; all rows step together."""
    (s, n), (t, m) = srna, target
    steps, left, at = np.zeros(len(n), dtype=np.int64), left.copy(), np.arange(len(n))
    while len(at):
        a, b = i[at] + di * steps[at], j[at] - di * steps[at]
        ok = (a >= 0) & (a < n[at]) & (b >= 0) & (b < m[at])
        if most is not None:
            ok &= steps[at] < most[at]
        at, a, b = at[ok], a[ok], b[ok]
        cost = _COST[s[at, a], t[at, b]]
        ok = cost <= left[at]
        at = at[ok]
        left[at] -= cost[ok]
        steps[at] += 1
    return steps, left


@F.pandas_udf(_EXTENT)
def _extend(srna: pd.Series, target: pd.Series, s_at: pd.Series, t_at: pd.Series, seed: pd.Series, budget: pd.Series) -> pd.DataFrame:
    s, t = _letters(srna), _letters(target)
    i, j, k, b = (x.to_numpy(dtype=np.int64) for x in (s_at, t_at, seed, budget))
    # The seed is checked first, then the 3' side of the sRNA, then its 5' side, on one budget.
    got, left = _walk(s, t, i, j, 1, b, k)
    right, left = _walk(s, t, i + k, j - k, 1, left)
    before, _ = _walk(s, t, i - 1, j + 1, -1, left)
    found = np.stack([i - before, i + k - 1 + right, j - k + 1 - right, j + before], axis=1)
    found[got < k] = -1
    return pd.DataFrame(found.astype(np.int32), columns=["srna_left", "srna_right", "target_left", "target_right"])


# M11
def seed_and_extend(contigs: DataFrame, srnas: DataFrame, seed: int, max_gu: int) -> DataFrame:
    """Antiparallel seed and extension on the forward strand with one wobble budget.

    Exact seeds are an equi-join on the reverse-complement k-mer, to which only positions travel; the bases that the
    sRNA can reach from a seed are cut afterwards, whatever its length.
    """
    src = with_bases(contigs, S.to_dna)
    spots = (
        padded_chunks(src, seed, 0, seed, CORE)
        .withColumn("pos", F.explode(F.sequence(
            F.col("offset") + 1, F.least(F.col("offset") + CORE, F.col("contig_len") - (seed - 1)))))
        .select("contig_id", "pos", F.substring("bases", (F.col("pos") - F.col("cut")).cast("int"), F.lit(seed)).cast("string").alias("seed_rc"))
    )
    keyed = _exact_seeds(srnas.select("srna_id", S.to_dna("srna").alias("srna")), seed, ["srna"])
    reach = F.length("srna")
    cand = spots.join(keyed, "seed_rc").select("contig_id", "srna_id", "srna", "s_start", "pos")
    cand = fetch_region(cand, src, F.col("pos") - reach, F.col("pos") + (seed - 1) + reach, "near").withColumnRenamed("_first", "lead")
    ext = cand.withColumn("x", _extend(
        "srna", "near", F.col("s_start") - 1, F.col("pos") + (seed - 1) - F.col("lead"),
        F.lit(seed), F.lit(max_gu)))
    return ext.where(F.col("x.srna_left") >= 0).select(
        "contig_id", "srna_id", "s_start", F.col("pos").cast("bigint").alias("seed_start"),
        (F.col("x.srna_left") + 1).alias("srna_start"), (F.col("x.srna_right") + 1).alias("srna_end"),
        (F.col("lead") + F.col("x.target_left")).cast("bigint").alias("start"),
        (F.col("lead") + F.col("x.target_right")).cast("bigint").alias("end"))
