"""Scans, scalar functions, duplexes and alignment against small brute-force references."""
import random

import pytest
from pyspark.sql import functions as F

from strandwork.functions import sequence as S
from strandwork.operators import align, duplex, filters, scan

RNG = random.Random(7)
SEQS = {1: "".join(RNG.choice("ACGT") for _ in range(700)), 2: "".join(RNG.choice("AT") for _ in range(150)), 3: "ACG", 4: "",
        5: "ACGTNNACGTTTANNTATAATGN" * 5}


def rc(s):
    return s.translate(str.maketrans(S.COMPLEMENT_FROM, S.COMPLEMENT_TO))[::-1]


def mm(p, w):
    return sum(b not in S.IUPAC[a] for a, b in zip(p, w))


def brute(pattern, k, skip=False):
    out = set()
    for cid, seq in SEQS.items():
        for strand, q in (("+", pattern), ("-", rc(pattern))):
            if skip and strand == "-" and q == pattern:
                continue
            for i in range(len(seq) - len(q) + 1):
                w = seq[i:i + len(q)]
                if mm(q, w) <= k:
                    out.add((cid, i + 1, i + len(q), strand, w if strand == "+" else rc(w), mm(q, w)))
    return out


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame(list(SEQS.items()), "contig_id bigint, seq string").cache()


def rows(df, *cols):
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert len(got) == len(set(got)), "rows repeat"
    return set(got)


HIT = ("contig_id", "start", "end", "strand", "found_seq", "mismatches")


@pytest.mark.parametrize("pattern,k", [("TRTNAN", 0), ("TRTNAN", 1), ("ACGT", 0), ("TATRAATAATGA", 0), ("TATRAATAATGA", 4)])
def test_motif_hits(contigs, pattern, k):
    assert rows(scan.motif_hits(contigs, pattern, k), *HIT) == brute(pattern, k)


def test_strand_policy(contigs):
    assert rows(scan.motif_hits(contigs, "ACGT", 0, "skip_palindrome"), *HIT) == brute("ACGT", 0, skip=True)
    with pytest.raises(ValueError):
        scan.motif_hits(contigs, "ACGT", 0, "sometimes")
    with pytest.raises(ValueError):
        scan.motif_hits(contigs, "AXGT")


@pytest.mark.parametrize("core", [16, 37, 128])
def test_hits_do_not_depend_on_chunk_size(contigs, core, monkeypatch):
    monkeypatch.setattr(scan.chunk, "__defaults__", (core, None, None))
    monkeypatch.setattr(scan, "CORE", core)
    assert rows(scan.motif_hits(contigs, "TRTNAN", 1), *HIT) == brute("TRTNAN", 1)
    batch = scan.batch_motif_hits(contigs, {">a": "TRTNAN", ">b": "ACG"}, 1)
    assert rows(batch.where("query = '>a'"), *HIT) == brute("TRTNAN", 1)
    assert rows(batch.where("query = '>b'"), *HIT) == brute("ACG", 1)


def test_nonoverlapping(contigs):
    import re

    want = set()
    for cid, seq in SEQS.items():
        for strand, q in (("+", "TANNTA"), ("-", "TANNTA")):
            for m in re.finditer(S.iupac_regex(q), seq):
                want.add((cid, m.start() + 1, strand))
    assert rows(scan.motif_hits_nonoverlapping(contigs, "TANNTA"), "contig_id", "start", "strand") == want


def test_batch_join_equals_scan(spark, contigs):
    queries = {">first query": "TRTNANGA", ">second": "ACGTACRT"}
    table = spark.createDataFrame(list(queries.items()), "query string, pattern string")
    cols = ("query", "contig_id", "start", "end", "strand", "found_seq", "mismatches")
    for k, seed in ((0, None), (1, None), (2, 2)):
        assert rows(scan.batch_motif_join(contigs, table, k, seed), *cols) == rows(scan.batch_motif_hits(contigs, queries, k), *cols)


def pal(w):
    return sum(S.COMPLEMENT_TO[S.COMPLEMENT_FROM.index(a)] != b for a, b in zip(w[:len(w) // 2], reversed(w)))


@pytest.mark.parametrize("k", [0, 1])
def test_region_palindromes(contigs, k):
    want = set()
    for cid, seq in SEQS.items():
        region = seq[9:300]
        for n in range(4, 10):
            for i in range(len(region) - n + 1):
                w = region[i:i + n]
                if pal(w) <= k:
                    want |= {(cid, i + 10, i + 9 + n, "+", w, pal(w)), (cid, i + 10, i + 9 + n, "-", rc(w), pal(w))}
    assert rows(scan.region_palindromes(contigs, 10, 300, 4, 9, k), *HIT) == want


def test_flanks_and_context(contigs):
    hits = scan.motif_hits(contigs, "TRTNAN")
    for r in scan.flanked_targets(hits, contigs, 7, 4).collect():
        seq, up, down = SEQS[r.contig_id], (7, 4)[r.strand == "-"], (4, 7)[r.strand == "-"]
        a, b = max(0, r.start - 1 - up), min(len(seq), r.end + down)
        assert r.coordinates == f"{a}-{b}"
        assert r.target_seq == (seq[a:b] if r.strand == "+" else rc(seq[a:b]))
    for r in scan.palindrome_context(hits, contigs, 3, 2).collect():
        whole = SEQS[r.contig_id][max(0, r.start - 4):r.end + 3]
        assert r.is_palindrome == (pal(whole) <= 2) and r.palindrome_seq == (whole if r.is_palindrome else "")


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ACGTRYSWKMBDHVN", "ACG"), ("acguAA", "AC-T")], "a string, b string")
    got = df.select(S.reverse_complement("a"), S.mismatch_count(F.lit("RCG"), "b"), S.palindrome_mismatches("b"),
                    S.identity_line("b", F.lit("AC-A")), S.identity_line("b", F.lit("AC-A"), False), S.is_rna("a")).collect()
    assert got[0][0] == rc("ACGTRYSWKMBDHVN") and got[0][1:] == (0, 1, "** ", "** ", False)
    assert got[1][1] == 1 and got[1][3:] == ("*** ", "**  ", True)


PAIR = {("A", "T"): 0, ("T", "A"): 0, ("C", "G"): 0, ("G", "C"): 0, ("G", "T"): 1, ("T", "G"): 1}
RNA = "GGAUGUUCACGAAGUUCC"


def test_duplex_hits(spark, contigs):
    want = set()
    rna = RNA.replace("U", "T")
    for cid, seq in SEQS.items():
        for w in (4, 6):
            for strand, g in (("+", seq), ("-", rc(seq))):
                for p in range(len(g) - w + 1):
                    for s in range(len(rna) - w + 1):
                        sub, scanned = rna[s:s + w], g[p:p + w]
                        cost = [PAIR.get(x) for x in zip(sub, scanned)]
                        if None in cost or sum(cost) > 2:
                            continue
                        start = p + 1 if strand == "+" else len(seq) - p - w + 1
                        target = scanned if strand == "+" else rc(scanned)
                        shown = sum(x in (("G", "T"), ("T", "G")) for x in zip(sub, target))
                        if shown <= 2:
                            want.add((cid, w, strand, s + 1, start, target, sum(cost), shown))
    srna = spark.createDataFrame([("r", RNA)], "srna_id string, srna string")
    hits = duplex.duplex_hits(contigs, srna, [4, 6], 2)
    assert rows(hits, "contig_id", "window", "strand", "srna_start", "start", "target_seq", "gu_seed", "gu_reported") == want
    kept = duplex.dedupe_duplex(hits)
    assert kept.columns == hits.columns
    key = {(c, w, s, st, t, sh) for c, w, _, s, st, t, _, sh in want}
    assert rows(kept, "contig_id", "window", "srna_start", "start", "target_seq", "gu_reported") == key
    assert duplex.window_sizes("8-10") == [8, 9, 10] and duplex.window_sizes("8,12") == [8, 12] and duplex.window_sizes(None) == [14]


def test_seed_and_extend(spark, contigs):
    def extend(s, g, i, anchor, k, budget):
        left = budget
        sr, gr = i + k, anchor - k
        while sr < len(s) and gr >= 0 and (c := PAIR.get((s[sr], g[gr]))) is not None and c <= left:
            left -= c
            sr, gr = sr + 1, gr - 1
        sl, gl = i - 1, anchor + 1
        while sl >= 0 and gl < len(g) and (c := PAIR.get((s[sl], g[gl]))) is not None and c <= left:
            left -= c
            sl, gl = sl - 1, gl + 1
        return sl + 2, sr, gr + 2, gl

    rna, k, want = RNA.replace("U", "T"), 4, set()
    for cid, seq in SEQS.items():
        for i in range(len(rna) - k + 1):
            seed = rc(rna[i:i + k])
            for p in range(len(seq) - k + 1):
                if seq[p:p + k] == seed:
                    want.add((cid, i + 1, p + 1, *extend(rna, seq, i, p + k - 1, k, 1)))
    srna = spark.createDataFrame([("r", RNA)], "srna_id string, srna string")
    got = duplex.seed_and_extend(contigs, srna, k, 1)
    assert rows(got, "contig_id", "s_start", "seed_start", "srna_start", "srna_end", "start", "end") == want


def plain_align(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                t[i][j] = -2 * (i + j)
            else:
                t[i][j] = max(t[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), t[i - 1][j] - 2, t[i][j - 1] - 2)
    x, y, i, j = "", "", len(a), len(b)
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1):
            i, j, x, y = i - 1, j - 1, a[i - 1] + x, b[j - 1] + y
        elif i and (not j or t[i][j] == t[i - 1][j] - 2):
            i, x, y = i - 1, a[i - 1] + x, "-" + y
        else:
            j, x, y = j - 1, "-" + x, b[j - 1] + y
    return x, y, t[-1][-1]


def test_pairwise_alignment(spark, monkeypatch):
    word = lambda: "".join(RNG.choice("ACGT") for _ in range(RNG.randint(0, 14)))
    pairs = [(i, word(), word()) for i in range(60)] + [(99, "", ""), (98, "ACGT", "")]
    got = align.pairwise_align(spark.createDataFrame(pairs, "id int, seq_a string, seq_b string")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert (r.aligned_a, r.aligned_b, r.score) == plain_align(r.seq_a, r.seq_b)
        assert r.aligned_a.replace("-", "") == r.seq_a and r.aligned_b.replace("-", "") == r.seq_b
    monkeypatch.setattr(align, "_CELLS", 300)
    assert align._align_all([p[1] for p in pairs], [p[2] for p in pairs]) == [plain_align(p[1], p[2]) for p in pairs]


def test_consensus_and_best_window(spark):
    rows_ = [("g", "AT-G"), ("g", "TT-C"), ("g", "ACA"), ("h", "--")]
    got = dict(align.consensus(spark.createDataFrame(rows_, "group_id string, aligned_seq string")).collect())
    assert got == {"g": "ATAG", "h": "AA"}
    t = spark.createDataFrame([("x", "TTACGA"), ("y", "AC")], "name string, target_seq string")
    best = {r.name: (r.best_mm, r.best_at, r.best_window) for r in align.best_windows(t, {"r": "ACGN"}).collect()}
    assert best == {"x": (0, 3, "ACGA"), "y": (0, 1, "AC")}


def test_filters(spark, contigs):
    hits = scan.motif_hits(contigs, "TRTNAN")
    assert filters.filter_or_all(hits, F.col("mismatches") > 3).count() == hits.count()
    span = spark.createDataFrame([(1, 100)], "start int, end int")
    assert span.where(filters.touches_region(10, 20)).count() == 0
    assert span.where(filters.overlaps_region(10, 20)).count() == 1
    nums = filters.number_hits(hits, 50).where("contig_id = 1").orderBy("match_no").collect()
    assert [r.match_no for r in nums] == list(range(1, len(nums) + 1))
    assert [(r.start, r.strand) for r in nums] == sorted((r.start, r.strand) for r in nums)


@pytest.mark.parametrize("core", [16, 4096])
def test_regions_of_any_length(spark, core):
    rng = random.Random(5)
    seqs = {k: "".join(rng.choice("ACGT") for _ in range(n)) for k, n in ((1, 700), (2, 33))}
    contigs = spark.createDataFrame(list(seqs.items()), "contig_id long, seq string")
    rows = [(rng.choice([1, 2]), a := rng.randint(-20, 720), a + rng.randint(0, 500)) for _ in range(60)]
    rows += [rows[0], rows[0], (1, 5, 10**9), (1, 800, 900), (9, 1, 5)]
    df = spark.createDataFrame(rows, "contig_id long, start long, end long")
    got = scan.fetch_region(df, contigs, F.col("start"), F.col("end"), core=core).collect()
    want = [(c, a, b, seqs[c][max(a, 1) - 1:max(b, 0)]) for c, a, b in rows if c in seqs]
    assert sorted((r.contig_id, r.start, r.end, r.region_seq) for r in got) == sorted(want)


def test_queries_with_the_same_first_letters_stay_apart(spark):
    contigs = spark.createDataFrame([(1, "ACGTTGCAACGTACGGTTAAGGCCAA" * 20)], "contig_id long, seq string")
    names = ["x" * 40 + "a", "x" * 40 + "b"]
    table = spark.createDataFrame([(n, "ACGTTGCA" * 1) for n in names], "query string, pattern string")
    joined = scan.batch_motif_join(contigs, table, 1).collect()
    listed = scan.batch_motif_hits(contigs, dict.fromkeys(names, "ACGTTGCA"), 1).collect()
    assert {r.query for r in joined} == set(names)
    key = lambda r: (r.query, r.start, r.strand, r.found_seq, r.mismatches)
    assert sorted(map(key, joined)) == sorted(map(key, listed))
    long = "ACGTTGCAACGTACGGTTAAGGCCAA" * 12
    assert scan.batch_motif_join(contigs, spark.createDataFrame([("long", long)], table.schema), 1).count() > 0
