"""Sequences in pieces: readers by byte ranges, and scans that equal those of whole contigs for every block, piece and core size."""
import random
import re

import pytest
from pyspark.sql import functions as F

from strandwork.functions import sequence as S
from strandwork.operators import duplex, scan
from strandwork.sources import fasta, gff

RNG = random.Random(21)
SEQS = {"a": "".join(RNG.choice("ACGT") for _ in range(900)), "b": "AT" * 60, "c": "ACG", "d": "", "e": "ACGTNNTATAATGN" * 9, "f": "TA" * 200}
HIT = ("contig_id", "start", "end", "strand", "found_seq", "mismatches")


def lines(spark, block, width):
    rows, n = [], 0
    for k, (name, seq) in enumerate(SEQS.items()):
        text = [f">{name} some words", *(seq[i:i + width].lower() for i in range(0, len(seq), width)), "", None]
        for t in text:
            rows.append((f"file{k % 2}", n // block, n, t))
            n += 1
    RNG.shuffle(rows)
    return spark.createDataFrame(rows, "file string, block long, line long, value string").repartition(3)


@pytest.fixture(scope="module")
def whole(spark):
    return spark.createDataFrame(list(SEQS.items()), "contig_id string, seq string").cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("block,width,piece", [(1, 7, 3), (3, 60, 64), (5, 13, 20), (1000, 50, 1 << 16)])
def test_pieces_hold_every_base_once(spark, block, width, piece):
    got = {}
    for r in fasta.parse_pieces(lines(spark, block, width), piece=piece).orderBy("at").collect():
        assert 0 < len(r.bases) <= piece and r.contig_len == len(SEQS[r.contig_id]) and r.at == len(got.get(r.contig_id, ""))
        got[r.contig_id] = got.get(r.contig_id, "") + r.bases
    assert got == {k: v for k, v in SEQS.items() if v}


@pytest.mark.parametrize("piece,core", [(9, 16), (64, 37), (1 << 16, 128)])
def test_scans_of_pieces_equal_those_of_whole_contigs(spark, whole, piece, core, monkeypatch):
    pieces = fasta.parse_pieces(lines(spark, 4, 33), piece=piece).cache()
    monkeypatch.setattr(scan.chunk, "__defaults__", (core, None, None))
    monkeypatch.setattr(scan, "CORE", core)
    monkeypatch.setattr(duplex, "CORE", core)
    for run, cols in [
        (lambda c: scan.motif_hits(c, "TRTNAN", 1), HIT),
        (lambda c: scan.motif_hits(c, "ATATATATATAT"), HIT),
        (lambda c: scan.batch_motif_hits(c, {">a": "TRTNAN", ">b": "ACG"}, 1), ("query", *HIT)),
        (lambda c: scan.region_palindromes(c, 10, 300, 4, 9, 1), HIT),
        (lambda c: scan.pattern_palindromes(c, "TANNTA", 1), ("contig_id", "start", "found_seq")),
        (lambda c: scan.flanked_targets(scan.motif_hits(c, "TRTNAN"), c, 40, 5), ("contig_id", "start", "strand", "target_seq", "coordinates")),
        (lambda c: duplex.duplex_hits(c, spark.createDataFrame([("s", "GGAUGUUCACGAAGUUCC")], "srna_id string, srna string"), [6, 8], 2),
         ("contig_id", "window", "start", "strand", "target_seq", "srna_start")),
    ]:
        want = rows(run(whole), *cols)
        assert rows(run(pieces), *cols) == want and want


@pytest.mark.parametrize("pattern,core,group", [("TANNTA", 8, 2), ("TATA", 5, 3), ("NNNNNNN", 9, 2), ("TATATATATATA", 1, 2), ("TANNTA", 1 << 16, 256)])
def test_nonoverlapping_hits_equal_the_regex_walk(spark, whole, pattern, core, group):
    want = []
    for name, seq in SEQS.items():
        for strand, q in (("+", pattern), ("-", S.reverse_complement_text(pattern))):
            for m in re.finditer(S.iupac_regex(q), seq):
                want.append((name, m.start() + 1, m.end(), strand, m[0] if strand == "+" else S.reverse_complement_text(m[0]), 0))
    for contigs in (whole, fasta.parse_pieces(lines(spark, 4, 33), piece=50)):
        assert rows(scan.motif_hits_nonoverlapping(contigs, pattern, core, group), *HIT) == sorted(want)


@pytest.mark.parametrize("policy", ["records", "first_header", "all_headers", "bases_only"])
def test_one_file_is_read_by_many_tasks(spark, tmp_path, policy):
    text = ">one x\r\n" + "\n".join(SEQS["a"][i:i + 60] for i in range(0, 900, 60)) + "\n>two\n" + "acgnu\n" * 40
    (tmp_path / "g.fa").write_text(text)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        pieces = fasta.read_pieces(spark, str(tmp_path / "g.fa"), policy)
        assert spark.read.text(str(tmp_path / "g.fa")).rdd.getNumPartitions() > 4
        got = rows(scan.chunk(pieces, 1, 128).withColumn("seq", F.col("bases").cast("string")), "contig_id", "contig_len", "offset", "seq")
        if policy == "records":
            want = fasta.read_contigs(spark, str(tmp_path / "g.fa")).collect()
        else:
            want = fasta.read_genomes(spark, str(tmp_path / "g.fa"), policy).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == sorted((r.contig_id, len(r.seq), i, r.seq[i:i + 128]) for r in want for i in range(0, len(r.seq), 128))


def test_load_order_goes_by_file_and_place(spark, tmp_path):
    """Small files are packed with others and large ones are cut; the order stays that of names and places."""
    texts = {f"g{k}.gff": [f"c\tx\tgene\t{i + 1}\t{i + 9}\t.\t+\t.\tID=1;Name=n{k}_{i}" for i in range(n)] for k, n in enumerate((3, 120, 1, 40))}
    for name, rows_ in texts.items():
        (tmp_path / name).write_text("\n".join(rows_) + "\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted((r.ordinal, r.gene) for r in gff.read_genes(spark, str(tmp_path)).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [f"n{k}_{i}" for k, name in enumerate(texts) for i in range(len(texts[name]))]
    assert got == list(enumerate(want))
