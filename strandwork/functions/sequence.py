"""Scalar sequence functions as Catalyst expressions.

Everything here builds a `Column`; no Python runs per row. Sequences that are
indexed base by base are passed as BINARY: taking a slice of a BINARY value
costs the slice, while a STRING slice has to walk the text from its start.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fifteen IUPAC nucleotide codes and the bases each allows.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# Each code and its complement; U is read as T.
COMPLEMENT_FROM = "ACGTRYSWKMBDHVNU"
COMPLEMENT_TO = "TGCAYRSWMKVHDBNA"
# Watson-Crick pairs and G-U wobble pairs, T standing for U.
WATSON_CRICK = ("AT", "TA", "CG", "GC")
WOBBLE = ("GT", "TG")

IUPAC_PATTERN = "^[ACGTRYSWKMBDHVN]+$"
RNA_PATTERN = "^[ACGTU]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def every(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, terms)


def either(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, terms)


def by_case(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first condition that holds; the last one is the default."""
    out = cases[-1][1]
    for cond, value in reversed(cases[:-1]):
        out = F.when(cond, value).otherwise(out)
    return out


# F1
def reverse_complement(seq: Column | str) -> Column:
    """Reverse complement over IUPAC letters; letters outside them pass through."""
    return F.reverse(F.translate(col(seq), COMPLEMENT_FROM, COMPLEMENT_TO))


def reverse_complement_text(pattern: str) -> str:
    return pattern.upper().translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]


# F2
def iupac_regex(pattern: str) -> str:
    """A regular expression for a literal IUPAC pattern, for `rlike` and `split`."""
    parts = []
    for code in pattern.upper():
        allowed = IUPAC[code]
        parts.append(allowed if len(allowed) == 1 else f"[{allowed}]")
    return "".join(parts)


def check_pattern(pattern: str) -> str:
    pattern = pattern.strip().upper()
    bad = sorted(set(pattern) - set(IUPAC))
    if not pattern or bad:
        raise ValueError(f"not an IUPAC pattern: {pattern!r} (bad letters: {bad})")
    return pattern


# P11
def is_iupac(seq: Column | str) -> Column:
    return F.coalesce(F.upper(col(seq)).rlike(IUPAC_PATTERN), F.lit(False))


def is_rna(seq: Column | str) -> Column:
    return F.coalesce(F.upper(col(seq)).rlike(RNA_PATTERN), F.lit(False))


def base_at(bases: Column, at: Column) -> Column:
    """One byte of a BINARY sequence, 1-based."""
    return F.substring(bases, at, F.lit(1))


def fits(bases: Column, at: Column, code: str) -> Column:
    allowed = [F.lit(b.encode()) for b in IUPAC.get(code, code)]
    byte = base_at(bases, at)
    return byte == allowed[0] if len(allowed) == 1 else byte.isin(*allowed)


def matches_at(bases: Column, at: Column, pattern: str) -> Column:
    """Exact IUPAC match of a literal pattern at a position; stops at the first miss.

    Runs of unambiguous bases are compared as one slice.
    """
    terms, i = [], 0
    while i < len(pattern):
        j = i
        while j < len(pattern) and len(IUPAC[pattern[j]]) == 1:
            j += 1
        if j > i:
            terms.append(F.substring(bases, at + i, F.lit(j - i)) == F.lit(pattern[i:j].encode()))
            i = j
        else:
            terms.append(fits(bases, at + i, pattern[i]))
            i += 1
    return every(terms)


# F3
def mismatches_at(bases: Column, at: Column, pattern: str) -> Column:
    """IUPAC mismatches of a literal pattern laid on a BINARY sequence at `at`."""
    return total([F.when(fits(bases, at + i, code), 0).otherwise(1) for i, code in enumerate(pattern)])


def mismatch_count(pattern: Column | str, window: Column | str) -> Column:
    """IUPAC mismatches of two string columns over the length of the shorter one.

    The window base must be one of the bases the pattern code allows. Used when the
    pattern is data; `mismatches_at` is the faster form for a literal.
    """
    p, w = F.upper(col(pattern)), F.upper(col(window))
    allowed = F.create_map(*[F.lit(x) for pair in IUPAC.items() for x in pair])
    n = F.least(F.length(p), F.length(w))

    def step(acc: Column, i: Column) -> Column:
        code = F.substring(p, i, F.lit(1))
        ok = F.contains(F.coalesce(allowed[code], code), F.substring(w, i, F.lit(1)))
        return acc + F.when(ok, 0).otherwise(1)

    return F.when(n == 0, 0).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step))


# F4, F5
def palindrome_mismatches(seq: Column | str) -> Column:
    """Positions whose mirror is not the complement; a middle base is ignored."""
    s = F.upper(col(seq))
    rc = reverse_complement(s)
    half = F.floor(F.length(s) / 2).cast("int")
    pairs = F.zip_with(
        F.split(F.substring(s, F.lit(1), half), ""), F.split(F.substring(rc, F.lit(1), half), ""),
        lambda a, b: F.when(a == b, 0).otherwise(1),
    )
    return F.when(half < 1, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x))


def is_palindrome(seq: Column | str, max_mismatches: int = 0) -> Column:
    return palindrome_mismatches(seq) <= max_mismatches


def palindrome_mismatches_at(
    bases: Column, rc_bases: Column, at: Column, length: Column, max_length: int
) -> Column:
    """F4 for the window [at, at+length) of a chunk, given the chunk's reverse complement.

    Unrolled up to `max_length` so that it stays inside generated code although the
    length is a column.
    """
    mirror = F.length(bases) - at - length + 2
    half = F.floor(length / 2).cast("int")
    return total([
        F.when((half > j) & (base_at(bases, at + j) != base_at(rc_bases, mirror + j)), 1).otherwise(0)
        for j in range(max_length // 2)
    ])


# F6
def normalize_strand(strand: Column | str) -> Column:
    s = col(strand)
    return (
        F.when(F.lower(s).startswith("p"), "+").when(F.lower(s).startswith("n"), "-").otherwise(s)
    )


# F7
def is_watson_crick(a: Column | str, b: Column | str) -> Column:
    return F.translate(F.concat(col(a), col(b)), "U", "T").isin(*WATSON_CRICK)


def is_wobble(a: Column | str, b: Column | str) -> Column:
    return F.translate(F.concat(col(a), col(b)), "U", "T").isin(*WOBBLE)


# F8
def to_dna(seq: Column | str) -> Column:
    return F.translate(F.upper(col(seq)), "U", "T")


# M15
def identity_line(a: Column | str, b: Column | str, gap_counts: bool = True) -> Column:
    """`*` where two strings agree, a space elsewhere, over the shorter length."""
    left, right = col(a), col(b)
    n = F.least(F.length(left), F.length(right))
    agree = lambda x, y: (x == y) if gap_counts else ((x == y) & (x != "-"))
    marks = F.zip_with(
        F.split(F.substring(left, F.lit(1), n), ""), F.split(F.substring(right, F.lit(1), n), ""),
        lambda x, y: F.when(agree(x, y), "*").otherwise(" "),
    )
    return F.when(n == 0, "").otherwise(F.array_join(marks, ""))


def identity_count(a: Column | str, b: Column | str, gap_counts: bool = True) -> Column:
    return F.length(F.translate(identity_line(a, b, gap_counts), " ", ""))


# F16
def sequence_features(seq: Column | str) -> dict[str, Column]:
    """Length, GC share, ATG start and codon counts, with defaults for a missing sequence."""
    s = col(seq)
    known = s.isNotNull() & (F.length(s) > 0)
    out = {
        "sequence_length": F.when(known, F.length(s)).otherwise(1000),
        "gc_content": F.when(
            known, (F.length(s) - F.length(F.translate(s, "GC", ""))) / F.length(s)
        ).otherwise(0.43),
        "start_codon_atg": F.when(known, F.upper(s).startswith("ATG").cast("double")).otherwise(1.0),
    }
    for codon in ("ATG", "TAA", "TAG", "TGA"):
        out[f"codon_{codon.lower()}_count"] = F.when(
            known, F.regexp_count(F.upper(s), F.lit(codon))
        ).otherwise(0)
    return out
