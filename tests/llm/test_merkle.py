"""The Merkle manifest against a plain-Python tree."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandwork.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, h string, at long, g string, path string, load string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climb(nodes, fanout):
    """The last node and each leaf's siblings, level by level, as (left, right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            first = p - p % fanout
            paths[i].append(("".join(nodes[first:p]), "".join(nodes[p + 1:first + fanout])))
            at[i] = p // fanout
        nodes = [digest(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def expected(rows, fanout, changes):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        ranked = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = (ranked, *climb([leaf(r) for r in ranked], fanout))
    root, over = climb([trees[g][1] for g in order], fanout)
    out = []
    for g, above in zip(order, over, strict=True):
        ranked, top, paths = trees[g]
        for r, path in zip(ranked, paths, strict=True):
            acc = leaf(changes(r))
            for left, right in path + above:
                acc = digest(left, acc, right)
            out.append((r[0], leaf(r), top, root, digest(*[a + b for a, b in path + above]), acc, acc == root))
    return sorted(out, key=str)


def tables(kind):
    rng = random.Random(kind)
    if kind == "one":
        return [(5, None, None, None, None)]
    if kind == "pair":
        return [(2, "a", "x", 1, "t"), (1, "a", "x", 1, "")]
    rows = [(rng.randrange(200) if rng.random() < 0.95 else None, rng.choice(["s", None, "ü"]), rng.choice(["en", "en", "en", "de", "", None, "é"]),
             rng.choice([None, 3, 9]), rng.choice([None, "", "naïve", "x" * 5000, "a:b"])) for _ in range(150)]
    return rows + rows[:20] + [rows[0]] * 30 + [(7, "s", "solo", 1, "only one")]


@pytest.mark.parametrize(("kind", "fanout"), [("one", 2), ("pair", 2), ("many", 2), ("many", 3)])
def test_manifest_equals_a_plain_tree(spark, kind, fanout):
    rows = tables(kind)
    docs = spark.createDataFrame([(*r, "h", 1, "g", "p", "l") for r in rows], SCHEMA)
    altered = {"n_chars": F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = merkle.manifest(docs, FIELDS, fanout=fanout, altered=altered).drop("path").collect()
    want = expected(rows, fanout, lambda r: (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[0] % 3 == 0 and r[3] is not None else r)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_levels_beyond_one_block_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    rows = [(i, "s", "en" if i % 5 else "de", i, str(i)) for i in range(67)]
    docs = spark.createDataFrame([(*r, "h", 1, "g", "p", "l") for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in merkle.manifest(docs, FIELDS).drop("path").collect()), key=str) == expected(rows, 2, lambda r: r)
    assert merkle.manifest(docs.limit(0), FIELDS).collect() == []
