"""Collocations against a count of every phrase."""
import collections
import random
import re

import pytest

from strandwork.llm import collocations

SCHEMA = "doc_id long, text string, lang string, g string, h string, word string, n string, rank string"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, top, longest=5):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(ws)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = collections.Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i:i + k]] = max(held[p[i:i + k]], a)
        found = []
        for p, a in cand.items():
            if p in held and 100 * held[p] >= 100 * a:
                continue
            score, k = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, docs=60):
    rng = random.Random(seed)
    words = ["Of", "of", "the", "a", "naïve", "x1", "É", "zz", "rare", "new", "york", "in", "\x0b", "!", "a:b", "\x1f"]
    weights = [20, 20, 15, 10, 4, 4, 3, 2, 2, 3, 3, 9, 1, 2, 2, 1]
    passage = "once upon a time in new york, they said what they said"
    rows = []
    for i in range(docs):
        ws = rng.choices(words, weights, k=rng.choice([0, 1, 5, 40, 200]))
        if rng.random() < 0.3:
            ws.insert(rng.randrange(len(ws) + 1), passage)
        rows.append((rng.choice([" ", "  ", "\t"]).join(ws), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return [*rows, *rows[:9], (None, "en"), ("", "de"), (None, None), ("solo", "xx"), ("a a a a a a a a a", "rep"), (passage * 400, "long")]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 3, 2000), (2, 2, 4)])
def test_collocations_equal_a_full_count(spark, seed, least, top):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, g, "g", "h", "w", "n", "r") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(5)
    got = collocations.collocations(docs, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, top)


def test_rounds_end_when_no_open_branch_can_reach_the_last_rank(spark, monkeypatch):
    rows = [(" ".join(f"{w}{i % 40}" for w in "pqrst") + ". the of the of the of", "en") for i in range(400)]
    turns, one = [], collocations._round
    monkeypatch.setattr(collocations, "_round", lambda *a: turns.append(a[2].first()["high"]) or one(*a))
    docs = spark.createDataFrame([(i, t, g, "g", "h", "w", "n", "r") for i, (t, g) in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=5, top=3).collect()) == plain(rows, 5, 3)
    assert turns and max(turns) < 1000


def test_filters_that_let_all_through_change_nothing(spark, monkeypatch):
    rows = corpus(4, 25)
    docs = spark.createDataFrame([(i, t, g, "g", "h", "w", "n", "r") for i, (t, g) in enumerate(rows)], SCHEMA)
    monkeypatch.setattr(collocations, "_passes", lambda bits, hashes: hashes == hashes)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=3, top=50).collect()) == plain(rows, 3, 50)
    assert collocations.collocations(docs.limit(0)).collect() == []


def test_words_that_are_names_of_groups(spark):
    """`es` in German and `de` in Spanish texts are different words, as are `de` in `de` and `es` in `es`."""
    rows = [("es war es ist es gibt de es. von de", "de"), ("de la casa de es la de. es de", "es")] * 30 + [("de es und", None), ("und de", "fr")] * 20
    docs = spark.createDataFrame([(i, t, g, "g", "h", "w", "n", "r") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=5).collect()) == plain(rows, 5, 2000)


def test_first_words_behind_a_round_that_half_of_the_words_does_not_widen(spark):
    rows = [("a x a y b. z a w", "en")] * 30
    docs = spark.createDataFrame([(i, t, g, "g", "h", "w", "n", "r") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    want = plain(rows, 5, 2000)
    assert any(r[2].startswith("a ") for r in want)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=5).collect()) == want
