"""Trained operators: gradients, normalisation, counts, held-out accuracy; and the pipeline as a whole."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandwork.llm import decontaminate, language_model, near_dedup, quality
from strandwork.llm.common import U64

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def test_gradients_match_differences():
    net = language_model.Network(6, 2, 3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    targets = rng.integers(0, 7, (4, 3))
    inputs = rng.integers(0, 8, (4, 3))
    fresh = inputs == 7
    h = rng.normal(0, 1, (3, 3))
    grads, _, _ = net.gradients(h, inputs, targets, fresh)
    for name, weights in net.p.items():
        for at in [tuple(rng.integers(0, s) for s in weights.shape) for _ in range(6)]:
            old, losses = weights[at], []
            for d in (1e-5, -1e-5):
                weights[at] = old + d
                losses.append(net.gradients(h, inputs, targets, fresh)[2])
            weights[at] = old
            assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(grads[name][at], abs=1e-6)


def test_probabilities_sum_to_one_and_state_is_carried():
    net = language_model.Network(10, 3, 4, seed=2)
    net.start_from_counts(np.arange(10), 7.0)
    state = np.random.default_rng(1).normal(0, 1, (1, 4)).astype(np.float32)
    total = sum(math.exp(net.log_probs(state, np.array([t]))[0]) for t in range(11))
    assert total == pytest.approx(1, abs=1e-5)
    rng = np.random.default_rng(3)
    lengths = [1, 300, 7, 65, 64, 129]
    first = np.concatenate(([0], np.cumsum(lengths)))
    tokens = rng.integers(1, 11, first[-1])
    tokens[first[1:] - 1] = 0
    got = net.score(tokens, first, lanes=2, window=64)
    for a, b in zip(first[:-1], first[1:], strict=True):
        h, before = np.zeros((1, 4), dtype=np.float32), 11
        for k in range(a, b):
            h = net.step(h, np.array([before]))[0]
            assert got[k] == pytest.approx(net.log_probs(h, tokens[k:k + 1])[0], abs=1e-4)
            before = tokens[k]


def test_scores_and_counts(spark):
    rng = random.Random(2)
    two = [[f"{p}{k}" for k in range(30)] for p in "ab"]
    rows = []
    for i in range(300):
        own = two[i % 2]
        rows.append((i, " ".join(rng.choice(own) if rng.random() < 0.95 else f"Rare{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))), "x", "y", 0))
    rows += [(900, None, None, None, None), (901, "", "", "", 0), (None, "a1 b2 Rare7", "x", "y", 0), (3, rows[3][1], "x", "y", 0), (905, "a1 " * 3000, "x", "y", 1)]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2 for r in rows]
    counts, ends = collections.Counter(), 0
    for r, h in zip(rows, held, strict=True):
        if not h:
            counts.update(words(r[1]))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    frame = spark.createDataFrame([(*r, 1.0, 2, 3) for r in rows], DOCS + ", score double, n_tokens int, row_ int")
    got = language_model.score_documents(frame, known=33, classes=4, hidden=8, listed=50, sample_docs=150).collect()
    assert len(got) == len(rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for r, h in zip(rows, held, strict=True):
        w = words(r[1])
        g = by[r[0]][0]
        base = sum(math.log10((c + 1) / (total + kinds + 1)) for c in [counts[x] for x in w] + [ends])
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (h, len(w) + 1, sum(counts[x] > 0 for x in w) + 1, total)
        assert g.base_score == pytest.approx(base, abs=1e-6)
    out = [r for r in got if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 5 * len(out)
    assert language_model.score_documents(frame.limit(0)).count() == 0


def test_without_training_documents_the_scores_are_equal(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = language_model.score_documents(spark.createDataFrame([(i, "a b", "", "", 3) for i in ids], DOCS)).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0)] * len(ids)


def labelled_rows(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(["the", "of", "plain", "word", f"w{rng.randrange(400)}"]) for _ in range(rng.randint(5, 80))]
        kind = rng.random()
        quality_, toxic = 1, 0
        if kind < 0.15:
            toxic = 1
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["nastyword", "Vileword,", "uglyword"]))
        elif kind < 0.3:
            quality_ = 0
            text = [w.upper() + "!!" for w in text]
        body = " ".join(text)
        rows.append((i, body, rng.choice(["en", "fr"]), "bad" if kind < 0.3 and rng.random() < 0.5 else "src", len(body)))
        labels.append((i, quality_, toxic))
    return rows, labels


def test_co_training_finds_rejects_of_unseen_documents(spark):
    rows, labels = labelled_rows(1500, 1)
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], DOCS + ", kept string, p_text double")
    model = quality.fit(docs, spark.createDataFrame(labels[:700], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.kept for r in quality.score(docs, model).collect()}
    right = sum(got[i] == (q == 1 and t == 0) for i, q, t in labels[700:])
    assert right / 800 > 0.97
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


def test_classifier_edge_cases(spark):
    rows = [(1, None, None, None, None), (None, "", "", "", 0), (2, "word " * 20_000, "en", "s", 100_000), (2, "word " * 20_000, "en", "s", 100_000)]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert model == {} and [r.kept for r in quality.score(docs, model).collect()] == [True] * 4
    more, labels = labelled_rows(400, 2)
    model = quality.fit(spark.createDataFrame(more, DOCS), spark.createDataFrame([*labels, (3, None, None), (None, 0, 1), (5, 1, 0)], none.schema))
    assert len(quality.score(docs, model).collect()) == 4 and quality.score(docs.limit(0), model).count() == 0


def test_views_exchange_pseudo_labels():
    """A metadata view that is sure of some unlabelled rows teaches the text view a word that no labelled row has."""
    rng = np.random.default_rng(0)
    n = 600
    y = np.where(np.arange(n) < 300, rng.random(n) < 0.4, -1).astype(np.int64)
    truth = np.where(y >= 0, y, rng.random(n) < 0.4)
    new = mixed = np.array([1, 2, 3], dtype=U64)
    words_ = [np.array([mixed[0] if t else mixed[1], *([new[2]] if t and k >= 300 else [])], dtype=U64) for k, t in enumerate(truth)]
    meta = np.stack([truth * 7 + 1, np.full(n, 2), np.full(n, 3)], axis=1).astype(np.int64)
    shape = np.zeros((n, quality.SHAPES), dtype=np.float32)
    model = quality.co_train(words_, shape, meta, y, np.arange(n) % 5 == 0)
    p = quality.sigmoid(quality.linear(meta, model["meta"]) * model["meta_scale"][0] + model["meta_scale"][1])
    assert ((p > 0.5) == truth).all()


def test_pipeline_equals_its_stages_in_plain_python(spark, tmp_path):
    rows, labels = labelled_rows(500, 3)
    rng = random.Random(4)
    prose = lambda n: " ".join(f"p{rng.randrange(900)}" for _ in range(n))
    base, item = prose(60), prose(25)
    extra = [(1000, base), (1001, base), (1002, base.replace(base.split()[30], "other")), (1003, prose(40)), (1004, prose(10) + " " + item + " " + prose(10)), (1005, "key password=abcdefgh12345678 " + prose(30)), (1006, None), (1007, ""), (1003, None)]
    extra = [(i, t, "en", "src", len(t or "")) for i, t in extra]
    extra[-1] = (1003, extra[3][1], "en", "src", extra[3][4])
    spark.createDataFrame(rows + extra, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    ids = {i for i in got if i >= 1000}
    assert ids == {1000, 1003, 1005, 1006, 1007} and max(got.values()) == 1
    bad = {i for i, q, t in labels if q == 0 or t == 1}
    assert len(bad & set(got)) <= 8 and len(set(range(500)) - bad - set(got)) <= 25
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    text = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.secrets_stage(spark, docs.where("doc_id > 1003"), str(tmp_path)).collect()}
    assert text[1005][0].startswith("key [SECRET] p") and text[1005][1] == len(text[1005][0]) and text[1006] == (None, 0)


def test_helpers_of_the_stages_agree():
    assert near_dedup.shingle_sets(pa.array(["A b", None, "a B"]), 5)[1].tolist() == [0, 1, 1, 2]
    assert decontaminate.folded(pa.array(["É\tx"]))[0].tolist() == [201, 32, 120]


class Enough(Exception):
    pass


def trained_rows(monkeypatch, spark, rows, only_table=False, **options):
    """The table that the network is trained on, and the scores."""
    held = []
    plain = language_model.stored

    def kept(df, name):
        out = plain(df, name)
        if name == "train-tokens":
            held.append(out)
            if only_table:
                raise Enough
        return out

    monkeypatch.setattr(language_model, "stored", kept)
    frame = spark.createDataFrame(rows, DOCS)
    if only_table:
        with pytest.raises(Enough):
            language_model.score_documents(frame, known=33, classes=4, hidden=8, **options)
        return held[0].collect(), []
    scores = language_model.score_documents(frame, known=33, classes=4, hidden=8, **options).collect()
    return held[0].collect(), scores


def test_network_learns_from_all_training_documents(spark, monkeypatch):
    rows = [(i, f"a{i % 7} b c", "", "", 8) for i in range(3000)]
    coded, scores = trained_rows(monkeypatch, spark, rows, task_tokens=3000)
    n = sum(zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows)
    assert n > 2000 and len(coded) == n and sum(len(r.tokens) // 2 for r in coded) == 4 * n == scores[0].train_tokens
    assert {r.share for r in coded} == set(range(4)) and len({r.task for r in coded}) == 3


def test_a_long_document_does_not_end_training(spark, monkeypatch):
    """Wherever it comes in hash order, a document of 900,000 words is trained on in pieces, and all others are too."""
    rows = [(i, f"a{i % 7} b c", "", "", 8) for i in range(40)]
    n = sum(zlib.crc32(str(r[0]).encode()) % 7 != 2 for r in rows)
    long = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 != 2)
    coded, _ = trained_rows(monkeypatch, spark, [*rows, (long, "w " * 900_000, "", "", 0)], only_table=True, task_tokens=100_000)
    assert sum(len(r.tokens) // 2 for r in coded) == 4 * n + 900_001
    assert max(len(r.tokens) for r in coded) <= 2 * (1 << 16) and len({(r.share, r.task) for r in coded if r.piece}) > 4


def test_words_beyond_the_most_frequent_have_context(spark):
    """Words that have no token of their own are still told apart by what precedes them, and the words of a group share its probability."""
    rng = random.Random(8)
    rows = []
    for i in range(200):
        k = rng.randrange(40)
        rows.append((i, " ".join(f"r{(k + j) % 40}" for j in range(60)), "", "", 0))
    got = [r for r in language_model.score_documents(spark.createDataFrame(rows, DOCS), known=4, classes=8, hidden=16).collect() if r.held_out]
    assert sum(r.score - r.base_score for r in got) > 0.5 * sum(r.n_tokens for r in got)
    counts = np.sort(np.random.default_rng(1).integers(1, 500, 300))[::-1]
    words_ = language_model.Vocabulary(np.arange(300).astype(U64), counts, known=21, groups=16)
    rare = words_.token[20:]
    shares = np.bincount(rare, weights=(counts[20:] + 1) / 10**words_.off[rare])[21:]
    assert shares == pytest.approx(np.ones(16)) and words_.mass[21:].max() < 1.5 * words_.mass[21:].min()


def test_near_dedup_judges_texts_of_one_id_apart(spark):
    rng = random.Random(6)
    prose = lambda: " ".join(f"p{rng.randrange(900)}" for _ in range(60))
    a, b, c, d, e, f = (prose() for _ in range(6))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (4, e), (4, e + " more"), (4, e), (4, f), (5, None), (5, ""), (5, ""), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "src", 0) for i, t in rows], DOCS)
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert got == collections.Counter([(1, a), (2, b), (3, c), (3, d), (4, e), (4, f), (5, None), (5, ""), (5, ""), (None, a)])


def test_rare_rejects_among_many_labels_are_learnt(spark):
    """0.5 % of the labels reject: a sample by id alone would hold too few of them."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(12_000):
        bad = i % 200 == 0
        text = " ".join([f"w{rng.randrange(50)}" for _ in range(8)] + (["nastyword", "vileword"] if bad else []))
        rows.append((i, text, "en", "src", len(text)))
        labels.append((i, 1, int(bad)))
    labels += [(12_000 + k, None, None) for k in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labelled_rows=600)
    got = {r.doc_id: r.kept for r in quality.score(docs, model).collect()}
    assert model and sum(not got[i] for i in range(0, 12_000, 200)) >= 55
    assert sum(not k for i, k in got.items() if i % 200) <= 24


def test_sure_rows_are_chosen_from_all_unlabelled_documents(spark, monkeypatch):
    rows, labels = labelled_rows(6000, 5)
    held = []
    plain = quality.stored
    monkeypatch.setattr(quality, "stored", lambda df, name: held.append((name, plain(df, name))) or held[-1][1])
    model = quality.fit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels[:1000], "doc_id long, quality int, toxic int"))
    scored = [df for name, df in held if name == "quality-scores"]
    assert model and len(scored) == 3 and scored[0].count() > 4000 and scored[0].where("id < 1000").count() == 0
    assert 300 <= sum(df.count() for name, df in held if name == "quality-taught") <= 3600


def test_pieces_of_other_documents_share_no_state():
    """A piece without an end mark is followed by one that starts anew: the loss is that of the two pieces trained side by side."""
    def fed(starts):
        net, seen = language_model.Network(12, 3, 4, seed=3), []
        plain = net.gradients
        net.gradients = lambda h, inputs, targets, fresh: seen.append((inputs.copy(), fresh.copy())) or plain(h, inputs, targets, fresh)
        net.train(np.array([5, 6, 7, 8, 9, 0]), starts, lanes=1, window=8, updates=1)
        return seen[0]

    inputs, fresh = fed(np.array([0, 3]))
    assert inputs.ravel().tolist() == [13, 5, 6, 13, 8, 9] and fresh.ravel().tolist() == [True, False, False, True, False, False]
    inputs, fresh = fed(None)
    assert inputs.ravel().tolist() == [13, 5, 6, 7, 8, 9]


@pytest.mark.parametrize("listed", [1, 7, 40, 100, 5000])
def test_most_frequent_words_with_ties(spark, listed):
    rng = random.Random(5)
    rows = [(rng.getrandbits(64) - 2**63, rng.choice([1, 1, 1, 2, 3, 9, 5000, 5001, 70000])) for _ in range(300)]
    words, counts = language_model._most_frequent(spark.createDataFrame(rows, "word long, c long").repartition(3), listed)
    assert list(zip(words.tolist(), counts.tolist(), strict=True)) == sorted(rows, key=lambda r: (-r[1], r[0]))[:listed]


def test_the_network_works_on_many_texts_at_a_time(spark, monkeypatch):
    """Softmax calls grow with the tokens, not with the length of the longest text, and slices of a batch are scored together."""
    net, calls = language_model.Network(40, 4, 8, seed=4), []
    plain = net.log_probs
    net.log_probs = lambda states, targets: calls.append(len(targets)) or plain(states, targets)
    tokens = np.random.default_rng(0).integers(1, 41, 20_000 + 200 * 10)
    first = np.concatenate(([0], 20_000 + 10 * np.arange(201)))
    tokens[first[1:] - 1] = 0
    got = net.score(tokens, first)
    assert sum(calls) == len(tokens) and len(calls) <= 2
    alone = np.concatenate([net.score(tokens[a:b], np.array([0, b - a])) for a, b in zip(first[:-1], first[1:], strict=True)])
    assert got == pytest.approx(alone, abs=1e-4)


def test_sums_of_rows_by_key_and_steep_logits():
    rng = np.random.default_rng(6)
    for high in (1, 5, 300):
        rows, keys = rng.normal(size=(700, 5)), rng.integers(0, high, 700).astype(np.uint16)
        found, sums = language_model._sums(rows, keys)
        expected = np.zeros((high, 5))
        np.add.at(expected, keys, rows)
        assert found.tolist() == sorted(set(keys.tolist())) and sums == pytest.approx(expected[found])
    net = language_model.Network(10, 3, 4, seed=2)
    net.start_from_counts(np.arange(10), 7.0)
    net.p["c"] *= 5000
    states = rng.normal(0, 1, (1, 4)).astype(np.float32)
    for p in (1.0, 1e-3):
        net.p["c"] *= p
        total = sum(math.exp(net.log_probs(states, np.array([t]))[0]) for t in range(11))
        assert total == pytest.approx(1, abs=1e-5)


def test_words_are_found_in_the_list():
    rng = np.random.default_rng(7)
    listed = np.unique(np.concatenate((rng.integers(0, 2**64, 500, dtype=U64), np.array([0, 2**64 - 1], dtype=U64))))
    counts = np.arange(len(listed))[::-1] + 1
    words_ = language_model.Vocabulary(listed[rng.permutation(len(listed))], counts, known=20, groups=8)
    asked = np.concatenate((listed, rng.integers(0, 2**64, 500, dtype=U64), listed + U64(1)))
    rank, count = words_.find(asked)
    place = {int(w): int(words_.order[k]) for k, w in enumerate(words_.sorted)}
    assert rank.tolist() == [place.get(int(w), -1) for w in asked]
    assert count.tolist() == [counts[place[int(w)]] if int(w) in place else 0 for w in asked]
