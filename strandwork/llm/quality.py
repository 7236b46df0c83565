"""Quality classifier by co-training: a text view and a page-metadata view teach each other, then calibrated views are combined.

Both views are logistic models in numpy, fitted on a bounded sample of labelled documents, drawn for each class, and on the unlabelled ones that the views are most
sure of, chosen by Spark from all of them; every document is scored.
The text view has the presence of telling words and shape measures; the metadata view has language, source and length.
"""
from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, flat, mixed, pieces, stored, word_bounds, word_hashes

_CLASSES = np.full(256, 6, dtype=np.int64)  # other signs
_CLASSES[[9, 10, 11, 12, 13, 32]] = 0
_CLASSES[97:123] = 1
_CLASSES[65:91] = 2
_CLASSES[48:58] = 3
_CLASSES[[33, 63]] = 4
_CLASSES[[44, 46, 58, 59, 39, 34, 45]] = 5
_CLASSES[128:] = 7
_TRIM = np.zeros(256, dtype=bool)
_TRIM[np.frombuffer(b".,!?;:\"'()[]#$%&*|", dtype=np.uint8)] = True
_BUCKETS = 4096
SHAPES = 14


def trimmed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of lower-cased words without marks at their ends, the text of each word, and shape measures of each text."""
    raw, offsets = flat(texts)
    size, n = int(offsets[-1]), len(texts)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(owner * 8 + _CLASSES[raw[:size]], minlength=n * 8).reshape(n, 8).astype(np.float64)
    data, _ = flat(texts, lower=True)
    starts, ends, first = word_bounds(data, offsets)
    for _ in range(4):
        ends = ends - ((ends - starts > 1) & _TRIM[data[ends - 1]])
        starts = starts + ((ends - starts > 1) & _TRIM[data[starts]])
    words = word_hashes(data, starts, ends)
    of = np.repeat(np.arange(n), np.diff(first))
    counts = np.diff(first).astype(np.float64)
    shape = np.zeros((n, SHAPES), dtype=np.float32)
    shape[:, :8] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    for lag in (1, 2, 4):
        same = np.flatnonzero((words[lag:] == words[:-lag]) & (of[lag:] == of[:-lag]))
        shape[:, {1: 8, 2: 9, 4: 10}[lag]] = np.bincount(of[same], minlength=n) / np.maximum(counts, 1)
    shape[:, 11] = np.log1p(counts) / 10
    shape[:, 12] = np.bincount(of, weights=ends - starts, minlength=n) / np.maximum(counts, 1) / 20
    shape[:, 13] = counts == 0
    return words, of, shape


def meta_features(lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Three hashed features of each row: language, source and the power of two of the length; nulls have buckets of their own."""
    columns = []
    for salt, column in enumerate((lang, source)):
        data, offsets = flat(pc.fill_null(column.cast(pa.string()), "\x00"))
        columns.append(mixed(word_hashes(data, offsets[:-1], offsets[1:]) + U64(salt)) % U64(_BUCKETS))
    size = pc.fill_null(n_chars.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
    columns.append(mixed(np.floor(np.log2(np.maximum(size, 0) + 1)).astype(np.int64).view(U64) + np.where(size < 0, U64(99), U64(200))) % U64(_BUCKETS))
    return np.stack(columns, axis=1).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 150, rate: float = 0.05) -> np.ndarray:
    """Weights and, last, the intercept, by Adam on all rows at once. `x` is a matrix, or rows of active feature numbers."""
    indexed = x.dtype.kind == "i"
    width = _BUCKETS if indexed else x.shape[1]
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        error = (sigmoid(linear(x, w)) - y) / len(y)
        grad = np.empty(width + 1)
        grad[:-1] = np.bincount(x.ravel(), weights=np.repeat(error, x.shape[1]), minlength=width) if indexed else x.T @ error.astype(x.dtype)
        grad[:-1] += l2 * w[:-1]
        grad[-1] = error.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (w[:-1][x].sum(axis=1) if x.dtype.kind == "i" else x @ w[:-1].astype(x.dtype)) + w[-1]


def platt(scores: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope and offset that turn scores into calibrated log-odds, by Newton steps with smoothed targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack([scores, np.ones(len(scores))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * (w - [1, 0]))
        w = w - np.clip(step, -2, 2)
    return np.array([max(w[0], 0.0), w[1]])


def co_train(words: list[np.ndarray], shape: np.ndarray, meta: np.ndarray, y: np.ndarray, held: np.ndarray, terms: int = 1500, rounds: int = 3, confident: float = 0.97, per_round: int = 300, taught: np.ndarray | None = None, shift: float = 0.0) -> dict[str, np.ndarray]:
    """Fit both views. `y` is 1 (reject), 0 (keep) or -1 (unlabelled); rows with `held` serve for calibration only.

    In each round every view labels the unlabelled rows that it is `confident` of, at most `per_round` of each class, for the other view's
    next fit. With fewer than ten labelled rows of a class, in either part, there is no model and everything is kept. `taught` has labels that the views already
have from each other, a row for each view, -1 for none. `shift` is the log-odds of the classes among all labels, less those among the rows here.
    """
    train = np.flatnonzero((y >= 0) & ~held)
    test = np.flatnonzero((y >= 0) & held)
    if min((y[train] == 1).sum(), (y[train] == 0).sum(), (y[test] == 1).sum(), (y[test] == 0).sum()) < 10:
        return {}
    known, inverse = np.unique(np.concatenate([words[i] for i in train]), return_inverse=True)
    label = np.repeat(y[train], [len(words[i]) for i in train])
    bad, good = np.bincount(inverse[label == 1], minlength=len(known)), np.bincount(inverse[label == 0], minlength=len(known))
    n_bad, n_good = (y[train] == 1).sum(), (y[train] == 0).sum()
    pooled = (bad + good + 1) / (n_bad + n_good + 2)
    z = np.abs((bad + 0.5) / (n_bad + 1) - (good + 0.5) / (n_good + 1)) / np.sqrt(pooled * (1 - pooled) * (1 / n_bad + 1 / n_good))
    z[bad + good < 5] = 0
    chosen = np.sort(known[np.argsort(-z, kind="stable")[:terms]])
    mean, spread = shape[train].mean(axis=0), shape[train].std(axis=0) + 1e-6
    x = np.concatenate([presence(np.concatenate(words), np.repeat(np.arange(len(words)), [len(w) for w in words]), len(words), chosen), (shape - mean) / spread], axis=1).astype(np.float32)
    views, labels = (x, meta), [np.where(y < 0, -1 if taught is None else taught[k], np.where(held, -1, y)) for k in (0, 1)]
    pool = np.flatnonzero(y < 0)
    for step in range(rounds + 1):
        weights = [fit_logistic(v[own >= 0], own[own >= 0].astype(np.float64)) for v, own in zip(views, labels, strict=True)]
        scales = [platt(linear(v[test], w), y[test]) + [0, shift] for v, w in zip(views, weights, strict=True)]
        if step == rounds or not len(pool):
            break
        for k in (0, 1):
            p = sigmoid(linear(views[k][pool], weights[k]) * scales[k][0] + scales[k][1])
            for value, sure in ((1, p), (0, 1 - p)):
                order = np.argsort(-sure, kind="stable")[:per_round]
                labels[1 - k][pool[order[sure[order] >= confident]]] = value
        pool = pool[(labels[0][pool] < 0) | (labels[1][pool] < 0)]
    prior = y[train].mean()
    return {"terms": chosen, "mean": mean, "spread": spread, "text": weights[0], "meta": weights[1], "text_scale": scales[0], "meta_scale": scales[1], "prior": np.array([np.log(prior / (1 - prior)) + shift])}


def presence(words: np.ndarray, of: np.ndarray, n: int, terms: np.ndarray) -> np.ndarray:
    """Matrix of which of the sorted `terms` each text has."""
    out = np.zeros((n, len(terms)), dtype=np.float32)
    if len(terms) and len(words):
        at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
        hit = terms[at] == words
        out[of[hit], at[hit]] = 1
    return out


def judged(model: dict[str, np.ndarray], texts: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> np.ndarray:
    """Probability to reject of each text: by its words, by its metadata, and by both."""
    if not model:
        return np.zeros((len(texts), 3))
    words, of, shape = trimmed_words(texts)
    x = np.concatenate([presence(words, of, len(texts), model["terms"]), (shape - model["mean"]) / model["spread"]], axis=1).astype(np.float32)
    text = linear(x, model["text"]) * model["text_scale"][0] + model["text_scale"][1]
    meta = linear(meta_features(lang, source, n_chars), model["meta"]) * model["meta_scale"][0] + model["meta_scale"][1]
    # The views are taken as independent given the class, so their log-odds add once the prior is taken off.
    return sigmoid(np.stack([text, meta, text + meta - model["prior"][0]], axis=1))


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = 8000, rounds: int = 3, confident: float = 0.97, per_round: int = 300, id_col: str = "doc_id") -> dict[str, np.ndarray]:
    """Co-train on at most `labelled_rows` labelled documents and the unlabelled ones that the views teach each other.

    Of each class at most half of `labelled_rows` are taken, more if the other has fewer, the first by a hash of the id; calibration is corrected for it. In each
    round all unlabelled documents are scored, and the `per_round` of each class that a view is surest of, and `confident`, are labelled for the other view.
    `labels` has the id column, `quality` and `toxic` (0 or 1); a document is to be rejected if quality is 0 or toxic is 1. Conflicting labels
    of an id reject it; rows whose labels are both null are unlabelled. One task fits the bounded sample; the model is under 1 MB.
    """
    bad = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0))
    named = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(bad.alias("y")).where("y IS NOT NULL")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *_columns(docs)).where("id IS NOT NULL")
    rows = rows.select("id", F.xxhash64("text_", "lang_", "source_", "n_chars_").alias("key"), "text_", "lang_", "source_", "n_chars_")
    known = stored(named.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi").select("id", "y"), "quality-labels")
    count = dict(known.groupBy("y").count().collect())
    if min(count.get(0, 0), count.get(1, 0)) < 10:
        return {}
    take = [min(count[y], max(labelled_rows // 2, labelled_rows - count[1 - y])) for y in (0, 1)]
    shift = float(np.log(count[1] / count[0]) - np.log(take[1] / take[0]))
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(take[y]) for y in (0, 1)]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                words, of, shape = trimmed_words(part.column(2))
                cuts = np.searchsorted(of, np.arange(part.num_rows + 1))
                own = [np.unique(words[a:b]).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(6), pa.array(own, pa.binary()), pa.array([s.tobytes() for s in shape], pa.binary()),
                     pa.array([m.tobytes() for m in meta_features(part.column(3), part.column(4), part.column(5))], pa.binary())],
                    ["id", "key", "y", "words", "shape", "meta"])

    def trainer(told: list[dict[tuple[int, int], int]]):
        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by([("id", "ascending"), ("words", "ascending"), ("meta", "ascending")])
            read = lambda c, kind: [np.frombuffer(x.as_py(), dtype=kind) for x in table.column(c)]
            ids, y = table.column("id").to_numpy(), table.column("y").to_numpy().astype(np.int64)
            held = mixed(ids.view(U64) + U64(17)) % U64(5) == U64(0)
            names = list(zip(ids.tolist(), table.column("key").to_pylist(), strict=True))
            taught = np.array([[t.get(name, -1) for name in names] for t in told])
            model = co_train(read("words", "<u8"), np.stack(read("shape", "<f4")), np.stack(read("meta", "<i8")), y, held, rounds=0, taught=taught, shift=shift)
            out = io.BytesIO()
            np.savez(out, **model)
            return pa.table({"model": pa.array([out.getvalue()], pa.binary())})

        return train

    def judge(model: dict[str, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, 2):
                    p = judged(model, *(part.column(i) for i in range(2, 6)))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p[:, 0]), pa.array(p[:, 1])], ["id", "key", "p0", "p1"])

        return run

    kinds = "id long, key long, y int, words binary, shape binary, meta binary"
    sample = stored(rows.join(first[0].union(first[1]), "id").mapInArrow(features, kinds), "quality-sample")
    told: list[dict[tuple[int, int], int]] = [{}, {}]
    for step in range(rounds + 1):
        model = sample.groupBy(F.lit(0).alias("one")).applyInArrow(trainer(told), "model binary").first()
        model = dict(np.load(io.BytesIO(bytes(model[0]))))
        if step == rounds or not model:
            return model
        sure = F.greatest("p0", 1 - F.col("p0"), "p1", 1 - F.col("p1")) >= confident
        scored = stored(rows.mapInArrow(judge(model), "id long, key long, p0 double, p1 double").where(sure).join(known, "id", "left_anti").distinct(), "quality-scores")
        new = set()
        for k in (0, 1):
            old = told[1 - k]
            for value, p in ((1, F.col(f"p{k}")), (0, 1 - F.col(f"p{k}"))):
                best = scored.where(p >= confident).orderBy(p.desc(), F.xxhash64("id"), "id", "key").limit(per_round + len(old)).select("id", "key").collect()
                for name in [tuple(r) for r in best if tuple(r) not in old][:per_round]:
                    new.add(name)
                    old[name] = value
        if not new:
            return model
        had = sample.where("y < 0").select("id", "key")
        picked = rows.where(F.col("id").isin([i for i, _ in new]) & F.col("key").isin([key for _, key in new])).join(known, "id", "left_anti").dropDuplicates(["id", "key"]).join(had, ["id", "key"], "left_anti")
        picked = picked.select("id", "key", "text_", "lang_", "source_", "n_chars_", F.lit(-1).alias("y"))
        sample = sample.union(stored(picked.mapInArrow(features, kinds), "quality-taught"))
    return {}


def _columns(docs: DataFrame) -> list:
    return [F.col("text").cast("string").alias("text_"), F.col("lang").cast("string").alias("lang_"), F.col("source").cast("string").alias("source_"), F.col("n_chars").cast("double").alias("n_chars_")]


def score(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.5, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: the id column, `p_text`, `p_meta` and `p_reject` (probabilities to reject) and `kept`.

    Null and empty texts have no words; null metadata have features of their own; ids may be null or repeat. Other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                p = judged(model, *(part.column(i) for i in range(1, 5)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 2] < threshold)], [id_col, "p_text", "p_meta", "p_reject", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), *_columns(docs)).mapInArrow(run, f"`{id_col}` {kind}, p_text double, p_meta double, p_reject double, kept boolean")


def keep(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, with all columns, that are not rejected. Only what is judged goes to Python, and one boolean comes back."""

    @F.arrow_udf("boolean")
    def kept(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, lang, source, n_chars], ["text", "lang", "source", "n_chars"])
        return pa.concat_arrays([pa.array([], pa.bool_()), *(pa.array(judged(model, *part.columns)[:, 2] < threshold) for part in pieces(batch, 0))])

    return docs.where(kept(*_columns(docs)))
