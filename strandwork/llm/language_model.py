"""Gated recurrent language model in numpy: truncated backpropagation, class-factored softmax, state carried through whole documents.

The network knows the end mark and the most frequent training words each by itself, and the rest of the word list in groups of equal count mass: a group has an input and an
output vector like a word, and a word has its add-one share of its group. Words outside the list form one more class, in which a word has its add-one share of the corpus counts. Counts cover every training document and are joined by Spark. The network is fitted on every training document too: in each
round all tasks go on from the same weights over documents of their own, and Spark averages the weights by token count.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import binary
from .common import U64, flat, mixed, pieces, stored, word_bounds, word_hashes

#: Tokens of one row of the training table, and of the stream that is laid out in lanes at a time.
_PIECE, _STREAM = 1 << 16, 1 << 20


#: Columns of the softmax and elements of the weights that are worked on at a time: they stay in a core's cache, and OpenBLAS multiplies matrices below 10^6 products without packing them.
_COLUMNS, _ELEMENTS = 448, 1 << 14
#: States that are kept in scoring until their softmax is due.
_STATES = 1 << 14
#: Tokens behind which documents are scored, many at a time, since the longest one decides the number of steps.
_SCORED = 1 << 21


def _sums(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sum of each one's rows. Runs of eight rows are added side by side, then runs of their sums."""
    place = np.argsort(keys, kind="stable")
    ordered = keys[place]
    begin = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    distinct, counts = ordered[begin], np.diff(np.append(begin, len(keys)))
    while True:
        runs = -(-counts // 8)
        first = np.cumsum(runs) - runs
        within = 8 * (np.arange(first[-1] + runs[-1]) - np.repeat(first, runs))
        start, length = np.repeat(begin, runs) + within, np.minimum(np.repeat(counts, runs) - within, 8)
        by = np.argsort((8 - length).astype(np.uint8), kind="stable")
        start, more = start[by], len(length) - np.cumsum(np.bincount(length, minlength=9))
        total = rows.take(place[start], axis=0)
        for j in range(1, 8):
            if not more[j]:
                break
            total[:more[j]] += rows.take(place[start[:more[j]] + j], axis=0)
        back = np.empty(len(by), dtype=np.int64)
        back[by] = np.arange(len(by))
        if len(by) == len(distinct):
            return distinct, total.take(back, axis=0)
        rows, place, begin, counts = total, back, first, runs


class Network:
    """GRU with an input table for each known token, the other words and the start, and a two-level softmax.

    Token 0 is the end mark, token `known` stands for all other words and `known + 1` for the start of a document. Weights of the update gate, the reset gate and the
    new state lie one behind the other, and logits have a column for each token, so that numpy works on long contiguous rows.
    """

    def __init__(self, known: int, classes: int, hidden: int, seed: int = 11):
        self.known, self.classes, self.hidden = known, classes, hidden
        self.size = -(-known // classes)
        self.held: dict[str, np.ndarray] = {}
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(hidden)
        in_three = lambda x: x.reshape(-1, 3, hidden).transpose(1, 0, 2)
        self.p = {
            "g": in_three(rng.normal(0, 0.1, (known + 2, 3 * hidden))), "u": in_three(rng.normal(0, scale, (hidden, 3 * hidden))),
            "c": rng.normal(0, 0.1, (hidden, classes + 1)), "cb": np.zeros(classes + 1),
            "w": rng.normal(0, 0.1, (classes, hidden, self.size)), "wb": np.zeros((classes, self.size)),
        }
        self.p = {k: np.ascontiguousarray(v, dtype=np.float32) for k, v in self.p.items()}

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that is kept for the next call under this name; its content is left over."""
        size, kind = math.prod(shape), self.p["u"].dtype
        if name not in self.held or self.held[name].size < size or self.held[name].dtype != kind:
            self.held[name] = np.empty(size, dtype=kind)
        return self.held[name][:size].reshape(shape)

    def start_from_counts(self, counts: np.ndarray, others: float) -> None:
        """Biases that make the untrained network a unigram model; slots without a token get no mass."""
        full = np.zeros(self.classes * self.size)
        full[:self.known] = counts + 1
        grid = full.reshape(self.classes, self.size)
        with np.errstate(divide="ignore"):
            self.p["wb"][:] = np.maximum(np.log(grid / np.maximum(grid.sum(axis=1, keepdims=True), 1)), -30)
            self.p["cb"][:] = np.maximum(np.log(np.append(grid.sum(axis=1), others + 1) / (full.sum() + others + 1)), -30)

    def step(self, before: np.ndarray, inputs: np.ndarray, out: np.ndarray | None = None, gates: np.ndarray | None = None, new: np.ndarray | None = None, given: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """The next state; both gates and the product that the reset gate scales; and the proposed state. Results go to the arrays given, the last of which is for the inputs."""
        a = self.p["g"].take(inputs, axis=1, out=given, mode="clip")
        gates = np.matmul(before, self.p["u"], out=gates)
        both = gates[:2]
        both += a[:2]
        both *= 0.5
        np.tanh(both, out=both)
        both *= 0.5
        both += 0.5
        new = np.multiply(gates[1], gates[2], out=new)
        new += a[2]
        np.tanh(new, out=new)
        out = np.subtract(before, new, out=out)
        out *= gates[0]
        out += new
        return out, gates, new

    @staticmethod
    def _small(weights: np.ndarray, bias: np.ndarray, widest: float) -> bool:
        """Whether logits of states with no element beyond `widest` can neither overflow nor vanish as exponentials, so that the largest need not be taken off first."""
        return float((np.abs(weights).sum(axis=-2) * widest + np.abs(bias)).max()) < 60

    def by_class(self, states: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows in the order of their targets' classes: that order, states, classes, places in the class, and the first row of each class."""
        group = np.where(targets == self.known, self.classes, np.minimum(targets // self.size, self.classes - 1)).astype(np.int16)
        order = np.argsort(group, kind="stable")
        group = group[order].astype(np.int64)
        own = np.take(states, order, axis=0, out=self.room("by class", *states.shape), mode="clip")
        return order, own, group, targets[order] - group * self.size, np.searchsorted(group, np.arange(self.classes + 2))

    def log_probs(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural log-probability of each target; of another word, that of its class."""
        order, own, group, place, cuts = self.by_class(states, targets)
        found = np.zeros(len(targets), dtype=states.dtype)
        widest = max(1.0, float(np.abs(states).max(initial=0)))
        self._add_log_probs(self.p["c"], self.p["cb"], own, group, found, widest)
        for k in range(self.classes):
            these = slice(cuts[k], cuts[k + 1])
            self._add_log_probs(self.p["w"][k], self.p["wb"][k], own[these], place[these], found[these], widest)
        out = np.empty_like(found)
        out[order] = found
        return out

    def _add_log_probs(self, weights: np.ndarray, bias: np.ndarray, states: np.ndarray, at: np.ndarray, found: np.ndarray, widest: float) -> None:
        small = self._small(weights, bias, widest)
        for a in range(0, len(states), _COLUMNS):
            some, to = states[a:a + _COLUMNS], at[a:a + _COLUMNS]
            logits = np.matmul(weights.T, some.T, out=self.room("logits", len(bias), len(some)))
            logits += bias[:, None]
            if not small:
                logits -= logits.max(axis=0)
            found[a:a + _COLUMNS] += logits.reshape(-1)[to * len(to) + np.arange(len(to))]
            np.exp(logits, out=logits)
            found[a:a + _COLUMNS] -= np.log(logits.sum(axis=0))

    def _errors(self, weights: np.ndarray, bias: np.ndarray, states: np.ndarray, at: np.ndarray, found: np.ndarray, to: tuple[np.ndarray, ...], small: bool) -> None:
        """Probabilities of the targets of one softmax, and the gradients of the summed loss by weights, bias and states."""
        ones = np.ones(min(_COLUMNS, len(states)), dtype=states.dtype)
        for a in range(0, len(states), _COLUMNS):
            some, own = states[a:a + _COLUMNS], found[a:a + _COLUMNS]
            wide = len(some)
            error = np.matmul(weights.T, some.T, out=self.room("logits", len(bias), wide))
            error += bias[:, None]
            if not small:
                error -= error.max(axis=0)
            np.exp(error, out=error)
            error /= error.sum(axis=0)
            flattened, spots = error.reshape(-1), at[a:a + _COLUMNS] * wide + np.arange(wide)
            own[:] = flattened[spots]
            flattened[spots] = own - 1
            if a:
                to[0][:] += some.T @ error.T
                to[1][:] += error @ ones[:wide]
            else:
                np.matmul(some.T, error.T, out=to[0])
                np.matmul(error, ones[:wide], out=to[1])
            np.matmul(error.T, weights.T, out=to[2][a:a + _COLUMNS])

    def gradients(self, h: np.ndarray, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients over one window (time by lanes), the state behind it, and the loss for each token."""
        steps, lanes = inputs.shape
        n, p, total = self.hidden, self.p, inputs.size
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        states, news, zeroed = self.room("states", steps + 1, lanes, n), self.room("news", steps, lanes, n), self.room("zeroed", lanes, n)
        states[0] = h
        widest = max(1.0, float(np.abs(h).max(initial=0)))
        gates, given = self.room("gates", steps, 3, lanes, n), self.room("given", 3, lanes, n)
        begins = [np.flatnonzero(x) for x in fresh]
        for t in range(steps):
            before = states[t]
            if len(begins[t]):
                zeroed[:] = before
                zeroed[begins[t]] = 0
                before = zeroed
            self.step(before, inputs[t], states[t + 1], gates[t], news[t], given)
        order, own, group, place, cuts = self.by_class(states[1:].reshape(-1, n), targets.reshape(-1))
        back, inside, found, within = self.room("back", total, n), self.room("back inside", total, n), self.room("found", total), self.room("found inside", total)
        self._errors(p["c"], p["cb"], own, group, found, (grads["c"], grads["cb"], back), self._small(p["c"], p["cb"], widest))
        small = self._small(p["w"], p["wb"], widest)
        for k in range(self.classes):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                self._errors(p["w"][k], p["wb"][k], own[a:b], place[a:b], within[a:b], (grads["w"][k], grads["wb"][k], inside[a:b]), small)
        listed = cuts[self.classes]
        loss = -float(np.log(np.maximum(found, 1e-30)).sum() + np.log(np.maximum(within[:listed], 1e-30)).sum())
        back[:listed] += inside[:listed]
        back /= total
        for k in ("c", "cb", "w", "wb"):
            grads[k] /= total
        errors = self.room("errors", steps, lanes, n)
        turned = np.empty(total, dtype=np.int64)
        turned[order] = np.arange(total)
        back.take(turned, axis=0, out=errors.reshape(-1, n), mode="clip")
        ahead, some, left, parts = self.room("ahead", lanes, n), self.room("some", lanes, n), self.room("left", lanes, n), self.room("parts", 2, lanes, n)
        ahead.fill(0)
        turned = np.ascontiguousarray(p["u"].transpose(0, 2, 1))
        # Gradients take the place of the gates, and that of the product in the reset gate the place of the proposed state.
        for t in range(steps - 1, -1, -1):
            (z, r, bn), new, dh = gates[t], news[t], errors[t]
            dh += ahead
            np.subtract(1, z, out=left)
            left *= dh
            np.multiply(dh, z, out=ahead)
            np.subtract(states[t + 1], new, out=z)
            z *= left
            np.multiply(new, new, out=some)
            np.subtract(1, some, out=some)
            left *= some
            np.multiply(left, r, out=new)
            np.subtract(1, r, out=r)
            r *= bn
            r *= new
            bn[:] = left
            np.matmul(gates[t, :2], turned[:2], out=parts)
            ahead += parts[0]
            ahead += parts[1]
            ahead += np.matmul(new, turned[2], out=some)
            if len(begins[t]):
                ahead[begins[t]] = 0
        for k, side in enumerate((gates[:, 0], gates[:, 1], news)):
            np.matmul(states[:-1].transpose(0, 2, 1), side, out=self.room("by step", steps, n, n)).sum(axis=0, out=grads["u"][k])
            # A text that begins anew had zeros before.
            grads["u"][k] -= states[:-1][fresh].T @ side[fresh]
        rows = self.room("rows", steps, lanes, 3, n)
        rows[:] = gates.transpose(0, 2, 1, 3)
        used, sums = _sums(rows.reshape(-1, 3 * n), inputs.ravel().astype(np.uint16 if self.known + 2 <= 1 << 16 else np.int64))
        grads["g"][:, used] = sums.reshape(-1, 3, n).transpose(1, 0, 2)
        return grads, states[steps].copy(), loss / total

    def train(self, tokens: np.ndarray, starts: np.ndarray | None = None, lanes: int = 256, window: int = 32, updates: int = 200, rate: float = 0.01, begin: float = 0.0, end: float = 1.0) -> list[float]:
        """Adam over windows of a stream of documents cut into lanes; the state of a lane goes on from window to window. A small stream has fewer lanes and
        is passed over again, until there were about `updates` windows. The rate falls with the share of all training done, from `begin` to `end` here.

        `starts` are the places where a text begins anew; one does behind every end mark. Long streams are laid out piece by piece; tokens that do not fill the lanes follow in one lane, so every token is a target.
        """
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        lanes = max(1, min(lanes, len(tokens) // (updates * window)))
        windows = sum(-(-(min(a + _STREAM, len(tokens)) - a) // (lanes * window)) for a in range(0, len(tokens), _STREAM))
        passes = max(1, round(updates / max(windows, 1)))
        before = np.concatenate(([self.known + 1], tokens[:-1]))
        before[before == 0] = self.known + 1
        if starts is not None:
            before[starts] = self.known + 1
        t, losses = 0, []
        for _ in range(passes):
            for a in range(0, len(tokens), _STREAM):
                size = min(_STREAM, len(tokens) - a)
                length = size // lanes
                cuts = [(a, lanes, length), (a + lanes * length, 1, size - lanes * length)]
                for at, wide, long in cuts:
                    targets, inputs = (x[at:at + wide * long].reshape(wide, long).T for x in (tokens, before))
                    fresh = inputs == self.known + 1
                    h = np.zeros((wide, self.hidden), dtype=np.float32)
                    for w in range(0, long, window):
                        grads, h, loss = self.gradients(h, inputs[w:w + window], targets[w:w + window], fresh[w:w + window])
                        losses.append(loss)
                        part = min(window, long - w) * wide / (lanes * window)
                        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
                        t += 1
                        now = part * rate * (1 - 0.9 * (begin + (end - begin) * min(1.0, t / (passes * windows))))
                        for k, g in grads.items():
                            self._adam(*(x.reshape(-1) for x in (self.p[k], m[k], v[k], g)), min(1.0, 1 / (norm + 1e-9)), now, t)
        return losses

    def _adam(self, p: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray, clip: float, rate: float, t: int) -> None:
        """One step of Adam. `m` and `v` are the running sums without the factors 0.1 and 0.001, which go into the rate."""
        scale = math.sqrt(0.001 / (1 - 0.999**t))
        rate *= 0.1 / (1 - 0.9**t) / scale
        for a in range(0, len(p), _ELEMENTS):
            part, mean, square, now = (x[a:a + _ELEMENTS] for x in (p, m, v, g))
            change = self.room("change", len(part))
            if clip < 1:
                now *= clip
            mean *= 0.9
            mean += now
            now *= now
            square *= 0.999
            square += now
            np.sqrt(square, out=change)
            change += 1e-6 / scale
            np.divide(mean, change, out=change)
            change *= rate
            part -= change

    def score(self, tokens: np.ndarray, first: np.ndarray, lanes: int = 512, window: int = 64) -> np.ndarray:
        """Natural log-probability of each token of whole documents; `first` has each one's first token and ends with their number.

        Documents are laid into lanes one after the other; lanes run in step and the longest come first, so the live ones are a prefix.
        """
        lengths = np.diff(first)
        out = np.zeros(len(tokens))
        if not len(lengths):
            return out
        lanes = min(lanes, len(lengths))
        order = np.argsort(-lengths, kind="stable")
        queues: list[list[int]] = [[] for _ in range(lanes)]
        load = np.zeros(lanes, dtype=np.int64)
        for k in range(0, len(order), lanes):  # longest documents to the emptiest lanes
            some = order[k:k + lanes]
            for doc, lane in zip(some, np.argsort(load, kind="stable"), strict=False):
                queues[lane].append(doc)
                load[lane] += lengths[doc]
        by = np.argsort(-load, kind="stable")
        load = load[by]
        places = [np.concatenate([np.arange(first[d], first[d + 1]) for d in queues[q]]) for q in by]
        begins = np.zeros(len(tokens) + 1, dtype=bool)
        begins[first[:-1]] = True
        before = np.roll(tokens, 1)
        before[begins[:-1]] = self.known + 1
        states, spots, filled = self.room("states", _STATES + lanes, self.hidden), [], 0
        h, wide = np.zeros((lanes, self.hidden), dtype=states.dtype), 0
        for a in range(0, int(load[0]), window):
            steps = min(window, int(load[0]) - a)
            live = np.searchsorted(-load, -np.arange(a, a + steps)).tolist()
            grid = np.zeros((steps, live[0]), dtype=np.int64)
            for lane in range(live[0]):
                own = places[lane][a:a + steps]
                grid[:len(own), lane] = own
            inputs, fresh = before[grid].astype(np.int64), begins[grid]
            some = fresh.any(axis=1).tolist()
            for t, n in enumerate(live):
                if n != wide:
                    wide, into = n, [self.room(name, *shape) for name, shape in (("gates", (3, n, self.hidden)), ("news", (n, self.hidden)), ("given", (3, n, self.hidden)))]
                h = h[:n]
                if some[t]:
                    h = h.copy()
                    h[fresh[t, :n]] = 0
                h = self.step(h, inputs[t, :n], states[filled:filled + n], *into)[0]
                spots.append(grid[t, :n])
                filled += n
                if filled > _STATES:
                    h = h.copy()
                    at = np.concatenate(spots)
                    out[at] = self.log_probs(states[:filled], tokens[at])
                    spots, filled = [], 0
        if filled:
            at = np.concatenate(spots)
            out[at] = self.log_probs(states[:filled], tokens[at])
        return out


def _kind(known: int) -> str:
    """Integers that hold every token of a network with `known` tokens."""
    return "<u2" if known + 2 <= 1 << 16 else "<u4"


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts, lower-cased, and the first word of each text."""
    data, offsets = flat(texts, lower=True)
    starts, ends, first = word_bounds(data, offsets)
    return word_hashes(data, starts, ends), first


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, 0, 32 << 20):
            words, counts = np.unique(_tokens(part.column(0))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "c"])


def _most_frequent(counts: DataFrame, listed: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and counts of the `listed` most frequent words, ties to the smaller hash. The driver gets two histograms and these rows, whatever the number of words."""
    exact = 1 << 12
    level = F.when(F.col("c") < exact, F.col("c")).otherwise(exact + F.floor(F.log2(F.col("c").cast("double")) * 64).cast("long"))
    levelled = counts.withColumn("level", level)
    room, edge = listed, -1
    for row in sorted(levelled.groupBy("level").count().collect(), key=lambda r: -r[0]):
        if row[1] > room:
            edge = row[0]
            break
        room -= row[1]
    chosen = levelled.where(F.col("level") > edge).drop("level")
    if edge >= 0:
        last = levelled.where(F.col("level") == edge).drop("level")
        if edge < exact:
            # All of one count: whole ranges of hashes first.
            some = last.withColumn("range", F.shiftright("word", 48))
            cut = None
            for row in sorted(some.groupBy("range").count().collect(), key=lambda r: r[0]):
                cut = row[0]
                if row[1] > room:
                    break
                room -= row[1]
            chosen = chosen.union(some.where(F.col("range") < cut).drop("range"))
            last = some.where(F.col("range") == cut).drop("range")
        chosen = chosen.union(last.orderBy(F.desc("c"), "word").limit(room))
    rows = stored(chosen, "word-list").toArrow()
    words, found = rows["word"].to_numpy(), rows["c"].to_numpy()
    order = np.lexsort((words, -found))
    return words[order], found[order]


class Vocabulary:
    """The most frequent words, by hash, and their counts: those with a token of their own come first by count, the others share `groups` tokens.

    Tokens are 0 for the end, 1 to `known` - 1 for single words, then the groups, and `others` for words outside the list.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, known: int, groups: int):
        self.order = np.argsort(words, kind="stable")
        self.sorted, self.counts = words[self.order], counts
        #: First listed word at or behind each value of a hash's upper 18 bits, and the list with an end behind it.
        self.begin = np.searchsorted(self.sorted, np.arange(1 << 18, dtype=U64) << U64(46)).astype(np.int32)
        self.ended = np.append(self.sorted, ~U64(0))
        self.others = known + groups
        single, mass = np.arange(1, min(known, len(counts) + 1)), counts[known - 1:] + 1.0
        middle = np.cumsum(mass) - mass / 2
        group = np.minimum((middle * groups / max(mass.sum(), 1)).astype(np.int64), groups - 1)
        self.token = np.concatenate((single, known + group))
        #: Sum of counts of each token of listed words, with one more for each word of a group, and none for the end.
        self.mass = np.bincount(self.token, weights=np.concatenate((counts[:known - 1], mass)), minlength=self.others)
        # A word of a group has (its count + 1) / mass of it; the log10 of that divisor.
        self.off = np.where(np.arange(self.others) < known, 0, np.log10(np.maximum(self.mass, 1)))

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each word in the list (0 the most frequent), or -1; and its count."""
        if not len(self.sorted):
            return np.full(len(words), -1), np.zeros(len(words), dtype=np.int64)
        at = self.begin[(words >> U64(46)).astype(np.int64)].astype(np.int64)
        less = np.flatnonzero(self.ended[at] < words)
        while len(less):
            at[less] += 1
            less = less[self.ended[at[less]] < words[less]]
        at = np.minimum(at, len(self.sorted) - 1)
        rank = np.where(self.sorted[at] == words, self.order[at], -1)
        return rank, np.where(rank >= 0, self.counts[rank], 0)

    def token_ids(self, words: np.ndarray, first: np.ndarray, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the network, an end mark behind each text, and the first token of each text."""
        if rank is None:
            rank, _ = self.find(words)
        ids = np.where(rank >= 0, self.token[rank], self.others) if len(self.token) else np.full(len(rank), self.others)
        ends = first[1:] + np.arange(1, len(first))
        out = np.zeros(len(words) + len(first) - 1, dtype=np.int64)
        keep = np.ones(len(out), dtype=bool)
        keep[ends - 1] = False
        out[keep] = ids
        return out, np.concatenate(([0], ends))


def _encode(words: Vocabulary, tasks: int, rounds: int, kind: str):
    """Tokens of each document in pieces of at most _PIECE, dealt over rounds and tasks by the document's key and the number of the piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 4 << 20):
                tokens, begins = words.token_ids(*_tokens(part.column(1)))
                counts = -(-np.diff(begins) // _PIECE)
                row = np.repeat(np.arange(part.num_rows), counts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                cuts = np.append(begins[row] + piece * _PIECE, len(tokens))
                key = part.column(0).to_numpy()[row]
                dealt = mixed(mixed(key.view(U64)) + piece.astype(U64))
                task, share = dealt % U64(tasks), dealt // U64(tasks) % U64(rounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(share.astype(np.int32)), pa.array(task.astype(np.int32)), pa.array(key), pa.array(piece.astype(np.int32)), binary(tokens.astype(kind), np.dtype(kind).itemsize * cuts)],
                    ["share", "task", "key", "piece", "tokens"])

    return run


def _fitted(training: DataFrame, words: Vocabulary, start: Network, total: int, rounds: int, task_tokens: int, blocks: int = 64) -> dict[str, np.ndarray]:
    """Weights after `rounds` rounds of training in tasks and averaging. Weights travel in `blocks` rows for each task, so no task gathers all of them."""
    names, kind = list(start.p), _kind(start.known)
    tasks = max(1, round(total / task_tokens))
    rows = training.select(F.xxhash64("by_", F.coalesce("text_", F.lit(""))).alias("key"), "text_")
    coded = stored(rows.mapInArrow(_encode(words, tasks, rounds, kind), "share int, task int, key long, piece int, tokens binary"), "train-tokens")
    flattened = np.concatenate([start.p[k].ravel() for k in names])
    shapes = [start.p[k].shape for k in names]
    ends = np.cumsum([0, *(int(np.prod(s)) for s in shapes)])

    def network(values: np.ndarray) -> dict[str, np.ndarray]:
        return {k: values[a:b].reshape(s).copy() for k, a, b, s in zip(names, ends[:-1], ends[1:], shapes, strict=True)}

    def average(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        order = np.lexsort((table.column("task").to_numpy(), n))
        parts = table.column("weights")
        values = sum(np.frombuffer(parts[int(i)].as_py(), dtype="<f4").astype(np.float64) * n[i] for i in order) / n.sum()
        return pa.table({"block": table.column("block").slice(0, 1), "weights": pa.array([values.astype("<f4").tobytes()], pa.binary())})

    def trainer(now: np.ndarray, k: int):
        def train(table: pa.Table) -> pa.Table:
            table = table.sort_by([("key", "ascending"), ("piece", "ascending")])
            parts = [x.as_py() for x in table.column("tokens")]
            tokens = np.frombuffer(b"".join(parts), dtype=kind).astype(np.int64)
            # Neighbouring pieces are of different documents, or of distant places of one.
            starts = np.cumsum([0, *(len(x) // np.dtype(kind).itemsize for x in parts[:-1])])
            net = Network(start.known, start.classes, start.hidden)
            net.p = network(now)
            net.train(tokens, starts, begin=k / rounds, end=(k + 1) / rounds)
            out = np.array_split(np.concatenate([net.p[x].ravel() for x in names]).astype("<f4"), blocks)
            return pa.table({"block": pa.array(range(blocks), pa.int32()), "task": pa.array([table.column("task")[0].as_py()] * blocks, pa.int32()), "n": pa.array([len(tokens)] * blocks), "weights": pa.array([x.tobytes() for x in out], pa.binary())})

        return train

    for k in range(rounds):
        trained = coded.where(F.col("share") == k).groupBy("task").applyInArrow(trainer(flattened, k), "block int, task int, n long, weights binary")
        found = trained.groupBy("block").applyInArrow(average, "block int, weights binary").collect()
        if found:
            flattened = np.concatenate([np.frombuffer(bytes(r[1]), dtype="<f4") for r in sorted(found, key=lambda r: r[0])])
    return network(flattened)


def score_documents(docs: DataFrame, known: int = 1024, groups: int = 1024, classes: int = 32, hidden: int = 32, listed: int = 1 << 17, sample_docs: int | None = None, rounds: int = 4, task_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probability of every whole document by an add-one unigram model (`base_score`) and by the network (`score`).

    Training documents are those whose crc32(id as text) mod 7 is not 2; a null id counts as an empty one. Tokens are words (runs of other than ASCII white space, A-Z
    lower-cased) and one end. Counts cover all training documents. `listed` bounds the word list that tasks hold (the most frequent words); counts of
    other words are joined. The network has a token for each of the `known` - 1 most frequent words and `groups` tokens for the other listed ones. The network is fitted on all training documents, or, where `sample_docs` is given, on that many with the smallest hash of the id. They are cut
    into `rounds` shares, which all together use each document once; in a round about one task for each `task_tokens` training tokens goes on from the common weights, which are
    then averaged by token count. A null text is empty: its only token is the end. Without training documents both scores are those of one unknown token after another.
    Returns one row per input row: the id column, `held_out`, `n_tokens`, `n_known`, `train_tokens`, `base_score`, `score`. Other columns are not carried.
    """
    out_kind = docs.schema[id_col].dataType.simpleString()
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id_"), (F.crc32(name) % 7 == 2).alias("held_out"), F.xxhash64(name).alias("by_"), F.col(text_col).cast("string").alias("text_"))
    training = rows.where("NOT held_out")
    counts = stored(training.select("text_").mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = training.count()
    n_words, n_kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = n_words + ends, n_kinds + (ends > 0)
    top = _most_frequent(counts, listed)
    words = Vocabulary(top[0].view(U64), top[1], known, groups)
    other_tokens, other_kinds = n_words - int(words.counts.sum()), n_kinds - len(top[0])
    bottom = np.log10(total + kinds + 1)
    other_bottom = np.log10(other_tokens + other_kinds + 1)

    share = words.mass - (np.arange(words.others) >= known)
    share[0] = ends
    net = Network(words.others, classes, hidden)
    net.start_from_counts(share, other_tokens)
    weights = _fitted(training.orderBy("by_", "id_").limit(sample_docs) if sample_docs is not None else training, words, net, total, rounds, task_tokens) if ends else None

    kind = _kind(words.others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(words.others, classes, hidden)
        if weights:
            net.p = weights

        def finished(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
            if weights and waiting:
                lengths = np.concatenate([w[3] for w in waiting])
                begins = np.concatenate(([0], np.cumsum(lengths)))
                model = np.add.reduceat(net.score(np.concatenate([w[2] for w in waiting]), begins), begins[:-1]) / np.log(10)
                cuts = np.cumsum([len(w[3]) for w in waiting])[:-1]
                waiting = [(w[0], w[1] + own, *w[2:]) for w, own in zip(waiting, np.split(model, cuts), strict=True)]
            for columns, model, *_ in waiting:
                yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(model), columns[-1]], ["id_", "held_out", "n_tokens", "known", "base", "model", "tail"])

        for batch in batches:
            waiting = []
            for part in pieces(batch, 2, 4 << 20):
                hashes, first = _tokens(part.column(2))
                n = part.num_rows
                of = np.repeat(np.arange(n), np.diff(first))
                rank, count = words.find(hashes)
                seen = rank >= 0
                logs = np.log10(count + 1.0)
                base = np.bincount(of, weights=logs, minlength=n) + np.log10(ends + 1)
                other = rank >= known - 1
                if weights:
                    tokens, begins = words.token_ids(hashes, first, rank)
                    tokens, lengths = tokens.astype(kind), np.diff(begins)
                    model = np.bincount(of[other], weights=logs[other] - words.off[words.token[rank[other]]], minlength=n) - np.bincount(of[~seen], minlength=n) * other_bottom
                else:
                    tokens, lengths, model = hashes[:0], first[:0], base - (np.diff(first) + 1) * bottom
                far = np.flatnonzero(~seen)
                order = far[np.lexsort((hashes[far], of[far]))]
                change = np.ones(len(order), dtype=bool)
                change[1:] = (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
                begin = np.flatnonzero(change)
                times = np.diff(np.append(begin, len(order)))
                lists = np.searchsorted(of[order[begin]], np.arange(n + 1)).astype(np.int32)
                tail = pa.StructArray.from_arrays([pa.array(hashes[order[begin]].view(np.int64)), pa.array(times)], ["word", "n"])
                columns = [part.column(0), part.column(1), pa.array(np.diff(first) + 1), pa.array(np.bincount(of[seen], minlength=n) + (ends > 0)), pa.array(base), pa.ListArray.from_arrays(pa.array(lists), tail)]
                waiting.append((columns, model, tokens, lengths))
                if sum(len(w[2]) for w in waiting) >= _SCORED:
                    yield from finished(waiting)
                    waiting = []
            yield from finished(waiting)

    scored = rows.select("id_", "held_out", "text_").mapInArrow(run, f"id_ {out_kind}, held_out boolean, n_tokens long, known long, base double, model double, tail array<struct<word:long,n:long>>")
    scored = stored(scored.withColumn("row_", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row_", F.explode("tail").alias("t")).select("row_", "t.word", "t.n").join(counts, "word").groupBy("row_").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum("n").alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("tail").join(rest, "row_", "left").select(
        F.col("id_").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * F.lit(float(bottom))).alias("base_score"), (F.col("model") + more).alias("score"))
