"""A gated recurrent language model in NumPy with a class-factored output.

Word numbers are frequency ranks; a class is a run of numbers, so the probability of a word is that of
its class times that within the class. Runs are equal, or given by their ``bounds`` (few frequent words
in a class and many rare ones cost least). Documents are dealt to parallel lanes and read in windows.
The state is carried from window to window and starts anew with each document; gradients stop at the
beginning of a window (truncated backpropagation).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

HIDDEN = 24
TRAIN_LANES, TRAIN_STEPS = 64, 20
SCORE_LANES, SCORE_STEPS = 512, 64
OUTPUT_ROWS = 8_192
#: Scores up to this, either way, need no shift: sums of their exponentials stay in the range of their type.
SAFE = 60
END = 1


def start_weights(words: int, classes: int, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """Small random weights from a fixed seed; ``words`` is a multiple of ``classes``."""
    generator = np.random.default_rng(11)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return generator.normal(0, scale, shape).astype(np.float32)

    return {
        "input": normal(words, 3 * hidden, scale=0.1),
        "state": normal(hidden, 3 * hidden, scale=0.5 / np.sqrt(hidden)),
        "class": normal(hidden, classes, scale=0.1),
        "class_bias": np.zeros(classes, np.float32),
        "word": normal(words, hidden, scale=0.1),
        "word_bias": np.zeros(words, np.float32),
    }


def packed(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].reshape(-1) for k in sorted(weights)])


def unpacked(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    found, at = {}, 0
    for k in sorted(like):
        found[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return found


class Lanes:
    """Documents as word numbers, dealt to lanes of nearly equal length, longest lane first."""

    def __init__(self, documents: list[np.ndarray], lanes: int):
        order = sorted(range(len(documents)), key=lambda k: -len(documents[k]))
        heap = [(0, lane) for lane in range(min(lanes, len(documents)))]
        dealt: list[list[int]] = [[] for _ in heap]
        for k in order:
            total, lane = heapq.heappop(heap)
            dealt[lane].append(k)
            heapq.heappush(heap, (total + len(documents[k]) + 1, lane))
        totals = {lane: total for total, lane in heap}
        dealt = [dealt[lane] for lane in sorted(totals, key=lambda lane: (-totals[lane], lane))]
        flat = [k for own in dealt for k in own]
        end = np.array([END], np.int32)
        self.inputs = np.concatenate([x for k in flat for x in (end, documents[k])] or [end[:0]])
        self.targets = np.concatenate([x for k in flat for x in (documents[k], end)] or [end[:0]])
        sizes = np.array([len(documents[k]) + 1 for k in flat], np.int64)
        self.document = np.repeat(np.array(flat, np.int64), sizes)
        self.fresh = np.zeros(len(self.inputs), bool)
        self.fresh[np.cumsum(sizes) - sizes] = True
        self.lengths = np.array([sum(len(documents[k]) + 1 for k in own) for own in dealt], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the tokens, a row for each step and a column for each lane that still runs, and
        which of them are inside their lane."""
        for start in range(0, int(self.lengths[0]) if len(self.lengths) else 0, steps):
            running = int(np.searchsorted(-self.lengths, -start, "left"))
            at = start + np.arange(min(steps, int(self.lengths[0]) - start))[:, None]
            inside = at < self.lengths[:running]
            yield self.offsets[:running] + np.minimum(at, self.lengths[:running] - 1), inside


def logistic(x: np.ndarray) -> np.ndarray:
    """In place; an exponential beyond the range of its type gives 0, as it should."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def joined(rows: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One table of rows that end with their bias, and views of both parts."""
    table = np.concatenate([rows, bias[:, None]], axis=1, dtype=np.float32)
    return table, table[:, :-1], table[:, -1]


class Slopes(NamedTuple):
    """Gradients of the loss of a window."""

    #: Of the class table, its bias as the last row.
    classes: np.ndarray
    #: Of the states, a row for each target.
    states: np.ndarray
    #: For each class that was met, its number and two factors: shares of its words less the targets, and states that
    #: end with 1. Their product is the gradient of the word rows. The shares are good until the next window.
    within: list[tuple[int, np.ndarray, np.ndarray]]
    #: All the states of these factors, in one table.
    factors: np.ndarray
    #: No less than the sum of the squares of all these products.
    bound: float


class Network:
    """Weights, and ``bounds`` of the classes (the first word of each and the number of words); equal runs without.

    Word rows and the class table are copied, each with its bias, and ``w`` has views of the copies.
    """

    def __init__(self, weights: dict[str, np.ndarray], bounds: np.ndarray | None = None):
        self.w = dict(weights)
        self.words, self.w["word"], self.w["word_bias"] = joined(weights["word"], weights["word_bias"])
        self.table = np.concatenate([weights["class"], weights["class_bias"][None]], dtype=np.float32)
        self.w["class"], self.w["class_bias"] = self.table[:-1], self.table[-1]
        self.hidden, self.classes = weights["class"].shape
        equal = np.arange(self.classes + 1) * (len(self.words) // self.classes)
        self.bounds = equal if bounds is None else np.asarray(bounds, np.int64)
        self.sizes = np.diff(self.bounds)
        number = np.int16 if self.classes < 1 << 15 else np.int64  # short ones are sorted by radix
        self.of_class = np.repeat(np.arange(self.classes, dtype=number), self.sizes)
        self.spans = list(zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist()))
        self.buffer = np.empty(0, np.float32)

    def read(self, inputs: np.ndarray, fresh: np.ndarray, state: np.ndarray):
        """Reads a window, a row of inputs for each step and a column for each lane; ``state`` has a row for each lane.
        Returns what the backward steps need and the states after each step, by step, unit and lane, so that each
        gate lies in one piece."""
        h = self.hidden
        recurrent = np.ascontiguousarray(self.w["state"].T)
        keep = 1 - fresh.astype(np.float32)
        shape = (len(inputs), h, inputs.shape[1])
        gates = np.empty((len(inputs), 3 * h, inputs.shape[1]), np.float32)
        before, inner, candidates, states = (np.empty(shape, np.float32) for _ in range(4))
        from_state = np.empty(gates.shape[1:], np.float32)
        state = state.T
        for t in range(len(inputs)):
            gates[t] = self.w["input"][inputs[t]].T
            own = np.multiply(state, keep[t], out=before[t])
            np.dot(recurrent, own, out=from_state)
            both = gates[t, : 2 * h]
            both += from_state[: 2 * h]
            logistic(both)
            inner[t] = from_state[2 * h :]
            candidate = np.multiply(both[:h], inner[t], out=candidates[t])
            candidate += gates[t, 2 * h :]
            np.tanh(candidate, out=candidate)
            state = np.subtract(own, candidate, out=states[t])
            state *= both[h:]
            state += candidate
        return keep, before, gates, inner, candidates, states

    def output(self, states: np.ndarray, targets: np.ndarray, learn: bool = False) -> tuple[np.ndarray, Slopes | None]:
        """Natural log probability of every target, and with ``learn`` the gradients."""
        order = np.argsort(self.of_class[targets], kind="stable")
        targets = targets[order]
        of_class, rows = self.of_class[targets], np.arange(len(order))
        own = np.empty((len(order), self.hidden + 1), np.float32)
        own[:, :-1], own[:, -1] = states[order], 1
        scores = own @ self.table
        if scores.size and max(float(scores.max()), -float(scores.min())) > SAFE:
            scores -= scores.max(1, keepdims=True)
        found = scores[rows, of_class]
        shares = np.exp(scores, out=scores)
        sums = shares @ np.ones(self.classes, np.float32)
        found -= np.log(sums)
        if learn:
            shares /= sums[:, None]
            shares[rows, of_class] -= 1
            by_class = own.T @ shares
            by_state = shares @ np.ascontiguousarray(self.w["class"].T)
        # Scores within the classes lie in one buffer, token by token, each with as many as its class has words.
        starts = np.flatnonzero(np.diff(of_class, prepend=-1))
        ends = [*starts[1:].tolist(), len(order)]
        groups = [(k, a, b, *self.spans[k]) for k, a, b in zip(of_class[starts].tolist(), starts.tolist(), ends)]
        lengths = self.sizes[of_class]
        begins = np.cumsum(lengths) - lengths
        need = int(lengths.sum())
        if len(self.buffer) < need:
            self.buffer = np.empty(need + need // 4, np.float32)
        inner, blocks, at = self.buffer[:need], [], 0
        for _, a, b, low, high in groups:
            block = inner[at : at + (b - a) * (high - low)].reshape(b - a, high - low)
            np.dot(own[a:b], self.words[low:high].T, out=block)
            blocks.append(block)
            at += block.size
        if need and max(float(inner.max()), -float(inner.min())) > SAFE:
            inner -= np.repeat(np.maximum.reduceat(inner, begins), lengths)
        places = begins + targets - self.bounds[of_class]
        found += inner[places]
        np.exp(inner, out=inner)
        sums = np.add.reduceat(inner, begins) if need else inner
        found -= np.log(sums)
        result = np.empty_like(found)
        result[order] = found
        if not learn:
            return result, None
        inner *= np.repeat(1 / sums, lengths)
        inner[places] -= 1
        by_word = np.zeros_like(own)
        within = []
        for (k, a, b, low, high), block in zip(groups, blocks):
            if high - low > 1:  # a word alone in its class is certain
                np.dot(block, self.words[low:high], out=by_word[a:b])
                within.append((k, block, own[a:b]))
        by_state += by_word[:, :-1]
        back = np.empty_like(by_state)
        back[order] = by_state
        # The squares of a token's shares less its target sum to 2 (1 - share of the target) ** 2 at most.
        missed, size = inner[places], np.einsum("ij,ij->i", own, own)
        bound = 2 * float(np.add.reduceat(missed * missed, starts) @ np.add.reduceat(size, starts)) if need else 0.0
        return result, Slopes(by_class, back, within, own, bound)

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """Log10 probability of every whole document, its end included."""
        lanes = Lanes(documents, SCORE_LANES)
        totals = np.zeros(len(documents))
        state = np.zeros((len(lanes.lengths), self.hidden), np.float32)
        for at, inside in lanes.windows(SCORE_STEPS):
            states = self.read(lanes.inputs[at], lanes.fresh[at], state[: at.shape[1]])[-1].transpose(0, 2, 1)
            state = states[-1]
            states, at = states[inside], at[inside]
            for a in range(0, len(at), OUTPUT_ROWS):
                part = slice(a, a + OUTPUT_ROWS)
                found, _ = self.output(states[part], lanes.targets[at[part]])
                totals += np.bincount(lanes.document[at[part]], found.astype(float), minlength=len(documents))
        return totals / np.log(10)


class Trainer:
    """Adam over windows of lanes. Rows of the word tables move only in windows that touch them, so the
    work of a window doesn't follow the vocabulary.

    Word rows of a class move when ``gather`` of its tokens were met since they moved last, by the sum of all their
    gradients, and at the end of a pass. With 1 that is in every window that touches the class.
    """

    def __init__(self, weights: dict[str, np.ndarray], rate: float, bounds: np.ndarray | None = None, gather: int = 1):
        self.network = Network({k: v.copy() for k, v in weights.items()}, bounds)
        self.rate, self.gather, self.turn, self.tokens = rate, gather, 0, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}
        self.word_mean, self.mean["word"], self.mean["word_bias"] = joined(self.mean["word"], self.mean["word_bias"])
        self.word_square, self.square["word"], self.square["word_bias"] = joined(self.square["word"], self.square["word_bias"])
        self.waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.met = [0] * self.network.classes

    def learn(self, documents: list[np.ndarray]) -> None:
        """One pass over the documents."""
        lanes = Lanes(documents, TRAIN_LANES)
        state = np.zeros((len(lanes.lengths), self.network.hidden), np.float32)
        for at, inside in lanes.windows(TRAIN_STEPS):
            state = self.window(lanes, at, inside, state[: at.shape[1]])
        for k in list(self.waiting):
            self.move_class(k)

    def window(self, lanes: Lanes, at: np.ndarray, inside: np.ndarray, state: np.ndarray) -> np.ndarray:
        net, w = self.network, self.network.w
        h = net.hidden
        inputs, fresh = lanes.inputs[at], lanes.fresh[at]
        keep, before, gates, inner, candidates, states = net.read(inputs, fresh, state)
        targets = lanes.targets[at[inside]]
        _, slopes = net.output(states.transpose(0, 2, 1)[inside], targets, learn=True)
        by_state = np.zeros((*at.shape, h), np.float32)
        by_state[inside] = slopes.states
        by_state = np.ascontiguousarray(by_state.transpose(0, 2, 1))
        reset, update = gates[:, :h], gates[:, h : 2 * h]
        # What the gradient of a state is multiplied by, for all steps at once.
        by_candidate = (1 - update) * (1 - candidates * candidates)
        by_update = (before - candidates) * update * (1 - update)
        by_reset = inner * reset * (1 - reset)
        last = np.empty_like(before)
        through = np.empty_like(gates)
        recurrent = w["state"]
        later = np.zeros(states.shape[1:], np.float32)
        for t in reversed(range(len(at))):
            now = by_state[t]
            now += later
            candidate = np.multiply(now, by_candidate[t], out=last[t])
            np.multiply(candidate, by_reset[t], out=through[t, :h])
            np.multiply(now, by_update[t], out=through[t, h : 2 * h])
            np.multiply(candidate, reset[t], out=through[t, 2 * h :])
            np.dot(recurrent, through[t], out=later)
            now *= update[t]
            later += now
            later *= keep[t]
        by_recurrent = np.matmul(before, through.transpose(0, 2, 1)).sum(0)
        through[:, 2 * h :] = last
        words = inputs.reshape(-1)
        order = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.diff(words[order], prepend=-1))
        met = words[order[first]]
        by_input = through.transpose(0, 2, 1).reshape(len(words), 3 * h)[order]
        gradients = {
            "input": np.add.reduceat(by_input, first, axis=0),
            "state": by_recurrent,
            "class": slopes.classes[:-1],
            "class_bias": slopes.classes[-1],
        }
        many = int(inside.sum())
        self.tokens += many
        self.turn += 1
        scale = 1 / max(1, many)
        norm = sum(float(np.vdot(g, g)) for g in gradients.values())
        if scale * scale * (norm + slopes.bound) > 1:  # else nothing is clipped
            for _, shares, factors in slopes.within:
                if len(shares) < 2 * h:  # the norm of a product, without the product
                    norm += float(np.vdot(shares @ shares.T, factors @ factors.T))
                else:
                    norm += float(np.square(shares.T @ factors).sum())
        factor = np.float32(scale * min(1.0, 1.0 / max(scale * np.sqrt(norm), 1e-9)))
        for k, g in gradients.items():
            rows = met if k == "input" else slice(None)
            mean, square = self.mean[k][rows], self.square[k][rows]
            g *= factor
            w[k][rows] -= self.step(g, mean, square)
            if k == "input":  # copies, where slices are views
                self.mean[k][rows], self.square[k][rows] = mean, square
        np.multiply(slopes.factors, factor, out=slopes.factors)
        for k, shares, factors in slopes.within:
            self.met[k] += len(shares)
            if self.met[k] < self.gather:
                self.waiting.setdefault(k, []).append((shares.copy(), factors.copy()))
            else:
                self.waiting.setdefault(k, []).append((shares, factors))
                self.move_class(k)
        return states[-1].T

    def move_class(self, k: int) -> None:
        """Moves the word rows of a class by the gradients that wait for it."""
        parts = self.waiting.pop(k)
        self.met[k] = 0
        shares, factors = (x[0] if len(x) == 1 else np.concatenate(x) for x in zip(*parts))
        rows = slice(*self.network.spans[k])
        self.network.words[rows] -= self.step(shares.T @ factors, self.word_mean[rows], self.word_square[rows])

    @property
    def gradients(self) -> dict[str, np.ndarray]:
        """Gradients that no weight has moved by yet, those of the classes that wait."""
        left = {k: np.zeros(v.shape, np.float32) for k, v in self.network.w.items()}
        for k, parts in self.waiting.items():
            rows = slice(*self.network.spans[k])
            for shares, factors in parts:
                both = shares.T @ factors
                left["word"][rows] += both[:, :-1]
                left["word_bias"][rows] += both[:, -1]
        return left

    def step(self, g: np.ndarray, mean: np.ndarray, square: np.ndarray) -> np.ndarray:
        """What to take from weights by their gradient, which is overwritten; both moments move."""
        g *= np.float32(0.1)
        mean *= np.float32(0.9)
        mean += g
        g *= g
        g *= np.float32(0.1)
        square *= np.float32(0.999)
        square += g
        move = np.sqrt(square, out=g)
        move += np.float32(1e-6)
        np.divide(mean, move, out=move)
        move *= np.float32(self.rate * np.sqrt(1 - 0.999**self.turn) / (1 - 0.9**self.turn))
        return move
