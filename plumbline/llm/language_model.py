"""Scoring documents with a gated recurrent language model.

Words are counted over the whole training part. The most frequent ``MODELLED`` words get places in classes
of about equal frequency; the model predicts the class of the next word from its state, and within the
class the word. Less frequent words form classes of their own within which the training counts, with 0.1
added, decide; the last of them holds all words outside of the ``KNOWN`` most frequent ones, with one place
for all unknown words. So the probabilities of all words add up to one.

Training is distributed: a hash of the id deals the training documents to ``ROUNDS`` rounds, so that each
is learned from once. In a round every task runs truncated backpropagation over its share, the tasks'
parameters are averaged by their numbers of tokens, and the next round starts from the average. Scoring runs every
document from its first to its last word, documents of like length side by side; the state is carried from word to word.
Texts are cut into words twice, to count them and to write their input rows, 16 bits each, which all rounds and the
scoring read. Counts of the ``KNOWN`` words travel with the code, a table of bounded size; those of other words are
joined.

Defined cases: a missing text is an empty one, of which the end is scored. Repeated rows are scored each;
a missing id counts as the empty text in the split. Without training documents every probability is
one. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.classifier import remainder
from plumbline.llm.common import give_back, materialise, one_by_one, short_batches, text_of
from plumbline.llm.hashing import GOLDEN, mix

KNOWN = 1 << 18
MODELLED = 4096
CLASSES = 64
RARE_CLASSES = 8
HIDDEN = 24
WINDOW = 16
#: Pieces that are learned from side by side: a quarter of those at hand, within these bounds.
SIDE_BY_SIDE = (128, 512)
#: Documents are learned from in pieces of so many words.
PIECE = 256
#: Every training document is learned from in one of so many rounds.
ROUNDS = 4
SMOOTHING = 0.1
#: Words are found among the known ones by so many bits of their hash.
LEADING = 20
#: Different words of a task's texts that are counted before they go on.
COUNTED_AT_ONCE = 1 << 20
BLOCK = 16384
ROWS_AT_ONCE = 16384
#: Documents of about so many tokens are handled together, however many rows come at once.
TOKENS_AT_ONCE = 1 << 19
#: Encoded documents are learned from, and scored, by about so many tokens of a task, whatever batches they come in.
LEARNED_AT_ONCE = 1 << 20
SCORED_AT_ONCE = 1 << 21
#: Documents that are scored side by side, a long one beside other long ones.
SCORED_TOGETHER = 1024
#: Where the sums of squared slopes begin: windows of few words move the parameters little.
START_SQUARES = 1.0
#: Sums of exponentials outside of these are taken again, scaled by the largest of each row.
SMALLEST, LARGEST = 1e-18, 1e18
#: Slopes of an input that occurs so often in a window or less are added member by member.
SHORT_RUN = 16
#: So many logits stay in a core's cache.
NEAR = 1 << 17


_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of the eight bytes from a word's start, those that belong to a word of so many bytes.
_OWN_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
#: Stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and hashes of their words in lower case (A to Z only), an end behind those of each."""
    n = len(texts)
    places = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset: texts.offset + n + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8)[places[0]: places[-1]] if held else np.zeros(0, dtype=np.uint8)
    places -= places[0]
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    some = places[1:] > places[:-1]
    opening, closing = places[:-1][some], places[1:][some] - 1
    first[opening], last[closing] = inside[opening], inside[closing]
    start = np.flatnonzero(first)
    size = np.flatnonzero(last) + 1 - start
    eights = np.zeros(len(data) // 8 + 3, dtype=np.uint64)
    eights.view(np.uint8)[: len(data)] = _LOWER[data]

    def part(of: slice | np.ndarray, k: int) -> np.ndarray:
        """Bytes 8 k to 8 k + 7 of words, those behind a word as zeros."""
        at = start[of] + 8 * k
        by = ((at & 7) << 3).astype(np.uint64)
        at >>= 3
        both = (eights[at] >> by) | ((eights[at + 1] << np.uint64(1)) << (np.uint64(63) - by))
        return both & _OWN_BYTES[np.minimum(size[of] - 8 * k, 8)]

    hashed = mix(part(slice(None), 0) ^ (size.astype(np.uint64) * GOLDEN))
    k, longer = 1, np.flatnonzero(size > 8)
    while len(longer):
        hashed[longer] = mix(part(longer, k) ^ (hashed[longer] + GOLDEN))
        k += 1
        longer = longer[size[longer] > 8 * k]
    upto = np.searchsorted(start, places)
    found = np.full(len(start) + n, END, dtype=np.uint64)
    found[np.arange(len(start)) + np.repeat(np.arange(n), np.diff(upto))] = hashed
    return upto + np.arange(n + 1), found.view(np.int64)


@dataclass
class Vocabulary:
    """The most frequent words, sorted by hash, and the classes of all words."""

    hashes: np.ndarray
    log_count: np.ndarray  # log10 of the count + 0.1
    place: np.ndarray  # row of the input table; for modelled words also of the output table
    group: np.ndarray  # class
    within: np.ndarray  # log10 of the share in the class, for words that are not modelled
    bounds: np.ndarray  # of the modelled classes among the modelled words
    modelled_counts: np.ndarray
    class_counts: np.ndarray
    tail_total: float  # denominator in the last class

    @property
    def modelled(self) -> int:
        return len(self.modelled_counts)

    @property
    def classes(self) -> int:
        return len(self.class_counts)

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray, n_tokens: int, n_words: int) -> Vocabulary:
        """From the most frequent words, most frequent first, and the totals over all words."""
        m = min(MODELLED, len(hashes))
        cuts = lambda c, n: np.unique(
            np.concatenate([[0], np.searchsorted(np.cumsum(np.sqrt(c)), np.sqrt(c).sum() * np.arange(1, n) / n) + 1, [len(c)]])
        ).clip(0, len(c))
        bounds = np.unique(cuts(counts[:m].astype(float), CLASSES)) if m else np.zeros(1, dtype=np.int64)
        rare = counts[m:].astype(float)
        edges = np.unique(cuts(rare, RARE_CLASSES)) if len(rare) else np.zeros(1, dtype=np.int64)
        group = np.concatenate([
            np.searchsorted(bounds, np.arange(m), side="right") - 1,
            len(bounds) - 1 + np.searchsorted(edges, np.arange(len(rare)), side="right") - 1,
        ]).astype(np.int32)
        last = len(bounds) - 1 + len(edges) - 1
        class_counts = np.bincount(group, weights=counts, minlength=last + 1) + SMOOTHING
        class_counts[last] += n_tokens - counts.sum()
        sizes = np.bincount(group, minlength=last + 1)
        total = np.bincount(group, weights=counts + SMOOTHING, minlength=last + 1)
        within = np.log10((counts + SMOOTHING) / total[group]) if len(counts) else np.zeros(0)
        within[:m] = 0.0
        place = np.where(np.arange(len(hashes)) < m, np.arange(len(hashes)), m + group - (len(bounds) - 1))
        order = np.argsort(hashes)
        return cls(
            hashes[order], np.log10(counts + SMOOTHING)[order], place.astype(np.int32)[order], group[order], within[order],
            bounds, counts[:m].astype(float), class_counts,
            float(n_tokens - counts.sum() + SMOOTHING * (n_words - sizes.sum() + 1)),
        )

    @cached_property
    def group_of_place(self) -> np.ndarray:
        modelled = len(self.bounds) - 1
        return np.concatenate([np.repeat(np.arange(modelled), np.diff(self.bounds)), np.arange(modelled, self.classes)]).astype(np.uint16)

    @cached_property
    def sizes(self) -> np.ndarray:
        """Modelled words in each class."""
        return np.concatenate([np.diff(self.bounds), np.zeros(self.classes - len(self.bounds) + 1, dtype=np.int64)])

    @staticmethod
    def _leading(hashed: np.ndarray) -> np.ndarray:
        """The leading bits, in the order of signed numbers."""
        return (hashed >> (64 - LEADING)) + (1 << (LEADING - 1))

    @cached_property
    def _starts(self) -> np.ndarray:
        """The first of the sorted words with each value of the leading bits."""
        return np.searchsorted(self._leading(self.hashes), np.arange((1 << LEADING) + 1)).astype(np.int32)

    def look_up(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index among the sorted words, and whether the word is there."""
        if not len(self.hashes):
            return np.zeros(len(hashed), dtype=np.int64), np.zeros(len(hashed), dtype=bool)
        leading = self._leading(hashed)
        at, end = self._starts[leading], self._starts[leading + 1]
        np.minimum(at, len(self.hashes) - 1, out=at)
        there = self.hashes[at] == hashed
        left = np.flatnonzero(~there & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.hashes[at[left]] == hashed[left]
            there[left[hit]] = True
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return at, there

    def places(self, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        """Input rows of what :meth:`look_up` gave; unknown words share the last."""
        rest = self.modelled + self.classes - len(self.bounds)
        return np.where(there, self.place[at], rest) if len(self.hashes) else np.full(len(at), rest)

    def encode(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Input rows and classes."""
        place = self.places(*self.look_up(hashed)).astype(np.int64)
        return place, self.group_of_place[place].astype(np.int64)


class _Softmax:
    """Log probabilities of words (or classes) among those of their class, and with ``learning`` the slopes.

    The biases are weights of the exponentials and not added to each row, or with ``shifted`` added, and the largest of
    each row taken off.
    """

    def __init__(self, table: np.ndarray, bias: np.ndarray, shifted: bool, learning: bool):
        self.table, self.bias, self.shifted, self.learning = np.ascontiguousarray(table), bias, shifted, learning
        self.weight = np.ones_like(bias) if shifted else np.exp(bias)
        self.safe = bool(len(bias) == 0 or self.weight.min() > SMALLEST)
        if learning:
            self.weighted = self.table * self.weight[:, None]
            self.summed = np.zeros((len(table), table.shape[1] + 1), dtype=np.float32)

    def of(self, room, s: np.ndarray, pieces: list[tuple[slice, slice, slice]], begin: np.ndarray, chosen: np.ndarray):
        """Of the ``chosen`` entries, and the slopes by ``s``.

        A piece is rows of ``s`` with the entries of their class and the place of the logits between them. The logit of a
        row and an entry is at ``begin`` of the row and the entry.
        """
        n, h = s.shape
        at, flat = begin + chosen, room("logits", pieces[-1][2].stop)
        views = [(rows, columns, flat[places].reshape(rows.stop - rows.start, -1)) for rows, columns, places in pieces]
        for rows, columns, logits in views:
            np.matmul(s[rows], self.table[columns].T, out=logits)
            if self.shifted:
                logits += self.bias[columns]
                logits -= logits.max(axis=1, keepdims=True)
        told = flat[at] if self.shifted else flat[at] + self.bias[chosen]
        np.exp(flat, out=flat)
        sums = np.empty(n, dtype=np.float32)
        for rows, columns, logits in views:
            np.matmul(logits, self.weight[columns], out=sums[rows])
        self.safe = bool(self.safe and sums.min() > SMALLEST and sums.max() < LARGEST)
        told -= np.log(sums)
        if not self.learning:
            return told, None
        flat[at] -= sums / self.weight[chosen]
        factor = np.divide(-1, sums, out=sums)
        scaled, slope = room("scaled", n, h + 1), room("slopes of a part", n, h)
        np.multiply(s, factor[:, None], out=scaled[:, :h])
        scaled[:, h] = factor
        for rows, columns, logits in views:
            np.matmul(logits, self.weighted[columns], out=slope[rows])
            self.summed[columns] += logits.T @ scaled[rows]
        slope *= factor[:, None]
        return told, slope

    def slopes(self) -> tuple[np.ndarray, np.ndarray]:
        """By the table and by the biases."""
        self.summed *= self.weight[:, None]
        return self.summed[:, :-1].copy(), self.summed[:, -1].copy()


class Network:
    """A gated recurrent unit with a class-factored output."""

    NAMES = ("x", "u", "wc", "bc", "ww", "bw")

    def __init__(self, vocabulary: Vocabulary):
        rng = np.random.default_rng(7)
        self.v, h = vocabulary, HIDDEN
        inputs = vocabulary.modelled + vocabulary.classes - (len(vocabulary.bounds) - 1) + 1
        self.begin = inputs - 1
        # Update gate, reset gate and new state one behind the other, so that each is one stretch of memory.
        self.x = rng.normal(0, 0.3, (3, inputs, h)).astype(np.float32)
        self.u = rng.normal(0, h**-0.5, (3, h, h)).astype(np.float32)
        self.wc = np.zeros((h, vocabulary.classes), dtype=np.float32)
        self.bc = np.log(vocabulary.class_counts / vocabulary.class_counts.sum()).astype(np.float32)
        self.ww = np.zeros((vocabulary.modelled, h), dtype=np.float32)
        self.bw = np.log(vocabulary.modelled_counts + SMOOTHING).astype(np.float32)
        self.squares = None
        self._rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array that is written again and again, as new memory costs more than what is done with it."""
        size = math.prod(shape)
        if name not in self._rooms or self._rooms[name].size < size:
            self._rooms[name] = np.empty(size, dtype=np.float32)
        return self._rooms[name][:size].reshape(shape)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).reshape(-1) for n in self.NAMES])

    def load(self, values: np.ndarray) -> Network:
        for name in self.NAMES:
            own = getattr(self, name)
            setattr(self, name, values[: own.size].reshape(own.shape).astype(np.float32).copy())
            values = values[own.size:]
        return self

    def _cell(self, a: np.ndarray, state: np.ndarray, zr: np.ndarray, new: np.ndarray, b: np.ndarray, after: np.ndarray):
        """Writes the next state to ``after`` from what the inputs give, with the gates z and r, what is new and what r lets pass.

        The gates close as their sums grow, which saves turning signs.
        """
        np.matmul(state, self.u, out=b)
        np.add(a[:2], b[:2], out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[1], b[2], out=new)
        new += a[2]
        np.tanh(new, out=new)
        np.subtract(state, new, out=after)
        after *= zr[0]
        after += new

    def _given(self, inputs: np.ndarray) -> np.ndarray:
        out = self._room("given", 3, *inputs.shape, HIDDEN)
        for of, part in zip(self.x, out, strict=True):
            np.take(of, inputs, axis=0, out=part, mode="clip")  # the only mode that writes to its place at once
        return out

    def step(self, inputs: np.ndarray, state: np.ndarray, after: np.ndarray | None = None):
        """The next state, in ``after`` if given, and the gates: z and r, what is new, and what r lets pass."""
        n, h = state.shape
        after = np.empty((n, h), dtype=np.float32) if after is None else after
        gates = self._room("zr", 2, n, h), self._room("new", n, h), self._room("passed", 3, n, h)
        self._cell(self._given(inputs), state, *gates, after)
        return after, gates

    def log_probability(self, state: np.ndarray, place: np.ndarray, group: np.ndarray, grads: dict | None = None):
        """Natural log probability of class and modelled word; with ``grads`` also the slope by state."""
        with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
            found, slope, safe = self._log_probability(state, place, group, grads, False)
        return (found, slope) if safe else self._log_probability(state, place, group, grads, True)[:2]

    def _log_probability(self, state: np.ndarray, place: np.ndarray, group: np.ndarray, grads: dict | None, shifted: bool):
        """The same and whether no sum of exponentials left the range of floats, as without ``shifted`` none is scaled."""
        (n, h), v = state.shape, self.v
        short = group.astype(np.uint16)  # short numbers are sorted by counting
        order = np.argsort(short, kind="stable")
        s = np.take(state, order, axis=0, out=self._room("states by class", n, h), mode="clip")
        place, group = place[order], group[order]
        upto = np.searchsorted(group, np.arange(len(v.bounds))).tolist()  # rows of the modelled classes
        size = v.sizes[group]
        start = np.cumsum(size) - size
        with_classes = start + v.classes * np.arange(n)
        cuts = np.unique(np.searchsorted(with_classes, np.arange(0, with_classes.max(initial=-1) + 1, NEAR))).tolist()
        softmax = {
            "c": _Softmax(self.wc.T, self.bc, shifted, grads is not None), "w": _Softmax(self.ww, self.bw, shifted, grads is not None)
        }
        found, slope = np.empty(n, dtype=np.float32), self._room("slopes by class", n, h)
        for i, j in zip(cuts, [*cuts, n][1:], strict=True):
            whole = [(slice(0, j - i), slice(0, v.classes), slice(0, (j - i) * v.classes))]
            found[i:j], inner = softmax["c"].of(self._room, s[i:j], whole, np.arange(j - i) * v.classes, group[i:j])
            if inner is not None:
                slope[i:j] = inner
            j = min(j, upto[-1])
            if i >= j:
                continue
            first, pieces = start[i], []
            for c in range(group[i], group[j - 1] + 1):
                a, b = max(i, upto[c]), min(j, upto[c + 1])
                if a < b:
                    columns = slice(v.bounds[c], v.bounds[c + 1])
                    pieces.append((slice(a - i, b - i), columns, slice(start[a] - first, start[b - 1] + size[b - 1] - first)))
            begin = start[i:j] - first - v.bounds[group[i:j]]
            told, inner = softmax["w"].of(self._room, s[i:j], pieces, begin, place[i:j])
            found[i:j] += told
            if inner is not None:
                slope[i:j] += inner
        result = np.empty_like(found)
        result[order] = found
        safe = all(x.safe for x in softmax.values())
        if grads is None:
            return result, None, safe
        (wc, grads["bc"]), (grads["ww"], grads["bw"]) = (x.slopes() for x in softmax.values())
        grads["wc"] = wc.T.copy()
        by_row = self._room("slopes", n, h)
        by_row[order] = slope
        return result, by_row, safe

    def learn(self, inputs: np.ndarray, place: np.ndarray, group: np.ndarray, live: np.ndarray, state: np.ndarray, rate: float):
        """One window (steps by documents) of truncated backpropagation; gives the state after it."""
        h, (steps, n) = HIDDEN, inputs.shape
        states = self._room("states", steps + 1, n, h)
        states[0] = state
        a, zr, new, passed = self._given(inputs), *(self._room(*k, steps, n, h) for k in (("zr", 2), ("new",), ("passed", 3)))
        for t in range(steps):
            self._cell(a[:, t], states[t], zr[:, t], new[t], passed[:, t], states[t + 1])
        grads: dict = {}
        seen, place, group = states[1:].reshape(-1, h), place.reshape(-1), group.reshape(-1)
        if live.all():
            ds = self.log_probability(seen, place, group, grads)[1]
        else:
            alive = np.flatnonzero(live)
            ds = np.zeros((steps * n, h), dtype=np.float32)
            ds[alive] = self.log_probability(seen[alive], place[alive], group[alive], grads)[1]
        ds = ds.reshape(steps, n, h)
        # What was given and passed is used up step by step.
        dx, inner, back, down = a, passed[2], 0, self.u.transpose(0, 2, 1).copy()
        rest, by_gate = self._room("rest", n, h), self._room("by gate", 3, n, h)
        for t in range(steps - 1, -1, -1):
            d, (z, r), (dz, dr, dn) = ds[t], zr[:, t], dx[:, t]
            d += back
            np.subtract(1, z, out=rest)
            np.multiply(new[t], new[t], out=dn)
            np.subtract(1, dn, out=dn)
            dn *= rest
            dn *= d
            np.subtract(new[t], states[t], out=dz)
            rest *= z
            rest *= d
            dz *= rest
            np.subtract(r, 1, out=dr)
            dr *= r
            dr *= inner[t]
            dr *= dn
            np.multiply(dn, r, out=inner[t])
            for k, of in enumerate((dz, dr, inner[t])):
                np.matmul(of, down[k], out=by_gate[k])
            d *= z
            d += by_gate[0]
            d += by_gate[1]
            d += by_gate[2]
            back = d
        before = states[:-1].reshape(-1, h).T
        du = np.stack([before @ of.reshape(-1, h) for of in (dx[0], dx[1], inner)])
        if self.squares is None:
            self.squares = {n: np.full_like(getattr(self, n), START_SQUARES) for n in self.NAMES}
        rows, gx = self._by_input(inputs.reshape(-1), dx.reshape(3, -1, h))
        squares = self.squares["x"][:, rows] + gx * gx
        self.squares["x"][:, rows] = squares
        gx *= rate
        gx /= np.sqrt(squares, out=squares)
        self.x[:, rows] += gx
        for name, grad in {**grads, "u": du}.items():
            np.clip(grad, -50, 50, out=grad)
            squares, own = self.squares[name], getattr(self, name)
            squares += grad * grad
            grad /= np.sqrt(squares)
            grad *= rate
            own += grad
        return states[steps].copy()

    def _by_input(self, inputs: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different inputs and the sums of their slopes: long runs by products, short ones member by member."""
        short = inputs.astype(np.uint16)
        order = np.argsort(short, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(short[order]) != 0]))
        counts = np.diff(starts, append=len(order))
        by_count = np.argsort(-counts, kind="stable")
        starts, counts = starts[by_count], counts[by_count]
        sorted_dx = self._room("slopes by input", *dx.shape)
        for of, part in zip(dx, sorted_dx, strict=True):
            np.take(of, order, axis=0, out=part, mode="clip")
        sums = np.take(sorted_dx, starts, axis=1)
        n_long = int((counts > SHORT_RUN).sum())
        ones = np.ones(int(counts.max(initial=0)), dtype=np.float32)
        for i, (at, n) in enumerate(zip(starts[:n_long].tolist(), counts[:n_long].tolist(), strict=True)):
            np.matmul(ones[:n], sorted_dx[:, at: at + n], out=sums[:, i])
        for member in range(1, SHORT_RUN):
            end = int(np.searchsorted(-counts, -member))  # those with more members than this come first
            if end <= n_long:
                break
            sums[:, n_long:end] += sorted_dx[:, starts[n_long:end] + member]
        return short[order[starts]], sums


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Ranges of documents of about ``TOKENS_AT_ONCE``, with their offsets and tokens."""
    lists = batch.column("tokens")
    offsets, hashed = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    start = 0
    while start < len(lists):
        end = int(np.searchsorted(offsets, offsets[start] + TOKENS_AT_ONCE, side="right")) - 1
        end = min(max(end, start + 1), len(lists))
        yield slice(start, end), offsets[start: end + 1] - offsets[start], hashed[offsets[start]: offsets[end]]
        start = end


def train_batch(net: Network, offsets: np.ndarray, place: np.ndarray, rate: float) -> None:
    """Learns from all words, in pieces of documents that are taken in a fixed mixed order, side by side."""
    place = place.astype(np.int64)
    group = net.v.group_of_place[place]
    sizes = np.diff(offsets).astype(np.int64)
    pieces = -(-sizes // PIECE)
    turn = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(offsets[:-1].astype(np.int64), pieces) + turn * PIECE
    length = np.minimum(np.repeat(sizes, pieces) - turn * PIECE, PIECE)
    opening = np.where(turn > 0, place[np.maximum(start - 1, 0)], net.begin)
    mixed = np.argsort(mix(np.arange(len(start), dtype=np.uint64)))
    side = min(max(len(mixed) // 4, SIDE_BY_SIDE[0]), SIDE_BY_SIDE[1])
    # A piece that is over gives its lane to the next one, so that windows stay wide to the last pieces.
    lanes, following = mixed[:side], side
    begun, state = np.zeros(len(lanes), dtype=np.int64), np.zeros((len(lanes), HIDDEN), dtype=np.float32)
    while len(lanes):
        left = length[lanes] - begun
        steps = np.arange(min(WINDOW, int(left.max())))[:, None]
        live = steps < left
        at = np.where(live, start[lanes] + begun + steps, 0)
        before = np.where(begun + steps > 0, place[np.maximum(at - 1, 0)], opening[lanes])
        state = net.learn(np.where(live, before, net.begin), place[at], group[at], live, state, rate)
        begun += WINDOW
        free = np.flatnonzero(left <= WINDOW)
        new = mixed[following: following + len(free)]
        following += len(new)
        taken, free = free[: len(new)], free[len(new):]
        lanes = np.delete(_with(lanes, taken, new), free)
        begun, state = np.delete(_with(begun, taken, 0), free), np.delete(_with(state, taken, 0), free, axis=0)


def _with(values: np.ndarray, at: np.ndarray, new: np.ndarray | int) -> np.ndarray:
    values = values.copy()
    values[at] = new
    return values


def score_batch(net: Network, offsets: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Log10 probability of each document but for the shares of words in classes that are not modelled."""
    return score_places(net, offsets, net.v.encode(hashed)[0])


def score_places(net: Network, offsets: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The same from the words' input rows, documents of like length side by side."""
    starts, lengths = offsets[:-1].astype(np.int64), np.diff(offsets).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")[: int((lengths > 0).sum())]
    result = np.zeros(len(lengths))
    for i in range(0, len(order), SCORED_TOGETHER):
        chosen = order[i: i + SCORED_TOGETHER]
        result[chosen] = _score_together(net, starts[chosen], lengths[chosen], place) / np.log(10)
    return result


def _score_together(net: Network, starts: np.ndarray, lengths: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Natural log probabilities of documents, the longest first."""
    n = len(lengths)
    # All first words, longest document first, then all second words and so on.
    active = n - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), side="right")
    ends = np.cumsum(active)
    owner = np.arange(ends[-1]) - np.repeat(ends - active, active)
    place = place[starts[owner] + np.repeat(np.arange(len(active)), active)].astype(np.int64)
    group = net.v.group_of_place[place]
    found = np.zeros(len(place))
    state = np.zeros((n, HIDDEN), dtype=np.float32)
    inputs = np.full(n, net.begin)
    kept, done = np.empty((ROWS_AT_ONCE + n, HIDDEN), dtype=np.float32), 0
    for now, end in zip(active.tolist(), ends.tolist(), strict=True):
        state, _ = net.step(inputs[:now], state[:now], kept[end - now - done: end - done])
        inputs = place[end - now: end]
        if end - done >= ROWS_AT_ONCE or end == len(place):
            for i in range(done, end, ROWS_AT_ONCE):
                part = slice(i, min(i + ROWS_AT_ONCE, end))
                found[part] = net.log_probability(kept[i - done: part.stop - done], place[part], group[part])[0]
            state, done = state.copy(), end
    return np.bincount(owner, weights=found, minlength=n)


def _average(parts: DataFrame) -> np.ndarray:
    """Mean of the tasks' parameters, block by block, in two steps of at most some hundred rows."""

    def merge(batch):
        import pandas as pd

        weight = batch["weight"].sum()
        values = sum(np.frombuffer(v, dtype=np.float64) * w for v, w in zip(batch["part"], batch["weight"], strict=True)) / weight
        return pd.DataFrame({"block": batch["block"].iloc[:1], "lane": 0, "weight": weight, "part": [values.tobytes()]})

    schema = "block int, lane int, weight double, part binary"
    for keys in (["block", "lane"], ["block"]):
        parts = parts.groupBy(*keys).applyInPandas(merge, schema)
    rows = parts.orderBy("block").select("part").collect()  # one row per block of the parameters
    return np.concatenate([np.frombuffer(r.part, dtype=np.float64) for r in rows]) if rows else np.zeros(0)


def _tokenised(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The same as :func:`_slices` of the texts of a batch."""
    offsets, hashed = tokens(batch.column("text"))
    lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(hashed))
    yield from _slices(pa.RecordBatch.from_arrays([lists], ["tokens"]))


def _placed(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """The same of the input rows that :meth:`LanguageModel._encoded` wrote."""
    places = batch.column("places")
    offsets = np.frombuffer(places.buffers()[1], dtype=np.int32)[places.offset: places.offset + len(places) + 1] // 2
    held = places.buffers()[2]
    values = pa.array(np.frombuffer(held, dtype=np.uint16, count=held.size // 2) if held else np.zeros(0, dtype=np.uint16))
    lists = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)
    yield from _slices(pa.RecordBatch.from_arrays([lists], ["tokens"]))


def _gathered(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, offsets and input rows of the documents of several batches, together about ``at_once`` tokens."""
    kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def together() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, sizes, place = (np.concatenate(part) for part in zip(*kept, strict=True))
        kept.clear()
        return row, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), place

    def taken(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for part, offsets, place in _placed(batch):
            kept.append((batch.column("row")[part].to_numpy(), np.diff(offsets), place.copy()))
            if sum(len(p) for _, _, p in kept) >= at_once:
                yield together()

    yield from one_by_one(batches, taken)
    if kept:
        yield together()
        give_back()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``hash, c`` of the words of a task's texts, summed over at most about ``COUNTED_AT_ONCE`` words."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def summed() -> pa.RecordBatch:
        hashed, counts = (np.concatenate(part) for part in zip(*kept, strict=True))
        order = np.argsort(hashed, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(hashed[order]) != 0]))
        kept[:] = [(hashed[order[starts]], np.add.reduceat(counts[order], starts))]
        return pa.RecordBatch.from_arrays([pa.array(kept[0][0]), pa.array(kept[0][1])], ["hash", "c"])

    def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, hashed in _tokenised(batch):
            kept.append(np.unique(hashed, return_counts=True))
            if sum(len(h) for h, _ in kept) > COUNTED_AT_ONCE:
                rows = summed()
                if rows.num_rows > COUNTED_AT_ONCE // 2:
                    kept.clear()
                    yield rows

    yield from one_by_one(batches, counted)
    if kept:
        yield summed()


class LanguageModel:
    """A model of the documents for which ``held_out`` is false."""

    def __init__(self, documents: DataFrame, held_out: Column):
        short_batches(documents.sparkSession)
        rows = documents.select("doc_id", held_out.alias("held_out"), text_of(documents).alias("text"))
        counted = rows.where(~F.col("held_out")).select("text").mapInArrow(_word_counts, "hash bigint, c bigint")
        self.counts = materialise(counted.groupBy("hash").agg(F.sum("c").alias("c")), "word-counts")
        totals = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        self.n_tokens, self.n_words = totals.n, totals.v
        # At most KNOWN rows of two numbers.
        top = self.counts.orderBy(F.desc("c"), "hash").limit(KNOWN).toArrow()
        self.vocabulary = Vocabulary.of(
            top.column("hash").to_numpy(), top.column("c").to_numpy(), self.n_tokens, self.n_words
        )
        self.network = Network(self.vocabulary)
        self.rows = self._encoded(rows)
        learned = self.rows.where(~F.col("held_out"))
        for turn in range(ROUNDS if self.n_tokens else 0):
            self._learn(learned.where(remainder(F.concat(F.lit("learn"), F.col("doc_id").cast("string")), ROUNDS) == turn), turn)

    def _encoded(self, rows: DataFrame) -> DataFrame:
        """The documents with the input rows of their words, 16 bits each, and what counts say of them."""
        voc = self.vocabulary

        def encoded(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for part, offsets, hashed in _tokenised(batch):
                at, there = voc.look_up(hashed)
                first, n = offsets[:-1].astype(np.int64), np.diff(offsets)  # every text has its end at least
                place = voc.places(at, there)

                def total(values: np.ndarray) -> pa.Array:
                    return pa.array(np.add.reduceat(np.where(there, values[at], 0.0) if len(values) else np.zeros(len(at)), first))  # noqa: B023

                known = np.add.reduceat(there.astype(np.int64), first)
                rest = np.concatenate([[0], np.cumsum(n - known)])
                ends = pa.py_buffer((2 * offsets).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id")[part], batch.column("held_out")[part], pa.array(n.astype(np.int64)),
                    pa.array(known), total(voc.log_count), total(voc.within),
                    pa.ListArray.from_arrays(pa.array(rest, type=pa.int32()), pa.array(hashed[~there])),
                    pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(place.astype(np.uint16).tobytes())]),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "base", "within", "rest", "places"])

        kind = rows.schema["doc_id"].dataType.simpleString()
        schema = (
            f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, base double, within double, "
            "rest array<bigint>, places binary"
        )
        found = rows.mapInArrow(lambda batches: one_by_one(batches, encoded), schema)
        return materialise(found.withColumn("row", F.monotonically_increasing_id()), "encoded")

    def _learn(self, part: DataFrame, turn: int) -> None:
        net, rate = self.network, 0.1 / (1 + turn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            seen = 0
            for _, offsets, place in _gathered(batches, LEARNED_AT_ONCE):
                train_batch(net, offsets, place, rate)
                seen += len(place)
            if seen:
                values = net.flat().astype(np.float64)
                blocks = [values[i: i + BLOCK].tobytes() for i in range(0, len(values), BLOCK)]
                n, lane = len(blocks), TaskContext.get().partitionId() // 256
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(n), type=pa.int32()), pa.array([lane] * n, type=pa.int32()),
                    pa.array([float(seen)] * n), pa.array(blocks, type=pa.binary()),
                ], ["block", "lane", "weight", "part"])

        schema = "block int, lane int, weight double, part binary"
        mean = _average(part.select("row", "places").mapInArrow(run, schema))
        if len(mean):
            self.network.load(mean)

    def scores(self) -> DataFrame:
        """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, scores as log10."""
        net, voc = self.network, self.vocabulary

        def scored_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row, offsets, place in _gathered(batches, SCORED_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(score_places(net, offsets, place))], ["row", "model"])

        scored = materialise(
            self.rows.select("row", "places").mapInArrow(scored_rows, "row bigint, model double"), "scored"
        )
        rare = self.rows.select("row", F.explode("rest").alias("hash")).join(self.counts, "hash", "left")
        added = rare.groupBy("row").agg(
            F.sum(F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)).alias("logs"), F.count("c").alias("counted")
        )
        logs, n_rest = F.coalesce("logs", F.lit(0.0)), F.size("rest")
        base_total = float(np.log10(self.n_tokens + SMOOTHING * (self.n_words + 1)))
        tail_total = float(np.log10(voc.tail_total))
        return self.rows.drop("places").join(scored, "row").join(added, "row", "left").select(
            "doc_id", "held_out", "n_tokens",
            (F.col("n_known") + F.coalesce("counted", F.lit(0))).alias("n_known"),
            F.lit(self.n_tokens).cast("bigint").alias("train_tokens"),
            (F.col("base") + logs - F.col("n_tokens") * base_total).alias("base_score"),
            (F.col("model") + F.col("within") + logs - n_rest * tail_total).alias("score"),
        )
