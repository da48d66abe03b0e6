"""Scores of texts by online logistic context mixing, learned from the whole corpus.

Texts are coded as the bits of a Huffman tree over bytes, word after word. For each bit, predictors of several orders
look up counts under a hash of their context and the place in the tree. The contexts run across words: the last 1, 2,
3 and 5 bytes of the text, and all of the word so far. A gate chosen
by how often the longer contexts were seen selects the weights with which the predictors' logits are added; an
adaptive table over (last byte, mixed logit) refines the sum. Weights and table are learned online, in small batches,
each predicted before it is learned from: first over the training words, by each owner on its own, the results being
averaged; then in each text that is scored, over its tokens as they run, STEP at a time. Every text starts from the
averages and keeps what it learns to itself, so its score doesn't depend on which texts stand beside it.

The first four bytes of a word (its head) are coded behind the last four bytes of the text before the gap, the rest
behind the head, so that no context is cut at a gap (`reach` 2 has two and two, and cuts the longest one there). The corpus' distinct heads and words are counted by owners. What the tables hold of a head's or word's bits is
looked up once in a block, and mixed anew wherever it stands. All training tokens count in the predictors' tables, n
equal ones as the root of n (what is coded by its bits alone is rare, and resembles rare words), every head and word of
training tokens teaches the first mixer, each as if its own token hadn't been counted.

Three more counts, all of them kept by owners and growing with the corpus, are mixed in per token. The word: a word's
bits share the probability with its frequency, and the share of the bits is that of training tokens that stand alone
(Good and Turing). The word before it: (pairs + weight * p) / (pairs with that word before + weight), where the weight
is the one at which the mass left for new pairs is the share of pairs that stand alone. The match: texts are cut where
the hash of two words ends in zero bits, and a segment that training texts hold is predicted as a whole. A training
text is scored as if the token (or segment) at hand hadn't been counted, so that what stands once in the corpus and
what stands twice are told apart. All probabilities are proper: they add up to at most 1 over all token sequences.

The slots of the longer contexts grow with the letters of the vocabulary up to 2 ** SLOT_BITS[1] an order (a table goes
to every worker, so it has to stay bounded); the shorter contexts are few. Nothing that grows with the corpus goes to
the driver or to every executor. Texts are packed into blocks; each block sends its distinct words, heads, pairs and
segments to their owners and gets back their counts. The texts are then coded in the JVM (Coder.java); Mixer.online
says the same in numpy, as what the tests hold it against.
"""

from __future__ import annotations

import copy
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.common import bucketed, durable, give_back, java_function

#: Bytes of text in a block and to an owner, least and most bits of a slot of the longer contexts, those of the
#: shorter ones, words that are coded at once.
BLOCK, OWNED, SLOT_BITS, SHORT_BITS, AT_ONCE = 4 << 20, 8 << 20, (18, 22), (16, 18, 20), 1500
#: Orders of the predictors in bytes; 0: all of the word so far.
ORDERS = (1, 2, 3, 5, 0)
SEEN, RATE = 4, 0.2
#: Tokens of a text that are predicted before they are learned from, texts that are coded side by side, and how many of
#: a text's own bits the adaptive table's cell is worth.
STEP, LANES, OWN = 32, 64, 20
#: A segment ends with one pair of words in so many.
CUT = 16
#: Weights of the words by themselves against pairs, between which the one that fits is found.
WEIGHTS = 2.0 ** np.arange(-4, 21)
#: What stands for a text's end, a word of its own that no text holds, and the byte after every word.
END, GAP = b"\n", 32
#: Bytes that are hashed at once.
PIECE = 1 << 18
#: Slices that tables are added up in, and how many partial tables are added at a time.
SLICES, FAN = 16, 32


class Tree:
    """The bits of each byte: places in the tree (places) and turns (bits), with their number (depth)."""

    def __init__(self, frequency: np.ndarray):
        heap = [(int(f) + 1, i, i) for i, f in enumerate(frequency)]
        heapq.heapify(heap)
        inner: dict[int, tuple[int, int]] = {}
        while len(heap) > 1:
            a, _, x = heapq.heappop(heap)
            b, _, y = heapq.heappop(heap)
            n = 256 + len(inner)
            inner[n] = (x, y)
            heapq.heappush(heap, (a + b, n, n))
        self.depth = np.zeros(256, np.int64)
        own: list[list[tuple[int, int]]] = [[] for _ in range(256)]
        todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][2], [])]
        while todo:
            n, way = todo.pop()
            if n < 256:
                own[n], self.depth[n] = way, len(way)
            else:
                todo += [(child, [*way, (n - 255, turn)]) for turn, child in enumerate(inner[n])]
        width = int(self.depth.max())
        self.places, self.bits = np.zeros((256, width), np.uint32), np.zeros((256, width), np.uint8)
        for i, way in enumerate(own):
            for j, (place, turn) in enumerate(way):
                self.places[i, j], self.bits[i, j] = place, turn


#: Where in a text its word begins, and how many of its first bytes are context only: of heads and of the rests behind
#: them, by the kind of number that heads are (see Block).
ORIGINS = {np.dtype(np.uint32): ((3, 3), (1, 3)), np.dtype(np.uint64): ((5, 5), (1, 5))}


def contexts(texts: list[bytes], origin: int | tuple[int, int]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Of every byte of the texts but their first ones: the byte, its text's number, its context per order, the byte before.

    origin: where in a text its word begins, and how many bytes are its first ones (three, if not given).
    """
    origin, known = origin if isinstance(origin, tuple) else (origin, 3)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    start = np.cumsum(size) - size
    coded = np.maximum(0, size - known)
    number = np.repeat(np.arange(len(texts)), coded)
    first = start[number]
    at = np.arange(len(number)) + (start + known - np.cumsum(coded) + coded)[number]
    place = at - first
    back = [text[at - k] for k in range(1, 4)]
    for k in (4, 5):
        back.append(np.where(place >= k, text[np.maximum(at - k, 0)], np.uint32(0)))
    with np.errstate(over="ignore"):
        three = back[0] | back[1] << 8 | back[2] << 16
        five = (three * np.uint32(0x9E3779B1) ^ (back[3] | back[4] << 8)) * np.uint32(0x85EBCA6B) + np.uint32(0x632BE5AB)
        h = spelled(text, first + origin, at)
        whole = (h >> np.uint64(32)).astype(np.uint32)
    return text[at].astype(np.uint8), number, [back[0], back[0] | back[1] << 8, three, five, whole], back[0].astype(np.uint8)


_powers = np.ones((2, 0), np.uint64)


def powers(n: int) -> np.ndarray:
    """The first n powers (and some more) of an odd base and of its inverse."""
    global _powers
    if _powers.shape[1] < n:
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.stack([np.full(n + n // 4, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]), axis=1)
    return _powers


def spelled(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of text[start:stop]: a polynomial in an odd base over the whole array, made relative to where each starts."""
    power, back = powers(len(text) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum((text + np.uint32(1)) * power[: len(text)], out=total[1:])
        h = (total[stop] - total[start]) * back[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slots(texts: list[bytes], origin: int | tuple[int, int], tree: Tree, widths: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of every bit: its slot per order, its value, the byte before its byte, and its text's number."""
    symbol, number, context, last = contexts(texts, origin)
    depth = tree.depth[symbol]
    at = np.repeat(np.arange(len(symbol)), depth)
    inner = np.arange(len(at)) - (np.cumsum(depth) - depth)[at]
    inner += symbol[at].astype(np.int64) * tree.places.shape[1]
    out = []
    with np.errstate(over="ignore"):
        node = (tree.places * np.uint32(0xC2B2AE35)).ravel()[inner]
        for k, (h, bits) in enumerate(zip(context, widths)):
            s = (h * np.uint32(0x9E3779B1) + np.uint32(k)).take(at, mode="clip")
            s ^= node
            s ^= s >> np.uint32(15)
            s *= np.uint32(0x27D4EB2F)
            s ^= s >> np.uint32(13)
            s *= np.uint32(0x165667B1)
            s >>= np.uint32(32 - bits)
            out.append(s.astype(np.int64))
    return out, tree.bits.ravel().take(inner, mode="clip"), last.take(at, mode="clip"), number.take(at, mode="clip")


def add_counts(tables: list[np.ndarray], texts: list[bytes], origin: int | tuple[int, int], times: np.ndarray, tree: Tree, widths: tuple[int, ...]) -> None:
    """tables[order][2 * slot + bit] gets the root of a text's number of tokens for each of its bits."""
    slot, bits, _, number = slots(texts, origin, tree, widths)
    n = np.sqrt(times).astype(tables[0].dtype)[number]
    for k, s in enumerate(slot):
        np.add.at(tables[k], 2 * s + bits, n)


def rounded(n: np.ndarray) -> np.ndarray:
    """Counts in six bits: exact up to 15, then in steps of a quarter of a doubling."""
    return np.where(n < 16, np.rint(n), np.minimum(63, 16 + (4 * np.log2(np.maximum(n, 16) / 16)).astype(np.int64))).astype(np.uint8)


#: What rounded() stands for. By a slot's two rounded counts, as they are, with a zero taken off, and with a one taken
#: off: its logit, and how often it was seen.
COUNT = np.where(np.arange(64) < 16, np.arange(64), 16 * 2.0 ** ((np.arange(64) - 15.5) / 4))
STATES = 64 * 64
_ZEROS, _ONES = (np.maximum(0, np.concatenate([COUNT[x] - off for off in offs])) for x, offs in ((np.arange(STATES) & 63, (0, 1, 0)), (np.arange(STATES) >> 6, (0, 0, 1))))
LOGIT = np.log((_ONES + 0.1) / (_ZEROS + 0.1)).astype(np.float32)
OFTEN = sum((_ZEROS + _ONES >= x).astype(np.uint8) for x in (1, 4, 32))


class Mixer:
    """states[order][slot]: a slot's rounded counts, 64 * ones + zeros."""

    def __init__(self, tree: Tree, states: list[np.ndarray], widths: tuple[int, ...]):
        self.tree, self.states, self.widths = tree, states, widths
        self.weights = np.full((SEEN**3, len(ORDERS) + 1), 0.3, np.float64)
        self.seen = np.zeros((256, 33, 2))
        self.refine()

    def refine(self) -> None:
        """The adaptive table: what came after (last byte, mixed logit), from where the logit itself says."""
        start = 1 / (1 + np.exp(8 - np.arange(33) / 2))
        self.refined = (self.seen[:, :, 1] + 20 * start) / (self.seen.sum(axis=2) + 20)

    def found(self, texts: list[bytes], origin: int | tuple[int, int], without: np.ndarray):
        """What the predictors know of every bit: its state per order, gates, bits, last bytes and texts; without: texts to be seen as if one token less were counted."""
        slot, bits, last, number = slots(texts, origin, self.tree, self.widths)
        states = np.empty((len(ORDERS), len(bits)), np.int16)
        gate = np.zeros(len(bits), np.uint8)
        less = (bits.astype(np.int16) + np.int16(1)) * np.int16(STATES)
        less *= without.take(number, mode="clip")
        for k, s in enumerate(slot):
            self.states[k].take(s, mode="clip", out=states[k])
            states[k] += less
            if k >= 2:
                gate *= SEEN
                gate += OFTEN.take(states[k], mode="clip")
        return states, gate, bits, last, number

    def inputs(self, texts: list[bytes], origin: int | tuple[int, int], without: np.ndarray):
        """Logits of the predictors (and a one), gates, bits, last bytes and texts, as found."""
        states, gate, bits, last, number = self.found(texts, origin, without)
        x = np.ones((len(ORDERS) + 1, len(bits)), np.float32)
        for k, s in enumerate(states):
            np.take(LOGIT, s, out=x[k], mode="clip")
        return x, gate, bits, last, number

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("kn,nk->n", x, self.weights.astype(np.float32)[gate]), -15, 15)

    def learn(self, texts: list[bytes], origin: int | tuple[int, int]) -> int:
        """Online: texts in their order, some at a time, each first predicted, then learned from; the number of bits."""
        x, gate, bits, last, _ = self.inputs(texts, origin, np.ones(len(texts), bool))
        for a in range(0, len(bits), 1 << 14):
            part = slice(a, a + (1 << 14))
            z = self.mixed(x[:, part], gate[part])
            off = bits[part] - 1 / (1 + np.exp(-z))
            n = np.bincount(gate[part], minlength=len(self.weights))
            for j in range(len(x)):
                self.weights[:, j] += RATE * np.bincount(gate[part], off * x[j, part], len(self.weights)) / np.maximum(n, 50)
            cell = (last[part].astype(np.int64) * 33 + np.rint(np.clip(z, -8, 8) * 2 + 16).astype(np.int64)) * 2 + bits[part]
            self.seen += np.bincount(cell, minlength=self.seen.size).reshape(self.seen.shape)
        return len(bits)

    def log10(self, texts: list[bytes], origin: int | tuple[int, int], without: np.ndarray) -> np.ndarray:
        """log10 of the probability of each text's bytes, given its first three, by the weights and the table as they are."""
        out = [np.zeros(0)]
        for i in range(0, len(texts), AT_ONCE):
            part = texts[i : i + AT_ONCE]
            x, gate, bits, last, number = self.inputs(part, origin, without[i : i + AT_ONCE])
            z = self.mixed(x, gate)
            cell = np.rint(np.clip(z, -8, 8) * 2 + 16).astype(np.int64) + last.astype(np.int64) * 33
            p = np.clip((1 / (1 + np.exp(-z)) + self.refined.astype(np.float32).ravel()[cell]) / 2, 1e-6, 1 - 1e-6)
            out.append(np.bincount(number, np.log10(np.where(bits == 1, p, 1 - p)), len(part)))
        return np.concatenate(out)

    def online(self, kinds: list[tuple[list[bytes], int | tuple[int, int], np.ndarray]], tokens: list[np.ndarray], size: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token's bits, coded in running texts from which weights and table go on learning.

        kinds: distinct texts to code, their origin, and which of them to see without one token, as in log10; tokens:
        which of each kind a token is made of, one after the other; size: tokens of each text, which stand in a row.
        Every text starts from the weights and the table as they are and has its own from there on. STEP tokens are
        predicted, then learned from, until the text ends, so a text's result is up to that text alone.
        """
        parts, width = [], []
        for texts, origin, without in kinds:
            for i in range(0, len(texts), AT_ONCE):
                states, gate, bits, last, text = self.found(texts[i : i + AT_ONCE], origin, without[i : i + AT_ONCE])
                parts.append(np.empty((len(bits), 8), np.uint16))  # 16 bytes a bit, so that it is read as one number
                parts[-1][:, : len(ORDERS)] = states.T
                parts[-1][:, -1] = last.astype(np.uint16) << 8 | gate << 1 | bits
                width.append(np.bincount(text, minlength=len(texts[i : i + AT_ONCE])))
        known, width = np.concatenate(parts).view(np.complex128).ravel(), np.concatenate(width)
        del parts
        first = np.cumsum(width) - width
        number = np.stack([t + n for t, n in zip(tokens, np.cumsum([0] + [len(t) for t, _, _ in kinds]))], axis=1)
        out = np.empty(len(number))
        start = np.cumsum(size) - size
        refined = self.refined.astype(np.float32).ravel()
        shared = np.ascontiguousarray(self.weights.T, np.float32)
        cells = len(refined)
        ones = np.ones(1 << 18, np.float32)

        def some(token: np.ndarray, lane: np.ndarray, weights: np.ndarray, seen: np.ndarray | None, learn: bool) -> None:
            """Codes tokens by their lanes' weights (by order, lane and gate) and counts (by lane and cell of the table), then lets them learn."""
            kind = number[token]
            n = width[kind].ravel()
            stop = np.cumsum(n)
            at = np.repeat(first[kind].ravel() - stop + n, n)
            at += np.arange(len(at))
            token_bits = stop[len(kinds) - 1 :: len(kinds)]
            of = np.repeat(lane, np.diff(token_bits, prepend=0))
            row = known.take(at, mode="clip").view(np.uint16).reshape(-1, 8)
            rest = row[:, -1].astype(np.int64)
            gate = of * len(self.weights)
            gate += rest >> 1 & 127
            x = [LOGIT.take(row[:, k], mode="clip") for k in range(len(ORDERS))]
            z = weights[-1].take(gate, mode="clip")
            for a, w in zip(x, weights):
                z += a * w.take(gate, mode="clip")
            np.clip(z, -15, 15, out=z)
            bit = (rest & 1).astype(bool)
            plain = 1 / (1 + np.exp(-z))
            cell = np.rint(np.clip(z, -8, 8) * 2 + 16).astype(np.int64)
            cell += (rest >> 8) * 33
            p = refined.take(cell, mode="clip")
            if seen is not None:
                cell += of * cells
                own = seen.view(np.complex64).take(cell, mode="clip")  # zeros and ones
                p = (p * OWN + own.imag) / (own.real + own.imag + OWN)
            p = np.clip((plain + p) / 2, 1e-6, 1 - 1e-6)
            out[token] = np.add.reduceat(np.log(np.abs(p - ~bit)), np.concatenate([[0], token_bits[:-1]])) / np.log(10)
            if learn:
                by = RATE / np.maximum(np.bincount(gate, minlength=weights.shape[1]), 50)
                off = (bit - plain) * by.astype(np.float32).take(gate, mode="clip")
                for a in x:
                    a *= off
                for a, w in zip([*x, off], weights):
                    np.add.at(w, gate, a)
                cell *= 2
                cell += bit
                np.add.at(seen, cell, ones[: len(cell)] if len(cell) <= len(ones) else np.ones(len(cell), np.float32))

        def ranges(a: np.ndarray, n: np.ndarray) -> np.ndarray:
            stop = np.cumsum(n)
            return np.repeat(a - stop + n, n) + np.arange(stop[-1])

        order = np.argsort(-size, kind="stable")
        longer = int((size > STEP).sum())
        short = order[longer:]
        for i in range(0, len(short), LANES):  # predicted at once, so there is nothing to learn from
            token = ranges(start[short[i : i + LANES]], size[short[i : i + LANES]])
            some(token, np.zeros(len(token), np.int64), shared, None, False)
        for i in range(0, longer, LANES):
            lanes = order[i : min(i + LANES, longer)]
            weights = np.tile(shared, (1, len(lanes)))
            seen = np.zeros(len(lanes) * cells * 2, np.float32)
            for done in range(0, int(size[lanes[0]]), STEP):
                lanes = lanes[size[lanes] > done]
                n = np.minimum(size[lanes] - done, STEP)
                some(ranges(start[lanes] + done, n), np.repeat(np.arange(len(lanes)), n), weights[:, : len(lanes) * len(self.weights)], seen, size[lanes[0]] > done + STEP)
        return out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, each key's place among them, and where each is first."""
    n = len(keys)
    if not n:
        return keys, np.zeros(0, np.int32), np.zeros(0, np.int64)
    wide = np.uint64(max(1, int(n - 1).bit_length()))
    least = keys.min()
    shift = np.uint64(64 - max(1, int(keys.max() - least).bit_length()))
    # Key and place are sorted as one number, the lowest bits of the key making way where there is no room for both.
    packed = ((keys - least).astype(np.uint64) << shift >> wide << wide) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << int(wide)) - 1)).astype(np.int64)
    if shift < wide:
        top = packed >> wide
        wrong = np.flatnonzero(keys[order][1:] < keys[order][:-1])
        if len(wrong) > 100:  # keys that have their differences in the low bits: scattered, then put in order
            own, place, first = distinct(scattered(keys))
            by = np.argsort(keys[first])
            rank = np.empty(len(own), np.int32)
            rank[by] = np.arange(len(own), dtype=np.int32)
            return keys[first[by]], rank[place], first[by]
        for x in np.unique(top[wrong]):  # a few keys that differ in those bits only
            i, j = np.searchsorted(top, [x, x + np.uint64(1)])
            order[i:j] = order[i:j][np.argsort(keys[order[i:j]], kind="stable")]
    own = keys[order]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(own[1:], own[:-1], out=new[1:])
    place = np.empty(n, np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return own[new], place, order[new]


def end_hash() -> np.ndarray:
    """What stands before the first token."""
    return spelled(np.frombuffer(END, np.uint8), np.array([0]), np.array([1]))


def segments(hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where segments end (exclusive) and their hashes (even numbers); hashes: of the tokens of texts in a row, last: places of texts' ends.

    A text's last segment ends with it, and its hash holds the text's end, too. A text without words is one segment.
    """
    with np.errstate(over="ignore"):
        pair = hashes + np.concatenate([end_hash(), hashes[:-1]]) * np.uint64(3)
        ends = ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(CUT) == 0
        ends[last] = True
        before = last[last > 0] - 1
        ends[before] = np.isin(before, last)  # the end joins what stands before it
        cut = np.flatnonzero(ends) + 1
        power, back = powers(len(hashes) + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((hashes ^ (hashes >> np.uint64(31))) * power[: len(hashes)])])
        first = np.concatenate([[0], cut[:-1]]).astype(np.int64)
        out = (total[cut] - total[first]) * back[first]
    return cut, (out ^ (out >> np.uint64(32))) & ~np.uint64(1)


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Hash (an odd number) of each token with the one before it; before the first stands a text's end."""
    with np.errstate(over="ignore"):
        before = np.concatenate([end_hash(), hashes[:-1]])
        out = (before * np.uint64(0x9E3779B97F4A7C15) ^ (before >> np.uint64(29))) + hashes * np.uint64(0xBF58476D1CE4E5B9)
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return (out ^ (out >> np.uint64(32))) | np.uint64(1)


def word_hashes(text: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Hashes of the words between gaps, taken some PIECE bytes at a time."""
    out, i = [], 0
    while i < len(gaps) - 1:
        j = max(i + 1, int(np.searchsorted(gaps, gaps[i] + PIECE)) - 1)
        at = gaps[i]
        out.append(spelled(text[at : gaps[j]], gaps[i:j] + 1 - at, gaps[i + 1 : j + 1] - at))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def owner_of(keys: np.ndarray, owners: int, width: int = 64) -> np.ndarray:
    """By the high bits (of so many in all), so that the keys of an owner stand together once sorted."""
    return ((keys >> np.uint64(width - 32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def squeezed(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: those of small numbers vanish, those of random ones are left as they are."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def expanded(x: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(x), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def steps(keys: np.ndarray) -> np.ndarray:
    """Keys in order as the distance of each from the one before."""
    return np.diff(keys, prepend=np.uint64(0))


class Block:
    """The tokens of a block's texts, their distinct words, heads, pairs and segments, all ordered by owner.

    heads: the kind of number that a head is. Of 32 bits: the first two bytes of a word (or the word and the gap behind
    it) after the last two before the gap. Of 64 bits: the first four (nothing stands behind the gap) after the last
    four, which run across words as far back as the text's begin, so that no context ends at a gap.
    """

    def __init__(self, packed: bytes, learned: bytes, owners: int, width: int, heads: type = np.uint32):
        data = b" " + zstandard.decompress(packed) + b" "
        text = np.frombuffer(data, np.uint8)
        gaps = np.flatnonzero(text == GAP)
        start, stop = gaps[:-1] + 1, gaps[1:]
        words, place, first = distinct(word_hashes(text, gaps))  # by hash, so words of an owner stand together
        self.word_hash, self.at = words, place
        self.words = [data[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
        self.last = np.flatnonzero((text[start] == END[0]) & (stop - start == 1))
        size = np.diff(self.last, prepend=-1)
        self.text = np.repeat(np.arange(len(size)), size)
        flags = np.frombuffer(learned, bool)
        self.learned = flags[self.text]
        self.word_times = np.bincount(place, self.learned, len(words)).astype(np.int32)
        h = words[place]
        self.cut, seg = segments(h, self.last)
        self.seg_text = self.text[self.cut - 1]
        keys = np.concatenate([seg, pairs(h)])
        self.keys, place, first = distinct(keys >> np.uint64(65 - width) << np.uint64(1) | keys & np.uint64(1))
        self.seg, self.pair = place[: len(seg)], place[len(seg) :]
        self.key_times = np.bincount(place, np.concatenate([flags[self.seg_text], self.learned]), len(self.keys)).astype(np.int32)
        # What stands before the first text, and behind the last.
        near = np.concatenate([np.array([0, 0, GAP, END[0]], np.uint8), text, np.array([GAP] * 4, np.uint8)])
        reach = np.dtype(heads).itemsize // 2
        begins = np.zeros(len(start), bool)
        begins[np.concatenate([[0], self.last[:-1] + 1])] = True
        head = np.zeros(len(start), np.uint64)
        for k in range(reach, 0, -1):
            head = head << np.uint64(8) | (near[gaps[:-1] + 4 - k] if k <= 2 else np.where(begins, np.uint8(0), near[gaps[:-1] + 4 - k]))
        for k in range(reach):
            head = head << np.uint64(8) | (near[start + 4 + k] if k < 2 else np.where(start + k <= stop, near[start + 4 + k], np.uint8(0)))
        own, place, _ = distinct(head)
        times = np.bincount(place, self.learned, len(own)).astype(np.int32)
        order = np.argsort(owner_of(scattered(own), owners), kind="stable")
        self.heads, self.head_times = own[order].astype(heads), times[order]
        rank = np.empty(len(own), np.int32)
        rank[order] = np.arange(len(own), dtype=np.int32)
        self.head = rank[place]
        bounds = np.arange(owners + 1)
        self.cuts = [np.searchsorted(owner_of(x, owners, n), bounds) for x, n in ((words, 64), (scattered(self.heads.astype(np.uint64)), 64), (self.keys, width))]

    def messages(self) -> list[tuple]:
        """For each owner that is asked: its number, words, heads and keys, each with their training tokens in this block."""
        out = []
        for o in np.flatnonzero(np.any([np.diff(c) > 0 for c in self.cuts], axis=0)).tolist():
            w, e, k = (slice(c[o], c[o + 1]) for c in self.cuts)
            numbers = (self.word_times[w], self.heads[e], self.head_times[e], steps(self.keys[k]), self.key_times[k])
            out.append((o, zstandard.compress(b" ".join(self.words[w]), 1), *map(squeezed, numbers)))
        return out


def scattered(heads: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return heads * np.uint64(0x9E3779B97F4A7C15)


def head_texts(heads: np.ndarray) -> list[bytes]:
    """What a head is coded as: two bytes of the word before (or four of the text), a gap, and the bytes that are coded."""
    if heads.dtype == np.uint64:
        out = np.full((len(heads), 9), GAP, np.uint8)
        own = heads.astype(">u8").view(np.uint8).reshape(-1, 8)
        out[:, :4], out[:, 5:] = own[:, :4], own[:, 4:]
        ends = np.argmax(own[:, 4:] == GAP, axis=1)
        data = out.tobytes()
        return [data[9 * i : 9 * i + n] for i, n in enumerate(np.where(ends, 6 + ends, 9).tolist())]
    out = np.empty((len(heads), 5), np.uint8)
    for k, at in enumerate((0, 1, 3, 4)):
        out[:, at] = heads >> np.uint32(24 - 8 * k) & np.uint32(255)
    out[:, 2] = GAP
    return [x.tobytes() for x in out]


def rest_texts(words: list[bytes]) -> list[bytes]:
    """What words are coded as behind their heads: a gap and two bytes, then the rest and the gap behind it."""
    return [b" %b " % w for w in words]


def pack(docs: DataFrame, id_type: pa.DataType) -> DataFrame:
    """Rows of blocks: number, the tokens of its texts with their ends (compressed), which texts are training ones, ids, bytes."""
    names, kinds = ["block", "words", "learned", "ids", "bytes"], [pa.int64(), pa.binary(), pa.binary(), pa.list_(id_type), pa.int64()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, flags, texts = [], [], []
        size, small = 0, zstandard.ZstdCompressor(level=1)

        def flush() -> pa.RecordBatch:
            row = (task * 1_000_000_000 + number, small.compress(b" ".join(texts)), bytes(flags), ids, size)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for b in batches:
            for i, train, t in zip(*b.columns):
                words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                words.append(END)
                texts.append(b" ".join(words))
                ids.append(i.as_py())
                flags.append(train.as_py())
                size += len(texts[-1]) + 1
                if size >= BLOCK:
                    yield flush()
                    number, ids, flags, texts, size = number + 1, [], [], [], 0
        if texts:
            yield flush()

    return docs.mapInArrow(work, f"block long, words binary, learned binary, ids array<{'bigint' if id_type == pa.int64() else 'string'}>, bytes long")


MESSAGE = {"words": "binary", "times": "binary", "heads": "binary", "head_times": "binary", "keys": "binary", "key_times": "binary"}


def split(blocks: DataFrame, owners: int, width: int, heads: type = np.uint32) -> DataFrame:
    """Rows of an owner and a block: what the block asks of that owner, with its own training counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, packed, learned in zip(*b.columns):
                rows = [(m[0], block.as_py(), *m[1:]) for m in Block(packed.as_py(), learned.as_py(), owners, width, heads).messages()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [pa.int64(), pa.int64(), *[pa.binary()] * 6])], ["owner", "block", *MESSAGE])
                del rows
                give_back()

    return blocks.select("block", "words", "learned").mapInArrow(work, "owner long, block long, " + ", ".join(f"{k} {t}" for k, t in MESSAGE.items()))


def summed(parts: DataFrame, tasks: int, kind: type, finish: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """Adds up the arrays of rows (slice, part, counts) of one slice, FAN at a time; counts are numbers of this kind, compressed, in the end what finish makes of them."""

    def adding(last: bool):
        def add(table: pa.Table) -> pa.Table:
            total = np.zeros(0, kind)
            for x in table.column("counts"):
                own = np.frombuffer(zstandard.decompress(x.as_py()), kind)
                total = total + own if len(total) else own
            total = finish(total) if last else total
            return pa.table({"slice": table.column("slice")[:1], "part": table.column("part")[:1], "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

        return add

    while True:
        tasks = -(-tasks // FAN)
        parts = parts.withColumn("part", F.expr(f"cast(part div {FAN} as int)")).groupBy("slice", "part").applyInArrow(adding(tasks <= 1), "slice int, part int, counts binary")
        if tasks <= 1:
            return parts


class Model:
    """What scoring needs of the corpus: totals, the mixer, and the weights of words against pairs and segments."""

    def __init__(self, sums: dict, left: np.ndarray, mixer: Mixer):
        self.mixer, self.total, self.v = mixer, sums["n"], sums["v"]
        self.weight = float(2.0 ** np.interp(sums["pairs_once"], left, np.log2(WEIGHTS)))
        self.segs = sums["segs"]
        self.anew = min(1.0, max(1e-4, sums["segs_once"] / self.segs)) if self.segs else 1.0
        self.spell = min(0.5, max(1e-4, sums["once"] / self.total)) if self.total else 1.0

    def parts(self, block: Block, times: np.ndarray, head_times: np.ndarray, key_times: np.ndarray) -> tuple[bytes, bytes, bytes]:
        """Marks, numbers and segments of a block's tokens, as Coder.java mixes them with their bits; times are those of its words, head_times of its heads, key_times of its keys.

        Marks: 1, 2: head and rest are seen as if one token less were counted; 4: a segment ends; 8: a text ends.
        Numbers: the word's probability by its frequency; its pairs with the word before; the times of the word before.
        Segments: each one's probability as a whole.
        """
        marks = (head_times == 1)[block.head].astype(np.uint8)
        marks |= (times == 1)[block.at].astype(np.uint8) << 1
        marks[block.cut - 1] |= 4
        marks[block.last] |= 8
        own = block.learned.astype(np.int64)
        known = times[block.at]
        before = np.concatenate([known[block.last[:1]], known[:-1]])  # a text begins behind an end
        word = (1 - self.spell) * (known - own) / np.maximum(1, self.total - own)
        numbers = np.concatenate([word, key_times[block.pair] - own, before - own]).astype("<f4")
        own = own[block.cut - 1]
        whole = (1 - self.anew) * (key_times[block.seg] - own) / np.maximum(1, self.segs - own)
        return marks.tobytes(), numbers.tobytes(), whole.astype("<f4").tobytes()

    def packed(self, reach: int) -> bytes:
        """All that Coder.java needs, in the order in which it reads it."""
        m = self.mixer
        deep = m.tree.places.shape[1]
        head = np.array([reach, STEP, SEEN, len(m.weights), deep, *m.widths], "<i4"), np.array([RATE, OWN, self.spell, self.anew, self.weight], "<f8")
        tables = m.weights.astype("<f4"), m.refined.astype("<f4"), LOGIT.astype("<f4"), OFTEN, m.tree.depth.astype(np.uint8), m.tree.bits, m.tree.places.astype("<u4")
        states = (np.stack([s & 63, s >> 6], axis=1).astype(np.uint8) for s in m.states)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (*head, *tables, *states))


#: What owners' sums are of, followed by the mass left for new pairs at each weight and the letters' frequencies.
SUMS = ("n", "v", "once", "segs", "segs_once", "pairs_once")
OWNED_ROW = "owner long, block long, words binary, times binary, heads binary, head_times binary, places binary, head_places binary, key_times binary, sums array<double>"


def vocabulary(table: pa.Table, head_kind: type = np.uint32) -> pa.Table:
    """An owner's words and heads with their counts and sums (block null), and for each block the places and counts that it asks for."""
    read = lambda name, kind: [expanded(x.as_py(), kind) for x in table.column(name)]
    number: dict[bytes, int] = {}
    places = []
    for words, n in zip(table.column("words"), read("times", np.int32)):
        words = zstandard.decompress(words.as_py())
        places.append(np.fromiter((number.setdefault(w, len(number)) for w in words.split(b" ")), np.int32, len(n)) if words else np.zeros(0, np.int32))
    times = np.bincount(np.concatenate(places), np.concatenate(read("times", np.int32)), len(number)).astype(np.int64)

    def added(name: str, kind: type) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        parts = [np.cumsum(x) for x in read(name, kind)] if name == "keys" else read(name, kind)
        every, place, _ = distinct(np.concatenate(parts))
        total = np.bincount(place, np.concatenate(read(f"{name[:-1]}_times", np.int32)), len(every)).astype(np.int64)
        return every, total, np.split(place, np.cumsum([len(x) for x in parts])[:-1])

    heads, head_times, head_places = added("heads", head_kind)
    keys, key_times, key_places = added("keys", np.uint64)
    pair = (keys & np.uint64(1)) == 1
    known = [w for w, x in zip(number, times.tolist()) if x]
    letters = np.bincount(np.frombuffer(b" ".join(known) + b" ", np.uint8), minlength=256) if known else np.zeros(256, np.int64)
    often = times[times > 0].astype(np.float64)
    segs = key_times[~pair]
    sums = np.concatenate([[times.sum(), len(known), (times == 1).sum(), segs.sum(), (segs == 1).sum(), (key_times[pair] == 1).sum()], [(often * x / (often + x)).sum() for x in WEIGHTS], letters]).astype(np.float64)
    n = len(table)
    one = {"words": b" ".join(number), "times": times.tobytes(), "heads": heads.tobytes(), "head_times": head_times.tobytes()}
    many = {"places": places, "head_places": head_places, "key_times": [key_times[a].astype(np.int32) for a in key_places]}
    return pa.table(
        {"owner": pa.array([table.column("owner")[0].as_py()] * (n + 1), pa.int64()), "block": pa.array([None, *table.column("block").to_pylist()], pa.int64())}
        | {c: pa.array([x, *[None] * n], pa.binary()) for c, x in one.items()}
        | {c: pa.array([None, *map(squeezed, x)], pa.binary()) for c, x in many.items()}
        | {"sums": pa.array([sums, *[None] * n], pa.list_(pa.float64()))}
    )


def texts_of(row: dict, head_kind: type = np.uint32) -> list[tuple[list[bytes], int | tuple[int, int], np.ndarray]]:
    """What is coded of an owner's words and heads: texts, where the word begins in them, training tokens."""
    words = row["words"].split(b" ") if row["words"] else []
    heads = np.frombuffer(row["heads"], head_kind)
    head, rest = ORIGINS[heads.dtype]
    return [(rest_texts(words), rest, np.frombuffer(row["times"], np.int64)), (head_texts(heads), head, np.frombuffer(row["head_times"], np.int64))]


def score(docs: DataFrame, train, id_column: str = "doc_id", text_column: str = "text", reach: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row.

    train is a condition on docs' columns; null counts as false. A null or blank text has one token, its end. Without
    training rows every token is new: base_score is that of an empty vocabulary (log10 of 0.5 / 0.5, so 0) and score
    the untrained coding. Ids may be null, repeated, and of any type that a string stands for. Repeated rows are counted
    and returned as often as they stand; other columns, whatever their names, are left out; an empty table gives an
    empty one. A text of any length is one part of one block.

    reach: bytes before a gap that contexts see, 2 or 4; with 4, the longest context is of five bytes everywhere.
    """
    head_kind = {2: np.uint32, 4: np.uint64}[reach]
    spark = docs.sparkSession
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.string()
    rows = docs.select(F.col(id_column).cast("bigint" if kind == "bigint" else "string").alias("_id"), F.coalesce(train, F.lit(False)).alias("_train"), F.col(text_column).alias("_text"))
    blocks = bucketed(pack(rows, id_type), "block")
    size = blocks.agg(F.sum("bytes")).first()[0] or 0
    owners = max(8, -(-size // OWNED))
    width = min(64, max(48, size.bit_length() + 22))  # of so many keys, hardly one in 2 ** 24 shares its hash with another
    every = durable(split(blocks, owners, width, head_kind).groupBy("owner").applyInArrow(lambda table: vocabulary(table, head_kind), OWNED_ROW))
    owned = every.where("block is null").drop("places", "key_times")
    got = np.zeros(len(SUMS) + len(WEIGHTS) + 256)
    for r in owned.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        got[r["pos"]] = r["n"]
    sums, left, letters = np.split(got, [len(SUMS), len(SUMS) + len(WEIGHTS)])
    tree = Tree(letters)
    longer = int(np.clip(int(letters.sum()).bit_length() + 1, *SLOT_BITS))
    widths = (*SHORT_BITS, longer, longer)
    tasks = max(spark.sparkContext.defaultParallelism, owners // SLICES)
    coded = owned.select("words", "times", "heads", "head_times").coalesce(tasks)

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], int | tuple[int, int], np.ndarray]]:
        """The texts with training tokens, some at a time."""
        for b in batches:
            for row in b.to_pylist():
                for texts, origin, times in texts_of(row, head_kind):
                    some = np.flatnonzero(times)
                    for k in range(0, len(some), AT_ONCE):
                        own = some[k : k + AT_ONCE]
                        yield [texts[i] for i in own.tolist()], origin, times[own]

    def sliced(arrays: list[np.ndarray]) -> pa.RecordBatch:
        cut = [np.array_split(a, SLICES) for a in arrays]
        out = [zstandard.compress(np.concatenate([c[s] for c in cut]).tobytes(), 1) for s in range(SLICES)]
        return pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), pa.array(out, pa.binary())], ["slice", "part", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << w, np.float32) for w in widths]
        some = False
        for texts, origin, times in trained(batches):
            add_counts(tables, texts, origin, times, tree, widths)
            some = True
        if some:
            yield sliced(tables)
        del tables
        give_back()

    counts = summed(coded.mapInArrow(count, "slice int, part int, counts binary"), tasks, np.float32, rounded).select("slice", "counts")
    states = [np.zeros((SLICES, (2 << w) // SLICES), np.uint8) for w in widths]
    for r in counts.collect():  # of a bounded size: two bytes a slot
        for s, own in zip(states, np.split(np.frombuffer(zstandard.decompress(r["counts"]), np.uint8), np.cumsum([(2 << w) // SLICES for w in widths])[:-1])):
            s[r["slice"]] = own
    states = [s.reshape(-1, 2) for s in states]
    mixer = Mixer(tree, [s[:, 0].astype(np.int16) | s[:, 1].astype(np.int16) << 6 for s in states], widths)
    start = spark.sparkContext.broadcast(mixer)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mixer(tree, start.value.states, widths)
        bits = sum(m.learn(texts, origin) for texts, origin, _ in trained(batches))
        if bits:
            row = np.concatenate([[bits], (m.weights * bits).ravel(), m.seen.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([zstandard.compress(row.tobytes(), 1)], pa.binary())], ["slice", "part", "counts"])

    for r in summed(coded.mapInArrow(learn, "slice int, part int, counts binary"), tasks, np.float64).collect():  # one row: the weights and the table
        learned = np.frombuffer(zstandard.decompress(r["counts"]), np.float64)
        mixer.weights = learned[1 : 1 + mixer.weights.size].reshape(mixer.weights.shape) / learned[0]
        mixer.seen = learned[1 + mixer.weights.size :].reshape(mixer.seen.shape)
        mixer.refine()
    model = Model(dict(zip(SUMS, sums.astype(np.int64).tolist())), left, mixer)
    coder = java_function(spark, "Coder.java", model.packed(reach), "array<double>")
    counted = copy.copy(model)
    counted.mixer = None  # that is the JVM's
    shared = spark.sparkContext.broadcast(counted)

    def reply(table: pa.Table) -> pa.Table:
        """For each block its words', heads' and keys' counts."""
        k = table.column("block").to_pylist().index(None)
        rest = [i for i in range(len(table)) if i != k]

        def asked(counts: str, places: str) -> pa.Array:
            n = np.frombuffer(table.column(counts)[k].as_py(), np.int64)
            return pa.array([squeezed(n[expanded(table.column(places)[i].as_py(), np.int32)]) for i in rest], pa.binary())

        return pa.table({
            "block": pa.array([table.column("block")[i].as_py() for i in rest], pa.int64()), "owner": pa.array([table.column("owner")[0].as_py()] * len(rest), pa.int64()),
            "times": asked("times", "places"), "head_times": asked("head_times", "head_places"), "key_times": pa.array([table.column("key_times")[i].as_py() for i in rest], pa.binary()),
        })

    replies = every.select("owner", "block", "times", "head_times", "places", "head_places", "key_times").groupBy("owner").applyInArrow(reply, "block long, owner long, times binary, head_times binary, key_times binary")
    id_kind = "bigint" if kind == "bigint" else "string"
    lists = {"_id": (id_type, id_kind), "held_out": (pa.bool_(), "boolean"), "n_tokens": (pa.int64(), "long"), "n_known": (pa.int64(), "long"), "base_score": (pa.float64(), "double"), "_bytes": (pa.int64(), "long")}
    names, kinds = [*lists, "text", "marks", "numbers", "whole"], [*(pa.list_(k) for k, _ in lists.values()), *[pa.binary()] * 4]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """A block's texts in lists, and what it takes to code them."""
        m = shared.value
        right = right.sort_by("owner")
        times, head_times, key_times = (np.concatenate([np.zeros(0, k), *(expanded(x.as_py(), k) for x in right.column(c))]) for c, k in (("times", np.int64), ("head_times", np.int64), ("key_times", np.int32)))
        parts = []
        for row in left.to_pylist():
            b = Block(row["words"], row["learned"], owners, width, head_kind)
            n = len(b.last)
            base = np.bincount(b.text, (np.log10(times + 0.5) - np.log10(m.total + 0.5 * (m.v + 1)))[b.at], n)
            known = np.bincount(b.text, (times > 0)[b.at], n).astype(np.int64)
            size = np.bincount(b.text, np.fromiter(map(len, b.words), np.int64, len(b.words))[b.at] + 1, n).astype(np.int64)
            columns = [row["ids"], ~np.frombuffer(row["learned"], bool), np.bincount(b.text, minlength=n), known, base, size]
            columns += [b" " + zstandard.decompress(row["words"]) + b" ", *m.parts(b, times, head_times, key_times)]
            parts.append(pa.table([pa.array([c], k) for c, k in zip(columns, kinds)], names=names))
            del b, columns
            give_back()
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], k) for k in kinds], names=names)

    got = blocks.select("block", "words", "learned", "ids").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        finish, ", ".join(f"{name} array<{k}>" for name, (_, k) in lists.items()) + ", text binary, marks binary, numbers binary, whole binary"
    )
    got = got.select(*lists, coder("text", "marks", "numbers", "whole").alias("score")).select(F.inline(F.arrays_zip(*lists, "score")))
    return got.select(F.col("_id").cast(kind).alias(id_column), "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.col("_bytes")).alias("bits_per_byte"))
