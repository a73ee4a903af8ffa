"""Elias-Fano coded monotone sequences in memory-mapped files, queried in vectors, and trie levels made of them."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

U1 = np.uint64(1)


def mapped(array: np.ndarray) -> np.ndarray:
    """A read-only copy of an array in a temporary file that is already unlinked, so it goes with its last reader."""
    with tempfile.TemporaryFile() as file:
        file.write(np.ascontiguousarray(array).tobytes() or b"\0" * 8)
        file.flush()
        raw = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    return np.frombuffer(raw, array.dtype, len(array))


def _packed(values: np.ndarray, bits: int) -> np.ndarray:
    """Values of at most `bits` bits one after the other in 64-bit words, with two words to spare."""
    out = np.zeros(len(values) * bits // 64 + 2, np.uint64)
    if bits and len(values):
        at = np.arange(len(values)) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[first]] = np.bitwise_or.reduceat(values << shift, first)
        over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out


def _select_in(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th (from 0) one of each word, by halves."""
    place = np.zeros(len(words), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(words & np.uint64((1 << half) - 1)).astype(np.int64)
        up = rank >= below
        place += half * up
        rank = rank - below * up
        words = words >> (np.uint64(half) * up)
    return place


class EliasFano:
    """Ascending integers below 2**bits: the low bits packed, the high bits in unary. About 2 + log2(2**bits / n) bits each."""

    def __init__(self, values: np.ndarray, bits: int):
        values = values.astype(np.uint64)
        self.n = len(values)
        self.low_bits = max(0, min(60, bits - max(0, self.n - 1).bit_length()))
        self.low = mapped(_packed(values & np.uint64((1 << self.low_bits) - 1), self.low_bits))
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        self.top = int(high[-1]) + 1 if self.n else 0
        unary = np.zeros(-(-(self.n + self.top + 1) // 64) * 64, np.uint8)
        unary[high + np.arange(self.n)] = 1
        words = np.packbits(unary, bitorder="little").view(np.uint64)
        self.high = mapped(words)
        ones = np.bitwise_count(words).astype(np.int64)
        self.ones = mapped(np.append(0, np.cumsum(ones)))
        self.zeros = mapped(np.append(0, np.cumsum(64 - ones)))

    def _select(self, i: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the i-th (from 0) bits of one kind."""
        directory = self.ones if bit else self.zeros
        word = np.searchsorted(directory, i, side="right") - 1
        return word * 64 + _select_in(self.high[word] if bit else ~self.high[word], i - directory[word])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def successor(self, x: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element not below x (and not before start), and whether it equals x."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        bucket = np.minimum((x >> np.uint64(self.low_bits)).astype(np.int64), self.top)
        want = x & np.uint64((1 << self.low_bits) - 1)
        begin = np.where(bucket > 0, self._select(np.maximum(bucket - 1, 0), 0) - bucket + 1, 0)
        end = np.where(bucket < self.top, self._select(np.minimum(bucket, self.top - 1), 0) - bucket, self.n)
        at = begin if start is None else np.maximum(begin, start)
        limit = end.copy()
        todo = np.flatnonzero(at < limit)
        while len(todo):  # by halves: a context with many children crowds few buckets
            middle = (at[todo] + limit[todo]) >> 1
            less = self._low(middle) < want[todo]
            at[todo[less]] = middle[less] + 1
            limit[todo[~less]] = middle[~less]
            todo = todo[at[todo] < limit[todo]]
        equal = at < end
        equal[equal] = self._low(at[equal]) == want[equal]
        return at, equal


#: Codes are logarithms again, of minus the logarithm of a probability, so that scores have a bounded relative error.
SCALE, LEAST = 1024.0, 2.0**-7


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit codes, that restore minus their logarithm to base 2, plus 2**-7, within 0.034 %."""
    return np.rint(SCALE * np.log2(1 + np.maximum(0.0, -np.log2(p)) / LEAST)).astype(np.uint16)


def logarithms(codes: np.ndarray) -> np.ndarray:
    """To base 2, of the probabilities."""
    return (1 - np.exp2(codes / SCALE)) * LEAST


def restore(codes: np.ndarray) -> np.ndarray:
    return np.exp2(logarithms(codes))


CHILD_BITS = 32


class Trie:
    """A level of an n-gram trie: contexts, monotone pointers to their children, and the children's quantised probabilities.

    A child is coded relative to its context: the context's rank in the high bits, the word's hash in the low ones, so
    the whole level is one monotone sequence, and a search starts at its context's pointer."""

    def __init__(self, contexts: np.ndarray, children: np.ndarray, p: np.ndarray, context_bits: int):
        """From n-grams sorted by (context, child), each once; contexts below 2**context_bits, children below 2**CHILD_BITS."""
        begin = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(contexts) else np.zeros(0, np.int64)
        rank = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(contexts))))
        self.contexts = EliasFano(contexts[begin], context_bits)
        self.pointers = EliasFano(np.append(begin, len(contexts)), max(1, int(len(contexts)).bit_length()))
        bits = CHILD_BITS + max(1, int(len(begin)).bit_length())
        self.children = EliasFano((rank.astype(np.uint64) << np.uint64(CHILD_BITS)) | children, bits)
        self.codes = mapped(quantise(p))

    def find(self, contexts: np.ndarray, of: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the n-grams (contexts[of], children), and which of them are known."""
        rank, known = self.contexts.successor(contexts)
        pointer = np.zeros(len(contexts), np.int64)
        pointer[known] = self.pointers.access(rank[known]).astype(np.int64)
        codes, found = np.zeros(len(children), np.uint16), np.zeros(len(children), bool)
        asked = np.flatnonzero(known[of])
        key = (rank[of[asked]].astype(np.uint64) << np.uint64(CHILD_BITS)) | children[asked]
        at, equal = self.children.successor(key, pointer[of[asked]])
        codes[asked[equal]] = self.codes[at[equal]]
        found[asked[equal]] = True
        return codes, found
