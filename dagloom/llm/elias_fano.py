"""Elias-Fano sequences and the trigram trie that is built of them.

``EliasFano`` keeps a non-decreasing sequence in about 2 + log2(U / n) bits an
entry: the low bits packed, the high bits as unary gaps with a directory of set
bits, both readable at any place without unpacking the rest.

``Trie`` has the contexts v, for each its successors w (the bigrams v w), for
each its earlier words u (the trigram contexts u v), and for each of these its
successors w (the trigrams u v w).  Every level is one monotone sequence of
ranks, each range shifted by the ranges before it, and a monotone sequence of
pointers to where its ranges begin.  A trigram's word is not kept by its rank in
the vocabulary but by its place among the successors of the shorter context v,
which is a much smaller number; a successor is found by a search within its
context's range alone.  Log probabilities and backoff weights are quantised to a
byte.  A trie is written as one file, whose levels are read through a memory map
and never unpacked whole.

The empty sequence and the empty trie are allowed.
"""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)
#: Place of the r-th set bit in each byte.
_SELECT = np.zeros((256, 8), np.uint8)
for _x in range(256):
    _set = [k for k in range(8) if _x >> k & 1]
    _SELECT[_x, : len(_set)] = _set


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = values.astype(np.uint64)
        n = len(v)
        if not n:
            return cls(0, 0, np.zeros(2, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.uint32))
        bits = max(0, (int(v[-1]) // n).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            part = v & np.uint64((1 << bits) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(place[-1]) // 8 * 8 + 8, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_POP[high], dtype=np.uint32)])
        return cls(n, bits, low, high, ones.astype(np.uint32))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i, each in 0 .. n - 1."""
        byte = np.searchsorted(self.ones, i.astype(np.uint32), "right") - 1
        place = byte * 8 + _SELECT[self.high[byte], i - self.ones[byte]]
        out = (place - i).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            at = i.astype(np.uint64) * np.uint64(self.low_bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            low = self.low[word] >> shift
            over = np.where(shift > 0, self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
            out |= (low | over) & np.uint64((1 << self.low_bits) - 1)
        return out

    def find(self, want: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Place of each wanted value within its range [low, high), or -1."""
        low, high = low.copy(), high.copy()
        inside = np.flatnonzero(low < high)
        live = inside[high[inside] - low[inside] > 1]
        while len(live):  # low stays at or before the place, if there is one
            mid = (low[live] + high[live]) >> 1
            less = self[mid] <= want[live]
            low[live[less]] = mid[less]
            high[live[~less]] = mid[~less]
            live = live[high[live] - low[live] > 1]
        out = np.full(len(want), -1, np.int64)
        same = self[low[inside]] == want[inside]
        out[inside[same]] = low[inside[same]]
        return out

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high, self.ones]

    @classmethod
    def from_parts(cls, parts: list[np.ndarray]) -> EliasFano:
        return cls(int(parts[0][0]), int(parts[0][1]), *parts[1:])


#: log10 probabilities are kept in steps of 1 / STEPS, down to -255 / STEPS.
STEPS = 25
#: Every how many hashes of a level one is looked at first, to bound its search.
SAMPLE = 64


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-logs * STEPS), 0, 255).astype(np.uint8)


def value(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -STEPS


class Trie:
    NAMES = ("contexts", "words", "earlier", "pointers", "successors", "node_pointers", "nodes", "third_pointers", "third")
    CODES = ("probability", "backoff", "third_probability", "node_backoff")

    def __init__(self, levels: dict[str, EliasFano], codes: dict[str, np.ndarray]):
        self.levels, self.codes = levels, codes

    @classmethod
    def build(
        cls, contexts: np.ndarray, words: np.ndarray, earlier: np.ndarray,
        bigrams: tuple[np.ndarray, np.ndarray, np.ndarray], backoff: np.ndarray,
        nodes: tuple[np.ndarray, np.ndarray, np.ndarray],
        trigrams: tuple[np.ndarray, np.ndarray, np.ndarray],
    ) -> bytes:
        """contexts, words, earlier: sorted hashes.  bigrams: (context, word, log
        probability); nodes: (context, earlier word, log backoff); trigrams:
        (node, bigram, log probability); all by places in the former, and sorted
        by the first two.  backoff: each context's.  Returns the file's bytes."""
        begin = np.searchsorted(bigrams[0], np.arange(len(contexts) + 1))
        node_begin = np.searchsorted(nodes[0], np.arange(len(contexts) + 1))
        third_begin = np.searchsorted(trigrams[0], np.arange(len(nodes[0]) + 1))
        among = trigrams[1] - begin[nodes[0][trigrams[0]]]
        levels = (
            contexts, words, earlier, begin, _shifted(bigrams[1], begin),
            node_begin, _shifted(nodes[1], node_begin), third_begin, _shifted(among, third_begin),
        )
        arrays = [a for x in levels for a in EliasFano.of(x).parts()]
        arrays += [quantise(x) for x in (bigrams[2], backoff, trigrams[2], nodes[2])]
        head = np.array([[ord(a.dtype.kind), a.dtype.itemsize, len(a)] for a in arrays], np.int64)
        out = [np.array([len(arrays)], np.int64).tobytes(), head.tobytes()]
        for a in arrays:
            raw = a.tobytes()
            out.append(raw + b"\0" * (-len(raw) % 8))
        return b"".join(out)

    @classmethod
    def open(cls, data: bytes) -> Trie:
        """Maps a trie file; it lives in an unnamed file until it is let go."""
        held = tempfile.TemporaryFile()
        held.write(data)
        held.flush()
        view = mmap.mmap(held.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(view, np.int64, 1)[0])
        head = np.frombuffer(view, np.int64, 3 * n, 8).reshape(n, 3)
        at, arrays = 8 + 24 * n, []
        for kind, size, length in head.tolist():
            arrays.append(np.frombuffer(view, np.dtype(f"{chr(kind)}{size}"), length, at))
            at += size * length + -(size * length) % 8
        levels = {name: EliasFano.from_parts(arrays[4 * k : 4 * k + 4]) for k, name in enumerate(cls.NAMES)}
        return cls(levels, dict(zip(cls.CODES, arrays[4 * len(cls.NAMES) :])))

    def places(self, level: str, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes among the contexts, words or earlier words, or -1."""
        n = self.levels[level].n
        if not n:
            return np.full(len(hashes), -1, np.int64)
        some = np.arange(0, n, SAMPLE)
        low = np.maximum(np.searchsorted(self.levels[level][some], hashes, "right") - 1, 0) * SAMPLE
        return self.levels[level].find(hashes, low, np.minimum(low + SAMPLE, n))

    def _range(self, pointers: str, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.levels[pointers]
        return at[node].astype(np.int64), at[node + 1].astype(np.int64)

    def _within(self, pointers: str, ranks: str, node: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Places of ranks within the nodes' ranges, or -1; of -1, too."""
        out = np.full(len(node), -1, np.int64)
        level = self.levels[ranks]
        at = np.flatnonzero((node >= 0) & (rank >= 0))
        if level.n and len(at):
            low, high = self._range(pointers, node[at])
            # a range's shift is one more than the entry before it
            shift = np.where(low > 0, level[np.maximum(low - 1, 0)] + np.uint64(1), np.uint64(0))
            out[at] = level.find(rank[at].astype(np.uint64) + shift, low, high)
        return out

    def bigrams(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, place) by the places of contexts and words; where
        the place is -1, the context's backoff weight, 0 for an unknown one."""
        place = self._within("pointers", "successors", context, word)
        out = np.zeros(len(context))
        known, hit = context >= 0, place >= 0
        out[known] = value(self.codes["backoff"][context[known]])
        out[hit] = value(self.codes["probability"][place[hit]])
        return out, place

    def nodes(self, context: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Places of the trigram contexts, or -1."""
        return self._within("node_pointers", "nodes", context, earlier)

    def trigrams(self, context: np.ndarray, node: np.ndarray, bigram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log10 probability, found) by the places of contexts, trigram contexts
        and bigrams; where not found, the trigram context's backoff weight, 0 for
        an unknown one."""
        among = bigram.copy()
        some = bigram >= 0
        among[some] -= self._range("pointers", context[some])[0] if some.any() else 0
        place = self._within("third_pointers", "third", node, among)
        out = np.zeros(len(node))
        known, hit = node >= 0, place >= 0
        out[known] = value(self.codes["node_backoff"][node[known]])
        out[hit] = value(self.codes["third_probability"][place[hit]])
        return out, hit


def _shifted(rank: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Ranks, each range of them moved to begin after the last one before it."""
    if not len(rank):
        return np.zeros(0, np.int64)
    size = np.diff(begin)
    top = np.where(size > 0, rank[np.maximum(begin[1:] - 1, 0)] + 1, 0)
    return rank + np.repeat(np.cumsum(top) - top, size)
