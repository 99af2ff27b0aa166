"""Token ids of whole texts by the word-level BPE of the tokenizers library.

For the tokenizer files that ``SPLITTING`` describes, a text's ids are those of
its parts: pre-tokens never hold white space, the normaliser works on each run
of characters by itself, and an ASCII (or Latin-1) letter and an ASCII mark
other than the apostrophe are never in one pre-token.  A letter of A-Z that no
byte of another alphabet follows may be lowered beforehand, as no composition
reaches it.  So numpy cuts texts to parts and hashes them (64 bits), a hash
table of at most ``CACHE`` parts gives the ids of those that a worker has seen.
Of the others, those of small Latin-1 letters only are one pre-token each and go
through ``Merges``, which does the file's merges in numpy, many parts side by
side; the library encodes the rest, many in one call.

Any other tokenizer file, and any text with a special string, goes through the
library whole.  Nulls count as empty texts.
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from dagloom.llm.prefix_tokens import byte_alphabet
from dagloom.llm.words import LOWER, SEPARATOR, mix, split_words, text_bytes

#: Parts in a worker's table, and ids kept for them, at most.
CACHE = 1 << 20
MOST_IDS = 1 << 23
#: Parts in one call of the library, and bytes of text looked at in one go.
CALL = 20_000
PIECE = 1 << 21
#: Bytes of a part that is merged in numpy, at most.
PLAIN = 256
BETWEEN = "\x01"

# How the word-level tokenizer file normalises and splits.
SPLITTING = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, bool)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = True
_MARK[ord("'")] = False


def lowered(raw: np.ndarray) -> np.ndarray:
    """raw with A-Z lowered where no byte over 127 follows."""
    out = LOWER.take(raw)
    held = np.flatnonzero((raw[1:] > 127) & (out[:-1] != raw[:-1]))
    out[held] = raw[held]
    return out


def part_borders(raw: np.ndarray) -> np.ndarray:
    """Places (len raw + 1) inside words where one part surely ends."""
    letter, mark = _LETTER.take(raw), _MARK.take(raw)
    after = letter.copy()  # bytes that end a letter
    after[1:] |= (raw[:-1] == 0xC3) & (raw[1:] > 127) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    out = np.zeros(len(raw) + 1, bool)
    out[1:-1] = (after[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return out


def _small_only(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether parts hold small letters a-z and of Latin-1 only, at most PLAIN bytes."""
    size = end - start
    out = size <= PLAIN
    size = size[out]
    at = np.repeat(start[out] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    x = raw[at]
    after = raw[np.maximum(at - 1, 0)]
    lead = (x == 0xC3) & (raw[np.minimum(at + 1, len(raw) - 1)] >= 0x9F) & (raw[np.minimum(at + 1, len(raw) - 1)] != 0xB7)
    fine = (x >= 97) & (x <= 122) | lead | (x >= 0x9F) & (x <= 0xBF) & (x != 0xB7) & (after == 0xC3)
    if len(size):
        out[out] = np.logical_and.reduceat(fine, np.cumsum(size) - size)
    return out


class Merges:
    """Byte-pair merging of many pre-tokens side by side: in each turn every
    pre-token makes the merge of lowest rank, the leftmost among equals."""

    NONE = np.int64(1) << 30

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        byte = byte_alphabet()
        self.inner = np.array([vocab.get(byte[b], -1) for b in range(256)], np.int64)
        self.last = np.array([vocab.get(byte[b] + end, -1) for b in range(256)], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int64)
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint64)
        self.table = Known(max(len(key), 1))
        first = np.unique(key, return_index=True)[1]
        self.table.put(mix(key[first]) | np.uint64(1 << 63), first.astype(np.uint64))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at, found = self.table.find(mix((a << 16 | b).astype(np.uint64)) | np.uint64(1 << 63))
        return np.where(found, at.astype(np.int64), self.NONE)

    def run(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pre-tokens whose bytes stand in raw one after another
        (each at least one byte), and their number in each."""
        ends = np.cumsum(sizes)
        sym = self.inner.take(raw)
        sym[ends - 1] = self.last.take(raw[ends - 1])
        rank = np.full(len(sym), self.NONE)
        pair = np.ones(len(sym), bool)
        pair[ends - 1] = False
        at = np.flatnonzero(pair)
        rank[at] = self.rank(sym[at], sym[at + 1])
        word, size = np.arange(len(sizes)), sizes.astype(np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(word):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), begin)
            at, best = best & 0xFFFFFFFF, best >> 32
            over = best == self.NONE
            if over.any():
                of = np.repeat(over, size)
                done.append((word[over], size[over], sym[of]))
                shift = np.cumsum(of)
                sym, rank = sym[~of], rank[~of]
                at = at[~over]
                at -= shift[at]
                word, size, best = word[~over], size[~over], best[~over]
                if not len(word):
                    break
                begin = np.cumsum(size) - size
            sym[at] = self.made.take(best)
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            rank[at] = rank[at + 1]  # the end of a pre-token stays one
            sym, rank = sym[left], rank[left]
            at -= np.arange(len(at))
            size = size - 1
            begin = np.cumsum(size) - size
            more = at + 1 < begin + size
            rank[at[more]] = self.rank(sym[at[more]], sym[at[more] + 1])
            more = at > begin
            rank[at[more] - 1] = self.rank(sym[at[more] - 1], sym[at[more]])
        words, counts, syms = (np.concatenate([x[k] for x in done]) for k in range(3))
        order = np.argsort(words)
        counts, begin = counts[order], (np.cumsum(counts) - counts)[order]
        end = np.cumsum(counts)
        return syms[np.repeat(begin - (end - counts), counts) + np.arange(len(syms))].astype(np.uint16), counts


class Known:
    """A hash table from part hashes to runs of ids."""

    def __init__(self, room: int = CACHE):
        size = 1 << max(10, (2 * room - 1).bit_length())
        self.room, self.mask = room, np.uint64(size - 1)
        self.key, self.place = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        self.ids, self.end, self.n = np.zeros(1 << 16, np.uint16), 0, 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found) of each hash; a value is place << 16 | number of ids."""
        slot = (h & self.mask).astype(np.int64)
        held = self.key.take(slot)
        found = held == h
        at = np.flatnonzero(~found & (held != 0))
        while len(at):
            slot[at] = (slot[at] + 1) & int(self.mask)
            held = self.key.take(slot[at])
            found[at] = held == h[at]
            at = at[(held != 0) & (held != h[at])]
        return self.place.take(slot), found

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """h: distinct hashes that are not in the table; ids: one run after another."""
        while self.end + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids), np.uint16)])
        self.ids[self.end : self.end + len(ids)] = ids
        value = (np.cumsum(sizes) - sizes + self.end).astype(np.uint64) << np.uint64(16) | sizes.astype(np.uint64)
        self.end += len(ids)
        self.put(h, value)

    def put(self, h: np.ndarray, value: np.ndarray) -> None:
        self.n += len(h)
        slot, at = (h & self.mask).astype(np.int64), np.arange(len(h))
        while len(at):
            s = slot[at]
            free = self.key[s] == 0
            self.key[s[free]] = h[at[free]]
            won = self.key[s] == h[at]
            self.place[s[won]] = value[at[won]]
            at = at[~won]
            slot[at] = (slot[at] + 1) & int(self.mask)


class PartEncoder:
    """Encodes texts to uint16 ids (vocabularies up to 65,536 ids)."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        with open(path) as f:
            spec = json.load(f)
        mark = self.library.encode(BETWEEN, add_special_tokens=False).ids
        self.by_parts = len(mark) == 1 and all(spec.get(k) == v for k, v in SPLITTING.items())
        self.between = mark[0] if self.by_parts else None
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.known = Known()
        self.merges = Merges(spec["model"]["vocab"], spec["model"]["merges"], spec["model"].get("end_of_word_suffix") or "") if self.by_parts else None

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    def _library(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts without white space, from texts made of many of them with
        a mark between that none of them holds and that is one id of its own."""
        out: list[np.ndarray] = []
        for at in range(0, len(parts), CALL):
            some = parts[at : at + CALL]
            plain = [p for p in some if BETWEEN not in p]
            ids = np.zeros(0, np.uint16)
            if plain:
                coded = self.library.encode_batch_fast([f" {BETWEEN} ".join(plain)], add_special_tokens=False)[0]
                ids = np.array(coded.ids, np.uint16)
            runs = iter(np.split(ids, np.flatnonzero(ids == self.between)))
            first = True
            for p in some:
                if BETWEEN in p:
                    out.append(self._whole(p))
                    continue
                run = next(runs)
                out.append(run if first else run[1:])
                first = False
            if next(runs, None) is not None and plain:
                raise AssertionError("a part held the mark")
        return out

    def _piece(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a piece and their number in each of its texts."""
        low = lowered(raw)
        w = split_words(low, off, lower=False, cut=part_borders(low))
        h = mix(w.hash + (w.end - w.start).astype(np.uint64))
        h[h == 0] = 1
        at, found = self.known.find(h)
        if not found.all():
            new, first = np.unique(h[~found], return_index=True)
            if self.known.n + len(new) > self.known.room or self.known.end > MOST_IDS:
                self.known = Known(max(CACHE, len(h)))
                new, first = np.unique(h, return_index=True)
                which = first
            else:
                which = np.flatnonzero(~found)[first]
            start, end = w.start[which], w.end[which]
            plain = _small_only(low, start, end)
            if plain.any():
                size = (end - start)[plain]
                at = np.repeat(start[plain] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                self.known.add(new[plain], *self.merges.run(low[at], size))
            if not plain.all():
                data = low.tobytes()
                runs = self._library([data[a:z].decode() for a, z in zip(start[~plain].tolist(), end[~plain].tolist())])
                sizes = np.array([len(x) for x in runs], np.int64)
                if sizes.max() >= 1 << 16:  # a part longer than the table can say
                    return self._long(low, off)
                self.known.add(new[~plain], np.concatenate(runs), sizes)
            at, _ = self.known.find(h)
        size = (at & np.uint64(0xFFFF)).astype(np.int64)
        end = np.cumsum(size)
        begin = (at >> np.uint64(16)).astype(np.int64) - (end - size)
        ids = self.known.ids.take(np.repeat(begin, size) + np.arange(len(begin) and int(end[-1])))
        return ids, np.diff(np.concatenate([[0], end])[w.first])

    def _long(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = raw.tobytes()
        runs = [self._whole(data[a:z].decode()) for a, z in zip(off[:-1].tolist(), off[1:].tolist())]
        return np.concatenate(runs or [np.zeros(0, np.uint16)]), np.array([len(x) for x in runs], np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column one after another, and their number in
        each text."""
        raw, off = text_bytes(column)
        n = len(off) - 1
        odd = np.zeros(n, bool)
        for x in self.special if self.by_parts else ():
            odd |= np.array(pc.fill_null(pc.match_substring(column, x), False)).astype(bool)
        if not self.by_parts or odd.any():
            ids, sizes = [], np.zeros(n, np.int64)
            for i in range(n):
                part = raw[off[i] : off[i + 1]]
                if odd[i] or not self.by_parts:
                    one = self._whole(part.tobytes().decode())
                else:
                    one = self._pieces(part, np.array([0, len(part)]))[0]
                ids.append(one)
                sizes[i] = len(one)
            return np.concatenate(ids or [np.zeros(0, np.uint16)]), sizes
        return self._pieces(raw, off)

    def _pieces(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Goes through the bytes piece by piece, cut at white space or a text's start."""
        n, sizes, out, a = len(off) - 1, np.zeros(len(off) - 1, np.int64), [], 0
        while a < len(raw):
            b = min(len(raw), a + PIECE)
            while b < len(raw):
                near = np.flatnonzero(SEPARATOR[raw[b : b + 4096]])
                text = int(np.searchsorted(off, b))
                start = int(off[text]) if text < len(off) else len(raw)
                b = min(start, b + (int(near[0]) if len(near) else 4096))
                if len(near) or b == start:
                    break
            i, j = int(np.searchsorted(off, a, "right")) - 1, int(np.searchsorted(off, b))
            ids, size = self._piece(raw[a:b], np.clip(off[i : j + 1], a, b) - a)
            sizes[i:j] += size
            out.append(ids)
            a = b
        return np.concatenate(out or [np.zeros(0, np.uint16)]), sizes


@cache
def encoder(name: str = "word_bpe_49k.json") -> PartEncoder:
    return PartEncoder(public_tokenizers.path(name))
