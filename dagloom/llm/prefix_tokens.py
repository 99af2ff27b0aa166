"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-pair encoding, the last token of a prefix's encoding is the one token
that ends there and may follow the last token of what is left before it; two
tokens may follow each other if encoding their joint bytes gives just them.
So one pass over a pre-token gives the count at each of its prefixes, and a
running sum gives the count at each prefix of the text.  Truncation points and
budget questions are then lookups.

Edge cases: a null text counts as empty (0 tokens); the special string inside a
text is one token, as the tokenizer library has it by default; repeated rows
stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dagloom.llm.common import load

#: Entries kept in each of a worker's two caches: counts of chunks, and pairs.
CACHE = 1_400_000
PAIRS = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: visible
    Latin-1 characters stand for themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return out


class PrefixCounter:
    """Counts for one byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path))
        self.vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(a, b): k for k, (a, b) in enumerate(pairs)}
        self.begins = {t[:k] for t in self.vocab for k in range(1, len(t) + 1)}
        self.byte = byte_alphabet()
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.follows: dict[tuple[str | None, str], bool] = {}
        self.totals: dict[str, int] = {}

    def merge(self, text: str) -> list[str]:
        """Plain byte-pair merging: lowest rank first, leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            parts[best : best + 2] = [pair[0] + pair[1]]
        return parts

    def may_follow(self, before: str | None, token: str) -> bool:
        key = (before, token)
        known = self.follows.get(key)
        if known is None:
            known = self.merge((before or "") + token) == ([token] if before is None else [before, token])
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            self.follows[key] = known
        return known

    def steps(self, pre_token: str) -> list[int]:
        """Token counts at each byte prefix of a pre-token (its first entry is 0)."""
        s = "".join([self.byte[b] for b in pre_token.encode()])
        n = len(s)
        last: list[str | None] = [None] * (n + 1)
        count = [0] + [-1] * n
        vocab, begins, follows = self.vocab, self.begins, self.follows
        for j in range(n):  # tokens that start here; the right ones before are known
            before, after = last[j], count[j] + 1
            for i in range(j + 1, n + 1):
                t = s[j:i]
                if t not in begins:
                    break
                if count[i] < 0 and t in vocab:
                    ok = follows.get((before, t))
                    if ok is None:
                        ok = self.may_follow(before, t)
                    if ok:
                        last[i], count[i] = t, after
        return count

    def pre_tokens(self, chunk: str) -> list[str]:
        if not chunk or chunk.isascii() or max(chunk) < "ɐ":
            return self.pattern.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def total(self, chunk: str) -> int:
        known = self.totals.get(chunk)
        if known is None:
            parts = self.pre_tokens(chunk)
            known = self.steps(chunk)[-1] if len(parts) == 1 else sum(map(self.total, parts))
            if len(self.totals) >= CACHE:
                self.totals.clear()
            self.totals[chunk] = known
        return known

    @staticmethod
    def chunks(piece: str) -> list[str]:
        """Parts at whose borders pre-tokens surely end: before single spaces."""
        if "  " in piece or piece[:1] == " " or piece[-1:] == " ":
            parts, a = [], 0
            for m in re.finditer(r"(?<=\S) (?=\S)", piece):
                parts.append(piece[a : m.start()])
                a = m.start()
            return [*parts, piece[a:]]
        first, *rest = piece.split(" ")
        return [first, *[" " + x for x in rest]]

    def pieces(self, text: str) -> list[str]:
        """Text between special strings; each gap between pieces is one token."""
        if self.special is None or not any(x in text for x in self.specials):
            return [text]
        return self.special.split(text)

    def count(self, text: str) -> int:
        pieces = self.pieces(text)
        get, n = self.totals.get, len(pieces) - 1
        for piece in pieces:
            chunks = self.chunks(piece)
            found = list(map(get, chunks))
            if None in found:
                n += sum([self.total(c) if x is None else x for c, x in zip(chunks, found)])
            else:
                n += sum(found)
        return n

    def _piece_counts(self, piece: str) -> np.ndarray:
        out = np.zeros(len(piece) + 1, np.int32)
        at = total = 0
        for p in self.pre_tokens(piece):
            count = self.steps(p)
            size = np.cumsum([len(c.encode()) for c in p])
            out[at + 1 : at + len(p) + 1] = total + np.array(count)[size]
            if p in ("'re", "'ve", "'ll"):  # cut short, it is a quote and a letter
                out[at + 2] = total + 2
            at += len(p)
            total += count[-1]
        for m in regex.finditer(r"\s+", piece):  # a prefix that ends in white space ends in one run of it
            run, a = m.group(), m.start()
            if len(run) > 1:
                size = np.cumsum([len(c.encode()) for c in run])
                out[a + 1 : a + len(run) + 1] = out[a] + np.array(self.steps(run))[size]
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[i]: tokens of text[:i], for i = 0 .. len(text)."""
        pieces, out, base = self.pieces(text), [np.zeros(1, np.int32)], 0
        marks = self.special.findall(text) if len(pieces) > 1 else []
        for piece, mark in zip(pieces, [*marks, ""]):
            within = self._piece_counts(piece + mark[:-1])
            out.append(base + within[1:])
            base += int(self._piece_counts(piece)[-1])
            if mark:
                base += 1
                out.append(np.array([base], np.int32))
        return np.concatenate(out)

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, looked
        for up to the first chunk that passes the budget."""
        done = used = 0
        pieces = self.pieces(text)
        marks = self.special.findall(text) if len(pieces) > 1 else []
        for piece, mark in zip(pieces, [*marks, ""]):
            for c in self.chunks(piece):
                n = self.total(c)
                if used + n > budget:
                    return done + int(np.flatnonzero(self._piece_counts(c) <= budget - used)[-1])
                done, used = done + len(c), used + n
            if mark:
                if used + 1 > budget:
                    return done
                done, used = done + len(mark), used + 1
        return done


@cache
def counter(name: str) -> PrefixCounter:
    return PrefixCounter(public_tokenizers.path(name))


def token_counts(df: DataFrame, limit: int, name: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, keep_chars): keep_chars is where
    to cut a text so that it has at most ``limit`` tokens."""
    names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "keep_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [x or "" for x in part.column(1).to_pylist()]
                n = [count.count(x) for x in texts]
                yield pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(x.encode()) for x in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                        pa.array([len(x) if k <= limit else count.fit(x, limit) for x, k in zip(texts, n)], pa.int64()),
                    ],
                    names,
                )

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, keep_chars long")


def prefix_tables(df: DataFrame, name: str = "byte_bpe_50k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, counts array<int>): the stored table, one entry for each prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(name)
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                rows = [count.prefix_counts(x or "") for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "counts"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, counts array<int>")


def op3_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), limit=1024)
