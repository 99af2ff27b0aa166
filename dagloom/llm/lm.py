"""Language-model scores from a sharded Elias-Fano trigram trie.

Each order is smoothed with the one below it (Dirichlet, weights ``MU``, ``MU3``)::

    p(w | v)   = (c(v w) + MU p(w)) / (c(v) + MU)
    p(w | u v) = (c(u v w) S + MU3 p(w | v)) / (c(u v B) + MU3)

A text's first word has two start marks before it.  The unigram model has every
word's own count, and an unseen word counts as one seen once.  About ``TOP`` of
the most frequent words' counts are broadcast; a shuffle on the word takes each
other count to the shards whose trigrams need it.

All trigrams, the training texts' and the queries' alike, go to shards by the
middle word v, so that its bigrams and trigram contexts meet there.  A shard
counts its training trigrams, builds its trie, and asks it for all its trigrams;
sums by document, a packed row for each message of texts, are then added up over
the shards.

Where v is so frequent that it would swell one shard, its next words w are
divided into 2^b classes B by their hash, as few as will do, and each class goes
to a shard of its own.  There the trigram context is (u, v, B), and
S = p(B | v) = (c(v B) + MU p(B)) / (c(v) + MU) is the class's share, so that the
probabilities after u v still sum to one, and no trigram is left out.  For all
other v, B is every word and S is 1.  Shards and classes follow from the texts'
number of words alone, not from the cluster's settings.

A word's training count is what its bigrams as first word say, so base scores and
known words come from the same shards.

Edge cases: a null text is empty, with one token, its end; a null id is held
out; rows that repeat an id and its text are scored and counted each; extra
columns are ignored; an empty table, or one without training rows, trains on
nothing and scores with what is left (0 known tokens, N = 0).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.common import NULL_ID, id_key, load, stored
from dagloom.llm.elias_fano import Trie
from dagloom.llm.words import mix, slices, split_words, text_bytes

MU = 300.0
MU3 = 30.0
TOP = 1 << 18
#: Counts on their way to the shards that a task packs at once.
CELLS = 1 << 19
SHARD_WORDS = 1_500_000
#: Shards at least, so that small tables are not left to one task.
SHARDS_LEAST = 8
#: Words (tokens) of a message to the shards at most, but for longer texts.
CHUNK_BYTES = 8 << 20
#: A shard's sums for a document.
SUMS = (("rows", "<u2"), ("n_tokens", "<u4"), ("n_known", "<u4"), ("base", "<f8"), ("score", "<f8"))
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)


@dataclass
class Unigrams:
    tokens: int  # N, ends included
    kinds: int  # V, the end included
    ends: int  # training documents
    single: int  # words seen once
    words: np.ndarray  # sorted hashes of frequent words
    counts: np.ndarray
    rest_words: np.ndarray  # sorted hashes of the others that a shard needs
    rest_counts: np.ndarray

    def top(self, word: np.ndarray) -> np.ndarray:
        """Counts of frequent words, 0 for others."""
        return _looked_up(self.words, self.counts, word)

    @property
    def whole(self) -> float:
        return self.tokens + self.single + 1.0

    def log10(self, word: np.ndarray) -> np.ndarray:
        """log10 probabilities; the unseen share follows the words seen once."""
        count = np.maximum(self.top(word), _looked_up(self.rest_words, self.rest_counts, word)).astype(float)
        p = np.where(count > 0, count, 1.0)
        p = np.where(word == END, self.ends + 0.1, p)
        return np.log10(p / self.whole)


@dataclass
class Classes:
    """The first words that are spread, and the classes of their next words: a
    word's lowest bits.  mass: the probability of each of 2^k classes, with the
    most bits that any word has."""

    words: np.ndarray  # sorted hashes
    bits: np.ndarray
    mass: np.ndarray

    def bits_of(self, first: np.ndarray) -> np.ndarray:
        return _looked_up(self.words, self.bits, first)

    def share(self, bits: np.ndarray, label: np.ndarray) -> np.ndarray:
        """p(B) by the unigram model."""
        out = np.ones(len(bits))
        for k in np.unique(bits).tolist():
            folded = self.mass.reshape(-1, 1 << k).sum(0)
            out[bits == k] = folded[label[bits == k].astype(np.int64)]
        return out


def label_of(bits: np.ndarray, second: np.ndarray) -> np.ndarray:
    return second & ((np.uint64(1) << bits.astype(np.uint64)) - np.uint64(1))


def classes_of(vocab: DataFrame, uni: Unigrams, shards: int) -> Classes:
    """Classes for words with more than half a shard's words; there are at most
    2 * shards of them, and as many classes in all."""
    share = max(1, uni.tokens // (2 * shards))
    words = np.append(uni.words, START)
    counts = np.append(uni.counts, uni.ends)
    hot = np.flatnonzero(counts > share)
    hot = hot[np.argsort(words[hot])]
    bits = np.ceil(np.log2(counts[hot] / share)).astype(np.int64)
    most = int(bits.max(initial=0))
    low = F.expr(f"h & {(1 << most) - 1}L")
    found = vocab.groupBy(low.alias("label")).agg(F.sum("c").alias("c")).toArrow()
    mass = np.full(1 << most, (uni.single + 0.9) / (1 << most))
    mass[np.array(found["label"]).astype(np.int64)] += np.array(found["c"]).astype(float)
    mass[int(END) & ((1 << most) - 1)] += uni.ends + 0.1
    return Classes(words[hot], bits, mass / uni.whole)


def _looked_up(words: np.ndarray, counts: np.ndarray, word: np.ndarray) -> np.ndarray:
    if not len(words):
        return np.zeros(len(word), np.int64)
    at = np.minimum(np.searchsorted(words, word), len(words) - 1)
    return np.where(words[at] == word, counts[at], 0)


def training_counts(rows: DataFrame) -> tuple[Unigrams, DataFrame, DataFrame]:
    """rows: (text, train).  The model with frequent words, and (h, c) of all
    words and of those that are not frequent."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", CHUNK_BYTES):
                w = split_words(*text_bytes(b.column("text")), lower=True)
                h, n = np.unique(w.hash, return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "c"])

    train = rows.where("train")
    spark = rows.sparkSession
    vocab = stored(train.select("text").mapInArrow(counts, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "op1-words")
    ends = train.select("train").count()
    scale = F.floor(F.log2("c") * 16).cast("int")
    levels = vocab.groupBy(scale.alias("s")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.sum((F.col("c") == 1).cast("long")).alias("one")).collect()
    kept, cut = 0, 1 << 30
    for r in sorted(levels, key=lambda r: -r["s"]):
        if kept + r["n"] > TOP:
            break
        kept, cut = kept + r["n"], r["s"]
    top = vocab.where(scale >= cut).toArrow()
    words = np.array(top["h"]).astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    uni = Unigrams(
        sum(r["c"] for r in levels) + ends, sum(r["n"] for r in levels) + (ends > 0), ends, sum(r["one"] for r in levels),
        words[order], np.array(top["c"]).astype(np.int64)[order], *none,
    )
    return uni, vocab, vocab.where(scale < cut)


def _trigrams(w, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, earlier, document) of every word and end: the one before
    it, itself, and the one before both; texts start with START twice and end
    with END."""
    n = np.diff(w.first)
    doc = np.repeat(np.arange(docs), n + 1)
    begin = w.first[:-1] + np.arange(docs)
    first = np.empty(len(doc), np.uint64)
    second = np.empty(len(doc), np.uint64)
    inner = np.ones(len(doc), bool)
    inner[begin] = False
    first[begin] = START
    first[inner] = w.hash
    last = np.ones(len(doc), bool)
    last[begin + n] = False
    second[begin + n] = END
    second[last] = w.hash
    earlier = np.empty(len(doc), np.uint64)
    earlier[1:] = first[:-1]
    earlier[begin] = START
    return first, second, earlier, doc


def _press(fields: list[np.ndarray]) -> bytes:
    """Arrays of numbers, compressed: all numbers' first bytes, then the second
    ones, and so on."""
    data = b"".join(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in fields)
    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def _unpress(data: bytes, shape: list[tuple[str, int]]) -> list[np.ndarray]:
    size = sum(np.dtype(kind).itemsize * n for kind, n in shape)
    raw = pa.Codec("zstd").decompress(data, decompressed_size=size, asbytes=True)
    at, out = 0, []
    for kind, n in shape:
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def _table(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of x, as steps of places in the sorted array known
    and, of the others, steps of the numbers; and where each of x stands in
    both, one after the other."""
    values, at = np.unique(x, return_inverse=True)
    place = np.searchsorted(known, values)
    hit = np.zeros(len(values), bool)
    inside = np.flatnonzero(place < len(known))
    hit[inside] = known[place[inside]] == values[inside]
    rank = np.where(hit, np.cumsum(hit) - 1, hit.sum() + np.cumsum(~hit) - 1)
    steps = np.diff(place[hit], prepend=0).astype("<u4")
    return steps, np.diff(values[~hit], prepend=np.uint64(0)), rank[at]


def _pack(first: np.ndarray, second: np.ndarray, earlier: np.ndarray, doc: np.ndarray, known: np.ndarray) -> bytes:
    """Trigrams sorted by the first and second word: the first words once each
    with their numbers of trigrams, a table of second and earlier words, and by
    trigram both places there and the document; compressed.  known: the words
    that are named by their place in it."""
    n = len(first)
    near, far, head = _table(first, known)
    table_near, table_far, at = _table(np.concatenate([second, earlier]), known)
    size = len(table_near) + len(table_far)
    order = np.argsort(head * np.int64(size) + at[:n], kind="stable")
    wide = 4 if size > 1 << 16 else 2
    fields = [
        near, far, np.bincount(head).astype("<u4"), table_near, table_far, at[:n][order].astype(f"<u{wide}"),
        at[n:][order].astype(f"<u{wide}"), doc[order].astype("<u2"),
    ]
    sizes = np.array([len(near), len(far), len(table_near), len(table_far), n, wide], np.int64)
    return sizes.tobytes() + _press(fields)


def _unpack(data: bytes, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    near, far, table_near, table_far, n, wide = np.frombuffer(data, np.int64, 6).tolist()
    shape = [("<u4", near), ("<u8", far), ("<u4", near + far), ("<u4", table_near), ("<u8", table_far), (f"<u{wide}", n), (f"<u{wide}", n), ("<u2", n)]
    a, b, times, c, d, second, earlier, doc = _unpress(data[48:], shape)
    heads, table = (np.concatenate([known[np.cumsum(x, dtype=np.int64)], np.cumsum(y, dtype=np.uint64)]) for x, y in ((a, b), (c, d)))
    return np.repeat(heads, times), table[second], table[earlier], doc


def score(docs: DataFrame, train: F.Column, text: str = "text", key: str = "doc_id", mu: float = MU, mu3: float = MU3) -> tuple[DataFrame, Unigrams]:
    """(k, x, train, rows, n_tokens, n_known, base, score) of the texts, with
    the training counts; rows: how many rows share this id and text."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(id_key(key).alias("k"), whole.alias("text"), train.alias("train"))
    spark = docs.sparkSession
    uni, vocab, rest = training_counts(rows)
    total = rows.agg(F.coalesce(F.sum(F.length("text") / 5 + 1), F.lit(0)).alias("n")).first()["n"]
    shards = max(SHARDS_LEAST, math.ceil(total / SHARD_WORDS))
    held = spark.sparkContext.broadcast((uni, classes_of(vocab, uni, shards)))

    def dealt(first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The trigrams' shards."""
        bits = held.value[1].bits_of(first)
        spot = np.where(bits > 0, first ^ mix(label_of(bits, second) + np.uint64(1)), first)
        return (mix(spot) % np.uint64(shards)).astype(np.int32)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards that need the count of a word that is not broadcast."""
        for batch in batches:
            for b in slices(batch, "text", CHUNK_BYTES):
                first, second, _, _ = _trigrams(split_words(*text_bytes(b.column("text")), lower=True), b.num_rows)
                rare = (second != END) & (held.value[0].top(second) == 0)
                words, at = np.unique(second[rare], return_inverse=True)
                each = np.unique(at * np.int64(shards) + dealt(first[rare], second[rare]))
                yield pa.record_batch([pa.array(words[each // shards].view(np.int64)), pa.array((each % shards).astype(np.int32))], ["h", "shard"])

    def pack_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(some: list[pa.RecordBatch]) -> pa.RecordBatch:
            s, h, c = (np.concatenate([np.array(b.column(x)) for b in some]) for x in ("shard", "h", "c"))
            order = np.argsort(s, kind="stable")
            at, begin = np.unique(s[order], return_index=True)
            edges = np.append(begin, len(s)).tolist()
            data = [h[order[a:z]].tobytes() + c[order[a:z]].tobytes() for a, z in zip(edges[:-1], edges[1:])]
            n = len(at)
            return pa.record_batch([pa.array(at, pa.int32()), pa.array([-1] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array(data, pa.binary())], ["shard", "message", "docs", "data"])

        some, n = [], 0
        for batch in batches:
            some.append(batch)
            n += batch.num_rows
            if n >= CELLS:
                yield packed(some)
                some, n = [], 0
        if n:
            yield packed(some)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, message = TaskContext.get().partitionId(), 0
        names = ["shard", "message", "docs", "data"]
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        for batch in batches:
            for b in slices(batch, "text", CHUNK_BYTES):
                for at in range(0, b.num_rows, 60_000):
                    part = b.slice(at, 60_000)
                    w = split_words(*text_bytes(part.column("text")), lower=True)
                    first, second, earlier, doc = _trigrams(w, part.num_rows)
                    goes = dealt(first, second)
                    order = np.argsort(goes, kind="stable")
                    edges = np.searchsorted(goes[order], np.arange(shards + 1))
                    k, x, learn = (np.array(part.column(c)) for c in ("k", "x", "train"))
                    flags = np.packbits(learn).tobytes()
                    name = place << 32 | message
                    message += 1
                    # the documents' own row goes past the shards
                    out = [(-1, name, part.num_rows, k.tobytes() + x.astype("<i4").tobytes() + flags)]
                    for s in np.flatnonzero(np.diff(edges)).tolist():
                        pick = order[edges[s] : edges[s + 1]]
                        out.append((s, name, part.num_rows, flags + _pack(first[pick], second[pick], earlier[pick], doc[pick], held.value[0].words)))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    def shard(table: pa.Table) -> pa.Table:
        names, docs, data = (table.column(c).to_pylist() for c in ("message", "docs", "data"))
        if table.column("shard")[0].as_py() < 0:
            return pa.table({"message": pa.array(names, pa.int64()), "docs": pa.array(docs, pa.int32()), "own": [True] * len(names), "data": pa.array(data, pa.binary())})
        first, second, earlier, doc, learn, base = [], [], [], [], [], [0]
        counts = [np.frombuffer(raw, np.int64).reshape(2, -1) for name, raw in zip(names, data) if name < 0]
        words, at = np.unique(np.concatenate([x[0] for x in counts] or [np.zeros(0, np.int64)]).view(np.uint64), return_index=True)
        uni = replace(held.value[0], rest_words=words, rest_counts=np.concatenate([x[1] for x in counts] or [np.zeros(0, np.int64)])[at])
        sent = [i for i, name in enumerate(names) if name >= 0]
        names, docs, data = ([x[i] for i in sent] for x in (names, docs, data))
        for n, raw in zip(docs, data):
            flags = -(-n // 8)
            a, b, c, d = _unpack(raw[flags:], uni.words)
            first.append(a)
            second.append(b)
            earlier.append(c)
            doc.append((d + np.int64(base[-1])).astype(np.int32))
            learn.append(np.unpackbits(np.frombuffer(raw, np.uint8, flags), count=n).astype(bool))
            base.append(base[-1] + n)
        del table, data
        whole = []
        for part in (first, second, earlier, doc, learn):
            whole.append(np.concatenate(part))
            part.clear()
        sums = score_shard(uni, held.value[1], *whole, base[-1], mu, mu3)
        out = []
        for a, b in zip(base[:-1], base[1:]):
            at = np.flatnonzero(sums["n_tokens"][a:b])
            columns = [at.astype("<u2"), *(sums[c][a:b][at].astype(t) for c, t in SUMS)]
            out.append(np.int64(len(at)).tobytes() + _press(columns))
        return pa.table({"message": pa.array(names, pa.int64()), "docs": pa.array(docs, pa.int32()), "own": [False] * len(names), "data": pa.array(out, pa.binary())})

    def gather(table: pa.Table) -> pa.Table:
        """Adds up a message's parts from the shards."""
        n = table.column("docs")[0].as_py()
        sums = {c: np.zeros(n, np.float64 if t == "<f8" else np.int64) for c, t in SUMS}
        keys = None
        for own, raw in zip(table.column("own").to_pylist(), table.column("data").to_pylist()):
            if own:
                keys = np.frombuffer(raw, np.int64, n), np.frombuffer(raw, "<i4", n, 8 * n), np.unpackbits(np.frombuffer(raw, np.uint8, offset=12 * n), count=n).astype(bool)
                continue
            m = int(np.frombuffer(raw, np.int64, 1)[0])
            place, *parts = _unpress(raw[8:], [("<u2", m), *((t, m) for _, t in SUMS)])
            for (c, _), part in zip(SUMS, parts):
                sums[c][place] += part
        return pa.table({"k": keys[0], "x": keys[1], "train": keys[2], **sums})

    asked = rows.select("text").mapInArrow(ask, "h long, shard int")
    counts = asked.join(rest, "h").select("shard", "h", "c").mapInArrow(pack_counts, "shard int, message long, docs int, data binary")
    sent = rows.withColumn("x", F.hash("text")).select("k", "x", "train", "text").mapInArrow(send, "shard int, message long, docs int, data binary")
    shape = "message long, docs int, own boolean, data binary"
    # the documents' rows are dealt out by message, not gathered as one shard
    spot = F.when(F.col("shard") < 0, -1 - F.pmod("message", F.lit(shards))).otherwise(F.col("shard"))
    parts = sent.union(counts).withColumn("spot", spot.cast("int")).groupBy("spot").applyInArrow(shard, shape)
    whole = parts.groupBy("message").applyInArrow(gather, "k long, x int, train boolean, rows long, n_tokens long, n_known long, base double, score double")
    names = [c for c, _ in SUMS]
    return whole.groupBy("k", "x", "train").agg(*[F.sum(c).alias(c) for c in names]), uni


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, at = np.unique(x, return_inverse=True)
    return values, at.astype(np.int32)


def score_shard(
    uni: Unigrams, classes: Classes, first: np.ndarray, second: np.ndarray, earlier: np.ndarray, doc: np.ndarray, learn: np.ndarray, docs: int, mu: float = MU, mu3: float = MU3
) -> dict[str, np.ndarray]:
    """Builds a shard's trie from its training trigrams and asks it for all."""
    train = learn[doc]
    contexts, a = _ranked(first)
    words, b = np.unique(second, return_inverse=True)
    bits = classes.bits_of(contexts)
    spread = np.flatnonzero(bits[a])
    if len(spread):  # their trigram contexts are by class
        label = label_of(bits[a[spread]], second[spread])
        earlier = earlier.copy()
        earlier[spread] = mix(earlier[spread] ^ mix(label + np.uint64(1)))
    befores, c = np.unique(earlier, return_inverse=True)
    del second, earlier
    pair, each = _ranked(a * np.int64(len(words)) + b)
    node, at = _ranked(a * np.int64(len(befores)) + c)
    del b, c
    third, to = _ranked(at * np.int64(len(pair)) + each)
    pair_v, pair_w = pair // len(words), pair % len(words)
    node_v, node_u = node // len(befores), node % len(befores)
    third_node, third_pair = third // len(pair), third % len(pair)

    times = np.bincount(each[train], minlength=len(pair))
    own = np.bincount(a[train], minlength=len(contexts))
    start = contexts == START
    own = np.where(bits > 0, uni.top(contexts), own)
    own[start] = uni.ends
    low = uni.log10(words)
    p = (times + mu * 10.0 ** low[pair_w]) / (own[pair_v] + mu)
    share = np.ones(len(pair))
    some = np.flatnonzero(bits[pair_v])
    if len(some):
        v, k = pair_v[some], bits[pair_v[some]]
        label = label_of(k, words[pair_w[some]])
        _, group = np.unique(v << np.int64(32) | label.astype(np.int64), return_inverse=True)
        inside = np.bincount(group, weights=times[some])
        share[some] = (inside[group] + mu * classes.share(k, label)) / (own[v] + mu)
    third_times = np.bincount(to[train], minlength=len(third))
    node_times = np.bincount(at[train], minlength=len(node))
    p3 = (third_times * share[third_pair] + mu3 * p[third_pair]) / (node_times[third_node] + mu3)

    has_v, has_pair, has_node, has_third = own > 0, times > 0, node_times > 0, third_times > 0
    rank_v, rank_pair, rank_node = (np.cumsum(x) - 1 for x in (has_v, has_pair, has_node))
    known_w, rank_w = np.unique(pair_w[has_pair], return_inverse=True)
    known_u, rank_u = np.unique(node_u[has_node], return_inverse=True)
    trie = Trie.open(
        Trie.build(
            contexts[has_v], words[known_w], befores[known_u],
            (rank_v[pair_v[has_pair]], rank_w, np.log10(p[has_pair])), np.log10(mu / (own[has_v] + mu)),
            (rank_v[node_v[has_node]], rank_u, np.log10(mu3 / (node_times[has_node] + mu3))),
            (rank_node[third_node[has_third]], rank_pair[third_pair[has_third]], np.log10(p3[has_third])),
        )
    )
    del p, p3, share, times, third_times, node_times
    v, w, u = (trie.places(x, y) for x, y in (("contexts", contexts), ("words", words), ("earlier", befores)))
    log2, place = trie.bigrams(v[pair_v], w[pair_w])
    log2 = np.where(place >= 0, log2, log2 + low[pair_w])
    context = trie.nodes(v[node_v], u[node_u])
    log3, hit = trie.trigrams(v[node_v[third_node]], context[third_node], place[third_pair])
    logp = np.where(hit, log3, log3 + log2[third_pair])
    is_word = ~start
    base = np.where(is_word, np.log10(own + 0.1), 0.0)
    return {
        "rows": np.bincount(doc, weights=start[a], minlength=docs).astype(np.int64),
        "n_tokens": np.bincount(doc, minlength=docs).astype(np.int64),
        "n_known": np.bincount(doc, weights=(is_word & (own > 0))[a], minlength=docs).astype(np.int64),
        "base": np.bincount(doc, weights=base[a], minlength=docs),
        "score": np.bincount(doc, weights=logp[to], minlength=docs),
    }


def scores(docs: DataFrame, text: str = "text", key: str = "doc_id", mu: float = MU, mu3: float = MU3) -> DataFrame:
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    found, uni = score(docs, F.crc32(name) % 10 != 0, text, key, mu, mu3)
    n = F.col("rows")
    tokens = (F.col("n_tokens") / n).cast("long")
    whole = math.log10(uni.tokens + 0.1 * (uni.kinds + 1))
    out = found.select(
        F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"),
        (~F.col("train")).alias("held_out"),
        tokens.alias("n_tokens"),
        ((F.col("n_known") / n).cast("long") + int(uni.ends > 0)).alias("n_known"),
        F.lit(uni.tokens).cast("long").alias("train_tokens"),
        (F.col("base") / n + math.log10(uni.ends + 0.1) - tokens * whole).alias("base_score"),
        (F.col("score") / n).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("copy"),
    )
    return out.drop("copy")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(load(spark, sf_dir, "documents"))
