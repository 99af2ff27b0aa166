"""Suffix-array dedup of bytes.

A byte goes if it lies in a string of ``LENGTH`` bytes of one document that also
starts earlier (smaller doc_id, or the same document further ahead).

A sparse suffix array over all texts.  Suffixes stand where the hash of their
leading token, ``TOKEN`` bytes, is the smallest of ``REACH`` + 1 neighbouring
places (the leftmost of equal ones), so every string of LENGTH bytes holds one,
and equal strings hold it at the same place.  A suffix answers for the strings
that it is the smallest of: they begin ``near`` to ``far`` bytes before it.

Suffixes whose leading token occurs once are dropped, by a filter of bounded
size.  The others are range-partitioned by splitters between leading tokens of
a sample.  A bucket sorts its suffixes, and the texts before them read
backwards, by multikey quicksort over words of eight bytes, all runs of a depth
at once.  For each offset o, equal strings are those whose suffixes share 100 -
o bytes and whose texts before share o, as the common prefixes of neighbours in
the two orders say; all but the first of them are covered.  No hash decides
here.

Suffixes of one leading token always meet in one bucket, unless there are too
many (their exact counts are known): those are dealt to several buckets, and
what is first in its bucket is compared across buckets by 128 bits of hash.

Whole copies of a text need no suffixes: each but the first goes, if it has
LENGTH bytes.

Edge cases: a null text has no bytes; a null id counts as the smallest; rows
that repeat a doc_id and its text count as one place and stay alike; rows that
share a doc_id but not the text come in the order of a hash of the text; extra
columns are ignored or, in ``without_repeated_bytes``, kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.common import KeyFilter, digest, id_key, key_filter, load, small_side, stored
from dagloom.llm.words import mix, powers, slices, text_bytes

LENGTH = 100
TOKEN = 54
REACH = LENGTH - TOKEN
#: Rows that a bucket is meant to have, and buckets at most: splitters are
#: broadcast.  Fuller buckets are worked off in runs of whole leading tokens.
BUCKET_ROWS = 120_000
MOST_BUCKETS = 16_384
#: Sampled leading tokens for each bucket.
SAMPLE = 16
#: Rows of one leading token from which on they may be dealt out.
HOT_ROWS = 1_000
#: Numbers in broadcast lists of spans at most; beyond, the join is shuffled.
BROADCAST_NUMBERS = 16_000_000

_BLOCK = 1 << 17
_MASK = np.uint64((1 << 18) - 1)
_rng = np.random.default_rng(20240311)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POW = powers(np.uint64(_BASE), _BLOCK + LENGTH)
_BACK = powers(np.uint64(pow(_BASE, -1, 1 << 64)), _BLOCK + LENGTH)
_SIDES = _rng.integers(1, 1 << 63, (2, LENGTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Anchors:
    """Suffixes by place: of each the hash of its leading token, and the first
    and the last string that it answers for."""

    at: np.ndarray
    h: np.ndarray
    first: np.ndarray
    last: np.ndarray


def anchors(raw: np.ndarray, off: np.ndarray) -> Anchors:
    """The suffixes of the texts at off, by places in raw."""
    n = len(raw)
    outside = np.zeros(n + 1, np.int8)  # strings that would leave their text
    low, high = np.maximum(off[:-1], off[1:] - (LENGTH - 1)), off[1:]
    some = low < high
    outside[low[some]] += 1  # texts don't overlap, so no place is met twice
    outside[high[some]] -= 1
    inside = np.cumsum(outside[:-1], dtype=np.int8) == 0
    out = []
    for a in range(0, max(n - LENGTH + 1, 0), _BLOCK):
        block = raw[a : a + _BLOCK + LENGTH - 1]
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(_BYTE.take(block) * _POW[: len(block)], out=sums[1:])
        h = mix((sums[TOKEN:] - sums[:-TOKEN]) * _BACK[: len(block) - TOKEN + 1])
        low = h & ~_MASK | np.arange(len(h), dtype=np.uint64)
        step = 1
        while 2 * step <= REACH + 1:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        rest = REACH + 1 - step
        low = np.minimum(low[: len(low) - rest], low[rest:])
        start = np.flatnonzero(inside[a : a + len(low)])
        if not len(start):
            continue
        at = (low[start] & _MASK).astype(np.int64)
        new = np.flatnonzero(np.diff(at, prepend=-1))
        out.append((at[new] + a, h[at[new]], start[new] + a, start[np.append(new[1:], len(start)) - 1] + a))
    if not out:
        z = np.zeros(0, np.int64)
        return Anchors(z, np.zeros(0, np.uint64), z, z)
    at, h, first, last = (np.concatenate(x) for x in zip(*out))
    new = np.flatnonzero(np.diff(at, prepend=-1))  # one may end a block and begin the next
    return Anchors(at[new], h[new], first[new], last[np.append(new[1:], len(at)) - 1])


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            h, n = np.unique(anchors(*text_bytes(b.column("text"))).h, return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def _share(a: Anchors, doc: np.ndarray, k: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A number for each suffix that depends on its place only."""
    return mix(k[doc].view(np.uint64) * np.uint64(_BASE) + (a.at - off[doc]).astype(np.uint64))


def _kept_anchors(b: pa.RecordBatch, several: KeyFilter) -> tuple[np.ndarray, np.ndarray, Anchors, np.ndarray, np.ndarray]:
    raw, off = text_bytes(b.column("text"))
    a = anchors(raw, off)
    some = several.may_hold(a.h)
    a = Anchors(a.at[some], a.h[some], a.first[some], a.last[some])
    doc = np.searchsorted(off, a.at, "right") - 1
    k = np.array(b.column("k")).astype(np.int64)
    return raw, off, a, doc, _share(a, doc, k, off)


def _leads(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(raw, TOKEN)[at].view(f"S{TOKEN}")[:, 0] if len(at) else np.zeros(0, f"S{TOKEN}")


def _sampled_leads(several: Broadcast, share: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, _, a, _, dice = _kept_anchors(b, several.value)
                leads = _leads(raw, a.at[dice <= np.uint64(min(share, 1) * (2**64 - 2**11))])
                yield pa.record_batch([pa.array(leads.tolist(), pa.binary())], ["lead"])

    return run


def _suffix_rows(several: Broadcast, splitters: Broadcast, hot: Broadcast, spare: int) -> Callable:
    """Makes the rows of suffixes that several, a filter, may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, off, a, doc, dice = _kept_anchors(b, several.value)
                wide = np.concatenate([np.zeros(REACH, np.uint8), raw, np.zeros(LENGTH, np.uint8)])
                for i in range(0, len(a.at), 50_000):
                    at, h, d = a.at[i : i + 50_000], a.h[i : i + 50_000], doc[i : i + 50_000]
                    near, far = at - a.last[i : i + 50_000], at - a.first[i : i + 50_000]
                    ctx = np.lib.stride_tricks.sliding_window_view(wide, REACH + LENGTH)[at]
                    place = np.arange(-REACH, LENGTH)  # what no string needs is blank
                    ctx[(place < -far[:, None]) | (place >= LENGTH - near[:, None])] = 0
                    bucket = np.searchsorted(splitters.value, _leads(raw, at), "right")
                    if len(hot.value):
                        is_hot = hot.value[np.minimum(np.searchsorted(hot.value, h), len(hot.value) - 1)] == h
                        bucket = np.where(is_hot, len(splitters.value) + 1 + dice[i : i + 50_000] % np.uint64(max(spare, 1)), bucket)
                    data = pa.py_buffer(np.ascontiguousarray(ctx))
                    ends = pa.py_buffer((np.arange(len(at) + 1) * (REACH + LENGTH)).astype(np.int32))
                    row = pa.array(d)
                    yield pa.record_batch(
                        [
                            pa.array(bucket.astype(np.int32)),
                            pa.array(h.view(np.int64)),
                            b.column("k").take(row),
                            b.column("x").take(row),
                            pa.array((at - off[d]).astype(np.int32)),
                            pa.array(near.astype(np.int8)),
                            pa.array(far.astype(np.int8)),
                            pa.Array.from_buffers(pa.binary(), len(at), [None, ends, data]),
                        ],
                        ["b", "h", "k", "x", "at", "near", "far", "ctx"],
                    )

    return run


def multikey_order(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of a matrix of bytes, and how many leading bytes
    each has in common with the one before it in that order.

    Multikey quicksort: runs that are equal so far are sorted by their next word
    alone and split where it differs; all runs of one depth at a time."""
    n, width = m.shape
    words = np.zeros((n, -(-width // 8) * 8), np.uint8)
    words[:, :width] = m
    words = words.view(">u8")
    order = np.arange(n)
    begins = np.zeros(n + 1, bool)
    begins[[0, n]] = True
    for depth in range(words.shape[1]):
        open_ = np.flatnonzero(~(begins[:-1] & begins[1:]))
        if not len(open_):
            break
        run = np.cumsum(begins[:-1])[open_]
        word = words[order[open_], depth].astype(np.uint64)
        by = np.lexsort((word, run))
        order[open_] = order[open_][by]
        word = word[by]
        begins[open_[1:]] |= (word[1:] != word[:-1]) & (run[1:] == run[:-1])
    sorted_ = m[order]
    common = np.zeros(n, np.int64)
    differ = sorted_[1:] != sorted_[:-1]
    common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, common


def _first_of(key: np.ndarray) -> np.ndarray:
    """For each key the index of the first that equals it."""
    by = np.argsort(key, kind="stable")
    new = np.diff(key[by], prepend=-1) != 0
    out = np.empty(len(key), np.int64)
    out[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _string_hashes(ctx: np.ndarray) -> np.ndarray:
    """Two hashes of each row of LENGTH bytes."""
    return mix((ctx[None].astype(np.uint64) * _SIDES[:, None]).sum(axis=2, dtype=np.uint64))


def repeats_in(ctx: np.ndarray, k: np.ndarray, x: np.ndarray, at: np.ndarray, near: np.ndarray, far: np.ndarray, spread: bool) -> tuple[np.ndarray, ...]:
    """Rows in the order of places.  For each the smallest and the largest
    offset at which an earlier row has the same string (low > high if there is
    none), and, if spread, rows and offsets that are first here."""
    n = len(k)
    ranks, commons = [], []
    for side in (ctx[:, REACH:], ctx[:, :REACH][:, ::-1]):
        order, common = multikey_order(np.ascontiguousarray(side))
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append(rank)
        commons.append(common)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    leaders: list[tuple[np.ndarray, np.ndarray]] = []
    for o in range(REACH + 1):
        rows = np.flatnonzero((near <= o) & (o <= far))
        if not len(rows):
            continue
        after = np.cumsum(commons[0] < LENGTH - o)[ranks[0][rows]]
        before = np.cumsum(commons[1] < o)[ranks[1][rows]]
        lead = rows[_first_of(after * (n + 1) + before)]
        later = rows[(k[rows] != k[lead]) | (x[rows] != x[lead]) | (at[rows] != at[lead])]
        low[later] = np.minimum(low[later], o)
        high[later] = o
        if spread:
            own = rows[lead == rows]
            leaders.append((own, np.full(len(own), o)))
    some = [np.concatenate(z) for z in zip(*leaders)] if leaders else [np.zeros(0, np.int64)] * 2
    return low, high, *some


def _compare(buckets: int) -> Callable:
    """Spans that earlier strings cover, from rows sorted by their leading
    token's hash; of dealt-out rows also the strings that are first here."""

    def work(rows: pa.Table, spread: bool) -> Iterator[pa.RecordBatch]:
        of = lambda c: rows.column(c).to_numpy().astype(np.int64)
        h = of("h")
        _, back, times = np.unique(h, return_inverse=True, return_counts=True)
        some = np.flatnonzero(times[back] > 1) if not spread else np.arange(len(h))
        k, x, at, near, far = (of(c)[some] for c in ("k", "x", "at", "near", "far"))
        by = np.lexsort((at, x, k))
        k, x, at, near, far = k[by], x[by], at[by], near[by], far[by]
        column = rows.column("ctx").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        width = REACH + LENGTH
        data = np.frombuffer(column.buffers()[2], np.uint8, len(column) * width, column.offset * width).reshape(-1, width)
        ctx = data[some[by]]
        low, high, lead, o = repeats_in(ctx, k, x, at, near, far, spread)
        hit = np.flatnonzero(low <= high)
        none = pa.nulls(len(hit), pa.int64())
        names = ["g", "g2", "k", "x", "lo", "hi"]
        i32 = lambda v: pa.array(v.astype(np.int32))
        yield pa.record_batch([none, none, pa.array(k[hit]), pa.array(x[hit]), i32(at[hit] - high[hit]), i32(at[hit] - low[hit] + LENGTH)], names)
        for i in range(0, len(lead), 20_000):
            r, p = lead[i : i + 20_000], o[i : i + 20_000]
            strings = np.take_along_axis(ctx[r], REACH - p[:, None] + np.arange(LENGTH), axis=1)
            g = _string_hashes(strings).view(np.int64)
            yield pa.record_batch([pa.array(g[0]), pa.array(g[1]), pa.array(k[r]), pa.array(x[r]), i32(at[r] - p), i32(at[r] - p + LENGTH)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            count += b.num_rows
            if count < BUCKET_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            spread = rows.column("b")[0].as_py() >= buckets
            h = rows.column("h").to_numpy()
            cut = count if spread else int(np.searchsorted(h, h[-1]))  # whole tokens only
            if cut:
                yield from work(rows.slice(0, cut), spread)
                held, count = (rows.slice(cut).to_batches() if cut < count else []), count - cut
        if held:
            rows = pa.Table.from_batches(held)
            yield from work(rows, rows.column("b")[0].as_py() >= buckets)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a text, sorted and joined where they touch: lo, hi, lo, hi, .."""
    for b in batches:
        out = []
        for i in range(b.num_rows):
            flat = b.column("spans")[i].values
            lo, hi = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            by = np.argsort(lo, kind="stable")
            lo, hi = lo[by], np.maximum.accumulate(hi[by])
            new = np.append(True, lo[1:] > hi[:-1])
            ends = np.append(np.flatnonzero(new)[1:], len(lo)) - 1
            out.append(np.stack([lo[new], hi[ends]], axis=1).ravel())
        yield pa.record_batch([b.column("k"), b.column("x"), pa.array(out, pa.list_(pa.int32()))], ["k", "x", "spans"])


def _rows(docs: DataFrame, text: str, key: str, *more: Column) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(*more, id_key(key).alias("k"), whole.alias("text")).withColumns({"t": digest("text"), "x": F.xxhash64("text")})


def _splitters(own: DataFrame, several: Broadcast, buckets: int, total: int) -> np.ndarray:
    """Leading tokens between buckets, evenly spaced in a sample."""
    share = SAMPLE * buckets / total
    texts = min(1.0, 8 * share)
    leads = own.select("text", "k").sample(texts, 5).mapInArrow(_sampled_leads(several, share / texts), "lead binary")
    found = np.sort(np.array([bytes(r["lead"]) for r in leads.toLocalIterator()], f"S{TOKEN}"))
    if not len(found):
        return found
    return np.unique(found[np.arange(1, buckets) * len(found) // buckets])


def find_repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", name: str = "suffixes") -> tuple[DataFrame, DataFrame]:
    """Two stored tables: copies (t, first), of texts that more than one id has,
    and covered (k, x, spans), where other texts are covered: a list lo, hi, .."""
    spark = docs.sparkSession
    rows = _rows(docs, text, key)
    copies = stored(
        rows.groupBy("t").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("last > first").select("t", "first"),
        f"{name}-copies",
    )
    own = rows.join(small_side(copies), "t", "left").where("first is null or first = k").select("k", "x", "text")
    counts = own.select("text").mapInArrow(_token_counts, "h long, n long")
    twice = stored(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), f"{name}-tokens")
    total = twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not total:
        return copies, rows.limit(0).select("k", "x", F.array().cast("array<int>").alias("spans"))
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS + 1))
    # at most 2^20 tokens can have more rows than this
    many = max(total >> 20, min(BUCKET_ROWS // 2, max(HOT_ROWS, 2 * total // buckets)))
    hot = np.array(sorted(r["h"] for r in twice.where(F.col("n") > many).toLocalIterator()), np.int64).view(np.uint64)
    hot_rows = twice.where(F.col("n") > many).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    several = spark.sparkContext.broadcast(key_filter(twice, "h"))
    splitters = _splitters(own, several, buckets, total)
    spare = -(-int(hot_rows) * buckets // total)
    buckets = len(splitters) + 1
    make = _suffix_rows(several, spark.sparkContext.broadcast(splitters), spark.sparkContext.broadcast(np.sort(hot)), spare)
    suffixes = own.mapInArrow(make, "b int, h long, k long, x long, at int, near byte, far byte, ctx binary")
    dealt = suffixes.repartitionById(buckets + spare, "b").sortWithinPartitions("h")
    found = stored(dealt.mapInArrow(_compare(buckets), "g long, g2 long, k long, x long, lo int, hi int"), f"{name}-spans")
    spans = found.where("g is null").select("k", "x", "lo", "hi")
    if spare:
        strings = found.where("g is not null")
        first = strings.groupBy("g", "g2").agg(F.min(F.struct("k", "x", "lo")).alias("f"), F.count("*").alias("c")).where("c > 1")
        first = stored(first.select("g", "g2", F.col("f.k").alias("fk"), F.col("f.x").alias("fx"), F.col("f.lo").alias("flo")), f"{name}-first")
        later = strings.join(small_side(first), ["g", "g2"]).where("fk <> k or fx <> x or flo <> lo")
        spans = spans.unionByName(later.select("k", "x", "lo", "hi"))
    covered = spans.groupBy("k", "x").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return copies, stored(covered.mapInArrow(_merged, "k long, x long, spans array<int>"), f"{name}-covered")


def _spans(size: int, spans: np.ndarray | None, copy: bool) -> np.ndarray:
    """(n, 2): where bytes go."""
    if copy:
        return np.array([[0, size]] if size >= LENGTH else [], np.int64).reshape(-1, 2)
    return np.zeros((0, 2), np.int64) if spans is None else spans.reshape(-1, 2)


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _with_spans(docs: DataFrame, text: str, key: str) -> DataFrame:
    copies, covered = find_repeated_bytes(docs, text, key)
    rows = _rows(docs, text, key, F.struct("*").alias("row"))
    rows = rows.join(small_side(copies), "t", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("k"), F.lit(False)))
    total = covered.agg(F.coalesce(F.sum(F.size("spans") + 8), F.lit(0)).alias("n")).first()["n"]
    return rows.join(F.broadcast(covered) if total <= BROADCAST_NUMBERS else covered, ["k", "x"], "left")


def _each(b: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray]]:
    """The text's bytes and its spans, from the columns text, copy and spans."""
    for i in range(b.num_rows):
        raw, flat = b.column("text")[i].as_py().encode(), b.column("spans")[i].values
        yield raw, _spans(len(raw), None if flat is None else flat.to_numpy(), b.column("copy")[i].as_py())


def repeated_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256) of every row; spans: lo, hi, lo, ..
    of the maximal runs of bytes that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(len(raw), s.ravel(), hashlib.sha256(_kept(raw, s)).hexdigest()) for raw, s in _each(b)]
            columns = list(zip(*out)) or [()] * 3
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.string())
            yield pa.record_batch([b.column(0), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], ["doc_id", "n_bytes", "spans", "kept_sha256"])

    rows = _with_spans(docs, text, key)
    rows = rows.select(F.col(f"row.{key}").cast("long").alias("doc_id"), "text", "copy", "spans")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, spans array<long>, kept_sha256 string")


def without_repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the covered bytes of their texts; a character of which some
    bytes go, goes whole; a text that loses nothing stays as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_kept(raw, s).decode(errors="ignore") for raw, s in _each(b)]
            yield pa.record_batch([b.column("row"), pa.array(out, pa.string())], ["row", "text"])

    rows = _with_spans(docs, text, key).select("row", "text", "copy", "spans")
    done = rows.mapInArrow(run, f"row {docs.schema.simpleString()}, text string")
    return done.select(*[F.when(F.col("row")[c].isNull(), F.lit(None)).otherwise(F.col("text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = F.transform("spans", lambda v, i: F.when(i % 2 == 1, v).otherwise(-v))
    spans = repeated_spans(load(spark, sf_dir, "documents"))
    return spans.select(
        "doc_id",
        "n_bytes",
        F.aggregate(ends, F.lit(0).cast("long"), lambda total, v: total + v).alias("n_removed"),
        (F.size("spans") / 2).cast("long").alias("n_spans"),
        "kept_sha256",
    )
