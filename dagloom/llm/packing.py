"""Sequence packing by non-negative least squares over length patterns.

Texts become ids plus an end id, and are cut at multiples of ``SIZE``.  The
histogram of piece lengths, in units of ``UNIT`` ids, is all that is planned
on: shallow combinations of lengths that fill a window exactly are enumerated,
repeat counts are solved by non-negative least squares against the histogram
and rounded, and a greedy pass packs what is left, longest first.  Where no
piece fits a gap it cuts one, so hardly a window is left open.  The plan works
on counts; a piece finds its window by its rank among pieces of its length.
Pieces under ``SHORT`` ids are first joined end to end, within a task, into
bundles that nearly fill whole units, and a bundle is planned as one piece.

Edge cases: a null text is empty and becomes the end id alone; repeated rows
are packed each; a null id is reported as null; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.llm.common import load, small_side, stored
from dagloom.llm.ids import encoder
from dagloom.llm.words import slices

SIZE = 4096
UNIT = 16
END_ID = 2
SWEEPS = 60
#: Pieces below go into bundles; a bundle has MOST_BUNDLED ids at most, and is
#: closed from half of that on where it fills its units.
SHORT = 256
MOST_BUNDLED = 2048


def patterns(bins: int) -> list[tuple[int, ...]]:
    """Shallow combinations of lengths 1..bins that sum to bins: up to three
    parts, or one part repeated with one more to fill up."""
    out = {(bins,)}
    for a in range(1, bins):
        for b in range(1, min(a, bins - a) + 1):
            c = bins - a - b
            if c == 0:
                out.add((a, b))
            elif c <= b:
                out.add((a, b, c))
    for a in range(1, bins // 2 + 1):
        for times in range(2, bins // a + 1):
            rest = bins - a * times
            out.add(tuple(sorted([a] * times + [rest] * (rest > 0), reverse=True)))
    return sorted(out, reverse=True)


def solve(columns: list[dict[int, int]], want: np.ndarray, sweeps: int = SWEEPS) -> list[float]:
    """Minimises |A x - want| over x >= 0 by coordinate descent; columns: the
    non-zero entries of A's columns."""
    rest = want.astype(float).tolist()
    norm = [sum(v * v for v in c.values()) for c in columns]
    items = [list(c.items()) for c in columns]
    x = [0.0] * len(columns)
    live = range(len(columns))
    for sweep in range(sweeps):
        moved = 0.0
        for p in live:
            g = 0.0
            for b, v in items[p]:
                g += v * rest[b]
            step = max(-x[p], g / norm[p])
            if step:
                x[p] += step
                moved += abs(step)
                for b, v in items[p]:
                    rest[b] -= v * step
        if moved < 1e-3 * max(1.0, sum(x)):
            break
        if sweep % 10 == 9:  # mostly settled columns are looked at now and then
            live = [p for p in range(len(columns)) if x[p] > 0] if sweep % 20 == 9 else range(len(columns))
    return x


@dataclass
class Plan:
    """Ranges of ranks by length bin: where they go.  A cut range gives its
    pieces' heads away and sends their tails on to another bin's ranks."""

    bins: int
    total: list[int]
    used: list[int]
    windows: int = 0
    ranges: list[tuple[int, int, int, int, int, int, int]] = field(default_factory=list)

    def left(self, b: int) -> int:
        return self.total[b] - self.used[b]

    def place(self, slots: list[tuple[int, int]], times: int) -> None:
        """times windows with these slots: (bin, 0) or, cut, (bin, head)."""
        for slot, (b, head) in enumerate(slots):
            tail, rank = 0, 0
            if head:
                tail, rank = b - head, self.total[b - head]
                self.total[tail] += times
            self.ranges.append((b, self.used[b], self.windows, slot, head, tail, rank))
            self.used[b] += times
        self.windows += times


def make_plan(histogram: np.ndarray) -> Plan:
    """histogram[b]: pieces of b units, b = 0 .. bins (none at 0)."""
    bins = len(histogram) - 1
    plan = Plan(bins, [int(x) for x in histogram], [0] * (bins + 1))
    plan.place([(bins, 0)], plan.left(bins)) if plan.left(bins) else None
    have = [b > 0 and plan.left(b) > 0 for b in range(bins + 1)]
    shapes = [p for p in patterns(bins) if len(p) > 1 and all(have[b] for b in p)]
    columns = [{b: p.count(b) for b in set(p)} for p in shapes]
    want = np.array([plan.left(b) for b in range(bins + 1)])
    x = solve(columns, want) if columns else []
    for p in sorted(range(len(shapes)), key=lambda p: -x[p]):
        times = min([int(x[p] + 0.5), *(plan.left(b) // n for b, n in columns[p].items())])
        if times > 0:
            plan.place([(b, 0) for b in shapes[p]], times)
    while True:  # the rest, longest first
        b = next((b for b in range(bins, 0, -1) if plan.left(b)), 0)
        if not b:
            return plan
        slots, gap, take = [(b, 0)], bins - b, {b: 1}
        while gap:
            free = lambda c: plan.left(c) - take.get(c, 0) > 0
            c = next((c for c in range(gap, 0, -1) if free(c)), 0)
            if c:
                slots.append((c, 0))
                gap -= c
            else:
                c = next((c for c in range(gap + 1, bins) if free(c)), 0)
                if not c:
                    break
                slots.append((c, gap))
                gap = 0
            take[c] = take.get(c, 0) + 1
        plan.place(slots, min(plan.left(c) // n for c, n in take.items()) if gap == 0 else 1)


_RANK = np.int64(1) << 48  # ranks stay below


class Lookup:
    def __init__(self, plan: Plan):
        rows = np.array(sorted(plan.ranges), np.int64).reshape(-1, 7)
        self.key = rows[:, 0] * _RANK + rows[:, 1]
        self.first, self.window, self.slot, self.head, self.tail, self.rank = rows[:, 1:].T

    def assign(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Yields (row, start in the piece, length, window, slot) until every
        id of the pieces has its place."""
        row, start = np.arange(len(length)), np.zeros(len(length), np.int64)
        while len(row):
            b = -(-length // UNIT)
            at = np.searchsorted(self.key, b * _RANK + rank, "right") - 1
            cut = self.head[at] > 0
            part = np.where(cut, self.head[at] * UNIT, length)
            step = rank - self.first[at]
            yield row, start, part, self.window[at] + step, self.slot[at]
            rank = (self.rank[at] + step)[cut]
            row, start, length = row[cut], (start + part)[cut], (length - part)[cut]


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, doc_tokens, part, bin, rank, ids, inner): pieces
    of at most SIZE ids and bundles of short ones; rank counts a task's pieces of
    one bin; ids are uint16; inner has a bundle's pieces, a row of int64 each of
    has an id, id, start, length, doc_tokens."""
    names = ["doc_id", "start", "length", "doc_tokens", "part", "bin", "rank", "ids", "inner"]
    kinds = (pa.int64(),) * 4 + (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = [0] * (SIZE // UNIT + 1)
        end = np.array([END_ID], np.uint16).tobytes()
        out, short, held = [], [], 0  # rows; pieces of the open bundle, their ids

        def add(k: int | None, start: int, size: int, n: int, ids: bytes, inner: bytes | None = None) -> None:
            kind = -(-size // UNIT)
            out.append((k, start, size, n, part, kind, seen[kind], ids, inner))
            seen[kind] += 1

        def close() -> None:
            nonlocal short, held
            inner = np.array([(k is not None, k or 0, start, size, n) for k, start, size, n, _ in short], np.int64)
            add(None, 0, held, 0, b"".join(x[-1] for x in short), inner.tobytes())
            short, held = [], 0

        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                flat, sizes = code.encode(b.column(1))
                stop = np.cumsum(sizes)
                for k, low, high in zip(b.column(0).to_pylist(), (stop - sizes).tolist(), stop.tolist()):
                    ids = flat[low:high].tobytes() + end
                    n = high - low + 1
                    for start in range(0, n, SIZE):
                        size = min(SIZE, n - start)
                        one = ids[2 * start : 2 * (start + size)]
                        if size >= SHORT:
                            add(k, start, size, n, one)
                            continue
                        if held + size > MOST_BUNDLED:
                            close()
                        short.append((k, start, size, n, one))
                        held += size
                        if held >= MOST_BUNDLED // 2 and held % UNIT == 0:
                            close()
                if out:
                    yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)
                    out.clear()
        if held:
            close()
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, part int, bin int, rank long, ids binary, inner binary")


def _members(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each row's first place among all pieces of the batch (and their number),
    and the pieces: has an id, id, start, length, doc_tokens, place in the row."""
    doc = b.column("doc_id")
    plain = np.stack([np.array(doc.is_valid()), np.array(doc.fill_null(0)), *(np.array(b.column(c)) for c in ("start", "length", "doc_tokens"))], axis=1).astype(np.int64)
    every = [plain[i : i + 1] if x is None else np.frombuffer(x, np.int64).reshape(-1, 5) for i, x in enumerate(b.column("inner").to_pylist())]
    first = np.concatenate([[0], np.cumsum([len(x) for x in every])])
    found = np.concatenate(every)
    ends = np.cumsum(found[:, 3])
    begin = ends - found[:, 3]
    return first, np.column_stack([found, begin - np.repeat(begin[first[:-1]], np.diff(first))])


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text: str = "text", key: str = "doc_id", name: str = "packing", with_ids: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) and,
    unless left out, the pieces' ids as uint16; the checksum is of the ids as
    little-endian uint32."""
    cut = stored(pieces(docs, tokenizer, text, key), f"{name}-pieces")
    by_part = stored(cut.groupBy("bin", "part").agg(F.count("*").alias("n")), f"{name}-counts")
    histogram = np.zeros(SIZE // UNIT + 1, np.int64)
    for r in by_part.groupBy("bin").agg(F.sum("n").alias("n")).collect():
        histogram[r["bin"]] = r["n"]
    lookup = Lookup(make_plan(histogram))
    order = Window.partitionBy("bin").orderBy("part")
    base = by_part.select("bin", "part", (F.sum("n").over(order) - F.col("n")).alias("base"))
    ranked = cut.join(small_side(stored(base, f"{name}-bases")), ["bin", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                first, member = _members(b)
                ids = b.column("ids").to_pylist()
                for row, begin, size, window, slot in lookup.assign(np.array(b.column("length")), np.array(b.column("rank")) + np.array(b.column("base"))):
                    n = first[row + 1] - first[row]
                    of = np.repeat(np.arange(len(row)), n)
                    inner = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    has, doc, start, length, total, place = member[first[row][of] + inner].T
                    low, high = np.maximum(begin[of], place), np.minimum((begin + size)[of], place + length)
                    in_part = high > low
                    of, inner, has, doc, start, total, place, low, high = (x[in_part] for x in (of, inner, has, doc, start, total, place, low, high))
                    some = [ids[r][2 * a : 2 * z] for r, a, z in zip(row[of].tolist(), low.tolist(), high.tolist())]
                    crc = [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in some]
                    columns = [pa.array(doc, pa.int64(), mask=has == 0), pa.array(start + low - place), pa.array(high - low), pa.array(crc, pa.int64()),
                               pa.array(total), pa.array(window[of]), pa.array((slot[of] * SIZE + inner).astype(np.int32))]
                    yield pa.record_batch(columns + [pa.array(some, pa.binary())] * with_ids, names)

    shape = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot int" + ", ids binary" * with_ids
    names = [x.split()[0] for x in shape.split(", ")]
    placed = ranked.mapInArrow(run, shape)
    before = Window.partitionBy("sequence_id").orderBy("slot")
    return placed.withColumn("offset", F.sum("length").over(before) - F.col("length")).drop("slot")


def packed_digests(docs: DataFrame, name: str = "packing") -> DataFrame:
    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    return pack(docs, name=name, with_ids=False).select(*columns)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(load(spark, sf_dir, "documents"), "op6")
