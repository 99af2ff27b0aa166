"""Token-id files: an adaptive context-mixing range coder in blocks.

A block holds whole documents, about ``BLOCK_IDS`` ids, and can be read without
any other: every model starts anew, and checksums cover the coded bytes and the
ids.  Within a block the ids are split into up to ``LANES`` runs of neighbours
which are coded side by side, one id of each run at a step; all runs share the
models, which learn after each step.  So numpy works on whole steps.

A block lists its distinct ids, frequent ones first.  An id is coded as its place
in that list, as digits to base 16, the highest first.  Each digit is predicted
from counts under no context (order 0), the id before (order 1) and the two ids
before (order 2), always with the digits already known; rows of counts of orders
1 and 2 are found by a hash, and contexts that fall together share one.  The
three distributions are mixed with weights that depend on how often each context
was seen, and which learn from the share that each order had in the chance of
the digit that came (the expectation step of a mixture).  Frequencies come from
single steps of IEEE arithmetic on elements and from exact sums of whole numbers,
so any machine decodes alike.

A file is a Parquet table of blocks, in ascending order of doc_id over the
parts and within them; blocks list their documents' ids and lengths.

Edge cases: a null text is empty and becomes the end id alone; a null doc_id
sorts first and stays null; rows that repeat a doc_id are ordered by a digest
of the text; extra columns are ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.llm.common import NULL_ID, id_key, load, stored
from dagloom.llm.ids import encoder
from dagloom.llm.words import slices

MAGIC = b"TIDB"
VERSION = 2
BLOCK_IDS = 1 << 20
LANES = 4096
LEAST_STEPS = 256
END_ID = 2

# range coder: 48-bit low and range, 16 bits out at a time
_MASK = np.uint64((1 << 48) - 1)
_TOP = np.uint64(1 << 32)
_BOT = np.uint64((1 << 28) - 1)
_W, _W16 = np.uint64(32), np.uint64(16)

# models: rows of the hashed tables (as powers of two), where counts are halved
ROWS_1, ROWS_2 = 18, 20
MOST_1, MOST_2 = 1000, 250
SCALE = 1 << 15
LEAST_WEIGHT = 64
LEARN_ALL, LEARN_EACH = 32, 4

_UPTO = np.triu(np.ones((16, 16), np.float32))
_BITS = np.array([min(n.bit_length(), 7) for n in range(128)])


def _row_sums(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", x)


def _running_sums(x: np.ndarray) -> np.ndarray:
    """Along rows.  Products this small stay in the calling thread: BLAS threads
    would double the CPU time."""
    out = np.empty_like(x)
    for k in range(0, len(x), 512):
        np.matmul(x[k : k + 512], _UPTO, out=out[k : k + 512])
    return out


class Models:
    """What has been learned of a block so far."""

    def __init__(self, levels: int) -> None:
        self.zero = [np.zeros((16**k, 16), np.int64) for k in range(levels)]
        self.one = np.zeros((1 << ROWS_1, 16), np.uint16)
        self.two = np.zeros((1 << ROWS_2, 16), np.uint16)
        self.weight = np.full((3, levels * 64), SCALE // 3, np.int64)
        self.step = -1

    def after(self, before: np.ndarray, last: np.ndarray) -> None:
        """Sets the contexts of the next id."""
        self.step += 1
        self.hash1 = last.astype(np.uint32) * np.uint32(0x9E3779B1)
        self.hash2 = (self.hash1 ^ (before.astype(np.uint32) * np.uint32(0x85EBCA6B) + np.uint32(1))) * np.uint32(0xC2B2AE35)
        self.row = np.arange(len(last)) * 16

    def predict(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies of the digits and their running sums; node: the digits
        known of the id, as a number."""
        self.level, self.node = level, node
        place = (node + 16**level).astype(np.uint32) * np.uint32(0x85EBCA77)
        self.at1 = ((self.hash1 ^ place) * np.uint32(0x27D4EB2F) >> np.uint32(32 - ROWS_1)).astype(np.int64)
        self.at2 = ((self.hash2 ^ place) * np.uint32(0x165667B1) >> np.uint32(32 - ROWS_2)).astype(np.int64)
        zero = self.zero[level]
        share = (zero / np.maximum(zero.sum(1, keepdims=True), 1)).astype(np.float32)
        part0 = share.take(node, 0)
        part1, part2 = self.one.take(self.at1, 0).astype(np.float32), self.two.take(self.at2, 0).astype(np.float32)
        seen1, seen2 = _row_sums(part1), _row_sums(part2)
        self.set = level * 64 + _BITS.take(seen1.astype(np.int64), mode="clip") * 8 + _BITS.take(seen2.astype(np.int64), mode="clip")
        weight = [w.take(self.set) for w in self.weight.astype(np.float32)]
        part0 *= weight[0][:, None]
        part1 *= (weight[1] / np.maximum(seen1, np.float32(1)))[:, None]
        part2 *= (weight[2] / np.maximum(seen2, np.float32(1)))[:, None]
        self.parts = part0, part1, part2
        f = part0 + part1
        f += part2
        np.floor(f, out=f)
        f += np.float32(1)
        self.frequency = f
        return f, _running_sums(f)

    def learn(self, digit: np.ndarray) -> None:
        came = self.row + digit
        if self.step < LEARN_ALL or self.step % LEARN_EACH == 0:
            size = self.weight.shape[1]
            f = self.frequency.ravel().take(came)
            n = np.bincount(self.set, minlength=size)
            on = np.flatnonzero(n)
            for w, part in zip(self.weight, self.parts):
                share = np.floor(part.ravel().take(came) * np.float32(SCALE) / f)
                mean = np.bincount(self.set, share, size).astype(np.int64)[on] // n[on]
                w[on] = np.maximum(w[on] + (mean - w[on]) * np.minimum(n[on], 64) // 256, LEAST_WEIGHT)
        zero = self.zero[self.level]
        zero += np.bincount(self.node * 16 + digit, minlength=zero.size).reshape(zero.shape)
        for table, at, most in ((self.one, self.at1, MOST_1), (self.two, self.at2, MOST_2)):
            flat, cell = table.reshape(-1), at * 16 + digit
            np.add.at(flat, cell, np.uint16(1))
            high = flat.take(cell) > most
            if high.any():
                table[np.unique(at[high])] >>= np.uint16(1)


def _shape(n: int) -> tuple[np.ndarray, int]:
    """Lengths of the runs that n ids are split into, and the greatest."""
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    size = np.full(lanes, n // lanes, np.int64)
    size[: n % lanes] += 1
    return size, int(size[0]) if n else 0


def _digits(distinct: int) -> int:
    levels = 1
    while 16**levels < distinct:
        levels += 1
    return levels


class _Coder:
    def __init__(self, lanes: int):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, _MASK, np.uint64)

    def ready(self, n: int) -> Iterator[np.ndarray]:
        """Lanes that shift 16 bits out, until all have range enough."""
        low, wide = self.low[:n], self.range[:n]
        at = np.flatnonzero(((low ^ (low + wide)) < _TOP) | (wide <= _BOT))
        while len(at):
            # where the top isn't settled the range ends at the next border
            a, w = low[at], wide[at]
            w = np.where((a ^ (a + w)) < _TOP, w, (~a + np.uint64(1)) & _BOT)
            yield at
            low[at] = a = (a << _W16) & _MASK
            wide[at] = w = (w << _W16) & _MASK
            at = at[((a ^ (a + w)) < _TOP) | (w <= _BOT)]


def encode_ids(ids: np.ndarray) -> bytes:
    """Coded form of ids (each under 65,536)."""
    n = len(ids)
    if n and not 0 <= int(ids.min()) <= int(ids.max()) < 1 << 16:
        raise ValueError("ids of this format have 16 bits")
    size, steps = _shape(n)
    begin = np.cumsum(size) - size
    count = np.bincount(ids, minlength=1 << 16)
    order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]  # distinct ids
    place = np.empty(1 << 16, np.int64)
    place[order] = np.arange(len(order))
    symbols = place.take(ids)
    levels = _digits(len(order))
    coder, model = _Coder(len(size)), Models(levels)
    lanes, words = [], []
    before = last = np.zeros(len(size), np.int64)
    for step in range(steps):
        on = int(np.searchsorted(-size, -step, "left"))  # lanes longer than step come first
        symbol = symbols[begin[:on] + step]
        model.after(before[:on], last[:on])
        node = np.zeros(on, np.int64)
        for level in range(levels):
            digit = symbol >> 4 * (levels - 1 - level) & 15
            f, upto = model.predict(level, node)
            came = model.row + digit
            width = f.ravel().take(came).astype(np.uint64)
            start = upto.ravel().take(came).astype(np.uint64) - width
            unit = coder.range[:on] // upto[:, 15].astype(np.uint64)
            coder.low[:on] += start * unit
            coder.range[:on] = width * unit
            for at in coder.ready(on):
                lanes.append(at.astype(np.uint16))
                words.append((coder.low[at] >> _W).astype(np.uint16))
            model.learn(digit)
            node = node * 16 + digit
        before, last = last[:on], symbol
    # as few words as name a value in the range; zeros follow
    left = np.arange(len(size) if n else 0)
    for k in range(1, 4):
        unit = np.uint64(1 << 48 - 16 * k)
        value = (coder.low[left] + unit - np.uint64(1)) // unit * unit
        fits = value < coder.low[left] + coder.range[left]
        for j in range(k):
            lanes.append(left[fits].astype(np.uint16))
            words.append((value[fits] >> np.uint64(32 - 16 * j) & np.uint64(0xFFFF)).astype(np.uint16))
        left = left[~fits]
    lane, word = np.concatenate([np.zeros(0, np.uint16), *lanes]), np.concatenate([np.zeros(0, np.uint16), *words])
    length = np.bincount(lane, minlength=len(size)).astype("<u4")
    head = zlib.compress(order.astype("<u2").tobytes() + length.tobytes(), 6)
    return struct.pack("<II", len(order), len(head)) + head + word[np.argsort(lane, kind="stable")].astype("<u2").tobytes()


def decode_ids(coded: bytes, n: int) -> np.ndarray:
    size, steps = _shape(n)
    begin = np.cumsum(size) - size
    k = len(size)
    kinds, head_size = struct.unpack_from("<II", coded)
    head = zlib.decompress(coded[8 : 8 + head_size])
    distinct = np.frombuffer(head, "<u2", kinds)
    length = np.frombuffer(head, "<u4", k, 2 * kinds).astype(np.int64)
    word = np.append(np.frombuffer(coded, "<u2", offset=8 + head_size).astype(np.uint64), np.uint64(0))
    stop = np.cumsum(length)
    at = stop - length
    levels = _digits(kinds)
    coder, model = _Coder(k), Models(levels)
    code = np.zeros(k, np.uint64)

    def take(x: np.ndarray) -> None:
        code[x] = (code[x] << _W16 | word[np.where(at[x] < stop[x], at[x], -1)]) & _MASK
        at[x] += 1

    for _ in range(3):
        take(np.arange(k))
    out = np.empty(n, np.int64)
    before = last = np.zeros(k, np.int64)
    for step in range(steps):
        on = int(np.searchsorted(-size, -step, "left"))
        model.after(before[:on], last[:on])
        node = np.zeros(on, np.int64)
        for level in range(levels):
            f, upto = model.predict(level, node)
            total = upto[:, 15].astype(np.uint64)
            unit = coder.range[:on] // total
            value = np.minimum((code[:on] - coder.low[:on]) // unit, total - np.uint64(1)).astype(np.float32)
            digit = _row_sums((upto <= value[:, None]).astype(np.float32)).astype(np.int64)
            came = model.row + digit
            width = f.ravel().take(came).astype(np.uint64)
            coder.low[:on] += (upto.ravel().take(came).astype(np.uint64) - width) * unit
            coder.range[:on] = width * unit
            for x in coder.ready(on):
                take(x)
            model.learn(digit)
            node = node * 16 + digit
        out[begin[:on] + step] = node
        before, last = last[:on], node
    return distinct[out].astype(np.uint16) if n else np.empty(0, np.uint16)


def write_block(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A block: header, coded document table, coded ids."""
    table = zlib.compress(keys.astype("<i8").tobytes() + lengths.astype("<u4").tobytes(), 1)
    coded = encode_ids(ids)
    sums = zlib.crc32(coded, zlib.crc32(table)), zlib.crc32(ids.astype("<u2").tobytes())
    return MAGIC + struct.pack("<IIIIIII", VERSION, len(keys), len(ids), len(table), len(coded), *sums) + table + coded


def read_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, lengths, ids) of a block; raises if it was damaged."""
    version, docs, n, table_size, coded_size, outer, inner = struct.unpack_from("<IIIIIII", block, 4)
    if block[:4] != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    table = block[32 : 32 + table_size]
    coded = block[32 + table_size : 32 + table_size + coded_size]
    if len(coded) != coded_size or zlib.crc32(coded, zlib.crc32(table)) != outer:
        raise ValueError("a block's bytes are damaged")
    raw = zlib.decompress(table)
    ids = decode_ids(coded, n)
    if zlib.crc32(ids.astype("<u2").tobytes()) != inner:
        raise ValueError("a block's ids are damaged")
    return np.frombuffer(raw, "<i8", docs), np.frombuffer(raw, "<u4", docs, 8 * docs), ids


def write_ids(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", text: str = "text", key: str = "doc_id", name: str = "ids") -> DataFrame:
    """The stored file's blocks: (part, seq, n_ids, block)."""
    names = ["part", "seq", "n_ids", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u2").tobytes()
        keys, held, size, seq = [], [], 0, 0

        def block() -> pa.RecordBatch:
            nonlocal keys, held, size, seq
            lengths = np.array([len(x) // 2 for x in held])
            made = write_block(np.array(keys, np.int64), lengths, np.frombuffer(b"".join(held), "<u2"))
            out = pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([size], pa.int64()), pa.array([made], pa.binary())], names)
            keys, held, size, seq = [], [], 0, seq + 1
            return out

        for batch in batches:
            for b in slices(batch, "text", 2 << 20):
                flat, sizes = code.encode(b.column(1))
                stop = np.cumsum(sizes)
                for k, low, high in zip(b.column(0).to_pylist(), (stop - sizes).tolist(), stop.tolist()):
                    keys.append(k)
                    held.append(flat[low:high].tobytes() + end)
                    size += high - low + 1
                    if size >= BLOCK_IDS:
                        yield block()
        if keys:
            yield block()

    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(id_key(key).alias("k"), whole.alias("text"))
    ordered = rows.repartitionByRange("k").sortWithinPartitions("k", F.sha2("text", 256))
    return stored(ordered.mapInArrow(run, "part int, seq int, n_ids long, block binary"), name)


def read_ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of a stored file's documents."""
    by_part = Window.partitionBy("part").orderBy("seq")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_base"))
    places = blocks.select("part", "seq", (F.sum("n_ids").over(by_part) - F.col("n_ids")).alias("base"))
    places = places.join(parts, "part").select("part", "seq", (F.col("base") + F.col("part_base")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, lengths, ids = read_block(b.column(2)[i].as_py())
                lengths = lengths.astype(np.int64)
                end = np.cumsum(lengths)
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[x:y].tobytes()) for x, y in zip((end - lengths).tolist(), end.tolist())]
                n = len(keys)
                yield pa.record_batch(
                    [pa.array([b.column(0)[i].as_py()] * n, pa.int32()), pa.array([b.column(1)[i].as_py()] * n, pa.int32()),
                     pa.array(keys, mask=keys == NULL_ID), pa.array(end - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    found = blocks.select("part", "seq", "block").mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return found.join(places, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(load(spark, sf_dir, "documents"), name="op4-ids"))
