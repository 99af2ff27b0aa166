"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on seeds, runs of ``SEED`` shared
words (case of A-Z ignored).  A filter of bounded size keeps seeds that no item
has out of the join; the join is exact.  For each pair that shares enough of
them, Karp-Rabin hashes find the longest match of words that are still unmarked
on both sides, which becomes a tile, again and again, until no match of SEED
words is left.  A document is contaminated by an item if tiles cover ``SHARE``
of the item's words, in whatever order they stand.  Items meet documents by
joins alone, so a benchmark may have any size.

Edge cases: null and empty texts match nothing; items with fewer words than a
seed are found where they stand whole (``without_leaks`` passes them over),
those without words never; a null doc_id or item_id is reported as null; repeated
documents and items each give their rows; extra columns are ignored or, in
``without_leaks``, kept; an empty table on either side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.common import key_filter, keyed, load, small_side, stored, without
from dagloom.llm.words import mix, slices, split_words, text_bytes, windows

SEED = 4
SHARE = 0.5
#: Words of the shortest item for which a document is dropped.
LEAST_WORDS = 8


def _free(used: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a used word."""
    total = np.concatenate([[0], np.cumsum(used)])
    return np.flatnonzero(total[size:] == total[:-size]) if len(used) >= size else np.zeros(0, np.int64)


def tiles(doc: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of word hashes: again and again the longest match
    of unmarked words is marked, of equally long ones the first in doc and then
    in item.  Returns (doc place, item place, length).

    The greatest length of any match is found by bisection: each length looks
    for a Karp-Rabin hash of a window that both sides have.  Time and memory
    don't depend on how often the same words repeat.
    """
    known = np.isin(doc, item)
    near = np.zeros(len(doc) + 1, bool)  # words that can be in a tile, and one after each run
    starts = _free(~known, least)
    for k in range(least + 1):
        near[starts + k] = True
    place = np.flatnonzero(near[:-1])
    doc, used_doc = doc[place], ~known[place]
    # words that stood apart get a used one between them, as each run has one after it
    used_item, out = np.zeros(len(item), bool), []

    def shared(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Doc starts of free windows that the item has, and the item's starts
        and hashes of its free windows."""
        at, to = _free(used_doc, size), _free(used_item, size)
        h, g = windows(doc, size)[at], windows(item, size)[to]
        return at[np.isin(h, g)], to, g

    low, high = least, min(len(doc), len(item))
    while low <= high:
        while low < high:
            middle = (low + high + 1) // 2
            if len(shared(middle)[0]):
                low = middle
            else:
                high = middle - 1
        at, to, g = shared(low)
        if not len(at):
            break
        waiting: dict[int, list[int]] = {}
        for j, x in zip(to[::-1].tolist(), g[::-1].tolist()):
            waiting.setdefault(x, []).append(j)
        h = windows(doc, low)
        for i in at.tolist():
            if used_doc[i : i + low].any():
                continue
            places = waiting[int(h[i])]
            while places and used_item[places[-1] : places[-1] + low].any():
                places.pop()
            if places:
                j = places.pop()
                used_doc[i : i + low] = used_item[j : j + low] = True
                out.append((int(place[i]), j, low))
        low, high = least, low - 1
    return out


def _keys(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words, which differ between n, and their texts."""
    h = windows(words, n)
    text = np.searchsorted(first, np.arange(len(h)), "right") - 1
    fits = np.arange(len(h)) + n <= first[text + 1]
    return mix(h[fits] ^ np.uint64(n)), text[fits]


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(i, h, times, size): an item's seeds, or, of fewer words, the whole."""
    for batch in batches:
        for b in slices(batch, "text"):
            w = split_words(*text_bytes(b.column("text")), lower=True)
            size = np.diff(w.first)
            for n in range(1, SEED + 1):
                h, item = _keys(w.hash, w.first, n)
                own = (size[item] == n) | (n == SEED)
                order = np.lexsort((h[own], item[own]))
                h, item = h[own][order], item[own][order]
                new = np.flatnonzero(np.append(True, (np.diff(item) != 0) | (h[1:] != h[:-1]))[: len(h)])
                times = np.diff(np.append(new, len(h)))
                yield pa.record_batch([b.column("i").take(pa.array(item[new])), pa.array(h[new].view(np.int64)), pa.array(times), pa.array(size[item[new]])], ["i", "h", "times", "size"])


def _doc_seeds(known: Broadcast, sizes: list[int]) -> Callable:
    """(k, t, h): a document's seeds that known, a filter, may hold, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = split_words(*text_bytes(b.column("text")), lower=True)
                for n in sizes:
                    h, doc = _keys(w.hash, w.first, n)
                    some = known.value.may_hold(h)
                    h, doc = h[some], doc[some]
                    order = np.lexsort((h, doc))
                    h, doc = h[order], doc[order]
                    new = np.append(True, (np.diff(doc) != 0) | (h[1:] != h[:-1]))[: len(h)]
                    row = pa.array(doc[new])
                    yield pa.record_batch([b.column("k").take(row), b.column("t").take(row), pa.array(h[new].view(np.int64))], ["k", "t", "h"])

    return run


def _covered(doc: np.ndarray, item: np.ndarray, share: float) -> tuple[int, int]:
    """Words of the item that tiles cover, and tiles; none if seeds, tiled or
    not, cover too few."""
    mark = np.zeros(len(item) + 1, np.int32)
    at = np.flatnonzero(np.isin(windows(item, SEED), windows(doc, SEED)))
    np.add.at(mark, at, 1)
    np.add.at(mark, at + SEED, -1)
    if np.count_nonzero(np.cumsum(mark)) < share * len(item):
        return 0, 0
    found = tiles(doc, item)
    return sum(x[2] for x in found), len(found)


def _tiled(share: float) -> Callable:
    def words(text: str) -> np.ndarray:
        return split_words(*text_bytes(pa.array([text])), lower=True).hash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, rows, last, doc = [], [], None, None
            for i, (text, item) in enumerate(zip(b.column("text"), b.column("item"))):
                if text != last:
                    last, doc = text, words(text.as_py())
                size = words(item.as_py())
                covered, n = _covered(doc, size, share) if len(size) >= SEED else (len(size), 1)
                if covered >= share * len(size):
                    found.append((covered / len(size), n))
                    rows.append(i)
            at = pa.array(rows, pa.int64())
            columns = [pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int32())]
            yield pa.record_batch([*(b.column(c).take(at) for c in ("k", "t", "item_id")), *columns], ["k", "t", "item_id", "coverage", "tiles"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text: str = "text", key: str = "doc_id", least_words: int = 1, name: str = "leaks") -> DataFrame:
    """(k, t, item_id, coverage, tiles): a row for each document and item of
    least_words words or more."""
    spark = docs.sparkSession
    rows = keyed(docs, text, key)
    items = benchmark.select(F.monotonically_increasing_id().alias("i"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item"))
    items = stored(items.where("item is not null"), f"{name}-items")
    seeds = items.select("i", F.col("item").alias("text")).mapInArrow(_item_seeds, "i long, h long, times long, size long")
    seeds = stored(seeds.where(F.col("size") >= least_words), f"{name}-seeds")
    sizes = [r["n"] for r in seeds.select(F.least("size", F.lit(SEED)).cast("int").alias("n")).distinct().collect()]
    known = spark.sparkContext.broadcast(key_filter(seeds.select("h").distinct(), "h"))
    met = rows.mapInArrow(_doc_seeds(known, sorted(sizes)), "k long, t binary, h long").join(small_side(seeds), "h")
    pairs = met.groupBy("k", "t", "i", "size").agg(F.sum("times").alias("times"))
    # tiles cover no more words than the item's seeds that both have
    pairs = stored(pairs.where((F.col("size") < SEED) | (F.col("times") * SEED >= F.lit(share) * F.col("size"))).select("k", "t", "i"), f"{name}-pairs")
    both = rows.join(small_side(pairs), ["k", "t"]).join(small_side(items), "i")
    return both.select("k", "t", "text", "item_id", "item").mapInArrow(_tiled(share), "k long, t binary, item_id long, coverage double, tiles int")


def without_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, text: str = "text", key: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without those that an item of least_words words or more
    contaminates: a few common words are no reason to drop a document."""
    gone = stored(find_leaks(docs, benchmark, share, text, key, least_words).select("k", "t").distinct(), "leaks")
    return without(docs, gone, text, key)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return found.select(F.when(F.col("k") > -(1 << 63), F.col("k")).alias("doc_id"), "item_id", "coverage", "tiles")
