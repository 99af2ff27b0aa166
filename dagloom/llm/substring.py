"""Exact substring dedup with difference-cover anchors.

A word goes if it lies in a window of ``WINDOW`` words whose word sequence also
starts earlier (smaller doc_id, or the same document further ahead).

Windows of ``ANCHOR`` words are hashed only at positions whose residue modulo
``PERIOD`` is in ``COVER``.  Every residue is a difference of two cover
elements, so two equal runs of ANCHOR + PERIOD - 1 words, however they are
aligned, share a hashed anchor at the same offset.  Anchors that occur once are
dropped, most of them by a filter of bounded size where they are made; around
the others the match is extended to all windows that hold the anchor, and among
windows of equal words (128 bits of hash) all but the first are covered.

Whole copies need no windows: every word of a copy that is not the first is
covered if the text has at least WINDOW words.

Edge cases: a null text has no words; a null id counts as the smallest; rows
that repeat a doc_id and its text count as one place and stay alike; rows that
share a doc_id but not the text come in the order of a hash of the text; extra
columns are ignored or, in ``without_repeats``, kept; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.common import digest, drop, id_key, key_filter, load, small_side, stored
from dagloom.llm.words import mix, slices, split_words, text_bytes, windows

WINDOW = 20
# A perfect difference set, and its modulus.
PERIOD = 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Numbers in broadcast position lists at most; beyond, the join is shuffled.
BROADCAST_NUMBERS = 16_000_000

WINDOW_ROW = "g long, g2 long, k long, x long, at int"
#: Makes the second 64 bits of a window's hash.
OTHER = np.uint64(0x5851F42D4C957F2D)

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _anchor_places(first: np.ndarray) -> np.ndarray:
    """Word indexes of anchors, given each document's first word."""
    total = int(first[-1])
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(total) - first[doc]
    return np.flatnonzero(_IN_COVER[at % PERIOD] & (np.arange(total) + ANCHOR <= first[doc + 1]))


def _anchor_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            w = split_words(*text_bytes(b.column("text")), lower=False)
            at = _anchor_places(w.first)
            h, n = np.unique(windows(w.hash, ANCHOR)[at], return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])


def _anchor_rows(several: Broadcast) -> Callable:
    """Makes the rows of anchors that several, a filter, may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = split_words(*text_bytes(b.column("text")), lower=False)
                at = _anchor_places(w.first)
                h = windows(w.hash, ANCHOR)[at]
                some = several.value.may_hold(h)
                at, h = at[some], h[some].view(np.int64)
                doc = np.searchsorted(w.first, at, "right") - 1
                row = pa.array(doc)
                yield pa.record_batch(
                    [pa.array(h), b.column("k").take(row), b.column("x").take(row), pa.array((at - w.first[doc]).astype(np.int32))],
                    ["h", "k", "x", "at"],
                )

    return run


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            w = split_words(*text_bytes(b.column("text")), lower=False)
            lists = b.column("places")
            size = np.array(pc.list_value_length(lists)).astype(np.int64)
            doc = np.repeat(np.arange(b.num_rows), size)
            places = np.array(lists.flatten()).astype(np.int64) + w.first[doc]
            mark = np.zeros(int(w.first[-1]) + 1, np.int32)
            low = np.maximum(places - (PERIOD - 1), w.first[doc])
            np.add.at(mark, low, 1)
            np.add.at(mark, places + 1, -1)
            start = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            doc = np.searchsorted(w.first, start, "right") - 1
            fits = start + WINDOW <= w.first[doc + 1]
            start, doc = start[fits], doc[fits]
            row = pa.array(doc)
            yield pa.record_batch(
                [
                    pa.array(windows(w.hash, WINDOW)[start].view(np.int64)),
                    pa.array(windows(mix(w.hash ^ OTHER), WINDOW)[start].view(np.int64)),
                    b.column("k").take(row),
                    b.column("x").take(row),
                    pa.array((start - w.first[doc]).astype(np.int32)),
                ],
                ["g", "g2", "k", "x", "at"],
            )


def _keyed(docs: DataFrame, text: str, key: str, several: bool, *more: Column) -> DataFrame:
    """A number for the id (k), the text, a digest (t) of it, and what tells
    texts of one id apart (x): a hash, or 0 where ids don't have several."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(*more, id_key(key).alias("k"), whole.alias("text"))
    return rows.withColumns({"t": digest("text"), "x": F.xxhash64("text") if several else F.lit(0).cast("long")})


def _several_texts(docs: DataFrame, text: str, key: str) -> bool:
    """Whether any id has more than one text."""
    rows = _keyed(docs, text, key, True)
    return not rows.groupBy("k").agg(F.min("x").alias("a"), F.max("x").alias("z")).where("a <> z").isEmpty()


def _numbers_side(lists: DataFrame, column: str) -> DataFrame:
    total = lists.agg(F.coalesce(F.sum(F.size(column) + 8), F.lit(0)).alias("n")).first()["n"]
    return F.broadcast(lists) if total <= BROADCAST_NUMBERS else lists


def _held_windows(several: Broadcast) -> Callable:
    """The rows of windows that several, a filter, may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(several.value.may_hold(b.column("g").to_numpy().view(np.uint64))))

    return run


def find_repeats(docs: DataFrame, several: bool, text: str = "text", key: str = "doc_id", name: str = "substring") -> tuple[DataFrame, DataFrame]:
    """Two stored tables: copies (t, first), of texts that more than one id has,
    and covered (k, x, starts), the starts of covered windows of other texts.
    several: whether ids have several texts."""
    rows = _keyed(docs, text, key, several)
    copies = stored(
        rows.groupBy("t").agg(F.min("k").alias("first"), F.max("k").alias("last")).where("last > first").select("t", "first"),
        f"{name}-copies",
    )
    own = rows.join(small_side(copies), "t", "left").where("first is null or first = k").select("k", "x", "text")
    counts = own.select("text").mapInArrow(_anchor_counts, "h long, n byte")
    twice = stored(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), f"{name}-anchors")
    known = docs.sparkSession.sparkContext.broadcast(key_filter(twice, "h"))
    found = own.mapInArrow(_anchor_rows(known), "h long, k long, x long, at int").join(small_side(twice), "h", "left_semi")
    places = stored(found.groupBy("k", "x").agg(F.collect_list("at").alias("places")), f"{name}-places")
    near = own.join(_numbers_side(places, "places"), ["k", "x"])
    spans = stored(near.mapInArrow(_window_rows, WINDOW_ROW), f"{name}-windows")
    first = spans.groupBy("g", "g2").agg(F.min(F.struct("k", "x", "at")).alias("f"), F.count("*").alias("c")).where("c > 1")
    # stored, so that the join has exchanges of its own and Spark can split the
    # windows that most documents have
    first = stored(first.select("g", "g2", F.col("f.k").alias("fk"), F.col("f.x").alias("fx"), F.col("f.at").alias("fat")), f"{name}-first")
    side, held = small_side(first), spans
    if side is first:  # windows of their own needn't be shuffled
        repeated = docs.sparkSession.sparkContext.broadcast(key_filter(first, "g"))
        held = spans.mapInArrow(_held_windows(repeated), WINDOW_ROW)
    later = held.join(side, ["g", "g2"]).where("fk <> k or fx <> x or fat <> at")
    covered = stored(later.groupBy("k", "x").agg(F.sort_array(F.collect_set("at")).alias("starts")), f"{name}-covered")
    drop(twice, places, spans, first)
    return copies, covered


def _kept(words: list[bytes], starts: np.ndarray | None, copy: bool) -> list[bytes]:
    if copy:
        return [] if len(words) >= WINDOW else words
    if starts is None or not len(starts):
        return words
    mark = np.zeros(len(words) + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + WINDOW, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(mark)[:-1] == 0).tolist()]


def _with_repeats(docs: DataFrame, copies: DataFrame, covered: DataFrame, several: bool, text: str, key: str) -> DataFrame:
    """docs' rows with a list of covered starts and whether they are copies."""
    rows = _keyed(docs, text, key, several, F.struct("*").alias("row"))
    rows = rows.join(small_side(copies), "t", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("k"), F.lit(False)))
    return rows.join(_numbers_side(covered, "starts"), ["k", "x"], "left")


def repeat_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                words = b.column(1)[i].as_py().encode().split()
                starts = b.column(3)[i].values
                kept = _kept(words, None if starts is None else starts.to_numpy(), b.column(2)[i].as_py())
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*out)) or [()] * 3
            kinds = (pa.int64(), pa.int64(), pa.string())
            yield pa.record_batch([b.column(0), *(pa.array(x, k) for x, k in zip(columns, kinds))], names)

    several = _several_texts(docs, text, key)
    copies, covered = find_repeats(docs, several, text, key)
    rows = _with_repeats(docs, copies, covered, several, text, key)
    return rows.select(F.col(f"row.{key}").cast("long").alias("doc_id"), "text", "copy", "starts").mapInArrow(
        run, "doc_id long, n_words long, n_removed long, kept_sha256 string"
    )


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with covered words taken out of the texts; a text that loses
    nothing stays as it is, others are their kept words joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                whole, copy, starts = b.column(1)[i].as_py(), b.column(2)[i].as_py(), b.column(3)[i].values
                if copy or starts is not None:
                    words = whole.encode().split()
                    kept = _kept(words, None if starts is None else starts.to_numpy(), copy)
                    whole = whole if len(kept) == len(words) else b" ".join(kept).decode()
                out.append(whole)
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], ["row", "text"])

    several = _several_texts(docs, text, key)
    copies, covered = find_repeats(docs, several, text, key)
    rows = _with_repeats(docs, copies, covered, several, text, key).select("row", "text", "copy", "starts")
    done = rows.mapInArrow(run, f"row {docs.schema.simpleString()}, text string")
    return done.select(*[F.when(F.col("row")[c].isNull(), F.lit(None)).otherwise(F.col("text")).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(load(spark, sf_dir, "documents"))
