"""N-gram Jaccard join: a size-aware heavy-light set similarity join.

Sets are the distinct word shingles of documents.  Equal sets form one class.
Between classes, light sets (small ones) are joined by enumerating subsets of a
fixed size: sets of sizes a and b with Jaccard t share at least
``c = ceil(t (a + b) / (1 + t))`` shingles, so they share a subset of size c.
Heavy sets go to inverted lists: two of them differ in at most
``D = floor(2 U (1 - t) / (1 + t))`` shingles, U being their size band's upper
end, so of more than D parts of the shingle space at least one holds the same
shingles of both.  A list's key is a band, a part and the digest of the
shingles in it; single shingles would not do as keys, as a passage that a third
of all documents share would put them all into one list.  The size where
enumeration ends is where its cost passes that of the lists.

Parts that are empty are no keys for a set with more than D other parts: its
partners meet it elsewhere.  Only sets with fewer list their empty parts too.

Of lists that hold the same classes one is kept, as they give the same pairs.
Similar sets differ in no more parts than in shingles, so they share many lists,
not one; of each set's lists, the rarest first, the last ones go of which it
shares more than that with any similar set (a prefix filter), and sets that have
too few lists go whole.
Lists are scanned without emitting their pairs: in each round every set of a
list is held against a few pivots of other components and keeps the nearest by
a bit-parity sketch, whose Hamming distance never exceeds the symmetric
difference; only lists that still have several components give their remaining
pairs, as far as the sketch allows a link.  Pairs are then held against longer
sketches, with cells in proportion to the sets, and what these allow is tested
exactly.  No candidate is capped.  Tables go once nothing needs them.

Edge cases: null texts and texts without words have an empty set, linked with
nothing; with fewer words than a shingle has, the whole sequence is one; a null
id counts as the smallest; repeated rows are alike; extra columns are ignored
or, in ``one_of_each``, kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.llm.common import NULL_ID, components, drop, key_filter, keyed, keyed_rows, load, small_side, stored
from dagloom.llm.words import mix, slices, split_words, text_bytes, windows

#: Most elements of a light set, whatever its cost.
LIGHT_MOST = 40
#: Chance taken for two sets to share one shingle, in the cost of short list keys.
SHARE = 0.05
#: Star rounds at most before the remaining pairs of unsettled lists are looked
#: at, and pivots of a list in each.
STARS = 4
PIVOTS = 3
#: Sets of a list on average, weighted by its length, up to which a list's
#: remaining pairs are looked at without more star rounds.
SHORT = 256
#: Lists of a set by which a pair is known to come up elsewhere.
HEAD = 8
#: 64-bit words of the parity sketch.
SKETCH = 8


@dataclass(frozen=True)
class Plan:
    """Threshold num/den, shingle words, the last light size, and the bands."""

    num: int
    den: int
    words: int
    light: int
    lows: tuple[int, ...]

    def overlap(self, a: int, b: int) -> int:
        return -(-self.num * (a + b) // (self.num + self.den))

    def least(self, b: int) -> int:
        """The smallest size that can be similar to size b."""
        return -(-self.num * b // self.den)

    def most_apart(self, upper: int) -> int:
        return 2 * upper * (self.den - self.num) // (self.den + self.num)

    def parts(self, upper: int) -> int:
        return math.ceil(1.15 * (self.most_apart(upper) + 1)) + 2

    def common(self, s: int, upper: int, full: int) -> int:
        """Full parts that a set of size s, which has ``full`` of them, shares
        with any similar set of a band up to upper, at least: no more parts
        differ than shingles do."""
        apart = (s + min(s * self.den // self.num, upper)) * (self.den - self.num) // (self.den + self.num)
        return max(1, full - apart)

    def partners(self, s: int) -> list[int]:
        """Sizes of light pairs that a set of size s can be in."""
        out = [p for p in range(self.least(s), s * self.den // self.num + 1) if max(s, p) <= self.light]
        return [p for p in out if self.overlap(s, p) <= min(s, p) and (s != p or self.overlap(s, p) < s)]

    def bands(self, s: int) -> list[int]:
        """Bands that size s is listed in: its own, and the next if it can have
        a larger partner there."""
        own = int(np.searchsorted(self.lows, s, "right")) - 1
        out = [own] if own >= 0 else []
        if own + 1 < len(self.lows) and s >= self.least(self.lows[own + 1]):
            out.append(own + 1)
        return out


def subsets_of(plan: Plan, s: int) -> int:
    return sum(math.comb(s, plan.overlap(s, p)) for p in plan.partners(s))


def make_plan(num: int, den: int, words: int, sizes: dict[int, int], largest: int) -> Plan:
    """Chooses where enumeration ends by cost; sizes: sets of each size up to
    about LIGHT_MOST, largest: the greatest size."""
    light = 0
    for s in range(1, LIGHT_MOST + 1):
        plan = Plan(num, den, words, s, ())
        enumerated = subsets_of(plan, s)
        parts = plan.parts(s * den // num)
        listed = 2 * parts * (1 + sizes.get(s, 0) * SHARE ** (s / parts))
        if enumerated > listed:
            break
        light = s
    lows, at = [], light + 1
    while at <= max(largest, light + 1):
        lows.append(at)
        at = max(at + 1, math.ceil(at * (den / num) ** 2))
    return Plan(num, den, words, light, tuple(lows))


def shingle_sets(b: pa.RecordBatch, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of the batch."""
    w = split_words(*text_bytes(b.column("text")), lower=True)
    whole = windows(w.hash, words)
    out = []
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if z - a >= words:
            out.append(np.unique(whole[a : z - words + 1]))
        else:
            out.append(windows(w.hash[a:z], z - a) if z > a else whole[:0])
    return out


def listed(plan: Plan, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of one set, their bands (-1: subsets) and how many keys of the
    band it has in common with any similar set of it, at least."""
    s, out, bands = len(items), [], []
    own = mix(items ^ np.uint64(0xA5A5A5A55A5A5A5A))
    if s <= plan.light:
        for p in plan.partners(s):
            c = plan.overlap(s, p)
            left = [own[list(x)].sum(dtype=np.uint64) for x in itertools.combinations(range(s), s - c)]
            sums = own.sum(dtype=np.uint64) - np.array(left, np.uint64)
            out.append(mix(sums ^ mix(np.array([1 << 40 | min(s, p) << 20 | max(s, p)], np.uint64))))
            bands.append((-1, 1))
    for band in plan.bands(s):
        upper = plan.lows[band + 1] - 1 if band + 1 < len(plan.lows) else plan.lows[band] * plan.den**2 // plan.num**2 + 1
        n = plan.parts(upper)
        part = (mix(items + np.uint64(band + 1)) % np.uint64(n)).astype(np.int64)
        count = np.bincount(part, minlength=n)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, part, own)
        keys = mix(sums ^ mix(np.arange(n, dtype=np.uint64) + np.uint64((band + 1) << 32)))
        full = count > 0
        out.append(keys[full] if full.sum() > plan.most_apart(upper) else keys)
        bands.append((band, plan.common(s, upper, int(full.sum()))))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    each = np.repeat(np.array(bands, np.int32), [len(x) for x in out], axis=0)
    return np.concatenate(out), each[:, 0], each[:, 1]


def keys_of(plan: Plan, items: np.ndarray) -> np.ndarray:
    return listed(plan, items)[0]


def sketch(items: np.ndarray) -> np.ndarray:
    """Parity of the number of items in each of 64 * SKETCH hash cells."""
    cell = np.bincount((mix(items) % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(cell.astype(np.uint8)).view(np.int64)


def long_sketch(items: np.ndarray) -> np.ndarray:
    """The same with cells in proportion to the items, four for each or more;
    their number is a power of two, so that longer ones can be folded."""
    cells = max(64 * SKETCH, 1 << (4 * len(items) - 1).bit_length())
    cell = np.bincount((mix(items ^ np.uint64(0x3C3C3C3CC3C3C3C3)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(cell.astype(np.uint8)).view(np.int64)


def sketches_apart(a: np.ndarray, b: np.ndarray) -> int:
    """In how many cells two long sketches differ: no more than items differ."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def _possible(pairs: DataFrame, sets: DataFrame, plan: Plan, name: str) -> DataFrame:
    """Of the stored pairs(a, b, n), those that long sketches allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(b.column("na").to_pylist(), b.column("nb").to_pylist())
            signs = zip(b.column("la"), b.column("lb"))
            fits = [sketches_apart(x.values.to_numpy(), y.values.to_numpy()) * (plan.den + plan.num) <= (m + n) * (plan.den - plan.num) for (x, y), (m, n) in zip(signs, sizes)]
            yield pa.record_batch([b.column(c) for c in ("a", "b", "n")], ["a", "b", "n"]).filter(pa.array(fits, pa.bool_()))

    side = lambda c: sets.select(F.col("d").alias(c), F.col("long").alias(f"l{c}"), F.size("items").alias(f"n{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n", "la", "lb", "na", "nb")
    return stored(both.mapInArrow(run, pairs.select("a", "b", "n").schema.simpleString()), f"{name}-possible")


def _verified(pairs: DataFrame, sets: DataFrame, volume: int, plan: Plan, name: str) -> DataFrame:
    """Of the stored pairs(a, b, n), those whose sets are similar; n: shingles
    of a; volume: those of all sets.  Sets meet the pairs where they are read,
    and only those in pairs that long sketches allow are shuffled, about half
    the sets' volume at a time."""
    pairs = _possible(pairs, sets, plan, name)
    parts = max(1, math.ceil(2 * (pairs.agg(F.sum("n").alias("n")).first()["n"] or 0) / max(volume, 1)))
    out = None
    for part in range(parts):
        some = pairs.where(F.pmod(F.xxhash64("b"), F.lit(parts)) == part).select("a", "b")
        left = sets.select(F.col("d").alias("a"), F.col("items").alias("ia")).join(small_side(some), "a")
        right = sets.select(F.col("d").alias("b"), F.col("items").alias("ib")).join(small_side(some.select("b")), "b", "left_semi")
        both = left.join(right, "b")
        inter = F.size(F.array_intersect("ia", "ib"))
        union = F.size("ia") + F.size("ib") - inter
        found = stored(both.where(F.lit(plan.den) * inter >= F.lit(plan.num) * union).select("a", "b"), f"{name}-links")
        out = found if out is None else out.union(found)
    drop(pairs)
    return out


def _of_one_membership(lists: DataFrame, name: str) -> DataFrame:
    """Of lists(key, d, n, band, need) of a band that hold the same classes, one
    each: they give the same pairs, and near copies share most of their keys.
    Memberships are told apart by their number and 128 bits of hash.  Adds c,
    the classes of a list, and w, how many lists it stands for."""
    held = [F.bit_xor(F.xxhash64("d", F.lit(j))).alias(f"x{j}") for j in range(2)]
    members = lists.groupBy("band", "key").agg(F.count("*").alias("c"), *held)
    kept = members.groupBy("band", "c", "x0", "x1").agg(F.min("key").alias("key"), F.count("*").alias("w")).where("c > 1").select("key", "c", "w")
    kept = stored(kept, f"{name}-kept")
    out = stored(lists.join(small_side(kept), "key"), f"{name}-lists")
    drop(kept)
    return out


def _rarest(lists: DataFrame, name: str) -> DataFrame:
    """Of each set's lists those in which it can first meet a similar one.

    Two similar sets share ``need`` lists of their band or more.  In the order of
    (c, key) the first that they share has as many with it and after it, in
    either set.  So a set's last lists go, of less than that weight, and all of
    one that has too few; then lists of a single set.

    Adds head, those of the set's HEAD last lists that come after this one: a
    pair comes up in one of them, too, where its heads have a list in common."""
    order = Window.partitionBy("d", "band").orderBy(F.desc("c"), F.desc("key"))
    first = lists.withColumn("after", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("after >= need")
    first = first.withColumn("last", F.when(F.row_number().over(order) <= HEAD, F.col("key")))
    first = first.withColumn("head", F.collect_list("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    first = stored(first.select("key", "d", "n", "head"), f"{name}-first")
    several = stored(first.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), f"{name}-several")
    out = stored(first.join(small_side(several), "key", "left_semi"), f"{name}-lists")
    drop(first, several)
    return out


def link_classes(docs: DataFrame, words: int, num: int, den: int, text: str = "text", key: str = "doc_id", name: str = "jaccard") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored tables: members (k, t, n, d), a row for each row of docs, d being
    its class; kinds (d, own, n), the classes of sets that are not empty, own
    being the least (k, t); and groups (d, c), for classes that are linked with
    others: c is the smallest d of the component."""
    spark = docs.sparkSession
    rows = keyed(docs, text, key)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                sets = shingle_sets(b, words)
                yield pa.record_batch(
                    [b.column("k"), b.column("t"), pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) for x in sets], pa.binary())],
                    ["k", "t", "n", "d"],
                )

    members = stored(rows.mapInArrow(classes, "k long, t binary, n long, d binary"), f"{name}-members")
    kinds = members.where("n > 0").groupBy("d").agg(F.min(F.struct("k", "t")).alias("own"), F.first("n").alias("n"))
    kinds = stored(kinds, f"{name}-kinds")
    sizes = kinds.groupBy(F.least("n", F.lit(LIGHT_MOST + 1)).alias("s")).agg(F.count("*").alias("c"), F.max("n").alias("m")).collect()
    plan = make_plan(num, den, words, {r["s"]: r["c"] for r in sizes}, max([r["m"] for r in sizes], default=0))

    def with_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                sets = shingle_sets(b, words)
                keys = [listed(plan, x) for x in sets]
                row = np.repeat(np.arange(len(sets)), [len(x[0]) for x in keys])
                key, band, need = (np.concatenate(x) for x in zip(*keys))
                some = several.value.may_hold(key)
                key, row = key[some], pa.array(row[some])
                yield pa.record_batch(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array([_digest(x) for x in sets], pa.binary()).take(row),
                        pa.array([len(x) for x in sets], pa.int64()).take(row),
                        pa.array(band[some]),
                        pa.array(need[some]),
                    ],
                    ["key", "d", "n", "band", "need"],
                )

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                keys = np.concatenate([keys_of(plan, x) for x in shingle_sets(b, words)])
                yield pa.record_batch([pa.array(keys.view(np.int64))], ["key"])

    extra = members.join(small_side(kinds.select("d", "own")), "d").where("own.k <> k or own.t <> t").select("k", "t").distinct()
    extra = stored(extra, f"{name}-extra")
    own = rows.join(small_side(extra), ["k", "t"], "left_anti").select("k", "t", "text")
    counts = own.mapInArrow(keys_only, "key long").groupBy("key").agg(F.count("*").alias("c"))
    twice = stored(counts.where("c > 1").select("key"), f"{name}-keys")
    several = spark.sparkContext.broadcast(key_filter(twice))
    lists = own.mapInArrow(with_keys, "key long, d binary, n long, band int, need int").join(small_side(twice), "key", "left_semi")
    every = stored(lists.distinct(), f"{name}-every")
    distinct = _of_one_membership(every, name)
    drop(every, twice)
    lists = _rarest(distinct, name)
    drop(distinct)
    met = kinds.join(lists.select("d").distinct(), "d", "left_semi").select("own.k", "own.t")
    met = stored(met, f"{name}-met")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                sets = shingle_sets(b, words)
                signs = [sketch(x) for x in sets]
                yield pa.record_batch(
                    [
                        pa.array([_digest(x) for x in sets], pa.binary()),
                        pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                        pa.array([long_sketch(x) for x in sets], pa.list_(pa.int64())),
                        *(pa.array([x[k] for x in signs], pa.int64()) for k in range(SKETCH)),
                    ],
                    ["d", "items", "long", *(f"s{k}" for k in range(SKETCH))],
                )

    shape = "d binary, items array<long>, long array<long>" + "".join(f", s{k} long" for k in range(SKETCH))
    sets = own.join(small_side(met), ["k", "t"], "left_semi").mapInArrow(whole_sets, shape)
    # sets are one for each class unless rows repeat an id and its text
    again = members.join(small_side(met), ["k", "t"], "left_semi").groupBy("k", "t").count().where("count > 1")
    sets = stored(sets if again.isEmpty() else sets.dropDuplicates(["d"]), f"{name}-sets")

    # star rounds: each set against one pivot of another component
    tried = spark.createDataFrame([], "a binary, b binary")
    label: DataFrame | None = None

    def labelled(df: DataFrame) -> DataFrame:
        if label is None:
            return df.withColumn("c", F.col("d"))
        return df.join(label, "d", "left").withColumn("c", F.coalesce("c", "d"))

    volume = sets.agg(F.sum(F.size("items")).alias("n")).first()["n"] or 0

    def settle(pairs: DataFrame) -> bool:
        """Joins the components of pairs that are similar; whether there were any.
        Only pairs of different components are looked at, once each."""
        nonlocal label
        new = _verified(pairs, sets, volume, plan, name)
        if new.isEmpty():
            return False
        ends = new
        for side in ("a", "b"):
            ends = labelled(ends.withColumnRenamed(side, "d")).drop("d").withColumnRenamed("c", side)
        merged = components(ends.where("a <> b").distinct(), f"{name}-comp")
        if label is None:
            label = merged.toDF("d", "c")
            return True
        moved = label.join(merged.toDF("c", "to"), "c", "left").select("d", F.coalesce("to", "c").alias("c"))
        fresh = merged.toDF("d", "c").join(label, "d", "left_anti")
        before, label = label, stored(moved.unionByName(fresh), f"{name}-label")
        drop(before)
        return True

    signs = sets.select("d", F.array(*(f"s{k}" for k in range(SKETCH))).alias("sign"))
    # codegen'd sums over the sketch's words; the arrays are read by position
    apart = sum(F.bit_count(F.col("x.sign")[k].bitwiseXOR(F.col("y.sign")[k])) for k in range(SKETCH))
    within = apart * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num)
    sized = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    able = (F.col("x.key") == F.col("y.key")) & (F.col("x.c") != F.col("y.c")) & sized & within

    def unsettled() -> DataFrame:
        now = labelled(lists)
        several = now.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
        return stored(now.join(several, "key", "left_semi").join(signs, "d"), f"{name}-open")

    rest, stars = unsettled(), []
    for turn in range(STARS):
        firsts = [F.min(F.struct(F.xxhash64("d", F.lit(turn * PIVOTS + j)).alias("h"), "d", "c", "n", "sign")) for j in range(PIVOTS)]
        pivot = rest.groupBy("key").agg(F.array(*firsts).alias("p")).select("key", F.explode(F.array_distinct("p")).alias("p")).select("key", "p.d", "p.c", "p.n", "p.sign")
        # stored, so that neither side of the join has its exchange in common
        # with the aggregate and Spark can split the lists with most sets
        pivot = stored(pivot, f"{name}-pivots")
        near = rest.alias("x").join(pivot.alias("y"), able).select(F.col("x.d").alias("d"), F.struct(apart.alias("apart"), F.col("y.d").alias("p"), F.greatest("x.n", "y.n").alias("n")).alias("y"))
        near = near.groupBy("d").agg(F.min("y").alias("y")).select(F.least("d", "y.p").alias("a"), F.greatest("d", "y.p").alias("b"), "y.n")
        pairs = stored(near.distinct().join(tried, ["a", "b"], "left_anti"), f"{name}-star")
        stars.append(pairs)
        drop(pivot)
        tried = tried.union(pairs.select("a", "b"))
        if not settle(pairs):
            break
        before, rest = rest, unsettled()
        drop(before)
        size = rest.groupBy("key").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("pairs")).first()
        if (size["pairs"] or 0) <= SHORT * (size["n"] or 0):
            break  # the lists that are left are short

    # what unsettled lists have left
    x, y = rest.alias("x"), rest.alias("y")
    left = x.join(y, able & (F.col("x.d") < F.col("y.d")) & ~F.arrays_overlap("x.head", "y.head"))
    left = left.select(F.col("x.d").alias("a"), F.col("y.d").alias("b"), apart.alias("apart"), F.greatest("x.n", "y.n").alias("n")).distinct()
    left = stored(left.join(tried, ["a", "b"], "left_anti"), f"{name}-left")
    drop(rest, *stars)
    best = 2
    while True:
        ends = left
        for side in ("a", "b"):
            ends = labelled(ends.withColumnRenamed(side, "d")).withColumnsRenamed({"d": side, "c": f"c{side}"})
        ends = ends.where("ca <> cb")
        order = Window.partitionBy("a", "cb").orderBy("apart", "b")
        ends = stored(ends.withColumn("r", F.row_number().over(order)), f"{name}-ends")
        pairs = stored(ends.where(F.col("r") <= best).select("a", "b", "n"), f"{name}-best")
        left = ends.where(F.col("r") > best).select("a", "b", "apart", "n")
        if pairs.isEmpty():
            break
        settle(pairs)
        best *= 16
    drop(sets, lists, met, extra)
    return members, kinds, label if label is not None else spark.createDataFrame([], "d binary, c binary")


def linked(docs: DataFrame, words: int, num: int, den: int, text: str = "text", key: str = "doc_id", name: str = "jaccard") -> DataFrame:
    """(k, t, n, own): own is the least (k, t) of the linked rows, null for an
    empty set.  Components are worked out on classes; rows meet only their
    class, by a join whose hot classes can be split."""
    members, kinds, groups = link_classes(docs, words, num, den, text, key, name)
    named = stored(kinds.select("d", "own").join(groups, "d", "left").withColumn("g", F.coalesce("c", "d")).select("d", "own", "g"), f"{name}-named")
    least = stored(named.groupBy("g").agg(F.min("own").alias("own")), f"{name}-least")
    owners = stored(named.select("d", "g").join(small_side(least), "g").select("d", "own"), f"{name}-owners")
    drop(named, least, kinds, groups)
    found = members.where("n > 0").join(small_side(owners), "d").select("k", "t", "n", "own")
    return found.unionByName(members.where("n = 0").select("k", "t", "n"), allowMissingColumns=True)


def jaccard_components(docs: DataFrame, words: int, num: int, den: int, text: str = "text", key: str = "doc_id", name: str = "jaccard") -> DataFrame:
    """(k, t, n, component): component is the smallest k of the linked rows; an
    empty set's is its own."""
    found = linked(docs, words, num, den, text, key, name)
    return found.select("k", "t", "n", F.coalesce("own.k", "k").alias("component"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those that are near copies of one with a smaller id.  Of
    rows with one id in a group, the one whose digest is smallest stays, and of
    rows with one id and text the one whose columns as JSON come first; rows
    without words all stay."""
    found = stored(linked(docs, words, num, den, text, key, "near"), "near-components").where("n > 0")
    gone = stored(found.where("own.k <> k or own.t <> t").select("k", "t").distinct(), "near-gone")
    again = stored(found.where("own.k = k and own.t = t").groupBy("k", "t").count().where("count > 1").select("k", "t"), "near-again")
    rows = keyed_rows(docs, text, key).join(small_side(gone), ["k", "t"], "left_anti")
    if not again.isEmpty():
        again = small_side(again)
        least = rows.join(again, ["k", "t"], "left_semi").groupBy("k", "t").agg(F.min_by("row", F.to_json("row")).alias("row"))
        rows = rows.join(again, ["k", "t"], "left_anti").select("row").union(least.select("row"))
    return rows.select("row.*")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(load(spark, sf_dir, "documents"), words=3, num=90, den=100, name="op2")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(real("k").alias("doc_id"), F.col("n").alias("n_shingles"), real("component").alias("component_id"))
