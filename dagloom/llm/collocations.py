"""Phrase collocations by generalised suffix automata of bounded depth.

Texts, lower-cased in A-Z, are split at ``. , ; : ! ?`` and line breaks into
pieces, and those at blanks and tabs into words.  Everything is per language.

A phrase of m words is as frequent as its parts at most.  So hashes of words,
then of pairs of frequent words, and so on up to five words, are counted, each
over all texts, and filters of bounded size hold those that occur
``least`` times.  A hash or filter that errs lets too much through, never too
little, and the counts that follow are of the words themselves.

Each shard, some megabytes of a partition's texts, then becomes a suffix
automaton over its runs of such words.  A state is a class of word strings that
end at the same places (endpos); its strings are suffixes of the longest one,
down to a word more than its suffix link has.  Links form the tree of contexts
read backwards, so states and endpos counts come from sorting all places by
their last words: a string of d words is a run of equal d-word contexts, and
strings with the same run are one state.  Depth is bounded by ``WORDS``.  A
shard gives a row for each state, with its longest string, the length of its
shortest and the count.  Equal states are summed over a task's shards before rows
leave it, then over all, and then, down the links, the counts of all their strings.

A phrase is subsumed where one that holds it is as frequent.  Then one with one
word more is, too: one whose suffix link leads to the phrase, or the same at its
other end.

Edge cases: a null text has no words, a null language is ``und``; ids are not
looked at, and each row counts, repeated or not; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.llm.common import KeyFilter, key_filter, load, small_side, stored
from dagloom.llm.words import Q, mix, slices, split_words, strings_at, text_bytes

#: Words of the longest phrase.
WORDS = 5
LEAST = 100
TOP = 2000
#: Bytes of text of a shard: its automaton takes some forty times as much.
SHARD_BYTES = 3 << 20
#: Bytes of states that a task holds to sum equal ones of its shards.
HELD = 48 << 20
STATE = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("low", pa.int32()), ("high", pa.int32()), ("n", pa.int64())])
#: Parts in which a language's phrases are ranked before they meet.
SALTS = 64

# Bytes that part pieces, and those that part words.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True


@dataclass
class Tokens:
    """Words of a batch by place: their hash, which has the language in it;
    whether the word before is of the same piece; the document."""

    h: np.ndarray
    joined: np.ndarray
    doc: np.ndarray
    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray


def tokens(b: pa.RecordBatch) -> Tokens:
    raw, off = text_bytes(b.column("text"))
    w = split_words(raw, off, lower=True, separator=SEPARATOR)
    doc = np.repeat(np.arange(b.num_rows), np.diff(w.first))
    breaks = np.cumsum(BREAK.take(raw), dtype=np.int32).take(w.start) if len(w.start) else np.zeros(0, np.int32)
    joined = np.zeros(len(doc), bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (breaks[1:] == breaks[:-1])
    langs = b.column("lang").dictionary_encode()
    salt = np.array([xxhash.xxh64_intdigest(x) for x in langs.dictionary.to_pylist()], np.uint64)
    code = np.array(langs.indices)
    return Tokens(mix(w.hash ^ salt[code[doc]]) if len(doc) else w.hash, joined, doc, raw, w.start, w.end)


def _grams(t: Tokens, filters: list[KeyFilter]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For the length after the filters': hashes of strings by their last word's
    place, and where both their parts are frequent; and for each filter where
    strings of its length are."""
    g, may, passed = t.h, np.ones(len(t.h), bool), []
    for f in filters:
        at = np.flatnonzero(may)
        ok = np.zeros(len(g), bool)
        ok[at[f.may_hold(g[at])]] = True
        passed.append(ok)
        longer = g.copy()
        longer[1:] = mix(g[:-1] * Q + t.h[1:])
        may = np.zeros(len(g), bool)
        may[1:] = ok[1:] & ok[:-1] & t.joined[1:]
        g = longer
    return g, may, passed


def _hash_counts(filters: Broadcast) -> Callable:
    """(lang, h, n); without h: the words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                t = tokens(b)
                g, may, _ = _grams(t, filters.value)
                h, n = np.unique(g[may], return_counts=True)
                yield pa.record_batch([pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], ["lang", "h", "n"])
                if not filters.value:
                    words = np.bincount(t.doc, minlength=b.num_rows)
                    yield pa.record_batch([b.column("lang"), pa.nulls(b.num_rows, pa.int64()), pa.array(words)], ["lang", "h", "n"])

    return run


@dataclass
class States:
    """States of a bounded automaton: the end of an occurrence of each, its
    longest and shortest strings' lengths, and its endpos count."""

    end: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    count: np.ndarray


def automaton(ids: np.ndarray, depth: np.ndarray, words: int = WORDS) -> States:
    """Of words by place; depth: how many words, up to the place, a string that
    ends there may have."""
    at = np.flatnonzero(depth > 0)
    n = len(at)
    if not n:
        return States(at, at, at, at)
    context = np.zeros((words, n), np.int32)
    for d in range(words):
        deep = depth[at] > d
        context[d, deep] = ids[at[deep] - d] + 1
    order = np.lexsort(context[::-1])
    context = context[:, order]
    new = np.zeros(n, bool)
    new[:1] = True
    runs = []
    for d in range(words):
        new[1:] |= context[d, 1:] != context[d, :-1]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, n))
        real = context[d, begin] > 0
        runs.append((begin[real], size[real], np.full(int(real.sum()), d + 1)))
    begin, size, length = (np.concatenate(x) for x in zip(*runs))
    by = np.lexsort((length, size, begin))
    begin, size, length = begin[by], size[by], length[by]
    head = np.flatnonzero(np.append(True, (np.diff(begin) != 0) | (np.diff(size) != 0)))
    tail = np.append(head[1:], len(begin)) - 1
    return States(at[order[begin[head]]], length[tail], length[head], size[head])


def _summed(tables: list[pa.Table]) -> pa.Table:
    """Equal states once, their counts summed."""
    whole = pa.concat_tables(tables)
    return whole.group_by(["lang", "phrase", "low", "high"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "low", "high", "n"])


def _state_rows(filters: Broadcast) -> Callable:
    """(lang, phrase, low, high, n): a row for each state of a task's shards; of
    a task with more than HELD bytes of them now and then one again."""

    def shard(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t = tokens(b)
        _, _, passed = _grams(t, filters.value)
        depth = np.zeros(len(t.h), np.int64)
        for k in range(WORDS):
            ok = passed[min(k, len(passed) - 1)]
            more = ok.copy()
            if k >= len(passed):  # both strings of a word less must do
                more[1:] = (depth[1:] >= k) & (depth[:-1] >= k)
                more[0] = False
                more &= ok
            depth[more & (depth == k)] = k + 1
        _, ids = np.unique(t.h, return_inverse=True)
        s = automaton(ids, depth)
        for i in range(0, len(s.end), 100_000):
            end, length = s.end[i : i + 100_000], s.longest[i : i + 100_000]
            ends = np.cumsum(length)
            place = np.repeat(end + 1 - ends, length) + np.arange(ends[-1])
            flat = strings_at(t.raw, t.start[place], t.end[place], lower=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), flat)
            small = lambda v: pa.array(v[i : i + 100_000].astype(np.int32))
            yield pa.record_batch(
                [b.column("lang").take(pa.array(t.doc[end])), pc.binary_join(lists, " "), small(s.shortest), small(s.longest), pa.array(s.count[i : i + 100_000])],
                ["lang", "phrase", "low", "high", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            for b in slices(batch, "text", SHARD_BYTES):
                held.append(pa.Table.from_batches([*shard(b)], STATE))
                if len(held) > 1 and sum(x.nbytes for x in held[1:]) >= max(held[0].nbytes, HELD // 4):
                    held = [_summed(held)]
                    if held[0].nbytes > HELD:
                        yield from held.pop().to_batches(max_chunksize=100_000)
        if held:
            yield from _summed(held).to_batches(max_chunksize=100_000)

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, name: str = "phrases") -> tuple[DataFrame, DataFrame]:
    """Two stored tables: totals (lang, total) of words, and counts (lang,
    phrase, words, f) of phrases of up to WORDS words that occur ``least``
    times."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    filters: list[KeyFilter] = []
    totals = None
    for words in range(1, WORDS + 1):
        counts = rows.mapInArrow(_hash_counts(spark.sparkContext.broadcast(filters)), "lang string, h long, n long")
        counts = stored(counts.groupBy("lang", "h").agg(F.sum("n").alias("n")).where(f"h is null or n >= {least}"), f"{name}-{words}")
        if totals is None:
            totals = counts.where("h is null").select("lang", F.col("n").alias("total"))
        filters = [*filters, key_filter(counts.where("h is not null").select("h"), "h")]
    states = rows.mapInArrow(_state_rows(spark.sparkContext.broadcast(filters)), "lang string, phrase string, low int, high int, n long")
    states = states.groupBy("lang", "phrase", "low", "high").agg(F.sum("n").alias("n"))
    strings = states.select("lang", "phrase", "n", F.explode(F.sequence("low", "high")).alias("words"))
    strings = strings.withColumn("phrase", F.expr("substring_index(phrase, ' ', -words)"))
    counts = strings.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return totals, stored(counts, f"{name}-counts")


def without_subsumed(counts: DataFrame) -> DataFrame:
    """(lang, phrase, words, f) of phrases of two words or more that none with
    the same count holds."""
    phrases = counts.where("words > 1")
    shorter = F.array(F.expr("substring_index(phrase, ' ', 1 - words)"), F.expr("substring_index(phrase, ' ', words - 1)"))
    held = phrases.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return phrases.join(held, ["lang", "phrase"], "left").where("most is null or most < f").drop("most")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases."""
    totals, counts = phrase_counts(docs, text, lang, least)
    cuts = without_subsumed(counts).select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.withColumns({"head": F.expr("substring_index(phrase, ' ', k)"), "rest": F.expr("substring_index(phrase, ' ', k - words)")})
    part = lambda c, to: counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(to))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("rest", "r"), ["lang", "rest"]).join(small_side(totals), "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "total", "l", "r")}
    score = cuts.select("lang", "phrase", "a", "k", "l", "r", "total", *[v.alias(f"{c}_") for c, v in wide.items()])
    score = score.withColumn("score", F.expr("(a_ * total_ * 1000) div (l_ * r_)").cast("long"))
    best = score.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    best = best.select("lang", "phrase", "a", F.col("m.l").alias("l"), F.col("m.r").alias("r"), F.col("total").alias("n"), F.col("m.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(load(spark, sf_dir, "documents"))


SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
grams AS (SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
  FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, phrase, k, string_split(phrase, ' ') AS w, count(*)::BIGINT AS f FROM grams GROUP BY lang, phrase, k HAVING count(*) >= 100),
held AS (SELECT lang, array_to_string(w[i : j], ' ') AS phrase, max(f) AS most
  FROM f, (SELECT unnest(range(1, 6)) AS i), (SELECT unnest(range(1, 6)) AS j) WHERE i < j AND j <= k AND j - i + 1 < k GROUP BY ALL),
c AS (SELECT f.lang, f.phrase, f.w, f.k, f.f AS a FROM f LEFT JOIN held USING (lang, phrase) WHERE f.k > 1 AND (most IS NULL OR 100 * most < 100 * f.f)),
cuts AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, cut, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM c JOIN (SELECT unnest(range(1, 5)) AS cut) ON cut < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 : c.k], ' ') JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) WHERE rank <= 2000"""
