"""Ranked lexical search over an index of postings.

Terms are maximal runs of ASCII letters, digits and bytes above 127; only A-Z
are lower-cased.  ``postings`` is the index: one row for each document and term
with its number of occurrences (tf) and the document's number of terms (n), in
folders by a bucket of the term's hash; rows of a bucket are rebalanced, so a
term that all documents have fills several files.  Given the terms that will be
asked for, a filter of bounded size keeps others out where rows are made.

``search`` joins the items' terms to the postings and gives each posting an
integer score, which no item changes; only then are postings dealt by document,
so that documents' sums for items need no other shuffle:

    w = floor(1000 ln((2N + 2) / (2 df + 1)))
    score of a posting = w * ((10^9 tf) div (1000 tf + 8 m)),
    m = 100 - 90 + ((90 n N) div L)

with N documents that have a term, df of them with this one, and L terms in
all.  Items whose terms don't fit a broadcast are worked off in blocks.

Edge cases: null texts have no terms; documents without terms are never found;
each row is a document of its own, so rows that repeat a doc_id rank apart;
equal scores rank by doc_id, nulls first; rows that repeat an item_id are one
item with the terms of all; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dagloom.llm.common import BROADCAST_BYTES, KeyFilter, key_filter, load, row_bytes, shared_dir, small_batches, small_side, stored
from dagloom.llm.words import slices, split_words, strings_at, text_bytes

#: Folders of the index.
BUCKETS = 16
TOP = 10

# The bytes that no term has.
SEPARATOR = np.ones(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    SEPARATOR[_low : _high + 1] = False


def _terms(wanted: Broadcast | None) -> Callable:
    """(r, doc, term, h, tf, n) of documents' terms, and for each part of a batch
    a row without a term: its documents that have terms, and their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                raw, off = text_bytes(b.column("text"))
                w = split_words(raw, off, lower=True, separator=SEPARATOR)
                n = np.diff(w.first)
                doc = np.repeat(np.arange(b.num_rows), n)
                at = np.arange(len(w.hash)) if wanted is None else np.flatnonzero(wanted.value.may_hold(w.hash))
                at = at[np.lexsort((w.hash[at], doc[at]))]
                new = np.flatnonzero(np.append(True, (np.diff(doc[at]) != 0) | (w.hash[at][1:] != w.hash[at][:-1]))[: len(at)])
                tf = np.diff(np.append(new, len(at)))
                at = at[new]
                row = pa.array(np.append(doc[at], -1), mask=np.append(np.zeros(len(at), bool), True))
                term = strings_at(raw, w.start[at], w.end[at], lower=True)
                yield pa.record_batch(
                    [
                        b.column("r").take(row),
                        b.column("doc").take(row),
                        pa.concat_arrays([term, pa.nulls(1, pa.string())]),
                        pa.array(np.append(w.hash[at].view(np.int64), 0)),
                        pa.array(np.append(tf, (n > 0).sum())),
                        pa.array(np.append(n[doc[at]], n.sum())),
                    ],
                    ["r", "doc", "term", "h", "tf", "n"],
                )

    return run


def _term_rows(rows: DataFrame, text: str, key: str, wanted: KeyFilter | None = None) -> DataFrame:
    rows = rows.select(F.monotonically_increasing_id().alias("r"), F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    shared = None if wanted is None else rows.sparkSession.sparkContext.broadcast(wanted)
    return rows.mapInArrow(_terms(shared), "r long, doc long, term string, h long, tf long, n long")


def bucket_of(term: str) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(term), F.lit(BUCKETS)), F.lit(0)).cast("int")


def postings(docs: DataFrame, text: str = "text", key: str = "doc_id", wanted: KeyFilter | None = None, name: str = "postings") -> DataFrame:
    """The stored index (term, r, doc, tf, n, bucket), r being a number for the
    document's row.  Rows without a term hold counts: their sum of tf is the
    number of documents that have a term, that of n the number of all terms."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    small_batches(spark)
    rows = _term_rows(docs, text, key, wanted).drop("h").withColumn("bucket", bucket_of("term"))
    rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def item_terms(items: DataFrame, text: str = "text", key: str = "item_id", name: str = "item-terms") -> DataFrame:
    """The stored terms (item, term, h, bucket) of items, each once."""
    rows = _term_rows(items, text, key).where("term is not null")
    return stored(rows.select(F.col("doc").alias("item"), "term", "h", bucket_of("term").alias("bucket")).distinct(), name)


def search(index: DataFrame, asked: DataFrame, top: int = TOP, name: str = "search") -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's best documents; index as
    ``postings`` gives it, for the terms of asked at least, which is as
    ``item_terms`` gives it."""
    total = index.where("term is null").agg(F.sum("tf").alias("docs"), F.sum("n").alias("terms")).first()
    docs, terms = F.lit(total["docs"] or 0).cast("long"), F.lit(total["terms"] or 0).cast("long")
    distinct = asked.select("bucket", "term").distinct()
    df = index.join(small_side(stored(distinct, f"{name}-distinct")), ["bucket", "term"], "left_semi").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000) * F.ln((2 * docs + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    weights = stored(df.select("bucket", "term", weight.alias("w"), F.monotonically_increasing_id().alias("tid")), f"{name}-weights")
    pairs = stored(asked.join(small_side(weights), ["bucket", "term"]).select("item", "tid"), f"{name}-pairs")
    found = index.join(small_side(weights), ["bucket", "term"])
    found = found.withColumns({"nn": 90 * F.col("n") * docs, "ll": terms}).withColumn("m", 10 + F.expr("nn div ll"))
    found = found.select("r", "doc", "tid", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("s")).where("s > 0")
    dealt = found.repartition("r")
    blocks = -(-pairs.count() * row_bytes([x.dataType for x in pairs.schema]) // BROADCAST_BYTES)
    out = None
    for block in range(max(blocks, 1)):
        some = pairs.where(F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1))) == block)
        sums = dealt.join(F.broadcast(some), "tid").groupBy("r", "doc", "item").agg(F.sum("s").alias("score"))
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc"), "r"))
        best = sums.withColumn("rank", rank).where(F.col("rank") <= top)
        best = best.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
        out = best if out is None else out.unionByName(best)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = item_terms(load(spark, sf_dir, "benchmark"))
    wanted = key_filter(stored(asked.select(F.col("h").alias("key")).distinct(), "search-keys"))
    return search(postings(load(spark, sf_dir, "documents"), wanted=wanted), asked)


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS terms FROM documents),
sizes AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, sizes GROUP BY term),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), sizes GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
