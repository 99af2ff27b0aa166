"""Language identification by Bayesian evidence fusion.

A row's posterior over languages adds, in logs,

* the likelihood of its text: a naive Bayes model over hashed byte trigrams
  (case of A-Z ignored), tempered by ``TEMPER`` as trigrams are not independent;
* the declared (markup) language, right with the share ``TRUST``;
* the address suffix: how often each language stands under it;
* the host: its own language shares, smoothed towards those of its parent
  domain, and these towards all rows' (``KAPPA`` pseudo-rows each).

Suffix and host counts come from grouped sums of the text likelihood's winners
over all rows; each row is judged by those of the others.  One more class, "und", has all trigrams alike; a row for which
it wins, or that has no letter, is rejected.  A declared language without a
model shares this likelihood and has ``TRUST`` of its weight, so such a row
keeps its declared language unless a model explains its text better.

Every labelled language has a model, however rare it is, fitted on about
``SAMPLE_ROWS`` of its rows (all, if it has fewer), taken by a hash of their
content; everything else covers all rows.  A language takes 128 KB, and more
than ``MOST_LANGUAGES`` labels are an error.

Edge cases: null and empty texts, and texts without a letter, are rejected as
"und"; null or empty declarations and null hosts say nothing; a null id is
reported as null; repeated rows are alike; extra columns are ignored or, in
``known_language_only``, kept; an empty table, or one without labels, rejects
everything it has.
"""

from __future__ import annotations

import html as markup
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dagloom.llm.common import NULL_ID, digest, id_key, load, small_batches, small_side, stored, without
from dagloom.llm.words import LOWER, slices, text_bytes

#: Of each language.
SAMPLE_ROWS = 20_000
#: Labels at most: workers and the driver hold a model of each.
MOST_LANGUAGES = 500
BUCKETS = 1 << 14
TEMPER = 0.3
TRUST = 0.9
KAPPA = 20.0

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def trigrams(raw: np.ndarray) -> np.ndarray:
    """The bucket of the trigram that starts at each byte (two fewer)."""
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    x = LOWER.take(raw).astype(np.uint32)
    h = (x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(18)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (languages + 1, BUCKETS): log likelihood; the last is "und"

    def scores(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, languages + 1) log likelihoods, and each row's letters."""
        n = len(off) - 1
        letters = np.concatenate([[0], np.cumsum(_LETTER.take(raw))])
        out = np.zeros((n, len(self.table)))
        grams = trigrams(raw)
        end = np.maximum(off[1:] - 2, off[:-1])
        for k, row in enumerate(self.table):
            total = np.concatenate([[0.0], np.cumsum(row.take(grams)), [0.0, 0.0]])
            out[:, k] = total[end] - total[off[:-1]]
        return out, letters[off[1:]] - letters[off[:-1]]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labelled: (label, text).  Languages are in alphabetical order."""
    small_batches(labelled.sparkSession)
    rows = labelled.where("label is not null and text is not null")
    if rows.select("label").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels: these are no languages")
    keyed = rows.select("label", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"))
    cut = F.greatest(F.min("h") + 1, F.ceil(F.lit(float(sample_rows << 40)) / F.count("*")).cast("long"))  # one text at least
    sample = keyed.join(F.broadcast(keyed.groupBy("label").agg(cut.alias("cut"))), "label").where("h < cut")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                raw, off = text_bytes(b.column("text"))
                grams = trigrams(raw)
                for label, a, z in zip(b.column("label").to_pylist(), off[:-1].tolist(), off[1:].tolist()):
                    if z - a >= 3:
                        one = np.bincount(grams[a : z - 2], minlength=BUCKETS)
                        if label in sums:
                            sums[label] += one
                        else:
                            sums[label] = one
        for label, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.record_batch([pa.array([label] * len(at)), pa.array(at, pa.int32()), pa.array(x[at], pa.int64())], ["label", "bucket", "n"])

    found = sample.select("label", "text").mapInArrow(counts, "label string, bucket int, n long")
    sums = found.groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    label = got.column("label").combine_chunks().dictionary_encode()
    languages = sorted(label.dictionary.to_pylist())
    table = np.full((len(languages) + 1, BUCKETS), -math.log(BUCKETS))
    order = np.array([languages.index(x) for x in label.dictionary.to_pylist()], int)
    one = np.zeros((len(languages), BUCKETS))
    one[order[np.array(label.indices, int)], np.array(got.column("bucket"), int)] = np.array(got.column("n"))
    table[:-1] = np.log((one + 0.05) / (one.sum(axis=1, keepdims=True) + 0.05 * BUCKETS))
    return Model(languages, table)


def host_of(url: str | Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def declared_of(html: str | Column) -> Column:
    """The main part of the first lang attribute of an html element."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(html) if isinstance(html, str) else html, F.lit("")), r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))


_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<[a-z!?/][^>]*(?:>|\Z)", re.S | re.I)


def visible_text(html: str | None) -> str | None:
    """html without comments, scripts, styles and tags, entities decoded."""
    return None if html is None else markup.unescape(_MARKUP.sub(" ", html))


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "html", 1 << 20):
            text = [visible_text(x) or "" for x in b.column("html").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in ("k", "declared", "host")), pa.array(text, pa.string())], ["k", "declared", "host", "text"])


def identify(rows: DataFrame, model: Model, name: str = "langid") -> DataFrame:
    """rows: (k, t, text, declared, host), the last two may be null.  Returns
    (k, t, lang, posterior, accepted) for each."""
    languages = model.languages
    size = len(languages)
    if not size:
        return rows.select("k", "t", F.lit("und").alias("lang"), F.lit(1.0).alias("posterior"), F.lit(False).alias("accepted"))

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                score, letters = model.scores(*text_bytes(b.column("text")))
                yield pa.record_batch(
                    [b.column(c) for c in ("k", "t", "declared", "host")] + [pa.array(list(score * TEMPER), pa.list_(pa.float64())), pa.array(letters, pa.int64())],
                    ["k", "t", "declared", "host", "ll", "letters"],
                )

    shape = "k long, t binary, declared string, host string, ll array<double>, letters long"
    seen = stored(rows.select("k", "t", "text", "declared", "host").mapInArrow(likelihood, shape), f"{name}-text")
    seen = seen.withColumn("host", F.when(F.col("host") != "", F.col("host"))).withColumns(
        {
            "parent": F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1),
            "suffix": F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)),
            "won": (F.array_position("ll", F.array_max("ll")) - 1).cast("int"),
        }
    )
    usable = seen.where((F.col("letters") > 0) & (F.col("won") < size))
    per = [F.coalesce(F.sum((F.col("won") == k).cast("double")), F.lit(0.0)) for k in range(size)]
    every = usable.agg(F.array(*per).alias("n")).first()["n"]
    base = [(x + 1.0) / (sum(every) + size) for x in every]

    counted = (F.col("letters") > 0) & (F.col("won") < size)

    def shares(column: str, above: Column) -> Column:
        """By the other rows: a row's own winner is its text once more."""
        own = F.when(counted & F.col(column).isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0))
        total = F.coalesce(F.col(f"by_{column}.total"), F.lit(0.0)) - own + KAPPA
        counts = F.coalesce(F.col(f"by_{column}.n"), F.array_repeat(F.lit(0.0), size))
        others = F.transform(counts, lambda c, k: c - F.when(k == F.col("won"), own).otherwise(F.lit(0.0)))
        return F.zip_with(others, above, lambda c, a: (c + KAPPA * a) / total)

    out = seen
    for column in ("host", "parent", "suffix"):
        found = usable.where(F.col(column).isNotNull()).groupBy(column).agg(F.array(*per).alias("n"), F.count("*").cast("double").alias("total"))
        counts = stored(found, f"{name}-{column}")
        out = out.join(small_side(counts.select(column, F.struct("n", "total").alias(f"by_{column}"))), column, "left")
    whole = F.array(*[F.lit(x) for x in base])
    host = shares("host", shares("parent", whole))
    suffix = F.zip_with(shares("suffix", whole), whole, lambda s, b: F.log(s) - F.log(b))
    place = F.zip_with(host, suffix, lambda h, s: F.log(h) + s)
    # of the declared language among the models; null if nothing is declared
    at = F.when(F.col("declared") != "", F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("declared")))
    miss = math.log((1 - TRUST) / max(size - 1, 1))
    said = lambda k: F.when(F.col("at") == k + 1, math.log(TRUST)).when(F.col("at") > 0, miss).otherwise(0.0)
    score = F.transform(F.zip_with(F.slice("ll", 1, size), "place", lambda a, b: a + b), lambda x, k: x + said(k))
    none = F.col("ll")[size] + math.log(0.01)
    other = F.when(F.col("at") == 0, none + math.log(TRUST)).otherwise(float("-inf"))
    und = none + F.when(F.col("at") == 0, math.log(1 - TRUST)).when(F.col("at") > 0, -math.log(size)).otherwise(0.0)
    out = out.withColumns({"place": place, "at": at}).withColumn("score", F.concat(score, F.array(other, und)))
    top = F.array_max("score")
    out = out.withColumns(
        {
            "best": F.array_position("score", top),
            "posterior": 1.0 / F.aggregate(F.transform("score", lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x),
        }
    )
    named = F.element_at(F.array(*[F.lit(x) for x in languages], F.col("declared"), F.lit("und")), F.col("best").cast("int"))
    lang = F.when(F.col("letters") == 0, F.lit("und")).otherwise(named)
    return out.select("k", "t", lang.alias("lang"), F.when(F.col("letters") == 0, 1.0).otherwise(F.col("posterior")).alias("posterior")).withColumn("accepted", F.col("lang") != "und")


def evidence(docs: DataFrame, text: str, key: str, declared: Column | None, host: Column | None) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    rows = docs.select(
        id_key(key).alias("k"), whole.alias("text"),
        (none if declared is None else declared.cast("string")).alias("declared"),
        (none if host is None else host.cast("string")).alias("host"),
    )
    return rows.withColumn("t", digest("text"))


def known_language_only(docs: DataFrame, name: str = "langid") -> DataFrame:
    """docs without rows that no language explains.  lang labels what the model
    is fitted on, so it is no evidence about a row."""
    rows = evidence(docs, "text", "doc_id", None, F.col("source"))
    found = identify(rows, fit(docs.select(F.col("lang").alias("label"), "text")), name)
    gone = stored(found.where("not accepted").select("k", "t").distinct(), f"{name}-gone")
    return without(docs, gone, "text", "doc_id")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: text and source (as the host).  They declare nothing: lang
    holds the labels that the model is fitted on."""
    docs = load(spark, sf_dir, "documents")
    rows = evidence(docs, "text", "doc_id", None, F.col("source"))
    found = identify(rows, fit(docs.select(F.col("lang").alias("label"), "text")), "op5")
    return found.select(F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"), "lang", "posterior", "accepted")


def page_languages(pages: DataFrame, model: Model, name: str = "langid-pages") -> DataFrame:
    """(k, t, lang, posterior, accepted) of pages(page_id, url, html), by their
    text, html element, host, its parent domain and suffix."""
    rows = pages.select(id_key("page_id").alias("k"), declared_of("html").alias("declared"), host_of("url").alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    small_batches(pages.sparkSession)
    shown = rows.mapInArrow(_with_text, "k long, declared string, host string, text string")
    return identify(shown.withColumn("t", digest("text")), model, name)


def op5_language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, by a model of the labelled documents."""
    docs = load(spark, sf_dir, "documents")
    found = page_languages(load(spark, sf_dir, "pages"), fit(docs.select(F.col("lang").alias("label"), "text")), "op5-pages")
    return found.select(F.when(F.col("k") != NULL_ID, F.col("k")).alias("page_id"), "lang", "posterior", "accepted")
