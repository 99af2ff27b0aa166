"""Phrase collocations against a plain Python version and the query's SQL."""

import collections
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dagloom.llm import collocations
from tests.llm.helpers import LOWER, awkward, awkward_rows, empty


def plain(rows, least, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER).encode()):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for j in range(i + 1, min(i + 5, len(w)) + 1):
                    f[lang, tuple(w[i:j])] += 1
    held = collections.Counter()
    for (lang, p), c in f.items():
        if c >= least:
            for i in range(len(p)):
                for j in range(i + 1, len(p) + 1):
                    if j - i < len(p):
                        held[lang, p[i:j]] = max(held[lang, p[i:j]], c)
    out = collections.defaultdict(list)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least > 0 and held[lang, p] < a:
            cuts = []
            for k in range(1, len(p)):
                l, r = f[lang, p[:k]], f[lang, p[k:]]
                cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
            score, _, l, r = min(cuts)
            out[lang].append((-score, -a, b" ".join(p), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def rows_with_phrases():
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(60)] + ["Ünï", "漢字", "it's", "THE", "the"]
    fixed = ["new york city", "new york", "of the", "a b a b a", "x x x x x x x", "one two three four five six seven"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(0, 12)):
            words.append(rng.choice(fixed) if rng.random() < 0.4 else rng.choice(vocabulary))
            words.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]))
        rows.append(("".join(words), rng.choice(["en", "en", "de", None, "und"])))
    return rows


@pytest.mark.parametrize("shard", [3 << 20, 900])
def test_phrases(spark, monkeypatch, shard):
    """The same however texts fall into shards."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    rows = rows_with_phrases()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    for least in (2, 15):
        want = plain(rows, least)
        assert found(collocations.collocations(df, least=least)) == want and len(want) > 20
    assert found(collocations.collocations(df, least=2, top=7)) == plain(rows, 2, 7)


@pytest.mark.parametrize("held", [48 << 20, 2000])
def test_a_task_gives_each_state_once(spark, monkeypatch, held):
    """However many shards it has, up to what it may hold; sums stay the same."""
    monkeypatch.setattr(collocations, "SHARD_BYTES", 300)
    monkeypatch.setattr(collocations, "HELD", held)
    rows = rows_with_phrases()
    keys = [collocations.KeyFilter(np.full(4096, 255, np.uint8), 15)]
    filters = type("Held", (), {"value": keys * collocations.WORDS})
    batch = pa.record_batch([pa.array([x or "und" for _, x in rows]), pa.array([x for x, _ in rows])], ["lang", "text"])
    sums, n = collections.Counter(), 0
    for b in collocations._state_rows(filters)(iter([batch, batch])):
        for r in b.to_pylist():
            sums[r["lang"], r["phrase"], r["low"], r["high"]] += r["n"]
            n += 1
    assert (n == len(sums)) == (held > 2000) and n > 100
    words = sum(len(re.findall(rb"[^\x20\x09]+", p)) for t, _ in rows for p in re.split(rb"[.,;:!?\x0A-\x0D]", t.encode()))
    assert sum(n for (_, _, low, _), n in sums.items() if low == 1) == 2 * words


def test_awkward_rows(spark):
    want = plain([(t, lang) for _, t, lang, *_ in awkward_rows()], 3)
    assert found(collocations.collocations(awkward(spark, extra=True), least=3)) == want and want
    assert found(collocations.collocations(empty(spark))) == []


def test_large_numbers(spark):
    """Products beyond 64 bits."""
    counts = spark.createDataFrame([("en", "a b", 2, 10**12), ("en", "a", 1, 10**12 + 7), ("en", "b", 1, 3 * 10**12)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, total long")
    real = collocations.phrase_counts
    collocations.phrase_counts = lambda *a: (totals, counts)
    try:
        got = found(collocations.collocations(counts))
    finally:
        collocations.phrase_counts = real
    assert got == [("en", 1, "a b", 10**12, 10**12 + 7, 3 * 10**12, 10**15, 1000 * 10**12 * 10**15 // ((10**12 + 7) * 3 * 10**12))]


def test_sql(spark, tmp_path):
    rows = rows_with_phrases() * 3
    spark.createDataFrame(rows, "text string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = collocations.op13_collocations(spark, str(tmp_path))
    result = con.execute(collocations.SQL)
    assert [c[0] for c in result.description] == got.columns
    assert found(got) == sorted(result.fetchall()) == plain(rows, 100) != []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=9), max_size=6))
def test_automaton(texts):
    """States partition the strings by where they end."""
    ids = np.array([w for t in texts for w in t], np.int64)
    depth = np.array([min(i + 1, 5) for t in texts for i in range(len(t))], np.int64)
    ends = collections.defaultdict(list)
    for i, d in enumerate(depth.tolist()):
        for k in range(1, d + 1):
            ends[tuple(ids[i - k + 1 : i + 1].tolist())].append(i)
    want = collections.defaultdict(set)
    for s, places in ends.items():
        want[tuple(places)].add(s)
    s = collocations.automaton(ids, depth)
    got = {}
    for end, high, low, n in zip(s.end.tolist(), s.longest.tolist(), s.shortest.tolist(), s.count.tolist()):
        strings = {tuple(ids[end - k + 1 : end + 1].tolist()) for k in range(low, high + 1)}
        places = tuple(ends[max(strings, key=len)])
        assert len(places) == n and end in places
        got[places] = strings
    assert got == want and len(s.end) == len(got)


def test_states_are_of_frequent_strings(spark, monkeypatch):
    """Triples are frequent here and strings of five words are not: a shard
    gives no rows for those."""
    rng, taken, rows = random.Random(4), [], collocations._state_rows
    text = " ".join(rng.choice("abcde") for _ in range(5000))
    monkeypatch.setattr(collocations, "_state_rows", lambda filters: taken.append(filters) or rows(filters))
    docs = spark.createDataFrame([(text, "en")], "text string, lang string")
    _, counts = collocations.phrase_counts(docs, least=12, name="rare")
    words = text.split()
    strings = [" ".join(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1)]
    want = {s: strings.count(s) for s in set(strings) if s.count(" ") < 3}
    got = {r.phrase: r.f for r in counts.collect()}
    assert {s: n for s, n in got.items() if s.count(" ") < 3} == {s: n for s, n in want.items() if n >= 12}
    batch = pa.record_batch([pa.array([text]), pa.array(["en"])], ["text", "lang"])
    states = pa.Table.from_batches(list(rows(taken[0])(iter([batch]))))
    assert sum(x == 5 for x in states.column("high").to_pylist()) < 50
