"""Ranked search against a plain Python version and the query's SQL."""

import collections
import math
import re

import duckdb
import pytest

from dagloom.llm import search
from dagloom.llm.common import key_filter
from tests.llm.helpers import LOWER, awkward, awkward_rows, empty

ITEMS = "item_id long, text string"
ASKED = [(1, "THE w1, w2; w3-w4 Ünï"), (2, None), (3, ""), (4, "one two one"), (5, "no_such_word zzz"), (None, "null id 漢字 text"), (6, "w7 w8 w9 a"), (6, "w10 it's")]


def terms(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER).encode())


def plain(docs, items, top=10):
    counts = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i].update(terms(t))
    out = []
    for item, wanted in asked.items():
        best = []
        for d, c in counts:
            score = 0
            for t in wanted & c.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
                score += w * (1000000000 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                best.append((-score, d is not None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(best)[:top])]
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=repr)


@pytest.mark.parametrize("filtered", [True, False])
def test_search(spark, filtered):
    asked = search.item_terms(spark.createDataFrame(ASKED, ITEMS))
    wanted = key_filter(asked.select("h").distinct(), "h") if filtered else None
    index = search.postings(awkward(spark, extra=True).repartition(3), wanted=wanted)
    want = plain([(d, t) for d, t, *_ in awkward_rows()], ASKED)
    assert found(search.search(index, asked)) == want and len(want) > 20
    assert found(search.search(index, asked, top=3)) == [x for x in want if x[1] <= 3]


def test_blocks_of_items(spark, monkeypatch):
    asked = search.item_terms(spark.createDataFrame(ASKED, ITEMS))
    index = search.postings(awkward(spark))
    whole = found(search.search(index, asked))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 200)
    assert found(search.search(index, asked)) == whole


def test_index_holds_every_term(spark):
    rows = search.postings(awkward(spark)).where("term is not null").collect()
    want = collections.Counter((d, t, n) for d, text, *_ in awkward_rows() for t, n in collections.Counter(terms(text)).items())
    assert collections.Counter((r.doc, r.term.encode(), r.tf) for r in rows) == want
    assert len({(r.bucket, r.term) for r in rows}) == len({r.term for r in rows})


def test_nothing_to_find(spark):
    items = spark.createDataFrame(ASKED, ITEMS)
    assert found(search.search(search.postings(empty(spark)), search.item_terms(items))) == []
    assert found(search.search(search.postings(awkward(spark)), search.item_terms(items.limit(0)))) == []


def test_sql(spark, tmp_path):
    """Equal scores of equal ids apart, the SQL gives the query's rows."""
    docs = [r for k, r in enumerate(awkward_rows()) if r not in awkward_rows()[:k] and r[0] is not None]
    spark.createDataFrame([r[:2] for r in docs], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = [x for x in ASKED[:-1] if x[0] is not None]
    spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = search.op12_lexical_search(spark, str(tmp_path))
    result = con.execute(search.SQL)
    assert [c[0] for c in result.description] == got.columns
    assert found(got) == sorted(result.fetchall(), key=repr) == plain([r[:2] for r in docs], items)
