"""Suffix-array dedup against plain Python versions."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dagloom.llm import suffixes
from dagloom.llm.words import text_bytes
from tests.llm.helpers import SCHEMA, awkward, awkward_rows, empty

N = suffixes.LENGTH


def plain(rows):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) by a table of all strings;
    no two rows share an id but not the text."""
    places = sorted({(d is not None, d or 0, t or "") for d, t in rows})
    first, out = {}, {}
    for place in places:
        raw = place[2].encode()
        gone = np.zeros(len(raw) + 1, np.int8)
        for i in range(len(raw) - N + 1):
            if first.setdefault(raw[i : i + N], (place, i)) != (place, i):
                gone[i : i + N] = 1
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = int((np.diff(gone, prepend=0) > 0).sum())
        out[place] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted([(d, *out[d is not None, d or 0, t or ""]) for d, t in rows], key=repr)


def found(df):
    size = lambda s: sum(s[1::2]) - sum(s[::2])
    return sorted([(r.doc_id, r.n_bytes, size(r.spans), len(r.spans) // 2, r.kept_sha256) for r in df.collect()], key=repr)


def test_spans(spark):
    rows = [(d, t) for d, t, *_ in awkward_rows()]
    assert found(suffixes.repeated_spans(awkward(spark, extra=True))) == plain(rows)
    assert suffixes.repeated_spans(empty(spark)).count() == 0


def messy_rows():
    """Overlaps, borders in characters, runs of one byte and short periods,
    passages after different lead-ins, and a passage that every text has."""
    rng = random.Random(11)
    draw = lambda n: "".join(rng.choice("abcdefgh äé漢 ") for _ in range(n))
    common, other = draw(330), draw(180)
    rows = [(1, "x" * 700), (2, "x" * 99 + "y" * 130), (3, "ab" * 300), (4, "-" * 100), (5, "-" * 99), (6, draw(5000))]
    for i in range(10, 130):
        cut = rng.randrange(0, 60)
        rows.append((i, draw(rng.randrange(0, 200)) + common[cut : 330 - rng.randrange(0, 60)] + draw(rng.randrange(0, 90)) + (other if i % 3 else "")))
    return rows + [(200, rows[20][1]), (201, rows[20][1] + "z"), (202, "q" + rows[6][1])]


@pytest.mark.parametrize("hot", [1_000, 5])
def test_hot_tokens(spark, monkeypatch, hot):
    """The same whether the suffixes of a common token meet in one bucket or are
    dealt out and compared across buckets."""
    monkeypatch.setattr(suffixes, "HOT_ROWS", hot)
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 400 if hot == 5 else 120_000)
    rows = messy_rows()
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3)
    assert found(suffixes.repeated_spans(df)) == plain(rows)


def test_texts_without_repeats(spark):
    rows = messy_rows()
    df = spark.createDataFrame([(d, t, "en", None, 1) for d, t in rows], SCHEMA)
    left = {r.doc_id: r.text for r in suffixes.without_repeated_bytes(df).collect()}
    want = {r.doc_id: r.kept_sha256 for r in suffixes.repeated_spans(df).collect()}
    same = [d for d, t in rows if hashlib.sha256(left[d].encode()).hexdigest() == want[d]]
    assert len(same) > len(rows) // 2  # the others' cuts are within characters
    kept = sorted(left.values())
    again = suffixes.repeated_spans(spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(kept)], SCHEMA))
    assert sum(len(r.spans) for r in again.collect()) < len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=12), min_size=1, max_size=40))
def test_multikey_order(rows):
    m = np.array([list(r.ljust(12, b"\0")) for r in rows], np.uint8)
    order, common = suffixes.multikey_order(m)
    texts = [bytes(m[i]) for i in order]
    assert texts == sorted(texts) and sorted(order) == list(range(len(rows)))
    for a, b, c in zip(texts, texts[1:], common[1:]):
        assert a[:c] == b[:c] and (c == 12 or a[c] != b[c])


def test_anchors_are_found_in_every_string():
    """Equal strings have one suffix that answers for them, at the same place,
    whatever stands around them and wherever blocks end."""
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 300).astype(np.uint8).tobytes().decode()
    texts = ["", "short", passage, "x" * (suffixes._BLOCK - 150) + passage + "tail", "y" * 77 + passage]
    raw, off = text_bytes(pa.array(texts))
    a = suffixes.anchors(raw, off)
    assert sum(a.last - a.first + 1) == sum(max(0, len(t) - N + 1) for t in texts)
    at = lambda s: int(a.at[np.searchsorted(a.first, s, "right") - 1] - s)
    starts = [off[2], off[3] + suffixes._BLOCK - 150, off[4] + 77]
    for i in range(300 - N + 1):
        assert len({at(s + i) for s in starts}) == 1
