import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from dagloom.llm import words as W


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\n\x0bé漢", max_size=40)), max_size=8), st.sampled_from([8, 64, 1 << 17]))
def test_split(texts, piece):
    old, W.PIECE = W.PIECE, piece
    try:
        raw, off = W.text_bytes(pa.array(texts, pa.string()))
        w = W.split_words(raw, off, lower=True)
    finally:
        W.PIECE = old
    want = [(x or "").translate({i: i + 32 for i in range(65, 91)}).encode().split() for x in texts]
    low = W.LOWER[raw].tobytes()
    assert [[low[a:b] for a, b in zip(w.start[x:y], w.end[x:y])] for x, y in zip(w.first[:-1], w.first[1:])] == want
    known = {}
    for word, h in zip([y for x in want for y in x], w.hash.tolist()):
        assert known.setdefault(word, h) == h
    assert len(set(known.values())) == len(known)


def test_windows():
    h = np.arange(60, dtype=np.uint64) % 7
    for n in (1, 2, 3, 5, 8, 20, 60):
        x = W.windows(h, n)
        assert len(x) == 61 - n
        known = {}
        for i in range(len(x)):
            assert known.setdefault(tuple(h[i : i + n]), x[i]) == x[i]
        assert len(set(known.values())) == len(known)
    assert len(W.windows(h, 61)) == 0
