"""corpus_pipeline.run() against plain Python, stage by stage."""

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
from dagloom.llm import decontam, langid

from tests.llm.helpers import SCHEMA, awkward_rows, words
from tests.llm.test_text_operators import brute_components, brute_kept, brute_tiles, check_packing

NULL = -(1 << 63)


def documents():
    rng = random.Random(11)
    rows = [r for r in awkward_rows() if r[0] != 7]
    vocabulary = ["Haus%d" % i for i in range(80)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows += [(100 + i, " ".join(draw(60)), "de", "a.site.de" if i % 2 else "b.site.de", 1) for i in range(12)]
    rows += [(120, "1234 5678 " * 30, None, "src1", 1), (121, "?! " * 40, None, None, 1)]  # no language
    rows.append((130, " ".join(draw(20) + ITEMS[0].split() + draw(20)), "de", "c.site.de", 1))
    rows.append((131, " ".join(draw(30) + ITEMS[1].upper().split()[15:] + draw(10) + ITEMS[1].split()[:15]), "de", None, 1))
    rows.append((132, " ".join(draw(30) + ITEMS[1].split()[:9]), "de", None, 1))  # too little of it
    return rows


ITEMS = [" ".join(f"q{random.Random(s).randrange(10**6)}x{i}" for i in range(30)) for s in (1, 2)]
BENCHMARK = [(1, ITEMS[0]), (2, ITEMS[1]), (3, None), (4, ""), (5, "no such words anywhere at all")]


def grams(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(raw) - 2)]


def plain_languages(rows):
    """Rows that a language explains: text likelihoods and host shares, which
    are smoothed by the parent domain's and the whole's."""
    size, counts = langid.BUCKETS, defaultdict(Counter)
    for _, text, lang, *_ in rows:
        if lang is not None and len(grams(text)):
            counts[lang].update(grams(text))
    names = sorted(counts)
    logs = []
    for x in names:
        n = sum(counts[x].values())
        logs.append(lambda g, c=counts[x], n=n: math.log((c[g] + 0.05) / (n + 0.05 * size)))
    seen, by = [], defaultdict(Counter)
    for r in rows:
        g = grams(r[1])
        ll = [langid.TEMPER * sum(map(f, g)) for f in logs] + [-langid.TEMPER * len(g) * math.log(size)]
        letters = any(b >= 128 or chr(b).isalpha() for b in (r[1] or "").encode())
        host = r[3] or None
        parts = (host or "").split(".")
        parent = None if host is None else ".".join(parts[-2:]) if len(parts) > 1 else ""
        suffix = parts[-1] if len(parts) > 1 else None
        won = max(range(len(ll)), key=lambda k: (ll[k], -k))
        if letters and won < len(names):
            by["all"][won] += 1
            for kind, value in (("host", host), ("parent", parent), ("suffix", suffix)):
                if value is not None:
                    by[kind, value][won] += 1
        seen.append((r, ll, letters, won if letters and won < len(names) else None, host, parent, suffix))

    def share(key, above, own):
        c = Counter(by[key]) if key[1] is not None else Counter()
        if key[1] is not None and own is not None:  # by the other rows
            c[own] -= 1
        return [(c[k] + langid.KAPPA * a) / (sum(c.values()) + langid.KAPPA) for k, a in enumerate(above)]

    whole = [(by["all"][k] + 1) / (by["all"].total() + len(names)) for k in range(len(names))]
    kept = []
    for r, ll, letters, own, host, parent, suffix in seen:
        place = share(("host", host), share(("parent", parent), whole, own), own)
        ending = share(("suffix", suffix), whole, own)
        score = [a + math.log(h) + math.log(s / b) for a, h, s, b in zip(ll, place, ending, whole)]
        if letters and max(score) >= ll[-1] + math.log(0.01):
            kept.append(r)
    return kept


def key(r):
    return NULL if r[0] is None else r[0]


def test_run(spark, tmp_path, monkeypatch):
    rows = documents()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCHMARK, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    inputs = []

    def recorded(stage):
        def run(spark, docs, sf_dir):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            inputs.append([tuple(r) for r in docs.collect()])
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, recorded(f)) for n, f in corpus_pipeline.STAGES])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()

    whole, known, apart, trimmed, clean = inputs
    order = lambda x: sorted(x, key=repr)
    assert order(whole) == order(rows)
    assert order(known) == order(plain_languages(rows))
    gone = {r[0] for r in rows} - {r[0] for r in known}
    assert {1, 2, 3, 120, 121} <= gone and not gone & set(range(100, 120))

    groups = defaultdict(set)
    for d, n, c in brute_components(known, 5, 80, 100):
        groups[c if n else ("empty", d)].add(d)
    assert order(map(key, apart)) == order(map(min, groups.values()))
    assert set(apart) <= set(known) and len(apart) < len(known) - 15

    assert order((r[0], [x.encode() for x in r[1].split()]) for r in trimmed) == order((d, kept) for d, _, kept in brute_kept(apart))
    assert all(r[4] == len(r[1]) for r in trimmed)

    def leaks(text):
        doc = words(text, lower=True)
        for _, item in BENCHMARK:
            y = words(item, lower=True)
            if y and sum(t[2] for t in brute_tiles(doc, y, decontam.SEED)) >= 0.5 * len(y):
                return True
        return False

    assert order(clean) == order(r for r in trimmed if not leaks(r[1]))
    assert {r[0] for r in trimmed} - {r[0] for r in clean} == {130, 131}

    check_packing([(r[0], r[1]) for r in clean], packed)
    assert {r.doc_id for r in packed} == {r[0] for r in clean}


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
