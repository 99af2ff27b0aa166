"""Operators over documents against plain Python versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dagloom.llm import codec, decontam, jaccard, langid, lm, media, packing, prefix_tokens, substring
from dagloom.llm.elias_fano import Trie
from dagloom.llm.words import split_words, text_bytes
from tests.llm.helpers import awkward, awkward_rows, empty, rows_of, words

ROWS = awkward_rows()


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def word_ids(text):
    return library_ids(text) + [2]


_word_bpe = library("word_bpe_49k.json")


def library_ids(text):
    return _word_bpe.encode(text or "", add_special_tokens=False).ids


def id_crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ------------------------------------------------------------------ scoring


def test_lm_scores(spark):
    got = lm.scores(awkward(spark, extra=True))
    count = collections.Counter()
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    for d, t, *_ in ROWS:
        if not held(d):
            count.update([*words(t, True), None])
    n, v = sum(count.values()), len(count)
    want = []
    for d, t, *_ in ROWS:
        w = [*words(t, True), None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want.append((d, held(d), len(w), sum(count[x] > 0 for x in w), n, round(base, 6)))
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got.collect())
    assert lm.scores(empty(spark)).count() == 0


def test_lm_counts_of_words_beyond_the_broadcast(spark, monkeypatch):
    """Words that are not broadcast keep their own counts: scores don't change
    with the number of those that are."""
    wide = {(r.doc_id, r.n_tokens): r.score for r in lm.scores(awkward(spark)).collect()}
    monkeypatch.setattr(lm, "TOP", 20)
    few = {(r.doc_id, r.n_tokens): r.score for r in lm.scores(awkward(spark)).collect()}
    assert few.keys() == wide.keys() and all(abs(few[k] - wide[k]) < 1e-6 for k in wide)


def lm_of(texts, held, shards):
    """A plain model of the training texts: probabilities after two words."""
    hashed = split_words(*text_bytes(pa.array(texts)), lower=True)
    seen, events = {}, []
    for i, t in enumerate(texts):
        names = words(t, True)
        seen.update(zip(names, hashed.hash[hashed.first[i] :].tolist()))
        w = ["<s>", "<s>", *names, None]
        events.append(list(zip(w, w[1:], w[2:])))
    seen |= {None: int(lm.END)}
    one, two, three, before, classed = (collections.Counter() for _ in range(5))
    learn = [e for e, h in zip(events, held) if not h]
    one.update(w for e in learn for _, _, w in e)
    n, ends = sum(one.values()), len(learn)
    share = max(1, n // (2 * shards))
    total = one + collections.Counter({"<s>": ends})

    def label(v, w):
        count = ends if v == "<s>" else one[v]
        bits = math.ceil(math.log2(count / share)) if count > share else 0
        return bits, seen[w] & ((1 << bits) - 1)

    for e in learn:
        for u, v, w in e:
            two[v, w] += 1
            three[u, v, w] += 1
            before[u, v, label(v, w)] += 1
            classed[v, label(v, w)] += 1
    single = sum(c == 1 for w, c in one.items() if w is not None)
    whole = n + single + 1

    def p1(w):
        return (ends + 0.1 if w is None else max(one[w], 1)) / whole

    def mass(bits, low):
        at = lambda w: (seen[w] & ((1 << bits) - 1)) == low
        return (sum(c for w, c in one.items() if w is not None and at(w)) + (ends + 0.1) * at(None) + (single + 0.9) / (1 << bits)) / whole

    def p3(u, v, w):
        p2 = (two[v, w] + lm.MU * p1(w)) / (total[v] + lm.MU)
        k = label(v, w)
        s = (classed[v, k] + lm.MU * mass(*k)) / (total[v] + lm.MU) if k[0] else 1.0
        return (three[u, v, w] * s + lm.MU3 * p2) / (before[u, v, k] + lm.MU3)

    return events, p3, one, single, label


def test_lm_scores_against_brute_force(spark):
    """Within what quantising costs, with words that are spread and others."""
    held = [d is None or zlib.crc32(str(d).encode()) % 10 == 0 for d, *_ in ROWS]
    events, p3, one, single, label = lm_of([t or "" for _, t, *_ in ROWS], held, lm.SHARDS_LEAST)
    want = collections.defaultdict(list)
    for (d, *_), e in zip(ROWS, events):
        want[d].append((sum(math.log10(p3(*x)) for x in e), len(e)))
    got = collections.defaultdict(list)
    for r in lm.scores(awkward(spark)).collect():
        got[r.doc_id].append((r.score, r.n_tokens))
    assert got.keys() == want.keys()
    for d in want:
        for (x, n), (y, m) in zip(sorted(got[d]), sorted(want[d])):
            assert n == m and abs(x - y) < 0.02 + 0.006 * n + 0.04 * (n < 20)
    # after any two words, all words' probabilities and the unseen ones' share sum to one
    for u, v in (("<s>", "<s>"), (b"one", b"two"), (b"w1", b"w2"), events[-1][50][:2]):
        assert sum(p3(u, v, w) for w in one) <= 1 + 1e-9


def test_lm_spreads_frequent_words(spark):
    """With a word that stands between all others, the plain model's scores come
    out, each context's probabilities sum to one but for unseen words, and the
    trigrams of a spread word count."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(40)} the" for _ in range(60)) for _ in range(40)]
    texts += ["w1 the w2 the w3 the w4"] * 8
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = [zlib.crc32(str(d).encode()) % 10 == 0 for d in range(len(texts))]
    events, p3, one, single, label = lm_of(texts, held, lm.SHARDS_LEAST)
    assert label(b"the", b"w1")[0] >= 2 and not label(b"w1", b"the")[0]
    for r in lm.scores(df).collect():
        want = sum(math.log10(p3(*x)) for x in events[r.doc_id])
        assert abs(r.score - want) < 0.02 * r.n_tokens
    assert 0.9 < sum(p3(b"w1", b"the", w) for w in one) <= 1 + 1e-9
    assert p3(b"w1", b"the", b"w2") > 1.5 * p3(b"w5", b"the", b"w2")


def test_trie_against_dictionaries():
    rng = np.random.default_rng(1)
    for size in (0, 1, 50, 3000):
        table = np.unique(rng.integers(1, 1 << 63, 60).astype(np.uint64) * np.uint64(2))
        events = np.unique(rng.integers(0, len(table), (size, 3)), axis=0)  # v, u, w
        pairs = np.unique(events[:, [0, 2]], axis=0)
        nodes = np.unique(events[:, :2], axis=0)
        pair_at = {tuple(x): i for i, x in enumerate(pairs.tolist())}
        node_at = {tuple(x): i for i, x in enumerate(nodes.tolist())}
        third = sorted((node_at[v, u], pair_at[v, w]) for v, u, w in events.tolist())
        n4, b4 = (np.array([x[i] for x in third], np.int64) for i in (0, 1))
        logs = lambda n: -rng.integers(0, 200, n) / 25
        two, back, node_back, three = logs(len(pairs)), logs(len(table)), logs(len(nodes)), logs(len(third))
        trie = Trie.open(Trie.build(table, table, table, (pairs[:, 0], pairs[:, 1], two), back, (nodes[:, 0], nodes[:, 1], node_back), (n4, b4, three)))
        asked = np.vstack([events, rng.integers(0, len(table), (500, 3))])
        v, u, w = asked.T
        assert (trie.places("contexts", table) == np.arange(len(table))).all()
        assert (trie.places("words", table + np.uint64(1)) == -1).all()
        log2, place = trie.bigrams(v, w)
        node = trie.nodes(v, u)
        log3, hit = trie.trigrams(v, node, place)
        known = dict(zip(third, three))
        for i, (x, y, z) in enumerate(asked.tolist()):
            p, c = pair_at.get((x, z), -1), node_at.get((x, y), -1)
            assert place[i] == p and node[i] == c
            assert abs(log2[i] - (two[p] if p >= 0 else back[x])) < 1e-9
            assert hit[i] == ((c, p) in known)
            assert abs(log3[i] - (known[c, p] if hit[i] else node_back[c] if c >= 0 else 0)) < 1e-9


# ------------------------------------------------------------------ joins


def brute_components(rows, k, num, den):
    sets = []
    for d, t, *_ in rows:
        w = words(t, True)
        full = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.append((-(1 << 63) if d is None else d, full))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            n = len(a & b)
            if a and b and den * n >= num * (len(a) + len(b) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(d, least.get(root(i), d))
    return sorted((d, len(s), least[root(i)]) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard(spark, k, num):
    got = jaccard.jaccard_components(awkward(spark, extra=True), k, num, 100)
    assert sorted((r.k, r.n, r.component) for r in got.collect()) == brute_components(ROWS, k, num, 100)


def test_jaccard_keys_meet():
    """Any two similar sets share a key, light or heavy, full or sparse."""
    rng = np.random.default_rng(5)
    for num, den in ((90, 100), (80, 100), (50, 100)):
        plan = jaccard.make_plan(num, den, 3, {}, 400)
        for _ in range(300):
            s = int(rng.integers(1, 120))
            a = rng.integers(0, 1 << 62, s).astype(np.uint64)
            drop = int(rng.integers(0, 3 + s // 5))
            b = np.concatenate([a[min(drop, s - 1) :], rng.integers(0, 1 << 62, int(rng.integers(0, 3 + s // 9))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            inter = len(np.intersect1d(a, b))
            if len(a) != inter or len(b) != inter:
                if den * inter >= num * (len(a) + len(b) - inter):
                    assert len(np.intersect1d(jaccard.keys_of(plan, a), jaccard.keys_of(plan, b))), (len(a), len(b), inter)


def similar_sets(rng, plan, s):
    """Two sets whose similarity is just about the plan's threshold."""
    a = np.unique(rng.integers(0, 1 << 62, s).astype(np.uint64))
    apart = int(rng.integers(0, plan.most_apart(s) + 1))
    new = int(rng.integers(0, apart + 1))
    b = np.unique(np.concatenate([a[apart - new :], rng.integers(0, 1 << 62, new).astype(np.uint64)]))
    inter = len(np.intersect1d(a, b))
    return (a, b) if plan.den * inter >= plan.num * (len(a) + len(b) - inter) else similar_sets(rng, plan, s)


def test_similar_sets_share_as_many_lists_as_needed():
    """In the band of the larger one."""
    rng = np.random.default_rng(6)
    most = 0
    for num, den in ((90, 100), (80, 100), (50, 100)):
        plan = jaccard.make_plan(num, den, 3, {}, 6000)
        for _ in range(200):
            a, b = similar_sets(rng, plan, int(rng.integers(plan.light + 1, rng.choice([60, 300, 5000]))))
            band = max(plan.bands(max(len(a), len(b)))[0], 0)
            keys, needs = [], []
            for x in (a, b):
                key, of, need = jaccard.listed(plan, x)
                keys.append(key[of == band])
                needs.append(int(need[of == band][0]))
            assert len(np.intersect1d(*keys)) >= max(needs) >= 1
            most = max(most, *needs)
    assert most > 20


def test_lists_of_few_common_parts_go(spark):
    """Sets that share fewer lists than similar ones do meet in none, and others
    only in the first that they share."""
    row = lambda key, d, need, c, w: (key, d.encode(), 100, 0, need, c, w)
    rows = [row(1, x, 5, 2, 4) for x in "ab"] + [row(2, x, 5, 3, 1) for x in "abc"] + [row(3, x, 5, 4, 3) for x in "abce"]
    lists = spark.createDataFrame(rows, "key long, d binary, n long, band int, need int, c long, w long")
    assert sorted((r.key, bytes(r.d), r.head) for r in jaccard._rarest(lists, "test").collect()) == [(1, b"a", []), (1, b"b", [])]


def test_pairs_come_up_once(spark):
    """Each list of a set names its last ones, up to its own."""
    rows = [(key, d, 100, 0, 1, 2, 1) for key in range(30) for d in (b"a", b"b")]
    lists = spark.createDataFrame(rows, "key long, d binary, n long, band int, need int, c long, w long")
    heads = {(r.key, bytes(r.d)): r.head for r in jaccard._rarest(lists, "test").collect()}
    assert len(heads) == 60 and all(x == list(range(29, max(key, 21), -1)) for (key, _), x in heads.items())
    assert sum(not set(heads[key, b"a"]) & set(heads[key, b"b"]) for key in range(30)) == 1


def test_names_and_repeated_rows(spark):
    """Columns with inner names keep their values, rows without words all stay,
    and of rows with one id and text the least as JSON stays."""
    text = "one two three four five six seven"
    rows = [(1, text, "b", 5), (1, text, "a", 7), (2, text, "c", 8), (3, None, "d", 9), (3, None, "d", 9), (4, "", "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __k string, __t int")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[1], *rows[3:]], key=repr)


def test_one_of_each(spark):
    kept = jaccard.one_of_each(awkward(spark, extra=True))
    assert kept.columns == awkward(spark, extra=True).columns
    comp = collections.defaultdict(set)
    for d, n, c in brute_components(ROWS, 5, 80, 100):
        comp[c if n else ("empty", d)].add(d)
    ids = [r.doc_id for r in kept.collect()]
    real = [None if d == -(1 << 63) else d for c in comp.values() for d in [min(c)]]
    assert sorted(ids, key=repr) == sorted(real, key=repr)
    assert jaccard.one_of_each(empty(spark)).count() == 0
    assert jaccard.jaccard_components(empty(spark), 3, 90, 100).count() == 0


# ------------------------------------------------------------------ tokens


def test_prefix_token_counts(spark):
    t = library("byte_bpe_50k.json")
    want = [(r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS]
    got = prefix_tokens.token_counts(awkward(spark, extra=True), 50)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens") == sorted(want, key=repr)
    assert all(r.over_limit == (r.n_tokens > 50) for r in got.collect())
    assert prefix_tokens.token_counts(empty(spark), 50).count() == 0
    tables = prefix_tokens.prefix_tables(awkward(spark).where("length(text) < 200"))
    assert all(r.counts[0] == 0 for r in tables.collect())


def test_id_files(spark):
    order = sorted(ROWS, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    want, at = [], 0
    for r in order:
        ids = word_ids(r[1])
        want.append((r[0], at, len(ids), id_crc(ids)))
        at += len(ids)
    got = codec.read_ids(codec.write_ids(awkward(spark, extra=True)))
    assert rows_of(got, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert codec.read_ids(codec.write_ids(empty(spark))).count() == 0


def test_codec_round_trips_and_sees_damage():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 63, 64, 65, 1000, 30000):
        for ids in (rng.integers(0, 65536, n), np.zeros(n, int), rng.zipf(1.3, n) % 49408, np.arange(n) % 7):
            assert (codec.decode_ids(codec.encode_ids(ids), n) == ids).all()
    block = codec.write_block(np.array([5, 6]), np.array([3, 1]), np.array([9, 9, 9, 2], np.uint16))
    keys, lengths, ids = codec.read_block(block)
    assert (keys.tolist(), lengths.tolist(), ids.tolist()) == ([5, 6], [3, 1], [9, 9, 9, 2])
    for at in range(4, len(block)):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(Exception):
            codec.read_block(bytes(bad))
    small = codec.encode_ids(np.tile(np.arange(500), 100))
    assert len(small) < 50_000
    with pytest.raises(ValueError):
        codec.encode_ids(np.array([1 << 16]))


def test_codec_beats_order_0_on_real_ids():
    """Real ids of made-up prose: the context models earn clearly more than the
    best static code of single ids would."""
    rng = np.random.default_rng(8)
    made = ["".join(rng.choice(list("aeioustrnlkm"), int(rng.integers(4, 11)))) for _ in range(2000)]
    ids = np.array(word_ids(" ".join(made[min(int(x), 1999)] for x in rng.zipf(1.2, 40_000))))
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    coded = codec.encode_ids(ids)
    assert (codec.decode_ids(coded, len(ids)) == ids).all()
    assert len(coded) * 8 < 0.85 * len(ids) * -(share * np.log2(share)).sum()


def check_packing(rows, got):
    want = collections.Counter((d, id_crc(word_ids(t)), len(word_ids(t))) for d, t in rows)
    cover, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        cover[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.SIZE
    total = sum(r.length for r in got)
    assert total == sum(n * c for (_, _, n), c in want.items())
    by_id = collections.defaultdict(list)
    for (d, _, n), c in want.items():
        by_id[d, n].append(c)
    for key, parts in cover.items():
        assert sum(x[1] for x in parts) == key[1] * sum(by_id[key])
    return total, len(sequences)


def test_packing(spark):
    got = packing.packed_digests(awkward(spark, extra=True)).collect()
    check_packing([(r[0], r[1]) for r in ROWS], got)
    ids = {r[0]: word_ids(r[1]) for r in ROWS}
    for r in got:
        assert r.ids_crc32 == id_crc(ids[r.doc_id][r.start : r.start + r.length])
    assert packing.packed_digests(empty(spark)).count() == 0


def test_packing_short_texts(spark):
    """Very short texts fill their windows too."""
    rows = [(i if i % 7 else None, ["", "a", "of the", "x y z a b"][i % 4]) for i in range(6000)] + [(9000, " ".join(["word"] * 5000))]
    got = packing.packed_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    ids = {t: word_ids(t) for t in {t for _, t in rows}}
    assert sum(r.length for r in got) == (n := sum(len(ids[t]) for _, t in rows))
    whole = collections.Counter((r.doc_id, r.ids_crc32) for r in got if r.length == r.doc_tokens)
    want = collections.Counter((d, id_crc(ids[t])) for d, t in rows)
    assert not whole - want and (want - whole).total() < 20  # few are cut
    assert len({r.sequence_id for r in got}) <= 1.02 * n / packing.SIZE + 2
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE


@pytest.mark.parametrize("lengths", [[3000] * 2000, list(range(1, 4097)) * 3, [4096] * 5, [1], [2049] * 999 + [100] * 50])
def test_packing_plan(lengths):
    n = np.array(lengths)
    b = -(-n // packing.UNIT)
    histogram = np.bincount(b, minlength=packing.SIZE // packing.UNIT + 1)
    plan = packing.make_plan(histogram)
    order = np.argsort(b, kind="stable")
    rank = np.empty(len(b), np.int64)
    rank[order] = np.arange(len(b)) - np.concatenate([[0], np.cumsum(histogram)])[b[order]]
    fill, total = np.zeros(plan.windows, int), 0
    for row, _, size, window, _ in packing.Lookup(plan).assign(n, rank):
        np.add.at(fill, window, size)
        total += size.sum()
    assert total == n.sum() and fill.max() <= packing.SIZE and fill.min() > 0
    assert plan.windows <= 1.02 * n.sum() / packing.SIZE + 2


# ------------------------------------------------------------------ filters


def test_language_id(spark):
    text = {"en": "the house of the rising sun is the one that they all know ", "de": "das haus und der garten sind nicht so groß wie ich dachte "}
    rows = [(i, " ".join([text[x]] * 5), x, "h%d.example.%s" % (i % 2, x), 1) for i, x in enumerate(["en", "de"] * 20)]
    rows += [(100, "12345 67890 !!! ???", None, None, 1), (101, None, "en", "x", 0), (102, text["de"], None, None, 1), (103, text["de"], "en", None, 1), (104, text["en"], "xx", "h0.example.en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    found = {r.k: r for r in langid.identify(langid.evidence(docs, "text", "doc_id", F.col("lang"), F.col("source")), langid.fit(docs.select(F.col("lang").alias("label"), "text"))).collect()}
    assert all(found[r[0]].lang == r[2] for r in rows[:40])
    assert not found[100].accepted and not found[101].accepted
    assert found[102].lang == "de" and found[103].lang == "de" and found[104].lang == "en"
    kept = langid.known_language_only(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {100, 101}
    assert langid.known_language_only(empty(spark)).count() == 0
    assert langid.known_language_only(awkward(spark, extra=True)).count() <= len(ROWS)


def test_rare_and_unmodelled_languages(spark):
    """A language under half a per cent of all text has a model, and a declared
    one without labels does not fall to "und"."""
    from pyspark.sql import functions as F

    text = {"en": "the house of the rising sun is the one that they all know ", "el": "το σπίτι και ο κήπος δεν είναι τόσο μεγάλα όσο νόμιζα "}
    docs = [(i, text["en"] * 20 + str(i), "en", "src0", 1) for i in range(500)] + [(500 + i, text["el"], "el", "src0", 1) for i in range(3)]
    docs = spark.createDataFrame(docs + [(600, text["el"], None, "src0", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    model = langid.fit(docs.select(F.col("lang").alias("label"), "text"), sample_rows=50)
    assert model.languages == ["el", "en"]
    found = {r.k: r.lang for r in langid.identify(langid.evidence(docs, "text", "doc_id", F.col("lang"), F.col("source")), model).collect()}
    assert found[500] == found[502] == found[600] == "el" and found[7] == "en"
    assert langid.known_language_only(docs).count() == 504
    few = langid.Model(["en"], model.table[[1, 2]])
    found = {r.k: (r.lang, r.accepted) for r in langid.identify(langid.evidence(docs, "text", "doc_id", F.col("lang"), F.col("source")), few).collect()}
    assert found[500] == ("el", True) and found[600] == ("und", False) and found[7] == ("en", True)


def test_markup_and_host(spark):
    df = spark.createDataFrame([("https://u@News.Example.de:8080/x?y#z", '<HTML class=a LANG="de-AT">'), (None, None), ("nonsense", "<p lang=fr>")], "url string, html string")
    got = df.select(langid.host_of("url"), langid.declared_of("html")).collect()
    assert [tuple(r) for r in got] == [("news.example.de", "de"), ("", ""), ("", "")]


def test_suffix_and_parent_of_pages(spark):
    """A page that says nothing itself follows its suffix's pages and, where
    suffixes are alike, its parent domain's; markup is read too."""
    text = {"en": "the house of the rising sun is the one that they all know ", "de": "das haus und der garten sind nicht so groß wie ich dachte "}
    labelled = spark.createDataFrame([(x, text[x] * 5) for x in text], "label string, text string")
    page = lambda i, host, body, tag="<html>": (i, f"https://{host}/p{i}", f"{tag}<style>p {{the}}</style><!-- the --><body>{body}")
    far = [page(100 * (x == "de") + i, f"h{i}.s{i}.{end}", text[x] * 5) for x, end in (("en", "uk"), ("de", "de")) for i in range(20)]
    near = [page(300 + 100 * (x == "de") + i, f"h{i}.{x}-site.com", text[x] * 5) for x in text for i in range(20)]
    asked = [page(900, "new.s91.uk", "zq"), page(901, "new.s92.de", "zq"), page(902, "new.en-site.com", "zq"), page(903, "new.de-site.com", "zq"), page(904, "new.s93.org", "zq", '<html lang="de">'), page(905, "new.s94.org", "zq", '<html lang="en">')]
    pages = spark.createDataFrame(far + near + asked + [(None, None, None)], "page_id long, url string, html string")
    assert langid.visible_text(None) is None
    shown = langid.visible_text(far[0][2])
    assert shown.split() == (text["en"] * 5).split()
    found = {r.k: r for r in langid.page_languages(pages, langid.fit(labelled)).collect()}
    assert [found[i].lang for i in range(900, 906)] == ["en", "de", "en", "de", "de", "en"]
    assert all(found[i].posterior > 0.7 for i in range(900, 906)) and not found[-(1 << 63)].accepted


def plain_posteriors(pages, model):
    """(language, posterior) of pages (host, declared, text), by the formula."""
    size = len(model.languages)
    seen, by = [], collections.defaultdict(collections.Counter)
    for host, declared, text in pages:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        ll = [langid.TEMPER * sum(row[g] for g in langid.trigrams(raw).tolist()) for row in model.table]
        letters = any(b >= 128 or chr(b).isalpha() for b in raw.tolist())
        won = ll.index(max(ll))
        own = won if letters and won < size else None
        names = [("host", host), ("parent", ".".join(host.split(".")[-2:])), ("suffix", host.split(".")[-1])] if host else []
        seen.append((ll, letters, own, declared, dict(names)))
        for key in [("all", None), *names]:
            by[key][own] += own is not None
    base = [(by["all", None][k] + 1) / (sum(by["all", None].values()) + size) for k in range(size)]
    out = []
    for ll, letters, own, declared, names in seen:
        def share(kind, above):
            c = [by[kind, names.get(kind)][k] - (k == own) if kind in names else 0 for k in range(size)]
            return [(x + langid.KAPPA * a) / (sum(c) + langid.KAPPA) for x, a in zip(c, above)]

        place, ending = share("host", share("parent", base)), share("suffix", base)
        score = [a + math.log(h) + math.log(s) - math.log(b) for a, h, s, b in zip(ll, place, ending, base)]
        names_ = [*model.languages, declared, "und"]
        none = ll[-1] + math.log(0.01)
        if declared in model.languages:
            score = [x + math.log(langid.TRUST if n == declared else (1 - langid.TRUST) / max(size - 1, 1)) for x, n in zip(score, names_)]
            score += [-math.inf, none - math.log(size)]
        elif declared:
            score += [none + math.log(langid.TRUST), none + math.log(1 - langid.TRUST)]
        else:
            score += [-math.inf, none]
        top = max(score)
        out.append((names_[score.index(top)], 1 / sum(math.exp(x - top) for x in score)) if letters else ("und", 1.0))
    return out


def test_posteriors_of_pages(spark):
    """Markup, suffix, host and parent domain against the formula."""
    text = {"en": "the house of the rising sun is the one that they all know ", "de": "das haus und der garten sind nicht so groß wie ich dachte ", "fr": "la maison et le jardin ne sont pas aussi grands que je pensais "}
    labelled = spark.createDataFrame([(x, text[x] * 5) for x in text], "label string, text string")
    rng = random.Random(6)
    rows = []
    for i in range(80):
        body = " ".join(rng.sample(text[rng.choice(list(text))].split(), rng.randrange(1, 6))) if i % 9 else rng.choice(["", "12 34", "zq"])
        host = rng.choice(["a.site.de", "b.site.de", "x.org", "y.co.fr", "y.co.fr", None])
        rows.append((i, host, rng.choice([None, None, "en", "de", "xx"]), body))
    model = langid.fit(labelled)
    pages = [(i, host and f"http://{host}/", f"<html{f' lang={d}' if d else ''}><b>{body}</b>") for i, host, d, body in rows]
    found = {r.k: (r.lang, r.posterior) for r in langid.page_languages(spark.createDataFrame(pages, "page_id long, url string, html string"), model).collect()}
    want = plain_posteriors([(host, d, langid.visible_text(html)) for (_, host, d, _), (_, _, html) in zip(rows, pages)], model)
    assert [found[i][0] for i in range(80)] == [x for x, _ in want] and len({x for x, _ in want}) > 3
    assert all(abs(found[i][1] - p) < 1e-9 for i, (_, p) in enumerate(want))


def test_labels_that_are_no_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 3)
    rows = spark.createDataFrame([(f"x{i}", "some text") for i in range(4)], "label string, text string")
    assert len(langid.fit(rows.limit(3)).languages) == 3
    with pytest.raises(ValueError, match="no languages"):
        langid.fit(rows)


def test_pages_query(spark, tmp_path):
    text = "das haus und der garten sind nicht so groß wie ich dachte " * 5
    spark.createDataFrame([(1, text, "de")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "http://a.b.de/", f"<p>{text}")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert [tuple(r)[:2] for r in langid.op5_language_id_pages(spark, str(tmp_path)).collect()] == [(7, "de")]


def test_decontamination(spark):
    item = " ".join("q%d" % i for i in range(40))
    half = item.split()
    docs = [
        (1, "clean words only here"),
        (2, "before " + item.upper() + " after"),
        (3, " ".join(half[20:] + ["gap"] * 5 + half[:20])),  # reordered
        (4, " ".join(half[:15])),  # too little
        (5, None),
        (None, item),
        (2, "before " + item.upper() + " after"),
        (7, " ".join(half[:4] * 30)),  # one seed again and again
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", __import__("pyspark").sql.functions.lit(1))
    bench = spark.createDataFrame([(10, item), (11, None), (12, "too short"), (13, " ".join("z%d" % i for i in range(30)))], "item_id long, text string")
    got = decontam.find_leaks(df, bench)
    assert sorted((r.k, r.item_id, round(r.coverage, 3)) for r in got.collect()) == [(-(1 << 63), 10, 1.0), (2, 10, 1.0), (2, 10, 1.0), (3, 10, 1.0)]
    kept = decontam.without_leaks(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 7] and kept.columns == df.columns
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0
    assert decontam.find_leaks(df.limit(0), bench).count() == 0


def brute_tiles(doc, item, least):
    """Plain greedy string tiling, the first of equally long matches."""
    md, mi, out = [False] * len(doc), [False] * len(item), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and not md[i + k] and not mi[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return out
        for x in range(k):
            md[i + x] = mi[j + x] = True
        out.append((i, j, k))


def test_tiling_against_brute_force():
    rng = np.random.default_rng(1)
    for letters in (1, 2, 4, 9):
        for _ in range(25):
            doc, item = (rng.integers(1, letters + 1, int(rng.integers(0, n))).astype(np.uint64) for n in (40, 20))
            assert decontam.tiles(doc, item, 3) == brute_tiles(doc.tolist(), item.tolist(), 3)
    one = np.full(30_000, 7, np.uint64)  # memory and time bounded for repeated words
    assert decontam.tiles(one, one[:15_000]) == [(0, 0, 15_000)]


def test_decontamination_against_brute_force(spark, monkeypatch):
    """Whole result, short items included, by either kind of join."""
    rng = np.random.default_rng(4)
    draw = lambda n: [f"v{x}" for x in rng.integers(0, 12, n)]
    items = [draw(int(rng.integers(1, 30))) for _ in range(25)] + [["a"], [], ["a", "a", "a", "a", "a"]]
    docs = [draw(int(rng.integers(0, 80))) for _ in range(40)] + [["a"] * 300, items[3] + draw(9) + items[4]]
    want = []
    for d, x in enumerate(docs):
        for k, y in enumerate(items):
            if 0 < len(y) < decontam.SEED:
                if any(x[i : i + len(y)] == y for i in range(len(x))):
                    want.append((d, k, 1.0, 1))
            elif y:
                found = brute_tiles(x, y, decontam.SEED)
                if sum(t[2] for t in found) >= 0.5 * len(y):
                    want.append((d, k, round(sum(t[2] for t in found) / len(y), 6), len(found)))
    frame = lambda rows, key: spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(rows)], f"{key} long, text string")
    got = decontam.find_leaks(frame(docs, "doc_id"), frame(items, "item_id"))
    assert sorted((r.k, r.item_id, round(r.coverage, 6), r.tiles) for r in got.collect()) == sorted(want)
    with monkeypatch.context() as m:  # joins that shuffle
        m.setattr(decontam, "small_side", lambda df: df)
        again = decontam.find_leaks(frame(docs, "doc_id"), frame(items, "item_id"), least_words=3)
        assert sorted((r.k, r.item_id, round(r.coverage, 6), r.tiles) for r in again.collect()) == sorted(x for x in want if len(items[x[1]]) >= 3)
    kept = decontam.without_leaks(frame(docs, "doc_id"), frame(items, "item_id"), least_words=6)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(range(len(docs))) - {d for d, k, *_ in want if len(items[k]) >= 6})


def test_short_items_drop_nothing(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the"), (2, "the cat sat"), (3, "a b c d e f g h")], "item_id long, text string")
    assert sorted((r.k, r.item_id) for r in decontam.find_leaks(docs, items).collect()) == [(1, 1), (1, 2), (2, 3)]
    assert [r.doc_id for r in decontam.without_leaks(docs, items).collect()] == [1]


# ------------------------------------------------------------------ media


def plain_features(payload):
    """The feature string, sample by sample, by the formats' rules."""
    def mu(c):
        c = ~c & 255
        size = ((c & 15) * 8 + 132 << (c >> 4 & 7)) - 132
        return -size if c & 128 else size

    def a(c):
        c ^= 0x55
        exp, low = c >> 4 & 7, (c & 15) * 16 + 8
        size = low if exp == 0 else low + 256 << exp - 1
        return size if c & 128 else -size

    def powers(pcm):
        return sum(x * x for x in pcm) // len(pcm), sum((x - y) ** 2 for x, y in zip(pcm[1:], pcm)) // len(pcm)

    def adpcm(block):
        held, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
        out = [held]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEP_SIZE[index])
                move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                held = max(-32768, min(32767, held - move if code & 8 else held + move))
                index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * ((code & 7) - 3))))
                out.append(held)
        return out

    wide = [mu(c) for c in payload]
    samples = [x for i in range(0, len(payload), 64) for x in adpcm(payload[i : i + 64])]
    pcm = []
    for x, y in zip(wide, [*wide[1:], wide[-1]]):
        pcm += [x, (x + y) // 2]
    crc = zlib.crc32(np.array(pcm, "<i2").tobytes())
    (m, n), (p, q) = powers(wide), powers([a(c) for c in payload])
    return f"mu={m},{n};a={p},{q};adpcm={sum(x * x for x in samples) // len(samples)},{samples[-1]};pcm16k={crc:08x}"


def test_media(spark):
    got = media.digests(media.store_payloads(awkward(spark, extra=True)))
    want = []
    for d, t, *_ in ROWS:
        raw = (t or "").encode()
        p = media.padded(raw)
        assert len(p) % 64 == 0 and len(p) >= 64 and p.startswith(raw)
        want.append((d, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert rows_of(got, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=repr)
    same = collections.defaultdict(set)
    for r in got.collect():
        same[r.payload_sha256].add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in same.values())
    assert media.digests(media.store_payloads(empty(spark))).count() == 0
    for r in got.where("doc_id in (4, 10, 40)").collect():
        assert r.feature == plain_features(media.padded(next((x[1] or "") for x in ROWS if x[0] == r.doc_id).encode()))
    files = media.store_payloads(awkward(spark))
    sound = {r.doc_id: r.pcm for r in media.stored_pcm(files).collect()}
    for r in files.where("doc_id in (3, 10, 71)").collect():
        codes = np.frombuffer(media.read_payload(r.media)[1], np.uint8)
        assert sound[r.doc_id] == media.resample(media.MU[codes], 2, 1).astype("<i2").tobytes()
    pcm = media.decoded(media.store_payloads(awkward(spark).where("doc_id = 4"))).first()
    assert len(pcm.pcm) == 2 * 2 * 64


def test_companding_tables():
    assert media.MU[[0, 127, 128, 255]].tolist() == [-32124, 0, 32124, 0]
    assert media.A[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert len(set(media.A.tolist())) == 256 and len(set(media.MU.tolist())) == 255


def test_adpcm_against_one_sample_at_a_time():
    rng = np.random.default_rng(0)
    blocks = rng.integers(0, 256, (40, media.BLOCK)).astype(np.uint8)
    got = media.decode_ima(blocks)
    for block, out in zip(blocks.tolist(), got.tolist()):
        held = int.from_bytes(bytes(block[:2]), "little", signed=True)
        index, want = min(block[2], 88), [held]
        for byte in block[4:]:
            for code in (byte & 15, byte >> 4):
                step = int(media.STEP_SIZE[index])
                diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
                held = max(-32768, min(32767, held - diff if code & 8 else held + diff))
                index = max(0, min(88, index + int(media.INDEX_MOVE[code])))
                want.append(held)
        assert out == want


# ------------------------------------------------------------------ substrings


def brute_kept(rows):
    place = sorted({(-(1 << 63) if d is None else d, t or "") for d, t, *_ in rows})
    first = {}
    for d, t in place:
        w = words(t)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for r in rows:
        d, w = (-(1 << 63) if r[0] is None else r[0]), words(r[1])
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone |= set(range(i, i + 20))
        out.append((r[0], w, [x for i, x in enumerate(w) if i not in gone]))
    return out


def test_substring_dedup(spark):
    want = [(d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()) for d, w, kept in brute_kept(ROWS)]
    got = substring.repeat_digests(awkward(spark, extra=True))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert any(0 < r[2] < r[1] for r in want)
    assert substring.repeat_digests(empty(spark)).count() == 0


def test_windows_of_one_id_at_one_place(spark):
    """Two texts with one id and a window at the same place: one of them goes."""
    same = " ".join("s%d" % i for i in range(25))
    rows = [(None, same + " a b c"), (None, same + " d e"), (3, "x y")]
    got = substring.repeat_digests(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.n_words, r.n_removed) for r in got.collect() if r.doc_id is None) in ([(27, 25), (28, 0)], [(27, 0), (28, 25)])


@pytest.mark.parametrize("shuffled", [False, True])
def test_windows_carry_no_hash_of_texts_unless_ids_repeat(spark, monkeypatch, shuffled):
    """And where they don't fit a broadcast only those that repeat are shuffled,
    with the same result."""
    words = lambda a, z: [f"w{i}" for i in range(a, z)]
    texts = [words(0, 60), words(100, 130) + words(20, 55) + words(200, 230), words(300, 310) + words(10, 45) + words(400, 420)]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    if shuffled:
        monkeypatch.setattr(substring, "small_side", lambda df: df)
    for ids, several in (([0, 1, 2], False), ([0, 1, 1], True)):
        docs = spark.createDataFrame([(i, x) for i, (_, x) in zip(ids, rows)], "doc_id long, text string")
        assert substring._several_texts(docs, "text", "doc_id") == several
        _, covered = substring.find_repeats(docs, several)
        assert sorted((len(r.starts), r.x != 0) for r in covered.collect()) == [(16, several)] * 2
        removed = sorted(r.n_removed for r in substring.repeat_digests(docs).collect())
        assert removed == [0, 35, 35]


def test_without_repeats(spark):
    docs = awkward(spark, extra=True)
    out = substring.without_repeats(docs)
    assert out.schema.simpleString() == docs.schema.simpleString()
    want = [(d, [x.decode() for x in kept]) for d, _, kept in brute_kept(ROWS)]
    assert sorted(((r.doc_id, (r.text or "").split() if r.text is None or r.doc_id != 7 else [r.text]) for r in out.collect()), key=repr) == sorted(want, key=repr)


def test_cover_is_a_difference_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))
    assert substring.ANCHOR + substring.PERIOD - 1 == substring.WINDOW


def test_sizes_of_broadcasts(spark):
    """Nested values count by their lengths."""
    from dagloom.llm.common import side_bytes, small_side

    flat = spark.range(1000).selectExpr("id", "id as b")
    wide = spark.range(1000).selectExpr("id", "struct(array_repeat(1.0D, 200) as n, 1.0D as total) as x", "cast(null as array<double>) as y", "array('abc') as z", "map('a', 1) as m")
    assert side_bytes(flat) == 1000 * 64 and side_bytes(flat.limit(0)) == 0
    assert 1000 * 1600 < side_bytes(wide) < 1000 * 2100
    hint = lambda df, most: "broadcast" in small_side(df, most)._jdf.queryExecution().analyzed().toString().lower()
    assert hint(wide, 1 << 21) and not hint(wide, 1 << 20)


def test_long_sketches_bound_differences():
    """Sketches of any two lengths never differ in more cells than sets do."""
    rng = np.random.default_rng(3)
    for n, m, common in ((10, 12, 8), (200, 190, 150), (1000, 1100, 0), (130, 700, 60), (3000, 2900, 2850)):
        x = rng.integers(0, 1 << 63, n + m, dtype=np.uint64)
        a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:common], x[n : n + m - common]]))
        apart = jaccard.sketches_apart(jaccard.long_sketch(a), jaccard.long_sketch(b))
        assert apart == jaccard.sketches_apart(jaccard.long_sketch(b), jaccard.long_sketch(a)) <= len(np.setxor1d(a, b))
        if m == 2900:
            assert apart > 0.9 * len(np.setxor1d(a, b))


def test_texts_of_megabytes(spark):
    """One very long text among short ones."""
    rng = random.Random(2)
    long = " ".join("w%d" % rng.randrange(3000) for _ in range(400_000))  # two megabytes
    docs = spark.createDataFrame([(1, "short"), (2, long), (3, None)], "doc_id long, text string")
    found = {r.doc_id: r for r in media.digests(media.store_payloads(docs)).collect()}
    assert found[2].payload_sha256 == hashlib.sha256(media.padded(long.encode())).hexdigest()
    counts = {r.doc_id: r.n_tokens for r in prefix_tokens.token_counts(docs, 1024).collect()}
    assert counts[2] == len(library("byte_bpe_50k.json").encode(long, add_special_tokens=False).ids) and counts[3] == 0
    from dagloom.llm import suffixes

    spans = {r.doc_id: r.spans for r in suffixes.repeated_spans(docs.unionByName(docs.where("doc_id = 2").selectExpr("4 as doc_id", "'x' || text as text"))).collect()}
    assert spans[2] == [] and spans[4] == [1, len(long) + 1]
