"""Operator 12: signatures, bounds and the whole join against brute force; word hashes."""

import random

import numpy as np
import pytest

from postlake.llm import common, jaccard, neardup, shingle
from test_operators import brute_components, docs, key, none, rows, words  # noqa: F401


def hashed(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return data, np.cumsum([0] + [len(r) for r in raw])


def test_word_hashes_depend_on_bytes_alone():
    texts = ["Ab cd", "", "cd\tab\x0bAB", "x" * 300 + " " + "X" * 300, "ab", "ab", "a" * 8, "a" * 9 + " " + "a" * 256, "é É 東京", "cd"]
    data, offsets = hashed(texts)
    w = shingle.SetWords(data, offsets)
    seen, i = {}, 0
    for d, t in enumerate(texts):
        own = [x for x in t.replace("\t", " ").replace("\x0b", " ").split(" ") if x]
        assert w.first[d + 1] - w.first[d] == len(own)
        for x in own:
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            assert seen.setdefault(low, int(w.hash[i])) == int(w.hash[i])
            i += 1
    assert len(set(seen.values())) == len(seen)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_polynomials_stay_apart(spark):
    one = thue_morse(1024)
    two = one.translate(str.maketrans("ab", "ba"))
    for n in (64, 256, 1024, 4096):
        a, b = one[:n] if n <= 1024 else thue_morse(n), (two[:n] if n <= 1024 else thue_morse(n).translate(str.maketrans("ab", "ba")))
        data, offsets = hashed([a, b])
        h = shingle.SetWords(data, offsets).hash
        assert h[0] != h[1]
    df = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id bigint, text string")
    assert {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(df, 85).collect()} == {1: (1, True), 2: (2, True), 3: (1, False)}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(df).collect()} == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("percent", [80, 85, 76])
def test_linked_sets_share_a_signature(percent):
    """Pairs exactly at the threshold, of all small sizes and some large ones."""
    bands = jaccard.Bands(percent)
    r = np.random.default_rng(percent)
    tried = shared = 0
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(12 if n < 60 else 4):
            pool = np.unique(common.mix(r.integers(0, 1 << 63, 3 * n + 8).astype(np.uint64)))
            r.shuffle(pool)
            union = n
            both = -(-percent * union // 100)
            own = int(r.integers(0, union - both + 1))
            a, b = np.sort(pool[: both + own]), np.sort(np.concatenate([pool[:both], pool[both + own : union]]))
            which, sign, guest = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
            equal = len(a) == len(b) == both
            tried += 1
            met = set(sign[which == 0]) & set(sign[which == 1])
            shared += equal or bool(met & set(sign[~guest]))
            ca, cb = jaccard.cells(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), bands)
            assert jaccard.differing(ca, cb) <= union - both <= (len(a) + len(b)) * (100 - percent) // (100 + percent)
    assert shared == tried


def test_far_sets_share_hardly_any():
    bands = jaccard.Bands(80)
    r = np.random.default_rng(3)
    h = np.concatenate([np.sort(common.mix(r.integers(0, 1 << 63, 200).astype(np.uint64))) for _ in range(100)])
    which, sign, _ = jaccard.signatures(h, np.arange(0, 20001, 200), bands)
    assert len(np.unique(sign)) > 0.999 * len(sign) and len(sign) < 1.3 * len(h)


def test_runs_over_batches(spark):
    r = random.Random(2)
    rows_ = [(r.randint(0, 40), r.random() < 0.6, i) for i in range(500)] + [(100 + i, i % 2 > 0, i) for i in range(200)] + [(900, True, i) for i in range(30)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = jaccard.shared(spark.createDataFrame(rows_, "sign bigint, guest boolean, id bigint"), 3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for s, g, i in rows_:
        by.setdefault(s, []).append((g, i))
    want = [(s, g, i, min(m)[1]) for s, m in by.items() if len(m) > 1 and not min(m)[0] for g, i in m]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 300


def test_join_against_brute_force(spark, docs, none):  # noqa: F811
    got = sorted(map(tuple, jaccard.jaccard_join(docs).collect()), key=key)
    mine = rows()
    groups = {}
    for i, (n, root) in brute_components([(i, d[1]) for i, d in enumerate(mine)], 80).items():
        groups.setdefault(root, []).append((i, n))
    want = []
    for members in groups.values():
        name = min((mine[i][0] for i, _ in members if mine[i][0] is not None), default=None)
        want += [(mine[i][0], n, name) for i, n in members]
    assert got == sorted(want, key=key)
    assert jaccard.jaccard_join(none).count() == 0


def family(seed, base, n, step):
    """A chain of texts, each a few words from the one before."""
    w, out, r = words(base, seed).split(), [], random.Random(seed)
    for i in range(n):
        for _ in range(step):
            w[r.randrange(len(w))] = f"z{seed}q{i}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("few", "block"), [(32, 400_000), (3, 3000)])
def test_chains_passages_and_copies(spark, monkeypatch, few, block):
    """Chains, texts around one passage, and small sets; also with all open signatures worked off in small blocks."""
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", block)
    texts = family(1, 120, 40, 2) + family(2, 30, 30, 1) + family(3, 12, 30, 1)
    passage = words(80, 77)
    texts += [passage + " " + words(20 + i % 7, 900 + i) for i in range(60)]
    texts += [" ".join(f"w{(i * 7 + k) % 11}" for k in range(5 + i % 5)) for i in range(60)]
    texts += texts[:20] * 3 + ["one", "one", "a b c d e", "A b c d e"]
    random.Random(1).shuffle(texts)
    numbered = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(numbered, "doc_id bigint, text string")).collect()}
    assert got == brute_components(numbered, 80)


@pytest.mark.parametrize(("n", "span", "buckets"), [(1, 5, 32), (5000, 300, 32), (5000, 1 << 62, 7), (20000, 4000, 70000)])
def test_packed_signatures(n, span, buckets):
    r = np.random.default_rng(n + buckets)
    sign = r.integers(0, 1 << 64, n, dtype=np.uint64)
    guest, ids = r.random(n) < 0.5, r.integers(-span, span, n)
    got = []
    for b, data in zip(*jaccard.pack(sign, guest, ids, buckets), strict=True):
        got += [(int(b), int(v), int(i)) for v, i in zip(*jaccard.unpack(data), strict=True)]
    assert sorted(got) == sorted(((int(s) >> 32) * buckets >> 32, int(s) & 0xFFFFFFFE | int(g), int(i)) for s, g, i in zip(sign, guest, ids, strict=True))


def test_signatures_take_few_bytes(spark):
    """What is shuffled: before, some 13 bytes a signature once compressed, nearly four times the input."""
    texts = [(i, words(200, i)) for i in range(400)]
    bands = jaccard.Bands(80)
    h = [shingle.distinct_sets(*hashed([t])) for _, t in texts]
    n = sum(len(jaccard.signatures(x, begin, bands)[0]) for x, begin in h)
    packs = jaccard.signed(spark.createDataFrame(texts, "id bigint, text string").coalesce(1), 80, 32).collect()
    assert sum(len(jaccard.unpack(p.data)[0]) for p in packs) == n > 60_000
    assert sum(len(p.data) for p in packs) < 6 * n


@pytest.mark.parametrize("held", [1 << 22, 40])
def test_meeting_signatures(spark, monkeypatch, held):
    """Packed signatures meet as plain ones do; where a bucket holds too many, all of it is left to ``shared``."""
    monkeypatch.setattr(jaccard, "HELD", held)
    r = np.random.default_rng(5)
    known = r.integers(0, 1 << 64, 900, dtype=np.uint64)
    packs, plain = [], []
    for _ in range(5):
        sign, guest, ids = r.choice(known, 400), r.random(400) < 0.6, r.integers(0, 1000, 400)
        for b, data in zip(*jaccard.pack(sign, guest, ids, 16), strict=True):
            packs.append((int(b), bytearray(data)))
        plain += [(((int(s) >> 32) * 16 >> 32) << 31 | (int(s) & 0xFFFFFFFF) >> 1, bool(g), int(i)) for s, g, i in zip(sign, guest, ids, strict=True)]
    got = jaccard.meeting(spark.createDataFrame(packs, "bucket int, data binary"), 3)
    loose = got.where("a is null").select("sign", "guest", "id")
    assert [r.n for r in got.where("(n is null) <> (a is null)").collect()] == []
    assert loose.isEmpty() == (held > 40)
    rows_ = got.where("a is not null").drop("n").union(jaccard.shared(loose, 3)).collect()
    by = {}
    for s, g, i in plain:
        by.setdefault(s, []).append((g, i))
    want = [(s, g, i, min(m)[1]) for s, m in by.items() if len(m) > 1 and not min(m)[0] for g, i in m]
    assert sorted(map(tuple, rows_)) == sorted(want) and len(want) > 500
    assert all(r.n == len(by[r.sign]) for r in got.where("a is not null").collect())


def test_buckets_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 30)
    numbered = list(enumerate(family(4, 60, 30, 2) + [words(30, i) for i in range(30)] + family(5, 14, 20, 1)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(numbered, "doc_id bigint, text string")).collect()}
    assert got == brute_components(numbered, 80)


def test_passages_bring_no_sets_together(spark, monkeypatch):
    """Texts around one passage that are otherwise different: before, all sets of the group went to every pair of its blocks, with
    the square of their number. Now few of them are left to blocks, and what links still does."""
    passage = words(60, 5)
    texts = [passage + " " + words(40 + i % 3, 700 + i) for i in range(150)] + family(6, 100, 30, 2)
    numbered = list(enumerate(texts))
    left = []
    real = neardup._cluster_links
    monkeypatch.setattr(jaccard, "FEW", 4)
    monkeypatch.setattr(neardup, "_cluster_links", lambda large, *rest: left.extend(r.id for r in large.select("id").distinct().collect()) or real(large, *rest))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(spark.createDataFrame(numbered, "doc_id bigint, text string")).collect()}
    assert got == brute_components(numbered, 80)
    assert not [i for i in left if i < 150]


def test_narrowed_groups_hold_all_links(spark):
    texts = family(7, 60, 40, 1) + family(8, 25, 30, 1) + [words(50, 9) + " " + words(12 + i, 300 + i) for i in range(20)]
    numbered = list(enumerate(texts))
    df = spark.createDataFrame(numbered, "id bigint, text string")
    reps = jaccard.summarise(df, 80)
    groups = {}
    for r in jaccard.narrowed(df.select("id"), reps, df, 80).collect():
        groups.setdefault(r.sign, set()).add(r.id)
    met = {(a, b) for m in groups.values() for a in m for b in m if a < b}
    sets = [set(shingle.distinct_sets(*hashed([t]))[0].tolist()) for t in texts]
    linked = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked <= met and len(linked) > 40


def test_open_groups(spark):
    """Two members are tested already where they met by signature, not where they meet by shingles."""
    groups = spark.createDataFrame([(s, False, i) for s, m in ((1, (5, 6)), (2, (5, 6, 7)), (3, (7, 8, 9))) for i in m], "sign bigint, guest boolean, id bigint")
    roots = spark.createDataFrame([(7, 7), (8, 7), (9, 7)], "id bigint, root bigint")
    assert {r.sign for r in jaccard._open(groups, roots, 3).collect()} == {2}
    two = jaccard._open(groups, roots, 2)
    assert {r.sign for r in two.collect()} == {1, 2}
    assert sorted(map(tuple, jaccard._listed(two).collect())) == [(5, 6), (5, 7), (6, 7)]
