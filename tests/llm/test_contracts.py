"""Every registered query on a small table of awkward rows, by its contract; the two
classifiers against plain loops."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from postlake.llm import bpe, common, pii, quality, registry, toxicity
from test_operators import ITEM, SCHEMA, brute_components, brute_repeats, rows, words

MASK = (1 << 64) - 1


def docs_rows():
    """The awkward rows with one row a doc_id, and a null doc_id."""
    seen, out = set(), []
    for r in rows():
        if r[0] not in seen:
            seen.add(r[0])
            out.append(r)
    bad = [(100 + i, words(30, 300 + i) + (" you idiot" if i % 4 == 0 else " ###$$$ ###" if i % 4 == 1 else ""), "en", "s", 1, 1.0, 1, "q", 1, 1) for i in range(120)]
    return out + bad


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs_rows(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, ITEM), (8, None), (9, "one two three")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(100 + i, int(i % 4 != 1), int(i % 4 == 0)) for i in range(120)] + [(3, None, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "</s>"), (1, 2, "assistant", None), (2, 0, None, "x")], "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


def result(spark, sf, name):
    df = registry.queries()[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    return df.columns, df.collect()


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def texts():
    return {r[0]: r[1] or "" for r in docs_rows()}


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def test_op1(spark, sf):
    cols, got = result(spark, sf, "op1_decontaminate")
    assert {(r.doc_id, r.item_id) for r in got} == {(11, 7), (4, 9)} and {"doc_id", "item_id", "similarity", "start_word"} <= set(cols)


def test_op2(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    _, got = result(spark, sf, "op2_bpe")
    assert len(got) == len(docs_rows())
    for r in got:
        ids = t.encode(texts()[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_op3(spark, sf):
    _, got = result(spark, sf, "op3_neardup")
    want = brute_components([(-1 if i is None else i, t) for i, t in texts().items()], 85)
    names = {}
    for i, (_, root) in want.items():
        if i != -1:
            names[root] = min(names.get(root, i), i)
    for r in got:
        n, root = want[-1 if r.doc_id is None else r.doc_id]
        assert (r.n_shingles, r.component_id) == (n, names.get(root))
        assert r.doc_id is None or r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize(("name", "m", "rest"), [("op4_quality", 5, 0), ("op8_toxicity", 4, 2)])
def test_op4_op8(spark, sf, name, m, rest):
    cols, got = result(spark, sf, name)
    assert cols[:4] == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(docs_rows())
    for r in got:
        assert r.held_out == (crc(r.doc_id) % m == rest) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op5(spark, sf):
    _, got = result(spark, sf, "op5_chat")
    by = {r.conv_id: r for r in got}
    assert set(by) == {1, 2, -7}
    probe = "</s>[INST] ok [/INST]"
    want = {-7: [("user", probe), ("assistant", probe)], 1: [("user", "a [INST] b"), ("assistant", "</s>"), ("assistant", "")], 2: [("", "x")]}
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (by[c].n_turns, by[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)))
        assert (by[c].loss_chars, by[c].loss_sha256) == (len(loss), sha(loss)) and by[c].parsed_ok


def test_op6(spark, sf):
    cols, got = result(spark, sf, "op6_fingerprints")
    assert cols == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id"]
    prints = {}
    for r in got:
        assert r.n_chars == len(texts()[r.doc_id])
        prints.setdefault(texts()[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in prints.values())


def test_op7(spark, sf):
    _, got = result(spark, sf, "op7_pii")
    for r in got:
        base = pii.base_spans(texts()[r.doc_id])
        shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == sha(shown) and (r.spans == shown or r.spans.startswith(shown + "," if shown else ("other:", "secret:")))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in pii.KINDS]
        assert r.n_spans == len([x for x in r.spans.split(",") if x])


def test_op9(spark, sf):
    _, got = result(spark, sf, "op9_sharding")
    counts = Counter(r.shard for r in got)
    assert len(got) == len(docs_rows()) and max(counts.values()) - min(counts.get(s, 0) for s in range(40)) <= 1
    for r in got:
        raw = texts()[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)


def test_op10(spark, sf):
    _, got = result(spark, sf, "op10_repeats")
    mine = [(i, t.encode()) for i, t in texts().items() if i != 12]
    want = {w[0]: w for w in brute_repeats(mine)}
    for r in got:
        if r.doc_id != 12:  # the very long text shares no 50 bytes with the others
            assert tuple(r) == want[r.doc_id]
        else:
            assert r.n_removed == 0


def test_pipeline_on_awkward_rows(spark, sf):
    got = corpus_pipeline.run(spark, sf).collect()
    assert got and len({r.doc_id for r in got}) == len(got) and 11 not in {r.doc_id for r in got}


# ---- operator 4 against plain loops
def mixed(x):
    return int(common.mix(np.array([x & MASK], np.uint64))[0])


def plain_features(text):
    out = Counter()
    chars = [32 if c in " \t\n\x0b\x0c\r" else ord(c) for c in text]
    for size, key in ((3, int(quality._G3)), (4, int(quality._G4))):
        for i in range(len(chars) - size + 1):
            g = chars[i : i + size]
            if 32 in g[1:-1]:
                continue
            h = 0
            for k, c in enumerate(g):
                h = c if not k else ((h << 21) & MASK) ^ (h >> 43) ^ c
            out[mixed((h + size) * key) >> 48] += 1
    hashes = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode()):
        h = sum(int(common._LETTERS[b]) * pow(common._BASE, i, 1 << 64) for i, b in enumerate(w))
        hashes.append(mixed(h + len(w) * 0xD6E8FEB86659FD93))
    for h in hashes:
        out[h >> 48] += 1
    for a, b in zip(hashes, hashes[1:]):
        out[mixed(int(quality._SAME) if a == b else (a * int(quality._PAIR)) ^ b) >> 48] += 1
    return out


def test_quality_features_are_words_pairs_and_character_grams():
    many = ["a bb ccc dddd dddd", "é東京 x\tyz", "", " ", "long " * 30, "x", "ab cd"]
    raw = "".join(many).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in many])
    f, owner = quality.features(np.frombuffer(raw, np.uint8), offsets)
    for i, t in enumerate(many):
        assert Counter(f[owner == i].tolist()) == plain_features(t), t


def test_quality_fit_is_plain_gradient_descent():
    many = [words(12, i) if i % 2 else words(6, i) + " ### $$$" for i in range(24)]
    y = [i % 2 for i in range(24)]
    share, bias = quality.fit(many, y)
    rng = np.random.default_rng(7)
    v = rng.uniform(-1 / quality.DIM, 1 / quality.DIM, (1 << quality.BITS, quality.DIM)).astype(np.float32).astype(float)
    first = rng.uniform(-0.5, 0.5, quality.DIM)
    out = [[float(np.float32(a)), -float(np.float32(a))] for a in first]
    b = [0.0, 0.0]
    step, total = 0, quality.EPOCHS * len(many)
    bags = []
    for t in many:
        c = plain_features(t)
        n = sum(c.values())
        bags.append({k: x / n for k, x in c.items()})
    for _ in range(quality.EPOCHS):
        for i in rng.permutation(len(many)):
            rate = quality.RATE * (1 - step / total)
            step += 1
            hidden = [sum(x * v[k][d] for k, x in bags[i].items()) for d in range(quality.DIM)]
            z = [sum(hidden[d] * out[d][c] for d in range(quality.DIM)) + b[c] for c in (0, 1)]
            e = [np.exp(q - max(z)) for q in z]
            p = [q / sum(e) for q in e]
            p[y[i]] -= 1
            back = [out[d][0] * p[0] + out[d][1] * p[1] for d in range(quality.DIM)]
            for d in range(quality.DIM):
                for c in (0, 1):
                    out[d][c] -= rate * hidden[d] * p[c]
            for c in (0, 1):
                b[c] -= 0.1 * rate * p[c]
            square = sum(x * x for x in bags[i].values())
            for k, x in bags[i].items():
                v[k] -= x * rate / square * np.array(back)
    want = v @ (np.array(out)[:, 1] - np.array(out)[:, 0])
    assert abs(bias - (b[1] - b[0])) < 1e-3
    for t in many:
        assert abs(sum(x * (share[k] - want[k]) for k, x in plain_features(t).items())) < 0.05


# ---- operator 8 against plain loops
def test_toxicity_features():
    text = "YOU are an IDIOT!! you 1diot, sooo trash 42 %%"
    raw = np.frombuffer(text.encode(), np.uint8)
    x = dict(zip(toxicity.NAMES, toxicity.dense(raw, np.array([0, len(raw)]), np.zeros(0, np.uint64), np.zeros(0))[0], strict=True))
    tokens = re.findall("[a-zA-Z]+", text)
    low = [t.lower() for t in tokens]
    assert x["seed_n"] == sum(t in toxicity.SEED for t in low) == 2
    assert x["you_rate"] * len(tokens) == sum(t in toxicity.SECOND for t in low)
    you = [i for i, t in enumerate(low) if t in toxicity.SECOND]
    assert x["near_you"] == sum(t in toxicity.SEED and min(abs(i - j) for j in you) <= 3 for i, t in enumerate(low))
    assert x["hidden_n"] == 1 and x["capitals"] * len(text) == sum(c.isupper() for c in text)
    assert x["exclaim"] * len(text) == text.count("!") and x["digits"] * len(text) == sum(c.isdigit() for c in text)
    assert x["runs"] * len(text) == 1 and abs(x["log_words"] - np.log1p(len(tokens))) < 1e-12


def test_trees_walk_and_reduce_loss():
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(float)
    t = toxicity.Trees(rounds=15).fit(x, y)
    bins = t._bin(x)
    for i in range(0, 400, 37):
        z = t.base
        for tree in t.trees:
            node = tree[0]
            while node[0] == "split":
                node = tree[node[3] if bins[i, node[1]] <= node[2] else node[4]]
            z += t.rate * node[1]
        assert abs(z - t.raw(x[i : i + 1])[0]) < 1e-9
    assert ((t.raw(x) > 0) == (y > 0.5)).mean() > 0.97
    # the first split has the greatest gain of all features and bins
    p = y.mean()
    g, h = y - p, np.full(400, p * (1 - p))
    gain = {}
    for k in range(3):
        for i in range(len(t.edges[k])):
            left = bins[:, k] <= i
            if left.sum() >= t.least and (~left).sum() >= t.least:
                gain[k, i] = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
    assert abs(gain[t.trees[0][0][1:3]] - max(gain.values())) < 1e-9


def test_isotonic_is_the_min_max_fit():
    r = np.random.default_rng(5)
    z = np.sort(r.normal(size=60))
    y = (r.random(60) < 1 / (1 + np.exp(-2 * z))).astype(float)
    xs, ps = toxicity.isotonic(z, y)
    fit = np.array([max(min(y[a : b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)])
    for value in np.unique(fit):
        at = np.flatnonzero(fit == value)
        want = (y[at].sum() + y.mean()) / (len(at) + 1)
        mine = ps[np.searchsorted(xs, z[at[0]])]
        assert mine >= want - 1e-9 and (mine == pytest.approx(want) or mine in ps)
