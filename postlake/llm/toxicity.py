"""Operator 8: toxicity by gradient-boosted trees over dense features.

Features of a whole text: counts and densities of two lexicons (a fixed seed
list of abusive words, and the up to ``LEARNED`` words and word beginnings that the
training rows show most clearly to be far more common under label 1), distance of their hits to second-person words, hits that
appear only after undoing letter substitutions, and rates of capitals,
exclamation and other punctuation, digits, mixed letter-and-symbol words and
long character runs. Trees are fitted with logistic loss on binned features in
numpy; an isotonic fit on training rows kept out of the trees maps their output
to a probability.

At most ``max_rows`` labelled rows (documented bound, lowest hash of doc_id
first) reach the driver. The model is a few KB and is broadcast. Every row is
scored over its whole text. Null and empty texts have all features 0 and are
scored like any other; without labels of both classes the score is the share of
label 1 (0.5 without any); null labels are left out; repeated rows score alike;
an empty table gives no rows. Only doc_id and text are read; a column that has the
score's name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .quality import remainder, training_rows

MAX_ROWS = 6000
THRESHOLD = 0.3
LEARNED = 192
#: Lengths in bytes of the word beginnings that may enter the learned lexicon.
STEMS = (4, 5, 6, 7, 8, 10)

#: Seed lexicon (fixed values).
SEED = """idiot moron stupid dumb loser trash garbage scum worthless disgusting pathetic clown fool imbecile
filth vermin hate hateful kill die ugly shut jerk creep coward liar pig rat dirtbag freak lunatic psycho
idiota imbecil estupido estupida basura escoria asqueroso inutil payaso cerdo mierda
idiot imbecile connard ordure dechet minable debile salaud merde
dumm idiotisch abschaum wertlos widerlich versager trottel dreck arschloch schwachkopf""".split()
#: Second-person words (fixed values).
SECOND = "you your yours youre yourself u ur tu te ti tus usted ustedes vosotros vous votre toi du dich dir dein deine sie ihr euch".split()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: Letter substitutions that are undone (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_PLAIN_LUT = common.FOLDED
_LEET_LUT = common.FOLDED.copy()
_LEET = _LETTER.copy()
for _a, _b in SUBSTITUTES.items():
    _LEET_LUT[ord(_a)] = common.FOLDED[ord(_b)]
    _LEET[ord(_a)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True

NAMES = ["seed_n", "seed_rate", "learned_n", "learned_rate", "learned_weight", "near_you", "you_rate", "hidden_n", "hidden_rate", "capitals", "capital_words", "exclaim", "punct", "digits", "mixed", "runs", "log_words"]


def _words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, letters: np.ndarray) -> common.Words:
    return common.Words(data, offsets, letters, member)


def hashes(words: list[str]) -> np.ndarray:
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.unique(_words(raw, np.array([0, len(raw)]), _LETTER, _PLAIN_LUT).hash)


_SEED, _SECOND = hashes(SEED), hashes(SECOND)


def _isin(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def _forms(w: common.Words) -> list[np.ndarray]:
    """The hashes under which a word may stand in the learned lexicon: its own and its beginnings'."""
    return [w.hash, *(w.prefix(k) for k in STEMS)]


def dense(data: np.ndarray, offsets: np.ndarray, learned: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Feature matrix of a run of documents."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)

    def by_doc(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.float64)])
        return total[first[1:]] - total[first[:-1]]

    w = _words(data, offsets, _LETTER, _PLAIN_LUT)
    words = np.maximum(np.diff(w.first), 1).astype(np.float64)
    seed, second = _isin(w.hash, _SEED), _isin(w.hash, _SECOND)
    weight = np.zeros(len(w.hash))
    for h in _forms(w):
        found = np.flatnonzero(_isin(h, learned))
        weight[found] = np.maximum(weight[found], weights[np.searchsorted(learned, h[found])])
    known = weight > 0
    bad = seed | known
    you = np.flatnonzero(second)
    hit = np.flatnonzero(bad)
    close = np.zeros(len(w.hash), bool)
    if len(you) and len(hit):
        k = np.searchsorted(you, hit)
        d = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - hit), np.abs(you[np.maximum(k - 1, 0)] - hit))
        close[hit] = d <= 3
    leet = _words(data, offsets, _LEET, _LEET_LUT)
    mixed_byte = np.concatenate([[0], np.cumsum(~_LETTER[data])])
    mixed = (mixed_byte[leet.ends] > mixed_byte[leet.starts]) & ((leet.ends - leet.starts) > mixed_byte[leet.ends] - mixed_byte[leet.starts])
    hidden = mixed & (_isin(leet.hash, _SEED) | _isin(leet.hash, learned))
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = ((upper[w.ends] - upper[w.starts]) == (w.ends - w.starts)) & ((w.ends - w.starts) > 1)
    run = np.zeros(len(data), bool)
    if len(data) > 2:
        run[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    seed_n, learned_n, hidden_n = by_doc(seed, w.first), by_doc(known, w.first), by_doc(hidden, leet.first)
    cols = [
        seed_n, seed_n / words, learned_n, learned_n / words, by_doc(weight, w.first), by_doc(close, w.first), by_doc(second, w.first) / words,
        hidden_n, hidden_n / words, by_doc(_UPPER[data], offsets) / size, by_doc(shout, w.first) / words, by_doc(data == 33, offsets) / size,
        by_doc(_PUNCT[data], offsets) / size, by_doc(_DIGIT[data], offsets) / size, by_doc(mixed, leet.first) / words, by_doc(run, offsets) / size,
        np.log1p(np.diff(w.first)),
    ]
    return np.stack(cols, 1) if n else np.zeros((0, len(NAMES)))


def learn_words(texts: list[str], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of the words and beginnings whose share of documents is far larger under label 1."""
    found = []
    for i, t in enumerate(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        h = np.unique(np.concatenate(_forms(_words(raw, np.array([0, len(raw)]), _LETTER, _PLAIN_LUT))))
        h = h[h != 0]
        found.append((h, np.full(len(h), y[i])))
    h, lab = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    uniq, inv = np.unique(h, return_inverse=True)
    pos = np.bincount(inv, weights=lab, minlength=len(uniq))
    neg = np.bincount(inv, minlength=len(uniq)) - pos
    np_, nn = max(y.sum(), 1), max((1 - y).sum(), 1)
    odds = np.log(((pos + 0.5) / (np_ + 1)) / ((neg + 0.5) / (nn + 1)))
    expected = (pos + neg) * np_ / (np_ + nn)
    z = (pos - expected) / np.sqrt(expected + 1e-9)
    keep = np.flatnonzero((z > 5) & (odds > 1.5) & (pos >= 4))
    keep = keep[np.argsort(-z[keep])][:LEARNED]
    keep = keep[np.argsort(uniq[keep])]
    return uniq[keep], odds[keep]


class Trees:
    """Gradient-boosted depth-3 trees over at most 32 bins a feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.edges: list[np.ndarray] = []
        self.trees: list[list] = []
        self.base = 0.0

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1]), np.unique(c)[1 : self.bins // 2] if len(np.unique(c)) < self.bins else []])) for c in x.T]
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-z))
            g, h = y - q, q * (1 - q)
            tree: list = []
            self._grow(tree, b, g, h, np.arange(len(y)), 0)
            self.trees.append(tree)
            z += self.rate * self._run(tree, b)
        return self

    def _grow(self, tree: list, b, g, h, rows, depth) -> int:
        me = len(tree)
        gs, hs = g[rows].sum(), h[rows].sum()
        tree.append(("leaf", gs / (hs + 1.0)))
        best = (1e-6, None)
        if depth < self.depth and len(rows) >= 2 * self.least:
            for k in range(b.shape[1]):
                m = len(self.edges[k]) + 1
                if m < 2:
                    continue
                c = b[rows, k]
                gl, hl, nl = (np.cumsum(np.bincount(c, weights=v, minlength=m))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                gain[(nl < self.least) | (len(rows) - nl < self.least)] = 0
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (k, i))
        if best[1]:
            k, i = best[1]
            left = b[rows, k] <= i
            lo = self._grow(tree, b, g, h, rows[left], depth + 1)
            hi = self._grow(tree, b, g, h, rows[~left], depth + 1)
            tree[me] = ("split", k, i, lo, hi)
        return me

    def _run(self, tree: list, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(b))
        todo = [(0, np.arange(len(b)))]
        while todo:
            at, rows = todo.pop()
            node = tree[at]
            if node[0] == "leaf":
                out[rows] = node[1]
            else:
                left = b[rows, node[1]] <= node[2]
                todo += [(node[3], rows[left]), (node[4], rows[~left])]
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        z = np.full(len(x), self.base)
        for t in self.trees:
            z += self.rate * self._run(t, b)
        return z


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of a rising step fit, drawn towards the mean by one row."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []
    mean = float(y.mean())
    for zi, yi in zip(z[order], y[order], strict=True):
        blocks.append([zi, zi, yi, 1.0])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    xs = np.array([v for b in blocks for v in (b[0], b[1])])
    ps = np.array([(b[2] + mean) / (b[3] + 1) for b in blocks for _ in (0, 1)])
    return xs, np.maximum.accumulate(ps)


class Model:
    def __init__(self, texts: list[str], labels: list[int]):
        y = np.asarray(labels, float)
        self.trees = None
        self.prior = float(y.mean()) if len(y) else 0.5
        self.learned, self.weights = np.zeros(0, np.uint64), np.zeros(0)
        if len(set(labels)) < 2:
            return
        held = np.arange(len(y)) % 4 == 3
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held = np.zeros(len(y), bool)
        self.learned, self.weights = learn_words([t for t, k in zip(texts, held, strict=True) if not k], y[~held])
        x = np.concatenate([self._features(t) for t in texts])
        self.trees = Trees().fit(x[~held], y[~held])
        rest = held if held.any() else ~held
        self.knots, self.values = isotonic(self.trees.raw(x[rest]), y[rest])

    def _features(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return dense(raw, np.array([0, len(raw)]), self.learned, self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        return np.interp(self.trees.raw(x), self.knots, self.values)


def classifier(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    return Model(*training_rows(docs, labels, "toxic", remainder(F.col("doc_id"), 4) != 2, max_rows))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The columns of ``docs`` and the score of every whole text; no shuffle. An older column of that name goes."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, offsets = common.buffers(batch.column(at))
            x = [dense(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], m.learned, m.weights) for i, j in common.chunks(offsets)]
            p = m.score(np.concatenate(x)) if x else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(common.task(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = classifier(docs, common.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (remainder(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
