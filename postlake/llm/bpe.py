"""Operator 2: BPE encoding and decoding over a prefix-sharing trie.

Text is normalised (NFC, lower case code point by code point) and cut into
pre-tokens as the tokenizer file states. Distinct pre-tokens go into a byte
trie; a depth-first walk gives each node the last token of the encoding of its
path. The encoding of a prefix followed by token t is the encoding of the path
iff t merges with nothing before it, which is a property of the pair (last
token before, t) alone; so one pair test per candidate suffix token finds the
state, a shared prefix is encoded once, and a pre-token's ids are read by
walking back from its end state. White space separates pre-tokens and nothing
joins across it, so a group of texts is normalised, cut at spaces and its
distinct pieces numbered by Arrow; only these are looked up in a bounded memory
of the worker or encoded, and ids and decoded texts are gathered by number.

Null text counts as empty: 0 tokens, digests of the empty string. Very long
texts are encoded whole. Repeated rows give repeated results, an empty table
none. The columns of the input other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import json
import marshal
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from . import common

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
#: White space by the Unicode property, as the tokenizer's patterns take it (fixed values).
ASCII_SPACES = "\t\n\x0b\x0c\r"
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zA-ZªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼½¾]|[^a-zA-ZªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+")
ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
BEYOND_LATIN = re.compile("[^\x00-ɏ]")
#: Words remembered by a task in one generation; states and pair tests as a multiple of it.
#: Workers live on between tasks, so a task forgets all but the pair tests, the file's own, at its end.
MEMORY = 100_000


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that
    print stand for themselves, the others for the code points from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in prints else spare))
        spare += b not in prints
    return out


class Vocabulary:
    """Tokens and merge ranks of a byte-level BPE file with a word-end suffix."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = _byte_symbols()
        reached = {a + b for a, b in merges} | set(self.symbols) | {s + self.end for s in self.symbols}
        self.tokens = sorted(t for t in self.ids if t in reached)
        ends = [bool(self.end) and t.endswith(self.end) and len(t) > len(self.end) for t in self.tokens]
        #: Numbers of the tokens inside words, and of those at a word's end by their text without the suffix.
        self.inner = {t: k for k, (t, e) in enumerate(zip(self.tokens, ends, strict=True)) if not e}
        self.final = {t[: -len(self.end)]: k for k, (t, e) in enumerate(zip(self.tokens, ends, strict=True)) if e} if self.end else self.inner
        self.prefixes = {t[:n] for found in (self.inner, self.final) for t in found for n in range(len(t) + 1)}
        #: What a number stands for: tokens, a word's beginning, special tokens; each id and text as they stand in a result, a space before.
        self.names = [*self.tokens, "", *self.special]
        self.as_id = pa.array([f" {self.ids[t]}" for t in self.tokens] + [""] + [f" {i}" for i in self.special.values()], pa.large_string())
        self.as_text = pa.array([f" {t}" if t else "" for t in self.names], pa.large_string())
        self.codes = [k.to_bytes(4, "little") for k in range(len(self.names))]
        self._states: dict[str, tuple[str, dict, tuple, tuple]] = {}
        self._joins: dict[int, bool] = {}
        self._packed = b""

    def state(self, begun: str) -> tuple[str, dict, tuple, tuple]:
        """What a path's next step needs: the longest end of it that begins a token, the states that follow by symbol, and
        length and number of the tokens that end the path, longest first: those inside a word and those at its end."""
        known = self._states.get(begun)
        if known is None:
            ends = [begun[k:] for k in range(len(begun))]
            known = self._states[begun] = (begun, {}, *(tuple((len(x), found[x]) for x in ends if x in found) for found in (self.inner, self.final)))
        return known

    def step(self, state: tuple[str, dict, tuple, tuple], symbol: str) -> tuple[str, dict, tuple, tuple]:
        path = state[0] + symbol
        after = state[1][symbol] = self.state(next((path[k:] for k in range(len(path)) if path[k:] in self.prefixes), ""))
        return after

    def forget(self) -> None:
        """Empty the states, which point at each other."""
        for x in self._states.values():
            x[1].clear()
        self._states.clear()

    def pack(self) -> None:
        """Keep the pair tests as one string until ``unpack``: the small objects lie between those of the pieces
        and would keep all that memory from going back."""
        self._packed = marshal.dumps(self._joins)
        self._joins = {}

    def unpack(self) -> None:
        if self._packed:
            self._joins = marshal.loads(self._packed)
            self._packed = b""

    def merged(self, parts: list[str]) -> list[str]:
        """Plain BPE of a few symbols: lowest rank first, leftmost first."""
        parts = list(parts)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get((parts[i], parts[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _split(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def stands(self, left: int, right: int) -> bool:
        """Whether BPE of the two tokens' text gives the two tokens again; with the number of tokens as ``left``, which
        stands for a word's beginning, whether that of the right one alone does."""
        key = left * (len(self.tokens) + 1) + right
        known = self._joins.get(key)
        if known is None:
            if len(self._joins) > 5 * MEMORY:
                self._joins.clear()
            first, then = self.tokens[left : left + 1], self.tokens[right]
            known = self._joins[key] = self.merged([*"".join(first), *self._split(then)]) == [*first, then]
        return known

    def shown(self, word: str) -> str:
        """A word's bytes in the vocabulary's symbols."""
        return word if word.isascii() and word.isprintable() and " " not in word else "".join([self.symbols[b] for b in word.encode()])


def trie_encode(words: Iterable[str], v: Vocabulary) -> dict[str, bytes]:
    """Token numbers (four bytes each) of every distinct word (in byte symbols), shared prefixes encoded once.

    The trie is laid out as the sorted words, whose order is its depth-first
    order: last[i], start[i] and states[i] are those of the path's node at depth i, and
    the next word keeps the states of the prefix it shares with the one before.
    """
    out: dict[str, bytes] = {}
    if len(v._states) > 5 * MEMORY:
        v.forget()
    base = len(v.tokens) + 1
    last, start, states = [base - 1], [0], [v.state("")]
    before = ""
    stands, step, known, codes = v.stands, v.step, v._joins.get, v.codes
    for w in sorted(set(words)):
        n = len(w)
        shared, most = 0, min(n, len(before)) - 1
        while shared < most and w[shared] == before[shared]:
            shared += 1
        del last[shared + 1 :], start[shared + 1 :], states[shared + 1 :]
        state = states[shared]
        i = shared
        for symbol in w[shared : n - 1]:
            i += 1
            state = state[1].get(symbol) or step(state, symbol)
            for size, t in state[2]:
                left = last[i - size]
                ok = known(left * base + t)
                if ok is None:
                    ok = stands(left, t)
                if ok:
                    last.append(t)
                    start.append(i - size)
                    states.append(state)
                    break
            else:
                raise ValueError(f"no encoding of {w!r}")
        symbol = w[n - 1]
        for size, t in (state[1].get(symbol) or step(state, symbol))[3]:
            ok = known(last[n - size] * base + t)
            if ok is None:
                ok = stands(last[n - size], t)
            if ok:
                code, at = codes[t], n - size
                while at:
                    code, at = codes[last[at]] + code, start[at]
                out[w] = code
                break
        else:
            raise ValueError(f"no encoding of {w!r}")
        before = w
    return out


class Codec:
    """Encoder and decoder with a bounded memory of words."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.forget()
        marks = "|".join(re.escape(t) for t in sorted(v.special, key=len, reverse=True))
        self.special = re.compile(f"({marks})") if marks else None
        #: Pieces that are not words: none, and special tokens behind a tab, which no piece of text has.
        self.fixed = {"": b""} | {f"\t{t}": v.codes[len(v.tokens) + 1 + k] for k, t in enumerate(v.special)}

    def forget(self) -> None:
        """Empty the memory of words."""
        self.ids_of: dict[str, bytes] = {}
        self.old_ids: dict[str, bytes] = {}

    def _spaced(self, text: str) -> str:
        """The normalised text with plain spaces for all white space. Nothing joins or moves across white space, and
        none comes or goes."""
        if self.special and "<|" in text and len(cut := self.special.split(text)) > 1:
            return " ".join([f"\t{s}" if i % 2 else self._spaced(s) for i, s in enumerate(cut)])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        for c in SPACES if not text.isascii() else ASCII_SPACES:
            if c in text:
                text = text.replace(c, " ")
        return text

    @staticmethod
    def _pretokens(pieces: list[str]) -> list[list[str]]:
        """The pre-tokens of each normalised piece."""
        if not BEYOND_LATIN.search("".join(pieces)):
            cut = LATIN.findall
            return [[p] if p.isalpha() else cut(p) for p in pieces]
        return [(ANY if BEYOND_LATIN.search(p) else LATIN).findall(p) for p in pieces]

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Token numbers of distinct pieces; words not met before are encoded in one trie. The memory of words has two
        generations: a full one becomes the old one, from which entries in use move over. Pieces of several words are
        put together anew, as few of them come again."""
        known, old = self.ids_of, self.old_ids
        out = list(map(known.get, pieces))
        unmet = []
        for k, code in enumerate(out):
            if code is None:
                p = pieces[k]
                code = old.get(p)
                if code is not None:
                    out[k] = known[p] = code
                elif p in self.fixed:
                    out[k] = self.fixed[p]
                else:
                    unmet.append(k)
        if unmet:
            cut = self._pretokens([pieces[k] for k in unmet])
            words = {w for ws in cut for w in ws}.difference(known)
            for w in words.intersection(old):
                known[w] = old[w]
            shown = {w: self.v.shown(w) for w in words.difference(known)}
            made = trie_encode(shown.values(), self.v)
            for w, x in shown.items():
                known[w] = made[x]
            for k, ws in zip(unmet, cut, strict=True):
                out[k] = b"".join([known[w] for w in ws])
        if len(known) > MEMORY:
            self.old_ids, self.ids_of = known, {}
        return out

    def _pieces(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts one after another, and where each text's begin and the last one's end."""
        cut = pc.split_pattern(pa.array([self._spaced(t) for t in texts], pa.large_string()), " ")
        return cut.values.dictionary_encode(), cut.offsets.to_numpy()

    def digest_batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        pieces, first = self._pieces(texts)
        codes = self.learn(pieces.dictionary.to_pylist())
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes)) // 4)])
        tokens = np.concatenate([[0], np.cumsum(np.diff(ends)[pieces.indices.to_numpy()])])
        numbers = pa.array(np.frombuffer(b"".join(codes), "<u4"))
        cols: list[list] = [np.diff(tokens[first]).tolist()]
        for names in (self.v.as_id, self.v.as_text):
            _, at, shown = names.take(numbers).buffers()
            each = pa.LargeStringArray.from_buffers(len(codes), pa.py_buffer(np.frombuffer(at, np.int64)[ends]), shown)
            _, at, shown = each.take(pieces.indices).buffers()
            data, at = memoryview(shown or b""), np.frombuffer(at, np.int64)[first].tolist()
            cols.append([hashlib.sha256(data[a + 1 : b]).hexdigest() for a, b in zip(at, at[1:])])
        return list(zip(*cols, strict=True))

    def encode(self, text: str | None) -> list[int]:
        pieces, _ = self._pieces([text or ""])
        codes = self.learn(pieces.dictionary.to_pylist())
        numbers = np.frombuffer(b"".join([codes[k] for k in pieces.indices.to_pylist()]), "<u4")
        return [int(x) for x in self.v.as_id.take(pa.array(numbers)).to_pylist()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, as the file names no decoder."""
        names = getattr(self, "_names", None)
        if names is None:
            names = self._names = {i: t for t, i in self.v.ids.items()} | {i: t for t, i in self.v.special.items()}
        return " ".join(names[i] for i in ids)


_CODEC: dict[str, Codec] = {}


def codec(text_of_file: str) -> Codec:
    key = hashlib.md5(text_of_file.encode()).hexdigest()
    if key not in _CODEC:
        _CODEC[key] = Codec(Vocabulary(text_of_file))
    return _CODEC[key]


def encode_digests(docs: DataFrame, tokenizer_path: str, batch_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text. The
    tokenizer file (about 2 MB, fixed) is broadcast; no shuffle."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        c.v.unpack()
        try:
            yield from encoded(c, batches)
        finally:
            c.forget()
            c.v.forget()
            c.v.pack()

    def encoded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            found: list[tuple[int, str, str]] = []
            i, n = 0, len(texts)
            while i < n:
                group, chars = [], 0
                while i < n and (not group or chars < batch_chars):
                    t = texts[i].as_py() or ""
                    group.append(t)
                    chars += len(t)
                    i += 1
                found += c.digest_batch(group)
            cols = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(common.task(run), SCHEMA)


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(common.table(spark, sf_dir, "documents"), default_tokenizer())
