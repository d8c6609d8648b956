"""Features of whole texts inside tasks, by numbers: each different word and word pair of some hundred texts
is spelled once, its repeats are numpy arrays. ``model.features`` says what the features are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are worked on together.
TEXTS = 512
#: Counts that a task gathers before it adds them up and hands them on.
HELD = 1_000_000


def features_of(words: list[str]) -> list[str]:
    """What ``model.features`` gives for these words."""
    out = [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:], strict=False))]
    for w in words:
        if 4 <= len(w) <= 10 and w[0] != "_":
            out += [f"#{w[i : i + 3]}#" for i in range(len(w) - 2)]
    return out


def chunks(b: pa.RecordBatch, size: int = TEXTS) -> Iterator[pa.RecordBatch]:
    for at in range(0, b.num_rows, size):
        yield b.slice(at, size)


def numbers(words: pa.ListArray, find) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every occurrence of a feature in lists of words; ``find`` numbers an array of spelled
    features, with -1 for one that does not count."""
    count = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(count)), count)
    coded = words.flatten().dictionary_encode()
    names, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = max(len(names), 1)
    long = pc.utf8_length(names).to_numpy(zero_copy_only=False)
    plain = (long >= 4) & (long <= 10) & ~pc.starts_with(names, "_").to_numpy(zero_copy_only=False)
    owner, spelled = [np.arange(len(names))], [names]
    for i in range(8):
        at = np.flatnonzero(plain & (long >= i + 3))
        owner.append(at)
        spelled.append(pc.binary_join_element_wise("#", pc.utf8_slice_codeunits(names.take(pa.array(at)), i, i + 3), "#", ""))
    beside = np.flatnonzero(text[:-1] == text[1:])
    pair, which = np.unique(code[beside] * n + code[beside + 1], return_inverse=True)
    spelled.append(pc.binary_join_element_wise(names.take(pa.array(pair // n)), names.take(pa.array(pair % n)), "_"))
    found = find(pa.concat_arrays(spelled))
    own, double = found[: len(found) - len(pair)], found[len(found) - len(pair) :][which]
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    order = order[own[order] >= 0]
    flat, size = own[order], np.bincount(owners[order], minlength=len(names))
    times = size[code]
    first = (np.cumsum(size) - size)[code]
    single = flat[np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())]
    known = double >= 0
    return np.concatenate([np.repeat(text, times), text[beside][known]]), np.concatenate([single, double[known]])


def cells(words: pa.ListArray, tokens: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, tf) of the known tokens, ordered by text and token."""
    n = max(len(tokens), 1)
    text, token = numbers(words, lambda x: pc.index_in(x, value_set=tokens).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64))
    cell, tf = np.unique(text * n + token, return_counts=True)
    return cell // n, cell % n, tf


def weights(text: np.ndarray, token: np.ndarray, tf: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Sublinear term frequency times idf, of unit length in each of ``n`` texts."""
    v = (1.0 + np.log(tf)) * idf[token]
    length = np.sqrt(np.bincount(text, v * v, n))
    return v / np.where(length > 0, length, 1.0)[text]


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (words, times) to (token, df): texts that hold each token, a text counted ``times`` times. A
    token comes up again when more than ``HELD`` counts have been gathered."""
    held: list[pa.RecordBatch] = []

    def out() -> list[pa.RecordBatch]:
        made = pa.Table.from_batches(held).group_by("token").aggregate([("df", "sum")]).select(["token", "df_sum"]).rename_columns(["token", "df"])
        held.clear()
        return made.to_batches(max_chunksize=50_000)

    for b in batches:
        for c in chunks(b):
            seen: list[pa.StringArray] = []

            def find(x: pa.StringArray, seen=seen) -> np.ndarray:
                coded = x.dictionary_encode()
                seen.append(coded.dictionary)
                return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)

            text, token = numbers(c.column(0), find)
            n = len(seen[0])
            if n:
                cell = np.unique(text * n + token)
                df = np.bincount(cell % n, c.column(1).to_numpy(zero_copy_only=False)[cell // n], n).astype(np.int64)
                held.append(pa.RecordBatch.from_arrays([seen[0], pa.array(df)], names=["token", "df"]))
            if sum(x.num_rows for x in held) > HELD:
                yield from out()
    if held:
        yield from out()
