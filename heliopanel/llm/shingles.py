"""Hashed word shingles of many texts at once, with numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from heliopanel.llm.common import SPACES

PASS_CHARS = 1_000_000
PRIME = 0x100000001B3
WORDS = 5


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of PRIME and of its inverse modulo 2 ** 64."""
    n = 1 << bits
    step = np.full(n, PRIME, np.uint64)
    back = np.full(n, pow(PRIME, -1, 1 << 64), np.uint64)
    step[0] = back[0] = 1
    return np.cumprod(step), np.cumprod(back)


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


def passes(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about PASS_CHARS characters; a longer text is a run of its own."""
    run, chars = [], 0
    for text in texts:
        if run and chars + len(text) > PASS_CHARS:
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text) + 1
    if run:
        yield run


def shingle_hashes(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles in text order, their number per text, and a 64-bit hash of each text's word sequence.

    Words are lower-cased runs without white space. A text of fewer words than a shingle has one shingle
    of all its words; a text without words has none.
    """
    codes = lower_table()[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le"), np.uint32)]
    n = len(codes)
    space = np.isin(codes, [ord(c) for c in SPACES])
    edge = np.diff((~space).astype(np.int8), prepend=0)
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = powers(max(20, (n + 1).bit_length()))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n])])
    word = mixed((running[after] - running[first]) * inverse[first])
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(first, text_ends), prepend=0)

    begins = np.cumsum(per_text) - per_text
    chain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * power[:len(word)])])
    width = np.minimum(per_text, words)
    shingles = np.maximum(per_text - words + 1, (per_text > 0).astype(np.int64))
    at = np.repeat(begins - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    until = at + np.repeat(width, shingles)
    hashes = mixed((chain[until] - chain[at]) * inverse[at] + np.repeat(width, shingles).astype(np.uint64))
    whole = mixed((chain[begins + per_text] - chain[begins]) * inverse[np.minimum(begins, n - 1)] + per_text.astype(np.uint64))
    return hashes, shingles, whole


def weighted_sets(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each text: its distinct shingle hashes, sorted, and their TF-IDF weights."""
    begin = 0
    for n in counts.tolist():
        own = np.sort(hashes[begin:begin + n])
        begin += n
        new = np.ones(n, bool)
        new[1:] = own[1:] != own[:-1]
        places = np.flatnonzero(new)
        distinct = own[places]
        yield distinct, np.diff(places, append=n) * idf[(distinct & np.uint64(len(idf) - 1)).astype(np.int64)]
