"""Hashes of words and word n-grams, computed for a slice of texts at once with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(text number, start, end, hash) of every word, and the joined bytes the positions refer to.

    Words are runs of bytes other than space, tab and line ends.
    """
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(begins, start, "right") - 1
    length = end - start
    order = np.argsort(-np.minimum(length, _LONG + 1), kind="stable")
    by_length = length[order]
    value = np.zeros(len(start), np.uint64)
    at, held = start[order], np.zeros(len(start), np.uint64)
    more = np.searchsorted(-np.minimum(by_length, _LONG + 1), -np.arange(_LONG), "left")
    for j in range(_LONG):
        n = more[j]  # words longer than j
        if not n:
            break
        held[:n] = held[:n] * _STEP + _LETTER[raw[at[:n] + j]]
    for i in range(int(np.searchsorted(-np.minimum(by_length, _LONG + 1), -_LONG, "left"))):
        held[i] = int.from_bytes(hashlib.blake2b(joined[at[i] : at[i] + by_length[i]], digest_size=8).digest(), "little")
    value[order] = mix(held)
    return owner, start, end, value, joined


def grams(owner: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of n words within a text."""
    if len(value) < n:
        return owner[:0], value[:0]
    whole = owner[: len(owner) - n + 1] == owner[n - 1 :]
    held = np.zeros(len(owner) - n + 1, np.uint64)
    for j in range(n):
        held = mix(held * _STEP + value[j : len(value) - n + 1 + j])
    return owner[: len(owner) - n + 1][whole], held[whole]


def gram_sets(owner: np.ndarray, value: np.ndarray, texts: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of the distinct n-grams of every text, in order of both.

    A text of fewer than n words, but at least one, has its whole sequence as its one n-gram.
    """
    whole_owner, whole = grams(owner, value, n)
    count = np.bincount(owner, minlength=texts)
    few = np.flatnonzero((count > 0) & (count < n))
    first = np.searchsorted(owner, few)
    short = np.zeros(len(few), np.uint64)
    for j in range(n - 1):
        has = count[few] > j
        short[has] = mix(short[has] * _STEP + value[first[has] + j])
    short = mix(short ^ count[few].astype(np.uint64))
    text, held = np.concatenate([whole_owner, few]), np.concatenate([whole, short])
    order = np.lexsort((held, text))
    text, held = text[order], held[order]
    if len(text):
        new = np.concatenate([[True], (text[1:] != text[:-1]) | (held[1:] != held[:-1])])
        text, held = text[new], held[new]
    return text, held
