"""Word shingles of whole texts as sorted arrays of 64-bit hashes, with numpy over batches of documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 2**64)
_WORD_BASE = 0xD1342543DE82EF95

#: Bytes of text that are hashed at a time, about.
BATCH_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64, by doubling."""
    out = np.ones(n + 1, dtype=_U)
    done = 1
    while done <= n:
        step = min(done, n + 1 - done)
        out[done : done + step] = out[:step] * _U(pow(base, done, 2**64))
        done += step
    return out


def pieces(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """UTF-8 texts in lists of about BATCH_BYTES; null is empty."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        held.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= BATCH_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text and the number of words), A-Z counting as a-z."""
    joint = b" ".join([b"", *texts, b""]).lower()  # bytes: only A-Z change
    data = np.frombuffer(joint, dtype=np.uint8)
    space = _SPACE[data]
    begin = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(_VALUE[data] * powers(_BASE, len(data))[:-1], out=sums[1:])
    words = mix((sums[end] - sums[begin]) * powers(_UNBASE, len(data))[begin] + (end - begin).astype(_U))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))
    return words, np.searchsorted(begin, starts)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted distinct shingles of text i are ``hashes[offsets[i]:offsets[i + 1]]``.

    A text with fewer than ``size`` words has its whole sequence as one shingle, one without words has none.
    """
    words, first = word_hashes(texts)
    counts = np.diff(first)
    shingle = np.zeros(max(0, len(words) - size + 1), dtype=_U)
    for place in range(size):
        shingle = shingle * _U(_WORD_BASE) + words[place : place + len(shingle)]
    per_text = np.where(counts >= size, counts - size + 1, 0)
    owner = np.repeat(np.arange(len(texts)), per_text)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    hashes = mix(shingle[first[:-1][owner] + within]) if len(owner) else np.zeros(0, _U)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = np.array(
            [_fold(words[first[i] : first[i + 1]]) for i in short], dtype=_U
        )
        hashes, owner = np.concatenate((hashes, whole)), np.concatenate((owner, short))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(texts) + 1))


def _fold(words: np.ndarray) -> int:
    h = len(words)
    for w in words:
        h = (h * _WORD_BASE + int(w)) % 2**64
    return int(mix(np.array([h], dtype=_U))[0])
