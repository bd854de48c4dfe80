"""Numpy hashing of the words of many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Longest word, in bytes, that is hashed with others at once, in blocks of eight; longer ones go to BLAKE2b.
SHORT = 64
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first n bytes of a little-endian block of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a byte buffer, and where each word starts.

    Words are runs without ASCII white space; A-Z are lower-cased. The finaliser is a bijection, so words of one
    length of up to eight bytes never collide; the blocks of longer ones are chained through it, and the state between
    two blocks is mixed, so that no sum of bytes at powers of a base decides. Words of more than ``SHORT``
    bytes take eight bytes of BLAKE2b. Two given words have one hash with a chance of about 2 ** -64; only
    someone who picks words to this end could do better, and only for words of 9 to ``SHORT`` bytes.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = np.concatenate(([False], ~_WHITE[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    lowered = np.concatenate((_LOWER[data], np.zeros(8, np.uint8)))
    blocks = np.ndarray((len(data) + 1,), "<u8", lowered, strides=(1,))  # the eight bytes from each place on
    hashes = mix(lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x2545F4914F6CDD1D))
    left, at = np.arange(len(starts)), 0
    while len(left):
        size = lengths[left] - at
        hashes[left] = mix((hashes[left] ^ (blocks[starts[left] + at] & _FIRST[np.minimum(size, 8)])) * np.uint64(0xA24BAED4963EE407))
        at += 8
        left = left[(size > 8) & (lengths[left] <= SHORT)]
    for i in np.flatnonzero(lengths > SHORT).tolist():
        word = lowered[starts[i] : starts[i] + lengths[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"word").digest(), "little")
    return hashes, starts


def _pieces(data: np.ndarray, size: int = 1 << 21):
    """Cut a buffer at white space into pieces of about ``size`` bytes, to bound memory."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and not _WHITE[data[end]]:
            end += 1
        yield at, data[at:end]
        at = end


def all_word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of a buffer of any size."""
    parts = [(words, starts + at) for at, piece in _pieces(data) for words, starts in [word_hashes(piece)]]
    if not parts:
        return word_hashes(data)
    return np.concatenate([words for words, _ in parts]), np.concatenate([starts for _, starts in parts])


def by_bytes(texts: list[str | None], size: int = 1 << 21):
    """Cut a list of texts into runs of about ``size`` characters."""
    run, held = [], 0
    for text in texts:
        run.append(text)
        held += len(text or "")
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer than k words, but at least one, has its whole word sequence as its one shingle;
    a text without words, or null, has none.
    """
    encoded = [b"" if text is None else text.encode("utf-8", "surrogatepass") for text in texts]
    data = np.frombuffer(b" ".join(encoded), np.uint8)
    words, starts = all_word_hashes(data)
    bounds = np.cumsum([0] + [len(x) + 1 for x in encoded])
    at = np.searchsorted(starts, bounds)
    rolled = words.copy()
    for j in range(1, k):
        rolled[: len(words) - j] = mix(rolled[: len(words) - j] * np.uint64(0xA24BAED4963EE407) + words[j:])
    out = []
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= k:
            out.append(np.unique(rolled[lo : hi - k + 1]))
        elif hi > lo:
            whole = words[lo : lo + 1]
            for j in range(lo + 1, hi):
                whole = mix(whole * np.uint64(0xA24BAED4963EE407) + words[j : j + 1])
            out.append(mix(whole + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
