"""Hashed word shingles of many texts at once, with numpy; used inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False
#: Bytes of a word that are hashed in lanes of eight; longer words get a BLAKE2 digest.
LANES = 4

#: Bytes of text that are hashed together; one longer text is hashed alone.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one array of bytes, where its words start and end, and how many words each text has."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    edge = np.flatnonzero(np.diff(IS_WORD[data].astype(np.int8), prepend=0, append=0))
    starts, ends = edge[::2], edge[1::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    return data, starts, ends, np.diff(np.searchsorted(starts, text_ends), prepend=0)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each word. Words of at most eight bytes are mixed by a bijection with their length, so no two
    of one length collide; every further eight bytes are mixed in likewise, and no sum of parts can cancel."""
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    out = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    for lane in range(LANES):
        some = np.flatnonzero(lengths > 8 * lane) if lane else slice(None)
        left = np.minimum(lengths[some] - 8 * lane, 8)
        part = eight[starts[some] + 8 * lane] & _MASKS[left]
        out[some] = mix(out[some] ^ part)
    for i in np.flatnonzero(lengths > 8 * LANES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


#: The low bytes of a lane that belong to a word, by their number.
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and how many words each text has."""
    data, starts, ends, counts = spans(texts)
    return hashed(data, starts, ends), counts


def chunks(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about CHUNK bytes, with the place of the first; null counts as empty."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if run and size + len(raw) > CHUNK:
            yield start, run
            start, size, run = i, 0, []
        run.append(raw)
        size += len(raw)
    if run:
        yield start, run


def shingle_sets(texts: list, n: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted. A text of fewer than n words is one shingle of its
    own; one without words has none."""
    odd = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    for _, run in chunks(texts):
        hashed, counts = word_hashes(run)
        total = np.zeros(max(0, len(hashed) - n + 1), np.uint64)
        for j in range(n):
            total += hashed[j : j + len(total)] * odd[j]
        total = mix(total)
        at = 0
        for count in counts:
            if count >= n:
                yield np.unique(total[at : at + count - n + 1])
            elif count:
                yield mix((hashed[at : at + count] * odd[:count]).sum(keepdims=True) + np.uint64(count))
            else:
                yield np.empty(0, np.uint64)
            at += count
