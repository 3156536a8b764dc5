"""Hashes of words and of runs of words, for many texts at once."""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

from orbweave.llm.common import splitmix

#: Bytes that separate words: space, and tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Texts are hashed in parts of about so many bytes.
_PART = 1 << 20
#: Runs are hashed in blocks of so many, so that the powers that a worker keeps are small.
_BLOCK = 1 << 16
_MULTIPLIER = 0xD6E8FEB86659FD93


def _powers(base: int, n: int) -> np.ndarray:
    """Powers of a base; those for blocks of the usual size are kept."""
    return _kept_powers(base, n) if n <= 2 * _BLOCK else _made_powers(base, n)


@functools.lru_cache(maxsize=8)
def _kept_powers(base: int, n: int) -> np.ndarray:
    return _made_powers(base, n)


def _made_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of stretches of an array of hashes."""
    n = 1 << max(12, int(len(values)).bit_length())
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, n)[: len(values)], out=sums[1:])
    return splitmix((sums[ends] - sums[starts]) * _powers(pow(base, -1, 1 << 64), n)[starts])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = b"\n".join(texts) + b"\n"
    solid = np.concatenate([[False], ~_SPACE[np.frombuffer(data, np.uint8)]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts = edges[::2]
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    bounds = np.concatenate([[0], np.searchsorted(starts, text_ends)])
    # Words and what is between them take turns; each distinct word is hashed once.
    stretches = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(len(edges) - 1, 0), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)])
    words = stretches.take(pa.array(np.arange(0, len(stretches), 2))).dictionary_encode()
    digests = b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words.dictionary.to_pylist())
    return bounds, np.frombuffer(digests, np.uint64).reshape(-1, 2).T[:, np.asarray(words.indices, np.int64)]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's words begin and the last end, and two independent hashes of each word:
    the halves of a cryptographic one, for which no two words that collide are known."""
    bounds, hashes, start, size = [np.zeros(1, np.int64)], [], 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size > _PART or i + 1 == len(texts):
            b, h = _word_hashes(texts[start : i + 1])
            bounds.append(b[1:] + bounds[-1][-1])
            hashes.append(h)
            start, size = i + 1, 0
    return np.concatenate(bounds), np.concatenate(hashes, axis=1) if hashes else np.zeros((2, 0), np.uint64)


def run_hashes(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of `length` consecutive words, from one of their hashes; runs may span texts."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    base, out = _MULTIPLIER + 2 * length + 2 * salt, np.empty(len(words) - length + 1, np.uint64)
    for first in range(0, len(out), _BLOCK):  # a run's hash doesn't depend on where it starts
        starts = np.arange(min(_BLOCK, len(out) - first))
        out[first : first + _BLOCK] = _stretches(words[first : first + len(starts) + length - 1], starts, starts + length, base)
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, sorted: for short arrays in a fraction of np.unique's time."""
    out = np.sort(hashes)
    new = np.ones(len(out), bool)
    np.not_equal(out[1:], out[:-1], out=new[1:])
    return out if new.all() else out[new]


def shingle_sets(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes: all words as one where it
    has fewer than `length`, none where it has no words."""
    bounds, (words, _) = word_hashes(texts)
    runs, out = run_hashes(words, length), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= length:
            out.append(distinct(runs[a : b - length + 1]))
        else:
            out.append(run_hashes(words[a:b], b - a) if b > a else runs[:0])
    return out
