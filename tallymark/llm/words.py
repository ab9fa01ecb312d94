"""Words of whole texts as arrays: positions in the UTF-8 bytes and 64-bit names.

All of it is vectorised over a batch of texts, so a task handles a long text and many short ones alike.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Byte classes of words: white space 0, all else 1.
WORDS = np.ones(256, np.uint8)
WORDS[[0x20, 9, 10, 11, 12, 13]] = 0


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Batch:
    """Texts joined by one space each, with the places of their words: runs of bytes of one class but 0.

    ``data``: bytes; ``begin``, ``end``: each text's byte range; ``starts``, ``ends``: each word's;
    ``doc``: each word's text; ``first``: each text's first word (one entry more than texts).
    """

    def __init__(self, texts: list[bytes], classes: np.ndarray = WORDS) -> None:
        joined = b" ".join(texts) + b" " if texts else b""
        self.raw = joined + bytes(16)
        self.data = np.frombuffer(self.raw, np.uint8)
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.end = np.cumsum(sizes + 1) - 1
        self.begin = self.end - sizes
        kind = classes[self.data[: len(joined)]]
        flips = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        if len(kind) and kind[0]:
            flips = np.concatenate(([0], flips))
        run = kind[flips] != 0
        ends = np.append(flips[1:], len(joined))
        self.starts, self.ends = flips[run], ends[run]
        self.first = np.concatenate((np.searchsorted(self.starts, self.begin), [len(self.starts)])) if len(texts) else np.zeros(1, np.int64)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def names(self, seed: int) -> np.ndarray:
        """A 64-bit name for each word, from all its bytes, eight at a time."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        data = self.data
        words = np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1))
        size = self.ends - self.starts
        out = mix(np.full(len(size), seed, np.uint64) + size.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        todo, at = np.arange(len(size)), self.starts.copy()
        left = size.copy()
        while len(todo):
            chunk = np.ascontiguousarray(words[at]).view("<u8")[:, 0]
            part = left < 8
            if part.any():
                chunk[part] &= (_U(1) << (left[part].astype(np.uint64) * _U(8))) - _U(1)
            out[todo] = mix(out[todo] ^ chunk)
            keep = left > 8
            todo, at, left = todo[keep], at[keep] + 8, left[keep] - 8
        return out


def windows(names: np.ndarray, n: int, factor: int) -> np.ndarray:
    """A name for each run of ``n`` consecutive names; the last ``n - 1`` entries are cut off."""
    if len(names) < n:
        return np.zeros(0, np.uint64)
    m = len(names) - n + 1
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out *= _U(factor)
            out += names[k : k + m]
    return mix(out)


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """A mask of ``size`` entries: those in a window of ``n`` entries that begins where ``starts`` is true."""
    edges = np.zeros(size + 1, np.int32)
    at = np.flatnonzero(starts)
    edges[at] += 1
    edges[at + n] -= 1
    return np.cumsum(edges[:size]) > 0
