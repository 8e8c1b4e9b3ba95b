"""Hashed character n-grams of many texts at once, in numpy.

Texts are laid end to end as code points and hashed in blocks of bounded size. A long text goes through several blocks
that overlap by the longest n-gram less one, so each of its n-grams is seen once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points hashed at once.
BLOCK = 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    """Each code point's lower-case letter, or a space if it is none."""
    return np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)], dtype=np.uint32)


def blocks(texts: list[str], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, the starts of the segments in them, the segments' texts). Empty texts have no segment."""
    parts, starts, owners, size = [], [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            if size >= BLOCK:
                yield _points(parts), np.array(starts), np.array(owners)
                parts, starts, owners, size = [], [], [], 0
            part = text[max(0, at - overlap) : at + BLOCK]
            at += BLOCK
            parts.append(part)
            starts.append(size)
            owners.append(k)
            size += len(part)
    if parts:
        yield _points(parts), np.array(starts), np.array(owners)


def _points(parts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")


def hashed(points: np.ndarray, starts: np.ndarray, n: int, overlap: int, inner: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each code point; 1 << bits where it would leave the segment.

    ``inner`` marks segments that go on from a block before: of their overlap, n-grams that lie in it wholly count there.
    """
    size = len(points)
    out = np.full(size, 1 << bits, dtype=np.int32)
    if size >= n:
        h = np.full(size - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h ^= points[k : size - n + 1 + k]
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        out[: size - n + 1] = h >> np.uint32(32 - bits)
    ends = np.append(starts[1:], size)
    for k in range(1, n):
        cut = ends - k
        out[cut[cut >= starts]] = 1 << bits
    for k in range(overlap - n + 1):
        out[starts[inner] + k] = 1 << bits
    return out
