"""Bigram models: how often each pair of bytes occurs in a language under an encoding.

A model has 65,536 cells of 0 to 255. Models are trained here from the samples of ``samples``, for each encoding that a
language is registered with and for UTF-8; ``operators.scoring`` trains them from a corpus in the same form.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np

from byteloom.tables.registry import REGISTRY
from byteloom.tables.samples import SAMPLES

CELLS = 65_536


def bigrams(data: bytes) -> np.ndarray:
    """The pairs of adjacent bytes, as numbers."""
    b = np.frombuffer(data, np.uint8).astype(np.int32)
    return (b[:-1] << 8) | b[1:] if len(b) > 1 else np.zeros(0, np.int32)


def quantized(counts: np.ndarray) -> np.ndarray:
    """Counts as 0 to 255, on a logarithmic scale."""
    top = counts.max(initial=0)
    return np.rint(255 * np.log1p(counts) / np.log1p(top)).astype(np.uint8) if top else counts.astype(np.uint8)


def variants(text: str) -> str:
    """A sample in the forms in which text occurs."""
    return f"{text}\n{text.lower()}\r\n{text.upper()[: len(text) // 4]} "


@dataclass(frozen=True)
class Models:
    """``weights`` has a row for each model; those of an encoding are together, in its languages' order."""

    keys: tuple[tuple[str, str], ...]  # (language, encoding)
    weights: np.ndarray  # (models, CELLS) uint8
    norms: np.ndarray  # (models,)
    idf: np.ndarray  # (CELLS,) 1 to 255

    def __post_init__(self):
        if self.weights.shape != (len(self.keys), CELLS) or self.weights.dtype != np.uint8:
            raise ValueError(f"{len(self.keys)} models need {CELLS} uint8 cells each, got {self.weights.dtype} {self.weights.shape}")
        if self.idf.shape != (CELLS,) or self.norms.shape != (len(self.keys),) or not np.isfinite(self.norms).all():
            raise ValueError("models need a finite norm each, and an inverse document frequency for each cell")

    def of(self, encoding: str) -> range:
        """The rows of an encoding's models."""
        return self.index.get(encoding, range(0))

    @cached_property
    def by_cell(self) -> np.ndarray:
        """The weights with a row for each cell, so that those of one pair of bytes lie together."""
        return np.ascontiguousarray(self.weights.T)

    @cached_property
    def index(self) -> dict[str, range]:
        return _index(self.keys)


def _index(keys: tuple[tuple[str, str], ...]) -> dict[str, range]:
    found: dict[str, range] = {}
    for row, (_, encoding) in enumerate(keys):
        span = found.get(encoding, range(row, row))
        if span.stop != row:
            raise ValueError(f"the models of {encoding} must be adjacent")
        found[encoding] = range(span.start, row + 1)
    return found


def document_frequency(weights: np.ndarray) -> np.ndarray:
    """1 to 255: the fewer models have a pair, the more it tells."""
    having = (weights > 0).sum(axis=0)
    scaled = np.log((1 + len(weights)) / (1 + having)) / np.log(1 + len(weights))
    return np.where(having > 0, np.clip(np.rint(1 + 254 * scaled), 1, 255), 1).astype(np.uint8)


def build(keys: list[tuple[str, str]], counts: np.ndarray) -> Models:
    weights = np.stack([quantized(c) for c in counts]) if keys else np.zeros((0, CELLS), np.uint8)
    norms = np.sqrt(np.square(weights.astype(np.float64)).sum(axis=1))
    return Models(tuple(keys), weights, norms, document_frequency(weights))


@lru_cache(1)
def standard() -> Models:
    keys = [(lang, e.name) for e in REGISTRY.values() for lang in e.languages if lang in SAMPLES]
    keys += [(lang, "utf-8") for lang in SAMPLES]
    counts = []
    for lang, encoding in keys:
        data = variants(SAMPLES[lang]).encode(encoding, "ignore")
        counts.append(np.bincount(bigrams(data), minlength=CELLS))
    return build(keys, np.array(counts))


# The packed form: magic, count, then name and norm of each model, then all cells. Numbers are big-endian.
MAGIC, MOST_MODELS, MOST_NAME = b"CMD2", 10_000, 256


def pack(models: Models) -> bytes:
    out = [MAGIC, len(models.keys).to_bytes(4, "big")]
    for (lang, encoding), norm in zip(models.keys, models.norms):
        name = f"{lang}/{encoding}".encode()
        out += [len(name).to_bytes(4, "big"), name, struct.pack(">d", norm)]
    return b"".join(out) + models.weights.tobytes()


def unpack(data: bytes) -> Models:
    """Reads the packed form; says what is wrong with data that isn't in it."""

    def number(at: int) -> int:
        if at + 4 > len(data):
            raise ValueError(f"packed models end at {len(data)}, inside a number at {at}")
        return int.from_bytes(data[at : at + 4], "big")

    if data[:4] != MAGIC:
        raise ValueError("packed models must start with CMD2")
    n, at, keys, norms = number(4), 8, [], []
    if n > MOST_MODELS:
        raise ValueError(f"packed models claim to be {n}; {MOST_MODELS} is the most")
    for k in range(n):
        size = number(at)
        if size > MOST_NAME:
            raise ValueError(f"the name of packed model {k} claims {size} bytes; {MOST_NAME} is the most")
        if at + 12 + size > len(data):
            raise ValueError(f"packed models end inside the entry of model {k}")
        lang, _, encoding = data[at + 4 : at + 4 + size].decode().partition("/")
        keys.append((lang, encoding))
        norms.append(float(np.frombuffer(data[at + 4 + size : at + 12 + size], ">f8")[0]))
        at += 12 + size
    if len(data) - at != n * CELLS:
        raise ValueError(f"{n} packed models need {n * CELLS} bytes of cells; there are {len(data) - at}")
    weights = np.frombuffer(data[at:], np.uint8).reshape(n, CELLS)
    return Models(tuple(keys), weights, np.array(norms), document_frequency(weights))
