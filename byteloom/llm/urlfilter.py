"""URL filters: a bit-parallel wildcard automaton over canonical URLs.

All glob rules are packed into one Shift-And automaton whose states are the bits of as many 64-bit words as they need.
For each byte of a URL, every rule advances at once: states shift by one (with a carry from word to word), are masked by
the bits that accept the byte, and states under a wildcard also stay. A batch of URLs runs side by side in numpy.

In a glob ``*`` stands for any run of bytes without ``/``, ``**`` for any run; all else stands for itself. A glob covers
the canonical URL (host, then path) from its start to its end.

Nulls and edge cases: a null URL, or one without ``://``, has an empty host and path, which fit no host rule; an empty
rule list allows everything; of rules equally long the one listed first wins; repeated rows are judged alike; an empty
table gives no rows. ``judge`` passes on the columns asked for (all, unless told) and replaces any named ``host``,
``path``, ``rule`` or ``verdict``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from byteloom.llm.common import batch_input

#: Cells (URLs x bytes) of a group of URLs that run side by side.
CELLS_AT_ONCE = 1 << 22


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"]


class Automaton:
    """Shift-And over many globs. State 0 of a glob means that nothing has been read yet."""

    def __init__(self, globs: list[str]):
        steps: list[tuple[bytes, str]] = []  # the byte that leads into a state ("" for a first one), and what stays there
        self.finals, first, self.globs = [], [], list(globs)
        for glob in globs:
            first.append(len(steps))
            text, enter, stay, at = glob.encode(), b"", "", 0
            while at < len(text):
                if text[at : at + 2] == b"**":
                    stay, at = "all", at + 2
                elif text[at : at + 1] == b"*":
                    stay, at = stay or "segment", at + 1
                else:
                    steps.append((enter, stay))
                    enter, stay, at = text[at : at + 1], "", at + 1
            steps.append((enter, stay))
            self.finals.append(len(steps) - 1)
        self.words = len(steps) // 64 + 1
        self.accept = np.zeros((256, self.words), "<u8")
        self.stay = np.zeros((256, self.words), "<u8")
        self.start = self._mask(first)
        every, segment = np.arange(256), np.array([b for b in range(256) if b != ord("/")])
        for k, (enter, stay) in enumerate(steps):
            word, bit = k // 64, np.uint64(1 << (k % 64))
            if enter:
                self.accept[enter[0], word] |= bit
            if stay:
                self.stay[every if stay == "all" else segment, word] |= bit

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, "<u8")
        for b in bits:
            out[b // 64] |= np.uint64(1 << (b % 64))
        return out

    def match(self, texts: list[bytes]) -> np.ndarray:
        """(texts, globs): which globs cover which texts."""
        out = np.zeros((len(texts), len(self.globs)), bool)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")[::-1]
        at = 0
        while at < len(order):
            longest = max(1, int(sizes[order[at]]))
            own = order[at : at + max(1, CELLS_AT_ONCE // longest)]
            at += len(own)
            out[own] = self._run([texts[i] for i in own], sizes[own])
        return out

    def _run(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """``sizes`` descends, so the URLs that still have bytes are the first ones."""
        width = int(sizes[0]) if len(sizes) else 0
        cells = np.zeros((len(texts), width), np.uint8)
        for k, t in enumerate(texts):
            cells[k, : len(t)] = np.frombuffer(t, np.uint8)
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        running = np.searchsorted(-sizes, -np.arange(width), side="left")  # how many are longer than each column
        for column in range(width):
            n = running[column]
            now, byte = state[:n], cells[:n, column]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.accept[byte]) | (now & self.stay[byte])
        finals = np.array(self.finals, dtype=np.int64)
        return (state[:, finals // 64] >> (finals % 64).astype("<u8") & one).astype(bool)


def canonical(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for k in (rest.find("?"), rest.find("#")) if k >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.encode().lower().decode(), path


def judge(pages: DataFrame, rules: list[Rule], blocked: list[str], url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Adds host, path, rule and verdict: that of the longest rule that fits, else ``block`` if a ``blocked`` glob does."""
    names = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict")]
    ranked = sorted(rules, key=lambda r: -len(r.name))
    globs = [g for r in ranked for g in r.globs()]
    rows, at = batch_input(pages, names, url_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs + blocked)
        for batch in batches:
            parts = [canonical(u) for u in batch.column(at).to_pylist()]
            fits = automaton.match([(h + p).encode() for h, p in parts])
            by_rule = fits[:, : len(globs)].reshape(len(parts), len(ranked), 2).any(axis=2) if ranked else np.zeros((len(parts), 0), bool)
            bad = fits[:, len(globs) :].any(axis=1)
            rule = [ranked[k] if any_fits else None for any_fits, k in zip(by_rule.any(axis=1), by_rule.argmax(axis=1) if ranked else np.zeros(len(parts), int))]
            verdict = [r.action if r else "block" if b else "allow" for r, b in zip(rule, bad)]
            added = [[h for h, _ in parts], [p for _, p in parts], [r.name if r else None for r in rule], verdict]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(x, pa.string()) for x in added)], [*names, "host", "path", "rule", "verdict"])

    schema = StructType([*pages.select(*names).schema, *(StructField(c, StringType()) for c in ("host", "path", "rule", "verdict"))])
    return rows.mapInArrow(run, schema)
