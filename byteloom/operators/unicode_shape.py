"""UTF-16 and UTF-32 without byte-order marks, told by where their null bytes lie; and UTF-7."""

from __future__ import annotations

import base64
import re
import unicodedata

import numpy as np

_PLAIN_OR_NULL = np.array([0, 9, 10, 13, *range(0x20, 0x7F)], np.uint8)
SCAN, LEAST_16, LEAST_32 = 4096, 10, 16
NULL_SHARE, LEAST_QUALITY, PRINTABLE, SEPARATORS = 0.03, 0.5, 0.7, 0.15


def _units(data: bytes, order: str) -> np.ndarray:
    return np.frombuffer(data, f"{order}u2")


def looks_like_text(text_units: int, text: str) -> bool:
    """Whether over 70 % of up to 500 UTF-16 units are printable characters or line breaks."""
    if not text_units:
        return False
    good, units = 0, 0
    for c in text:
        wide = 1 + (ord(c) > 0xFFFF)
        if units + wide > 500 and units:
            break
        units += wide
        good += ord(c) >= 0x20 or c in "\n\r\t"
    return good / min(text_units, 500) > PRINTABLE


def quality(text: str) -> float:
    """Share of letters, with more for ASCII ones and for spaces; -1 for what no text has so many of."""
    text = text[:500]
    if not text:
        return -1.0
    n = sum(1 + (ord(c) > 0xFFFF) for c in text)
    kinds = [unicodedata.category(c) for c in text]
    letters = sum(k[0] == "L" for k in kinds)
    latin = sum(k[0] == "L" and c < "\x80" for k, c in zip(kinds, text))
    marks = sum(k[0] == "M" for k in kinds)
    controls = sum(k[0] == "C" and c not in "\n\r\t" for k, c in zip(kinds, text))
    spaces = sum(k == "Zs" or c in "\n\r\t" for k, c in zip(kinds, text))
    if controls / n > 0.1 or marks / n > 0.2:
        return -1.0
    return letters / n + 0.5 * latin / n + (0.1 if n > 20 and spaces else 0.0)


def utf32(data: bytes) -> str | None:
    data = data[:SCAN]
    data = data[: len(data) - len(data) % 4]
    if len(data) < LEAST_32:
        return None
    lanes = np.frombuffer(data, np.uint8).reshape(-1, 4)
    for name, order, outer, inner in (("utf-32-be", ">", 0, 1), ("utf-32-le", "<", 3, 2)):
        if lanes[:, outer].any() or (lanes[:, inner] == 0).mean() <= 0.5:
            continue
        points = np.frombuffer(data, f"{order}u4")
        if points.max() <= 0x10FFFF:
            text = "".join(map(chr, points.tolist()))
            if looks_like_text(sum(1 + (p > 0xFFFF) for p in points.tolist()), text):
                return name
    return None


def _decoded(data: bytes, order: str) -> tuple[int, str] | None:
    try:
        return len(data) // 2, data.decode("utf-16-le" if order == "<" else "utf-16-be")
    except UnicodeDecodeError:
        return None


def utf16(data: bytes) -> str | None:
    data = data[:SCAN]
    data = data[: len(data) - len(data) % 2]
    if len(data) < LEAST_16:
        return None
    lanes = np.frombuffer(data, np.uint8).reshape(-1, 2)
    # NULs may also part the fields of plain text: then they are few, amid printable bytes.
    plain = bool(np.isin(lanes, _PLAIN_OR_NULL).all())
    found = []
    for name, order, lane in (("utf-16-le", "<", 1), ("utf-16-be", ">", 0)):
        share = (lanes[:, lane] == 0).mean()
        if share >= NULL_SHARE and not (plain and share < SEPARATORS):
            found.append((name, _decoded(data, order)))
    if len(found) == 1:
        name, got = found[0]
        return name if got and looks_like_text(*got) else None
    rated = [(name, quality(got[1])) for name, got in found if got]
    best = max(rated, key=lambda r: r[1], default=(None, -1.0))
    return best[0] if best[1] >= LEAST_QUALITY else None


_SHIFT = re.compile(rb"\+(-|\++|[A-Za-z0-9/][A-Za-z0-9+/]*|)")
_BASE64 = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=")


def _inside_base64(data: bytes, at: int) -> bool:
    """Whether four base64 characters at least lead up to ``at`` (line ends apart)."""
    seen = 0
    while at > 0 and seen < 4:
        at -= 1
        if data[at] not in b"\r\n":
            if data[at] not in _BASE64:
                return False
            seen += 1
    return seen == 4


def valid_shift(run: bytes) -> bool:
    """Whether base64 characters are UTF-16 with nothing left over."""
    bits = len(run) * 6
    whole = bits // 16 * 2
    raw = base64.b64decode(run + b"A" * (-len(run) % 4))
    # Bits after the last whole unit must be zero; those of the last character are what counts.
    value = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/".index(run[-1:])
    if value & ((1 << bits % 16) - 1):
        return False
    try:
        raw[:whole].decode("utf-16-be")
    except UnicodeDecodeError:
        return False
    return True


def is_utf7(data: bytes) -> bool:
    if not data.isascii() or b"+" not in data:
        return False
    at = 0
    while (shift := data.find(b"+", at)) >= 0:
        run = _SHIFT.match(data, shift)[1]
        at = shift + 1
        if run == b"-" or run.strip(b"+") == b"":
            at += len(run)
        elif not _inside_base64(data, shift):
            if len(run) >= 3 and any(65 <= c <= 90 for c in run) and valid_shift(run):
                return True
            at += len(run)
    return False
