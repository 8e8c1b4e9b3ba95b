"""What follows from the single-byte code pages themselves, worked out from Python's codecs."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import combinations

from byteloom.tables.registry import REGISTRY, lookup

#: Encodings that differ in at most this share of all byte values may be confused.
CONFUSABLE_SHARE = 0.2


def single_byte() -> list[str]:
    return [e.name for e in REGISTRY.values() if not e.is_multibyte and not e.name.startswith("utf-")]


@lru_cache(None)
def characters(encoding: str) -> tuple[str | None, ...]:
    """The character of each byte value; None where the code page has none."""
    found = []
    for value in range(256):
        try:
            found.append(bytes([value]).decode(encoding))
        except UnicodeDecodeError:
            found.append(None)
    return tuple(found)


@lru_cache(None)
def undefined(encoding: str) -> frozenset[int]:
    """Byte values at which a strict decoder fails. ASCII is read as Western text on the web, so none fail there."""
    return frozenset() if encoding == "ascii" else frozenset(b for b, c in enumerate(characters(encoding)) if c is None)


def differing(a: str, b: str, within: range = range(256)) -> frozenset[int]:
    return frozenset(v for v in within if characters(a)[v] != characters(b)[v])


def category(encoding: str, value: int) -> str:
    char = characters(encoding)[value]
    return "Cn" if char is None else unicodedata.category(char)


@lru_cache(1)
def confusable() -> dict[frozenset[str], frozenset[int]]:
    """Pairs of code pages that are easily confused, with the byte values at which they differ."""
    return {frozenset((a, b)): d for a, b in combinations(single_byte(), 2) if len(d := differing(a, b)) <= CONFUSABLE_SHARE * 256}


# How much a Unicode general category speaks for text.
CATEGORY_PREFERENCE = {
    "Lu": 10, "Ll": 10, "Lt": 10, "Lm": 9, "Lo": 9, "Nd": 8, "Nl": 7, "No": 7,
    "Pc": 6, "Pd": 6, "Ps": 6, "Pe": 6, "Pi": 6, "Pf": 6, "Po": 6, "Sc": 5, "Sm": 5, "Sk": 4, "So": 4,
    "Zs": 3, "Zl": 3, "Zp": 3, "Cf": 2, "Cc": 1, "Co": 1, "Cs": 0, "Cn": 0, "Mn": 5, "Mc": 5, "Me": 5,
}


@lru_cache(1)
def distinguishing() -> dict[str, frozenset[int]]:
    """Niche encodings, and the bytes without which a common Latin one is likelier."""
    high = range(0x80, 0x100)
    turkish = frozenset(v for v in differing("cp1254", "cp1252", high) if characters("cp1254")[v] is not None)
    roman8 = frozenset(v for v in high if category("hp-roman8", v) == "Ll" and category("iso8859-1", v) == "Lu")
    return {
        "iso8859-10": differing("iso8859-10", "iso8859-1", high),
        "iso8859-14": differing("iso8859-14", "iso8859-1", high),
        "cp1254": turkish,
        "hp-roman8": roman8,
    }


COMMON_LATIN = ("iso8859-1", "iso8859-15", "cp1252")


@lru_cache(1)
def tajik() -> frozenset[int]:
    """Bytes that are letters in KOI8-T (Tajik ones) and none in KOI8-R."""
    return frozenset(v for v in range(0x80, 0x100) if category("koi8-t", v)[0] == "L" and category("koi8-r", v)[0] != "L")


#: Categories by their number in packed tables: fixed values.
PACKED_CATEGORIES = ("Lu", "Ll", "Lt", "Lm", "Lo", "Mn", "Mc", "Me", "Nd", "Nl", "No", "Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po", "Sm", "Sc", "Sk", "So", "Zs", "Zl", "Zp", "Cc", "Cf", "Cs", "Co", "Cn")


def unpack_confusable(data: bytes) -> dict[tuple[str, str], dict[int, tuple[str, str]]]:
    """Reads a packed table of confusable pairs: for each, the bytes that differ and their categories in both.

    The form: number of pairs (two bytes, big-endian); for each the two names, each after its length, and the number of
    bytes that differ; for each of those its value and two category numbers. Numbers are one byte but for the first.
    Names that are registered, or aliases, become registered ones. Says what is wrong with data that isn't in this form.
    """
    at = 0

    def take(n: int, what: str) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError(f"packed pairs end at {len(data)}, inside {what} at {at}")
        at += n
        return data[at - n : at]

    def name() -> str:
        raw = take(take(1, "a length")[0], "a name")
        try:
            text = raw.decode()
        except UnicodeDecodeError as e:
            raise ValueError(f"a name before {at} isn't UTF-8") from e
        return lookup(text) or text

    def kind(number: int) -> str:
        return PACKED_CATEGORIES[number] if number < len(PACKED_CATEGORIES) else "Cn"

    found = {}
    for _ in range(int.from_bytes(take(2, "the number of pairs"), "big")):
        pair, size = (name(), name()), take(1, "a count")[0]
        rows = [take(3, "a difference") for _ in range(size)]
        found[pair] = {value: (kind(a), kind(b)) for value, a, b in rows}
    return found
