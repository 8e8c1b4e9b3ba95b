"""The whole detection for one value, in Python and numpy.

It runs inside Arrow batches, for the rows that the native stages leave undecided, and fills in languages. The order of
the stages is that of ``functions.stages``; the two are held against each other in tests.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np

from byteloom.functions import patterns as P
from byteloom.functions import stages as S
from byteloom.operators.options import DetectOptions
from byteloom.operators.unicode_shape import is_utf7, utf16, utf32
from byteloom.operators.zip_kind import zip_kind
from byteloom.tables import codepages, registry
from byteloom.tables.models import CELLS, Models, bigrams

STRUCTURED, SCORED_BYTES, LANGUAGE_BYTES = 0.85, 16_384, 2_048
BAND, BOOST_FROM = 0.005, 0.95
TEXTS_AT_ONCE = 256


@dataclass(frozen=True)
class Found:
    encoding: str | None
    confidence: float
    language: str | None = None
    mime_type: str | None = None


BINARY = Found(None, S.CERTAIN, None, S.OCTETS)
_WEB_CODECS = {"big5hkscs": "big5hkscs", "cp932": "cp932", "shift_jis_2004": "cp932", "cp949": "cp949", "euc_kr": "cp949", "euc_jis_2004": "euc_jp", "gb18030": "gb18030", "iso2022_jp_2": "iso2022_jp_2", "utf-8": "utf-8"}


@lru_cache(None)
def _compiled(pattern: str) -> re.Pattern[bytes]:
    return P.python(pattern)


@lru_cache(None)
def _table(values: frozenset[int]) -> bytes:
    return bytes(sorted(values))


def holds_any(data: bytes, values: frozenset[int]) -> bool:
    return len(data.translate(None, _table(values))) < len(data) if values else False


def decodes(data: bytes, encoding: str) -> bool:
    """Whether a web decoder reads the data without error; so it does where the web has none."""
    if encoding in _WEB_CODECS:
        try:
            data.decode(_WEB_CODECS[encoding])
        except UnicodeDecodeError:
            return False
        return True
    return not holds_any(data, S._web_undefined(encoding) or frozenset())


_SINGLE_BYTE = frozenset(codepages.single_byte())


def is_valid(data: bytes, encoding: str) -> bool:
    """Whether a candidate stays: no byte that its code page lacks, nor an error of its decoder."""
    if encoding in _SINGLE_BYTE:
        return not holds_any(data, codepages.undefined(encoding))
    return decodes(data, encoding)


@dataclass(frozen=True)
class Structure:
    ratio: float
    mb_bytes: int
    diversity: int


_ASCII_REST = re.compile(rb"(?<=[\x00-\x7F])[\x00-\x7F]+")


def condensed(data: bytes) -> bytes:
    """As ``functions.bytes.condensed``: what multi-byte sequences can't hold is left out."""
    return _ASCII_REST.sub(b"\x00", data)


def structure(data: bytes, encoding: str) -> Structure:
    """How bytes, condensed or not, read as sequences of a multi-byte encoding."""
    if encoding not in P.SEQUENCES:
        return Structure(0.0, 0, 256)
    lead, sequence = P.SEQUENCES[encoding]
    every = _compiled(f"({sequence})|{lead}").findall(data)
    valid = [v for v in every if v]
    joined = b"".join(valid)
    return Structure(len(valid) / len(every) if every else 0.0, high_bytes(joined), len({v[:1] for v in valid}))


_ASCII = bytes(range(0x80))


def high_bytes(data: bytes) -> int:
    return len(data.translate(None, _ASCII))


def bom(data: bytes) -> str | None:
    for prefix, name in S.MARKS:
        if data.startswith(prefix) and (name != "utf-32" or (len(data) - len(prefix)) % 4 == 0):
            return name
    return None


def escape(data: bytes) -> Found | None:
    found = None
    if b"\x1b" in data:
        if any(e in data for e in S.ESCAPES_2004):
            found = "iso2022_jp_2004"
        elif S.ESCAPE_EXT in data:
            found = "iso2022_jp_ext"
        elif any(e in data for e in S.ESCAPES_JP):
            found = "iso2022_jp_ext" if b"\x0e" in data and b"\x0f" in data else "iso2022_jp_2"
        elif S.ESCAPE_KR in data:
            found = "iso2022_kr"
    if found is None and b"~{" in data and any(_compiled(P.HZ_PAIRS).match(r) for r in _compiled(P.HZ_REGION).findall(data)):
        found = "hz"
    if found:
        return Found(found, S.CERTAIN, {"hz": "zh", "iso2022_kr": "ko"}.get(found, "ja"))
    return Found("utf-7", S.CERTAIN) if is_utf7(data) else None


def magic(data: bytes) -> str | None:
    at8 = data[8:12]
    if len(data) >= 12 and data[4:8] == b"ftyp" and 8 <= int.from_bytes(data[:4], "big") <= len(data):
        return S.BRANDS.get(at8, "video/mp4")
    for start, kinds in ((b"RIFF", S.RIFF), (b"FORM", S.FORM)):
        if len(data) >= 12 and data.startswith(start) and at8 in kinds:
            return kinds[at8]
    if data.startswith(S.ZIP):
        return zip_kind(data)
    if len(data) >= 8 and data.startswith(b"\xca\xfe\xba\xbe"):
        return "application/x-mach-binary" if int.from_bytes(data[4:8], "big") <= S.FAT_MOST else "application/java-vm"
    for prefix, mime in S.MAGIC:
        if data.startswith(prefix):
            return mime
    return "application/x-tar" if data[S.TAR_AT : S.TAR_AT + 6] in (b"ustar\x00", b"ustar ") else None


def utf8(data: bytes) -> float | None:
    rest = _compiled(rf"[\x00-\x7F]+|({P.UTF8_SEQUENCE})|{P.UTF8_CUT}").sub(b"", data)
    if rest:
        return None
    within = len(b"".join(_compiled(rf"[\x00-\x7F]+|({P.UTF8_SEQUENCE})|{P.UTF8_CUT}").findall(data)))
    return min(0.99, 0.80 + 0.19 * min(within * 6 / len(data), 1.0)) if within else None


_TEXT = bytes([9, 10, 13, *range(0x20, 0x7F)])
_CONTROL = bytes([*range(0x09), *range(0x0E, 0x20)])


def ascii_text(data: bytes) -> float | None:
    other = data.translate(None, _TEXT)
    if not other:
        return 1.0
    return 0.99 if not other.strip(b"\x00") and len(other) <= 0.05 * len(data) else None


def is_binary(data: bytes) -> bool:
    return len(data) - len(data.translate(None, _CONTROL)) > 0.01 * len(data)


def markup(data: bytes) -> Found | None:
    head = data[: S.MARKUP_SCAN]
    sources = [(re.compile(p.encode(), re.I | re.S), head, mime) for p, mime in P.DECLARATIONS]
    if b"#" in data[: S.CODING_SCAN]:
        sources.append((re.compile(P.CODING_COMMENT.encode()), b"\n".join(data.split(b"\n", 2)[:2]), "text/x-python"))
    for pattern, text, mime in sources:
        m = pattern.search(text)
        if m and m[1].isascii():
            encoding = registry.lookup(m[1].decode().strip())
            if encoding and decodes(head, encoding):
                return Found(encoding, S.CERTAIN, None, mime)
    return None


def promoted(data: bytes, found: Found, allowed: frozenset[str]) -> Found:
    """Pages that declare Shift_JIS or EUC-KR mostly hold the Windows superset."""
    wider = {"shift_jis_2004": "cp932", "euc_kr": "cp949"}.get(found.encoding)
    if wider in allowed and decodes(data, wider) and structure(data, wider).ratio > structure(data, found.encoding).ratio:
        return replace(found, encoding=wider)
    return found


class Profile:
    """Pairs of bytes that occur, with how much each weighs."""

    def __init__(self, pairs: np.ndarray, idf: np.ndarray):
        self.pairs, count = np.unique(pairs, return_counts=True)
        self.weights = count * idf[self.pairs].astype(np.float64)
        self.norm = float(np.sqrt(np.square(self.weights).sum()))

    def cosines(self, models: Models, rows: range) -> np.ndarray:
        """The similarity to each of these models.

        Products and sums are of whole numbers below 2**53, so equal models give equal results.
        """
        dots = self.weights @ models.by_cell[self.pairs, rows.start : rows.stop].astype(np.float64)
        scale = models.norms[rows.start : rows.stop] * self.norm
        return np.divide(dots, scale, out=np.zeros(len(scale)), where=scale > 0)

    def best(self, models: Models, encoding: str, cosines: np.ndarray | None = None) -> tuple[float, str | None]:
        """The best model's similarity and language, the first of equals. ``cosines`` are those of all models, if known."""
        rows = models.of(encoding)
        scores = self.cosines(models, rows) if cosines is None else cosines[rows.start : rows.stop]
        k = int(scores.argmax()) if len(scores) else 0
        return (float(scores[k]), models.keys[rows.start + k][0]) if len(scores) and scores[k] > 0 else (0.0, None)


def scored(data: bytes, candidates: list[str], models: Models) -> list[Found]:
    profile = Profile(bigrams(data[:SCORED_BYTES]), models.idf)
    cosines = profile.cosines(models, range(len(models.keys)))
    found = [Found(c, *profile.best(models, c, cosines)) for c in candidates if len(models.of(c))]
    return sorted((f for f in found if f.confidence > 0), key=lambda f: -f.confidence)


def vote(data: bytes, a: str, b: str, differ: frozenset[int]) -> str | None:
    """Which of two code pages makes likelier characters of the bytes at which they differ."""
    gain = {a: 0, b: 0}
    for value in differ.intersection(data):
        pa, pb = (codepages.CATEGORY_PREFERENCE.get(codepages.category(e, value), 0) for e in (a, b))
        gain[a] += max(pa - pb, 0)
        gain[b] += max(pb - pa, 0)
    return a if gain[a] > gain[b] else b if gain[b] > gain[a] else None


def rescored(data: bytes, a: str, b: str, differ: frozenset[int], models: Models) -> str | None:
    """Which of two code pages' models fits the pairs that touch those bytes better."""
    mask = np.zeros(256, bool)
    mask[list(differ)] = True
    pairs = bigrams(data)
    pairs = pairs[mask[pairs >> 8] | mask[pairs & 0xFF]]
    if not len(pairs):
        return None
    profile = Profile(pairs, models.idf)
    sa, sb = profile.best(models, a)[0], profile.best(models, b)[0]
    return a if sa > sb else b if sb > sa else None


def untangled(data: bytes, found: list[Found], models: Models) -> list[Found]:
    """Puts a candidate that is confusable with the first one, and fits better, in its place."""
    for k, other in enumerate(found[1:], 1):
        if k > 1 and found[0].confidence - other.confidence > BAND:
            break
        pair = frozenset((found[0].encoding, other.encoding))
        differ = codepages.confusable().get(pair)
        if differ is None:
            continue
        winner = rescored(data, found[0].encoding, other.encoding, differ, models) or vote(data, found[0].encoding, other.encoding, differ)
        if winner == other.encoding:
            return [replace(other, confidence=found[0].confidence), *found[:k], *found[k + 1 :]]
    return found


def without_niche(data: bytes, found: list[Found]) -> list[Found]:
    """A niche Latin encoding without a byte of its own gives way to a common one, and goes last."""
    first = found[0].encoding if found else None
    own = codepages.distinguishing().get(first)
    if own is None or len(found) < 2 or holds_any(data, own):
        return found
    for k, other in enumerate(found[1:], 1):
        if other.encoding in codepages.COMMON_LATIN:
            rest = [f for i, f in enumerate(found) if i != k and f.encoding != first]
            return [replace(other, confidence=found[0].confidence), *rest, *[f for f in found if f.encoding == first]]
    return found


def with_tajik(data: bytes, found: list[Found]) -> list[Found]:
    """KOI8-T takes the place of KOI8-R if one of its letters occurs."""
    if found and found[0].encoding == "koi8-r" and holds_any(data, codepages.tajik()):
        for k, other in enumerate(found):
            if other.encoding == "koi8-t":
                return [replace(other, confidence=found[0].confidence), *found[:k], *found[k + 1 :]]
    return found


def postprocessed(data: bytes, found: list[Found], models: Models) -> list[Found]:
    return with_tajik(data, without_niche(data, untangled(data, found, models)))


def fallback(encoding: str, options: DetectOptions) -> list[Found]:
    return [Found(encoding, S.FALLBACK) if encoding in options.allowed else Found(None, 0.0)]


def early(data: bytes, options: DetectOptions) -> Found | None:
    """What the deterministic stages say."""
    allowed = options.allowed
    if (name := bom(data)) in allowed:
        return Found(name, 1.0)
    if len(data) >= 10 and (name := utf32(data) or utf16(data)) in allowed:
        return Found(name, S.CERTAIN)
    found = escape(data)
    if found and found.encoding in allowed:
        return found
    if mime := magic(data):
        return Found(None, 1.0, None, mime)
    as_utf8, as_ascii = utf8(data), ascii_text(data)
    if as_utf8 is None and as_ascii is None and is_binary(data):
        return BINARY
    found = markup(data)
    if found and found.encoding in allowed:
        return promoted(data, found, allowed)
    if as_ascii is not None and "ascii" in allowed:
        return Found("ascii", as_ascii)
    return Found("utf-8", as_utf8) if as_utf8 is not None and "utf-8" in allowed else None


def ranked(data: bytes, options: DetectOptions, models: Models) -> list[Found]:
    """What structure and statistics say, likeliest first."""
    high, short, kept, structures = high_bytes(data), condensed(data), [], {}
    for e in options.candidates:
        if not is_valid(data, e.name):
            continue
        if e.is_multibyte:
            s = structures[e.name] = structure(short, e.name)
            if s.ratio < 0.05 or high < 2 or s.mb_bytes / high < 0.35 or high >= 16 and s.diversity < 4:
                continue
        kept.append(e)
    multibyte = sorted((e.name for e in kept if e.is_multibyte), key=lambda n: -structures[n].ratio)
    if multibyte and structures[multibyte[0]].ratio >= STRUCTURED:
        found = scored(data, [*multibyte, *(e.name for e in kept if not e.is_multibyte)], models)
        cover = {n: structures[n].mb_bytes / high for n in multibyte}
        found = [replace(f, confidence=f.confidence * (1 + cover[f.encoding])) if cover.get(f.encoding, 0) >= BOOST_FROM else f for f in found]
        if found:
            return postprocessed(data, sorted(found, key=lambda f: -f.confidence), models)
    found = scored(data, [e.name for e in kept], models)
    return postprocessed(data, found, models) if found else fallback(options.no_match_encoding, options)


def to_utf8(data: bytes, encoding: str) -> bytes | None:
    """The text in UTF-8, errors passed over; None where nothing can read the encoding."""
    codec = _WEB_CODECS.get(encoding, encoding)
    try:
        return data.decode(codec, "ignore").encode("utf-8", "ignore")
    except LookupError:
        return None


def language(data: bytes, encoding: str, models: Models) -> str | None:
    """The language that goes with the encoding, or whose model fits the first bytes best."""
    own = registry.REGISTRY[encoding].languages
    if len(own) == 1:
        return own[0]
    head = data[:LANGUAGE_BYTES]
    if len(models.of(encoding)) and encoding != "utf-8" and (lang := Profile(bigrams(head), models.idf).best(models, encoding)[1]):
        return lang
    text = head if encoding == "utf-8" else to_utf8(head, encoding)
    return Profile(bigrams(text), models.idf).best(models, "utf-8")[1] if text else None


def best_languages(texts: list[bytes], models: Models, encoding: str = "utf-8") -> list[str | None]:
    """The language of each text, as ``Profile.best`` finds it, for all texts at once: one table of (text, pair) counts."""
    rows = models.of(encoding)
    out: list[str | None] = [None] * len(texts)
    for start in range(0, len(texts) if len(rows) else 0, TEXTS_AT_ONCE):
        some = texts[start : start + TEXTS_AT_ONCE]
        owner = np.repeat(np.arange(len(some)), [len(t) for t in some])
        pairs = bigrams(b"".join(some))
        inner = owner[1:] == owner[:-1]
        if not inner.any():
            continue
        keys, count = np.unique(owner[1:][inner] * CELLS + pairs[inner], return_counts=True)
        cell, of = keys % CELLS, keys // CELLS
        weights = count * models.idf[cell].astype(np.float64)
        table = models.by_cell[cell, rows.start : rows.stop]
        ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of))
        for at, end in zip(np.append(0, ends[:-1]), ends):
            own, scale = weights[at:end], models.norms[rows.start : rows.stop]
            scale = scale * float(np.sqrt(np.square(own).sum()))
            scores = np.divide(own @ table[at:end].astype(np.float64), scale, out=np.zeros(len(scale)), where=scale > 0)
            best = int(scores.argmax())
            if scores[best] > 0:
                out[start + of[at]] = models.keys[rows.start + best][0]
    return out


def languages(texts: list[bytes], encodings: list[str], models: Models) -> list[str | None]:
    """``language`` for many values; those that the UTF-8 models judge go together."""
    out: list[str | None] = [None] * len(texts)
    wide: list[tuple[int, bytes]] = []
    for k, (data, encoding) in enumerate(zip(texts, encodings)):
        own, head = registry.REGISTRY[encoding].languages, data[:LANGUAGE_BYTES]
        if len(own) == 1:
            out[k] = own[0]
        elif encoding == "utf-8" or not len(models.of(encoding)):
            if text := head if encoding == "utf-8" or encoding == "ascii" and head.isascii() else to_utf8(head, encoding):
                wide.append((k, text))
        else:
            out[k] = language(data, encoding, models)
    for (k, _), lang in zip(wide, best_languages([t for _, t in wide], models)):
        out[k] = lang
    return out


def finished(data: bytes, found: list[Found], options: DetectOptions, models: Models) -> list[Found]:
    out = []
    for f in found:
        lang = f.language
        if lang is None and f.encoding is not None and options.language:
            lang = language(data, f.encoding, models)
        out.append(Found(f.encoding, min(f.confidence, 1.0), lang, f.mime_type or (S.OCTETS if f.encoding is None else S.PLAIN)))
    return out


def detect_all(data: bytes, options: DetectOptions, models: Models) -> list[Found]:
    """All results for one value, likeliest first, with registered names."""
    cut = data[: options.max_bytes]
    if not cut:
        found = fallback(options.empty_input_encoding, options)
    elif hit := early(cut, options):
        found = [hit]
    else:
        found = ranked(cut, options, models)
    return finished(data, found, options, models)


assert CELLS == 1 << 16
