"""Which encodings count for which others, and what they and languages are called."""

from __future__ import annotations

from functools import lru_cache

from byteloom.tables.registry import REGISTRY, lookup

# An encoding, and those whose detection is right for it too (one-way).
SUPERSETS = {
    "ASCII": "utf-8 cp1252",
    "TIS-620": "iso8859-11 cp874",
    "ISO-8859-11": "cp874",
    "GB2312": "gb18030",
    "GBK": "gb18030",
    "Big5": "big5hkscs cp950",
    "Shift_JIS": "cp932 shift_jis_2004",
    "Shift-JISX0213": "shift_jis_2004",
    "EUC-JP": "euc_jis_2004",
    "EUC-JISX0213": "euc_jis_2004",
    "EUC-KR": "cp949",
    "CP037": "cp1140",
    "ISO-2022-JP": "iso2022_jp_2 iso2022_jp_2004 iso2022_jp_ext",
    "ISO2022-JP-1": "iso2022_jp_2 iso2022_jp_ext",
    "ISO2022-JP-3": "iso2022_jp_2004",
    "ISO-8859-1": "cp1252",
    "ISO-8859-2": "cp1250",
    "ISO-8859-5": "cp1251",
    "ISO-8859-6": "cp1256",
    "ISO-8859-7": "cp1253",
    "ISO-8859-8": "cp1255",
    "ISO-8859-9": "cp1254",
    "ISO-8859-13": "cp1257",
    "UTF-16": "utf-16-le utf-16-be",
    "UTF-16-LE": "utf-16",
    "UTF-16-BE": "utf-16",
    "UTF-32": "utf-32-le utf-32-be",
    "UTF-32-LE": "utf-32",
    "UTF-32-BE": "utf-32",
}
# The superset that is named in an encoding's place on request.
PREFERRED_SUPERSET = {
    "ascii": "cp1252",
    "euc_kr": "cp949",
    "iso8859-1": "cp1252",
    "iso8859-2": "cp1250",
    "iso8859-5": "cp1251",
    "iso8859-6": "cp1256",
    "iso8859-7": "cp1253",
    "iso8859-8": "cp1255",
    "iso8859-9": "cp1254",
    "iso8859-11": "cp874",
    "iso8859-13": "cp1257",
    "tis-620": "cp874",
}
# Display names. Encodings that aren't listed are shown as registered.
COMPAT_NAMES = {
    "big5hkscs": "Big5",
    "cp855": "IBM855",
    "cp866": "IBM866",
    "cp874": "CP874",
    "cp949": "CP949",
    "euc_jis_2004": "EUC-JP",
    "euc_kr": "EUC-KR",
    "gb18030": "GB18030",
    "hz": "HZ-GB-2312",
    "iso2022_jp_2": "ISO-2022-JP",
    "iso2022_kr": "ISO-2022-KR",
    "iso8859-1": "ISO-8859-1",
    "iso8859-2": "ISO-8859-2",
    "iso8859-5": "ISO-8859-5",
    "iso8859-6": "ISO-8859-6",
    "iso8859-7": "ISO-8859-7",
    "iso8859-8": "ISO-8859-8",
    "iso8859-9": "ISO-8859-9",
    "iso8859-13": "ISO-8859-13",
    "johab": "Johab",
    "koi8-r": "KOI8-R",
    "mac-cyrillic": "MacCyrillic",
    "mac-roman": "MacRoman",
    "shift_jis_2004": "SHIFT_JIS",
    "tis-620": "TIS-620",
    "utf-16": "UTF-16",
    "utf-32": "UTF-32",
    "utf-8-sig": "UTF-8-SIG",
    "cp1250": "Windows-1250",
    "cp1251": "Windows-1251",
    "cp1252": "Windows-1252",
    "cp1253": "Windows-1253",
    "cp1254": "Windows-1254",
    "cp1255": "Windows-1255",
    "cp1256": "Windows-1256",
    "cp1257": "Windows-1257",
    "kz1048": "KZ1048",
    "mac-greek": "MacGreek",
    "mac-iceland": "MacIceland",
    "mac-latin2": "MacLatin2",
    "mac-turkish": "MacTurkish",
}
# Encodings that count for each other, and languages that do.
BIDIRECTIONAL = [("iso2022_jp_2", "iso2022_jp_2004", "iso2022_jp_ext")]
LANGUAGE_GROUPS = [("sk", "cs"), ("uk", "ru", "bg", "be"), ("ms", "id"), ("no", "da", "sv")]
# Language names by ISO code.
LANGUAGES = {
    "ar": "arabic", "be": "belarusian", "bg": "bulgarian", "br": "breton", "cs": "czech", "cy": "welsh", "da": "danish",
    "de": "german", "el": "greek", "en": "english", "eo": "esperanto", "es": "spanish", "et": "estonian", "fa": "farsi",
    "fi": "finnish", "fr": "french", "ga": "irish", "gd": "gaelic", "he": "hebrew", "hr": "croatian", "hu": "hungarian",
    "id": "indonesian", "is": "icelandic", "it": "italian", "ja": "japanese", "kk": "kazakh", "ko": "korean",
    "lt": "lithuanian", "lv": "latvian", "mk": "macedonian", "ms": "malay", "mt": "maltese", "nl": "dutch",
    "no": "norwegian", "pl": "polish", "pt": "portuguese", "ro": "romanian", "ru": "russian", "sk": "slovak",
    "sl": "slovene", "sr": "serbian", "sv": "swedish", "tg": "tajik", "th": "thai", "tr": "turkish", "uk": "ukrainian",
    "und": "undetermined", "ur": "urdu", "vi": "vietnamese", "zh": "chinese",
}
ISO_CODES = {name: code for code, name in LANGUAGES.items()}


def _known(name: str) -> str:
    return lookup(name) or name.lower()


@lru_cache(1)
def accepted() -> dict[str, frozenset[str]]:
    """Registered encoding -> all encodings whose detection is right for it, itself included."""
    found: dict[str, set[str]] = {name: {name} for name in REGISTRY}
    for subset, supersets in SUPERSETS.items():
        found.setdefault(_known(subset), set()).update(_known(s) for s in supersets.split())
    for group in BIDIRECTIONAL:
        for name in group:
            found[name].update(group)
    return {k: frozenset(v) for k, v in found.items()}


def is_correct(expected: str | None, detected: str | None) -> bool:
    """Whether a detected encoding (None: binary) is right where ``expected`` is the truth."""
    if expected is None or detected is None:
        return expected is detected
    want, got = _known(expected), _known(detected)
    return want == got or got in accepted().get(want, ())


def is_language_equivalent(expected: str, detected: str) -> bool:
    return expected == detected or any(expected in g and detected in g for g in LANGUAGE_GROUPS)


def display(encoding: str | None, prefer_superset: bool = False, compat_names: bool = True) -> str | None:
    """The name that is reported: first the preferred superset, then its display name."""
    if encoding is not None and prefer_superset:
        encoding = PREFERRED_SUPERSET.get(encoding, encoding)
    if encoding is not None and compat_names:
        encoding = COMPAT_NAMES.get(encoding, encoding)
    return encoding
