"""The encodings that can be told apart, their names, and how candidates are chosen from them."""

from __future__ import annotations

import codecs
import encodings.aliases
import pkgutil
import re
from collections.abc import Iterable
from dataclasses import dataclass
from enum import IntFlag
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


class Era(IntFlag):
    MODERN_WEB = 1
    LEGACY_ISO = 2
    LEGACY_MAC = 4
    LEGACY_REGIONAL = 8
    DOS = 16
    MAINFRAME = 32
    ALL = 63


@dataclass(frozen=True)
class Encoding:
    ordinal: int
    name: str
    aliases: tuple[str, ...]
    era: Era
    is_multibyte: bool
    languages: tuple[str, ...]


# Groups of languages, then name | era | languages or @group | aliases, in rank order (ties between
# equal scores go to the encoding listed first).
_GROUPS = {
    "WESTERN": "br cy da de en es fi fr ga id is it ms nl no pt sv",
    "WESTERN_TR": "br cy da de en es fi fr ga id is it ms nl no pt sv tr",
    "CYRILLIC": "ru bg uk sr mk be",
    "CENTRAL_EU": "pl cs hu hr ro sk sl",
    "CENTRAL_EU_NO_RO": "pl cs hu hr sk sl",
    "BALTIC": "et lt lv",
    "ARABIC": "ar fa",
}
_ENCODINGS = """
ascii | MODERN_WEB |  | us-ascii
utf-8 | MODERN_WEB |  | utf-8 utf8 csutf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8
utf-8-sig | MODERN_WEB |  | UTF-8-SIG utf-8-bom
utf-16 | MODERN_WEB |  | UTF-16 utf16 csutf16
utf-16-be | MODERN_WEB |  | UTF-16-BE utf-16be csutf16be
utf-16-le | MODERN_WEB |  | UTF-16-LE utf-16le csutf16le
utf-32 | MODERN_WEB |  | UTF-32 utf32 csutf32
utf-32-be | MODERN_WEB |  | UTF-32-BE utf-32be csutf32be
utf-32-le | MODERN_WEB |  | UTF-32-LE utf-32le csutf32le
utf-7 | LEGACY_REGIONAL |  | UTF-7 utf7 csutf7
big5hkscs | MODERN_WEB multibyte | zh | Big5-HKSCS Big5HKSCS big5 big5-tw csbig5 cp950 cn-big5 x-x-big5 csbig5hkscs
cp932 | MODERN_WEB multibyte | ja | CP932 ms932 mskanji ms-kanji cswindows31j windows-31j
cp949 | MODERN_WEB multibyte | ko | CP949 ms949 uhc windows-949 csksc56011987 iso-ir-149 ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601
euc_jis_2004 | MODERN_WEB multibyte | ja | EUC-JIS-2004 euc-jp eucjp ujis u-jis euc-jisx0213 cseucpkdfmtjapanese x-euc-jp
euc_kr | MODERN_WEB multibyte | ko | EUC-KR euckr cseuckr
gb18030 | MODERN_WEB multibyte | zh | GB18030 gb-18030 gb2312 gbk csgb2312 gb_2312 gb_2312-80 x-gbk csiso58gb231280 iso-ir-58 csgb18030 csgbk cp936 ms936 windows-936
hz | LEGACY_REGIONAL multibyte | zh | HZ-GB-2312 hz
iso2022_jp_2 | MODERN_WEB multibyte | ja | ISO-2022-JP-2 iso-2022-jp csiso2022jp iso2022-jp-1 csiso2022jp2
iso2022_jp_2004 | MODERN_WEB multibyte | ja | ISO-2022-JP-2004 iso2022-jp-3
iso2022_jp_ext | MODERN_WEB multibyte | ja | ISO-2022-JP-EXT
iso2022_kr | LEGACY_REGIONAL multibyte | ko | ISO-2022-KR csiso2022kr
shift_jis_2004 | MODERN_WEB multibyte | ja | Shift-JIS-2004 Shift_JIS_2004 shift_jis sjis shiftjis s_jis shift-jisx0213 x-sjis csshiftjis ms_kanji
cp874 | MODERN_WEB | th | CP874 windows-874 dos-874
cp1250 | MODERN_WEB | pl cs hu hr ro sk sl sr | Windows-1250 cp1250 x-cp1250 cswindows1250
cp1251 | MODERN_WEB | @CYRILLIC | Windows-1251 cp1251 x-cp1251 cswindows1251
cp1252 | MODERN_WEB | @WESTERN | Windows-1252 cp1252 x-cp1252 cswindows1252
cp1253 | MODERN_WEB | el | Windows-1253 cp1253 x-cp1253 cswindows1253
cp1254 | MODERN_WEB | tr | Windows-1254 cp1254 x-cp1254 cswindows1254
cp1255 | MODERN_WEB | he | Windows-1255 cp1255 x-cp1255 cswindows1255
cp1256 | MODERN_WEB | @ARABIC | Windows-1256 cp1256 x-cp1256 cswindows1256
cp1257 | MODERN_WEB | @BALTIC | Windows-1257 cp1257 x-cp1257 cswindows1257
cp1258 | MODERN_WEB | vi | Windows-1258 cp1258 x-cp1258 cswindows1258
koi8-r | MODERN_WEB | ru | KOI8-R koi8r koi koi8 cskoi8r
koi8-u | MODERN_WEB | uk | KOI8-U koi8u koi8-ru cskoi8u
tis-620 | MODERN_WEB | th | TIS-620 tis620 iso-8859-11 iso8859-11 iso885911 cstis620
iso8859-1 | LEGACY_ISO | @WESTERN | ISO-8859-1 latin-1 latin1 iso8859-1 iso88591
iso8859-2 | LEGACY_ISO | @CENTRAL_EU | ISO-8859-2 latin-2 latin2 iso8859-2 iso88592
iso8859-3 | LEGACY_ISO | eo mt tr | ISO-8859-3 latin-3 latin3 iso8859-3 iso88593
iso8859-4 | LEGACY_ISO | @BALTIC | ISO-8859-4 latin-4 latin4 iso8859-4 iso88594
iso8859-5 | LEGACY_ISO | @CYRILLIC | ISO-8859-5 iso8859-5 cyrillic iso88595
iso8859-6 | LEGACY_ISO | @ARABIC | ISO-8859-6 iso8859-6 arabic iso88596 iso-8859-6-e iso-8859-6-i csiso88596e csiso88596i
iso8859-7 | LEGACY_ISO | el | ISO-8859-7 iso8859-7 greek iso88597 sun_eu_greek
iso8859-8 | LEGACY_ISO | he | ISO-8859-8 iso8859-8 hebrew iso88598 iso-8859-8-e iso-8859-8-i csiso88598e csiso88598i visual logical
iso8859-9 | LEGACY_ISO | tr | ISO-8859-9 latin-5 latin5 iso8859-9 iso88599
iso8859-10 | LEGACY_ISO | is fi | ISO-8859-10 latin-6 latin6 iso8859-10 iso885910
iso8859-13 | LEGACY_ISO | @BALTIC | ISO-8859-13 latin-7 latin7 iso8859-13 iso885913 csiso885913
iso8859-14 | LEGACY_ISO | cy ga br gd | ISO-8859-14 latin-8 latin8 iso8859-14 iso885914 csiso885914 iso-ir-199 iso-celtic l8
iso8859-15 | LEGACY_ISO | @WESTERN | ISO-8859-15 latin-9 latin9 iso8859-15 iso885915 csisolatin9 csiso885915 l9
iso8859-16 | LEGACY_ISO | ro pl hr hu sk sl | ISO-8859-16 latin-10 latin10 iso8859-16 iso885916 csiso885916 iso-ir-226 l10
johab | LEGACY_ISO multibyte | ko | Johab
mac-cyrillic | LEGACY_MAC | @CYRILLIC | Mac-Cyrillic MacCyrillic maccyrillic x-mac-cyrillic x-mac-ukrainian
mac-greek | LEGACY_MAC | el | Mac-Greek MacGreek macgreek
mac-iceland | LEGACY_MAC | is | Mac-Iceland MacIceland maciceland
mac-latin2 | LEGACY_MAC | @CENTRAL_EU_NO_RO | Mac-Latin2 MacLatin2 maclatin2 maccentraleurope
mac-roman | LEGACY_MAC | @WESTERN | Mac-Roman MacRoman macroman macintosh csmacintosh mac x-mac-roman
mac-turkish | LEGACY_MAC | tr | Mac-Turkish MacTurkish macturkish
cp720 | LEGACY_REGIONAL | @ARABIC | CP720
cp1006 | LEGACY_REGIONAL | ur | CP1006
cp1125 | LEGACY_REGIONAL | uk | CP1125
koi8-t | LEGACY_REGIONAL | tg | KOI8-T
kz1048 | LEGACY_REGIONAL | kk | KZ-1048 kz1048 strk1048-2002 rk1048
ptcp154 | LEGACY_REGIONAL | kk | PTCP154 pt154 cp154
hp-roman8 | LEGACY_REGIONAL | @WESTERN | HP-Roman8 roman8 r8 csHPRoman8
cp437 | DOS | en fr de es pt it nl da sv fi ga | CP437
cp737 | DOS | el | CP737
cp775 | DOS | @BALTIC | CP775
cp850 | DOS | @WESTERN | CP850
cp852 | DOS | @CENTRAL_EU | CP852
cp855 | DOS | @CYRILLIC | CP855
cp856 | DOS | he | CP856
cp857 | DOS | tr | CP857
cp858 | DOS | @WESTERN | CP858
cp860 | DOS | pt | CP860
cp861 | DOS | is | CP861
cp862 | DOS | he | CP862
cp863 | DOS | fr | CP863
cp864 | DOS | ar | CP864
cp865 | DOS | da no | CP865
cp866 | DOS | @CYRILLIC | CP866
cp869 | DOS | el | CP869
cp1140 | MAINFRAME | @WESTERN_TR | CP1140 cp037 cp01140 ibm01140 ibm1140 csibm01140
cp424 | MAINFRAME | he | CP424
cp500 | MAINFRAME | @WESTERN | CP500
cp875 | MAINFRAME | el | CP875
cp1026 | MAINFRAME | tr | CP1026
cp273 | MAINFRAME | de | CP273
"""


def _parse() -> dict[str, Encoding]:
    found = {}
    for ordinal, line in enumerate(_ENCODINGS.strip().splitlines()):
        name, kind, languages, aliases = (part.strip() for part in line.split("|"))
        era, _, multibyte = kind.partition(" ")
        languages = _GROUPS[languages[1:]] if languages.startswith("@") else languages
        found[name] = Encoding(ordinal, name, tuple(aliases.split()), Era[era], bool(multibyte), tuple(languages.split()))
    return found


REGISTRY: dict[str, Encoding] = _parse()


@lru_cache(1)
def names() -> dict[str, str]:
    """Every lower-cased name and alias; where two encodings share one, the first listed has it."""
    found: dict[str, str] = {}
    for enc in REGISTRY.values():
        for name in (enc.name, *enc.aliases):
            found.setdefault(name.lower(), enc.name)
    return found


def plain_name(name: str) -> str:
    """A codec's name in lower case, with one underscore for each run of other characters within it."""
    return re.sub(r"^_|_$", "", re.sub(r"[^a-z0-9.]+", "_", name.lower()))


def _codec_name(name: str) -> str | None:
    """The name of Python's own text or byte codec, for a name of any of its spellings."""
    plain = plain_name(name)
    if not plain or "\0" in name:
        return None
    try:
        return codecs.lookup(plain).name
    except LookupError:
        return None


@lru_cache(4096)
def lookup(name: str) -> str | None:
    """The registered encoding that goes by this name, or None."""
    lowered = name.lower()
    if lowered in names():
        return names()[lowered]
    codec = _codec_name(name)
    return lookup(codec) if codec is not None and codec != lowered else None


@lru_cache(1)
def codec_names() -> dict[str, str]:
    """The registered encoding of every name that Python's codecs go by and that ``names`` lacks, in its plain spelling."""
    known = {*encodings.aliases.aliases, *encodings.aliases.aliases.values(), *(m.name for m in pkgutil.iter_modules(encodings.__path__))}
    found = {}
    for name in known | {plain_name(n) for n in names()}:
        encoding = lookup(name)
        if encoding is not None:
            found[plain_name(name)] = encoding
    return found


def require(name: str, parameter: str) -> str:
    found = lookup(name)
    if found is None:
        raise ValueError(f"Unknown encoding {name!r} in {parameter}")
    return found


def require_all(wanted: Iterable[str] | None, parameter: str) -> frozenset[str] | None:
    if wanted is None:
        return None
    found = frozenset(require(n, parameter) for n in wanted)
    if not found:
        raise ValueError(f"{parameter} must not be empty; omit the argument or pass None to disable filtering")
    return found


def candidates(era: int = Era.ALL, include: frozenset[str] | None = None, exclude: frozenset[str] | None = None) -> list[Encoding]:
    """Encodings of the eras asked for that are included and not excluded, in rank order."""
    return [e for e in REGISTRY.values() if e.era & era and (include is None or e.name in include) and (exclude is None or e.name not in exclude)]


def dimension(spark: SparkSession) -> DataFrame:
    """The registry as a table of 86 rows, to be broadcast."""
    rows = [(e.ordinal, e.name, list(e.aliases), int(e.era), e.is_multibyte, list(e.languages)) for e in REGISTRY.values()]
    return spark.createDataFrame(rows, "ordinal int, name string, aliases array<string>, era int, is_multibyte boolean, languages array<string>")


def alias_table(spark: SparkSession) -> DataFrame:
    """(alias, encoding): every name and alias, one row each."""
    return spark.createDataFrame(list(names().items()), "alias string, encoding string")
