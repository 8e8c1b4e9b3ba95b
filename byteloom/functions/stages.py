"""The deterministic stages as one native expression.

Each stage gives (encoding, confidence, language, mime_type) or null; the first that says something decides. Stages that
need a decoder (UTF-16 and UTF-32 without mark, UTF-7, ZIP members, declared multi-byte encodings) and the statistical
ones can't be native: for rows that may need one, ``decided`` is null and the rest of the pipeline takes over.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.functions import bytes as B
from byteloom.functions import patterns as P
from byteloom.tables import codepages, registry

RESULT = "struct<encoding:string,confidence:double,language:string,mime_type:string>"
CERTAIN, FALLBACK = 0.95, 0.10
OCTETS, PLAIN = "application/octet-stream", "text/plain"
MARKUP_SCAN, CODING_SCAN = 4096, 200

# Byte-order marks in the order in which they are tried.
MARKS = [(b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\xef\xbb\xbf", "utf-8-sig"), (b"\xfe\xff", "utf-16"), (b"\xff\xfe", "utf-16")]
# Media types by the bytes that files start with; the first that fits decides.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"MM\x00*", "image/tiff"),
    (b"II*\x00", "image/tiff"),
    (b"8BPS", "image/vnd.adobe.photoshop"),
    (b"qoif", "image/qoi"),
    (b"BM", "image/bmp"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"\x00\x00\x00\x0cJXL \r\n\x87\n", "image/jxl"),
    (b"\xff\n", "image/jxl"),
    (b"\x00\x00\x01\x00", "image/vnd.microsoft.icon"),
    (b"ID3", "audio/mpeg"),
    (b"MThd", "audio/midi"),
    (b"OggS", "audio/ogg"),
    (b"fLaC", "audio/flac"),
    (b"\x1aE\xdf\xa3", "video/webm"),
    (b"\x1f\x8b", "application/gzip"),
    (b"BZh", "application/x-bzip2"),
    (b"\xfd7zXZ\x00", "application/x-xz"),
    (b"7z\xbc\xaf'\x1c", "application/x-7z-compressed"),
    (b"Rar!\x1a\x07\x01\x00", "application/vnd.rar"),
    (b"Rar!\x1a\x07\x00", "application/vnd.rar"),
    (b"(\xb5/\xfd", "application/zstd"),
    (b"%PDF-", "application/pdf"),
    (b"SQLite format 3\x00", "application/x-sqlite3"),
    (b"ARROW1", "application/vnd.apache.arrow.file"),
    (b"PAR1", "application/vnd.apache.parquet"),
    (b"\x00asm", "application/wasm"),
    (b"dex\n", "application/vnd.android.dex"),
    (b"\x7fELF", "application/x-elf"),
    (b"\xfe\xed\xfa\xce", "application/x-mach-binary"),
    (b"\xfe\xed\xfa\xcf", "application/x-mach-binary"),
    (b"\xce\xfa\xed\xfe", "application/x-mach-binary"),
    (b"\xcf\xfa\xed\xfe", "application/x-mach-binary"),
    (b"MZ", "application/vnd.microsoft.portable-executable"),
    (b"wOFF", "font/woff"),
    (b"wOF2", "font/woff2"),
    (b"OTTO", "font/otf"),
    (b"\x00\x01\x00\x00", "font/ttf"),
]
# Media types of containers, by the four bytes at offset 8.
BRANDS = {
    b"avif": "image/avif", b"avis": "image/avif", b"heic": "image/heic", b"heix": "image/heic", b"mif1": "image/heif", b"msf1": "image/heif",
    b"M4A ": "audio/mp4", b"M4B ": "audio/mp4", b"F4A ": "audio/mp4", b"qt  ": "video/quicktime",
}
RIFF = {b"WEBP": "image/webp", b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo"}
FORM = {b"AIFF": "audio/aiff", b"AIFC": "audio/aiff"}
ZIP, TAR_AT, FAT_MOST = b"PK\x03\x04", 257, 20
# Escape sequences that tell ISO 2022 encodings.
ESCAPES_2004, ESCAPE_EXT = [b"\x1b$(O", b"\x1b$(P", b"\x1b$(Q"], b"\x1b(I"
ESCAPES_JP, ESCAPE_KR = [b"\x1b$B", b"\x1b$@", b"\x1b(J", b"\x1b$(D"], b"\x1b$)C"


def result(encoding: Column | str | None, confidence: Column | float, language: str | None, mime: Column | str | None) -> Column:
    value = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(value(encoding, "string").alias("encoding"), value(confidence, "double").alias("confidence"), value(language, "string").alias("language"), value(mime, "string").alias("mime_type"))


def none() -> Column:
    return F.lit(None).cast(RESULT)


def mark(data: Column) -> Column:
    """The encoding that a byte-order mark names. UTF-32 needs whole characters behind the mark, else it may be UTF-16."""
    found = F.lit(None).cast("string")
    for prefix, name in reversed(MARKS):
        whole = (F.octet_length(data) - len(prefix)) % 4 == 0 if name == "utf-32" else F.lit(True)
        found = F.when(B.starts(data, prefix) & whole, name).otherwise(found)
    return found


def _any(data: Column, needles: Iterable[bytes]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | B.holds(data, n)
    return out


def iso2022(data: Column) -> Column:
    both_shifts = B.holds(data, b"\x0e") & B.holds(data, b"\x0f")
    found = F.when(_any(data, ESCAPES_2004), "iso2022_jp_2004").when(B.holds(data, ESCAPE_EXT), "iso2022_jp_ext").when(_any(data, ESCAPES_JP), F.when(both_shifts, "iso2022_jp_ext").otherwise("iso2022_jp_2")).when(B.holds(data, ESCAPE_KR), "iso2022_kr")
    return F.when(B.holds(data, b"\x1b"), found)


def is_hz(data: Column) -> Column:
    regions = F.regexp_extract_all(B.latin1(data), F.lit(f"(?s){P.HZ_REGION}"), F.lit(1))
    return B.holds(data, b"~{") & F.exists(regions, lambda r: r.rlike(P.HZ_PAIRS))


def escape(data: Column) -> Column:
    """The 7-bit encoding that escape sequences tell (without UTF-7)."""
    return F.coalesce(iso2022(data), F.when(is_hz(data), "hz"))


def magic(data: Column) -> Column:
    """The media type that a file signature tells (ZIP archives as such)."""
    size, at8 = F.octet_length(data), F.substring(data, 9, 4)

    def of(kinds: dict[bytes, str]) -> Column:
        found = F.lit(None).cast("string")
        for key, mime in kinds.items():
            found = F.when(at8 == F.lit(key), mime).otherwise(found)
        return found

    box = B.number(data, 0, 4)
    steps = [
        F.when((size >= 12) & (F.substring(data, 5, 4) == F.lit(b"ftyp")) & (box >= 8) & (box <= size), F.coalesce(of(BRANDS), F.lit("video/mp4"))),
        F.when((size >= 12) & B.starts(data, b"RIFF"), of(RIFF)),
        F.when((size >= 12) & B.starts(data, b"FORM"), of(FORM)),
        F.when(B.starts(data, ZIP), "application/zip"),
        F.when((size >= 8) & B.starts(data, b"\xca\xfe\xba\xbe"), F.when(B.number(data, 4, 4) <= FAT_MOST, "application/x-mach-binary").otherwise("application/java-vm")),
    ]
    fixed = F
    for prefix, mime in MAGIC:
        fixed = fixed.when(B.starts(data, prefix), mime)
    tar = F.substring(data, TAR_AT + 1, 6)
    return F.coalesce(*steps, fixed, F.when((tar == F.lit(b"ustar\x00")) | (tar == F.lit(b"ustar ")), "application/x-tar"))


def _web_undefined(name: str) -> frozenset[int] | None:
    """Bytes that a web decoder of this single-byte encoding rejects; None where the web has no such decoder."""
    web = {"ascii": "cp1252", "iso8859-1": "cp1252", "iso8859-9": "cp1254", "tis-620": "cp874"}
    if name not in WEB_SINGLE_BYTE:
        return None
    return frozenset(v for v in codepages.undefined(web.get(name, name)) if v >= 0xA0)


# Single-byte encodings that web browsers decode.
WEB_SINGLE_BYTE = frozenset(
    """ascii cp1250 cp1251 cp1252 cp1253 cp1254 cp1255 cp1256 cp1257 cp1258 cp866 cp874 iso8859-1 iso8859-2 iso8859-3 iso8859-4
    iso8859-5 iso8859-6 iso8859-7 iso8859-8 iso8859-10 iso8859-13 iso8859-14 iso8859-15 iso8859-16 iso8859-9 koi8-r koi8-u mac-cyrillic
    mac-roman tis-620""".split()
)
#: Encodings whose validity takes a real multi-byte decoder.
DECODED = ("big5hkscs", "cp932", "cp949", "euc_jis_2004", "euc_kr", "gb18030", "iso2022_jp_2", "shift_jis_2004")


def literal_map(table: dict[str, str]) -> Column:
    """A map as one literal, which is folded once."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in table.items())), F.lit("\x02"), F.lit("\x01"))


def _decodes(first: Column, encoding: Column) -> Column:
    """Whether bytes are valid in the declared encoding (for all but DECODED ones)."""
    bad = {name: B.byte_class(values) for name in registry.REGISTRY if (values := _web_undefined(name))}
    rejected = F.try_element_at(literal_map(bad), encoding)
    return F.when(encoding == "utf-8", F.is_valid_utf8(first)).otherwise(F.coalesce(~F.rlike(B.latin1(first), rejected), F.lit(True)))


def declared_names(data: Column) -> list[tuple[Column, str]]:
    """The names that the page or file declares, with the media type that goes with each."""
    first = B.latin1(B.head(data, MARKUP_SCAN))
    found = [(F.regexp_extract(first, f"(?is){pattern}", 1), mime) for pattern, mime in P.DECLARATIONS]
    lines = F.substring_index(B.latin1(data), "\n", 2)
    comment = F.when(B.holds(B.head(data, CODING_SCAN), b"#"), F.regexp_extract(lines, P.CODING_COMMENT, 1))
    return [*found, (comment, "text/x-python")]


def markup(first: Column, declared: list[Column]) -> Column:
    """The declared encoding, if it is known and the first bytes bear it out. ``confidence`` null: it takes a decoder to tell.

    ``declared`` holds the names found, as ``declared_names`` orders them.
    """
    found = none()
    kinds = [mime for _, mime in P.DECLARATIONS] + ["text/x-python"]
    for name, mime in reversed(list(zip(declared, kinds))):
        plain = F.trim(name).rlike(r"\A[\x00-\x7F]+\z")
        encoding = F.when(plain, F.try_element_at(literal_map(registry.names()), F.lower(F.trim(name))))
        # A name that is neither registered nor an alias may be one of Python's many spellings: left to the lookup there.
        unknown = plain & encoding.isNull()
        take = F.when(unknown | encoding.isin(*DECODED), result(None, F.lit(None), None, mime)).when(encoding.isNotNull() & _decodes(first, encoding), result(encoding, CERTAIN, None, mime))
        found = F.coalesce(take, found)
    return found


def decided(df: DataFrame, content: str, output: str, allowed: frozenset[str], empty: str, max_bytes: int) -> DataFrame:
    """Adds what the native stages decide; null if a row may need more than they can do.

    Stages become columns in a few steps: each is worked out once, and what Spark has to compile stays small.
    """
    data, first = F.col("__data"), F.col("__first")
    may = lambda name: name.isin(*allowed) if allowed else F.lit(False)
    df = df.withColumn("__data", B.head(F.col(content), max_bytes))
    names = [f"__name{k}" for k in range(len(P.DECLARATIONS) + 1)]
    facts = {
        "__first": B.head(data, MARKUP_SCAN),
        "__bom": mark(data),
        "__escape": escape(data),
        "__mime": magic(data),
        "__ascii": B.ascii_confidence(data),
        "__within": B.utf8_bytes(data),
        "__binary": B.is_binary(data),
        "__nulls": B.holds(B.head(data, 4096), b"\x00") & (F.octet_length(data) >= 10),
        "__plus": B.holds(data, b"+") & ~B.latin1(data).rlike(P.HIGH),
    }
    df = df.select("*", *[c.alias(n) for n, c in facts.items()], *[c.alias(n) for n, (c, _) in zip(names, declared_names(data))])
    df = df.withColumn("__declared", F.when(F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names]).isNotNull(), markup(first, [F.col(n) for n in names])))
    df = df.withColumn("__utf8", B.utf8_confidence(data, F.col("__within")))
    bom, esc, mime, declared, as_ascii, as_utf8 = (F.col(f"__{n}") for n in ("bom", "escape", "mime", "declared", "ascii", "utf8"))
    more = F.lit(None).cast(RESULT)
    start = result(empty, FALLBACK, None, PLAIN) if empty in allowed else result(None, 0.0, None, OCTETS)
    lingual = F.when(esc == "hz", "zh").when(esc == "iso2022_kr", "ko").otherwise("ja")
    found = (
        F.when(F.octet_length(data) == 0, start)
        .when(may(bom), result(bom, 1.0, None, PLAIN))
        .when(F.col("__nulls"), more)
        .when(may(esc), result(esc, CERTAIN, None, PLAIN).withField("language", lingual))
        .when(esc.isNull() & F.col("__plus"), more)
        .when(mime == "application/zip", more)
        .when(mime.isNotNull(), result(None, 1.0, None, mime))
        .when(as_ascii.isNull() & as_utf8.isNull() & F.col("__binary"), result(None, CERTAIN, None, OCTETS))
        .when(declared.isNotNull() & declared["confidence"].isNull(), more)
        .when(may(declared["encoding"]), declared)
        .when(as_ascii.isNotNull() & F.lit("ascii" in allowed), result("ascii", as_ascii, None, PLAIN))
        .when(as_utf8.isNotNull() & F.lit("utf-8" in allowed), result("utf-8", as_utf8, None, PLAIN))
        .otherwise(more)
    )
    return df.withColumn(output, found).drop("__data", "__declared", "__utf8", *facts, *names)
