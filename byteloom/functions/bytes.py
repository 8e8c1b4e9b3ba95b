"""Native expressions over binary columns: everything here stays inside the JVM.

``latin1`` shows bytes as characters one to one, so string and regular-expression functions work on bytes. It must not
be mixed up with the text of a string column, which ``utf8`` turns into bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from byteloom.functions import patterns as P


def latin1(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def utf8(text: Column) -> Column:
    """A string column's own bytes."""
    return F.encode(text, "UTF-8")


def utf32(text: Column, little: bool = False) -> Column:
    """UTF-32 without a mark."""
    big = F.encode(text, "UTF-32")
    return F.unhex(F.regexp_replace(F.hex(big), "(..)(..)(..)(..)", "$4$3$2$1")) if little else big


def low_bytes(text: Column) -> Column:
    """One byte for each UTF-16 unit of a string: its low eight bits."""
    wide = F.encode(text, "UTF-16BE")
    narrow = F.unhex(F.regexp_replace(F.hex(wide), "(?i)[0-9A-F]{2}([0-9A-F]{2})", "$1"))
    return F.when(text.rlike(r"[^\x00-\xFF]"), narrow).otherwise(F.encode(F.regexp_replace(text, r"[^\x00-\xFF]", ""), "ISO-8859-1"))


def head(data: Column, n: int) -> Column:
    return F.substring(data, 1, n)


def starts(data: Column, prefix: bytes) -> Column:
    return F.startswith(data, F.lit(prefix))


def holds(data: Column, needle: bytes) -> Column:
    return F.contains(data, F.lit(needle))


def position(data: Column, needle: str) -> Column:
    """0-based place of an ASCII string, or -1."""
    return F.instr(latin1(data), needle) - 1


def count(data: Column, byte_class: str) -> Column:
    """How many bytes are of the class (a regular-expression character class)."""
    return F.octet_length(data) - F.length(F.regexp_replace(latin1(data), f"{byte_class}++", ""))


def number(data: Column, offset: int, size: int, little: bool = False) -> Column:
    """The unsigned whole number of ``size`` bytes at ``offset``."""
    digits = F.hex(F.substring(data, offset + 1, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.conv(digits, 16, 10).cast("long")


def any_of(data: Column, values: frozenset[int]) -> Column:
    """Whether a byte of the set occurs."""
    return latin1(data).rlike(byte_class(values)) if values else F.lit(False)


def distinct(data: Column) -> Column:
    """The bytes that occur, each once, as characters."""
    return F.array_join(F.array_distinct(F.split(latin1(data), "")), "")


def byte_class(values: frozenset[int]) -> str:
    return "[" + "".join(rf"\x{v:02X}" for v in sorted(values)) + "]"


def non_ascii(data: Column) -> Column:
    return count(data, P.HIGH)


def condensed(data: Column) -> Column:
    """The bytes as characters, without those that no multi-byte sequence can hold.

    Sequences have an ASCII byte right after a high one alone. So of each run of ASCII the first byte stays, and a NUL,
    which ends any sequence, stands for the rest. Mostly Western text becomes very short.
    """
    return F.regexp_replace(latin1(data), r"(?<=[\x00-\x7F])[\x00-\x7F]++", "\x00")


def structure(text: Column, encoding: str) -> Column:
    """(leads, valid, mb_bytes, lead_diversity): how ``condensed`` bytes read as sequences of a multi-byte encoding.

    The regular expression walks as a decoder does: a valid sequence is taken whole, else one byte is skipped.
    """
    lead, sequence = P.SEQUENCES[encoding]
    # An array of one element binds the sequences, which are used three times.
    held = F.array(F.regexp_extract_all(text, F.lit(f"(?s){sequence}"), F.lit(0)))
    found = F.transform(
        held,
        lambda valid: F.struct(
            F.regexp_count(text, F.lit(f"(?s){sequence}|{lead}")).alias("leads"),
            F.size(valid).alias("valid"),
            F.length(F.regexp_replace(F.array_join(valid, ""), r"[\x00-\x7F]", "")).alias("mb_bytes"),
            F.size(F.array_distinct(F.transform(valid, lambda v: F.left(v, F.lit(1))))).alias("lead_diversity"),
        ),
    )
    return found[0]


def pair_ratio(s: Column) -> Column:
    return F.when(s["leads"] > 0, s["valid"] / s["leads"]).otherwise(F.lit(0.0))


def coverage(s: Column, high: Column) -> Column:
    return F.when(high > 0, s["mb_bytes"] / high).otherwise(F.lit(0.0))


def cjk_gate(s: Column, high: Column) -> Column:
    """Whether a multi-byte candidate stays: enough pairs, high bytes, coverage, and kinds of lead bytes."""
    return (pair_ratio(s) >= 0.05) & (high >= 2) & (coverage(s, high) >= 0.35) & ((high < 16) | (s["lead_diversity"] >= 4))


def utf8_bytes(data: Column) -> Column:
    """Bytes in multi-byte sequences of valid UTF-8; null if it isn't, or has none. A last sequence may be cut off."""
    text = latin1(data)
    high = non_ascii(data)
    rest = F.length(F.regexp_replace(text, rf"(?s)[\x00-\x7F]++|{P.UTF8_SEQUENCE}|{P.UTF8_CUT}", ""))
    within = F.length(F.regexp_replace(text, rf"(?s)({P.UTF8_SEQUENCE})|[\x00-\x7F]++|{P.UTF8_CUT}", "$1"))
    # What is valid to the end needs no walk.
    return F.when(F.is_valid_utf8(data), F.nullif(high, F.lit(0))).otherwise(F.when((rest == 0) & (within > 0), within))


def utf8_confidence(data: Column, within: Column | None = None) -> Column:
    """0.80 to 0.99, by the share of bytes in multi-byte sequences; null if the data isn't UTF-8 with any.

    ``within`` is ``utf8_bytes``, if it is a column already: it is used twice.
    """
    within = utf8_bytes(data) if within is None else within
    share = F.least(within * 6 / F.octet_length(data), F.lit(1.0))
    return F.when(within.isNotNull(), F.least(F.lit(0.99), F.lit(0.80) + F.lit(0.19) * share))


def ascii_confidence(data: Column) -> Column:
    """1 for text bytes alone, 0.99 with at most 5 % NULs besides, else null."""
    other, nulls = count(data, P.NOT_TEXT), count(data, r"\x00")
    with_nulls = holds(data, b"\x00") & (other == nulls) & (nulls <= F.octet_length(data) * 0.05)
    return F.when(~latin1(data).rlike(P.NOT_TEXT), 1.0).when(with_nulls, 0.99)


def is_binary(data: Column) -> Column:
    """More than 1 % control bytes."""
    return latin1(data).rlike(P.CONTROL) & (count(data, P.CONTROL) > F.octet_length(data) * 0.01)
