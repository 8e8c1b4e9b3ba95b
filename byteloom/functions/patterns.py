"""Byte patterns that Spark's (Java's) and Python's regular expressions share.

Both run over bytes seen as Latin-1 characters, so positions and lengths are those of the bytes. They are written for
dot-matches-all mode.
"""

from __future__ import annotations

import re

# For each multi-byte encoding its lead bytes, and its valid sequences, longest first.
SEQUENCES = {
    "shift_jis_2004": (r"[\x81-\x9F\xE0-\xEF]", r"[\x81-\x9F\xE0-\xEF][\x40-\x7E\x80-\xFC]"),
    "cp932": (r"[\x81-\x9F\xE0-\xFC]", r"[\x81-\x9F\xE0-\xFC][\x40-\x7E\x80-\xFC]"),
    "euc_jis_2004": (r"[\x8E\x8F\xA1-\xFE]", r"\x8F[\xA1-\xFE]{2}|\x8E[\xA1-\xDF]|[\xA1-\xFE]{2}"),
    "euc_kr": (r"[\xA1-\xFE]", r"[\xA1-\xFE]{2}"),
    "cp949": (r"[\x81-\xC8\xCA-\xFD]", r"[\x81-\xC8\xCA-\xFD][\x41-\x5A\x61-\x7A\x81-\xFE]"),
    "gb18030": (r"[\x81-\xFE]", r"[\x81-\xFE][\x30-\x39][\x81-\xFE][\x30-\x39]|[\xA1-\xF7][\xA1-\xFE]"),
    "big5hkscs": (r"[\x87-\xFE]", r"[\x87-\xFE][\x40-\x7E\xA1-\xFE]"),
    "big5": (r"[\xA1-\xF9]", r"[\xA1-\xF9][\x40-\x7E\xA1-\xFE]"),
    "johab": (r"[\x84-\xD3\xD8-\xDE\xE0-\xF9]", r"[\x84-\xD3\xD8-\xDE\xE0-\xF9][\x31-\x7E\x91-\xFE]"),
}

#: RFC 3629's multi-byte sequences, and a last one that is cut off (whose bytes aren't looked at).
UTF8_SEQUENCE = r"[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}|[\xF1-\xF3][\x80-\xBF]{3}|\xF4[\x80-\x8F][\x80-\xBF]{2}"
UTF8_CUT = r"[\xC2-\xDF]\z|[\xE0-\xEF].?\z|[\xF0-\xF4].{0,2}\z"

CONTROL = r"[\x00-\x08\x0E-\x1F]"
NOT_TEXT = r"[^\x09\x0A\x0D\x20-\x7E]"
HIGH = r"[\x80-\xFF]"

# Patterns of what an XML or HTML page or a Python file says about its encoding, in the order in which it is
# believed. They decide which declarations count, so they have to be these.
DECLARATIONS = [
    (r"<\?xml[^>]+encoding\s*=\s*['\"]([^'\"]+)['\"]", "text/xml"),
    (r"<meta[^>]+charset\s*=\s*['\"]?\s*([^\s'\">;]+)", "text/html"),
    (r"<meta[^>]+content\s*=\s*['\"][^'\"]*charset=([^\s'\">;]+)", "text/html"),
]
CODING_COMMENT = r"(?m)^[ \t\f]*#[^\n\r]*?coding[:=][ \t]*([-\w.]+)"

#: HZ's shifted regions; those of an even number of printable bytes count.
HZ_REGION, HZ_PAIRS = r"~\{(.*?)~\}", r"\A(?:[\x21-\x7E]{2})+\z"


def python(pattern: str) -> re.Pattern[bytes]:
    return re.compile(pattern.replace(r"\z", r"\Z").encode("ascii"), re.S)
