"""Bytes of a known encoding as text or UTF-8, and comparisons of decoded texts."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from byteloom.operators.residual import to_utf8


def _transcoded(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, encoding in batches:
        yield pd.Series([None if d is None or e is None else to_utf8(bytes(d), e) for d, e in zip(data, encoding)])


def transcode(data: Column, encoding: Column) -> Column:
    """UTF-8 bytes of data in the registered encoding; what can't be decoded is passed over. Unknown encodings give null."""
    return F.pandas_udf(_transcoded, "binary")(data, encoding)


def _plain(text: str) -> list[str]:
    """Each character without its marks; the general currency sign and the euro sign are one."""
    return ["¤" if c == "€" else "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in text]


def equivalent(data: bytes, a: str, b: str) -> bool:
    """Whether two encodings read the data as texts of equal length that differ in marks at most."""
    try:
        left, right = data.decode(a), data.decode(b)
    except (LookupError, UnicodeDecodeError):
        return False
    return left == right or len(left) == len(right) and _plain(left) == _plain(right)


def _equivalent(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for data, a, b in batches:
        yield pd.Series([None if d is None or x is None or y is None else equivalent(bytes(d), x, y) for d, x, y in zip(data, a, b)])


def reads_alike(data: Column, a: Column, b: Column) -> Column:
    return F.pandas_udf(_equivalent, "boolean")(data, a, b)
