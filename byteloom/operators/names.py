"""Naming and equivalence as column expressions: small maps are literals, so nothing is joined or shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from byteloom.functions.stages import literal_map
from byteloom.tables import names, registry


def mapping(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def lookup(name: Column) -> Column:
    """The registered encoding of a name or alias, in any spelling that Python's codecs have, else null."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9.]+", "_"), "^_|_$", "")
    return F.coalesce(mapping(registry.names(), F.lower(name)), F.when(~F.contains(name, F.lit("\0")), mapping(registry.codec_names(), plain)))


def prefer_superset(encoding: Column) -> Column:
    return F.coalesce(mapping(names.PREFERRED_SUPERSET, encoding), encoding)


def compat_name(encoding: Column) -> Column:
    return F.coalesce(mapping(names.COMPAT_NAMES, encoding), encoding)


def single_language(encoding: Column) -> Column:
    """The language of an encoding that has one alone."""
    return mapping({e.name: e.languages[0] for e in registry.REGISTRY.values() if len(e.languages) == 1}, encoding)


def language_name(code: Column) -> Column:
    return mapping(names.LANGUAGES, code)


def language_code(name: Column) -> Column:
    return mapping(names.ISO_CODES, F.lower(name))


def is_correct(expected: Column, detected: Column) -> Column:
    """Whether a detected encoding is right; null stands for binary, which only null matches."""
    known = [F.coalesce(lookup(c), F.lower(c)) for c in (expected, detected)]
    sets = F.create_map(*[x for k, v in names.accepted().items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    accepted = F.coalesce(F.array_contains(F.try_element_at(sets, known[0]), known[1]), F.lit(False))
    both = expected.isNotNull() & detected.isNotNull()
    return F.when(both, (known[0] == known[1]) | accepted).otherwise(expected.isNull() & detected.isNull())


def is_language_equivalent(expected: Column, detected: Column) -> Column:
    out = expected == detected
    for group in names.LANGUAGE_GROUPS:
        out = out | (expected.isin(*group) & detected.isin(*group))
    return out


def report(label: Column, result: Column, minimal: bool = False, language: bool = False) -> Column:
    """One line of output for a result: label, encoding, language and confidence, or the encoding alone."""
    encoding = F.coalesce(result["encoding"], F.lit("None"))
    iso = F.coalesce(result["language"], F.lit("und"))
    if minimal:
        return F.concat_ws(" ", encoding, iso) if language else encoding
    shown = F.concat(F.lit(" "), iso, F.lit(" ("), F.initcap(F.coalesce(language_name(iso), iso)), F.lit(")")) if language else F.lit("")
    return F.concat(label, F.lit(": "), encoding, shown, F.lit(" with confidence "), result["confidence"].cast("string"))
