from __future__ import annotations

import collections

import numpy as np
import pytest

from byteloom.operators.options import DetectOptions
from byteloom.tables import codepages, models, names, registry
from byteloom.tables.registry import Era


def test_registry_has_86_encodings_in_six_eras():
    assert len(registry.REGISTRY) == 86
    assert [e.ordinal for e in registry.REGISTRY.values()] == list(range(86))
    assert collections.Counter(e.era.name for e in registry.REGISTRY.values()) == {"MODERN_WEB": 32, "LEGACY_ISO": 15, "LEGACY_MAC": 6, "LEGACY_REGIONAL": 10, "DOS": 17, "MAINFRAME": 6}
    assert sum(e.is_multibyte for e in registry.REGISTRY.values()) == 13


@pytest.mark.parametrize(
    "name, expected",
    [("UTF8", "utf-8"), ("latin-1", "iso8859-1"), ("ISO_8859-1:1987", "iso8859-1"), ("windows-1252", "cp1252"), ("gbk", "gb18030"), ("cp037", "cp1140"), ("Big5", "big5hkscs"), ("646", "ascii"), ("macintosh", "mac-roman"), ("nonsense", None), ("utf-8\0", None), ("", None)],
)
def test_lookup(name, expected):
    assert registry.lookup(name) == expected


def test_candidates_are_filtered_in_rank_order():
    found = registry.candidates(Era.DOS, frozenset({"cp437", "cp866", "utf-8"}), frozenset({"cp866"}))
    assert [e.name for e in found] == ["cp437"]
    assert len(registry.candidates(Era.ALL)) == 86
    assert len(registry.candidates(Era.MODERN_WEB | Era.DOS)) == 49


def test_options_are_checked_when_made():
    with pytest.raises(ValueError, match="Unknown encoding"):
        DetectOptions(include_encodings=("nope",))
    with pytest.raises(ValueError, match="must not be empty"):
        DetectOptions(exclude_encodings=())
    for bad in (0, -1, True, 1.5):
        with pytest.raises(ValueError, match="positive integer"):
            DetectOptions(max_bytes=bad)
    with pytest.warns(DeprecationWarning):
        assert DetectOptions(should_rename_legacy=True).prefer_superset
    with pytest.warns(DeprecationWarning):
        DetectOptions(chunk_size=1)
    with pytest.warns(UserWarning, match="excluded"):
        DetectOptions(include_encodings=("utf-8",))


@pytest.mark.parametrize("expected, detected, ok", [("ascii", "utf-8", True), ("utf-8", "ascii", False), ("GB2312", "gb18030", True), ("EUC-JP", "euc_jis_2004", True), ("iso2022_jp_2", "iso2022_jp_ext", True), (None, None, True), (None, "utf-8", False), ("utf-8", None, False), ("koi8-r", "koi8-u", False), ("utf-16", "utf-16-le", True)])
def test_is_correct(expected, detected, ok):
    assert names.is_correct(expected, detected) is ok


def test_display_names_follow_the_preferred_superset():
    assert names.display("ascii", prefer_superset=True) == "Windows-1252"
    assert names.display("ascii") == "ascii"
    assert names.display("iso2022_jp_2") == "ISO-2022-JP"
    assert names.display(None) is None
    assert names.display("cp1252", compat_names=False) == "cp1252"


def test_language_equivalence():
    assert names.is_language_equivalent("no", "sv") and names.is_language_equivalent("en", "en")
    assert not names.is_language_equivalent("en", "fr")


def test_code_pages():
    assert codepages.undefined("cp1252") == {0x81, 0x8D, 0x8F, 0x90, 0x9D}
    assert sum(bool(codepages.undefined(e)) for e in codepages.single_byte()) == 22
    assert len(codepages.confusable()) == 74
    assert codepages.confusable()[frozenset(("cp850", "cp858"))] == {0xD5}
    assert codepages.distinguishing()["cp1254"] == {0xD0, 0xDD, 0xDE, 0xF0, 0xFD, 0xFE}
    assert codepages.tajik() == {0x80, 0x81, 0x83, 0x8A, 0x8C, 0x8D, 0x8E, 0x90, 0xA1, 0xA2, 0xA5, 0xB5}


def test_models_round_trip_and_are_checked():
    standard = models.standard()
    assert standard.weights.shape == (len(standard.keys), models.CELLS)
    assert (standard.idf >= 1).all()
    few = models.build([("en", "utf-8"), ("fr", "utf-8")], np.array([np.bincount(models.bigrams(t.encode()), minlength=models.CELLS) for t in ("the thing", "le chien")]))
    packed = models.pack(few)
    back = models.unpack(packed)
    assert back.keys == few.keys and (back.weights == few.weights).all() and np.allclose(back.norms, few.norms)
    for broken, what in ((b"nope" + packed[4:], "CMD2"), (packed[:-1], "cells"), (packed[:20], "end"), (packed[:4] + b"\xff\xff\xff\xff", "claim")):
        with pytest.raises(ValueError, match=what):
            models.unpack(broken)
