"""Native stages against the Python ones, and detection as a whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from byteloom.functions import bytes as B
from byteloom.functions import patterns as P
from byteloom.functions import stages as S
from byteloom.operators import residual as R
from byteloom.operators.detect import candidate_log, column, detect, detect_all, detect_native, register
from byteloom.operators.options import DetectOptions
from byteloom.plans import queries as Q
from byteloom.tables.models import standard
from byteloom.tables.names import is_correct
from byteloom.tables.registry import REGISTRY
from byteloom.tables.samples import SAMPLES


def frame(spark, contents):
    return spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "id int, content binary")


def edge_bytes(n, seed=5):
    rng = random.Random(seed)
    alphabet = [0x00, 0x08, 0x0A, 0x0E, 0x1B, 0x1F, 0x20, 0x2B, 0x30, 0x39, 0x40, 0x41, 0x5A, 0x61, 0x7A, 0x7E, 0x7F, 0x80, 0x81, 0x8E, 0x8F, 0x9F, 0xA0, 0xA1, 0xBF, 0xC1, 0xC2, 0xC3, 0xC8, 0xC9, 0xDF, 0xE0, 0xED, 0xEF, 0xF0, 0xF4, 0xF5, 0xF7, 0xFC, 0xFD, 0xFE, 0xFF]
    return [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def walk(data, encoding):
    """The tokenizer in plain steps."""
    lead, seq = (P.python(p) for p in P.SEQUENCES[encoding])
    at, leads, valid = 0, 0, []
    while at < len(data):
        m = seq.match(data, at)
        if m:
            valid.append(m[0])
            at = m.end()
            leads += 1
        else:
            leads += bool(lead.match(data, at))
            at += 1
    return leads, len(valid), sum(b > 0x7F for v in valid for b in v), len({v[0] for v in valid})


@pytest.mark.parametrize("encoding", list(P.SEQUENCES))
def test_structure_is_a_left_to_right_walk(spark, encoding):
    data = edge_bytes(400)
    got = frame(spark, data).select("id", B.structure(B.condensed(F.col("content")), encoding).alias("s")).collect()
    for r in got:
        assert tuple(r["s"]) == walk(data[r["id"]], encoding), data[r["id"]]
        python = R.structure(data[r["id"]], encoding)
        assert (python.mb_bytes, python.diversity) == tuple(r["s"])[2:]


def utf8_walk(data):
    """RFC 3629 step by step; a sequence cut off at the end is passed over."""
    at, within = 0, 0
    while at < len(data):
        b = data[at]
        if b < 0x80:
            at += 1
            continue
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 0
        if not size:
            return None
        if at + size > len(data):
            break
        try:
            data[at : at + size].decode("utf-8")
        except UnicodeDecodeError:
            return None
        within += size
        at += size
    return within or None


def test_utf8_matches_the_walk(spark):
    data = edge_bytes(2000, 9) + ["é".encode() * 50_000, "aé€𝒳".encode() * 1000, b"ab\xf0\xc2\x8f", b"\xc3"]
    got = frame(spark, data).select("id", B.utf8_bytes(F.col("content")).alias("n"), B.utf8_confidence(F.col("content")).alias("c")).collect()
    for r in got:
        assert r["n"] == utf8_walk(data[r["id"]]), data[r["id"]][:20]
        assert (r["c"] is None) == (r["n"] is None)
        python = R.utf8(data[r["id"]]) if data[r["id"]] else None
        assert python == pytest.approx(r["c"]) if python is not None else r["c"] is None


CASES = {
    b"": ("utf-8", 0.10, None, "text/plain"),
    b"plain words\n": ("ascii", 1.0, ..., "text/plain"),
    b"\xef\xbb\xbfhello": ("utf-8-sig", 1.0, ..., "text/plain"),
    b"\xff\xfea\x00b\x00": ("utf-16", 1.0, ..., "text/plain"),
    b"\x00\x00\xfe\xff\x00\x00\x00a": ("utf-32", 1.0, ..., "text/plain"),
    b"\xff\xfe\x00\x00a\x00": ("utf-16", 1.0, ..., "text/plain"),
    b"\x1b$B$3$s\x1b(B": ("iso2022_jp_2", 0.95, "ja", "text/plain"),
    b"\x1b(I123\x1b(B": ("iso2022_jp_ext", 0.95, "ja", "text/plain"),
    b"\x1b$)C\x0e12\x0f": ("iso2022_kr", 0.95, "ko", "text/plain"),
    b"a ~{VPND~} b": ("hz", 0.95, "zh", "text/plain"),
    b"+AOk-t+AOk-": ("utf-7", 0.95, ..., "text/plain"),
    b"1 + 1 = 2": ("ascii", 1.0, ..., "text/plain"),
    b"\x89PNG\r\n\x1a\n0000": (None, 1.0, None, "image/png"),
    b"\x00\x00\x00\x10ftypavif\x00\x00\x00\x00": (None, 1.0, None, "image/avif"),
    b"RIFF\x00\x00\x00\x00WEBPVP8 ": (None, 1.0, None, "image/webp"),
    b"\xca\xfe\xba\xbe\x00\x00\x00\x34": (None, 1.0, None, "application/java-vm"),
    b"\x00" * 257 + b"ustar\x0000": (None, 1.0, None, "application/x-tar"),
    b"\x01\x02\x03\x80\x81": (None, 0.95, None, "application/octet-stream"),
    b'<?xml version="1.0" encoding="iso-8859-2"?><a/>': ("iso8859-2", 0.95, ..., "text/xml"),
    b'<meta charset="windows-1251">hello': ("cp1251", 0.95, ..., "text/html"),
    b"# -*- coding: latin-1 -*-\nprint()\n": ("iso8859-1", 0.95, ..., "text/x-python"),
    b'<meta charset="utf-8">\xff\xfe\xfd caf': (..., ..., ..., ...),
    b"text" * 30 + b"\x00" * 6: ("ascii", 0.99, ..., "text/plain"),
    "caffè naïve façade".encode(): ("utf-8", ..., ..., "text/plain"),
}


def test_byte_literals(spark):
    contents = list(CASES)
    found = detect(frame(spark, [*contents, None]), options=DetectOptions(compat_names=False)).collect()
    for r in found:
        if r["id"] == len(contents):
            assert r["detected"] is None
            continue
        got, want = r["detected"], CASES[contents[r["id"]]]
        for name, w in zip(("encoding", "confidence", "language", "mime_type"), want):
            assert w is ... or got[name] == w, (contents[r["id"]], name, got)


def test_native_stages_agree_with_python(spark):
    rng = random.Random(2)
    pieces = [b"", b"\xef\xbb\xbf", b"\xff\xfe", b"\x00\x00\xfe\xff", b"\x1b$B", b"~{VPND~}", b"+AOk-", b"abc \n", b"\x00", b"\x01", "é".encode(), b"\xe9", b"\x82\xa0\x82\xa2", b"PK\x03\x04", b"%PDF-", b"BM", b'<meta charset="sjis">', b'<meta charset="iso-8859-6">', b'<?xml encoding="utf-8"?>', b"# coding: nope\n", b"\xa1\xff", b"~{", b"+", b"GIF89a"]
    data = [b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(1500)] + edge_bytes(1500, 3)
    options, models = DetectOptions(language=False), standard()
    decided = 0
    for r in S.decided(frame(spark, data), "content", "n", options.allowed, "utf-8", options.max_bytes).select("id", "n").collect():
        if r["n"] is not None:
            decided += 1
            want = R.detect_all(data[r["id"]], options, models)[0]
            assert tuple(r["n"])[0::3] == (want.encoding, want.mime_type) and r["n"]["confidence"] == pytest.approx(want.confidence), data[r["id"]]
    assert decided > 700


def test_round_trip_of_all_encodings():
    models, options, wrong = standard(), DetectOptions(), []
    for e in REGISTRY.values():
        for lang in e.languages or ["fr"]:
            data = SAMPLES[lang][40:].encode(e.name, "ignore")
            found = R.detect_all(data, options, models)[0].encoding
            if not is_correct(e.name, found) and data.decode(found or "latin-1", "ignore") != data.decode(e.name, "ignore"):
                wrong.append((e.name, lang, found))
    assert len(wrong) <= 6, wrong


def test_filters_and_fallbacks(spark):
    data = frame(spark, [b"plain", "é".encode(), b"", b"\x89PNG\r\n\x1a\n", b"\x80\x81\x01\x02\x03"])
    with pytest.warns(UserWarning):
        options = DetectOptions(include_encodings=("cp1252", "cp437"), compat_names=False)
    got = {r["id"]: r["detected"]["encoding"] for r in detect(data, options=options).collect()}
    assert got[0] in ("cp1252", "cp437") and got[1] in ("cp1252", "cp437")
    assert got[2] is None and got[3] is None and got[4] is None


def test_inclusion_does_not_change_an_answer():
    models = standard()
    for data in ("déjà vu en été".encode(), SAMPLES["ru"].encode("koi8-r"), SAMPLES["ja"].encode("cp932")):
        whole = R.detect_all(data, DetectOptions(), models)[0].encoding
        alone = R.detect_all(data, DetectOptions(include_encodings=(whole,), no_match_encoding=whole, empty_input_encoding=whole), models)[0].encoding
        assert alone == whole


def test_detect_all_lists_candidates_by_confidence(spark):
    data = frame(spark, [SAMPLES["fr"].encode("latin-1"), b"plain", None])
    rows = detect_all(data).orderBy("id", "rank").collect()
    first = [r for r in rows if r["id"] == 0]
    assert [r["rank"] for r in first] == list(range(1, len(first) + 1)) and len(first) > 1
    assert all(a["confidence"] >= b["confidence"] for a, b in zip(first, first[1:]))
    assert len([r for r in rows if r["id"] == 1]) == 1 and not [r for r in rows if r["id"] == 2]
    high = detect_all(data, minimum_threshold=2.0).where("id = 0").count()
    assert high == detect_all(data, ignore_threshold=True).where("id = 0").count()


def test_postprocessing():
    F_ = R.Found
    top = [F_("iso8859-10", 0.9, "is"), F_("cp437", 0.8), F_("cp1252", 0.7, "fr")]
    moved = R.without_niche(b"abc \xe9", top)
    assert [f.encoding for f in moved] == ["cp1252", "cp437", "iso8859-10"] and moved[0].confidence == 0.9
    assert R.without_niche(b"abc \xa1", top) == top
    koi = [F_("koi8-r", 0.9), F_("cp1251", 0.5), F_("koi8-t", 0.4)]
    assert [f.encoding for f in R.with_tajik(b"\x8a", koi)] == ["koi8-t", "koi8-r", "cp1251"]
    assert R.with_tajik(b"\xc1", koi) == koi
    assert R.vote(b"\xa4", "iso8859-1", "iso8859-15", frozenset({0xA4})) is None
    assert R.vote(b"\xbd", "iso8859-1", "iso8859-15", frozenset({0xBD})) == "iso8859-15"


def test_column_function_and_sql(spark):
    data = frame(spark, [b"plain", "é".encode()])
    assert [r[0] for r in data.select(column(F.col("content")).alias("r")).select("r.encoding").collect()] == ["ascii", "utf-8"]
    register(spark, "what_bytes")
    data.createOrReplaceTempView("some_bytes")
    assert {r[0] for r in spark.sql("SELECT what_bytes(content).mime_type FROM some_bytes").collect()} == {"text/plain"}
    assert detect_native(data).where("detected is null").count() == 0


def test_low_bytes(spark):
    got = spark.createDataFrame([("aé",), ("€x",), ("",)], "t string").select(F.hex(B.low_bytes(F.col("t")))).collect()
    assert [r[0] for r in got] == ["61E9", "AC78", ""]


def test_planted_archives():
    assert [R.zip_kind(a).rsplit(".", 1)[-1].rsplit("/", 1)[-1] for a in Q._ARCHIVES] == ["sheet", "document", "java-archive", "x-wheel+zip", "text", "zip"]


def plain_ranking(data, options, models):
    """Structure and statistics in plain steps, with Python's codecs, dictionaries and loops."""
    from byteloom.tables import codepages as C

    def similar(pairs, rows):
        counts = {}
        for pair in pairs:
            counts[pair] = counts.get(pair, 0) + 1
        weight = {c: n * int(models.idf[c]) for c, n in counts.items()}
        length = sum(w * w for w in weight.values()) ** 0.5
        return [sum(w * int(models.weights[k, c]) for c, w in weight.items()) / (float(models.norms[k]) * length) if length else 0.0 for k in rows]

    def best(pairs, name):
        rows = list(models.of(name))
        scores = similar(pairs, rows)
        k = max(range(len(rows)), key=lambda i: (scores[i], -i), default=None)
        return (scores[k], models.keys[rows[k]][0]) if k is not None and scores[k] > 0 else (0.0, None)

    pairs = [data[i] * 256 + data[i + 1] for i in range(min(len(data), 16384) - 1)]
    high, ratios, cover, names = sum(b > 127 for b in data), {}, {}, []
    for e in options.candidates:
        if e.is_multibyte:
            if not R.decodes(data, e.name) or e.name not in P.SEQUENCES:
                continue
            leads, valid, mb, kinds = walk(data, e.name)
            ratio = valid / leads if leads else 0.0
            if ratio < 0.05 or high < 2 or mb / high < 0.35 or high >= 16 and kinds < 4:
                continue
            ratios[e.name], cover[e.name] = ratio, mb / high
        elif e.name in C.single_byte():
            if any(C.characters(e.name)[b] is None for b in data) and e.name != "ascii":
                continue
        elif not R.decodes(data, e.name):
            continue
        names.append(e.name)
    wide = sorted(ratios, key=lambda n: -ratios[n])
    boosted = bool(wide) and ratios[wide[0]] >= 0.85
    order = [*wide, *(n for n in names if n not in ratios)] if boosted else names
    found = []
    for n in order:
        score, lang = best(pairs, n)
        if score > 0:
            found.append([n, score * (1 + cover[n]) if boosted and cover.get(n, 0) >= 0.95 else score, lang])
    found.sort(key=lambda f: -f[1])
    if boosted:  # sorted before and after the boost, equals in the order of the first
        first = sorted(([n, *best(pairs, n)] for n in order), key=lambda f: -f[1])
        place = {n: k for k, (n, _, _) in enumerate(first)}
        found.sort(key=lambda f: (-f[1], place[f[0]]))
    if not found:
        return None
    # The first candidate that is confusable with the leader, near enough and fits better, takes its place.
    top = found[0]
    for k, other in enumerate(found[1:], 1):
        if k > 1 and top[1] - other[1] > 0.005:
            break
        differ = {v for v in range(256) if C.characters(top[0])[v] != C.characters(other[0])[v]} if {top[0], other[0]} <= set(C.single_byte()) else set(range(256))
        if len(differ) > 0.2 * 256:
            continue
        touching = [data[i] * 256 + data[i + 1] for i in range(len(data) - 1) if data[i] in differ or data[i + 1] in differ]
        a, b = (best(touching, n)[0] for n in (top[0], other[0])) if touching else (0, 0)
        if a == b:
            a = b = 0
            for v in differ & set(data):
                pa, pb = (C.CATEGORY_PREFERENCE.get(C.category(n, v), 0) for n in (top[0], other[0]))
                a, b = a + max(pa - pb, 0), b + max(pb - pa, 0)
        if b > a:
            found = [[other[0], top[1], other[2]], *found[:k], *found[k + 1 :]]
            break
    own = {"iso8859-10", "iso8859-14", "cp1254", "hp-roman8"}
    if found[0][0] in own and not set(data) & C.distinguishing()[found[0][0]]:
        common = next((k for k, f in enumerate(found) if k and f[0] in ("iso8859-1", "iso8859-15", "cp1252")), None)
        if common is not None:
            niche = found[0]
            found = [[found[common][0], niche[1], found[common][2]], *[f for k, f in enumerate(found) if k not in (0, common)], niche]
    if found[0][0] == "koi8-r" and set(data) & C.tajik():
        k = next((k for k, f in enumerate(found) if f[0] == "koi8-t"), None)
        if k is not None:
            found = [[found[k][0], found[0][1], found[k][2]], *[f for i, f in enumerate(found) if i != k]]
    return found


def statistical_values():
    rng = random.Random(21)
    for lang, text in sorted(SAMPLES.items()):
        names = [e.name for e in REGISTRY.values() if lang in e.languages] + ["cp1252", "iso8859-1", "koi8-r", "cp1251", "cp437"]
        words = text.split()
        for name in rng.sample(names, min(3, len(names))):
            yield " ".join(rng.choice(words) for _ in range(rng.randint(2, 30))).encode(name, "ignore")
    for _ in range(30):
        yield bytes(rng.choice(b"aeinrst \xe9\xe8\xfc\xdf\xf0\xfe\xa4\xb3\xd2\xc1\x81\x90") for _ in range(rng.randint(2, 40)))


def test_ranking_against_a_plain_version():
    options, models, seen = DetectOptions(language=False), standard(), 0
    for data in statistical_values():
        got = R.ranked(data, options, models)
        want = plain_ranking(data, options, models)
        if want is None:
            assert [f.encoding for f in got] == ["cp1252"] and got[0].confidence == 0.10
            continue
        assert [f.encoding for f in got] == [f[0] for f in want], data
        for f, (_, score, lang) in zip(got, want):
            assert f.confidence == pytest.approx(score) and f.language == lang
        seen += 1
    assert seen > 100


def test_languages_of_many_values_are_those_of_each():
    models, values = standard(), [v for v in statistical_values()] + [b"", b"a", b"plain words and more"]
    values += [t.encode() for t in list(SAMPLES.values())[:20]]
    for encoding in ("utf-8", "ascii", "cp1252", "cp1251", "iso2022_kr"):
        got = R.languages(values, [encoding] * len(values), models)
        assert got == [R.language(v, encoding, models) if v else got[k] for k, v in enumerate(values)]


def test_thresholds_debug_log_and_old_options(spark):
    df = frame(spark, ["Das ist ein schöner Tag, früh am Morgen".encode("latin-1"), None])
    every = detect_all(df, ignore_threshold=True).count()
    kept = detect_all(df, minimum_threshold=2.0).collect()
    assert len(kept) == every > detect_all(df, minimum_threshold=0.3).count() > 0
    log = candidate_log(df).collect()
    assert len(log) == 1 and log[0]["line"].count('"encoding"') == every
    with pytest.warns(DeprecationWarning, match="lang_filter"):
        DetectOptions(lang_filter=1)


def test_native_lookup_is_the_lookup_of_python(spark):
    from byteloom.operators import names
    from byteloom.tables import registry

    asked = ["UTF8", "latin-1", "Latin 1", "ISO_8859-1:1987", "windows 1252", "U8", "cp-1252", "eucJP", "mac--roman", "ansi_x3.4-1986", "nothing", "", "utf\0-8", "8859", "csISOLatin2", "shift jis", "_latin_1_", "GB18030-2000", "iso-8859-8-i", "KOI8_R"]
    rows = spark.createDataFrame([(a,) for a in asked], "a string").select("a", names.lookup(F.col("a")).alias("e")).collect()
    assert {r["a"]: r["e"] for r in rows} == {a: registry.lookup(a) for a in asked}


def test_packed_confusable_pairs():
    from byteloom.tables.codepages import unpack_confusable

    data = b"\0\2" + b"\x06latin1" + b"\x06cp1252" + b"\2" + bytes([0x80, 25, 19, 0x81, 25, 99]) + b"\1x\1y\0"
    assert unpack_confusable(data) == {("iso8859-1", "cp1252"): {0x80: ("Cc", "Sc"), 0x81: ("Cc", "Cn")}, ("x", "y"): {}}
    for n in range(len(data)):
        with pytest.raises(ValueError, match="packed pairs end"):
            unpack_confusable(data[:n])
    with pytest.raises(ValueError, match="UTF-8"):
        unpack_confusable(b"\0\1\1\xff\1y\0")
