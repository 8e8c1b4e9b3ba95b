"""Packing, language ID, quality, PII, SimHash and mixing against plain versions, and on odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from byteloom.llm import common, langid, mixing, ngrams, packing, pii, quality, queries, simhash

TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
ODD = [None, "", " \n\t", "x", "é" * 3, "word " * 40_000, "a" * 30_000, "%%% ###", "same text here now", "same text here now", "𝒳 中文 ñ"]
SCHEMA = "doc_id long, text string, lang string, source string, score double, spans string, lang_pred string, block int, slot int, rule string"


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with extra columns whose names clash with what operators add; a null id and a repeated row."""
    rows = [(i, t, "en", "s", 1.0, "x", "y", 1, 2, "r") for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, None, None, None, None, None, None, None), rows[8]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def write(spark, folder, docs, labels=()):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{folder}/labels.parquet")
    return str(folder)


# Packing


def token_pieces(texts):
    tok, want = Tokenizer.from_file(TOKENIZER), {}
    for doc, text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[doc, k // 2048] = (k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    return want


def check_packed(rows):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by_sequence)


def test_packing_of_odd_documents(spark, odd, tmp_path):
    rows = queries.op1_best_fit_packing(spark, write(spark, tmp_path, odd)).collect()
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    assert got == token_pieces([*enumerate(ODD), (None, "no id")])
    assert Counter((r["doc_id"], r["piece"]) for r in rows)[8, 0] == 2
    total = sum(r["length"] for r in rows)
    assert check_packed(rows) == -(-total // 2048)


def test_packed_sequences_hold_the_ids(spark, odd):
    packed = packing.pack(odd.limit(5), TOKENIZER, keep_ids=True)
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in packed.collect())


def test_packing_of_nothing(none):
    assert packing.pack(none, TOKENIZER).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_word_encoder_is_the_tokenizer(seed):
    rng = random.Random(seed)
    alphabet = list("aAbZé'sStT.,;!?-_#1 ٣́̊YyHẖ \n\t\x1c İΣς Kﬁ中ñ‍😀") + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|", "'s", "'ll", "RE", " "]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    tok = Tokenizer.from_file(TOKENIZER)
    for text, got in zip(texts, packing.WordEncoder(TOKENIZER).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids, text


def test_fullest_is_a_best_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 70)
        sums = {0}
        for n, c in counts.items():
            for _ in range(c):
                sums |= {s + n for s in sums if s + n <= room}
        chosen = packing.fullest(sorted(counts), counts, room)
        assert sum(n * k for n, k in chosen.items()) == max(sums)
        assert all(k <= counts[n] for n, k in chosen.items())


def fewest(histogram, capacity):
    """A bound from below: long pieces need a bin each, and the rest what room those leave not."""
    best = 0
    for small in range(capacity // 2 + 1):
        alone = sum(c for n, c in histogram.items() if n > capacity - small)
        half = {n: c for n, c in histogram.items() if capacity // 2 < n <= capacity - small}
        rest = sum(n * c for n, c in histogram.items() if small <= n <= capacity // 2)
        room = sum((capacity - n) * c for n, c in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def test_plan_places_each_length_once_and_fills_bins():
    rng = random.Random(2)
    histogram = {n: rng.randint(1, 50) for n in rng.sample(range(1, 2049), 400)}
    steps = packing.plan(histogram)
    placed = Counter()
    for s in steps:
        assert sum(n * k for n, k in s.pattern) <= 2048
        for n, k in s.pattern:
            placed[n] += k * s.times
    assert placed == histogram
    assert sum(s.times for s in steps) <= 1.01 * fewest(histogram, 2048) + 1
    assert len(steps) < 3 * len(histogram)


# Language ID

WORDS = {"en": "the and of to that with this are was from have not", "fr": "le la les des une dans pour que qui avec sur été", "de": "der die das und nicht mit ist ein für auf über"}


def prose(lang, rng, n=60):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


def test_language_id(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(lang := rng.choice(list(WORDS)), rng), lang) for i in range(400)] + [(900 + i, t, None) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    got = {r["doc_id"]: r for r in queries.op2_language_id(spark, write(spark, tmp_path, docs)).collect()}
    assert len(got) == len(rows)
    for doc, text, lang in rows:
        r = got[doc]
        assert r["held_out"] == (zlib.crc32(str(doc).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        letters = text is not None and any(map(str.isalpha, text))
        assert (r["lang_pred"] == "und") == (not letters)
        if lang:
            assert r["lang_pred"] == lang


def test_language_counts_are_those_of_all_texts(spark):
    rng = random.Random(4)
    texts = [prose("fr", rng, rng.randint(0, 30)) for _ in range(50)] + ["x" * 600_000]
    docs = spark.createDataFrame([(t, "fr") for t in texts], "text string, lang string").repartition(3)
    model = langid.train(docs)
    n = sum(max(len(t) - k, 0) for t in texts for k in range(3))
    want = np.zeros(1 << langid.BITS)
    for buckets, _, _ in langid._buckets(texts):
        want += np.bincount(buckets, minlength=(1 << langid.BITS) + 1)[:-1]
    assert want.sum() == n
    assert np.allclose(model.log_prob[:-1, 0], np.log(want + langid.ALPHA) - np.log(n + langid.ALPHA * (1 << langid.BITS)))


def test_long_texts_are_cut_without_losing_an_ngram(monkeypatch):
    texts = ["ab cd é" * 9, "", "z", "hello world " * 7]
    whole = [np.sort(b) for b, _, _ in langid._buckets(texts)]
    monkeypatch.setattr(ngrams, "BLOCK", 5)
    parts = [b[b < 1 << langid.BITS] for b, _, _ in langid._buckets(texts)]
    for k in range(3):
        assert np.array_equal(np.sort(np.concatenate(parts[k::3])), whole[k][whole[k] < 1 << langid.BITS])


def test_language_scores_are_those_of_plain_naive_bayes(spark):
    """Counts, log-probabilities and posteriors from n-grams that are cut and hashed one by one."""
    rng = random.Random(15)
    rows = [(prose(lang := rng.choice(["en", "fr", "de"]), rng, 12) + rng.choice(["", " É1", "!?"]), lang) for _ in range(60)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))

    def grams(text):
        letters = [ord(c.lower()[0]) if c.isalpha() else 32 for c in text]
        for n in (1, 2, 3):
            for at in range(len(letters) - n + 1):
                h = n * 0x9E3779B1 % 2**32
                for point in letters[at : at + n]:
                    h = (h ^ point) * 0x85EBCA6B % 2**32
                    h ^= h >> 15
                yield h >> (32 - langid.BITS)

    counts = {lang: Counter() for lang in ("de", "en", "fr")}
    for text, lang in rows:
        counts[lang].update(grams(text))
    docs, size = Counter(lang for _, lang in rows), 2**langid.BITS
    asked = [text for text, _ in rows[:20]] + ["été", "the"]
    langs, scores = langid.score(model, asked)
    for text, lang, score in zip(asked, langs, scores):
        logs = {x: math.log(docs[x] / 60) + sum(math.log((c[g] + langid.ALPHA) / (c.total() + langid.ALPHA * size)) for g in grams(text)) for x, c in counts.items()}
        best = max(logs, key=logs.get)
        assert lang == best and score == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()))


def test_languages_have_an_end(spark, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGS", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.train(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "text string, lang string"))


def test_language_id_without_training(spark, odd, none):
    model = langid.train(none)
    rows = langid.classify(odd, model).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)} and len(rows) == len(ODD) + 2
    assert langid.classify(none, model).collect() == []


# Quality


def test_quality_tells_junk(spark, tmp_path):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(300):
        bad = rng.random() < 0.3
        text = prose("en", rng)
        rows.append((i, " ".join(w.upper() + "!!" for w in text.split()) if bad else text))
        labels.append((i, int(not bad), 0))
    rows += [(900 + i, t) for i, t in enumerate(ODD)]
    labels += [(900, None, 0), (5000, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in queries.op4_quality(spark, write(spark, tmp_path, docs, labels)).collect()}
    assert len(got) == len(rows)
    for i, label, _ in labels[:300]:
        assert got[i]["predicted"] == label and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert got[900]["score"] == got[901]["score"] and 0.5 < got[900]["score"] < 1


def test_quality_without_labels(spark, odd, none, tmp_path):
    rows = queries.op4_quality(spark, write(spark, tmp_path, odd)).collect()
    assert {(r["score"], r["predicted"]) for r in rows} == {(0.0, 0)}
    assert queries.op4_quality(spark, write(spark, tmp_path, none)).collect() == []


def test_quality_votes_are_exact():
    rng = np.random.default_rng(1)
    vectors = quality._unit(rng.standard_normal((50, 4)))
    labels = rng.integers(0, 2, 50)
    model = quality.Model(np.ones((1 << quality.BITS) + 1, np.float32), rng.standard_normal(((1 << quality.BITS) + 1, 4)), vectors, labels, np.ones(50), 0.5)
    texts = ["some text", "another one altogether", ""]
    got = quality.score(model, texts, k=7)
    for text, score in zip(texts[:2], got):
        unit = quality._unit(quality._weigh(quality.features([text]), model.idf) @ model.axes)[0]
        near = sorted(range(50), key=lambda i: -float(unit @ vectors[i]))[:7]
        votes = [max(float(unit @ vectors[i]), 0) for i in near]
        assert score == pytest.approx(sum(v for v, i in zip(votes, near) if labels[i]) / sum(votes))
    assert got[2] == 0.5


# PII

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_pii_base_spans(spark, odd, tmp_path):
    rng = random.Random(6)
    bits = ["a@b.com", "x_y@d.co.uk", "@", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+49 30 1234567890", ".", "5", "é", "𝒳", "\n", "1.2.3.4.5.6.7.8.9", "--", "%", "_", "a", "9" * 20, " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(800)] + ["a@b.co " * 3000, "1" * 20_000, "+1" + " " * 20_000]
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    known = {100 + i: t for i, t in enumerate(texts)} | dict(enumerate(ODD)) | {None: "no id"}
    rows = queries.op8_pii(spark, write(spark, tmp_path, docs)).collect()
    assert len(rows) == len(texts) + len(ODD) + 2
    for r in rows:
        want = base_spans(known[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s and s.split(":")[0] in dict(BASE)] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s.startswith(k + ":") for s in want) for k, _ in BASE)


def test_pii_zero_octets(spark, tmp_path):
    rng = random.Random(7)
    octets = ["0", "00", "000", "1", "010", "0255", "255", "0256", "256", "100", "300", "0" * 40, "0" * 3000]
    texts = ["10.0.0.1", "0.0.0.0", "127.0.0.1", "8.8.8.0", "192.168.0.1", "at 10.0.0.1, or 256.0.0.1."] + ["x".join(".".join(rng.choice(octets) for _ in range(rng.randint(3, 9))) for _ in range(3)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in queries.op8_pii(spark, write(spark, tmp_path, docs)).collect():
        want = base_spans(texts[r["doc_id"]])
        assert [s for s in r["spans"].split(",") if s and s.split(":")[0] in dict(BASE)] == want
        assert r["n_ip"] == sum(s.startswith("ip:") for s in want) and (r["n_ip"] == 1 or r["doc_id"] > 5)
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    clean = [r["text"] for r in pii.redact(docs).orderBy("doc_id").limit(6).collect()]
    assert clean == ["[IP]"] * 5 + ["at [IP], or 256.0.0.1."]


def test_pii_added_spans_and_redaction(spark, none):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 please", "GB83 WEST 1234 5698 7654 32", "my ssn is 123-45-6789", "part no 123-45-6789", "a@b.com and 1.2.3.4, card 4111 1111 1111 1111", None]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = [r["s"] for r in pii.detect(docs).orderBy("doc_id").select(pii.written(F.col("spans")).alias("s")).collect()]
    assert got[0].startswith("iban:7:") and got[1] == "" and got[2] == "ssn:10:21" and got[3] == ""
    clean = [r["text"] for r in pii.redact(docs).orderBy("doc_id").collect()]
    assert clean == ["pay to [IBAN] please", texts[1], "my ssn is [SSN]", texts[3], "[EMAIL] and [IP], card [CARD]", None]
    assert pii.detect(none).collect() == [] and pii.redact(docs).columns == docs.columns


def test_redaction_against_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 4)
    rng = random.Random(13)
    bits = ["a@b.com", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 123-4567", "words ", "é𝒳", "+4111111111111111", "\n", " ", "iban GB82 WEST 1234 5698 7654 32 "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["a@b.co " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    for r in pii.redact(docs).collect():
        text, out, at = texts[r["doc_id"]], "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += text[at : s["start"]] + pii.LABELS[pii.KINDS[s["kind"]]]
            at = max(at, s["end"])
        assert r["text"] == out + text[at:]


CLASHES = "_email _ip _card _phone _iban _ssn spans _spans __spans pool block slot place share phase turn since until slot0 cycle nth _start _salt _rank _digest _tie _round _count _at _parts _input _low _high _file _row _since lang_pred score length".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with a column of each name that operators use inside."""
    rng = random.Random(14)
    rows = [(i if i % 7 else None, prose(lang := rng.choice(["en", "fr"]), rng, 60) + " a@b.com", lang, f"src{i % 3}", 5, *[f"{c}{i}" for c in CLASHES]) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))


def test_operators_pass_on_columns_of_any_name(clashing):
    rows = sorted(clashing.collect(), key=str)

    def others(found, *replaced):
        names = [c for c in clashing.columns if c not in replaced]
        return found.columns, sorted((str([r[c] for c in names]) for r in found.collect())) == sorted(str([r[c] for c in names]) for r in rows)

    assert others(pii.detect(clashing), "spans")[1] and others(pii.redact(clashing), "text") == (clashing.columns, True)
    assert others(mixing.mix(clashing, {"src0": 2, "src1": 1}), *mixing.ADDED)[1]
    assert others(langid.classify(clashing, langid.train(clashing)), "lang_pred", "score")[1]
    assert simhash.near_duplicates(clashing).count() == len(rows) and others(simhash.one_of_each(clashing)) == (clashing.columns, True)
    assert others(packing.file_order(clashing, "order_"))[1] and packing.pack(clashing, TOKENIZER).count() == len(rows)


def test_pii_stays_native(spark, odd):
    plan = pii.detect(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(s) for s in zip(words, words[1:], words[2:])] if len(words) > 2 else [" ".join(words)] if words else []
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(fps, radius=3):
    ids, root = list(fps), {}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(ids)):
        for b in range(a):
            if (fps[ids[a]] ^ fps[ids[b]]).bit_count() <= radius:
                x, y = find(ids[a]), find(ids[b])
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_of_odd_documents(spark, odd, tmp_path):
    rng = random.Random(7)
    base = [rng.choice(WORDS["en"].split()) + str(rng.randint(0, 99)) for _ in range(300)]
    near = []
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(300)] = "changed"
        near.append(" ".join(words))
    docs = spark.createDataFrame([(100 + i, t) for i, t in enumerate(near)], "doc_id long, text string").unionByName(odd.select("doc_id", "text"))
    texts = {100 + i: t for i, t in enumerate(near)} | dict(enumerate(ODD))
    rows = queries.op9_simhash(spark, write(spark, tmp_path, docs)).collect()
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(fps)
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is not None:
            assert int(r["fingerprint"], 16) == fps[r["doc_id"]] and r["component_id"] == want[r["doc_id"]]
    assert len(set(want.values())) > 5 and max(Counter(want.values()).values()) > 5


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def labels(found):
    rows = [tuple(r) for r in found.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


@pytest.mark.parametrize(("split_at", "chunk_rows"), [(1, 8192), (10_000, 8192), (10_000, 3)])
@pytest.mark.parametrize("radius", [1, 3, 5])
def test_links_find_all_pairs(spark, split_at, chunk_rows, radius):
    rng = random.Random(radius)
    centre = [rng.getrandbits(64) for _ in range(12)]
    fps = {0: 0, 1: (1 << 64) - 1}
    for i in range(2, 600):
        v = rng.choice(centre) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        fps[i] = v
    fps = {i: v for v, i in {v: i for i, v in fps.items()}.items()}
    reps = spark.createDataFrame([(signed(v),) for v in fps.values()], "fp long")
    got = labels(simhash.components(simhash.links(reps, radius, split_at, chunk_rows)))
    own = {signed(v): i for i, v in fps.items()}
    least = {}
    for v, root in got.items():
        least[root] = min(least.get(root, own[v]), own[v])
    assert {i: least[got[v]] if v in got else i for v, i in own.items()} == plain_components(fps, radius)


def test_bit_planes_compare_every_shift():
    rng = np.random.default_rng(3)
    for n in (1, 2, 63, 64, 65, 300):
        fps = rng.integers(0, 8, n).astype(np.uint64) << np.uint64(40)
        keys = np.sort(rng.integers(0, 3, n))
        got = {(int(i), int(j)) for a, b in simhash.close_pairs(keys, fps, 1) for i, j in zip(a, b)}
        want = {(i, j) for j in range(n) for i in range(j) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= 1}
        assert got == want


@pytest.mark.parametrize("path", [lambda n: [*range(1, n), 0], lambda n: random.Random(4).sample(range(n), n)], ids=["far", "mixed"])
def test_components_of_paths_take_few_rounds(spark, monkeypatch, path):
    nodes, rounds = list(path(129)), []
    plain = simhash.Scratch.write
    monkeypatch.setattr(simhash.Scratch, "write", lambda self, df: rounds.append(1) or plain(self, df))
    edges = spark.createDataFrame([*zip(nodes, nodes[1:]), (1000, 900), (7000, 7000)], "node long, root long")
    got = labels(simhash.components(edges))
    assert set(got) == {*nodes, 900, 1000} and len({got[n] for n in nodes}) == 1 and got[900] == got[1000] != got[nodes[0]]
    assert len(rounds) <= 60


def test_components_of_a_star_take_one_round(spark, monkeypatch):
    monkeypatch.setattr("byteloom.llm.common.SPLIT_ROWS", 16)
    got = labels(simhash.components(spark.createDataFrame([(i, 500) for i in range(300)], "node long, root long")))
    assert set(got) == {*range(300), 500} and len(set(got.values())) == 1


def test_joins_split_hot_keys(spark, monkeypatch):
    monkeypatch.setattr("byteloom.llm.common.SPLIT_ROWS", 10)
    many = spark.createDataFrame([(i, 0 if i % 3 == 0 else i, "x") for i in range(300)], "_salt long, k long, _parts string")
    one = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = sorted(tuple(r) for r in common.join_split(many, one, "k", F.col("_salt"), "left").select("_salt", "k", "v", "_parts").collect())
    assert got == [(i, k, 2 * k if k < 200 else None, "x") for i in range(300) for k in [0 if i % 3 == 0 else i]]


def test_one_of_each_group(spark):
    text, other = "a b c d e f g h " * 20, "other words stand here " * 20
    rows = [(5, text, "p"), (3, text, "q"), (3, other, "q"), (None, text, "r"), (3, text, "q"), (None, "alone " * 30, "r"), (None, "alone " * 30, "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _low string").withColumn("kinds", F.create_map(F.lit("a"), F.lit(1)))
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["_low"]) for r in got.collect()) == [(0, "alone " * 30, "r"), (3, text, "q"), (3, other, "q")]


def test_simhash_of_nothing(none):
    assert simhash.near_duplicates(none).collect() == []


# Mixing


def test_period_meets_every_deadline_and_share():
    for weights in ({"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 97, "b": 2, "c": 1}, {f"s{i}": i + 1 for i in range(12)}):
        order, total = mixing.period(weights), sum(weights.values())
        assert Counter(order) == weights
        seen = Counter()
        for slot, s in enumerate(order, 1):
            seen[s] += 1
            for x, w in weights.items():
                assert abs(seen[x] - Fraction(slot * w, total)) < 1


def simulate(weights, blocks):
    """Earliest deadline first, slot by slot, with shares worked out anew when a source is used up."""
    left, slots = {s: n for s, n in blocks.items() if n}, []
    while left:
        total, t, done = sum(weights[s] for s in left), 0, dict.fromkeys(left, 0)
        while all(left.values()):
            due = [(mixing.window(done[s], Fraction(weights[s], total))[1], s) for s in left if mixing.window(done[s], Fraction(weights[s], total))[0] <= t]
            s = min(due)[1]
            slots.append(s)
            done[s] += 1
            left[s] -= 1
            t += 1
        left = {s: n for s, n in left.items() if n}
    return slots


def test_mixing_is_the_simulated_schedule(spark, odd):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a"] * 6 + ["b"] * 3 + ["c", "new", None]), f"t{i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {"a": 5, "b": 3, "c": 2, mixing.OTHER: 1}
    got = mixing.mix(docs, weights, block_rows=4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(700))
    pools = Counter(r["pool"] for r in got)
    want = simulate(weights, {s: -(-n // 4) for s, n in pools.items()})
    by_slot = {}
    for r in got:
        by_slot.setdefault(r["slot"], []).append(r)
    assert [by_slot[t][0]["pool"] for t in range(len(by_slot))] == want
    for rows_ in by_slot.values():
        assert len({(r["pool"], r["block"]) for r in rows_}) == 1 and sorted(r["place"] for r in rows_) == list(range(len(rows_)))
    digest = lambda r: hashlib.md5(str(r["doc_id"]).encode()).hexdigest()
    own = sorted((r for r in got if r["pool"] == "a"), key=lambda r: (r["block"], r["place"]))
    assert own == sorted(own, key=digest)


def test_mixing_of_odd_documents(spark, odd, none):
    got = mixing.interleave(mixing.mix(odd, {"s": 1})).collect()
    assert len(got) == len(ODD) + 2 and {r["pool"] for r in got} == {"s", mixing.OTHER}
    assert mixing.mix(none, {"s": 1}).collect() == []
    with pytest.raises(ValueError, match="positive"):
        mixing.mix(odd, {"s": 0})
    with pytest.raises(ValueError, match="sum up"):
        mixing.mix(odd, {"s": 1_000_003, "t": 2})
    assert mixing.mix(odd, {"s": 2_000_000, "t": 1_000_000, mixing.OTHER: 1_000_000}).count() == len(got)
