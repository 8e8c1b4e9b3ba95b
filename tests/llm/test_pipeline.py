"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_text_operators import CLASHES, base_spans, check_packed, plain_components, plain_fingerprint, prose, token_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        text = prose(lang := rng.choice(["en", "fr", "de"]), rng, 150)
        rows.append((i, text, lang, f"src{rng.choice([0, 0, 0, 1, 2])}"))
    for i in range(150, 170):
        rows.append((i, rows[i - 150][1], rows[i - 150][2], "src3"))
    rows += [(170, None, "en", "src0"), (171, "123 456 !!", "en", None), (172, "the and of to " * 40 + "write to a@b.com or 1.2.3.4", "en", "else"), (None, prose("en", rng, 150), "en", "src1")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_in_turn(spark, docs, tmp_path):
    kept = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r["text"] for r in out.collect()} if name != "best_fit_packing" else None
        if after is not None:
            assert out.columns == COLUMNS
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if i not in (170, 171)}
        elif name == "simhash_near_dedup":
            groups = plain_components({10_000 if i is None else i: plain_fingerprint(t) for i, t in before.items()})
            assert set(after) == {i if i < 10_000 else None for i, c in groups.items() if i == c}
            assert all(after[i] == before[i] for i in after) and not any(150 <= (i or 0) < 170 for i in after)
        elif name == "pii":
            assert set(after) == set(before)
            assert not any(base_spans(t) for t in after.values()) and after[172].endswith("write to [EMAIL] or [IP]")
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "source_mixing":
            assert after == before and out.count() == len(before)
        else:
            rows = out.collect()
            assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == token_pieces(before.items())
            assert check_packed(rows) == -(-sum(r["length"] for r in rows) // 2048)
        kept = out


def test_run_is_the_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 100


def test_empty_documents(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_rows_keep_one(spark, docs):
    one = docs.where("doc_id = 3")
    assert corpus_pipeline.drop_near_duplicates(spark, one.unionByName(one), "").count() == 1


def test_two_texts_under_one_id_both_stay(spark, docs):
    rng = random.Random(16)
    texts = [prose("en", rng, 150) for _ in range(3)]
    rows = [(7, texts[0]), (7, texts[1]), (8, texts[0]), (None, texts[2]), (None, texts[2]), (None, texts[1])]
    given = spark.createDataFrame([(*r, "en", "src0", 1) for r in rows], docs.schema)
    got = sorted((r["doc_id"] or 0, r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, given, "").collect())
    assert got == sorted([(7, texts[0]), (7, texts[1]), (0, texts[2])])


def test_without_languages_texts_with_letters_stay(spark, docs):
    given = docs.withColumn("lang", F.lit(None).cast("string"))
    got = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, given, "").collect()}
    assert got == {r["doc_id"] for r in docs.collect()} - {170, 171}


def test_columns_of_any_name_go_through(spark, docs, tmp_path):
    for name in CLASHES:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    assert all(r[c] == f"{c}{r['doc_id']}" for r in docs.where("doc_id is not null").collect() for c in CLASHES)
    assert corpus_pipeline.pack(spark, docs, "").count() >= docs.count()


def test_packing_follows_the_mix(spark, tmp_path):
    rng = random.Random(12)
    names = list(corpus_pipeline.SOURCE_WEIGHTS)
    rows = [(i, "word " * rng.randint(1, 300), "en", names[0] if i % 3 else rng.choice(names[1:]), 5) for i in range(4000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    corpus_pipeline.mix_sources(spark, spark.read.parquet(f"{tmp_path}/docs"), "").write.parquet(f"{tmp_path}/mixed")
    packed = corpus_pipeline.pack(spark, spark.read.parquet(f"{tmp_path}/mixed"), "").collect()
    assert len({r["doc_id"] for r in packed}) == 4000
    check_packed(packed)
    place = {r["doc_id"]: (r["slot"], r["place"]) for r in corpus_pipeline.mixing.mix(spark.read.parquet(f"{tmp_path}/docs"), corpus_pipeline.SOURCE_WEIGHTS).collect()}
    window = {doc: k // corpus_pipeline.packing.WINDOW_ROWS for k, doc in enumerate(sorted(place, key=place.get))}
    found = [window[r["doc_id"]] for r in sorted(packed, key=lambda r: r["sequence_id"])]
    assert found == sorted(found) and len(set(found)) == 4
