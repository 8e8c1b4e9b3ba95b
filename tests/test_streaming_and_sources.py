from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from byteloom.cli import main
from byteloom.operators import names
from byteloom.operators.detect import detect
from byteloom.operators.options import DetectOptions
from byteloom.sources import files
from byteloom.sources import models as model_files
from byteloom.streaming.chunks import assembled, detect_chunks, detect_stream, split
from byteloom.tables.models import pack, standard


@pytest.mark.parametrize("size", [1, 64, 100_000])
def test_chunk_sizes_make_no_difference(spark, size):
    texts = [b"", b"plain text", "déjà vu".encode() * 20, b"\xff\xfea\x00b\x00", b"%PDF-1.4"]
    df = spark.createDataFrame([(i, bytearray(t)) for i, t in enumerate(texts)], "id int, content binary")
    whole = {r["id"]: r["detected"] for r in detect(df).collect()}
    parts = {r["id"]: r["detected"] for r in detect_chunks(split(df, size, "id"), "id").collect()}
    assert parts == whole


def test_assembly_is_capped_and_ordered(spark):
    rows = [(1, 2, bytearray(b"cc")), (1, 0, bytearray(b"aa")), (1, 1, bytearray(b"bb")), (2, 0, None)]
    chunks = spark.createDataFrame(rows, "stream_id int, seq int, chunk binary")
    got = {r[0]: bytes(r[1]) for r in assembled(chunks, max_bytes=5).collect()}
    assert got == {1: b"aabbc", 2: b""}


def test_stream_lifecycle(spark, tmp_path):
    schema = "stream_id string, seq long, chunk binary, event string"
    batches = [
        [("a", 1, bytearray("é".encode()), "feed"), ("b", 0, bytearray(b"plain"), None)],
        [("a", 0, bytearray(b"caf"), "feed"), ("b", 1, None, "close"), ("c", 0, bytearray(b"x" * 50), "feed"), ("c", 1, None, "close")],
        [("a", 2, None, "close"), ("b", 2, bytearray(b"late"), "feed"), ("c", 2, None, "reset"), ("c", 3, bytearray(b"%PDF-"), "feed"), ("c", 4, None, "close")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = detect_stream(source, event="event", options=DetectOptions(max_bytes=20))
    query = found.writeStream.format("memory").queryName("closed_streams").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.table("closed_streams").collect()
    good = {(r["stream_id"], r["encoding"], r["mime_type"], r["n_bytes"]) for r in rows if r["error"] is None}
    assert good == {("a", "utf-8", "text/plain", 5), ("b", "ascii", "text/plain", 5), ("c", "ascii", "text/plain", 20), ("c", None, "application/pdf", 5)}
    assert [(r["stream_id"], r["error"]) for r in rows if r["error"]] == [("b", "chunk fed after close")]


def test_files_corpus_and_report(spark, tmp_path):
    corpus = tmp_path / "corpus"
    for folder, name, data in (("utf-8-fr", "a.txt", "été à la mer".encode()), ("ascii-en", "b.txt", b"plain words"), ("None-None", "c.bin", b"\x89PNG\r\n\x1a\n")):
        (corpus / folder).mkdir(parents=True)
        (corpus / folder / name).write_bytes(data)
    labelled = files.read_corpus(spark, str(corpus))
    assert {(r[0], r[1]) for r in labelled.select("encoding", "language").collect()} == {("utf-8", "fr"), ("ascii", "en"), (None, None)}
    found = detect(labelled)
    summary = files.accuracy(found, "encoding", "detected.encoding").collect()
    assert {(r["expected"], r["is_total"]): (r["n"], r["n_correct"]) for r in summary}[(None, 1)] == (3, 3)
    files.write_report(found, str(tmp_path / "report"), minimal=True)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "report")).collect()) == ["None", "ascii", "utf-8"]
    ranks = spark.createDataFrame([(float(x),) for x in range(10)], "v double")
    assert tuple(files.nearest_percentiles(ranks, "v", [0.5, 0.9, 1.0]).first()) == (5.0, 9.0, 9.0)


def test_files_are_cut_and_missing_ones_pass(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(b"x" * 1000)
    assert files.read_files(spark, str(tmp_path / "big.txt"), max_bytes=10).select(F.octet_length("content"), "length").first()[:] == (10, 1000)
    out, err = [], []
    assert main([str(tmp_path / "none.txt"), str(tmp_path / "big.txt")], spark=spark, write=out.append, write_error=err.append) == 0
    assert out == [f"{tmp_path / 'big.txt'}: ascii with confidence 1.0\n"] and len(err) == 1
    assert main([str(tmp_path / "none.txt")], spark=spark, write=out.append, write_error=err.append) == 1


def test_heads_of_files(spark, tmp_path):
    for name, size in (("a b.txt", 5), ("b.txt", 1000), ("c.bin", 3)):
        (tmp_path / name).write_bytes(b"x" * size)
    rows = files.read_heads(spark, str(tmp_path), max_bytes=10, glob="*.txt").collect()
    assert sorted((r["length"], bytes(r["content"])) for r in rows) == [(5, b"x" * 5), (1000, b"x" * 10)]
    assert rows[0]["path"] in {r["path"] for r in files.read_files(spark, str(tmp_path)).collect()}


def test_streams_that_wait_for_too_much_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("byteloom.streaming.chunks.EARLY_CHUNKS", 3)
    schema = "stream_id string, seq long, chunk binary"
    rows = [("a", k, bytearray(b"x")) for k in range(1, 6)] + [("b", k, bytearray(b"x")) for k in (2, 1, 3)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    found = detect_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = found.writeStream.format("memory").queryName("waiting_streams").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert [(r["stream_id"], r["error"]) for r in spark.table("waiting_streams").collect()] == [("a", "more than 3 chunks wait for chunk 0")]


def test_small_tables_are_spread(spark):
    assert files.spread_small(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 4


def test_cli_reads_standard_input(spark):
    out = []
    assert main(["-l", "-e", "unknown"], stdin=b"the best of times was the time of that friend", spark=spark, write=out.append) == 0
    assert out == ["stdin: ascii en (English) with confidence 1.0\n"]
    out.clear()
    main(["--minimal"], stdin="été".encode(), spark=spark, write=out.append)
    assert out == ["utf-8\n"]


def test_model_files(spark, tmp_path):
    models = standard()
    (tmp_path / "packed").write_bytes(pack(models))
    assert model_files.read_packed(spark, str(tmp_path / "packed")).keys == models.keys
    few = type(models)(models.keys[:2], models.weights[:2], models.norms[:2], models.idf)
    model_files.write_table(spark, few, str(tmp_path / "table"))
    back = model_files.read_table(spark, str(tmp_path / "table"))
    assert back.keys == few.keys and (back.weights == few.weights).all()
    assert model_files.long_table(spark, few).count() == int((few.weights > 0).sum())


def test_report_lines(spark):
    row = spark.range(1).select(F.struct(F.lit("utf-8").alias("encoding"), F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("language"), F.lit("text/plain").alias("mime_type")).alias("r"))
    assert row.select(names.report(F.lit("f"), F.col("r"), language=True)).first()[0] == "f: utf-8 und (Undetermined) with confidence 0.5"
