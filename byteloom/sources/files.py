"""Files and corpora as sources of bytes, reports as sinks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.functions import bytes as B
from byteloom.operators import names
from byteloom.operators.options import MAX_BYTES


#: Bytes of a table for each core below which it is dealt out anew: so small a table may be one row group, and one task.
SMALL = 64 << 20


def spread_small(df: DataFrame) -> DataFrame:
    """Deals a small table out over all cores, for work that is heavy for its size; larger ones stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * SMALL else df


def read_files(spark: SparkSession, path: str | list[str], max_bytes: int = MAX_BYTES, glob: str | None = None, recursive: bool = False, ignore_errors: bool = True) -> DataFrame:
    """(path, length, content): files, each cut to ``max_bytes``. Files that can't be read are left out, unless told."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("ignoreCorruptFiles", str(ignore_errors).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", B.head(F.col("content"), max_bytes).alias("content"))


def read_heads(spark: SparkSession, path: str | list[str], max_bytes: int = MAX_BYTES, glob: str | None = None, recursive: bool = False, ignore_errors: bool = True) -> DataFrame:
    """As ``read_files``, but only the first ``max_bytes`` of a file are read, whatever its size.

    Spark lists the files; workers open them through Arrow, so it takes a file system that Arrow knows (local, HDFS, S3, ...).
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    system, place = pa.fs.FileSystem.from_uri(quote(re.sub(r"^file:/(?!/)", "file:///", name), safe=":/@"))
                    with system.open_input_file(place) as file:
                        head = file.read(max_bytes)
                except OSError:
                    if ignore_errors:
                        continue
                    raise
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([length], pa.int64()), pa.array([head], pa.binary())], ["path", "length", "content"])

    return reader.load(path).select("path", "length").mapInArrow(run, "path string, length long, content binary")


def read_stream(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """As ``read_files``, for files as they arrive."""
    return spark.readStream.format("binaryFile").load(path).select("path", "length", B.head(F.col("content"), max_bytes).alias("content"))


def read_corpus(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A labelled corpus: files in folders named {encoding}-{language}, where ``None`` stands for no encoding or language."""
    files = read_files(spark, path, max_bytes, recursive=True)
    folder = r"([^/]+)-([^/-]+)/[^/]+$"
    label = lambda k: F.nullif(F.regexp_extract("path", folder, k), F.lit("None"))
    return files.select(label(1).alias("encoding"), label(2).alias("language"), "path", "content").where(F.col("path").rlike(folder))


def write_report(results: DataFrame, path: str, label: str = "path", result: str = "detected", minimal: bool = False, language: bool = False) -> None:
    """One line of text for each result."""
    results.select(names.report(F.col(label), F.col(result), minimal, language).alias("value")).write.text(path)


def accuracy(results: DataFrame, expected: str, detected: str) -> DataFrame:
    """(expected, n, n_correct) for each expected encoding, with a row of null and ``is_total`` for all."""
    judged = results.select(F.col(expected).alias("expected"), names.is_correct(F.col(expected), F.col(detected)).cast("long").alias("_ok"))
    return judged.rollup("expected").agg(F.grouping("expected").cast("int").alias("is_total"), F.count(F.lit(1)).alias("n"), F.sum("_ok").alias("n_correct"))


def nearest_percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """Percentiles as the sample at floor(share x n), without interpolation. One row; n is counted first."""
    known = df.where(F.col(column).isNotNull())
    n = known.count()
    # The value whose cumulative share first reaches the middle of the sample wanted is that sample.
    middle = [(min(int(s * n), n - 1) + 0.5) / n if n else 0.5 for s in shares]
    picks = [F.expr(f"percentile_disc({m}) WITHIN GROUP (ORDER BY `{column}`)").alias(f"p{round(s * 100)}") for s, m in zip(shares, middle)]
    return known.agg(*picks)
