"""Model tables and packed model files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from byteloom.tables import models as M


def write_table(spark: SparkSession, models: M.Models, path: str) -> None:
    """(ordinal, lang, enc, norm, cells) rows in Parquet, a row for each model."""
    rows = [(k, lang, enc, float(norm), bytearray(cells.tobytes())) for k, ((lang, enc), norm, cells) in enumerate(zip(models.keys, models.norms, models.weights))]
    spark.createDataFrame(rows, "ordinal int, lang string, enc string, norm double, cells binary").coalesce(1).write.parquet(path)


def read_table(spark: SparkSession, path: str) -> M.Models:
    """Bounded by the number of models, as models are."""
    rows = spark.read.parquet(path).orderBy("ordinal").collect()
    cells = np.array([np.frombuffer(bytes(r["cells"]), np.uint8) for r in rows]).reshape(len(rows), -1)
    return M.Models(tuple((r["lang"], r["enc"]) for r in rows), cells, np.array([r["norm"] for r in rows]), M.document_frequency(cells))


def read_packed(spark: SparkSession, path: str) -> M.Models:
    """One packed model file, read through Spark so that it may lie in any store."""
    return M.unpack(bytes(spark.read.format("binaryFile").load(path).first()["content"]))


def long_table(spark: SparkSession, models: M.Models) -> DataFrame:
    """(lang, enc, bigram, w): one row for each cell above zero."""
    rows = []
    for (lang, enc), cells in zip(models.keys, models.weights):
        rows += [(lang, enc, int(b), float(cells[b])) for b in np.flatnonzero(cells)]
    return spark.createDataFrame(rows, "lang string, enc string, bigram int, w double")
