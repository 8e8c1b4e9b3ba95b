"""Bigram statistics as DataFrame operators: profiles, models trained from a corpus, similarities and ranks.

This is the long form: (id, bigram, weight) rows, joined to models on the bigram and summed. Bigrams are counted within
their row before anything is shuffled, so a profile has at most 65,536 rows whatever its text's length, and the join
side of the models is bounded by models x 65,536 rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from byteloom.functions import bytes as B
from byteloom.functions import patterns as P
from byteloom.operators import residual
from byteloom.operators.detect import share
from byteloom.tables import codepages
from byteloom.tables.models import CELLS, Models, bigrams, build


#: Models of a corpus that ``trained`` makes at most.
MOST_MODELS = 256


def bigram_counts(df: DataFrame, content: str = "content", keys: Iterable[str] = ("id",), limit: int | None = None, unique: bool = False) -> DataFrame:
    """(keys, bigram, n): how often each pair of adjacent bytes occurs, for each combination of keys.

    Counting within a row is numpy's; what is left to add up is summed before and after one shuffle. With ``unique``, keys
    tell rows apart, so nothing is left to add up or to shuffle.
    """
    names = list(keys)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in enumerate(batch.column(len(names))):
                pairs, n = np.unique(bigrams(value.as_py()), return_counts=True)
                at = pa.array(np.full(len(pairs), row))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[:-1]), pa.array(pairs.astype(np.int32)), pa.array(n.astype(np.int64))], [*names, "bigram", "n"])

    data = B.head(F.col(content), limit) if limit else F.col(content)
    rows = df.where(F.col(content).isNotNull()).select(*names, data.alias("_data"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    counted = rows.mapInArrow(run, f"{kinds}, bigram int, n long")
    return counted if unique else counted.groupBy(*names, "bigram").agg(F.sum("n").alias("n"))


def trained(df: DataFrame, content: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(key, bigram, w) models and (bigram, idf) of a corpus, counted once.

    The counts go through the driver: at most MOST_MODELS x 65,536 rows, whatever the corpus's size. More models are an error.
    """
    rows = df.where(F.col(key).isNotNull())
    models = rows.select(key).distinct().limit(MOST_MODELS + 1).count()
    if models > MOST_MODELS:
        raise ValueError(f"there are more than {MOST_MODELS} models to train")
    counts = df.sparkSession.createDataFrame(bigram_counts(rows, content, [key]).toArrow())
    idf = counts.groupBy("bigram").agg(F.log1p(F.lit(float(models)) / F.count(F.lit(1))).alias("idf"))
    return profiles(counts, idf, [key]), idf


def idf_table(counts: DataFrame, models: list[str]) -> DataFrame:
    """(bigram, idf) of the models that ``counts`` holds: ln(1 + models / models that have it)."""
    total = counts.select(*models).distinct().agg(F.count(F.lit(1))).scalar()
    having = counts.groupBy("bigram").agg(F.count(F.lit(1)).alias("having"))
    return having.select("bigram", F.log1p(total / F.col("having")).alias("idf"))


def profiles(counts: DataFrame, idf: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bigram, w): counts weighted by idf; pairs that no model has weigh nothing and are left out."""
    return counts.join(idf, "bigram").select(*keys, "bigram", (F.col("n") * F.col("idf")).alias("w"))


def norms(weighted: DataFrame, keys: list[str], weight: str = "w") -> DataFrame:
    return weighted.groupBy(*keys).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("norm"))


def cosines(profile: DataFrame, models: DataFrame, keys: list[str], model_keys: list[str]) -> DataFrame:
    """(keys, model_keys, score) of each pair that shares a bigram. ``models`` has (model_keys, bigram, w)."""
    dots = profile.join(models.withColumnRenamed("w", "mw"), "bigram").groupBy(*keys, *model_keys).agg(F.sum(F.col("w") * F.col("mw")).alias("dot"))
    scored = dots.join(norms(profile, keys), keys).join(norms(models, model_keys).withColumnRenamed("norm", "model_norm"), model_keys)
    return scored.select(*keys, *model_keys, (F.col("dot") / (F.col("norm") * F.col("model_norm"))).alias("score"))


def ranked(scores: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """Adds ``rank``, highest score first, ties in the order of the columns given."""
    return scores.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("score"), *ties)))


def within_band(scores: DataFrame, keys: list[str], ties: list[str], band: float) -> DataFrame:
    """The first-ranked row of each key, the second, and all within ``band`` of the first."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), *ties)
    top = F.first("score").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    out = scores.withColumn("rank", F.row_number().over(w)).withColumn("gap", top - F.col("score"))
    return out.where((F.col("rank") <= 2) | (F.col("gap") <= band))


def encoding_scores(df: DataFrame, content: str = "content", id_col: str = "id", models: Models | None = None) -> DataFrame:
    """(id, encoding, score, language): how well each encoding's best model fits the bytes, where any does."""
    shared = share(df.sparkSession, models)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        every = list(models.index)
        for batch in batches:
            for row, value in enumerate(batch.column(1)):
                found = residual.scored(value.as_py(), every, models)
                ids = batch.column(0).take(pa.array([row] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([f.encoding for f in found], pa.string()), pa.array([f.confidence for f in found], pa.float64()), pa.array([f.language for f in found], pa.string())], [id_col, "encoding", "score", "language"])

    return df.where(F.col(content).isNotNull()).select(id_col, content).mapInArrow(run, f"`{id_col}` {kind}, encoding string, score double, language string")


def train(corpus: DataFrame, lang: str = "lang", content: str = "content", encoding: str = "utf-8") -> Models:
    """Models of all languages in a corpus of bytes. The driver gets languages x 65,536 counts at most."""
    counts = bigram_counts(corpus.where(F.col(lang).isNotNull()), content, [lang]).toArrow()
    langs = sorted(set(counts[lang].to_pylist()))
    table = np.zeros((len(langs), CELLS), np.int64)
    row = np.array([langs.index(x) for x in counts[lang].to_pylist()], dtype=np.int64)
    np.add.at(table, (row, counts["bigram"].to_numpy()), counts["n"].to_numpy())
    return build([(x, encoding) for x in langs], table)


def category_votes(df: DataFrame, a: str, b: str, content: str = "content"):
    """Adds votes_a, votes_b and winner: which of two code pages makes likelier characters of the bytes present."""
    differ = codepages.confusable().get(frozenset((a, b)), codepages.differing(a, b))
    votes_a, votes_b = F.lit(0), F.lit(0)
    text = B.latin1(F.col(content))
    for value in sorted(differ):
        pa_, pb = (codepages.CATEGORY_PREFERENCE.get(codepages.category(e, value), 0) for e in (a, b))
        here = F.contains(text, F.lit(chr(value)))
        if pa_ > pb:
            votes_a = votes_a + F.when(here, pa_ - pb).otherwise(0)
        elif pb > pa_:
            votes_b = votes_b + F.when(here, pb - pa_).otherwise(0)
    out = df.withColumn("votes_a", votes_a).withColumn("votes_b", votes_b)
    return out.withColumn("winner", F.when(F.col("votes_a") > F.col("votes_b"), a).when(F.col("votes_b") > F.col("votes_a"), b))


def valid_candidates(df: DataFrame, content: str = "content", output: str = "valid_candidates") -> DataFrame:
    """Adds the single-byte encodings all of whose bytes are defined, in rank order.

    Text is walked once, for the bytes that occur; each code page then looks at those few alone.
    """
    lacking = {name: codepages.undefined(name) for name in codepages.single_byte()}
    seen = "__seen" if output != "__seen" else "__bytes"
    checks = [F.when(~F.col(seen).rlike(B.byte_class(values)), F.lit(name)) if values else F.when(F.col(content).isNotNull(), F.lit(name)) for name, values in lacking.items()]
    return df.withColumn(seen, B.distinct(F.col(content))).withColumn(output, F.array_compact(F.array(*checks))).drop(seen)


def gated(df: DataFrame, content: str = "content") -> DataFrame:
    """Adds a struct for each multi-byte encoding with an analyser: its pair ratio, coverage, lead diversity and gate."""
    data = F.col(content)
    wide = df.withColumn("_high", B.non_ascii(data)).withColumn("_text", B.condensed(data))
    wide = wide.select("*", *[B.structure(F.col("_text"), e).alias(f"_{e}") for e in P.SEQUENCES if e != "big5"])
    for e in P.SEQUENCES:
        if e != "big5":
            s, high = F.col(f"_{e}"), F.col("_high")
            wide = wide.withColumn(e, F.struct(B.pair_ratio(s).alias("ratio"), B.coverage(s, high).alias("coverage"), s["lead_diversity"].alias("lead_diversity"), B.cjk_gate(s, high).alias("kept")))
    return wide.drop("_high", "_text", *[f"_{e}" for e in P.SEQUENCES if e != "big5"])
