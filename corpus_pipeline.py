"""The corpus pipeline: language ID, near-duplicate removal, PII redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, with the columns of ``documents``.
``run`` writes each stage's rows as Parquet in the folder that all executors share, and the next stage reads them.

Nulls and edge cases: a null text goes in the first stage, as no language is found in it, as does a text without letters;
if no row has a language to learn from, all texts with letters stay. Rows are told apart by what they hold, not by their
ids: a row without id is a document like any other, and of two texts under one id each is judged for itself. Further
columns are passed on until packing, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from byteloom.llm import langid, mixing, packing, pii, simhash
from byteloom.llm.common import delete, fresh, shared_folder
from byteloom.llm.queries import SOURCE_WEIGHTS, TOKENIZER

#: A document stays if its language is told with at least this probability.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found."""
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "lang_pred", "score")
    found = langid.classify(docs, model, output=(lang, score))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each SimHash group."""
    return simhash.one_of_each(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by labels; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all documents into the order of the mix; the files written hold it."""
    kept, added = docs, {}
    for name in mixing.ADDED:  # the mix would replace columns of these names
        if name in docs.columns:
            added[name] = fresh(kept, f"_{name}")[0]
            kept = kept.withColumnRenamed(name, added[name])
    mixed = mixing.interleave(mixing.mix(kept, SOURCE_WEIGHTS)).drop(*mixing.ADDED)
    return mixed.withColumnsRenamed({new: old for old, new in added.items()}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs in the order of the files, which is that of the mix."""
    at = fresh(docs, "_at")[0]
    return packing.pack_in_order(packing.file_order(docs, at), public_tokenizers.path(TOKENIZER), at)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", redact_pii),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack),
]

#: SQL has no XXH64, tokenizer or classifier to express the stages with.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}_{name}")
            docs = spark.read.parquet(f"{folder}/{k}_{name}")
            if k:  # what that stage has read is no longer needed
                delete(spark, f"{folder}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
