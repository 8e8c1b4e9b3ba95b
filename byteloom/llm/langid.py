"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters and spaces; n-grams of 1 to 3 of those are hashed into 2**BITS buckets. Training counts
all n-grams of all labelled texts, summed by (language, bucket) before and after one shuffle. The log-probability
matrix, of 2**BITS rows and a column for each language, is broadcast; a batch of texts is scored as a sparse matrix
(rows: texts, entries: the buckets of their n-grams) times that matrix.

Nulls and edge cases: a text that is null or has no letter is ``und`` with score 0, as is every text when nothing was
learned; ties go to the language that sorts first; rows with a null language aren't learned from; more than MOST_LANGS
languages are an error; repeated rows count each time; an empty table gives no rows. ``classify`` passes on the columns asked for (all, unless told) and
replaces any named ``lang_pred`` or ``score``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from byteloom.llm.common import batch_input
from byteloom.llm.ngrams import blocks, hashed, letters

BITS, ORDERS, ALPHA = 14, (1, 2, 3), 0.5
UNKNOWN = "und"
#: The driver holds a column of counts for each language, so there is an end to them.
MOST_LANGS = 1024
_LANGS_HELD = 32


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # (2**BITS + 1, languages); the last row, for no n-gram, is zero
    log_prior: np.ndarray


def _buckets(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(buckets, starts of segments, texts of segments), for each block and order."""
    overlap = max(ORDERS) - 1
    seen = -1
    for points, starts, owners in blocks(texts, overlap):
        plain = letters()[points]
        inner = owners == seen
        inner[1:] |= owners[1:] == owners[:-1]
        seen = owners[-1]
        for n in ORDERS:
            yield hashed(plain, starts, n, overlap, inner, BITS), starts, owners


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts every n-gram of every labelled text. The driver gets languages x (2**BITS + 1) rows at most."""
    size = 1 << BITS

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                own = np.flatnonzero(counts)
                bucket = np.where(own > size, -1, own)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(bucket, pa.int32()), pa.array(counts[own])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                counts = held.setdefault(lang, np.zeros(size + 2, np.int64))
                counts[size + 1] += len(texts)  # documents
                for buckets, _, _ in _buckets(texts):
                    counts[:size] += np.bincount(buckets, minlength=size + 1)[:size]
            if len(held) > _LANGS_HELD:
                yield from flush()
        yield from flush()

    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"there are more than {MOST_LANGS} languages to learn")
    totals = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    place = {x: k for k, x in enumerate(langs)}
    index = np.array([place[x] for x in totals["lang"].to_pylist()], dtype=np.int64)
    bucket, n = totals["bucket"].to_numpy().astype(np.int64), totals["n"].to_numpy().astype(np.float64)
    counts, texts = np.zeros((size, len(langs))), np.zeros(len(langs))
    docs = bucket < 0
    texts[index[docs]] = n[docs]
    counts[bucket[~docs], index[~docs]] = n[~docs]
    log_prob = np.zeros((size + 1, len(langs)))
    log_prob[:size] = np.log(counts + ALPHA) - np.log(counts.sum(axis=0) + ALPHA * size)
    return Model(langs, log_prob, np.log(texts / max(texts.sum(), 1)) if langs else texts)


def score(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text and its posterior probability."""
    known = [t if t and model.langs and any(map(str.isalpha, t)) else "" for t in texts]
    total = np.tile(model.log_prior, (len(texts), 1))
    for buckets, starts, owners in _buckets(known):
        np.add.at(total, owners, np.add.reduceat(model.log_prob[buckets], starts, axis=0))
    if not model.langs or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = total.argmax(axis=1)
    posterior = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    some = np.array([bool(t) for t in known])
    return [model.langs[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, posterior, 0.0)


def classify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, output: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Adds the language and score to the columns kept. The model's size is bounded by 2**BITS and the languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in output]
    rows, at = batch_input(docs, names, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, values = score(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(values, pa.float64())], [*names, *output])

    schema = StructType([*docs.select(*names).schema, StructField(output[0], StringType()), StructField(output[1], DoubleType())])
    return rows.mapInArrow(run, schema)
