"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's features are hashed character 1- to 3-grams (case, marks and symbols included), damped and weighted by inverse
document frequency, and the share of its words that repeat the word before. A bounded sample of labelled texts gives
the latent space (a truncated singular value decomposition) and its labelled unit vectors; both are broadcast. Every text is projected, its cosines with all labelled
vectors are computed exactly in blocks, and its K nearest vote, each with its similarity as weight.

The sample takes up to PER_CLASS texts of each label, those with the smallest hash of their id; votes are weighted
back by the share of each label that was sampled, so scores follow the labels' real frequency.

Nulls and edge cases: an empty or null text has no vector, and its score is the share of label 1; so has every text
if nothing was labelled (then 0). Null labels, and labels other than 0 and 1, aren't learned from. Equal similarities
are broken by sample order (hash of the id). An id labelled twice is learned twice. Repeated rows score alike; an
empty table gives no rows. ``score_texts`` passes on the columns asked for and replaces any named ``score``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from byteloom.llm.common import batch_input
from byteloom.llm.ngrams import blocks, hashed

BITS, ORDERS = 12, (1, 2, 3)
PER_CLASS, DIMENSIONS, K = 2000, 48, 25
#: Weight of the share of repeated words beside the n-grams' unit vector.
REPEATS = 2.0
_ROWS_AT_ONCE = 256


@dataclass
class Model:
    idf: np.ndarray  # (2**BITS + 1,)
    axes: np.ndarray  # (2**BITS + 1, dimensions)
    vectors: np.ndarray  # (sample, dimensions), unit length
    labels: np.ndarray  # (sample,), 0 or 1
    weights: np.ndarray  # (sample,), rows that each one stands for
    prior: float


def features(texts: list[str | None]) -> np.ndarray:
    """(texts, 2**BITS + 1): counts of hashed n-grams, then words that repeat the word before, in parts per 10,000."""
    size = 1 << BITS
    out = np.zeros((len(texts), size + 1), np.float32)
    for k, text in enumerate(texts):
        words = text.split() if text else []
        if len(words) > 1:
            out[k, size] = round(10_000 * sum(map(eq, words, islice(words, 1, None))) / (len(words) - 1))
    overlap, seen = max(ORDERS) - 1, -1
    for points, starts, owners in blocks([t or "" for t in texts], overlap):
        inner = owners == seen
        inner[1:] |= owners[1:] == owners[:-1]
        seen = owners[-1]
        low = owners[0]
        row = np.repeat((owners - low).astype(np.int64), np.diff(np.append(starts, len(points)))) * (size + 1)
        height = int(owners[-1] - low + 1)
        for n in ORDERS:
            bucket = hashed(points, starts, n, overlap, inner, BITS)
            counts = np.bincount(row + bucket, minlength=height * (size + 1)).reshape(height, size + 1)
            out[low : low + height, :size] += counts[:, :size]
    return out


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    x[:, -1] = 0
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    np.divide(x, norm, out=x, where=norm > 0)
    x[:, -1] = REPEATS * np.sqrt(counts[:, -1] / 10_000)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


def _axes(x: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors, by subspace iteration from a fixed start."""
    k = min(dimensions, *x.shape)
    basis = np.linalg.qr(x.T @ (x @ np.random.default_rng(7).standard_normal((x.shape[1], k)).astype(np.float32)))[0]
    for _ in range(6):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    return basis.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> Model:
    """Learns from the rows of ``labels`` (already limited to those that may be learned from).

    The driver gets the features of 2 * per_class texts at most, of bounded size whatever the texts' length.
    """
    size = (1 << BITS) + 1
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_label in (0, 1) and _id is not null")
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    hashed_id = known.withColumn("_order", F.xxhash64("_id"))
    chosen = None
    for label in (0, 1):
        part = hashed_id.where(F.col("_label") == label).orderBy("_order", "_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    # At most 2 * per_class rows are broadcast.
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(chosen), "_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(2).to_pylist()
            packed = []
            for at in range(0, len(rows), _ROWS_AT_ONCE):
                packed += [x.astype("<f4").tobytes() for x in features(rows[at : at + _ROWS_AT_ONCE])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["order", "label", "features"])

    # Repeated ids are cut off at the bound too, in the sample's own order.
    got = texts.select("_order", "_label", "_text").mapInArrow(run, "order long, label int, features binary").orderBy("order", "label", F.xxhash64("features")).limit(2 * per_class).toArrow()
    label = got["label"].to_numpy().astype(np.int64)
    counts = np.frombuffer(b"".join(got["features"].to_pylist()), "<f4").reshape(len(label), size)
    rows = totals.get(0, 0) + totals.get(1, 0)
    prior = totals.get(1, 0) / rows if rows else 0.0
    if not len(label):
        return Model(np.zeros(size, np.float32), np.zeros((size, 1), np.float32), np.zeros((0, 1), np.float32), label, np.zeros(0), prior)
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = _weigh(counts, idf)
    axes = _axes(x, DIMENSIONS)
    sampled = np.bincount(label, minlength=2)
    weights = np.array([totals.get(c, 0) / max(1, sampled[c]) for c in (0, 1)])[label]
    return Model(idf, axes, _unit(x @ axes), label, weights, prior)


def score(model: Model, texts: list[str | None], k: int = K) -> np.ndarray:
    """The similarity-weighted share of label 1 among each text's nearest labelled vectors."""
    out = np.full(len(texts), model.prior)
    if not len(model.vectors):
        return out
    k = min(k, len(model.vectors))
    for at in range(0, len(texts), _ROWS_AT_ONCE):
        unit = _unit(_weigh(features(texts[at : at + _ROWS_AT_ONCE]), model.idf) @ model.axes)
        cosine = unit @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) * model.weights[near]
        total, ones = vote.sum(axis=1), (vote * model.labels[near]).sum(axis=1)
        some = (total > 0) & (np.abs(unit).max(axis=1) > 0)
        out[at : at + len(unit)][some] = ones[some] / total[some]
    return out


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``score`` to the columns kept. The model's size is bounded by the sample and 2**BITS."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    rows, at = batch_input(docs, names, text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = score(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(values, pa.float64())], [*names, "score"])

    schema = StructType([*docs.select(*names).schema, StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)
