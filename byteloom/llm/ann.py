"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash rotates a unit vector by fast Hadamard transforms with random signs (three rounds) and names the signed
axis that is nearest. Each of TABLES tables puts every vector in the bucket of its axis; a query probes the PROBES nearest
axes of each table, and all vectors found are ranked exactly, by inner product in double precision on the original
vectors. Vectors need not have unit length: the inner product is made an angle by one more component, which brings all
vectors to the largest length and is zero in queries.

With 2 * dimensions buckets a table, a query meets about TABLES * PROBES / (2 * dimensions) of the vectors at most, some
of them more than once. Buckets are dealt out as blocks of bounded size, to which a bucket's queries are copied; a
block sends each query's k + 1 best on, never its pairs. The nearest axis of each table is probed first; the k + 1 best
found there are the least that the other probes need to report. A query that found fewer vectors than it may return is
searched among all vectors, block by block. Queries too meet a block in parts of bounded number.

Nulls and edge cases: see ``vectors.prepared``; ties go to smaller ids; an empty table, or one without queries, gives no
rows. Only the id and vector columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from byteloom.llm.common import checkpoint
from byteloom.llm.vectors import QUERY_ROWS, classes, merge, pack_vectors, prepared, query_classes

TABLES, PROBES, ROUNDS, SEED = 4, 32, 3, 11
QUERY_EVERY, K = 20, 20
#: Vectors in one block of a bucket; near copies fill one bucket, so blocks are small.
BLOCK_ROWS = 512


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, of a power of two components."""
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), -1, 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def rotated(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-rotation of rows, padded to a power of two."""
    n = 1 << max(1, (x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), n))
    out[:, : x.shape[1]] = x
    signs = np.random.default_rng([SEED, table]).choice([-1.0, 1.0], (ROUNDS, n))
    for s in signs:
        out = hadamard(out * s)
    return out


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The nearest signed axes of each row, nearest first: a for +axis a, n + a for -axis a."""
    turned = rotated(x, table)
    both = np.concatenate([turned, -turned], axis=1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def lifted(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Vectors with the component that makes all of them equally long; queries (None) are scaled to length one."""
    size = np.linalg.norm(x, axis=1)
    if longest is None:
        return np.concatenate([x / size[:, None], np.zeros((len(x), 1))], axis=1)
    extra = np.sqrt(np.maximum(longest**2 - size**2, 0))
    # Lengths that differ by rounding alone need no further component.
    extra[extra < 1e-3 * longest] = 0
    return np.concatenate([x, extra[:, None]], axis=1) / longest


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products summed in one order, so that equal pairs give equal scores wherever they stand."""
    return np.einsum("ij,ij->i", q, x)


def _decode(column, dim: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(np.float64)


def _same_length(size_min: float, size_max: float) -> bool:
    return size_min >= size_max * (1 - 1e-6)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, k: int = K, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id is divisible by ``every``."""
    # Single-precision components stay so while they are moved; all arithmetic is in double precision.
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows, dim, _ = prepared(vectors, id_col, vector_col, nonzero=True)
    packed = checkpoint(pack_vectors(rows, dim, lambda x: x, kind))
    index = checkpoint(classes(packed, k))
    queries, asked = query_classes(packed, every)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    norms = rows.select(F.sqrt(F.min(square)), F.sqrt(F.max(square))).first()
    longest = norms[1] or 1.0
    flat = norms[0] is None or _same_length(norms[0], longest)  # all equally long: no further component
    sides = 2 * (1 << max(1, (dim - flat).bit_length()))
    total, parts = index.count(), max(1, -(-queries.count() // QUERY_ROWS))

    def hashing(first: int, last: int, of_queries: bool):
        """Rows for the axes of each table from the ``first`` nearest up to the ``last``."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _decode(batch.column(batch.num_columns - 1), dim, kind)
                x = x / np.linalg.norm(x, axis=1, keepdims=True) if flat else lifted(x, None if of_queries else longest)
                for t in range(tables):
                    near = axes(x, t, last)[:, first:]
                    times = near.shape[1]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), times))
                    bucket = pa.array((near.ravel() + t * sides).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([bucket, *(c.take(at) for c in batch.columns)], ["bucket", *batch.schema.names])

        return run

    stored = index.select("node", "first", "v").mapInArrow(hashing(0, 1, False), "bucket int, node long, first long, v binary")
    # tables x sides counts, whatever the number of rows.
    sizes = F.broadcast(stored.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("long").alias("blocks")))
    stored = stored.join(sizes, "bucket")

    def probing(some: DataFrame, start: int, stop: int) -> DataFrame:
        """What the axes from ``start`` up to ``stop`` of each table lead to. ``some`` has (node, reached, v)."""
        schema = "bucket int, node long, reached double, v binary"
        probed = some.select("node", "reached", "v").mapInArrow(hashing(start, stop, True), schema)
        return scored(stored, probed.join(sizes, "bucket"), dim, k, kind, parts)

    # What a query is sure to reach after its first probes spares it all that is less near.
    nothing = F.lit(float("-inf"))
    partial = checkpoint(probing(queries.withColumn("reached", nothing), 0, 1))
    if min(probes, sides) > 1:
        best_first = W.partitionBy("node").orderBy(F.desc("score"), "found")
        distinct = partial.groupBy("node", "found").agg(F.max("score").alias("score")).withColumn("nth", F.row_number().over(best_first))
        tops = distinct.where(F.col("nth") <= k + 1).where(F.col("nth") == k + 1).select("node", F.col("score").alias("least"))
        reached = queries.join(tops, "node", "left").select("node", "v", F.coalesce("least", nothing).alias("reached"))
        partial = checkpoint(partial.unionByName(probing(reached, 1, min(probes, sides))))

    enough = partial.groupBy("node").agg(F.count_distinct("found").alias("n"))
    short = queries.join(enough, "node", "left").where(F.coalesce("n", F.lit(0)) < min(k + 1, total)).select("node", "v")
    if not short.isEmpty():
        blocks = F.lit(max(1, -(-total // BLOCK_ROWS))).cast("long").alias("blocks")
        everything = index.select(F.lit(0).alias("bucket"), *[F.col(c).alias(c) for c in ("node", "first", "v")], blocks)
        rest = scored(everything, short.select(F.lit(0).alias("bucket"), "node", nothing.alias("reached"), "v", blocks), dim, k, kind, parts)
        partial = partial.unionByName(rest)
    return merge(partial, asked, index, k, "double")


def scored(stored: DataFrame, probed: DataFrame, dim: int, k: int, kind: str, parts: int) -> DataFrame:
    """(node, found, first, score): the k + 1 best of each bucket's blocks for each query that probes the bucket.

    Both sides have bucket, node, v and the bucket's number of blocks; vectors have their class's first id, queries the
    score that they need at least. A block meets the queries in as many parts as ``parts``, by node.
    """

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, firsts, x = left["node"].to_numpy(), left["first"].to_numpy(), _decode(left["v"], dim, kind)
        who, q, reached = right["node"].to_numpy(), _decode(right["v"], dim, kind), right["reached"].to_numpy()
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(who) if len(ids) else 0, 256):
            rough = q[at : at + 256] @ x.T
            slack = 1e-12 * dim * (1 + np.abs(rough).max())
            least = reached[at : at + 256] - slack
            if len(ids) > k + 1:
                least = np.maximum(least, np.partition(rough, len(ids) - k - 1, axis=1)[:, len(ids) - k - 1] - slack)
            some, near = np.nonzero(rough >= least[:, None])
            exact = products(q[at + some], x[near])
            order = np.lexsort((ids[near], firsts[near], -exact, some))
            some, near, exact = some[order], near[order], exact[order]
            starts = np.flatnonzero(np.append(True, some[1:] != some[:-1])) if len(some) else np.zeros(0, np.int64)
            place = np.arange(len(some)) - np.repeat(starts, np.diff(np.append(starts, len(some))))
            kept = place <= k
            out.append((who[at + some[kept]], ids[near[kept]], firsts[near[kept]], exact[kept]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [*[np.zeros(0, np.int64)] * 3, np.zeros(0)]
        return pa.table(dict(zip(("node", "found", "first", "score"), columns)))

    keys, part = ["bucket", "block", "part"], F.pmod(F.xxhash64("node", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    spread = stored.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    copied = probed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    left = spread.select("bucket", "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "node", "first", "v").groupBy(*keys)
    right = copied.select("bucket", "block", part, "node", "reached", "v").groupBy(*keys)
    return left.cogroup(right).applyInArrow(rank, "node long, found long, first long, score double")
