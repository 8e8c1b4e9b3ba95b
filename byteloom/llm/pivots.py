"""Exact top-k search by inner product, with a pivot-distance index.

Vectors are whole numbers. Each belongs to the cell of its nearest pivot and is keyed by its distance r to it; a cell is
held in blocks sorted by r. For a query at distance d from a cell's pivot, the triangle inequality gives every vector x
of the cell |q - x| >= |d - r|, so

    q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + |x|^2 - (d - r)^2) / 2.

First each query searches the blocks of its own cell, which gives it a k-th best score that is reached for certain. Then
it goes to each other cell whose bound is not below that score. Within a block, annuli are expanded outwards from
r = d; the search stops when the bound of all that is left falls below the k-th best score. No candidate is left out
that could be returned, so results are exact; scores are sums of integer products. They are summed in double precision
where no sum can reach 2**53, else in 64-bit integers; components so large that a score might not fit those are an error.

Pivots are drawn by hash from the vectors (PIVOTS at most), so they, and the statistics of their cells, are bounded.

Nulls and edge cases: see ``vectors.prepared`` (zero vectors take part); ties go to smaller ids; an empty table, or one
without queries, gives no rows. Only the id and vector columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from byteloom.llm.common import checkpoint
from byteloom.llm.vectors import BLOCK_ROWS, QUERY_ROWS, classes, merge, pack_vectors, prepared, query_classes

PIVOTS, SCALE = 48, 64
QUERY_EVERY, K = 20, 20
#: Vectors of one annulus, which are scored together.
ANNULUS_ROWS = 64
#: Queries that are held against one annulus at once.
QUERIES_AT_ONCE = 4096
#: What rounding may do to a squared distance, relative to the squares it is made of.
SLACK = 1e-9


def quantized(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(scale * x)


def _decode(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, dim)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def bound(q2: np.ndarray, x2: np.ndarray, d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """No less than the inner product of a query and a vector of these squared lengths and pivot distances."""
    return (q2 + x2 - np.square(d - r)) / 2 + SLACK * (q2 + x2 + np.square(d) + np.square(r) + 1)


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = QUERY_EVERY, k: int = K, pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id is divisible by ``every``; components become floor(scale * x)."""
    spark = vectors.sparkSession
    rows, dim, largest = prepared(vectors, id_col, vector_col, nonzero=False)
    most = dim * (scale * largest + 1) ** 2
    if most >= 2**63:
        raise ValueError(f"components of up to {largest} may have scores beyond 64 bits")
    wide = most >= 2**53
    packed = checkpoint(pack_vectors(rows, dim, lambda x: quantized(x, scale), "<f8"))
    index = checkpoint(classes(packed, k))
    queries, asked = query_classes(packed, every)
    parts = max(1, -(-queries.count() // QUERY_ROWS))
    drawn = index.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(pivots).select("v").collect()
    centres = np.frombuffer(b"".join(bytes(r["v"]) for r in drawn), "<f8").reshape(-1, dim)
    shared = spark.sparkContext.broadcast(centres)

    def key(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _decode(batch.column(2), dim)
            far = distances(x, shared.value)
            cell = far.argmin(axis=1)
            added = [pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(x)), cell]), pa.array((x * x).sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*added, *batch.columns], ["cell", "r", "x2", "node", "first", "v"])

    keyed = index.select("node", "first", "v").mapInArrow(key, "cell int, r double, x2 double, node long, first long, v binary")
    # One row for each pivot.
    cells = keyed.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.max("x2").alias("x2"), F.count(F.lit(1)).alias("rows")).toArrow().to_pandas()
    low, high, x2 = (np.full(max(1, len(centres)), fill) for fill in (np.inf, -np.inf, -np.inf))
    low[cells["cell"]], high[cells["cell"]], x2[cells["cell"]] = cells["low"], cells["high"], cells["x2"]
    blocks = {int(c): int(-(-n // BLOCK_ROWS)) for c, n in zip(cells["cell"], cells["rows"])}
    stats = spark.sparkContext.broadcast((low, high, x2, blocks))

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, _, dealt = stats.value
        for batch in batches:
            # Node ids are mixed, so that blocks of a cell are even whatever the ids are.
            mixed = batch.column(3).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            of = np.array([dealt[c] for c in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((mixed % of).astype(np.int32)), *batch.columns[1:]], ["cell", "block", "r", "x2", "node", "first", "v"])

    def visits(own: bool):
        """The blocks to visit: those of the query's own cell, or of the other cells that may hold something."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, high, x2, dealt = stats.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _decode(batch.column(1), dim)
                far = distances(q, shared.value)
                nearest = far.argmin(axis=1)
                reached = batch.column(2).to_numpy()
                q2 = (q * q).sum(axis=1)[:, None]
                closest = np.clip(far, low, high)
                may = bound(q2, x2, far, closest) >= reached[:, None]
                may[:, ~np.isfinite(x2)] = False
                mine = np.zeros(may.shape, bool)
                mine[np.arange(len(q)), nearest] = True
                row, cell = np.nonzero(mine & np.isfinite(x2) if own else may & ~mine)
                times = np.array([dealt[int(c)] for c in cell], dtype=np.int64)
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(far[row, cell]), batch.column(2).take(take), batch.column(0).take(take), batch.column(1).take(take)], ["cell", "block", "d", "reached", "node", "v"])

        return run

    keys = ["cell", "block", "part"]
    held = keyed.mapInArrow(spread, "cell int, block int, r double, x2 double, node long, first long, v binary").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = "cell int, block int, d double, reached double, node long, v binary"

    def rank(left: pa.Table, right: pa.Table) -> pa.Table:
        columns = _expand(left, right, dim, k, wide) if left.num_rows and right.num_rows else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("node", "found", "first", "score"), columns)))

    def scan(asking: DataFrame) -> DataFrame:
        asking = asking.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int"))
        return held.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(rank, "node long, found long, first long, score long")

    nothing = F.lit(float("-inf"))
    first = checkpoint(scan(queries.select("node", "v", nothing.alias("reached")).mapInArrow(visits(True), schema)))
    # A query's k + 1 best so far: it may have to leave itself out.
    nth = F.row_number().over(W.partitionBy("node").orderBy(F.desc("score")))
    tops = first.select("node", "score", nth.alias("nth")).where(F.col("nth") <= k + 1).where(F.col("nth") == k + 1).select("node", F.col("score").cast("double").alias("least"))
    reached = queries.join(tops, "node", "left").select("node", "v", F.coalesce("least", nothing).alias("reached"))
    second = scan(reached.mapInArrow(visits(False), schema))
    return merge(first.unionByName(second), asked, index, k, "long")


def _expand(left: pa.Table, right: pa.Table, dim: int, k: int, wide: bool) -> tuple[np.ndarray, ...]:
    """Each query's best of one block: annuli outwards from r = d until nothing left can reach the k + 1 best.

    All queries take a step outwards at once; those that take the same annulus share one product of matrices.
    """
    r = left["r"].to_numpy()
    order = np.argsort(r, kind="stable")
    r, x2, ids, firsts, x = r[order], left["x2"].to_numpy()[order], left["node"].to_numpy()[order], left["first"].to_numpy()[order], _decode(left["v"], dim)[order]
    starts = np.arange(0, len(r), ANNULUS_ROWS)
    ends = np.append(starts[1:], len(r))
    inner, outer, longest = r[starts], r[ends - 1], np.maximum.reduceat(x2, starts)
    who, d, least, q = right["node"].to_numpy(), right["d"].to_numpy(), right["reached"].to_numpy().copy(), _decode(right["v"], dim)
    q2 = (q * q).sum(axis=1)
    bounds = bound(q2[:, None], longest[None, :], d[:, None], np.clip(d[:, None], inner[None, :], outer[None, :]))
    turn = np.argsort(-bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, turn, axis=1)
    whole = (q.astype(np.int64), x.astype(np.int64)) if wide else (q, x)
    hits = [np.zeros(0, np.int64)] * 3  # query, place in the block, score
    running = np.arange(len(who))
    for step in range(len(starts)):
        running = running[bounds[running, step] >= least[running]]
        if not len(running):
            break
        found = [hits]
        for annulus in np.unique(turn[running, step]):
            rows = running[turn[running, step] == annulus]
            for at in range(0, len(rows), QUERIES_AT_ONCE):
                some, own = rows[at : at + QUERIES_AT_ONCE], slice(starts[annulus], ends[annulus])
                product = whole[0][some] @ whole[1][own].T  # sums of whole numbers, exact either way
                i, j = np.nonzero(product >= least[some, None])
                found.append([some[i], starts[annulus] + j, product[i, j].astype(np.int64)])
        asked, near, score = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((ids[near], firsts[near], -score, asked))
        asked, near, score = asked[order], near[order], score[order]
        first = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, np.int64)
        place = np.arange(len(asked)) - np.repeat(first, np.diff(np.append(first, len(asked))))
        full = place == k
        least[asked[full]] = np.maximum(least[asked[full]], score[full])
        hits = [c[place <= k] for c in (asked, near, score)]
    return who[hits[0]], ids[hits[1]], firsts[hits[1]], hits[2]
