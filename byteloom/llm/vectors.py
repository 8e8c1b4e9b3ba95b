"""What the two vector searches share: which vectors take part, copies, blocks of rows, and merging of results.

Every row is a candidate, whether or not its id or its vector occurs again: rows have numbers of their own here, and a
query leaves out its own row alone. Copies of one vector are searched as one. A class keeps its k + 1 first rows, by id:
no query can need more, as ties go to smaller ids. Queries with equal vectors share one search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from byteloom.llm.common import checkpoint, join_split

#: Vectors in one block of an index cell, and queries that meet a block at once; more are dealt out over several.
BLOCK_ROWS, QUERY_ROWS = 2048, 32_768
MOST_COMPONENTS = 1 << 16


def finite(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def prepared(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> tuple[DataFrame, int, float]:
    """(id, v) of the vectors that take part, v as doubles; the length of the longest, and the largest component.

    Rows without id, and vectors that are null, empty or hold null or non-finite components (or, with ``nonzero``, only
    zeros) take no part. Shorter vectors are as if filled up with zeros, which changes no inner product; a vector of more
    than MOST_COMPONENTS is an error.
    """
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & finite(v))
    if nonzero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    longest, largest = rows.select(F.max(F.size(v)), F.max(F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()
    if (longest or 0) > MOST_COMPONENTS:
        raise ValueError(f"a vector has {longest} components; {MOST_COMPONENTS} is the most")
    return rows, longest or 1, largest or 0.0


def pack_vectors(rows: DataFrame, dim: int, transform: Callable[[np.ndarray], np.ndarray], kind: str) -> DataFrame:
    """(id, row, v) with v as the bytes of its transformed components, of numpy type ``kind``, and a number for each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            flat = batch.column(1).flatten().to_numpy()
            full = np.zeros((batch.num_rows, dim))
            full[np.arange(dim) < sizes[:, None]] = flat
            data = np.ascontiguousarray(transform(full), dtype=kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in data], pa.binary())], ["id", "v"])

    # A checkpoint of this makes the numbers last.
    return rows.select("id", "v").mapInArrow(run, "id long, v binary").select("id", F.monotonically_increasing_id().alias("row"), "v")


def classes(packed: DataFrame, k: int) -> DataFrame:
    """(node, first, ids, v): each distinct vector, its k + 1 first (id, row), the number of the first row, and its id.

    Ranks are cut at k + 1 before the shuffle as well as after it, so a vector of any number of copies sends k + 1
    rows from a task at most.
    """
    ranked = packed.withColumn("_rank", F.row_number().over(W.partitionBy("v").orderBy("id", "row"))).where(F.col("_rank") <= k + 1)
    ids = ranked.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("ids"))
    return ids.select(F.col("ids")[0]["row"].alias("node"), F.col("ids")[0]["id"].alias("first"), "ids", "v")


def query_classes(packed: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """The distinct query vectors (node, v), and (query_id, row, node) for each query."""
    asked = packed.where(F.col("id") % every == 0)
    nodes = checkpoint(asked.groupBy("v").agg(F.min("row").alias("node")).select("node", "v"))
    return nodes, checkpoint(join_split(asked, nodes, "v", F.col("row")).select(F.col("id").alias("query_id"), "row", "node"))


def merge(partial: DataFrame, asked: DataFrame, nodes: DataFrame, k: int, score_type: str) -> DataFrame:
    """The k best of each query from (node, found, first, score) rows, which may repeat: a class counts once.

    ``found`` is a class and ``first`` its first id; ``nodes`` has its rows. Each query vector's k + 1 best classes
    suffice, as each has one row at least.
    """
    by_query = W.partitionBy("node").orderBy(F.desc("score"), "first", "found")
    top = partial.groupBy("node", "found", "first").agg(F.max("score").alias("score")).withColumn("_rank", F.row_number().over(by_query)).where(F.col("_rank") <= k + 1)
    top = checkpoint(top.select("node", "found", "score"))
    hits = join_split(top, nodes.select(F.col("node").alias("found"), "ids"), "found", F.col("node")).select("node", "score", F.inline("ids").alias("vec_id", "of_row"))
    ordered = W.partitionBy("node").orderBy(F.desc("score"), "vec_id", "of_row")
    hits = hits.withColumn("_rank", F.row_number().over(ordered)).where(F.col("_rank") <= k + 1)
    lists = hits.groupBy("node").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "of_row", "score"))).alias("hits"))
    own = join_split(asked, lists, "node", F.col("row")).select("query_id", F.slice(F.filter("hits", lambda h: h["of_row"] != F.col("row")), 1, k).alias("hits"))
    out = own.select("query_id", F.posexplode("hits").alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").cast(score_type).alias("score"))
