"""SimHash near-duplicates, compared on bit slices.

A document's fingerprint has bit b set if over half of its word shingles' XXH64 hashes have it set. Fingerprints that
differ in at most ``radius`` bits link, and documents of one connected component form a group.

Equal fingerprints collapse first. Distinct ones that differ in at most ``radius`` bits agree in one of radius + 1
bands (pigeonhole), so they meet in that band's bucket. Large buckets are split once more by the same argument over
the remaining bits. A task turns its buckets into vertical bit planes and compares each fingerprint with the one s places
on, for s = 1, 2, ..., 64 pairs to a machine word: differing bits go into carry-save bitwise counters, and words whose
pairs all exceed the radius are abandoned. A bucket yields a star for each group found in it, never its pairs. Buckets
that are still larger than CHUNK_ROWS go on as chunks of that size, and each pair of chunks is a task's of its own, so
memory and work of a task are bounded whatever a bucket holds.

Components are found by contraction: each node points to its smallest neighbour, pointers are followed to their roots,
and roots with links between them are the nodes of the next round. Every node that has a link is merged with another one,
so a round at least halves their number: there are at most log2(nodes) rounds, of at most log2(nodes) steps each.

Nulls and edge cases: a null or blank text has fingerprint zero, which links like any other; fewer words than a
shingle's make one shingle; a row without id links like any other, and the component of rows without id alone is null;
repeated rows share their component; an empty table gives no rows. Only the id and text columns are read, so further
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import Scratch, checkpoint, fresh, hashable, join_split

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
#: Buckets of more members are split by bits outside their band.
SPLIT_AT = 2048
#: Buckets of more members than this are compared chunk by chunk.
CHUNK_ROWS = 8192
#: Hashes counted at once, and bucket members compared at once.
HASHES_AT_ONCE, LANES_AT_ONCE = 1 << 16, 1 << 15


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint. ``bytes`` methods lower-case A-Z alone and split at ASCII white space alone."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = zip(*(words[k:] for k in range(shingle_words))) if len(words) >= shingle_words else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = np.array([digest(join(s), SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, keys: dict[str, Column] | None = None) -> DataFrame:
    """(id, fp) of each document, and the whole numbers ``keys`` between the two."""
    keys = keys or {}
    names = ["id", *keys, "fp"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle_words) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fps, pa.int64())], names)

    asked = docs.select(F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"), *[c.cast("long").alias(n) for n, c in keys.items()])
    return asked.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def planes(fps: np.ndarray) -> np.ndarray:
    """64 bit planes, each with one bit for each fingerprint, in whole 64-bit words and one word of zeros more."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    words = len(fps) // 64 + 2
    out = np.zeros((64, words * 8), np.uint8)
    packed = np.packbits(bits, axis=0, bitorder="little").T
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def close_pairs(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of the pairs within ``radius``, for members of equal (adjacent) key, shift by shift."""
    n = len(fps)
    if n < 2:
        return
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, n)
    after = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) - 1  # members of the bucket that follow each one
    sliced = planes(fps)
    padded = np.zeros((n // 64 + 1) * 64, np.int64)
    padded[:n] = after
    lanes = padded.reshape(-1, 64)
    longest = lanes.max(axis=1)
    counters = radius.bit_length()
    preset = (1 << counters) - 1 - radius  # so that a counter overflows once the distance exceeds the radius
    active = np.flatnonzero(longest >= 1)
    for shift in range(1, int(longest.max()) + 1):
        active = active[longest[active] >= shift]
        valid = np.packbits(lanes[active] >= shift, axis=1, bitorder="little").view("<u8")[:, 0]
        word, bit = active + shift // 64, np.uint64(shift % 64)
        at, live = active, valid
        count = [np.full(len(at), ~np.uint64(0) if preset >> k & 1 else np.uint64(0)) for k in range(counters)]
        for k in range(64):
            there = sliced[k, word]
            if bit:
                there = (there >> bit) | (sliced[k, word + 1] << (np.uint64(64) - bit))
            carry = sliced[k, at] ^ there
            for c in range(counters):
                count[c], carry = count[c] ^ carry, count[c] & carry
            live = live & ~carry
            if k % 8 == 7:  # abandon the words in which no pair is left
                keep = np.flatnonzero(live)
                if len(keep) < len(live):
                    at, word, live, count = at[keep], word[keep], live[keep], [c[keep] for c in count]
                if not len(live):
                    break
        if len(live):
            row, lane = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            first = at[row] * 64 + lane
            yield first, first + shift


def stars(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(fp, root) of each member that is linked within its bucket; a root is one member of its group there."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for left, right in close_pairs(keys, fps, radius):
        new = root[left] != root[right]
        for i, j in zip(left[new].tolist(), right[new].tolist()):
            a, b = find(i), find(j)
            if a != b:
                root[max(a, b)] = min(a, b)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _bits(column: str, low: int, width: int):
    return F.shiftrightunsigned(F.col(column), low).bitwiseAND((1 << width) - 1)


def banded(reps: DataFrame, radius: int = RADIUS, split_at: int = SPLIT_AT) -> DataFrame:
    """(bucket, fp): each distinct fingerprint in each of its buckets. Two within ``radius`` share a bucket at least."""
    bands = radius + 1
    cuts = [64 * b // bands for b in range(bands + 1)]
    keyed = reps.select("fp", F.posexplode(F.array(*[_bits("fp", lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])])).alias("band", "value"))
    if max(hi - lo for lo, hi in zip(cuts, cuts[1:])) > 16:  # few bands: the number of buckets has no useful bound
        return keyed.select(F.struct("band", "value", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest")).alias("bucket"), "fp")
    # At most bands x 2**16 buckets can be large, and so many rows are broadcast at most.
    large = keyed.groupBy("band", "value").count().where(F.col("count") > split_at).select("band", "value", F.lit(True).alias("large"))
    marked = keyed.join(F.broadcast(large), ["band", "value"], "left")
    # The bits outside the band, moved together, are cut into as many parts: one of them agrees too.
    rest_bits = F.lit(0).cast("long")
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        high = F.shiftleft(F.shiftrightunsigned(F.col("fp"), hi), lo) if hi < 64 else F.lit(0).cast("long")
        rest_bits = F.when(F.col("band") == b, high.bitwiseOR(_bits("fp", 0, lo) if lo else F.lit(0).cast("long"))).otherwise(rest_bits)
    width = 64 - (cuts[1] - cuts[0])
    subs = [width * s // bands for s in range(bands + 1)]
    parts = F.array(*[F.struct(F.lit(s).alias("sub"), F.shiftrightunsigned(F.col("_rest"), lo).bitwiseAND((1 << (hi - lo)) - 1).alias("rest")) for s, (lo, hi) in enumerate(zip(subs, subs[1:]))])
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("rest")))
    out = marked.withColumn("_rest", rest_bits).select("fp", "band", "value", F.explode(F.when(F.col("large"), parts).otherwise(whole)).alias("part"))
    return out.select(F.struct("band", "value", F.col("part.sub").alias("sub"), F.col("part.rest").alias("rest")).alias("bucket"), "fp")


def links(reps: DataFrame, radius: int = RADIUS, split_at: int = SPLIT_AT, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(fp, root) edges whose components are those of all pairs within ``radius``. ``reps`` has each fingerprint once."""

    def compared(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = stars(keys, fps.astype("<i8").view("<u8"), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8")), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.binary())], names)

    def chunk(key: int, number: int, fps: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array([key]), pa.array([number]), pa.array([fps.astype("<i8").tobytes()])], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket. Edges of the buckets that are small, and the chunks of those that aren't."""
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        giant, number = None, 0  # the bucket of which chunks have gone, and how many
        for batch in (*batches, None):
            if batch is not None:
                keys, fps = (np.concatenate([held, batch.column(c).to_numpy()]) for c, held in enumerate((keys, fps)))
                if len(keys) < LANES_AT_ONCE:
                    continue
            starts = np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)
            small = np.ones(len(keys), bool)
            for k in np.flatnonzero((np.diff(starts) > chunk_rows) | (keys[starts[:-1]] == giant if giant is not None else False)):
                at, end = starts[k], starts[k + 1]
                if keys[at] != giant:
                    giant, number = keys[at], 0
                open_end = batch is not None and end == len(keys)  # more of it may come
                while end - at > chunk_rows or at < end and not open_end:
                    yield chunk(int(giant), number, fps[at : min(end, at + chunk_rows)])
                    small[at : at + chunk_rows] = False
                    at, number = min(end, at + chunk_rows), number + 1
                if not open_end:
                    small[starts[k] : end] = False
            kept = small.copy()
            if batch is not None and len(keys):  # the last bucket may go on in the next batch
                small[starts[-2] :] = False
                kept[: starts[-2]] = False
            else:
                kept[:] = False
            yield compared(keys[small], fps[small])
            keys, fps = keys[kept], fps[kept]

    def pair(chunks: pa.Table) -> pa.Table:
        fps = np.frombuffer(b"".join(chunks["blob"].to_pylist()), "<u8")
        a, b = stars(np.zeros(len(fps), np.int64), fps, radius)
        return pa.table({"fp": a.view("<i8"), "root": b.view("<i8")})

    names = ["fp", "root", "bucket", "number", "blob"]
    # Buckets are told apart by a 64-bit hash: if two ever share one, they are merely compared together.
    keyed = banded(reps, radius, split_at).select(F.xxhash64("bucket").alias("key"), "fp")
    found = checkpoint(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "fp long, root long, bucket long, number long, blob binary"))
    # One row for each chunk_rows members of a bucket; each chunk meets each other one of its bucket once.
    chunks = found.where("blob is not null").select("bucket", "number", "blob")
    known = chunks.join(chunks.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket").where("n > 1")
    paired = known.select("bucket", "number", "blob", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("other")).where("number != other")
    met = paired.select("bucket", F.least("number", "other").alias("first"), F.greatest("number", "other").alias("second"), "blob")
    between = met.groupBy("bucket", "first", "second").applyInArrow(pair, "fp long, root long")
    return found.where("fp is not null").select("fp", "root").unionByName(between)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): one node of each component, the same for all of its nodes. Edges are pairs of nodes in any order."""
    a, b = edges.columns
    node, up, scratch = F.col("node"), F.col("up"), Scratch(edges.sparkSession)
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node != other")
    both = scratch.write(both.unionByName(both.select(F.col("other").alias("node"), node.alias("other"))).distinct())
    roots = None
    while True:
        # Everyone's smallest neighbour. Of two that point to each other the smaller one is a root; there is no other circle.
        points = scratch.write(both.groupBy("node").agg(F.min("other").alias("up")))
        back = join_split(points, points.select(node.alias("up"), up.alias("back")), "up", node)
        points = scratch.write(back.select("node", F.when((F.col("back") == node) & (node < up), node).otherwise(up).alias("up")))
        while True:
            over = join_split(points, points.select(node.alias("up"), up.alias("over")), "up", node)
            over = scratch.write(over.select("node", F.col("over").alias("up"), (up != F.col("over")).alias("moved")))
            points = over.select("node", "up")
            if over.where("moved").isEmpty():
                break
        points = points.select("node", up.alias("root"))
        if roots is None:
            roots = scratch.write(points)
        else:
            now = join_split(roots, points.select(node.alias("root"), F.col("root").alias("now")), "root", node, "left")
            roots = scratch.write(now.select("node", F.coalesce("now", "root").alias("root")))
        near = scratch.write(join_split(both, points, "node", F.col("other")).select(F.col("root").alias("near"), "other"))
        far = join_split(near, points.select(node.alias("other"), F.col("root").alias("far")), "other", F.col("near"))
        both = scratch.write(far.where("near != far").select(F.col("near").alias("node"), F.col("far").alias("other")).distinct())
        scratch.keep(roots, both)
        if both.isEmpty():
            return roots


def grouped(made: DataFrame, radius: int = RADIUS, split_at: int = SPLIT_AT) -> DataFrame:
    """(fp, root): each distinct fingerprint of ``made`` with one fingerprint of its component."""
    reps = made.select("fp").distinct()
    roots = components(links(reps, radius, split_at))
    return reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, split_at: int = SPLIT_AT) -> DataFrame:
    """(id, fp, component_id) of each document; component_id is the smallest id that links reach, its own included."""
    made = checkpoint(fingerprints(docs, id_col, text_col, shingle_words))
    groups = checkpoint(grouped(made, radius, split_at).join(made.groupBy("fp").agg(F.min("id").alias("least")), "fp"))
    least = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = join_split(groups.select("fp", "root"), least, "root", F.col("fp")).select("fp", "component_id")
    return join_split(made, of_fp, "fp", F.col("id")).select(F.col("id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, split_at: int = SPLIT_AT) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row of smallest id (those without id last).

    Rows are told apart by two hashes over all their columns, whatever their ids, so one of an id that is given twice may
    go and the other stay; of rows that are equal throughout one stays. Whole rows are shuffled once.
    """
    low, high = fresh(docs, "_low", "_high")
    hashes = {low: F.xxhash64(*hashable(docs)), high: F.xxhash64(F.lit(1), *hashable(docs))}
    made = checkpoint(fingerprints(docs, id_col, text_col, shingle_words, hashes))
    first = F.min(F.struct(F.col("id").isNull(), "id", low, high)).alias("first")
    best = made.groupBy("fp").agg(first).join(grouped(made, radius, split_at), "fp").groupBy("root").agg(F.min("first").alias("first"))
    kept = best.select(f"first.{low}", f"first.{high}")
    keyed = docs.select("*", *[c.alias(n) for n, c in hashes.items()])
    # The join deals rows by their hashes, so equal ones already lie together.
    return keyed.join(kept, [low, high], "left_semi").dropDuplicates([low, high]).select(*docs.columns)
