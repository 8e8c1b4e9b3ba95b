"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks. With weight w (its share of all weights), block j of a source is
released at slot floor(j / w) and is due by slot ceil((j + 1) / w); in each slot the released block with the earliest
deadline goes next. On one channel that meets every deadline, so after any number of slots each source has had its
share to within less than one block.

Weights are whole numbers, so the schedule repeats after their sum: the driver makes one period, and a block's slot
follows from its number alone. When a source has no block left, a new phase begins in which the others share the
slots in proportion to their weights; there are at most as many phases as sources named. Whatever the size of the
corpus, the driver sees one count per named source. Weights are taken by their greatest common divisor, and may then sum
up to MOST_SLOTS, as the driver makes that many slots.

Nulls and edge cases: sources that the weights don't name, null among them, are pooled under ``OTHER``; within a source
documents are ordered by a digest of their id (of all their columns where it is null), so the order is random and
repeatable; repeated rows keep places of their own; an empty table gives no rows. Null texts are kept. Columns that this operator adds
(``pool block slot place``) replace input columns of those names; other columns may have any name.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil, floor, gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byteloom.llm.common import fresh, hashable, part_rows, salted_rank

OTHER = "*"
ADDED = ("pool", "block", "slot", "place")
BLOCK_ROWS = 16
#: Slots of one period at most, by sources named at most: both tables that are broadcast are bounded by these.
MOST_SLOTS, MOST_SOURCES = 10_000, 256


def window(j: int, weight: Fraction) -> tuple[int, int]:
    """Release slot and deadline of block ``j`` of a source of this share."""
    return floor(j / weight), ceil((j + 1) / weight)


def period(weights: dict[str, int]) -> list[str]:
    """The source of each slot of one period, which has as many slots as the weights' sum."""
    total = sum(weights.values())
    done = dict.fromkeys(weights, 0)
    order = []
    for slot in range(total):
        due = []
        for source, weight in weights.items():
            if done[source] < weight:
                release, deadline = window(done[source], Fraction(weight, total))
                if release <= slot:
                    due.append((deadline, source))
        deadline, source = min(due)
        assert slot < deadline
        done[source] += 1
        order.append(source)
    return order


def phases(weights: dict[str, int], blocks: dict[str, int]) -> list[dict]:
    """Stretches of slots in which the same sources take turns: where each stretch and its sources' blocks start."""
    left = {s: blocks.get(s, 0) for s in weights if blocks.get(s, 0)}
    used = dict.fromkeys(left, 0)
    slot, out = 0, []
    while left:
        share = {s: weights[s] for s in left}
        order = period(share)
        whole = min(left[s] // share[s] for s in share)
        taken = {s: whole * share[s] for s in share}
        length = whole * len(order)
        for source in order:
            if any(taken[s] == left[s] for s in left):
                break
            taken[source] += 1
            length += 1
        out.append({"slot": slot, "order": order, "share": share, "first": dict(used), "taken": taken})
        slot += length
        for s in list(left):
            used[s] += taken[s]
            left[s] -= taken[s]
            if not left[s]:
                del left[s]
    return out


def mix(docs: DataFrame, weights: dict[str, int], id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds to each document its pool, block (number within the pool), slot and place (within the block).

    Ordering by (slot, place) is the mix; ``interleave`` writes it out. All documents are kept.
    """
    if not weights or any(not isinstance(w, int) or w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive whole numbers")
    weights = {OTHER: max(1, min(weights.values()))} | weights
    weights = {s: w // gcd(*weights.values()) for s, w in weights.items()}
    if sum(weights.values()) > MOST_SLOTS or len(weights) > MOST_SOURCES:
        raise ValueError(f"{len(weights)} weights sum up to {sum(weights.values())}; {MOST_SOURCES} of {MOST_SLOTS} is the most")
    spark = docs.sparkSession
    named = [s for s in weights if s != OTHER]
    base = docs.drop(*ADDED)
    digest, tie, salt, rank, phase, since, until, slot0, share, cycle, nth, round_, turn = fresh(docs, *"_digest _tie _salt _rank _phase _since _until _slot0 _share _cycle _nth _round _turn".split())
    source, every = F.col(source_col), F.xxhash64(*hashable(docs))
    written = F.md5(F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), every.cast("string"))))
    pooled = docs.withColumns({digest: written, tie: every, "pool": F.when(source.isin(named), source).otherwise(F.lit(OTHER))}).drop("block", "slot", "place")
    rows = {r["pool"]: r["count"] for r in pooled.groupBy("pool").count().collect()}
    blocks = {s: -(-n // block_rows) for s, n in rows.items()}

    spans, turns = [], []
    for p, stretch in enumerate(phases(weights, blocks)):
        seen = dict.fromkeys(stretch["share"], 0)
        for slot, s in enumerate(stretch["order"]):
            turns.append((s, p, seen[s], slot))
            seen[s] += 1
        spans += [(s, p, stretch["first"][s], stretch["first"][s] + stretch["taken"][s], stretch["slot"], stretch["share"][s], len(stretch["order"])) for s in stretch["share"]]
    spans = spark.createDataFrame(spans, f"pool string, {phase} int, {since} long, {until} long, {slot0} long, {share} long, {cycle} long")
    turns = spark.createDataFrame(turns, f"pool string, {phase} int, {nth} long, {turn} long")

    parts = max(1, -(-max(rows.values(), default=0) // part_rows(spark, sum(rows.values()))))
    dealt = F.floor(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") * parts / F.lit(2**32)).cast("long")
    ranked = salted_rank(pooled.withColumn(salt, dealt), ["pool"], salt, [F.col(digest), F.col(tie)], rank)
    numbered = ranked.withColumns({"block": F.floor(F.col(rank) / block_rows), "place": (F.col(rank) % block_rows).cast("int")})
    # Both tables are bounded by the weights: (sources x phases) and (phases x sum of weights) rows.
    in_phase = numbered.join(F.broadcast(spans), ["pool"]).where((F.col("block") >= F.col(since)) & (F.col("block") < F.col(until)))
    at = F.col("block") - F.col(since)
    in_phase = in_phase.withColumns({nth: at % F.col(share), round_: F.floor(at / F.col(share))})
    placed = in_phase.join(F.broadcast(turns), ["pool", phase, nth])
    slot = F.col(slot0) + F.col(round_) * F.col(cycle) + F.col(turn)
    return placed.select(*base.columns, "pool", "block", slot.alias("slot"), "place")


def interleave(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mix: ranges of slots by partition, sorted within, so files written hold that order."""
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
