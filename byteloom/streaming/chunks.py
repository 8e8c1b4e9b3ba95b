"""Detection over chunked byte streams, in batch and in Structured Streaming.

A stream's chunks are put together up to ``max_bytes``, and detection runs once, when the stream closes; what the chunks
were makes no difference. The batch form orders chunks by ``seq``. The streaming form keeps, for each stream, the bytes
so far and the chunks that came too early; it never holds more than ``max_bytes`` of content in order, and drops what is
past that. Chunks that came early keep no more of their bytes than the limit leaves in any case; if more than EARLY_CHUNKS
wait for one that is missing, the stream ends with an error, so its state is bounded.

Events: a row without event, or ``feed``, adds its chunk; ``close`` ends the stream and gives its result once; ``reset``
forgets everything, so the stream starts anew. A chunk that is fed after ``close`` gives a row with ``error`` instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from byteloom.operators import residual
from byteloom.operators.detect import _displayed, _standard_models, detect
from byteloom.operators.options import DetectOptions

FEED, CLOSE, RESET = "feed", "close", "reset"
EARLY_CHUNKS = 10_000
OUTPUT = "encoding string, confidence double, language string, mime_type string, n_bytes long, error string"
STATE = "buffer binary, next long, closed boolean, early_seqs array<long>, early_chunks array<binary>, early_events array<string>"


def progress(chunks: DataFrame, key: str, seq: str, chunk: str, max_bytes: int) -> DataFrame:
    """Adds ``before``, the bytes of a stream's chunks before each one, and ``done``: with it, ``max_bytes`` are reached."""
    before = F.sum(F.octet_length(chunk)).over(W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    placed = chunks.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
    return placed.withColumn("done", F.col("before") + F.coalesce(F.octet_length(chunk), F.lit(0)) >= max_bytes)


def assembled(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk", max_bytes: int | None = None) -> DataFrame:
    """(key, content): each stream's chunks in order, cut at ``max_bytes``. Null chunks count as empty."""
    most = max_bytes or DetectOptions().max_bytes
    placed = progress(chunks.select(key, seq, chunk), key, seq, chunk, most)
    part = F.when(F.col("before") < most, F.expr(f"substring(`{chunk}`, 1, cast({most} - before as int))"))
    # A chunk that is null or past the limit counts as none, so each stream has a row.
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct(F.col(seq).alias("seq"), part.alias("part")))))
    joined = placed.groupBy(key).agg(parts.alias("_parts"))
    return joined.select(key, F.aggregate("_parts", F.lit(b""), lambda acc, p: F.concat(acc, p["part"])).alias("content"))


def detect_chunks(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk", options: DetectOptions | None = None) -> DataFrame:
    """(key, detected) for each stream of a batch of chunks."""
    options = options or DetectOptions()
    return detect(assembled(chunks, key, seq, chunk, options.max_bytes), "content", "detected", options).drop("content")


def split(df: DataFrame, size: int, key: str, content: str = "content") -> DataFrame:
    """(key, seq, chunk): content cut into chunks of ``size`` bytes, for tests and replays."""
    n = F.greatest(F.ceil(F.octet_length(content) / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.expr(f"substring(`{content}`, 1, 2147483647)").substr(k * size + 1, F.lit(size)))
    return df.where(F.col(content).isNotNull()).select(key, F.posexplode(cut).alias("seq", "chunk"))


def detect_stream(
    chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk", event: str | None = None,
    options: DetectOptions | None = None, idle_ms: int | None = None,
) -> DataFrame:
    """A row for each stream that closes, or is idle for ``idle_ms`` (processing time) if that is given."""
    options = options or DetectOptions()
    most = options.max_bytes
    named = chunks.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(chunk).alias("chunk"), F.coalesce(F.col(event) if event else F.lit(FEED), F.lit(FEED)).alias("event"))
    key_type = named.schema["key"].dataType.simpleString()

    def row(key: tuple, content: bytes) -> dict:
        found = residual.detect_all(content, options, _standard_models())[0]
        return {"key": key[0], **_displayed(found, options), "n_bytes": len(content), "error": None}

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, following, closed, early = b"", 0, False, {}
        if state.exists:
            buffer, following, closed, seqs, parts, events = state.get
            buffer = bytes(buffer)
            early = {s: (e, bytes(p)) for s, p, e in zip(seqs, parts, events)}
        out: list[dict] = []
        if state.hasTimedOut:
            state.remove()
            if not closed:
                yield pd.DataFrame([row(key, buffer)])
            return
        for batch in batches:
            for s, part, what in zip(batch["seq"], batch["chunk"], batch["event"]):
                if int(s) >= following:
                    early[int(s)] = (what, b"" if part is None else bytes(part)[:most])
        while following in early:
            what, part = early.pop(following)
            following += 1
            if what == RESET:
                buffer, closed = b"", False
            elif closed and what == FEED:
                out.append({"key": key[0], **asdict(residual.Found(None, 0.0)), "n_bytes": len(buffer), "error": "chunk fed after close"})
            elif what == FEED:
                buffer += part[: most - len(buffer)]
            elif not closed:
                out.append(row(key, buffer))
                closed = True
        if len(early) > EARLY_CHUNKS:
            out.append({"key": key[0], **asdict(residual.Found(None, 0.0)), "n_bytes": len(buffer), "error": f"more than {EARLY_CHUNKS} chunks wait for chunk {following}"})
            early, closed = {}, True
        held = sorted(early)
        state.update((buffer, following, closed, held, [early[s][1] for s in held], [early[s][0] for s in held]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if out:
            yield pd.DataFrame(out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    found = named.groupBy("key").applyInPandasWithState(step, f"key {key_type}, {OUTPUT}", STATE, "append", timeout)
    return found.withColumnRenamed("key", key)
