"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity`` tokens; the packing itself only needs the histogram of piece
lengths, which has at most ``capacity`` rows whatever the corpus holds. On that histogram the driver repeats: seed a
bin with the longest length left, find by bitset subset-sum dynamic programming the fullest combination of the
lengths left, and take that combination out as many times as the counts allow. Each step uses up the counts of a
length (to below what the pattern needs), so there are few more steps than lengths. Executors then number the pieces
of each length and look their place up in the plan.

Nulls and edge cases: a null text is an empty one; an empty text is one piece that holds the separator alone; a null
id is kept as it is; repeated rows are packed as documents of their own; an empty table gives no rows. Only the id
and text columns are read, so further columns may have any name.
"""

from __future__ import annotations

import bisect
import os
import re
import string
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from byteloom.llm.common import checkpoint, fresh, part_rows, salted_rank

CAPACITY = 2048
SEPARATOR = 0
#: Words longer than this (in bytes) are encoded each time; the worker keeps at most so many others.
WORD_BYTES, WORDS_KEPT = 64, 400_000
MARKS = string.punctuation.encode()
LATIN_END = "\u0250"
COMBINING = re.compile("[\u0300-\u036f]")
#: Documents that ``pack_in_order`` packs together.
WINDOW_ROWS = 1024


def _stem(word: bytes) -> bytes:
    """The word without its closing marks, if a letter or digit stands before them."""
    stem = word.rstrip(MARKS)
    if stem and not stem[-1:].isalnum() and not stem[-4:].decode(errors="ignore").lower()[-1:].isalpha():
        return word
    return stem


class WordEncoder:
    """Token ids of whole texts, for a tokenizer that lower-cases, drops white space and never joins across it.

    A text is cut at ASCII white space, and a word's ids are kept; those of a text are those of its words in turn, as
    normalisation stays within words. A new word's closing ASCII marks are split off first: the tokenizer splits there
    too. A-Z is lower-cased first unless the text holds combining marks, which may compose with one case alone.
    """

    def __init__(self, tokenizer_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        # Strings of special tokens stand for them wherever they occur, so texts are cut there first; words are plain then.
        self.tokenizer.encode_special_tokens = True
        own = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = {t: np.array([i], dtype="<u4").tobytes() for t, i in own.items()}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")" if own else r"(?!)")
        # Words of small Latin letters are what normalising and splitting would leave them; they skip both.
        self.bare = Tokenizer.from_file(tokenizer_path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, ByteLevel(add_prefix_space=False, use_regex=False)
        self.known: dict[bytes, bytes] = {}

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = {}
        plain = {w: s for w in words if (s := w.decode()).isalpha() and s.islower() and max(s) < LATIN_END}
        rest = {w: w.decode() for w in words if w not in plain}
        for tokenizer, part in ((self.bare, plain), (self.tokenizer, rest)):
            out = tokenizer.encode_batch_fast(list(part.values()), add_special_tokens=False)
            found.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(part, out))
        return found

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of new words; they are kept while there is room, which the frequent ones, seen early, find."""
        known = self.known
        stems = {w: _stem(w) for w in words}
        parts = {part for w, stem in stems.items() for part in (stem, w[len(stem) :]) if part}
        new = [w for w in parts if w not in known]
        ids = self._encode(new)
        ids[b""] = b""
        for w, stem in stems.items():
            if w not in ids:
                tail = w[len(stem) :]
                ids[w] = (known[stem] if stem in known else ids[stem]) + (known[tail] if tail in known else ids[tail])
        if len(known) < WORDS_KEPT:
            known.update((w, i) for w, i in ids.items() if len(w) <= WORD_BYTES)
        return ids

    def _ids(self, text: str) -> bytes:
        known, data = self.known, text.encode()
        words = (data if COMBINING.search(text) else data.lower()).split()
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            own = self._learn(set(words).difference(known))
            return b"".join([known[w] if w in known else own[w] for w in words])

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        for text in texts:
            text = text or ""
            if any(s in text for s in self.special):
                yield b"".join([self.special.get(part) or self._ids(part) for part in self.cuts.split(text)])
            else:
                yield self._ids(text)


@lru_cache(2)
def encoder(tokenizer_path: str) -> WordEncoder:
    """One for each worker process, so that what one task has learned serves the next."""
    return WordEncoder(tokenizer_path)


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False, at_col: str | None = None) -> DataFrame:
    """The token pieces of each document: id, piece, start, length, ids_crc32, ids with ``keep_ids``, and the long ``at_col``."""
    limit = 4 * capacity

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(tokenizer_path)
        for batch in batches:
            rows: list[tuple] = []
            blobs: list[bytes] = []
            places: list = []
            for row, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), words.encode(batch.column(1).to_pylist()))):
                ids += SEPARATOR.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), limit)):
                    part = ids[at : at + limit]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    places.append(row)
                    if keep_ids:
                        blobs.append(part)
            if not rows:
                continue
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = [id_col, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array([np.frombuffer(b, "<u4").astype(np.int64) for b in blobs], pa.list_(pa.int64())))
                names.append("ids")
            if at_col:
                columns.append(batch.column(2).take(pa.array(places)))
                names.append(at_col)
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids + f", `{at_col}` long" * bool(at_col)
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"), *[at_col] * bool(at_col)).mapInArrow(cut, schema)


@dataclass(frozen=True)
class Step:
    """``times`` sequences, each of ``pattern``: how many pieces of each length it holds, longest first."""

    pattern: tuple[tuple[int, int], ...]
    times: int


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths that fills ``room`` best; longer lengths are preferred among equals.

    ``lengths`` ascends. Bit t of a state says that t tokens can be made up from the lengths tried so far, which are the
    longest ones; no more are tried once ``room`` is made up exactly.
    """
    reach, states = 1, []
    mask = (1 << (room + 1)) - 1
    for k in range(bisect.bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[k]
        most, take = min(counts[length], room // length), 1
        while most > 0:
            take = min(take, most)
            states.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            most -= take
            take *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(states):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Step]:
    """Minimum bin slack over a histogram of lengths."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(counts)
    steps = []
    while lengths:
        seed = lengths[-1]
        counts[seed] -= 1
        chosen = fullest(lengths, counts, capacity - seed)
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        times = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
        steps.append(Step(tuple(sorted(chosen.items(), reverse=True)), times))
    return steps


def _places(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length: from which piece on, first sequence, number of sequences and offset of each run of pieces."""
    first: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = dict.fromkeys(histogram, 0)
    sequence = 0
    for step in plan(histogram, capacity):
        offset = 0
        for length, each in step.pattern:
            first.setdefault(length, []).append((used[length], sequence, step.times, offset))
            used[length] += each * step.times
            offset += each * length
        sequence += step.times
    assert used == histogram, "the plan places each piece once"
    return {k: np.array(v, dtype=np.int64).T for k, v in first.items()}


def _placed(length: np.ndarray, rank: np.ndarray, places: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces, from their rank among those of their length."""
    at, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    for n in np.unique(length):
        own = np.flatnonzero(length == n)
        since, base, times, off = places[int(n)]
        k = np.searchsorted(since, rank[own], side="right") - 1
        nth = rank[own] - since[k]
        at[own] = base[k] + nth % times[k]
        offset[own] = off[k] + nth // times[k] * n
    return at, offset


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Packs all documents: a row for each piece with its sequence_id and offset.

    Tokens are made once and kept in the checkpoint folder. The driver gets the histogram alone (``capacity`` rows
    at most); the plan that goes back has a few rows for each length.
    """
    made = checkpoint(pieces(docs, tokenizer_path, id_col, text_col, capacity, keep_ids))
    histogram = {r["length"]: r["count"] for r in made.groupBy("length").count().collect()}
    places = _places(histogram, capacity)

    # At most ``capacity`` lengths.
    each = part_rows(docs.sparkSession, sum(histogram.values()))
    salts = F.broadcast(docs.sparkSession.createDataFrame([(k, -(-v // each)) for k, v in histogram.items()], "length long, _parts long"))
    spread = made.join(salts, "length").withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.col("_parts"))).drop("_parts")
    ranked = salted_rank(spread, ["length"], "_salt", [F.col(id_col), F.col("piece")], "_rank")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
            at, offset = _placed(length, rank, places)
            keep = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(at), pa.array(offset)], [*names, "sequence_id", "offset"])

    names = made.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return ranked.select(*names, "_rank").mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def file_order(docs: DataFrame, output: str) -> DataFrame:
    """Adds each row's place in the files that ``docs`` reads, by file name and row; no row moves.

    Rows that aren't read from files are numbered in the order of their partitions.
    """
    if not docs.inputFiles():
        return docs.withColumn(output, F.monotonically_increasing_id())
    file, row, since = fresh(docs, "_file", "_row", "_since")
    named = docs.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(row))
    held = {r[file]: r["n"] for r in named.groupBy(file).agg((F.max(row) + 1).alias("n")).collect()}
    before, starts = 0, []
    for name in sorted(held):
        starts.append((name, before))
        before += held[name]
    starts = docs.sparkSession.createDataFrame(starts, f"{file} string, {since} long")
    return named.join(F.broadcast(starts), file).select(*docs.columns, (F.col(since) + F.col(row)).alias(output))


def pack_in_order(docs: DataFrame, tokenizer_path: str, at_col: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Packs ``window_rows`` documents at a time, consecutive by ``at_col``; sequences are numbered window by window.

    So each stretch of sequences holds the documents of one stretch of the order, whatever their lengths. A window leaves
    one sequence more or less unfilled. A task has one window, however large the corpus.
    """
    made = pieces(docs, tokenizer_path, id_col, text_col, capacity, at_col=at_col)
    names = [c for c in made.columns if c != at_col]

    def place(window: pa.Table) -> pa.Table:
        length, at, piece, number = (window.column(n).to_numpy() for n in ("length", at_col, "piece", "_window"))
        order = np.lexsort((piece, at, length))
        kinds, first, counts = np.unique(length[order], return_index=True, return_counts=True)
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length)) - np.repeat(first, counts)
        sequence, offset = _placed(length, rank, _places(dict(zip(kinds.tolist(), counts.tolist())), capacity))
        return pa.Table.from_arrays([*(window.column(c) for c in names), pa.array(number), pa.array(sequence), pa.array(offset)], [*names, "_window", "_sequence", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.select(*names).schema)
    windows = made.withColumn("_window", F.floor(F.col(at_col) / window_rows)).groupBy("_window")
    placed = checkpoint(windows.applyInArrow(place, f"{kinds}, _window long, _sequence long, offset long"))
    before = W.orderBy("_window").rowsBetween(W.unboundedPreceding, -1)
    used = placed.groupBy("_window").agg((F.max("_sequence") + 1).alias("_n"))
    bases = used.select("_window", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(bases), "_window").select(*names, (F.col("_base") + F.col("_sequence")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from ``pack(..., keep_ids=True)``; a sequence holds ``capacity`` ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
