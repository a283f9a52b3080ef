"""Benchmark decontamination by spaced seeds.

Texts are lower-cased (ASCII), punctuation is dropped and words are split at white space. Fixed masks
ignore some positions of a 13-word window; the hashes of the kept positions of benchmark windows are joined with
those of document windows. Each hit fixes an alignment, on which the longest run of 13-word windows with
at least 80 % equal words around the hit is verified, so substituted words are tolerated. However the words that
verification lets differ are placed, a mask fits between them: nothing that verifies is missed.

Texts are read once. A bit table of fixed size, made of the benchmark's seeds, stops all other seeds where the text is;
documents with a seed left over are written as word hashes with their hits. Hits are joined with the benchmark's seeds and
alignments with its items: by broadcast while these have at most ``BROADCAST_ROWS`` rows (counted), by shuffle beyond, where
adaptive execution splits frequent keys.

Items of fewer than ``least_words`` words (five) are no passages and not searched; shorter ones than 13 words must be found
whole, by 80 % of their words, those of fewer than five words exactly. Null and empty texts match nothing. Repeated document
rows give repeated matches, repeated items one match for each item_id. An empty table on either side gives an empty result;
only the id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, among, discard, id_text, materialize, small_batches

SPAN, LEAST_WORDS, TOLERANCE = 13, 5, 0.8
#: Bits of the table of seeds (its size on the driver and in a worker is an eighth of it in bytes), rows that may be broadcast, words remembered.
FILTER_BITS, BROADCAST_ROWS, MEMO = 27, 2_000_000, 1 << 18
#: 1 marks the positions that a seed compares. Shorter items than ``SPAN`` use the second family. However
#: the words that verification lets differ are placed in a window, a mask of its family fits between them (enumerated in the tests).
MASKS = ("11110111", "1110110011", "11010010111")
SHORT_MASKS = ("1111", "10111", "11011", "11101")
PUNCTUATION = b".,;:!?\"'()[]{}"
SCHEMA = "doc_id long, item_id long, n_equal long, n_words long, start_word long"
U64 = np.uint64
MIX = U64(0x9E3779B97F4A7C15)


def words(text: str) -> list[bytes]:
    return text.encode().translate(LOWER, PUNCTUATION).split()


class Hashes:
    """64-bit hashes of words, remembered for at most MEMO words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known, found = self.known, words(text)
        if len(known) > MEMO:
            known.clear()
        for w in set(found).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), U64, len(found))


def masks_of(n: int) -> tuple[str, ...]:
    """Masks that search an item of n words."""
    return MASKS if n >= SPAN else SHORT_MASKS if n >= 5 else ("1" * n,)


def seeds(ids: np.ndarray, mask: str) -> np.ndarray:
    """Hashes of the windows of word hashes, by start."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = np.full(n, len(mask), U64)
    for i in (i for i, c in enumerate(mask) if c == "1"):
        h = (h ^ ids[i : i + n]) * MIX
        h ^= h >> U64(32)
    return h


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """Equal words, length and first document word (negative) of the longest verified run of the alignment doc[i + shift] ~ item[i]."""
    a, b = max(0, -shift), min(len(item), len(doc) - shift)
    span = min(SPAN, len(item))
    if b - a < span:
        return None
    same = (doc[a + shift : b + shift] == item[a:b]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(same)])
    good = np.flatnonzero(total[span:] - total[:-span] >= TOLERANCE * span)
    if not len(good):
        return None
    breaks = np.flatnonzero(np.diff(good) > 1)
    runs = [(int(good[s]), int(good[e]) + span) for s, e in zip([0, *(breaks + 1)], [*breaks, len(good) - 1], strict=True)]
    return max((int(total[e] - total[s]), e - s, -(s + a + shift)) for s, e in runs)


def items_of(benchmark: DataFrame, least_words: int) -> DataFrame:
    """(item, item_id, n, ids): a number for each row of the benchmark that is searched, and its word hashes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in it:
            ids = [hashes(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([len(x) for x in ids], pa.int32()), pa.array([x.tobytes() for x in ids], pa.binary())], ["item_id", "n", "ids"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    return rows.mapInArrow(run, "item_id long, n int, ids binary").where(F.col("n") >= max(1, least_words)).withColumn("item", F.monotonically_increasing_id())


def seeds_of(items: DataFrame) -> DataFrame:
    """(h, item, at)"""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for item, raw in zip(b.column("item").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids = np.frombuffer(raw, U64)
                for mask in masks_of(len(ids)):
                    h = seeds(ids, mask).view(np.int64)
                    out.append((h, np.full(len(h), item), np.arange(len(h), dtype=np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["h", "item", "at"])

    return items.select("item", "ids").mapInArrow(run, "h long, item long, at int")


def bit_table(found: DataFrame) -> np.ndarray:
    """One bit for each value of the upper bits of the seeds: a fixed number of words at most reach the driver."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 as int))")
    rows = found.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    if rows:
        at, bits = zip(*rows, strict=True)
        out[list(at)] = bits
    return out.view(U64)


def hits_of(docs: DataFrame, masks: list[str], table: np.ndarray, key: str) -> DataFrame:
    """(row, key, ids, h, pos): documents of which seeds are in the table, their word hashes, and those seeds."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, hashes, bits = TaskContext.get().partitionId() << 40, Hashes(), shared.value
        for b in it:
            out = []
            for d, text in zip(b.column(key).to_pylist(), b.column("text").to_pylist(), strict=True):
                ids, h, pos = hashes(text), [], []
                for mask in masks:
                    s = seeds(ids, mask)
                    slot = s >> U64(64 - FILTER_BITS)
                    at = np.flatnonzero((bits[slot >> U64(6)] >> (slot & U64(63))) & U64(1))
                    h.append(s[at].view(np.int64))
                    pos.append(at)
                h, pos = np.concatenate(h), np.concatenate(pos)
                if len(h):
                    out.append((row, d, ids.tobytes(), h.tolist(), pos.tolist()))
                    row += 1
            if out:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], ["row", key, "ids", "h", "pos"])

    return docs.mapInArrow(run, f"row long, {key} long, ids binary, h array<long>, pos array<int>")


def small_or_merge(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows.hint("merge")


def matches(docs: DataFrame, benchmark: DataFrame, key: str, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, item_id, n_equal, n_words, start_word): the longest verified run of each row of ``docs`` (key, text) and item."""
    items = materialize(items_of(benchmark, least_words), "items")
    found = materialize(seeds_of(items), "item-seeds")
    n_seeds, lengths = found.count(), [r[0] for r in items.select(F.least("n", F.lit(SPAN)).alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_of(n)})
    words_ = items.agg(F.sum("n")).first()[0] or 0
    hit = materialize(hits_of(docs, masks, bit_table(found), key), "hits") if masks else docs.sparkSession.createDataFrame([], f"row long, {key} long, ids binary, h array<long>, pos array<int>")
    one = hit.select("row", F.explode(F.arrays_zip("h", "pos")).alias("x")).select("row", "x.h", "x.pos")
    aligned = one.join(small_or_merge(found, n_seeds), "h").select("row", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct()
    both = aligned.join(small_or_merge(items.select("item", "item_id", F.col("ids").alias("own")), words_), "item").join(hit.select("row", key, "ids").hint("merge"), "row")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", key, "item_id", "shift", "ids", "own"]
        for b in it:
            out = []
            for row, d, item, shift, ids, own in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if best := overlap(np.frombuffer(ids, U64), np.frombuffer(own, U64), shift):
                    out.append((row, d, item, *best))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["row", key, "item_id", "n_equal", "n_words", "back"])

    verified = both.select("row", key, "item_id", "shift", "ids", "own").mapInArrow(run, f"row long, {key} long, item_id long, n_equal long, n_words long, back long")
    best = verified.groupBy("row", key, "item_id").agg(F.max(F.struct("n_equal", "n_words", "back")).alias("m"))
    out = materialize(best.select(key, "item_id", "m.n_equal", "m.n_words", (-F.col("m.back")).alias("start_word")), "leaks")
    discard(items, found, *([hit] if masks else []))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each document and benchmark item that share a verified passage."""
    return matches(id_text(docs), benchmark, "doc_id", least_words)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage, also those of a null or repeated doc_id. Null and empty texts
    stay; an empty table stays empty; all columns are kept as they are, whatever their names. Whether a row goes depends on its text
    alone, so rows are told apart by a 64-bit hash of it, as words are, and no numbered copy of them is written."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.struct(*docs.columns).alias("d"))
    leaks = matches(rows.select("th", F.coalesce("d.text", F.lit("")).alias("text")), benchmark, "th", least_words).select("th").distinct()
    rows = among(rows, leaks, "th", "unsure")
    return rows.where("not unsure").select("d.*").unionAll(rows.where("unsure").join(leaks, "th", "left_anti").select("d.*"))
