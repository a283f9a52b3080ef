"""Exact substring removal by bucket-pointer refinement, distributed.

Classic refinement puts suffixes into q-gram buckets and splits a bucket by sorting on the bucket
identifiers found q, 2q, ... positions later, reusing identifiers already refined. Here identifiers are
fingerprints, so a later offset's identifier is computed where the text is and no pointer crosses the
network: b8 -> b16 -> b32 (initial q-gram bucket, q = 32), then b64[s] = (b32[s], b32[s+32]) and
b100[s] = (b64[s], b64[s+36]). Buckets with one suffix drop out of further refinement:

1. every 100-byte window is owned by the leftmost minimiser of its 32-grams, chosen by its content; the
   suffixes at minimisers go into 32-gram buckets, and buckets with one member end there;
2. the rest is refined by the identifier of all bytes that the owned windows cover (at most 168); all but
   the first member of such a context are repeats as a whole;
3. the first members of different contexts in one bucket are refined again, with the windows cut into
   cells of 12, 4 and 1 starts: a cell's bucket is the identifier of the bytes that all its windows share,
   its context that of the bytes they cover. Buckets with one context end, later members of a context are
   repeats, and only first members in split buckets reach the next level, so few windows are ever looked
   at one by one. Bucket and context together are 128 bits.

First means smallest (doc_id, start). All counts are hash aggregates, so a copied passage of any frequency
is combined before the shuffle and no group is gathered.

Null text is the empty text. Rows of a null doc_id keep all their bytes. Rows that repeat a doc_id and its text are one
document; with other texts they are documents of their own, ordered by a hash of the text. An empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import discard, id_text, materialize

LENGTH, Q = 100, 32
#: 32-grams of one window, and bytes of text that are worked on together.
WIDTH, CHUNK = LENGTH - Q + 1, 1 << 17
REACH = WIDTH - 1
U64 = np.uint64
#: Starts in a cell, level by level.
CELLS = (12, 4, 1)
SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def refine(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """Identifier of (bucket here, bucket at a later offset)."""
    h = a * U64(seed)
    h ^= h >> U64(32)
    h += b
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    return h


def grams(buf: bytes, seed: int) -> np.ndarray:
    """b32 of every position of ``buf`` with 32 bytes left; by doubling from 8-byte words."""
    n = len(buf) - 7
    word = np.ndarray((n,), "<u8", buf, strides=(1,))
    b8 = word * U64(seed)
    b8 ^= b8 >> U64(31)
    b16 = refine(b8[:-8], b8[8:], seed)
    return refine(b16[:-16], b16[16:], seed)


def b100(b32: np.ndarray, s: np.ndarray, seed: int) -> np.ndarray:
    return refine(refine(b32[s], b32[s + 32], seed), refine(b32[s + 36], b32[s + 68], seed), seed)


def sliding(v: np.ndarray, op) -> np.ndarray:
    """op over WIDTH consecutive values (WIDTH between 64 and 128)."""
    for j in (1, 2, 4, 8, 16, 32):
        v = op(v[:-j], v[j:])
    return op(v[: len(v) - (WIDTH - 64)], v[WIDTH - 64 :])


def chunks(docs: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, bytes]]]:
    part, size = [], 0
    for d in docs:
        if len(d[1]) >= LENGTH and d[0] is not None:
            part.append(d)
            size += len(d[1])
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def anchors_of(part: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
    """doc_id, place (start, and how far before it the first and last owned windows begin, in one number),
    bucket and context identifier of every owning minimiser of the texts (each of 100 bytes at least)."""
    buf = b"".join(t for _, t in part)
    ends = np.cumsum([len(t) for _, t in part])
    begins = ends - [len(t) for _, t in part]
    b32 = grams(buf, SEEDS[0])
    v = (b32 >> U64(33)).astype(np.uint32) + np.uint32(1)
    low = sliding(v, np.minimum)  # by window start
    for e in ends[:-1]:
        low[e - LENGTH + 1 : e] = 0  # windows that would cross into the next text have no owner
    pad = np.zeros(REACH, np.uint32)
    chosen = sliding(np.concatenate([pad, low, pad]), np.maximum) == v
    p = np.flatnonzero(chosen)
    s = np.flatnonzero(low)
    k = (np.cumsum(chosen, dtype=np.int32) - chosen)[s]  # first chosen place at or after each window's start
    wrong = np.flatnonzero(v[p[k]] != low[s])
    while len(wrong):
        k[wrong] += 1
        wrong = wrong[v[p[k[wrong]]] != low[s[wrong]]]
    edge = np.flatnonzero(np.diff(k)) + 1
    p, s1, s2 = p[k[np.append(0, edge)]], s[np.append(0, edge)], s[np.append(edge, len(s)) - 1]
    doc = np.searchsorted(ends, p, "right")
    ctx = refine(refine(b100(b32, s1, SEEDS[0]), b100(b32, s2, SEEDS[0]), SEEDS[1]), (p - s1).astype(U64) * U64(1000) + (s2 - s1).astype(U64), SEEDS[1])
    ids, at = np.array([d for d, _ in part], np.int64)[doc], begins[doc]
    return ids, (p - at) << 16 | (p - s1) << 8 | (p - s2), b32[p].view(np.int64), ctx.view(np.int64)


def documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): ``doc`` names a document and rises with doc_id. It is doc_id itself, unless a doc_id has several
    texts: then (doc_id, hash of the text) is numbered in order."""
    rows = id_text(docs).withColumn("th", F.xxhash64("text"))
    ids = materialize(rows.where("doc_id is not null").select("doc_id", "th").distinct(), "ids")
    if not ids.groupBy("doc_id").count().where("count > 1").limit(1).count():
        discard(ids)
        return rows.select("doc_id", "text", F.col("doc_id").alias("doc"))
    names = materialize(ids.orderBy("doc_id", "th").withColumn("doc", F.monotonically_increasing_id()), "names")
    return materialize(rows.join(names.hint("merge"), ["doc_id", "th"], "left").select("doc_id", "text", "doc"), "named")


def anchors(rows: DataFrame) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [(d, t.encode()) for d, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), strict=True)]
            for part in chunks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in anchors_of(part)], ["doc", "place", "h", "ctx"])

    return rows.select("doc", "text").mapInArrow(run, "doc long, place long, h long, ctx long")


def contexts(rows: DataFrame) -> DataFrame:
    """The bytes covered by the owned windows of the given minimisers (doc, text, places)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for d, t, places in zip(*(b.column(c).to_pylist() for c in ("doc", "text", "places")), strict=True):
                raw = t.encode()
                own = [(x["pos"], x["s1"], x["s2"]) for x in places if x["s2"] + LENGTH <= len(raw)]
                pos, s1, s2 = (pa.array([x[i] for x in own], pa.int32()) for i in range(3))
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(own), pa.int64()), pos, s1, s2, pa.array([raw[x[1] : x[2] + LENGTH] for x in own], pa.binary())], ["doc", "pos", "s1", "s2", "bytes"])

    return rows.mapInArrow(run, "doc long, pos int, s1 int, s2 int, bytes binary")


def cells(rows: DataFrame, width: int) -> DataFrame:
    """Cells of ``width`` starts, on a grid that counts from the minimiser: bucket, context, first and last start."""
    digest = xxhash.xxh3_64_intdigest

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for d, p, base, s1, s2, raw in zip(*(b.column(c).to_pylist() for c in ("doc", "pos", "base", "s1", "s2", "bytes")), strict=True):
                for c in range((p - s2) // width, (p - s1) // width + 1):
                    lo, hi = max(s1, p - c * width - width + 1), min(s2, p - c * width)
                    core = raw[p - c * width - base : p - c * width - width + 1 + LENGTH - base]
                    ctx = digest(raw[lo - base : hi + LENGTH - base], seed=(p - lo) * 128 + p - hi)
                    out.append((d, p, lo, hi, digest(core, seed=c) - (1 << 63), ctx - (1 << 63)))
            types = [pa.int64(), *[pa.int32()] * 3, pa.int64(), pa.int64()]
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], ["doc", "pos", "s1", "s2", "h", "ctx"])

    return rows.mapInArrow(run, "doc long, pos int, s1 int, s2 int, h long, ctx long")


def split(found: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """Refine buckets h by context: the bytes of repeats, the first members of contexts in split buckets, and the
    scratch table behind both."""
    heads = found.groupBy("h", "ctx").agg(F.min(F.struct("doc", "s1", "pos", "s2")).alias("first"), F.count("*").alias("n"))
    heads = heads if last else materialize(heads, "contexts")
    same = (F.col("first.doc") == F.col("doc")) & (F.col("first.s1") == F.col("s1"))
    again = found.join(heads.where("n > 1"), ["h", "ctx"]).where(~same).select("doc", F.col("s1").alias("start"), (F.col("s2") + LENGTH).alias("end"))
    if last:
        return again, None, None
    many = heads.groupBy("h").count().where("count > 1").select("h")
    return again, heads.join(many, "h", "left_semi").select("first.doc", "first.pos", "first.s1", "first.s2"), heads


def runs(found: DataFrame) -> DataFrame:
    """(doc, list of [start, end) removed): a document's own bytes bound the list."""
    return found.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def strip(rows: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document: sizes, digest of the bytes left, and, if asked for, those bytes."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for d, t, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans")), strict=True):
                raw = t.encode()
                parts, at, n, removed = [], 0, 0, 0
                for s, e in sorted((max(0, x["start"]), min(len(raw), x["end"])) for x in spans or ()):
                    if s >= e:
                        continue
                    if s > at or not n:
                        parts.append(raw[at:s])
                        n += 1
                    removed += max(0, e - max(s, at))
                    at = max(at, e)
                parts.append(raw[at:])
                kept = b"".join(parts)
                out.append((d, len(raw), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] * keep_text)))
            types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep_text
            cols = list(zip(*out, strict=True)) if out else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], [x.split()[0] for x in schema.split(", ")])

    return rows.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    rows = documents(docs)
    many = materialize(anchors(rows).groupBy("h").count().where("count > 1").select("h"), "buckets")
    shared = materialize(anchors(rows).join(many.hint("merge"), "h", "left_semi"), "shared")
    discard(many)
    pos = F.shiftright("place", 16).cast("int")
    unpacked = shared.select("doc", pos.alias("pos"), (pos - F.shiftright("place", 8).bitwiseAND(255).cast("int")).alias("s1"), (pos - F.col("place").bitwiseAND(255).cast("int")).alias("s2"), "h", "ctx")
    again, left, heads = split(unpacked)
    places = left.groupBy("doc").agg(F.collect_list(F.struct("pos", "s1", "s2")).alias("places"))
    around = materialize(contexts(rows.select("doc", "text").join(places.hint("merge"), "doc")), "around")
    repeats, open_, used = [again], around.withColumn("base", F.col("s1")), [shared, heads, around]
    for width in CELLS:
        level = materialize(cells(open_, width), f"cells{width}")
        again, left, heads = split(level, last=width == 1)
        repeats.append(again)
        used += [level] if heads is None else [level, heads]
        if left is not None:
            bytes_ = around.select("doc", "pos", F.col("s1").alias("base"), "bytes")
            open_ = left.join(bytes_, ["doc", "pos"])
    spans = materialize(runs(reduce(DataFrame.unionAll, repeats)), "spans")
    discard(*used)
    return strip(rows.join(spans.hint("merge"), "doc", "left").select("doc_id", "text", "spans"), keep_text)
