"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), linear in the
number of features. Fitted on at most ``TRAIN_DOCS`` labelled documents (the smallest hashes of doc_id)
whose crc32(doc_id as text) mod 3 is not 1; labels, lang, source and doc_id are never inputs.

Null and empty texts are scored by their statistics alone. Rows with a null doc_id are scored and not
held out. Without two label classes to learn from every score is the share of label 1 (0.5 without
labels). Repeated rows give repeated rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, id_text, sample_by_hash

TRAIN_DOCS, DIM, RANK, EPOCHS, BATCH, RATE = 4000, 1 << 15, 8, 5, 64, 0.08
BINS = 8
STATS = 10
SIZE = DIM + STATS * BINS


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 3 == 1, F.lit(False))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of one text: distinct hashed words (unit length together), one bin of each statistic."""
    raw = text.encode()
    words = raw.translate(LOWER).split()
    n, size = max(1, len(words)), max(1, len(raw))
    bare = raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    distinct = set(words)
    ratios = (
        np.log2(size) / 20,
        np.log2(n) / 16,
        (size - len(bare)) / size * 4,
        (len(raw) - len(raw.translate(None, b"#*$%&|<>"))) / size * 8,
        raw.count(b"!") / n,
        len(distinct) / n,
        (size / n) / 16,
        raw.count(b"|") / n,
        min(1.0, raw.count(b"\n") / n * 8),
        (len(raw) - len(text)) / size * 4,
    )
    stats = [DIM + i * BINS + min(BINS - 1, int(r * BINS)) for i, r in enumerate(ratios)]
    # sorted: the sum of the values must not depend on the order of a set
    idx = np.fromiter(sorted({crc32(w) & (DIM - 1) for w in distinct}), np.int64)
    val = np.full(len(idx) + STATS, 1 / np.sqrt(max(1, len(idx))), np.float32)
    val[len(idx) :] = 0.5
    return np.concatenate([idx, np.array(stats, np.int64)]), val


def fm(idx: np.ndarray, val: np.ndarray, starts: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    xv = v[idx] * val[:, None]
    s = np.add.reduceat(xv, starts)
    y = w0 + np.add.reduceat(w[idx] * val, starts) + 0.5 * (s * s - np.add.reduceat(xv * xv, starts)).sum(1)
    return y, s, xv


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    w, v = np.zeros(SIZE, np.float32), rng.normal(0, 0.05, (SIZE, RANK)).astype(np.float32)
    y = np.array([r[2] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return float(np.log(p / (1 - p))), w, np.zeros_like(v)
    w0, g0, gw, gv = 0.0, 1e-6, np.full(SIZE, 1e-6, np.float32), np.full((SIZE, RANK), 1e-6, np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = [rows[i] for i in order[at : at + BATCH]]
            idx, val = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            lens = np.array([len(r[0]) for r in part])
            starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
            out, s, xv = fm(idx, val, starts, w0, w, v)
            d = (1 / (1 + np.exp(-out)) - np.array([r[2] for r in part])) / len(part)
            e = np.repeat(d, lens).astype(np.float32)
            uniq, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, e * val, len(uniq)).astype(np.float32) + 1e-5 * w[uniq]
            each = (e * val)[:, None] * (np.repeat(s, lens, 0) - xv)
            dv = np.stack([np.bincount(where, each[:, f], len(uniq)) for f in range(RANK)], 1).astype(np.float32) + 1e-4 * v[uniq]
            g0 += d.sum() ** 2
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            w0 -= RATE * d.sum() / np.sqrt(g0)
            w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
            v[uniq] -= RATE * dv / np.sqrt(gv[uniq])
    return float(w0), w, v


def train(docs: DataFrame, labels: DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
    """Fit on the bounded sample; a document has at most DIM hashed words."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    picked = F.broadcast(sample_by_hash(marked.where(~held_out()), "doc_id", TRAIN_DOCS))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            f = [features(t)[0].astype(np.int32).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(f, pa.list_(pa.int32()))], ["doc_id", "y", "idx"])

    found = id_text(docs).join(picked, "doc_id").mapInArrow(run, "doc_id long, y int, idx array<int>")
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id", "idx").limit(TRAIN_DOCS).toArrow()  # cut before it is collected
    rows = []
    for doc, y, idx in zip(*(got.column(c).to_numpy() for c in ("doc_id", "y", "idx")), strict=True):
        val = np.full(len(idx), 1 / np.sqrt(max(1, len(idx) - STATS)), np.float32)
        val[len(idx) - STATS :] = 0.5
        rows.append((doc, tuple(idx[:9]), np.asarray(idx, np.int64), val, int(y)))
    rows.sort(key=lambda r: r[:2])
    return fit([r[2:] for r in rows[:TRAIN_DOCS]])


def score(docs: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    w0, w, v = model

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for t in b.column("text").to_pylist():
                idx, val = features(t)
                xv = v[idx] * val[:, None]
                s = xv.sum(0)
                out.append(w0 + float(w[idx] @ val) + 0.5 * float((s * s).sum() - (xv * xv).sum()))
            p = 1 / (1 + np.exp(-np.array(out, np.float64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
