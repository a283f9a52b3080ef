"""Toxicity: a factorisation machine over hashed terms, which learns pairs such as an insult beside a group's name.

Terms are words and their beginnings of 4 to 7 bytes (inflected and compounded insults share one), hashed to 32 bits;
letters A-Z are lower-cased. Marked terms enter the model: those that documents labelled toxic hold far more often than
others, and those that tell toxic from other documents where only a doubtful term of the first kind is present. The latter may say
nothing alone; the pairwise part of the machine needs them. All other terms have weight zero, so that a long text is not
judged by the number of its words.

score = sigmoid(w0 + sum w_i + 1/2 sum_f [(sum_i v_if)^2 - sum_i v_if^2]) over the marked terms present: linear in their number.

Fitted on the rows of at most ``TRAIN_DOCS`` labelled ids whose crc32(doc_id as text) mod 3 is not 1 (the smallest hashes of
doc_id), and on at most ``TRAIN_DOCS`` rows where ids repeat; labels, lang, source and doc_id are never inputs. Terms are counted by
Spark over those rows, at most ``MARKED`` and ``CONTEXT`` of them kept; the driver gets terms and positions of marked terms, no texts.

Null and empty texts hold no term: their score is that of w0. Rows with a null doc_id are scored and not held out, and teach
nothing; a doc_id labelled twice counts as toxic if one label is 1. Without two label classes every score is the
share of label 1 (0.5 without labels), kept within 0.01 and 0.99. Repeated rows give repeated rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.classifier import fm, held_out
from quillstone.llm.common import LOWER, discard, id_text, materialize, sample_by_hash

TRAIN_DOCS, MARKED, CONTEXT = 20_000, 4096, 1024
STARTS = (4, 5, 6, 7)
#: Least number of documents with a term, and least standard score of its share of toxic ones.
LEAST_DOCS, LEAST_Z = 4, 5.0
#: Share of toxic rows from which a term decides alone; rows with such a term teach nothing about its neighbours.
SURE = 0.9
#: Smallest term hashes that tell copies of a text in the sample, which would else count as many documents.
SKETCH = 4
RANK, EPOCHS, BATCH, RATE, DECAY = 4, 100, 128, 0.2, 2e-5
THRESHOLD = 0.7
WORD = re.compile(rb"[a-z\x80-\xff]+")


def terms(text: str) -> np.ndarray:
    """Distinct hashes of a text's words and of their beginnings, in order."""
    words = set(WORD.findall(text.encode().translate(LOWER)))
    parts = set(words)
    for n in STARTS:
        parts.update([w[:n] for w in words if len(w) > n])
    return np.unique(np.fromiter(map(crc32, parts), np.int64, len(parts)))


def picked_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(y, text) of the rows of at most TRAIN_DOCS labelled ids; where a doc_id repeats they may be more."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("y"))
    some = F.broadcast(sample_by_hash(y.where(~held_out()), "doc_id", TRAIN_DOCS))
    return id_text(docs).join(some, "doc_id").select("y", "text")


def with_terms(rows: DataFrame) -> DataFrame:
    """(y, terms) of the picked rows; of those with the same smallest hashes, which are copies, one for each label."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = pa.array([terms(t).tolist() for t in b.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("y"), lists], ["y", "terms"])

    found = rows.mapInArrow(run, "y int, terms array<long>")
    return found.groupBy("y", F.slice("terms", 1, SKETCH).alias("_s")).agg(F.max("terms").alias("terms")).drop("_s")


def apart(n: Column, pos: Column, share: float) -> Column:
    """Standard score of a term's number of toxic documents, if terms fell on documents at random."""
    return (pos - n * share) / F.sqrt(n * share * (1 - share))


def marked_terms(rows: DataFrame, most: int, both_ways: bool = False) -> list[tuple[int, float]]:
    """At most ``most`` terms that lie furthest from the share of toxic rows, each with its own share, counted map-side before the shuffle."""
    total, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < pos < total:
        return []
    counted = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    z = apart(F.col("n"), F.col("pos"), pos / total)
    far = counted.withColumn("z", F.abs(z) if both_ways else z).where((F.col("n") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z))
    return [(r[0], r[1]) for r in far.orderBy(F.desc("z"), "term").limit(most).select("term", F.col("pos") / F.col("n")).collect()]


def present(vocabulary: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Positions in the sorted ``vocabulary`` of the terms found there."""
    if not len(vocabulary) or not len(found):
        return np.zeros(0, np.int64)
    at = np.searchsorted(vocabulary, found)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == found]


def fit(rows: list[tuple[np.ndarray, int]], size: int, rank: int = RANK) -> tuple[float, np.ndarray, np.ndarray]:
    """w0, w and v by stochastic gradients with steps scaled per weight. Each row gets a constant term of no weight, so none is empty."""
    rng = np.random.default_rng(11)
    w, v = np.zeros(size + 1), rng.normal(0, 0.05, (size + 1, rank))
    v[size] = 0
    y = np.array([r[1] for r in rows], float)
    p = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    w0 = float(np.log(p / (1 - p)))
    if len(set(y.tolist())) < 2:
        return w0, w, np.zeros_like(v)
    full = [np.append(r[0], size) for r in rows]
    g0, gw, gv = 1e-6, np.full(size + 1, 1e-6), np.full((size + 1, rank), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at : at + BATCH]
            idx, lens = np.concatenate([full[i] for i in part]), np.array([len(full[i]) for i in part])
            val, starts = np.ones(len(idx)), np.concatenate([[0], np.cumsum(lens)[:-1]])
            out, s, xv = fm(idx, val, starts, w0, w, v)
            d = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[part]
            e = np.repeat(d, lens) / len(part)
            uniq, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, e, len(uniq)) + DECAY * w[uniq]
            each = e[:, None] * (np.repeat(s, lens, 0) - xv)
            dv = DECAY * v[uniq]
            for f in range(rank):
                dv[:, f] += np.bincount(where, each[:, f], len(uniq))
            still = uniq == size
            dw[still], dv[still] = 0, 0
            g0 += d.mean() ** 2
            gw[uniq] += dw * dw
            gv[uniq] += dv * dv
            w0 -= RATE * d.mean() / np.sqrt(g0)
            w[uniq] -= RATE * dw / np.sqrt(gw[uniq])
            v[uniq] -= RATE * dv / np.sqrt(gv[uniq])
    return w0, w, v


def train(docs: DataFrame, labels: DataFrame, rank: int = RANK) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """The sorted marked terms and the machine over them. The driver gets marked terms only, never texts."""
    rows = materialize(with_terms(picked_rows(docs, labels)), "toxic-terms")
    first = marked_terms(rows, MARKED)
    has = lambda found: F.arrays_overlap("terms", F.array(*map(F.lit, found)).cast("array<long>"))
    unsure = rows.where(has([t for t, _ in first]) & ~has([t for t, share in first if share >= SURE]))
    near = marked_terms(unsure, CONTEXT, True) if first else []
    vocabulary = np.array(sorted({t for t, _ in first + near}), np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = pa.array([present(vocabulary, np.array(t, np.int64)).tolist() for t in b.column("terms").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("y"), lists], ["y", "at"])

    small = rows.mapInArrow(run, "y int, at array<int>")
    got = small.orderBy(F.xxhash64("at"), "at", "y").limit(TRAIN_DOCS).toArrow()  # cut before it is collected
    discard(rows)
    pairs = sorted((tuple(at), y) for at, y in zip(got.column("at").to_pylist(), got.column("y").to_pylist(), strict=True))
    return vocabulary, *fit([(np.array(at, np.int64), y) for at, y in pairs], len(vocabulary), rank)


def score(docs: DataFrame, model: tuple[np.ndarray, float, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; narrow."""
    vocabulary, w0, w, v = model

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = np.empty(b.num_rows)
            for i, t in enumerate(b.column("text").to_pylist()):
                at = present(vocabulary, terms(t))
                s = v[at].sum(0)
                out[i] = w0 + w[at].sum() + 0.5 * float((s * s - (v[at] ** 2).sum(0)).sum())
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    scored = id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
