"""Target-distribution importance resampling by external sort-count over hashed words.

Documents become packed streams of 16-bit bucket numbers with document offsets, written once as Parquet. Counts: each
stream is sorted and run-length encoded where it lies, runs of a task are merged, and Spark adds the tasks' runs. The gains
of the buckets (at most ``BUCKETS`` numbers, a bound that does not depend on the data) go back to the streams, where a
document's weight is a segmented sum. Scores add Gumbel noise drawn from doc_id, so that the highest scores are a draw
without replacement; ranks come from ranges of scores, never from one task.

Null and empty texts have no words and weight 0. A null doc_id draws the noise of an empty id and sorts before others of an
equal score. Repeated rows are documents of their own, each with its rank; among rows equal in score and doc_id the order
is that of n_features and else arbitrary, as such rows are equal. Empty tables give no rows, an empty target gives
every bucket the gain of t = T = 0. Further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, discard, id_text, materialize, small_batches

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, 2024, 20, 10
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
STREAMS = "stream binary, offsets array<int>, doc_id array<long>"


def buckets(text: str) -> np.ndarray:
    """The bucket of each word of a text, in order, as uint16."""
    words = WORD.findall(text.encode().translate(LOWER))
    return (np.fromiter(map(crc32, words), np.int64, len(words)) % BUCKETS).astype("<u2")


def streams(docs: DataFrame) -> DataFrame:
    """One row for each batch of documents: their bucket streams end to end, where each begins and the end, and their ids."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            each = [buckets(t) for t in b.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)]).astype(np.int32)
            packed = np.concatenate([np.zeros(0, "<u2"), *each]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([ends], pa.list_(pa.int32())), pa.array([b.column("doc_id").to_pylist()], pa.list_(pa.int64()))], ["stream", "offsets", "doc_id"])

    return id_text(docs).mapInArrow(run, STREAMS)


def runs(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted and run-length encoded: the distinct values of a stream and how often each occurs."""
    s = np.sort(stream)
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[starts], np.diff(np.append(starts, len(s)))


def bucket_counts(packed: DataFrame) -> np.ndarray:
    """Occurrences of each bucket. A task hands on a row for each bucket at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in it:
            for s in b.column("stream"):
                value, n = runs(np.frombuffer(s.as_buffer(), "<u2"))
                total[value] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], ["bucket", "n"])

    counts = np.zeros(BUCKETS, np.int64)
    small_batches(packed.sparkSession)
    for r in packed.select("stream").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed target share over the smoothed source share) of each bucket."""
    s_all, t_all = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * (s_all + BUCKETS)) / (float(s + 1) * (t_all + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(packed: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_features and weight of each document in the streams."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for s, ends, ids in zip(b.column("stream"), b.column("offsets"), b.column("doc_id"), strict=True):
                at = np.asarray(ends.values, np.int64)
                n = np.diff(at)
                # one more gain of zero, so that an empty document at the end has a place to begin
                gathered = np.append(gains[np.frombuffer(s.as_buffer(), "<u2")], 0)
                weight = np.where(n > 0, np.add.reduceat(gathered, at[:-1]), 0) if len(n) else n
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(n), pa.array(weight, pa.int64())], ["doc_id", "n_features", "weight"])

    return packed.mapInArrow(run, "doc_id long, n_features long, weight long")


def noisy(weighted: DataFrame) -> DataFrame:
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weighted.withColumn("score", F.col("weight") + noise.cast("long"))


def drawn(scored: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` (written, with a number for each row in ``_n``) and the rank of the drawn rows: a row's place in its range of scores plus
    the rows of the ranges before it. Rows of one score and doc_id are told apart by ``_n``, so ranges can split them."""
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("_n")]
    fit = F.col("n_features") >= least
    places = scored.where(fit).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    places = materialize(places, "resampling-places")
    sizes = sorted((r[0], r[1]) for r in places.groupBy(F.shiftright("_at", 33)).count().collect())  # one row for each range
    before, total = [], 0
    for part, n in sizes:
        before.append((part, total))
        total += n
    starts = F.broadcast(scored.sparkSession.createDataFrame(before or [(0, 0)], "_part long, _before long"))
    place = places.join(starts, F.shiftright("_at", 33) == F.col("_part"), "left")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = place.select(*columns, F.when(rank <= percent * total // 100, rank).alias("rank"))
    return ranked.unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every document's n_features, weight, score and, where drawn, rank."""
    packed = materialize(streams(docs), "resampling-streams")
    aim = streams(target.select(F.lit(0).alias("doc_id"), "text"))
    gains = bucket_gains(bucket_counts(packed), bucket_counts(aim))
    scored = materialize(noisy(weights(packed, gains)).withColumn("_n", F.monotonically_increasing_id()), "resampling-scores")
    discard(packed)
    return drawn(scored)


def oracle() -> str:
    """The same in DuckDB; crc32 is folded over bytes with a table made from its polynomial, once for each distinct word."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
words AS (SELECT k, unnest(w) AS word FROM d),
bytes AS (SELECT word, list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS x FROM (SELECT word FROM words UNION SELECT word FROM b)),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, x), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]))) % {BUCKETS} AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS n FROM words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN hashed USING (word) GROUP BY bucket),
tot AS (SELECT (SELECT count(*) FROM words)::DOUBLE AS s_all, (SELECT count(*) FROM b)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {BUCKETS})) / ((s.n + 1)::DOUBLE * (t_all + {BUCKETS}))))::BIGINT AS g FROM s LEFT JOIN t USING (bucket), tot),
weight AS (SELECT k, sum(g)::BIGINT AS weight FROM words JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY k),
scored AS (
  SELECT k, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM d LEFT JOIN weight USING (k)),
ranks AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= {PERCENT} * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (k)
"""
