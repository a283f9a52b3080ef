"""Context-memory operators over entries.

An entry has id, session, pos, content, score, ts_ms, ttl_s, access_count, critical and tags; operators
take the columns they need. ``pos`` makes every order total.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone import functions as Q
from quillstone.operators.store import materialize, spread, squeezed

#: Entries and characters of one group, rows and terms of one dense tile, and pairs of rows whose products are summed at once, of the blocked comparison.
GROUP_ROWS, GROUP_CHARS, TILE_ROWS, TILE_TERMS, TILE_CELLS = 6144, 1 << 25, 256, 2048, 1 << 22
#: How many dense products cost as much as one along postings; pairs in a batch.
DENSE, PAIRS_BATCH = 500, 1 << 16
#: Characters of text whose terms meet in one task; hash of the term that stands for a group.
BUCKET_CHARS, GROUP_TERM = 1 << 27, 0x5851F42D4C957F2D


def document_frequency(entries: DataFrame, content: str = "content", by: list[str] | None = None) -> DataFrame:
    """(by..., term, df): entries that hold a term."""
    return entries.select(*(by or []), F.explode(F.array_distinct(Q.tokens(F.col(content)))).alias("term")).groupBy(*(by or []), "term").agg(F.count("*").alias("df"))


def counted(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of the distinct terms of a lower-cased text, and their counts: ``bytes.split`` splits as the
    JVM's ``\\s+``."""
    n = Counter(text.split())
    t = np.fromiter(map(xxhash.xxh3_64_intdigest, n), np.uint64, len(n)).view(np.int64)
    order = np.argsort(t)
    return t[order], np.fromiter(n.values(), np.int32, len(n))[order]


def term_pieces(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, k, m, t, c) of rows (k, g, x): the terms of some rows that fall into a bucket, packed. ``k`` are the keys of the rows and
    ``m`` how many terms of each follow in ``t`` (hash of term and group) and ``c`` (count). One more term of each row, of
    count 0, stands for its group."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys, groups = (batch.column(x).to_numpy() for x in ("k", "g"))
            got = [counted(x) for x in batch.column("x").to_pylist()]
            n = np.array([len(t) + 1 for t, _ in got])
            t = np.concatenate([x for g, (terms, _) in zip(groups, got, strict=True) for x in ([g ^ GROUP_TERM], terms ^ g)])
            c = np.concatenate([x for _, counts in got for x in (np.zeros(1, np.int32), counts)])
            bucket, row = (t.view(np.uint64) >> np.uint64(33)) % np.uint64(buckets), np.repeat(np.arange(len(n)), n)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            out = []
            for b in range(buckets):
                at = order[ends[b] : ends[b + 1]]
                if len(at):
                    r, m = np.unique(row[at], return_counts=True)
                    out.append((b, *(x.tobytes() for x in (keys[r], m.astype(np.int32), t[at], c[at]))))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "k", "m", "t", "c"])

    return rows.mapInArrow(run, "bucket int, k binary, m binary, t binary, c binary")


def term_sums(pieces: DataFrame) -> DataFrame:
    """(k, roots, weighed, terms, total) of each row of each piece, dealt so that a task has whole buckets: the sums, over the row's terms there, of
    sqrt(count), of sqrt(count) ln(df) and of the count; ``total`` is the ln of the group's number of rows where its own term lies, else 0."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_pylist() for c in b.columns] for b in it]
        if not parts:
            return
        k, m, t, c = (np.frombuffer(b"".join(x for p in parts for x in p[i]), d) for i, d in enumerate((np.int64, np.int32, np.int64, np.int32)))
        del parts
        _, at, df = np.unique(t, return_inverse=True, return_counts=True)
        logs, roots, starts = np.log(df)[at], np.sqrt(c), np.cumsum(m) - m
        sums = [np.add.reduceat(x, starts) for x in (roots, roots * logs, c.astype(np.int64), np.where(c == 0, logs, 0.0))]
        for x in range(0, len(k), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(y[x : x + (1 << 16)]) for y in (k, *sums)], ["k", "roots", "weighed", "terms", "total"])

    return pieces.select("k", "m", "t", "c").mapInArrow(run, "k long, roots double, weighed double, terms long, total double")


def tfidf(entries: DataFrame, by: list[str] | None = None, content: str = "content") -> DataFrame:
    """Adds ``tfidf``: sum over distinct terms of sqrt(count) ln(N / df), over the number of terms.

    Terms are counted inside each row and shuffled once, as packed 64-bit hashes, to the bucket of the term, where all its rows meet and
    df is known. As ln(N / df) = ln N - ln df, what a row gets from a bucket is a few sums, so neither the index nor the scores are
    joined with the terms. A bucket holds the terms of about BUCKET_CHARS characters of text.
    """
    by = by or []
    grouped = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by], F.lit(True))
    texts = entries.where(grouped).select(F.xxhash64(*by, "id").alias("k"), (F.xxhash64(*by) if by else F.lit(0).cast("long")).alias("g"), F.lower(F.coalesce(content, F.lit(""))).cast("binary").alias("x"))
    chars = entries.agg(F.sum(F.length(content))).first()[0] or 0
    buckets = max(entries.sparkSession.sparkContext.defaultParallelism, math.ceil(chars / BUCKET_CHARS))
    sums = term_sums(term_pieces(texts, buckets).repartitionById(buckets, F.col("bucket")))
    row = sums.groupBy(F.col("k").alias("_k")).agg(*[F.sum(x).alias(x) for x in ("roots", "weighed", "terms")], F.max("total").alias("total"))
    score = (F.col("total") * F.col("roots") - F.col("weighed")) / F.col("terms")
    scored = row.where("terms > 0").select("_k", (F.greatest(F.lit(0.0), score) + F.lit(0.0)).alias("tfidf"))
    keyed = entries.withColumn("_k", F.when(grouped & F.col("id").isNotNull(), F.xxhash64(*by, "id")))
    return keyed.join(scored, "_k", "left").select(*entries.columns, F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def sparse_prune(entries: DataFrame, percent: float = 5.0, by: list[str] | None = None) -> DataFrame:
    """Adds ``kept``: the best max(1, ceil(n percent / 100)) entries of a group by TF-IDF, ties by pos.

    Keys and scores are written once, dealt by ranges of (group, score, pos), so a group that holds a third of all rows,
    or one score that many copies share, lies in many chunks. A row's rank is its rank in the chunk plus the
    rows of its group in earlier chunks; only the counts of chunks meet in a window over a group.
    """
    by = by or []
    scored = tfidf(entries, by).select(*by, "id", "pos", F.round("tfidf", 6).alias("tfidf"))
    dealt = materialize(scored.repartitionByRange(*by, F.desc("tfidf"), "pos").withColumn("_p", F.spark_partition_id()))
    c = dealt.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    total = F.sum("_n").over(group)
    before = F.sum("_n").over(group.orderBy("_p")) - F.col("_n")
    c = c.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_p").alias("_q"), before.alias("_before"), F.greatest(F.lit(1), F.ceil(total * percent / 100)).alias("_most"))
    r = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_p").orderBy(F.desc("tfidf"), "pos")))
    cond = r["_p"] == c["_q"]
    for k in by:
        cond = cond & r[k].eqNullSafe(c[f"_{k}"])
    ranked = r.join(c, cond).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("id").alias("_id"), F.col("pos").alias("_pos"), "tfidf", (F.col("_before") + F.col("_r") <= F.col("_most")).alias("kept"))
    cond = entries["id"].eqNullSafe(ranked["_id"]) & entries["pos"].eqNullSafe(ranked["_pos"])
    for k in by:
        cond = cond & entries[k].eqNullSafe(ranked[f"_{k}"])
    return entries.join(ranked, cond).select(*[entries[k] for k in entries.columns], "tfidf", "kept")


def greedy_scan(rows: Iterator[tuple], budget: float, share: float = 0.8) -> Iterator[tuple]:
    """(group, id, kept) of rows (group, critical, id, tokens), sorted by group with critical ones first.

    A critical row is taken if it still fits into the share of the budget, another one if it fits into the budget. If no
    critical one was taken, the first of them is. Only the state of one group is held.
    """
    for key, part in groupby(rows, key=lambda r: r[0]):
        used, first = 0, None
        for urgent, rs in groupby(part, key=lambda r: r[1]):
            taken = False
            for _, _, i, n in rs:
                fits = used + n <= (share * budget if urgent else budget)
                used, taken = used + n * fits, taken or fits
                if urgent and first is None and not fits:
                    first = (i, n)  # its turn comes when the others are known
                    continue
                yield key, i, fits
            if urgent and first:
                yield key, first[0], not taken
                used += 0 if taken else first[1]


def budget_prune(entries: DataFrame, budget: int, by: list[str], now_ms: int) -> DataFrame:
    """Adds tokens, priority and kept. Per session: critical entries, newest first, into 80 % of the budget (if none
    fits, the newest is forced in); then the others by priority while they fit.

    Sessions are sorted within their partitions and scanned, keys and sizes alone: memory does not grow with a session.
    ``id`` is unique within a session.
    """
    e = tfidf(entries, by)
    score = Q.engram_score(F.col("score"), F.lit(now_ms) - F.col("ts_ms"), F.col("ttl_s"), F.col("access_count"), F.col("critical"))
    st = Q.state(F.col("score"), F.col("critical"))
    e = e.withColumn("tokens", Q.token_estimate(F.col("content"))).withColumn("priority", F.round(F.col("tfidf") * score * Q.state_multiplier(st, F.col("critical")), 9))
    order = F.when(F.col("critical"), F.col("ts_ms").cast("double")).otherwise(F.col("priority"))
    keys = e.select(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(by)]).alias("_g"), "critical", order.alias("_o"), "pos", "id", "tokens")
    keys = keys.withColumn("_g", F.to_json("_g", {"ignoreNullFields": "false"})).repartition("_g").sortWithinPartitions("_g", F.desc("critical"), F.desc("_o"), "pos").select("_g", "critical", "id", "tokens")
    field = "bigint" if e.schema["id"].dataType.simpleString() == "bigint" else "string"
    kinds = [pa.string(), pa.int64() if field == "bigint" else pa.string(), pa.bool_()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        done = greedy_scan(rows, budget)
        while part := list(islice(done, 8192)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), kinds, strict=True)], ["_h", "_id", "kept"])

    taken = keys.withColumn("id", F.col("id").cast(field)).mapInArrow(scan, f"_h string, _id {field}, kept boolean")
    e = e.withColumn("_h2", F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(by)]), {"ignoreNullFields": "false"}))
    return e.join(taken, (e["_h2"] == taken["_h"]) & e["id"].cast(field).eqNullSafe(taken["_id"])).drop("_h", "_h2", "_id")


def hybrid_evict(entries: DataFrame, window: int, by: list[str]) -> DataFrame:
    """Adds hybrid and kept: 0.4 min-max recency + 0.6 score, critical 2; the best ``window`` of a session stay."""
    w = Window.partitionBy(*by)
    lo, span = F.min("ts_ms").over(w), F.max("ts_ms").over(w) - F.min("ts_ms").over(w)
    recency = (F.col("ts_ms") - lo) / F.when(span == 0, 1).otherwise(span)
    h = entries.withColumn("hybrid", F.when(F.col("critical"), 2.0).otherwise(0.4 * recency + 0.6 * F.col("score")))
    return h.withColumn("kept", F.row_number().over(w.orderBy(F.desc(F.round("hybrid", 9)), F.desc("ts_ms"), "pos")) <= window)


def query(entries: DataFrame, state: str | None = None, low: float | None = None, high: float | None = None, critical: bool | None = None, tags: list[str] | None = None, limit: int = 0, offset: int = 0) -> DataFrame:
    """Conjunctive filter, best score first. A limit of 0 means none; the offset counts only with a limit."""
    preds = []
    if state is not None:
        preds.append(F.col("state") == state)
    if low is not None:
        preds.append(F.col("score") >= low)
    if high is not None:
        preds.append(F.col("score") <= high)
    if critical is not None:
        preds.append(F.col("critical") == critical)
    preds += [F.array_contains("tags", t) for t in tags or []]
    for p in preds:
        entries = entries.where(p)
    if not limit:
        return entries
    return entries.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def get(entries: DataFrame, id_) -> DataFrame:
    """The entry of that id, or no row."""
    return entries.where(F.col("id") == id_)


def keys(entries: DataFrame) -> DataFrame:
    return entries.select("id")


def refresh_ttl(entries: DataFrame, now_ms: int, hours: int = 24) -> DataFrame:
    """Entries that live anew from now on."""
    return entries.withColumns({"ttl_s": F.lit(hours * 3600).cast("long"), "ts_ms": F.lit(now_ms).cast("long")})


def compact(entries: DataFrame, now_ms: int) -> DataFrame:
    """Entries that outlive their ttl or have decayed to 0.95 go; critical ones stay."""
    dead = (F.col("ttl_s") <= 0) | (F.col("ts_ms") + F.col("ttl_s") * 1000 < now_ms) | (Q.decay(F.lit(now_ms) - F.col("ts_ms"), F.col("ttl_s")) >= 0.95)
    return entries.where(F.col("critical") | ~dead)


def exact_groups(entries: DataFrame, content: str = "content") -> DataFrame:
    """Members of groups of equal content: hash, size, first id."""
    hashed = entries.select("id", F.sha2(F.coalesce(content, F.lit("")), 256).alias("hash"))
    return hashed.groupBy("hash").agg(F.count("*").alias("size"), F.min("id").alias("first_id")).where("size > 1")


#: Most frequent terms whose order is known to every task; postings of one term that meet in one task.
FREQUENT, POSTINGS_BLOCK = 20_000, 2_000
#: Bytes of a vector's outline, and how many of the most frequent terms have one to themselves.
OUTLINE, OWN = 512, 128


def text_vectors(entries: DataFrame, content: str) -> DataFrame:
    """(id, t, c) of the entries with a term: their sorted 64-bit term hashes and the counts, packed; narrow."""
    texts = entries.select("id", F.lower(content).cast("binary").alias("x")).where("x is not null")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = [counted(x) for x in batch.column("x").to_pylist()]
            rows = pa.RecordBatch.from_arrays([batch.column("id"), pa.array([t.tobytes() for t, _ in got], pa.binary()), pa.array([c.tobytes() for _, c in got], pa.binary())], ["id", "t", "c"])
            yield rows.filter(pa.array([len(t) > 0 for t, _ in got], pa.bool_()))

    return texts.mapInArrow(run, f"id {entries.schema['id'].dataType.simpleString()}, t binary, c binary")


def outline(t: np.ndarray, c: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Norms of the parts of a unit vector, rounded up to 255ths; ``rank``: 1 for the most frequent term, 0 if unknown.

    Each of the most frequent terms is a part, others fall into parts by hash. The product of two outlines is never
    under the cosine of the vectors (Cauchy and Schwarz, part by part).
    """
    part = np.where((rank > 0) & (rank <= OWN), rank - 1, OWN + t % (OUTLINE - OWN))
    return np.ceil(255 * np.sqrt(np.bincount(part, c * c, OUTLINE) / (c @ c)) - 1e-9).clip(0, 255).astype(np.uint8)


def prefixes(vec: DataFrame, common: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """(id, term, w, after, part) of each vector's prefix: rare terms by hash, then those of ``common`` (sorted hashes and their ranks), up to where what follows has a norm under the threshold. ``w`` is the term's share of the unit
    vector, ``after`` the squared norm of what follows it, ``part`` the vector's outline."""
    hashes, ranks = common

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, terms, ws, afters, parts = [], [], [], [], []
            for k, (t, c) in enumerate(zip(batch.column("t"), batch.column("c"), strict=True)):
                t, c = np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int32).astype(float)
                at = np.minimum(np.searchsorted(hashes, t), max(0, len(hashes) - 1))
                known = hashes[at] == t if len(hashes) else np.zeros(len(t), bool)
                rank = np.where(known, ranks[at] if len(hashes) else 0, -1)
                parts.append(outline(t, c, np.where(known, len(hashes) + 1 - rank, 0)).tobytes())
                order = np.lexsort((t, rank))
                t, c = t[order], c[order]
                sq = c * c / (c @ c)
                left = np.cumsum(sq[::-1])[::-1]
                n = int(np.searchsorted(-left, -(threshold * threshold - 1e-9), side="right"))
                ids.append(np.full(n, k))
                terms.append(t[:n])
                ws.append(np.sqrt(sq[:n]))
                afters.append((left - sq)[:n])
            at = pa.array(np.concatenate([np.zeros(0, np.int64), *ids]).astype(np.int64))
            cols = [pa.array(np.concatenate([np.zeros(0, d), *x])) for x, d in ((terms, np.int64), (ws, float), (afters, float))]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), *cols, pa.array(parts, pa.binary()).take(at)], ["id", "term", "w", "after", "part"])

    return vec.mapInArrow(run, f"id {vec.schema['id'].dataType.simpleString()}, term long, w double, after double, part binary")


def meetings(dealt: DataFrame, threshold: float) -> DataFrame:
    """(i, j, w, after_i, after_j) of the postings (term, a, b, block, id, w, after, part), sorted by (term, a, b, id), that meet in a
    pair of blocks and whose outlines can reach the threshold. A task holds two blocks."""
    kind = dealt.schema["id"].dataType.simpleString()

    def compare(part: np.ndarray, first: np.ndarray, one: bool) -> tuple[np.ndarray, np.ndarray]:
        part = part.astype(np.float32)
        x, y = np.nonzero(first)[0], np.nonzero(first if one else ~first)[0]
        k, m = np.nonzero(part[x] @ part[y].T >= 255 * 255 * (threshold - 1e-9))  # whole numbers under 2^24: exact
        i, j = np.minimum(x[k], y[m]), np.maximum(x[k], y[m])
        return (i[x[k] < y[m]], j[x[k] < y[m]]) if one else (i, j)

    def met(t: pa.Table, starts: np.ndarray, low: np.ndarray, one: np.ndarray) -> pa.RecordBatch:
        part = np.frombuffer(b"".join(t.column("part").to_pylist()), np.uint8).reshape(-1, OUTLINE)
        pairs = [(np.zeros(0, np.int64),) * 2]
        for at, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if end - at > 1:
                pairs.append(tuple(at + x for x in compare(part[at:end], low[at:end], bool(one[at]))))
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ids, w, after = t.column("id").combine_chunks(), t.column("w").to_numpy(), t.column("after").to_numpy()
        out = pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j)), pa.array(w[i] * w[j]), pa.array(after[i]), pa.array(after[j])], ["i", "j", "w", "after_i", "after_j"])
        return out.filter(pc.not_equal(out.column("i"), out.column("j")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in it:
            t = pa.Table.from_batches([*rest, batch])
            key = np.stack([t.column(c).to_numpy() for c in ("term", "a", "b")])
            starts = np.concatenate([[0], np.nonzero((key[:, 1:] != key[:, :-1]).any(0))[0] + 1])
            if len(starts) > 1:
                yield met(t.slice(0, starts[-1]), starts, t.column("block").to_numpy() == key[1], key[1] == key[2])
            rest = t.slice(starts[-1]).to_batches()
        if rest:
            t = pa.Table.from_batches(rest)
            yield met(t, np.array([0, t.num_rows]), t.column("block").to_numpy() == t.column("a").to_numpy(), t.column("a").to_numpy() == t.column("b").to_numpy())

    return dealt.mapInArrow(run, f"i {kind}, j {kind}, w double, after_i double, after_j double")


def cosine_pairs(entries: DataFrame, threshold: float = 0.85, content: str = "content") -> DataFrame:
    """(i, j, similarity), i < j, for bag-of-words cosine >= threshold; terms are 64-bit hashes.

    Prefix filtering over one order of all terms, rare ones first: a pair can reach the threshold only if the prefixes whose
    remaining norm is not under the threshold share a term. Postings of a hot term are dealt in blocks. Postings carry an
    outline of their vector, so only pairs whose outlines can reach the threshold leave the task in which they meet. Such a pair is kept only if the
    products over the terms met so far and the norms of what follows the last of them can reach the threshold; only such pairs fetch
    their vectors.
    """
    vec = materialize(text_vectors(entries.where("id is not null"), content))
    kind, parts = entries.schema["id"].dataType.simpleString(), int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            t, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("t"))]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["term", "n"])

    df = vec.select("t").mapInArrow(explode, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    top = [r.term for r in df.where("n > 1").orderBy(F.desc("n"), "term").limit(FREQUENT).collect()]  # a top-k, whatever the vocabulary
    order = np.argsort(np.array(top, np.int64))
    p = materialize(prefixes(vec, (np.array(top, np.int64)[order], (len(top) - order).astype(np.int64)), threshold))
    hot = p.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") > POSTINGS_BLOCK).select("term", F.ceil(F.col("n") / POSTINGS_BLOCK).cast("int").alias("blocks"))
    p = p.join(F.broadcast(hot), "term", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # a row for each 2,000 postings at most
    p = p.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = p.select("term", F.least("block", "o").alias("a"), F.greatest("block", "o").alias("b"), "block", "id", "w", "after", "part")
    met = meetings(dealt.repartition(parts, "term", "a", "b").sortWithinPartitions("term", "a", "b", "id"), threshold).groupBy("i", "j")
    bound = F.sum("w") + F.sqrt(F.greatest(F.lit(0.0), F.min("after_i")) * F.greatest(F.lit(0.0), F.min("after_j")))
    cand = met.agg(bound.alias("most")).where(F.col("most") >= threshold - 1e-9).select("i", "j")
    both = cand.join(vec.toDF("i", "t_i", "c_i"), "i").join(vec.toDF("j", "t_j", "c_j"), "j")

    def cosines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sims = []
            for t, c, u, d in zip(*(batch.column(k) for k in ("t_i", "c_i", "t_j", "c_j")), strict=True):
                t, u = np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(u.as_buffer(), np.int64)
                c, d = np.frombuffer(c.as_buffer(), np.int32).astype(float), np.frombuffer(d.as_buffer(), np.int32).astype(float)
                at = np.minimum(np.searchsorted(u, t), len(u) - 1)
                same = u[at] == t
                sims.append(float(c[same] @ d[at[same]]) / (np.sqrt(c @ c) * np.sqrt(d @ d)))
            yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("j"), pa.array(sims, pa.float64())], ["i", "j", "similarity"])

    return both.select("i", "j", "t_i", "c_i", "t_j", "c_j").mapInArrow(cosines, f"i {kind}, j {kind}, similarity double").where(F.col("similarity") >= threshold)


def by_norm(ids: np.ndarray, n: np.ndarray, term: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ids and norms of rows of ``n`` entries each, short vectors first, and the row, term and count of each of their entries."""
    c = c.astype(float)
    norm = np.sqrt(np.bincount(np.repeat(np.arange(len(n)), n), c * c, len(n)))
    order = np.argsort(norm, kind="stable")
    place = np.empty(len(n), np.int64)
    place[order] = np.arange(len(n))
    row = np.repeat(place, n)
    entry = np.argsort(row, kind="stable")
    return ids[order], norm[order], row[entry], term[entry], c[entry]


def flat_rows(ids: list[int], terms: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``by_norm`` of rows whose terms and counts are packed."""
    n = np.array([len(x) // 8 for x in terms], np.int64)
    return by_norm(np.array(ids, np.int64), n, np.frombuffer(b"".join(terms), np.int64), np.frombuffer(b"".join(counts), np.int32))


def compare_groups(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...] | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, similarity) of the rows ``a`` with those of ``b`` (None: of ``a`` among themselves), tile by tile.

    Terms that many rows of both sides hold are multiplied as dense matrices, the others along their postings. Dots are sums of
    whole numbers: exact in single precision while the product of two norms is under 2^24, and in double precision otherwise.
    """
    ids, norm, row, term, c = a
    ids2, norm2, row2, term2, c2 = other = a if b is None else b
    vocab, at2, n2 = np.unique(other[3], return_inverse=True, return_counts=True)
    at = np.minimum(np.searchsorted(vocab, term), len(vocab) - 1)
    shared = vocab[at] == term
    row, at, c = row[shared], at[shared], c[shared]
    weight = np.bincount(at, minlength=len(vocab)) * n2
    hot = np.nonzero(weight * DENSE > len(ids) * len(ids2))[0]
    hot = hot[np.argsort(-weight[hot], kind="stable")[:TILE_TERMS]]
    place = np.full(len(vocab), -1)
    place[hot] = np.arange(len(hot))

    def dense(rows: np.ndarray, terms: np.ndarray, counts: np.ndarray, height: int) -> np.ndarray:
        m, k = np.zeros((height, len(hot)), np.float32), place[terms] >= 0
        m[rows[k], place[terms[k]]] = counts[k]
        return m

    right = dense(row2, at2, c2, len(ids2))
    rare = place[at2] < 0
    by_term = np.argsort(at2[rare], kind="stable")
    posted_row, posted_c = row2[rare][by_term], c2[rare][by_term]
    posted_n = np.bincount(at2[rare], minlength=len(vocab))
    posted_at = np.cumsum(posted_n) - posted_n
    ends = np.searchsorted(row, np.arange(len(ids) + 1))
    step = max(1, min(TILE_ROWS, TILE_CELLS // len(ids2)))
    for low in range(0, len(ids), step):
        high = min(len(ids), low + step)
        r, t, w = row[ends[low] : ends[high]] - low, at[ends[low] : ends[high]], c[ends[low] : ends[high]]
        left, exact = dense(r, t, w, high - low), int(np.searchsorted(norm2 * norm[high - 1], 1 << 24))
        dot = np.empty((high - low, len(ids2)))
        dot[:, :exact] = left @ right[:exact].T
        for y in range(exact, len(ids2), TILE_ROWS):
            dot[:, y : y + TILE_ROWS] = left.astype(float) @ right[y : y + TILE_ROWS].astype(float).T
        k = place[t] < 0
        r, t, w = r[k], t[k], w[k]
        upto = np.cumsum(posted_n[t])
        x = 0
        while x < len(t):  # so many entries at once as have TILE_CELLS products
            y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + TILE_CELLS, side="right")))
            n = posted_n[t[x:y]]
            entry = np.repeat(posted_at[t[x:y]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            cell = np.repeat(r[x:y] * len(ids2), n) + posted_row[entry]
            dot += np.bincount(cell, np.repeat(w[x:y], n) * posted_c[entry], dot.size).reshape(dot.shape)
            x = y
        dot /= norm[low:high, None] * norm2
        i, j = np.nonzero(dot >= threshold)
        if b is None:
            i, j = i[low + i < j], j[low + i < j]
        one, two = ids[low + i], ids2[j]
        yield np.minimum(one, two), np.maximum(one, two), dot[i, j]


#: Columns of packed rows: their ids, the digests of their texts, how many entries each has, the distinct terms of all, and each entry's place among these (as steps from
#: the entry before) and count.
PACKED = {"ids": np.int64, "digests": "V32", "n": np.int32, "vocab": np.int64, "steps": np.int32, "c": np.int32}


def packed_rows(ids: np.ndarray, digests: np.ndarray, n: np.ndarray, term: np.ndarray, c: np.ndarray) -> list[bytes]:
    """Rows as the columns of PACKED, squeezed."""
    vocab, at = np.unique(term, return_inverse=True)
    cols = ids, digests, n, vocab, np.diff(at, prepend=0), c
    return [squeezed(x.astype(d, copy=False).tobytes()) for x, d in zip(cols, PACKED.values(), strict=True)]


def unpacked_rows(cols: list[bytes]) -> list[np.ndarray]:
    """What ``packed_rows`` packed."""
    ids, digests, n, vocab, steps, c = (np.frombuffer(spread(x), d) for x, d in zip(cols, PACKED.values(), strict=True))
    return [ids, digests, n, vocab[np.cumsum(steps, dtype=np.int64)], c]


def first_of_equal(ids: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """Places of the smallest id of each digest."""
    parts = digests.view(np.int64).reshape(-1, 4)
    order = np.lexsort((ids, *parts.T))
    return np.sort(order[np.r_[True, (parts[order][1:] != parts[order][:-1]).any(1)]]) if len(order) else order


def chosen_rows(rows: list[np.ndarray], keep: np.ndarray) -> list[np.ndarray]:
    """The rows at ``keep``, in that order."""
    ids, digests, n, term, c = rows
    size = n[keep].astype(np.int64)
    entry = np.repeat((np.cumsum(n, dtype=np.int64) - n)[keep] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return [ids[keep], digests[keep], n[keep], term[entry], c[entry]]


def packed_groups(entries: DataFrame, groups: int, fold: bool, content: str) -> DataFrame:
    """(g, PACKED without digests): the rows with a term, in groups by the digest of their text. What the rows of a batch have for a group travels packed; rows of
    equal texts meet in their group, of which ``fold`` keeps the smallest id."""
    texts = entries.select("id", F.unhex(F.sha2(content, 256)).alias("d"), F.lower(content).cast("binary").alias("x")).where("id is not null and x is not null")
    schema = ", ".join(["g int", *[f"{k} binary" for k in PACKED]])

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * len(PACKED)), strict=True)], ["g", *PACKED])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in it if b.num_rows):
            digests = np.frombuffer(b"".join(batch.column("d").to_pylist()), "V32")
            ids = batch.column("id").to_numpy()
            some = first_of_equal(ids, digests) if fold else np.arange(len(ids))
            got = [counted(x) for x in batch.column("x").take(pa.array(some)).to_pylist()]
            rows = [ids[some], digests[some], np.array([len(t) for t, _ in got], np.int32), *(np.concatenate(x) for x in zip(*got, strict=True))]
            group = rows[1].view(np.uint64).reshape(-1, 4)[:, 0] % np.uint64(groups)
            dealt = [(g, np.nonzero((group == g) & (rows[2] > 0))[0]) for g in np.unique(group).tolist()]
            if dealt := [(g, *packed_rows(*chosen_rows(rows, keep))) for g, keep in dealt if len(keep)]:
                yield table(dealt)

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [(g, unpacked_rows(r)) for b in it for g, *r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if pieces:
            rows = [np.concatenate(x) for x in zip(*(r for _, r in pieces), strict=True)]
            ids, digests, *rest = chosen_rows(rows, first_of_equal(*rows[:2])) if fold else rows
            yield table([(pieces[0][0], *packed_rows(ids, digests[:0], *rest))])

    return texts.mapInArrow(pack, schema).repartitionById(groups, F.col("g")).mapInArrow(gather, schema)


def cosine_pairs_blocked(entries: DataFrame, threshold: float = 0.85, content: str = "content", fold: bool = False) -> DataFrame:
    """``cosine_pairs`` for long texts, whose frequent words leave prefixes nothing to filter: (i, j, similarity) by
    comparing all pairs of groups of at most about ``GROUP_ROWS`` entries (integer ids; terms as 64-bit hashes); with ``fold``, of equal texts only the smallest id
    is compared. A group is packed and written once, and a task reads two of them where they lie: of the groups on a circle each meets the
    following half. What is written grows with the entries; time grows with their square, and so does the result where many entries are alike."""
    entries = entries.withColumn("id", F.col("id").cast("long"))
    n, chars = entries.agg(F.count("*"), F.coalesce(F.sum(F.length(content)), F.lit(0))).first()
    cores = entries.sparkSession.sparkContext.defaultParallelism
    groups = max(1, math.ceil(n / GROUP_ROWS), math.ceil(chars / GROUP_CHARS), min(cores, n * 8 // GROUP_ROWS)) | 1  # odd, so that the two ways round differ
    packed = materialize(packed_groups(entries, groups, fold, content))
    dealt = packed.repartitionById(groups, F.col("g"))  # one group is one partition, so a task of the product has one pair
    one, two = (dealt.select([F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in "ab")
    met = one.join(two.hint("shuffle_replicate_nl"), F.expr(f"pmod(b_g - a_g, {groups}) <= {groups // 2}"))

    def opened(cols: dict, side: str) -> tuple[np.ndarray, ...]:
        ids, _, *rest = unpacked_rows([cols[f"{side}_{c}"] for c in PACKED])
        return by_norm(ids, *rest)

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in (r for b in it for r in b.to_pylist()):
            own, other = opened(pair, "a"), None if pair["a_g"] == pair["b_g"] else opened(pair, "b")
            for i, j, s in compare_groups(own, other, threshold):
                for x in range(0, len(i), PAIRS_BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(y[x : x + PAIRS_BATCH]) for y in (i, j, s)], ["i", "j", "similarity"])

    return met.mapInArrow(compare, "i long, j long, similarity double")


def pair_components(pairs: DataFrame) -> DataFrame:
    """(v, comp): the smallest end that each end of a pair is connected with, by minimum propagation and pointer jumping."""
    both = materialize(pairs.select(F.col("i").alias("x"), F.col("j").alias("y")).unionAll(pairs.select("j", "i")))
    comp = materialize(both.groupBy(F.col("x").alias("v")).agg(F.least(F.min("y"), F.first("x")).alias("comp")))
    while True:
        near = both.join(comp, both["y"] == comp["v"]).groupBy(F.col("x").alias("v")).agg(F.min("comp").alias("near"))
        low = comp.join(near, "v").select("v", F.col("comp").alias("old"), F.least("comp", "near").alias("low"))
        new = materialize(low.join(comp.toDF("low", "next"), "low").select("v", F.least("low", "next").alias("comp"), "old"))
        comp = new.select("v", "comp")
        if not new.where("comp <> old").limit(1).count():
            return comp


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """Greedy matching in (i, j) order: a pair is taken if both ends are free. Pairs that share no end do not touch each
    other, so each component is passed through in order, streamed from a sorted partition."""
    pairs = materialize(pairs.select("i", "j"))
    rows = pairs.join(pair_components(pairs).withColumnRenamed("v", "i"), "i").select("comp", "i", "j")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, used = None, set()
        for b in it:
            out = []
            for c, i, j in zip(*(b.column(k).to_pylist() for k in ("comp", "i", "j")), strict=True):
                if c != comp:
                    comp, used = c, set()
                if i not in used and j not in used:
                    used |= {i, j}
                    out.append((i, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, b.schema.field("i").type) for x in zip(*out, strict=True)], ["i", "j"])

    kind, n = pairs.schema["i"].dataType.simpleString(), int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "comp").sortWithinPartitions("comp", "i", "j").mapInArrow(run, f"i {kind}, j {kind}")


def merge_groups(entries: DataFrame, group: str) -> DataFrame:
    """One row per group: the best score (ties: first pos), summed accesses, union of tags."""
    return entries.groupBy(group).agg(
        F.max_by("id", F.struct("score", (-F.col("pos")).alias("p"))).alias("id"),
        F.max("score").alias("score"),
        F.sum("access_count").alias("access_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
        F.count("*").alias("size"),
    )


def consolidate(entries: DataFrame, now_ms: int, threshold: float = 0.85) -> DataFrame:
    """Decayed entries go; exact groups, then greedy near pairs of the rest, are merged. (id, score, access_count, tags, size)."""
    alive = entries.where(Q.decay(F.lit(now_ms) - F.col("ts_ms"), F.col("ttl_s")) < 0.95).withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    sizes = alive.groupBy("hash").agg(F.count("*").alias("_s"), F.min("id").alias("_first"))
    alive = alive.join(sizes, "hash")
    single = alive.where("_s = 1")
    pairs = greedy_pairs(cosine_pairs(single, threshold))
    member = pairs.select(F.col("i").alias("id"), F.col("i").alias("_pair")).unionAll(pairs.select(F.col("j").alias("id"), F.col("i").alias("_pair")))
    grouped = alive.join(member, "id", "left").withColumn("grp", F.coalesce("_pair", "_first"))
    return merge_groups(grouped, "grp").drop("grp")
