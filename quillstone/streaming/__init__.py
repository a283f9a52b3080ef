"""Streaming context pipeline: incremental, per-session state in Spark's state store."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone import functions as Q
from quillstone.operators import memory, store

OUT = "session string, batch_rows long, total_rows long, distinct_rows long, kept long, evicted long, tokens long"
STATE = "hashes array<string>, tokens array<long>, ts array<long>, total long, seen long, evicted long"


def ingest(stream: DataFrame, budget: int = 40_000, window: int = 500) -> DataFrame:
    """One row per session and micro-batch. Input: session, content, ts_ms, tokens.

    State of a session is at most ``window`` entries: equal contents are one entry, entries over the token
    budget or the window leave, oldest first.
    """
    rows = stream.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256)).select("session", "hash", "ts_ms", "tokens")

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hashes, tokens, ts, total, seen, evicted = state.get if state.exists else ([], [], [], 0, 0, 0)
        kept = {h: (t, k) for h, k, t in zip(hashes, tokens, ts, strict=True)}
        n = 0
        for p in parts:
            for h, t, k in sorted(zip(p["hash"], p["ts_ms"], p["tokens"], strict=True), key=lambda r: (r[1], r[0])):
                n += 1
                if h not in kept:
                    kept[h] = (int(t), int(k))
                    seen += 1
        order = sorted(kept.items(), key=lambda e: (-e[1][0], e[0]))
        live, used = [], 0
        for h, (t, k) in order:
            if len(live) < window and used + k <= budget:
                live.append((h, k, t))
                used += k
        evicted += len(order) - len(live)
        total += n
        state.update(([x[0] for x in live], [x[1] for x in live], [x[2] for x in live], total, seen, evicted))
        yield pd.DataFrame({"session": [key[0]], "batch_rows": [n], "total_rows": [total], "distinct_rows": [seen], "kept": [len(live)], "evicted": [evicted], "tokens": [used]})

    return rows.groupBy("session").applyInPandasWithState(step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def document_frequency_deltas(stream: DataFrame) -> DataFrame:
    """Running (term, df) from rows (content, sign): +1 on arrival, -1 on removal; zero counts are left out downstream."""
    terms = stream.select("sign", F.explode(F.array_distinct(Q.tokens(F.col("content")))).alias("term"))
    return terms.groupBy("term").agg(F.sum("sign").alias("df"))


HELD = ["hash", "terms", "tokens", "ts_ms", "ttl_s", "score", "access_count", "critical"]
HELD_TYPES = "hash array<string>, terms array<string>, tokens array<long>, ts_ms array<long>, ttl_s array<long>, score array<double>, access_count array<long>, critical array<boolean>, updates long, now long"
OPTIMIZED = "session string, updates long, whole boolean, rows long, hits long, kept long, removed long, tokens_before long, tokens_after long, hashes array<string>"


def live_score(score: float, age: int, ttl: int, access: int, critical: bool) -> float:
    """The value of ``functions.engram_score``, for rows held in state."""
    gone = 1.0 if ttl == 0 else 0.0 if age <= 0 else min(1.0, 1 - math.exp(-age / (ttl * 1000)))
    s = score * (1 - gone)
    s = min(1.0, s + 0.1 * math.log(access + 1)) if access > 0 else s
    if critical:
        s = max(s, Q.CRITICAL_FLOOR)
    elif 0 <= age < Q.BOOST_MS:
        s *= 1 + (Q.BOOST - 1) * (1 - age / Q.BOOST_MS)
    return max(0.0, min(1.0, s))


def fit(held: list[tuple], budget: int, now: int) -> set[str]:
    """Hashes of the entries (as in ``HELD``, in order of arrival) that ``memory.budget_prune`` keeps of one session."""
    counts = [Counter(e[1].split(" ")) if e[1] else Counter() for e in held]
    df = Counter(t for c in counts for t in c)

    def key(i: int) -> tuple:
        h, _, _, ts, ttl, score, access, critical = held[i]
        if critical:
            return (False, -ts, i)
        idf = sum(math.sqrt(c) * math.log(len(held) / df[t]) for t, c in counts[i].items()) / max(1, counts[i].total())
        weight = 2.0 if score >= Q.ACTIVE else 1.0 if score >= Q.READY else 0.5
        return (True, -round(idf * live_score(score, now - ts, ttl, access, critical) * weight, 9), i)

    order = sorted(range(len(held)), key=key)
    return {h for _, h, kept in memory.greedy_scan((("", held[i][7], held[i][0], held[i][2]) for i in order), budget) if kept}


def take_in(held: dict[str, tuple], new: list[tuple], budget: int, most: int, now: int) -> tuple[list[tuple], int, int, int, int]:
    """New entries (as in ``HELD``, in order) join the held ones and the budget is applied: what lives on, repeats met, entries
    removed, tokens before, and the latest time seen."""
    hits = 0
    for h, terms, n, ts, ttl, score, access, critical in new:
        now = max(now, int(ts))
        if h in held:
            hits += 1
            continue
        if len(held) >= most:
            for old in list(held)[: most // 5]:
                del held[old]
        held[h] = (h, terms, int(n), int(ts), int(ttl), float(score), int(access), bool(critical))
    good = fit(list(held.values()), budget, now)
    live = [e for e in held.values() if e[0] in good]
    return live, hits, len(held) - len(live), sum(e[2] for e in held.values()), now


def optimize(stream: DataFrame, budget: int = 50_000, interval: int = 50, most: int = 10_000) -> DataFrame:
    """One row per session and micro-batch: what is kept of the entries held and the new ones, by ``memory.budget_prune``.

    Input: session, content, ts_ms, ttl_s, score, access_count, critical. State holds the kept entries alone, so the budget bounds it;
    an entry whose content is held is a hit. Terms are counted from what is held, so a removal needs no correction. Before an
    entry is added to ``most`` of them, the oldest fifth by arrival leaves. Every ``interval`` updates the run is a whole one: it
    counts no hits and starts the count of updates anew. Now is the latest time seen.
    """
    text = F.coalesce("content", F.lit(""))
    rows = stream.select("session", F.sha2(text, 256).alias("hash"), F.array_join(Q.tokens(text), " ").alias("terms"), Q.token_estimate(text).alias("tokens"), *HELD[3:])

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *cols, updates, now = state.get if state.exists else (*([] for _ in HELD), 0, 0)
        held = {e[0]: e for e in zip(*cols, strict=True)}
        new = sorted((r for p in parts for r in p[HELD].itertuples(index=False, name=None)), key=lambda r: (r[3], r[0]))
        whole = updates + 1 >= interval
        live, hits, removed, before, now = take_in(held, new, budget, most, now)
        updates = 0 if whole else updates + 1
        state.update((*(list(c) for c in (zip(*live, strict=True) if live else ([] for _ in HELD))), updates, now))
        yield pd.DataFrame({"session": [key[0]], "updates": [updates], "whole": [whole], "rows": [len(new)], "hits": [0 if whole else hits], "kept": [len(live)], "removed": [removed], "tokens_before": [before], "tokens_after": [sum(e[2] for e in live)], "hashes": [[e[0] for e in live]]})

    return rows.groupBy("session").applyInPandasWithState(step, OPTIMIZED, HELD_TYPES, "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str = "update", last: bool = False) -> DataFrame:
    """Runs a stream over what its source holds now and gives all its rows, or those of the last micro-batch. Rows and the
    checkpoint are written to the shared folder; a batch that is run again replaces its own rows."""
    spark = stream.sparkSession
    root = f"{store.shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/n={0 if last else number}")

    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not q.lastProgress:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{root}/rows/n=*")


def consolidate_due(last_ms: int | None, now_ms: int, hours: float) -> bool:
    """A scheduled consolidation is due; an interval of zero switches it off. The scheduler runs one job at a time."""
    return hours > 0 and (last_ms is None or now_ms - last_ms >= hours * 3_600_000)


def each_batch(run: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes ``run`` of each micro-batch; a batch that is run again replaces its own rows."""
    return lambda batch, number: run(batch).write.mode("overwrite").parquet(f"{path}/n={number}")
