"""Session watcher: bursts of appended lines, settled by processing-time timers, go into each session's context.

Lines wait in state until a session has been still for ``debounce_ms``; then one timer releases them together, so a burst of
writes is one run, however many micro-batches it took. The context held after a run is bounded by the token budget and
the window; waiting lines are a list in the state store, read back in order when their timer fires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillstone import functions as Q
from quillstone import sources, streaming

#: Stillness that ends a burst, tokens kept, tokens at which a session asks for an optimisation, entries kept.
DEBOUNCE_MS, BUDGET, ALERT_TOKENS, WINDOW = 5_000, 40_000, 60_000, 500
ENTRY = "hash string, terms string, tokens long, ts_ms long, ttl_s long, score double, access_count long, critical boolean"
ENTRIES = "array<struct<" + ENTRY.replace(" ", ":").replace(",:", ",") + ">>"
STATE = f"session string, burst long, total long, removed long, now long, entries {ENTRIES}"
BURST = "session string, burst long, lines long, total_lines long, entries long, tokens long, removed long, evicted long, reduction double, utilization double, alert boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def evict(live: list[tuple], window: int) -> list[tuple]:
    """At most ``window`` entries (as in ``streaming.HELD``): critical ones, then by 0.4 newness + 0.6 score, newer first."""
    if len(live) <= window:
        return live
    times = [e[3] for e in live]
    low, span = min(times), max(times) - min(times) or 1
    order = sorted(range(len(live)), key=lambda i: (-(2.0 if live[i][7] else (live[i][3] - low) / span * 0.4 + live[i][5] * 0.6), -live[i][3], i))
    kept = set(order[:window])
    return [e for i, e in enumerate(live) if i in kept]


class Watcher(StatefulProcessor):
    def __init__(self, debounce_ms: int, budget: int, window: int, alert_tokens: int) -> None:
        self.debounce_ms, self.budget, self.window, self.alert_tokens = debounce_ms, budget, window, alert_tokens

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"position long, {ENTRY}")
        self.held = handle.getListState("held", ENTRY)
        self.counts = handle.getValueState("counts", "burst long, total long, removed long, now long, deadline long")

    def state(self) -> tuple:
        return self.counts.get() if self.counts.exists() else (0, 0, 0, 0, -1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        burst, total, removed, now, deadline = self.state()
        for p in rows:
            self.waiting.appendList([(int(r[0]), r[1], r[2], int(r[3]), int(r[4]), int(r[5]), float(r[6]), int(r[7]), bool(r[8])) for r in p[["position", *streaming.HELD]].itertuples(index=False, name=None)])
        if deadline >= 0:
            self.handle.deleteTimer(deadline)
        deadline = timerValues.getCurrentProcessingTimeInMs() + self.debounce_ms
        self.handle.registerTimer(deadline)
        self.counts.update((burst, total, removed, now, deadline))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        burst, total, removed, now, _ = self.state()
        new = [tuple(r[1:]) for r in sorted(map(tuple, self.waiting.get()), key=lambda r: (r[0], r[4]))] if self.waiting.exists() else []
        held = {e[0]: e for e in map(tuple, self.held.get())} if self.held.exists() else {}
        live, _, gone, before, now = streaming.take_in(held, new, self.budget, 10_000, now)
        kept = evict(live, self.window)
        gone += len(live) - len(kept)
        tokens = sum(e[2] for e in kept)
        self.waiting.clear()
        self.held.clear()
        if kept:
            self.held.put(kept)
        self.counts.update((burst + 1, total + len(new), removed + gone, now, -1))
        row = [key[0], burst + 1, len(new), total + len(new), len(kept), tokens, gone, removed + gone, (before - tokens) / before if before else 0.0, tokens / self.budget, tokens >= self.alert_tokens]
        yield pd.DataFrame([row], columns=[c.split(" ")[0] for c in BURST.split(", ")])

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """A session goes on from an exported state; rows that are no state are passed over."""
        for r in initialState.itertuples(index=False):
            held = [tuple(e[c] for c in streaming.HELD) for e in r.entries if e is not None and e["hash"] is not None and e["tokens"] is not None]
            if held:
                self.held.put([(h, t or "", int(n), int(ts), int(ttl), float(score), int(access), bool(critical)) for h, t, n, ts, ttl, score, access, critical in held])
            self.counts.update((int(r.burst), int(r.total), int(r.removed), int(r.now), -1))

    def close(self) -> None:
        pass


def entries_of(lines: DataFrame) -> DataFrame:
    """Entries of transcript lines (session, position, value), one JSON message each; ``position`` stands for time within a file."""
    m = sources.jsonl_messages(lines, "value", "session", "position")
    score = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in sources.BASE_SCORES.items()], F.lit(0.5))
    return m.select(
        "session",
        "position",
        F.sha2("content", 256).alias("hash"),
        F.array_join(Q.tokens(F.col("content")), " ").alias("terms"),
        Q.token_estimate(F.col("content")).alias("tokens"),
        F.col("position").alias("ts_ms"),
        F.lit(sources.TTL_S).cast("long").alias("ttl_s"),
        score.alias("score"),
        F.lit(0).cast("long").alias("access_count"),
        Q.is_critical(F.col("content")).alias("critical"),
    )


def watch(entries: DataFrame, debounce_ms: int = DEBOUNCE_MS, budget: int = BUDGET, window: int = WINDOW, alert_tokens: int = ALERT_TOKENS, initial: DataFrame | None = None) -> DataFrame:
    """One row for each burst of a session. ``entries`` as of ``entries_of``; ``alert`` marks sessions that ask for an optimisation.
    ``initial`` is an exported state that a stream without a checkpoint starts from."""
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # timers need it
    rows = entries.select("session", "position", *streaming.HELD)
    start = usable(initial).groupBy("session") if initial is not None else None
    return rows.groupBy("session").transformWithStateInPandas(Watcher(debounce_ms, budget, window, alert_tokens), BURST, "Update", "ProcessingTime", initialState=start)


def usable(states: DataFrame) -> DataFrame:
    """One state of each session of an export, the one of most bursts; fields that are not there count as nothing held."""
    whole = F.struct(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("burst", "total", "removed", "now")], F.coalesce("entries", F.array().cast(ENTRIES)).alias("entries"))
    return states.where("session is not null").groupBy("session").agg(F.max_by(whole, F.coalesce("burst", F.lit(0))).alias("s")).select("session", "s.*")


def export_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(session, burst, total, removed, now, entries) of every session, read from a stopped watcher's checkpoint by Spark's state data
    source. Lines still waiting for their timer are not part of it: their offsets are not settled either."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    read = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    counts = read("counts").select("key.session", "value.burst", "value.total", "value.removed", "value.now")
    held = read("held").groupBy("key.session").agg(F.collect_list("list_element").alias("entries"))  # as many as the window holds
    return counts.join(held, "session", "left").withColumn("entries", F.coalesce("entries", F.array().cast(ENTRIES)))


def sessions_again(lines: DataFrame, initial: DataFrame | None = None, **options) -> DataFrame:
    """The watcher over transcript lines as of ``sources.tail``, from an exported state if there is one."""
    return watch(entries_of(lines), initial=initial, **options)


def alerts(bursts: DataFrame) -> DataFrame:
    return bursts.where("alert")
