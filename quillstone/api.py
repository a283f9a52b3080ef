"""The whole runs as plain calls, and the interfaces that a user's own parts fill in."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import functions as Q
from quillstone import sources
from quillstone.operators import memory, search, store, workflow
from quillstone.plans import pipelines


@runtime_checkable
class Analyzer(Protocol):
    """Findings (path, rule_id, severity, deduction, detail) of files (path, content)."""

    def findings(self, files: DataFrame) -> DataFrame: ...


@runtime_checkable
class Adapter(Protocol):
    """How one assistant's transcripts become entries, and entries its context again."""

    def parse(self, transcripts: DataFrame) -> DataFrame: ...

    def context(self, optimized: DataFrame) -> DataFrame: ...


class TranscriptAdapter:
    """Transcripts (session, text) with marked lines."""

    def __init__(self, now_ms: int, budget: int = 50_000) -> None:
        self.now_ms, self.budget = now_ms, budget

    def parse(self, transcripts: DataFrame) -> DataFrame:
        return pipelines.optimize_transcripts(transcripts, "text", "session", self.now_ms, self.budget)

    def context(self, optimized: DataFrame) -> DataFrame:
        return pipelines.optimized_context(optimized)


def optimize(spark: SparkSession, text: str, now_ms: int, percent: float = 5.0) -> DataFrame:
    """One row: the kept paragraphs of a text in order, counts and tokens before and after."""
    p = sources.paragraphs(spark.createDataFrame([("text", text)], "session string, t string"), "t", "session").withColumn("kind", F.lit("other"))
    best = pipelines.optimize_entries(sources.entries(p, now_ms, order="pos"), now_ms, percent)
    result = pipelines.optimization_result(best)
    context = best.where("kept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n\n").alias("context"))
    return result.crossJoin(F.broadcast(context))  # one row each


def statistics(stats: DataFrame) -> DataFrame:
    return store.optimization_totals(stats)


def find(lines: DataFrame, text: str, limit: int = 10) -> DataFrame:
    return search.search(lines, text, limit)


def consolidate(entries: DataFrame, now_ms: int) -> DataFrame:
    return memory.consolidate(entries, now_ms)


def relay(spark: SparkSession, command: list[str], now_ms: int, percent: float = 50.0) -> DataFrame:
    """Runs a command on the driver and gives its exit code beside its optimised output; nothing is stored."""
    ran = workflow.run_command(spark, command).first()
    return optimize(spark, ran.text, now_ms, percent).withColumn("code", F.lit(ran.code))


def analyze(files: DataFrame, *extra: Analyzer) -> tuple[DataFrame, DataFrame]:
    """Findings of the built-in analysis and of a user's analyzers, and the built-in total."""
    found, _, total = pipelines.analyze(files)
    for a in extra:
        found = found.unionByName(a.findings(files).select(*found.columns))
    return found, total


def sessions_again(entries: DataFrame, session: str, budget: int, now_ms: int) -> DataFrame:
    """One session optimised anew, its entries' scores as they are."""
    mine = entries.where(F.col("session") == session)
    return memory.budget_prune(mine, budget, ["session"], now_ms).withColumn("state", Q.state(F.col("score"), F.col("critical")))
