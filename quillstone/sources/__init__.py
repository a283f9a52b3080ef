"""Sources: transcripts, JSONL, paragraphs and lines, file trees, git logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone.sources.tailing import TailSource

#: Base scores by kind of block, seconds to live.
BASE_SCORES, TTL_S = {"other": 0.5, "conversation": 0.8, "tool": 0.7, "result": 0.4}, 86_400
#: File selections.
SOURCE_EXT = "ts|tsx|js|jsx|sql|cs|json|md"
GRAPH_EXT = "ts|tsx|js|jsx"
SKIPPED = "node_modules|dist|coverage|bin|obj"


def lines(df: DataFrame, text: str, *keys: str, keep_blank: bool = True) -> DataFrame:
    """(keys..., line, content), lines counted from 1."""
    out = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)
    return out if keep_blank else out.where(F.trim("content") != "")


def line_kind(line: Column) -> Column:
    return (
        F.when(line.rlike(r"^\s*(User|Assistant):"), "conversation")
        .when(line.rlike("<(function_calls|invoke|tool_use)>"), "tool")
        .when(line.rlike("</?function_results>"), "result")
    )


def transcript_blocks(df: DataFrame, text: str, session: str) -> DataFrame:
    """(session, block, kind, content): a block starts at a marked line; a result line inside a result stays in it.

    The unit of the windows is one session's lines.
    """
    w = Window.partitionBy(session).orderBy("line")
    x = lines(df, text, session).withColumn("mark", line_kind(F.col("content")))
    x = x.withColumn("before", F.last("mark", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.col("mark").isNotNull() & ~((F.col("mark") == "result") & (F.coalesce("before", F.lit("")) == "result"))
    x = x.withColumn("block", F.sum(starts.cast("int")).over(w))
    got = x.groupBy(session, "block").agg(
        F.coalesce(F.min_by("mark", "line"), F.lit("other")).alias("kind"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda s: s["content"]), "\n").alias("content"),
    )
    return got.withColumn("content", F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))).where("content <> ''")


MESSAGE = "role string, type string, tool_use string, tool_result string, content string"
BLOCKS = "array<struct<type:string,text:string,name:string,content:string>>"


def jsonl_messages(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys..., kind, content) of one JSON message per row; rows that don't parse are left out."""
    m = df.select(*keys, F.from_json(value, MESSAGE).alias("m")).where(F.coalesce("m.role", "m.type", "m.content").isNotNull())
    m = m.withColumn("blocks", F.when(F.col("m.content").startswith("["), F.from_json("m.content", BLOCKS)))
    part = lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_use", F.concat(F.lit("[tool_use: "), b["name"], F.lit("]"))).when(b["type"] == "tool_result", b["content"])
    content = F.when(F.col("blocks").isNotNull(), F.array_join(F.filter(F.transform("blocks", part), lambda s: F.coalesce(s, F.lit("")) != ""), "\n")).otherwise(F.coalesce("m.content", F.lit("")))
    has = lambda t: F.coalesce(F.exists("blocks", lambda b: b["type"] == t), F.lit(False))
    kind = (
        F.when(has("tool_use"), "tool")
        .when(has("tool_result"), "result")
        .when((F.coalesce("m.type", F.lit("")) == "tool_use") | F.col("m.tool_use").isNotNull(), "tool")
        .when((F.coalesce("m.type", F.lit("")) == "tool_result") | F.col("m.tool_result").isNotNull(), "result")
        .when(F.col("m.role").isin("user", "assistant"), "conversation")
        .otherwise("other")
    )
    return m.select(*keys, kind.alias("kind"), content.alias("content")).where(F.trim("content") != "")


def paragraphs(df: DataFrame, text: str, *keys: str) -> DataFrame:
    out = df.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n\n+")).alias("pos", "content"))
    return out.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).where("content <> ''")


def entries(blocks: DataFrame, base_ms: int, session: str = "session", order: str = "block") -> DataFrame:
    """Entry columns with their defaults; ids are derived, so a rerun gives the same ones."""
    score = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in BASE_SCORES.items()], F.lit(0.5))
    return blocks.select(
        F.sha2(F.concat_ws("|", F.col(session).cast("string"), F.col(order).cast("string"), "content"), 256).alias("id"),
        F.col(session).alias("session"),
        F.col(order).cast("long").alias("pos"),
        "content",
        F.sha2("content", 256).alias("hash"),
        (F.lit(base_ms) + F.col(order)).cast("long").alias("ts_ms"),
        score.alias("score"),
        F.lit(TTL_S).cast("long").alias("ttl_s"),
        F.when(score >= 0.7, "active").when(score >= 0.3, "ready").otherwise("silent").alias("state"),
        F.lit(0).cast("long").alias("access_count"),
        F.array("kind").alias("tags"),
        F.create_map(F.lit("type"), F.col("kind")).alias("metadata"),
        F.lit(False).alias("critical"),
    )


def source_tree(spark: SparkSession, root: str, extensions: str = SOURCE_EXT, max_bytes: int = 1_000_000) -> DataFrame:
    """(path, content) of a directory's source files, by Spark's own reader."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    ok = f.where(F.col("length") < max_bytes).where(F.col("path").rlike(rf"\.({extensions})$")).where(~F.col("path").rlike(rf"/({SKIPPED}|\.[^/]+)/"))
    return ok.select("path", F.decode("content", "UTF-8").alias("content"), "modificationTime")


def git_log(df: DataFrame, text: str) -> DataFrame:
    """(hash, date, file) from ``hash|date`` header lines followed by file names. Each row is a log of its own and one group."""
    x = lines(df.select(text).withColumn("_k", F.monotonically_increasing_id()), text, "_k", keep_blank=False)
    head = F.regexp_extract("content", r"^([0-9a-f]{7,40})\|(.+)$", 1)
    w = Window.partitionBy("_k").orderBy("line")
    x = x.withColumn("hash", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(w)).withColumn("date", F.last(F.nullif(F.regexp_extract("content", r"^([0-9a-f]{7,40})\|(.+)$", 2), F.lit("")), ignorenulls=True).over(w))
    return x.where(head == "").select("hash", "date", F.col("content").alias("file"))


def tail(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """(path, session, position, value): lines appended to a folder's files as a stream. Byte offsets of each file are the query's
    checkpoint; blank lines are left out and unfinished ones wait for their end."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("jsonl_tail").option("glob", glob).load(folder)
