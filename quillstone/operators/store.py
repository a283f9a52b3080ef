"""Tables kept as Parquet: upsert, retention, statistics, debts, history, baselines."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstone import functions as Q


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one is set only where that setting is missing and all runs on one machine, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Written to the shared folder in spark.checkpoint.dir and reread: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def squeezed(raw: bytes) -> bytes:
    """Compressed, behind its length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def spread(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True)


def upsert(table: DataFrame, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest row of each id, then of each hash (a new row replaces one of the same id or the same content)."""
    both = table.unionByName(rows)
    for key in ("id", "hash"):
        both = both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))).where("_r = 1").drop("_r")
    return both


def delete(table: DataFrame, ids: DataFrame) -> DataFrame:
    return table.join(ids.select("id"), "id", "left_anti")


def newest(table: DataFrame, n: int, ts: str, *ties: str) -> DataFrame:
    """Retention: the newest n rows (a top-k, not a full sort)."""
    return table.orderBy(F.desc(ts), *ties).limit(n)


def optimization_totals(stats: DataFrame) -> DataFrame:
    saved = F.col("tokens_before") - F.col("tokens_after")
    ratio = F.when(F.col("tokens_before") > 0, saved / F.col("tokens_before")).otherwise(0.0)
    return stats.agg(F.count("*").alias("runs"), F.sum(saved).alias("saved"), F.avg(ratio).alias("mean_reduction"))


def latency(metrics: DataFrame, value: str) -> DataFrame:
    """Nearest-rank percentiles of all rows, nulls left out, and the number of rows.

    Values are counted first and dealt by ranges; a value's rank is its rank in the range plus the counts of the ranges before it.
    """
    c = metrics.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = materialize(c.repartitionByRange("v").withColumn("_p", F.spark_partition_id()))
    some = dealt.where("v is not null")
    parts = some.groupBy("_p").agg(F.sum("n").alias("m"))  # one row for each range
    parts = parts.select("_p", (F.sum("m").over(Window.orderBy("_p")) - F.col("m")).alias("before"))
    total = dealt.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"), F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("total"))
    upto = some.join(F.broadcast(parts), "_p").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("_p").orderBy("v")))
    ranked = upto.crossJoin(F.broadcast(total))  # one row
    p = [F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("total") - 1e-9), F.col("v"))).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    return total.select(F.col("n_all").alias("n")).crossJoin(F.broadcast(ranked.agg(*p)))


def debt_list(debts: DataFrame, now: Column, status: str | None = None, severity: str | None = None, overdue: bool = False) -> DataFrame:
    if status:
        debts = debts.where(F.col("status") == status)
    if severity:
        debts = debts.where(F.col("severity") == severity)
    if overdue:
        debts = debts.where((F.col("due") < now) & (F.col("status") != "resolved"))
    return debts


def debt_stats(debts: DataFrame, now: Column) -> DataFrame:
    done = F.col("status") == "resolved"
    return debts.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "open").alias("open"),
        F.count_if(F.col("status") == "in_progress").alias("in_progress"),
        F.count_if(done).alias("resolved"),
        F.count_if((F.col("due") < now) & ~done).alias("overdue"),
        F.sum("token_cost").alias("total_cost"),
        F.sum(F.when(done, F.coalesce(F.nullif("resolution_tokens", F.lit(0)), "token_cost"))).alias("repaid"),
        F.coalesce(F.count_if(done & (F.col("resolved_at") <= F.col("due"))) / F.nullif(F.count_if(done), F.lit(0)), F.lit(0.0)).alias("on_time"),
    )


def insert_debt(debts: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Debts with new ones (description, due, severity, token_cost, files) added as open, each under a random id of eight digits."""
    new = rows.withColumns({"id": F.substring(F.uuid(), 1, 8), "created_at": now, "status": F.lit("open")})
    return debts.unionByName(new, allowMissingColumns=True)


def require(debts: DataFrame, id_: str) -> None:
    if not debts.where(F.col("id") == id_).limit(1).count():
        raise KeyError(f"no debt {id_}")


def start_debt(debts: DataFrame, id_: str) -> DataFrame:
    """The debt is being worked on; an unknown id is an error."""
    require(debts, id_)
    return debts.withColumn("status", F.when(F.col("id") == id_, "in_progress").otherwise(F.col("status")))


def resolve_debt(debts: DataFrame, id_: str, resolved_at: Column, tokens: int | None = None) -> DataFrame:
    """The debt is paid; an unknown id is an error."""
    require(debts, id_)
    hit = F.col("id") == id_
    return debts.withColumns({"status": F.when(hit, "resolved").otherwise(F.col("status")), "resolved_at": F.when(hit, resolved_at).otherwise(F.col("resolved_at")), "resolution_tokens": F.when(hit, F.lit(tokens)).otherwise(F.col("resolution_tokens"))})


def baseline_diff(current: DataFrame, base: DataFrame) -> DataFrame:
    """(fingerprint, status): new, fixed or unchanged."""
    return current.select("fingerprint").distinct().withColumn("_c", F.lit(1)).join(base.select("fingerprint").distinct().withColumn("_b", F.lit(1)), "fingerprint", "full").select("fingerprint", F.when(F.col("_b").isNull(), "new").when(F.col("_c").isNull(), "fixed").otherwise("unchanged").alias("status"))


def trend(history: DataFrame, ts: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Change from the run before, to one decimal, half up."""
    w = Window.partitionBy(*(by or [])).orderBy(ts)
    delta = Q.js_round(F.col(score) - F.lag(score).over(w), 1)
    return history.withColumn("delta", delta).withColumn("trend", F.when(delta.isNull(), "first").when(delta > 0, "up").when(delta < 0, "down").otherwise("same"))


def plan_verify(steps: DataFrame) -> DataFrame:
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return steps.groupBy("plan_id").agg(
        F.count("*").alias("steps"),
        done.alias("completed"),
        failed.alias("failed"),
        F.sum(F.when(F.col("status") == "completed", F.col("estimated"))).alias("tokens_used"),
        ((failed == 0) & (done == F.count("*"))).alias("success"),
    )


def clear(table: DataFrame) -> DataFrame:
    """The table without rows, to overwrite it with."""
    return table.limit(0)


def save_baseline(findings: DataFrame, path: str) -> None:
    """Findings with their fingerprints as JSON lines, replacing an earlier baseline."""
    findings.withColumn("fingerprint", Q.fingerprint(F.col("rule_id"), F.col("path"), F.col("title"))).write.mode("overwrite").json(path)


def append_history(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)
