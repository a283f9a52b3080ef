"""Plans of work, the briefing of a session, counters of compressed outputs and of optimisations."""

from __future__ import annotations

import subprocess
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import functions as Q

STEPS = "array<struct<order:int,action:string,target:string,estimated:bigint,status:string,result:string>>"
PLAN = f"id string, created_at bigint, task string, steps {STEPS}, max_file_reads int, budget bigint, status string"


def new_plan(spark: SparkSession, task: str, steps: list[tuple[int, str, str, int]], now_ms: int, max_file_reads: int = 5, budget: int = 0) -> DataFrame:
    """A draft of one plan, its steps (order, action, target, estimated tokens) pending."""
    rows = [(*s, "pending", None) for s in steps]
    return spark.createDataFrame([(uuid.uuid4().hex[:8], now_ms, task, rows, max_file_reads, budget, "draft")], PLAN)


def read_plans(spark: SparkSession, folder: str) -> DataFrame:
    """Plans of a folder of JSON documents, the newest first; a document that is no plan is left out."""
    return spark.read.schema(PLAN).option("multiLine", True).option("mode", "DROPMALFORMED").json(folder).where("id is not null").orderBy(F.desc("created_at"), "id")


def _require(plans: DataFrame, id_: str, order: int | None = None) -> None:
    have = plans.where(F.col("id") == id_)
    if not have.limit(1).count():
        raise KeyError(f"no plan {id_}")
    if order is not None and not have.where(F.exists("steps", lambda s: s["order"] == order)).limit(1).count():
        raise KeyError(f"no step {order} in plan {id_}")


def update_step(plans: DataFrame, id_: str, order: int, status: str, result: str | None = None) -> DataFrame:
    """The step's status, and its result if one is given; an unknown plan or step is an error."""
    _require(plans, id_, order)
    new = F.transform("steps", lambda s: F.when(s["order"] == order, s.withField("status", F.lit(status)).withField("result", F.lit(result) if result is not None else s["result"])).otherwise(s))
    return plans.withColumn("steps", F.when(F.col("id") == id_, new).otherwise(F.col("steps")))


def start_plan(plans: DataFrame, id_: str) -> tuple[DataFrame, DataFrame]:
    """The plans with this one executing, and its limits (max_file_reads, budget, replan)."""
    _require(plans, id_)
    limits = plans.where(F.col("id") == id_).select("max_file_reads", "budget", F.lit(False).alias("replan"))
    return plans.withColumn("status", F.when(F.col("id") == id_, "executing").otherwise(F.col("status"))), limits


def verify_plans(plans: DataFrame) -> DataFrame:
    """Adds counts of steps, tokens used, success; a plan without pending or running steps becomes completed or failed."""
    n = lambda *st: F.size(F.filter("steps", lambda s: s["status"].isin(*st)))
    used = F.aggregate("steps", F.lit(0).cast("bigint"), lambda a, s: a + F.when(s["status"] == "completed", s["estimated"]).otherwise(0))
    done = (n("failed") == 0) & (n("completed") == F.size("steps"))
    status = F.when(n("pending", "in_progress") > 0, F.col("status")).when(done, "completed").otherwise("failed")
    return plans.withColumns({"completed": n("completed"), "failed": n("failed"), "skipped": n("skipped"), "tokens_used": used, "success": done, "status": status})


def briefing(entries: DataFrame, debts: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """(section, pos, line): five critical entries, three overdue debts, the running ones of five plans. Each list is a top-k."""

    def top(df: DataFrame, section: str, line: Column, k: int) -> DataFrame:
        order = [o.alias(f"o{i}") for i, o in enumerate(keys[section])]
        best = df.orderBy(*keys[section]).limit(k).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("l"))
        return best.select(F.lit(section).alias("section"), F.posexplode("l").alias("pos", "s")).select("section", "pos", "s.line")

    rank = F.when(F.col("severity") == "P0", 0).when(F.col("severity") == "P1", 1).otherwise(2)
    keys = {"memory": [-F.col("score"), -F.col("ts_ms"), F.col("id")], "debt": [rank, F.col("id")], "plans": [F.col("id")]}
    crit = top(entries.where("critical"), "memory", F.replace(F.substring("content", 1, 200), F.lit("\n"), F.lit(" ")), 5)
    late = top(debts.where((F.col("status") != "resolved") & (F.col("due") < now)), "debt", F.concat(F.lit("["), "severity", F.lit("] "), "description"), 3)
    first = plans.orderBy("id").limit(5).where(F.col("status").isin("planned", "in_progress", "executing"))
    return crit.union(late).union(top(first, "plans", F.coalesce("task", "id"), 5))


def dashboard(entries: DataFrame, stats: DataFrame | None, debts: DataFrame, now: Column) -> DataFrame:
    """(pos, line): entries by state; runs, tokens saved and mean reduction; open and overdue debts. Parts without rows are left out.

    Input: entries with a state, stats with tokens_before and tokens_after, debts with status and due.
    """
    n = lambda s: F.count_if(F.col("state") == s).cast("string")
    states = F.array(*[F.when(F.count_if(F.col("state") == s) > 0, F.concat(F.lit(f"{s.capitalize()}:"), n(s))) for s in ("active", "ready", "silent")])
    listed = F.coalesce(F.nullif(F.array_join(states, " "), F.lit("")), F.lit("none"))
    out = entries.agg(F.concat(F.lit("Entries: "), F.count("*").cast("string"), F.lit(" ("), listed, F.lit(")")).alias("line")).select(F.lit(0).alias("pos"), "line")
    if stats is not None:
        saved, before = F.col("tokens_before") - F.col("tokens_after"), F.col("tokens_before")
        s = stats.agg(F.count("*").alias("n"), F.sum(saved).alias("saved"), F.avg(F.when(before > 0, saved / before * 100).otherwise(0.0)).alias("mean")).where("n > 0")
        out = out.union(s.select(F.lit(1), F.concat(F.lit("Optimizations: "), F.col("n").cast("string"), F.lit(" total, saved "), Q.short_number(F.col("saved")), F.lit(" tokens, "), F.format_string("%.1f", "mean"), F.lit("% on average"))))
    late = F.count_if((F.col("due") < now) & (F.col("status") != "resolved"))
    d = debts.agg(F.count_if(F.col("status") == "open").alias("open"), late.alias("late")).where("open > 0 OR late > 0")
    return out.union(d.select(F.lit(2), F.concat(F.lit("Debt: "), F.col("open").cast("string"), F.lit(" open"), F.when(F.col("late") > 0, F.concat(F.lit(", "), F.col("late").cast("string"), F.lit(" overdue"))).otherwise(""))))


def compression_stats(outputs: DataFrame) -> DataFrame:
    """(session, tool, compressed, tokens_before, tokens_after); the row without a tool is the session's sum."""
    return outputs.rollup("session", "tool").agg(F.count("*").alias("compressed"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"), F.grouping("session").alias("_all"), F.grouping("tool").alias("_sum")).where("_all = 0").withColumn("tool", F.when(F.col("_sum") == 1, "*").otherwise(F.col("tool"))).drop("_all", "_sum")


def metrics_snapshot(metrics: DataFrame, window: int = 1000) -> DataFrame:
    """One row: latencies and savings of the newest ``window`` runs, mean latency and cache hits of all of them.

    Input: ts, seq, duration, tokens_before, tokens_after, processed, hit_rate.
    """
    hits = F.when(F.col("hit_rate") > 0, Q.js_round(F.col("processed") * F.col("hit_rate")))
    asked = F.when(F.col("hit_rate") > 0, F.col("processed"))
    whole = metrics.agg(F.avg("duration").alias("mean_latency"), F.coalesce(F.sum(hits), F.lit(0)).cast("bigint").alias("hits"), F.coalesce(F.sum(asked), F.lit(0)).cast("bigint").alias("queries"))
    saved, before = F.sum(F.col("tokens_before") - F.col("tokens_after")), F.sum("tokens_before")
    p = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY duration)").alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)]
    new = metrics.orderBy(F.desc("ts"), F.desc("seq")).limit(window)
    rolled = new.agg(F.count("*").alias("runs"), F.sum("duration").alias("duration"), saved.alias("saved"), F.when(before > 0, saved / before).otherwise(0.0).alias("reduction"), *p)
    x = rolled.crossJoin(F.broadcast(whole))  # one row each
    return x.withColumn("misses", F.col("queries") - F.col("hits")).withColumn("cache_rate", F.when(F.col("queries") > 0, F.col("hits") / F.col("queries")).otherwise(0.0)).drop("queries")


def as_json(df: DataFrame) -> DataFrame:
    """One JSON document a row, for a text sink."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def cache_split(rows: DataFrame, cached: DataFrame) -> DataFrame:
    """Adds ``hit``: a row's content hash is among the cached ones."""
    known = cached.select(F.col("hash").alias("_h")).distinct().withColumn("_k", F.lit(True))
    return rows.join(known, rows["hash"] == known["_h"], "left").withColumn("hit", F.col("_k").isNotNull()).drop("_h", "_k")


def tool_outputs(df: DataFrame, value: str) -> DataFrame:
    """(session, tool, command, text) of tool calls as JSON documents; text is a string response or the JSON of another one."""
    j = df.select(F.from_json(value, "session_id string, tool_name string, tool_input map<string,string>, tool_response string").alias("j"))
    return j.where("j.tool_name is not null").select(F.col("j.session_id").alias("session"), F.col("j.tool_name").alias("tool"), F.element_at("j.tool_input", "command").alias("command"), F.coalesce("j.tool_response", F.lit("")).alias("text"))


def run_command(spark: SparkSession, command: list[str], timeout: int = 60) -> DataFrame:
    """(command, text, code): what a command writes, run by the driver without a shell."""
    done = subprocess.run(command, capture_output=True, text=True, timeout=timeout, check=False)
    return spark.createDataFrame([(" ".join(command), done.stdout + done.stderr, done.returncode)], "command string, text string, code int")


def get_option(options: dict, path: str):
    """The option at a dotted path, or None."""
    for key in path.split("."):
        if not isinstance(options, dict) or key not in options:
            return None
        options = options[key]
    return options


def set_option(options: dict, path: str, value, kinds: dict[str, type | tuple]) -> dict:
    """A copy of the options with one of them set; an unknown path is a KeyError, another type a TypeError."""
    if path not in kinds:
        raise KeyError(f"no option {path}")
    if not isinstance(value, kinds[path]) or (isinstance(value, bool) and kinds[path] is not bool):
        raise TypeError(f"{path} takes {kinds[path]}")
    key, _, rest = path.partition(".")
    inner = options.get(key) if isinstance(options.get(key), dict) else {}
    return {**options, key: set_option(inner, rest, value, {rest: kinds[path]}) if rest else value}
