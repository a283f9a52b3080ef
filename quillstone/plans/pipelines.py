"""Whole runs: optimising a context, analysing a project, the two audits, their gates and reports.

Everything is a plan over entries or files; only a report's few rows are meant for the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone import functions as Q
from quillstone import sources
from quillstone.operators import analyzers, catalogue, memory, rules
from quillstone.operators.store import materialize

CONVERSATION_BOOST = 1.5
#: The categories of an analysis with their points, by the prefix of a rule.
CATEGORIES = [("ARCH", "architecture", 25.0), ("QUAL", "quality", 20.0), ("DB", "database", 20.0), ("SEC", "security", 15.0), ("TOK", "tokens", 10.0), ("DOC", "testdocs", 10.0)]
#: Most that a rule can cost.
CAPS = {"ARCH-001": 3.0, "ARCH-002": 3.0, "ARCH-003": 2.0, "ARCH-004": 5.0, "ARCH-006": 2.0, "ARCH-007": 3.0, "ARCH-008": 2.0, "ARCH-009": 1.0, "ARCH-010": 1.0, "SEC-001": 5.0, "SEC-008": 1.0, "TOK-004": 2.0, "TOK-005": 1.0} | {k: float(v) for k, v in (catalogue.DB_CAPS | catalogue.QUALITY_CAPS).items()}
#: Layers of the quick audits.
QUICK = {"secure": (1, 3, 4, 5), "comply": (1, 2, 3)}
#: Rules that read manifests; the first stands for a package audit, which needs a network and counts as passed.
MANIFEST_RULES = [*(f"SEC-SC-{i:03d}" for i in range(1, 9)), "SEC-DI-005"]
#: Layer and control of the rules of several conditions.
EXTRA = {"SEC-INJ-008": (3, "A03:2025"), "SEC-EX-004": (10, "A05:2025"), "CMP-DM-001": (5, "Art. 5(1)(c)")}
AUDITS = {
    "secure": (catalogue.SECURE, catalogue.SECURE_WEIGHTS, rules.SECURE_CAPS, (1,)),
    "comply": (catalogue.COMPLY, catalogue.COMPLY_WEIGHTS, rules.COMPLY_CAPS, ()),
}


def _rescored(entries: DataFrame, now_ms: int) -> DataFrame:
    return entries.withColumn("score", Q.engram_score(F.col("score"), F.lit(now_ms) - F.col("ts_ms"), F.col("ttl_s"), F.col("access_count"), F.col("critical")))


def optimize_entries(entries: DataFrame, now_ms: int, percent: float = 5.0, by: list[str] | None = None) -> DataFrame:
    """Adds tokens, state and kept: decay, then the best ``percent`` by TF-IDF, of which silent entries go too."""
    e = _rescored(entries, now_ms)
    e = e.withColumn("state", Q.state(F.col("score"), F.col("critical"))).withColumn("tokens", Q.token_estimate(F.col("content")))
    return memory.sparse_prune(e, percent, by).withColumn("kept", F.col("kept") & (F.col("state") != "silent"))


def optimize_transcripts(transcripts: DataFrame, text: str, session: str, now_ms: int, budget: int = 50_000, patterns: list[str] | None = None) -> DataFrame:
    """Adds tokens, priority, state and kept to a transcript's entries. Critical entries are marked by pattern; what
    was said is boosted before and after decay; each session is fitted to the budget."""
    e = sources.entries(sources.transcript_blocks(transcripts, text, session), now_ms, session=session)
    said = F.trim("content").rlike("^(User|Assistant):")
    boosted = lambda s: F.when(said, s * CONVERSATION_BOOST).otherwise(s)
    e = e.withColumn("critical", Q.is_critical(F.col("content"), patterns)).withColumn("score", boosted(F.when(F.col("critical"), 1.0).otherwise(F.col("score"))))
    e = _rescored(e, now_ms).withColumn("score", F.least(F.lit(1.0), boosted(F.col("score"))))
    e = materialize(e.withColumn("state", Q.state(F.col("score"), F.col("critical"))))  # read several times below
    return memory.budget_prune(e, budget, ["session"], now_ms)


def optimization_result(optimized: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, tokens before and after, and the states of what is kept, as one row (of each group)."""
    kept = F.col("kept")
    g = optimized.groupBy(*(by or [])).agg(
        F.count("*").alias("entries_processed"),
        F.count_if(kept).alias("entries_kept"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum(F.when(kept, F.col("tokens"))), F.lit(0)).alias("tokens_after"),
        *[F.count_if(kept & (F.col("state") == s)).alias(s) for s in ("active", "ready", "silent")],
    )
    return g.withColumn("reduction", F.when(F.col("tokens_before") > 0, (F.col("tokens_before") - F.col("tokens_after")) / F.col("tokens_before")).otherwise(0.0))


def optimized_context(optimized: DataFrame, session: str = "session") -> DataFrame:
    """The kept entries of each session in their order, one text a session."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "content")))
    return optimized.where("kept").groupBy(session).agg(F.array_join(F.transform(rows, lambda x: x["content"]), "\n").alias("context"))


def analyze(files: DataFrame, log: DataFrame | None = None, layers: dict[str, list[str]] | None = None, limits: analyzers.Limits = analyzers.Limits()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Findings, categories (points and score) and the total with its grade. Without any SQL the database category does not count."""
    plain = rules.evaluate(files, catalogue.ANALYZER).select("path", "rule_id", "severity", "deduction", F.col("line").cast("string").alias("detail"))
    found = plain.unionByName(analyzers.code_findings(files, limits)).unionByName(analyzers.graph_findings(files, log, layers, limits)).unionByName(analyzers.ratio_findings(files, limits))
    lost = rules.deductions(found, CAPS).withColumn("prefix", F.substring_index("rule_id", "-", 1)).groupBy("prefix").agg(F.sum("deducted").alias("lost"))
    table = files.sparkSession.createDataFrame(CATEGORIES, "prefix string, category string, max_points double")
    sql = files.agg(F.coalesce(F.max(F.col("path").endswith(".sql") | F.coalesce("content", F.lit("")).rlike(analyzers.SQL)), F.lit(False)).alias("has_sql"))
    c = table.join(lost, "prefix", "left").crossJoin(F.broadcast(sql))  # six rows and one
    c = c.select("category", "max_points", F.greatest(F.lit(0.0), F.col("max_points") - F.coalesce("lost", F.lit(0.0))).alias("score"), ((F.col("category") == "database") & ~F.col("has_sql")).alias("na"))
    return found, c, rules.weighted_score(c)


def chosen_rules(kind: str, layers: list[int] | None = None, quick: bool = False) -> list[rules.Rule]:
    return [r for r in AUDITS[kind][0] if (not layers or r.layer in layers) and (not quick or r.layer in QUICK[kind])]


def _manifest_layer(rule_id: F.Column) -> F.Column:
    return F.when(rule_id.startswith("SEC-SC-"), 6).otherwise(8)


def _in_audit(kind: str, layers: list[int] | None, quick: bool) -> F.Column:
    wanted = set(layers or range(1, len(AUDITS[kind][1]) + 1)) & set(QUICK[kind] if quick else range(1, 12))
    return F.col("layer").isin(sorted(wanted))


def audit_findings(files: DataFrame, kind: str, layers: list[int] | None = None, quick: bool = False) -> DataFrame:
    """(path, rule_id, layer, severity, line, title, control, effort) of the ``secure`` or ``comply`` rules; path is null for project rules."""
    todo = chosen_rules(kind, layers, quick)
    per_file = rules.evaluate(files, todo).select("path", "rule_id", "layer", "severity", F.col("line").cast("int").alias("line"), "title")
    whole = rules.evaluate_project(files, todo).where("issue").select(F.lit(None).cast("string").alias("path"), "rule_id", "layer", "severity", F.lit(None).cast("int").alias("line"), "title")
    found = per_file.unionByName(whole)
    more = analyzers.extra_audit_findings(files).where(F.col("rule_id").startswith("SEC" if kind == "secure" else "CMP"))
    at = F.element_at(F.create_map(*[F.lit(x) for kv in EXTRA.items() for x in (kv[0], kv[1][0])]), F.col("rule_id"))
    more = more.select("path", "rule_id", at.alias("layer"), "severity", F.lit(None).cast("int").alias("line"), F.col("rule_id").alias("title"))
    found = found.unionByName(more.where(_in_audit(kind, layers, quick)))
    control = F.create_map(*[F.lit(x) for x in (y for r in AUDITS[kind][0] for y in (r.id, r.regulation))], *[F.lit(x) for k, v in EXTRA.items() for x in (k, v[1])])
    effort = F.create_map(*[F.lit(x) for r in AUDITS[kind][0] for x in (r.id, r.effort)])
    if kind == "secure":
        m = analyzers.manifest_findings(files).select("path", "rule_id", _manifest_layer(F.col("rule_id")).alias("layer"), "severity", F.lit(None).cast("int").alias("line"), F.col("rule_id").alias("title"))
        found = found.unionByName(m.where(_in_audit(kind, layers, quick)))
    return found.select("*", F.coalesce(control[F.col("rule_id")], F.when(F.col("layer") == 8, "A08:2025").otherwise("A06:2025")).alias("control"), F.coalesce(effort[F.col("rule_id")], F.lit("immediate")).alias("effort"))


def audit_scores(files: DataFrame, kind: str, layers: list[int] | None = None, quick: bool = False) -> DataFrame:
    """(layer, weight, passed, total, score, grade) of each layer."""
    weights = AUDITS[kind][1]
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("layer"))
    c = rules.checks(files, chosen_rules(kind, layers, quick), AUDITS[kind][3])
    if kind == "secure":
        bad = analyzers.manifest_findings(files).select("rule_id").distinct()
        names = files.sparkSession.createDataFrame([(r,) for r in MANIFEST_RULES], "rule_id string")
        m = names.join(F.broadcast(bad.withColumn("bad", F.lit(True))), "rule_id", "left")  # one row for each rule
        m = m.select("rule_id", _manifest_layer(F.col("rule_id")).alias("layer"), F.when(F.col("bad"), 0).otherwise(1).cast("long").alias("passed"), F.lit(1).cast("long").alias("total"))
        c = c.unionByName(m.where(_in_audit(kind, layers, quick)))
    hit = analyzers.extra_audit_findings(files).groupBy("rule_id").agg(F.count("*").alias("n"))
    prefix = "SEC" if kind == "secure" else "CMP"
    e = files.sparkSession.createDataFrame([(k, v[0]) for k, v in EXTRA.items() if k.startswith(prefix)], "rule_id string, layer int").join(F.broadcast(hit), "rule_id", "left")  # one row for each rule
    n = F.coalesce("n", F.lit(0)).cast("long")
    c = c.unionByName(e.select("rule_id", "layer", (F.greatest(n, F.lit(1)) - n).alias("passed"), F.greatest(n, F.lit(1)).alias("total")).where(_in_audit(kind, layers, quick)))
    return rules.layer_scores(c.select("layer", weight.alias("weight"), "passed", "total"))


def audit_total(scores: DataFrame, findings: DataFrame, kind: str) -> DataFrame:
    return rules.capped_total(scores, findings, AUDITS[kind][2])


def gate(total: DataFrame, findings: DataFrame, min_grade: str | None = None, fail_on: str | None = None) -> DataFrame:
    """(passed): the grade is at least ``min_grade`` and no finding is as severe as ``fail_on``; with neither, none is critical."""
    order = F.array(*[F.lit(g) for _, g in Q.AUDIT_GRADES])
    severe = findings.agg(F.coalesce(F.max(rules.meets(F.col("severity"), fail_on or "critical")), F.lit(False)).alias("severe"))
    x = total.crossJoin(F.broadcast(severe))  # one row each
    low = F.array_position(order, F.col("grade")) > F.array_position(order, F.lit(min_grade)) if min_grade else F.lit(False)
    bad = F.col("severe") if fail_on or not min_grade else F.lit(False)
    return x.select("total", "grade", (~(low | bad)).alias("passed"))


def report_json(findings: DataFrame) -> DataFrame:
    """One JSON line for each finding, the most severe first within a file of the sink."""
    rank = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in rules.RANKS.items()], F.lit(9))
    return findings.sortWithinPartitions(rank, "rule_id", "path").select(F.to_json(F.struct(*findings.columns)).alias("value"))


def report_markdown(findings: DataFrame, per_rule: int = 5) -> DataFrame:
    """One Markdown section for each severity, in order; at most ``per_rule`` findings of a rule are listed (the report's feature)."""
    rank = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in rules.RANKS.items()], F.lit(9))
    shown = rules.cap(findings, per_rule)
    line = F.concat(F.lit("- **"), F.col("rule_id"), F.lit("** "), F.coalesce(F.concat(F.lit("`"), "path", F.lit("`")), F.lit("project")))
    g = shown.groupBy(rank.alias("rank"), "severity").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return g.select("rank", "severity", F.concat(F.lit("## "), F.initcap("severity"), F.lit("\n\n"), "body").alias("section")).orderBy("rank", "severity")


#: What a finding says about the data that is handled, as rule, category and type.
DATA_TYPES = [("CMP-PD-001", "pii", "email"), ("CMP-PD-002", "pii", "name"), ("CMP-PD-003", "pii", "phone"), ("CMP-PD-004", "pii", "address"), ("CMP-PD-005", "sensitive", "national-id"), ("CMP-PD-006", "pii", "date-of-birth"), ("CMP-PD-007", "behavioral", "ip-address"), ("CMP-PD-008", "behavioral", "geolocation"), ("CMP-PD-009", "biometric", "biometric"), ("CMP-PD-010", "health", "sensitive-category"), ("CMP-PD-011", "financial", "financial")]


def data_flow(findings: DataFrame) -> DataFrame:
    """(data_type, category, collection_point, has_consent, has_encryption, has_retention) of the kinds of personal data
    that the compliance audit found; the collection point is the first file by name."""
    table = findings.sparkSession.createDataFrame(DATA_TYPES, "rule_id string, category string, data_type string")
    seen = findings.groupBy("rule_id").agg(F.min("path").alias("collection_point"))
    flags = findings.agg(*[(~F.coalesce(F.max(F.col("rule_id") == r), F.lit(False))).alias(n) for r, n in (("CMP-DP-001", "has_encryption"), ("CMP-DM-002", "has_retention"))])
    out = table.join(seen, "rule_id").crossJoin(F.broadcast(flags))  # at most eleven rows and one
    return out.select("data_type", "category", "collection_point", F.lit(False).alias("has_consent"), "has_encryption", "has_retention")
