"""Queries over files, plans of work, counters and streams; registered when ``registry`` is imported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone import functions as Q
from quillstone import streaming
from quillstone.operators import catalogue, memory, project, rules, tokens, workflow
from quillstone.plans import registry as r
from quillstone.plans.registry import query

#: Pages as files of four folders and five kinds.
PAGES = "f AS (SELECT page_id, 'src/d' || page_id % 4 || '/f' || page_id || ['.ts', '.tsx', '.js', '.css', '.md'][page_id % 5 + 1] AS path, html AS content FROM pages)"


def page_tree(t) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".tsx", ".js", ".css", ".md")]), (F.col("page_id") % 5 + 1).cast("int"))
    return t("pages").select("page_id", F.concat(F.lit("src/d"), (F.col("page_id") % 4).cast("string"), F.lit("/f"), F.col("page_id").cast("string"), ext).alias("path"), F.col("html").alias("content"))


@query(f"WITH {PAGES}, e AS (SELECT regexp_extract(path, '\\.([a-z]+)$', 1) AS x FROM f), g(tag, pos, x) AS (VALUES ('typescript', 1, 'ts'), ('typescript', 1, 'tsx'), ('typescript', 1, 'js'), ('react', 2, 'tsx'), ('dotnet', 3, 'cs'), ('sql', 4, 'sql')) SELECT string_agg(tag, ',' ORDER BY pos) AS tags FROM (SELECT DISTINCT tag, pos FROM g JOIN e USING (x))")
def stack_tags(t):
    return project.stack_tags(page_tree(t)).select(F.array_join("tags", ",").alias("tags"))


@query(f"WITH {PAGES} SELECT path, len(string_split(content, chr(10))) AS lines FROM f WHERE NOT regexp_matches(path, 'css|md')")
def module_lines(t):
    return project.modules(page_tree(t))


@query(f"""WITH {PAGES}, m AS (SELECT 'src/' || string_split(path, '/')[2] AS dir, path, string_split(path, '/')[3] || ' (' || len(string_split(content, chr(10))) || 'L)' AS name FROM f WHERE NOT regexp_matches(path, 'css|md')),
k AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY path) AS k FROM m) SELECT dir, count(*) AS files, string_agg(name, ', ' ORDER BY path) FILTER (k <= 8) AS names FROM k GROUP BY dir""")
def directory_summary(t):
    return project.directories(project.modules(page_tree(t)))


@query(f"WITH {PAGES} SELECT f.path FROM f JOIN pages USING (page_id) WHERE contains(url, '?') OR contains(url, '#')")
def changed_files(t):
    f, urls = page_tree(t), t("pages").select("page_id", "url")
    named = lambda s: f.join(urls.where(F.col("url").contains(s)), "page_id").select("path")
    return project.changed_files(f, named("?"), named("#")).select("path")


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id = 17")
def memory_get(t):
    return memory.get(r.doc_entries(t), 17).select("id", "source")


@query("SELECT doc_id AS id FROM documents")
def memory_keys(t):
    return memory.keys(r.doc_entries(t))


@query(f"SELECT event_id AS id, {r.NOW_MS}::BIGINT AS ts_ms, 172800::BIGINT AS ttl_s FROM events")
def refresh_ttl(t):
    return memory.refresh_ttl(r.event_entries(t), r.NOW_MS, 48).select("id", "ts_ms", "ttl_s")


@query("SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE lang = 'en' AND text IS NOT NULL) AS hit FROM documents")
def cache_split(t):
    d = t("documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    return workflow.cache_split(d, d.where("lang = 'en'")).select("doc_id", "hit")


@query("""WITH m AS (SELECT ts, event_id AS seq, value AS duration, event_id % 1000 + 1 AS b, (event_id % 1000 + 1) // 2 AS a, event_id % 40 AS processed, (event_id % 3) / 2.0 AS rate FROM events),
n AS (SELECT * FROM m ORDER BY ts DESC, seq DESC LIMIT 1000), w AS (SELECT avg(duration) AS mean_latency, sum(floor(processed * rate + 0.5)) FILTER (rate > 0)::BIGINT AS hits, (sum(processed) FILTER (rate > 0))::BIGINT AS asked FROM m)
SELECT count(*) AS runs, round(sum(duration), 4) AS duration, sum(b - a)::BIGINT AS saved, round(sum(b - a) / sum(b), 6) AS reduction, quantile_disc(duration, 0.5) AS p50, quantile_disc(duration, 0.95) AS p95, quantile_disc(duration, 0.99) AS p99,
round(any_value(mean_latency), 6) AS mean_latency, any_value(hits) AS hits, any_value(asked - hits) AS misses, round(any_value(hits / asked), 6) AS cache_rate FROM n, w""")
def metrics_snapshot(t):
    e = F.col("event_id")
    m = t("events").select("ts", e.alias("seq"), F.col("value").alias("duration"), (e % 1000 + 1).alias("tokens_before"), F.floor((e % 1000 + 1) / 2).alias("tokens_after"), (e % 40).alias("processed"), ((e % 3) / 2.0).alias("hit_rate"))
    s = workflow.metrics_snapshot(m)
    return s.withColumns({c: F.round(c, 4 if c == "duration" else 6) for c in ("duration", "reduction", "mean_latency", "cache_rate")})


@query("""WITH o AS (SELECT user_id AS session, event_type AS tool, floor(value * 1000)::BIGINT AS b, floor(value * 250)::BIGINT AS a FROM events)
SELECT session, tool, count(*) AS compressed, sum(b)::BIGINT AS tokens_before, sum(a)::BIGINT AS tokens_after FROM o GROUP BY ALL UNION ALL SELECT session, '*', count(*), sum(b)::BIGINT, sum(a)::BIGINT FROM o GROUP BY session""")
def compression_stats(t):
    return workflow.compression_stats(t("events").select(F.col("user_id").alias("session"), F.col("event_type").alias("tool"), F.floor(F.col("value") * 1000).alias("tokens_before"), F.floor(F.col("value") * 250).alias("tokens_after")))


@query(f"WITH {r.FIND} SELECT path, rule_id, deduction AS points, CASE rule_id WHEN 'DOC-SECRET' THEN 'low' WHEN 'DOC-IP' THEN 'high' ELSE 'medium' END AS effort FROM f")
def action_items(t):
    f = r.findings(t)
    kind = F.when(F.col("rule_id") == "DOC-SECRET", "replace-pattern").when(F.col("rule_id") == "DOC-IP", "refactor").when(F.col("rule_id") == "DOC-EMAIL", "add-docs")
    return rules.action_items(f.withColumn("fix_type", kind)).select("path", "rule_id", "points", "effort")


#: Controls of two frameworks that the demonstration rules are held against.
DEMO_CONTROLS = [("DOC-EMAIL", "gdpr", "Art. 5"), ("DOC-SECRET", "gdpr", "Art. 32"), ("DOC-IP", "soc2", "CC6.1"), ("DOC-LICENSE", "soc2", "CC2.2")]


@query(f"""WITH {r.FIND}, d(rule_id, framework, control) AS (VALUES {", ".join(map(str, DEMO_CONTROLS))}), g AS (SELECT framework, control, count(*) AS n, bool_or(severity IN ('critical', 'high')) AS bad FROM f JOIN d USING (rule_id) GROUP BY ALL),
k AS (SELECT 'gdpr' AS framework, unnest({catalogue.GDPR!r}) AS control UNION ALL SELECT 'soc2', unnest({catalogue.SOC2!r})), m AS (SELECT framework, control, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'pass' WHEN bad THEN 'fail' ELSE 'partial' END AS status FROM k LEFT JOIN g USING (framework, control))
SELECT *, floor(avg(CASE WHEN status = 'pass' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY framework) * 100 + 0.5)::INT AS rate FROM m""")
def framework_matrices(t):
    d = t("documents").sparkSession.createDataFrame(DEMO_CONTROLS, "rule_id string, framework string, control string")
    return rules.framework_matrices(r.findings(t).join(F.broadcast(d), "rule_id"), catalogue.CONTROLS, "gdpr, SOC2")


@query(f"WITH {r.FIND}, g AS (SELECT 'docs/' || path AS path, rule_id FROM f) SELECT path, rule_id FROM g WHERE NOT (rule_id IN ('DOC-EMAIL', 'DOC-IP') AND regexp_matches(path, '^docs/[^/]*1[^/]*$')) AND NOT regexp_matches(path, '^(?:[^/]+/)*[^/]*7$')")
def rule_suppression(t):
    f = r.findings(t).withColumn("path", F.concat(F.lit("docs/"), F.col("path").cast("string")))
    return rules.suppressed(f, [("docs/*1*", ["DOC-EMAIL", "DOC-IP"]), ("**/*7", [])]).select("path", "rule_id")


@query(f"WITH {r.FIND} SELECT path, rule_id FROM f JOIN documents d ON d.doc_id = path WHERE line = 1 OR NOT contains(string_split(text, chr(10))[(line - 1)::INT], 'a')")
def line_suppression(t):
    files = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return rules.line_suppressed(r.findings(t), files, "a").select("path", "rule_id")


@query(r"""WITH l AS (SELECT page_id, unnest(string_split(html, chr(10))) AS x, generate_subscripts(string_split(html, chr(10)), 1) AS line FROM pages), h AS (SELECT *, x[1:instr(x, 'href') - 1] AS b FROM l WHERE contains(x, 'href'))
SELECT page_id, line, (length(b) - length(replace(b, '/', '')) - (length(b) - length(replace(b, '\/', ''))) // 2) % 2 = 1 OR regexp_matches(x, '(?i)new\s+RegExp\s*\(|(?:pattern|regex)\s*[:=]\s*/') AS guarded FROM h""")
def pattern_guard(t):
    ls = t("pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line", "x")).where(F.col("x").contains("href"))
    return ls.select("page_id", (F.col("line") + 1).alias("line"), rules.in_pattern(F.col("x"), F.instr("x", "href") - 1).alias("guarded"))


@query(f"""WITH {r.AGED}, k AS (SELECT count(*) AS n, count(*) FILTER (state = 'active') AS a, count(*) FILTER (state = 'ready') AS b, count(*) FILTER (state = 'silent') AS c FROM st), g AS (WITH {r.DEBT} SELECT count(*) FILTER (status = 'open') AS open, count(*) FILTER (due < TIMESTAMP '1998-01-01' AND status <> 'resolved') AS overdue FROM d)
SELECT 0 AS pos, 'Entries: ' || n || ' (' || concat_ws(' ', CASE WHEN a > 0 THEN 'Active:' || a END, CASE WHEN b > 0 THEN 'Ready:' || b END, CASE WHEN c > 0 THEN 'Silent:' || c END) || ')' AS line FROM k UNION ALL SELECT 2, 'Debt: ' || open || ' open, ' || overdue || ' overdue' FROM g""")
def dashboard(t):
    return workflow.dashboard(r.scored_events(t), None, r.debts(t), r.now())


@query()
def bpe_count(t):
    """Exact token counts by a public tokenizer's file; no SQL form, held against the tokenizer in the tests."""
    import public_tokenizers

    return t("documents").select("doc_id", tokens.bpe_count(public_tokenizers.path("byte_bpe_50k.json"))("text").alias("tokens"))


PLANS = """s AS (SELECT l_orderkey AS id, l_linenumber AS n, floor(l_quantity)::BIGINT AS estimated, CASE WHEN l_orderkey = 1 AND l_linenumber = 1 THEN 'failed' WHEN l_returnflag = 'R' THEN 'skipped' WHEN l_linestatus = 'F' THEN 'completed' WHEN l_returnflag = 'N' AND l_quantity < 5 THEN 'pending' ELSE 'completed' END AS status FROM lineitem)"""


def plans(t) -> DataFrame:
    st = F.when(F.col("l_returnflag") == "R", "skipped").when(F.col("l_linestatus") == "F", "completed").when((F.col("l_returnflag") == "N") & (F.col("l_quantity") < 5), "pending").otherwise("completed")
    step = F.struct(F.col("l_linenumber").cast("int").alias("order"), F.lit("read").alias("action"), F.col("l_partkey").cast("string").alias("target"), F.floor("l_quantity").alias("estimated"), st.alias("status"), F.lit(None).cast("string").alias("result"))
    return t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("id")).agg(F.array_sort(F.collect_list(step)).alias("steps")).withColumns({"status": F.lit("executing"), "task": F.concat(F.lit("order "), "id")})


@query(f"""WITH {PLANS}, g AS (SELECT id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'pending') AS pending, count(*) AS n, coalesce(sum(estimated) FILTER (status = 'completed'), 0)::BIGINT AS tokens_used FROM s GROUP BY id)
SELECT id::VARCHAR AS id, completed, failed, skipped, tokens_used, failed = 0 AND completed = n AS success, CASE WHEN pending > 0 THEN 'executing' WHEN failed = 0 AND completed = n THEN 'completed' ELSE 'failed' END AS status FROM g""")
def plan_status(t):
    p = plans(t)
    if p.where("id = '1'").where(F.exists("steps", lambda s: s["order"] == 1)).limit(1).count():
        p = workflow.update_step(p, "1", 1, "failed", "not found")
    return workflow.verify_plans(p).select("id", "completed", "failed", "skipped", "tokens_used", "success", "status")


@query(f"""WITH {r.DEBT}, m AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos, replace(text[1:200], chr(10), ' ') AS line FROM documents WHERE lang = 'en' ORDER BY doc_id DESC LIMIT 5),
o AS (SELECT row_number() OVER (ORDER BY severity, id) - 1 AS pos, '[' || severity || '] debt ' || id AS line FROM d WHERE status <> 'resolved' AND due < TIMESTAMP '1998-01-01' ORDER BY severity, id LIMIT 3),
p AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pos, 'order ' || id AS line FROM (SELECT DISTINCT l_orderkey::VARCHAR AS id FROM lineitem ORDER BY id LIMIT 5))
SELECT 'memory' AS section, pos, line FROM m UNION ALL SELECT 'debt', * FROM o UNION ALL SELECT 'plans', * FROM p""")
def session_briefing(t):
    e = r.doc_entries(t).join(t("documents").select(F.col("doc_id").alias("id"), "lang"), "id").select("id", "content", F.lit(0.9).alias("score"), F.col("id").alias("ts_ms"), (F.col("lang") == "en").alias("critical"))
    d = r.debts(t).withColumn("description", F.concat(F.lit("debt "), F.col("id").cast("string")))
    return workflow.briefing(e, d, plans(t), r.now())


def stream_of(t, name: str) -> DataFrame:
    """The table as a stream: the source lists one file of the table's folder."""
    spark, path = t(name).sparkSession, t(name).inputFiles()
    folder = path[0].rsplit("/", 1)[0] if path else ""
    single = folder.endswith(f"{name}.parquet")
    reader = spark.readStream.schema(t(name).schema)
    return reader.parquet(folder) if single else reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@query(r.SQL["doc_frequency"])
def stream_df_delta(t):
    rows = stream_of(t, "documents").select(F.col("text").alias("content"), F.lit(1).cast("long").alias("sign"))
    return streaming.drain(streaming.document_frequency_deltas(rows), "complete", last=True)


def stream_entries(t) -> DataFrame:
    c = stream_of(t, "conversations")
    return c.select(F.col("conv_id").cast("string").alias("session"), F.col("text").alias("content"), F.col("turn").cast("long").alias("ts_ms"), F.lit(86_400).cast("long").alias("ttl_s"), F.lit(0.8).alias("score"), F.lit(0).cast("long").alias("access_count"), (F.col("role") == "system").alias("critical"))


CONV = f"c AS (SELECT conv_id::VARCHAR AS session, coalesce(text, '') AS x, count(*) AS n FROM conversations GROUP BY ALL), k AS (SELECT *, {r.EST.format('x')} AS tokens FROM c)"


@query(f"WITH {CONV} SELECT session, sum(n)::BIGINT AS total_rows, count(*) AS distinct_rows, count(*) AS kept, sum(tokens)::BIGINT AS tokens FROM k GROUP BY session")
def stream_ingest(t):
    rows = stream_entries(t).withColumn("tokens", Q.token_estimate(F.col("content")))
    return streaming.drain(streaming.ingest(rows, 1 << 40, 1 << 30)).select("session", "total_rows", "distinct_rows", "kept", "tokens")


@query(f"WITH {CONV} SELECT session, sum(n)::BIGINT AS rows, (sum(n) - count(*))::BIGINT AS hits, sum(tokens)::BIGINT AS tokens_before, count(*) AS kept FROM k GROUP BY session")
def stream_optimize(t):
    return streaming.drain(streaming.optimize(stream_entries(t), 1 << 40, most=1 << 30)).select("session", "rows", "hits", "tokens_before", "kept")
