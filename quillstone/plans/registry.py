"""Queries over the driver's tables, each with the DuckDB statement of the same result.

The tables are neither transcripts nor code, so every operator is shown on a documented view of them:
documents and conversations as entries, events as scored memories, orders as debts, lineitem and nations as
graphs, pages as files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import functions as Q
from quillstone import sources
from quillstone.operators import analyzers, graph, memory, rules, search, store, summaries
from quillstone.operators.catalogue import OWASP
from quillstone.plans import pipelines

FLAGSHIP = "sparse_prune_source"
NOW_MS = 1_706_659_200_000  # 2024-01-31 00:00:00 UTC
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register a query; ``sql`` is its oracle."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


TOKS = r"list_filter(regexp_split_to_array(lower(coalesce({}, '')), '\s+'), lambda x: x <> '')"
EST = r"greatest(ceil(len(list_filter(regexp_split_to_array(coalesce({0}, ''), '\s+'), lambda x: x <> '')) * 0.75), ceil(length(coalesce({0}, '')) / 4.0))::BIGINT"


def doc_entries(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("id"), "source", F.col("doc_id").alias("pos"), F.col("text").alias("content"))


@query(f"SELECT doc_id, {EST.format('text')} AS tokens FROM documents")
def token_estimate(t):
    return t("documents").select("doc_id", Q.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, sha256(text) AS hash, substr(sha256('R::' || source || '::' || lang), 1, 16) AS fingerprint FROM documents")
def content_hash_fingerprint(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("hash"), Q.fingerprint(F.lit("R"), F.col("source"), F.col("lang")).alias("fingerprint"))


@query(f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKS.format('text')})) AS term FROM documents) GROUP BY term")
def doc_frequency(t):
    return memory.document_frequency(t("documents"), "text")


TFIDF = f"""t AS (SELECT doc_id, source, unnest({TOKS.format('text')}) AS term, len({TOKS.format('text')}) AS n FROM documents),
c AS (SELECT doc_id, source, n, term, count(*) AS c FROM t GROUP BY ALL)"""


@query(f"""WITH {TFIDF}, df AS (SELECT term, count(*) AS df FROM c GROUP BY term), s AS (
SELECT doc_id, sum(sqrt(c) * ln((SELECT count(*) FROM documents) / df)) / any_value(n) AS s FROM c JOIN df USING (term) GROUP BY doc_id)
SELECT d.doc_id AS id, round(coalesce(s, 0), 6) AS tfidf FROM documents d LEFT JOIN s USING (doc_id)""")
def tfidf_score(t):
    return memory.tfidf(doc_entries(t)).select("id", F.round("tfidf", 6).alias("tfidf"))


@query(f"""WITH {TFIDF}, df AS (SELECT source, term, count(*) AS df FROM c GROUP BY ALL), n AS (SELECT source, count(*) AS N FROM documents GROUP BY 1), s AS (
SELECT doc_id, sum(sqrt(c) * ln(N / df)) / any_value(n) AS s FROM c JOIN df USING (source, term) JOIN n USING (source) GROUP BY doc_id),
x AS (SELECT d.doc_id AS id, source, round(coalesce(s, 0), 6) AS tfidf FROM documents d LEFT JOIN s USING (doc_id))
SELECT id, source, tfidf, row_number() OVER (PARTITION BY source ORDER BY tfidf DESC, id) <= greatest(1, ceil(count(*) OVER (PARTITION BY source) * 5 / 100.0)) AS kept FROM x""".replace("any_value(n)", "any_value(c.n)").replace("N / df", "n.N / df"))
def sparse_prune_source(t):
    return memory.sparse_prune(doc_entries(t), by=["source"]).select("id", "source", "tfidf", "kept")


@query(SQL["sparse_prune_source"].replace("(source, term)", "(term)").replace("SELECT source, term, count(*) AS df", "SELECT term, count(*) AS df").replace("JOIN n USING (source)", "CROSS JOIN n").replace("SELECT source, count(*) AS N FROM documents GROUP BY 1", "SELECT count(*) AS N FROM documents").replace("PARTITION BY source ORDER", "ORDER").replace("OVER (PARTITION BY source)", "OVER ()").replace("SELECT id, source, tfidf,", "SELECT id, tfidf,"))
def sparse_prune_corpus(t):
    return memory.sparse_prune(doc_entries(t)).select("id", "tfidf", "kept")


def event_entries(t) -> DataFrame:
    base = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "purchase", 0.8).when(F.col("event_type") == "click", 0.7).otherwise(0.5)
    return t("events").select(F.col("event_id").alias("id"), "user_id", F.col("event_id").alias("pos"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), base.alias("score"), F.lit(86400).cast("long").alias("ttl_s"), (F.col("event_id") % 4).alias("access_count"), (F.col("event_type") == "error").alias("critical"), F.array("event_type").alias("tags"), F.col("event_type").alias("content"))


EV = "e AS (SELECT event_id AS id, user_id, event_type, epoch_ms(ts) AS ts_ms, CASE event_type WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 0.8 WHEN 'click' THEN 0.7 ELSE 0.5 END AS score, event_id % 4 AS access_count, event_type = 'error' AS critical FROM events)"
AGED = f"""{EV}, d AS (SELECT *, {NOW_MS} - ts_ms AS age, CASE WHEN {NOW_MS} - ts_ms <= 0 THEN 0.0 ELSE least(1.0, 1 - exp(-({NOW_MS} - ts_ms) / 86400000.0)) END AS decay FROM e),
s1 AS (SELECT *, score * (1 - decay) AS s FROM d), s2 AS (SELECT * REPLACE (CASE WHEN access_count > 0 THEN least(1.0, s + 0.1 * ln(access_count + 1.0)) ELSE s END AS s) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN critical THEN greatest(s, 0.9) ELSE s END AS s) FROM s2),
s4 AS (SELECT * REPLACE (greatest(0.0, least(1.0, CASE WHEN NOT critical AND age >= 0 AND age < 1800000 THEN s * (1 + 0.3 * (1 - age / 1800000.0)) ELSE s END)) AS s) FROM s3),
st AS (SELECT *, CASE WHEN critical OR s >= 0.7 THEN 'active' WHEN s >= 0.3 THEN 'ready' ELSE 'silent' END AS state FROM s4)"""


def scored_events(t) -> DataFrame:
    e = event_entries(t)
    e = e.withColumn("score", Q.engram_score(F.col("score"), F.lit(NOW_MS) - F.col("ts_ms"), F.col("ttl_s"), F.col("access_count"), F.col("critical")))
    return e.withColumn("state", Q.state(F.col("score"), F.col("critical")))


@query(f"WITH {AGED} SELECT id, round(s, 6) AS score, state FROM st")
def engram_score(t):
    return scored_events(t).select("id", F.round("score", 6).alias("score"), "state")


@query(f"WITH {AGED} SELECT state, count(*) AS n FROM st GROUP BY state")
def state_distribution(t):
    return scored_events(t).groupBy("state").agg(F.count("*").alias("n"))


@query(f"WITH {AGED} SELECT id, round(s, 6) AS score FROM (SELECT *, round(s, 9) AS r FROM st) WHERE state = 'active' AND r >= 0.7 AND event_type = 'error' ORDER BY r DESC, id LIMIT 50 OFFSET 10")
def memory_query(t):
    e = scored_events(t).withColumn("score", F.round("score", 9))
    return memory.query(e, state="active", low=0.7, tags=["error"], limit=50, offset=10).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {EV} SELECT id FROM e WHERE critical OR NOT (ts_ms + 86400000 < {NOW_MS} OR 1 - exp(-({NOW_MS} - ts_ms) / 86400000.0) >= 0.95)")
def ttl_compact(t):
    return memory.compact(event_entries(t), NOW_MS).select("id")


@query(f"""WITH {EV}, w AS (SELECT *, min(ts_ms) OVER (PARTITION BY user_id) AS lo, max(ts_ms) OVER (PARTITION BY user_id) AS hi FROM e),
h AS (SELECT id, user_id, ts_ms, CASE WHEN critical THEN 2.0 ELSE 0.4 * ((ts_ms - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END) + 0.6 * score END AS hybrid FROM w)
SELECT id, round(hybrid, 6) AS hybrid, row_number() OVER (PARTITION BY user_id ORDER BY round(hybrid, 9) DESC, ts_ms DESC, id) <= 20 AS kept FROM h""")
def hybrid_eviction(t):
    return memory.hybrid_evict(event_entries(t), 20, ["user_id"]).select("id", F.round("hybrid", 6).alias("hybrid"), "kept")


def conv_entries(t) -> DataFrame:
    c = t("conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", F.col("turn").alias("pos"), F.col("text").alias("content"), (F.lit(NOW_MS) - F.col("turn") * 3_600_000).alias("ts_ms"), F.lit(0.8).alias("score"), F.lit(86400).cast("long").alias("ttl_s"), F.lit(0).cast("long").alias("access_count"), (F.col("role") == "system").alias("critical"))


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, len({TOKS.format('text')}) AS n, unnest({TOKS.format('text')}) AS term FROM conversations), c AS (SELECT conv_id, turn, n, term, count(*) AS c FROM t GROUP BY ALL),
df AS (SELECT conv_id, term, count(*) AS df FROM c GROUP BY ALL), z AS (SELECT conv_id, count(*) AS docs FROM conversations GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(sqrt(c.c) * ln(z.docs / df.df)) / any_value(c.n) AS s FROM c JOIN df USING (conv_id, term) JOIN z USING (conv_id) GROUP BY ALL),
e AS (SELECT v.conv_id, turn, role = 'system' AS critical, {EST.format('text')} AS tokens, coalesce(s, 0) AS s, turn * 3600000 AS age FROM conversations v LEFT JOIN s USING (conv_id, turn)),
p AS (SELECT *, 0.8 * CASE WHEN age <= 0 THEN 1.0 ELSE exp(-age / 86400000.0) END AS a FROM e),
q AS (SELECT *, CASE WHEN critical THEN -age::DOUBLE ELSE round(s * least(1.0, CASE WHEN age < 1800000 THEN a * 1.3 ELSE a END) * 2, 9) END AS o FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY critical DESC, o DESC, turn) AS r FROM q),
w AS (SELECT conv_id, r, critical, tokens <= CASE WHEN critical THEN 400 ELSE 500 END AS kept, CASE WHEN tokens <= CASE WHEN critical THEN 400 ELSE 500 END THEN tokens ELSE 0 END AS used, tokens AS f, critical AND tokens <= 400 AS got FROM o WHERE r = 1
UNION ALL SELECT conv_id, r, critical, u + tokens <= lim, u + CASE WHEN u + tokens <= lim THEN tokens ELSE 0 END, f, got OR (critical AND u + tokens <= lim)
FROM (SELECT o.*, w.f, w.got, CASE WHEN o.critical THEN 400 ELSE 500 END AS lim, CASE WHEN w.critical AND NOT o.critical AND NOT w.got THEN w.f ELSE w.used END AS u FROM w JOIN o ON o.conv_id = w.conv_id AND o.r = w.r + 1))
SELECT conv_id * 1000 + turn AS id, conv_id, tokens, w.kept OR (r = 1 AND o.critical AND NOT bool_or(w.got) OVER (PARTITION BY conv_id)) AS kept FROM o JOIN w USING (conv_id, r)""")
def budget_prune(t):
    return memory.budget_prune(conv_entries(t), 500, ["conv_id"], NOW_MS).select("id", "conv_id", "tokens", "kept")


@query("""WITH s AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END || replace(coalesce(text, ''), chr(10), ' '), chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
l AS (SELECT conv_id, unnest(string_split(t, chr(10))) AS content, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM s),
b AS (SELECT *, sum(CASE WHEN regexp_matches(content, '^\\s*(User|Assistant):') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY line) AS block FROM l)
SELECT conv_id, block, CASE WHEN bool_or(regexp_matches(content, '^\\s*(User|Assistant):')) THEN 'conversation' ELSE 'other' END AS kind, count(*) AS n_lines FROM b GROUP BY ALL
HAVING trim(string_agg(content, '')) <> ''""")
def transcript_blocks(t):
    said = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise(""), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    s = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("t"))
    return sources.transcript_blocks(s, "t", "conv_id").select("conv_id", F.col("block").cast("long").alias("block"), "kind", F.size(F.split("content", "\n")).cast("long").alias("n_lines"))


@query("SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN 'conversation' ELSE 'other' END AS kind, sha256(text) AS hash FROM conversations WHERE trim(coalesce(text, '')) <> ''")
def jsonl_messages(t):
    j = t("conversations").select("conv_id", "turn", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("value"))
    return sources.jsonl_messages(j, "value", "conv_id", "turn").select("conv_id", "turn", "kind", F.sha2("content", 256).alias("hash"))


@query("SELECT doc_id, count(*) AS n, sum(length(x)) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x) <> '' GROUP BY doc_id")
def line_entries(t):
    return sources.lines(t("documents"), "text", "doc_id", keep_blank=False).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query(r"SELECT page_id, sum(CASE WHEN regexp_replace(p, '^\s+|\s+$', '', 'g') <> '' THEN 1 ELSE 0 END)::BIGINT AS n FROM (SELECT page_id, unnest(regexp_split_to_array(html, '\n\n+')) AS p FROM pages) GROUP BY page_id")
def paragraph_entries(t):
    return sources.paragraphs(t("pages"), "html", "page_id").groupBy("page_id").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)\b(error|exception|failure|fatal|critical|panic)\b') OR regexp_matches(text, 'AKIA[0-9A-Z]{16}|password=') OR regexp_matches(text, '\b(TypeError|ReferenceError|SyntaxError|RangeError|URIError)\b') OR regexp_matches(text, '(?m)^={7}|^<<<<<<< |^>>>>>>> ') AS critical FROM documents")
def critical_detect(t):
    return t("documents").select("doc_id", Q.is_critical(F.col("text"), ["AKIA[0-9A-Z]{16}|password="]).alias("critical"))


@query("SELECT sha256(text) AS hash, count(*) AS size, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(t):
    return memory.exact_groups(t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


@query(f"""WITH t AS (SELECT item_id AS id, unnest({TOKS.format('text')}) AS term FROM benchmark), c AS (SELECT id, term, count(*) AS c FROM t GROUP BY ALL),
n AS (SELECT id, sqrt(sum(c * c)) AS norm FROM c GROUP BY id),
p AS (SELECT a.id AS i, b.id AS j, sum(a.c * b.c) AS dot FROM c a JOIN c b ON a.term = b.term AND a.id < b.id GROUP BY ALL)
SELECT i, j, round(dot / (x.norm * y.norm), 6) AS similarity FROM p JOIN n x ON x.id = i JOIN n y ON y.id = j WHERE dot / (x.norm * y.norm) >= 0.5""")
def near_duplicates(t):
    b = t("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return memory.cosine_pairs(b, 0.5).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query()
def near_duplicates_documents(t):
    d = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return memory.cosine_pairs_blocked(d, 0.85, fold=True).select("i", "j", F.round("similarity", 6).alias("similarity"))


@query()
def consolidate(t):
    e = conv_entries(t).withColumn("tags", F.array(F.lit("chat")))
    return memory.consolidate(e, NOW_MS)


@query("SELECT count(*) AS runs, round(sum(l_extendedprice - l_extendedprice * (1 - l_discount)), 2) AS saved, round(avg(CASE WHEN l_extendedprice > 0 THEN (l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice ELSE 0 END), 6) AS mean_reduction FROM lineitem")
def optimization_stats(t):
    s = t("lineitem").select(F.col("l_extendedprice").alias("tokens_before"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("tokens_after"))
    return store.optimization_totals(s).select("runs", F.round("saved", 2).alias("saved"), F.round("mean_reduction", 6).alias("mean_reduction"))


@query("SELECT count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events")
def latency_percentiles(t):
    return store.latency(t("events"), "value")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 1000")
def rolling_retention(t):
    return store.newest(t("orders"), 1000, "o_orderdate", "o_orderkey").select("o_orderkey")


def debts(t) -> DataFrame:
    o = t("orders")
    sev = F.when(F.col("o_orderpriority").startswith("1"), "P0").when(F.col("o_orderpriority").startswith("2"), "P1").otherwise("P2")
    st = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("resolved")
    return o.select(F.col("o_orderkey").alias("id"), sev.alias("severity"), st.alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 14 DAYS")).alias("due"), F.floor("o_totalprice").alias("token_cost"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_orderkey") % 100).alias("resolution_tokens"), (F.col("o_orderdate") + F.make_interval(days=F.col("o_orderkey") % 30)).alias("resolved_at"))


DEBT = """d AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'P0' WHEN o_orderpriority LIKE '2%' THEN 'P1' ELSE 'P2' END AS severity,
CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'resolved' END AS status, o_orderdate + INTERVAL 14 DAYS AS due, floor(o_totalprice)::BIGINT AS token_cost,
CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 100 END AS resolution_tokens, o_orderdate + to_days((o_orderkey % 30)::INT) AS resolved_at FROM orders)"""
def now():
    return F.lit("1998-01-01").cast("timestamp")


@query(f"WITH {DEBT} SELECT id, severity, status FROM d WHERE due < TIMESTAMP '1998-01-01' AND status <> 'resolved'")
def debt_overdue(t):
    return store.debt_list(debts(t), now(), overdue=True).select("id", "severity", "status")


@query(f"WITH {DEBT} SELECT id FROM d WHERE severity = 'P0' AND status = 'open'")
def debt_critical(t):
    return store.debt_list(debts(t), now(), severity="P0", status="open").select("id")


@query(f"""WITH {DEBT} SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'resolved') AS resolved,
count(*) FILTER (due < TIMESTAMP '1998-01-01' AND status <> 'resolved') AS overdue, sum(token_cost)::BIGINT AS total_cost,
(sum(coalesce(nullif(resolution_tokens, 0), token_cost)) FILTER (status = 'resolved'))::BIGINT AS repaid,
round(count(*) FILTER (status = 'resolved' AND resolved_at <= due) / nullif(count(*) FILTER (status = 'resolved'), 0), 6) AS on_time FROM d""")
def debt_stats(t):
    return store.debt_stats(debts(t), now()).withColumn("on_time", F.round("on_time", 6))


def doc_lines(t) -> DataFrame:
    return sources.lines(t("documents"), "text", "doc_id", keep_blank=False).withColumnRenamed("doc_id", "path")


LINES = "l AS (SELECT doc_id AS path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents), k AS (SELECT * FROM l WHERE trim(content) <> '')"


@query(f"WITH {LINES} SELECT path, max(line) AS last_line, count(*) AS n FROM k GROUP BY path")
def line_index(t):
    return doc_lines(t).groupBy("path").agg(F.max("line").alias("last_line"), F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT path, line FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS r FROM k WHERE regexp_matches(content, '(?i)licen[sc]e')) WHERE r <= 3")
def line_grep(t):
    return search.grep(doc_lines(t), "(?i)licen[sc]e", 3).select("path", "line")


@query(f"WITH {LINES}, h AS (SELECT DISTINCT path, line FROM k WHERE contains(content, 'MIT License')) SELECT DISTINCT k.path, k.line FROM k JOIN h ON k.path = h.path AND k.line BETWEEN h.line - 2 AND h.line + 2")
def search_context(t):
    ls = doc_lines(t)
    return search.context(ls, ls.where(F.col("content").contains("MIT License"))).select("path", "line")


@query(r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'license')) AS a, len(list_filter(w, lambda x: x = 'version')) AS b FROM t),
s AS (SELECT count(*) AS N, avg(n) AS av, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c),
r AS (SELECT doc_id, round(0.0 + ln((s.N - da + 0.5) / (da + 0.5) + 1) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * c.n / av)) + ln((s.N - db + 0.5) / (db + 0.5) + 1) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * c.n / av)), 6) AS rank FROM c, s WHERE a > 0 AND b > 0)
SELECT doc_id, rank FROM r""")
def bm25_search(t):
    return search.bm25(t("documents"), "text", "License: (version)", "doc_id", limit=None)


@query()
def hybrid_search(t):
    return search.search(doc_lines(t), "MIT License", 20).select("path", "line", F.round("score", 6).alias("score"))


def trade(t) -> tuple[DataFrame, DataFrame]:
    e = t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    nodes = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node")).union(t("part").select(F.concat(F.lit("p"), "p_partkey")))
    return nodes, e


TRADE = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem), v AS (SELECT 's' || s_suppkey AS node FROM supplier UNION ALL SELECT 'p' || p_partkey FROM part), o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY 1), d AS (SELECT node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM v LEFT JOIN o USING (node) LEFT JOIN i USING (node))"


@query(f"WITH {TRADE} SELECT node, n_out, n_in, CASE WHEN n_in + n_out > 0 THEN n_out / (n_in + n_out) ELSE 0 END AS instability, CASE WHEN n_in = 0 AND n_out = 0 THEN 'orphan' WHEN n_in = 0 THEN 'entry' ELSE 'inner' END AS role FROM d")
def graph_degrees(t):
    return graph.classify(graph.degrees(*trade(t)))


@query(f"WITH {TRADE} SELECT node, n_in FROM d WHERE n_in > 0 ORDER BY n_in DESC, node LIMIT 10")
def graph_hot(t):
    return graph.hot(graph.degrees(*trade(t))).select("node", "n_in")


@query(f"WITH {TRADE} SELECT node FROM v WHERE contains(node, 's1') UNION SELECT dst FROM e WHERE contains(src, 's1') UNION SELECT src FROM e WHERE contains(dst, 's1')")
def graph_focus(t):
    return graph.focus(*trade(t), "S1")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'o' || l_orderkey AS dst FROM lineitem WHERE l_suppkey <= 20 UNION SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
w AS (SELECT 's1' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM w JOIN e ON e.src = w.node WHERE w.depth < 3) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def graph_bfs(t):
    li = t("lineitem")
    e = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("o"), "l_orderkey").alias("dst")).union(li.select(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey")))
    return graph.reach(e, li.sparkSession.createDataFrame([("s1",)], "node string"), 3)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
w AS (SELECT user_id, a, b FROM e WHERE b IS NOT NULL UNION SELECT w.user_id, w.a, e.b FROM w JOIN e ON e.user_id = w.user_id AND e.a = w.b WHERE e.b IS NOT NULL)
SELECT DISTINCT user_id || ':' || a AS node FROM w WHERE a = b""")
def graph_cycles(t):
    ev = t("events")
    from pyspark.sql import Window

    e = ev.select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("src"), F.concat_ws(":", F.col("user_id").cast("string"), F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("dst"), F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("nx"))
    return graph.in_cycle(e.where("nx is not null").select("src", "dst"))


@query("SELECT DISTINCT page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages)")
def link_extract(t):
    return t("pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target")).distinct()


#: Demonstration rules over documents and pages; portable between regex dialects.
DEMO = [
    rules.Rule("DOC-EMAIL", 1, "medium", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", r"All rights reserved", deduction=0.5, regulation="A01:2025"),
    rules.Rule("DOC-SECRET", 2, "critical", r"password=\S+|token = \"[0-9a-f]+\"|AKIA[0-9A-Z]{16}", deduction=1.0, regulation="A02:2025"),
    rules.Rule("DOC-IP", 1, "high", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", deduction=0.5, regulation="A09:2025"),
    rules.Rule("DOC-LICENSE", 3, "info", r"[Ll]icense", deduction=0.25, regulation="A06:2025"),
]


def findings(t) -> DataFrame:
    return rules.evaluate(t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), DEMO)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FIND = "f AS (" + " UNION ALL ".join(f"SELECT doc_id AS path, '{r.id}' AS rule_id, {r.layer} AS layer, '{r.severity}' AS severity, len(regexp_extract_all(text, {_lit(r.trigger)}))::INT AS hits, {r.deduction}::DOUBLE AS deduction, length(text[1:instr(text, regexp_extract(text, {_lit(r.trigger)})) - 1]) - length(replace(text[1:instr(text, regexp_extract(text, {_lit(r.trigger)})) - 1], chr(10), '')) + 1 AS line FROM documents WHERE regexp_matches(text, {_lit(r.trigger)})" + (f" AND NOT regexp_matches(text, {_lit(r.gate)})" if r.gate else "") for r in DEMO) + ")"


@query(f"WITH {FIND} SELECT path, rule_id, layer, severity, hits, deduction FROM f")
def rule_findings(t):
    return findings(t).select("path", "rule_id", "layer", "severity", "hits", "deduction")


@query(f"WITH {FIND} SELECT path, rule_id FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY path) AS r FROM f) WHERE r <= 5")
def rule_cap(t):
    return rules.cap(findings(t)).select("path", "rule_id")


@query(f"WITH {FIND} SELECT rule_id, least(sum(deduction), CASE rule_id WHEN 'DOC-SECRET' THEN 5 WHEN 'DOC-IP' THEN 2 ELSE 1e9 END) AS deducted FROM f GROUP BY rule_id")
def rule_deductions(t):
    return rules.deductions(findings(t), {"DOC-SECRET": 5.0, "DOC-IP": 2.0})


def checks(t) -> DataFrame:
    n = t("documents").agg(F.count("*").alias("total"))
    per = findings(t).groupBy("layer").agg(F.count("*").alias("issues"))
    w = t("documents").sparkSession.createDataFrame([(1, 20.0), (2, 15.0), (3, 5.0)], "layer int, weight double")
    return w.join(per, "layer", "left").crossJoin(F.broadcast(n)).select("layer", "weight", F.greatest(F.lit(0), F.col("total") - F.coalesce("issues", F.lit(0))).alias("passed"), "total")


GRADE = "CASE " + " ".join(f"WHEN {{0}} >= {lo} THEN '{g}'" for lo, g in Q.AUDIT_GRADES) + " END"
LAYERS = f"{FIND}, w(layer, weight) AS (VALUES (1, 20.0::DOUBLE), (2, 15.0), (3, 5.0)), i AS (SELECT layer, count(*) AS issues FROM f GROUP BY layer), n AS (SELECT count(*) AS total FROM documents), c AS (SELECT layer, weight, greatest(0, total - coalesce(issues, 0)) AS passed, total FROM w LEFT JOIN i USING (layer), n), s AS (SELECT layer, weight, passed, total, floor(passed / total * weight * 100 + 0.5) / 100 AS score FROM c)"


@query(f"WITH {LAYERS} SELECT layer, weight, passed, total, score, {GRADE.format('(score / weight * 100)')} AS grade FROM s")
def layer_scores(t):
    return rules.layer_scores(checks(t))


@query(f"WITH {LAYERS}, z AS (SELECT round(sum(score), 2) AS raw FROM s), y AS (SELECT raw, least(raw, CASE WHEN EXISTS (SELECT 1 FROM f WHERE severity = 'critical') THEN 30.0 ELSE 100.0 END) AS total FROM z) SELECT raw, total, {GRADE.format('total')} AS grade FROM y")
def score_caps(t):
    return rules.capped_total(rules.layer_scores(checks(t)), findings(t), [(30, ["*:critical"])])


@query(f"WITH {FIND}, g AS (SELECT CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN '{r.regulation}'" for r in DEMO) + f" END AS control, count(*) AS n, bool_or(severity IN ('critical', 'high')) AS bad FROM f GROUP BY 1), k AS (SELECT unnest({OWASP!r}) AS control) SELECT control, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'pass' WHEN bad THEN 'fail' ELSE 'partial' END AS status FROM k LEFT JOIN g USING (control)")
def compliance_matrix(t):
    f = findings(t).withColumn("control", F.coalesce(*[F.when(F.col("rule_id") == r.id, r.regulation) for r in DEMO]))
    controls = f.sparkSession.createDataFrame([(c,) for c in OWASP], "control string")
    return rules.matrix(controls, f)


@query(f"WITH {FIND}, r AS (SELECT DISTINCT rule_id, severity FROM f), b AS (SELECT rule_id, CASE WHEN severity IN ('critical', 'high') THEN 'immediate' ELSE 'quarter' END AS effort, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 4 END AS k FROM r) SELECT effort, count(*) AS n, string_agg(rule_id, ',' ORDER BY k, rule_id) AS rules FROM b GROUP BY effort")
def remediation_roadmap(t):
    f = findings(t).select("rule_id", "severity").distinct().withColumn("effort", F.when(F.col("severity").isin("critical", "high"), "immediate").otherwise("quarter"))
    return rules.roadmap(f)


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, '^(?:[^/]+/)*[^/]*1[^/]*$')")
def ignore_rules(t):
    return rules.ignored(t("pages"), "url", ["**/*1*"]).select("page_id")


@query(f"WITH {FIND}, p AS (SELECT substr(sha256(rule_id || '::' || (path // 2)::VARCHAR || '::' || severity), 1, 16) AS fingerprint, path % 2 AS side FROM f), c AS (SELECT DISTINCT fingerprint FROM p WHERE side = 0), b AS (SELECT DISTINCT fingerprint FROM p WHERE side = 1) SELECT coalesce(c.fingerprint, b.fingerprint) AS fingerprint, CASE WHEN b.fingerprint IS NULL THEN 'new' WHEN c.fingerprint IS NULL THEN 'fixed' ELSE 'unchanged' END AS status FROM c FULL JOIN b ON c.fingerprint = b.fingerprint")
def baseline_diff(t):
    f = findings(t).select(Q.fingerprint(F.col("rule_id"), F.floor(F.col("path") / 2).cast("string"), F.col("severity")).alias("fingerprint"), (F.col("path") % 2).alias("side"))
    return store.baseline_diff(f.where("side = 0"), f.where("side = 1"))


@query("WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 6) AS score FROM events GROUP BY 1), x AS (SELECT day, score, floor((score - lag(score) OVER (ORDER BY day)) * 10 + 0.5) / 10 AS delta FROM d) SELECT day, score, delta, CASE WHEN delta IS NULL THEN 'first' WHEN delta > 0 THEN 'up' WHEN delta < 0 THEN 'down' ELSE 'same' END AS trend FROM x")
def history_trend(t):
    d = t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.round(F.avg("value"), 6).alias("score"))
    return store.trend(d, "day", "score")


@query("WITH c AS (SELECT l_partkey AS p_partkey, count(DISTINCT l_orderkey) AS churn FROM lineitem GROUP BY 1), h AS (SELECT * FROM c ORDER BY churn DESC, p_partkey LIMIT 20) SELECT p_partkey, churn, p_size FROM h JOIN part USING (p_partkey) WHERE p_size > 20 AND churn >= 10")
def churn_hotspots(t):
    c = graph.churn(t("lineitem").select(F.col("l_partkey").alias("file"), F.col("l_orderkey").alias("hash"))).orderBy(F.desc("churn"), "file").limit(20)
    return c.join(t("part"), F.col("file") == F.col("p_partkey")).where("p_size > 20 AND churn >= 10").select("p_partkey", "churn", "p_size")


@query("SELECT p_type AS name, count(DISTINCT p_brand) AS files FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def duplicate_types(t):
    return t("part").groupBy(F.col("p_type").alias("name")).agg(F.countDistinct("p_brand").alias("files")).where("files > 1")


@query(r"SELECT page_id, len(regexp_extract_all(html, '<h[1-3][^>]*>'))::INT AS headings, len(regexp_extract_all(html, '<a '))::INT AS links, len(regexp_extract_all(html, '<script'))::INT AS scripts FROM pages")
def summarize_web(t):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return t("pages").select("page_id", n("<h[1-3][^>]*>").alias("headings"), n("<a ").alias("links"), n("<script").alias("scripts"))


@query("SELECT event_id, list_aggregate(list_transform(json_keys(props::JSON), lambda x: x), 'string_agg', ',') AS keys FROM events")
def summarize_json(t):
    return t("events").select("event_id", F.array_join(summaries.json_keys(F.col("props")), ",").alias("keys"))


HREFS = """h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS p, generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS i FROM pages)"""


def hrefs():
    return F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))


@query(f"""WITH {HREFS}, c AS (SELECT page_id, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '.' END AS dir, count(*) AS n FROM h GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, dir) AS k FROM c),
g AS (SELECT page_id, sum(n)::BIGINT AS files, count(*) AS dirs, string_agg(dir || ':' || n, ',' ORDER BY k) FILTER (k <= 5) AS top FROM k GROUP BY page_id) SELECT page_id, coalesce(files, 0) AS files, coalesce(dirs, 0) AS dirs, coalesce(top, '') AS top FROM pages LEFT JOIN g USING (page_id)""")
def summarize_glob(t):
    s = t("pages").select("page_id", summaries.glob_summary(F.array_join(hrefs(), "\n")).alias("s"))
    return s.select("page_id", "s.files", "s.dirs", F.array_join("s.top", ",").alias("top"))


@query(fr"""WITH {HREFS}, m AS (SELECT page_id, regexp_extract(p || ':' || i, '^([^:]+):\d+', 1) AS f, i FROM h), x AS (SELECT page_id, f, min(i) AS i, count(*) AS n FROM m WHERE f <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS k FROM x),
g AS (SELECT page_id, sum(n)::BIGINT AS matches, count(*) AS files, string_agg(f, ',' ORDER BY k) FILTER (k <= 5) AS top FROM k GROUP BY page_id) SELECT page_id, coalesce(matches, 0) AS matches, coalesce(files, 0) AS files, coalesce(top, '') AS top FROM pages LEFT JOIN g USING (page_id)""")
def summarize_search(t):
    rows = F.transform(hrefs(), lambda p, i: F.concat(p, F.lit(":"), (i + 1).cast("string"), F.lit(":found")))
    s = t("pages").select("page_id", summaries.search_summary(F.array_join(rows, "\n")).alias("s"))
    return s.select("page_id", "s.matches", "s.files", F.array_join("s.top", ",").alias("top"))


def module_tree(t) -> DataFrame:
    """Pages as modules of four folders; each imports its fourth successor, in its own folder, and the next one."""
    i = F.col("page_id")
    at = lambda k: F.concat(F.lit("d"), ((i + k) % 4).cast("string"), F.lit("/f"), (i + k).cast("string"))
    text = F.concat(F.lit("import { a, b as c } from './f"), (i + 4).cast("string"), F.lit("'\nimport x from \"../"), at(1), F.lit('.js"\nimport y from "lib"\nexport const v'), i.cast("string"), F.lit(" = 1\nexport { a }\n"))
    return t("pages").select(F.concat(F.lit("src/"), at(0), F.lit(".ts")).alias("path"), text.alias("content"))


@query("""WITH f AS (SELECT page_id AS i, 'src/d' || page_id % 4 || '/f' || page_id || '.ts' AS path FROM pages)
SELECT a.path AS src, b.path AS dst, CASE WHEN b.i = a.i + 4 THEN 'a,b' ELSE 'x' END AS symbols FROM f a JOIN f b ON b.i = a.i + 4 OR b.i = a.i + 1""")
def graph_imports(t):
    files = module_tree(t)
    return graph.resolve(graph.imports(files), files).withColumn("symbols", F.array_join("symbols", ","))


@query("SELECT 'src/d' || page_id % 4 || '/f' || page_id || '.ts' AS path, 'a,v' || page_id AS exports FROM pages")
def graph_exports(t):
    return graph.exports(module_tree(t)).withColumn("exports", F.array_join("exports", ","))


@query("""WITH s AS (SELECT l_orderkey AS plan_id, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status, floor(l_quantity)::BIGINT AS estimated FROM lineitem)
SELECT plan_id, count(*) AS steps, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, (sum(estimated) FILTER (status = 'completed'))::BIGINT AS tokens_used, count(*) FILTER (status = 'failed') = 0 AND count(*) FILTER (status = 'completed') = count(*) AS success FROM s GROUP BY plan_id""")
def plan_verify(t):
    st = F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_linestatus") == "F", "completed").otherwise("pending")
    return store.plan_verify(t("lineitem").select(F.col("l_orderkey").alias("plan_id"), st.alias("status"), F.floor("l_quantity").alias("estimated")))


@query("SELECT user_id, event_type, greatest(500, floor(CASE event_type WHEN 'click' THEN 2500 WHEN 'view' THEN 2000 WHEN 'error' THEN 1000 WHEN 'purchase' THEN 1500 ELSE 3000 END * CASE WHEN s > 500000 THEN 0.33 WHEN s > 300000 THEN 0.5 WHEN s > 100000 THEN 0.75 ELSE 1.0 END))::BIGINT AS threshold FROM (SELECT user_id, event_type, sum(floor(value * 1000)) AS s FROM events GROUP BY ALL)")
def adaptive_threshold(t):
    s = t("events").groupBy("user_id", "event_type").agg(F.sum(F.floor(F.col("value") * 1000)).alias("s"))
    tool = F.create_map(*[F.lit(x) for kv in (("click", "Read"), ("view", "Bash"), ("error", "WebSearch"), ("purchase", "Glob")) for x in kv])[F.col("event_type")]
    return s.select("user_id", "event_type", Q.adaptive_threshold(F.coalesce(tool, F.lit("other")), F.col("s")).alias("threshold"))


@query(r"""WITH f AS (SELECT replace(replace(html, '<a href', 'router.get( <a href'), '<p>', 'req.body <p>') AS c FROM pages),
r AS (SELECT sum(len(regexp_extract_all(c, '(?i)(?:app|router)\.(get|post|put|patch|delete)\s*\(')))::BIGINT AS endpoints, bool_or(regexp_matches(c, '(?i)(?:auth|authenticate|authorize|requireAuth|protect|guard|jwt)')) AS guarded, bool_or(regexp_matches(c, '(?i)(?:rate.?limit|throttle)')) AS limited,
sum(len(regexp_extract_all(c, '(?i)(?:req\.body|req\.query|req\.params|req\.files|formData)')))::BIGINT AS inputs FROM f)
SELECT endpoints, (CASE WHEN guarded THEN floor(endpoints * 0.7 + 0.5) ELSE 0 END)::BIGINT AS authenticated, CASE WHEN limited THEN endpoints ELSE 0 END AS rate_limited, inputs FROM r""")
def attack_surface(t):
    c = F.replace(F.replace("html", F.lit("<a href"), F.lit("router.get( <a href")), F.lit("<p>"), F.lit("req.body <p>"))
    return rules.attack_surface(t("pages").select(c.alias("content")))


@query(f"WITH p AS ({SQL['sparse_prune_corpus']}) SELECT id, kept FROM p")
def optimize_documents(t):
    e = doc_entries(t).withColumns({"ts_ms": F.lit(NOW_MS), "score": F.lit(0.5), "ttl_s": F.lit(86400).cast("long"), "access_count": F.lit(0).cast("long"), "critical": F.lit(False)})
    return pipelines.optimize_entries(e, NOW_MS).select("id", "kept")


@query()
def optimize_sessions(t):
    said = F.concat(F.when(F.col("role") == "user", "User: ").when(F.col("role") == "assistant", "Assistant: ").otherwise(""), F.coalesce("text", F.lit("")))
    s = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))), lambda x: x["s"]), "\n").alias("t"))
    return pipelines.optimization_result(pipelines.optimize_transcripts(s, "t", "conv_id", NOW_MS, 500), ["session"])


def page_files(t) -> DataFrame:
    return t("pages").select(F.concat(F.regexp_replace("url", "^https?://", ""), F.lit(".ts")).alias("path"), F.col("html").alias("content"))


@query()
def project_analysis(t):
    return pipelines.analyze(page_files(t))[1]


@query()
def secure_audit(t):
    return pipelines.audit_scores(page_files(t), "secure")


@query()
def comply_audit(t):
    return pipelines.audit_scores(page_files(t), "comply")


@query()
def code_metrics(t):
    return analyzers.code_metrics(page_files(t)).select("path", F.size("functions").alias("functions"), "nesting", "loop_queries", "ternaries")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), k AS (SELECT doc_id, trim(x) AS x FROM l),
n AS (SELECT doc_id, unnest(regexp_split_to_array(x, '[^0-9A-Za-z_]+')) AS w FROM k WHERE NOT regexp_matches(x, '^(?://|\*|/\*|const |let |var |enum |import |export const |export let |export enum |return )|default:|case |type |interface |^\s*\d+\s*[,\]]|^\s*[''"`]|:\s*\d')),
m AS (SELECT doc_id, count(*) AS n FROM n WHERE regexp_full_match(w, '[0-9]{2,}') AND coalesce(TRY_CAST(w AS BIGINT) NOT IN (0, 1, 2, 3, 4, 5, 8, 10, 12, 16, 24, 32, 50, 60, 64, 80, 100, 128, 200, 256, 300, 400, 404, 500, 512, 1000, 1024, 2000, 3000, 4096, 5000, 8080, 8000, 9000), true) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n FROM documents LEFT JOIN m USING (doc_id)""")
def magic_numbers(t):
    return t("documents").select("doc_id", analyzers.magic_numbers(F.col("text")).alias("n"))


from quillstone.plans import held_queries, project_queries, stored_queries  # noqa: E402, F401, I001  register their queries here
