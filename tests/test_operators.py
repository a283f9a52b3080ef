"""Known cases of the operators."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone import functions as Q
from quillstone import sources, streaming
from quillstone.operators import catalogue, graph, memory, rules, search, store, summaries
from quillstone.plans import pipelines


def entries(spark, rows):
    return spark.createDataFrame(rows, "id string, s string, pos long, content string, score double, ts_ms long, ttl_s long, access_count long, critical boolean, tags array<string>")


def test_scalars(spark):
    df = spark.createDataFrame([("hello world", 86_400_000, 86_400, 0.5, 3)], "t string, age long, ttl long, s double, a long")
    r = df.select(Q.token_estimate(F.col("t")).alias("n"), Q.decay(F.col("age"), F.col("ttl")).alias("d"), Q.engram_score(F.col("s"), F.col("age"), F.col("ttl"), F.col("a"), F.lit(False)).alias("e"), Q.engram_score(F.lit(0.8), F.lit(0), F.col("ttl"), F.lit(0), F.lit(False)).alias("fresh"), Q.engram_score(F.lit(0.8), F.lit(1_800_000), F.col("ttl"), F.lit(0), F.lit(False)).alias("edge")).first()
    assert r.n == 3 and abs(r.d - 0.632121) < 1e-6 and abs(r.e - (0.5 / math.e + 0.1 * math.log(4))) < 1e-6
    assert r.fresh == 1.0 and abs(r.edge - 0.8 * math.exp(-1800 / 86400)) < 1e-9


@pytest.mark.parametrize(("total", "tool", "want"), [(0, "Bash", 2000), (0, "Read", 2500), (0, "WebSearch", 1000), (0, "Other", 3000), (150_000, "Bash", 1500), (150_000, "WebSearch", 750), (400_000, "Read", 1250), (600_000, "Bash", 660), (600_000, "Glob", 500)])
def test_adaptive_threshold(spark, total, tool, want):
    assert spark.range(1).select(Q.adaptive_threshold(F.lit(tool), F.lit(total))).first()[0] == want


def test_states_and_grades(spark):
    got = spark.createDataFrame([(0.7,), (0.69,), (0.3,), (0.29,)], "s double").select(Q.state(F.col("s"), F.lit(False))).collect()
    assert [r[0] for r in got] == ["active", "ready", "ready", "silent"]
    got = spark.createDataFrame([(96.0,), (92.0,), (80.0,), (0.0,)], "s double").select(Q.grade(F.col("s"), Q.AUDIT_GRADES)).collect()
    assert [r[0] for r in got] == ["S", "A+++", "A", "Zero"]


def test_critical(spark):
    rows = ["TypeError: x\n    at foo (a.js:1:2)", "plain log line", "<<<<<<< HEAD", "Fatal thing"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(Q.is_critical(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, False, True, True]


def test_tfidf_values(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, "hello there"), (3, "world peace"), (4, None)], "id int, content string")
    got = {r.id: r.tfidf for r in memory.tfidf(df.where("id < 4")).collect()}
    assert abs(got[1] - 0.405465) < 1e-6 and abs(got[2] - 0.752039) < 1e-6
    assert {r.term: r.df for r in memory.document_frequency(df).collect()} == {"hello": 2, "world": 2, "there": 1, "peace": 1}


def test_greedy_scan():
    scan = lambda rows, budget: {i: k for _, i, k in memory.greedy_scan(iter(rows), budget)}
    assert scan([("g", False, str(i), n) for i, n in enumerate((50, 30, 40, 10))], 100) == {"0": True, "1": True, "2": False, "3": True}
    assert scan([("g", True, "a", 90), ("g", True, "b", 85), ("g", False, "c", 10), ("g", False, "d", 20)], 100) == {"a": True, "b": False, "c": True, "d": False}
    assert scan([("g", True, "a", 90), ("g", True, "b", 70), ("g", False, "c", 10), ("h", False, "d", 100)], 100) == {"a": False, "b": True, "c": True, "d": True}


def test_budget_prune_invariants(spark):
    rows = [(str(i), f"s{i % 3}", i, " ".join(f"w{(i * j) % 17}" for j in range(5 + i)), 0.5 + (i % 5) / 10, 1000 * i, 3600, i % 3, i % 9 == 0, []) for i in range(60)]
    out = memory.budget_prune(entries(spark, rows), 60, ["s"], 70_000).collect()
    assert len(out) == 60
    for s in ("s0", "s1", "s2"):
        kept = [r for r in out if r.s == s and r.kept]
        crit = [r for r in kept if r.critical]
        assert sum(r.tokens for r in kept) <= 60 or (len(crit) == 1 and not [r for r in kept if not r.critical])
    one = entries(spark, [("a", "x", 0, "word " * 400, 1.0, 5, 3600, 0, True, []), ("b", "x", 1, "small one", 0.5, 4, 3600, 0, False, [])])
    assert {r.id: r.kept for r in memory.budget_prune(one, 50, ["x" if False else "s"], 10).collect()} == {"a": True, "b": False}


def test_near_duplicates_and_consolidation(spark):
    fox = "The quick brown fox jumps over the lazy dog"
    rows = [("a", "x", 0, fox, 0.5, 0, 86400, 1, False, ["p"]), ("b", "x", 1, fox.replace("over the", "over"), 0.9, 0, 86400, 2, False, ["q"]), ("c", "x", 2, "something else entirely here", 0.5, 0, 86400, 0, False, []), ("d", "x", 3, "same", 0.3, 0, 86400, 1, False, []), ("e", "x", 4, "same", 0.3, 0, 86400, 1, False, []), ("old", "x", 5, "gone", 0.5, -200 * 3_600_000, 86400, 0, False, [])]
    e = entries(spark, rows)
    pairs = memory.cosine_pairs(e.where("id in ('a', 'b', 'c')")).collect()
    assert [(p.i, p.j) for p in pairs] == [("a", "b")] and abs(pairs[0].similarity - 0.959403) < 1e-6
    out = {r.id: r for r in memory.consolidate(e, 0).collect()}
    assert set(out) == {"b", "c", "d"}
    assert out["b"].access_count == 3 and out["b"].tags == ["p", "q"] and out["d"].access_count == 2


@pytest.mark.parametrize(("frequent", "block", "threshold"), [(20_000, 2_000, 0.85), (7, 3, 0.85), (0, 1, 0.6), (40, 2, 0.99)])
def test_cosine_pairs_equal_all_pairs(spark, monkeypatch, frequent, block, threshold):
    from collections import Counter

    monkeypatch.setattr(memory, "FREQUENT", frequent)
    monkeypatch.setattr(memory, "POSTINGS_BLOCK", block)
    rng, rows = random.Random(7), [("none", None), ("empty", ""), ("one", "the"), ("two", "The  the")]
    for g in range(10):
        base = [rng.choice(["the", "of", "and", f"w{rng.randrange(60)}"]) for _ in range(rng.choice([3, 12, 60]))]
        for k in range(5):
            w = list(base)
            for _ in range(rng.choice([0, 1, 3, 9])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(30)}"
            rows.append((f"g{g}-{k}", " ".join(w)))
    vec = {d: Counter(t.lower().split()) for d, t in rows if t}
    norm = {d: sum(c * c for c in v.values()) ** 0.5 for d, v in vec.items()}
    sims = {(i, j): sum(c * vec[j][t] for t, c in vec[i].items()) / (norm[i] * norm[j]) for i in vec for j in vec if i < j}
    got = memory.cosine_pairs(spark.createDataFrame(rows, "id string, content string"), threshold).collect()
    found = {(r.i, r.j): r.similarity for r in got}
    assert len(got) == len(found) and all(abs(sims[k] - v) < 1e-9 for k, v in found.items())
    assert {k for k, v in sims.items() if v >= threshold + 1e-9} <= set(found) <= {k for k, v in sims.items() if v >= threshold - 1e-9}


def test_greedy_pairs_equal_the_sequential_pass(spark):
    import random

    rng = random.Random(0)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(80)})
    used, want = set(), []
    for i, j in edges:
        if i not in used and j not in used:
            want.append((i, j))
            used |= {i, j}
    got = memory.greedy_pairs(spark.createDataFrame(edges, "i long, j long")).collect()
    assert sorted((r.i, r.j) for r in got) == want


def test_transcripts(spark):
    text = "User: Hello, how are you?\nAssistant: I'm doing well\nmore\n<function_calls>\nx\n<function_results>\n1\n</function_results>\n2\n"
    got = sources.transcript_blocks(spark.createDataFrame([(1, text)], "s int, t string"), "t", "s").orderBy("block").collect()
    assert [r.kind for r in got] == ["conversation", "conversation", "tool", "result"]
    assert got[1].content.endswith("more") and got[3].content.endswith("2")
    e = sources.entries(sources.transcript_blocks(spark.createDataFrame([(1, text)], "session int, t string"), "t", "session"), 0).orderBy("pos").collect()
    assert [r.score for r in e] == [0.8, 0.8, 0.7, 0.4]


def test_jsonl(spark):
    rows = ['{"role":"user","content":"hi"}', "not json", '{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool_use","name":"Bash"}]}', '{"content":[{"type":"tool_result","content":"out"}]}']
    got = sources.jsonl_messages(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k int, v string"), "v", "k").orderBy("k").collect()
    assert [(r.kind, r.content) for r in got] == [("conversation", "hi"), ("tool", "a\n[tool_use: Bash]"), ("result", "out")]


def test_git_log(spark):
    log = "abcdef1|2024-01-01T00:00:00+00:00\na.ts\nb.ts\n\nabcdef2|2024-01-02T00:00:00+00:00\na.ts\n"
    got = sources.git_log(spark.createDataFrame([(log,)], "t string"), "t")
    assert {r.file: r.churn for r in graph.churn(got).collect()} == {"a.ts": 2, "b.ts": 1}


def test_git_logs_of_several_rows(spark):
    logs = [("abcdef1|2024-01-01\na.ts\nb.ts\n",), ("abcdef2|2024-01-02\nc.ts\n",)]
    got = sources.git_log(spark.createDataFrame(logs, "t string"), "t").collect()
    assert sorted((r.hash, r.file) for r in got) == [("abcdef1", "a.ts"), ("abcdef1", "b.ts"), ("abcdef2", "c.ts")]


def test_nodes_between_cycles_are_on_none(spark):
    def cyc(pairs):
        return {r.node for r in graph.in_cycle(spark.createDataFrame(pairs, "src string, dst string")).collect()}

    assert cyc([("a", "b"), ("b", "a"), ("b", "m"), ("m", "c"), ("c", "d"), ("d", "c")]) == {"a", "b", "c", "d"}
    assert cyc([("x", "x"), ("x", "y"), ("y", "z"), ("z", "w")]) == {"x"}
    rng = random.Random(6)
    pairs = [(str(rng.randrange(40)), str(rng.randrange(40))) for _ in range(60)]
    reach = {n: {n} for p in pairs for n in p}
    after = {n: {b for a, b in pairs if a == n} for n in reach}
    for n in reach:
        todo = list(after[n])
        reach[n] = set()
        while todo:
            x = todo.pop()
            if x not in reach[n]:
                reach[n].add(x)
                todo += after[x]
    assert cyc(pairs) == {n for n in reach if n in reach[n]}


def test_suppression(spark):
    f = spark.createDataFrame([("src/a.ts", "R-001", 2), ("src/a.ts", "R-002", 3), ("lib/b.ts", "R-001", 1), (None, "R-001", 0)], "path string, rule_id string, line int")
    rule_list = rules.parse_ignore("src/** R-001\n# note\nlib/**\n")
    assert sorted((r.path or "", r.rule_id) for r in rules.suppressed(f, rule_list).collect()) == [("", "R-001"), ("src/a.ts", "R-002")]
    files = spark.createDataFrame([("src/a.ts", "x\n// skip-next\nbad()\n")], "path string, content string")
    assert sorted((r.path or "", r.line) for r in rules.line_suppressed(f, files, "skip-next").collect()) == [("", 0), ("lib/b.ts", 1), ("src/a.ts", 2)]


def test_debts_are_inserted_started_and_resolved(spark):
    none = spark.createDataFrame([], "id string, description string, due timestamp, severity string, token_cost long, files array<string>, created_at timestamp, status string, resolved_at timestamp, resolution_tokens long")
    new = spark.sql("SELECT 'slow query' AS description, TIMESTAMP '2024-02-01' AS due, 'P1' AS severity, 500L AS token_cost, array('a.ts') AS files")
    d = store.materialize(store.insert_debt(none, new, F.to_timestamp(F.lit("2024-01-01"))))
    (r,) = d.collect()
    assert len(r.id) == 8 and r.status == "open" and r.resolved_at is None
    assert store.start_debt(d, r.id).first().status == "in_progress"
    assert store.resolve_debt(d, r.id, F.current_timestamp(), 40).first().resolution_tokens == 40
    with pytest.raises(KeyError):
        store.start_debt(d, "nothing")


def test_credentials_cap(spark):
    scores = spark.createDataFrame([(100.0,)], "score double")
    f = spark.createDataFrame([("SEC-CR-002", "critical", 1, "Default password")], "rule_id string, severity string, layer int, title string")
    assert rules.capped_total(scores, f, rules.SECURE_CAPS).first().total == 14
    assert rules.capped_total(scores, f.withColumn("title", F.lit("Key")), rules.SECURE_CAPS).first().total == 69


def test_credentials_cap_and_baseline_through_an_audit(spark, tmp_path):
    files = spark.createDataFrame([("src/app.ts", "const password = 'default-admin-1';\n"), ("src/key.ts", f"const k = 'AKIA{'Q' * 16}';")], "path string, content string")
    found = pipelines.audit_findings(files, "secure").where("rule_id = 'SEC-CR-002'")
    assert {(r.path, r.title) for r in found.collect()} == {("src/app.ts", "Hardcoded secret: Hardcoded credential"), ("src/key.ts", "Hardcoded secret: AWS Access Key")}
    own = [r._replace(titles=(("default-admin", "Default admin password"), *r.titles)) if r.id == "SEC-CR-002" else r for r in catalogue.SECURE]
    named = rules.evaluate(files, own).where("rule_id = 'SEC-CR-002'")
    scores = spark.createDataFrame([(100.0,)], "score double")
    assert rules.capped_total(scores, found, rules.SECURE_CAPS).first().total == 69
    assert rules.capped_total(scores, named, rules.SECURE_CAPS).first().total == 14
    store.save_baseline(pipelines.audit_findings(files, "secure"), f"{tmp_path}/base")
    base = spark.read.json(f"{tmp_path}/base")
    now = pipelines.audit_findings(files.where("path = 'src/key.ts'"), "secure").withColumn("fingerprint", Q.fingerprint(F.col("rule_id"), F.col("path"), F.col("title")))
    status = {r.fingerprint: r.status for r in store.baseline_diff(now, base).collect()}
    gone = {r.fingerprint for r in base.where("path = 'src/app.ts'").collect()}
    assert gone and {f for f, s in status.items() if s == "fixed"} >= gone and "unchanged" in status.values()


def test_graph(spark):
    files = spark.createDataFrame([("src/utils/auth.ts", "export function validateToken() {}"), ("src/core/handler.ts", "import { validateToken } from '../utils/auth.js';\nexport const handleRequest = 1"), ("src/cli/app.ts", "import { handleRequest as h } from '../core/handler';\nexport default 1")], "path string, content string")
    e = graph.resolve(graph.imports(files), files)
    assert {(r.src, r.dst): r.symbols for r in e.collect()} == {("src/core/handler.ts", "src/utils/auth.ts"): ["validateToken"], ("src/cli/app.ts", "src/core/handler.ts"): ["handleRequest"]}
    nodes = files.select(F.col("path").alias("node"))
    assert graph.focus(nodes, e, "AUTH").count() == 2
    assert {r.path: r.exports for r in graph.exports(files).collect()}["src/cli/app.ts"] == ["default"]
    start = nodes.where("node like '%app.ts'")
    assert {r.node: r.depth for r in graph.reach(e, start).collect()} == {"src/cli/app.ts": 0, "src/core/handler.ts": 1, "src/utils/auth.ts": 2}
    assert graph.in_cycle(e).count() == 0
    loop = e.select("src", "dst").union(spark.createDataFrame([("src/utils/auth.ts", "src/cli/app.ts")], "src string, dst string"))
    assert graph.in_cycle(loop).count() == 3
    chain = spark.createDataFrame([("A", "B"), ("B", "C"), ("X", "X")], "child string, parent string")
    assert {r.child: r.depth for r in graph.inheritance_depth(chain).collect()} == {"A": 2, "B": 1, "X": 1}


def found(spark, content, rule_set, path="src/a.ts"):
    return {r.rule_id for r in rules.evaluate(spark.createDataFrame([(path, content)], "path string, content string"), rule_set).collect()}


def test_rule_snippets(spark):
    assert "SEC-AC-001" in found(spark, "app.get('/api/users', async (q, r) => {})", catalogue.SECURE)
    assert "SEC-AC-001" not in found(spark, "app.get('/api/users', authenticate, f)", catalogue.SECURE)
    assert "DB-001" in found(spark, "CREATE TABLE users (id INT, name VARCHAR(100));", catalogue.ANALYZER)
    assert "DB-005" in found(spark, "SELECT * FROM users WHERE id = 1;", catalogue.ANALYZER)
    assert "CMP-PD-001" in found(spark, "const email = form.value", catalogue.COMPLY)
    assert "CMP-PD-001" not in found(spark, "const email = form.value // with consent", catalogue.COMPLY)


def test_project_rules_and_ids(spark):
    df = spark.createDataFrame([("a", "app.listen(1)"), ("b", None)], "path string, content string")
    got = {r.rule_id: r.issue for r in rules.evaluate_project(df, catalogue.SECURE).collect()}
    assert got["SEC-MC-007"] and got["SEC-DI-004"] and not got["SEC-AS-002"]
    for c in (catalogue.ANALYZER, catalogue.SECURE, catalogue.COMPLY):
        assert len({r.id for r in c}) == len(c)
    assert sum(catalogue.SECURE_WEIGHTS) == sum(catalogue.COMPLY_WEIGHTS) == 100


def test_scores(spark):
    cats = spark.createDataFrame([("q", 25.0, 20.0, False), ("db", 20.0, 0.0, True), ("t", 25.0, 25.0, False)], "category string, max_points double, score double, na boolean")
    r = rules.weighted_score(cats).first()
    assert (r.total, r.grade) == (90.0, "A+++")
    assert rules.parse_ignore("# x\nsrc/** SEC-001,DB-002\n*.md\n") == [("src/**", ["SEC-001", "DB-002"]), ("*.md", [])]


def test_search(spark):
    ls = spark.createDataFrame([("a", i, c) for i, c in enumerate(["validate token", "other", "the token is here and validated", "x"], 1)], "path string, line int, content string")
    hits = search.search(ls, "token").collect()
    assert {r.line for r in hits} == {1, 3}
    assert {r.line for r in search.context(ls, ls.where("line = 1")).collect()} == {1, 2, 3}
    assert search.bm25(ls, "content", " * ", "path", "line").count() == 0


def test_store(spark):
    t = spark.createDataFrame([("1", "h1", 1), ("2", "h2", 2)], "id string, hash string, seq int")
    out = store.upsert(t, spark.createDataFrame([("3", "h1", 3), ("2", "h9", 4)], "id string, hash string, seq int")).collect()
    assert {(r.id, r.hash) for r in out} == {("3", "h1"), ("2", "h9")}


def test_summaries(spark):
    text = "a.ts(1,2): error TS2304: x\nb.ts: error TS2304: y\nc.ts: error TS1005: z"
    r = spark.createDataFrame([(text,)], "t string").select(summaries.shell_kind(F.col("t")).alias("k"), summaries.typescript_errors(F.col("t")).alias("e")).first()
    assert r.k == "typescript" and r.e == ["TS2304:2", "TS1005:1"]
    fixed = spark.createDataFrame([("const h = createHash('md5')\nconsole.log(1);\nx\n",)], "t string").select(summaries.apply_fixes(F.col("t"))).first()[0]
    assert fixed == "const h = createHash('sha256')\nx\n"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 2}", f"text {i % 7}", i, 5) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "session string, content string, ts_ms long, tokens long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("session string, content string, ts_ms long, tokens long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = streaming.ingest(src, budget=20, window=10).writeStream.outputMode("update").format("memory").queryName("ingested").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("SELECT session, max(total_rows) AS n, max(kept) AS kept, max(tokens) AS tokens FROM ingested GROUP BY session").collect()
    assert {r.session: r.n for r in got} == {"s0": 20, "s1": 20}
    assert all(r.tokens <= 20 and r.kept <= 4 for r in got)


def test_near_duplicates_of_all_documents(spark, tmp_path):
    import random
    from collections import Counter

    from quillstone.plans import registry

    rng, rows = random.Random(3), []
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([5, 40, 200]))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.choice([0, 1, 4, 12, 30])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(400)}"
            rows.append((len(rows), " ".join(w)))
    rows += [(100, "same text"), (101, "same text"), (102, "same text twice"), (103, None), (104, ""), (105, "Same TEXT")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for d, t in rows:
        first.setdefault(t or "", d)
    vec = {d: Counter(t.lower().split()) for t, d in first.items() if t}
    norm = {d: sum(c * c for c in v.values()) ** 0.5 for d, v in vec.items()}
    want = {}
    for i in vec:
        for j in vec:
            if i < j and (s := sum(c * vec[j][t] for t, c in vec[i].items()) / (norm[i] * norm[j])) >= 0.85:
                want[i, j] = round(s, 6)
    assert (100, 105) in want and len(want) > 30
    sizes = memory.GROUP_ROWS, memory.TILE_ROWS, memory.TILE_TERMS
    for memory.GROUP_ROWS, memory.TILE_ROWS, memory.TILE_TERMS in (sizes, (16, 3, 50)):
        got = registry.QUERIES["near_duplicates_documents"](spark, str(tmp_path)).collect()
        assert len(got) == len(want) and {(r.i, r.j): r.similarity for r in got} == want
    memory.GROUP_ROWS, memory.TILE_ROWS, memory.TILE_TERMS = sizes


def test_vectors_are_written_once_however_many_groups_they_are_compared_in(spark, monkeypatch):
    """Random words, which no codec makes much smaller; equal texts, one of them without an id, and texts of one id."""
    import random

    from tests.llm.test_disk import shuffled

    rng = random.Random(5)
    texts = [[f"{rng.getrandbits(64):016x}" for _ in range(300)] for _ in range(120)]
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rows += [(200, " ".join(texts[3])), (None, " ".join(texts[3])), (201, " ".join([*texts[4][:-9], "x"])), (4, " ".join(texts[5][:-9])), (202, None), (203, " "), (204, "")]
    entries, size = spark.createDataFrame(rows, "id long, content string"), sum(len(t or "") for _, t in rows)
    alike = {(4, 201), (4, 5)}
    for group_rows in (memory.GROUP_ROWS, 16):
        monkeypatch.setattr(memory, "GROUP_ROWS", group_rows)
        for fold, want in ((True, alike), (False, alike | {(3, 200)})):
            got, moved = shuffled(spark, lambda f=fold: memory.cosine_pairs_blocked(entries, 0.85, fold=f).collect())
            assert sorted((r.i, r.j) for r in got) == sorted(want)
            assert moved < 2 * size, (moved, size)


def test_graph_cycles_keep_users_apart(spark, tmp_path):
    """Users 1 and 6, and 2 and 12, make cycles only when they are folded into one."""
    import datetime

    from quillstone.plans import registry

    walks = {1: "view click", 6: "click view", 2: "signup view error", 12: "error signup", 3: "view click view purchase", 8: "click click", 13: "view"}
    start = datetime.datetime(2024, 1, 1)
    rows = [(100 * u + k, start + datetime.timedelta(seconds=k), u, x) for u, w in walks.items() for k, x in enumerate(w.split())]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for u, w in walks.items():
        w = w.split()
        reach = {(a, b) for a, b in zip(w, w[1:])}
        for _ in w:
            reach |= {(a, d) for a, b in reach for c, d in reach if b == c}
        want |= {f"{u}:{a}" for a, b in reach if a == b}
    assert want == {"3:view", "3:click", "8:click"}
    assert {r.node for r in registry.QUERIES["graph_cycles"](spark, str(tmp_path)).collect()} == want


def test_graph_bfs_walks_every_supplier(spark, tmp_path, monkeypatch):
    from quillstone.plans import registry

    rows = [(1, 10, 7), (1, 11, 8), (2, 10, 9), (21, 12, 7), (30, 10, 6)]
    spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, reach = [], graph.reach
    monkeypatch.setattr(graph, "reach", lambda edges, *a: seen.append(edges) or reach(edges, *a))
    got = {r.node: r.depth for r in registry.QUERIES["graph_bfs"](spark, str(tmp_path)).collect()}
    assert got == {"s1": 0, "o10": 1, "o11": 1, "p7": 2, "p8": 2, "p9": 2, "p6": 2}
    assert {("s21", "o12"), ("s30", "o10"), ("s1", "o10")} <= {(r.src, r.dst) for r in seen[0].collect()}


def test_cosine_pairs_meet_in_blocks_and_part_by_their_outlines(spark, monkeypatch):
    """Texts that share one hot term alone do not leave the task they meet in; what is similar does, whatever the blocks."""
    rng = np.random.default_rng(3)
    texts = [" ".join(["hot"] * 9 + [f"w{k}" for k in rng.integers(0, 400, 12)]) for _ in range(40)] + [f"hot only{k}" for k in range(40)]
    texts += [x + " more" for x in texts[:10]]
    e = spark.createDataFrame([(f"é{i}" if i % 2 else f"z{i}", x) for i, x in enumerate(texts)] + [(None, texts[0])], "id string, content string")
    vec = []
    for r in e.where("id is not null").collect():
        words, n = np.unique(r.content.split(), return_counts=True)
        vec.append((r.id, dict(zip(words.tolist(), n.tolist(), strict=True))))
    norm = {i: sum(c * c for c in v.values()) ** 0.5 for i, v in vec}
    dots = {(min(i, j), max(i, j)): sum(c * w.get(t, 0) for t, c in v.items()) / norm[i] / norm[j] for k, (i, v) in enumerate(vec) for j, w in vec[:k]}
    monkeypatch.setattr(memory, "POSTINGS_BLOCK", 7)
    for threshold in (0.5, 0.9):
        got = {(r.i, r.j): r.similarity for r in memory.cosine_pairs(e, threshold).collect()}
        assert got == pytest.approx({p: s for p, s in dots.items() if s >= threshold})

    v = memory.text_vectors(spark.createDataFrame([(i, f"hot a{i} b{i} c{i}") for i in range(30)], "id long, content string"), "content")
    p = memory.prefixes(v, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0.3)
    dealt = p.selectExpr("term", "0 as a", "0 as b", "0 as block", "id", "w", "after", "part").repartition(2, "term").sortWithinPartitions("term", "a", "b", "id")
    assert p.groupBy("term").count().where("count = 30").count() == 1
    assert memory.meetings(dealt, 0.8).count() == 0


def test_groups_are_compared_exactly_whatever_the_tiles(monkeypatch):
    """Dense and rare terms, norms whose product single precision does not hold, and products summed in slices."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        t = np.unique(np.concatenate([np.arange(5), rng.integers(5, 400, 30)]))
        c = rng.integers(1, 4, len(t)).astype(np.int32) * (5_000_000 if i % 4 == 0 else 1)
        rows.append((1000 - i, t.astype(np.int64).tobytes(), c.astype(np.int32).tobytes()))
    full = np.zeros((60, 400), object)
    for k, (_, t, c) in enumerate(rows):
        full[k, np.frombuffer(t, np.int64)] = [int(x) for x in np.frombuffer(c, np.int32)]
    norm = [float(sum(x * x for x in v)) ** 0.5 for v in full]
    sims = {(1000 - j, 1000 - i): float(full[i] @ full[j]) / (norm[i] * norm[j]) for i in range(60) for j in range(i + 1, 60)}
    want = {p: s for p, s in sims.items() if s >= 0.2}
    assert 100 < len(want) < len(sims)
    monkeypatch.setattr(memory, "TILE_ROWS", 7)
    a, b = (memory.flat_rows(*zip(*side)) for side in (rows[:25], rows[25:]))
    for memory.TILE_CELLS in (1 << 22, 90):
        got = [memory.compare_groups(a, None, 0.2), memory.compare_groups(b, None, 0.2), memory.compare_groups(a, b, 0.2)]
        pairs = [(i, j, s) for g in got for x in g for i, j, s in zip(*(y.tolist() for y in x))]
        assert len(pairs) == len(want) and {(i, j): s for i, j, s in pairs} == pytest.approx(want, rel=1e-12)
    memory.TILE_CELLS = 1 << 22


def test_tfidf_meets_in_buckets_of_terms(spark, monkeypatch):
    """Sums of buckets give the scores of brute force, by group and over all, and no term is a row of its own."""
    import random
    from collections import Counter

    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None]), " ".join(rng.choice(["x", "Y", "É", "w%d" % rng.randrange(40)]) for _ in range(rng.randrange(12)))) for i in range(150)]
    rows += [(200, "a", None), (201, "only", "one one two"), (None, "a", "x lost"), (202, "b", "tab\tx\x0by\u00a0z\n")]
    e = spark.createDataFrame(rows, "id long, g string, content string").repartition(5)
    words = [(i, g, Counter(t for t in re.split(r"[ \t\n\x0b\f\r]+", (x or "").lower()) if t)) for i, g, x in rows]
    monkeypatch.setattr(memory, "BUCKET_CHARS", 40)
    for by in ([], ["g"]):
        same = lambda g, h: not by or g == h
        want = {}
        for i, g, w in words:
            n, s = sum(same(g, h) for _, h, _ in words), 0.0
            for t, c in w.items():
                s += c**0.5 * math.log(n / sum(same(g, h) and t in v for _, h, v in words))
            want[i] = s / sum(w.values()) if w and i is not None and (not by or g is not None) else 0.0
        found = memory.tfidf(e, by)
        assert "Generate" not in found._jdf.queryExecution().toString()
        assert {r.id: r.tfidf for r in found.collect()} == pytest.approx(want)
