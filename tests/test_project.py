"""Files, plans, counters and streams: known cases, and the stream against the batch operator."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone import streaming
from quillstone.operators import memory, project, rules, store, summaries, workflow


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_project_facts(spark):
    pkg = json.dumps({"name": "shop", "scripts": {"build": "tsc", "other": "x"}, "dependencies": {"react": "1", "zod": ""}, "devDependencies": {"typescript": "5"}})
    f = files(spark, [("package.json", pkg), ("src/index.ts", "a\nb"), ("src/lib/x.js", "1"), ("node_modules/y.js", ""), ("db/q.sql", None)])
    assert project.stack_tags(f).first().tags == ["typescript", "react", "sql"]
    assert project.stack_tags(f.limit(0)).first().tags == []
    assert project.libraries(f).first().libraries == ["TypeScript", "React"]
    assert [(r.path, r.lines) for r in project.modules(f).orderBy("path").collect()] == [("src/index.ts", 2), ("src/lib/x.js", 1)]
    assert [r.path for r in project.entry_points(f).collect()] == ["src/index.ts"]
    assert {r.dir: r.names for r in project.directories(project.modules(f)).collect()} == {"src": "index.ts (2L)", "src/lib": "x.js (1L)"}
    text = "\n".join(r.section for r in project.guide(f, sections=["end"]).orderBy("pos").collect())
    assert text.startswith("# shop") and "`npm run build` — `tsc`" in text and "Library API" in text and "### src/lib/ (1 files)" in text and text.endswith("end")
    assert project.guide(f.where("path = 'db/q.sql'")).first().section.startswith("# Project")


def test_single_and_changed_files(spark):
    f = files(spark, [("a/b.ts", ""), ("c.ts", "")])
    assert [r.path for r in project.single_file(f, "a/../a/b.ts").collect()] == ["a/b.ts"]
    assert [r.path for r in project.single_file(f, "/work/c.ts", "/work").collect()] == ["c.ts"]
    assert project.single_file(f, "../c.ts", "/work").count() == 0 and project.single_file(f, "/workshop/c.ts", "/work").count() == 0
    assert project.changed_files(f).count() == 2
    assert project.changed_files(f, f.where("path = 'c.ts'"), f.where("path = 'c.ts'")).count() == 1


def test_plans(spark, tmp_path):
    p = workflow.new_plan(spark, "t", [(1, "read", "x", 10), (2, "edit", "y", 5)], 7)
    i = p.first().id
    p, limits = workflow.start_plan(p, i)
    assert tuple(limits.first()) == (5, 0, False)
    p = workflow.update_step(p, i, 1, "completed", "done")
    assert workflow.verify_plans(p).select("status", "tokens_used", "success").first() == ("executing", 10, False)
    assert workflow.verify_plans(workflow.update_step(p, i, 2, "skipped")).first().status == "failed"
    assert workflow.verify_plans(workflow.update_step(p, i, 2, "completed")).first().status == "completed"
    with pytest.raises(KeyError):
        workflow.update_step(p, i, 9, "completed")
    with pytest.raises(KeyError):
        workflow.start_plan(p, "absent")
    for r in p.toJSON().collect():
        (tmp_path / "plan.json").write_text(r)
    (tmp_path / "broken.json").write_text("{")
    assert [r.id for r in workflow.read_plans(spark, str(tmp_path)).collect()] == [i]


def test_options():
    kinds = {"a.b": int, "c": bool}
    assert workflow.set_option({"a": {"x": 1}}, "a.b", 2, kinds) == {"a": {"x": 1, "b": 2}}
    assert workflow.get_option({"a": {"b": 3}}, "a.b") == 3 and workflow.get_option({"a": 1}, "a.b") is None
    with pytest.raises(TypeError):
        workflow.set_option({}, "a.b", True, kinds)
    with pytest.raises(KeyError):
        workflow.set_option({}, "z", 1, kinds)


def test_commands_and_outputs(spark):
    assert workflow.run_command(spark, ["echo", "hi"]).first() == ("echo hi", "hi\n", 0)
    rows = [(json.dumps({"session_id": "s", "tool_name": "Bash", "tool_input": {"command": "ls"}, "tool_response": r}),) for r in ("x", {"a": 1})]
    got = workflow.tool_outputs(spark.createDataFrame([*rows, ("no json",)], "v string"), "v").collect()
    assert sorted((r.tool, r.command, r.text) for r in got) == [("Bash", "ls", "x"), ("Bash", "ls", '{"a":1}')]


@pytest.mark.parametrize(("text", "command", "want"), [
    ("a\n3 passed\nTests: 3", "x", "Test output (3 lines):\n3 passed\nTests: 3"),
    ("a TS2304: x\nb TS2304: y\nc TS1005: z", "x", "TypeScript: 3 errors, 2 codes: TS2304:2, TS1005:1"),
    ("  1:1 bad  no/such\n  2:1 bad  no/such\n2 problems", "x", "Lint: 3 lines, 1 rules: no/such:2"),
    ("added 4 packages\n2 vulnerabilities", "npm i", "Packages: 4 added, 2 vulnerabilities"),
    ("ok\nbuild failed", "make", "Build output (1 of 2 lines):\nbuild failed"),
    ("diff --git a/x b/x\n+1\ndiff --git a/y b/z", "git diff", "Diff: 2 files: x, z"),
    (f"commit {'a' * 40}\nAuthor: b\n\n    Mend it\n", "git log", "Log: 1 commits. Latest: Mend it"),
    ("\tmodified: a.py\n\tother.py", "git status", "Status: 1 modified, 1 staged, 2 untracked. Files: a.py, a.py"),
    ("a.py\nb.py\nMakefile", "ls", "Listing: 3 lines. By extension: .py:2, (no ext):1"),
    (json.dumps({"k": "x" * 1000, "z": 1}), "curl", "JSON object: k, z"),
    ("1\n2\n3\n4\n5\n6\n7", "x", "Output of 7 lines. First: 1 | 2 | 3 ... last: 6 | 7"),
    (None, None, "Output of 1 lines. First: "),
])
def test_shell_summary(spark, text, command, want):
    df = spark.createDataFrame([(text, command)], "t string, c string")
    assert df.select(summaries.shell_summary(F.col("t"), F.col("c"))).first()[0] == want


def test_frameworks_and_guard(spark):
    assert rules.frameworks("GDPR, none") == ["gdpr"] and rules.frameworks("none") == rules.FRAMEWORKS == rules.frameworks(None)
    lines = [("x = /ab/", 5, True), ("x / y / ab", 8, False), ("new RegExp('ab')", 12, True), (r"a\/ab", 3, False)]
    df = spark.createDataFrame(lines, "l string, i int, w boolean")
    assert all(r[0] == r[1] for r in df.select(rules.in_pattern(F.col("l"), F.col("i")), "w").collect())


def test_stores(spark, tmp_path):
    f = spark.createDataFrame([("R", "p", "t")], "rule_id string, path string, title string")
    for _ in range(2):
        store.save_baseline(f, f"{tmp_path}/b")
        store.append_history(f, f"{tmp_path}/h")
    assert spark.read.json(f"{tmp_path}/b").count() == 1 and spark.read.parquet(f"{tmp_path}/h").count() == 2
    assert store.clear(f).count() == 0 and json.loads(workflow.as_json(f).first().value)["rule_id"] == "R"
    r = store.latency(spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "v double"), "v").first()
    assert tuple(r) == (101, 50.0, 95.0, 99.0)
    assert tuple(store.latency(spark.createDataFrame([], "v double"), "v").first()) == (0, None, None, None)


def test_prune_by_group_with_ties_and_nulls(spark):
    rows = [(i, None if i % 3 == 0 else "hot", i, "same text" if i % 2 else f"word{i} other{i % 5}") for i in range(200)]
    e = spark.createDataFrame(rows, "id long, g string, pos long, content string").repartition(7)
    got = memory.sparse_prune(e, 10, ["g"]).collect()
    assert len(got) == 200
    for g in (None, "hot"):
        part = sorted((r for r in got if r.g == g), key=lambda r: (-r.tfidf, r.pos))
        n = -(-len(part) // 10)
        assert [r.kept for r in part] == [True] * n + [False] * (len(part) - n)
    assert memory.sparse_prune(e.limit(0), 10, ["g"]).count() == 0


def test_stream_keeps_what_the_batch_operator_keeps(spark, tmp_path):
    rng = random.Random(3)
    kind = "session string, id string, pos long, content string, ts_ms long, ttl_s long, score double, access_count long, critical boolean"
    batches, n = [], 0
    for b in range(3):
        rows = []
        for s in ("a", "b"):
            for _ in range(12):
                n += 1
                rows.append((s, str(n), n, " ".join(rng.choices(["x", "y", "z", f"w{n}", f"v{n % 7}"], k=rng.randint(2, 12))) + f" u{n}", n * 60_000, 3600, rng.choice([0.2, 0.5, 0.9]), n % 3, n % 7 == 0))
        rows.append((rows[0][0], "again", n, rows[0][3], *rows[0][4:]))
        batches.append(spark.createDataFrame(rows, kind).coalesce(1))
    src = tmp_path / "in"
    held, want, now = None, [], {"a": 0, "b": 0}
    for i, b in enumerate(batches):
        b.write.mode("append").parquet(str(src))
        new = b.where("id <> 'again'")
        both = new if held is None else held.unionByName(new)
        kept = []
        for s in ("a", "b"):
            last = max(r.ts_ms for r in new.where(F.col("session") == s).collect())
            kept += memory.budget_prune(both.where(F.col("session") == s), 60, ["session"], last).where("kept").collect()
        held = spark.createDataFrame([tuple(r[c] for c in new.columns) for r in kept], kind)
        want.append({s: {r.content for r in kept if r.session == s} for s in ("a", "b")})
    import hashlib

    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = streaming.drain(streaming.optimize(stream, 60, interval=3)).collect()
    assert sorted({r.updates for r in out}) == [0, 1, 2] and all(r.whole == (r.updates == 0) for r in out)
    for r in out:
        step = 2 if r.whole else r.updates - 1
        assert set(r.hashes) == {hashlib.sha256(c.encode()).hexdigest() for c in want[step][r.session]}
        assert r.tokens_after <= r.tokens_before and r.rows - (r.session == "a") == 12
    assert any(r.hits for r in out if r.session == "a")


def test_consolidation_is_due():
    assert streaming.consolidate_due(None, 5, 1) and not streaming.consolidate_due(0, 3_599_999, 1) and streaming.consolidate_due(0, 3_600_000, 1) and not streaming.consolidate_due(None, 5, 0)


def test_calls(spark):
    from quillstone import api

    text = "first words here\n\nsecond words there\n\nthird words everywhere"
    r = api.optimize(spark, text, 1_000, 34).first()
    assert r.entries_processed == 3 and 1 <= r.entries_kept <= 2 and all(p in text for p in r.context.split("\n\n"))
    assert api.relay(spark, ["echo", "hello world"], 1_000, 100).select("code", "context").first() == (0, "hello world")

    class Long:
        def findings(self, files):
            return files.where(F.length("content") > 3).select("path", F.lit("OWN-1").alias("rule_id"), F.lit("minor").alias("severity"), F.lit(0.5).alias("deduction"), F.lit("").alias("detail"))

    assert isinstance(Long(), api.Analyzer) and isinstance(api.TranscriptAdapter(0), api.Adapter)
    found, _ = api.analyze(files(spark, [("a.ts", "const a = 1"), ("b.ts", "x")]), Long())
    assert [x.path for x in found.where("rule_id = 'OWN-1'").collect()] == ["a.ts"]
    a = api.TranscriptAdapter(1_000, 1_000)
    t = spark.createDataFrame([("s", "User: hi there\nAssistant: hello you")], "session string, text string")
    assert "User: hi there" in a.context(a.parse(t)).first().context


def test_bpe_count(spark):
    tok = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from quillstone.operators import tokens

    path = public.path("byte_bpe_50k.json")
    model = tok.Tokenizer.from_file(path)
    model.encode_special_tokens = True
    texts = ["hello <|endoftext|> world", "", None, "é" * 5000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tokens.bpe_count(path)("t").alias("n")).orderBy("i").collect()
    assert [r.n for r in got] == [len(model.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
