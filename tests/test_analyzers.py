"""Analyzer rules, audits and whole runs on small projects."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import analyzers, catalogue, rules
from quillstone.plans import pipelines

FILES = "path string, content string"
LONG = "function big(x) {\n" + "if (x) {\ny()\n}\n" * 20 + "}\n"
NEST = "if (a) {\nfor (;;) {\nwhile (b) {\nif (c) {\nif (d) {\nx()\n}\n}\n}\n}\n}\n"
MANIFEST = '{"dependencies": {"axois": "^1.0", "faker": "1"}, "scripts": {"postinstall": "x"}, "license": "GPL-3"}'


def ids(df):
    return {(r.path, r.rule_id) for r in df.collect()}


@pytest.fixture(scope="module")
def project(spark):
    return spark.createDataFrame(
        [
            ("src/a.ts", LONG + "for (const x of y) {\n db.query('SELECT 1')\n}\n"),
            ("src/b.ts", NEST),
            ("src/c.ts", "import { big } from './a'\n/** doc */\nexport function f() {}\nfoo(17, 33, 99)\nfoo(77, 78, 79)\n"),
            (".env", "A=1"),
            ("package.json", MANIFEST),
            ("package-lock.json", '{"lockfileVersion": 1}'),
            ("src/index.ts", "export * from './a'\n" * 5),
            ("tests/a.test.ts", "it('works', () => {})"),
            ("src/empty.ts", None),
            ("src/server.ts", "app.get('/u', async (q, r) => {})\nres.cookie('a')\nconst email = x\nconsole.log(password)"),
        ],
        FILES,
    )


def test_metrics():
    assert analyzers.branches("if (a && b) { } else if (c) { } for (;;) { }") == 1 + 2 + 1 + 1 + 1
    assert analyzers.nesting(NEST) == 5
    assert analyzers.functions_of(LONG) == [("big", 1, 62, 21)]
    assert analyzers.functions_of("function open() {") == [("open", 1, 1, 0)]
    assert analyzers.closing("a { b { } } c", 0, 13) == 10


def test_code_rules(spark, project):
    got = ids(analyzers.code_findings(project))
    assert got == {("src/a.ts", "QUAL-001"), ("src/a.ts", "QUAL-002"), ("src/a.ts", "DB-006"), ("src/b.ts", "QUAL-008"), ("src/c.ts", "QUAL-010"), (".env", "SEC-002")}
    nothing = spark.createDataFrame([], FILES)
    assert ids(analyzers.code_findings(nothing)) == set()


def test_graph_rules(spark):
    hub = [(f"src/n{i}.ts", "import { h } from './hub'\nexport const x = 1") for i in range(16)]
    rows = [("src/hub.ts", "export const h = 1"), ("src/lone.ts", "let x"), *hub, ("src/p.ts", "import { q } from './q'"), ("src/q.ts", "import { p } from './p'"), ("src/k.ts", "".join(f"class C{i} extends C{i + 1} {{}}\n" for i in range(5)))]
    files = spark.createDataFrame(rows, FILES)
    log = spark.createDataFrame([(str(i), "src/hub.ts") for i in range(12)], "hash string, file string")
    big = files.unionByName(spark.createDataFrame([("src/hot.ts", "x\n" * 300)], FILES))
    got = ids(analyzers.graph_findings(big, log.unionByName(spark.createDataFrame([(str(i), "src/hot.ts") for i in range(10)], "hash string, file string")), {"src": ["hub"]}))
    assert {("src/hub.ts", "ARCH-001"), ("src/p.ts", "ARCH-004"), ("src/q.ts", "ARCH-004"), (None, "ARCH-006"), ("src/hot.ts", "ARCH-008"), (None, "ARCH-009")} <= got
    assert ("src/hub.ts", "ARCH-008") not in got and not [x for x in got if x[1] == "ARCH-002"]


def test_ratio_and_manifest_rules(spark, project):
    got = ids(analyzers.ratio_findings(project))
    assert {(None, "DOC-001"), (None, "DOC-002"), (None, "DOC-004"), (None, "DOC-005"), (None, "DOC-006"), (None, "DOC-007"), ("src/index.ts", "TOK-004")} <= got
    assert (None, "DOC-003") not in got
    tidy = spark.createDataFrame([("README.md", "Install\n" + "x" * 300), ("CHANGELOG.md", ""), ("docs/adr/1.md", ""), ("a.ts", "// " + "note " * 50 + "\nlet a = 1\n")], FILES)
    assert (None, "TOK-001") in ids(analyzers.ratio_findings(tidy)) and not {x for x in ids(analyzers.ratio_findings(tidy)) if x[1] in ("DOC-004", "DOC-005", "DOC-006")}
    assert {r for _, r in ids(analyzers.manifest_findings(project))} == {"SEC-SC-003", "SEC-SC-004", "SEC-SC-006", "SEC-SC-007", "SEC-SC-008", "SEC-DI-005"}
    assert ids(analyzers.manifest_findings(spark.createDataFrame([("package.json", "{bad")], FILES))) == {("package.json", "SEC-SC-002")}


def test_conditions_of_rules(spark):
    def found(path, text, todo):
        return {r.rule_id for r in rules.evaluate(spark.createDataFrame([(path, text)], FILES), todo).collect()}

    assert "SEC-AC-007" in found("a.ts", "res.cookie('x', {httpOnly: true, secure: true})", catalogue.SECURE)
    assert "SEC-AC-007" not in found("a.ts", "res.cookie('x', {httpOnly: true, secure: true, sameSite: 'lax'})", catalogue.SECURE)
    assert "SEC-INJ-006" in found("a.ts", "'use server'\nexec(x)", catalogue.SECURE)
    assert "SEC-INJ-006" not in found("a.ts", "'use server'", catalogue.SECURE)
    assert "SEC-MC-002" in found("config/app.yml", "DEBUG: true", catalogue.SECURE)
    assert "SEC-MC-002" not in found("src/app.ts", "DEBUG: true", catalogue.SECURE)
    assert "SEC-CR-005" in found("a.ts", "const token = Math.random()", catalogue.SECURE)
    assert "SEC-CR-005" not in found("a.test.ts", "const token = Math.random()", catalogue.SECURE)
    assert "SEC-SD-005" in found("a.ts", "try { a() } catch (e) { }", catalogue.SECURE)
    assert "CMP-TP-005" not in found("a.ts", "fetch(email)", catalogue.COMPLY)
    for todo in (catalogue.ANALYZER, catalogue.SECURE, catalogue.COMPLY):
        assert found("a.ts", None, todo) <= {"SEC-SD-003"}


def test_analysis(project):
    found, categories, total = pipelines.analyze(project)
    c = {r.category: r for r in categories.collect()}
    assert len(c) == 6 and not c["database"].na and c["security"].score < 15
    assert 0 <= total.first().total <= 100
    assert found.where("rule_id = 'SEC-005'").count() == 1


@pytest.mark.parametrize("kind", ["secure", "comply"])
def test_audits(project, kind):
    found, scores = pipelines.audit_findings(project, kind), pipelines.audit_scores(project, kind)
    rows = {r.layer: r for r in scores.collect()}
    assert set(rows) == set(range(1, len(pipelines.AUDITS[kind][1]) + 1))
    assert all(0 <= r.passed <= r.total and 0 <= r.score <= r.weight for r in rows.values())
    if kind == "secure":
        assert (rows[6].passed, rows[6].total) == (3, 8)
        assert {r.layer for r in pipelines.audit_findings(project, kind, quick=True).collect()} <= {1, 3, 4, 5}
    total = pipelines.audit_total(scores, found, kind)
    assert total.first().total <= 74
    assert not pipelines.gate(total, found).first().passed
    assert pipelines.gate(total, found, min_grade="Zero").first().passed
    assert not pipelines.gate(total, found, min_grade="S").first().passed
    assert pipelines.report_markdown(found).first().section.startswith("## Critical")
    assert pipelines.report_json(found).count() == found.count()


def test_optimize(spark):
    t = spark.createDataFrame([("s1", "User: hello there\nAssistant: hi\n" + "word " * 400), ("s2", "User: x\n<tool_use>\nTypeError: no")], "session string, text string")
    o = pipelines.optimize_transcripts(t, "text", "session", 1000, budget=100)
    kept = {(r.session, r.pos): r.kept for r in o.collect()}
    assert kept[("s1", 1)] and not kept[("s1", 2)]
    r = {x.session: x for x in pipelines.optimization_result(o, ["session"]).collect()}
    assert r["s1"].tokens_after < r["s1"].tokens_before and r["s2"].reduction == 0
    assert {x.session for x in pipelines.optimized_context(o).collect()} == {"s1", "s2"}
    e = o.select("id", "pos", "content", "ts_ms", "score", "ttl_s", "access_count", "critical")
    got = pipelines.optimize_entries(e.withColumn("ts_ms", F.lit(0)), 10**9, 50.0)
    assert pipelines.optimization_result(got).first().entries_processed == o.count()


def test_rules_of_several_conditions(spark):
    pii = "interface User { email, phone, firstName, lastName, address, ssn, passport, gender, religion, salary, income }"
    files = spark.createDataFrame([("a.ts", "const r = /(a+)+$/g"), ("b.ts", "const r = /a+b/g"), ("c.ts", pii), ("d.ts", "express()\napp.use(express.json())")], FILES)
    assert ids(analyzers.extra_audit_findings(files)) == {("a.ts", "SEC-INJ-008"), ("c.ts", "CMP-DM-001"), (None, "SEC-EX-004")}
    assert {r.layer for r in pipelines.audit_findings(files, "comply", layers=[5]).collect()} == {5}


def test_data_flow(spark):
    files = spark.createDataFrame([("b.ts", "const email = a"), ("a.ts", "const email = b\nconst phone = c")], FILES)
    got = {r.data_type: (r.category, r.collection_point, r.has_encryption) for r in pipelines.data_flow(pipelines.audit_findings(files, "comply")).collect()}
    assert got == {"email": ("pii", "a.ts", False), "phone": ("pii", "a.ts", False)}


def test_secure_fixes(spark):
    from quillstone.operators import summaries

    fix = lambda f, x: spark.createDataFrame([(x,)], "t string").select(f(F.col("t"))).first()[0]
    assert fix(summaries.apply_secure_fixes, "createHash('sha1')") == "createHash('sha256')"
    assert fix(summaries.apply_secure_fixes, "x = Math.random()") == "import { randomUUID } from 'node:crypto';\nx = randomUUID()"
    assert fix(summaries.apply_secure_fixes, "cookie: { secure: true }") == "cookie: { secure: true , httpOnly: true, sameSite: 'strict'}"
    assert fix(summaries.pin_dependencies, '{"a": "^1.2", "b": "~3"}') == '{"a": "1.2", "b": "3"}'
    assert fix(lambda c: summaries.complete_gitignore(c, [".env", "dist"]), "dist\n") == "dist\n.env"


#: Pairs from the published description of the algorithm.
STEMS = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit digitizer digit vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope formality formal sensitivity sensit sensibility sensibl triplicate triplic formative form electricity electr goodness good revival reviv allowance allow inference infer adjustable adjust replacement replac adoption adopt effective effect probate probat rate rate controlling control roll roll".split()


def test_porter(spark):
    from quillstone.operators import search

    for word, stem in zip(STEMS[::2], STEMS[1::2], strict=True):
        assert search.porter(word) == stem
        assert word.startswith(stem[: max(1, len(stem) - 2)])
    d = spark.createDataFrame([(1, "connected tokens"), (2, "a connection of token rings"), (3, "disconnect token"), (4, None)], "k int, t string")
    assert {r.k for r in search.bm25(d, "t", "connecting token", "k", stem=True).collect()} == {1, 2}
    assert search.bm25(d, "t", "connecting token", "k").count() == 0


def test_long_texts(spark):
    """Very long lines and texts neither overflow the pattern engine nor take long."""
    files = spark.createDataFrame([("a.ts", "/" + "x" * 300_000 + "\n" + "token /a+/ " * 20_000)], FILES)
    for kind in pipelines.AUDITS:
        assert pipelines.audit_scores(files, kind).count() == len(pipelines.AUDITS[kind][1])


def test_magic_numbers_trim_and_space_as_their_sql_does(spark):
    """Lines lose Unicode's space separators, and a vertical tab is no space."""
    lines = ["　//142", "\xa0142,", " `142", "\t142,", "\x0b142,", ":\x0b142", "　call 142"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string").select("i", analyzers.magic_numbers(F.col("x")).alias("n"))
    assert [r.n for r in got.orderBy("i").collect()] == [0, 0, 0, 0, 1, 1, 1]


def test_patterns_are_tried_only_where_their_pieces_occur(spark):
    """The pieces refuse no text in which a pattern occurs, and details that nobody asks for are not looked for."""
    from quillstone.plans.held_queries import SNIPPETS

    todo = [r for r in catalogue.ANALYZER + catalogue.SECURE + catalogue.COMPLY if r.shape == "F"]
    texts = [*SNIPPETS, "X = 'ſelect * from a'", "SELECT\n* FROM k", "İ NOLOCK K", "plain prose", "", None]
    files = spark.createDataFrame([(f"src/f{i}.ts", x) for i, x in enumerate(texts)], FILES)
    bare = [r._replace(gate="", gates=(), also="", only="", skip="") for r in todo if r.id.startswith(("QUAL", "SEC-00", "CMP-PD"))]
    tried = files.select("path", *[F.coalesce("content", F.lit("")).rlike(r.trigger).alias(r.id) for r in bare]).collect()
    plain = [(row.path, r.id) for row in tried for r in bare if row[r.id]]
    found = rules.evaluate(files, bare)
    assert ids(found) == set(plain) and len(plain) > 10
    assert {frozenset({"token", "cache"}), frozenset({"store", "put"})} == set(rules.needed(r"(?i)(?:token|cache)\s*(?:store|put)\b"))
    assert rules.needed(r"a|bcd") == () and rules.needed(r"(?:abc)*x?") == ()
    assert "regexp_count" not in found.select("path", "rule_id")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r.line for r in found.where("path = 'src/f17.ts'").collect()} == {1}
    assert [r.line for r in rules.evaluate(spark.createDataFrame([("a.ts", "x\ny\neval(z)")], FILES), [r for r in bare if r.id == "QUAL-004"]).collect()] == [3]
