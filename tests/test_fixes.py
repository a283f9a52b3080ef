"""Fixes as edits of spans, against a plain pass over lines and matches."""

import re

from quillstone.operators import fixes

TEXTS = {
    "a.ts": "const h = createHash('md5');\nconsole.log(1);\n  debugger\nx = createHash( \"sha1\" )\n// @ts-ignore\nlast",
    "b.ts": "cors({ origin: '*' });\nlet y = 1; console.log(y);\n\tconsole.warn('z')",
    "c.ts": "console.info(createHash('md5'));\n// @ts-nocheck\nconsole.debug(2)\ndebugger;",
    "d.ts": "nothing here\n",
    "e.ts": "",
    "f.ts": None,
    "g.ts": "debugger",
}


def lines_out(text, pattern):
    return "\n".join(x for x in text.split("\n") if not re.fullmatch(pattern, x))


def plain(text):
    """One fix after another over whole lines and matches; right where no fixes meet."""
    text = lines_out(text, r"\s*(console\.(log|debug|warn|info)\s*\(.*\);?\s*|debugger;?\s*)")
    text = re.sub(r"createHash\s*\(\s*['\"](?:md5|sha1)['\"]\s*\)", "createHash('sha256')", text)
    text = lines_out(text, r"\s*//\s*@ts-(ignore|nocheck)\s*")
    return re.sub(r"(origin\s*:\s*)['\"]?\*['\"]?", r"\1'https://your-domain.com'", text)


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def test_actions_and_fixed_texts(spark):
    files = table(spark, TEXTS)
    actions = fixes.fix_actions(files)
    got = {(r.rule_id, r.path): r for r in actions.collect()}
    assert set(got) == {("QUAL-009", "a.ts"), ("SEC-003", "a.ts"), ("QUAL-004", "a.ts"), ("SEC-004", "b.ts"), ("QUAL-009", "b.ts"), ("QUAL-009", "c.ts"), ("SEC-003", "c.ts"), ("QUAL-004", "c.ts"), ("QUAL-009", "g.ts")}
    a = got["QUAL-009", "a.ts"]
    assert a.description == "Remove 2 debug statement(s)" and a.preview == ["L2: console.log(1);", "L3: debugger"]
    assert got["SEC-003", "a.ts"].preview == ["L1: createHash('md5')", 'L4: createHash( "sha1" )']
    assert got["QUAL-009", "b.ts"].preview == ["L3: console.warn('z')"]
    fixed = {r.path: r for r in fixes.apply_actions(files, actions).collect()}
    assert {p: r.content for p, r in fixed.items()} == {p: plain(t) for p, t in TEXTS.items() if t and plain(t) != t}
    # the hash inside a debug line that goes is a conflict, the line starts first
    assert {p: r.conflicts for p, r in fixed.items()} == {"a.ts": 0, "b.ts": 0, "c.ts": 1, "g.ts": 0}


def test_actions_are_one_for_each_rule_and_file(spark):
    files = table(spark, TEXTS)
    found = spark.createDataFrame([("SEC-003", "a.ts")] * 3 + [("SEC-003", "d.ts"), ("QUAL-001", "a.ts")], "rule_id string, path string")
    actions = fixes.fix_actions(files, found)
    assert [(r.rule_id, r.path) for r in actions.collect()] == [("SEC-003", "a.ts")]
    twice = fixes.apply_actions(files, actions.unionByName(actions)).collect()
    assert [(r.path, r.applied) for r in twice] == [("a.ts", 2)] and twice[0].content.count("sha256") == 2


def test_overlapping_edits_go_by_start_then_rule(spark):
    own = [fixes.Fix("R1", "bc", "<1>", "{}"), fixes.Fix("R2", "abc|cd", "<2>", "{}"), fixes.Fix("R3", "(c)(d)e", "$2$1", "{}")]
    files = table(spark, {"x": "abcde bcd é😀cd", "y": "bcbc"})
    done = {r.path: (r.content, r.applied, r.conflicts) for r in fixes.apply_actions(files, fixes.fix_actions(files, fixes=own), own).collect()}
    assert done["x"] == ("<2>de <1>d é😀<2>", 3, 3)  # six edits were found
    assert done["y"] == ("<1><1>", 2, 0)
    plan = fixes.fix_actions(files, fixes=own)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
