"""Rules as rows, one evaluator, and the scores made from findings.

Shape F: a file is an issue if the trigger (and ``also``, if given) occurs and the gate does not; shape P: the
project is an issue if the trigger (and ``also``) occurs somewhere and the gate nowhere. Shape A: the project is
an issue if the gate occurs nowhere. ``gates`` must all occur: one that is absent is an issue. ``only`` and
``skip`` choose files by path. All rules of a catalogue are evaluated in one pass over the files: the catalogue
has a fixed size and becomes columns, not a join.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import and_
from re import _parser as parser
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillstone import functions as Q


class Rule(NamedTuple):
    id: str
    layer: int
    severity: str
    trigger: str
    gate: str = ""
    shape: str = "F"
    deduction: float = 0.5
    regulation: str = ""
    effort: str = "sprint"
    also: str = ""
    gates: tuple[str, ...] = ()
    only: str = ""
    skip: str = ""
    #: What a finding is called: of ``titles`` (pattern, title) the first that occurs in the file, else ``title``, else the id.
    title: str = ""
    titles: tuple[tuple[str, str], ...] = ()


RANKS = {"critical": 0, "high": 1, "major": 1, "medium": 2, "minor": 2, "low": 3, "info": 4}
EFFORTS = {"immediate": 0, "sprint": 1, "quarter": 2}


def _words(items) -> list[frozenset[str]]:
    """Sets of lower-cased pieces of text; every match of a parsed pattern holds one of each set."""
    found, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is parser.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        found.append(frozenset([run]))
        run = ""
        if op is parser.SUBPATTERN:
            found += _words(arg[-1])
        elif op is parser.BRANCH:
            parts = [_words(x) for x in arg[1]]
            if all(parts):
                found.append(frozenset().union(*(max(x, key=lambda y: (min(4, *map(len, y)), -len(y))) for x in parts)))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and arg[0]:
            found += _words(arg[2])
    return [x for x in found if min(map(len, x)) > 1]


@lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of lower-cased pieces: a text that the pattern occurs in holds one of each set, in some letter case."""
    try:
        found = _words(parser.parse(pattern))
    except (re.error, OverflowError):  # what only the JVM's dialect says
        return ()
    return tuple({frozenset(x for x in f if not any(y in x for y in f - {x})) for f in found})


def _tried(files: DataFrame, content: str, patterns: list[str]) -> tuple[DataFrame, Callable[[str], Column]]:
    """The files with a column that lists the patterns a text may hold, and the condition that a pattern of them occurs.

    A pattern is tried only where a piece that it needs is found: ASCII letters stay next to each other when a text is lower-cased, and
    a plain search costs a small part of a pattern's.
    """
    patterns = sorted(set(patterns))
    wanted = [(k, needed(p)) for k, p in enumerate(patterns)]
    pieces = sorted(frozenset().union(*(x for _, sets in wanted for x in sets)))

    def may_hold(text: str) -> list[int]:
        low = text.lower()
        seen = {x for x in pieces if x in low}
        return [k for k, sets in wanted if not any(seen.isdisjoint(x) for x in sets)]

    @F.pandas_udf(ArrayType(IntegerType()))
    def held(texts: pd.Series) -> pd.Series:
        return texts.map(may_hold)

    text, number = F.coalesce(F.col(content), F.lit("")), {p: k for k, p in enumerate(patterns)}
    return files.withColumn("_held", held(text)), lambda p: F.array_contains("_held", number[p]) & text.rlike(p)


def _chosen(r: Rule, path: F.Column) -> F.Column:
    """Files that a rule looks at."""
    c = F.lit(True)
    if r.only:
        c = c & path.rlike(r.only)
    if r.skip:
        c = c & ~path.rlike(r.skip)
    return c


def titled(r: Rule, text: Column | None = None) -> Column:
    plain = F.lit(r.title or r.id)
    return F.coalesce(*[F.when(text.rlike(p), t) for p, t in r.titles], plain) if r.titles and text is not None else plain


def evaluate(files: DataFrame, rules: list[Rule], path: str = "path", content: str = "content") -> DataFrame:
    """(rule_id, layer, severity, path, hits, line, deduction, title) for each file that has an issue (F rules); one narrow pass."""
    text, cols = F.coalesce(F.col(content), F.lit("")), []
    files, occurs = _tried(files, content, [r.trigger for r in rules if r.shape == "F"])
    todo = [r for r in rules if r.shape == "F"]
    for k, r in enumerate(todo):
        hit = _chosen(r, F.col(path)) & occurs(r.trigger)
        if r.also:
            hit = hit & text.rlike(r.also)
        if r.gate:
            hit = hit & ~text.rlike(r.gate)
        if r.gates:
            hit = hit & ~reduce(and_, [text.rlike(g) for g in r.gates])
        cols.append(F.when(hit, k))
    found = files.select(F.col(path).alias("path"), text.alias("_text"), F.explode(F.filter(F.array(*cols, F.lit(None).cast("int")), lambda x: x.isNotNull())).alias("_k"))
    if not todo:
        found = found.where(F.lit(False))
    # what a finding says is made after the rows are known, so that a plan without hits, line or title does not look for them
    of = lambda say: F.coalesce(*[F.when(F.col("_k") == k, say(r)) for k, r in enumerate(todo)], *([] if todo else [F.lit(None)]))
    first = lambda r: F.size(F.split(F.substring(F.col("_text"), F.lit(1), F.regexp_instr(F.col("_text"), F.lit(r.trigger)) - 1), "\n"))
    says = {"rule_id": lambda r: F.lit(r.id), "layer": lambda r: F.lit(r.layer), "severity": lambda r: F.lit(r.severity), "hits": lambda r: F.regexp_count("_text", F.lit(r.trigger)), "line": first, "deduction": lambda r: F.lit(r.deduction), "title": lambda r: titled(r, F.col("_text"))}
    return found.select("path", *[of(f).alias(name) for name, f in says.items()])


def evaluate_project(files: DataFrame, rules: list[Rule], content: str = "content", path: str = "path") -> DataFrame:
    """(rule_id, layer, severity, issue, title) of P and A rules from one aggregate over the files."""
    chosen = [r for r in rules if r.shape in "PA"]
    if not chosen:
        return files.sparkSession.createDataFrame([], "rule_id string, layer int, severity string, issue boolean")
    files, occurs = _tried(files, content, [p for r in chosen for p in (r.trigger, r.also, r.gate, *r.gates)])
    aggs, row = [], []
    for i, r in enumerate(chosen):
        looked = _chosen(r, F.col(path)) if r.only or r.skip else F.lit(True)

        def seen(pattern: str, name: str, looked=looked) -> F.Column:
            aggs.append(F.coalesce(F.max(looked & occurs(pattern)), F.lit(False)).alias(name))
            return F.col(name)

        issue = seen(r.trigger, f"t{i}") if r.trigger or r.shape == "P" else F.lit(True)
        if r.also:
            issue = issue & seen(r.also, f"a{i}")
        if r.gate:
            issue = issue & ~seen(r.gate, f"g{i}")
        if r.gates:
            issue = issue & ~reduce(and_, [seen(g, f"g{i}_{k}") for k, g in enumerate(r.gates)])
        row.append(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.layer).alias("layer"), F.lit(r.severity).alias("severity"), issue.alias("issue"), titled(r).alias("title")))
    return files.agg(*aggs).select(F.explode(F.array(*row)).alias("r")).select("r.*")


def checks(files: DataFrame, rules: list[Rule], strict: tuple[int, ...] = (), content: str = "content", path: str = "path") -> DataFrame:
    """(rule_id, layer, passed, total) of every rule: F rules count the files they inspect, the others count as one.
    A rule with nothing to inspect passes once; in ``strict`` layers it does not."""
    text, row, marks, aggs = F.coalesce(F.col(content), F.lit("")), [], [], []
    seen, occurs = _tried(files, content, [r.trigger for r in rules if r.shape == "F"])
    for i, r in enumerate(x for x in rules if x.shape == "F"):
        looked = _chosen(r, F.col(path)) & occurs(r.trigger)
        for p in filter(None, [r.also]):
            looked = looked & text.rlike(p)
        ok = text.rlike(r.gate) if r.gate else reduce(and_, [text.rlike(g) for g in r.gates]) if r.gates else F.lit(False)
        marks.append(F.when(looked, F.when(ok, 1).otherwise(2)).otherwise(0).alias(f"m{i}"))  # each pattern is tried once
        aggs += [F.count_if(F.col(f"m{i}") > 0).alias(f"n{i}"), F.count_if(F.col(f"m{i}") == 2).alias(f"bad{i}")]
        least = F.lit(0 if r.layer in strict else 1)
        row.append(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.layer).alias("layer"), (F.greatest(F.col(f"n{i}"), least) - F.col(f"bad{i}")).alias("passed"), F.greatest(F.col(f"n{i}"), F.lit(1)).alias("total")))
    per_file = seen.select(*marks).agg(*aggs).select(F.explode(F.array(*row)).alias("c")).select("c.*") if row else None
    whole = evaluate_project(files, rules, content, path).select("rule_id", "layer", F.when(F.col("issue"), 0).otherwise(1).cast("long").alias("passed"), F.lit(1).cast("long").alias("total"))
    return whole if per_file is None else per_file.unionByName(whole)


def cap(findings: DataFrame, n: int = 5) -> DataFrame:
    """At most n findings per rule, by path and line."""
    w = Window.partitionBy("rule_id").orderBy("path", "line")
    return findings.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def deductions(findings: DataFrame, caps: dict[str, float] | None = None) -> DataFrame:
    """(rule_id, deducted): summed and capped by rule."""
    limit = F.coalesce(*[F.when(F.col("rule_id") == k, v) for k, v in (caps or {}).items()], F.lit(1e9))
    return findings.groupBy("rule_id").agg(F.sum("deduction").alias("s")).select("rule_id", F.least("s", limit).alias("deducted"))


def weighted_score(categories: DataFrame) -> DataFrame:
    """category, max_points, score, na -> total and grade; weights of absent categories go to the others."""
    scale = 100 / F.sum(F.when(~F.col("na"), F.col("max_points")))
    got = F.sum(F.when(~F.col("na"), F.col("score")))
    t = categories.agg(F.coalesce(got * scale, F.lit(0.0)).alias("raw")).select(Q.js_round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), "raw")), 2).alias("total"))
    return t.withColumn("grade", Q.grade(F.col("total")))


def layer_scores(checks: DataFrame) -> DataFrame:
    """layer, weight, passed, total -> score (two decimals) and grade per layer."""
    g = checks.groupBy("layer", "weight").agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"))
    s = Q.js_round(F.least(F.col("weight"), F.greatest(F.lit(0.0), F.when(F.col("total") > 0, F.col("passed") / F.col("total") * F.col("weight")).otherwise(F.col("weight")))), 2)
    return g.withColumn("score", s).withColumn("grade", Q.layer_grade(F.col("score"), F.col("weight")))


#: Fixed values: (cap, rules that must all be present; rule:severities where they matter; L1: any rule of layer 1; ~word: in the title).
SECURE_CAPS = [(14, ["SEC-CR-002~default:critical"]), (34, ["SEC-MC-007:high"]), (49, ["SEC-INJ-001"]), (69, ["SEC-CR-002:critical"]), (74, ["*:critical"])]
COMPLY_CAPS = [(14, ["L1:critical,high", "CMP-CN-004:high"]), (34, ["CMP-CN-001"]), (49, ["CMP-DR-002"]), (49, ["CMP-PD-010", "CMP-DP-001"]), (69, ["CMP-CN-005"]), (74, ["*:critical"])]


def capped_total(scores: DataFrame, findings: DataFrame, caps: list[tuple[int, list[str]]]) -> DataFrame:
    def present(spec: str):
        rule, _, sev = spec.partition(":")
        rule, _, word = rule.partition("~")
        if word:
            return F.coalesce(F.max(F.col("rule_id").contains(rule) & F.lower("title").contains(word) & F.col("severity").isin(sev.split(","))), F.lit(False))
        c = F.lit(True) if rule == "*" else F.col("layer") == int(rule[1:]) if rule[1:].isdigit() else F.col("rule_id") == rule
        return F.coalesce(F.max(c & (F.col("severity").isin(sev.split(",")) if sev else F.lit(True))), F.lit(False))

    flags = []
    for i, (_, specs) in enumerate(caps):
        x = present(specs[0])
        for s in specs[1:]:
            x = x & present(s)
        flags.append(x.alias(f"c{i}"))
    one = scores.agg(F.sum("score").alias("raw")).crossJoin(F.broadcast(findings.agg(*flags)))  # one row each
    limit = F.least(F.lit(100.0), *[F.when(F.col(f"c{i}"), float(n)).otherwise(100.0) for i, (n, _) in enumerate(caps)])
    return one.select(F.round("raw", 2).alias("raw"), F.least(F.round("raw", 2), limit).alias("total")).withColumn("grade", Q.grade(F.col("total"), Q.AUDIT_GRADES))


def matrix(controls: DataFrame, findings: DataFrame, key: str = "control") -> DataFrame:
    """pass: no finding; fail: a critical or high one; else partial. Controls are a fixed list and are broadcast."""
    f = findings.groupBy(key).agg(F.count("*").alias("n"), F.max(F.col("severity").isin("critical", "high")).alias("bad"))
    return controls.join(f, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "pass").when(F.col("bad"), "fail").otherwise("partial").alias("status"))


def roadmap(findings: DataFrame) -> DataFrame:
    """Findings by effort, in order of severity."""
    rank = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in RANKS.items()], F.lit(9))
    return findings.groupBy("effort").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "rule_id"))), lambda x: x["rule_id"]), ",").alias("rules"))


#: Frameworks, effort by kind of fix.
FRAMEWORKS = ["gdpr", "ccpa", "hipaa", "soc2"]
FIX_EFFORT = {"remove-code": "low", "replace-pattern": "low", "config-change": "low", "add-constraint": "low", "add-index": "low", "add-docs": "medium", "add-test": "medium", "extract-function": "medium", "refactor": "high"}


def frameworks(names: str | None) -> list[str]:
    """The known ones of a comma-joined list; all of them without a list or without a known name."""
    asked = [n.strip().lower() for n in (names or "").split(",")]
    return [f for f in FRAMEWORKS if f in asked] or FRAMEWORKS


def framework_matrices(findings: DataFrame, controls: dict[str, list[str]], names: str | None = None) -> DataFrame:
    """(framework, control, n, status, rate) of findings (framework, control, severity); rate is the percentage of passed controls.

    Controls are fixed lists and are broadcast; findings are counted before they meet them.
    """
    table = findings.sparkSession.createDataFrame([(f, c) for f in frameworks(names) for c in controls.get(f, [])], "framework string, control string")
    f = findings.groupBy("framework", "control").agg(F.count("*").alias("n"), F.max(F.col("severity").isin("critical", "high")).alias("bad"))
    m = F.broadcast(table).join(f, ["framework", "control"], "left")
    m = m.select("framework", "control", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "pass").when(F.col("bad"), "fail").otherwise("partial").alias("status"))
    good = F.avg(F.when(F.col("status") == "pass", 1.0).otherwise(0.0)).over(Window.partitionBy("framework"))  # at most a few dozen rows
    return m.withColumn("rate", Q.js_round(good * 100).cast("int"))


def action_items(findings: DataFrame) -> DataFrame:
    """Findings with the points to win back and the effort of their kind of fix (medium if unknown)."""
    effort = F.element_at(F.create_map(*[F.lit(x) for kv in FIX_EFFORT.items() for x in kv]), F.col("fix_type"))
    return findings.select("*", F.col("deduction").alias("points"), F.coalesce(effort, F.lit("medium")).alias("effort"))


def in_pattern(line, at) -> F.Column:
    """A match at 0-based column ``at`` of a line stands in a regex literal, or the line builds a pattern."""
    slashes = F.regexp_count(F.substring(line, F.lit(1), at), F.lit(r"(?<!\\)/"))
    return (slashes % 2 == 1) | line.rlike(r"(?i)new\s+RegExp\s*\(|(?:pattern|regex)\s*[:=]\s*/")


def action_bucket(severity) -> F.Column:
    return F.when(severity == "critical", "quickWins").when(severity == "major", "structural").otherwise("backlog")


def meets(severity, threshold: str) -> F.Column:
    """At least as severe as the threshold."""
    return F.coalesce(*[F.when(severity == k, v) for k, v in RANKS.items()], F.lit(9)) <= RANKS[threshold]


def ignored(df: DataFrame, path: str, globs: list[str]) -> DataFrame:
    """Rows whose path matches no ignore glob. Globs are parameters and become one pattern."""
    if not globs:
        return df
    return df.where(~F.col(path).rlike("|".join(f"(?:{Q.glob_to_regex(g)})" for g in globs)))


def parse_ignore(text: str) -> list[tuple[str, list[str]]]:
    """(glob, rule ids; empty: every rule) of an ignore file."""
    import re

    out = []
    for line in (x.strip() for x in text.split("\n")):
        if line and not line.startswith("#"):
            m = re.fullmatch(r"(\S+)\s+([A-Z]+(?:-[A-Z]+)*-\d+(?:\s*,\s*[A-Z]+(?:-[A-Z]+)*-\d+)*)", line)
            out.append((m[1], [r.strip() for r in m[2].split(",")]) if m else (line, []))
    return out


def suppressed(findings: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Findings that no (glob, rule ids; empty: every rule) of an ignore file takes back. A finding without a path stays."""
    for glob, ids in rules:
        hit = F.coalesce(F.col("path").rlike(Q.glob_to_regex(glob)), F.lit(False))
        findings = findings.where(~(hit & F.col("rule_id").isin(ids)) if ids else ~hit)
    return findings


def line_suppressed(findings: DataFrame, files: DataFrame, marker: str) -> DataFrame:
    """Findings (path, line) but those whose previous line holds the marker; one join by path."""
    marks = files.select("path", F.posexplode(F.split("content", "\n"))).where(F.col("col").contains(marker)).select("path", (F.col("pos") + 2).alias("line"))
    return findings.join(marks, ["path", "line"], "left_anti").select(findings.columns)


def attack_surface(files: DataFrame, content: str = "content") -> DataFrame:
    t = F.coalesce(F.col(content), F.lit(""))
    n = lambda p: F.sum(F.regexp_count(t, F.lit(p)))
    some = lambda p: F.max(t.rlike(p))
    routes = n(r"(?i)(?:app|router)\.(get|post|put|patch|delete)\s*\(")
    return files.agg(
        routes.alias("endpoints"),
        F.when(some("(?i)(?:auth|authenticate|authorize|requireAuth|protect|guard|jwt)"), F.floor(routes * 0.7 + 0.5)).otherwise(0).alias("authenticated"),
        F.when(some("(?i)(?:rate.?limit|throttle)"), routes).otherwise(0).alias("rate_limited"),
        n(r"(?i)(?:req\.body|req\.query|req\.params|req\.files|formData)").alias("inputs"),
    )
