"""Summaries of tool outputs as column expressions over lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def histogram(values: Column, k: int) -> Column:
    """The k most frequent values of an array as value:count, ties by value."""
    d = F.array_distinct(values)
    counted = F.transform(d, lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("n"), v.alias("v")))
    return F.transform(F.slice(F.array_sort(counted), 1, k), lambda s: F.concat(s["v"], F.lit(":"), -s["n"]))


def shell_kind(text: Column) -> Column:
    """Which summary applies; the first that matches and yields something."""
    ls = lines_of(text)
    return (
        F.when(text.rlike(r"(?i)\d+ (pass|fail|skip)|Tests?:") & F.exists(ls, lambda x: x.rlike(r"(?i)pass|fail|skip|error|Tests?:|Test Suites?:")), "tests")
        .when(text.rlike(r"TS\d{4,5}:"), "typescript")
        .when(text.rlike(r"(?i)eslint|biome") & text.rlike(r"[a-z]+/[a-zA-Z-]+|no-[a-z-]+"), "lint")
        .when(text.rlike(r"(?i)(added|removed|changed|audited) \d+ packages?"), "packages")
        .when(text.rlike(r"(?i)error(\[| TS|:)|FAILED"), "build")
        .when(text.rlike(r"(?m)^diff --git|^@@ "), "diff")
        .when(text.rlike(r"(?m)^commit [0-9a-f]{40}|^[0-9a-f]{7,40} "), "log")
        .when(text.rlike(r"(?m)^On branch |^\s*(modified|new file|deleted):"), "status")
        .when(F.trim(text).rlike(r"^[\[{]") & (F.length(text) > 1000), "json")
        .otherwise("head_tail")
    )


def head_tail(text: Column, head: int = 15, tail: int = 10) -> Column:
    ls = lines_of(text)
    n = F.size(ls)
    cut = F.concat(F.slice(ls, 1, head), F.array(F.concat(F.lit("... "), n - head - tail, F.lit(" lines omitted"))), F.slice(ls, -tail, tail))
    return F.when(n <= head + tail, text).otherwise(F.array_join(cut, "\n"))


def typescript_errors(text: Column) -> Column:
    return histogram(F.transform(F.regexp_extract_all(text, F.lit(r"TS(\d{4,5}):"), F.lit(1)), lambda c: F.concat(F.lit("TS"), c)), 5)


def lint_rules(text: Column) -> Column:
    return histogram(F.regexp_extract_all(text, F.lit(r"\b([a-z]+/[a-zA-Z-]+)\b"), F.lit(1)), 5)


def shell_summary(text: Column, command: Column) -> Column:
    """One line or a short list for a command's output: the first kind that applies. Null text counts as empty."""
    text, command = F.coalesce(text, F.lit("")), F.coalesce(command, F.lit(""))
    ls = lines_of(text)
    n = F.size(ls)
    those = lambda p: F.filter(ls, lambda x: x.rlike(p))
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    tests, codes = those(r"(?i)pass|fail|skip|error|Tests?:|Test Suites?:"), F.regexp_extract_all(text, F.lit(r"TS(\d{4,5}):"), F.lit(1))
    rules = F.filter(F.transform(ls, lambda x: F.regexp_extract(x, r"\s([a-z][\w/.-]+)\s*$", 1)), lambda x: x.contains("/"))
    packages = [say(found(p), f" {word}") for p, word in ((r"(?i)added\s+(\d+)\s+packages?", "added"), (r"(?i)removed\s+(\d+)\s+packages?", "removed"), (r"(?i)changed\s+(\d+)\s+packages?", "changed"), (r"(?i)(\d+)\s+vulnerabilit", "vulnerabilities"))]
    moved = F.filter(F.array(*packages), lambda x: x.isNotNull())
    broken = those(r"(?i)error|warning|failed|fatal")
    diff = F.regexp_extract_all(text, F.lit(r"(?m)^diff --git a/.*? b/(.*)$"), F.lit(1))
    commits = F.regexp_count(text, F.lit(r"(?m)^commit [0-9a-f]{40}"))
    message = F.get(F.filter(ls, lambda x: x.rlike(r"\S") & ~x.rlike("^(commit |Author:|Date:|Merge:)")), F.lit(0))
    changed, staged = those(r"(?i)^\s*(modified|renamed|deleted):"), those(r"(?i)^\s*(new file|modified|deleted):")
    names = F.transform(F.slice(F.concat(changed, staged), 1, 15), lambda x: F.regexp_replace(x, r"(?i)^\s*(modified|renamed|deleted|new file):\s*|\s+$", ""))
    kinds = F.transform(F.filter(F.transform(ls, F.trim), lambda x: x != ""), lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^.+(\.[^.]*)$", 1), F.lit("")), F.lit("(no ext)")))
    listing = lambda values, k: F.array_join(histogram(values, k), ", ")
    errors = F.size(those(r"(?i)error|exception|fail"))
    return F.coalesce(
        F.when(text.rlike(r"(?i)\d+ (pass|fail|skip)|Tests?:") & (F.size(tests) > 0), say("Test output (", n, " lines):\n", F.array_join(F.slice(tests, 1, 15), "\n"))),
        F.when(F.size(codes) > 0, say("TypeScript: ", F.size(codes), " errors, ", F.size(F.array_distinct(codes)), " codes: ", listing(F.transform(codes, lambda c: F.concat(F.lit("TS"), c)), 5))),
        F.when((text.rlike(r"(?i)\d+ (problem|error|warning|issue)") | command.rlike("(?i)lint")) & (F.size(rules) > 0), say("Lint: ", n, " lines, ", F.size(F.array_distinct(rules)), " rules: ", listing(rules, 5))),
        F.when(text.rlike(r"(?i)npm\s+(warn|info|notice)|added\s+\d+\s+packages") & (F.size(moved) > 0), say("Packages: ", F.array_join(moved, ", "))),
        F.when((F.size(broken) > 0) & ~command.rlike(r"(?i)git log|git status|ls\s"), say("Build output (", F.size(broken), " of ", n, " lines):\n", F.array_join(F.slice(broken, 1, 10), "\n"))),
        F.when(F.size(diff) > 0, say("Diff: ", F.size(diff), " files: ", F.array_join(diff, ", "))),
        F.when(commits > 0, say("Log: ", commits, " commits. Latest: ", F.substring(F.regexp_replace(F.coalesce(message, F.lit("")), r"^\s+|\s+$", ""), 1, 100))),
        F.when(command.rlike(r"(?i)git\s+status"), say("Status: ", F.size(changed), " modified, ", F.size(staged), " staged, ", F.size(those(r"^\t\S")), " untracked. Files: ", F.array_join(names, ", "))),
        F.when(command.rlike(r"(?i)\b(ls|find)\b"), say("Listing: ", n, " lines. By extension: ", listing(kinds, 8))),
        F.when(F.trim(text).rlike(r"^\{") & (F.length(text) > 1000), say("JSON object: ", F.array_join(F.slice(F.json_object_keys(text), 1, 10), ", "))),
        F.when(F.trim(text).rlike(r"^\[") & (F.length(text) > 1000), say("JSON array: ", F.json_array_length(text), " items")),
        say("Output of ", n, " lines", F.when(errors > 0, say(", ", errors, " with errors")).otherwise(""), ". First: ", F.array_join(F.slice(ls, 1, 3), " | "), F.when(n > 6, say(" ... last: ", F.array_join(F.slice(ls, -2, 2), " | "))).otherwise("")),
    )


def headings(text: Column, k: int = 8) -> Column:
    return F.slice(F.filter(lines_of(text), lambda x: x.rlike("^#{1,3} ")), 1, k)


def markdown_links(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\[[^\]]*\]\([^)]+\)"))


def code_blocks(text: Column) -> Column:
    return F.floor(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("```")) / 2)


def json_keys(text: Column, k: int = 20) -> Column:
    return F.slice(F.json_object_keys(text), 1, k)


def yaml_keys(text: Column, k: int = 20) -> Column:
    return F.slice(F.filter(F.transform(lines_of(text), lambda x: F.regexp_extract(x, r"^([A-Za-z_][\w-]*):", 1)), lambda x: x != ""), 1, k)


def code_symbols(text: Column, k: int = 20) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(r"(?:function|class|interface|type|enum|const)\s+(\w+)"), F.lit(1)), 1, k)


def search_summary(text: Column) -> Column:
    """struct(matches, files, top): path:line:text rows."""
    paths = F.filter(F.transform(lines_of(text), lambda x: F.regexp_extract(x, r"^([^:]+):\d+", 1)), lambda x: x != "")
    return F.struct(F.size(paths).alias("matches"), F.size(F.array_distinct(paths)).alias("files"), F.slice(F.array_distinct(paths), 1, 5).alias("top"))


def glob_summary(text: Column) -> Column:
    paths = F.filter(lines_of(text), lambda x: F.trim(x) != "")
    dirs = F.transform(paths, lambda p: F.when(p.contains("/"), F.regexp_replace(p, "/[^/]*$", "")).otherwise(F.lit(".")))
    return F.struct(F.size(paths).alias("files"), F.size(F.array_distinct(dirs)).alias("dirs"), histogram(dirs, 5).alias("top"))


def search_titles(text: Column, k: int = 5) -> Column:
    title = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"\[([^\]]+)\]\(", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"\*\*([^*]+)\*\*", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^#{1,3} (.+)$", 1), F.lit("")))
    return F.slice(F.filter(F.transform(lines_of(text), title), lambda x: x.isNotNull()), 1, k)


#: Safe fixes as (pattern, replacement).
FIXES = [
    (r"createHash\(\s*(['\"])(?:md5|sha1)\1\s*\)", "createHash($1sha256$1)"),
    (r"(?m)^\s*console\.(?:log|debug|info)\([^\n]*\);?\s*\n", ""),
    (r"(?m)^\s*//\s*@ts-ignore[^\n]*\n", ""),
    (r"(origin\s*:\s*)['\"]\*['\"]", "$1process.env.CORS_ORIGIN"),
]


def apply_fixes(content: Column, fixes: list[tuple[str, str]] | None = None) -> Column:
    """Fixed text; the source is never changed in place."""
    for p, r in fixes or FIXES:
        content = F.regexp_replace(content, p, r)
    return content


#: Safe fixes of the security audit as (pattern, replacement); random ids need the import that is put first.
SECURE_FIXES = [
    (r"createHash\s*\(\s*['\"](?:md5|sha1)['\"]\s*\)", "createHash('sha256')"),
    (r"devtool\s*:\s*['\"]source-map['\"]", "devtool: false"),
]
COOKIE = r"(?i)(cookie\s*:\s*\{(?![^}]*%s)[^}]*)(\})"
COOKIE_FLAGS = [("httpOnly", ", httpOnly: true"), (r"secure\s*:", ", secure: true"), ("sameSite", ", sameSite: 'strict'")]


def apply_secure_fixes(content: Column) -> Column:
    """Weak hashes, random ids, source maps and cookie flags; the fixed text is returned."""
    content = apply_fixes(content, SECURE_FIXES)
    uses, imported = content.rlike(r"Math\.random\s*\(\s*\)"), content.rlike(r"import.*crypto|require.*crypto")
    replaced = F.regexp_replace(content, r"Math\.random\s*\(\s*\)", "randomUUID()")
    content = F.when(uses & ~imported, F.concat(F.lit("import { randomUUID } from 'node:crypto';\n"), replaced)).when(uses, replaced).otherwise(content)
    for flag, more in COOKIE_FLAGS:
        content = F.regexp_replace(content, COOKIE % flag, "$1" + more + "$2")
    return content


def pin_dependencies(manifest: Column) -> Column:
    """A manifest whose version ranges (^ and ~) are exact."""
    return F.regexp_replace(manifest, r'("[^"]+"\s*:\s*")[\^~](\d)', "$1$2")


def complete_gitignore(text: Column, wanted: list[str]) -> Column:
    """The ignore file with each wanted entry that it does not mention."""
    missing = F.filter(F.array(*[F.lit(w) for w in wanted]), lambda w: ~F.coalesce(text, F.lit("")).contains(w))
    return F.when(F.size(missing) == 0, text).otherwise(F.array_join(F.concat(F.filter(F.array(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+$", "")), lambda x: x != ""), missing), "\n"))
