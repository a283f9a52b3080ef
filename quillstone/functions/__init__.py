"""Scalar functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: State thresholds, recency boost, critical floor.
ACTIVE, READY, BOOST, BOOST_MS, CRITICAL_FLOOR = 0.7, 0.3, 1.3, 30 * 60 * 1000, 0.9
#: Critical-event patterns (custom ones are added by the caller, case-sensitively).
CRITICAL = [
    r"(?i)\b(error|exception|failure|fatal|critical|panic)\b",
    r"\b(TypeError|ReferenceError|SyntaxError|RangeError|URIError)\b",
    r"\bENOENT|EACCES|ECONNREFUSED|ETIMEDOUT\b",
    r"(?m)^\s+at\s+.*\(.*:\d+:\d+\)",
    r"(?m)^\s+at\s+.*\.[a-zA-Z]+:\d+",
    r"(?m)^new file mode \d+$",
    r"(?m)^--- /dev/null$",
    r"(?m)^<<<<<<< ",
    r"(?m)^=======",
    r"(?m)^>>>>>>> ",
]
#: Lower bounds of the grades of analyses and of audits.
GRADES = [(95, "S"), (90, "A+++"), (85, "A++"), (80, "A+"), (75, "A"), (65, "B"), (55, "B-"), (40, "C"), (20, "D"), (0, "Zero")]
AUDIT_GRADES = [(96, "S"), (92, "A+++"), (88, "A++"), (84, "A+"), (80, "A"), (75, "A-"), (70, "B+"), (60, "B"), (50, "B-"), (35, "C"), (15, "D"), (0, "Zero")]


def tokens(text: Column) -> Column:
    """Lower-cased whitespace terms; empty array for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")


def token_estimate(text: Column) -> Column:
    """max(ceil(0.75 words), ceil(chars / 4)); 0 for null and empty."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))
    return F.greatest(F.ceil(words * 0.75), F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def fingerprint(rule: Column, path: Column, title: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("::", rule, F.coalesce(path, F.lit("")), title), 256), 1, 16)


def decay(age_ms: Column, ttl_s: Column) -> Column:
    """1 - e^(-age/ttl), within [0, 1]."""
    return F.when(ttl_s == 0, 1.0).when(age_ms <= 0, 0.0).otherwise(F.least(F.lit(1.0), 1 - F.exp(-age_ms / (ttl_s * 1000))))


def engram_score(base: Column, age_ms: Column, ttl_s: Column, access: Column, critical: Column) -> Column:
    s = base * (1 - decay(age_ms, ttl_s))
    s = F.when(access > 0, F.least(F.lit(1.0), s + 0.1 * F.log(access + 1.0))).otherwise(s)
    s = F.when(critical, F.greatest(s, F.lit(CRITICAL_FLOOR))).otherwise(s)
    fresh = ~critical & (age_ms >= 0) & (age_ms < BOOST_MS)
    s = F.when(fresh, s * (1 + (BOOST - 1) * (1 - age_ms / BOOST_MS))).otherwise(s)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def state(score: Column, critical: Column) -> Column:
    return F.when(critical | (score >= ACTIVE), "active").when(score >= READY, "ready").otherwise("silent")


def state_multiplier(state_: Column, critical: Column) -> Column:
    return F.when(critical | (state_ == "active"), 2.0).when(state_ == "ready", 1.0).otherwise(0.5)


def is_critical(text: Column, custom: list[str] | None = None) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(text, F.lit("")).rlike(p) for p in [*CRITICAL, *(custom or [])]])


def grade(score: Column, table: list[tuple[int, str]] = GRADES) -> Column:
    out = F.lit(table[-1][1])
    for low, name in reversed(table[:-1]):
        out = F.when(score >= low, name).otherwise(out)
    return out


def layer_grade(score: Column, weight: Column) -> Column:
    return F.when(weight == 0, "S").otherwise(grade(score / weight * 100, AUDIT_GRADES))


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def plan_id(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^a-zA-Z0-9_-]", "")


def short_number(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("K"))).otherwise(n.cast("string"))


def adaptive_threshold(tool: Column, total: Column) -> Column:
    """Compression threshold of a tool, tightened by what the session has used."""
    base = F.create_map(*[F.lit(x) for kv in (("Bash", 2000), ("Read", 2500), ("Grep", 2000), ("Glob", 1500), ("WebFetch", 1500), ("WebSearch", 1000)) for x in kv])
    share = F.when(total > 500_000, 0.33).when(total > 300_000, 0.5).when(total > 100_000, 0.75).otherwise(1.0)
    return F.greatest(F.lit(500), F.floor(F.coalesce(base[tool], F.lit(3000)) * share)).cast("long")


def glob_to_regex(glob: str) -> str:
    """Anchored regex of a path glob: ** crosses separators, * and ? don't."""
    out, i = "", 0
    special = {"**/": "(?:[^/]+/)*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    while i < len(glob):
        key = next((k for k in special if glob.startswith(k, i)), None)
        out += special[key] if key else ("\\" + glob[i] if glob[i] in r".+^${}()|[]\\" else glob[i])
        i += len(key or " ")
    return f"^{out}$"
