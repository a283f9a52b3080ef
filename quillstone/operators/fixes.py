"""Safe fixes as edits of spans: found, previewed and deduplicated by rule and file, conflicts settled by interval order, applied in one pass.

An edit is (start, end, text) in characters, end exclusive. All edits of a file come from its own row, so nothing is shuffled: places
follow from the pieces between matches. Of edits that overlap the one that starts first is applied, then the one of the rule named first;
the others are counted as conflicts and come up again when the fixes run on the result. Sources are never changed; the fixed
text is returned.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Fix(NamedTuple):
    rule: str
    pattern: str
    #: What a match becomes; empty removes it.
    text: str
    #: Description with the number of edits in place of {}.
    says: str


def whole_lines(body: str) -> str:
    """A pattern of whole lines that ``body`` matches, with the newline that goes with them."""
    line = rf"[^\S\n]*(?:{body})[^\S\n]*"
    return rf"\n(?:{line}\n)*{line}\z|(?<![^\n]){line}\n|\A{line}\z"


#: Safe fixes of the analysis.
FIXES = [
    Fix("QUAL-009", whole_lines(r"console\.(?:log|debug|warn|info)[^\S\n]*\(.*\);?|debugger;?"), "", "Remove {} debug statement(s)"),
    Fix("SEC-003", r"createHash\s*\(\s*['\"](?:md5|sha1)['\"]\s*\)", "createHash('sha256')", "Replace weak crypto in {} place(s)"),
    Fix("QUAL-004", whole_lines(r"//[^\S\n]*@ts-(?:ignore|nocheck)"), "", "Remove {} @ts-ignore/@ts-nocheck comment(s)"),
    Fix("SEC-004", r"(origin\s*:\s*)['\"]?\*['\"]?", "$1'https://your-domain.com'", "Replace CORS wildcard * with placeholder in {} place(s)"),
]
EDITS = "array<struct<start:int,end:int,text:string>>"


def edits_of(text: Column, fix: Fix) -> Column:
    """All edits of one fix in a text, in order."""
    found, between = F.regexp_extract_all(text, F.lit(fix.pattern), F.lit(0)), F.split(text, fix.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(EDITS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["piece"])
        end = begin + F.length(x["match"])
        text_ = F.regexp_replace(x["match"], fix.pattern, fix.text) if fix.text else F.lit("")
        one = F.array(F.struct(begin.alias("start"), end.alias("end"), text_.alias("text")))
        return F.struct(end.alias("at"), F.concat(F.coalesce(acc["out"], F.array().cast(EDITS)), one).cast(EDITS).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match")))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda acc: acc["out"]))


def fix_actions(files: DataFrame, findings: DataFrame | None = None, fixes: list[Fix] | None = None) -> DataFrame:
    """(rule_id, path, description, preview, edits): one action for each rule and file that a fix changes. With ``findings`` (rule_id,
    path) only those they name, however often; a preview line is ``L<line>: <what is there>``."""
    text = F.coalesce("content", F.lit(""))
    each = [F.struct(F.lit(f.rule).alias("rule_id"), F.lit(f.says).alias("says"), edits_of(text, f).alias("edits")) for f in fixes or FIXES]
    x = files.select("path", text.alias("content"), F.explode(F.array(*each)).alias("f")).select("path", "content", "f.*").where("edits is not null")
    place = lambda e: F.substring(F.col("content"), e["start"] + 1, e["end"] - e["start"])
    # a match may begin with the newline before its line
    first = lambda e: F.length(F.regexp_replace(F.substring(F.col("content"), F.lit(1), e["start"]), r"[^\n]", "")) + F.when(place(e).startswith("\n"), 2).otherwise(1)
    preview = F.transform("edits", lambda e: F.concat(F.lit("L"), first(e).cast("string"), F.lit(": "), F.trim(F.regexp_replace(place(e), r"^\s+|\s+$", ""))))
    out = x.select("rule_id", "path", F.replace(F.col("says"), F.lit("{}"), F.size("edits").cast("string")).alias("description"), preview.alias("preview"), "edits")
    if findings is not None:
        out = out.join(findings.select("rule_id", "path").dropDuplicates(), ["rule_id", "path"], "left_semi")
    return out


def settle(edits: Column) -> Column:
    """Of edits (start, rank, end, text) those that apply: in order, each that begins after the last one taken. A removal that overlaps
    a removal is shortened to what is left of it."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("cut"), F.array().cast(EDITS).alias("kept"))

    def step(acc: Column, e: Column) -> Column:
        cut = e["text"] == ""
        free = (e["start"] >= acc["at"]) | (cut & acc["cut"] & (e["end"] > acc["at"]))
        one = F.array(F.struct(F.greatest(e["start"], acc["at"]).alias("start"), e["end"].alias("end"), e["text"].alias("text")))
        return F.struct(F.when(free, e["end"]).otherwise(acc["at"]).alias("at"), F.when(free, cut).otherwise(acc["cut"]).alias("cut"), F.when(free, F.concat(acc["kept"], one).cast(EDITS)).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(edits, start, step, lambda acc: acc["kept"])


def edited(text: Column, edits: Column) -> Column:
    """The text with disjoint edits in order put in."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        return F.struct(e["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["text"])).alias("out"))

    return F.aggregate(edits, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), ""))


def apply_actions(files: DataFrame, actions: DataFrame, fixes: list[Fix] | None = None) -> DataFrame:
    """(path, content, applied, conflicts) of the files that the actions change; a file has at most one action a rule."""
    order = F.create_map(*[F.lit(x) for i, f in enumerate(fixes or FIXES) for x in (f.rule, i)])
    ranked = F.transform("edits", lambda e: F.struct(e["start"].alias("start"), F.coalesce(order[F.col("rule_id")], F.lit(99)).alias("rank"), e["end"].alias("end"), e["text"].alias("text")))
    per_file = actions.dropDuplicates(["rule_id", "path"]).select("path", ranked.alias("e")).groupBy("path").agg(F.array_sort(F.flatten(F.collect_list("e"))).alias("all"))
    x = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(per_file, "path").withColumn("kept", settle(F.col("all")))
    return x.select("path", edited(F.col("content"), F.col("kept")).alias("content"), F.size("kept").alias("applied"), (F.size("all") - F.size("kept")).alias("conflicts"))
