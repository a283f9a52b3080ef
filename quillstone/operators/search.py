"""Line index, BM25 ranking, regex search and their fusion."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

K1, B = 1.2, 0.75
#: What separates terms.
SEPARATORS = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda t: t != "")


def query_terms(q: str) -> list[str]:
    """Operators are stripped; an empty list for a blank query."""
    return [t for t in re.split(r"[^\w]+", re.sub(r"[{}()\[\]\"':*^~]", " ", q).lower()) if t]


#: The suffix tables of Porter's algorithm (1980), longest suffix first where it matters.
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _shape(w: str) -> str:
    """Vowels and consonants of a word; y is a vowel after a consonant."""
    out = ""
    for c in w:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _short_end(w: str) -> bool:
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


@lru_cache(maxsize=100_000)
def porter(w: str) -> str:
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (cut := _longest(w, ("ed", "ing"))) and "v" in _shape(w[: -len(cut)]):
        w = w[: -len(cut)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short_end(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (STEP2, STEP3):
        cut = _longest(w, table)
        if cut and _measure(w[: -len(cut)]) > 0:
            w = w[: -len(cut)] + table[cut]
    cut = _longest(w, STEP4)
    if cut and _measure(w[: -len(cut)]) > 1 and (cut != "ion" or w[: -len(cut)].endswith(("s", "t"))):
        w = w[: -len(cut)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short_end(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@F.pandas_udf(ArrayType(StringType()))  # a type object: workers import this module without a session
def stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [porter(w) for w in ws])


def weight(n: Column, df: Column, tf: Column, length: Column, mean: Column) -> Column:
    """One term's part of a row's BM25."""
    return F.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def bm25(docs: DataFrame, text: str, q: str, *keys: str, limit: int | None = 10, stem: bool = False) -> DataFrame:
    """(keys..., rank) of the rows holding every term; larger is better. Nothing is exploded: terms are counted in
    their row. With ``stem``, words of one Porter stem are one term; only words that begin like a wanted stem leave
    the JVM to be stemmed."""
    want = sorted({porter(w) if stem else w for w in query_terms(q)})
    x = docs.select(*keys, terms(F.col(text)).alias("_t"))
    if stem and want:
        x = x.withColumn("_s", stems(F.filter("_t", lambda t: t.rlike("^(?:" + "|".join(re.escape(w[: max(1, len(w) - 2)]) for w in want) + ")"))))
        counts = [(F.size("_s") - F.size(F.array_remove("_s", w))).alias(f"_c{i}") for i, w in enumerate(want)]
    else:
        counts = [(F.size("_t") - F.size(F.array_remove("_t", w))).alias(f"_c{i}") for i, w in enumerate(want)]
    x = x.select(*keys, F.size("_t").alias("_n"), *counts)
    stats = x.agg(F.count("*").alias("N"), F.avg("_n").alias("avg"), *[F.count_if(F.col(f"_c{i}") > 0).alias(f"_d{i}") for i in range(len(want))])
    if not want:
        return x.limit(0).select(*keys, F.lit(0.0).alias("rank"))
    y = x.crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(want)):
        y = y.where(F.col(f"_c{i}") > 0)
        score = score + weight(F.col("N"), F.col(f"_d{i}"), F.col(f"_c{i}"), F.col("_n"), F.col("avg"))
    out = y.select(*keys, F.round(score, 6).alias("rank"))
    return out.orderBy(F.desc("rank"), *keys).limit(limit) if limit else out


def grep(lines: DataFrame, pattern: str, per_file: int) -> DataFrame:
    w = Window.partitionBy("path").orderBy("line")
    return lines.where(F.col("content").rlike(pattern)).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_file).drop("_r")


def search(lines: DataFrame, q: str, limit: int = 10, parity: bool = False) -> DataFrame:
    """Ranked hits united with plain matches (0.8); a line counts once. The score clamps 1 + rank / 10, where a better
    hit has a lower rank; by default hits are ordered by rank, with ``parity`` by that score."""
    hits = bm25(lines, "content", q, "path", "line", "content", limit=2 * limit).select("path", "line", "content", F.lit(0).alias("src"), "rank", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("rank") / 10)).alias("score"))
    plain = grep(lines, re.escape(q), limit).orderBy("path", "line").limit(limit).select("path", "line", "content", F.lit(1).alias("src"), F.lit(0.0).alias("rank"), F.lit(0.8).alias("score"))
    w = Window.partitionBy("path", "line").orderBy("src")
    out = hits.unionByName(plain).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    order = [F.desc("score")] if parity else ["src", F.desc("rank")]
    return out.orderBy(*order, "path", "line").limit(limit)


def context(lines: DataFrame, hits: DataFrame, around: int = 2) -> DataFrame:
    """Lines within ``around`` of a hit of the same path: an equi-join on path and one key per offset, no range join."""
    want = hits.select("path", F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line")).distinct()
    return lines.join(want, ["path", "line"], "left_semi")


def stale(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Files that are new or changed since they were indexed."""
    return files.join(meta.select("path", F.col("mtime").alias("_m")), "path", "left").where(F.col("_m").isNull() | (F.col("_m") < F.col("mtime"))).drop("_m")
