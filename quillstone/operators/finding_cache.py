"""Findings kept by content: a file is evaluated again only if its text, its path or the rule set changed.

A file's key is the digest of its path and content (rules choose files by path), a rule set's the digest of all its fields. What was
evaluated and what was found are immutable folders named by a versioned manifest, so two runs may add to one cache.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import rules
from quillstone.operators.store import materialize
from quillstone.operators.versions import Versions

#: Folders of one rule set that are read before they become one.
MOST_FOLDERS = 16


class FindingCache:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.versions = spark, Versions(spark, root)
        #: Files that the last run had to evaluate.
        self.evaluated = 0

    @staticmethod
    def rule_set(todo: list[rules.Rule]) -> str:
        return hashlib.sha256(repr([tuple(r) for r in todo]).encode()).hexdigest()[:16]

    def _read(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*paths) if paths else None

    def findings(self, files: DataFrame, todo: list[rules.Rule]) -> DataFrame:
        """``rules.evaluate(files, todo)``, from the cache where it can be."""
        name = self.rule_set(todo)
        key = F.sha2(F.concat_ws("\u0000", "path", F.coalesce("content", F.lit(""))), 256)
        keyed = files.select("path", "content", key.alias("_key"))

        def make(number: int, manifest: dict) -> dict | None:
            mine = manifest.get(name, {"seen": [], "found": []})
            seen = self._read(mine["seen"])
            missing = keyed if seen is None else keyed.join(seen, "_key", "left_anti")
            missing = materialize(missing.dropDuplicates(["_key"]))
            self.evaluated = missing.count()
            if not self.evaluated:
                return None
            found = rules.evaluate(missing, todo).join(missing.select("path", "_key"), "path").drop("path")
            seen_at, found_at = [*mine["seen"], self.versions.write(missing.select("_key"))], [*mine["found"], self.versions.write(found)]
            if len(seen_at) > MOST_FOLDERS:
                seen_at, found_at = [self.versions.write(self._read(seen_at))], [self.versions.write(self._read(found_at))]
            return manifest | {name: {"seen": seen_at, "found": found_at}}

        self.versions.change(make)
        found = self._read(self.versions.read()[1].get(name, {"found": []})["found"])
        if found is None:  # no files at all
            return rules.evaluate(files, todo)
        return keyed.select("path", "_key").join(found, "_key").drop("_key").select("path", "rule_id", "layer", "severity", "hits", "line", "deduction", "title")

    def forget(self, todo: list[rules.Rule]) -> None:
        """Drop what is kept for a rule set; ``vacuum`` of the versions deletes its files."""
        name = self.rule_set(todo)
        self.versions.change(lambda number, manifest: {k: v for k, v in manifest.items() if k != name} if name in manifest else None)
