"""Entry store with unique id and unique content hash, kept as immutable files and merged on read.

Rows lie in buckets by hash of id; each commit adds one folder with the rows (and tombstones) of the buckets it touches, and the
newest commit's row of an id wins. A second small table, in buckets by content hash, tells which id a content belongs to,
so that a new entry of known content replaces the old entry wherever that lies. Point lookups read one bucket, an upsert reads
the buckets of its own ids and contents, and a bucket of many folders is rewritten by ``compact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstone.operators.store import materialize
from quillstone.operators.versions import Versions

BUCKETS, MOST_FOLDERS = 64, 8


class EntryStore:
    """Entries with the columns ``id`` and ``hash`` (not null) and any others, the same in every call."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.versions = spark, Versions(spark, root)
        self.buckets = int(self.versions.read()[1].get("buckets", buckets))

    def _bucket(self, of: str) -> Column:
        return F.pmod(F.xxhash64(F.col(of).cast("string")), F.lit(self.buckets)).cast("int")

    def _folders(self, manifest: dict, kind: str, buckets: set[int] | None) -> list[str]:
        return [f"{path}/_b={b}" for b, paths in manifest.get(kind, {}).items() if buckets is None or int(b) in buckets for path in paths]

    def _all_rows(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        folders = self._folders(manifest, "rows", buckets)
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*folders) if folders else None

    def _live(self, rows: DataFrame) -> DataFrame:
        """The newest row of each id, without tombstones."""
        newest = Window.partitionBy("id").orderBy(F.desc("_v"))
        return rows.withColumn("_r", F.row_number().over(newest)).where("_r = 1 and not _gone").drop("_r", "_gone", "_v")

    def table(self, version: int | None = None) -> DataFrame | None:
        """All entries of a version; None before the first entry."""
        rows = self._all_rows(self.versions.read(version)[1])
        return None if rows is None else self._live(rows)

    def get(self, *ids) -> DataFrame | None:
        """The entries of a few ids: only their buckets are read."""
        manifest = self.versions.read()[1]
        one = self.spark.createDataFrame([(str(i),) for i in ids], "id string").select(self._bucket("id")).distinct()
        rows = self._all_rows(manifest, {r[0] for r in one.collect()})
        return None if rows is None else self._live(rows.where(F.col("id").isin(*ids)))

    def put(self, rows: DataFrame, seq: str | None = None) -> int:
        """Insert or replace. A row replaces the entry of its id and the entry of its content; of rows that collide with each other
        the one of the largest ``seq`` stays. The version that holds them."""
        once = rows
        for key in ("id", "hash"):
            order = [F.desc(seq)] if seq else []
            w = Window.partitionBy(key).orderBy(*order, "id", "hash")
            once = once.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
        once = materialize(once.drop(seq) if seq and seq not in ("id", "hash") else once)
        return self._add(once)

    def delete(self, ids: DataFrame) -> int:
        """Entries of the ids go; unknown ids are passed over. The version without them."""
        return self._add(None, materialize(ids.select("id").distinct()))

    def _numbers(self, df: DataFrame, of: str) -> set[int]:
        return {r[0] for r in df.select(self._bucket(of).alias("b")).distinct().collect()}  # at most one for each bucket

    def _add(self, new: DataFrame | None, doomed: DataFrame | None = None) -> int:
        def make(number: int, manifest: dict) -> dict | None:
            gone = doomed
            old = None
            if new is not None and manifest:
                # ids that hold the same contents, by the table of contents; an entry of it may be out of date
                folders = self._folders(manifest, "contents", self._numbers(new, "hash"))
                if folders:
                    known = self.spark.read.schema(StructType.fromJson(manifest["content_schema"])).parquet(*folders)
                    gone = known.join(new.select("hash", F.col("id").alias("_new")), "hash").where("id <> _new").select("id", "hash").distinct()
                    gone = materialize(gone)
            if gone is not None and manifest:
                old = self._all_rows(manifest, self._numbers(gone, "id"))
            parts = []
            if old is not None:
                on = ["id", "hash"] if new is not None else ["id"]
                dead = self._live(old).join(gone.select(*on), on, "left_semi")
                dead = dead.join(new.select("id"), "id", "left_anti") if new is not None else dead
                parts.append(dead.withColumn("_gone", F.lit(True)))
            if new is not None:
                parts.append(new.withColumn("_gone", F.lit(False)))
            if not parts:
                return None
            rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
            rows = materialize(rows.withColumn("_v", F.lit(number).cast("long")).withColumn("_b", self._bucket("id")))
            touched = sorted(r[0] for r in rows.select("_b").distinct().collect())
            if not touched:
                return None
            path = self.versions.write(rows.repartition("_b").sortWithinPartitions("_b", "id"), "_b")
            out = {"buckets": self.buckets, "rows": dict(manifest.get("rows", {})), "contents": dict(manifest.get("contents", {}))}
            out["schema"] = rows.drop("_b").schema.jsonValue()
            out["content_schema"] = manifest.get("content_schema")
            out["rows"] |= {str(b): [*out["rows"].get(str(b), []), path] for b in touched}
            if new is not None:
                pairs = new.select("hash", "id").withColumn("_b", self._bucket("hash"))
                at = self.versions.write(pairs.repartition("_b"), "_b")
                out["contents"] |= {str(b): [*out["contents"].get(str(b), []), at] for b in sorted(self._numbers(new, "hash"))}
                out["content_schema"] = pairs.drop("_b").schema.jsonValue()
            return out

        return self.versions.change(make)

    def compact(self, most: int = MOST_FOLDERS) -> int:
        """Buckets of more than ``most`` folders become one folder of live rows each; others stay as they are."""

        def make(number: int, manifest: dict) -> dict | None:
            full = {int(b) for b, p in manifest.get("rows", {}).items() if len(p) > most}
            if not full:
                return None
            out = manifest | {"rows": dict(manifest["rows"]), "contents": dict(manifest["contents"])}
            rows = self._all_rows(manifest, full)
            live = self._live(rows).withColumns({"_gone": F.lit(False), "_v": F.lit(number).cast("long"), "_b": self._bucket("id")})
            path = self.versions.write(live.repartition("_b").sortWithinPartitions("_b", "id"), "_b")
            left = {r[0] for r in self.spark.read.parquet(path).select("_b").distinct().collect()}
            out["rows"] |= {str(b): [path] if b in left else [] for b in full}
            crowded = {int(b) for b, p in manifest["contents"].items() if len(p) > most}
            if crowded:
                known = self.spark.read.schema(StructType.fromJson(manifest["content_schema"])).parquet(*self._folders(manifest, "contents", crowded))
                at = self.versions.write(known.distinct().withColumn("_b", self._bucket("hash")).repartition("_b"), "_b")
                out["contents"] |= {str(b): [at] for b in crowded}
            return out

        return self.versions.change(make)

    def vacuum(self, keep: int = 2) -> int:
        return self.versions.vacuum(lambda m: {p for kind in ("rows", "contents") for paths in m.get(kind, {}).values() for p in paths}, keep)
