"""Shared plumbing of the training-data operators.

Scratch tables go to the shared folder named by ``spark.checkpoint.dir``; a local one is
set only where that setting is missing and all runs on one machine, as in tests.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and \x09-\x0D. ``bytes.split()`` splits on exactly these.
SPACES = b" \t\n\x0b\x0c\r"
#: ASCII-only lower-casing of UTF-8 bytes.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Rows and bytes of one Arrow batch, so that a Python worker's memory does not follow the partition.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        root = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and reread it: lineage is cut, and a
    lost executor costs nothing that was already written."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no pending plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Give back the shuffle files and broadcasts of finished steps, which otherwise wait for the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text with null as the empty text: all that most operators read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)


#: Groups of one join that may be broadcast, and rows that any group may have without it.
HOT_GROUPS, HOT_ROWS = 500_000, 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row that ``groups`` has for each key and that counts the key's rows in ``size``. Keys of very many
    of the ``total`` rows are looked up where the rows are: being so large they are at most HOT_GROUPS, which bounds the broadcast.
    The others are shuffled."""
    least = max(HOT_ROWS, -(-total // HOT_GROUPS))
    hot = F.broadcast(groups.where(F.col(size) > least).drop(size))
    cold = groups.where(F.col(size) <= least).drop(size)
    keys = F.broadcast(groups.where(F.col(size) > least).select(on))
    return rows.join(hot, on).unionByName(rows.join(keys, on, "left_anti").join(cold.hint("merge"), on, how))


#: Bits of a table of keys, as a power of two; it has a 64th as many rows at most.
KEY_BITS = 26


def key_bits(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """``rows`` with the place of their key, the broadcast table in which ``keys`` set bits, and whether a row's bit is set."""
    slot = F.shiftrightunsigned(F.xxhash64(*([on] if isinstance(on, str) else on)), 64 - KEY_BITS)
    bits = keys.select(slot.alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_bits"))
    put = rows.withColumn("_slot", slot).withColumn("_at", F.shiftright("_slot", 6))
    return put, F.broadcast(bits), F.expr("shiftrightunsigned(_bits, cast(_slot & 63 as int)) & 1L") == 1


def among(rows: DataFrame, keys: DataFrame, on: str | list[str], name: str = "_among") -> DataFrame:
    """``rows`` with the mark ``name``, which is false only where no row of ``keys`` has the same ``on`` (of the same types). Keys set bits in a
    table of fixed size, which is broadcast, so that no row is shuffled; keys that share a bit with one of ``keys`` are marked too."""
    put, bits, is_set = key_bits(rows, keys, on)
    return put.join(bits, F.col("_at") == F.col("_word"), "left").select(*(rows[c] for c in rows.columns), F.coalesce(is_set, F.lit(False)).alias(name))


def only_among(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """``rows`` without most of those whose key no row of ``keys`` has, by the same table."""
    put, bits, is_set = key_bits(rows, keys, on)
    return put.join(bits, (F.col("_at") == F.col("_word")) & is_set, "left_semi").select(rows.columns)


def sample_by_hash(rows: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows with the smallest hash of ``key``: a bounded, repeatable sample."""
    return rows.orderBy(F.xxhash64(key), key).limit(n)


def spread(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(n, "doc_id")
