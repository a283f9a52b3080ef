"""Stored inverted index: immutable segments of postings in buckets of terms, a table of files, tombstones, merges.

A refresh reads only files that are new or changed, and writes one segment: postings (term, path, line, tf, length) in buckets
by hash of the term and sorted by it, and the lines themselves. The files table of a version says which segment holds a
file's live lines; postings and lines of other segments are dead, so a changed or deleted file needs no rewrite. A search reads the
buckets of its terms alone, with the terms pushed down to the scan. ``merge`` rewrites live rows as one segment.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import search
from quillstone.operators.store import spread, squeezed
from quillstone.operators.versions import Versions

#: Buckets of an index, lines whose terms are counted at once, postings that are packed together, and characters of text whose postings a task gets.
BUCKETS, PACK_LINES, PACK_POSTINGS, TASK_CHARS = 64, 5000, 1 << 21, 1 << 24
POSTINGS = "term string, path string, line int, tf long, length int, segment long"
LINES = "path string, line int, content string, segment long"
MARKS = "path string, line int, mtime long"
FILES = "path string, mtime long, segment long, n_lines long, n_terms long"
#: A piece: its terms in order, their sizes and how many postings each has; the paths of its files and their sizes; and of each posting the file (as a step from the
#: one before), line, count and length of the line.
PIECE = ["terms", "sizes", "n", "paths", "path_sizes", "steps", "line", "tf", "length"]

#: Bytes of ASCII that are in no term as spaces.
SPACED = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def plain(text: Column) -> Column:
    """Lower-cased text as bytes in which, but for ASCII, spaces alone separate terms (``search.terms``); the pattern is only tried on text beyond ASCII."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(F.octet_length(text) == F.length(text), low).otherwise(F.regexp_replace(low, search.SEPARATORS, " ")).cast("binary")


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers, first the lowest byte of all, then the next: small ones are squeezed to little."""
    return squeezed(np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes())


def numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(spread(packed), np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def strings(x: pa.Array) -> tuple[bytes, bytes]:
    """Bytes or strings end to end, and their sizes, -1 for null."""
    x = x.cast(pa.binary())
    return squeezed(b"".join(t for t in x.to_pylist() if t is not None)), planes(pc.fill_null(pc.binary_length(x), -1).to_numpy())


def from_strings(data: bytes, sizes: bytes) -> pa.Array:
    n = numbers(sizes)
    offsets = np.cumsum(np.r_[0, n.clip(0)]).astype(np.int32)
    x = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spread(data))])
    return pc.if_else(pa.array(n < 0), pa.scalar(None, pa.binary()), x) if (n < 0).any() else x


def n_terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        n = pa.array([len(x.translate(SPACED).split()) for x in b.column("x").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("path"), n], ["path", "n"])


def marked_lines(files: DataFrame) -> DataFrame:
    """(path, mtime, line, content): the lines of each file that are not blank, and a line 0 that holds its time."""
    rows = files.select("path", F.col("mtime").cast("long").alias("mtime"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), F.split(F.coalesce("content", F.lit("")), "\n"))).alias("line", "content"))
    return rows.select("path", F.when(F.col("line") == 0, F.col("mtime")).alias("mtime"), "line", "content").where("line = 0 OR trim(content) <> ''")


class SearchIndex:
    """Index of files (path, content, mtime as a number) below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.versions = spark, Versions(spark, root)
        self.buckets = int(self.versions.read()[1].get("buckets", buckets))

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _read(self, schema: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def files(self, manifest: dict | None = None) -> DataFrame:
        """One row for each live file, with the segment of its lines."""
        manifest = self.versions.read()[1] if manifest is None else manifest
        return self._read(FILES, [manifest["files"]] if manifest else [])

    def lines(self) -> DataFrame:
        """(path, line, content) of all live lines."""
        manifest = self.versions.read()[1]
        live = self.files(manifest).select("path", "segment")
        return self._lines([s["lines"] for s in manifest.get("segments", [])]).join(live, ["path", "segment"], "left_semi").drop("segment")

    def _postings(self, lines: DataFrame, number: int) -> DataFrame:
        """Postings of lines (path, line, content), bucket by bucket, each sorted by term.

        One line's terms are counted in the line. What many lines of a task have for a bucket travels as one compressed piece, in which a term and a path
        stand once, and the task that gets a bucket's pieces sorts their terms. Where there is more text than tasks of a bucket each are to get, a
        bucket is dealt in parts by the path.
        """
        buckets, chars = self.buckets, lines.agg(F.sum(F.length("content"))).first()[0] or 0
        parts = max(1, -(-chars // (TASK_CHARS * buckets)))
        places = buckets * parts
        tasks = min(places, max(self.spark.sparkContext.defaultParallelism, -(-chars // TASK_CHARS)))
        texts = lines.select("path", "line", plain(F.col("content")).alias("x"), F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("s"))

        def pieces(held: list[tuple]) -> pa.RecordBatch:
            terms, path, line, s, n, tf, length = zip(*held, strict=True)
            terms = pa.chunked_array(terms).unify_dictionaries().combine_chunks()
            words, code = terms.dictionary, terms.indices.to_numpy()
            path, (line, s, n, tf, length) = pa.chunked_array(path).combine_chunks().dictionary_encode(null_encoding="encode"), (np.concatenate(x) for x in (line, s, n, tf, length))
            file, row = path.indices.to_numpy(), np.repeat(np.arange(len(n)), n)
            # the signed 64-bit hash of Spark's xxhash64
            bucket = np.array([(xxhash.xxh64_intdigest(t, 42) + 2**63) % 2**64 - 2**63 for t in words.to_pylist()], np.int64) % buckets
            place = bucket[code] * parts + s[row]
            ordered = pc.sort_indices(words).to_numpy()
            rank = np.empty(len(words), np.int64)
            rank[ordered] = np.arange(len(words))
            order = np.argsort(place * max(1, len(words)) + rank[code], kind="stable")
            place, row, code, tf = place[order], row[order], code[order], tf[order]
            starts = np.unique(place, return_index=True)[1]
            out = []
            for x, y in zip(starts.tolist(), [*starts[1:].tolist(), len(place)], strict=False):
                first = np.r_[0, np.nonzero(np.diff(code[x:y]))[0] + 1]
                files, at = np.unique(file[row[x:y]], return_inverse=True)
                numbered = np.diff(at, prepend=0), line[row[x:y]], tf[x:y], length[row[x:y]]
                out.append((place[x], *strings(words.take(pa.array(code[x:y][first]))), planes(np.diff(first, append=y - x)), *strings(path.dictionary.take(pa.array(files))), *map(planes, numbered)))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), *[pa.binary()] * len(PIECE)), strict=True)], ["place", *PIECE])

        def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in (b.slice(x, PACK_LINES) for b in it for x in range(0, b.num_rows, PACK_LINES)):
                counts = [Counter(x.translate(SPACED).split()) for x in batch.column("x").to_pylist()]
                n, length = np.array([len(c) for c in counts], np.int64), np.array([c.total() for c in counts], np.int32)
                tf = np.fromiter((c for x in counts for c in x.values()), np.int32, n.sum())
                held.append((pa.array([t for c in counts for t in c], pa.binary()).dictionary_encode(), batch.column("path"), batch.column("line").to_numpy(), batch.column("s").to_numpy(), n, tf, length))
                size += len(tf)
                if size >= PACK_POSTINGS:
                    yield pieces(held)
                    held, size = [], 0
            if size:
                yield pieces(held)

        def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (r for b in it for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
            for place, part in groupby(rows, key=lambda r: r[0]):
                pieces = ((from_strings(*x[1:3]), numbers(x[3]), from_strings(*x[4:6]), *map(numbers, x[6:])) for x in part)
                terms, n, paths, steps, *rest = zip(*pieces, strict=True)
                before = np.cumsum([0, *(len(x) for x in paths)])
                file = np.concatenate([k + np.cumsum(x) for k, x in zip(before.tolist(), steps, strict=False)])
                paths, terms = pa.concat_arrays(paths).cast(pa.string()), pa.concat_arrays(terms).dictionary_encode()
                words = terms.dictionary.take(ordered := pc.sort_indices(terms.dictionary))
                rank = np.empty(len(words), np.int64)
                rank[ordered.to_numpy()] = np.arange(len(words))
                term = np.repeat(rank[terms.indices.to_numpy()], np.concatenate(n))
                order, words = np.argsort(term, kind="stable"), words.cast(pa.string())
                line, tf, length = map(np.concatenate, rest)
                for at in (order[x : x + (1 << 16)] for x in range(0, len(order), 1 << 16)):
                    cols = words.take(pa.array(term[at])), paths.take(pa.array(file[at])), line[at], tf[at].astype(np.int64), length[at], np.full(len(at), number, np.int64), np.full(len(at), place // parts, np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["term", "path", "line", "tf", "length", "segment", "_b"])

        task = F.floor(F.col("place") * F.lit(tasks) / F.lit(places)).cast("int")  # a bucket's parts lie side by side
        dealt = texts.mapInArrow(pack, ", ".join(["place int", *[f"{c} binary" for c in PIECE]])).repartitionById(tasks, task).sortWithinPartitions("place")
        return dealt.mapInArrow(unpack, f"{POSTINGS}, _b int")

    def _write_lines(self, rows: DataFrame, number: int) -> str:
        """Lines (path, line, content, mtime) of a segment, written once: all else is made of what was written. Line 0 marks a file and is no line."""
        return self.versions.write(rows.select("path", "line", "content", "mtime", F.lit(number).cast("long").alias("segment")))

    def _segment(self, lines: str, number: int) -> dict:
        return {"postings": self.versions.write(self._postings(self._lines([lines]), number), "_b"), "lines": lines}

    def _lines(self, paths: list[str]) -> DataFrame:
        return self._read(LINES, paths).where("line > 0")

    def refresh(self, files: DataFrame, gone: DataFrame | None = None) -> int:
        """Index the files that are new or whose mtime is later than the indexed one; the paths of ``gone`` leave the index. The version."""

        def make(number: int, manifest: dict) -> dict | None:
            known = self.files(manifest)
            new = search.stale(files, known) if manifest else files  # before the first version all are new
            kept = self._write_lines(marked_lines(new), number)
            changed, lines = self._read(MARKS, [kept]).where("line = 0"), self._lines([kept])
            left = known.join(changed.select("path"), "path", "left_anti")
            left = left.join(gone.select("path").distinct(), "path", "left_anti") if gone is not None else left
            n_changed = changed.count()
            if not n_changed and (gone is None or left.count() == known.count()):
                return None
            segments = [*manifest.get("segments", []), *([self._segment(kept, number)] if n_changed else [])]
            sizes = lines.select("path", plain(F.col("content")).alias("x")).mapInArrow(n_terms, "path string, n long").groupBy("path").agg(F.count("*").alias("n_lines"), F.sum("n").alias("n_terms"))
            found = changed.select("path", "mtime", F.lit(number).cast("long").alias("segment")).join(sizes, "path", "left").fillna(0, ["n_lines", "n_terms"])
            return {"buckets": self.buckets, "segments": segments, "files": self.versions.write(left.unionByName(found))}

        return self.versions.change(make)

    def merge(self) -> int:
        """All live lines as one segment; dead postings go."""

        def make(number: int, manifest: dict) -> dict | None:
            if len(manifest.get("segments", [])) < 2:
                return None
            live = self.files(manifest).select("path", "segment")
            lines = self._lines([s["lines"] for s in manifest["segments"]]).join(live, ["path", "segment"], "left_semi")
            segment = self._segment(self._write_lines(lines.withColumn("mtime", F.lit(None).cast("long")), number), number)
            files = self.files(manifest).withColumn("segment", F.lit(number).cast("long"))
            return manifest | {"segments": [segment], "files": self.versions.write(files)}

        return self.versions.change(make)

    def rebuild(self, files: DataFrame) -> int:
        """The index of ``files`` alone, whatever was indexed before."""
        known = self.files()
        self.versions.change(lambda number, manifest: manifest | {"segments": [], "files": self.versions.write(known.limit(0))} if manifest else None)
        return self.refresh(files)

    def vacuum(self, keep: int = 2) -> int:
        return self.versions.vacuum(lambda m: {m["files"], *(p for s in m.get("segments", []) for p in s.values())} if m else set(), keep)

    def postings(self, terms: list[str]) -> DataFrame:
        """Live postings of a few terms; the scan reads their buckets and, by statistics of the sorted files, little beside them."""
        manifest = self.versions.read()[1]
        wanted = self.spark.createDataFrame([(t,) for t in terms], "t string").select(self._bucket(F.col("t")).alias("b")).distinct().collect() if terms else []
        paths = [f"{s['postings']}/_b={r.b}" for s in manifest.get("segments", []) for r in wanted]
        found = self._read(POSTINGS, self._existing(paths)).where(F.col("term").isin(*terms) if terms else F.lit(False))
        return found.join(self.files(manifest).select("path", "segment"), ["path", "segment"], "left_semi").drop("segment")

    def _existing(self, paths: list[str]) -> list[str]:
        return [p for p in paths if self.versions._fs.exists(self.versions._path(p))]

    def bm25(self, q: str, limit: int | None = 10) -> DataFrame:
        """(path, line, rank) of the lines that hold every term, as ``search.bm25`` ranks them over all live lines."""
        want = sorted(set(search.query_terms(q)))
        none = self.spark.createDataFrame([], "path string, line int, rank double")
        if not want:
            return none
        p = self.postings(want)
        hits = p.groupBy("path", "line", "length").agg(*[F.coalesce(F.sum(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"_c{i}") for i, w in enumerate(want)])
        df = p.groupBy("term").agg(F.count("*").alias("n"))
        frequency = df.agg(*[F.coalesce(F.max(F.when(F.col("term") == w, F.col("n"))), F.lit(0)).alias(f"_d{i}") for i, w in enumerate(want)])
        totals = self.files().agg(F.sum("n_lines").alias("N"), (F.sum("n_terms") / F.sum("n_lines")).alias("avg"))
        y = hits.crossJoin(F.broadcast(totals.crossJoin(F.broadcast(frequency))))  # one row
        score = F.lit(0.0)
        for i in range(len(want)):
            y = y.where(F.col(f"_c{i}") > 0)
            score = score + search.weight(F.col("N"), F.col(f"_d{i}"), F.col(f"_c{i}"), F.col("length"), F.col("avg"))
        out = y.select("path", "line", F.round(score, 6).alias("rank"))
        return out.orderBy(F.desc("rank"), "path", "line").limit(limit) if limit else out

    def search(self, q: str, limit: int = 10) -> DataFrame:
        """(path, line, content, rank) of the best lines."""
        hits = self.bm25(q, limit)
        return self.lines().join(F.broadcast(hits), ["path", "line"]).orderBy(F.desc("rank"), "path", "line")  # at most ``limit`` hits
