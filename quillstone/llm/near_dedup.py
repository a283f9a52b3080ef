"""Near-duplicate detection by circulant MinHash.

A document's set holds the 64-bit hashes of its distinct k-word shingles. Two fixed bijections of the
32-bit integers make the whole signature: the first permutes shingle ids, the second, circularly shifted
by 0, 1, 2, ..., gives coordinate after coordinate. ``BANDS`` bands of ``ROWS`` coordinates propose
candidates; a pair at the threshold shares no band with probability (1 - 0.8^4)^28 < 4e-7. Every link is
confirmed on the full sets.

Sketches are numbered in writing, so that rows with equal or no doc_id are told apart; a row's text is found again by doc_id and
a hash of the text. Rows with equal sets form one class and enter the search once, under its smallest number. Within a bucket no list of all pairs
is made: rounds of stars merge classes (each test joins two components that meet in a bucket), and only
pairs of different components that still share a bucket are then compared exhaustively, block against
block, in groups of bounded size. There a parity sketch of each set (bit i: parity of the hashes in bin
i) refuses pairs with certainty: differing bits never outnumber the differing elements.

Joins on the key of a class, a bucket or a hub look up the keys of very many rows where the rows are (``join_groups``); of at most FEW keys
all are, so that no row is shuffled for it (``join_keys``).

Null and empty texts, and texts without words, have the empty set and are linked with nothing. Rows that
repeat a doc_id are linked by their own texts, each for itself; rows of a null doc_id are linked like others, and a component of
such rows alone has no id. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import LOWER, among, discard, id_text, join_groups, materialize, only_among

WORDS, PERCENT = 5, 80
BANDS, ROWS = 28, 4
K = BANDS * ROWS
#: Bits of the parity sketch.
PARITY = 4096
STAR_ROUNDS, BLOCK, SALT_SIZE = 4, 256, 512
#: A round that links less than one in so many of its pairs is the last one.
STAR_YIELD = 50
#: Keys that a join may broadcast whole, in rows of a few longs.
FEW = 100_000
U64, U32 = np.uint64, np.uint32


def shingle_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, U64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), U64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, U64(min(k, len(words))))
    for j in range(min(k, len(words))):
        out = (out ^ h[j : j + n]) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
    return np.unique(out)


def signature(s: np.ndarray) -> np.ndarray:
    """K coordinates from two permutations, the second one shifted circularly."""
    x = (s ^ (s >> U64(32))).astype(U32)
    x = (x ^ (x >> U32(16))) * U32(0x85EBCA6B)
    x = (x ^ (x >> U32(13))) * U32(0xC2B2AE35)
    x ^= x >> U32(16)
    out, shift = np.full(K, 0xFFFFFFFF, U32), np.arange(K, dtype=U32)[:, None]
    for at in range(0, len(x), 1024):
        y = x[None, at : at + 1024] + shift
        y *= U32(0x2C1B3C6D)
        y ^= y >> U32(15)
        y *= U32(0x297A2D39)
        np.minimum(out, y.min(1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS).astype(U64)
    h = np.arange(1, BANDS + 1, dtype=U64)
    for j in range(ROWS):
        h = (h ^ parts[:, j]) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(32)
    return h.view(np.int64)


def sketch(rows: DataFrame, k: int = WORDS) -> DataFrame:
    """Size, fingerprint and band keys of the set of each row (doc_id, text, th)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, k1, k2, bands = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                k1.append(int((s * U64(0xD6E8FEB86659FD93)).sum(dtype=U64).view(np.int64)))
                k2.append(int(np.bitwise_xor.reduce((s ^ (s >> U64(31))) * U64(0xA0761D6478BD642F)).view(np.int64)) if len(s) else 0)
                bands.append(band_keys(signature(s)).tolist() if len(s) else [])
            cols = [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "th", "n", "k1", "k2", "bands"])

    return rows.mapInArrow(run, "doc_id long, th long, n long, k1 long, k2 long, bands array<long>").withColumn("row", F.monotonically_increasing_id())


def same_text(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def hashed(docs: DataFrame) -> DataFrame:
    return id_text(docs).withColumn("th", F.xxhash64("text"))


def of_keys(keys: DataFrame, n: int) -> DataFrame:
    """``keys`` as a side of a join: ``n`` rows at most, broadcast if they are few, else merged."""
    return F.broadcast(keys) if n <= FEW else keys.hint("merge")


def join_keys(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str, total: int, n: int) -> DataFrame:
    """``join_groups`` where ``groups`` has ``n`` rows at most: if they are few, all are looked up where the rows are."""
    return rows.join(F.broadcast(groups.drop(size)), on) if n <= FEW else join_groups(rows, groups, on, size, total)


def full_sets(rows: DataFrame, reps: DataFrame, k: int, n: int) -> DataFrame:
    """Sets and parity sketches of the texts of ``reps`` (rep, doc_id, th), of which there are ``n`` at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            odd = [np.packbits((np.bincount((s >> U64(40)).astype(np.int64) % PARITY, minlength=PARITY) & 1).astype(np.uint8)).tobytes() for s in sets]
            cols = [b.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(odd, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["rep", "items", "size", "odd"])

    # the classes grow with the corpus: many are never broadcast, but only the texts that may be theirs are shuffled
    rows = rows if n <= FEW else only_among(rows, reps, ["doc_id", "th"])
    found = rows.join(of_keys(reps, n), same_text(rows, reps)).select("rep", "text").dropDuplicates(["rep"])
    return found.mapInArrow(run, "rep long, items binary, size long, odd binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, total: int) -> DataFrame:
    """The pairs (a, b), ``total`` in all, whose sets are similar. Grouped by b in salted parts of about SALT_SIZE pairs, so a
    much-linked document is split, and streamed: a task holds one set of each side."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_SIZE).alias("salts"), F.count("*").alias("n_rows"))
    salted = join_keys(pairs, sizes, "b", "n_rows", total, total).withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")))
    member = salted.select("b", "salt", F.lit(1).alias("kind"), "a")
    lead = sizes.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("b").alias("a"))
    # one request list, so that the sets are shuffled once, and only those asked for
    asked, sets = pairs.select(F.explode(F.array("a", "b")).alias("a")), sets.select(F.col("rep").alias("a"), "items")
    sets = sets.join(F.broadcast(asked), "a", "left_semi") if 2 * total <= FEW else only_among(sets, asked, "a")
    rows = lead.unionByName(member).join(sets.hint("merge"), "a")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = None
        for batch in it:
            out = []
            for b, kind, a, items in zip(*(batch.column(c).to_pylist() for c in ("b", "kind", "a", "items")), strict=True):
                s = np.frombuffer(items, U64)
                if kind == 0:
                    base = s
                    continue
                both = np.concatenate([base, s])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                if 100 * inter >= percent * (len(both) - inter):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return rows.repartition(n, "b", "salt").sortWithinPartitions("b", "salt", "kind").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label, n_rows): the smallest node reachable, and the node's links. Minimum propagation with pointer jumping; every round is
    a written table, and only counts reach the driver."""
    both = materialize(edges.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("e")).select("e.*"), "edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("label"), F.count("*").alias("n_rows")).withColumn("label", F.least("label", "node")), "labels")
    total, n = both.count(), labels.count()
    while True:
        heard = join_keys(both, labels.withColumnRenamed("node", "y"), "y", "n_rows", total, n).select(F.col("x").alias("node"), "label", F.lit(None).cast("long").alias("old"), F.lit(0).cast("long").alias("n_rows"))
        own = labels.select("node", "label", F.col("label").alias("old"), "n_rows")
        low = heard.unionByName(own).groupBy("node").agg(F.min("label").alias("low"), F.max("old").alias("old"), F.max("n_rows").alias("n_rows"))
        used = [labels]
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        if n > FEW:
            low = materialize(low, "low")
            used.append(low)
            jump = low.groupBy("low").agg(F.count("*").alias("followers")).join(jump, "low")
        new = materialize(join_keys(low, jump, "low", "followers", n, n).select("node", F.least("low", "jump").alias("label"), "old", "n_rows"), "labels")
        changed = new.where("label <> old").limit(1).count()
        discard(*used)
        labels = new.drop("old")
        labels._scratch_path = new._scratch_path
        if not changed:
            discard(both)
            return labels


def label_of(reps: DataFrame, labels: DataFrame | None, n: int) -> DataFrame:
    """``reps`` with the label of each, of ``n`` labels at most: its own number if it has none."""
    if labels is None:
        return reps.withColumn("label", F.col("rep"))
    known = labels.select(F.col("node").alias("rep"), "label")
    return reps.join(F.broadcast(known) if n <= FEW else known, "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def live(buckets: DataFrame, labels: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Rows of the buckets in which more than one component meets, and the number of such buckets."""
    rows = label_of(buckets, labels, n)
    mixed = materialize(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n_rows")).where("lo <> hi").select("key", "n_rows"), "mixed")
    keys = mixed.count()
    out = materialize(join_keys(rows, mixed, "key", "n_rows", buckets.count(), keys), "live")
    discard(mixed)
    return out, keys


def star_pairs(rows: DataFrame, round_: int, keys: int) -> DataFrame:
    """In each of the ``keys`` buckets one member of every component against one member of the smallest; members are drawn anew each round."""
    pick = F.min_by("rep", F.struct(F.xxhash64("rep", F.lit(round_)), "rep"))
    one = rows.groupBy("key", "label").agg(pick.alias("rep"))
    lead = one.groupBy("key").agg(F.min_by("rep", "label").alias("lead"), F.min("label").alias("low"), F.count("*").alias("n_rows"))
    met = join_keys(one, lead, "key", "n_rows", rows.count(), keys).where("label <> low").groupBy("label", "low").agg(F.min(F.struct("rep", "lead")).alias("p"))
    return met.select(F.col("p.rep").alias("a"), F.col("p.lead").alias("b"))


def cross_pairs(rows: DataFrame, sets: DataFrame, percent: int, keys: int) -> DataFrame:
    """Pairs of different components in one of the ``keys`` buckets whose parity sketches allow the similarity, block against block.

    percent * union <= 100 * intersection means that at most (100 - percent) / (100 + percent) of the two
    sizes together differ.
    A bucket of m rows makes about m / BLOCK blocks; each pair of blocks is one group of at most a few
    hundred rows, and only agreeing pairs leave it.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n_rows"))
    sketches = sets.select("rep", "size", "odd")
    put = join_keys(rows, size, "key", "n_rows", rows.count(), keys).join(sketches, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    sent = put.select("key", "label", "rep", "size", "odd", "block", other.alias("o")).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "label", "rep", "size", "odd")

    def compare(group: list[tuple]) -> list[tuple[int, int]]:
        i, j = group[0][1:3]
        sides = [[g for g in group if g[3] == x] for x in (i, j)]
        lab = [np.array([g[4] for g in s], np.int64) for s in sides]
        rep = [np.array([g[5] for g in s], np.int64) for s in sides]
        n = [np.array([g[6] for g in s], np.int64) for s in sides]
        odd = [np.frombuffer(b"".join(g[7] for g in s), U64).reshape(-1, PARITY // 64) for s in sides]
        out = []
        for x in range(len(rep[0])):
            differ = np.bitwise_count(odd[1] ^ odd[0][x]).sum(1, dtype=np.int64)
            ok = (differ * (100 + percent) <= (100 - percent) * (n[1] + n[0][x])) & (lab[1] != lab[0][x])
            if i == j:
                ok[: x + 1] = False
            out += [(max(int(rep[0][x]), y), min(int(rep[0][x]), y)) for y in rep[1][ok].tolist()]
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for b in it:
            out = []
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", "block", "label", "rep", "size", "odd")), strict=True):
                if group and group[0][:3] != row[:3]:
                    out += compare(group)
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(out), strict=True)], ["a", "b"])
        if group and (out := compare(group)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*set(out), strict=True)], ["a", "b"])

    return sent.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long").distinct()


def linked(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """row, doc_id, th (hash of the text), n, component (the smallest row number of its component; null for the empty set),
    component_id (its smallest doc_id) of every row."""
    rows = hashed(docs)
    sketches = materialize(sketch(rows, k), "sketch")
    filled = sketches.where("n > 0")
    # bands of a class are those of any of its rows: they are shuffled with it, once
    classes = materialize(filled.groupBy("k1", "k2", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("doc"), F.count("*").alias("n_rows"), F.min("bands").alias("bands")), "classes")
    n_classes = classes.count()
    banded = classes.select(F.explode("bands").alias("key"), "rep")
    shared = banded.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n_rows")).where("lo <> hi").select("key", "n_rows")
    shared = materialize(shared, "shared")
    keys = shared.count()
    # most keys are of one class: their rows are not shuffled again
    buckets = materialize(join_keys(banded if keys <= FEW else only_among(banded, shared, "key"), shared, "key", "n_rows", BANDS * n_classes, keys), "buckets")
    involved = sketches.select("row", "doc_id", "th").join(of_keys(buckets.select(F.col("rep").alias("row")).distinct(), n_classes), "row", "left_semi").withColumnRenamed("row", "rep")
    used, n_involved = [shared], n_classes
    if n_classes > FEW:
        involved = materialize(involved, "involved")
        used.append(involved)
        n_involved = involved.count()
    sets = materialize(full_sets(rows, involved, k, n_involved), "sets")
    used.append(sets)

    # every bucket holds different classes, so that all are live at first
    labels, edges, before = None, None, buckets
    rows_ = label_of(buckets, None, 0)
    for round_ in range(STAR_ROUNDS + 1):
        if round_ and labels is not None:
            rows_, keys = live(buckets, labels, n_classes)
            discard(before)
            before = rows_
            buckets = rows_.select("key", "rep")  # a bucket that one component fills never splits again
        if not keys:
            break
        last = round_ == STAR_ROUNDS
        pairs = materialize(cross_pairs(rows_, sets, percent, keys) if last else star_pairs(rows_, round_, keys), "pairs")
        total = pairs.count()
        found = materialize(verify(pairs, sets, percent, total), "links")
        n_found = found.count()
        discard(pairs)
        used.append(found)
        edges = found if edges is None else edges.unionAll(found)
        if not last and round_ and n_found * STAR_YIELD <= total:  # stars find little more: compare what is left
            last, pairs = True, materialize(cross_pairs(rows_, sets, percent, keys), "pairs")
            found = materialize(verify(pairs, sets, percent, pairs.count()), "links")
            n_found += found.count()
            discard(pairs)
            used.append(found)
            edges = edges.unionAll(found)
        if n_found:
            if labels is not None:
                used.append(labels)
            labels = components(edges)
        if last:
            break
    named = label_of(classes.drop("bands"), labels, n_classes).withColumnRenamed("label", "component")
    if n_classes > FEW:
        named = materialize(named, "named")
        used.append(named)
    ids = named.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("n_classes"))
    by_class = materialize(join_keys(named.drop("doc"), ids, "component", "n_classes", n_classes, n_classes).drop("rep"), "by-class")
    plain = sketches.drop("bands")
    out = join_keys(plain.where("n > 0"), by_class, ["k1", "k2", "n"], "n_rows", sketches.count(), n_classes)
    none = plain.where("n = 0").select("*", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    out = materialize(out.unionByName(none).drop("k1", "k2"), "members")
    discard(*used, before, by_class, classes, sketches, *([] if labels is None else [labels]))
    return out


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked(docs, k, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near copies: of the smallest doc_id (null comes last), and of rows that repeat it one.
    Null and empty texts stay, all columns are kept, whatever their names; an empty table stays empty."""
    found = linked(docs, k, percent).where("component is not null")
    first = found.where("doc_id <=> component_id").groupBy("component").agg(F.min("row").alias("row"))
    stay = found.join(first.select("row").hint("merge"), "row", "left_semi").select("doc_id", "th").withColumn("stays", F.lit(True))
    goes = found.join(first.select("row").hint("merge"), "row", "left_anti").select("doc_id", "th")
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    rows = docs.select(own.alias("k"), F.struct(*docs.columns).alias("d")).select("k.doc_id", "k.th", "d")
    # a row that goes, or is repeated, has the key of one that goes: texts of other keys stay where they are
    rows = among(rows, goes, ["doc_id", "th"], "unsure")
    unsure = rows.where("unsure")
    some = F.coalesce("d.text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    marked = unsure.join(stay.hint("merge"), same_text(unsure, stay), "left").select(unsure["doc_id"], unsure["th"], "d", "stays")
    number = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("stays"))
    kept = marked.withColumn("nth", number).where(~some | (F.col("stays") & (F.col("nth") == 1))).select("d.*")
    return rows.where("not unsure").select("d.*").unionAll(kept)
