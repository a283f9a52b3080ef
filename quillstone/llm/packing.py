"""Sequence packing by non-negative least squares.

Every document becomes ids (public word BPE, then the end id); documents are cut into full windows and
one remainder. The histogram of piece lengths (at most WINDOW values, whatever the corpus) goes to the
driver. Shallow combinations of one to three lengths that fill a window exactly are the columns of a
non-negative least-squares problem whose right side is the histogram; the repeat counts are rounded down
and the residual pieces packed greedily, best fit first, still on counts. Ranks of equally long pieces
are taken in salted groups, so one common length never meets in one task.

A null text is the empty text: one piece holding the end id. Repeated doc_ids are packed as separate
documents. An empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import id_text, materialize

WINDOW, END = 4096, 2
END_BYTES = END.to_bytes(4, "little")
#: Words remembered by a tokenizing worker; the memory is emptied beyond, so it stays bounded.
CACHE = 700_000
SALTS = 64
#: White space as the tokenizer sees it; a text's ids are those of its words, one after another.
WORD = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt int, piece_key long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Classes of Latin-1 characters: white space, letters and digits, full stop and comma, other marks, and the
#: control characters that only Python takes for white space.
CLASSES = bytes(
    ord("x") if 0x1C <= c <= 0x1F else ord(" ") if chr(c).isspace() else ord("a") if chr(c).isalnum() else ord(".") if chr(c) in ".," else ord("!")
    for c in range(256)
)


class Words(dict):
    """Ids of a word (little-endian 32-bit), found when first asked for; emptied beyond CACHE words."""

    def __init__(self, t):
        self.t, self.model, self.chars = t, t.model, dict(zip(range(256), byte_chars(), strict=True))

    def __missing__(self, w: str) -> bytes:
        if w.isalpha() and w == w.lower():
            # one lower-case word of letters is one unit of the tokenizer, so its model can be asked directly
            if not w.isascii():
                w_ = unicodedata.normalize("NFC", w)
                ids = [k.id for k in self.model.tokenize("".join(map(self.chars.__getitem__, w_.encode())))] if w_.isalpha() else self.t.encode(w, add_special_tokens=False).ids
            else:
                ids = [k.id for k in self.model.tokenize(w)]
        else:
            ids = self.t.encode(w, add_special_tokens=False).ids
        if len(self) >= CACHE:
            self.clear()
        out = self[w] = array("I", ids).tobytes()
        return out


def byte_chars() -> list[str]:
    """The printable character that byte-level tokenizers use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Tokenizer:
    """Word-wise memo over the public tokenizer; texts holding a special token's string go to it whole.

    The tokenizer lower-cases, and ends a word at white space and between letters and punctuation. Lower-casing
    and setting full stops and commas apart beforehand therefore leaves the ids alone and makes far fewer
    different words. That is done for Latin-1 texts whose full stops and commas stand alone."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tokenizers

        self.t = tokenizers.Tokenizer.from_file(path or tokenizer_path())
        self.memo = Words(self.t)

    @staticmethod
    def words(text: str) -> list[str]:
        try:
            kinds = text.encode("latin-1").translate(CLASSES)
        except UnicodeEncodeError:
            return [w.lower() if w.isascii() else w for w in WORD.findall(text)]
        if b"x" in kinds:
            return [w.lower() if w.isascii() else w for w in WORD.findall(text)]
        if not (b".." in kinds or b".!" in kinds or b"!." in kinds):
            text = text.replace(".", " .").replace(",", " ,")
        return text.lower().split()

    def __call__(self, text: str) -> np.ndarray:
        """Ids of ``text`` and the end id, as little-endian unsigned 32-bit integers."""
        if "<|" in text:
            ids = self.t.encode(text, add_special_tokens=False).ids
            return np.array([*ids, END], "<u4")
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.words(text))) + END_BYTES, "<u4")


@cache
def shared_tokenizer(path: str | None) -> Tokenizer:
    """One memo for all tasks of a Python worker."""
    return Tokenizer(path)


def cut(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """Pieces of every document: full windows and a remainder, with their ids' crc32."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, part, n = shared_tokenizer(path), TaskContext.get().partitionId(), 0
        for b in it:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = tok(text)
                for s in range(0, len(ids), window):
                    piece = ids[s : s + window]
                    rows.append((doc, s, len(piece), zlib.crc32(piece.tobytes()), len(ids), n % SALTS, (part << 40) + n))
                    n += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            types = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return id_text(docs).mapInArrow(run, PIECES)


def nnls(A: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Projected coordinate descent for min ||Ax - b||, x >= 0."""
    gram, rhs = A.T @ A, A.T @ b
    x, diag = np.zeros(A.shape[1]), np.maximum(np.diag(gram), 1e-12)
    grad = -rhs.copy()
    for _ in range(rounds):
        move = 0.0
        for j in range(len(x)):
            new = max(0.0, x[j] - grad[j] / diag[j])
            if new != x[j]:
                step = new - x[j]
                grad += gram[:, j] * step
                x[j] = new
                move = max(move, abs(step))
        if move < 0.25:
            break
    return x


def combinations(lengths: list[int], weight: dict[int, int], window: int, most: int = 600) -> list[tuple[int, ...]]:
    """Pairs and triples of present lengths that fill a window exactly, the best supplied first."""
    there, found = set(lengths), set()
    for a in lengths:
        if window - a in there and a <= window - a:
            found.add((a, window - a))
    common = sorted(lengths, key=lambda x: (-weight[x], x))[:160]
    for i, a in enumerate(common):
        for b in common[i:]:
            c = window - a - b
            if c > 0 and c in there:
                found.add(tuple(sorted((a, b, c))))
    return sorted(found, key=lambda c: (-min(weight[x] // c.count(x) for x in c), c))[:most]


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) covering the histogram exactly. Works on counts alone, so its cost
    is bounded by the number of distinct lengths."""
    left = dict(histogram)
    out: list[tuple[tuple[int, ...], int]] = []

    def take(combo: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((combo, times))
            for x in combo:
                left[x] -= times
                if not left[x]:
                    del left[x]

    if window in left:
        take((window,), left[window])
    lengths = sorted(left)
    combos = combinations(lengths, left, window)
    if combos:
        row = {x: i for i, x in enumerate(lengths)}
        A = np.zeros((len(lengths), len(combos)))
        for j, c in enumerate(combos):
            for x in c:
                A[row[x], j] += 1
        for c, x in zip(combos, nnls(A, np.array([float(left[x]) for x in lengths])), strict=True):
            if all(y in left for y in c):
                take(c, min(int(x), *(left[y] // c.count(y) for y in c)))
    # residuals: longest first, then the longest that still fits, repeated while the counts allow
    while left:
        combo, room, free = [], window, dict(left)
        keys = np.array(sorted(free))
        while len(keys):
            k = int(np.searchsorted(keys, room, "right")) - 1
            if k < 0:
                break
            x = int(keys[k])
            combo.append(x)
            room -= x
            free[x] -= 1
            if not free[x]:
                keys = np.delete(keys, k)
        c = tuple(combo)
        take(c, min(left[x] // c.count(x) for x in set(c)))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank of each run of slots, first sequence, offset in the sequence; ranks run on."""
    out, used, seq = defaultdict(list), defaultdict(int), 0
    for combo, times in patterns:
        off = 0
        for x in combo:
            out[x].append((used[x], seq, off))
            used[x] += times
            off += x
        seq += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for x, v in out.items()}


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    pieces = materialize(cut(docs, window, path), "pieces")
    counts = pieces.groupBy("length", "salt").count().toPandas()  # at most window * SALTS rows
    histogram = {int(k): int(v) for k, v in counts.groupby("length")["count"].sum().items()}
    where = slots(plan(histogram, window))
    first: dict[int, np.ndarray] = {}
    for length, part in counts.sort_values(["length", "salt"]).groupby("length"):
        n = np.zeros(SALTS, np.int64)
        n[part["salt"]] = part["count"]
        first[int(length)] = np.cumsum(n) - n

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank = None, 0
        for b in it:
            length, salt = b.column("length").to_numpy(), b.column("salt").to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for i, key in enumerate(zip(length.tolist(), salt.tolist(), strict=True)):
                rank = rank + 1 if key == last else 0
                last = key
                at, ids, offs = where[key[0]]
                r = int(first[key[0]][key[1]]) + rank
                j = int(np.searchsorted(at, r, "right")) - 1
                seq[i], off[i] = ids[j] + r - at[j], offs[j]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(seq), pa.array(off)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        pieces.repartition(n, "length", "salt")
        .sortWithinPartitions("length", "salt", "piece_key")
        .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
