"""Language-model scoring with a hierarchical Pitman-Yor model, seated by Gibbs sampling.

Restaurants: one for each preceding word (the word itself), all sharing the unigram restaurant as parent, whose own
parent is uniform over the known words and one unknown. A sweep

1. draws the parent's distribution G0 given its seating: Dirichlet weights (customers - discount * tables) of the
   words and (strength + discount * all tables) of what it has not served;
2. draws for each context u an auxiliary Gamma(theta / d + T_u), given which its dishes are independent, each with
   density S_d(c, t) * s^t of its tables, s = d * auxiliary * G0(word);
3. seats all customers of every dish anew by the Chinese-restaurant rule (a new table with probability
   s / (s + j - d * t) after j customers at t tables) and accepts the seating by the Metropolis-Hastings rule, whose
   ratio is that of the products of these denominators: the exact conditional is left invariant;
4. seats the parent likewise: its customers are the tables of the contexts.

All customers of a dish are seated at once, for any number of them: the openings are the fixed point of
t = 1 + (openings so far), which the causal order makes unique. The predictive probabilities of the last ``KEPT`` of
``SWEEPS`` sweeps are averaged. Discounts come from counts of counts, strengths are ``THETA``.

Every random number is a hash of (word, context, sweep, customer), words are numbered by fixed slots of their hash, and
corpus-wide sums are of integers: scores do not depend on the number of partitions.

Distribution: texts are read once, in blocks of about ``BLOCK_BYTES`` written as numbers of words. A block asks the homes
of its words (dealt by hash) for their corpus-wide numbers, small for frequent words, and then sends its distinct (context,
word) keys to ranges dealt by context; a context of more than ``SPLIT`` customers is dealt further by word, which the
auxiliary variable allows. Per sweep, ranges and homes exchange tables and probabilities of distinct words;
only scalars reach the driver. At the end each range answers each block. Blocks, homes and ranges combine what
is frequent before a shuffle, and the number of ranges follows the number of tokens.

A null text is the empty text and holds the end token only. Rows of a null doc_id are training rows. Repeated rows count
repeatedly. Without training tokens every probability is that of the uniform base. An empty table gives an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import BATCH_BYTES, LOWER, discard, id_text, materialize

SWEEPS, KEPT = 5, 3
BLOCK_BYTES = 8 << 20
#: Fixed numbers of slots of word hashes; customers of one part of a context; tokens of one range; customers seated together.
SLOTS, SPLIT, RANGE_TOKENS, CHUNK = 4096, 1 << 22, 1 << 22, 1 << 16
HOME_BYTES, LEAST_TOKENS = 4 << 20, 1 << 18
THETA = 1.0
END = b" "
U64 = np.uint64
DTYPES = ("u1", "u4", "i4", "i8", "u8", "f4")
ROW = "kind int, dest long, origin long, blob binary, sums array<long>"
#: Fixed-point scale of the sums of Dirichlet weights.
FIXED = 1 << 16


# ---- arrays as values


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one value: count, lengths and kinds, then the bytes, plane by plane and compressed."""
    head = np.array([x for a in arrays for x in (len(a), DTYPES.index(a.dtype.str[1:]))], "<i8").tobytes()
    press = zlib.compressobj(1)
    body = [press.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T)) for a in arrays if len(a)]
    return b"".join([len(arrays).to_bytes(4, "little"), head, *body, press.flush()])


def unpacked(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw, at, out = zlib.decompress(memoryview(blob)[4 + 16 * n :]), 0, []
    for size, num in np.frombuffer(blob, "<i8", 2 * n, 4).reshape(n, 2).tolist():
        kind = np.dtype(DTYPES[num])
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += size * kind.itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers as 32 bits where they fit."""
    return x.astype(np.uint32 if not len(x) or int(x.max()) < 1 << 32 else np.uint64)


def narrow_sort(x: np.ndarray) -> np.ndarray:
    """Small whole numbers in 16 bits where they fit, which are sorted by their digits."""
    return x.astype(np.uint16) if len(x) and int(x.max()) < 1 << 16 else x


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a rising list."""
    return narrow(np.diff(x, prepend=x.dtype.type(0)))


def rising(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=np.int64)


def starts(*cols: np.ndarray) -> np.ndarray:
    """Where a new combination of the sorted columns begins."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each value among them."""
    order = np.argsort(x)
    at = starts(x[order])
    new = np.zeros(len(x), np.int64)
    new[at] = 1
    place = np.empty(len(x), np.int64)
    place[order] = np.cumsum(new) - 1
    return x[order[at]], place


def lengths(at: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(at, n))


# ---- random numbers as hashes


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U64)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def keyed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit key of several numbers."""
    h = np.array([0x9E3779B97F4A7C15], U64)
    for p in parts:
        h = mix((h ^ np.asarray(p).astype(U64)) + U64(0x9E3779B97F4A7C15))
    return h


def uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((mix(key) >> U64(12)).astype(float) + 0.5) * 2.0**-52


def gamma(key: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Gamma draws (Marsaglia and Tsang's squeeze), one for each key."""
    small = shape < 1
    d = np.where(small, shape + 1, shape) - 1 / 3
    out, todo, i = np.empty(len(d)), np.arange(len(d)), 0
    while len(todo):
        k = keyed(key[todo], i)
        x = np.sqrt(-2 * np.log(uniform(k))) * np.cos(2 * np.pi * uniform(k + U64(1)))
        v = (1 + x / np.sqrt(9 * d[todo])) ** 3
        ok = v > 0
        ok[ok] = np.log(uniform(k + U64(2))[ok]) < (0.5 * x * x + d[todo] * (1 - v))[ok] + d[todo][ok] * np.log(v[ok])
        out[todo[ok]] = (d[todo] * v)[ok]
        todo, i = todo[~ok], i + 1
    if small.any():
        out[small] *= uniform(keyed(key[small], 1 << 20)) ** (1 / shape[small])
    return np.maximum(out, 1e-300)


# ---- seating


def openings(key: np.ndarray, at: np.ndarray, n: np.ndarray, s: np.ndarray, d: float, t: np.ndarray) -> tuple[np.ndarray, ...]:
    """For n customers of each dish, of which ``at`` are seated at t tables: customers and tables before each, and whether
    it opens one. Dish after dish."""
    first = np.cumsum(n) - n
    j = np.arange(n.sum()) - np.repeat(first - at, n)
    u, t = uniform(np.repeat(key, n) + j.astype(U64) * U64(0x9E3779B97F4A7C15)), np.repeat(t, n)
    bound = np.repeat(s, n) * (1 / u - 1) - j  # a customer opens a table where this exceeds -d * tables
    before = t
    while True:
        opens = bound > -d * before
        total = np.cumsum(opens)
        now = t + total - opens - np.repeat(total[first] - opens[first], n)
        if np.array_equal(now, before):
            return j, before, opens
        before = now


def pieces(c: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Dishes, customers seated before and customers to seat, in groups of at most CHUNK customers; a larger dish comes in
    several groups, one after another."""
    ends = np.cumsum(c - 1)
    a = 0
    while a < len(c):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        if b == a + 1:
            for k in range(1, int(c[a]), CHUNK):
                yield np.array([a]), np.array([k]), np.array([min(CHUNK, int(c[a]) - k)])
        else:
            yield np.arange(a, b), np.ones(b - a, np.int64), c[a:b] - 1
        a = b


def seat(key: np.ndarray, c: np.ndarray, s: np.ndarray, d: float, weigh: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tables of the seating that ``key`` draws at strength ``s`` (0: all at one table), and the log of the product of its
    denominators at strength ``weigh`` (default: s). Each dish has two customers at least."""
    weigh = s if weigh is None else weigh
    t, out = np.ones(len(c), np.int64), np.zeros(len(c))
    for k, at, n in pieces(c):
        j, before, opens = openings(key[k], at, n, s[k], d, t[k])
        first = np.cumsum(n) - n
        out[k] += np.add.reduceat(np.log(np.repeat(weigh[k], n) + j - d * before), first)
        t[k] = (before + opens)[first + n - 1]
    return t, out


class Dishes:
    """Seating of dishes with customers c: tables t (one where there is one customer, none where there is none), and for those
    with three customers or more the sweep and strength that drew them (two customers need no acceptance step). ``name``
    gives the random keys of dishes."""

    def __init__(self, name: Callable[[np.ndarray], np.ndarray], c: np.ndarray, sweep: np.ndarray | None = None, drawn: np.ndarray | None = None, t: np.ndarray | None = None):
        self.c, self.two, self.many = c, np.flatnonzero(c == 2), np.flatnonzero(c > 2)
        self.of_two, self.of_many = name(self.two), name(self.many)
        self.sweep = np.zeros(len(self.many), np.uint8) if sweep is None else sweep.copy()
        self.drawn = np.zeros(len(self.many), np.float32) if drawn is None else drawn.copy()
        self.t = np.minimum(c, 1)
        if t is not None:
            self.t[self.two], self.t[self.many] = t[: len(self.two)], t[len(self.two) :]

    def open(self) -> np.ndarray:
        """Tables of the dishes that have two customers or more."""
        return narrow(np.concatenate([self.t[self.two], self.t[self.many]]))

    def move(self, sweep: int, s: np.ndarray, d: float) -> None:
        s = np.maximum(s.astype(np.float32), np.float32(1e-30))
        two, m = self.two, self.many
        self.t[two], _ = seat(keyed(self.of_two, sweep), self.c[two], s[two].astype(float), d)
        if not len(m):
            return
        c, now = self.c[m], s[m].astype(float)
        t, new = seat(keyed(self.of_many, sweep), c, now, d)
        was, old = seat(keyed(self.of_many, self.sweep), c, self.drawn.astype(float), d, now)
        ok = np.log(uniform(keyed(self.of_many, sweep, 1))) < new - old
        self.t[m] = np.where(ok, t, was)
        self.sweep[ok], self.drawn[ok] = sweep, s[m[ok]]


# ---- rows between steps


def grouped(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(kind, origin, blob) of one destination after another from a sorted partition; the caller may empty the list."""
    last, rows = None, []
    for b in it:
        for dest, *x in zip(*(b.column(c).to_pylist() for c in ("dest", "kind", "origin", "blob")), strict=True):
            if rows and dest != last:
                yield last, rows
                rows = []
            last = dest
            rows.append(tuple(x))
    if rows:
        yield last, rows


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, dest, origin, blob, sums) in batches of bounded size."""
    types = dict(kind=pa.int32(), dest=pa.int64(), origin=pa.int64(), blob=pa.binary(), sums=pa.list_(pa.int64()))
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[3])
        if len(out) == 64 or size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types.values(), strict=True)], [*types])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types.values(), strict=True)], [*types])


def step(rows: DataFrame, parts: int, work: Callable[[int, list[tuple]], Iterator[tuple]], label: str) -> tuple[DataFrame, list[int]]:
    """Deal rows by destination, work on each destination, write what comes out; the sums of its scalars."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches(x for dest, got in grouped(it) for x in work(dest, got))

    out = materialize(deal_out(rows, parts).mapInArrow(run, ROW), label)
    some = out.where("sums is not null").agg(*(F.sum(F.get("sums", F.lit(i))) for i in range(6))).first()
    return out, [x or 0 for x in some]


def deal_out(rows: DataFrame, parts: int) -> DataFrame:
    """One destination after another, evenly over the partitions."""
    return rows.repartitionById(parts, F.pmod("dest", F.lit(parts)).cast("int")).sortWithinPartitions("dest", "kind", "origin")


def pick(df: DataFrame, kind: int) -> DataFrame:
    return df.where(F.col("kind") == kind)


#: Kinds of rows. Those of one destination arrive in this order.
STATE, VOCAB, TABLES, KEYS, REPLY, NUMBERS, ASKED, VALUES, SHARES, SUMS = range(10)


# ---- blocks of documents


class Vocabulary(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class Block:
    """Documents of one block, until it is written."""

    def __init__(self):
        self.vocab = Vocabulary({END: 0})
        self.docs: list[tuple[int | None, bool]] = []
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, doc: int | None, held: bool, text: str) -> None:
        words = text.encode().translate(LOWER).split()
        words.append(END)
        self.docs.append((doc, held))
        self.ids.append(np.fromiter(map(self.vocab.__getitem__, words), np.int32, len(words)))
        self.size += len(text)

    def rows(self, block: int, homes: int) -> Iterator[tuple]:
        """The documents as places in the block's list of words (by hash), and that list with training counts by home."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocab), U64, len(self.vocab))
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        word, lens = place[np.concatenate(self.ids)], np.array([len(x) for x in self.ids], np.int32)
        held = np.array([h for _, h in self.docs])
        ids = np.array([-1 if d is None else d for d, _ in self.docs], np.int64)
        flags = np.array([2 * (d is None) + h for d, h in self.docs], np.uint8)
        yield STATE, block, -1, packed(ids, flags, lens, place[:1], word), None
        count, h = np.bincount(word[np.repeat(~held, lens)], minlength=len(order)), hashes[order]
        cut = np.searchsorted(home(h >> U64(52), homes), np.arange(homes + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[k], cut[k + 1]
            yield VOCAB, k, block, packed(np.diff(h[a:b], prepend=U64(0)), narrow(count[a:b])), None


def home(slot: np.ndarray, homes: int) -> np.ndarray:
    return (slot.astype(np.int64) * homes) // SLOTS


def blocks(docs: DataFrame, homes: int, held) -> DataFrame:
    rows = id_text(docs).withColumn("held", held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def whole() -> Iterator[tuple]:
            n, open_ = 0, Block()
            for b in it:
                for doc, text, out in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "held")), strict=True):
                    open_.add(doc, out, text)
                    if open_.size >= BLOCK_BYTES:
                        yield from open_.rows((part << 24) + n, homes)
                        n, open_ = n + 1, Block()
            if open_.docs:
                yield from open_.rows((part << 24) + n, homes)

        return batches(whole())

    return rows.mapInArrow(run, ROW)


def number(dest: int, got: list[tuple]) -> Iterator[tuple]:
    """A home merges the lists of its words and numbers them: within a slot by falling count, so that frequent words have
    small numbers. Its state keeps words by slot and rank: sizes of slots and counts."""
    parts = [(o, *unpacked(b)) for _, o, b in got]
    got.clear()
    h = np.concatenate([np.cumsum(p[1], dtype=U64) for p in parts])
    names, at = distinct(h)
    count = np.bincount(at, np.concatenate([p[2] for p in parts]), len(names)).astype(np.int64)
    slot = (names >> U64(52)).astype(np.int64)
    order = np.lexsort((names, -count, slot))
    first = starts(slot[order])
    rank = np.arange(len(order)) - np.repeat(first, lengths(first, len(order)))
    num = np.empty(len(order), np.int64)
    num[order] = rank * SLOTS + slot[order]
    yield STATE, dest, -1, packed(steps(slot[order][first]), narrow(lengths(first, len(order))), narrow(count[order])), None
    for (o, *_), k in zip(parts, np.split(at, np.cumsum([len(p[1]) for p in parts])[:-1]), strict=True):
        yield NUMBERS, o, dest, packed(narrow(num[k]), narrow(count[k])), None
    yield SUMS, -1, dest, b"", [int(count.sum()), int((count > 0).sum())]


class Written:
    """A block's documents with the numbers and counts of its words."""

    def __init__(self, got: list[tuple]):
        self.ids, self.flags, self.lens, self.end, self.word = unpacked(got[0][2])
        parts = [unpacked(b) for k, _, b in got if k == NUMBERS]
        self.num = np.concatenate([p[0].astype(np.int64) for p in parts])
        self.count = np.concatenate([p[1].astype(np.int64) for p in parts])

    def keys(self, ranges: int, split: int) -> tuple[np.ndarray, ...]:
        """Distinct (range, context, word) of the tokens whose word and context are known, their training counts, and for
        each token its key (-1: none)."""
        word = self.word.astype(np.int64)
        prev = np.concatenate([self.end.astype(np.int64), word[:-1]])
        prev[np.cumsum(self.lens)[:-1]] = self.end[0]  # a text begins as after an end
        held = np.repeat((self.flags & 1) > 0, self.lens)
        order = np.argsort(self.num)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        known = (self.count[word] > 0) & (self.count[prev] > 0)
        v = len(order)
        pair, inv = distinct(rank[prev[known]] * v + rank[word[known]])
        u, w = order[pair // max(v, 1)], order[pair % max(v, 1)]
        n = np.bincount(inv[~held[known]], minlength=len(pair))
        r = range_of(self.num, np.zeros(1, np.int64), ranges)[u]
        hot = np.flatnonzero(self.count[u] >= split)
        part = keyed(self.num[w[hot]], 5) % (1 + self.count[u[hot]] // split).astype(U64)
        r[hot] = range_of(self.num[u[hot]], part, ranges)
        by = np.argsort(narrow_sort(r), kind="stable")
        back = np.empty(len(by), np.int64)
        back[by] = np.arange(len(by))
        key = np.full(len(word), -1)
        key[known] = back[inv]
        return r[by], self.num[u][by], self.num[w][by], n[by], key, word, prev


def range_of(u: np.ndarray, part: np.ndarray, ranges: int) -> np.ndarray:
    """Range of the keys of a context's part: 0, but in a context of ``split`` customers or more, which is dealt by word too."""
    return (keyed(u, part, 6) % U64(ranges)).astype(np.int64)


def pairs_packed(u: np.ndarray, w: np.ndarray, *more: np.ndarray) -> bytes:
    """Keys in order of context and word."""
    at = starts(u)
    first = np.zeros(len(u), bool)
    first[at] = True
    d = np.diff(w, prepend=0)
    d[first] = w[first]
    return packed(steps(u[at]), narrow(lengths(at, len(u))), narrow(d), *more)


def pairs_unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    du, n, d, *more = unpacked(blob)
    u, total, at = np.repeat(rising(du), n), np.cumsum(d, dtype=np.int64), np.cumsum(n, dtype=np.int64) - n
    return u, total - np.repeat(total[at] - d[at].astype(np.int64), n), more


# ---- contexts, in ranges


class Range:
    """Trained keys of one range, by context and word, and their seating. What never changes is written once."""

    def __init__(self, fixed: bytes, seating: bytes | None = None):
        self.fixed = fixed
        contexts, size, words, self.word, c = unpacked(fixed)
        self.contexts, self.words, self.size = rising(contexts), rising(words), size.astype(np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.context = np.repeat(np.arange(len(size)), self.size)
        sweep, drawn, *t = unpacked(seating) if seating else (None, None, None)
        self.kept = t[:-1]
        self.dishes = Dishes(lambda k: keyed(self.contexts[self.context[k]], self.words[self.word[k]]), c.astype(np.int64), sweep, drawn, t[-1])

    @staticmethod
    def merged(blobs: list[bytes]) -> Range:
        parts = []
        while blobs:  # each is given up as it is read
            u, w, (n, *_) = pairs_unpacked(blobs.pop(0))
            k = n > 0
            parts.append((u[k], w[k], n[k].astype(np.int64)))
        u, w, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        contexts, most = np.unique(u), int(w.max(initial=0)) + 1
        pair = np.searchsorted(contexts, u) * most + w
        order = np.argsort(pair, kind="stable")  # the parts are sorted runs
        pair = pair[order]
        at = starts(pair)
        c = np.add.reduceat(n[order], at) if len(at) else n
        context, w = np.divmod(pair[at], most)
        words, word = distinct(w)
        return Range(packed(steps(contexts), narrow(np.bincount(context, minlength=len(contexts))), steps(words), narrow(word), narrow(c)))

    @staticmethod
    def read(blob: bytes) -> Range:
        n = int.from_bytes(blob[:8], "little")
        return Range(blob[8 : 8 + n], blob[8 + n :])

    def written(self, keep: bool) -> bytes:
        d = self.dishes
        return b"".join([len(self.fixed).to_bytes(8, "little"), self.fixed, packed(d.sweep, d.drawn, *self.kept, *[d.open()] * (1 + keep))])

    def seatings(self) -> list[np.ndarray]:
        """Tables by key of the sweeps that are averaged."""
        out = []
        for t in self.kept:
            x = np.minimum(self.dishes.c, 1)
            x[self.dishes.two], x[self.dishes.many] = t[: len(self.dishes.two)], t[len(self.dishes.two) :]
            out.append(x)
        return out

    def tables(self) -> np.ndarray:
        """By context."""
        return np.add.reduceat(self.dishes.t, self.at) if len(self.at) else np.zeros(0, np.int64)

    def messages(self, origin: int, homes: int) -> Iterator[tuple]:
        """To each home: tables by word and by context."""
        sent = (self.words, np.bincount(self.word, self.dishes.t, len(self.words)).astype(np.int64)), (self.contexts, self.tables())
        cols = []
        for num, x in sent:
            h = home(num % SLOTS, homes)
            by = np.argsort(h, kind="stable")
            cols.append((num[by], x[by], np.searchsorted(h[by], np.arange(homes + 1))))
        for k in range(homes):
            (w, tw, cw), (u, tu, cu) = cols
            a, b, e, f = cw[k], cw[k + 1], cu[k], cu[k + 1]
            if a < b or e < f:
                yield TABLES, k, origin, packed(steps(w[a:b]), narrow(tw[a:b]), steps(u[e:f]), narrow(tu[e:f])), None

    def draw(self, sweep: int, shape: Shape, parent: Parent, weight: np.ndarray, tables: np.ndarray) -> None:
        """One sweep, given the parent's weights by word and the tables by context."""
        aux = gamma(keyed(self.contexts, sweep, 2), THETA / shape.discount + tables)
        g0 = (weight.astype(float) + parent.rest / (shape.words + 1)) / (parent.weight + parent.rest)
        self.dishes.move(sweep, shape.discount * np.repeat(aux, self.size) * g0[self.word], shape.discount)


class Shape:
    """Corpus-wide scalars of the counts."""

    def __init__(self, tokens: int, words: int, n1: int, n2: int, top1: int, top2: int):
        discount = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
        self.tokens, self.words = tokens, words
        self.discount, self.top_discount = discount(n1, n2), discount(top1, top2)


class Parent:
    """Corpus-wide scalars of the unigram restaurant after a sweep: customers, tables, the sum of its words' weights, and the
    weight of what it has not served."""

    def __init__(self, sweep: int, shape: Shape, customers: int, tables: int, weight: int):
        self.customers, self.tables, self.weight = customers, tables, weight / FIXED
        strength = np.array([THETA + shape.top_discount * tables])
        self.rest = float(gamma(keyed(np.array([sweep]), 3), strength)[0])


# ---- words, in homes


class Home:
    """Words of one home by slot and rank."""

    def __init__(self, blob: bytes):
        slots, size, count, *more = unpacked(blob)
        self.slots, self.size, self.count = rising(slots), size.astype(np.int64), count
        self.begin = np.zeros(SLOTS, np.int64)
        self.begin[self.slots] = np.cumsum(self.size) - self.size
        self.num = (np.arange(len(count)) - np.repeat(self.begin[self.slots], self.size)) * SLOTS + np.repeat(self.slots, self.size)
        self.root, self.kept = more[:3], more[3:]

    def place(self, num: np.ndarray) -> np.ndarray:
        return self.begin[num % SLOTS] + num // SLOTS

    def written(self, root: list[np.ndarray], kept: list[np.ndarray]) -> bytes:
        return packed(steps(self.slots), narrow(self.size), self.count, *root, *kept)


def predictive(shape: Shape, parent: Parent, cw: np.ndarray, tw: np.ndarray) -> np.ndarray:
    """Probability of words in the unigram restaurant."""
    back = THETA + shape.top_discount * parent.tables
    return (np.maximum(cw - shape.top_discount * tw, 0) + back / (shape.words + 1)) / (THETA + parent.customers)


def seat_parent(sweep: int, shape: Shape | None, parent: Parent | None, keep: bool, split: int) -> Callable[[int, list[tuple]], Iterator[tuple]]:
    """A home's part of a sweep: gather tables, seat the words (not before the first sweep, when all have one table), draw their
    Dirichlet weights, reply to the ranges. ``keep`` stores tables by word and context of the last sweep."""

    def work(dest: int, got: list[tuple]) -> Iterator[tuple]:
        h = Home(got[0][2])
        cw, tu, sent = np.zeros(len(h.count), np.int64), np.zeros(len(h.count), np.int64), []
        for kind, o, b in got[1:]:
            w, t, u, x = unpacked(b)
            w, u = h.place(rising(w)), h.place(rising(u))
            cw[w] += t
            tu[u] += x
            sent.append((o, w, u))
        if shape is None:
            yield SUMS, -1, dest, b"", [int((cw == 1).sum()), int((cw == 2).sum())]
            return
        old = Dishes(lambda k: keyed(h.num[k], 4), cw)
        if h.root:  # the customers have changed: a dish goes on from what its last draw gives for them
            old.sweep, old.drawn = h.root[1][old.many], h.root[2][old.many]
        if parent is not None:
            aux = gamma(keyed(np.array([sweep]), 7), np.array([THETA / shape.top_discount + parent.tables]))
            old.move(sweep, np.repeat(shape.top_discount * aux / (shape.words + 1), len(cw)), shape.top_discount)
        sweeps, drawn = np.zeros(len(cw), np.uint8), np.zeros(len(cw), np.float32)
        sweeps[old.many], drawn[old.many] = old.sweep, old.drawn
        root = [narrow(cw), sweeps, drawn]
        weight = np.zeros(len(cw), np.float32)
        some = np.flatnonzero(cw)
        weight[some] = gamma(keyed(h.num[some], sweep, 8), cw[some] - shape.top_discount * old.t[some])
        kept = [*h.kept, *([narrow(cw), narrow(old.t), narrow(tu)] if keep else [])]
        yield STATE, dest, -1, h.written(root, kept), None
        yield SUMS, -1, dest, b"", [int(cw.sum()), int(old.t.sum()), int(np.rint(weight.astype(float) * FIXED).astype(np.int64).sum())]
        for o, w, u in sent:
            hot = h.count[u] >= split
            yield REPLY, o, dest, packed(steps(h.num[w]), weight[w], steps(h.num[u[hot]]), narrow(tu[u[hot]])), None

    return work


def score_documents(docs: DataFrame, held=None, split: int = SPLIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document. ``held`` marks rows
    that are scored but not learnt from (default: crc32(doc_id as text) mod 7 is 2)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a home holds the words of at least HOME_BYTES of input and a range LEAST_TOKENS, so that messages are not many and tiny
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    homes = max(1, min(n, SLOTS, size // HOME_BYTES))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)) if held is None else held
    read = materialize(blocks(docs, homes, held), "lm-texts")
    named, (tokens, words, *_) = step(pick(read, VOCAB), homes, number, "lm-words")
    ranges = max(1, min(n, tokens // LEAST_TOKENS), tokens // RANGE_TOKENS)

    def deal(dest: int, got: list[tuple]) -> Iterator[tuple]:
        r, u, w, c, *_ = Written(got).keys(ranges, split)
        cut = np.searchsorted(r, np.arange(ranges + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            a, e = cut[k], cut[k + 1]
            yield KEYS, k, dest, pairs_packed(u[a:e], w[a:e], narrow(c[a:e])), None

    texts, numbers = pick(read, STATE), pick(named, NUMBERS)
    dealt, _ = step(texts.unionAll(numbers), n, deal, "lm-keys")

    def merge(dest: int, got: list[tuple]) -> Iterator[tuple]:
        r = Range.merged([b for *_, b in got])
        yield STATE, dest, -1, r.written(False), None
        yield SUMS, -1, dest, b"", [int((r.dishes.c == 1).sum()), int((r.dishes.c == 2).sum())]
        yield from r.messages(dest, homes)

    state, (n1, n2, *_) = step(pick(dealt, KEYS), ranges, merge, "lm-counts")
    served = pick(named, STATE).unionAll(pick(state, TABLES))
    counted, (top1, top2, *_) = step(served, homes, seat_parent(0, None, None, False, split), "lm-parent")
    shape = Shape(tokens, words, n1, n2, top1, top2)
    home_state, sums = step(served, homes, seat_parent(0, shape, None, False, split), "lm-parent")
    discard(counted)
    parents: list[Parent] = []
    for sweep in range(1, SWEEPS + 1):
        parent = Parent(sweep, shape, *sums[:3])
        keep = sweep > SWEEPS - KEPT

        def seat_contexts(dest: int, got: list[tuple], sweep=sweep, parent=parent, keep=keep) -> Iterator[tuple]:
            r = Range.read(got[0][2])
            weight, tables = np.zeros(len(r.words), np.float32), r.tables()
            for kind, o, b in got[1:]:
                w, g, u, x = unpacked(b)
                weight[np.searchsorted(r.words, rising(w))] = g
                tables[np.searchsorted(r.contexts, rising(u))] = x
            r.draw(sweep, shape, parent, weight, tables)
            yield STATE, dest, -1, r.written(keep), None
            yield from r.messages(dest, homes)

        new, _ = step(pick(state, STATE).unionAll(pick(home_state, REPLY)), ranges, seat_contexts, "lm-contexts")
        discard(state)
        state = new
        new, sums = step(pick(home_state, STATE).unionAll(pick(state, TABLES)), homes, seat_parent(sweep, shape, parent, keep, split), "lm-parent")
        discard(home_state)
        home_state = new
        if keep:
            parents.append(Parent(sweep, shape, *sums[:3]))

    def answer_keys(dest: int, got: list[tuple]) -> Iterator[tuple]:
        r = Range.read(got.pop(0)[2])
        values, num = [r.dishes.c, *r.seatings()], r.words[r.word]
        most = int(r.words.max(initial=0)) + 1
        own = r.context * most + num
        while got:
            _, o, b = got.pop(0)
            u, w, _ = pairs_unpacked(b)
            if not len(own):
                yield VALUES, o, dest, packed(*[np.zeros(len(u), np.uint32)] * (1 + KEPT)), None
                continue
            context = np.minimum(np.searchsorted(r.contexts, u), len(r.contexts) - 1)
            at = np.minimum(np.searchsorted(own, context * most + w), len(own) - 1)
            hit = (r.contexts[r.context[at]] == u) & (num[at] == w)
            yield VALUES, o, dest, packed(*(narrow(np.where(hit, x[at], 0)) for x in values)), None

    def answer_words(dest: int, got: list[tuple]) -> Iterator[tuple]:
        h = Home(got.pop(0)[2])
        by_sweep = list(zip(parents, h.kept[::3], h.kept[1::3], h.kept[2::3], strict=True))
        shares = [predictive(shape, p, cw.astype(float), tw).astype(np.float32) for p, cw, tw, _ in by_sweep]
        while got:
            _, o, b = got.pop(0)
            k = h.place(unpacked(b)[0].astype(np.int64))
            yield SHARES, o, dest, packed(*(x[k] for x in shares), *(narrow(tu[k]) for *_, tu in by_sweep)), None

    asked = numbers.select(F.lit(ASKED).alias("kind"), F.col("origin").alias("dest"), F.col("dest").alias("origin"), "blob", "sums")
    values, _ = step(pick(state, STATE).unionAll(pick(dealt, KEYS)), ranges, answer_keys, "lm-values")
    shares, _ = step(pick(home_state, STATE).unionAll(asked), homes, answer_words, "lm-shares")
    discard(dealt, state, home_state)

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, got in grouped(it):
            b = Written(got)
            own = [np.concatenate(x) for x in zip(*(unpacked(v) for k, _, v in got if k == VALUES), strict=True)] or [np.zeros(1, np.uint32)] * (1 + KEPT)
            word_values = [np.concatenate(x) for x in zip(*(unpacked(v) for k, _, v in got if k == SHARES), strict=True)]
            got.clear()
            *_, key, word, prev = b.keys(ranges, split)
            p, seated = np.zeros(len(word)), np.zeros(len(own[0]))
            for share, tables, t in zip(word_values[:KEPT], word_values[KEPT:], own[1:], strict=True):
                seated += np.maximum(own[0] - shape.discount * t, 0)
                p += (THETA + shape.discount * tables)[prev] * share.astype(float)[word]
            p += np.append(seated, 0)[key]  # key -1 finds the last one
            logp = np.log10(p / (KEPT * (THETA + b.count))[prev])
            count = b.count[word]
            base = np.log10((b.count + 1) / (tokens + words + 1))[word]
            at = np.cumsum(b.lens) - b.lens
            cols = [
                pa.array(b.ids, mask=(b.flags & 2) > 0),
                pa.array((b.flags & 1) > 0),
                pa.array(b.lens.astype(np.int64)),
                pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                pa.array(np.full(len(b.ids), tokens, np.int64)),
                pa.array(np.add.reduceat(base, at)),
                pa.array(np.add.reduceat(logp, at)),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = texts.unionAll(numbers).unionAll(pick(values, VALUES)).unionAll(pick(shares, SHARES))
    return deal_out(rows, n).mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
