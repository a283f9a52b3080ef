"""Quality rules by line-sequence labelling.

A two-state linear-chain conditional random field (content / boilerplate) reads one bit mask of line
features per line; Viterbi decoding labels the lines, and the share of words in content lines decides
whether a document stays. The field is trained on ``labels``: the lines of at most ``TRAIN_DOCS``
labelled documents (the smallest hashes of doc_id; all lines of each) carry their document's label. Without usable labels the documented ``DEFAULT`` weights hold.

Null and empty texts have no words and fail the base rule. Repeated rows give repeated rows; an empty
table gives an empty result; only doc_id and text are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import SPACES, id_text, sample_by_hash, small_batches

TRAIN_DOCS, EPOCHS, TURNS, RIDGE = 3000, 40, 2, 2e-3
#: Lines of one training sequence.
TRAIN_LINES = 2000
#: Least share of words in content lines, and the window of the repetition rule.
MIN_SHARE, WINDOW = 0.5, 8
SYMBOLS = b"#*$%&|<>"
UPPERS = bytes(range(65, 91))
FEATURES = ("short", "medium", "symbols", "many_symbols", "upper", "digits", "repeats", "duplicate", "no_stop", "shouts")
N = len(FEATURES)
#: Emission weights of the content state when there is nothing to learn from (bias first), and the transitions.
DEFAULT = (np.array([2.0, -0.2, 0.0, -2.0, -3.0, -3.0, -0.5, -3.0, -1.0, -0.2, -2.0]), np.array([[0.5, 0.0], [0.0, 0.5]]))

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def line_mask(line: bytes, words: list[bytes], seen: bool) -> int:
    n, size = len(words), len(line) or 1
    sym = len(line) - len(line.translate(None, SYMBOLS))
    up = len(line) - len(line.translate(None, UPPERS))
    dig = len(line) - len(line.translate(None, b"0123456789"))
    return (
        (n < 3)
        | (3 <= n < 8) << 1
        | (sym * 50 > size) << 2
        | (sym * 10 > size) << 3
        | (up * 3 > size) << 4
        | (dig * 5 > size) << 5
        | (n >= 4 and len(set(words)) * 2 < n) << 6
        | seen << 7
        | (line.rstrip(SPACES)[-1:] not in (b".", b"?", b"!", b"")) << 8
        | (line.count(b"!!") * 3 > n) << 9
    )


def line_masks(raw: bytes) -> tuple[list[int], list[int], int]:
    """Masks and word counts of the lines that have a word, and how many of them repeat an earlier line."""
    masks, counts, seen, dup = [], [], set(), 0
    for line in raw.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            masks.append(line_mask(line, words, again))
            counts.append(len(words))
    return masks, counts, dup


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words covered by k-word windows that occur twice or more (64-bit window fingerprints)."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    d: dict[bytes, int] = {}
    ids = np.fromiter([d.setdefault(w, len(d)) for w in words], np.uint64, len(words))
    if len(d) == len(words):
        return 0
    ids = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    ids ^= ids >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * np.uint64(0xBF58476D1CE4E5B9) + ids[j : j + n]
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def viterbi(masks: list[int], emit: list[float], trans: list[list[float]]) -> list[int]:
    """1 for content; none for no lines. emit: score of content over boilerplate by mask; ties go to content."""
    if not masks:
        return []
    (bb, bc), (cb, cc) = trans
    back, b, c = [], 0.0, emit[masks[0]]
    for m in masks[1:]:
        fb, fc = c + cb > b + bb, c + cc >= b + bc
        b, c = (c + cb if fb else b + bb), (c + cc if fc else b + bc) + emit[m]
        back.append((fb, fc))
    s = int(c >= b)
    out = [s]
    for fb, fc in reversed(back):
        s = int(fc if s else fb)
        out.append(s)
    return out[::-1]


def padded(masks: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines there are, and their features (bias first)."""
    L = max(map(len, masks))
    on, bits = np.zeros((len(masks), L)), np.zeros((len(masks), L), int)
    for i, m in enumerate(masks):
        on[i, : len(m)], bits[i, : len(m)] = 1, m
    return on, np.concatenate([np.ones((len(masks), L, 1)), (bits[:, :, None] >> np.arange(N)) & 1], 2) * on[:, :, None]


def marginals(on: np.ndarray, X: np.ndarray, w: np.ndarray, A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of content for each line, and of each pair of labels for neighbours, by forward and backward sums."""
    pair = on[:, 1:] * on[:, :-1]
    e = np.stack([np.zeros_like(on), X @ w], 2)
    L = on.shape[1]
    alpha, beta = np.zeros((len(on), L, 2)), np.zeros((len(on), L, 2))
    alpha[:, 0] = e[:, 0]
    for t in range(1, L):
        s = np.logaddexp.reduce(alpha[:, t - 1, :, None] + A, 1) + e[:, t]
        alpha[:, t] = np.where(on[:, t, None] > 0, s, alpha[:, t - 1])
    for t in range(L - 2, -1, -1):
        s = np.logaddexp.reduce(A[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        beta[:, t] = np.where(on[:, t + 1, None] > 0, s, 0)
    z = np.logaddexp.reduce(alpha[:, -1], 1)
    p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * on
    return p1, np.exp(alpha[:, :-1, :, None] + A + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]


def gradient(on: np.ndarray, X: np.ndarray, y: np.ndarray, share: np.ndarray, w: np.ndarray, A: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the conditional log likelihood of the lines' labels ``y``, by emission weights and transitions."""
    p1, pp = marginals(on, X, w, A)
    gw = np.einsum("ij,ijk,i->k", (y - p1) * on, X, share)
    seen = np.stack([1 - y, y], 2) * on[:, :, None]
    return gw, np.einsum("ita,itb,i->ab", seen[:, :-1], seen[:, 1:], share) - np.einsum("itab,i->ab", pp, share)


def line_labels(p: np.ndarray, on: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines from their probabilities: at least half of a good document's lines are content, fewer than half of a bad one's."""
    n = on.sum(1).astype(int)
    y = (p >= 0.5) * on
    rank = np.argsort(np.argsort(np.where(on > 0, -p, np.inf), axis=1, kind="stable"), axis=1, kind="stable")  # 0 for the surest content
    y = np.where(good[:, None], np.maximum(y, rank < np.ceil(n / 2)[:, None]), np.minimum(y, rank < np.floor((n - 1) / 2)[:, None]))
    return y * on


def ascend(parts: list[tuple], w: np.ndarray, A: np.ndarray, chain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent on the conditional likelihood with steps scaled per weight; without ``chain`` lines are judged alone."""
    mw, mA, vw, vA = np.zeros_like(w), np.zeros_like(A), np.zeros_like(w), np.zeros_like(A)
    for step in range(1, EPOCHS + 1):
        grads = [gradient(*part, w, A) for part in parts]
        gw, gA = sum(g for g, _ in grads) - RIDGE * w, sum(g for _, g in grads) - RIDGE * A
        for p, g, m, v in ((w, gw, mw, vw), (A, gA, mA, vA))[: 1 + chain]:
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return w, A


def fit_crf(rows: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights (bias first) and transitions; the labels of lines and the weights are found by turns."""
    # a very long text is several sequences, so that the steps of a pass are bounded
    rows = [(m[i : i + TRAIN_LINES], y) for m, y in rows for i in range(0, len(m), TRAIN_LINES)]
    if len({y for _, y in rows}) < 2:
        return DEFAULT
    lens, y = np.array([len(m) for m, _ in rows]), np.array([y for _, y in rows])
    # both classes weigh the same, and long documents no more than short ones
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) / np.sqrt(lens)
    share /= share.sum()
    # rows of like length are padded together, so that one long text does not lengthen all
    sizes = np.maximum(6, np.ceil(np.log2(lens)).astype(int))
    parts = [(*padded([rows[i][0] for i in k]), y[k] == 1, share[k]) for k in (np.flatnonzero(sizes == z) for z in np.unique(sizes))]
    whole = [(on, X, np.repeat(good[:, None], on.shape[1], 1) * on, s) for on, X, good, s in parts]
    w, A = ascend(whole, np.zeros(N + 1), np.zeros((2, 2)), chain=False)
    for _ in range(TURNS):
        latent = [(on, X, line_labels(marginals(on, X, w, A)[0], on, good), s) for on, X, good, s in parts]
        w, A = ascend(latent, w, A)
    return w, A


def training_rows(docs: DataFrame, labels: DataFrame) -> list[tuple[list[int], int]]:
    """Line masks of the bounded sample; the sample's ids have a fixed bound and are broadcast."""
    marked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("y"))
    picked = F.broadcast(sample_by_hash(marked, "doc_id", TRAIN_DOCS))

    def masks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [line_masks(t.encode())[0] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.list_(pa.int32()))], ["doc_id", "y", "masks"])

    rows = id_text(docs).join(picked, "doc_id").mapInArrow(masks, "doc_id long, y int, masks array<int>")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "masks").limit(TRAIN_DOCS).collect()  # cut before it is collected
    return [(r.masks, r.y) for r in sorted(rows, key=lambda r: (r.doc_id, r.masks))]


def verdict(text: str, emit: list[float], trans: list[list[float]]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    masks, counts, dup = line_masks(raw)
    rep = repeated_words(words)
    failed = n < 20 or 100 * rep > 30 * n
    share = sum(c for c, s in zip(counts, viterbi(masks, emit, trans), strict=True) if s) / n if n else 0.0
    return n, len(text) - sum(text.count(chr(c)) for c in SPACES), len(raw) - len(raw.translate(None, SYMBOLS)), dup, rep, failed, not failed and share >= MIN_SHARE, share


def score_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Base counts, the field's content share and the verdict of every document; one narrow pass."""
    w, A = model
    bits = (np.arange(1 << N)[:, None] >> np.arange(N)) & 1
    emit, trans = (w[0] + bits @ w[1:]).tolist(), A.tolist()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows.append((doc, *verdict(text, emit, trans)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return id_text(docs).mapInArrow(run, SCHEMA)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score_quality(docs, fit_crf(training_rows(docs, labels)))


def keep_quality(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns whatever they are called; one narrow pass. Null and empty
    texts go, as they fail the base rule; of repeated rows all stay or all go; an empty table stays empty."""
    w, A = model
    bits = (np.arange(1 << N)[:, None] >> np.arange(N)) & 1
    emit, trans = (w[0] + bits @ w[1:]).tolist(), A.tolist()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            kept = [t is not None and verdict(t, emit, trans)[-2] for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(kept, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
