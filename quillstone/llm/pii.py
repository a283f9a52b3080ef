"""Personal data by weak supervision.

The fixed patterns (email, ip, card, phone) give base spans. Besides, every ASCII token that holds a digit or that a credential
word introduces, of any length, is a candidate for kind ``secret`` where no base span touches it. Six labelers vote on it (1 private, 0
not, 2 abstains): known shapes of keys, a gazetteer of credential words before it, whether it is assigned and to what name, mixture of
digits and letters, likeness to a plain word, and prose around it. Expectation-maximisation over the vote patterns of the whole corpus
estimates how reliable each labeler is when it votes (an abstention says nothing), and a logistic span classifier over votes and shape
features is trained on the resulting posteriors; it alone decides. The mask of a candidate has a fixed number of bits, so the
pattern table that reaches the driver is bounded whatever the corpus.

Null and empty texts have no spans. Repeated rows give repeated rows, an empty table an empty result;
only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import id_text, materialize

KINDS = ("email", "ip", "card", "phone")
# possessive repeats and a look-behind keep the scans linear; they match what the plain patterns match
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, TAIL = re.compile("[0-9]"), re.compile("[A-Za-z0-9_]*")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")

#: Words that introduce a credential.
GAZETTEER = re.compile(r"(?:password|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|ssn|iban)[^A-Za-z0-9]{0,6}\Z", re.I)
KEY_SHAPES = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|[0-9a-f]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|sk_[A-Za-z0-9]{16,}|[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
LABELERS = ("regex", "gazetteer", "assignment", "mixture", "wordlike", "prose")
SHAPES = ("len6", "len12", "len16", "len24", "digits20", "digits50", "upper50", "lower_hex")
#: A token that a credential word introduces, whatever it is made of.
INTRODUCED = re.compile(GAZETTEER.pattern.removesuffix("{0,6}\\Z") + "{1,6}([A-Za-z0-9_]+)", re.I)
ASSIGNED = re.compile(r"[=:][ \t]{0,3}[\"']?\Z")
PLAIN_WORD = re.compile(r"[A-Za-z_]+[0-9]{0,4}|[0-9]+")
BITS = 2 * len(LABELERS) + len(SHAPES)

SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, cands array<struct<start:int,end:int,mask:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: the local part reaches back to the last match's end."""
    out, floor = [], 0
    for m in DOMAIN.finditer(text):
        at = i = m.start()
        while i > floor and text[i - 1] in LOCAL:
            i -= 1
        if i < at:
            out.append((i, m.end()))
            floor = m.end()
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        d = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out["phone"].append(m.span())
    return out


def candidate_mask(text: str, s: int, e: int) -> int:
    """Two bits per labeler (vote), one per shape feature."""
    t = text[s:e]
    n, digits, ups = len(t), sum("0" <= c <= "9" for c in t), sum("A" <= c <= "Z" for c in t)
    before, after = text[max(0, s - 24) : s], text[e : e + 1]
    runs = len(re.findall(r"[0-9]+|[A-Za-z_]+", t))
    assigned, named = bool(ASSIGNED.search(before)), bool(GAZETTEER.search(before))
    votes = (
        1 if KEY_SHAPES.fullmatch(t) and 0 < digits < n else 0 if digits == n else 2,
        1 if named else 2,
        (1 if named else 0) if assigned else 0 if named else 2,
        1 if n >= 14 and runs >= 4 else 0 if runs <= 2 else 2,
        0 if PLAIN_WORD.fullmatch(t) else 2,
        0 if not assigned and before[-1:] in ("", " ", "\n") and after in ("", " ", "\n", ".", ",", ";") else 2,
    )
    shapes = (n >= 6, n >= 12, n >= 16, n >= 24, digits * 5 >= n, digits * 2 >= n, ups * 2 >= n, bool(re.fullmatch("[0-9a-f]+", t)))
    mask = 0
    for i, v in enumerate(votes):
        mask |= v << (2 * i)
    for i, v in enumerate(shapes):
        mask |= bool(v) << (2 * len(votes) + i)
    return mask


def candidates(text: str, taken: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """Tokens with a digit and tokens that a credential word introduces, in order, where no base span touches them."""
    used = sorted(x for v in taken.values() for x in v)
    found, at = [], 0
    while m := DIGIT.search(text, at):
        s = m.start()
        while s > at and text[s - 1] in TOKEN:
            s -= 1
        at = TAIL.match(text, m.start()).end()
        found.append((s, at))
    found = sorted({*found, *((m.start(1), m.end(1)) for m in INTRODUCED.finditer(text))})
    out, k, reach = [], 0, 0
    for s, e in found:
        while k < len(used) and used[k][0] < e:
            reach = max(reach, used[k][1])
            k += 1
        if reach <= s and (not out or out[-1][1] <= s):
            out.append((s, e, candidate_mask(text, s, e)))
    return out


def extract(docs: DataFrame) -> DataFrame:
    """Base spans and voted candidates of every document; one narrow pass over the texts."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ns, shas, bases, cands = [[] for _ in KINDS], [], [], []
            for text in b.column("text").to_pylist():
                spans = base_spans(text)
                joined = ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])
                for i, k in enumerate(KINDS):
                    ns[i].append(len(spans[k]))
                bases.append(joined)
                shas.append(hashlib.sha256(joined.encode()).hexdigest())
                cands.append([{"start": s, "end": e, "mask": m} for s, e, m in candidates(text, spans)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("mask", pa.int32())]))
            cols = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in ns), pa.array(shas, pa.string()), pa.array(bases, pa.string()), pa.array(cands, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "cands"])

    return id_text(docs).mapInArrow(run, SCHEMA)


def estimate(masks: np.ndarray, counts: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns: posterior of 'private' by pattern, labeler confusion [labeler, class, vote], prior.

    The start is a belief that labelers are better than chance, worth a tenth of the votes or so; it also breaks the symmetry. Labelers that
    only ever vote one way are told from each other by whom they agree with.
    """
    votes = np.stack([(masks >> (2 * i)) & 3 for i in range(len(LABELERS))], 1)
    prior_counts = np.zeros((len(LABELERS), 2, 3))
    prior_counts[:, 0, :2], prior_counts[:, 1, :2] = (4, 1), (1, 4)
    prior_counts *= max(1.0, counts.sum() / 40)
    conf, prior = prior_counts / prior_counts.sum(2, keepdims=True), np.array([0.5, 0.5])
    post = np.full(len(masks), 0.5)
    for _ in range(rounds):
        ll = np.log(prior)[None] + sum(np.where(votes[:, i, None] < 2, np.log(conf[i][:, np.minimum(votes[:, i], 1)]).T, 0.0) for i in range(len(LABELERS)))
        post = 1 / (1 + np.exp(np.clip(ll[:, 0] - ll[:, 1], -50, 50)))
        for i in range(len(LABELERS)):
            for c, r in ((0, counts * (1 - post)), (1, counts * post)):
                conf[i, c] = prior_counts[i, c] + np.bincount(votes[:, i], r, 3) * (1, 1, 0)
        conf /= conf.sum(2, keepdims=True)
        p = (counts @ post + 2) / (counts.sum() + 4)
        prior = np.array([1 - p, p])
    return post, conf, prior


def design(masks: np.ndarray) -> np.ndarray:
    votes = [((masks >> (2 * i)) & 3) == v for i in range(len(LABELERS)) for v in (0, 1)]
    shapes = [(masks >> (2 * len(LABELERS) + i)) & 1 for i in range(len(SHAPES))]
    return np.stack([np.ones(len(masks)), *votes, *shapes], 1).astype(float)


def train_classifier(masks: np.ndarray, post: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Logistic regression on the posteriors, by Newton steps with a ridge."""
    X, w = design(masks), np.zeros(1 + 2 * len(LABELERS) + len(SHAPES))
    weight = counts / max(1.0, counts.sum())
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        g = X.T @ (weight * (post - p)) - 1e-4 * w
        h = (X * (weight * p * (1 - p))[:, None]).T @ X + 1e-4 * np.eye(len(w))
        w = w + np.linalg.solve(h, g)
    return w


def private_masks(found: DataFrame) -> set[int]:
    """The candidate masks that the trained classifier calls private."""
    rows = found.select(F.explode("cands.mask").alias("mask")).groupBy("mask").count().collect()
    if not rows:
        return set()
    rows.sort()
    masks, counts = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    post, _, _ = estimate(masks, counts)
    w = train_classifier(masks, post, counts)
    return set(masks[design(masks) @ w > 0].tolist())


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, base counts and digest, all spans (kind:start:end), and the number of spans added."""
    found = materialize(extract(docs), "pii")
    masks = sorted(private_masks(found))
    keep = F.filter("cands", lambda c: c["mask"].isin(masks)) if masks else F.filter("cands", lambda c: F.lit(False))
    more = F.transform(keep, lambda c: F.concat(F.lit("secret:"), c["start"], F.lit(":"), c["end"]))
    spans = F.array_join(F.concat(F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.array("base")), more), ",")
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", spans.alias("spans"), F.size(keep).cast("long").alias("n_secret"))


def redact(docs: DataFrame, kinds: tuple[str, ...] = (*KINDS, "secret")) -> DataFrame:
    """``docs`` with each private span's text replaced by its kind in angle brackets and n_chars updated.

    Texts are read twice and never shuffled: the first pass only counts vote patterns. Every row stays, with all its columns
    whatever they are called; null texts stay null, empty ones empty, repeated rows repeated, and an empty table stays empty.
    """
    masks = private_masks(materialize(extract(docs).select("cands"), "pii-votes"))
    schema = docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for text in b.column("text").to_pylist():
                if text:
                    spans = base_spans(text)
                    marks = [(s, e, k) for k in KINDS for s, e in spans[k]]
                    marks += [(s, e, "secret") for s, e, m in candidates(text, spans) if m in masks]
                    parts, at = [], 0
                    for s, e, k in sorted(x for x in marks if x[2] in kinds):
                        if e <= at:
                            continue
                        if s >= at:
                            parts += [text[at:s], f"<{k.upper()}>"]
                        at = e
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
