"""Conversation structure repair: A* on the edit lattice of each conversation.

``repair`` takes conversations as they are; ``damage`` makes the faults of the contract's query first. Rows of a conversation
go by turn (nulls first), then role, then the digest of the text. A row's first fault counts: blank, duplicate (role and text
seen earlier), truncated (does not end in one of ``.!?``). Edits and costs: keep 0, give another role 3, delete 4 (required for blank
and duplicate rows), insert an empty row 3; a truncated row that stays adds 3. The cheapest edits win whose role initials are
``(s?(ua)+)?``; among those the ASCII-least initials of the edits (the audit).

The lattice has a node for each place between rows and state of the role pattern. A* visits nodes by (cost + heuristic, audit);
the heuristic is the suffix sum of required deletions and of the charge that a truncated row costs whatever is done with
it, so it never exceeds the true cost and never falls by more than an edge costs: a node's first visit is its best.

How it is distributed: equal rows are counted before the shuffle, first occurrences come from an aggregate, rows are dealt by ranges
of (conversation, turn), so one conversation may lie in many tasks. Each task cuts its rows into segments of at most
``SEGMENT_ROWS`` or ``SEGMENT_BYTES``. A conversation inside one task is finished there. Of others each segment is
solved from every state of the pattern to every other, in parallel; the segments then pass one task in order, which only
chains those results and feeds the digest (a digest of a whole conversation is sequential by nature), holding one segment and
a letter a row.

Nulls in role and text are one space (a role that starts with no letter of the pattern can't be kept); an empty role has no initial
and can't be kept either. A null conv_id is a conversation of its own, a null turn counts in no gap. Repeated rows are
duplicates. Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import join_groups, materialize, small_batches

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SEGMENT_ROWS, SEGMENT_BYTES = 256, 1 << 20
#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row. The first and the last may end it.
NONE, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = range(4), (NONE, ASSISTANT)
STEPS = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = {"su", "ua", "au"}
ROLE_AFTER = {NONE: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
STATE_OF = {"user": USER, "assistant": ASSISTANT}
#: Faults of a row; a row has one at most.
FINE, BLANK, DUPLICATE, CUT = range(4)

COUNTS = "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, turns long, first_turn long, last_turn long"
PIECE = f"known boolean, cid long, part int, seq int, whole boolean, {COUNTS}, cost long, audit string, repaired_sha256 string, roles array<string>, texts array<string>, kinds array<int>, copies array<long>, costs array<long>, audits array<string>"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that crc32 of ``conv_id:turn`` deals, and ``copies``: 0 drops a row but leaves its conversation, 2 repeats it."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    x = x.withColumn("_d", F.crc32(F.concat_ws(":", name("conv_id"), name("turn"))) % 20)
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_d") == 0, 0).when(F.col("_d") == 3, 2).otherwise(1).cast("long").alias("copies"))


def fault(text: Column, again: Column) -> Column:
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", BLANK).when(again, DUPLICATE).when(~last.rlike("^[.!?]$"), CUT).otherwise(FINE)


def faulty_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows (known, cid, turn, role, text, digest) with their number of copies and the fault of the first."""
    none = F.col("copies") == 0
    x = rows.select(
        F.col("conv_id").isNotNull().alias("known"),
        F.coalesce("conv_id", F.lit(0)).alias("cid"),
        *[F.when(~none, F.col(c)).alias(c) for c in ("turn", "role", "text")],
        "copies",
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))
    x = materialize(x.groupBy("known", "cid", "turn", "role", "digest").agg(F.first("text").alias("text"), F.sum("copies").alias("copies")), "repair-rows")
    on = ["known", "cid", "role", "digest"]
    seen = x.where("copies > 0").groupBy(*on).agg(F.min("turn").alias("_first"), F.bool_or(F.col("turn").isNull()).alias("_null"), F.count("*").alias("_n")).where("_n > 1")
    x = join_groups(x, seen, on, "_n", x.count(), "left")
    again = F.coalesce(F.col("turn").isNotNull() & (F.col("_null") | (F.col("turn") > F.col("_first"))), F.lit(False))
    return x.select("known", "cid", "turn", "role", "digest", "text", "copies", fault(F.col("text"), again).alias("kind"))


def lattice(kinds: list[int], initials: list[str], copies: list[int], entry: int) -> list[tuple[int, str] | None]:
    """Least (cost, audit) from ``entry`` before the first row to each state after the last."""
    n = len(kinds)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        required = copies[i] if kinds[i] in (BLANK, DUPLICATE) else copies[i] - 1
        ahead[i] = ahead[i + 1] + DELETE * required + (TRUNCATED if kinds[i] == CUT else 0)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    open_ = [(ahead[0], "", 0, entry)]
    while open_:
        estimate, audit, i, q = heapq.heappop(open_)
        if (i, q) in best:
            continue
        cost = estimate - ahead[i]
        best[i, q] = (cost, audit)
        new = ROLE_AFTER[q]
        edges = [(i, STATE_OF[new], INSERT, "I")]
        if i < n:
            m, rest = copies[i], "D" * (copies[i] - 1)
            edges.append((i + 1, q, DELETE * m, "D" + rest))
            if kinds[i] not in (BLANK, DUPLICATE):
                stays = DELETE * (m - 1) + (TRUNCATED if kinds[i] == CUT else 0)
                edges.append((i + 1, STATE_OF[new], REROLE + stays, "R" + rest))
                if (q, initials[i]) in STEPS:
                    edges.append((i + 1, STEPS[q, initials[i]], KEEP + stays, "K" + rest))
        for j, to, more, op in edges:
            if (j, to) not in best:
                heapq.heappush(open_, (cost + more + ahead[j], audit + op, j, to))
    return [best.get((n, q)) for q in STATES]


def repaired(q: int, audit: str, roles: list[str], texts: list[str], copies: list[int]) -> Iterator[str]:
    """``role:text`` of the rows that ``audit`` leaves, from state ``q`` on."""
    at, i = 0, 0
    while at < len(audit):
        op = audit[at]
        if op == "D":
            at, i = at + copies[i], i + 1
            continue
        role = roles[i] if op == "K" else ROLE_AFTER[q]
        yield f"{role}:{'' if op == 'I' else texts[i]}"
        q = STEPS[q, role[:1]]
        at, i = (at + 1, i) if op == "I" else (at + copies[i], i + 1)


@dataclass
class Rows:
    """A segment of a conversation and what is counted of it."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first_initial: str | None = None
    last_initial: str | None = None
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    copies: list[int] = field(default_factory=list)
    size: int = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, kind: int) -> None:
        initial, required = role[:1], kind in (BLANK, DUPLICATE)
        self.blank += copies if kind == BLANK else 0
        self.duplicate += copies if kind == DUPLICATE else 0 if kind == BLANK else copies - 1
        self.truncated += kind == CUT
        self.illegal += (self.last_initial is not None and self.last_initial + initial not in LEGAL) + (copies - 1 if initial * 2 not in LEGAL else 0)
        self.first_initial = initial if self.first_initial is None else self.first_initial
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        self.roles.append(role)
        self.texts.append("" if required else text)
        self.kinds.append(kind)
        self.copies.append(copies)
        self.size += len(self.texts[-1])

    def counts(self) -> tuple:
        return self.blank, self.duplicate, self.truncated, self.illegal, self.first_initial, self.last_initial, self.turns, self.first_turn, self.last_turn

    def full(self) -> bool:
        return len(self.roles) >= SEGMENT_ROWS or self.size >= SEGMENT_BYTES

    def solve(self, entry: int) -> list[tuple[int, str] | None]:
        return lattice(self.kinds, [r[:1] for r in self.roles], self.copies, entry)


def digest(parts: Iterator[str]) -> str:
    h = hashlib.sha256()
    for i, p in enumerate(parts):
        h.update(("\n" if i else "").encode() + p.encode())
    return h.hexdigest()


def segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations that lie inside the task, repaired, and the segments of others: those that begin or end the task, and long ones."""
    schema, part, out = pa.schema(_arrow(PIECE)), TaskContext.get().partitionId(), []
    key: tuple | None = None
    rows, seq, first = Rows(), 0, True

    def close(last: bool) -> None:
        if seq == 0 and not first and not last and not rows.full():
            cost, audit = min(x for q, x in enumerate(rows.solve(NONE)) if x and q in ENDS)
            found = digest(repaired(NONE, audit, rows.roles, rows.texts, rows.copies))
            out.append((*key, part, seq, True, *rows.counts(), cost, audit, found, None, None, None, None, None, None))
            return
        solved = [x for q in (STATES if first or seq else (NONE,)) for x in rows.solve(q)]
        solved += [None] * (16 - len(solved))
        out.append((*key, part, seq, False, *rows.counts(), None, None, None, rows.roles, rows.texts, rows.kinds, rows.copies, [x and x[0] for x in solved], [x and x[1] for x in solved]))

    for b in it:
        for known, cid, turn, role, text, copies, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (known, cid) != key:
                if key is not None:
                    close(False)
                    first = False
                key, rows, seq = (known, cid), Rows(), 0
            if copies:
                if rows.full():
                    close(False)
                    rows, seq = Rows(), seq + 1
                rows.add(turn, role, text, copies, kind)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
    if key is not None:
        close(True)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return [(n, kinds[k]) for n, k in (c.split(" ") for c in ddl.split(", "))]


class Chain:
    """Segments of one conversation in order: the least (cost, audit) and the digest so far for each state of the pattern."""

    def __init__(self) -> None:
        self.best: list = [(0, "", hashlib.sha256()), None, None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.last_initial = self.first_turn = self.last_turn = None

    def add(self, s: dict) -> None:
        for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, c, getattr(self, c) + s[c])
        if s["first_initial"] is not None:
            self.illegal += self.last_initial is not None and self.last_initial + s["first_initial"] not in LEGAL
            self.last_initial = s["last_initial"]
        if s["turns"]:
            self.turns -= self.last_turn == s["first_turn"]
            self.first_turn = s["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = s["last_turn"]
        after = []
        for to in STATES:
            ways = []
            for q, so_far in enumerate(self.best):
                cost = s["costs"][4 * q + to]
                if so_far and cost is not None:
                    ways.append((so_far[0] + cost, so_far[1] + s["audits"][4 * q + to], q))
            if not ways:
                after.append(None)
                continue
            cost, audit, q = min(ways)
            h, started = self.best[q][2].copy(), q != NONE
            for p in repaired(q, s["audits"][4 * q + to], s["roles"], s["texts"], s["copies"]):
                h.update(("\n" if started else "").encode() + p.encode())
                started = True
            after.append((cost, audit, h))
        self.best = after

    def row(self, known: bool, cid: int) -> tuple:
        cost, audit, h = min((self.best[q] for q in ENDS if self.best[q]), key=lambda x: x[:2])
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return cid if known else None, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, h.hexdigest()


def chained(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of several tasks or segments, from their segments in order."""
    schema = pa.schema(_arrow(RESULT))
    key: tuple | None = None
    chain = Chain()
    for b in it:
        out = []
        for s in b.to_pylist():
            if (s["known"], s["cid"]) != key:
                if key is not None:
                    out.append(chain.row(*key))
                key, chain = (s["known"], s["cid"]), Chain()
            chain.add(s)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(chain.row(*key), schema, strict=True)], schema=schema)


def repair(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, copies; 0 copies: the conversation exists, the row does not)."""
    spark = rows.sparkSession
    small_batches(spark)
    order = ["known", "cid", "turn", "role", "digest"]
    dealt = faulty_rows(rows).repartitionByRange(*order).sortWithinPartitions(*order).drop("digest")
    found = materialize(dealt.select("known", "cid", "turn", "role", "text", "copies", "kind").mapInArrow(segments, PIECE), "repair-segments")
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0))
    done = found.where("whole").select(F.when(F.col("known"), F.col("cid")).alias("conv_id"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rest = found.where("not whole").repartition("known", "cid").sortWithinPartitions("known", "cid", "part", "seq")
    return done.unionByName(rest.mapInArrow(chained, RESULT))


def oracle() -> str:
    """The same in DuckDB: a recursion over rows that keeps, for each state, cost (nine digits) and audit as one text, whose least is the best."""
    add = lambda v, cost, op: f"printf('%09d', substr({v}, 1, 9)::INT + {cost}) || substr({v}, 10) || '{op}'"
    before_user = "least(n, s, a)"
    inserts = f"""n, s, u, least(a, {add("u", 3, "I")}) AS a FROM (SELECT conv, i, n, s, least(u, {add(before_user, 3, "I")}) AS u, a"""
    return rf"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))),
ids AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
dealt AS (
  SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(c.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]))) % 20 AS d
  FROM conversations c JOIN ids ON c.conv_id IS NOT DISTINCT FROM ids.conv_id, tab),
hurt AS (
  SELECT conv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, row_number() OVER () AS id
  FROM dealt, range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) r(copy)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text), id) AS i,
    row_number() OVER (PARTITION BY conv, role, text ORDER BY turn NULLS FIRST, id) AS seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
  FROM hurt),
kinds AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'fine' END AS kind,
    substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY i) AS before
  FROM placed),
steps AS (
  SELECT conv, 0 AS i, n, s, u, least(a, {add("u", 3, "I")}) AS a FROM (SELECT conv, n, s, {add("n", 3, "I")} AS u, a FROM (SELECT conv, '000000000' AS n, NULL::VARCHAR AS s, NULL::VARCHAR AS a FROM ids))
  UNION ALL
  SELECT conv, i, {inserts} FROM (
    SELECT conv, k.i::INT AS i, {add("n", 4, "D")} AS n,
      least({add("s", 4, "D")}, CASE WHEN stays AND r = 's' THEN {add("n", "more", "K")} END) AS s,
      least({add("u", 4, "D")}, CASE WHEN stays THEN {add(before_user, "3 + more", "R")} END, CASE WHEN stays AND r = 'u' THEN {add(before_user, "more", "K")} END) AS u,
      least({add("a", 4, "D")}, CASE WHEN stays THEN {add("u", "3 + more", "R")} END, CASE WHEN stays AND r = 'a' THEN {add("u", "more", "K")} END) AS a
    FROM steps JOIN (SELECT conv, i, r, kind IN ('fine', 'truncated') AS stays, CASE WHEN kind = 'truncated' THEN 3 ELSE 0 END AS more FROM kinds) k USING (conv) WHERE k.i = steps.i + 1))),
ended AS (SELECT conv, arg_max(least(n, a), i) AS v FROM steps GROUP BY conv),
audits AS (SELECT conv, substr(v, 1, 9)::BIGINT AS cost, substr(v, 10) AS audit FROM ended),
ops AS (SELECT conv, unnest(string_split(audit, '')) AS op, generate_subscripts(string_split(audit, ''), 1) AS j FROM audits WHERE audit <> ''),
rowed AS (SELECT *, sum((op <> 'I')::INT) OVER (PARTITION BY conv ORDER BY j) AS i FROM ops),
left_ AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY j) AS o, count(*) OVER (PARTITION BY conv) AS m FROM rowed WHERE op <> 'D'),
texts AS (
  SELECT conv, sha256(string_agg(CASE WHEN op = 'K' THEN k.role WHEN (o + m) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE k.text END, chr(10) ORDER BY o)) AS h
  FROM left_ LEFT JOIN kinds k USING (conv, i) GROUP BY conv),
counts AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
    count(*) FILTER (kind = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM kinds GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN audits USING (conv) LEFT JOIN counts USING (conv) LEFT JOIN texts USING (conv)
"""
