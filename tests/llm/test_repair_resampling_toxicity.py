import hashlib
import math
import random
import re
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import conversation_repair, resampling, toxicity
from tests.llm.helpers import LONG, docs, labels, odd_rows, prose

TALK = "conv_id long, turn long, role string, text string, cost int, audit string"


def talk(spark, rows):
    """conversations with columns whose names the operator uses for its own."""
    return spark.createDataFrame([(*r, 1, "x") for r in rows], TALK)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        role, text = name(role), name(text)
        d = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        if d == 4:
            role = "user"
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, repaired) of all edits tried one after another, with up to two insertions in a row at each place."""
    found = []

    def go(i, ops, cost, out, added):
        initials = "".join(o[0][:1] or "-" for o in out)
        if found and cost > min(found)[0] or not re.fullmatch("s?(ua)*u?", initials):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            found.append((cost, ops, "\n".join(f"{r}:{t}" for r, t in out)))
        if added < 2:
            for r in ("user", "assistant"):
                go(i, ops + "I", cost + 3, [*out, (r, "")], added + 1)
        if i < len(rows):
            role, text, kind = rows[i]
            if kind not in ("blank", "duplicate"):
                more = 3 if kind == "truncated" else 0
                go(i + 1, ops + "K", cost + more, [*out, (role, text)], 0)
                for r in ("user", "assistant"):
                    go(i + 1, ops + "R", cost + 3 + more, [*out, (r, text)], 0)
            go(i + 1, ops + "D", cost + 4, out, 0)

    go(0, "", 0, [], 0)
    return min(found)


def plain_repair(rows, solve=cheapest):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in plain_damage(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, kinds = set(), []
        for _, _, role, text in mine:
            core = re.sub(r"[\x20\x09-\x0D]", "", text)
            kinds.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "fine")
            seen.add((role, text))
        turns = {r[1] for r in mine} - {None}
        initials = [r[2][:1] for r in mine]
        cost, audit, fixed = solve([(r[2], r[3], k) for r, k in zip(mine, kinds)])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost,
            audit,
            hashlib.sha256(fixed.encode()).hexdigest(),
        )
    return out


def random_talk(n, most):
    rng = random.Random(5)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ubot"]
    texts = ["a.", "b!", "c", "", " \n", None, "d? ", "e.\n"]
    return [(c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, most))]


@pytest.mark.parametrize("segment", [256, 1, 2])
def test_repair_is_the_cheapest_of_all_edits(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", segment)
    rows = random_talk(80, 4)
    got = {r.conv_id: tuple(r)[1:] for r in solved(spark, rows, segment).collect()}
    assert got == plain_repair(rows)


def solved(spark, rows, segment):
    """Through Spark, or, as a segment size set here does not reach the workers, through the functions that run there."""
    dealt = conversation_repair.damage(talk(spark, rows))
    if segment == 256:
        return conversation_repair.repair(dealt)
    faulty = conversation_repair.faulty_rows(dealt).orderBy("known", "cid", "turn", "role", "digest").select("known", "cid", "turn", "role", "text", "copies", "kind")
    real, conversation_repair.TaskContext = conversation_repair.TaskContext, SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
    try:
        pieces = [p for b in conversation_repair.segments(iter(faulty.toArrow().to_batches(max_chunksize=7))) for p in b.to_pylist()]
    finally:
        conversation_repair.TaskContext = real
    assert any(not p["whole"] and p["seq"] for p in pieces)
    ends = [r for b in conversation_repair.chained(pa.RecordBatch.from_pylist([p]) for p in pieces if not p["whole"]) for r in b.to_pylist()]
    for p in (p for p in pieces if p["whole"]):
        ends.append(p | {"conv_id": p["cid"] if p["known"] else None, "gaps": p["last_turn"] - p["first_turn"] + 1 - p["turns"] if p["turns"] else 0})
    names = [c.split(" ")[0] for c in conversation_repair.RESULT.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in ends], conversation_repair.RESULT)


def test_one_long_conversation_over_many_segments_and_tasks(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "tool"]), f"{t}{rng.choice('.!x')}" if rng.random() < 0.9 else rng.choice(["", "again."])) for t in range(3000)]
    rows += [(8, 0, "user", "x."), (8, 1, "assistant", "y.")]

    def forward(items):
        best = {0: (0, ""), 1: None, 2: None, 3: None}

        def insert(b):
            for q, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if b[q] and (b[to] is None or (b[q][0] + 3, b[q][1] + "I") < b[to]):
                    b[to] = (b[q][0] + 3, b[q][1] + "I")

        insert(best)
        for role, _, kind in items:
            new = {q: b and (b[0] + 4, b[1] + "D") for q, b in best.items()}
            for q, b in best.items():
                if b and kind not in ("blank", "duplicate"):
                    to, more = 3 if q == 2 else 2, 3 if kind == "truncated" else 0
                    ways = [(to, (b[0] + 3 + more, b[1] + "R"))]
                    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((q, role[:1]))
                    ways += [(keep, (b[0] + more, b[1] + "K"))] if keep else []
                    for k, w in ways:
                        new[k] = w if new[k] is None else min(new[k], w)
            insert(new)
            best = new
        cost, audit = min(b for q, b in best.items() if q in (0, 3) and b)
        out, i, last = [], 0, ""
        for op in audit:
            role = "assistant" if last == "u" else "user"
            if op == "I":
                out.append(f"{role}:")
                last = role[0]
                continue
            if op != "D":
                role = items[i][0] if op == "K" else role
                out.append(f"{role}:{items[i][1]}")
                last = role[0]
            i += 1
        return cost, audit, "\n".join(out)

    got = {r.conv_id: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damage(talk(spark, rows))).collect()}
    assert got == plain_repair(rows, forward)


def test_repair_odd_conversations_and_oracle(spark):
    assert conversation_repair.repair(conversation_repair.damage(talk(spark, []))).count() == 0
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "system", LONG), (1, 2, "user", "a."), (1, 2, "user", "a."), (2, 5, "assistant", "é?"), (3, 1, "user", "x" * 3_000_000)]
    rows += [(10 + i, t, "user" if t % 2 == 0 else "assistant", f"{i} {t}.") for i in range(40) for t in range(4)]
    rows += [(99, 3, "user", "same.")] * 50
    got = sorted((tuple(r) for r in conversation_repair.repair(conversation_repair.damage(talk(spark, rows))).collect()), key=repr)
    duck = duckdb.connect()
    duck.sql("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    duck.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert got == sorted(duck.sql(conversation_repair.oracle()).fetchall(), key=repr)
    assert {r[0] for r in got} == {r[0] for r in rows}


def plain_resample(rows, target):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10000
    s, t = np.zeros(10000), np.zeros(10000)
    for _, x in rows:
        for w in words(x):
            s[bucket(w)] += 1
    for x in target:
        for w in words(x):
            t[bucket(w)] += 1
    out = []
    for d, x in rows:
        w = [bucket(v) for v in words(x)]
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000)))) for b in w)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(w), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: len(fit) * 10 // 100]):
        r[4] = i + 1
    return sorted(map(tuple, out), key=repr)


def test_resampling_equals_a_plain_count_and_its_sql(spark):
    rows = [(i, " ".join(prose(i, 10 + i % 60)) + f" É{i} 3X") for i in range(300)] + odd_rows() + [(400, " ".join(prose(1, 50)))] * 60
    target = [" ".join(prose(i, 30)) for i in range(0, 40, 4)] + [None, ""]
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, bucket string")
    got = sorted((tuple(r) for r in resampling.resample(docs(spark, rows), bench).collect()), key=repr)
    assert got == plain_resample(rows, target)
    duck = duckdb.connect()
    duck.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    duck.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(target)))
    assert got == sorted(duck.sql(resampling.oracle()).fetchall(), key=repr)


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs(spark, []), none).count() == 0
    got = resampling.resample(docs(spark, [(1, " ".join(prose(2, 30))), (2, None)]), none).collect()
    assert sorted((r.doc_id, r.n_features, r["rank"]) for r in got) == [(1, 30, None), (2, 0, None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9)))
def test_runs_count_values(values):
    value, n = resampling.runs(np.array(values, "<u2"))
    assert dict(zip(value.tolist(), n.tolist())) == {v: values.count(v) for v in values}


def toxic_labels(spark, rows):
    return spark.createDataFrame([(d, 1, t, "x") for d, t in rows], "doc_id long, quality int, toxic int, score string")


def planted(n):
    """Toxic texts hold an insult and a group's name; either alone, which half of the others hold, is clean."""
    rng, rows, toxic = random.Random(4), [], []
    for i in range(n):
        words = prose(i, 40)
        kind = rng.choice(["both", "insult", "group", "none", "none"])
        if kind in ("both", "insult"):
            words.insert(rng.randint(0, 40), "Zounder!")
        if kind in ("both", "group"):
            words.insert(rng.randint(0, 40), "quorlings,")
        rows.append((i, " ".join(words)))
        toxic.append((i, int(kind == "both")))
    return rows, toxic


def test_machine_learns_pairs_that_linear_weights_miss(spark):
    rows, toxic = planted(1500)
    table, marks, truth = docs(spark, rows), toxic_labels(spark, toxic), dict(toxic)
    out = [r for r in toxicity.classify_toxicity(table, marks).collect() if r.held_out]
    wrong = sum(r.predicted != truth[r.doc_id] for r in out)
    assert wrong <= 0.02 * len(out), (wrong, len(out))
    straight = [r for r in toxicity.score(table, toxicity.train(table, marks, rank=0)).collect() if r.held_out]
    assert sum(r.predicted != truth[r.doc_id] for r in straight) >= sum(truth[r.doc_id] for r in straight) / 4 or wrong == 0
    assert sum(math.log(max(1e-12, r.score if truth[r.doc_id] else 1 - r.score)) for r in out) > sum(math.log(max(1e-12, r.score if truth[r.doc_id] else 1 - r.score)) for r in straight)


def test_toxic_term_in_a_very_long_text_and_in_a_short_one(spark):
    rows = [(i, " ".join(prose(i, 60) + (["grubfaced"] if i % 5 == 0 else []) + prose(i + 1, 10))) for i in range(900)]
    toxic = [(i, int(i % 5 == 0)) for i in range(900)]
    more = [(2000, " ".join(prose(3, 60_000)) + " grubfaceds " + " ".join(prose(4, 9000))), (2001, " ".join(prose(5, 60_000))), (2002, "grubfaced"), (2003, "calm"), (2004, None), (2005, "")]
    got = {r.doc_id: r for r in toxicity.classify_toxicity(docs(spark, rows + more), toxic_labels(spark, toxic)).collect()}
    assert [got[i].predicted for i in range(2000, 2006)] == [1, 0, 1, 0, 0, 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows, toxic = planted(300)
    turned = [(d, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, t in toxic]
    one, other = (sorted((r.doc_id, r.score) for r in toxicity.classify_toxicity(docs(spark, rows), toxic_labels(spark, x)).collect()) for x in (toxic, turned))
    assert one == other


def test_toxicity_of_odd_rows(spark):
    none = toxic_labels(spark, [])
    out = toxicity.classify_toxicity(docs(spark, odd_rows()), none).collect()
    assert len(out) == len(odd_rows()) and {r.score for r in out} == {0.5}
    assert toxicity.classify_toxicity(docs(spark, []), none).count() == 0
    assert toxicity.classify_toxicity(docs(spark, []), toxic_labels(spark, [(1, 1), (3, 0)])).count() == 0
    one_class = toxicity.classify_toxicity(docs(spark, odd_rows()), labels(spark, [(i, 1) for i in range(9)])).collect()
    assert {round(r.score, 6) for r in one_class} == {0.01}
    rows, toxic = planted(200)
    twice = toxicity.classify_toxicity(docs(spark, rows + rows + odd_rows()), toxic_labels(spark, [*toxic, *toxic, (None, 1), (5, None)])).collect()
    assert len(twice) == 400 + len(odd_rows()) and all(0 <= r.score <= 1 for r in twice)
