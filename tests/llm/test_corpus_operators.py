import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np

from quillstone.llm import language_model, near_dedup, substring_dedup
from tests.llm.helpers import docs, labels, odd_rows, prose, text


def near_rows(seed=0):
    """Groups of exact and near copies around the threshold, chains, short texts."""
    rng, rows, d = random.Random(seed), [], 0
    for g in range(12):
        base = prose(1000 + g, rng.choice([3, 6, 40, 120, 300]))
        for _ in range(rng.randint(1, 12)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
            rows.append((d, " ".join(w)))
            d += 1
    chain = prose(77, 200)
    for i in range(10):  # each text is near the next one only
        rows.append((d + i, " ".join([*chain[i * 9 :], *prose(900 + i, i * 9)])))
    rng.shuffle(rows)
    return [*rows, *[(None if x is None else x + 500, t) for x, t in odd_rows()]]


def brute_components(rows, k):
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        if d is not None:
            sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return {d: (len(sets[d]), label[d]) for d in sets}


def test_near_duplicates_against_brute_force(spark):
    for k in (4, 5):
        rows = near_rows(k)
        want = brute_components(rows, k)
        out = near_dedup.near_duplicates(docs(spark, rows), k=k).collect()
        assert len(out) == len(rows)
        for r in out:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id]
                assert r.kept == (r.doc_id == r.component_id)


def test_cross_pairs_find_what_stars_miss(spark):
    """Without star rounds every link comes from the block comparison."""
    near_dedup.STAR_ROUNDS, was = 0, near_dedup.STAR_ROUNDS
    near_dedup.BLOCK, block = 4, near_dedup.BLOCK
    try:
        rows = near_rows(9)
        want = brute_components(rows, 5)
        out = near_dedup.near_duplicates(docs(spark, rows)).where("doc_id is not null").collect()
        assert {r.doc_id: r.component_id for r in out} == {d: c for d, (_, c) in want.items()}
    finally:
        near_dedup.STAR_ROUNDS, near_dedup.BLOCK = was, block


def test_rows_that_repeat_an_id_are_linked_by_their_own_texts(spark):
    """Whatever their order: (1, A), (2, B), (2, A2) with A and A2 near copies, and B another text."""
    a, b = prose(1, 100), " ".join(prose(2, 100))
    a2 = " ".join([*a[:-1], "other"])
    rows = [(1, " ".join(a)), (2, b), (2, a2), (None, a2), (None, "q r s t u v"), (None, "q r s t u v")]
    for order in (rows, rows[::-1], [rows[i] for i in (2, 5, 0, 4, 1, 3)]):
        d = docs(spark, order)
        got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(d).collect())
        assert got == [(0, 0, True), (0, 0, True), (0, 1, False), (1, 1, True), (2, 1, False), (2, 2, True)]
        left = sorted((r.doc_id or 0, r.text) for r in near_dedup.drop_near_duplicates(d).collect())
        assert left == sorted([(1, " ".join(a)), (2, b), (0, "q r s t u v")])


def test_one_row_of_repeated_rows_stays(spark):
    rows = [(5, text(3, 60)), (5, text(3, 60)), (4, text(3, 60)), (4, text(3, 60)), (9, None), (9, None)]
    d = docs(spark, rows).withColumnRenamed("h", "row").withColumnRenamed("count", "_row")
    out = near_dedup.drop_near_duplicates(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [4, 9, 9]


def test_hot_keys_are_looked_up(spark, monkeypatch):
    """With every key of more than two rows taken for a hot one."""
    from quillstone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_GROUPS", 10**9)
    rows = near_rows(4)
    want = brute_components(rows, 5)
    out = near_dedup.near_duplicates(docs(spark, rows)).where("doc_id is not null").collect()
    assert {r.doc_id: r.component_id for r in out} == {d: c for d, (_, c) in want.items()}


def test_many_keys_are_merged(spark, monkeypatch):
    """With no key few enough to broadcast all, keys of more than two rows hot, and each of the star rounds taken."""
    from quillstone.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(near_dedup, "FEW", -1)
    monkeypatch.setattr(near_dedup, "STAR_YIELD", 10**9)
    rows = near_rows(4)
    want = brute_components(rows, 5)
    out = near_dedup.near_duplicates(docs(spark, rows)).where("doc_id is not null").collect()
    assert {r.doc_id: r.component_id for r in out} == {d: c for d, (_, c) in want.items()}


def chained(n):
    """Links of a chain of ``n`` nodes and of a star, in no order."""
    links = [(i + 1, i) for i in range(100, 100 + n - 1)] + [(x, 7) for x in range(8, 40)]
    random.Random(n).shuffle(links)
    return [(a, b) if a % 2 else (b, a) for a, b in links]


def test_components_of_few_and_many_nodes(spark, monkeypatch):
    edges = spark.createDataFrame(chained(40), "a long, b long")
    want = {x: 100 for x in range(100, 140)} | {x: 7 for x in range(7, 40)}
    for few in (near_dedup.FEW, -1):
        monkeypatch.setattr(near_dedup, "FEW", few)
        assert {r.node: r.label for r in near_dedup.components(edges).collect()} == want


def test_few_keys_take_few_written_tables(spark, monkeypatch):
    """Where partitions are many, a round costs its stages rather than its rows: links that one star round finds take 15 written tables at most."""
    rows = [(d, " ".join([*prose(1, 100), f"x{d}"])) for d in range(6)]
    written, write = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, label: written.append(label) or write(df, label))
    out = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r.component_id for r in out} == {0} and len(written) <= 15, written


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    d = docs(spark, near_rows(3))
    assert near_dedup.drop_near_duplicates(d).columns == d.columns


def test_signature_estimates_similarity():
    a = near_dedup.shingle_set(" ".join(prose(1, 400)), 5)
    b = np.unique(np.concatenate([a[:300], near_dedup.shingle_set(" ".join(prose(2, 80)), 5)]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - j) < 0.15


def brute_repeats(rows):
    seen, cut = {}, {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            else:
                seen[w] = (d, s)
        cut[d] = (raw, gone)
    out = {}
    for d, (raw, gone) in cut.items():
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup_against_brute_force(spark):
    rng, rows = random.Random(2), []
    shared = [text(300 + i, rng.choice([10, 25, 60, 200])) for i in range(8)]
    for d in range(120):
        t = text(d, rng.choice([0, 5, 40, 150]))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            at = rng.randrange(len(t) + 1)
            t = t[:at] + s[a : a + rng.randint(60, 400)] + t[at:]
        rows.append((d * 7 % 120 - 40, t))
    rows += [(200, None), (201, ""), (202, "ab" * 400), (203, "b" + "ab" * 300), (204, "é" * 120), (205, "é" * 49 + "xx"), (206, shared[3]), (207, shared[3]), (208, "x" * 99), (209, "x" * 99), (210, "y" * 100), (211, "y" * 100)]
    want = brute_repeats(rows)
    out = substring_dedup.remove_repeats(docs(spark, rows), keep_text=True).collect()
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256


def test_substring_dedup_odd_rows(spark):
    out = substring_dedup.remove_repeats(docs(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    assert {r.doc_id: r.n_removed > 0 for r in out if r.doc_id in (6, 7)} == {6: False, 7: True}
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def test_substring_dedup_of_an_id_with_two_texts(spark):
    """B is cut nowhere, the second A as a whole; of rows repeated as they are none is cut; one passage in many rows."""
    a, b = text(1, 80), text(2, 80)
    rows = [(1, a), (2, a), (2, b), (2, b), (None, a), (9, b + a)]
    for order in (rows, rows[::-1]):
        got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in substring_dedup.remove_repeats(docs(spark, order)).collect())
        assert got == sorted([(1, len(a), 0), (2, len(a), len(a)), (2, len(b), 0), (2, len(b), 0), (0, len(a), 0), (9, len(a + b), len(a + b))])
    passage = text(3, 40)
    many = [(i, f"{text(50 + i, 3)} {passage} {text(5000 + i, 3)}") for i in range(3000)]
    out = substring_dedup.remove_repeats(docs(spark, many)).collect()
    assert [r.n_removed >= len(passage) for r in sorted(out, key=lambda r: r.doc_id)] == [False] + [True] * 2999


def lm_rows(n=400):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(150)]
    rows = []
    for d in range(n):
        w, out = rng.randrange(150), []
        for _ in range(60):
            out.append(vocab[w])
            w = (w * 7 + min(rng.randrange(12), rng.randrange(12))) % 150
        rows.append((d, " ".join(out)))
    return rows


def test_language_model(spark):
    rows = [*lm_rows(), (900, None), (901, ""), (902, "UNSEEN Words unseen"), (903, "a"), (903, "a")]
    out = language_model.score_documents(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    count, total = Counter(), 0
    toks = {d: [*(t or "").lower().split(), ""] for d, t in rows}
    for d, _ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            count.update(toks[d])
            total += len(toks[d])
    for r in out:
        t = toks[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), total)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t)) < 1e-6
    held = [r for r in out if r.held_out and r.doc_id < 900]
    assert sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held), "held-out perplexity beats the smoothed unigram"


def test_language_model_without_training(spark):
    d = docs(spark, [(1, "a b"), (2, None)])
    from pyspark.sql import functions as F

    for r in language_model.score_documents(d, held=F.lit(True)).collect():
        assert r.n_known == 0 and r.base_score == 0 and abs(r.score) < 1e-6
    assert language_model.score_documents(docs(spark, [])).count() == 0
    assert language_model.score_documents(docs(spark, odd_rows())).count() == len(odd_rows())


def stirling(c, s, d):
    """Tables of c customers of one dish: weight S_d(c, t) * s^t, by the seating recursion."""
    w = {1: s}
    for j in range(1, c):
        nxt = Counter()
        for t, x in w.items():
            nxt[t + 1] += x * s
            nxt[t] += x * (j - d * t)
        w = nxt
    total = sum(w.values())
    return {t: x / total for t, x in w.items()}


def test_seating_matches_exact_expectation():
    """Expected tables of c customers: one more at each step with probability s / (s + j - d t)."""
    d, n = 0.5, 20000
    for c, s in ((2, 0.3), (6, 0.3), (40, 7.0)):
        got, _ = language_model.seat(language_model.keyed(np.arange(n), 1), np.full(n, c), np.full(n, s), d)
        dist = {1: 1.0}
        for j in range(1, c):
            new = Counter()
            for t, p in dist.items():
                q = s / (s + j - d * t)
                new[t + 1] += p * q
                new[t] += p * (1 - q)
            dist = new
        assert abs(got.mean() - sum(t * p for t, p in dist.items())) < 0.05


def test_seating_in_pieces_is_the_same_seating():
    key, c, s = language_model.keyed(np.arange(5)), np.array([2, 900, 3, 70, 5]), np.array([0.1, 30.0, 1.0, 4.0, 0.5])
    whole = language_model.seat(key, c, s, 0.6)
    language_model.CHUNK, was = 64, language_model.CHUNK
    try:
        parts = language_model.seat(key, c, s, 0.6)
    finally:
        language_model.CHUNK = was
    assert (whole[0] == parts[0]).all() and np.allclose(whole[1], parts[1])


def test_moves_keep_the_exact_distribution():
    """Many chains of seatings of one dish, with a strength that changes on the way, end in S_d(c, t) s^t."""
    n, d = 20000, 0.7
    for c, s in ((2, 0.8), (5, 2.0), (12, 0.4)):
        x = language_model.Dishes(lambda k, c=c: language_model.keyed(k, c), np.full(n, c))
        for sweep in range(1, 13):
            x.move(sweep, np.full(n, s if sweep > 4 else 5 * s), d)
        want = stirling(c, s, d)
        for t, p in want.items():
            assert abs((x.t == t).mean() - p) < 4 * math.sqrt(p / n) + 1e-3, (c, t)


def test_gamma_draws():
    for a in (0.2, 1.0, 7.5):
        x = language_model.gamma(language_model.keyed(np.arange(40000), 9), np.full(40000, a))
        assert abs(x.mean() - a) < 0.05 * a + 0.01 and abs(x.var() - a) < 0.1 * a + 0.02


def brute_pitman_yor(texts, d, d0, theta, sweeps, rng):
    """Customer by customer: Gibbs sampling of the seating of a bigram model with table sizes; average probabilities."""
    pairs = [(u, w) for t in texts for u, w in zip(["", *t], [*t, ""])]
    vocab = sorted({w for _, w in pairs})
    base = 1 / (len(vocab) + 1)
    sizes, root, seats, top = {}, {}, [None] * len(pairs), {}
    total_tables, customers = Counter(), Counter()

    def p0(w):
        cw, tw, all_c, all_t = sum(root.get(w, [])), len(root.get(w, [])), sum(map(sum, root.values())), sum(map(len, root.values()))
        return (cw - d0 * tw + (theta + d0 * all_t) * base) / (theta + all_c)

    def choose(tables, new, disc):
        weights = [*(max(0, n - disc) for n in tables), new]
        return rng.choices(range(len(weights)), weights)[0]

    def sit_root(w):
        k = choose(root.setdefault(w, []), (theta + d0 * sum(map(len, root.values()))) * base, d0)
        root[w].append(1) if k == len(root[w]) else root[w].__setitem__(k, root[w][k] + 1)

    def leave_root(w):
        k = rng.choices(range(len(root[w])), root[w])[0]
        root[w][k] -= 1
        if not root[w][k]:
            root[w].pop(k)

    share = Counter()
    for sweep in range(sweeps):
        for i, (u, w) in enumerate(pairs):
            t = sizes.setdefault((u, w), [])
            if sweep:
                k = rng.choices(range(len(t)), t)[0]
                t[k] -= 1
                if not t[k]:
                    t.pop(k)
                    total_tables[u] -= 1
                    leave_root(w)
            k = choose(t, (theta + d * total_tables[u]) * p0(w), d)
            if k == len(t):
                t.append(1)
                total_tables[u] += 1
                sit_root(w)
            else:
                t[k] += 1
        if sweep == 0:
            customers.update(u for u, _ in pairs)
        if sweep >= sweeps // 4:
            for u in customers:
                for w in vocab:
                    t = sizes.get((u, w), [])
                    share[u, w] += (sum(t) - d * len(t) + (theta + d * total_tables[u]) * p0(w)) / (theta + customers[u]) / (sweeps - sweeps // 4)
    return share


def test_language_model_against_customer_by_customer_gibbs(spark, monkeypatch):
    """Averages over many sweeps agree with a plain sampler that moves one customer at a time."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = [[rng.choice("aabbbcde") for _ in range(12)] for _ in range(14)]
    monkeypatch.setattr(language_model, "SWEEPS", 24)
    monkeypatch.setattr(language_model, "KEPT", 20)
    seen = {}

    class Spy(language_model.Shape):
        def __init__(self, *x):
            super().__init__(*x)
            seen["shape"] = self
            self.__class__ = language_model.Shape

    monkeypatch.setattr(language_model, "Shape", Spy)
    tests = [(1000, "a b c"), (1001, "b b b e"), (1002, "d"), (1003, "c a a")]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + tests
    out = {r.doc_id: r.score for r in language_model.score_documents(docs(spark, rows), held=F.col("doc_id") >= 1000).collect()}
    shape = seen["shape"]
    share = brute_pitman_yor(texts, shape.discount, shape.top_discount, language_model.THETA, 400, rng)
    for d, t in tests:
        w = t.split()
        want = sum(math.log10(share[u, x]) for u, x in zip(["", *w], [*w, ""]))
        assert abs(out[d] - want) < 0.03 * len(w) + 0.03, (d, out[d], want)


def test_language_model_does_not_depend_on_partitions(spark):
    """Nor on whether frequent contexts are split."""
    rows = [*lm_rows(60), *odd_rows()]
    was, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n, split in ((4, 1 << 22), (7, 1 << 22), (23, 50)):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            got = language_model.score_documents(docs(spark, rows), split=split).collect()
            seen.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, round(r.score, 9)) for r in got))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert seen[0] == seen[1] == seen[2]


def test_probabilities_sum_to_one():
    """Over all words and the unknown one in the unigram restaurant."""
    rng = np.random.default_rng(0)
    cw = rng.integers(1, 50, 30).astype(float)
    tw = np.minimum(rng.integers(1, 4, 30), cw)
    shape = language_model.Shape(1000, 30, 40, 20, 12, 6)
    parent = language_model.Parent(1, shape, int(cw.sum()), int(tw.sum()), 1)
    p = language_model.predictive(shape, parent, np.append(cw, 0), np.append(tw, 0))
    assert abs(p.sum() - 1) < 1e-12 and p[-1] > 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from quillstone.llm import decontamination, packing

    good = [(i, text(i, 240)) for i in range(40)]
    rows = [*good, (50, good[3][1]), (51, good[4][1] + "\nfinal words."), (52, "few words"), (53, text(900, 200) + " write to bob@mail.org"), (54, None), (55, "")]
    item = " ".join(prose(999, 25))
    rows.append((56, text(56, 100) + "\n" + item))
    d = docs(spark, rows)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark, [(i, 1) for i in range(20)]).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "pii", "packing"]
    seen, cur = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, cur, str(tmp_path)).write.parquet(path)
        cur = spark.read.parquet(path)
        seen[name] = {r.doc_id for r in cur.select("doc_id").collect()}
        if name != "packing":
            assert cur.columns == d.columns
    start = {x for x, _ in rows}
    assert start - seen["quality_rules"] == {52, 54, 55}
    assert seen["quality_rules"] - seen["near_dedup"] == {50, 51}
    assert seen["near_dedup"] - seen["decontaminate"] == {56}
    assert seen["pii"] == seen["decontaminate"] == seen["packing"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/pii").collect()}
    assert texts[53].endswith("<EMAIL>") and all(texts[i] == dict(rows)[i] for i in texts if i != 53)
    tok = packing.Tokenizer()
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in out) == sum(len(tok(t)) for t in texts.values())
    assert decontamination.find_leaks(spark.read.parquet(f"{tmp_path}/pii"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == 0


def test_language_model_keeps_preceding_words_apart(spark):
    """500 words that are each followed by one word of their own: no class of contexts can tell them apart."""
    pairs = [(f"a{i}", f"b{i}") for i in range(500)]
    rows = [(d, " ".join(f"{a} {b}" for a, b in random.Random(d).sample(pairs, 100))) for d in range(120)]
    rows += [(1000, " ".join(f"{a} {b}" for a, b in pairs)), (1001, " ".join(f"{a} {b}" for a, (_, b) in zip((a for a, _ in pairs), pairs[1:])))]
    from pyspark.sql import functions as F

    out = {r.doc_id: r for r in language_model.score_documents(docs(spark, rows), held=F.col("doc_id") >= 1000).collect()}
    # each first word costs about log10 500, each second one nearly nothing
    assert out[1000].score / out[1000].n_tokens > -1.6
    assert out[1001].score < 1.5 * out[1000].score
