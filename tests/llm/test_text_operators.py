import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import chat, classifier, decontamination, licenses, packing, pii, quality_rules
from tests.llm.helpers import LONG, docs, labels, odd_rows, prose, text

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(t):
    out = {}
    for k, p in PLAIN.items():
        out[k] = []
        for m in p.finditer(t):
            d = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=d: 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda d=d: 8 <= len(d) <= 15,
            }[k]()
            if ok:
                out[k].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@.1+ -()9\n5é_", max_size=60))
def test_base_spans_are_those_of_the_plain_patterns(t):
    assert pii.base_spans(t) == plain_spans(t)


def test_base_spans_on_known_texts():
    t = "x a@b.c@d.e 1.2.3.4.5.6.7.8 x 4111 1111-1111 1111 x +1 (582) 555-0199 y 999.1.1.1 é"
    assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans(t)["card"] and pii.base_spans(t)["phone"]
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@")["email"] == []


def secrets(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        w = prose(i, 60)
        if i % 3 == 0:
            w.insert(20, "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(15)) + "7")
        if i % 3 == 1:
            w.insert(20, "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(17)) + "7")
        if i % 3 == 2:
            w.insert(20, "chapter2024")
        rows.append((i, " ".join(w)))
    return rows


def test_pii_finds_secrets_and_leaves_clean_texts(spark):
    rows = secrets(90)
    out = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    for i, t in rows:
        assert (out[i].n_secret == 1) == (i % 3 != 2), (t, out[i])
        for x in filter(None, out[i].spans.split(",")):
            s, e = map(int, x.split(":")[1:])
            assert re.fullmatch("AKIA.{16}|[0-9a-f]{18}", t[s:e])


def test_votes_are_weighed_against_each_other(spark):
    """Short and letters-only tokens are candidates; the classifier finds keys that no known shape tells, and beats each simple labeler."""
    rng = random.Random(1)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kinds = {
        "hex": (1, 2, lambda: f"token: {pick('0123456789abcdef', 31)}7"),
        "short": (1, 2, lambda: f"api_key={pick('ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789', 4)}4Q"),
        "shape": (1, 1, lambda: f"AKIA{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 15)}7"),
        "prose": (0, 4, lambda: f"secret {rng.choice(['garden', 'door', 'love'])}"),
        "chapter": (0, 4, lambda: "chapter2024"),
        "year": (0, 6, lambda: str(rng.randint(1, 2024))),
        "count": (0, 4, lambda: f"count: {rng.randint(1, 99)}"),
        "size": (0, 3, lambda: "size = 12px"),
        "room": (0, 3, lambda: "room B12a"),
        "none": (0, 6, str),
    }
    rows, names = [], []
    for i in range(1500):
        k = rng.choices(list(kinds), [w for _, w, _ in kinds.values()])[0]
        w = prose(i, 30)
        rows.append((i, " ".join([*w[:15], kinds[k][2](), *w[15:]])))
        names.append(k)
    found = {r.doc_id: r for r in pii.find_pii(docs(spark, rows)).collect()}
    truth = [bool(kinds[k][0]) for k in names]
    right = sum((found[i].n_secret > 0) == t for i, t in enumerate(truth))
    assert right >= 0.99 * len(rows)
    cands = [pii.candidates(t, pii.base_spans(t)) for _, t in rows]
    for v in ("regex", "gazetteer", "mixture"):
        i = pii.LABELERS.index(v)
        assert right > sum(any((m >> (2 * i)) & 3 == 1 for _, _, m in c) == t for c, t in zip(cands, truth))
    t = "token_7abc password: hunter, secret=x mail bob7@x.org"
    assert [t[s:e] for s, e, _ in pii.candidates(t, pii.base_spans(t))] == ["token_7abc", "hunter", "x"]


def test_pii_odd_rows_and_redaction(spark):
    rows = [*odd_rows(), (20, "mail bob@x.org now 10.0.0.1"), (20, "mail bob@x.org now 10.0.0.1")]
    out = pii.find_pii(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        base = ",".join(f"{k}:{s}:{e}" for k, v in plain_spans(dict(rows)[r.doc_id] or "").items() for s, e in v)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert r.spans.startswith(base)
    red = pii.redact(docs(spark, rows))
    assert red.columns == docs(spark, rows).columns
    got = [r.text for r in red.where("doc_id = 20").collect()]
    assert got == ["mail <EMAIL> now <IP>"] * 2
    assert red.where("doc_id = 1").first().text is None
    assert pii.find_pii(docs(spark, [])).count() == 0


def brute_repeats(words, k=8):
    seen = {}
    for i in range(len(words) - k + 1):
        seen.setdefault(tuple(words[i : i + k]), []).append(i)
    cover = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(k)}
    return len(cover)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(words):
    assert quality_rules.repeated_words(words) == brute_repeats(words)


def brute_viterbi(masks, emit, trans):
    from itertools import product

    score = lambda p: sum(emit[m] for m, s in zip(masks, p) if s) + sum(trans[a][b] for a, b in zip(p, p[1:]))
    return max(map(score, product((0, 1), repeat=len(masks)))), score


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.lists(st.floats(-3, 3), min_size=8, max_size=8))
def test_viterbi_is_the_best_path(masks, w):
    emit, trans = w[:4], [w[4:6], w[6:8]]
    best, score = brute_viterbi(masks, emit, trans)
    assert abs(score(quality_rules.viterbi(masks, emit, trans)) - best) < 1e-9


def test_quality_rules(spark):
    junk = lambda i: "\n".join(" ".join(x.upper() + "!!" for x in prose(i * 100 + j, 10)) for j in range(8))
    rows = [(i, text(i, 240) if i % 2 else junk(i)) for i in range(80)]
    d, lab = docs(spark, rows), labels(spark, [(i, i % 2) for i in range(60)])
    out = {r.doc_id: r for r in quality_rules.quality_rules(d, lab).collect()}
    assert all(out[i].kept == bool(i % 2) for i in range(80))
    odd = [*odd_rows(), (30, "x y\nx y\n \n \nx y #*$%&|<>")]
    out = quality_rules.quality_rules(docs(spark, odd), labels(spark, [])).collect()
    assert len(out) == len(odd)
    r = next(r for r in out if r.doc_id == 30)
    assert (r.n_words, r.n_dup_lines, r.n_symbols, r.base_failed) == (7, 1, 8, True)
    assert r.word_chars == sum(map(len, dict(odd)[30].split()))
    assert quality_rules.quality_rules(docs(spark, []), labels(spark, [])).count() == 0


def test_boilerplate_lines_are_found_in_good_documents_and_content_in_bad_ones():
    """Labels mark documents only: the labels of lines are latent."""
    rng = random.Random(12)
    bar = lambda: "home | login | " + " | ".join(prose(rng.random(), 4))
    say = lambda: " ".join(prose(rng.random(), 11)) + "."
    rows, truth = [], []
    for i in range(300):
        good = i % 2
        kinds = [1] * rng.randint(5, 9) + [0] * rng.randint(0, 3) if good else [0] * rng.randint(6, 9) + [1] * rng.randint(0, 3)
        kinds = kinds if rng.random() < 0.5 else kinds[::-1]
        lines = [say() if k else bar() for k in kinds]
        rows.append((quality_rules.line_masks("\n".join(lines).encode())[0], good))
        truth.append(kinds)
    w, A = quality_rules.fit_crf(rows[:200])
    bits = (np.arange(1 << quality_rules.N)[:, None] >> np.arange(quality_rules.N)) & 1
    emit = (w[0] + bits @ w[1:]).tolist()
    got = [quality_rules.viterbi(m, emit, A.tolist()) for m, _ in rows]
    held = range(200, 300)
    assert np.mean([a == b for i in held for a, b in zip(got[i], truth[i])]) > 0.97
    assert sum(len(set(got[i])) == 2 for i in held) > 50


def test_line_labels_keep_to_the_documents_label():
    on = np.array([[1, 1, 1, 0], [1, 1, 1, 1], [1, 0, 0, 0], [1, 0, 0, 0]])
    p = np.array([[0.4, 0.1, 0.2, 0.9], [0.9, 0.8, 0.6, 0.7], [0.1, 0, 0, 0], [0.9, 0, 0, 0]])
    got = quality_rules.line_labels(p, on, np.array([True, False, True, False]))
    assert got.tolist() == [[1, 0, 1, 0], [1, 0, 0, 0], [1, 0, 0, 0], [0, 0, 0, 0]]


def test_crf_gradient_is_that_of_the_likelihood():
    from itertools import product

    rng = np.random.default_rng(3)
    masks, y = [[1, 2, 3], [5]], [[1, 0, 1], [0]]
    on, X = quality_rules.padded(masks)
    Y = np.array([[1, 0, 1], [0, 0, 0]], float)
    share = np.array([0.3, 0.7])
    w, A = rng.normal(size=quality_rules.N + 1), rng.normal(size=(2, 2))

    def likelihood(w, A):
        total = 0.0
        for i, m in enumerate(masks):
            f = lambda p, i=i: sum(X[i, t] @ w for t, v in enumerate(p) if v) + sum(A[a, b] for a, b in zip(p, p[1:]))
            total += share[i] * (f(y[i]) - np.logaddexp.reduce([f(p) for p in product((0, 1), repeat=len(m))]))
        return total

    gw, gA = quality_rules.gradient(on, X, Y, share, w, A)
    for k in range(len(w)):
        d = np.eye(len(w))[k] * 1e-5
        assert abs((likelihood(w + d, A) - likelihood(w - d, A)) / 2e-5 - gw[k]) < 1e-6
    for a, b in product((0, 1), repeat=2):
        d = np.zeros((2, 2))
        d[a, b] = 1e-5
        assert abs((likelihood(w, A + d) - likelihood(w, A - d)) / 2e-5 - gA[a, b]) < 1e-6


def test_classifier_learns_and_scores_held_out(spark):
    junk = lambda i: " ".join(x.upper() + "!!" for x in prose(i, 80))
    rows = [(i, text(i, 200) if i % 2 else junk(i)) for i in range(150)]
    out = classifier.classify_quality(docs(spark, rows), labels(spark, [(i, i % 2) for i in range(150)])).collect()
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in out if r.held_out]
    assert np.mean([r.predicted == r.doc_id % 2 for r in held]) > 0.95
    odd = classifier.classify_quality(docs(spark, odd_rows()), labels(spark, [])).collect()
    assert len(odd) == len(odd_rows()) and all(0 <= r.score <= 1 for r in odd)
    assert classifier.classify_quality(docs(spark, []), labels(spark, [])).count() == 0


def test_fm_identity():
    rng = np.random.default_rng(0)
    idx, val = np.arange(6), rng.normal(size=6).astype(np.float32)
    w, v = rng.normal(size=6).astype(np.float32), rng.normal(size=(6, 3)).astype(np.float32)
    y, _, _ = classifier.fm(idx, val, np.array([0]), 0.5, w, v)
    pairs = sum(float(v[i] @ v[j]) * val[i] * val[j] for i in range(6) for j in range(i + 1, 6))
    assert abs(y[0] - (0.5 + w @ val + pairs)) < 1e-4


def test_licenses(spark):
    mit = "MIT Licence\n\nCopyright (c) 2020 Someone\nCopyright (c) 2021 Other\n" + licenses.LICENSES["MIT"].upper().replace(",", " , ")
    rows = [*odd_rows(), (40, mit), (40, mit), (41, mit + " more"), (42, "prose\nreleased under the MIT licence!\nReleased under the MIT License.")]
    out = licenses.scan_licenses(docs(spark, rows)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: (r.license_id, r.notices) for r in out}
    assert got[40] == ("MIT", "") and got[41] == (None, "") and got[42] == (None, "MIT")
    assert len({r.digest for r in out if r.doc_id in (1, 2, 3)}) == 1
    for k, t in licenses.LICENSES.items():
        assert licenses.scan_licenses(docs(spark, [(1, t)])).first().license_id == k.removesuffix("-titled")
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def test_every_licence_is_found_by_its_digest(spark):
    """As a whole text in another layout: case, line breaks, punctuation, copyright lines and spellings."""
    import duckdb

    assert len({licenses.digest(t) for t in licenses.LICENSES.values()}) == len(licenses.LICENSES) > 20
    rows, want = [], {}
    for i, (name, t) in enumerate(licenses.LICENSES.items()):
        t = t.upper().replace("LICENSE", "LICENCE").replace(". ", ".\n    ").replace(",", " ,")
        rows.append((i, f"Copyright (c) 2020 Somebody\n  {t}\n\n"))
        want[i] = name.removesuffix("-titled")
        rows.append((100 + i, rows[-1][1] + "and a word"))
    rows += odd_rows()[:4]
    d = docs(spark, [(x if t is not None else 900, t) for x, t in rows])
    got = licenses.scan_licenses(d).collect()
    assert {r.doc_id: r.license_id for r in got if r.license_id} == want
    documents = d.select("doc_id", "text").toPandas()  # noqa: F841
    sql = duckdb.sql(licenses.oracle()).fetchall()
    assert sorted(map(repr, sql)) == sorted(repr((r.doc_id, r.digest, r.license_id, r.notices)) for r in got)


def test_word_memo_gives_the_tokenizers_ids():
    tok = packing.Tokenizer()
    samples = ["", "Hello, world's  end!", "É́ Ünïcode x y \x1c z", "ΑΣ ΑΣΑ ȧ İ", "<|endoftext|> a", "x" * 3000, "tab\tnew\nline 12345 don't", " \n"]
    for t in samples:
        want = [*tok.t.encode(t, add_special_tokens=False).ids, 2]
        assert tok(t).tolist() == want, t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_word_memo_on_any_text(t):
    tok = test_word_memo_on_any_text.tok = getattr(test_word_memo_on_any_text, "tok", None) or packing.Tokenizer()
    assert tok(t).tolist() == [*tok.t.encode(t, add_special_tokens=False).ids, 2]


def check_packing(out, rows, window):
    tok = packing.Tokenizer()
    want = sorted(tuple(tok(t or "").tolist()) for _, t in rows)
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_seq.values():
        at = 0
        for off, n in sorted(pieces):
            assert off == at
            at += n
        assert at <= window
    assert sum(r.length for r in out) == sum(map(len, want))
    return by_seq


def test_packing(spark):
    rows = [(i, text(i, 5 + 37 * i % 400)) for i in range(120)] + [(None if d is None else d + 500, t) for d, t in odd_rows()]
    out = packing.pack(docs(spark, rows), window=256).collect()
    seqs = check_packing(out, rows, 256)
    tok, full = packing.Tokenizer(), sum(len(packing.Tokenizer()(t or "")) for _, t in rows)
    assert len(seqs) * 256 < 1.05 * full + 256
    texts = dict(rows)
    for r in out:
        ids = tok(texts[r.doc_id] or "")
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=30))
def test_plan_covers_the_histogram(hist):
    got = {}
    for combo, times in packing.plan(hist, 64):
        assert sum(combo) <= 64
        for x in combo:
            got[x] = got.get(x, 0) + times
    assert got == hist


def test_nnls():
    A = np.array([[1.0, 0, 2], [1, 1, 0], [0, 1, 1]])
    x = np.array([30.0, 0, 12])
    assert np.abs(packing.nnls(A, A @ x, 2000) - x).max() < 1


HARD = st.text(alphabet="\\#<: a/>turn\n.é", max_size=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(HARD, HARD), max_size=6))
def test_chat_template_round_trip(turns):
    out, _ = chat.render(turns, 0)
    assert [(chat.unescape(m[1]), chat.unescape(m[2])) for m in chat.TURN.finditer(out)] == turns
    assert "".join(m[0] for m in chat.TURN.finditer(out)) == out


def test_chat_windows_and_read_back(spark):
    rng, rows = random.Random(1), []
    for c in range(12):
        rows.append((c, 0, "system", "be kind </turn> ### user: x"))
        for k in range(1, rng.randint(2, 30)):
            rows.append((c, k, "assistant" if k % 2 == 0 else "user", " ".join(prose(c * 50 + k, rng.randint(0, 60)))))
    rows += [(50, 1, None, None), (50, 1, None, None), (50, None, "user", "x"), (51, 0, "assistant", LONG), (52, 0, "assistant", ""), (None, 0, "user", "z")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, window string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_chats(df, budget=120, history=40)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=key)
        assert out[c].n_turns == len(mine)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    wins = chat.format_chats(df, budget=120, history=40).collect()
    assert all(w.formatted.startswith("### system: ") for w in wins if w.conv_id is not None and w.conv_id < 12)
    assert any(w.n_repeated > 1 for w in wins)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_leaks(spark):
    items = [(i, " ".join(prose(500 + i, 30)).capitalize() + ".") for i in range(20)] + [(90, "too short"), (91, None), (92, "seven words that are found quite whole")]
    item = dict(items)
    rng, rows, want = random.Random(5), [], set()
    for i in range(60):
        body = prose(i, 100)
        if i % 4 == 0:
            w = item[i % 20].split()
            for at in ((7, 19) if i % 8 else ()):
                w[at] = "substituted"
            body[40:40] = w
            want.add((i, i % 20))
        rows.append((i, " ".join(body)))
    rows += [(70, "Seven words, THAT are found quite whole!"), *[(None if d is None else d + 100, t) for d, t in odd_rows()]]
    want.add((70, 92))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs(spark, rows), bench).collect()}
    assert got == want
    kept = {r.doc_id for r in decontamination.drop_leaks(docs(spark, rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    decontamination.BROADCAST_ROWS, was = 0, decontamination.BROADCAST_ROWS
    try:
        assert {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs(spark, rows), bench).collect()} == want
    finally:
        decontamination.BROADCAST_ROWS = was
    assert decontamination.find_leaks(docs(spark, []), bench).count() == 0
    assert decontamination.find_leaks(docs(spark, rows), bench.limit(0)).count() == 0


def test_long_system_turns_are_repeated_within_bound(spark):
    """Also one of over half the budget: its windows grow, so the output stays within a constant factor of the input."""
    rows = [(3, 0, "system", "t " * 300), *((3, i, "user", "a b c " * 30) for i in range(1, 21))]
    rows += [(1, 0, "system", "s " * 5000)] + [(1, i, "user", f"w{i}") for i in range(1, 201)] + [(2, 0, "user", "hello"), (2, 1, "system", "be brief"), *((2, i, "assistant", "a b c " * 60) for i in range(2, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wins = chat.format_chats(df).collect()
    assert sum(len(w.formatted) for w in wins if w.conv_id == 1) < 40_000
    two = sorted((w.window, w.formatted) for w in wins if w.conv_id == 2)
    assert len(two) > 2 and all("be brief" in t for _, t in two) and sum(t.count("be brief") for _, t in two) == len(two)
    three = [w.formatted for w in wins if w.conv_id == 3]
    assert len(three) > 4 and all(t.startswith("### system: t t") for t in three)
    assert all(sum(chat.tokens(*m.groups()) for m in chat.TURN.finditer(t)) <= 2 * 301 for t in three)
    assert all(w.formatted.startswith("### system: s s") for w in wins if w.conv_id == 1)
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert back[1].n_turns == 201 and back[2].n_turns == 9 and back[2].loss_chars == 7 * 360


def test_windows_against_sums_of_lists():
    """Prefix sums choose the spans that adding up the turns chooses."""
    rng = random.Random(8)
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "assistant", "system"]), "x " * rng.randint(0, 30)) for _ in range(rng.randint(1, 40))]
        w, got = chat.Windows(60, 20), []
        for t in turns:
            got += w.add(*t)
        got.append(w.close())
        system, past, left, want = None, [], list(turns), []
        size = lambda ts: sum(chat.tokens(*t) for t in ts)
        while left:
            fixed = [system] if system else []
            most = max(60, 2 * size(fixed))
            while past and size([*fixed, *past, left[0]]) > most:
                past.pop(0)
            new = [left.pop(0)]
            while left and size([*fixed, *past, *new, left[0]]) <= most:
                new.append(left.pop(0))
            want.append((chat.render([*fixed, *past, *new], len(fixed) + len(past))[0], len(fixed) + len(past)))
            tail = [*past, *new]
            at = max((i for i, t in enumerate(new) if t[0] == "system"), default=None)
            if at is not None:
                system, tail = new[at], new[at + 1 :]
            while size(tail) > 20:
                tail.pop(0)
            past = tail
        assert [(x[0], x[1]) for x in got] == want


def brute_leaks(rows, items, least=5):
    """Every alignment of every text with every item."""
    def hashes(t):
        return np.array([hash(w) for w in decontamination.words(t)], np.int64)

    out = {}
    for d, t in rows:
        doc = hashes(t or "")
        for i, x in items:
            item = hashes(x or "")
            if len(item) < max(1, least):
                continue
            if len(item) < 5:
                found = [(len(item), len(item), -s) for s in range(len(doc) - len(item) + 1) if (doc[s : s + len(item)] == item).all()]
            else:
                found = [r for s in range(-len(item), len(doc)) if (r := decontamination.overlap(doc, item, s))]
            if found:
                n, size, back = max(found)
                out[d, i] = max(out.get((d, i), (0,)), (n, size, back))
    return {k: (n, size, -back) for k, (n, size, back) in out.items()}


def test_leaks_against_brute_force(spark):
    """Items of 1 to 40 words, substituted at every rate, cut, repeated, at both ends of texts."""
    rng, items, rows = random.Random(11), [], []
    for i in range(40):
        items.append((i, " ".join(prose(700 + i, rng.choice([1, 3, 4, 5, 6, 8, 12, 13, 14, 20, 40])))))
    items += [(3, items[5][1]), (60, None), (61, ""), (None, items[7][1])]
    for d in range(150):
        body = prose(3000 + d, rng.choice([0, 3, 30, 90]))
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1]
            w = [rng.choice([x, x, x, x, x, "other"]) if rng.random() < 0.7 else x for x in (w or "").split()]
            at = rng.choice([0, len(body), rng.randrange(len(body) + 1)])
            body[at:at] = w[rng.choice([0, 0, 2]) :]
        rows.append((d, " ".join(body)))
    bench = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    for least in (5, 1):
        got = {(r.doc_id, r.item_id): (r.n_equal, r.n_words, r.start_word) for r in decontamination.find_leaks(docs(spark, rows), bench, least).collect()}
        want = brute_leaks(rows, items, least)
        assert len(want) > 40 and got == want


def test_leaks_among_rows_without_an_id_and_clashing_columns(spark):
    item = " ".join(prose(5, 20))
    d = spark.createDataFrame([(None, item, 1, 2), (None, "clean", 3, 4), (7, item, 5, 6), (7, "clean", 7, 8), (8, None, 9, 10)], "doc_id long, text string, _row int, item_id int")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontamination.drop_leaks(d, bench)
    assert out.columns == d.columns and sorted(r[2] for r in out.collect()) == [3, 7, 9]
    assert decontamination.drop_leaks(d.limit(0), bench).count() == 0
    assert decontamination.drop_leaks(d, bench.limit(0)).count() == 5


def seeded(doc, item):
    """Whether a mask of the item's family hits the true alignment."""
    hashes = decontamination.Hashes()
    a, b = hashes(" ".join(doc)), hashes(" ".join(item))
    return any(np.intersect1d(decontamination.seeds(a, m), decontamination.seeds(b, m)).size for m in decontamination.masks_of(len(item)))


def test_masks_cover_all_allowed_substitutions():
    """However the words that verification lets differ are placed, the passage is seeded."""
    from itertools import combinations

    for n in range(1, decontamination.SPAN + 1):
        passage = [f"p{i}" for i in range(n)]
        allowed = 0 if n < 5 else max(k for k in range(n) if n - k >= decontamination.TOLERANCE * n)
        for k in range(allowed + 1):
            for gone in combinations(range(n), k):
                assert seeded(["x", *("new" if i in gone else w for i, w in enumerate(passage)), "y"], passage), (n, gone)


def test_leak_with_every_fifth_word_replaced():
    for n in (20, 40, 59):
        item = [f"p{i}" for i in range(n)]
        assert seeded(["new" if i % 5 == 4 else w for i, w in enumerate(item)], item)


def test_quality_rules_train_on_all_lines(spark):
    rows = [(i, "\n".join(" ".join(prose(100 * i + j, 6)) for j in range(20 + 10 * i))) for i in range(12)]
    got = quality_rules.training_rows(docs(spark, rows), labels(spark, [(i, i % 2) for i in range(12)]))
    assert [(len(m), y) for m, y in got] == [(20 + 10 * i, i % 2) for i in range(12)]


def test_field_learns_from_lines_far_down():
    """The last lines alone tell the classes apart."""
    rows = [([0] * n + [k] * n, y) for n in (40, 90, 200) for k, y in ((1, 0), (2, 1)) for _ in range(3)]
    w, A = quality_rules.fit_crf(rows)
    assert w[2] > 0.1 > -0.1 > w[1] and np.isfinite(A).all()


def test_classifier_trains_on_very_long_documents(spark, monkeypatch):
    rows = [(i, LONG if i == 0 else text(i, 50)) for i in range(12)]
    seen = []
    monkeypatch.setattr(classifier, "fit", lambda got: seen.extend(got) or (0.0, None, None))
    classifier.train(docs(spark, rows), labels(spark, [(i, i % 2) for i in range(12)]))
    assert len(seen) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(12))
    assert zlib.crc32(b"0") % 3 != 1 and max(len(idx) for idx, _, _ in seen) > 3000
