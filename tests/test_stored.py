"""Entry store and stored index: equal to the plain operators after every change; writers never lose each other's rows."""

import random
import re
import threading
from pathlib import Path

import pytest

from quillstone.operators.entry_store import EntryStore
from quillstone import sources
from quillstone.operators import search
from quillstone.operators.search_index import SearchIndex
from quillstone.operators.versions import Conflict, Versions

ENTRY = "id string, hash string, content string"


def entries(spark, rows):
    return spark.createDataFrame([(i, h, c) for i, h, c in rows], ENTRY)


def stored(s):
    t = s.table()
    return sorted(tuple(r) for r in t.select("id", "hash", "content").collect()) if t is not None else []


def replaced(state, rows):
    """One row after another, as an insert-or-replace with two unique keys does it."""
    for i, h, c in rows:
        state = {k: v for k, v in state.items() if v[0] != h and k != i}
        state[i] = (h, c)
    return state


def test_puts_and_deletes_equal_insert_or_replace(spark, tmp_path):
    rng, s, state = random.Random(2), EntryStore(spark, str(tmp_path / "s"), buckets=4), {}
    assert stored(s) == [] and s.get("a") is None and s.delete(entries(spark, [("x", "h", "c")])) == 0
    for n in range(6):
        ids, hashes = rng.sample(range(12), 4), rng.sample(range(12), 4)
        rows = [(f"i{i}", f"h{h}", f"{n}") for i, h in zip(ids, hashes)]
        s.put(entries(spark, rows))
        state = replaced(state, rows)
        if n % 3 == 2:
            s.delete(entries(spark, [(f"i{ids[0]}", "", ""), ("none", "", "")]))
            state.pop(f"i{ids[0]}")
        assert stored(s) == sorted((i, *v) for i, v in state.items())
    before = stored(s)
    assert s.compact(most=1) and stored(s) == before
    assert s.vacuum(keep=1) > 0 and stored(s) == before
    one = before[0]
    assert [tuple(r) for r in s.get(one[0]).select("id", "hash", "content").collect()] == [one]


def test_content_of_an_entry_that_moved_on_is_free(spark, tmp_path):
    s = EntryStore(spark, str(tmp_path / "s"), buckets=4)
    for row in (("a", "h1", "1"), ("b", "h1", "2"), ("b", "h2", "3"), ("c", "h1", "4")):
        s.put(entries(spark, [row]))
    assert stored(s) == [("b", "h2", "3"), ("c", "h1", "4")]
    assert sorted(r.id for r in s.table(1).collect()) == ["a"]


def test_rows_that_collide_in_one_put(spark, tmp_path):
    s = EntryStore(spark, str(tmp_path / "s"), buckets=4)
    rows = spark.createDataFrame([("a", "h1", "old", 1), ("a", "h2", "new", 2), ("b", "h3", "old", 1), ("c", "h3", "new", 2)], f"{ENTRY}, seq long")
    s.put(rows, "seq")
    assert stored(s) == [("a", "h2", "new"), ("c", "h3", "new")]


def test_lookup_and_upsert_touch_few_buckets(spark, tmp_path):
    s = EntryStore(spark, str(tmp_path / "s"), buckets=16)
    s.put(entries(spark, [(f"i{i}", f"h{i}", "x") for i in range(200)]))
    paths = s.get("i7").inputFiles()
    assert len({re.search(r"_b=(\d+)", p)[1] for p in paths}) == 1
    old = s.versions.read()[1]["rows"]
    s.put(entries(spark, [("i7", "new", "y")]))
    new = s.versions.read()[1]["rows"]
    assert sum(old[b] != new[b] for b in old) == 1
    plan = s.get("i7")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(id,i7)" in plan


def test_two_writers_lose_no_row(spark, tmp_path):
    root = str(tmp_path / "s")
    EntryStore(spark, root, buckets=4).put(entries(spark, [("start", "h", "c")]))
    failed = []

    def work(name):
        try:
            mine = EntryStore(spark, root)
            for k in range(3):
                mine.put(entries(spark, [(f"{name}{k}", f"{name}{k}", "c"), ("both", f"shared{k}", name)]))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in "xy"]
    for t in threads:
        t.start()
    for t in threads:
        t.join(100)
    assert not failed
    got = {i for i, _, _ in stored(EntryStore(spark, root))}
    assert got == {"start", "both", *(f"{n}{k}" for n in "xy" for k in range(3))}
    assert Versions(spark, root).numbers() == list(range(1, 8))


def test_a_local_folder_is_no_shared_one_on_a_cluster():
    from types import SimpleNamespace

    from quillstone.operators.store import shared_folder

    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    session = lambda master: SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))
    assert shared_folder(session("local[4]")).startswith("file://")
    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_folder(session(master))


def test_a_version_is_taken_once(spark, tmp_path):
    v = Versions(spark, str(tmp_path / "v"))
    v.commit(1, {"a": 1})
    with pytest.raises(Conflict):
        v.commit(1, {"a": 2})
    assert v.read() == (1, {"a": 1}) and v.change(lambda n, m: None) == 1


def ranked(df):
    return sorted((r.path, r.line, r["rank"]) for r in df.collect())


def test_index_equals_ranking_from_scratch_after_every_change(spark, tmp_path):
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "Eta", "x1"]
    text = lambda: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(rng.randint(1, 12)))
    tree, index = {f"f{i}": (text(), 1) for i in range(12)}, SearchIndex(spark, str(tmp_path / "i"), buckets=4)
    table = lambda t: spark.createDataFrame([(p, c, m) for p, (c, m) in t.items()], "path string, content string, mtime long")

    def same():
        plain = sources.lines(table(tree), "content", "path", keep_blank=False)
        for q in ("alpha", "beta gamma", "eta X1", "nowhere", ""):
            assert ranked(index.bm25(q, None)) == ranked(search.bm25(plain, "content", q, "path", "line", limit=None)), q

    assert ranked(index.bm25("alpha")) == []
    index.refresh(table(tree))
    same()
    tree["f3"], tree["f4"], tree["new"] = (text(), 2), ("", 2), ("gamma alpha", 5)
    index.refresh(table(tree))
    assert len(index.versions.read()[1]["segments"]) == 2
    same()
    assert index.refresh(table(tree)) == 2  # nothing changed, no new version
    del tree["f5"]
    index.refresh(table(tree), gone=spark.createDataFrame([("f5",), ("never",)], "path string"))
    same()
    old = index.files().where("path = 'f1'").first()
    index.refresh(table({"f1": ("delta", 0)}))  # an older time than the indexed one
    assert index.files().where("path = 'f1'").first() == old
    index.merge()
    assert len(index.versions.read()[1]["segments"]) == 1
    same()
    assert index.vacuum(keep=1) > 0
    same()
    best = index.search("alpha", 3).collect()
    assert best and all("alpha" in r.content for r in best)
    index.rebuild(table({"only": ("beta", 1)}))
    assert [r.path for r in index.files().collect()] == ["only"] and ranked(index.bm25("alpha")) == []


def test_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=32)
    index.refresh(spark.createDataFrame([(f"f{i}", f"word{i} common\nother line{i}", 1) for i in range(60)], "path string, content string, mtime long"))
    p = index.postings(["common"])
    assert {re.search(r"_b=(\d+)", f)[1] for f in p.inputFiles() if "_b=" in f}.__len__() == 1
    plan = index.bm25("common word7")._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [common,word7])" in plan and "content" not in plan
    assert ranked(index.bm25("word7 common")) and p.count() == 60


def test_postings_are_packed_by_the_terms_of_the_search(spark, tmp_path):
    """Terms, counts and buckets are those of the column functions, in ASCII and beyond; a line's terms are not rows before they are counted."""
    from pyspark.sql import functions as F

    texts = ["A-b a_B 12a", "Größe, große “Größe”…x", "naïve\tcafé½ Ⅷ日本語 a", " ", "long " * 50 + "tail"]
    lines = spark.createDataFrame([(f"p{i % 3}", i + 1, x) for i, x in enumerate(texts)], "path string, line int, content string")
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=5)
    packed = index._postings(lines, 7)
    assert "Generate" not in packed._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(tuple(r) for r in packed.collect())
    words = lines.select("path", "line", search.terms(F.col("content")).alias("t")).select("path", "line", F.size("t").alias("n"), F.explode("t").alias("term"))
    want = words.groupBy("term", "path", "line").agg(F.count("*").alias("tf"), F.first("n").alias("n")).select("term", "path", "line", "tf", "n", F.lit(7), F.pmod(F.xxhash64("term"), F.lit(5)).cast("int"))
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 12


def test_postings_are_the_same_in_many_pieces_and_parts(spark, tmp_path, monkeypatch):
    """Pieces of few postings, buckets in parts, a file without a path, counts and lines beyond a byte."""
    from pyspark.sql import functions as F

    from quillstone.operators import search_index

    rng = random.Random(8)
    rows = [(f"p{i % 5}" if i % 7 else None, 300 * i + 1, " ".join(rng.choices(["a", "bé", "c1", "日本", "dd"], k=rng.randint(0, 9)))) for i in range(40)] + [("long", 1, "a " * 70_000 + "b")]
    lines = spark.createDataFrame(rows, "path string, line int, content string")
    index = SearchIndex(spark, str(tmp_path / "i"), buckets=5)
    words = lines.select("path", "line", search.terms(F.col("content")).alias("t")).select("path", "line", F.size("t").alias("n"), F.explode("t").alias("term"))
    found = words.groupBy("term", "path", "line").agg(F.count("*").alias("tf"), F.first("n").alias("n")).select("term", "path", "line", "tf", "n", F.lit(7), F.pmod(F.xxhash64("term"), F.lit(5)).cast("int"))
    want = sorted((tuple(r) for r in found.collect()), key=repr)
    for size, chars in ((1 << 21, 1 << 24), (6, 10_000)):
        monkeypatch.setattr(search_index, "PACK_POSTINGS", size)
        monkeypatch.setattr(search_index, "PACK_LINES", min(size, 5000))
        monkeypatch.setattr(search_index, "TASK_CHARS", chars)
        assert sorted((tuple(r) for r in index._postings(lines, 7).collect()), key=repr) == want


def test_a_refresh_moves_and_writes_little_beside_its_text(spark, tmp_path):
    """The text is written once, with its index, and no text is shuffled; hexadecimal words, which codecs make half as large at most."""
    from quillstone.operators.store import shared_folder
    from tests.llm.test_disk import shuffled

    rng = random.Random(4)
    words = [f"{rng.getrandbits(48):012x}" for _ in range(3000)]
    rows = [(f"f{i}", "\n".join(" ".join(rng.choices(words, k=40)) for _ in range(20)), 1) for i in range(150)]
    size = sum(len(c) for _, c, _ in rows)
    spark.createDataFrame(rows, "path string, content string, mtime long").write.parquet(str(tmp_path / "files"))
    files, index = spark.read.parquet(str(tmp_path / "files")), SearchIndex(spark, str(tmp_path / "i"))
    held = lambda folder: sum(p.stat().st_size for p in Path(folder.removeprefix("file://")).rglob("*") if p.is_file())
    before = held(shared_folder(spark))
    _, moved = shuffled(spark, lambda: index.refresh(files))
    written = held(str(tmp_path / "i")) + held(shared_folder(spark)) - before
    assert moved < size / 2 and written < 1.25 * size, (moved / size, written / size)
