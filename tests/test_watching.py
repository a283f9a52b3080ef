"""The tail source over appended, truncated, split and vanished files, and the watcher's timers."""

import json
import time

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone import sources
from quillstone.sources import tailing
from quillstone.streaming import watching


def step(spark, folder, out, split=None):
    """One run of the tail from its checkpoint: the new (file, value) in order."""
    before = spark.read.schema(tailing.SCHEMA).parquet(f"{out}/rows").count() if (out / "rows").exists() else 0
    s = sources.tail(spark, str(folder))
    if split:
        s = spark.readStream.format("jsonl_tail").option("splitBytes", split).load(str(folder))
    q = s.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(tailing.SCHEMA).parquet(f"{out}/rows")
    got = [(r.session, r.value) for r in rows.orderBy("path", "position").collect()]
    return got, rows.count() - before


def test_tail_reads_what_is_appended(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    (folder / "deep").mkdir(parents=True)
    a, b = folder / "a.jsonl", folder / "deep" / "b.jsonl"
    a.write_text("Line 1\n\n \nLine 2")
    (folder / "other.txt").write_text("no transcript\n")
    assert step(spark, folder, out) == ([("a", "Line 1")], 1)
    with a.open("a") as f:
        f.write(" completed\nLine 3\n")
    b.write_text("é1\n")
    assert step(spark, folder, out) == ([("a", "Line 1"), ("a", "Line 2 completed"), ("a", "Line 3"), ("b", "é1")], 3)
    assert step(spark, folder, out)[1] == 0
    a.write_text("New 1\n")  # shorter than before: read again from its start
    got, n = step(spark, folder, out)
    assert n == 1 and ("a", "New 1") in got
    b.unlink()
    assert step(spark, folder, out)[1] == 0
    b.write_text("back\n")
    got, n = step(spark, folder, out)
    assert n == 1 and ("b", "back") in got


def test_tail_of_a_missing_folder_has_no_rows(spark, tmp_path):
    reader = tailing.TailReader({"path": str(tmp_path / "none")})
    assert reader.latestOffset() == {"files": {}} and reader.partitions({"files": {}}, {"files": {}}) == []
    gone = tailing.Part(str(tmp_path / "gone.jsonl"), 0, 9, 0, 9)
    assert list(tailing.TailReader({"path": str(tmp_path)}).read(gone)) == []


def test_ranges_split_anywhere_give_each_line_once(tmp_path):
    lines = [f"{i}" * (i % 23) for i in range(200)] + ["é" * 300, "x" * 200_000, "end"]
    path = tmp_path / "a.jsonl"
    path.write_bytes(("\n".join(lines) + "\nunfinished").encode())
    want = [x for x in lines if x.strip()]
    for split in (1, 7, 64, 1000, 1 << 20):
        if split < 64:
            path.write_bytes(("\n".join(lines[:60]) + "\nunfinished").encode())
            want = [x for x in lines[:60] if x.strip()]
        else:
            path.write_bytes(("\n".join(lines) + "\nunfinished").encode())
            want = [x for x in lines if x.strip()]
        reader = tailing.TailReader({"path": str(tmp_path), "splitbytes": str(split)})
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        got = [v for p in parts for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert got == want, split


def test_offsets_move_by_whole_lines(tmp_path):
    path = tmp_path / "a.jsonl"
    reader = tailing.TailReader({"path": str(tmp_path)})
    path.write_bytes(b"x" * 100_000)
    first = reader.latestOffset()
    assert first["files"][str(path)] == [0, 100_000]
    with path.open("ab") as f:
        f.write(b"y\nz")
    second = reader.latestOffset()
    assert second["files"][str(path)] == [100_002, 100_003]
    assert [(p.begin, p.end) for p in reader.partitions(first, second)] == [(0, 100_002)]
    assert json.loads(json.dumps(second)) == tailing.TailReader({"path": str(tmp_path)}).latestOffset()


def wait_for(q: StreamingQuery, test, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not test():
        assert q.exception() is None, q.exception()
        time.sleep(0.2)
    assert test()


def test_a_burst_is_one_run_and_a_large_session_asks_for_an_optimisation(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    say = lambda role, text: json.dumps({"role": role, "content": text}) + "\n"
    entries = watching.entries_of(sources.tail(spark, str(folder)))
    bursts = watching.watch(entries, debounce_ms=4000, budget=100_000, window=3)
    write = lambda df, n: df.write.mode("append").parquet(f"{out}/rows")
    q = bursts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{out}/state").trigger(processingTime="300 milliseconds").start()
    read = lambda: spark.read.schema(watching.BURST).parquet(f"{out}/rows").orderBy("session", "burst").collect() if (out / "rows").exists() else []
    try:
        for i in range(4):  # one burst over several micro-batches
            with (folder / "small.jsonl").open("a") as f:
                f.write(say("user", f"word{i} is here") * 2)
            time.sleep(0.7)
        assert not read()
        wait_for(q, read)
        (folder / "big.jsonl").write_text(say("user", "alpha beta gamma " * 15_000) + say("assistant", "delta epsilon " * 1000))
        with (folder / "small.jsonl").open("a") as f:
            f.write(say("user", "later"))
        wait_for(q, lambda: len(read()) >= 3)
        time.sleep(1)
    finally:
        q.stop()
    got = [(r.session, r.burst, r.lines, r.total_lines, r.entries) for r in read()]
    assert got == [("big", 1, 2, 2, 2), ("small", 1, 8, 8, 3), ("small", 2, 1, 9, 3)]
    rows = {(r.session, r.burst): r for r in read()}
    assert rows["big", 1].alert and rows["big", 1].tokens >= 60_000 and not rows["small", 1].alert
    assert rows["small", 1].evicted == 1 and rows["small", 2].evicted == 2
    assert watching.alerts(spark.read.schema(watching.BURST).parquet(f"{out}/rows")).select(F.col("session")).collect()[0].session == "big"


def test_window_keeps_critical_then_hybrid_scores():
    e = lambda h, ts, score, critical=False: (h, "", 1, ts, 1, score, 0, critical)
    live = [e("old", 0, 0.9), e("crit", 0, 0.1, True), e("new", 100, 0.2), e("mid", 50, 0.9)]
    # 0.54, always, 0.52, 0.74
    assert [x[0] for x in watching.evict(live, 3)] == ["old", "crit", "mid"]
    assert watching.evict(live, 4) == live


def test_a_restored_watcher_goes_on_as_one_never_stopped(spark, tmp_path):
    say = lambda text: json.dumps({"role": "user", "content": text}) + "\n"
    first = "".join(say(f"alpha{i} beta gamma" * 3) for i in range(6))
    then = "".join(say(f"delta{i} beta" * 3) for i in range(4)) + say("alpha5 beta gamma" * 3)

    def run(name, texts, initial=None, base=0):
        folder, out = tmp_path / name, tmp_path / f"{name}-out"
        folder.mkdir()
        lines = sources.tail(spark, str(folder)).withColumn("position", F.col("position") + base)
        q = watching.sessions_again(lines, initial, debounce_ms=500, window=7).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(processingTime="200 milliseconds").start()
        read = lambda: spark.read.schema(watching.BURST).parquet(f"{out}/rows").orderBy("burst").collect() if (out / "rows").exists() else []
        try:
            for k, t in enumerate(texts):
                with (folder / "s.jsonl").open("a") as f:
                    f.write(t)
                wait_for(q, lambda k=k: len(read()) == k + 1)
        finally:
            q.stop()
        return read(), f"{out}/state"

    whole, _ = run("whole", [first, then])
    part, state = run("part", [first])
    kept = watching.export_state(spark, state)
    assert [(r.session, r.burst, r.total, len(r.entries)) for r in kept.collect()] == [("s", 1, 6, 6)]
    kept.write.json(f"{tmp_path}/export")
    back = spark.read.schema(watching.STATE).json(f"{tmp_path}/export")
    broken = spark.createDataFrame([("other", None, None, None, None, None), (None, 1, 1, 1, 1, None)], watching.STATE)
    rest, _ = run("rest", [then], back.unionByName(broken), base=len(first.encode()))
    assert [r.asDict() for r in part + rest] == [r.asDict() for r in whole]
    assert whole[1].burst == 2 and whole[1].evicted > 0
