"""Cached findings evaluate only what changed; scheduled jobs run once however many runners there are."""

import threading

from quillstone.operators import catalogue, rules
from quillstone.operators.finding_cache import FindingCache
from quillstone.streaming.schedule import Schedule


def tree(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def report(df):
    return sorted(map(tuple, df.collect()))


def test_second_run_evaluates_the_changed_file_only(spark, tmp_path):
    texts = {f"src/f{i}.ts": f"console.log({i});\nconst h = createHash('md5');\neval(x{i})" for i in range(8)} | {"src/g.ts": "clean", "src/none.ts": None}
    cache, todo = FindingCache(spark, str(tmp_path / "c")), catalogue.ANALYZER
    plain = lambda: report(rules.evaluate(tree(spark, texts), todo))
    assert report(cache.findings(tree(spark, {}), todo)) == [] and cache.evaluated == 0
    assert report(cache.findings(tree(spark, texts), todo)) == plain() != [] and cache.evaluated == 10
    assert report(cache.findings(tree(spark, texts), todo)) == plain() and cache.evaluated == 0
    texts["src/f3.ts"] = "eval(y)"
    assert report(FindingCache(spark, str(tmp_path / "c")).findings(tree(spark, texts), todo)) == plain()
    texts["src/g.ts"] = "debugger; eval(z)"
    assert report(cache.findings(tree(spark, texts), todo)) == plain() and cache.evaluated == 1
    del texts["src/f1.ts"]
    assert report(cache.findings(tree(spark, texts), todo)) == plain() and cache.evaluated == 0
    texts["tests/f2.ts"] = texts.pop("src/f2.ts")  # rules choose by path
    assert report(cache.findings(tree(spark, texts), todo)) == plain() and cache.evaluated == 1
    fewer = todo[:-3]
    assert report(cache.findings(tree(spark, texts), fewer)) == report(rules.evaluate(tree(spark, texts), fewer)) and cache.evaluated == 9
    cache.forget(fewer)
    cache.findings(tree(spark, texts), fewer)
    assert cache.evaluated == 9


def test_two_runners_one_job(spark, tmp_path):
    now, ran = [1_000_000_000_000], []
    make = lambda hours=2.0: Schedule(spark, str(tmp_path / "s"), hours, lease_ms=60_000, clock=lambda: now[0])
    gate = threading.Event()

    def job():
        ran.append(1)
        gate.wait(20)
        return {"entries_before": 10, "entries_after": 7}

    results = []
    threads = [threading.Thread(target=lambda: results.append(make().run(job))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(3)
    gate.set()
    for t in threads:
        t.join(30)
    assert len(ran) == 1 and sum(r is not None for r in results) == 1
    s = make().status()
    assert (s["running"], s["total_runs"], s["last_run"], s["next_run"]) == (False, 1, now[0], now[0] + 7_200_000)
    assert s["last_result"]["entries_after"] == 7 and s["last_result"]["success"]
    assert make().run(job) is None  # not due
    now[0] += 7_200_000

    def broken():
        raise ValueError("no store")

    assert make().run(broken)["success"] is False
    assert make().status()["last_result"]["error"] == "no store" and make().status()["total_runs"] == 2
    assert make(0).run(job) is None and make(0).status()["next_run"] is None
    assert make(0).run(job, force=True)["success"]


def test_an_expired_lease_is_taken_over_and_its_holder_records_nothing(spark, tmp_path):
    now = [5_000]
    make = lambda: Schedule(spark, str(tmp_path / "s"), 1, lease_ms=1_000, clock=lambda: now[0])

    def slow():
        now[0] += 2_000
        assert make().run(lambda: {"by": "second"})["by"] == "second"
        return {"by": "first"}

    assert make().run(slow) is None
    assert make().status()["last_result"]["by"] == "second" and make().status()["total_runs"] == 1
