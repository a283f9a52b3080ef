"""Texts stay where they are: what near-duplicate detection shuffles and decontamination writes is small beside them."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import near_dedup
from quillstone.llm.common import among, only_among, scratch_root
from quillstone.llm.decontamination import drop_leaks
from tests.llm.helpers import docs


def hexes(seed, n):
    """Words that no codec makes much smaller."""
    rng = random.Random(seed)
    return [f"{rng.getrandbits(64):016x}" for _ in range(n)]


def rows_with_copies():
    """100 long texts, of which four are copies or near copies, one under a repeated doc_id; an empty one and a null one."""
    plain = [(d, hexes(d, 1200)) for d in range(96)]
    copies = [(100, plain[3][1]), (101, [*plain[3][1], "x"]), (102, plain[5][1]), (7, plain[7][1])]
    return [*[(d, " ".join(w)) for d, w in [*plain, *copies]], (200, ""), (201, None)]


def shuffled(spark, run):
    """What ``run`` returns, and the bytes that its stages wrote to shuffles."""
    sc = spark.sparkContext
    jsc, none = sc._jsc.sc(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        jsc.listenerBus().waitUntilEmpty(30_000)
        found = jsc.statusStore().stageList(None, False, False, none, None)
        return {s.stageId(): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


@pytest.mark.parametrize("few", [near_dedup.FEW, -1])
def test_texts_of_no_near_copy_are_not_shuffled(spark, monkeypatch, few):
    monkeypatch.setattr(near_dedup, "FEW", few)
    rows = rows_with_copies()
    size = sum(len(t or "") for _, t in rows)
    d = docs(spark, rows)
    found, linking = shuffled(spark, lambda: near_dedup.near_duplicates(d).collect())
    assert {r.doc_id: r.component_id for r in found if r.doc_id != r.component_id} == {100: 3, 101: 3, 102: 5}
    assert linking < size / 2, (linking, size)


def test_texts_that_stay_are_not_shuffled(spark):
    rows = rows_with_copies()
    d, size = docs(spark, rows), sum(len(t or "") for _, t in rows)
    left, dropping = shuffled(spark, lambda: [r.doc_id for r in near_dedup.drop_near_duplicates(d).collect()])
    assert sorted(left) == [*range(96), 200, 201]
    assert dropping < size / 2, (dropping, size)


def written(spark):
    top = scratch_root(spark).removeprefix("file://")
    return sum(os.path.getsize(f"{at}/{x}") for at, _, names in os.walk(top) for x in names)


def test_decontamination_writes_no_copy_of_the_texts(spark):
    rows = [*rows_with_copies(), (None, " ".join(hexes(3, 1200)))]
    bench = spark.createDataFrame([(1, " ".join(hexes(3, 40))), (2, " ".join(hexes(500, 40)))], "item_id long, text string")
    d, before = docs(spark, rows).withColumns({"_slot": F.lit(1), "_at": F.lit(2), "th": F.lit("x")}), written(spark)
    left = drop_leaks(d, bench)
    assert left.columns == d.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(x for x, _ in rows if x not in (3, 100, 101, None))
    assert written(spark) - before < sum(len(t or "") for _, t in rows) / 4


def test_marks_miss_no_key_and_few_others(spark):
    keys = spark.createDataFrame([(3 * i, None if i % 5 else i) for i in range(500)], "a long, b long")
    others = spark.createDataFrame([(3 * i + 1, i) for i in range(2000)], "a long, b long")
    assert only_among(keys, keys, ["a", "b"]).count() == 500
    assert only_among(others, keys, ["a", "b"]).count() <= 5
    marked = among(others, keys.limit(0), ["a", "b"], "m")
    assert marked.columns == ["a", "b", "m"] and marked.where("not m").count() == 2000
