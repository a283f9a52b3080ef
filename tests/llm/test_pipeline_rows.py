"""The pipeline's stages on empty tables, odd rows, clashing columns and a text over one Arrow batch's bytes."""

import pytest

from tests.llm.helpers import odd_rows, text

CLASH = "doc_id long, text string, lang string, source string, n_chars long, _row long, h string, kind int, start int, label string, size long, cands string"


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(900, 40)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def staged(spark, rows, schema, folder):
    """Rows after each stage, each written and read again."""
    import corpus_pipeline

    docs, out = spark.createDataFrame(rows, schema), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, folder)
        if name != "packing":
            assert got.columns == docs.columns
        got.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs)
    return out


def test_stages_on_an_empty_table(spark, folder):
    assert [d.count() for d in staged(spark, [], CLASH, folder)] == [0] * 5


def test_stages_on_odd_rows_and_clashing_columns(spark, folder):
    huge = text(77, 900_000)  # over 4 MB
    assert len(huge) > 4 << 20
    leak = text(901, 60) + " " + text(900, 40)
    plain = [*odd_rows(), (20, huge), (21, text(21, 200) + " mail bob@x.org now"), (21, text(21, 200) + " mail bob@x.org now"), (22, leak), (23, text(23, 150))]
    rows = [(d, t, "en", "s", len(t or ""), 7, "h", 1, 2, "x", 3, None) for d, t in plain]
    quality, near, clean, private, packed = staged(spark, rows, CLASH, folder)
    ids = lambda df: sorted((r.doc_id is not None, r.doc_id or 0) for r in df.select("doc_id").collect())
    kept = {d for _, d in ids(quality)}
    assert {20, 21, 22, 23} <= kept and not {1, 2, 3, 4, 5} & kept  # null, empty and blank texts go, the short ones fail the rule
    assert ids(near).count((True, 21)) == 1 and (True, 20) in ids(near)
    assert (True, 22) not in ids(clean) and {(True, 20), (True, 21), (True, 23)} <= set(ids(clean))
    texts = {r.doc_id: (r.text, r.n_chars) for r in private.where("doc_id in (20, 21, 23)").collect()}
    assert texts[21][0].endswith("mail <EMAIL> now") and texts[21][1] == len(texts[21][0]) and texts[20][0] == huge
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {d for _, d in ids(private)}
    assert packed.where("doc_id = 20").groupBy().sum("length").first()[0] == packed.where("doc_id = 20").first().doc_tokens
