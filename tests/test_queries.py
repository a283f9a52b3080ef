"""Every query with an oracle gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillstone.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables are absent")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return str(v) if v is not None and not isinstance(v, bool) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] or name in ("churn_hotspots", "near_duplicates", "graph_cycles", "debt_overdue", "bm25_search")
    if name in registry.SQL:
        rel = duck.sql(registry.SQL[name])
        want = rows(rel.columns, rel.fetchall())
        assert got[0] == want[0]
        assert got[1] == want[1]
