"""Every registered query against its SQL in DuckDB, on the small tables."""

import math
import os

import duckdb
import pytest

from tracegrid.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    got = registry.queries()[name](spark, SF)
    data = [tuple(r) for r in got.collect()]
    assert data
    sql = registry.oracle_sql().get(name)
    if not sql:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    a, b = rows(got.columns, data), rows(cols, cur.fetchall())
    assert len(a) == len(b)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]


@pytest.mark.parametrize("name", ["a1_bin_counts", "e6_pulse_blocks", "e9_peaks", "j12_blank_intervals", "w2_smooth_counts", "w11_correct_frames"])
def test_plans_read_little(spark, name):
    """What several steps need is written once, so that a plan doesn't read its source again for each of them."""
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("Relation [") <= 3
