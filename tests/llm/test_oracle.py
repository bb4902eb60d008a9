"""Queries of the training-data operators that SQL can express, against DuckDB on the small tables and on rows made for ties, nulls and copies."""

import duckdb
import pytest

from tests.test_queries import rows
from tracegrid.llm import near_dedup, registry, warc

SF = "/root/testdata/sf0.001"
WORDS = " ".join(f"W{i}" for i in range(60))
DOCS = [(1, WORDS), (2, WORDS.lower()), (3, WORDS + " more"), (4, WORDS + " more and"), (5, None), (6, ""), (7, " \n\t"), (8, "a b"), (9, "A\tB"), (10, "a b c"), (11, WORDS[30:]), (12, "x y z w " * 50), (13, "x y z w " * 3), (14, "é\u00a0ß İ ſ k")]
PAGES = [(1, "h", "x"), (2, "h", None), (3, "h", "x"), (4, None, ""), (5, "h", "y\r\nWARC/1.0\r\n"), (None, "h", "x"), (None, "h", "z")]


def duck(sql, **paths):
    con = duckdb.connect()
    for name, path in paths.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    return rows([c[0] for c in cur.description], cur.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_small_tables(spark, name):
    got = registry.queries()[name](spark, SF)
    want = duck(registry.oracle_sql()[name], **{t: f"{SF}/{t}.parquet" for t in ("documents", "pages", "benchmark")})
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want


@pytest.mark.parametrize("name,module,schema,made", [("op3_warc", warc, "page_id long, url string, html string", PAGES), ("op4_near_dedup", near_dedup, "doc_id long, text string", DOCS)])
def test_made_rows(spark, monkeypatch, tmp_path, name, module, schema, made):
    for i, some in enumerate((made, [])):
        path = f"{tmp_path}/{i}"
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(path)
        monkeypatch.setattr(module, "table", lambda s, *_, path=path: s.read.schema(schema).parquet(path))
        got = registry.queries()[name](spark, "")
        want = duck(registry.oracle_sql()[name], **{"pages" if name == "op3_warc" else "documents": f"{path}/*.parquet"})
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == want and len(want) == len(some)
