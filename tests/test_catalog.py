"""Every catalogue query with SQL is compared with DuckDB on sf0.01."""

import glob
import os

import duckdb
import pytest

from quillspark.plans import catalog
from quillspark.plans.pipeline import Run, layered, signature


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    if name not in catalog.ORACLES:
        assert got
        return
    r = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == plain(tuple(x[names.index(c)] for c in cols) for x in r.fetchall())


def test_staged_run_resumes(spark, tmp_path):
    made = []

    def double(df, n):
        made.append(n)
        return df.selectExpr(f"id * {n} AS id")

    stages = [("a", double, {"n": 2}), ("b", double, {"n": 3})]
    run = Run(spark, str(tmp_path), "r1", {"q": "x", "max_rows": 5}, stop_after="a")
    assert run.run(stages, spark.range(3)).count() == 3 and made == [2]
    run = Run(spark, str(tmp_path), "r1", {"q": "x", "max_rows": 9})
    assert sorted(r.id for r in run.run(stages, spark.range(3)).collect()) == [0, 6, 12] and made == [2, 3]
    assert signature({"a": 1, "max_rows": 2}) == signature({"a": 1})
    assert layered({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
