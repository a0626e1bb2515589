"""The cascade is exact: long lists, several shards, colliding hashes, lists from files."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import queries, urlfilter


def pages(spark, n):
    return spark.range(n).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), "id", F.lit(".org/p")).alias("url"))


def wrong(df, every):
    return df.where((F.col("verdict") == "block") != (F.col("page_id") % every == 0)).count()


def listed(spark, n, every):
    return spark.range(0, n, every).select(F.concat(F.lit("h"), "id", F.lit(".org")).alias("key"))


def test_long_list(spark):
    n = 400_000
    out = urlfilter.judge(pages(spark, n), listed(spark, n, 4), rules=[])  # 100,000 listed keys
    assert out.count() == n and wrong(out, 4) == 0
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_shards(spark):
    n = 6_000
    out = urlfilter.judge(pages(spark, n), listed(spark, n, 3), rules=[], shard_bits=4_096)
    assert len(out.inputFiles()) > 1 and out.count() == n and wrong(out, 3) == 0


def test_collisions(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 1)
    monkeypatch.setattr(urlfilter, "HASHES", 1)
    rows = pages(spark, 3_000).cache()
    out = urlfilter.judge(rows, listed(spark, 3_000, 2), rules=[])
    assert wrong(out, 2) == 0  # many levels, none of them selective
    salted = urlfilter._salted
    # keys that collide fully at the first level part at the second
    monkeypatch.setattr(urlfilter, "_salted", lambda salt, key: F.lit(5).cast("long") if salt < urlfilter.HASHES else salted(salt, key))
    assert wrong(urlfilter.judge(rows, listed(spark, 3_000, 2), rules=[]), 2) == 0
    monkeypatch.setattr(urlfilter, "_salted", lambda salt, key: F.lit(5).cast("long"))
    monkeypatch.setattr(urlfilter, "MAX_LEVELS", 4)
    with pytest.raises(RuntimeError):
        urlfilter.judge(rows, listed(spark, 3_000, 2), rules=[])


def test_query_with_a_list_file(spark, sf, tmp_path):
    (tmp_path / "list.txt").write_text("# hosts\n\n WWW.theron.example.org \nabsent.example\n" + "\n".join(f"h{i}.net" for i in range(5_000)))
    hosts = {r.host for r in queries.op7_urls(spark, sf).select("host").collect()}
    pick = sorted(hosts)[::3]
    with open(tmp_path / "list.txt", "a") as f:
        f.write("\n" + "\n".join(pick))
    own = urlfilter.read_list(spark, str(tmp_path / "list.txt"))
    assert own.count() >= 5_000
    for r in queries.op7_urls(spark, sf, own).collect():
        assert r.listed == (r.host in pick or r.host == "www.theron.example.org")


def test_extra_columns_and_nulls(spark):
    df = spark.createDataFrame([(None, None, "a", True), (1, "http://h0.org/", "b", None), (1, "http://h0.org/", "b", None)], "page_id long, url string, key string, listed boolean")
    got = [tuple(r) for r in urlfilter.judge(df, listed(spark, 3, 3)).orderBy("page_id").collect()]
    assert got == [(None, "", "", None, "allow", False)] + [(1, "h0.org", "/", None, "block", True)] * 2
    assert urlfilter.judge(df, listed(spark, 0, 3)).where("listed").count() == 0
