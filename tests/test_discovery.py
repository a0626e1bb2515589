"""Captured pages as a data source, and the control of calls."""

import json

from pyspark.sql import functions as F

from quillspark.sources import pages, payloads as J
from quillspark.streaming import calls


def work(i, year=2020, kind="article", doi=True):
    return {"id": f"W{i}", "doi": f"https://doi.org/10.1/W{i}" if doi else None, "title": f"Work {i}", "publication_year": year, "type": kind, "primary_location": {"landing_page_url": f"u{i}", "source": {"display_name": "J"}}, "abstract_inverted_index": {"a": [0], f"w{i}": [1]}}


def put(root, provider, query, number, data, end=""):
    at = root / provider / query
    at.mkdir(parents=True, exist_ok=True)
    text = data if isinstance(data, str) else json.dumps(data)
    (at / f"page-{number}{end}.{'xml' if text.startswith('<') else 'json'}").write_text(text)


def test_pages_are_read_as_the_provider_would_answer(spark, tmp_path):
    first = [work(i, 2015 + i % 8, "article" if i % 3 else "review") for i in range(200)]
    put(tmp_path, "openalex", "q001", 1, {"results": first})
    put(tmp_path, "openalex", "q001", 2, {"results": [work(5), work(300, None), work(301, 2019, doi=False), work(301, 2019, doi=False)]})
    put(tmp_path, "openalex", "q001", 3, {"results": []})
    put(tmp_path, "openalex", "q001", 4, {"results": [work(999)]})  # never reached
    put(tmp_path, "openalex", "q002", 1, {"results": [work(1)]})
    rows = pages.search(spark, str(tmp_path), "openalex").orderBy("query_id", "discovery_rank").collect()
    assert len(rows) == 204 and [r.discovery_rank for r in rows[:203]] == list(range(1, 204)) and rows[1].doi == "10.1/w1" and rows[1].abstract == "a w1"
    # equal to the reader of whole pages
    whole = spark.createDataFrame([(n, (tmp_path / "openalex" / "q001" / f"page-{n}.json").read_text()) for n in (1, 2)], "_ord long, payload string")
    want = {(r.title, r.doi, r.publication_year, r.abstract, r.landing_page_url) for r in J.read("openalex", whole).collect()}
    assert {(r.title, r.doi, r.publication_year, r.abstract, r.landing_page_url) for r in rows[:203]} == want
    few = pages.search(spark, str(tmp_path), "openalex", year_from=2017, year_to=2018, types="review", max_results=7).where("query_id = 'q001'").orderBy("discovery_rank").collect()
    assert [r.title for r in few] == [f"Work {i}" for i in range(200) if i % 3 == 0 and i % 8 in (2, 3)][:7]


def test_filters_reach_the_reader(spark, tmp_path):
    for q in ("q001", "q002"):
        put(tmp_path, "openalex", q, 1, {"results": [work(i, 2010 + i if i else None, "article" if i % 2 else "review") for i in range(10)]})
    put(tmp_path, "arxiv", "q001", 1, "<feed></feed>")
    load = lambda **k: pages.load(spark, str(tmp_path), fields="title", **k)
    only = load(only={"provider": "openalex", "query_id": "q002", "year": (2013, 2017), "type": ["article", "x"]})
    cut = only.where("length(record) > 3")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan
    above = " ".join(x for x in plan.splitlines() if "Filter" in x and "BatchScan" not in x)
    assert "length" in above and "year" not in above and "query_id" not in above, plan
    assert cut.rdd.getNumPartitions() == 1
    rows = cut.orderBy("place").collect()
    assert [(r.year, json.loads(r.record)) for r in rows] == [(2010 + i, {"title": f"Work {i}"}) for i in (3, 5, 7)]
    # one table in several plans: filters that load did not state stay with Spark
    df = load()
    assert df.where("year >= 2013").count() == 14 and df.where("year is null or year > 2018").count() == 4 and df.count() == 20
    assert df.where("query_id = 'q001'").unionAll(df.where("query_id = 'q002' and year = 2015")).count() == 11
    assert only.where("year = 2013").unionAll(only.where("year >= 2015")).count() == 3 and only.count() == 3
    # a filter above a cap does not let other rows in
    assert load(providers="openalex", max_results=3, only={"year": (2012, None)}).count() == 2


def test_every_provider_and_how_its_calls_end(spark, tmp_path):
    paper = lambda i: {"paperId": str(i), "title": f"P {i}", "year": 2020, "externalIds": {"DOI": f"10.2/{i}"}}
    put(tmp_path, "semantic_scholar", "q1", 1, {"data": [paper(i) for i in range(100)]})
    put(tmp_path, "semantic_scholar", "q1", 2, {"data": [paper(i) for i in range(100, 150)]})  # a short page ends it
    put(tmp_path, "semantic_scholar", "q1", 3, {"data": [paper(999)]})
    put(tmp_path, "semantic_scholar", "q2", 1, {"data": [paper(i) for i in range(100)]})
    put(tmp_path, "semantic_scholar", "q2", 2, {"status": "rate_limited", "http_status": 429, "transient": True, "retry_after_seconds": 30.0, "error": "limited"}, ".error")
    entry = lambda i, y: f'<entry><id>http://arxiv.org/abs/{i}</id><title>T {i}</title><published>{y}-01-01</published><arxiv:doi xmlns:arxiv="http://arxiv.org/schemas/atom">10.3/{i}</arxiv:doi><link href="u{i}" rel="alternate"/></entry>'
    put(tmp_path, "arxiv", "q1", 1, f'<feed xmlns="http://www.w3.org/2005/Atom">{entry(1, 2001)}{entry(2, 2010)}{entry(1, 2001)}{entry(3, "x")}</feed>')
    put(tmp_path, "europe_pmc", "q1", 1, {"nextCursorMark": "b", "resultList": {"result": [{"id": "7", "source": "MED", "title": "E <i>one</i>", "pubYear": "2001"}]}})
    put(tmp_path, "europe_pmc", "q1", 2, {"nextCursorMark": "", "resultList": {"result": [{"id": "7", "source": "MED", "title": "again"}, {"id": "8", "source": "PPR", "title": "E two", "doi": "10.4/b"}]}})
    put(tmp_path, "europe_pmc", "q1", 3, {"resultList": {"result": [{"id": "9", "title": "not reached"}]}})
    put(tmp_path, "openalex", "q1", 1, {"results": []})
    put(tmp_path, "openalex", "q2", 1, "no json")
    got = {(r.provider, r.query_id): (r.pages, r.returned_count, r.status, r.retry_after_seconds) for r in pages.load(spark, str(tmp_path), what="calls").collect()}
    assert got == {
        ("semantic_scholar", "q1"): (2, 150, "ok", ""), ("semantic_scholar", "q2"): (1, 100, "partial_rate_limited", "30"), ("arxiv", "q1"): (1, 3, "ok", ""), ("europe_pmc", "q1"): (2, 2, "ok", ""),
        ("openalex", "q1"): (1, 0, "empty_result", ""), ("openalex", "q2"): (0, 0, "response_parse_error", ""),
    }
    years = pages.search(spark, str(tmp_path), "arxiv", year_from=2005).orderBy("discovery_rank").collect()
    assert [(r.arxiv_id, r.doi, r.landing_page_url) for r in years] == [("2", "10.3/2", "u2"), ("3", "10.3/3", "u3")]  # an unreadable year passes
    epmc = pages.search(spark, str(tmp_path), "epmc").orderBy("discovery_rank").collect()
    assert [(r.title, r.pmid) for r in epmc] == [("E one", "7"), ("E two", "")]
    every = pages.discovered(spark, str(tmp_path), ["openalex", "semantic_scholar", "arxiv", "europe_pmc"])
    assert every.groupBy("discovery_provider").count().count() == 3 and every.where("title is null").isEmpty()
    assert pages.load(spark, f"{tmp_path}/none").count() == 0


def plan(spark, *rows):
    """(query, provider, second, status, retry after, transient, rows)"""
    data = [("r1", p, f"q{i}", q, i, float(s), 10, st, n, "boom" if st != "ok" else "", "", tr, ra) for i, (q, p, s, st, ra, tr, n) in enumerate(rows)]
    df = spark.createDataFrame(data, "run_id string, provider string, query_id string, query string, q long, s double, max_results int, status string, returned_count int, error string, http_status string, transient_error string, retry_after_seconds string")
    return df.withColumn("at", F.timestamp_seconds("s")).drop("s")


def decided(df, run="r1"):
    return [(r.provider, r.status, r.made) for r in df.where(F.col("run_id") == run).orderBy("q").collect()]


def test_breaker_cooldown_and_cached_failures(spark, tmp_path):
    broken = [("query one", "openalex", 0, "error", "", "", 0), ("query two", "openalex", 1, "error", "", "", 0), ("query three", "openalex", 2, "ok", "", "", 5)]
    limited = [("query one", "semantic_scholar", 0, "rate_limited", "120", "true", 0), ("query two", "semantic_scholar", 3, "ok", "", "", 2), ("query three", "semantic_scholar", 121, "ok", "", "", 2)]
    batch = plan(spark, *broken, *limited).repartition(3)
    out = calls.run(batch, f"{tmp_path}/c", threshold=1, cooldown_seconds=30)
    assert decided(out) == [
        ("openalex", "error", True), ("openalex", "skipped_circuit_breaker", False), ("openalex", "skipped_circuit_breaker", False),
        ("semantic_scholar", "rate_limited", True), ("semantic_scholar", "skipped_rate_limit_cooldown", False), ("semantic_scholar", "skipped_circuit_breaker", False),
    ]
    rows = {r.q: r for r in out.collect()}
    assert rows[1].status_class == "skipped" and rows[1].error == "Skipped after 1 failed provider call(s) in this discovery run." and "inspect_error" in rows[0].next_action
    assert rows[3].retry_after_seconds == "120" and "retry_provider" in rows[3].next_action and rows[4].retry_after_seconds == "117" and rows[3].cache_status == "store"
    # a later run: the failure of the same query is still cached, other queries are called; then it has ended
    more = plan(spark, ("query one", "semantic_scholar", 60, "ok", "", "", 2), ("query five", "semantic_scholar", 61, "ok", "", "", 2), ("query one", "semantic_scholar", 130, "ok", "", "", 2)).withColumn("run_id", F.lit("r2"))
    again = calls.run(more, f"{tmp_path}/c", threshold=1, cooldown_seconds=30)
    assert decided(again, "r2") == [("semantic_scholar", "skipped_cached_provider_failure", False), ("semantic_scholar", "ok", True), ("semantic_scholar", "ok", True)]
    assert decided(again) == decided(out) and again.where("cache_status = 'hit'").first().error.startswith("Skipped due to cached provider failure: status=rate_limited; next_action=retry_provider")


def test_partial_and_permanent_failures_are_not_cached(spark, tmp_path):
    rows = [("a", "x", 0, "network_error", "", "", 0), ("a", "x", 1, "ok", "", "", 1), ("b", "y", 0, "partial_network_error", "", "", 4), ("b", "y", 1, "ok", "", "", 1), ("c", "z", 0, "http_500", "", "false", 0), ("c", "z", 1, "ok", "", "", 1)]
    out = calls.run(plan(spark, *rows), f"{tmp_path}/c")
    assert [s for _, s, _ in decided(out)] == ["network_error", "skipped_cached_provider_failure", "partial_network_error", "ok", "http_500", "ok"]
    none = calls.run(plan(spark, *rows), f"{tmp_path}/d", failure_ttl_seconds=None)
    assert all(made for _, _, made in decided(none))
