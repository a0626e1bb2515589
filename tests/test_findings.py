"""Faults that were found in review; each test failed before its fix."""

from quillspark.operators import probe as P
from quillspark.sources.candidates import web_leads


def test_rows_of_one_address_keep_their_own_fetch(spark):
    url = "https://pub.example.org/a"
    queue = spark.createDataFrame([(0, "", url), (1, "", url), (2, "", url)], "_ord long, doi string, publisher_url string")
    page = lambda o, status: (o, url, url, status, "text/html", "<html>x", "")
    pages = spark.createDataFrame([page(0, "200"), page(2, "503")], "_ord long, start_url string, url string, status string, content_type string, body string, error string")
    state = lambda df: [r.access_status for r in P.probe(queue, df, "now").orderBy("_ord").collect()]
    assert state(pages) == ["landing_page", "network_error", "server_error"]
    assert state(pages.where("_ord = 0").drop("_ord")) == ["landing_page"] * 3


def test_year_of_a_lead_comes_from_the_snippet_before_the_address(spark):
    rows = [(0, "https://a.org/en/1989", "seen 2021"), (1, "https://a.org/en/1989", "seen"), (2, "https://a.org/x", "")]
    got = web_leads(spark.createDataFrame(rows, "_ord long, link string, snippet string")).orderBy("_ord").collect()
    assert [r.publication_year for r in got] == ["2021", "1989", ""]


def test_lists_that_are_not_read_are_not_made(spark, sf):
    from quillspark.operators import dedupe as D
    from quillspark.sources.candidates import candidates

    rows = D.dedupe(candidates(spark, sf))
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(rows.select("_ord", "title", "abstract")) == 0 and joins(rows.select("_ord", "alternate_titles")) == 1


def test_rows_are_computed_once_before_they_are_numbered(spark, sf):
    from pyspark.sql import functions as F

    from quillspark.operators import tables as B

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        seen.add(1)
        return x

    got = B.with_ord(spark.range(1000, numPartitions=3).select(counted("id").alias("x")), F.desc("x"))
    assert got.where("_ord + x <> 999").count() == 0 and seen.value == 1000


def test_trimming_white_space_and_later_matches(spark):
    from pyspark.sql import functions as F

    from quillspark.functions import concepts as C, text as T

    cases = ["", " ", "\n\t　", " a ", "a\n", "  a  b \n c\u0085", "a\r\n\r\nb", "no the. " + "x " * 50 + "the", "no the", "μ  the"]
    df = spark.createDataFrame([(x,) for x in cases], "x string")
    old = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    assert df.where((T.strip("x") != old("x")) | (T.squeeze("x") != old(F.regexp_replace("x", r"(?U)\s+", " ")))).count() == 0
    assert [r[0] for r in df.select(C.basic_match(T.plain("x"), C.java_pattern("the"))).collect()[7:]] == [True, False, True]


def test_records_are_read_once_and_rows_without_a_key_all_stay(spark):
    import json

    from pyspark.sql import functions as F

    from quillspark.sources import payloads as J

    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    record = lambda **k: json.dumps({"resultList": {"result": [k, k]}})
    rows = [(o, record(doi=f"10.1/{o % 10}", title=f"t{o}", pubYear="2001")) for o in range(30)] + [(o, record(pubYear="2001")) for o in range(30, 40)] + [(40, record(pubYear="1980", doi="10.1/old"))]
    got = J.read("europe_pmc", spark.createDataFrame(rows, "_ord long, payload string").select("_ord", counted("payload").alias("payload")), year_from=2000, year_to=2010).select("_ord", "pos", "title").collect()
    assert sorted(map(tuple, got)) == [(o, 0, f"t{o}") for o in range(10)] + [(o, p, "") for o in range(30, 40) for p in range(2)]
    assert seen.value == len(rows)
