import pytest
from pyspark.sql import functions as F

from quillspark.functions import concepts as C, status as S, text as T
from quillspark.operators import dedupe as D, metrics as M, probe as P, queue as Q, tables as B, triage as G, verify as V
from quillspark.sources import payloads as J


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [
    ("https://doi.org/10.4321/(AB)77:5)", "10.4321/(ab)77:5)"),
    ("doi:10.4321/own.case).", "10.4321/own.case"), (" HTTP://DX.DOI.ORG/10.1/A.;, ", "10.1/a"), (None, ""), ("10.1/a]", "10.1/a"), ("10.1/[a]", "10.1/[a]"),
])
def test_doi(spark, given, want):
    assert one(spark, T.doi("v"), v=given) == want


def test_text_functions(spark):
    assert one(spark, T.title("v"), v="  A-b: C!  ") == "a b c"
    assert one(spark, T.journal("v"), v="The Journal of A &amp; B") == "a and b"
    assert one(spark, T.plain("v"), v="H<sub>2</sub>O  μm₂") == "H 2 O um2"
    assert one(spark, T.year("v"), v="seen 2021-03") == 2021
    assert one(spark, T.truncate("v", 5), v="abc defgh") == "abc..."
    assert one(spark, T.items("v"), v=" a; |b ") == ["a", "b"]


@pytest.mark.parametrize("text, hit", [
    ("grown without the green apple", False), ("a green apple fell", True),
    ("not one green apple at first, then a b c d e f g green apple", True), ("", False),
])
def test_negation(spark, text, hit):
    c = C.parse_spec("fruit=green apple")
    assert one(spark, C.matches(c, ["abstract"]), abstract=text) is hit


def test_boolean_near_and_regex(spark):
    c = C.from_object({"name": "x", "all_of": [{"near": {"terms": ["alpha", "beta gamma"], "window": 3}}, {"not": "delta"}]})
    assert one(spark, C.matches(c, ["title"]), title="beta gamma one alpha") is True
    assert one(spark, C.matches(c, ["title"]), title="alpha a b c d beta gamma") is False
    assert one(spark, C.matches(c, ["title"]), title="alpha beta gamma delta") is False
    with pytest.raises(ValueError):
        C.java_pattern("re:alpha")
    assert C.parse_spec("name=a|b").patterns == ("a", "b")


@pytest.mark.parametrize("status, kind", [("partial_rate_limited", "rate_limited"), ("partial_network", "network"), ("skipped_rate_limit_cooldown", "skipped"), ("partial_auth", "auth"), ("", "unknown"), ("http_500", "error"), ("x", "needs_review")])
def test_status(spark, status, kind):
    assert one(spark, S.classify(F.col("v")), v=status) == kind


def test_dedupe_merges(spark):
    rows = [(0, "A title", "10.1234/A", "", "s1"), (1, "A title!", "https://doi.org/10.1234/a", "text", "s2"), (2, "", "", "", "s3"), (3, "", "", "", "s4")]
    got = {r._ord: r for r in D.dedupe(spark.createDataFrame(rows, "_ord long, title string, doi string, abstract string, discovery_source string")).collect()}
    assert set(got) == {0, 2, 3}
    assert [(got[i].dedupe_key, got[i].dedupe_confidence, got[i].dedupe_reason) for i in (2, 3)] == [(f"row:{i}", "unique", "unique row fallback") for i in (2, 3)]
    r = got[0]
    assert (r.duplicate_count, r.dedupe_key, r.dedupe_confidence, r.abstract) == ("2", "doi:10.1234/a", "high", "text")
    assert r.merged_discovery_sources == "s1; s2" and r.title == "A title!" and r.alternate_titles == "A title"


def test_queue_and_triage(spark):
    rows = [(0, "t", "10.1234/a", "high", "", ""), (1, "t", "10.1234/b", "high", "blocked", ""), (2, "t", "", "medium", "", ""), (3, "t", "10.1234/c", "high", "", "mismatch")]
    df = spark.createDataFrame(rows, "_ord long, title string, doi string, triage_priority string, metadata_status string, crossref_status string")
    assert [r._ord for r in Q.build(df).collect()] == [0]
    reasons = {r._ord: r.x for r in df.select("_ord", Q.skip_reason(df, ("high", "medium")).alias("x")).collect()}
    assert reasons == {0: "", 1: "metadata_blocked", 2: "missing_doi", 3: "crossref_blocked"}
    p = C.Profile(required=(C.parse_spec("a=alpha"),), negative=(C.parse_spec("b=beta"),))
    docs = spark.createDataFrame([(0, "alpha", "10.1234/a", "2020"), (1, "alpha beta", "", ""), (2, "none", "10.1/x y", "2020")], "_ord long, title string, doi string, publication_year string")
    got = {r._ord: (r.triage_priority, r.triage_score, r.metadata_status) for r in G.triage(docs, p).collect()}
    assert got[0] == ("high", "3.5", "ok") and got[1] == ("medium", "1.0", "check") and got[2][0] == "needs_review"


def test_metrics(spark):
    m = spark.createDataFrame([(0, "The Journal of Paper Kites", "PK", "1234-5678", "1.33e1", "2023")], "_ord long, journal string, aliases string, issn string, impact_factor string, metric_year string")
    v = spark.createDataFrame([(0, "pk", "", ""), (1, "", "12345678", ""), (2, "Paper Kites Letters", "", ""), (3, "", "", "paper kites")], "_ord long, journal string, journal_issn string, container string")
    got = {r._ord: r.metric_filter_status for r in M.annotate(v, m, 13.3).collect()}
    assert got == {0: "fail", 1: "fail", 2: "unverified", 3: "fail"}
    for text, want in (("1e1", 10.0), (".5", 0.5), ("-1", -1.0), ("n/a", None), ("", None)):
        assert one(spark, M.number("v"), v=text) == want
    passed = M.annotate(v, m, 10.0).where("_ord = 3").first()
    assert (passed.journal_metric, passed.metric_filter_reason) == ("1.33e1", "Impact factor 13.3 > 10")
    assert M.annotate(v.select("_ord"), m, 1.0).first().metric_filter_status == "unverified"


def test_breaker_and_order(spark):
    calls = spark.createDataFrame([("p", i, s) for i, s in enumerate(["error", "ok", "error", "error", "ok"])], "provider string, q int, status string")
    got = [r.replayed for r in B.breaker_replay(calls, 2).orderBy("q").collect()]
    assert got == ["error", "ok", "error", "skipped_circuit_breaker", "skipped_circuit_breaker"]
    df = B.with_ord(spark.range(1000).selectExpr("(id * 7919) % 1000 AS k").repartition(5), "k")
    assert all(r.k == r._ord for r in df.collect())


def test_row_numbers_of_many_wide_rows(spark):
    rows = spark.range(1_500_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).alias("k"), "id", F.repeat(F.md5(F.col("id").cast("string")), 4).alias("wide"))
    out = B.with_ord(rows, "k", "id").select("k", "id", "_ord")
    assert out.agg(F.count_distinct("_ord"), F.min("_ord"), F.max("_ord")).first()[:] == (1_500_000, 0, 1_499_999)
    pairs = out.alias("a").join(out.alias("b"), F.col("b._ord") == F.col("a._ord") + 1)
    assert pairs.where("struct(a.k, a.id) >= struct(b.k, b.id)").count() == 0
    assert B.with_ord(rows.where("false"), "k").count() == 0


def test_payloads(spark):
    text = '{"results": [{"id": "W1", "doi": "https://doi.org/10.1/A", "title": "T", "publication_year": 2020, "authorships": [{"author": {"display_name": "X"}}], "abstract_inverted_index": {"a": [0, 3], "b": [1]}}]}'
    r = J.openalex(spark.createDataFrame([(text,)], "payload string")).first()
    assert (r.doi, r.abstract, r.authors, r.publication_year) == ("10.1/a", "a b  a", "X", "2020")
    text = '{"message": {"DOI": "10.1/B", "title": ["T <i>x</i>"], "created": {"date-parts": [[2019, 2]]}}}'
    r = J.crossref(spark.createDataFrame([(text,)], "payload string")).first()
    assert (r.doi, r.title, r.year, r.date) == ("10.1/b", "T x", "2019", "2019-2")
    atom = '<feed><entry><id>http://arxiv.org/abs/1.2v1</id><title>A  b</title><summary>s</summary><published>2021-01-01</published><author><name>N</name></author><link href="http://x/abs" rel="alternate"/><link href="http://x/pdf" title="pdf"/></entry></feed>'
    r = J.arxiv(spark.createDataFrame([(atom,)], "payload string")).first()
    assert (r.arxiv_id, r.title, r.pdf_url, r.landing_page_url, r.publication_year) == ("1.2v1", "A b", "http://x/pdf", "http://x/abs", "2021")
    assert J.providers("S2,openalex,s2") == ["semantic_scholar", "openalex"]


def test_probe(spark):
    body = '<html><a href="/x.pdf">Download PDF</a><a href="si.html">Supplement</a> Abstract </html>'
    pdf, si, _ = P.links("b", "u")
    df = spark.createDataFrame([(body, "https://www.a.springer.com/p/q")], "b string, u string")
    r = df.select(pdf.alias("pdf"), si.alias("si"), P.access(F.lit("200"), F.lit(""), "b").alias("acc"), P.family(P.authority("u")).alias("fam"), P.public_url("u").alias("ok"), P.public_url(F.lit("http://127.0.0.1/")).alias("bad")).first()
    assert (r.pdf, r.si) == ("https://www.a.springer.com/x.pdf", "https://www.a.springer.com/p/si.html")
    assert (r.acc, r.fam, r.ok, r.bad) == ("abstract_only_or_landing", "springer", True, False)


def test_title_match_and_reuse(spark):
    a = spark.createDataFrame([(0, "A study of crystallography", "2025"), (1, "A study of crystallography.", "2026")], "_ord long, title string, year string")
    d = spark.createDataFrame([(5, "A Study of Crystallography", "2026"), (6, "tiny", "2026")], "_ord long, title string, publication_year string")
    got = {r._ord: r.a_ord for r in V.best_title(d, a).collect()}
    assert got == {5: 1, 6: None}


def test_title_alone_never_merges(spark):
    rows = [(0, "only title", "", ""), (1, "only title", "", ""), (2, "Only  title", "", "2020"), (3, "only title!", "", "2020")]
    got = {r._ord: (r.dedupe_key, r.dedupe_confidence, r.duplicate_count) for r in D.dedupe(spark.createDataFrame(rows, "_ord long, title string, doi string, year string")).collect()}
    assert got == {0: ("row:0", "unique", "1"), 1: ("row:1", "unique", "1"), 2: ("title_context:only title|year=2020|journal=", "medium", "2")}


def test_authority_rules(spark):
    rows = [(0, "10.1/a", "", "", ""), (1, "10.1/a", "The blue kite flies", "", "Kite Weekly"), (2, "10.1/a", "The blue kite flies", "", "Sailing and Boats"), (3, "10.1/a", "The blue kyte flyes", "2001", ""), (4, "", "x", "", ""), (5, "10.1/z", "x", "", "")]
    df = spark.createDataFrame(rows, "_ord long, doi string, title string, publication_year string, journal string")
    auth = spark.createDataFrame([(1, "10.1/a", "later", "1", ""), (0, "10.1/A", "The Blue Kite Flies", "2000", "Kite Weekly")], "_ord long, doi string, title string, year string, journal string")
    got = {r._ord: (r.crossref_status, r.crossref_mismatches) for r in V.authority_join(df, auth).collect()}
    assert got == {0: ("verified", ""), 1: ("verified", ""), 2: ("mismatch", "JOURNAL_MISMATCH: input='sailing and boats' vs crossref='kite weekly'"), 3: ("mismatch", "YEAR_MISMATCH: input=2001 vs crossref=2000"), 4: ("missing_doi", "NO_DOI"), 5: ("lookup_failed", "CROSSREF_LOOKUP_FAILED")}
    strict = {r._ord: r.crossref_mismatches for r in V.authority_join(df, auth, strict=True).collect()}
    assert strict[3].startswith("TITLE_MINOR_DIFF: input vs crossref (sim=0.89); YEAR")


def test_scopes_types_and_decisions(spark):
    c = C.Concept("t", patterns=("kite",), scope="title")
    assert one(spark, C.matches(c, ["title", "crossref_title"]), title="a kite", crossref_title="other") is True
    meta = C.Concept("m", patterns=("kite",), scope="metadata")
    assert one(spark, C.matches(meta, ["abstract", "publisher"]), abstract="kite", publisher="") is True
    assert one(spark, C.matches(meta, ["publisher", "journal"]), publisher="kite", journal="x") is False
    p = C.Profile(exclude_article_types=("review",))
    row = spark.createDataFrame([(0, "t", "10.1234/a", "2020", "article", "Review")], "_ord long, title string, doi string, year string, article_type string, crossref_type string")
    r = G.triage(row, p).first()
    assert (r.metadata_status, r.hard_filter_flags, r.triage_reasons) == ("blocked", "article_type_review", "no semantic profile supplied; left for LLM review; metadata flags: article_type_review")
    d = spark.createDataFrame([("", "Backup"), ("Include", "Backup")], "screening_decision string, include_status string")
    assert [x.d for x in d.select(Q.decision(d).alias("d")).collect()] == ["Backup", "Include"]


def test_profile_loader():
    text = '{"required": ["a=x|y"], "negative_concepts": [{"name": "n", "terms": "z", "weight": -5}], "hard_filters": {"year_from": "2001", "year_to": 2010, "require_doi": true}, "exclude_article_types": ["Data_Paper"]}'
    p = C.load_profile(text, required=["b=w"], year_to=2012, exclude_article_types=["editorial, news_item"])
    assert [c.name for c in p.required] == ["a", "b"] and p.negative[0].weight == -5 and (p.year_from, p.year_to, p.require_doi) == (2001, 2012, True)
    assert p.exclude_article_types == ("data-paper", "editorial", "news-item") and C.load_profile().required == ()


@pytest.mark.parametrize("href, want", [("../a", "http://h/a"), ("./a/../b?c#d", "http://h/x/b?c#d"), ("/p/./q/..", "http://h/p/"), ("?k=1", "http://h/x/y?k=1"), ("#f", "http://h/x/y?z#f"), ("//o/a", "http://o/a"), ("mailto:x", "mailto:x"), ("", ""), ("../../../a", "http://h/a")])
def test_absolute_urls(spark, href, want):
    assert one(spark, P.absolute(F.lit("http://h/x/y?z"), "v"), v=href) == want


def test_concept_objects():
    f = C.from_object
    assert f({"near": "alpha, beta", "label": "Close By"}) == C.Concept("close_by", "near", ("alpha", "beta"))
    assert f({"terms": "a|b; c"}).patterns == ("a", "b", "c") and f({"term": ["x ", " ", 3]}).patterns == ("x", "3")
    assert f({"near": ["a", "b"], "window": 0}).window == C.NEAR_WINDOW and f({"near": ["a", "b"], "window": -4}).window == 1
    assert f({"not_near": {"terms": ["a", "b"], "window": 3}}).window == 3
    assert f({"all_of": ["A=x", {"any_of": "y"}], "weight": "2"}) == C.Concept("concept", "all", children=(C.Concept("a", patterns=("x",)), C.Concept("concept", "any", children=(C.Concept("y", patterns=("y",)),))), weight=2.0)
    assert f('{"name": "J", "patterns": "p"}') == C.Concept("j", patterns=("p",)) and f("{no json").patterns == ("{no json",)
    assert C.parse_spec("core=").patterns == ("",) and C.parse_spec("A b").name == "a_b"
    for bad in ('["x"]', {"near": "alone"}, {"all_of": []}, {"not": None}, {"near": 3}, {"terms": " "} | {"terms": []}, {"terms": 5}, 7, ""):
        try:
            f(bad)
            raise AssertionError(bad)
        except ValueError:
            pass


def test_empty_terms_and_commas_in_near(spark):
    df = spark.createDataFrame([("alpha then beta",), ("alpha",), ("",)], "abstract string")
    near, any_text = C.from_object({"near": "alpha, beta"}), C.parse_spec("core=")
    assert [tuple(r) for r in df.select(C.matches(near, df.columns), C.matches(any_text, df.columns)).collect()] == [(True, True), (False, True), (False, False)]


def test_sql_functions_say_what_the_columns_say(spark):
    from quillspark.plans import views

    rows = ["The Journal of X &amp; Y", "A-b  c", "1234-567x", "", None, "3.5", " -2e3 ", "x1", "high", "low", "needs_review"]
    df = spark.createDataFrame([(i, r, "", "t") for i, r in enumerate(rows)], "_ord long, title string, doi string, abstract string")
    names = views.register(spark, df, C.Profile(required=(C.parse_spec("t"),)))
    assert list(names) == ["candidates", "deduped_candidates", "triaged_candidates", "selected_candidates", "publisher_queue"]
    for r in spark.sql("SELECT normalize_title(title) a, normalize_issn(title) b, normalize_journal(title) c, first_number(title) d, triage_rank(title) e, title FROM candidates").select("*", T.title("title").alias("a2"), T.issn("title").alias("b2"), T.journal("title").alias("c2"), T.first_number("title").alias("d2")).collect():
        assert (r.a, r.b, r.c, r.d) == (r.a2, r.b2, r.c2, r.d2), r.title
    plan = spark.sql("SELECT count(*) FROM triaged_candidates WHERE _ord = 3")._jdf.queryExecution().optimizedPlan().toString()
    assert "triage_reasons" not in plan  # columns that the query does not read are not computed


def test_public_urls_and_probes_of_others(spark):
    from quillspark.operators import probe as P

    cases = {"http://127.0.0.1/x": False, "https://1.2.3/": True, "http://1.2.70000/": False, "http://0300.0250.1.1/": False, "http://0xc0a80101/": False, "https://[2001:4860:4860::8888]:443/": True, "http://[2001:10::1]/": False, "http://[::ffff:7f00:1]/": False, "http://user@[::]/": False, "http://9.9.9.9./": True, "http:///x": False, "gopher://a.org": False, "http://100.64.0.1/": True, "http://08.1.1.1/": False}
    df = spark.createDataFrame([*cases.items()], "u string, ok boolean")
    assert [r.u for r in df.where(P.public_url("u") != df.ok).collect()] == []
    queue = spark.createDataFrame([(0, "", "http://10.0.0.1/a"), (1, "", "https://pub.example.org/b"), (2, "", "https://pub.example.org/c")], "_ord long, doi string, publisher_url string")
    page = lambda start, url: (start, url, "200", "text/html", "<html>full text " + "x" * 600_000 + " abstract", "")
    pages = spark.createDataFrame([page("http://10.0.0.1/a", "http://10.0.0.1/a"), page("https://pub.example.org/b", "https://pub.example.org/b"), page("https://pub.example.org/c", "http://169.254.169.254/")], "start_url string, url string, status string, content_type string, body string, error string")
    got = [(r.access_status, r.http_status, r.page_features) for r in P.probe(queue, pages, "now").orderBy("_ord").collect()]
    assert got == [("blocked_url", "blocked_url", ""), ("html_possible", "200", "html; fulltext_marker"), ("blocked_url", "blocked_url", "")]


def test_query_lists_keep_their_order(spark, tmp_path):
    from quillspark.sources import files

    (tmp_path / "q.txt").write_text("# heading\n second  \n\nfirst\nsecond\n" + "\n".join(f"line {i}" for i in range(1200)))
    got = [(r.query_id, r["query"]) for r in files.read_queries(spark, f"{tmp_path}/q.txt", ["first", "more", "more"]).orderBy("_ord").collect()]
    assert got[:3] == [("q001", "second"), ("q002", "first"), ("q003", "line 0")] and got[-1] == ("q1203", "more") and len(got) == 1203


def test_dimensions_are_broadcast_by_keys_and_bytes(spark, monkeypatch):
    from quillspark.operators import metrics as M

    dim = spark.createDataFrame([(i, f"J{i}", "", "", str(i)) for i in range(50)], "_ord long, journal string, aliases string, issn string, impact_factor string")
    rows = spark.createDataFrame([(i, f"j{i}") for i in range(60)], "_ord long, journal string")
    plan = lambda: M.match(rows, dim)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan()
    monkeypatch.setattr(M, "BROADCAST_BYTES", 100)
    assert "strategy=broadcast" not in plan() and M.annotate(rows, dim).where("journal_metric_verified = 'true'").count() == 50
