"""Planning, summaries, configuration checks, streaming and the curation run."""

import json
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from test_discovery import put

from quillspark.operators import planning as N, summary as U, verify as V
from quillspark.plans import curate
from quillspark.plans.pipeline import fingerprint
from quillspark.sources import files, payloads as J
from quillspark.streaming import incremental


def test_strategy_and_plan(spark):
    controls = {"include_europe_pmc": True, "discovery_sources_origin": "config", "semantic_query_limit": "x", "max_results_per_query": 200}
    s = N.plan(spark, ["h2"], ["OpenAlex", "arxiv"], 2026, controls=controls)["source_strategy"]
    assert s["domain_tags"] == ["chemistry_materials"] and s["recommended_sources"] == ["openalex", "semantic_scholar"] and s["missing_recommended_sources"] == ["semantic_scholar"]
    assert s["fallback_order"] == ["openalex", "arxiv"] and s["source_selection"]["effective_configured_sources"] == ["openalex", "arxiv", "europe_pmc"]
    assert s["source_selection"]["not_enabled_reasons"] == {"semantic_scholar": "not enabled by runtime config channels"}
    assert s["risk_flags"] == ["single_query_low_recall_risk", "very_short_query_high_noise_risk", "no_required_concepts_triage_will_be_weak", "recommended_sources_not_selected", "recent_year_range_metadata_lag_risk", "high_result_limit_timeout_risk"]
    assert s["provider_roles"]["arxiv"]["role"] == "preprint_discovery" and len(s["agent_actions"]) == 3
    e = N.plan(spark, ["a", "b", "c"], ["openalex; semantic-scholar", "other"], controls={"semantic_query_limit": 2})["source_strategy"]
    assert e["request_estimate"] == {"queries": 3, "provider_calls": 8, "calls_by_source": {"openalex": 3, "semantic_scholar": 2, "other": 3}} and e["provider_roles"]["other"]["role"] == "caller_selected_source"
    p = N.plan(spark, ["a long query here", " "], ["openalex"], 2001, required="x=cell|mouse", mode="fast")
    assert p["query_count"] == 1 and p["year_range"] == {"from": 2001, "to": None} and p["source_strategy"]["domain_tags"] == ["biomedical"] and p["concepts"]["required"] == ["x=cell|mouse"]
    skipped = N.plan(spark, ["arxiv"], [], controls={"skip_openalex": True, "include_arxiv": True, "configured_discovery_sources": "openalex;s-x"})["source_strategy"]["source_selection"]
    assert skipped["not_enabled_reasons"]["openalex"] == "disabled by skip_openalex" and skipped["not_enabled_reasons"]["arxiv"] == "not selected for this run" and skipped["effective_configured_sources"] == ["s_x", "arxiv"]
    csv = N.plan(spark, [], ["arxiv"], controls={"discovery_sources_origin": "input_csv"})["source_strategy"]
    assert csv["source_selection"]["not_enabled_reasons"] == {"openalex": "API discovery was skipped because the workflow started from input_csv"} and "no_query_provided" in csv["risk_flags"]


def test_config_checks():
    bad = {"limits": {"max_results_per_query": "9", "odd": 1, "time_budget_seconds": -1, "provider_workers": None}, "cache": {"ttl_days": -0.5}, "x": {}, "api": 3, "channels": {"arxiv": False}}
    got = {(level, text) for _, level, text in U.config_checks(bad)}
    assert {("error", "limits.max_results_per_query must be int, got str"), ("warning", "unknown key: limits.odd"), ("error", "time_budget_seconds must not be negative"), ("error", "cache.ttl_days must not be negative")} <= got
    assert {("warning", "unknown top-level section: x"), ("error", "section 'api' must be an object"), ("warning", "all discovery channels are disabled")} <= got
    assert U.config_checks([])[0][1] == "error"
    assert [c[1] for c in U.ordered_checks([("b", "ok", ""), ("a", "warning", ""), ("z", "error", "")])] == ["error", "warning", "ok"]
    assert U.compact_columns(["x", "doi", "title"]) == ["title", "doi"] and U.compact_columns([str(i) for i in range(20)]) == [str(i) for i in range(12)]


def test_caps_and_problem_rows(spark):
    df = spark.createDataFrame([(i, "ok" if i % 3 else "http_500", "e" * 300) for i in range(60)], "_ord long, status string, error string")
    rows, more = U.capped(df)
    assert rows.count() == 20 and more and not U.capped(df.limit(20))[1]
    bad = U.problem_rows(df, "status", "error").collect()
    assert [r._ord for r in bad] == list(range(0, 36, 3)) and len(bad[0].error) == 160
    assert U.adapters(spark).count() == 3 and J.capabilities(spark).where("discovery").count() == 4


def test_csv_round_trip(spark, tmp_path):
    rows = [("a, \"q\"\nline", None, ["x", "y"]), ("", "2", [])]
    files.write_csv(spark.createDataFrame(rows, "a string, b string, c array<string>"), f"{tmp_path}/x")
    assert sorted(tuple(r) for r in files.read_csv(spark, f"{tmp_path}/x").collect()) == [("", "2", ""), ('a, "q"\nline', "", "x y")]
    files.write_csv(spark.createDataFrame([], "a string"), f"{tmp_path}/none")
    assert files.read_csv(spark, f"{tmp_path}/none").columns == ["a"]
    (tmp_path / "m.csv").write_text("journal,issn\n" + "\n".join(f"J{i},{i}" for i in range(50)))
    got = files.read_metrics(spark, f"{tmp_path}/m.csv").orderBy("_ord").collect()
    assert [(r._ord, r.journal) for r in got] == [(i, f"J{i}") for i in range(50)]


def test_arxiv_pages(spark):
    entry = lambda i, y: f'<entry><id>http://arxiv.org/abs/{i}</id><title>T {i}</title><published>{y}-01-01</published><link href="u{i}" rel="alternate"/></entry>'
    pages = spark.createDataFrame([(0, f"<feed>{entry('1', 2001)}{entry('2', 2010)}</feed>"), (1, f"<feed>{entry('1', 2001)}{entry('3', 2005)}</feed>")], "_ord long, payload string")
    assert [r.arxiv_id for r in J.read("arxiv", pages, year_from=2001, year_to=2009).orderBy("arxiv_id").collect()] == ["1", "3"]
    assert [r.arxiv_id for r in J.read("arxiv", pages, most=2).collect()] == ["1", "2"]


def test_stream_upserts_keep_what_was_merged(spark, tmp_path):
    src = tmp_path / "in"
    rows = lambda *r: spark.createDataFrame(r, "_ord long, title string, doi string, discovery_source string")
    rows((0, "A", "10.1/a", "s1"), (1, "B", "10.1/b", "s1")).coalesce(1).write.parquet(f"{src}/1")
    stream = lambda: spark.readStream.schema("_ord long, title string, doi string, discovery_source string").parquet(f"{src}/*")
    incremental.upsert_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    rows((2, "A", "doi:10.1/A", "s2"), (3, "A", "10.1/a", "s1")).coalesce(1).write.parquet(f"{src}/2")
    incremental.upsert_batches(stream(), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.doi: (r.duplicate_count, r.merged_discovery_sources) for r in incremental.current(spark, f"{tmp_path}/out").collect()}
    assert got == {"10.1/a": ("3", "s1; s2"), "10.1/b": ("1", "s1")}


def papers(spark, n=28):
    docs = [(i, f"Paper about kites {i % 7}", f"10.1234/k{i % 7}" if i % 7 else "", str(2000 + i % 7), "Kite Weekly" if i % 2 else "Other", "a text on kites") for i in range(n)]
    return spark.createDataFrame(docs, "_ord long, title string, doi string, publication_year string, journal string, abstract string")


def authority(spark):
    return spark.createDataFrame([(i, f"10.1234/k{i}", f"Paper about kites {i}", str(2000 + i), "") for i in range(1, 7)], "_ord long, doi string, title string, year string, journal string")


def test_curation_run(spark, tmp_path):
    df, auth = papers(spark), authority(spark)
    metrics = spark.createDataFrame([(0, "Kite Weekly", "", "", "5.5")], "_ord long, journal string, aliases string, issn string, impact_factor string")
    go = lambda df=df, folder="run", **k: curate.run(spark, df, f"{tmp_path}/{folder}", **{"required": ["kite=kites"], "year_from": 2002, "authority": auth, "metrics": metrics, "min_if": 3.0, "target": 2} | k)
    out = go()
    assert {"deduped_candidates", "triaged_candidates", "verified_candidates", "publisher_queue"} <= set(out["stages"])
    counts = out["counts"]
    assert counts["deduped"] == 8 and counts["verified"] == 5 and counts["publisher_queue"] == out["stages"]["publisher_queue"].count() > 0
    assert counts["crossref_verified"] == 6 and counts["crossref_missing_doi"] == 2 and counts["triaged"] == 8 and counts["metric_pass"] + counts["metric_backup"] == counts["selected_for_verification"]
    run = tmp_path / "run"
    assert (run / "feasibility_report.md").read_text().count("deduped: 8") == 1 and "| verified | 6 |" in (run / "processing_report.md").read_text()
    summary = json.loads((run / "agent_summary.json").read_text())
    assert summary["trust_tiers"]["crossref_trusted"] == 6 and summary["next_actions"] and summary["run_status"] == "completed" and summary["metric_statuses"]
    # every file that the index names is there, with rows and digest
    index = json.loads((run / "artifacts_index.json").read_text())
    missing = {a["name"] for a in index["artifacts"] if not a["exists"]}
    assert missing == {"api_discovery_trace", "api_candidates", "oa_annotated_candidates", "publisher_queue_probed", "api_discovery_report"}
    assert {a["name"]: a["rows"] for a in index["artifacts"]}["deduped_candidates"] == 8 and all(len(a["sha256"]) == 64 for a in index["artifacts"] if a["exists"])
    queue = files.read_csv(spark, f"{run}/publisher_queue.csv")
    assert queue.count() == counts["publisher_queue"] and len(queue.columns) == len(out["stages"]["publisher_queue"].columns) - 1
    records = json.loads((run / "field_provenance.json").read_text())["records"]
    assert len(records) == counts["publisher_queue"] and records[0]["fields"]["title"]["trust"] in ("candidate", "bibliographic_verified")
    # equal rows in another order: every stage is used again; other rows, or another authority: they are not
    before = out["run"].records().count()
    assert go(df.repartition(5))["run"].records().count() == before
    fewer = go(df.where("_ord < 3"))
    assert fewer["counts"]["deduped"] == 3 and fewer["stages"]["deduped_candidates"].count() == 3
    other = go(authority=auth.where("_ord < 3"))
    assert other["counts"]["crossref_verified"] == 2 and other["counts"]["crossref_lookup_failed"] == 4
    manifest = json.loads((run / "run_manifest.json").read_text())
    assert len(manifest["stages"]) > len(summary["stage_statuses"]) and manifest["created_at"] and all(s["output_digest"] for s in manifest["stages"])
    part = curate.run(spark, df, f"{tmp_path}/part", required=["kite=kites"], stop_after="triaged_candidates")
    assert part["run_status"] == "partial" and "publisher_queue" not in part["stages"] and any("Resume the run" in a for a in part["summary"]["next_actions"])
    try:
        curate.run(spark, df, f"{tmp_path}/run", required=["other=x"])
        raise AssertionError("another request went into the same folder")
    except ValueError:
        pass


def test_titles_are_recovered_before_the_doi_gate(spark, tmp_path):
    df = spark.createDataFrame([(0, "A precise paper title", "", "2026", "Journal A", "Reports external validation.")], "_ord long, title string, doi string, publication_year string, journal string, abstract string")
    auth = spark.createDataFrame([(0, "10.1234/recovered", "A precise paper title", "2026", "Journal A")], "_ord long, doi string, title string, year string, journal string")
    out = curate.run(spark, df, f"{tmp_path}/run", required=["validation=external validation"], year_from=2026, require_doi=True, authority=auth)
    row = out["stages"]["publisher_queue"].first()
    assert (row.doi, row.crossref_status) == ("10.1234/recovered", "title_recovered") and out["counts"]["crossref_title_recovered"] == 1
    none = curate.run(spark, df, f"{tmp_path}/none", required=["validation=external validation"], require_doi=True, authority=auth.where("false"))
    assert none["counts"]["publisher_queue"] == 0 and none["counts"]["crossref_title_lookup_failed"] == 1 and "NOT_FEASIBLE" in (tmp_path / "none" / "feasibility_report.md").read_text()


def test_checkpointed_verification_and_cache(spark, tmp_path):
    empty = spark.createDataFrame([], V.CACHE)
    one = curate.run(spark, papers(spark), f"{tmp_path}/one", authority=authority(spark), cache=empty)
    two = curate.run(spark, papers(spark), f"{tmp_path}/two", authority=authority(spark), checkpoint_rows=3)
    drop = ("crossref_cache_status", "crossref_cache_key")
    assert fingerprint(one["stages"]["verified_candidates"].drop(*drop)) == fingerprint(two["stages"]["verified_candidates"].drop(*drop)) and two["run"].records().where("status = 'partial'").count() == 3
    again = curate.run(spark, papers(spark), f"{tmp_path}/three", authority=authority(spark).where("false"), cache=spark.read.parquet(f"{tmp_path}/one/cache"))
    assert one["counts"]["crossref_cache_store"] == 6 and again["counts"]["crossref_cache_hit"] == 6 and again["counts"]["crossref_verified"] == 6
    few = curate.run(spark, papers(spark), f"{tmp_path}/four", authority=authority(spark), max_crossref_rows=2)
    assert few["counts"]["crossref_skipped_budget"] == 6


def test_discovery_feeds_the_run_and_its_advice(spark, tmp_path):
    work = lambda i: {"id": f"W{i}", "doi": f"https://doi.org/10.1234/k{i}", "title": f"Paper about kites {i}", "publication_year": 2000 + i, "type": "article"}
    put(tmp_path / "pages", "openalex", "q001", 1, {"results": [work(i) for i in range(1, 5)]})
    put(tmp_path / "pages", "openalex", "q002", 1, {"results": [work(i) for i in range(3, 7)]})
    put(tmp_path / "pages", "semantic_scholar", "q001", 1, {"status": "rate_limited", "http_status": 429, "transient": True, "retry_after_seconds": 30, "error": "limited"}, ".error")
    put(tmp_path / "pages", "semantic_scholar", "q002", 1, {"data": [{"title": "never seen", "externalIds": {"DOI": "10.1/x"}}]})
    go = lambda **k: curate.run(spark, None, f"{tmp_path}/run", queries=["kite flight in winds", "kite strings and knots"], sources=["openalex", "s2"], required=["kite=kites"], capture=str(tmp_path / "pages"), authority=authority(spark), **k)
    out = go()
    trace = {(r.provider, r.query_id): r.status for r in out["trace"].collect()}
    assert trace == {("openalex", "q001"): "ok", ("openalex", "q002"): "ok", ("semantic_scholar", "q001"): "rate_limited", ("semantic_scholar", "q002"): "skipped_rate_limit_cooldown"}
    assert out["counts"]["discovered"] == 8 and out["counts"]["deduped"] == 6 and out["counts"]["verified"] == 6
    first = out["stages"]["api_candidates"].orderBy("_ord").first()
    assert first.source_trace == "openalex:q001:rank1:doi=10.1234/k1:title=Paper about kites 1" and (first.discovery_query_id, first.discovery_rank, first.discovery_source) == ("q001", "1", "openalex")
    actions = out["summary"]["next_actions"]
    assert [any(x in a for a in actions) for x in ("retry_after_seconds", "Inspect api_discovery_trace.csv", "cache stored a transient failure")] == [True] * 3
    assert out["summary"]["provider_statuses"] == {"ok": 2, "rate_limited": 1, "skipped_rate_limit_cooldown": 1}
    report = (tmp_path / "run" / "api_discovery_report.md").read_text()
    assert "- skipped_rate_limit_cooldown: 1" in report and "- openalex: 8" in report and report.count("| q00") == 4
    assert len(files.read_csv(spark, f"{tmp_path}/run/api_discovery_trace.csv").collect()) == 4 and "Non-OK Provider Calls" in (tmp_path / "run" / "processing_report.md").read_text()
    before = out["run"].records().count()
    assert go()["run"].records().count() == before
    put(tmp_path / "pages", "openalex", "q002", 1, {"results": [work(9)]})
    assert go()["counts"]["discovered"] == 5
    (tmp_path / "bad" / "openalex" / "q001").mkdir(parents=True)
    (tmp_path / "bad" / "openalex" / "q001" / "page-1.json").write_text("none")
    try:
        curate.run(spark, None, f"{tmp_path}/strict", queries=["one query here"], capture=str(tmp_path / "bad"), strict_discovery=True)
        raise AssertionError("failed discovery went on")
    except RuntimeError as e:
        assert "response_parse_error" in str(e) and (tmp_path / "strict" / "api_discovery_trace.csv").exists()
