"""The curation run: discovery, dedupe, verification, triage, selection, open access, metrics and queue, staged and resumable, with its reports.

Every stage is written once, with its counts observed on the way (``pipeline``); reports are made from the records. A stage
is used again only while the request, its parameters, the stages before it and the rows of all tables it reads are the same."""

from __future__ import annotations

import json
import time

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import concepts as C, text as T
from ..operators import dedupe as D, metrics as M, planning as N, probe as P, queue as Q, report as R, summary as U, tables as B, triage as G, verify as V
from ..sources import files, pages as A, payloads as J, storage
from . import discovery as X, reports as Y
from .pipeline import Run, fingerprint, signature

#: Stages of more rows are written as folders of CSV files, fewer as one file; so many rows get JSON provenance in one file.
ONE_FILE_ROWS, PROVENANCE_ROWS = 1_000_000, 100_000
#: Papers brought by the caller come after discovered ones.
_LATER = 1 << 52


def stages(profile: C.Profile, priorities, authority=None, strict=False, title_lookup=None, prior=None, cache=None, cache_ttl_seconds=30 * 86400.0, max_crossref_rows=None, failures=None, index=None, now: Column | None = None, responses=None, email="", metrics=None, min_if=None, strict_queue=None, pages=None, checked_at="", include_blocked=False) -> list[tuple]:
    """(name, function, parameters, names of the tables that it reads) of the stages that the inputs allow, in order.

    Verification comes before triage, so that a DOI that a title recovers counts there; titles are looked up if the profile
    needs a DOI, unless title_lookup says otherwise. The queue takes only rows that pass the metric threshold where there is one, unless
    strict_queue says otherwise."""
    only_passed = min_if is not None if strict_queue is None else strict_queue
    titles = profile.require_doi if title_lookup is None else title_lookup
    out = [("deduped_candidates", lambda df, **_: D.dedupe(df), {}, ())]
    if authority is not None:

        def verified(df, strict, title_lookup, max_rows, ttl):
            dense = df if max_rows is None else B.with_ord(df.withColumnRenamed("_ord", "_first"), "_first").drop("_first")  # budgets count rows
            return V.verify(dense, authority, strict, title_lookup, prior, cache, now, ttl, max_rows, failures, index)

        out.append(("verified_candidates", verified, {"strict": strict, "title_lookup": titles, "max_rows": max_crossref_rows, "ttl": cache_ttl_seconds}, ("authority", "prior", "cache", "failures")))
    out += [
        ("triaged_candidates", lambda df, **_: G.triage(df, profile), {"profile": repr(profile)}, ()),
        ("selected_candidates", lambda df, priorities, include_blocked: G.select_by_priority(df, priorities, include_blocked), {"priorities": sorted(priorities), "include_blocked": include_blocked}, ()),
    ]
    if responses is not None:
        out.append(("oa_annotated_candidates", lambda df, **_: J.open_access_annotate(df, responses, email, checked_at), {"email": bool(email), "at": checked_at}, ("responses",)))
    if metrics is not None:
        out.append(("metrics_annotated_candidates", lambda df, min_if: M.annotate(df, metrics, min_if), {"min_if": min_if}, ("metrics",)))

    def queue(df, **_):
        rows = M.split(df)[0] if only_passed and "metric_filter_status" in df.columns else df
        return Q.build(rows, priorities=tuple(priorities), include_blocked=include_blocked)

    out.append(("publisher_queue", queue, {"only_passed": only_passed}, ()))
    if pages is not None:
        out.append(("publisher_queue_probed", lambda df, **_: P.probe(df, pages, checked_at), {"at": checked_at}, ("pages",)))
    return out


def counted(rows: dict[str, int], seen: dict[str, dict[str, int]]) -> dict[str, int]:
    """The run's counts from the records of its stages."""
    get = lambda stage, field: {k: v for k, v in Y.histogram(seen.get(stage, {}), field).items() if k not in (Y.BLANK, Y.OTHER)}
    out: dict[str, int] = {}
    if "api_candidates" in rows:
        out["discovered"] = rows["api_candidates"]
    if "deduped_candidates" in rows:
        out["deduped"] = rows["deduped_candidates"]
    if "verified_candidates" in rows:
        out |= {f"crossref_{k.split('=', 1)[1]}": n for k, n in sorted(seen["verified_candidates"].items()) if k.startswith("verification=") and n}
    if "triaged_candidates" in rows:
        own = seen["triaged_candidates"]
        out |= {"triaged": rows["triaged_candidates"], **{f"triage_{k}": own.get(f"triage_priority={k}", 0) for k in G.RANK}, "metadata_blocked": own.get("metadata_status=blocked", 0)}
    if "selected_candidates" in rows:
        trusted = get("selected_candidates", "crossref_status")
        out |= {"selected_for_verification": rows["selected_candidates"], "verified": trusted.get("verified", 0) + trusted.get("title_recovered", 0)}
    out |= {f"unpaywall_{k}": n for k, n in sorted(get("oa_annotated_candidates", "unpaywall_status").items())}
    if "metrics_annotated_candidates" in rows:
        passed = seen["metrics_annotated_candidates"].get("metric_filter_status=pass", 0)
        out |= {"metric_pass": passed, "metric_backup": rows["metrics_annotated_candidates"] - passed}
    if "publisher_queue" in rows:
        out["publisher_queue"] = rows["publisher_queue"]
    if "publisher_queue_probed" in rows:
        out["publisher_probed"] = seen["publisher_queue_probed"].get("probed", 0)
    return out


def _order(name: str, df: DataFrame) -> list:
    """Order of a stage's CSV: triage and queue put the best first, others keep the order of the input."""
    if name in ("triaged_candidates", "selected_candidates"):
        return [G.rank("triage_priority"), F.desc(T.first_number(F.col("triage_score").cast("string"))), F.lower(T.text("title")), "_ord"]
    if name.startswith("publisher_queue"):
        first = F.when(F.col("extraction_priority").rlike("^[0-9]+$"), F.col("extraction_priority").cast("int")).otherwise(99)
        return [first, F.desc(T.first_number("triage_score")), F.lower("title"), "_ord"]
    return ["_ord"]


def write_tables(folder: str, tables: dict[str, DataFrame], rows: dict[str, int], trace: DataFrame | None) -> None:
    """CSV artifacts of the stages, the metric split and the trace, and the provenance of the queue."""
    own = dict(tables)
    if "metrics_annotated_candidates" in own:
        own["strict_candidates"], own["backup_candidates"] = M.split(own["metrics_annotated_candidates"])
    for name, df in own.items():
        n = rows.get(name, rows.get("metrics_annotated_candidates", 0))
        if n <= ONE_FILE_ROWS:
            storage.write_csv(df, f"{folder}/{name}.csv", _order(name, df), ("_ord",))
        else:
            files.write_csv(df.drop("_ord"), f"{folder}/{name}.csv")
    if trace is not None:
        storage.write_csv(trace.select(*X.TRACE, "_ord"), f"{folder}/api_discovery_trace.csv", ["_ord"], ("_ord",))
    last = next((t for t in ("publisher_queue_probed", "publisher_queue") if t in tables), None)
    if last:
        records = R.provenance_records(tables[last])
        if rows[last] <= PROVENANCE_ROWS:
            found = [json.loads(r.record) for r in records.orderBy("_ord").toLocalIterator()]
            notes = ["Provenance explains where fields came from; it does not prove article-level scientific claims.", "Unpaywall and publisher probe values are access hints unless confirmed by page/full-text inspection."]
            storage.write_text(tables[last].sparkSession, f"{folder}/field_provenance.json", json.dumps({"schema_version": 1, "row_count": len(found), "records": found, "notes": notes}, indent=2, ensure_ascii=False) + "\n")
        else:
            records.select("record").write.mode("overwrite").text(f"{folder}/field_provenance.json")


def write_reports(spark: SparkSession, folder: str, tables, rows, seen, statuses, counts, manifest, plan, trace=None, target=None, min_if=None, metrics_off=False, warnings=()) -> dict:
    """All reports of the folder; returns the summary."""
    strategy, n = plan["source_strategy"], counts.get
    health = Y.trace_histograms(trace) if trace is not None else None
    of = lambda f, *v: sum((health or {}).get(f, {}).get(x, 0) for x in v)
    verified = seen.get("verified_candidates", {})
    trusted = verified.get("crossref_status=verified", 0) + verified.get("crossref_status=title_recovered", 0)
    tiers = {"discovered_or_deduped": n("deduped", n("discovered", 0)), "crossref_trusted": trusted, "metric_pass": n("metric_pass", 0), "publisher_queue": n("publisher_queue", 0), "publisher_probe_checked": n("publisher_probed", 0)}
    one = spark.createDataFrame([{k: v for k, v in counts.items()} or {"deduped": 0}])
    reasons = U.feasibility(one, target, min_if, metrics_off or "metrics_annotated_candidates" not in tables).first().blocking_reasons
    problems = sum(c for s, c in (health or {}).get("status", {}).items() if s not in ("ok", "empty_result"))
    facts = {
        "partial": manifest["run_status"] == "partial", "n_rate_limited": of("status_class", "rate_limited"), "n_cooldown": of("status", "skipped_rate_limit_cooldown"), "n_cached_failure": of("status", "skipped_cached_provider_failure"), "n_provider_problems": problems,
        "discovered": tiers["discovered_or_deduped"], "trusted": trusted, "queued": tiers["publisher_queue"], "probed": tiers["publisher_probe_checked"], "metric_pass": tiers["metric_pass"], "n_metric_rows": rows.get("metrics_annotated_candidates", 0),
        "single_query": "single_query_low_recall_risk" in strategy["risk_flags"], "n_failures_stored": of("cache_status", "store"),
    }
    row = spark.createDataFrame([facts]).withColumn("missing_sources", F.array(*map(F.lit, strategy["missing_recommended_sources"])).cast("array<string>"))
    actions = row.select(U.next_actions(row).alias("a")).first().a
    found = lambda stage, f: Y.histogram(seen.get(stage, {}), f)
    put = lambda name, text: storage.write_text(spark, f"{folder}/{name}", text)
    dump = lambda data: json.dumps(data, indent=2, ensure_ascii=False, default=str) + "\n"
    meanings = Y.stage_meanings(statuses, spark)
    write_tables(folder, tables, rows, trace)
    put("query_plan.json", dump(plan))
    put("run_manifest.json", dump(manifest))
    put("publisher_adapters.json", dump([r.asDict() for r in U.adapters(spark).collect()]))
    put("feasibility_report.md", U.feasibility_text(counts, reasons, target, warnings))
    if trace is not None:
        calls = trace.orderBy("_ord").limit(10_000).collect()
        put("api_discovery_report.md", Y.discovery(rows.get("api_candidates", 0), found("api_candidates", "discovery_provider"), health, calls, J.capabilities(spark).collect()))
    bad = U.problem_rows(trace, "status", "error").collect() if trace is not None else []
    for name in ("processing_report.md", "agent_summary.json", "artifacts_index.json"):  # so that the index knows all of them
        if not storage.exists(spark, f"{folder}/{name}"):
            put(name, "{}\n")
    index = U.artifact_index(spark, folder, rows)
    put("processing_report.md", Y.processing(rows, seen, meanings, tiers, health, bad, strategy, index))
    health = health or {f: {} for f in ("status", "status_class", "http_status", "transient_error", "next_action", "provider", "cache_status")}
    summary = {
        "schema_version": 1, **manifest, "partial": facts["partial"], "status_reason": manifest["stop_reason"] or manifest["run_status"], "stage_statuses": statuses, "stage_meanings": meanings, "trust_tiers": tiers, "counts": counts,
        "provider_statuses": health["status"], "provider_status_classes": health["status_class"], "provider_http_statuses": health["http_status"], "provider_transient_errors": health["transient_error"], "provider_next_actions": health["next_action"], "provider_counts": health["provider"],
        "cache": {"crossref_cache_statuses": found("verified_candidates", "crossref_cache_status"), "provider_failure_cache_statuses": health["cache_status"]},
        "triage_priorities": found("triaged_candidates", "triage_priority"), "candidate_statuses": found("triaged_candidates", "candidate_status"), "metadata_statuses": found("triaged_candidates", "metadata_status"), "metric_statuses": found("metrics_annotated_candidates", "metric_filter_status"),
        "access_statuses": found("publisher_queue_probed", "access_status"), "source_strategy": strategy, "artifact_tiers": index["by_tier"], "artifact_read_order": index["read_order"], "warnings": list(warnings), "next_actions": list(actions),
    }
    put("agent_summary.json", dump(summary))
    put("artifacts_index.json", dump(U.artifact_index(spark, folder, rows)))
    return summary


def run(spark: SparkSession, candidates: DataFrame | None, folder: str, queries=(), sources=(), required=(), optional=(), negative=(), profile_text=None, year_from=None, year_to=None, require_doi=False, priorities=("high", "medium", "needs_review"), target=None, stop_after=None, time_budget=None, cancelled=None, override_reason="", capture: str | None = None, discovery: dict | None = None, strict_discovery=False, versions: dict[str, str] | None = None, checkpoint_rows: int | None = None, mode="", **inputs) -> dict:
    """All stages, then the reports. Folder: on storage that driver and executors share.

    Candidates (with _ord) are the caller's, and with ``capture`` those of the queries at the sources (options of ``discovery``: see
    ``discovery.discover``). Inputs: those of ``stages``. A folder holds one request; another one is refused unless override_reason says why.
    versions: a text for tables (by name, ``candidates`` included) whose state a table format or a date names, instead of a digest of
    their rows. checkpoint_rows: verification is checkpointed after so many rows. The run ends early, as partial, after
    ``stop_after``, beyond ``time_budget`` seconds or once ``cancelled()`` is true. strict_discovery: failed discovery is an error, after its
    trace is written. An existing cache table is brought up to date as ``folder/cache`` for the caller to use next time."""
    folder = folder.rstrip("/")
    profile = C.load_profile(profile_text, required, optional, negative, year_from, year_to, require_doi)
    own_sources = J.providers(list(sources)) if sources else []
    controls = {"stop_after": stop_after, "time_budget": time_budget, **{k: v for k, v in (discovery or {}).items() if k in ("max_results", "semantic_query_limit")}}
    plan = N.plan(spark, list(queries), list(sources), profile.year_from, profile.year_to, list(required), list(optional), list(negative), mode, controls)
    frames = {k: v for k, v in inputs.items() if isinstance(v, DataFrame)}
    options = {k: v for k, v in inputs.items() if not isinstance(v, (DataFrame, Column))}
    request = {"profile": repr(profile), "queries": list(queries), "sources": list(sources), "priorities": sorted(priorities), "target": target, "capture": capture, "discovery": discovery, **options, "inputs": sorted(frames)}
    old, own = storage.read_json(spark, f"{folder}/request.json"), signature(request, budgets=("checked_at", "max_crossref_rows"))
    if old and stop_after is None and old.get("signature") != own and not override_reason:
        raise ValueError("the folder holds another request; use a new folder or give a reason to override")
    created = old.get("created_at") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    storage.write_text(spark, f"{folder}/request.json", json.dumps({"signature": own, "request": request, "override_reason": override_reason, "created_at": created}, default=str))
    warnings = Y.preflight(own_sources, unpaywall=inputs.get("responses") is not None, email=options.get("email", ""), probe=inputs.get("pages") is not None, metrics_wanted=options.get("min_if") is not None, metrics_off=inputs.get("metrics") is None, min_if=options.get("min_if"), strict_queue=options.get("strict_queue"), time_budget=time_budget, stop_after=stop_after, mode=mode)
    r, begin = Run(spark, f"{folder}/stages", own[:12], {"signature": own}), time.monotonic()
    known: dict[str, str] = {}

    def state(name: str, df: DataFrame) -> str:
        if name not in known:
            known[name] = (versions or {}).get(name) or fingerprint(df)
        return known[name]

    tables, trace, stop = {}, None, ""

    def ended(name: str, last: bool) -> str:
        if cancelled is not None and cancelled():
            return "cancelled"
        if last:
            return ""
        return f"stopped after {name}" if name == stop_after else "time budget exceeded" if time_budget is not None and time.monotonic() - begin > time_budget else ""

    df, parent = candidates, own
    if capture is not None:
        asked = spark.createDataFrame([(i, q) for i, q in enumerate(dict.fromkeys(q.strip() for q in queries if q.strip() and not q.strip().startswith("#")))], "_ord long, query string")
        options_ = {"year_from": profile.year_from, "year_to": profile.year_to, "providers": own_sources or ["openalex"], **(discovery or {})}
        calls = state("capture", A.load(spark, capture, what="calls"))
        made: dict[str, DataFrame] = {}

        def both():
            if not made:
                made["api_candidates"], made["trace"] = X.discover(spark, capture, asked, f"{folder}/stages", own[:12], **options_)
            return made

        trace, trace_sig = r.stage("api_discovery_trace", lambda: both()["trace"], {"options": str(sorted(options_.items()))}, own, {"calls": calls})
        df, parent = r.stage("api_candidates", lambda: both()["api_candidates"], {}, trace_sig, {"records": state("records", A.load(spark, capture))}, Y.counters("api_candidates"))
        tables["api_candidates"] = df
        statuses = {x.status: x["count"] for x in trace.groupBy("status").count().collect()}
        if strict_discovery and X.failed(statuses, 0 if df.isEmpty() else 1):
            storage.write_csv(trace.select(*X.TRACE, "_ord"), f"{folder}/api_discovery_trace.csv", ["_ord"], ("_ord",))
            raise RuntimeError(f"discovery failed at its providers: {statuses}")
        stop = ended("api_candidates", False)
        if candidates is not None:
            mine = candidates.select(*[F.col(c) + _LATER if c == "_ord" else T.text(F.col(c).cast("string")).alias(c) for c in candidates.columns]).withColumnRenamed(f"(_ord + {_LATER})", "_ord")
            df = df.unionByName(mine, allowMissingColumns=True).na.fill("")
            parent = signature({"parent": parent, "candidates": state("candidates", candidates)})
    elif candidates is not None:
        parent = signature({"parent": own, "candidates": state("candidates", candidates)})
    else:
        raise ValueError("give candidates or a capture")
    todo = [] if stop else stages(profile, priorities, **inputs)
    for i, (name, f, params, reads) in enumerate(todo):
        read = {k: state(k, frames[k]) for k in reads if k in frames}
        if name == "verified_candidates" and checkpoint_rows and not params["title_lookup"]:
            df, parent = r.batched(name, df, lambda b, f=f, params=params: f(b, **params), checkpoint_rows, params, parent, read, Y.counters(name))
        else:
            df, parent = r.stage(name, lambda df=df, f=f, params=params: f(df, **params), params, parent, read, Y.counters(name))
        tables[name] = df
        stop = ended(name, i + 1 == len(todo))
        if stop:
            break
    last = {x.stage: x for x in r.records().where("status <> 'partial'").groupBy("stage").agg(F.max_by(F.struct("status", "rows", "counters"), "_ord").alias("r")).select("stage", "r.*").collect()}
    rows, seen = {s: last[s].rows for s in tables}, {s: dict(last[s].counters or {}) for s in tables}
    if "cache" in frames and "verified_candidates" in tables:
        now = inputs.get("now") if inputs.get("now") is not None else F.current_timestamp()
        V.upsert(frames["cache"], V.cache_rows(tables["verified_candidates"], now, options.get("cache_ttl_seconds", 30 * 86400.0))).write.mode("overwrite").parquet(f"{folder}/cache")
    counts = counted(rows, seen)
    statuses = {s: last[s].status for s in (["api_discovery_trace"] if trace is not None else []) + list(tables)}
    manifest = {"run_id": own[:12], "mode": mode, "run_status": "partial" if stop else "completed", "stop_reason": stop, "created_at": created, "updated_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "inputs": known, "stages": [
        {"name": x.stage, "status": x.status, "rows": x.rows, "output": x.path, "output_digest": x.digest, "output_fields": x.fields, "signature": x.signature, "at": str(x.at)} for x in r.records().where("status <> 'partial'").orderBy("_ord").collect()
    ]}
    summary = write_reports(spark, folder, tables, rows, seen, statuses, counts, manifest, plan, trace, target, options.get("min_if"), inputs.get("metrics") is None and options.get("min_if") is not None, warnings)
    return {"stages": tables, "trace": trace, "counts": counts, "summary": summary, "run": r, "run_status": manifest["run_status"]}
