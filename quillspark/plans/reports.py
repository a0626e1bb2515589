"""Reports of a run from what was counted while its stages were written; no stage is read again for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import status as S, text as T
from ..operators import probe as P, report as R, verify as V

# The values that fields of the stages take; other ones are counted together.
VALUES = {
    "triage_priority": ("high", "medium", "needs_review", "low"),
    "candidate_status": ("ready_for_verification", "metadata_check", "metadata_blocked", "llm_review", "low_priority", "lead_unverified"),
    "metadata_status": ("ok", "check", "blocked"),
    "llm_review_needed": ("true", "false"),
    "crossref_status": ("verified", "title_recovered", "mismatch", "lookup_failed", "missing_doi", "title_lookup_failed", "rate_limited", "network_error", "auth_error", "response_parse_error", "provider_error", "skipped_budget"),
    "crossref_verified": ("true", "false"),
    "crossref_lookup_method": ("doi", "title_search"),
    "crossref_cache_status": ("hit", "miss", "store", "disabled"),
    "unpaywall_status": ("ok", "not_found", "missing_doi", "skipped_missing_email", "skipped_budget", "rate_limited", "network_error", "provider_error"),
    "is_oa": ("true", "false"),
    "oa_status": ("gold", "green", "hybrid", "bronze", "closed"),
    "metric_filter_status": ("pass", "fail", "unverified"),
    "access_status": ("pending", *P.ACCESS_ACTIONS),
    "html_status": ("pending", "available", "blocked", "not_html", "unknown"),
    "pdf_status": ("found", "unknown"),
    "si_status": ("found", "unknown"),
    "discovery_provider": ("openalex", "semantic_scholar", "arxiv", "europe_pmc"),
}
OTHER, BLANK = "<other>", "<blank>"
#: Fields that each stage counts.
FIELDS = {
    "api_candidates": ("discovery_provider",),
    "deduped_candidates": ("discovery_provider",),
    "verified_candidates": ("crossref_status", "crossref_verified", "crossref_lookup_method", "crossref_cache_status"),
    "triaged_candidates": ("triage_priority", "metadata_status", "candidate_status", "llm_review_needed"),
    "selected_candidates": ("crossref_status",),
    "oa_annotated_candidates": ("unpaywall_status", "is_oa", "oa_status"),
    "metrics_annotated_candidates": ("metric_filter_status",),
    "publisher_queue": ("access_status", "html_status", "pdf_status", "si_status"),
    "publisher_queue_probed": ("access_status", "html_status", "pdf_status", "si_status"),
}


def counters(stage: str):
    """Aggregates to observe while the stage is written: values of its fields, metadata health, and what is its own."""

    def of(df: DataFrame) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for f in FIELDS.get(stage, ()):
            if f in df.columns:
                x = T.strip(f)
                out |= {f"{f}={v}": F.count_if(x == v) for v in VALUES[f]} | {f"{f}={BLANK}": F.count_if(x == ""), f"{f}={OTHER}": F.count_if((x != "") & ~x.isin(*VALUES[f]))}
        if stage in ("deduped_candidates", "verified_candidates", "oa_annotated_candidates"):
            out |= {f"health={k}": c for k, c in R.health_columns(df).items()}
        if stage == "verified_candidates":
            out |= {f"verification={k}": c for k, c in V.verification_counts().items()}
        if stage == "publisher_queue_probed":
            out["probed"] = F.count_if(T.strip("publisher_probe_at") != "")
        return out

    return of


def histogram(counted: dict[str, int], field: str) -> dict[str, int]:
    """Counts of a field's values, the most frequent first."""
    own = {k.split("=", 1)[1]: n for k, n in counted.items() if k.startswith(f"{field}=") and n}
    return dict(sorted(own.items(), key=lambda x: (-x[1], x[0])))


def _table(rows: dict[str, int]) -> list[str]:
    return ["| Value | Count |", "|-------|-------|", *[f"| {v} | {n} |" for v, n in rows.items()], ""]


def _section(title: str, counted: dict[str, int], fields) -> list[str]:
    found = [(f, histogram(counted, f)) for f in fields]
    body = [line for f, rows in found if rows for line in (f"### `{f}`", "", *_table(rows))]
    return [f"## {title}", "", *body] if body else []


def trace_histograms(trace: DataFrame) -> dict[str, dict[str, int]]:
    """Counts of the trace's fields: one aggregation over the plan's calls."""
    fields = ("provider", "status", "status_class", "http_status", "transient_error", "cache_status", "next_action")
    out: dict[str, dict[str, int]] = {f: {} for f in fields}
    for r in R.histograms(trace, fields).collect():
        out[r.field][r.value] = r.n
    return {f: dict(sorted(v.items(), key=lambda x: (-x[1], x[0]))) for f, v in out.items()}


def processing(rows: dict[str, int], counted: dict[str, dict[str, int]], statuses: dict[str, str], tiers: dict[str, int], trace: dict | None, problems: list, strategy: dict, index: dict) -> str:
    """The processing report. rows and counted: by stage; statuses: by stage record."""
    get = lambda s: counted.get(s, {})
    lines = ["# Processing Report", "", "## Stage Counts", "", *[f"- {name}: {n}" for name, n in rows.items()], ""]
    if "api_candidates" in rows and "deduped_candidates" in rows:
        lines += [f"- duplicates_or_removed_before_dedupe: {max(0, rows['api_candidates'] - rows['deduped_candidates'])}", ""]
    if statuses:
        lines += ["## Stage Recovery Semantics", "", *[f"- {s}: {v}" for s, v in statuses.items()], ""]
    lines += ["## Trust Tiers", "", *[f"- {k}: {v}" for k, v in tiers.items()], ""]
    last = next((s for s in ("oa_annotated_candidates", "verified_candidates", "selected_candidates", "triaged_candidates", "deduped_candidates", "api_candidates") if histogram(get(s), "discovery_provider")), "")
    lines += _section("Source Distribution", get(last), ("discovery_provider",))
    if trace is not None:
        lines += ["## Discovery Trace Health", "", *[line for f, own in trace.items() for line in (f"### `{f}`", "", *_table(own))]]
        if problems:
            lines += ["### Non-OK Provider Calls", "", *[f"- {p.provider} {p.query_id}: {p.status}; returned={p.returned_count}; error={p.error}" for p in problems], ""]
    lines += ["## Metadata Health", ""]
    for s in ("deduped_candidates", "verified_candidates", "oa_annotated_candidates"):
        h = {k.split("=", 1)[1]: n for k, n in get(s).items() if k.startswith("health=")}
        if h:
            lines += [f"### {s}", "", f"- rows: {h['rows']}", f"- DOI present: {h['with_doi']} / {h['rows']}", f"- DOI missing: {h['missing_doi']}", f"- DOI invalid format: {h['invalid_doi']}", *[f"- {k} missing: {h[f'missing_{k}']}" for k in ("title", "year", "journal")], ""]
    lines += _section("Crossref Verification", get("verified_candidates"), FIELDS["verified_candidates"])
    lines += _section("Triage Summary", get("triaged_candidates"), FIELDS["triaged_candidates"])
    access = {**get("oa_annotated_candidates"), **(get("publisher_queue_probed") or get("publisher_queue"))}
    lines += _section("Access And OA Hints", access, (*FIELDS["oa_annotated_candidates"], *FIELDS["publisher_queue"]))
    if index.get("by_tier"):
        lines += ["## Artifact Tiers", "", *[f"- {t}: {', '.join(names)}" for t, names in index["by_tier"].items()], ""]
    own = [(k, strategy.get(k)) for k in ("selected_sources", "recommended_sources", "missing_recommended_sources", "risk_flags")]
    if any(v for _, v in own):
        lines += ["## Source Strategy", "", *[f"- {k}: {', '.join(v)}" for k, v in own if v], ""]
    return "\n".join(lines) + "\n"


def discovery(candidates: int, by_provider: dict[str, int], trace: dict[str, dict[str, int]], rows: list, capabilities: list) -> str:
    """The discovery report: counts, statuses, capabilities of the providers and a line for each call (at most some thousands)."""
    listed = lambda own: [f"- {k}: {n}" for k, n in sorted(own.items())] or ["- none: 0"]
    cell = lambda x: str(x if x is not None else "").replace("|", "\\|").replace("\n", " ")
    names = ("provider", "query_id", "returned_count", "status", "status_class", "http_status", "transient_error", "retry_after_seconds", "cache_status", "next_action", "query", "error")
    lines = ["# API Discovery Report", "", f"Candidates: {candidates}", f"Queries x providers: {sum(trace['status'].values())}", "", "## Provider Counts", "", *listed(by_provider), "", "## Provider Statuses", "", *listed(trace["status"]), "", "## Provider Status Classes", "", *listed(trace["status_class"]), ""]
    lines += ["## Provider Capabilities", "", "| Provider | Role | Aliases |", "|---|---|---|", *[f"| {c.provider} | {c.role} | {', '.join(c.aliases)} |" for c in capabilities], ""]
    lines += ["## Query Trace", "", "| " + " | ".join(names) + " |", "|---" * len(names) + "|", *["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows], ""]
    return "\n".join(lines)


def preflight(sources, s2_key=False, unpaywall=False, email="", probe=False, page_fields=(), metrics_wanted=False, metrics_off=False, min_if=None, strict_queue=None, time_budget=None, stop_after=None, mode="") -> list[str]:
    """Warnings before a run, in order."""
    rules = [
        (mode == "fast", "Fast mode is enabled: Crossref verification, Unpaywall annotation, Semantic Scholar, and publisher probing are disabled unless explicitly re-enabled."),
        (unpaywall and not email, "Unpaywall is enabled but no e-mail address is set; Unpaywall rows will be skipped."),
        (not probe and bool(page_fields), "Publisher-page fields were requested but publisher probing is disabled; publisher_queue.csv will be created without resolved access/html/pdf status."),
        ("semantic_scholar" in sources and not s2_key, "Semantic Scholar is selected without an API key; the free unauthenticated API is more likely to return HTTP 429 rate limits."),
        (metrics_wanted and metrics_off, "Journal metrics were requested but journal_metrics is disabled; metric annotation/filtering will be skipped."),
        (min_if is not None and strict_queue is False, "A minimum impact-factor threshold is set, but queue_strict_only is disabled; metric-fail and unverified rows may still enter the publisher queue."),
        (time_budget is not None, "A run time budget is set; the run stops only at stage boundaries and writes partial artifacts."),
        (bool(stop_after), f"Run will stop after stage: {stop_after}."),
    ]
    return [text for holds, text in rules if holds]


def stage_meanings(statuses: dict[str, str], spark) -> dict[str, str]:
    """status (class; action) of each stage's last record."""
    if not statuses:
        return {}
    df = spark.createDataFrame([*statuses.items()], "stage string, status string")
    rows = df.select("stage", F.format_string("%s (%s; %s)", "status", S.classify(F.col("status")), S.next_action(F.col("status"))).alias("t")).collect()
    own = {r.stage: r.t for r in rows}
    return {s: own[s] for s in statuses}
