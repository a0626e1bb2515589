"""Status texts: classes, actions and failure predicates as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import any_of, strip

# Classes in order of precedence, each with exact values, prefixes and parts of a status.
CLASSES = [
    ("ok", ("ok", "verified", "title_recovered", "pass", "completed", "skipped_existing"), (), ()),
    ("empty_or_missing", ("empty_result", "not_found", "missing_doi", "title_lookup_failed", "lookup_failed"), (), ()),
    ("budget_limited", ("skipped_budget", "partial_budget"), (), ()),
    ("auth", (), (), ("missing_email",)),
    ("skipped", (), ("skipped",), ()),
    ("rate_limited", ("http_429", "429"), (), ("rate_limited", "rate_limit", "too_many_requests")),
    ("auth", ("http_401", "http_403"), (), ()),
    ("network", (), (), ("network", "certificate", "ssl", "dns", "timeout", "connection", "name_resolution", "name resolution", "http_408")),
    ("auth", (), (), ("auth", "forbidden", "unauthorized")),
    ("partial", (), ("partial",), ()),
    ("error", ("mismatch", "error", "provider_error", "response_parse_error"), ("http_",), ()),
    ("unknown", ("", "<blank>"), (), ()),
]
# The action for each class.
ACTIONS = {
    "ok": "use_as_verified_for_this_stage",
    "empty_or_missing": "treat_as_missing_for_this_source_only_or_try_title/source_expansion",
    "budget_limited": "resume_with_higher_row_budget_or_continue_from_existing_artifacts",
    "skipped": "inspect_skip_reason_before_rerun",
    "rate_limited": "resume_later_or_reduce_request_volume",
    "network": "check_agent_network_permission_proxy_or_certificate",
    "auth": "check_api_key_contact_email_or_provider_access_policy",
    "partial": "keep_partial_rows_and_resume_or_retry_failed_stage",
    "error": "inspect_error_and_verify_with_alternate_source",
}
# The action for a provider call, by class and by raw status.
PROVIDER_ACTIONS = {
    "ok": "use_returned_candidates",
    "empty_or_missing": "treat_as_no_candidates_for_this_query_source_only",
    "auth": "check_provider_key_contact_email_or_access_policy_before_retrying",
    "network": "check_agent_network_permission_proxy_or_certificate_before_retrying",
    "rate_limited": "retry_provider_later_or_reduce_query_volume",
    "partial": "keep_partial_rows_and_resume_or_retry_provider_later",
    "skipped": "inspect_skip_reason_before_rerun",
    "budget_limited": "resume_with_higher_row_budget_or_continue_from_existing_artifacts",
}
PROVIDER_RAW = {
    "skipped_circuit_breaker": "continue_with_other_sources_or_lower_provider_failure_threshold",
    "skipped_rate_limit_cooldown": "retry_this_provider_after_cooldown_or_continue_with_other_sources",
    "skipped_cached_provider_failure": "wait_for_failure_cache_ttl_or_disable_cache_after_environment_fix",
}
FAILURES = ("auth", "error", "network", "partial", "rate_limited")


def classify(status: Column) -> Column:
    s, out = F.lower(strip(status)), F
    for name, exact, heads, parts in CLASSES:
        hit = any_of([s.isin(*exact)] * bool(exact) + [s.startswith(h) for h in heads] + [F.contains(s, F.lit(p)) for p in parts])
        out = out.when(hit, name)
    return out.otherwise("needs_review")


def _by(key: Column, table: dict[str, str], default: str) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(default)


def next_action(status: Column) -> Column:
    return _by(classify(status), ACTIONS, "manual_review")


def provider_action(status: Column, retry_after: Column | None = None) -> Column:
    kind = classify(status)
    wait = F.coalesce(retry_after, F.lit("")) != "" if retry_after is not None else F.lit(False)
    raw = _by(status, PROVIDER_RAW, "")
    return F.when((kind == "rate_limited") & wait, "retry_provider_after_retry_after_or_resume_later").when((kind == "skipped") & (raw != ""), raw).otherwise(_by(kind, PROVIDER_ACTIONS, "inspect_error_and_continue_with_other_sources_when_possible"))


def is_failure(status: Column) -> Column:
    return classify(status).isin(*FAILURES)


def is_cacheable_failure(status: Column, has_rows: Column, transient: Column) -> Column:
    kind = classify(status)
    return ~has_rows & ((kind == "rate_limited") | ((kind == "network") & F.coalesce(transient, F.lit(True))) | ((kind == "error") & F.coalesce(transient, F.lit(False))))


def fetch_status(http: Column, error: Column, message: Column, auth=(401, 403)) -> Column:
    """Status of a captured response: HTTP code, else the kind of failure."""
    low = F.lower(F.concat_ws(" ", error, message))
    net = any_of(F.contains(low, F.lit(x)) for x in ("ssl", "dns", "urlerror", "timed out", "name resolution"))
    return F.when(http.isin(*auth), "auth_error").when(http >= 400, F.concat(F.lit("http_"), http.cast("string"))).when(net, "network_error").when(F.contains(low, F.lit("parse")), "response_parse_error").otherwise("error")


def partial_status(status: Column, rows: Column) -> Column:
    """A failure after some rows is partial, unless it is already."""
    return F.when((rows > 0) & ~status.startswith("partial"), F.concat(F.lit("partial_"), status)).otherwise(status)


def retry_wait(header: Column, attempt: Column, cap: int = 60) -> Column:
    """Seconds to wait: the header's, clamped to the cap, else a power of two."""
    own = F.when(header.rlike(r"^\d+(\.\d+)?$"), header.cast("double"))
    return F.least(F.coalesce(own, F.pow(F.lit(2.0), attempt)), F.lit(float(cap)))


def classify_sql(x: str) -> str:
    """The same rules as a DuckDB expression."""
    s, out = f"lower(trim({x}))", []
    for name, exact, heads, parts in CLASSES:
        hit = [f"{s} = '{e}'" for e in exact] + [f"starts_with({s}, '{h}')" for h in heads] + [f"contains({s}, '{p}')" for p in parts]
        out.append(f"WHEN {' OR '.join(hit)} THEN '{name}'")
    return f"CASE {' '.join(out)} ELSE 'needs_review' END"


def table_sql(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"
