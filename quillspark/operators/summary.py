"""Run summaries: feasibility, trust tiers, next actions, the artifact catalogue, reports and configuration checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import status as S, text as T
from ..sources import storage

# Reasons why a run does not reach what was asked.
NO_CANDIDATES = "No candidates remained after discovery/merge/deduplication."
NO_TRIAGE = "No rows reached semantic triage."
METRICS_OFF = "Metric filtering was requested but journal metrics are disabled."
NO_METRIC = "No metric-pass candidates are available under the current IF threshold."
NO_QUEUE = "No candidates reached the publisher evidence queue under the current constraints."
# Advice by condition, in order.
ACTIONS = {
    "resume": "Resume the run with the same output_dir if the user request has not changed.",
    "limited": "Review provider retry_after_seconds in api_discovery_trace.csv before retrying rate-limited sources.",
    "cached": "Wait for provider failure cache TTL or rerun with --no-cache after fixing the environment.",
    "trace": "Inspect api_discovery_trace.csv before treating low counts as scientific absence.",
    "verify": "Run or resume Crossref verification before presenting bibliographic facts as verified.",
    "probe": "Use publisher_queue.csv for page inspection; publisher access has not been probed.",
    "review": "Review triaged_candidates.csv and constraints before broadening queries or relaxing filters.",
    "metrics": "Check journal metric coverage before enforcing metric thresholds.",
    "synonyms": "Consider adding focused synonym or mechanism queries before treating recall as complete.",
    "stored": "Provider failure cache stored a transient failure; resume later before repeating broad discovery.",
}
MORE_SOURCES = "Consider an additional discovery pass for recommended sources not selected: "
# Columns shown first.
PREFERRED = ("title", "crossref_title", "doi", "crossref_doi", "publication_year", "crossref_year", "journal", "crossref_container", "triage_priority", "triage_score", "candidate_status", "metadata_status", "crossref_status", "metric_filter_status", "publisher_url", "best_oa_url")
# Files of a run by tier, in reading order.
ARTIFACTS = {
    "primary": ("agent_summary.json", "processing_report.md", "artifacts_index.json", "query_plan.json", "run_manifest.json", "triaged_candidates.csv", "publisher_queue.csv", "api_discovery_trace.csv"),
    "supporting": ("feasibility_report.md", "field_provenance.json", "api_candidates.csv", "deduped_candidates.csv", "verified_candidates.csv", "selected_candidates.csv", "oa_annotated_candidates.csv", "metrics_annotated_candidates.csv", "publisher_queue_probed.csv"),
    "debug": ("api_discovery_report.md", "publisher_adapters.json", "strict_candidates.csv", "backup_candidates.csv"),
}
# Ways to reach a publisher's page: name, status, capabilities, boundary.
ADAPTERS = [
    ("http_heuristic", "built_in", ("doi_resolution", "html_marker_detection", "pdf_si_link_hints", "ssrf_guard"), "No JavaScript execution, no PDF parsing, no paywall bypass."),
    ("browser_page", "external_optional", ("javascript_page_opening", "screenshot_capture", "visible_text_extraction"), "Requires an Agent/browser integration; must respect publisher access controls."),
    ("pdf_extraction", "external_optional", ("pdf_text", "table_extraction", "supplementary_materials"), "Only on accessible PDFs and supplements; not part of this library."),
]
# Configuration keys and the JSON types that they take.
CONFIG = {
    "channels.openalex": ("boolean",), "channels.semantic_scholar": ("boolean",), "channels.arxiv": ("boolean",), "channels.europe_pmc": ("boolean",),
    "channels.crossref": ("boolean",), "channels.unpaywall": ("boolean",), "channels.journal_metrics": ("boolean",), "channels.publisher_probe": ("boolean",),
    "api.openalex_api_key_env": ("string",), "api.openalex_mailto_env": ("string",), "api.crossref_mailto_env": ("string",), "api.unpaywall_email_env": ("string",),
    "api.contact_email_env": ("string",), "api.openalex_work_types": ("string",),
    "limits.max_results_per_query": ("integer",), "limits.semantic_query_limit": ("integer", "null"), "limits.semantic_max_results": ("integer", "null"),
    "limits.publisher_probe_limit": ("integer", "null"), "limits.publisher_probe_sleep": ("integer", "number"), "limits.strict_discovery": ("boolean",),
    "limits.parallel_providers": ("boolean",), "limits.provider_workers": ("integer", "null"), "limits.provider_failure_threshold": ("integer", "null"),
    "limits.provider_rate_limit_cooldown_seconds": ("integer", "number"), "limits.unpaywall_sleep": ("integer", "number"), "limits.crossref_checkpoint_interval": ("integer",),
    "limits.unpaywall_checkpoint_interval": ("integer",), "limits.time_budget_seconds": ("integer", "number", "null"), "limits.max_crossref_rows": ("integer", "null"),
    "limits.max_unpaywall_rows": ("integer", "null"), "limits.max_publisher_probe_rows": ("integer", "null"),
    "outputs.default_output_dir": ("string",), "outputs.screenshot_root": ("string",),
    "cache.enabled": ("boolean",), "cache.cache_dir": ("string",), "cache.ttl_days": ("integer", "number"), "cache.provider_failure_ttl_seconds": ("integer", "number"),
    "evidence.require_doi_for_queue": ("boolean",), "evidence.queue_priorities": ("string",), "evidence.include_metadata_blocked": ("boolean",), "evidence.queue_strict_only": ("boolean",), "evidence.unknown_value": ("string",),
}
DISCOVERY = ("openalex", "semantic_scholar", "arxiv", "europe_pmc")


def feasibility(counts: DataFrame, target: int | None = None, min_if: float | None = None, metrics_off=False) -> DataFrame:
    """Adds feasible and the ordered reasons to rows of counts (deduped, triaged, publisher_queue, metric_pass)."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in counts.columns else F.lit(0)
    queue = n("publisher_queue")
    empty = F.lit(METRICS_OFF) if min_if is not None and metrics_off else F.when((n("metric_pass") == 0) & F.lit(min_if is not None), NO_METRIC).otherwise(NO_QUEUE)
    rules = [(n("deduped") == 0, F.lit(NO_CANDIDATES)), (n("triaged") == 0, F.lit(NO_TRIAGE)), (queue == 0, empty)]
    if target is not None:
        rules.append((queue < target, F.concat(F.lit("Current feasible count "), queue.cast("string"), F.lit(f" is below requested target {target}."))))
    return counts.withColumn("blocking_reasons", T.compact(rules)).withColumn("feasible", F.size("blocking_reasons") == 0)


def next_actions(df: DataFrame) -> Column:
    """Ordered advice for rows of a run's counts.

    Columns: partial, n_rate_limited, n_cooldown, n_cached_failure, n_provider_problems, discovered, trusted, queued, probed,
    metric_pass, n_metric_rows, missing_sources (array), single_query, n_failures_stored."""
    c = F.col
    missing = F.coalesce(c("missing_sources"), F.array().cast("array<string>"))
    return T.compact([
        (c("partial"), F.lit(ACTIONS["resume"])), ((c("n_rate_limited") > 0) | (c("n_cooldown") > 0), F.lit(ACTIONS["limited"])), (c("n_cached_failure") > 0, F.lit(ACTIONS["cached"])),
        (c("n_provider_problems") > 0, F.lit(ACTIONS["trace"])), ((c("discovered") > 0) & (c("trusted") == 0), F.lit(ACTIONS["verify"])), ((c("queued") > 0) & (c("probed") == 0), F.lit(ACTIONS["probe"])),
        (c("queued") == 0, F.lit(ACTIONS["review"])), ((c("metric_pass") == 0) & (c("n_metric_rows") > 0), F.lit(ACTIONS["metrics"])),
        (F.size(missing) > 0, F.concat(F.lit(MORE_SOURCES), F.array_join(missing, ", "), F.lit("."))), (c("single_query"), F.lit(ACTIONS["synonyms"])), (c("n_failures_stored") > 0, F.lit(ACTIONS["stored"])),
    ])


def provider_counts(trace: DataFrame) -> DataFrame:
    """Per provider and status: class, calls and rows; all_failed and any_failed say it for the provider's calls together."""
    one = trace.groupBy("provider", "status").agg(F.count("*").alias("calls"), F.sum("n_rows").alias("n_rows"))
    both = trace.groupBy("provider").agg(F.bool_and(S.is_failure(F.col("status"))).alias("all_failed"), F.bool_or(S.is_failure(F.col("status"))).alias("any_failed"))
    return one.withColumn("status_class", S.classify(F.col("status"))).join(F.broadcast(both), "provider")


def discovery_status(trace: DataFrame) -> DataFrame:
    """Per run: rate limits first, then any class that is neither ok nor empty, else completed."""
    kind = S.classify(F.col("status"))
    bad = kind.isin("auth", "network", "error", "partial", "skipped")
    return trace.groupBy("run_id").agg(F.when(F.bool_or(kind == "rate_limited"), "partial_rate_limited").when(F.bool_or(bad), "partial_source_failure").otherwise("completed").alias("stage_status"))


def compact_columns(columns: list[str]) -> list[str]:
    """The preferred columns there are, in their order, else the first twelve."""
    return [c for c in PREFERRED if c in columns] or columns[:12]


def adapters(spark) -> DataFrame:
    return spark.createDataFrame([(n, s, list(c), b) for n, s, c, b in ADAPTERS], "name string, status string, capabilities array<string>, boundary string")


def capped(df: DataFrame, most: int = 20) -> tuple[DataFrame, bool]:
    """The first rows by _ord, and whether there are more."""
    rows = df.orderBy("_ord").limit(most)
    return rows, df.limit(most + 1).count() > most


def problem_rows(df: DataFrame, status: str, error: str, most: int = 12, width: int = 160) -> DataFrame:
    """The first rows by _ord that are not ok or empty, with their error cut to width characters."""
    bad = ~S.classify(F.col(status)).isin("ok", "empty_or_missing")
    return df.where(bad).orderBy("_ord").limit(most).withColumn(error, F.substring(T.text(error), 1, width))


def ordered_checks(checks: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    """(name, level, message) by level (error, warning, ok), name and message."""
    rank = {"error": 0, "warning": 1, "ok": 2}
    return sorted(checks, key=lambda c: (rank.get(c[1], 3), c[0], c[2]))


#: Name of each JSON type in messages.
_NAMES = {"boolean": "bool", "integer": "int", "number": "float", "string": "str", "null": "NoneType", "object": "dict", "array": "list"}


def _kind(x) -> str:
    """JSON type of a parsed value."""
    if x is None:
        return "null"
    return next(k for t, k in ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"), (dict, "object"), (list, "array")) if isinstance(x, t))


def settings(data: dict) -> dict[str, object]:
    """section.key -> value for the sections of a configuration that are objects."""
    return {f"{s}.{k}": v for s, own in data.items() if isinstance(own, dict) for k, v in own.items()}


def config_checks(data) -> list[tuple[str, str, str]]:
    """(name, level, message) for a configuration: types are errors, unknown keys warnings, negative limits errors."""
    if _kind(data) != "object":
        return [("config", "error", "configuration must be an object")]
    sections, given = {k.split(".")[0] for k in CONFIG}, settings(data)
    # a boolean is also a whole number, as in the configuration's own language
    fits = lambda k, v: _kind(v) in CONFIG[k] or _kind(v) == "boolean" and "integer" in CONFIG[k]
    number = lambda v: _kind(v) in ("integer", "number")
    rules = [
        ("warning", [f"unknown top-level section: {s}" for s in data if s not in sections]),
        ("error", [f"section {s!r} must be an object" for s in data if s in sections and _kind(data[s]) != "object"]),
        ("warning", [f"unknown key: {k}" for k in given if k.split(".")[0] in sections and k not in CONFIG]),
        ("error", [f"{k} must be {' or '.join(_NAMES[t] for t in CONFIG[k])}, got {_NAMES[_kind(v)]}" for k, v in given.items() if k in CONFIG and not fits(k, v)]),
        ("warning", ["all discovery channels are disabled"] if _kind(data.get("channels", {})) == "object" and not any(given.get(f"channels.{c}") for c in DISCOVERY) else []),
        ("error", [f"{k.removeprefix('limits.')} must not be negative" for k, v in given.items() if k.startswith(("limits.", "cache.")) and "integer" in CONFIG.get(k, ()) and number(v) and v < 0]),
    ]
    return [("config", "ok", "loaded")] + [("config", level, text) for level, texts in rules for text in texts]


def artifact_index(spark, folder: str, rows: dict[str, int] | None = None) -> dict:
    """The catalogue of a run's files with tier, reading order, existence, size, rows where they are known, and digest."""
    out = []
    for i, (tier, file) in enumerate(((tier, file) for tier, files in ARTIFACTS.items() for file in files), 1):
        path, name = f"{folder}/{file}", file.rsplit(".", 1)[0]
        here = storage.exists(spark, path)
        out.append({"name": name, "tier": tier, "read_order": i, "path": path, "exists": here, "rows": (rows or {}).get(name) if here else None, "size": storage.size(spark, path) if here else None, "sha256": storage.sha256(spark, path) if here else ""})
    there = [r for r in out if r["exists"]]
    tiers = {t: [r["name"] for r in there if r["tier"] == t] for t in ARTIFACTS}
    return {"schema_version": 1, "by_tier": {t: names for t, names in tiers.items() if names}, "read_order": [r["name"] for r in there], "artifacts": out}


def feasibility_text(counts: dict[str, int], reasons: list[str], target: int | None = None, warnings=()) -> str:
    lines = ["# Feasibility Report", "", f"Target count: `{target if target is not None else 'not specified'}`", f"Overall: `{'NOT_FEASIBLE' if reasons else 'FEASIBLE'}`", "", "## Counts", "", *[f"- {k}: {v}" for k, v in counts.items()], "", "## Feasibility", ""]
    lines += ["Blocking reasons:", *[f"- {r}" for r in reasons]] if reasons else ["The current constraints appear feasible from the available candidate set."]
    lines += ["", "## Configuration Warnings", "", *[f"- {w}" for w in warnings]] if warnings else []
    return "\n".join(lines) + "\n"
