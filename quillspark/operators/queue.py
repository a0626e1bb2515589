"""Work queue: gates in order, extraction priority, projection and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as T


def _c(df, *names) -> Column:
    own = [n for n in names if n in df.columns]
    return T.first_filled(*own) if own else F.lit("")


def decision(df: DataFrame) -> Column:
    return T.strip(_c(df, "screening_decision", "include_status"))


def admit(df: DataFrame, priorities=(), decisions=(), statuses=()) -> Column:
    """The first filled signal decides: priority, then status, then decision; none filled admits."""
    out = None
    for col, allowed in ((T.strip(_c(df, "triage_priority")), priorities), (T.strip(_c(df, "candidate_status")), statuses), (decision(df), decisions)):
        if allowed:
            out = (F if out is None else out).when(col != "", col.isin(*allowed))
    return F.lit(True) if out is None else out.otherwise(True)


def authority_block(df: DataFrame) -> Column:
    status, mismatch = F.lower(T.strip(_c(df, "crossref_status"))), T.strip(_c(df, "crossref_mismatches"))
    return F.when(mismatch != "", mismatch).when(status.isin("lookup_failed", "title_lookup_failed", "mismatch"), F.concat(F.lit("crossref_status="), status)).otherwise("")


def extraction_priority(df: DataFrame) -> Column:
    p, d = T.strip(_c(df, "triage_priority")), decision(df)
    score = T.first_number(_c(df, "triage_score", "relevance_score"))
    return F.when(p == "high", "1").when(p == "medium", "2").when(p == "needs_review", "3").when(p == "low", "4").when(d == "Include", "1").when(d == "Backup", "2").when(score >= 6, "1").when(score >= 3, "2").otherwise("3")


def skip_reason(df: DataFrame, priorities=(), decisions=(), statuses=(), include_blocked=False, require_doi=True) -> Column:
    """Empty for rows that enter the queue; else the first gate that stops them."""
    doi = T.doi(_c(df, "crossref_doi", "doi"))
    gates = [] if include_blocked else [(_c(df, "metadata_status") == "blocked", "metadata_blocked"), (authority_block(df) != "", "crossref_blocked")]
    gates.append((~admit(df, priorities, decisions, statuses), "filtered"))
    if require_doi:
        gates.append((doi == "", "missing_doi"))
    out = F
    for stops, name in gates:
        out = out.when(stops, name)
    return out.otherwise("")


# Fields asked for, and texts of the queue.
FIELDS_NEEDED = ("publisher_landing_page", "abstract_or_summary", "article_sections_available", "task_requested_fields", "evidence_pointer", "pdf_url", "si_url")
PAGE_FIELDS = ("publisher_visible_text", "abstract", "methods_or_evidence_section", "results_or_key_claim_section", "evidence_pointer")
NEXT_ACTION = "Resolve DOI landing page and inspect publisher-visible article page. Use Unpaywall OA links as structured access hints when present. Record PDF/SI URLs if offered, but do not infer unavailable fields."
NOTES = "Agent-facing evidence queue; requested fields are task-specific. Publisher probe fields are planning hints, not extracted evidence."


def build(df: DataFrame, priorities=("high", "medium"), decisions=(), statuses=(), include_blocked=False, require_doi=True, fields_needed=FIELDS_NEEDED, page_fields=PAGE_FIELDS, screenshots="screenshots", guide="publisher-page-extraction.md") -> DataFrame:
    """Admitted rows with the queue's columns and _ord, unsorted; sort with ``order`` at a sink."""
    if priorities and "triage_priority" not in df.columns:
        raise ValueError("triage_priority is missing")
    if statuses and "candidate_status" not in df.columns:
        raise ValueError("candidate_status is missing")
    doi = T.doi(_c(df, "crossref_doi", "doi"))
    rows = df.where(skip_reason(df, priorities, decisions, statuses, include_blocked, require_doi) == "")
    link = F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")
    pdf, own, title = _c(df, "best_oa_pdf_url"), _c(df, "title"), _c(df, "crossref_title", "title")
    copied = lambda *names: {n: _c(df, n) for n in names}
    folder = T.safe_name(F.when(doi != "", doi).otherwise(own))
    cols = {
        "queue_status": F.lit("pending"), "extraction_priority": extraction_priority(df),
        "title": F.when(title != "", title).when(doi != "", F.concat(F.lit("DOI "), doi)).otherwise(""), "doi": doi, "doi_url": link,
        "journal": _c(df, "crossref_container", "journal"), "publication_year": _c(df, "crossref_year", "publication_year", "year"),
        "publisher_url": T.first_filled(link, _c(df, "landing_page_url", "url", "crossref_url")),
        **copied("discovery_source", "triage_priority", "triage_score", "candidate_status", "semantic_tags", "triage_reasons", "hard_filter_flags", "metadata_status", "crossref_status", "crossref_verified", "crossref_lookup_method", "crossref_mismatches", "crossref_title_similarity", "crossref_recovered_doi_confidence"),
        "screening_decision": decision(df), **copied("relevance_score", "journal_metric", "journal_metric_source", "metric_filter_status"),
        "access_status": F.lit("pending"), "html_status": F.lit("pending"),
        **copied("is_oa", "oa_status", "best_oa_url", "best_oa_landing_url", "best_oa_pdf_url", "best_oa_host_type", "best_oa_version", "best_oa_license", "unpaywall_status"),
        "pdf_status": F.when(pdf != "", "found").otherwise("unknown"), "si_status": F.lit("unknown"), "resolved_url": _c(df, "best_oa_landing_url", "best_oa_url"), "pdf_url": pdf, "si_url": F.lit(""),
        "fields_needed": F.lit("; ".join(fields_needed)), "page_required_fields": F.lit("; ".join(page_fields)), "full_text_required_fields": F.lit("; ".join(page_fields)),
        "screenshot_dir": F.concat(F.lit(screenshots.rstrip("/") + "/"), folder), "extraction_sop": F.lit(guide), "evidence_target_grade": F.lit("publisher_page_or_better"), "next_action": F.lit(NEXT_ACTION), "notes": F.lit(NOTES),
    }
    return rows.select("_ord", *[c.alias(n) for n, c in cols.items()])


def counts(df: DataFrame, **gates) -> DataFrame:
    """One row: queued rows and rows skipped by each kind of gate."""
    why = skip_reason(df, **gates)
    return df.agg(F.count_if(why == "").alias("queued"), F.count_if(why == "filtered").alias("skipped_filter"), F.count_if(why.isin("metadata_blocked", "crossref_blocked")).alias("skipped_metadata_blocked"), F.count_if(why == "missing_doi").alias("skipped_missing_doi"))


def order(df: DataFrame) -> DataFrame:
    """Extraction priority, score descending, title, input order. A global sort: for sinks only."""
    first = F.when(F.col("extraction_priority").rlike("^[0-9]+$"), F.col("extraction_priority").cast("int")).otherwise(99)
    return df.orderBy(first, F.desc(T.first_number(T.first_filled("triage_score", "relevance_score"))), F.lower("title"), "_ord")
