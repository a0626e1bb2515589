"""Concept triage: flags, score, priority, status, tags and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import concepts as C, text as T

RANK = {"high": 0, "medium": 1, "needs_review": 2, "low": 3}


def _c(df, name) -> Column:
    return T.text(name) if name in df.columns else F.lit("")


def _checks(df: DataFrame, p: C.Profile) -> list[tuple[Column, Column, Column, Column]]:
    """(condition, flag, reason, whether it blocks) of every metadata check, in order."""
    title = T.strip(T.first_filled(_c(df, "crossref_title"), _c(df, "title")))
    doi = T.doi(T.first_filled(_c(df, "crossref_doi"), _c(df, "doi")))
    year = T.year(_c(df, "crossref_year"), _c(df, "publication_year"), _c(df, "year"))
    kind = T.article_type(T.first_filled(_c(df, "crossref_type"), _c(df, "article_type")))
    status, metric = F.lower(T.strip(_c(df, "crossref_status"))), F.lower(T.strip(_c(df, "metric_filter_status")))
    mismatch, y = T.strip(_c(df, "crossref_mismatches")), year.cast("string")
    no, yes, need = F.lit(False), F.lit(True), F.lit(p.require_doi)
    say = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    out = [
        (title == "", F.lit("missing_title"), F.lit("title is missing"), no),
        (doi == "", F.lit("missing_doi"), F.lit("DOI is missing"), need),
        ((doi != "") & ~doi.rlike(T.DOI), F.lit("invalid_doi_format"), F.lit("DOI format does not match standard DOI pattern"), need),
        (year.isNull(), F.lit("missing_year"), F.lit("publication year is missing"), no),
    ]
    if p.year_from is not None:
        out.append((year < p.year_from, F.lit(f"year_before_{p.year_from}"), say("publication year ", y, f" is before {p.year_from}"), yes))
    if p.year_to is not None:
        out.append((year > p.year_to, F.lit(f"year_after_{p.year_to}"), say("publication year ", y, f" is after {p.year_to}"), yes))
    if p.exclude_article_types:
        out.append((kind.isin(*p.exclude_article_types), say("article_type_", kind), say("article type '", kind, "' is in caller-supplied excluded types"), yes))
    why = T.text(_c(df, "metric_filter_reason"))
    return [
        *out,
        (mismatch != "", F.lit("crossref_mismatch"), mismatch, yes),
        (status.isin("lookup_failed", "title_lookup_failed"), say("crossref_", status), say("Crossref status is ", status), yes),
        (status == "mismatch", F.lit("crossref_mismatch"), F.lit("Crossref metadata mismatch"), yes),
        (metric.isin("fail", "unverified"), say("metric_", metric), F.when(why != "", why).otherwise(say("journal metric status is ", metric)), metric == "fail"),
    ]


def metadata_flags(df: DataFrame, p: C.Profile) -> tuple[Column, Column, Column]:
    """(ordered flags, blocked/check/ok, ordered reasons)."""
    checks = [(F.coalesce(c, F.lit(False)), flag, why, b) for c, flag, why, b in _checks(df, p)]
    blocked = T.any_of(c & b for c, _, _, b in checks)
    status = F.when(blocked, "blocked").when(T.any_of(c for c, *_ in checks), "check").otherwise("ok")
    return T.compact([(c, flag) for c, flag, *_ in checks]), status, T.compact([(c, why) for c, _, why, _ in checks])


def priority(p: C.Profile, met: list[Column], required: list[Column], optional: list[Column], negative: list[Column], text: Column) -> Column:
    r, o, n = T.any_of(required), T.any_of(optional), T.any_of(negative)
    every = met[0] if met else F.lit(False)
    none = F.lit(not (p.required or p.optional or p.negative)) | (text == "")
    return F.when(none, "needs_review").when(every, F.when(n, "medium").otherwise("high")).when(r | o, F.when(n & ~r, "low").otherwise("medium")).when(n, "low").otherwise("needs_review")


def candidate_status(prio: Column, metadata: Column) -> Column:
    good = prio.isin("high", "medium")
    return F.when(metadata == "blocked", "metadata_blocked").when(good & (metadata == "ok"), "ready_for_verification").when(good, "metadata_check").when(prio == "needs_review", "llm_review").otherwise("low_priority")


def _tagged(names: Column, kind: str) -> Column:
    return F.transform(names, lambda x: F.concat(F.lit(f"{kind}:"), x))


def triage(df: DataFrame, p: C.Profile) -> DataFrame:
    """Adds the 13 triage columns. Each text and each concept is one column, computed once."""
    groups = {"required": p.required, "optional": p.optional, "negative": p.negative}
    base = df.columns
    hits = {(g, i): f"_{g}_{i}" for g, own in groups.items() for i in range(len(own))}
    flags, status, whys = metadata_flags(df, p)
    # the text of every scope once, for all concepts that read it
    texts = {s: f"_text_{i}" for i, s in enumerate(sorted(C.scopes(c for own in groups.values() for c in own) | {"title_abstract"}))}
    df = df.withColumns({**{n: C.scoped(base, s) for s, n in texts.items()}, "_flags": flags, "_whys": whys, "_status": status})
    made = {hits[g, i]: C.matches(c, base, p.allow_regex, {s: F.col(n) for s, n in texts.items()}) for g, own in groups.items() for i, c in enumerate(own)}
    df = df.withColumns(made)
    # a concept counts as matched by its name
    alike = {(g, i): T.any_of(F.col(hits[g, j]) for j, o in enumerate(own) if o.name == c.name) for g, own in groups.items() for i, c in enumerate(own)}
    col = {g: [F.col(hits[g, i]) for i in range(len(own))] for g, own in groups.items()}
    score = F.lit(0.0)
    for g, own in groups.items():
        for i, c in enumerate(own):
            score = score + F.when(alike[g, i], float(c.weight if c.weight is not None else p.weights[g])).otherwise(0.0 - (g == "required"))
    score = score + F.when(T.doi(T.first_filled(_c(df, "crossref_doi"), _c(df, "doi"))) != "", 0.5).otherwise(0.0) + F.when(_c(df, "abstract") != "", 0.5).otherwise(0.0)
    none = F.array().cast("array<string>")
    names = {g: T.compact([(F.col(hits[g, i]), F.lit(c.name)) for i, c in enumerate(own)]) if own else none for g, own in groups.items()}
    missing = T.compact([(~alike["required", i], F.lit(c.name)) for i, c in enumerate(p.required)]) if p.required else none
    missing_count = T.any_of(~alike["required", i] for i in range(len(p.required)))
    tags = F.concat(*[_tagged(v, g) for g, v in names.items()], _tagged(F.col("_flags"), "metadata"))
    parts = [("matched required: ", names["required"]), ("missing required: ", missing), ("matched optional: ", names["optional"]), ("matched caller negative tags: ", names["negative"])]
    whole = [(F.size(v) > 0, F.concat(F.lit(label), F.array_join(v, ", "))) for label, v in parts]
    if not any(groups.values()):
        whole.append((F.lit(True), F.lit("no semantic profile supplied; left for LLM review")))
    whole.append((F.size("_flags") > 0, F.concat(F.lit("metadata flags: "), F.array_join("_flags", ", "))))
    reasons = F.array_join(T.compact(whole), "; ")
    every = [~missing_count] if p.required else []
    df = df.withColumns({
        "triage_priority": priority(p, every, col["required"], col["optional"], col["negative"], F.col(texts["title_abstract"])), "triage_score": F.format_string("%.1f", score),
        "semantic_tags": F.array_join(tags, "; "), "matched_required": F.array_join(names["required"], "; "), "matched_optional": F.array_join(names["optional"], "; "),
        "matched_negative": F.array_join(names["negative"], "; "), "missing_required": F.array_join(missing, "; "),
        "triage_reasons": F.when(reasons != "", reasons).otherwise("no explicit match"), "hard_filter_flags": F.array_join("_flags", "; "),
        "metadata_status": F.col("_status"), "metadata_reasons": F.array_join("_whys", "; "),
    })
    review = (F.col("triage_priority") == "needs_review") | T.any_of(col["negative"]) | (F.size("_flags") > 0)
    df = df.withColumns({"candidate_status": candidate_status(F.col("triage_priority"), F.col("metadata_status")), "llm_review_needed": F.when(review, "true").otherwise("false")})
    return df.drop(*made, *texts.values(), "_flags", "_whys", "_status")


def counts(df: DataFrame) -> DataFrame:
    """One row: rows, rows of each priority, and metadata-blocked rows of triaged candidates."""
    of = lambda v: F.count_if(F.col("triage_priority") == v).alias(f"triage_{v}")
    return df.agg(F.count("*").alias("triaged"), *map(of, RANK), F.count_if(F.col("metadata_status") == "blocked").alias("metadata_blocked"))


def rank(prio) -> Column:
    out = F
    for k, v in RANK.items():
        out = out.when(F.col(prio) == k, v)
    return out.otherwise(99)


def order(df: DataFrame) -> DataFrame:
    """Priority, score descending, title, input order. A global sort: for sinks only."""
    title = T.first_filled(_c(df, "crossref_title"), _c(df, "title"))
    return df.orderBy(rank("triage_priority"), F.desc(T.first_number(F.col("triage_score").cast("string"))), F.lower(title), "_ord")


def select_by_priority(df: DataFrame, priorities, include_blocked=False) -> DataFrame:
    if "triage_priority" not in df.columns:
        raise ValueError("triage_priority is missing")
    p = T.strip("triage_priority")
    out = df.where((p == "") | p.isin(*priorities))
    return out if include_blocked or "metadata_status" not in df.columns else out.where(T.strip("metadata_status") != "blocked")
