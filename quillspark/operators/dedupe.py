"""Keyed dedupe with an order-aware record merge: one shuffle on the key, linear in the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

# Merged list columns and alternate value columns by source column.
MERGED = {"discovery_source": "merged_discovery_sources", "discovery_provider": "merged_discovery_providers", "discovery_query": "merged_discovery_queries", "source_trace": "merged_source_traces", "source_file": "merged_source_files"}
ALTERNATE = {"title": "alternate_titles", "abstract": "alternate_abstracts", "journal": "alternate_journals", "publication_year": "alternate_years", "landing_page_url": "alternate_landing_page_urls", "url": "alternate_urls", "pdf_url": "alternate_pdf_urls", "best_full_text_url": "alternate_full_text_urls", "authors": "alternate_authors"}


# Reasons of a merge.
REASONS = {
    "doi": "exact DOI match",
    "both": "normalized title with matching year and journal context",
    "one": "normalized title with partial year/journal context",
    "row": "unique row fallback",
}


def key_columns(df: DataFrame, doi_field="doi", title_field="title") -> DataFrame:
    """Adds key_kind and key_value: DOI, else title with year or journal; rows with neither never merge and are keyed by _ord."""
    have = lambda *names: [n for n in names if n in df.columns] or [F.lit("")]
    field = lambda c: T.text(c) if c in df.columns else F.lit("")
    year = T.strip(T.first_filled(*have("crossref_year", "publication_year", "year")))
    journal = T.title(T.first_filled(*have("crossref_container", "journal")))
    df = df.withColumns({"_doi": T.doi(field(doi_field)), "_title": T.title(field(title_field)), "_year": year, "_journal": journal})
    doi, context = F.col("_doi") != "", (F.col("_title") != "") & ((F.col("_year") != "") | (F.col("_journal") != ""))
    both = (F.col("_year") != "") & (F.col("_journal") != "")
    choose = lambda a, b, c: F.when(doi, a).when(context, b).otherwise(c)
    why = {k: F.lit(v) for k, v in REASONS.items()}
    return df.withColumns({
        "key_kind": choose(F.lit("doi"), F.lit("title_context"), F.lit("row")),
        "key_value": choose(F.col("_doi"), F.concat(F.col("_title"), F.lit("|year="), F.col("_year"), F.lit("|journal="), F.col("_journal")), F.col("_ord").cast("string")),
        "dedupe_confidence": choose(F.lit("high"), F.when(both, "high").otherwise("medium"), F.lit("unique")),
        "dedupe_reason": choose(why["doi"], F.when(both, why["both"]).otherwise(why["one"]), why["row"]),
    }).drop("_doi", "_title", "_year", "_journal")


def quality(stripped: dict[str, F.Column]) -> "F.Column":
    """One point for each filled cell, three for an abstract or summary of over 200 characters; of the trimmed cells by field."""
    score = F.lit(0)
    for c, x in stripped.items():
        score = score + F.when(x != "", 1).otherwise(0)
        if c.lower() in ("abstract", "summary"):
            score = score + F.when(F.length(x) > 200, 3).otherwise(0)
    return score


def dedupe(df: DataFrame, doi_field="doi", title_field="title") -> DataFrame:
    """One row per key: best row (most filled, first of equals), its blanks filled by the first filled value, merged and alternate lists.

    The best row and the fills are aggregates with map-side combine. Each list is made from the first place of each
    different value of a key, so copies of a value never meet in one task, and is a left join of its own on the key: Spark
    leaves out those whose columns are not read. Trimmed cells are computed once."""
    made = {*MERGED.values(), *ALTERNATE.values(), "duplicate_count", "dedupe_key", "dedupe_confidence", "dedupe_reason"}
    df = df.drop(*made)  # of an earlier run
    fields = [c for c in df.columns if c != "_ord"]
    own = {c: f"_strip_{c}" for c in fields}
    rows = key_columns(df, doi_field, title_field).withColumns({n: T.strip(c) for c, n in own.items()})
    key = ["key_kind", "key_value"]
    rank = F.struct(-quality({c: F.col(n) for c, n in own.items()}), F.col("_ord"))
    fills = [F.min_by(n, F.when(F.col(n) != "", F.col("_ord"))).alias(f"_fill_{c}") for c, n in own.items()]
    best = F.min_by(F.struct(*[T.text(c).alias(c) for c in fields], *[(F.col(n) != "").alias(n) for n in own.values()]), rank).alias("_best")
    heads = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_ord").alias("_ord"), F.first("dedupe_confidence").alias("dedupe_confidence"), F.first("dedupe_reason").alias("dedupe_reason"), best, *fills)

    value = {c: F.when(F.col(f"_best.{n}"), F.col(f"_best.{c}")).otherwise(T.text(f"_fill_{c}")) for c, n in own.items()}
    for c, n in own.items():
        if c in MERGED or c in ALTERNATE:
            first = rows.where(F.col(n) != "").groupBy(*key, F.col(n).alias("v")).agg(F.min("_ord").alias("o"))
            heads = heads.join(first.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias(f"_list_{c}")), key, "left")

    def values(c):
        return F.coalesce(F.col(f"_list_{c}.v"), F.array().cast("array<string>"))

    cols = ["_ord", *[value[c].alias(c) for c in fields], F.col("_n").cast("string").alias("duplicate_count"), F.concat("key_kind", F.lit(":"), "key_value").alias("dedupe_key"), "dedupe_confidence", "dedupe_reason"]
    cols += [(F.array_join(values(c), "; ") if c in fields else F.lit("")).alias(name) for c, name in MERGED.items()]
    cols += [(F.array_join(F.array_remove(values(c), T.strip(value[c])), " || ") if c in fields else F.lit("")).alias(name) for c, name in ALTERNATE.items()]
    return heads.select(*cols)
