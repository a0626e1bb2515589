"""Counts and checks over stages: histograms, health, tiers, manifests, validation, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import status as S, text as T

BLANKS = ("", "Unknown", "Not verified", "Not available")


def histograms(df: DataFrame, columns, blank="<blank>") -> DataFrame:
    """(field, value, n) of several columns in one pass: unpivot, then one aggregation."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.when(T.strip(c) == "", blank).otherwise(T.strip(c)).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def top(df: DataFrame, column: str, limit=12) -> DataFrame:
    """The most frequent values; ties by first appearance."""
    return df.groupBy(T.strip(column).alias("value")).agg(F.count("*").alias("n"), F.min("_ord").alias("first")).orderBy(F.desc("n"), "first").limit(limit)


def health_columns(df: DataFrame) -> dict[str, Column]:
    """Ten aggregates: rows, rows with and without DOI, title, year and journal, and with a malformed DOI."""
    own = lambda *c: [x for x in c if x in df.columns] or [F.lit("")]
    doi = T.doi(T.first_filled(*own("crossref_doi", "doi")))
    filled = {"title": ("crossref_title", "title"), "year": ("crossref_year", "publication_year", "year"), "journal": ("crossref_container", "journal")}
    have = {"doi": doi != "", **{k: T.strip(T.first_filled(*own(*c))) != "" for k, c in filled.items()}}
    out = {"rows": F.count(F.lit(1)), "invalid_doi": F.count_if((doi != "") & ~doi.rlike(T.DOI))}
    for k, ok in have.items():
        out |= {f"with_{k}": F.count_if(ok), f"missing_{k}": F.count_if(~ok)}
    return out


def metadata_health(df: DataFrame) -> DataFrame:
    """One row of the ten counts."""
    return df.agg(*[c.alias(k) for k, c in health_columns(df).items()])


def trust_tiers(df: DataFrame) -> DataFrame:
    have = lambda c, *v: F.count_if(T.strip(c).isin(*v)) if c in df.columns else F.lit(0).cast("long")
    return df.agg(F.count("*").alias("discovered"), have("crossref_status", "verified", "title_recovered").alias("trusted"), have("metric_filter_status", "pass").alias("metric_pass"), have("queue_status", "queued").alias("queued"))


def run_status(stages: DataFrame) -> DataFrame:
    """Per run: partial if any stage record, old ones included, has a bad class."""
    bad = S.classify(F.col("status")).isin("auth", "budget_limited", "error", "network", "partial", "rate_limited")
    return stages.groupBy("run_id").agg(F.when(F.bool_or(bad), "partial").otherwise("completed").alias("run_status"), F.count("*").alias("n_stages"))


def latest(stages: DataFrame, *keys) -> DataFrame:
    return stages.groupBy(*keys).agg(F.max_by("status", "_ord").alias("status"), F.max("_ord").alias("_ord"))


def validate(df: DataFrame, required, optional_empty=(), stage: str = "") -> DataFrame:
    """(row, level, field, issue): rows count from 2, header findings have row 0; fields of optional_empty may be blank.

    A queue warns of rows that went on while access is pending, a preliminary table of rows without evidence."""
    missing = [c for c in required if c not in df.columns]
    header = df.sparkSession.createDataFrame([(0, "FAIL", c, "Required column missing") for c in missing], "row long, level string, field string, issue string")
    cell = lambda c: T.text(c) if c in df.columns else F.lit("")
    found = [(T.strip(c).isin(*BLANKS), "FAIL", c, "Required stage field is empty/Unknown") for c in required if c in df.columns and c not in optional_empty]
    if stage == "queue":
        found.append(((cell("access_status") == "pending") & (cell("queue_status") != "pending"), "WARN", "access_status", "Queue status advanced while access remains pending"))
    if stage == "preliminary":
        found.append((T.strip(cell("evidence_pointer")).isin(*BLANKS), "WARN", "evidence_pointer", "Task-specific values still require source evidence"))
    if not found:
        return header
    issues = T.compact([(holds, F.struct(F.lit(level).alias("level"), F.lit(c).alias("field"), F.lit(issue).alias("issue"))) for holds, level, c, issue in found])
    return header.unionAll(df.select((F.col("_ord") + 2).alias("row"), F.explode(issues).alias("p")).select("row", "p.level", "p.field", "p.issue"))


def verdict(issues: DataFrame) -> DataFrame:
    """One row: n_fail, n_warn and PASS or FAIL."""
    fails = F.count_if(F.col("level") == "FAIL")
    return issues.agg(fails.alias("n_fail"), F.count_if(F.col("level") == "WARN").alias("n_warn"), F.when(fails == 0, "PASS").otherwise("FAIL").alias("overall"))


def _record_key(df: DataFrame) -> Column:
    own = lambda *names: T.first_filled(*[n for n in names if n in df.columns])
    doi, year = T.doi(own("crossref_doi", "doi")), T.strip(own("crossref_year", "publication_year", "year"))
    return F.when(doi != "", F.concat(F.lit("doi:"), doi)).otherwise(F.concat(F.lit("row:"), F.col("_ord").cast("string"), F.lit(":title:"), F.lower(T.squeeze(own("crossref_title", "title"))), F.lit("|year:"), year))


def _sources(df: DataFrame) -> dict[str, tuple[Column, Column, Column]]:
    """(value, source, trust) of each field of the provenance."""
    cell = lambda *names: T.first_filled(*[n for n in names if n in df.columns]) if any(n in df.columns for n in names) else F.lit("")
    out = {}
    for name, verified, own, form in (("title", "crossref_title", ("title",), T.text), ("doi", "crossref_doi", ("doi",), T.doi), ("journal", "crossref_container", ("journal",), T.text), ("publication_year", "crossref_year", ("publication_year", "year"), T.text)):
        known = cell(verified) != ""
        out[name] = (F.when(known, form(cell(verified))).otherwise(form(cell(*own))), F.when(known, "crossref").otherwise(T.first_filled(cell("discovery_source"), F.lit("candidate"))), F.when(known, "bibliographic_verified").otherwise("candidate"))
    link = cell("best_oa_pdf_url", "best_oa_landing_url", "best_oa_url")
    out["abstract"] = (cell("abstract"), T.first_filled(cell("discovery_source"), F.lit("candidate")), F.lit("candidate"))
    out["oa_link"] = (link, F.when(link != "", "unpaywall").otherwise(""), F.when(link != "", "access_hint").otherwise(""))
    out["journal_metric"] = (cell("journal_metric"), cell("journal_metric_source"), F.when(cell("journal_metric_verified") == "true", "verified_local_metric").otherwise("not_verified"))
    out["publisher_access"] = (cell("access_status"), cell("publisher_probe_method"), cell("publisher_probe_confidence"))
    return out


def provenance(df: DataFrame, fields=("title", "doi", "journal", "publication_year", "abstract", "oa_link", "journal_metric", "publisher_access")) -> DataFrame:
    """Long form (record_key, field, value, source, trust) of rows with _ord: every field of every row, blank ones too."""
    known = _sources(df)
    rows = [F.struct(F.lit(f).alias("field"), *[c.alias(n) for n, c in zip(("value", "source", "trust"), known[f])]) for f in fields]
    return df.select(_record_key(df).alias("record_key"), F.explode(F.array(*rows)).alias("p")).select("record_key", "p.*")


def provenance_records(df: DataFrame) -> DataFrame:
    """(_ord, record): one JSON object a row, with its key, title and the provenance of all fields."""
    cells = F.struct(*[F.struct(*[c.alias(n) for n, c in zip(("value", "source", "trust"), x)]).alias(f) for f, x in _sources(df).items()])
    title = T.first_filled(*[c for c in ("crossref_title", "title") if c in df.columns])
    return df.select("_ord", F.to_json(F.struct(_record_key(df).alias("record_key"), title.alias("title"), cells.alias("fields"))).alias("record"))
