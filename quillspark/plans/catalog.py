"""Queries over the supplied tables, one per operator, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..functions import concepts as C, status as S, text as T
from ..operators import dedupe as D, metrics as M, planning as N, probe as P, queue as Q, report as R, summary as U, tables as B, triage as G, verify as V
from ..sources import pages as A, payloads as J
from ..sources.candidates import BRIDGE, candidates, web_leads
from ..sources.shared import folder
from ..streaming import calls as L
from . import views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# DuckDB pieces shared by the SQL below.
_CAND = f"WITH c AS ({BRIDGE} FROM documents)"
_DOI = "regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:)', ''), '[.,;)\\]]+$', '')"
_TITLE = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
_STATUSES = ["verified", "not_found", "skipped_budget", "skipped_missing_email", "skipped_rate_limit_cooldown", "partial_rate_limited", "http_401", "ssl_error", "partial_auth", "partial_rows", "http_500", "", "odd one", "skipped_circuit_breaker"]
_STATUS_SQL = "[" + ", ".join(f"'{s}'" for s in _STATUSES) + f"][1 + event_id % {len(_STATUSES)}]"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _status() -> F.Column:
    return F.element_at(F.array(*map(F.lit, _STATUSES)), (1 + F.col("event_id") % len(_STATUSES)).cast("int"))


@query(f"{_CAND} SELECT _ord, {_DOI} AS doi FROM c")
def doi_normalize(spark, sf):
    return candidates(spark, sf).select("_ord", T.doi("doi").alias("doi"))


@query(f"{_CAND} SELECT _ord, {_TITLE} AS title_key, trim(regexp_replace(regexp_replace(regexp_replace(lower(journal), '[^a-z0-9]+', ' ', 'g'), '\\b(the|journal|of)\\b', ' ', 'g'), ' +', ' ', 'g')) AS journal_key, replace(lower(article_type), '_', '-') AS type_key FROM c")
def title_normalize_keys(spark, sf):
    return candidates(spark, sf).select("_ord", T.title("title").alias("title_key"), T.journal("journal").alias("journal_key"), T.article_type("article_type").alias("type_key"))


_CONTEXT = "'title_context:' || t || '|year=' || publication_year || '|journal=' || j"
_CLEAN = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def _kept(column: str, chosen: str) -> str:
    """Distinct filled values of the group in order, without the chosen one."""
    return f"array_to_string(list_filter(l_{column}, lambda x, i: list_position(l_{column}, x) = i AND x <> {chosen}), ' || ')"


_DEDUPE = f"""{_CAND},
k AS (SELECT *, {_DOI} AS d, {_TITLE} AS t, trim(regexp_replace(lower(journal), '[^a-z0-9]+', ' ', 'g')) AS j FROM c),
g AS (SELECT * REPLACE ({_CLEAN.format('title')} AS title), title AS raw, CASE WHEN d <> '' THEN 'doi:' || d WHEN t = '' THEN 'row:' || _ord ELSE {_CONTEXT} END AS key,
     ({_CLEAN.format('title')} <> '')::INT + (trim(doi) <> '')::INT + 1 + 1 + ({_CLEAN.format('abstract')} <> '')::INT + (trim(article_type) <> '')::INT + (trim(discovery_source) <> '')::INT + CASE WHEN length({_CLEAN.format('abstract')}) > 200 THEN 3 ELSE 0 END AS q FROM k),
u AS (SELECT key, min(_ord) AS _ord, count(*) AS n, {", ".join(f"arg_min({c}, (-q, _ord)) AS {c}" for c in ("raw", "title", "doi", "publication_year", "journal", "abstract"))},
     coalesce(nullif(arg_min(article_type, (-q, _ord)), ''), arg_min(article_type, _ord) FILTER (article_type <> ''), '') AS article_type,
     {", ".join(f"coalesce(list({c} ORDER BY _ord) FILTER ({c} <> ''), []) AS l_{c}" for c in ("title", "publication_year", "journal", "discovery_source"))} FROM g GROUP BY key)"""


@query(f"""{_DEDUPE}
SELECT _ord, key AS dedupe_key, CAST(n AS VARCHAR) AS duplicate_count, raw AS best_title, article_type, CASE WHEN starts_with(key, 'row:') THEN 'unique' ELSE 'high' END AS dedupe_confidence,
       CASE WHEN starts_with(key, 'row:') THEN 'unique row fallback' WHEN starts_with(key, 'doi:') THEN 'exact DOI match' ELSE 'normalized title with matching year and journal context' END AS dedupe_reason,
       array_to_string(list_filter(l_discovery_source, lambda x, i: list_position(l_discovery_source, x) = i), '; ') AS merged_discovery_sources,
       {_kept("title", "title")} AS alternate_titles, {_kept("publication_year", "publication_year")} AS alternate_years, {_kept("journal", "journal")} AS alternate_journals, '' AS merged_source_files FROM u""")
def dedupe_merge(spark, sf):
    out = D.dedupe(candidates(spark, sf))
    return out.select("_ord", "dedupe_key", "duplicate_count", F.col("title").alias("best_title"), "article_type", "dedupe_confidence", "dedupe_reason", "merged_discovery_sources", "alternate_titles", "alternate_years", "alternate_journals", "merged_source_files")


@query("SELECT 'documents' AS source_file, CAST(doc_id AS VARCHAR) AS doc_id, text, lang, '' AS item_id FROM documents UNION ALL SELECT 'benchmark', '', text, '', CAST(item_id AS VARCHAR) FROM benchmark")
def union_by_name(spark, sf):
    return B.union_by_name({"documents": _t(spark, sf, "documents").select("doc_id", "text", "lang"), "benchmark": _t(spark, sf, "benchmark").select("item_id", "text")})


@query(f"{_CAND} SELECT _ord, publication_year FROM c WHERE CAST(publication_year AS INT) BETWEEN 2020 AND 2024 AND replace(article_type, '_', '-') <> 'review'")
def year_and_type_filter(spark, sf):
    return B.year_filter(candidates(spark, sf), "publication_year", 2020, 2024).where(T.article_type("article_type") != "review").select("_ord", "publication_year")


_PROFILE = C.Profile(required=(C.parse_spec("core=the|und"),), optional=(C.parse_spec("and"), C.parse_spec("de")), negative=(C.parse_spec("junk=idiot|scum"),), year_from=2019, exclude_article_types=("data-paper",), require_doi=True)
#: ASCII terms standing as whole words; the corpus has no negator but "no" and "not".
_W = "[^\\p{L}\\p{N}_]"


def _has(term: str) -> str:
    """A hit that no negator with at most six words between precedes, for texts as RE2 sees them."""
    return f"regexp_matches(' ' || x || ' ', '(?i){_W}{term}{_W}')"


@query(f"SELECT doc_id, {_has('pathetic').replace('x ||', 'text ||')} AS hit FROM documents")
def concept_literal_match(spark, sf):
    c = C.Concept("bad", patterns=("pathetic",), scope="abstract")
    df = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("abstract"))
    return df.select("doc_id", C.matches(c, df.columns).alias("hit"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT doc_id, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'idiot') AS a, list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the') AS b FROM t)
SELECT doc_id, len(list_filter(a, lambda i: len(list_filter(b, lambda j: abs(i - j) <= 4)) > 0)) > 0 AS hit FROM p""")
def concept_near(spark, sf):
    c = C.Concept("near", "near", ("idiot", "the"), window=4, scope="abstract")
    df = _t(spark, sf, "documents").select("doc_id", F.col("text").alias("abstract"))
    return df.select("doc_id", C.matches(c, df.columns).alias("hit"))


_NEGATED = "(?i)(^|[^\\p{L}\\p{M}\\p{N}_])(" + "|".join(C.NEGATORS) + ")([^\\p{L}\\p{M}\\p{N}_]+[\\p{L}\\p{M}\\p{N}_]+){0,6}[^\\p{L}\\p{M}\\p{N}_]*$"
_INK = "'^[\\p{L}\\p{M}\\p{N}_]$'"


def _found(term: str) -> str:
    """Does the term stand in x as a whole word somewhere without a negator before it (n_term: lengths of what stands between its places)."""
    n, size = f"n_{term}", len(term)
    places = f"list_transform(range(1, len({n})), lambda i: CAST(list_sum({n}[1:i]) AS BIGINT) + (i - 1) * {size} + 1)"
    edges = f"NOT regexp_matches(CASE WHEN p > 1 THEN substr(x, p - 1, 1) ELSE '' END, {_INK}) AND NOT regexp_matches(substr(x, p + {size}, 1), {_INK})"
    return f"len(list_filter({places}, lambda p: {edges} AND NOT regexp_matches(substr(x, greatest(1, p - 80), least(80, p - 1)), '{_NEGATED}'))) > 0"


_TERMS = ("the", "und", "and", "de", "idiot", "scum")
_TRIAGED = f"""{_DEDUPE},
v AS (SELECT *, trim(regexp_replace(regexp_replace(raw || ' ' || abstract, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS x, {_DOI} AS dd, CAST(publication_year AS INT) AS y, replace(lower(trim(article_type)), '_', '-') AS a FROM u),
w AS (SELECT *, {", ".join(f"list_transform(string_split(lower(x), '{t}'), lambda g: length(g)) AS n_{t}" for t in _TERMS)} FROM v),
h AS (SELECT *, {_found("the")} OR {_found("und")} AS r, {_found("and")} AS o1, {_found("de")} AS o2, {_found("idiot")} OR {_found("scum")} AS ng FROM w),
f AS (SELECT *, list_filter([CASE WHEN title = '' THEN 'missing_title' END, CASE WHEN dd = '' THEN 'missing_doi' END, CASE WHEN y < 2019 THEN 'year_before_2019' END, CASE WHEN a = 'data-paper' THEN 'article_type_data-paper' END], lambda z: z IS NOT NULL) AS flags,
     CASE WHEN x = '' THEN 'needs_review' WHEN r THEN CASE WHEN ng THEN 'medium' ELSE 'high' END WHEN o1 OR o2 THEN CASE WHEN ng THEN 'low' ELSE 'medium' END WHEN ng THEN 'low' ELSE 'needs_review' END AS triage_priority,
     CASE WHEN r THEN 3.0 ELSE -1.0 END + o1::INT + o2::INT - 2 * ng::INT + CASE WHEN dd <> '' THEN 0.5 ELSE 0 END + CASE WHEN abstract <> '' THEN 0.5 ELSE 0 END AS score FROM h),
m AS (SELECT *, CASE WHEN dd = '' OR y < 2019 OR a = 'data-paper' THEN 'blocked' WHEN len(flags) > 0 THEN 'check' ELSE 'ok' END AS metadata_status,
     list_concat(CASE WHEN r THEN ['required:core'] ELSE [] END, CASE WHEN o1 THEN ['optional:and'] ELSE [] END, CASE WHEN o2 THEN ['optional:de'] ELSE [] END, CASE WHEN ng THEN ['negative:junk'] ELSE [] END, list_transform(flags, lambda z: 'metadata:' || z)) AS tags,
     array_to_string(list_filter([CASE WHEN o1 THEN 'and' END, CASE WHEN o2 THEN 'de' END], lambda z: z IS NOT NULL), ', ') AS opts FROM f)"""


#: Columns of the ranked rows: no others are computed, written and dealt out.
_RANKED = ("title", "triage_priority", "triage_score", "metadata_status", "semantic_tags", "hard_filter_flags", "candidate_status", "triage_reasons", "llm_review_needed")


@query(f"""{_TRIAGED}
SELECT _ord, raw AS title, triage_priority, printf('%.1f', CAST(score AS DOUBLE)) AS triage_score, metadata_status, array_to_string(tags, '; ') AS semantic_tags, array_to_string(flags, '; ') AS hard_filter_flags,
       CASE WHEN metadata_status = 'blocked' THEN 'metadata_blocked' WHEN triage_priority IN ('high', 'medium') THEN CASE WHEN metadata_status = 'ok' THEN 'ready_for_verification' ELSE 'metadata_check' END WHEN triage_priority = 'needs_review' THEN 'llm_review' ELSE 'low_priority' END AS candidate_status,
       concat_ws('; ', CASE WHEN r THEN 'matched required: core' ELSE 'missing required: core' END, CASE WHEN opts <> '' THEN 'matched optional: ' || opts END, CASE WHEN ng THEN 'matched caller negative tags: junk' END, CASE WHEN len(flags) > 0 THEN 'metadata flags: ' || array_to_string(flags, ', ') END) AS triage_reasons,
       CASE WHEN triage_priority = 'needs_review' OR ng OR len(flags) > 0 THEN 'true' ELSE 'false' END AS llm_review_needed,
       row_number() OVER (ORDER BY CASE triage_priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'needs_review' THEN 2 ELSE 3 END, score DESC, encode(lower(raw)), _ord) AS place FROM m""")
def triage_score_rank(spark, sf):
    """Flagship: deduplicate, tag, score and rank candidates; ranks come from a range sort, not from one task."""
    rows = G.triage(D.dedupe(candidates(spark, sf)), _PROFILE).withColumn("_first", F.col("_ord"))
    rows = B.with_ord(rows.select("_first", *_RANKED), G.rank("triage_priority"), F.desc(T.first_number("triage_score")), F.lower("title"), "_first")
    return rows.select(F.col("_first").alias("_ord"), *_RANKED, (F.col("_ord") + 1).alias("place"))


_META = f"""{_CAND},
m AS (SELECT *, {_DOI} AS d, CAST(publication_year AS INT) AS y, replace(lower(CASE WHEN _ord % 5 = 0 THEN 'Data_Paper' ELSE article_type END), '_', '-') AS a FROM c),
s AS (SELECT *, CASE WHEN y < 2019 OR a = 'data-paper' OR d = '' THEN 'blocked' WHEN trim(title) = '' THEN 'check' ELSE 'ok' END AS metadata_status, CASE WHEN _ord % 11 = 0 THEN 'lookup_failed' WHEN _ord % 4 = 0 THEN 'verified' ELSE '' END AS crossref_status,
     CASE WHEN _ord % 13 = 0 THEN 'YEAR_MISMATCH: input=1 vs crossref=2' ELSE '' END AS crossref_mismatches, CASE WHEN _ord % 6 = 0 THEN 'Include' WHEN _ord % 6 = 1 THEN 'Backup' ELSE '' END AS decision,
     CASE WHEN _ord % 3 = 0 THEN 'high' WHEN _ord % 3 = 1 THEN 'low' ELSE '' END AS triage_priority, CAST(_ord % 8 AS VARCHAR) AS triage_score FROM m)"""


def _triaged(spark, sf) -> DataFrame:
    k = lambda n: F.col("_ord") % n
    df = candidates(spark, sf).withColumn("crossref_type", F.when(k(5) == 0, "Data_Paper").otherwise(""))
    flags, status, whys = G.metadata_flags(df, _PROFILE)
    return df.withColumns({
        "hard_filter_flags": F.array_join(flags, "; "), "metadata_status": status, "metadata_reasons": F.array_join(whys, "; "),
        "triage_priority": F.when(k(3) == 0, "high").when(k(3) == 1, "low").otherwise(""), "triage_score": k(8).cast("string"), "screening_decision": F.when(k(6) == 0, "Include").otherwise(""), "include_status": F.when(k(6) == 1, "Backup").otherwise(""),
        "crossref_status": F.when(k(11) == 0, "lookup_failed").when(k(4) == 0, "verified").otherwise(""), "crossref_mismatches": F.when(k(13) == 0, "YEAR_MISMATCH: input=1 vs crossref=2").otherwise(""),
    })


@query(f"""{_META} SELECT _ord, metadata_status, concat_ws('; ', CASE WHEN trim(title) = '' THEN 'missing_title' END, CASE WHEN d = '' THEN 'missing_doi' END,
CASE WHEN y < 2019 THEN 'year_before_2019' END, CASE WHEN a = 'data-paper' THEN 'article_type_data-paper' END) AS hard_filter_flags, concat_ws('; ', CASE WHEN trim(title) = '' THEN 'title is missing' END, CASE WHEN d = '' THEN 'DOI is missing' END,
CASE WHEN y < 2019 THEN 'publication year ' || y || ' is before 2019' END, CASE WHEN a = 'data-paper' THEN 'article type ''data-paper'' is in caller-supplied excluded types' END) AS metadata_reasons FROM s""")
def metadata_hard_filter(spark, sf):
    return _triaged(spark, sf).select("_ord", "metadata_status", "hard_filter_flags", "metadata_reasons")


@query(f"{_META} SELECT _ord, triage_priority FROM s WHERE triage_priority IN ('', 'high') AND metadata_status <> 'blocked'")
def priority_selection(spark, sf):
    return G.select_by_priority(_triaged(spark, sf), ["high"]).select("_ord", "triage_priority")


_GATED = "CASE WHEN metadata_status = 'blocked' THEN 'metadata_blocked' WHEN crossref_mismatches <> '' OR crossref_status = 'lookup_failed' THEN 'crossref_blocked' WHEN CASE WHEN triage_priority <> '' THEN triage_priority <> 'high' ELSE decision NOT IN ('', 'Include') END THEN 'filtered' WHEN d = '' THEN 'missing_doi' ELSE '' END"
_GATES = {"priorities": ("high", "medium"), "decisions": ("Include",)}


@query(f"""{_META} SELECT _ord, d AS doi, publication_year, 'https://doi.org/' || d AS doi_url, 'https://doi.org/' || d AS publisher_url, title, journal, 'pending' AS queue_status, 'unknown' AS pdf_status, crossref_status, triage_score,
'screenshots/' || trim(regexp_replace(d, '[^a-z0-9]+', '_', 'g'), '_') AS screenshot_dir, decision AS screening_decision, 'publisher_visible_text; abstract; methods_or_evidence_section; results_or_key_claim_section; evidence_pointer' AS page_required_fields,
CASE triage_priority WHEN 'high' THEN '1' WHEN 'low' THEN '4' ELSE CASE WHEN decision = 'Include' THEN '1' WHEN decision = 'Backup' THEN '2' WHEN _ord % 8 >= 6 THEN '1' WHEN _ord % 8 >= 3 THEN '2' ELSE '3' END END AS extraction_priority,
discovery_source, triage_priority, metadata_status, crossref_mismatches, concat_ws('; ', CASE WHEN trim(title) = '' THEN 'missing_title' END, CASE WHEN d = '' THEN 'missing_doi' END, CASE WHEN y < 2019 THEN 'year_before_2019' END, CASE WHEN a = 'data-paper' THEN 'article_type_data-paper' END) AS hard_filter_flags, 'pending' AS access_status, 'pending' AS html_status, 'unknown' AS si_status, 'publisher_page_or_better' AS evidence_target_grade, '{Q.NEXT_ACTION}' AS next_action, '{Q.NOTES}' AS notes,
'' AS candidate_status, '' AS semantic_tags, '' AS triage_reasons, '' AS crossref_verified, '' AS relevance_score, '' AS journal_metric, '' AS metric_filter_status, '' AS is_oa, '' AS oa_status, '' AS best_oa_url, '' AS unpaywall_status, '' AS resolved_url, '' AS pdf_url, '' AS si_url, 'publisher_landing_page; abstract_or_summary; article_sections_available; task_requested_fields; evidence_pointer; pdf_url; si_url' AS fields_needed
FROM s WHERE {_GATED} = ''""")
def queue_build(spark, sf):
    out = Q.build(_triaged(spark, sf), **_GATES)
    return out.select("_ord", "doi", "publication_year", "doi_url", "publisher_url", "title", "journal", "queue_status", "pdf_status", "crossref_status", "triage_score", "screenshot_dir", "screening_decision", "page_required_fields", "extraction_priority", "discovery_source", "triage_priority", "metadata_status", "crossref_mismatches", "hard_filter_flags", "access_status", "html_status", "si_status", "evidence_target_grade", "next_action", "notes", "candidate_status", "semantic_tags", "triage_reasons", "crossref_verified", "relevance_score", "journal_metric", "metric_filter_status", "is_oa", "oa_status", "best_oa_url", "unpaywall_status", "resolved_url", "pdf_url", "si_url", "fields_needed")


@query(f"{_META} SELECT {_GATED} AS reason, count(*) AS n FROM s GROUP BY 1")
def queue_skip_reasons(spark, sf):
    df = _triaged(spark, sf)
    return df.groupBy(Q.skip_reason(df, **_GATES).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{_META} SELECT count(*) FILTER ({_GATED} = '') AS queued, count(*) FILTER ({_GATED} = 'filtered') AS skipped_filter, count(*) FILTER ({_GATED} IN ('metadata_blocked', 'crossref_blocked')) AS skipped_metadata_blocked, count(*) FILTER ({_GATED} = 'missing_doi') AS skipped_missing_doi FROM s")
def queue_counts(spark, sf):
    return Q.counts(_triaged(spark, sf), **_GATES)


@query(f"""{_META}, q AS (SELECT _ord, title, triage_score, CASE triage_priority WHEN 'high' THEN 1 ELSE CASE WHEN decision = 'Include' THEN 1 WHEN _ord % 8 >= 6 THEN 1 WHEN _ord % 8 >= 3 THEN 2 ELSE 3 END END AS e FROM s WHERE {_GATED} = '')
SELECT _ord, row_number() OVER (ORDER BY e, CAST(triage_score AS DOUBLE) DESC, encode(lower(title)), _ord) AS place FROM q""")
def queue_order(spark, sf):
    """Places of the queue's rows: the sink's order, as a number."""
    rows = Q.build(_triaged(spark, sf), **_GATES).withColumnRenamed("_ord", "_first")
    rows = B.with_ord(rows.select("_first", "title", "triage_score", "extraction_priority"), "extraction_priority", F.desc(T.first_number("triage_score")), F.lower("title"), "_first")
    return rows.select(F.col("_first").alias("_ord"), (F.col("_ord") + 1).alias("place"))


@query(f"""{_CAND} SELECT 'journal' AS field, CASE WHEN trim(journal) = '' THEN '<blank>' ELSE trim(journal) END AS value, count(*) AS n FROM c GROUP BY 2
UNION ALL SELECT 'article_type', CASE WHEN trim(article_type) = '' THEN '<blank>' ELSE trim(article_type) END, count(*) FROM c GROUP BY 2""")
def value_histograms(spark, sf):
    return R.histograms(candidates(spark, sf), ["journal", "article_type"])


@query(f"{_CAND} SELECT discovery_source AS value, count(*) AS n, min(_ord) AS first FROM c GROUP BY 1 ORDER BY n DESC, first LIMIT 5")
def top_values(spark, sf):
    return R.top(candidates(spark, sf), "discovery_source", 5)


@query(f"""{_CAND}, d AS (SELECT *, {_DOI} AS dd FROM c) SELECT count(*) AS "rows", count(*) FILTER (dd <> '' AND NOT regexp_matches(dd, '^10\\.\\d{{4,9}}/\\S+$')) AS invalid_doi, count(*) FILTER (dd <> '') AS with_doi, count(*) FILTER (dd = '') AS missing_doi,
count(*) FILTER ({_CLEAN.format('title')} <> '') AS with_title, count(*) FILTER ({_CLEAN.format('title')} = '') AS missing_title, count(*) FILTER (publication_year <> '') AS with_year, count(*) FILTER (publication_year = '') AS missing_year,
count(*) FILTER (journal <> '') AS with_journal, count(*) FILTER (journal = '') AS missing_journal FROM d""")
def metadata_health(spark, sf):
    return R.metadata_health(candidates(spark, sf))


@query(f"{_META} SELECT count(*) AS discovered, count(*) FILTER (crossref_status = 'verified') AS trusted, count(*) FILTER (_ord % 7 = 0) AS metric_pass, count(*) FILTER (_ord % 2 = 0) AS queued FROM s")
def trust_tiers(spark, sf):
    k = lambda n: F.col("_ord") % n == 0
    return R.trust_tiers(_triaged(spark, sf).withColumns({"queue_status": F.when(k(2), "queued").otherwise(""), "metric_filter_status": F.when(k(7), "pass").otherwise("fail")}))


@query(f"""{_META} SELECT CAST(_ord AS VARCHAR) AS _ord, CASE WHEN length(title) > 30 THEN rtrim(substr(title, 1, 29)) || '...' ELSE title END AS title, triage_score FROM s
WHERE triage_priority = 'high' ORDER BY CAST(triage_score AS DOUBLE) DESC, s._ord LIMIT 10 OFFSET 10""")
def adhoc_page(spark, sf):
    return B.page(_triaged(spark, sf), {"triage_priority": ["high"]}, "triage_score", True, 2, 10, ["_ord", "title", "triage_score"], 30)


# supplier is the metric dimension, part the rows to annotate
_DIM = "WITH m AS (SELECT s_suppkey AS _ord, 'The Journal of ' || s_name AS journal, CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(round(abs(s_acctbal) / 1000, 3) AS VARCHAR) END AS impact_factor, '2023' AS metric_year, lpad(CAST(s_suppkey % 90 AS VARCHAR), 8, '0') AS issn FROM supplier)"


def _dimension(spark, sf) -> DataFrame:
    s = _t(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("_ord"), F.concat(F.lit("The Journal of "), "s_name").alias("journal"), F.lit("").alias("aliases"), F.lpad((F.col("s_suppkey") % 90).cast("string"), 8, "0").alias("issn"), F.when(F.col("s_suppkey") % 7 == 0, "n/a").otherwise(F.regexp_replace(F.round(F.abs("s_acctbal") / 1000, 3).cast("string"), "E.*", "")).alias("impact_factor"), F.lit("2023").alias("metric_year"))


def _venues(spark, sf) -> DataFrame:
    """Rows that name their journal in one of several fields, some with an ISSN in one of two."""
    k, eight = lambda n: F.col("p_partkey") % n, F.lpad((F.col("p_partkey") % 97).cast("string"), 8, "0")
    name = F.concat(F.lit("journal of the supplier#"), F.lpad(k(150).cast("string"), 9, "0"))
    issn = F.concat(F.substring(eight, 1, 4), F.lit("-"), F.substring(eight, 5, 4))
    return _t(spark, sf, "part").select(
        F.col("p_partkey").alias("_ord"), F.when(k(3) == 0, "").otherwise(name).alias("journal"), F.when(k(3) == 0, name).otherwise("").alias("container"),
        F.when(k(5) == 0, F.concat(F.lit("none; "), issn)).otherwise("").alias("issn"), F.when(k(5) == 1, issn).otherwise("").alias("journal_issn"),
    )


_METRIC = f"""{_DIM}, i AS (SELECT issn, max(_ord) AS _ord FROM m GROUP BY 1),
v AS (SELECT p_partkey AS _ord, p_partkey % 150 AS n, CASE WHEN p_partkey % 5 IN (0, 1) THEN lpad(CAST(p_partkey % 97 AS VARCHAR), 8, '0') END AS issn FROM part),
j AS (SELECT v._ord, coalesce(a.impact_factor, b.impact_factor) AS f FROM v LEFT JOIN i USING (issn) LEFT JOIN m a ON a._ord = i._ord LEFT JOIN m b ON b._ord = v.n AND i._ord IS NULL),
z AS (SELECT *, TRY_CAST(f AS DOUBLE) AS x FROM j),
s AS (SELECT _ord, coalesce(f, 'Not verified') AS journal_metric, CASE WHEN f IS NULL OR x IS NULL THEN 'unverified' WHEN x > 3 THEN 'pass' ELSE 'fail' END AS metric_filter_status,
     CASE WHEN f IS NULL THEN 'No matching verified metric record' WHEN x IS NULL THEN 'Metric value is not numeric' ELSE 'Impact factor ' || format('{{:g}}', x) || CASE WHEN x > 3 THEN ' > 3' ELSE ' <= 3' END END AS metric_filter_reason, f IS NOT NULL AS known FROM z)"""


@query(f"{_METRIC} SELECT _ord, journal_metric, metric_filter_status, metric_filter_reason, CASE WHEN known THEN 'true' ELSE 'false' END AS journal_metric_verified FROM s")
def metric_lookup_join(spark, sf):
    return M.annotate(_venues(spark, sf), _dimension(spark, sf), 3.0).select("_ord", "journal_metric", "metric_filter_status", "metric_filter_reason", "journal_metric_verified")


@query(f"{_METRIC} SELECT CASE WHEN metric_filter_status = 'pass' THEN 'pass' ELSE 'backup' END AS part, _ord FROM s")
def metric_split(spark, sf):
    a, b = M.split(M.annotate(_venues(spark, sf), _dimension(spark, sf), 3.0))
    return a.select(F.lit("pass").alias("part"), "_ord").unionAll(b.select(F.lit("backup").alias("part"), "_ord"))


_KEYED = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), '\\b(the|journal|of)\\b', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"""WITH m AS (SELECT s_suppkey AS k, s_suppkey + 1 AS "row", CASE s_suppkey % 10 WHEN 0 THEN '' WHEN 1 THEN 'The Journal of S' || (s_suppkey // 20) WHEN 2 THEN 'Journal S' || (s_suppkey // 20) ELSE 'Title ' || s_suppkey END AS journal,
     CASE WHEN s_suppkey % 10 = 5 THEN ['Shared', 'A' || s_suppkey] ELSE [] END AS aliases, lpad(CAST(s_suppkey % 90 AS VARCHAR), 8, '0') AS issn, CASE WHEN s_suppkey % 7 = 0 THEN 'n/a' WHEN s_suppkey % 7 = 1 THEN '' ELSE '1.5' END AS f, s_suppkey % 3 = 0 AS nosource, s_suppkey % 4 = 0 AS unsure FROM supplier),
n AS (SELECT * FROM m WHERE journal <> ''),
o AS (SELECT 'journal' AS field, "row", journal, 0 AS i, {_KEYED.format("journal")} AS key FROM n UNION ALL SELECT 'journal', "row", journal, i, {_KEYED.format("aliases[i]")} FROM (SELECT *, unnest(range(1, len(aliases) + 1)) AS i FROM n) UNION ALL SELECT 'issn', "row", journal, 0, issn FROM n),
c AS (SELECT *, lag(journal) OVER (PARTITION BY field, key ORDER BY "row", i) AS before FROM o WHERE key <> '')
SELECT 'error' AS level, "row", field, CASE field WHEN 'issn' THEN 'ISSN ' ELSE 'normalized journal name ' END || '''' || key || ''' maps to both ''' || before || ''' and ''' || journal || '''' AS message FROM c WHERE before <> journal
UNION ALL SELECT 'error', "row", 'impact_factor', 'row ' || "row" || ' ' || journal || ': impact_factor is not numeric: ' || chr(39) || 'n/a' || chr(39) FROM n WHERE f = 'n/a'
UNION ALL SELECT 'warning', "row", 'journal', 'row ' || "row" || ': journal is blank' FROM m WHERE journal = ''
UNION ALL SELECT 'warning', "row", 'metric_source', 'row ' || "row" || ' ' || journal || ': metric_source is blank' FROM n WHERE nosource
UNION ALL SELECT 'warning', "row", 'confidence', 'row ' || "row" || ' ' || journal || ': confidence is blank' FROM n WHERE unsure
UNION ALL SELECT 'warning', "row", 'last_checked', 'row ' || "row" || ' ' || journal || ': last_checked is blank' FROM n
UNION ALL SELECT 'error', 1, '', 'missing required columns: last_checked'""")
def metric_governance(spark, sf):
    """Shared names that differ as written, shared ISSNs and aliases, texts for numbers, blanks, rows without a journal, a missing column."""
    k = F.col("s_suppkey")
    journal = F.when(k % 10 == 0, "").when(k % 10 == 1, F.concat(F.lit("The Journal of S"), F.expr("s_suppkey div 20"))).when(k % 10 == 2, F.concat(F.lit("Journal S"), F.expr("s_suppkey div 20"))).otherwise(F.concat(F.lit("Title "), k))
    dim = _t(spark, sf, "supplier").select(
        (k - 1).alias("_ord"), journal.alias("journal"), F.when(k % 10 == 5, F.concat(F.lit("Shared; A"), k)).otherwise("").alias("aliases"), F.lpad((k % 90).cast("string"), 8, "0").alias("issn"),
        F.when(k % 7 == 0, "n/a").when(k % 7 == 1, "").otherwise("1.5").alias("impact_factor"), F.lit("2023").alias("metric_year"), F.when(k % 3 == 0, " ").otherwise("JCR").alias("metric_source"), F.lit("u").alias("source_url"), F.when(k % 4 == 0, "").otherwise("high").alias("confidence"),
    )
    return M.governance(dim)


@query("""WITH j AS (SELECT o_orderkey AS k, c_custkey IS NOT NULL AS known, 1992 + o_orderkey % 7 AS y, 1992 + c_nationkey % 7 AS xy FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) c ON o_custkey = c_custkey),
r AS (SELECT *, k % 17 = 0 AS blank, k % 17 <> 0 AND known AND k % 5 = 2 AS t, known AND y <> xy AS d, k % 17 <> 0 AND known AND k % 4 = 2 AS o FROM j)
SELECT k AS _ord, CASE WHEN blank THEN 'missing_doi' WHEN NOT known THEN 'lookup_failed' WHEN t OR d OR o THEN 'mismatch' ELSE 'verified' END AS crossref_status, NOT blank AND t AS title_differs, NOT blank AND o AS journal_differs,
CASE WHEN NOT blank AND known AND y <> xy THEN 'YEAR_MISMATCH: input=' || y || ' vs crossref=' || xy ELSE '' END AS year_differs, blank AND NOT t AND NOT o AS no_doi, CASE WHEN NOT blank AND o THEN 'JOURNAL_MISMATCH: input=''unrelated weekly'' vs crossref=''journal of things' || chr(39) ELSE '' END AS journal_text FROM r""")
def authority_join_mismatch(spark, sf):
    """Titles that are equal, nearly equal, unrelated or blank; journals that are equal, nearly equal, unrelated or blank."""
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer").where("c_custkey % 3 <> 0")
    title = "CASE o_orderkey % 5 WHEN 2 THEN 'Wholly other words' WHEN 3 THEN '' WHEN 4 THEN concat('a STUDY of the long efects of item ', o_custkey, '.') ELSE concat('A study of the long effects of item ', o_custkey) END AS title"
    journal = "CASE o_orderkey % 4 WHEN 0 THEN 'Journal of Things' WHEN 1 THEN 'journal of thing' WHEN 2 THEN 'Unrelated Weekly' ELSE '' END AS journal"
    rows = o.selectExpr("o_orderkey AS _ord", "CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE concat('10.1000/c', o_custkey) END AS doi", title, "cast(1992 + o_orderkey % 7 as string) AS publication_year", journal)
    auth = c.selectExpr("c_custkey AS _ord", "concat('doi:10.1000/C', c_custkey) AS doi", "concat('<i>A study</i> of the long effects of item ', c_custkey) AS title", "cast(1992 + c_nationkey % 7 as string) AS year", "'Journal of Things' AS journal")
    auth = auth.unionAll(auth.selectExpr("_ord + 1000000", "doi", "'a later row of the DOI'", "'1900'", "''"))
    out = V.authority_join(rows, auth)
    m = F.col("crossref_mismatches")
    return out.select("_ord", "crossref_status", m.contains("TITLE_MISMATCH").alias("title_differs"), m.contains("JOURNAL_MISMATCH").alias("journal_differs"), F.regexp_extract(m, r"YEAR_MISMATCH: input=\d+ vs crossref=\d+", 0).alias("year_differs"), (m == "NO_DOI").alias("no_doi"), F.regexp_extract(m, "JOURNAL_MISMATCH:.*", 0).alias("journal_text"))


@query("""WITH c AS (SELECT c_custkey AS k, '10.1000/c' || c_custkey AS doi, md5(CAST(c_custkey AS VARCHAR)) AS title, CAST(1992 + c_nationkey % 7 AS VARCHAR) AS y FROM customer),
r AS (SELECT o_orderkey AS o, o_custkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE '10.1000/C' || o_custkey END AS raw, CASE WHEN o_orderkey % 28 = 0 THEN 'abc' WHEN o_orderkey % 12 = 0 THEN md5('x' || o_orderkey) ELSE md5(CAST(o_custkey AS VARCHAR)) END AS title, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(1992 + o_orderkey % 7 AS VARCHAR) END AS y FROM orders),
j AS (SELECT r.*, c.doi, c.title AS ct, c.y AS cy, raw <> '' AND r.k % 11 = 0 AS again, raw <> '' AND r.k % 7 = 0 AS hit, raw <> '' AND r.k % 13 = 0 AND r.k % 7 <> 0 AS failed, r.k % 3 <> 0 AND c.doi IS NOT NULL AS known FROM r LEFT JOIN c ON c.k = r.k),
s AS (SELECT *, CASE WHEN again THEN 'verified' WHEN o >= 12000 THEN 'skipped_budget' WHEN failed THEN 'rate_limited' WHEN raw = '' THEN CASE WHEN known AND title = ct AND (y = '' OR y = cy) THEN 'title_recovered' ELSE 'title_lookup_failed' END WHEN hit THEN 'verified' WHEN NOT known THEN 'lookup_failed' WHEN y <> '' AND y <> cy THEN 'mismatch' ELSE 'verified' END AS st FROM j)
SELECT o AS _ord, st AS crossref_status, CASE WHEN again THEN 'doi:' || doi WHEN st = 'title_recovered' THEN doi ELSE raw END AS doi, CASE st WHEN 'skipped_budget' THEN 'SKIPPED_BY_MAX_ROWS_BUDGET' WHEN 'rate_limited' THEN 'CROSSREF_RATE_LIMITED' WHEN 'title_lookup_failed' THEN 'NO_DOI_TITLE_LOOKUP_FAILED' WHEN 'lookup_failed' THEN 'CROSSREF_LOOKUP_FAILED' WHEN 'mismatch' THEN 'YEAR_MISMATCH: input=' || y || ' vs crossref=' || cy ELSE '' END AS crossref_mismatches,
CASE WHEN again THEN 'kept' WHEN st IN ('verified', 'mismatch', 'title_recovered') THEN ct ELSE '' END AS crossref_title, CASE WHEN again THEN '' WHEN st = 'title_recovered' THEN 'title_search' WHEN st IN ('verified', 'mismatch') THEN 'doi' ELSE '' END AS crossref_lookup_method,
CASE WHEN again OR st = 'skipped_budget' THEN '' WHEN hit THEN 'hit' WHEN st IN ('verified', 'mismatch', 'title_recovered') THEN 'store' ELSE 'miss' END AS crossref_cache_status, CASE WHEN st = 'title_recovered' THEN '1.000' ELSE '' END AS crossref_title_similarity, CASE WHEN st = 'title_recovered' THEN CASE WHEN y <> '' THEN 'high' ELSE 'medium' END ELSE '' END AS crossref_recovered_doi_confidence,
CASE WHEN st = 'rate_limited' THEN '30' ELSE '' END AS crossref_retry_after_seconds, again AS crossref_reused FROM s""")
def verification_run(spark, sf):
    """Verification with everything it takes: an earlier output, a cache, failures, a budget, and titles for rows without a DOI."""
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    rows = o.selectExpr("o_orderkey AS _ord", "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE concat('10.1000/C', o_custkey) END AS doi", "CASE WHEN o_orderkey % 28 = 0 THEN 'abc' WHEN o_orderkey % 12 = 0 THEN md5(concat('x', o_orderkey)) ELSE md5(cast(o_custkey as string)) END AS title", "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE cast(1992 + o_orderkey % 7 as string) END AS publication_year")
    auth = c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS _ord", "concat('10.1000/c', c_custkey) AS doi", "md5(cast(c_custkey as string)) AS title", "cast(1992 + c_nationkey % 7 as string) AS year")
    prior = c.where("c_custkey % 11 = 0").selectExpr("c_custkey AS _ord", "concat('doi:10.1000/c', c_custkey) AS doi", "'verified' AS crossref_status", "'kept' AS crossref_title")
    key = V.cache_key("doi", F.concat(F.lit("10.1000/c"), "c_custkey")).alias("key")
    cache = c.where("c_custkey % 7 = 0").select(key, F.lit("verified").alias("status"), F.to_json(F.struct(F.concat(F.lit("10.1000/c"), "c_custkey").alias("crossref_doi"), F.md5(F.col("c_custkey").cast("string")).alias("crossref_title"))).alias("value"), F.lit("2024-01-01").cast("timestamp").alias("updated_at"), F.lit("2025-01-01").cast("timestamp").alias("expires_at"))
    stale = cache.withColumns({"updated_at": F.lit("2024-01-02").cast("timestamp"), "expires_at": F.lit("2024-01-03").cast("timestamp"), "value": F.lit("{}")})
    failed = c.where("c_custkey % 13 = 0").selectExpr("concat('10.1000/c', c_custkey) AS doi", "'rate_limited' AS status", "'30' AS retry_after_seconds")
    out = V.verify(rows, auth, title_lookup=True, prior=prior, cache=cache.unionAll(stale), now=F.lit("2024-06-01").cast("timestamp"), ttl_seconds=86400.0, max_rows=12000, failures=failed)
    return out.select("_ord", "crossref_status", "doi", "crossref_mismatches", "crossref_title", "crossref_lookup_method", "crossref_cache_status", "crossref_title_similarity", "crossref_recovered_doi_confidence", "crossref_retry_after_seconds", "crossref_reused")


@query("SELECT o_custkey, o_orderkey AS _ord FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def keep_first(spark, sf):
    df = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("k"), "o_custkey", F.col("o_orderkey").alias("_ord"))
    return V.keep_first(df, "k").select("o_custkey", "_ord")


@query("SELECT o_custkey, o_orderkey AS _ord FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def keep_last(spark, sf):
    return V.keep_last(_t(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("_ord")), "o_custkey")


@query("""WITH p AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, p.k IS NOT NULL AS reused FROM customer LEFT JOIN p ON c_custkey = o_custkey""")
def incremental_reuse(spark, sf):
    rows = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_custkey")
    prior = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("id"), F.col("o_orderkey").alias("_ord"), F.col("o_orderstatus").alias("crossref_status"))
    hit, todo = V.reuse(rows, prior, "id", ["crossref_status"], ["F"])
    return hit.select("c_custkey", F.lit(True).alias("reused")).unionAll(todo.select("c_custkey", F.lit(False).alias("reused")))


@query()
def title_best_match(spark, sf):
    docs = candidates(spark, sf).select("_ord", "title", "publication_year", "journal")
    b = _t(spark, sf, "benchmark").select(F.col("item_id").alias("_ord"), F.col("text").alias("title"), F.lit("").alias("year"))
    return V.best_title(docs, b).select("_ord", "a_ord", "similarity", "match_confidence")


@query("""SELECT page_id, concat_ws('; ', CASE WHEN contains(lower(substr(html, 1, 1000)), '<html') THEN 'html' END, CASE WHEN regexp_matches(html, '(?i)\\babstract\\b') THEN 'abstract_marker' END,
CASE WHEN regexp_matches(html, '(?i)\\b(full text|materials and methods|experimental|supporting information)\\b') THEN 'fulltext_marker' END,
CASE WHEN regexp_matches(html, '(?i)\\b(methods?|materials and methods|experimental|procedure)\\b') THEN 'methods_marker' END,
CASE WHEN regexp_matches(html, '(?i)\\b(results?|discussion|conclusion|fig(?:ure)?\\.?\\s*\\d+|table\\s+\\d+)\\b') THEN 'results_marker' END,
CASE WHEN regexp_matches(html, '(?i)\\b(purchase|rent|subscribe|institutional access|access through your institution)\\b') THEN 'paywall_marker' END) AS features FROM pages""")
def page_features(spark, sf):
    return _t(spark, sf, "pages").select("page_id", P.features("html", F.lit("")).alias("features"))


_HTML = {"blocked": "blocked", "pdf_direct": "not_html", "non_html": "not_html", "html_possible": "available", "abstract_only_or_landing": "available", "landing_page": "available"}


@query(f"""WITH p AS (SELECT page_id, page_id % 11 AS k, CASE WHEN page_id % 11 IN (4, 5) THEN repeat(' ', 1000) || html WHEN page_id % 11 = 6 THEN '<html><p>Full Text</p>' || html WHEN page_id % 11 = 7 THEN '<html><p>abstract, full text: subscribe</p>' || html WHEN page_id % 11 = 8 THEN '<html><p>Abstract</p>' || html ELSE '<html>' || html END AS page FROM pages),
a AS (SELECT page_id, CASE WHEN k = 0 THEN 'blocked' WHEN k = 1 THEN 'server_error' WHEN k = 2 THEN 'network_error' WHEN k = 3 THEN 'blocked_url' WHEN NOT contains(lower(substr(page, 1, 1000)), '<html') THEN CASE WHEN k = 4 THEN 'pdf_direct' ELSE 'non_html' END
 WHEN regexp_matches(page, '(?i)\\b(full text|materials and methods|experimental|supporting information)\\b') AND NOT regexp_matches(page, '(?i)\\b(purchase|rent|subscribe|institutional access|access through your institution)\\b') THEN 'html_possible'
 WHEN regexp_matches(page, '(?i)\\babstract\\b') THEN 'abstract_only_or_landing' ELSE 'landing_page' END AS access_status FROM p)
SELECT page_id, access_status, CASE access_status {" ".join(f"WHEN '{a}' THEN '{h}'" for a, h in _HTML.items())} ELSE 'unknown' END AS html_status, CASE WHEN access_status = 'pdf_direct' THEN 'found' ELSE 'unknown' END AS pdf_status, 'unknown' AS si_status,
CASE access_status {" ".join(f"WHEN '{a}' THEN '{t}'" for a, t in P.ACCESS_ACTIONS.items())} END AS next_action FROM a""")
def access_class(spark, sf):
    """Every class, by status, content type and the whole pages with markers put before some."""
    k = F.col("page_id") % 11
    status = F.when(k == 0, "403").when(k == 1, "503").when(k == 2, "").when(k == 3, "blocked_url").otherwise("200")
    kind = F.when(k == 4, "application/pdf").when(k == 5, "text/plain").otherwise("")
    added = F.when(k == 6, "<p>Full Text</p>").when(k == 7, "<p>abstract, full text: subscribe</p>").when(k == 8, "<p>Abstract</p>").otherwise("")
    page = F.when(k.isin(4, 5), F.concat(F.lit(" " * 1000), "html")).otherwise(F.concat(F.lit("<html>"), added, "html"))
    return _t(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in P.access_row(status, kind, page).items()])


# Hosts and whether they are public.
_HOSTS = [
    ("localhost", False), ("a.local", False), ("127.1", False), ("2130706433", False), ("0x7f.0.0.1", False), ("0177.0.0.1", False), ("10.255.0.3:8080", False), ("172.31.9.9", False), ("172.32.9.9", True), ("192.168.1.1.", False),
    ("user:pw@169.254.169.254", False), ("8.8.8.8", True), ("134744072", True), ("[::1]", False), ("[::ffff:10.0.0.1]:80", False), ("[::ffff:808:808]", True), ("[fe80::1%25eth0]", False), ("[2001:db8::1]", False), ("[2606:4700::1111]", True), ("300.1.1.1", False), ("example.org", True), ("x.1.example", True), ("", False), ("224.0.0.251", False),
]


@query(f"SELECT page_id, [{', '.join(str(p).lower() for _, p in _HOSTS)}][1 + page_id % {len(_HOSTS)}] AND page_id % 7 <> 0 AS public, page_id % 7 <> 1 AND regexp_matches(url, '(?i)^https?://[a-z]') AS own FROM pages")
def url_safety(spark, sf):
    """Hosts as names and addresses in every form before the pages' own paths, with other schemes; and the pages' own URLs."""
    k = F.col("page_id")
    host = F.element_at(F.array(*[F.lit(h) for h, _ in _HOSTS]), (k % len(_HOSTS) + 1).cast("int"))
    made = F.concat(F.when(k % 7 == 0, "ftp://").otherwise("HTTP://"), host, F.lit("/"), F.regexp_replace("url", "^[a-z]+://[^/]*/?", ""))
    own = F.when(k % 7 == 1, F.concat(F.lit("file:"), "url")).otherwise(F.col("url"))
    return _t(spark, sf, "pages").select("page_id", P.public_url(made).alias("public"), P.public_url(own).alias("own"))


_ADDED = [
    '<META content-type="x" name="citation_pdf_url" content="/a/1.pdf"><a href="/sup">supplement</a>',
    '<a class="b" href="dl/x.pdf?a=1&amp;b=2">Get</a>',
    "<a href='../si/s1.zip'><b>Supporting</b> Information</a><a href=\"//cdn.example.org/p\">Download\nPDF</a>",
    '<area href="/article/pii/S1" alt="">read as pdf here<br>',
    '<a href="?view=more">Appendix</a>',
    "",
]


@query("""WITH p AS (SELECT page_id, page_id % 6 AS k, regexp_replace(url, '[?#].*$', '') AS plain, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root FROM pages),
f AS (SELECT *, regexp_extract(plain, '^(.*/)') AS folder FROM p)
SELECT page_id, CASE k WHEN 0 THEN root || '/a/1.pdf' WHEN 1 THEN folder || 'dl/x.pdf?a=1&b=2' WHEN 2 THEN regexp_extract(plain, '^[a-z]+:') || '//cdn.example.org/p' WHEN 3 THEN root || '/article/pii/S1' ELSE '' END AS pdf_url,
CASE k WHEN 0 THEN root || '/sup' WHEN 2 THEN regexp_replace(folder, '[^/]+/$', '') || 'si/s1.zip' WHEN 4 THEN plain || '?view=more' ELSE '' END AS si_url,
CASE k WHEN 0 THEN 'pdf:meta_citation_pdf_url' WHEN 1 THEN 'pdf:get' WHEN 2 THEN 'si:supporting information; pdf:download pdf' WHEN 3 THEN 'pdf:regex_fallback' WHEN 4 THEN 'si:appendix' ELSE '' END AS hints FROM f""")
def article_links(spark, sf):
    """Links of every kind put before the pages' own."""
    k = F.col("page_id") % 6
    added = F.element_at(F.array(*map(F.lit, _ADDED)), (k + 1).cast("int"))
    pdf, si, hints = P.links(F.concat(added, "html"), "url")
    return _t(spark, sf, "pages").select("page_id", pdf.alias("pdf_url"), si.alias("si_url"), hints.alias("hints"))


_FAMILY = ["pubs.acs.org", "www.nature.com", "link.springer.com", "x.elsevier.com", "onlinelibrary.wiley.com", "mdpi.com", "cell.com", "notacs.org", "www.science.org", "acs.org"]
_FAMILIES = ["acs", "springer_nature", "springer", "elsevier", "wiley", "mdpi", "cell_press", "other_publisher", "aaas", "acs"]


@query(f"SELECT page_id, regexp_replace([{', '.join(repr(x) for x in _FAMILY)}][1 + page_id % 10], '^www\\.', '') AS domain, [{', '.join(repr(x) for x in _FAMILIES)}][1 + page_id % 10] AS family FROM pages")
def publisher_family(spark, sf):
    host = F.element_at(F.array(*map(F.lit, _FAMILY)), (F.col("page_id") % 10 + 1).cast("int"))
    return _t(spark, sf, "pages").select("page_id", host.alias("h")).select("page_id", T.domain("h").alias("domain"), P.family("h").alias("family"))


@query(f"SELECT event_id, {S.classify_sql(_STATUS_SQL)} AS class, {S.table_sql(S.classify_sql(_STATUS_SQL), S.ACTIONS, 'manual_review')} AS action FROM events")
def status_classify(spark, sf):
    return _t(spark, sf, "events").select("event_id", S.classify(_status()).alias("class"), S.next_action(_status()).alias("action"))


@query(f"SELECT event_id, {S.classify_sql(_STATUS_SQL)} IN ('auth', 'error', 'network', 'partial', 'rate_limited') AS failure, {S.classify_sql(_STATUS_SQL)} IN ('rate_limited', 'network') AS cacheable FROM events")
def provider_failures(spark, sf):
    return _t(spark, sf, "events").select("event_id", S.is_failure(_status()).alias("failure"), S.is_cacheable_failure(_status(), F.lit(False), F.lit(None).cast("boolean")).alias("cacheable"))


@query(f"""SELECT event_id, CASE WHEN coalesce(sum(CASE WHEN {S.classify_sql(_STATUS_SQL)} IN ('auth', 'error', 'network', 'partial', 'rate_limited') THEN 1 ELSE 0 END)
OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 2 THEN 'skipped_circuit_breaker' ELSE {_STATUS_SQL} END AS replayed FROM events""")
def circuit_breaker_replay(spark, sf):
    calls = _t(spark, sf, "events").select("event_id", F.col("user_id").alias("provider"), F.col("event_id").alias("q"), _status().alias("status"))
    return B.breaker_replay(calls, 2).select("event_id", "replayed")


@query(f"""WITH RECURSIVE e AS (SELECT event_id, user_id AS u, event_type AS qt, {_STATUS_SQL} AS st, epoch_us(ts) / 1e6 AS at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id % 3 = 0 AS some FROM events),
f AS (SELECT *, {S.classify_sql("st")} AS c, {S.classify_sql("st")} IN ('auth', 'error', 'network', 'partial', 'rate_limited') AS fails FROM e),
s AS (SELECT u, 0 AS n, CAST(-1 AS BIGINT) AS event_id, '' AS status, false AS made, 0 AS failures, CAST(0 AS DOUBLE) AS until, MAP {{'': CAST(0 AS DOUBLE)}} AS failed FROM (SELECT DISTINCT u FROM f)
 UNION ALL SELECT f.u, f.n, f.event_id, CASE d.why WHEN '' THEN f.st ELSE d.why END, d.why = '', s.failures + CASE WHEN d.why = '' AND f.fails THEN 1 ELSE 0 END, CASE WHEN d.why = '' AND f.c = 'rate_limited' THEN f.at + 20000 ELSE s.until END,
  CASE WHEN d.why = '' AND NOT f.some AND f.c IN ('rate_limited', 'network') THEN map_from_entries(list_concat(list_filter(map_entries(s.failed), lambda x: x.key <> f.qt), [{{'key': f.qt, 'value': f.at + CASE f.c WHEN 'rate_limited' THEN 20000 ELSE 30000 END}}])) ELSE s.failed END
 FROM s JOIN f ON f.u = s.u AND f.n = s.n + 1, LATERAL (SELECT CASE WHEN s.until > f.at THEN 'skipped_rate_limit_cooldown' WHEN s.failures >= 5 THEN 'skipped_circuit_breaker' WHEN coalesce(element_at(s.failed, f.qt)[1], 0) > f.at THEN 'skipped_cached_provider_failure' ELSE '' END AS why) d)
SELECT event_id, status, made FROM s WHERE n > 0""")
def call_control(spark, sf):
    """Cooldown, breaker and cached failures over the calls of each user, in the order of their times, decided by a stateful stream."""
    e = _t(spark, sf, "events")
    rows = e.select(
        F.lit("run").alias("run_id"), F.col("user_id").cast("string").alias("provider"), F.col("event_id").cast("string").alias("query_id"), F.col("event_type").alias("query"), F.col("event_id").alias("q"), F.col("ts").cast("timestamp").alias("at"), F.lit(10).alias("max_results"),
        _status().alias("status"), (F.col("event_id") % 3 == 0).cast("int").alias("returned_count"),
    )
    out = L.run(rows, f"{folder(spark)}/calls-{uuid.uuid4().hex}", threshold=5, cooldown_seconds=20000, failure_ttl_seconds=30000)
    return out.select(F.col("q").alias("event_id"), "status", "made")


@query("""WITH w AS (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, 1992 + o_orderkey % 7 AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'review' ELSE 'article' END AS t, 'd' || (o_orderkey % 40) AS d FROM orders WHERE o_custkey < 300),
m AS (SELECT *, (n - 1) // 5 AS page, (n - 1) % 5 AS pos FROM w WHERE y BETWEEN 1993 AND 1997 AND t = 'article'),
u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY c, d ORDER BY n) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n) AS place FROM u)
SELECT 'q' || c AS query_id, '10.1/' || d AS doi, 'Work ' || k AS title, CAST(y AS VARCHAR) AS publication_year, CAST(place AS INTEGER) AS discovery_rank FROM r WHERE place <= 6 AND c BETWEEN 50 AND 250""")
def captured_pages(spark, sf):
    """Pages of five works a query, written by Spark, read through the data source with the request's bounds and cap, and pushed filters on queries."""
    from pyspark.sql import Window as W

    o = _t(spark, sf, "orders").where("o_custkey < 300").withColumn("n", F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")))
    work = F.struct(F.concat(F.lit("https://doi.org/10.1/D"), F.col("o_orderkey") % 40).alias("doi"), F.concat(F.lit("Work "), "o_orderkey").alias("title"), (1992 + F.col("o_orderkey") % 7).alias("publication_year"), F.when(F.col("o_orderkey") % 3 == 0, "review").otherwise("article").alias("type"))
    pages = o.groupBy(F.lit("openalex").alias("provider"), F.concat(F.lit("q"), "o_custkey").alias("query"), F.expr("(n - 1) div 5 + 1").alias("page")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("n", work.alias("w")))), lambda x: x["w"]).alias("results"))).alias("text"))
    path = f"{folder(spark)}/capture-{uuid.uuid4().hex}"
    pages.repartition("query", "page").write.partitionBy("provider", "query", "page").text(path)
    wanted = [f"q{i}" for i in range(50, 251)]
    out = A.search(spark, path, "openalex", only={"query_id": wanted}, year_from=1993, year_to=1997, types="article", max_results=6)
    return out.select("query_id", "doi", "title", "publication_year", "discovery_rank")


@query("SELECT conv_id, arg_max(role, turn) AS status, max(turn) AS _ord FROM conversations GROUP BY conv_id")
def latest_per_stage(spark, sf):
    rows = _t(spark, sf, "conversations").select("conv_id", F.col("role").alias("status"), F.col("turn").alias("_ord"))
    return R.latest(rows, "conv_id")


@query(f"""SELECT user_id AS run_id, CASE WHEN bool_or({S.classify_sql(_STATUS_SQL)} IN ('auth', 'budget_limited', 'error', 'network', 'partial', 'rate_limited')) THEN 'partial' ELSE 'completed' END AS run_status, count(*) AS n_stages FROM events GROUP BY 1""")
def run_status(spark, sf):
    return R.run_status(_t(spark, sf, "events").select(F.col("user_id").alias("run_id"), _status().alias("status")))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS discovery_rank FROM lineitem")
def rank_in_group(spark, sf):
    order = (F.col("l_linenumber").cast("long") * (1 << 40) + F.col("l_partkey")).alias("_ord")
    return B.rank_in_group(_t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", order), "l_orderkey").select("l_orderkey", "l_linenumber", "discovery_rank")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) > 100 THEN 'skipped_budget' ELSE o_orderstatus END AS status FROM orders")
def row_budget(spark, sf):
    df = B.with_ord(_t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status")), "o_orderkey")
    return B.row_budget(df, 100, "status").select("o_orderkey", "status")


@query("""WITH c AS (SELECT user_id, max(ts) AS u FROM events WHERE event_id % 3 = 0 GROUP BY 1)
SELECT e.event_id, CASE WHEN c.u + INTERVAL 1 DAY > TIMESTAMP '2024-01-15 00:00:00' THEN c.u END AS value FROM events e LEFT JOIN c USING (user_id)""")
def ttl_cache_lookup(spark, sf):
    e = _t(spark, sf, "events")
    cache = e.where("event_id % 3 = 0").select(F.col("user_id").alias("key"), F.lit("ok").alias("status"), F.col("ts").alias("value"), F.col("ts").alias("updated_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    return V.ttl_lookup(e.select("event_id", "user_id"), cache, "user_id", F.to_timestamp(F.lit("2024-01-15 00:00:00")), 86400).select("event_id", "value")


@query("""SELECT l_partkey AS doi_key, count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_suppkey = 1) GROUP BY 1""")
def citation_one_hop(spark, sf):
    edges = _t(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("citing"), F.col("l_suppkey").cast("string").alias("cited"))
    return B.one_hop(edges, "1").groupBy(F.col("doi").cast("long").alias("doi_key")).agg(F.count("*").alias("n"))


_SPACED = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


@query(f"""{_CAND}, k AS (SELECT *, {_DOI} AS d, CASE WHEN _ord % 3 = 0 THEN 'Seen: ' || title ELSE '' END AS vt, CASE WHEN _ord % 4 = 0 THEN '10.7/V' || _ord ELSE '' END AS vd, CASE WHEN _ord % 5 = 0 THEN 'https://x.org/' || _ord ELSE '' END AS link, CASE WHEN _ord % 7 = 0 THEN '' ELSE discovery_source END AS src FROM c),
r AS (SELECT *, CASE WHEN vd <> '' THEN 'doi:' || lower(vd) WHEN d <> '' THEN 'doi:' || d ELSE 'row:' || _ord || ':title:' || {_SPACED.format("CASE WHEN vt <> '' THEN vt ELSE title END")} || '|year:' || publication_year END AS record_key, CASE WHEN src = '' THEN 'candidate' ELSE src END AS own FROM k)
SELECT record_key, 'title' AS field, CASE WHEN vt <> '' THEN vt ELSE title END AS value, CASE WHEN vt <> '' THEN 'crossref' ELSE own END AS source, CASE WHEN vt <> '' THEN 'bibliographic_verified' ELSE 'candidate' END AS trust FROM r
UNION ALL SELECT record_key, 'doi', CASE WHEN vd <> '' THEN lower(vd) ELSE d END, CASE WHEN vd <> '' THEN 'crossref' ELSE own END, CASE WHEN vd <> '' THEN 'bibliographic_verified' ELSE 'candidate' END FROM r
UNION ALL SELECT record_key, 'journal', journal, own, 'candidate' FROM r UNION ALL SELECT record_key, 'publication_year', publication_year, own, 'candidate' FROM r UNION ALL SELECT record_key, 'abstract', abstract, own, 'candidate' FROM r
UNION ALL SELECT record_key, 'oa_link', link, CASE WHEN link <> '' THEN 'unpaywall' ELSE '' END, CASE WHEN link <> '' THEN 'access_hint' ELSE '' END FROM r
UNION ALL SELECT record_key, 'journal_metric', '', '', 'not_verified' FROM r UNION ALL SELECT record_key, 'publisher_access', '', '', '' FROM r""")
def provenance_long(spark, sf):
    """Every field of every row, some of them verified, some without a source."""
    k = lambda n: F.col("_ord") % n == 0
    when = lambda n, x: F.when(k(n), x).otherwise("")
    rows = candidates(spark, sf).withColumns({"crossref_title": when(3, F.concat(F.lit("Seen: "), "title")), "crossref_doi": when(4, F.concat(F.lit("10.7/V"), "_ord")), "best_oa_url": when(5, F.concat(F.lit("https://x.org/"), "_ord")), "discovery_source": F.when(k(7), "").otherwise(F.col("discovery_source"))})
    return R.provenance(rows)


@query(f"""{_CAND} SELECT _ord + 2 AS row, 'FAIL' AS level, 'doi' AS field, 'Required stage field is empty/Unknown' AS issue FROM c WHERE doi = '' UNION ALL
SELECT _ord + 2, 'WARN', 'access_status', 'Queue status advanced while access remains pending' FROM c WHERE _ord % 3 = 0 AND _ord % 2 = 0 UNION ALL SELECT 0, 'FAIL', 'crossref_status', 'Required column missing'""")
def stage_validation(spark, sf):
    k = lambda n: F.col("_ord") % n == 0
    rows = candidates(spark, sf).drop("abstract").withColumns({"access_status": F.when(k(3), "pending").otherwise("done"), "queue_status": F.when(k(2), "checked").otherwise("pending")})
    return R.validate(rows, ["doi", "article_type", "crossref_status"], ["article_type"], "queue")


@query("SELECT page_id AS _ord, url AS landing_page_url, CASE WHEN page_id % 2 = 0 THEN '10.5555/p' || page_id ELSE '' END AS doi, '2021' AS publication_year FROM pages")
def websearch_import(spark, sf):
    p = _t(spark, sf, "pages").select(F.col("page_id").alias("_ord"), F.col("url").alias("link"), F.concat(F.lit("seen 2021 "), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("see doi:10.5555/P"), "page_id", F.lit("."))).otherwise("")).alias("snippet"))
    return web_leads(p).select("_ord", "landing_page_url", "doi", "publication_year")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def json_flatten(spark, sf):
    return _t(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.page").alias("page"))


@query("SELECT doc_id, regexp_replace(lower(text), '[^a-z ]', '', 'g') AS rebuilt FROM documents")
def inverted_text_rebuild(spark, sf):
    """Inverted index of every whole text and the text rebuilt from it."""
    df = _t(spark, sf, "documents").select("doc_id", F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ", -1).alias("w"))
    return df.select("doc_id", J.inverted_index("w").alias("index")).select("doc_id", J.rebuild_abstract("index").alias("rebuilt"))


@query("SELECT DISTINCT lang, source, 'q' || lpad(CAST(dense_rank() OVER (ORDER BY lang) AS VARCHAR), 3, '0') AS query_id FROM documents")
def discovery_plan(spark, sf):
    """Plan rows of queries and providers; the few distinct queries get dense ids."""
    d = _t(spark, sf, "documents").select("lang", "source").distinct()
    ids = N.query_ids(d.select("lang").distinct().withColumn("_ord", F.col("lang"))).drop("_ord")
    return d.join(ids, "lang").select("lang", "source", "query_id")


@query(f"{_CAND} SELECT discovery_source, min(_ord) AS _ord FROM c GROUP BY 1")
def ordered_distinct(spark, sf):
    return B.ordered_distinct(candidates(spark, sf), "discovery_source")


_TAGS = ", ".join(f"CASE WHEN {' OR '.join(f"contains(x, '{w}')" for w in words)} THEN '{tag}' END" for tag, words in N.DOMAIN_HINTS.items())


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) || CASE doc_id % 5 WHEN 0 THEN ' wastewater' WHEN 1 THEN ' clinical arxiv' ELSE '' END AS x, CASE WHEN doc_id % 2 = 0 THEN ['arxiv', 'openalex'] ELSE ['semantic_scholar'] END AS own FROM documents),
t AS (SELECT *, list_filter([{_TAGS}], lambda z: z IS NOT NULL) AS tags FROM d),
r AS (SELECT *, list_concat(['openalex'], CASE WHEN list_contains(own, 'semantic_scholar') OR list_has_any(tags, ['preprint_heavy', 'biomedical', 'chemistry_materials', 'environmental']) THEN ['semantic_scholar'] ELSE [] END,
     CASE WHEN list_contains(tags, 'preprint_heavy') THEN ['arxiv'] ELSE [] END, CASE WHEN list_contains(tags, 'biomedical') THEN ['europe_pmc'] ELSE [] END) AS rec FROM t)
SELECT doc_id, array_to_string(tags, ',') AS tags, array_to_string(list_sort(rec), ',') AS recommended, array_to_string(list_sort(list_filter(rec, lambda z: NOT list_contains(own, z))), ',') AS missing,
CASE WHEN doc_id % 2 = 0 THEN 'openalex,arxiv' ELSE 'semantic_scholar' END AS fallback FROM r""")
def domain_strategy(spark, sf):
    """Domain tags of texts, suggested sources, those not selected, and the selected ones in fallback order."""
    k = F.col("doc_id") % 5
    x = F.concat(T.text("text"), F.when(k == 0, " wastewater").when(k == 1, " clinical arxiv").otherwise(""))
    own = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("arxiv"), F.lit("openalex"))).otherwise(F.array(F.lit("semantic_scholar")))
    d = _t(spark, sf, "documents").select("doc_id", N.domain_tags(x).alias("tags"), own.alias("own"))
    d = d.withColumn("rec", N.suggested_sources(F.col("tags"), F.col("own")))
    flat = lambda c: F.array_join(c, ",")
    return d.select("doc_id", flat("tags").alias("tags"), flat(F.array_sort("rec")).alias("recommended"), flat(F.array_sort(N.difference(F.col("rec"), F.col("own")))).alias("missing"), flat(N.by_priority(F.col("own"))).alias("fallback"))


@query("""WITH q AS (SELECT n_nationkey AS k, 'q' || lpad(CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR), 3, '0') AS query_id, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)
SELECT query_id, provider, (i - 1) * 3 + p AS q, provider = 'semantic_scholar' AND i > 7 AS skipped, CASE WHEN provider = 'semantic_scholar' THEN 50 ELSE 100 END AS max_results FROM q, (VALUES (0, 'openalex'), (1, 'semantic_scholar'), (2, 'arxiv')) v(p, provider)""")
def call_plan(spark, sf):
    """Queries times providers in plan order, with Semantic Scholar's limit of queries."""
    ids = N.query_ids(_t(spark, sf, "nation").select(F.col("n_nationkey").alias("_ord"), F.col("n_name").alias("query")))
    return N.calls(ids.select("query_id"), ["openalex", "semantic_scholar", "arxiv"], 7, 100, 50).select("query_id", "provider", F.col("q").cast("long").alias("q"), "skipped", "max_results")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id % 7 > 3 THEN 'skipped_rate_limit_cooldown' WHEN event_id % 4 >= 2 THEN 'skipped_circuit_breaker' WHEN event_id % 3 = 0 THEN 'skipped_cached_provider_failure' ELSE '' END AS why FROM events""")
def call_skips(spark, sf):
    """Precedence: cooldown, breaker, cached failure."""
    k = lambda n: F.col("event_id") % n
    return _t(spark, sf, "events").select("event_id", N.skip_call(F.when(k(5) == 0, k(7)), F.lit(3), k(4), 2, F.when(k(3) == 0, True)).alias("why"))


@query(f"""WITH e AS (SELECT user_id % 9 AS provider, {_STATUS_SQL} AS status, event_id % 4 AS n FROM events), f AS (SELECT *, {S.classify_sql('status')} AS c FROM e),
g AS (SELECT *, c IN ('auth', 'error', 'network', 'partial', 'rate_limited') AS bad FROM f), b AS (SELECT provider, bool_and(bad) AS all_failed, bool_or(bad) AS any_failed FROM g GROUP BY 1)
SELECT provider, status, any_value(c) AS status_class, count(*) AS calls, CAST(sum(n) AS BIGINT) AS n_rows, any_value(all_failed) AS all_failed, any_value(any_failed) AS any_failed FROM g JOIN b USING (provider) GROUP BY 1, 2""")
def provider_status_counts(spark, sf):
    e = _t(spark, sf, "events").select((F.col("user_id") % 9).alias("provider"), _status().alias("status"), (F.col("event_id") % 4).cast("long").alias("n_rows"))
    return U.provider_counts(e)


@query(f"""WITH e AS (SELECT user_id AS run_id, {S.classify_sql(_STATUS_SQL)} AS c FROM events)
SELECT run_id, CASE WHEN bool_or(c = 'rate_limited') THEN 'partial_rate_limited' WHEN bool_or(c IN ('auth', 'network', 'error', 'partial', 'skipped')) THEN 'partial_source_failure' ELSE 'completed' END AS stage_status FROM e GROUP BY 1""")
def discovery_stage_status(spark, sf):
    return U.discovery_status(_t(spark, sf, "events").select(F.col("user_id").alias("run_id"), _status().alias("status")))


@query("""WITH n AS (SELECT c_custkey AS k, c_custkey % 3 AS a, c_custkey % 5 AS b, c_custkey % 7 AS q, c_custkey % 2 AS m FROM customer),
r AS (SELECT k, list_filter([CASE WHEN a = 0 THEN 'No candidates remained after discovery/merge/deduplication.' END, CASE WHEN b = 0 THEN 'No rows reached semantic triage.' END,
CASE WHEN q = 0 THEN CASE WHEN m = 0 THEN 'No metric-pass candidates are available under the current IF threshold.' ELSE 'No candidates reached the publisher evidence queue under the current constraints.' END END,
CASE WHEN q < 4 THEN 'Current feasible count ' || q || ' is below requested target 4.' END], lambda z: z IS NOT NULL) AS l FROM n) SELECT k, len(l) = 0 AS feasible, array_to_string(l, ' ') AS reasons FROM r""")
def feasibility_reasons(spark, sf):
    k = lambda n: F.col("c_custkey") % n
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), k(3).alias("deduped"), k(5).alias("triaged"), k(7).alias("publisher_queue"), k(2).alias("metric_pass"))
    return U.feasibility(c, 4, 3.0).select("k", "feasible", F.array_join("blocking_reasons", " ").alias("reasons"))


_ADVICE = {"resume": "k % 2 = 0", "limited": "k % 3 = 0 OR k % 11 = 0", "cached": "k % 5 = 0", "trace": "k % 7 = 0", "verify": "k % 4 > 0 AND k % 6 = 0", "probe": "k % 8 > 0 AND k % 9 = 0", "review": "k % 8 = 0", "metrics": "k % 10 = 0 AND k % 3 > 0"}


@query(f"""WITH c AS (SELECT c_custkey AS k FROM customer) SELECT k, concat_ws(' ', {", ".join(f"CASE WHEN {w} THEN '{U.ACTIONS[a]}' END" for a, w in _ADVICE.items())},
CASE WHEN k % 13 = 0 THEN '{U.MORE_SOURCES}arxiv, europe_pmc.' END, CASE WHEN k % 12 = 0 THEN '{U.ACTIONS["synonyms"]}' END, CASE WHEN k % 14 = 0 THEN '{U.ACTIONS["stored"]}' END) AS actions FROM c""")
def run_next_actions(spark, sf):
    k = lambda n: F.col("k") % n
    is0 = lambda n: (k(n) == 0).cast("int")
    c = _t(spark, sf, "customer").select(F.col("c_custkey").alias("k")).withColumns({
        "partial": k(2) == 0, "n_rate_limited": is0(3), "n_cooldown": is0(11), "n_cached_failure": is0(5), "n_provider_problems": is0(7), "discovered": k(4), "trusted": k(6), "queued": k(8), "probed": k(9),
        "metric_pass": k(10), "n_metric_rows": k(3), "missing_sources": F.when(k(13) == 0, F.array(F.lit("arxiv"), F.lit("europe_pmc"))), "single_query": k(12) == 0, "n_failures_stored": is0(14),
    })
    return c.select("k", F.array_join(U.next_actions(c), " ").alias("actions"))


@query("SELECT s_suppkey AS k, format('{:g}', x) AS g FROM (SELECT s_suppkey, s_acctbal * pow(10, s_suppkey % 14 - 7) AS x FROM supplier) UNION ALL SELECT 0, '0'")
def number_formats(spark, sf):
    """Six significant digits without trailing zeros, plain or with an exponent."""
    x = _t(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_acctbal") * F.pow(F.lit(10.0), (F.col("s_suppkey") % 14 - 7).cast("double"))).alias("x"))
    return x.unionAll(spark.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("x")).select(F.col("k").cast(x.schema["k"].dataType), "x")).select("k", M.general(F.col("x")).alias("g"))


def _customers(spark, sf) -> DataFrame:
    return _t(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), (1990 + F.col("c_nationkey")).cast("int").alias("year"))


@query("""WITH k AS (SELECT c_custkey AS k, c_name AS name, 1990 + c_nationkey AS y FROM customer)
SELECT min(k) AS _ord, 'On ' || min_by(name, k) AS title, doi, CAST(min_by(y, k) AS VARCHAR) AS publication_year, 'Venue' AS journal, 'A; B' AS authors, 'one two  two' AS abstract FROM (SELECT *, '10.9/' || (k % 50) AS doi FROM k WHERE k % 3 > 0) GROUP BY doi
UNION ALL SELECT k, 'On ' || name, '', CAST(y AS VARCHAR), 'Venue', 'A; B', 'one two  two' FROM k WHERE k % 3 = 0""")
def openalex_read(spark, sf):
    """Captured pages of works: nested fields, inverted abstracts with a gap, papers distinct by DOI, types filtered."""
    work = F.struct(
        F.concat(F.lit("W"), "k").alias("id"), F.when(F.col("k") % 3 > 0, F.concat(F.lit("https://doi.org/10.9/"), F.col("k") % 50)).alias("doi"), F.concat(F.lit("On "), "name").alias("title"), F.col("year").alias("publication_year"), F.lit("article").alias("type"),
        F.array(*[F.struct(F.struct(F.lit(a).alias("display_name")).alias("author")) for a in ("A", " ", "B")]).alias("authorships"),
        F.struct(F.lit("u").alias("landing_page_url"), F.struct(F.lit("Venue").alias("display_name")).alias("source")).alias("primary_location"),
        F.create_map(F.lit("two"), F.array(F.lit(1), F.lit(3)), F.lit("one"), F.array(F.lit(0))).alias("abstract_inverted_index"),
    )
    other = F.struct(F.concat(F.lit("X"), "k").alias("id"), F.lit(None).cast("string").alias("doi"), F.lit("Skipped").alias("title"), F.lit(1).alias("publication_year"), F.lit("dataset").alias("type"), *[F.lit(None).cast(work_type).alias(n) for n, work_type in (("authorships", "array<struct<author:struct<display_name:string>>>"), ("primary_location", "struct<landing_page_url:string,source:struct<display_name:string>>"), ("abstract_inverted_index", "map<string,array<int>>"))])
    pages = _customers(spark, sf).select(F.col("k").alias("_ord"), F.to_json(F.struct(F.array(work, other).alias("results"))).alias("payload"))
    return J.read("openalex", pages, types=["article"]).select("_ord", "title", "doi", "publication_year", "journal", "authors", "abstract")


@query("""SELECT c_custkey AS _ord, 'T ' || c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '10.8/x' || c_custkey END AS doi, CAST(1990 + c_nationkey AS VARCHAR) AS publication_year,
CASE WHEN c_custkey % 2 = 0 THEN 'V' ELSE 'J' END AS journal, 'Review;Study' AS article_type, 'Ann; Bob' AS authors FROM customer""")
def semantic_scholar_read(spark, sf):
    paper = F.struct(
        F.col("k").cast("string").alias("paperId"), F.concat(F.lit("T "), "name").alias("title"), "year", F.when(F.col("k") % 2 == 0, "V").otherwise("").alias("venue"), F.struct(F.lit("J").alias("name")).alias("journal"),
        F.struct(F.when(F.col("k") % 4 != 0, F.concat(F.lit(" 10.8/X"), "k", F.lit(" "))).alias("DOI")).alias("externalIds"), F.array(F.lit("Review"), F.lit("Study")).alias("publicationTypes"),
        F.array(*[F.struct(F.lit(a).alias("name")) for a in ("Ann", "", "Bob")]).alias("authors"),
    )
    pages = _customers(spark, sf).select(F.col("k").alias("_ord"), F.to_json(F.struct(F.array(paper).alias("data"))).alias("payload"))
    return J.read("semantic_scholar", pages).select("_ord", "title", "doi", "publication_year", "journal", "article_type", "authors")


_EPMC_FORMS = ['["x", "<b>y</b>"]', '"review"', '{"pubType": ["a", "", "b"]}', '{"pubType": "one"}', "null", "[]"]


@query("""WITH c AS (SELECT c_custkey AS k, 1990 + c_nationkey AS y, c_name AS name FROM customer),
r AS (SELECT *, CASE k % 5 WHEN 0 THEN CAST(y AS VARCHAR) WHEN 1 THEN CAST(y AS VARCHAR) WHEN 2 THEN CAST(y + 1 AS VARCHAR) WHEN 3 THEN CAST(y + 2 AS VARCHAR) ELSE '' END AS year FROM c)
SELECT k AS _ord, 'a < b' || name AS title, CASE WHEN k % 3 <> 0 THEN 'P' || k ELSE CAST(k AS VARCHAR) END AS pmid, year AS publication_year, CASE k % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'only' WHEN 2 THEN 'first' ELSE '' END AS best_full_text_url, 'Doe J' AS authors,
CASE k % 6 WHEN 0 THEN 'x;y' WHEN 1 THEN 'review' WHEN 2 THEN 'a;b' WHEN 3 THEN 'one' ELSE 'from list' END AS article_type, 'https://europepmc.org/article/MED/' || k AS landing_page_url, 'MED:' || k AS europe_pmc_id, CAST(k % 50 AS VARCHAR) AS cited_by_count, 'source=MED; isOpenAccess=Y; hasFullText=; inEPMC=N' AS source_note
FROM r WHERE year = '' OR CAST(year AS INT) BETWEEN 1995 AND 2010""")
def europe_pmc_read(spark, sf):
    """Fields that are a text, an object or a list, and their fallbacks; tags and entities out of titles; years rechecked."""
    k = F.col("k")
    kind = F.element_at(F.array(*map(F.lit, _EPMC_FORMS)), (k % 6 + 1).cast("int"))
    year = F.col("year").cast("string")
    dates = F.when(k % 5 == 0, F.format_string('"pubYear": %d', F.col("year"))).when(k % 5 == 1, F.format_string('"pubYear": "", "yearOfPublication": "%s"', year)).when(k % 5 == 2, F.format_string('"firstPublicationDate": {"dateOfPublication": "%d May"}', F.col("year") + 1)).when(k % 5 == 3, F.format_string('"journalInfo": {"printPublicationDate": "", "dateOfPublication": "%d-02"}', F.col("year") + 2)).otherwise('"journalInfo": "n/a"')
    urls = F.when(k % 4 == 0, '{"fullTextUrl": [{"url": "first", "availabilityCode": "S"}, "text", {"url": "", "availabilityCode": "OA"}, {"url": "open", "availabilityCode": "OA"}]}').when(k % 4 == 1, '{"fullTextUrl": {"url": "only"}}').when(k % 4 == 2, '{"fullTextUrl": [{"availabilityCode": "OA"}, {"url": "first"}]}').otherwise('"none"')
    record = F.concat(
        F.lit('{"resultList": {"result": [{"id": '), k, F.lit(', "source": "MED", "title": "a &lt; <i>b</i>'), "name", F.lit('", "authorString": "Doe J.", "isOpenAccess": "Y", "inEPMC": "N", "doi": "10.7/'), k, F.lit('", "citedByCount": '), k % 50,
        F.when(k % 3 != 0, F.concat(F.lit(', "pmid": "P'), k, F.lit('"'))).otherwise(""), F.lit(', "pubType": '), kind, F.lit(', "pubTypeList": {"pubType": ["from", "list"]}, '), dates, F.lit(', "fullTextUrlList": '), urls, F.lit("}]}}"),
    )
    record = F.replace(record, F.lit('["from", "list"]'), F.lit('"from list"'))
    pages = _customers(spark, sf).select(k.alias("_ord"), record.alias("payload"))
    return J.read("europe_pmc", pages, year_from=1995, year_to=2010).select("_ord", "title", "pmid", "publication_year", "best_full_text_url", "authors", "article_type", "landing_page_url", "europe_pmc_id", "cited_by_count", "source_note")


@query("""SELECT c_custkey AS k, '10.6/a' || c_custkey AS doi, 'T ' || c_name AS title, 'C' AS journal, '1; 2' AS issn, CAST(1990 + c_nationkey AS VARCHAR) AS year, CASE WHEN c_custkey % 2 = 0 THEN (1990 + c_nationkey) || '-3' ELSE (1990 + c_nationkey) || '-4-9' END AS date FROM customer""")
def crossref_read(spark, sf):
    """Partial dates: issued, else created; parts are joined as they are."""
    k, dates = F.col("k"), lambda *p: F.struct(F.array(F.array(*p)).alias("date-parts"))
    message = F.struct(
        F.concat(F.lit("10.6/A"), k).alias("DOI"), F.array(F.concat(F.lit("T "), "name"), F.lit("other")).alias("title"), F.array(F.lit("C")).alias("container-title"), F.array(F.lit("1"), F.lit("2")).alias("ISSN"),
        F.when(k % 2 == 0, dates(F.col("year"), F.lit(3))).alias("issued"), dates(F.col("year"), F.lit(4), F.lit(9)).alias("created"),
    )
    return J.crossref(_customers(spark, sf).select("k", F.to_json(F.struct(message.alias("message"))).alias("payload"))).select("k", "doi", "title", "journal", "issn", "year", "date")


@query("""SELECT c_custkey AS _ord, CASE WHEN c_custkey >= 1000 THEN 'skipped_budget' WHEN c_custkey % 4 = 0 THEN 'missing_doi' WHEN c_custkey % 4 = 1 THEN 'ok' WHEN c_custkey % 4 = 2 THEN 'rate_limited' ELSE 'not_found' END AS unpaywall_status,
CASE WHEN c_custkey < 1000 AND c_custkey % 4 = 1 THEN 'true' ELSE '' END AS is_oa, CASE WHEN c_custkey < 1000 AND c_custkey % 4 = 1 THEN 'p' || c_custkey ELSE '' END AS best_oa_pdf_url, CASE WHEN c_custkey < 1000 AND c_custkey % 4 = 1 THEN '2' ELSE '' END AS oa_locations_count FROM customer""")
def open_access_lookup(spark, sf):
    """Status of each row: budget, missing DOI, then the response's own or not found."""
    c = _customers(spark, sf)
    k = F.col("k")
    rows = c.select(k.alias("_ord"), F.when(k % 4 != 0, F.concat(F.lit("10.5/"), k)).otherwise("").alias("doi"))
    best = F.struct(F.concat(F.lit("p"), k).alias("url_for_pdf"), F.lit("publisher").alias("host_type"))
    payload = F.to_json(F.struct(F.lit(True).alias("is_oa"), F.lit("gold").alias("oa_status"), best.alias("best_oa_location"), F.array(F.struct(F.lit("a").alias("url")), F.struct(F.lit("b").alias("url"))).alias("oa_locations")))
    found = c.where("k % 4 in (1, 2)").select(F.concat(F.lit("doi:10.5/"), k).alias("doi"), F.when(k % 4 == 1, "ok").otherwise("rate_limited").alias("status"), F.when(k % 4 == 1, payload).alias("payload"))
    return J.open_access_annotate(rows, found, "someone@example.org", most=1000).select("_ord", "unpaywall_status", "is_oa", "best_oa_pdf_url", "oa_locations_count")


@query("""WITH p AS (SELECT page_id AS k, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root, url FROM pages)
SELECT k AS _ord, CASE WHEN k % 4 = 0 THEN 'missing_url' WHEN k % 4 = 3 THEN 'network_error' ELSE 'landing_page' END AS access_status, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN 'https://doi.org/10.5/' || k ELSE url END AS publisher_probe_start_url,
CASE WHEN k % 4 = 1 THEN root || '/x.pdf' WHEN k % 4 = 2 THEN 'oa.pdf' ELSE '' END AS pdf_url, CASE k % 4 WHEN 0 THEN 'unknown' WHEN 3 THEN 'not_found' ELSE 'found' END AS pdf_status, CASE k % 4 WHEN 1 THEN 'pdf:pdf' WHEN 2 THEN 'pdf:unpaywall_best_oa' ELSE '' END AS publisher_link_hints,
CASE WHEN k % 4 IN (1, 2) THEN 'medium' ELSE 'low' END AS publisher_probe_confidence FROM p""")
def probe_queue(spark, sf):
    """Start URL by DOI, else by URL; the row's own fetch and the links of its page, else the open-access copy."""
    p = _t(spark, sf, "pages")
    k = F.col("page_id") % 4
    queue = p.select(F.col("page_id").alias("_ord"), F.when(k == 1, F.concat(F.lit("10.5/"), "page_id")).otherwise("").alias("doi"), F.when(k.isin(2, 3), F.col("url")).otherwise("").alias("publisher_url"), F.when(k == 2, "oa.pdf").otherwise("").alias("best_oa_pdf_url"))
    start = F.when(k == 1, F.concat(F.lit("https://doi.org/10.5/"), "page_id")).otherwise(F.col("url"))
    shown = F.concat(F.lit("<html>"), F.when(k == 1, '<a href="/x.pdf">PDF</a>').otherwise(""), "html")
    pages = p.where(k.isin(1, 2)).select(F.col("page_id").alias("_ord"), start.alias("start_url"), "url", F.lit("200").alias("status"), F.lit("text/html").alias("content_type"), shown.alias("body"), F.lit("").alias("error"))
    return P.probe(queue, pages, "2024-01-01T00:00:00Z").select("_ord", "access_status", "publisher_probe_start_url", "pdf_url", "pdf_status", "publisher_link_hints", "publisher_probe_confidence")


@query(ORACLES["triage_score_rank"])
def triage_sql(spark, sf):
    """The rows of triage_score_rank from the stages' views, in SQL."""
    V_ = views.register(spark, candidates(spark, sf), _PROFILE, prefix=f"v{uuid.uuid4().hex[:8]}_")
    rows = spark.sql(f"SELECT {', '.join(_RANKED)}, _ord AS _first, triage_rank(triage_priority) AS r, first_number(triage_score) AS n FROM {V_['triaged_candidates']} WHERE normalize_title(title) IS NOT NULL")
    rows = B.with_ord(rows, "r", F.desc("n"), F.lower("title"), "_first")
    return rows.select(F.col("_first").alias("_ord"), *_RANKED, (F.col("_ord") + 1).alias("place"))
