"""Candidate rows from the documents table, and web leads from arbitrary headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

BRIDGE = """
SELECT doc_id AS _ord, substr(text, 1, 80) AS title,
       CASE WHEN doc_id % 10 = 0 THEN ''
            WHEN doc_id % 10 < 3 THEN concat('https://doi.org/10.1234/DOC.', CAST(doc_id % 97 AS STRING), '.')
            ELSE concat('doi:10.1234/doc.', CAST(doc_id AS STRING)) END AS doi,
       CAST(2018 + doc_id % 9 AS STRING) AS publication_year, concat('Journal of ', source) AS journal, text AS abstract,
       CASE doc_id % 4 WHEN 0 THEN 'review' WHEN 1 THEN 'original_research' WHEN 2 THEN 'data-paper' ELSE '' END AS article_type,
       source AS discovery_source"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id is the order; no window or sort is needed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.selectExpr(*_expressions())


def _expressions() -> list[str]:
    body, out, depth, cur = BRIDGE.split("SELECT", 1)[1], [], 0, ""
    for c in body:
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += c
    return [*out, cur.strip()]


# Accepted headers of a web lead, in order of preference.
LEAD_HEADERS = {"title": ("title", "result_title", "name"), "url": ("url", "link", "href", "landing_page_url"), "snippet": ("snippet", "description", "abstract", "summary"), "doi": ("doi", "DOI"), "year": ("publication_year", "year", "date")}


def web_leads(df: DataFrame, query: str = "") -> DataFrame:
    """Lead rows: first filled header, DOI from doi, title, url or snippet, year from year, title, snippet or url, in this order. Needs _ord."""
    have = {k: [c for c in v if c in df.columns] for k, v in LEAD_HEADERS.items()}
    pick = {k: T.strip(T.first_filled(*v)) if v else F.lit("") for k, v in have.items()}
    year = T.year(pick["year"], pick["title"], pick["snippet"], pick["url"])  # what the engine says of the page before what its address may hold by chance
    return df.select("_ord", pick["title"].alias("title"), T.find_doi(pick["doi"], pick["title"], pick["url"], pick["snippet"]).alias("doi"), F.coalesce(year.cast("string"), F.lit("")).alias("publication_year"), pick["snippet"].alias("abstract"), pick["url"].alias("landing_page_url"), F.lit("websearch").alias("discovery_source"), F.lit(query).alias("discovery_query"), (F.col("_ord") + 1).cast("string").alias("discovery_rank"), F.lit("lead_unverified").alias("candidate_status"))
