"""The stages in SQL: a temporary view for each, and SQL functions for the keys that queries join and filter by.

Views are lazy plans, so a query over one is optimised together with the stage: columns it does not read are not
computed, and its filters move below the stage where that is right. Functions are SQL expressions too, not Python."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import concepts as C
from ..operators import triage as G
from .curate import stages

#: name(parameters) RETURNS type: expression. They say what the Column functions of the same purpose say (tests compare them).
FUNCTIONS = {
    "normalize_title(x STRING) RETURNS STRING": r"trim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9]+', ' '))",
    "normalize_issn(x STRING) RETURNS STRING": r"regexp_replace(upper(coalesce(x, '')), '[^0-9X]', '')",
    "normalize_journal(x STRING) RETURNS STRING": r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(x, '')), '&amp;|&', ' and '), '[^a-z0-9]+', ' '), '\\b(the|journal|of)\\b', ' '), ' +', ' '))",
    "first_number(x STRING) RETURNS DOUBLE": r"CASE WHEN trim(coalesce(x, '')) RLIKE '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$' THEN CAST(trim(x) AS DOUBLE) ELSE 0.0 END",
    "triage_rank(x STRING) RETURNS INT": "CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.RANK.items()) + " ELSE 99 END",
}


def register(spark: SparkSession, candidates: DataFrame, profile: C.Profile | None = None, priorities=("high", "medium", "needs_review"), prefix: str = "", **inputs) -> dict[str, str]:
    """Temporary views ``candidates`` and one for each stage that the inputs allow (see ``curate.stages``), and the functions; stage -> view."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    candidates.createOrReplaceTempView(f"{prefix}candidates")
    names, df = {"candidates": f"{prefix}candidates"}, candidates
    for name, f, params, _ in stages(profile or C.Profile(), priorities, **inputs):
        df = f(df, **params)
        df.createOrReplaceTempView(f"{prefix}{name}")
        names[name] = f"{prefix}{name}"
    return names
