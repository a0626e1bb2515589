"""Discovery as a stage: the plan's calls over captured pages, their control, the trace and the candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import planning as N
from ..sources import pages, payloads as P
from ..streaming import calls as C

# Columns of the trace, in order.
TRACE = ("discovery_run_id", "provider", "query_id", "query", "year_from", "year_to", "max_results", "returned_count", "status", "status_class", "http_status", "transient_error", "retry_after_seconds", "next_action", "cache_status", "cache_key", "error", "started_at")
#: A plan of more calls is joined instead of broadcast.
BROADCAST_CALLS = 100_000


def planned(queries: DataFrame, providers, max_results=100, semantic_query_limit=None, semantic_max_results=None) -> DataFrame:
    """(query_id, query, provider, q, max_results): the calls to make, in order; queries: query and _ord."""
    rows = N.calls(N.query_ids(queries.select("query", "_ord")), P.providers(list(providers)), semantic_query_limit, max_results, semantic_max_results)
    return rows.where("not skipped").select("query_id", "query", "provider", F.col("q").cast("long").alias("q"), F.col("max_results").cast("int").alias("max_results"))


def discover(spark: SparkSession, capture: str, queries: DataFrame, folder: str, run_id: str, providers=("openalex",), year_from=None, year_to=None, types="article", max_results=100, semantic_query_limit=None, semantic_max_results=None, threshold=None, cooldown_seconds=60.0, failure_ttl_seconds: float | None = 300.0, retrieved_at: str = "1970-01-01T00:00:00Z", seconds_per_call: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(candidates, trace) of the queries (query, _ord) at every provider, from a capture (see ``sources.pages``).

    Calls happen ``seconds_per_call`` apart from retrieved_at on, as far as cooldown, breaker and cached failures go, which ``folder``
    keeps between runs. Only calls that were made give candidates. A call that was planned but not captured is an error."""
    names = P.providers(list(providers))
    request = {"year_from": year_from, "year_to": year_to, "types": types, "max_results": max_results, "semantic_max_results": semantic_max_results}
    plan = planned(queries, names, max_results, semantic_query_limit, semantic_max_results)
    plan = F.broadcast(plan) if plan.limit(BROADCAST_CALLS + 1).count() <= BROADCAST_CALLS else plan
    outcome = pages.load(spark, capture, providers=names, what="calls", **request)
    known = F.col("status").isNotNull()
    rows = plan.join(outcome, ["provider", "query_id"], "left").withColumns({
        "run_id": F.lit(run_id), "at": F.to_timestamp(F.lit(retrieved_at)) + F.make_dt_interval(secs=F.col("q") * F.lit(float(seconds_per_call))),
        "status": F.coalesce("status", F.lit("error")), "error": F.when(known, F.col("error")).otherwise("no response was captured"), "returned_count": F.coalesce("returned_count", F.lit(0)),
    })
    scope = f"{year_from or ''}|{year_to or ''}|{types or ''}"
    decided = C.run(rows, f"{folder}/calls", threshold, cooldown_seconds, failure_ttl_seconds, scope).where(F.col("run_id") == run_id)
    # a run that is started again has its calls decided again: the first decision of a call holds
    first = decided.groupBy("provider", "query_id").agg(F.min_by(F.struct(*[c for c in decided.columns if c not in ("provider", "query_id")]), "q").alias("r")).select("provider", "query_id", "r.*")
    trace = first.select(
        F.col("run_id").alias("discovery_run_id"), "provider", "query_id", "query", F.lit(str(year_from or "")).alias("year_from"), F.lit(str(year_to or "")).alias("year_to"),
        *[F.col(c).cast("string").alias(c) if c in ("max_results", "returned_count") else F.col(c) for c in TRACE[6:-1]], F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("started_at"), F.col("q").alias("_ord"), "made",
    )
    made = trace.where("made and cast(returned_count as int) > 0").select(F.col("provider").alias("discovery_provider"), "query_id", "query", F.col("_ord").alias("_q"))
    found = pages.discovered(spark, capture, names, **request)
    found = found.join(F.broadcast(made) if plan.count() <= BROADCAST_CALLS else made, ["discovery_provider", "query_id"])
    return enriched(found, run_id, retrieved_at), trace


def enriched(found: DataFrame, run_id: str, retrieved_at: str) -> DataFrame:
    """Discovery columns of rows with discovery_provider, query_id, query, _q (place of the call) and discovery_rank; _ord is their order over all calls."""
    own = F.col("discovery_source") if "discovery_source" in found.columns else F.lit("")
    rank = F.col("discovery_rank").cast("string")
    trace = F.concat(F.col("discovery_provider"), F.lit(":"), F.col("query_id"), F.lit(":rank"), rank, F.lit(":doi="), F.coalesce(F.nullif(T.text("doi"), F.lit("")), F.lit("none")), F.lit(":title="), F.substring(T.text("title"), 1, 80))
    return found.withColumns({
        "discovery_source": T.first_filled(own, "discovery_provider"), "discovery_query": F.col("query"), "discovery_query_id": F.col("query_id"), "source_trace": trace, "discovery_run_id": F.lit(run_id), "retrieved_at": F.lit(retrieved_at),
        "_ord": F.col("_q") * (1 << 32) + F.col("discovery_rank").cast("long"), "discovery_rank": rank,
    }).drop("query", "query_id", "_q")


def failed(statuses: dict[str, int], candidates: int) -> bool:
    """Strict discovery fails if some call ended in neither rows nor an empty result and there are no candidates, or if all did."""
    bad = {s for s in statuses if s not in ("ok", "empty_result")}
    return bool(bad) and (not candidates or bad == set(statuses))
