"""Table operators: union by name, budgets, ranks, paged queries, discovery planning and breaker replay."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import status as S, text as T
from ..sources.shared import written
from .triage import rank

#: Parts of a provider's failures.
PARTS = 64
NUMERIC = ("triage_score", "relevance_score", "citation_count", "duplicate_count")


def with_ord(df: DataFrame, *order) -> DataFrame:
    """Dense row numbers from 0 in the given order, without one task for all rows.

    The rows are written once before they are dealt out, since the sample for the bounds would compute them once more. The
    range-sorted rows are written once with their place in their partition, and counts and numbers are both taken
    from that table: sampled bounds and coalesced partitions may differ from one run of a plan to the next. Only the
    counts of the partitions meet on the driver."""
    place = F.monotonically_increasing_id()
    df = written(df, "unordered")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.shiftright(place, 33).cast("int"), "_i": place.bitwiseAND(F.lit((1 << 33) - 1))})
    rows = written(rows, "ordered")
    counts = dict(rows.groupBy("_p").count().collect())
    base, start = [], 0
    for p in range(max(counts, default=-1) + 1):
        base.append(str(start))
        start += counts.get(p, 0)
    known = F.split(F.lit(",".join(base) or "0"), ",").cast("array<long>")
    return rows.withColumn("_ord", F.col("_i") + F.get(known, F.col("_p"))).drop("_p", "_i")


def union_by_name(frames: dict[str, DataFrame]) -> DataFrame:
    """Bag union with the ordered union of columns; missing becomes empty; source_file names the input."""
    parts = [df.select([T.text(F.col(c).cast("string")).alias(c) for c in df.columns if c != "source_file"]).withColumn("source_file", F.lit(name)) for name, df in frames.items() if df.columns]
    if not parts:
        raise ValueError("no input has a header")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).na.fill("")


def row_budget(df: DataFrame, most: int, status: str) -> DataFrame:
    """Rows with _ord beyond the budget are kept and marked; _ord is dense, so no window is needed."""
    return df.withColumn(status, F.when(F.col("_ord") >= most, "skipped_budget").otherwise(T.text(status)))


def rank_in_group(df: DataFrame, *keys, name="discovery_rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy("_ord")))


def enrich(df: DataFrame, provider: str, query_id: str, query: str, run_id: str, retrieved_at: str) -> DataFrame:
    """Discovery columns of one provider call."""
    doi = F.when(T.doi("doi") != "", T.doi("doi")).otherwise("none")
    df = df.withColumn("discovery_rank", F.col("_ord") + 1)
    trace = F.concat(F.lit(f"{provider}:{query_id}:rank"), F.col("discovery_rank").cast("string"), F.lit(":doi="), doi, F.lit(":title="), F.substring(T.text("title"), 1, 80))
    return df.withColumns({"discovery_provider": F.lit(provider), "discovery_query": F.lit(query), "query_id": F.lit(query_id), "run_id": F.lit(run_id), "retrieved_at": F.lit(retrieved_at), "source_trace": trace})


def page(df: DataFrame, filters: dict[str, list[str]] | None = None, sort_by: str | None = None, descending=False, page=1, page_size=20, columns=None, width=0) -> DataFrame:
    """SELECT columns WHERE field IN ... ORDER BY ... LIMIT ... OFFSET; page_size is held to 1..200."""
    for c, allowed in (filters or {}).items():
        if allowed:
            df = df.where(T.strip(c).isin(*allowed))
    if sort_by:
        if sort_by not in df.columns:
            raise ValueError(f"unknown column {sort_by}")
        if sort_by == "triage_priority":
            keys = [rank(sort_by), F.lower("title")]
        else:
            key = T.first_number(F.col(sort_by).cast("string")) if sort_by in NUMERIC else T.text(F.col(sort_by).cast("string"))
            keys = [key.desc() if descending else key.asc()]
        df = df.orderBy(*keys, "_ord")
    size = min(200, max(1, page_size))
    df = df.offset((max(1, page) - 1) * size).limit(size)
    columns = columns or [c for c in df.columns if c != "_ord"][:12]
    return df.select(*[T.truncate(F.col(c).cast("string"), width).alias(c) if width else F.col(c) for c in columns])


def breaker_replay(calls: DataFrame, threshold: int) -> DataFrame:
    """Replay of a provider's calls in order: after ``threshold`` failures every later call is skipped.

    A skipped call adds no failure, so a call is skipped exactly if threshold failures stand before it in
    the raw log. Only the order of each provider's threshold-th failure is needed: it is found in two steps of
    ``threshold`` rows a provider and part, so a provider with most of the calls is no single task. Needs
    provider, q (order, unique for a provider) and status."""
    failed = calls.where(S.is_failure(F.col("status"))).select("provider", "q", F.pmod(F.xxhash64("q"), F.lit(PARTS)).alias("part"))
    first = lambda df, *keys: df.withColumn("n", F.row_number().over(W.partitionBy(*keys).orderBy("q"))).where(F.col("n") <= max(1, threshold))
    last = first(first(failed, "provider", "part"), "provider").where(F.col("n") == max(1, threshold)).select(F.col("provider").alias("_p"), F.col("q").alias("_q"))
    out = calls.join(last, F.col("provider").eqNullSafe(F.col("_p")), "left")
    skipped = (F.col("q") > F.col("_q")) if threshold > 0 else F.lit(True)
    return out.withColumn("replayed", F.when(skipped, "skipped_circuit_breaker").otherwise(F.col("status"))).drop("_p", "_q")


def one_hop(edges: DataFrame, doi: str, forward=True) -> DataFrame:
    """Citing (forward) or cited papers of one paper, from edges (citing, cited)."""
    here, there = ("cited", "citing") if forward else ("citing", "cited")
    label, note = ("citation_of:", "cites ") if forward else ("reference_of:", "cited by ")
    return edges.where(F.col(here) == doi).select(F.col(there).alias("doi"), F.lit(label + doi).alias("discovery_query"), F.lit(note + doi).alias("source_note")).distinct()


def year_filter(df: DataFrame, column: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Unreadable years pass."""
    y = F.when(T.strip(column).rlike(r"^\d{4}"), F.substring(T.strip(column), 1, 4).cast("int"))
    return df.where(y.isNull() | y.between(low if low is not None else 0, high if high is not None else 9999))


def ordered_distinct(df: DataFrame, column: str) -> DataFrame:
    """Distinct trimmed values without blanks and # lines, with the order of their first appearance."""
    x = T.strip(column)
    return df.where((x != "") & ~x.startswith("#")).groupBy(x.alias(column)).agg(F.min("_ord").alias("_ord"))


def estimate_calls(queries: int, sources: list[str], s2_limit: int | None = None) -> int:
    return sum(min(queries, s2_limit) if s == "semantic_scholar" and s2_limit is not None else queries for s in sources)
