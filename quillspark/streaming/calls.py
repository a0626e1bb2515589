"""Control of provider calls in their order: cooldown after rate limits, circuit breaker, cached failures.

State lives in ``transformWithState`` by provider: for each run its failures and the end of its cooldown, and over all runs
the failures of queries with the end of their time to live. A call that would be skipped adds nothing, as its outcome
is never known; every other call counts. The state and what was decided are kept by the stream's checkpoint, so a
later batch of calls goes on where the last one ended, also after a lost driver.

Time is that of the calls (column ``at``), not of the clock: a replay decides the same. Entries that have ended are
dropped when their provider is next called. A provider's calls of one micro-batch are put in order in its task; a batch is a plan."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import status as S, text as T

CALL = "run_id string, provider string, query_id string, query string, q long, at timestamp, max_results int, status string, returned_count int, error string, http_status string, transient_error string, retry_after_seconds string"
DECIDED = f"{CALL}, made boolean, cache_status string, cache_key string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _wait(seconds: float) -> str:
    return f"{max(0.0, seconds):.3f}".rstrip("0").rstrip(".")


class CallControl(StatefulProcessor):
    """threshold: failures of a provider in a run after which it is not called (None: never)."""

    def __init__(self, threshold: int | None):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "run_id string", "failures int, until double")
        self.failed = handle.getMapState("failed", "cache_key string", "until double, status string, error string, http_status string, transient_error string, retry_after_seconds string, action string")

    def handleInputRows(self, key: Any, rows: Iterator, timerValues: Any) -> Iterator:
        import pandas as pd

        calls = pd.concat(list(rows)).sort_values(["at_s", "q"], kind="stable")
        first = float(calls["at_s"].iloc[0])
        for k, v in list(self.failed.iterator() or ()):
            if v[0] <= first:
                self.failed.removeKey(k)
        runs = {k[0]: v for k, v in (self.runs.iterator() or ())}
        out = []
        for c in calls.to_dict("records"):
            failures, until = runs.get(c["run_id"], (0, 0.0))
            cached = self.failed.getValue((c["cache_key"],)) if self.failed.containsKey((c["cache_key"],)) else None
            cached = cached if cached is not None and cached[0] > c["at_s"] else None
            c["made"], c["cache_status"] = False, ""
            skipped = {"returned_count": 0, "http_status": "", "transient_error": "", "retry_after_seconds": ""}
            own, c["cache_key"] = c["cache_key"], ""
            if until > c["at_s"]:
                left = _wait(until - c["at_s"])
                c |= skipped | {"status": "skipped_rate_limit_cooldown", "retry_after_seconds": left, "error": f"Skipped because this provider is cooling down for about {left or '0'}s after a rate limit."}
            elif self.threshold is not None and failures >= self.threshold:
                c |= skipped | {"status": "skipped_circuit_breaker", "error": f"Skipped after {failures} failed provider call(s) in this discovery run."}
            elif cached is not None:
                c |= skipped | {"status": "skipped_cached_provider_failure", "http_status": cached[3], "transient_error": cached[4], "retry_after_seconds": cached[5], "cache_status": "hit", "cache_key": own}
                c["error"] = f"Skipped due to cached provider failure: status={cached[1]}; next_action={cached[6]}; error={cached[2]}"
            else:
                c["made"] = True
                runs[c["run_id"]] = (failures + int(c["fails"]), c["at_s"] + c["wait_s"] if c["limited"] else until)
                if c["ttl_s"] >= 0:
                    self.failed.updateValue((own,), (c["at_s"] + c["ttl_s"], c["status"], c["error"], c["http_status"], c["transient_error"], c["retry_after_seconds"], c["action"]))
                    c["cache_status"], c["cache_key"] = "store", own
            out.append(c)
        for k, v in runs.items():
            self.runs.updateValue((k,), v)
        yield pd.DataFrame(out)[[x.split()[0] for x in DECIDED.split(", ")]]

    def close(self) -> None:
        pass


def control(calls: DataFrame, threshold: int | None = None, cooldown_seconds: float = 60.0, failure_ttl_seconds: float | None = 300.0, scope: str = "") -> DataFrame:
    """Decisions over a stream of calls with the columns of CALL: the outcome is what the call gave, or would have given.

    scope: what besides provider, query and max_results tells requests apart (years, types). failure_ttl_seconds None: no cached failures."""
    status, header = T.text("status"), T.strip("retry_after_seconds")
    own = F.when(header.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), header.cast("double"))
    wait = F.greatest(F.lit(0.0), F.coalesce(own, F.lit(float(cooldown_seconds))))
    limited = S.classify(status) == "rate_limited"
    transient = F.when(T.strip("transient_error") != "", F.lower(T.strip("transient_error")) == "true")
    stored = S.is_cacheable_failure(status, F.coalesce("returned_count", F.lit(0)) > 0, transient) & F.lit(failure_ttl_seconds is not None)
    key = F.concat(F.lit("failure:"), F.sha2(F.to_json(F.struct(F.array("provider", T.text("query"), F.lit(scope), F.coalesce(F.col("max_results").cast("string"), F.lit(""))).alias("parts"))), 256))
    texts = ("status", "error", "http_status", "transient_error", "retry_after_seconds", "query", "query_id", "run_id")
    rows = calls.select(
        *[T.text(c).alias(c) if c in texts else F.coalesce(c, F.lit(0)).alias(c) if c in ("returned_count", "max_results") else F.col(c) for c in (x.split()[0] for x in CALL.split(", "))], F.lit(False).alias("made"), F.lit("").alias("cache_status"), key.alias("cache_key"),
        F.col("at").cast("double").alias("at_s"), S.is_failure(status).alias("fails"), limited.alias("limited"), wait.alias("wait_s"), S.provider_action(status, header).alias("action"),
        F.when(stored, F.when(limited, wait).otherwise(F.lit(float(max(0.0, failure_ttl_seconds or 0))))).otherwise(-1.0).alias("ttl_s"),
    )
    return rows.groupBy("provider").transformWithStateInPandas(statefulProcessor=CallControl(threshold), outputStructType=DECIDED, outputMode="Append", timeMode="None")


def run(calls: DataFrame, folder: str, threshold: int | None = None, cooldown_seconds: float = 60.0, failure_ttl_seconds: float | None = 300.0, scope: str = "") -> DataFrame:
    """Append a batch of calls to the folder and decide all that are new; returns every decision of the folder so far, with class and action.

    The folder keeps calls, state and decisions; those of its former batches stay as they are."""
    spark: SparkSession = calls.sparkSession
    names = [x.split()[0] for x in CALL.split(", ")]
    kinds = dict(x.split() for x in CALL.split(", "))
    given = [F.col(c).cast(kinds[c]).alias(c) if c in calls.columns else F.lit(None).cast(kinds[c]).alias(c) for c in names]
    calls.select(*given).write.mode("append").parquet(f"{folder}/calls")
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = control(spark.readStream.schema(CALL).parquet(f"{folder}/calls"), threshold, cooldown_seconds, failure_ttl_seconds, scope)
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/decided")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old) if old else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.schema(DECIDED).parquet(f"{folder}/decided")
    return out.withColumns({"status_class": S.classify(F.col("status")), "next_action": S.provider_action(F.col("status"), F.col("retry_after_seconds"))})
