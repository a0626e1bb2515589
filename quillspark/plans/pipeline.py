"""Staged, resumable runs: every stage is a Parquet folder, the manifest records what made it.

A stage is used again only if it was made from the same request, parameters, parent and input tables. Tables enter
the signature by ``fingerprint``, an order-independent digest of their rows. What the manifest says of a
stage (rows, digest, counters) is observed while the stage is written, so no stage is read again to count it."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..sources import storage

MANIFEST = "run_id string, stage string, status string, path string, signature string, rows long, digest string, fields array<string>, counters map<string,long>, at timestamp, _ord long"


def signature(request: dict, budgets=("max_rows", "time_budget")) -> str:
    """Fingerprint of a request; budgets are no part of it, so a run can resume with larger ones."""
    own = {k: v for k, v in request.items() if k not in budgets}
    return hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()


def layered(*configs: dict) -> dict:
    """Later configurations win, nested ones key by key."""
    out: dict = {}
    for c in configs:
        for k, v in c.items():
            out[k] = layered(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def digest_columns(df: DataFrame) -> list[Column]:
    """Aggregates that tell a multiset of rows: their number and the sums of two 64-bit hashes.

    Rows may come in any order and partitioning. Nulls are told from empty values and shifted cells. Nested values are hashed as JSON."""
    parts = []
    for name, kind in sorted(df.dtypes):
        c = F.col(f"`{name}`")
        value = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if kind.startswith(("array<", "map<", "struct<", "variant")) else c
        parts += [c.isNull(), value]
    one = lambda salt: F.sum(F.xxhash64(F.lit(salt), *parts).cast("decimal(38,0)")).cast("string")
    return [F.count(F.lit(1)).alias("_rows"), one(1).alias("_h1"), one(2).alias("_h2")]


def _digest(schema: list, found) -> str:
    """From the names and types of the columns and the values of ``digest_columns``."""
    return hashlib.sha256(json.dumps([sorted(schema), found["_rows"], found["_h1"], found["_h2"]]).encode()).hexdigest()


def fingerprint(df: DataFrame) -> str:
    """Digest of a table's column names, types and rows, whatever their order: one aggregation."""
    return _digest(df.dtypes, df.agg(*digest_columns(df)).first().asDict())


@dataclass
class Run:
    spark: SparkSession
    folder: str
    run_id: str
    request: dict = field(default_factory=dict)
    stop_after: str | None = None

    def _manifest(self) -> DataFrame:
        if not storage.exists(self.spark, f"{self.folder}/manifest"):
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def records(self) -> DataFrame:
        return self._manifest()

    def last(self, stage: str):
        """The newest record of a stage, or None."""
        return next(iter(self._manifest().where(F.col("stage") == stage).orderBy(F.desc("_ord")).limit(1).collect()), None)

    def record(self, stage: str, status: str, path: str = "", sig: str = "", rows: int | None = None, digest: str = "", fields=(), counters: dict | None = None) -> None:
        """Append a record; records of all runs in a folder are ordered by their time in nanoseconds."""
        row = (self.run_id, stage, status, path, sig, rows, digest, list(fields), counters or {}, time.time_ns())
        df = self.spark.createDataFrame([row], MANIFEST.replace("at timestamp, ", ""))
        df.withColumn("at", F.timestamp_micros(F.expr("_ord div 1000"))).select(*[x.split()[0] for x in MANIFEST.split(", ")]).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def _observed(self, df: DataFrame, path: str, counters: dict[str, Column] | None) -> tuple[dict, dict[str, int]]:
        """Write a table once; the values of ``digest_columns`` and of the counters are observed in the same job."""
        seen, extra = Observation(), {f"c{i}": c for i, c in enumerate((counters or {}).values())}
        df.observe(seen, *digest_columns(df), *[c.cast("long").alias(k) for k, c in extra.items()]).write.mode("overwrite").parquet(path)
        got = seen.get
        return got, {k: got[f"c{i}"] or 0 for i, k in enumerate(counters or {})}

    def write(self, df: DataFrame, path: str, counters: dict[str, Column] | None = None) -> tuple[int, str, dict[str, int]]:
        """Write a table once: (rows, digest, counters). A counter is an aggregate that gives a whole number."""
        got, counted = self._observed(df, path, counters)
        return got["_rows"], _digest(df.dtypes, got), counted

    def _signed(self, name: str, params: dict | None, parent: str, inputs: dict[str, str] | None) -> tuple[str, str, DataFrame | None]:
        """(signature, path, the table of a stage that can be used again or None)."""
        sig = signature({"request": signature(self.request), "stage": name, "params": params or {}, "parent": parent, "inputs": inputs or {}})
        last = self.last(name)
        done = last and last.status in ("completed", "reused") and last.signature == sig
        if done and storage.exists(self.spark, f"{last.path}/_SUCCESS"):
            return sig, last.path, self.spark.read.parquet(last.path)
        return sig, f"{self.folder}/{name}-{sig[:16]}", None

    def stage(self, name: str, df_of, params: dict | None = None, parent: str = "", inputs: dict[str, str] | None = None, counters=None) -> tuple[DataFrame, str]:
        """Reuse the stage if its latest record is complete, its signature the same and its files there; else run it.

        inputs: fingerprints of the tables that it reads besides its parent. counters: function of the stage's table that
        gives named aggregates, recorded with it."""
        sig, path, old = self._signed(name, params, parent, inputs)
        if old is not None:
            return old, sig
        df = df_of()
        rows, digest, counted = self.write(df, path, counters(df) if counters else None)
        self.record(name, "completed", path, sig, rows, digest, df.columns, counted)
        return self.spark.read.schema(df.schema).parquet(path), sig

    def batched(self, name: str, source: DataFrame, f, every: int, params: dict | None = None, parent: str = "", inputs: dict[str, str] | None = None, counters=None) -> tuple[DataFrame, str]:
        """A stage of rows that do not depend on each other, checkpointed after every ``every`` rows.

        The source is written in files of that many rows; a stream takes one file at a time and writes f(batch) to a folder of
        that batch, which a repeated batch replaces. A run that was killed goes on with the first batch that was not finished;
        the result is that of one run. Counters must be sums."""
        sig, path, old = self._signed(name, params, parent, inputs)
        if old is not None:
            return old.drop("batch"), sig
        if not storage.exists(self.spark, f"{path}-source/_SUCCESS"):
            source.write.mode("overwrite").option("maxRecordsPerFile", every).parquet(f"{path}-source")
        run = self

        def one(batch: DataFrame, epoch: int) -> None:
            df = f(batch)
            got, counted = run._observed(df, f"{path}/batch={epoch}", counters(df) if counters else None)
            run.record(name, "partial", f"{path}/batch={epoch}", sig, got["_rows"], json.dumps({**got, "schema": df.dtypes}, default=str), df.columns, counted)

        stream = self.spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}-source")
        stream.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(one).start().awaitTermination()
        parts = {r.path: r for r in self._manifest().where((F.col("signature") == sig) & (F.col("status") == "partial")).orderBy("_ord").collect()}
        if not parts:  # no rows, so no batch
            one(source.limit(0), 0)
            parts = {r.path: r for r in self._manifest().where((F.col("signature") == sig) & (F.col("status") == "partial")).collect()}
        seen = [json.loads(r.digest) for r in parts.values()]
        total = {k: str(sum(int(s[k] or 0) for s in seen)) for k in ("_h1", "_h2")} | {"_rows": sum(s["_rows"] for s in seen)}
        total |= {k: None for k in ("_h1", "_h2") if not total["_rows"]}
        counted = {k: sum(r.counters[k] for r in parts.values()) for k in next(iter(parts.values())).counters}
        storage.write_text(self.spark, f"{path}/_SUCCESS", "")
        self.record(name, "completed", path, sig, total["_rows"], _digest([tuple(x) for x in seen[0]["schema"]], total), next(iter(parts.values())).fields, counted)
        return self.spark.read.parquet(path).drop("batch"), sig

    def run(self, stages, start: DataFrame, inputs: dict[str, str] | None = None) -> DataFrame:
        """stages: (name, function of a DataFrame, parameters), in order; ends early after ``stop_after``. ``start`` is an input of the first."""
        df, sig = start, signature({"request": signature(self.request), "start": fingerprint(start), "inputs": inputs or {}})
        for name, f, params in stages:
            df, sig = self.stage(name, lambda df=df, f=f, params=params: f(df, **params), params, sig)
            if name == self.stop_after:
                break
        return df
