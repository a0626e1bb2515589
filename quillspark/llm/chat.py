"""Operator 6 [native]: cumulative-snapshot collapse of logged conversations, then chat rendering.

A conversation whose turns are a proper prefix of another conversation's turns is a snapshot of it and
goes; of equal conversations the one with the smallest id stays. Every turn gets two 64-bit hashes of
(position, role, text); the rolling hash of a prefix is their running XOR, so a conversation's own
hash is an aggregate with map-side combine. An anti-join of conversations against the distinct keys
(length, hashes) of all proper prefixes leaves the maximal ones, whose turns are then rendered.

Positions are found in blocks of BLOCK turn numbers: a window inside a block, and offsets from the much
smaller table of blocks. So one conversation that holds a third of all rows is spread over many tasks,
and no group is ever collected. Texts are shuffled only by the last join, which is by conversation and block
too: the few columns of a maximal conversation go to each of its blocks.

Edge cases: rows without conv_id are left out. Null role or text is a value of its own and renders as
empty. Turns are ordered by turn (nulls first), then by the MD5 digest of role and text, which decides ties;
repeated rows are repeated turns. Turns that all share one number are one block. Empty tables give no row.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .store import table

BLOCK = 256
TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def _block() -> Column:
    """Number of the block of a turn; null for turns without a number."""
    return F.floor(F.col("turn") / BLOCK)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, block, pos (from 1), h1, h2 of the prefix that ends there, and n, the conversation's length."""
    role, text = F.coalesce(F.concat(F.lit("="), "role"), F.lit("")), F.coalesce(F.concat(F.lit("="), "text"), F.lit(""))
    rows = turns.where("conv_id is not null").select("conv_id", "turn", _block().alias("block"), F.md5(F.concat(role, F.lit("\x01"), text)).alias("t"))
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "t")))
    blocks = rows.groupBy("conv_id", "block").agg(F.count("*").alias("c"))
    before = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("skip"), F.sum("c").over(W.partitionBy("conv_id")).alias("n"))
    rows = rows.join(blocks.withColumnsRenamed({"conv_id": "c2", "block": "b2"}), (F.col("conv_id") == F.col("c2")) & F.col("block").eqNullSafe(F.col("b2")))
    rows = rows.select("conv_id", "block", "rn", "n", (F.col("skip") + F.col("rn")).alias("pos"), "t")
    rows = rows.withColumns({"e1": F.xxhash64("pos", "t"), "e2": F.xxhash64("t", "pos")}).drop("t")
    run = W.partitionBy("conv_id", "block").orderBy("rn").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"x1": F.bit_xor("e1").over(run), "x2": F.bit_xor("e2").over(run)})
    ends = rows.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("y1"), F.bit_xor("e2").alias("y2"))
    ends = ends.select(F.col("conv_id").alias("c2"), F.col("block").alias("b2"), *[F.coalesce(F.bit_xor(f"y{i}").over(before), F.lit(0)).alias(f"y{i}") for i in (1, 2)])
    rows = rows.join(ends, (F.col("conv_id") == F.col("c2")) & F.col("block").eqNullSafe(F.col("b2")))
    return rows.select("conv_id", "block", "pos", "n", F.col("x1").bitwiseXOR(F.col("y1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("y2")).alias("h2"))


def _maximal(rows: DataFrame) -> DataFrame:
    whole = rows.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = rows.where("pos < n").select(F.col("pos").alias("n"), "h1", "h2").distinct()
    return whole.join(prefixes, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies: conversations that are no proper prefix of another, one of each set of equal ones."""
    return _maximal(table(prefix_hashes(turns), "chat-prefixes"))


def collapse(turns: DataFrame) -> DataFrame:
    """Rendered turns of the maximal conversations: conv_id, turn, rendered, n_turns, n_copies."""
    a, b, c = map(F.lit, TEMPLATE)
    rows = table(prefix_hashes(turns), "chat-prefixes")
    kept = rows.select("conv_id", "block").distinct().join(_maximal(rows), "conv_id").withColumnsRenamed({"conv_id": "c2", "block": "b2"})
    shown = turns.select("conv_id", "turn", _block().alias("block"), F.concat(a, F.coalesce("role", F.lit("")), b, F.coalesce("text", F.lit("")), F.lit("\n"), c).alias("rendered"))
    return shown.join(kept, (F.col("conv_id") == F.col("c2")) & F.col("block").eqNullSafe(F.col("b2"))).select("conv_id", "turn", "rendered", "n_turns", "n_copies")


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce('=' || role, '') AS r, coalesce('=' || text, '') AS x,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce('=' || role, '') || chr(1) || coalesce('=' || text, ''))) AS pos,
        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, any_value(n) AS n, string_agg(md5(r || chr(1) || x), '' ORDER BY pos) AS h FROM t GROUP BY conv_id),
d AS (SELECT h, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY h, n),
k AS (SELECT d.conv_id, d.n, d.n_copies FROM d WHERE NOT EXISTS (
        SELECT 1 FROM d b WHERE b.n > d.n AND substr(b.h, 1, 32) = substr(d.h, 1, 32) AND starts_with(b.h, d.h)))
SELECT t.conv_id, t.turn, '<|' || substr(t.r, 2) || '|>' || chr(10) || substr(t.x, 2) || chr(10) || '<|end|>' || chr(10) AS rendered,
       k.n AS n_turns, k.n_copies FROM t JOIN k ON t.conv_id = k.conv_id"""
