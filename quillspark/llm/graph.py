"""Connected components and fixed-size membership bitmaps, as used by the near-duplicate operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .store import table


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) with comp the smallest id reachable, for every end of ``edges`` (a, b).

    Minimum-label propagation with pointer jumping: a number of rounds logarithmic in the diameter,
    each a join and an aggregation with map-side combine; labels are written and read again, never collected."""
    both = table(edges.select("a", "b").unionAll(edges.selectExpr("b as a", "a as b")).where("a <> b").distinct(), "graph-edges")
    label = table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "graph-labels")
    while True:
        near = both.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("c"))
        step = label.join(near, "id").select("id", "comp", F.least("comp", "c").alias("c"))
        jump = step.join(label.select(F.col("id").alias("c"), F.col("comp").alias("cc")), "c").select("id", "comp", F.least("c", "cc").alias("c"))
        new = table(jump, "graph-labels")
        if new.where("c <> comp").isEmpty():
            return label
        label = new.select("id", F.col("c").alias("comp"))


def extended(known: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp) when ``edges`` (a, b) join the components ``known`` (id, comp): only edges between different ones are walked again."""
    new = edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))).distinct().join(known, "id", "left_anti")
    label = table(known.select("id", "comp").unionAll(new.select("id", F.col("id").alias("comp"))), "graph-labels")
    ends = edges.join(label.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(label.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
    merged = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("comp"), F.col("comp").alias("c"))
    return table(label.join(merged, "comp", "left").select("id", F.coalesce("c", "comp").alias("comp")), "graph-labels")


BITMAP_BITS = 26


def bitmap(ids: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Fixed-size bitmap (2**bits bits) of the hashed values of the columns of ``ids``.

    It only spares work: what it lets through is checked exactly afterwards. Its size never grows."""
    h = slot(*ids.columns, bits=bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    rows = ids.select(F.shiftright(h, 6).cast("int").alias("w"), one.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def in_bitmap(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """h: pmod(xxhash64(id), 2**bits) as computed by Spark."""
    return (words[h >> 6] >> (h & 63)) & 1 == 1


def slot(*columns, bits: int = BITMAP_BITS):
    return F.pmod(F.xxhash64(*columns), F.lit(1 << bits))
