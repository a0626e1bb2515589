"""Operator 8: embedding near-duplicates with spherical-cap filters.

Unit vectors are turned by a seeded random rotation first, so that their energy is even over the
dimensions however it lies in the input. Filter directions form a random product code: the dimensions
are cut into two parts, each with a codebook of Gaussian codewords; a direction is one codeword of each
part. A vector is decoded to all directions whose inner product with it exceeds a threshold, and to a
least number of best ones, found from the scores of the parts without touching all directions. Vectors
that share (label, dimension, direction) are compared exactly, in double precision.

The code grows with the vectors: PER_VECTOR directions for each vector of the largest label, so a bucket's
chance members, and with them the comparisons of a vector, grow far slower than the vectors (with Gaussian
vectors below the square root); the directions a vector is decoded to grow with the eighth root of the code,
which holds the recall. Codewords are held to MOST a part for memory; beyond that only comparisons grow.

Equal vectors are collapsed first and counted with their number. A bucket is dealt into blocks of about
BLOCK vectors and every pair of blocks is a task of its own, so a hot bucket spreads. A task multiplies
its two blocks (many small buckets are taken in one vectorised step), takes a link only in the smallest
direction that both ends share (so once), and returns per vector with such links their number and the smallest
number it reaches by them: output is linear in the input, whatever the number of links. Components are formed from these.

Recall of the filters at the threshold is above 0.99 at every size; every reported link is exact.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component, and rows without a
label, link with nothing. Vectors are scaled by their largest component before their length is taken, so
tiny and huge ones do not under- or overflow. Rows that repeat a vec_id are vectors of their own: they are
answered one by one and only linked by what they hold. Rows without vec_id are compared like others; their
component_id is null if no vector with an id is reached. Vectors of different lengths are not compared. An
empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from math import log2
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .store import arrow, cut, table

COSINE = 0.93
SEED = 20240229
#: Directions for each vector of the largest label, and codewords of a part at least and at most.
PER_VECTOR, FEWEST, MOST = 180, 256, 1 << 17
#: Directions a vector is decoded to on average with a code of 2**20, and the share of that it gets at least.
FILTERS, LEAST = 64, 2 / 3
#: Vectors of fewer dimensions are turned into a space of so many.
WIDE = 64
BLOCK = 512
#: Groups of at most so many vectors are compared together in one vectorised step.
SMALL = 32
#: Directions that a task compares at once.
SLICE = 4_096


class Code(NamedTuple):
    """words: codewords of each part; mean and least: directions a vector is decoded to."""

    words: int
    mean: int
    least: int

    def number(self) -> pa.DataType:
        """Of a direction."""
        return pa.int32() if self.words <= 1 << 15 else pa.int64()


def code(vectors: int) -> Code:
    """The code for so many vectors of one label."""
    words = FEWEST
    while words * words < PER_VECTOR * vectors and words < MOST:
        words *= 2
    mean = round(FILTERS * 2 ** max(0.0, (2 * log2(words) - 20) / 8))
    return Code(words, mean, round(LEAST * mean))


@lru_cache(8)
def _books(dim: int, words: int, mean: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Codewords of both parts, and the threshold of a standard normal that ``mean`` directions exceed on average."""
    r = np.random.default_rng([SEED, dim])
    half = max(1, dim // 2)
    a, b = r.standard_normal((words, half)), r.standard_normal((words, dim - half))
    return a, b, NormalDist().inv_cdf(1 - mean / words**2)


@lru_cache(8)
def _rotation(dim: int) -> np.ndarray:
    """dim orthonormal random rows of WIDE elements at least, so that few dimensions spread over both parts too."""
    wide = max(dim, WIDE)
    q, r = np.linalg.qr(np.random.default_rng([SEED, dim]).standard_normal((wide, wide)))
    return (q * np.where(np.diag(r) < 0, -1.0, 1.0))[:dim]


def _best(s: np.ndarray, t: np.ndarray, least: int) -> np.ndarray:
    """The ``least`` directions of largest inner product; each is among the ``least`` best codewords of both parts."""
    i, j = (np.argpartition(-v, least - 1)[:least] for v in (s, t))
    top = np.argpartition(-(s[i, None] + t[None, j]).ravel(), least - 1)[:least]
    return i[top // least] * len(t) + j[top % least]


def decode(x: np.ndarray, c: Code) -> list[np.ndarray]:
    """Direction numbers exceeding the threshold, and the c.least best ones at least, ascending, for each unit row of x."""
    x = x @ _rotation(x.shape[1])
    a, b, level = _books(x.shape[1], c.words, c.mean)
    out = []
    for lo in range(0, len(x), 64):
        one, two = x[lo : lo + 64, : a.shape[1]] @ a.T, x[lo : lo + 64, a.shape[1] :] @ b.T
        for s, t in zip(one, two):
            # only codewords that reach the level with the best one of the other part
            i, j = np.flatnonzero(s >= level - t.max()), np.flatnonzero(t >= level - s.max())
            row, col = np.nonzero(s[i, None] + t[None, j] >= level)
            found = i[row] * c.words + j[col]
            out.append(np.sort(found if len(found) >= c.least else _best(s, t, c.least)))
    return out


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each dimension among valid vectors."""
    column = column.cast(pa.list_(pa.float64()))
    n = column.value_lengths().fill_null(0).to_numpy()
    out = []
    for dim in np.unique(n[n > 0]):
        at = np.flatnonzero(n == dim)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((at, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def _filters(c: Code):
    def run(batches):
        for b in batches:
            lists: list = [None] * b.num_rows
            for at, x in _matrix(b.column(0)):
                for i, f in zip(at, decode(x, c)):
                    lists[i] = f
            yield pa.record_batch([*b.columns[1:], b.column(0), pa.array(lists, pa.list_(c.number()))], names=["k", "group", "w", "x", "filters"])

    return run


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().fill_null(0).to_numpy().astype(np.int64)


def _spread(values, lengths, rows):
    """(index into rows, value): the lists of the given rows, one after the other."""
    n, begin = lengths[rows], np.cumsum(lengths) - lengths
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[rows], n)
    return np.repeat(np.arange(len(rows)), n), values[at]


def _pairs(begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b), a < b, of rows inside the groups that begin at begin."""
    pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows, k = pos + np.repeat(begin, size), np.repeat(size, size) - 1 - pos
    a = np.repeat(rows, k)
    return a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(k) - k, k)


def _small(cosine, t, x, begin, size):
    """Links of many groups of at most SMALL rows at once; x holds the unit vector of each row."""
    ids, w, f, group, side, cross = (t[c].to_numpy() for c in ("k", "w", "h", "group", "block", "cross"))
    a, b = _pairs(begin, size)
    ok = (f[a] == f[b]) & (group[a] == group[b]) & (~cross[a] | (side[a] != side[b]))
    a, b = a[ok], b[ok]
    ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
    a, b = a[ok], b[ok]
    if not len(a):
        return None
    values, lengths = _ragged(t["before"])
    (i, u), (j, v) = _spread(values, lengths, a), _spread(values, lengths, b)
    # directions by their place among those known here, so (pair, direction) is one number
    known, code_of = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, span = code_of[: len(u)], code_of[len(u) :], max(1, len(known))
    first = np.ones(len(a), bool)
    first[np.intersect1d(i * span + u, j * span + v, assume_unique=True) // span] = False
    a, b = a[first], b[first]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, a, w[b])
    np.add.at(links, b, w[a])
    root, keep = ids.copy(), np.zeros(len(ids), bool)
    keep[a] = keep[b] = True
    while True:
        least, was = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        if (was == root).all():
            return ids[keep], links[keep], root[keep]


def _large(cosine, t, x):
    """Links of one group of up to two blocks."""
    ids, w, f, group, side, cross = (t[c].to_numpy() for c in ("k", "w", "h", "group", "block", "cross"))
    link = (x @ x.T >= cosine) & (f[:, None] == f[None]) & (group[:, None] == group[None])
    np.fill_diagonal(link, False)
    if cross[0]:
        link &= side[:, None] != side[None]
    if not link.any():
        return None
    values, lengths = _ragged(t["before"])
    known, at = np.unique(values, return_inverse=True)
    of = np.repeat(np.arange(len(ids)), lengths)
    # a pair that shares a smaller direction is another task's; directions are taken in slices to bound the memory
    for lo in range(0, len(known), SLICE):
        own = (at >= lo) & (at < lo + SLICE)
        has = np.zeros((len(ids), min(SLICE, len(known) - lo)), np.float32)
        has[of[own], at[own] - lo] = 1
        link &= has @ has.T == 0
    links = link @ w
    root = ids.copy()
    while True:
        new = np.minimum(root, np.where(link, root[None], np.iinfo(np.int64).max).min(axis=1))
        if (new == root).all():
            break
        root = new
    keep = link.any(axis=1)
    return ids[keep], links[keep].astype(np.int64), root[keep]


def _compare(cosine):
    def whole(t: pa.Table):
        """Links of the groups of t, which are all complete."""
        key = t["task"].to_numpy()
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(begin, len(key)))
        for g in np.flatnonzero(size > SMALL):
            own = t.slice(begin[g], size[g])
            yield _large(cosine, own, _matrix(own["x"].combine_chunks())[0][1])
        few = (size > 1) & (size <= SMALL)
        if few.any():
            rows = t.filter(pa.array(np.repeat(few, size)))
            begin, size = np.cumsum(size[few]) - size[few], size[few]
            for at, x in _matrix(rows["x"].combine_chunks()):  # a group's vectors have one dimension
                own = np.isin(begin, at)
                n = size[own]
                yield _small(cosine, rows.take(pa.array(at)), x, np.cumsum(n) - n, n)

    def run(batches):
        held: list = []  # rows of the last group so far

        def emit(tables):
            for got in whole(pa.concat_tables(tables)) if tables else ():
                if got is not None:
                    yield pa.record_batch([pa.array(c) for c in got], names=["k", "links", "root"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            key = t["task"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # keys are sorted
            if held and (last or held[0]["task"][0].as_py() != key[0]):
                yield from emit([*held, t.slice(0, last)])
                held = []
            elif last:
                yield from emit([t.slice(0, last)])
            held.append(t.slice(last))
        yield from emit(held)

    return run


def link(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors."""
    valid = F.col("embedding").isNotNull() & F.col("label").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    rows = rows.withColumn("ok", F.coalesce(valid, F.lit(False)))
    rows = rows.withColumns({"d1": F.xxhash64("embedding"), "d2": F.xxhash64(F.lit(7), "embedding")})
    good = rows.where("ok")
    # vectors are numbered in a written table, so the numbers hold whatever is computed again
    sizes = good.groupBy("label", "d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("w"), F.first(F.size("embedding")).alias("dim"))
    classes = table(sizes.withColumn("k", F.monotonically_increasing_id()), "cap-vectors")
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    unique = good.join(classes, (good["label"] == classes["label"]) & (good["d1"] == classes["d1"]) & (good["d2"] == classes["d2"]) & good["vec_id"].eqNullSafe(classes["id"])).dropDuplicates(["k"])
    kind = dict(vectors.dtypes)["embedding"]
    c = code(largest)
    schema = f"k long, group long, w long, x {kind}, filters array<{'int' if c.number() == pa.int32() else 'long'}>"
    named = table(unique.select("embedding", "k", F.xxhash64(good["label"], "dim").alias("group"), "w").transform(arrow, _filters(c), schema), "cap-filters")

    spread = named.select("k", "group", F.explode("filters").alias("f")).select("k", "f", F.xxhash64("group", "f").alias("h"))
    blocks = spread.groupBy("h").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"), F.count("*").alias("c")).where("c > 1").drop("c")
    # only numbers meet in this join; a vector then goes to the directions that others share, and knows only those
    shared = spread.join(blocks, "h").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("f", "h", "nb"))).alias("own"))
    member = named.drop("filters").join(shared, "k")
    # with each direction go the smaller ones of the vector: a link counts in the smallest that both ends share
    member = member.select("k", "group", "w", "x", F.transform("own", lambda o: o["f"]).alias("filters"), F.posexplode("own").alias("at", "o"))
    member = member.withColumn("before", F.slice("filters", F.lit(1), F.col("at"))).select("k", "group", "w", "x", "before", "o.h", "o.nb")
    block = F.pmod(F.xxhash64("k"), F.col("nb")).cast("int")
    member = member.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    member = member.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    member = member.select("k", "group", "w", "x", "before", "h", "block", (F.col("i") != F.col("j")).alias("cross"), F.xxhash64("h", "i", "j").alias("task"))
    parts = member.repartition("task").sortWithinPartitions("task").transform(arrow, _compare(cosine), "k long, links long, root long")
    parts = table(parts, "cap-links")
    degree = parts.groupBy("k").agg(F.sum("links").alias("links"))
    comps = components(parts.where("k <> root").select(F.col("k").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("k"), "comp")
    found = classes.join(degree, "k", "left").join(comps, "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    least = found.groupBy("comp").agg(F.min("id").alias("component_id"))
    found = found.join(least, "comp").select("label", "d1", "d2", F.lit(True).alias("ok"), "component_id", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n"))
    out = rows.drop("embedding").join(found, ["ok", "label", "d1", "d2"], "left")
    comp = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), comp.eqNullSafe(F.col("vec_id")).alias("kept"))
