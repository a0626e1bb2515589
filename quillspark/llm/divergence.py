"""Operator 12: divergence between the sources of a language, over the terms that the language uses.

Terms are runs of letters (ASCII and any non-ASCII character), A-Z lower-cased. A language keeps the V terms of
at least ``least`` of its documents. A group (lang, source) and the language as a whole give each kept term
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), N the sum of its counts of kept terms. Two estimates p, q of a term
differ by floor((p - q)**2 / (p + q)). ``audit`` returns, for each group, the sum of that over all kept terms against
every other source of the language (part ``pair``, all ranks) and the terms by which the group most exceeds its
language (part ``term``, the first ``top``).

Plan: one pass over the texts counts terms in Arrow batches (exactly, by dictionary encoding) and emits a row for each
batch, group and term, which a map-side aggregation adds up. A second aggregation pivots each term into an array
that is indexed by the language's sources. From it higher-order functions emit the pairs i < j of sources of which at
least one uses the term, each as its difference from the constant that a pair has where neither uses it; a
map-side aggregation sums them, so a shuffle moves one row for each pair and task. The ten largest terms of a group are
taken by a window whose limit Spark applies before the shuffle, so a group of many terms is not gathered.

Size: a vector has as many numbers as its language has sources; of a term's pairs only those with a source that
uses it are made. The table of groups is broadcast while it has at most BROADCAST_GROUPS rows, else joined.

Arithmetic is exact: counts up to LONG_COUNT are handled in longs, larger ones in decimals of 38 digits.

Edge cases: null text, lang and source are ''. Empty texts give a group without terms; if no term is kept, V = 0, every
pair has 0 and there are no terms. Repeated rows count each time. An empty table has no rows. Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K
from .store import arrow, table

LEAST, TOP, SCALE = 10, 10, 1_000_000_000
BROADCAST_GROUPS = 100_000
#: SCALE * (count + 2) fits a long up to this count.
LONG_COUNT = 9_000_000_000

_FOLD = np.zeros(256, np.uint8)
for _a, _b in ((97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, and the number of the text of each."""
    low = _FOLD[buf]
    ink = low != 0
    starts = ink.copy()
    starts[1:] &= ~ink[:-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    starts[cut] = ink[cut]
    at = np.flatnonzero(starts)
    letters = low[ink]  # terms one after the other
    place = np.zeros(len(at) + 1, np.int32)
    if len(at):
        place[1:-1] = np.add.reduceat(ink, at, dtype=np.int64).cumsum()[:-1]
        place[-1] = len(letters)
    terms = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(place), pa.py_buffer(letters)])
    return terms, np.searchsorted(offs, at, "right") - 1


def _count(batches):
    """Rows (lang, source, term, n, docs) of a batch; term null stands for the group itself."""
    for b in batches:
        names = [b.column(i).dictionary_encode() for i in (0, 1)]
        lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
        groups, group = np.unique(lang * len(names[1].dictionary) + source, return_inverse=True)
        parts = []
        for lo, hi, buf, offs in K.chunks(b.column(2)):
            terms, doc = _terms(buf, offs)
            coded = terms.dictionary_encode()
            code, size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
            each, n = np.unique(doc * size + code, return_counts=True)  # by document
            key, back = np.unique(group[lo:hi][each // max(1, size)] * size + each % max(1, size), return_inverse=True)
            count, docs = np.bincount(back, n, len(key)).astype(np.int64), np.bincount(back, minlength=len(key))
            parts.append((key // max(1, size), coded.dictionary.take(pa.array(key % max(1, size))), count, docs))
        parts.append((np.arange(len(groups)), pa.nulls(len(groups), pa.string()), np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64)))
        for g, terms, count, docs in parts:
            of = [d.dictionary.take(pa.array(x)) for d, x in zip((names[0], names[1]), np.divmod(groups[g], max(1, len(names[1].dictionary))))]
            yield pa.record_batch([*of, terms, pa.array(count), pa.array(docs.astype(np.int64))], names=["lang", "source", "term", "n", "docs"])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group, and a row with a null term for each group."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = named.transform(arrow, _count, "lang string, source string, term string, n long, docs long")
    return table(rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")


def wide(counted: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, ns): the kept terms, ns[i] the count in the i-th of the language's sources in order."""
    sources = _sources(counted)
    numbered = sources.select("lang", F.posexplode("sources").alias("i", "source"))
    terms = _join(counted.where("term is not null"), numbered, ["lang", "source"], sources)
    kept = terms.groupBy("lang", "term").agg(F.collect_list(F.struct("i", "n")).alias("some"), F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    full = _join(kept, sources.select("lang", F.size("sources").alias("m")), ["lang"], sources)
    by = F.map_from_entries("some")
    return table(full.select("lang", "term", F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: F.coalesce(F.try_element_at(by, i), F.lit(0).cast("long"))).alias("ns")), "divergence-wide")


def _sources(counted: DataFrame) -> DataFrame:
    """(lang, sources): every source of a language, in order."""
    return counted.where("term is null").groupBy("lang").agg(F.array_sort(F.collect_list("source")).alias("sources"))


def _join(df: DataFrame, few: DataFrame, on: list[str], sources: DataFrame) -> DataFrame:
    """df join few; few has a row for each group or language, and is broadcast while there are few groups."""
    n = sources.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    return df.join(F.broadcast(few) if n <= BROADCAST_GROUPS else few, on)


def _estimate(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / total) in longs; total is N + 2 V."""
    small = F.call_function("div", F.lit(SCALE).cast("long") * (n + 2), total)
    big = F.call_function("div", (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total.cast("decimal(20,0)"))
    return F.when(n <= LONG_COUNT, small).otherwise(big) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) as described above."""
    counted = counts(docs)
    sources, terms = _sources(counted), wide(counted, least)
    # N of each source and V of each language: one row for each language
    sums = terms.select("lang", F.posexplode("ns").alias("i", "n")).groupBy("lang", "i").agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    sums = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "n"))), lambda x: x["n"]).alias("sums"), F.max("v").alias("v"))
    totals = table(sources.join(sums, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0).cast("long"))), "divergence-totals")
    totals = totals.withColumn("totals", F.transform("sums", lambda s: s + 2 * F.col("v"))).withColumn("total", F.expr("aggregate(sums, 0L, (a, x) -> a + x) + 2 * v"))
    at = _join(terms, totals.select("lang", "totals", "total", "sources"), ["lang"], sources)
    ps = at.select("lang", "term", "ns", "sources", F.transform("ns", lambda n, i: _estimate(n, F.get("totals", i))).alias("ps"), _estimate(F.expr("aggregate(ns, 0L, (a, x) -> a + x)"), F.col("total")).alias("q"), F.transform("totals", lambda t: _estimate(F.lit(0).cast("long"), t)).alias("zeros"))
    return _pairs(ps, totals, sources).unionAll(_top_terms(ps, top))


def _pairs(ps: DataFrame, totals: DataFrame, sources: DataFrame) -> DataFrame:
    """Sums over pairs i < j: V times the value where neither uses the term, plus what terms add that either uses."""
    p, z, n = (lambda c: lambda i: F.get(c, i))("ps"), (lambda i: F.get("zeros", i)), (lambda i: F.get("ns", i))
    last = F.size("ns") - 1
    emitted = F.flatten(F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.transform(
            # a source that uses the term meets all later ones; one that does not, only those that do
            F.filter(F.when(i < last, F.sequence(i + 1, last)).otherwise(F.array().cast("array<int>")), lambda j: (n(i) > 0) | (n(j) > 0)),
            lambda j: F.struct(i.alias("i"), j.alias("j"), (_gap(p(i), p(j)) - _gap(z(i), z(j))).alias("f")),
        ),
    ))
    summed = ps.select("lang", F.explode(emitted).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("f"))
    zero = lambda i: _estimate(F.lit(0).cast("long"), F.get("totals", i))
    base = totals.select("lang", "v", "totals", "sources", F.posexplode("sources").alias("i", "source")).select("lang", "v", "totals", "sources", "i", "source", F.posexplode("sources").alias("j", "item")).where("i <> j")
    low, high = F.least("i", "j"), F.greatest("i", "j")
    none = F.when(F.col("v") > 0, F.col("v") * _gap(zero(low), zero(high))).otherwise(F.lit(0).cast("long"))
    base = base.select("lang", "source", "item", low.alias("i"), high.alias("j"), none.alias("none"))
    value = (F.col("none") + F.coalesce("f", F.lit(0).cast("long"))).alias("value")
    out = base.join(summed, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value)
    return out.withColumn("rank", _rank())


def _rank() -> Column:
    from pyspark.sql import Window

    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def _top_terms(ps: DataFrame, top: int) -> DataFrame:
    more = F.filter(F.sequence(F.lit(0), F.size("ns") - 1), lambda i: (F.get("ns", i) > 0) & (F.get("ps", i) > F.col("q")))
    rows = ps.select("lang", "term", F.explode(F.transform(more, lambda i: F.struct(F.get("sources", i).alias("source"), _gap(F.get("ps", i), F.col("q")).alias("value")))).alias("x"))
    out = rows.select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), "x.value")
    return out.withColumn("rank", _rank()).where(F.col("rank") <= top)


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source, row_number() OVER () rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
o AS MATERIALIZED (SELECT lang, source, rid, unnest(w) term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
c AS (SELECT lang, source, term, count(*) n FROM o GROUP BY ALL),
f AS MATERIALIZED (SELECT g.lang, g.source, k.term, CAST(coalesce(n, 0) AS HUGEINT) n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) p FROM f),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) q FROM (SELECT lang, term, CAST(sum(n) AS HUGEINT) n FROM f GROUP BY lang, term)),
s AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(s.f, 0) v FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT p.lang, p.source, 'term', p.term, (p - q) * (p - q) // (p + q) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(v AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY v DESC, item) rank FROM x) WHERE part = 'pair' OR rank <= 10
"""
