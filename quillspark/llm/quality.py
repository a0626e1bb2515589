"""Operator 1: quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over 2**BITS hashed word unigrams and bigrams are estimated: the raw corpus (every
document) and the trusted target (documents marked as good; a bounded, documented number of labelled
rows, chosen by hash). A document's ratio is sum(log p_target - log p_raw) over its n-grams divided
by their number. A document is kept if the base rules hold and the ratio is at least ``threshold``.

Plan: pass 1 reads the texts once and emits one row per (partition, bucket) which one aggregation
adds up; the model has a fixed 2**BITS entries, so collecting and broadcasting it does not grow with
the data. Pass 2 is map-only.

Edge cases: null, empty or blank text has no words, so base_failed and not kept. With no trusted
document the ratio is 0 and only base rules decide. Null ids in ``trusted`` are ignored; repeated
document rows are judged one by one. Other columns of the input are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import kernels as K
from .store import arrow

BITS = 16
#: At most so many trusted documents fit the target model; the raw model uses every document.
MAX_TRUSTED = 20_000
SMOOTHING = 0.5
#: Length-normalised log-likelihood ratio (nats an n-gram) under which a document is rejected.
THRESHOLD = -0.11

_SYM = np.zeros(256, bool)
_SYM[[ord(c) for c in "#*$%&|<>"]] = True
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, llr double"


def _grams(buf, offs):
    """Word bounds, word hashes, and hashed uni- and bigram buckets with (first) per document."""
    s, e, first = K.words(buf, offs)
    h = K.span_hashes(buf, s, e)
    pair, _, at = K.windows(h, first, 2)
    shift = np.uint64(64 - BITS)
    return s, e, first, h, (h >> shift).astype(np.int64), (pair >> shift).astype(np.int64), at


def _count(batches):
    raw, good = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for b in batches:
        mark = np.asarray(b.column(1).fill_null(False).to_numpy(zero_copy_only=False), bool)
        for lo, hi, buf, offs in K.chunks(b.column(0)):
            _, _, first, _, uni, bi, at = _grams(buf, offs)
            for g, f in ((uni, first), (bi, at)):
                raw += np.bincount(g, minlength=1 << BITS)
                good += np.bincount(g[mark[lo:hi][K.doc_of(f)]], minlength=1 << BITS)
    at = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])


def trusted_ids(labels: DataFrame, most: int = MAX_TRUSTED) -> DataFrame:
    """Up to ``most`` ids of good, non-toxic documents, chosen by hash: a bounded training sample."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """log p_target - log p_raw for each bucket (2**BITS doubles); zeros without trusted documents."""
    ids = trusted.select(F.col("doc_id").alias("_t")).where("_t is not null").distinct().orderBy(F.xxhash64("_t"), "_t").limit(MAX_TRUSTED)
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_t"), "left").select("text", F.col("_t").isNotNull().alias("good"))
    rows = marked.transform(arrow, _count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow()
    raw, good = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = rows["bucket"].to_numpy()
    raw[at], good[at] = rows["raw"].to_numpy(), rows["good"].to_numpy()
    if not good.sum():
        return np.zeros(1 << BITS)
    # the target is smoothed towards the raw corpus, so a bucket it has not seen is not infinitely bad
    prior = (raw + SMOOTHING) / (raw + SMOOTHING).sum()
    return np.log((good + prior * len(prior) * SMOOTHING) / (good.sum() + len(prior) * SMOOTHING)) - np.log(prior)


def _score(model, threshold: float):
    def run(batches):
        ratio = model.value
        for b in batches:
            ids, out = b.column(0), []
            for lo, hi, buf, offs in K.chunks(b.column(1)):
                s, e, first, h, uni, bi, at = _grams(buf, offs)
                n = np.diff(first)
                # code points in words: bytes that are neither continuations nor white space
                chars = K.count(((buf & 0xC0) != 0x80) & ~K._WS[buf], offs)
                symbols = K.count(_SYM[buf], offs)
                tri, pos, tf = K.windows(h, first, 3)
                again, _ = K.dup_flags(K.doc_of(tf), tri)
                hit = np.zeros(len(h), bool)
                for j in range(3):
                    hit[pos[again] + j] = True
                # lines: split at \n and document bounds; a line counts if it has a word
                nl = np.flatnonzero(buf == 10)
                ls = np.unique(np.concatenate([offs[:-1], nl + 1]))
                ls = ls[ls < len(buf)]
                le = np.append(ls[1:], len(buf)) if len(ls) else ls
                inked = np.searchsorted(s, le) > np.searchsorted(s, ls)
                ls, le = ls[inked], le[inked]
                le = le - (buf[le - 1] == 10) if len(le) else le
                doc = np.searchsorted(offs, ls, "right") - 1
                _, later = K.dup_flags(doc, K.span_hashes(buf, ls, le))
                dup = np.bincount(doc[later], minlength=hi - lo)
                rep = K.sums(hit, first)
                grams = n + np.diff(at)
                llr = (K.sums(ratio[uni], first) + K.sums(ratio[bi], at)) / np.maximum(1, grams)
                failed = (n < 50) | (100 * rep > 50 * n)
                out.append([n, chars, symbols, dup, rep, failed, ~failed & (llr >= threshold), llr])
            cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0)] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64()]
            yield pa.record_batch([ids, *(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


def judge(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base measures, ratio and verdict."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, trusted))
    return docs.select(F.col("doc_id").cast("long"), "text").transform(arrow, _score(model, threshold), SCHEMA)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rejected documents go, all columns of the others stay, whatever their names. Equal rows get the same verdict; an empty table stays empty.

    The verdict is computed beside the row, so no join (and no shuffle of texts) is needed."""
    trusted = trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = spark.sparkContext.broadcast(fit(docs, trusted))
    return filter_rows(docs, _score(model, THRESHOLD), "kept")


def filter_rows(docs: DataFrame, score, keep: str) -> DataFrame:
    """Rows of docs for which score(doc_id, text) says ``keep``; score must answer in order, one row per row."""
    names, at, schema = docs.columns, docs.columns.index("text"), docs.schema

    def run(batches):
        import pyarrow.compute as pc

        for b in batches:
            pair = pa.record_batch([pa.array(np.arange(b.num_rows)), b.column(at)], names=["doc_id", "text"])
            for verdict in score(iter([pair])):
                yield b.filter(pc.fill_null(verdict.column(verdict.schema.get_field_index(keep)), False))

    return docs.select(*names).transform(arrow, run, schema)
