"""Operator 4: language identification as a mixture, fitted with expectation-maximisation.

Model: one multinomial per language over hashed byte n-grams (4 bytes, white space kept as a space,
ASCII lower-cased, spaces after the end of a text). Each word gets a likelihood per language, the product over the n-grams that
begin in it. A document is a mixture: EM estimates the proportions of the languages from the word
likelihoods. Candidate language sets are nested by estimated proportion; the set with the best
penalised likelihood (BIC: half the log of the words for each further language) is selected and the
proportions are re-estimated within it; the sets grow until no document's likelihood gains.

Training reads every document of the training fold; counts are aggregated per (language, bucket)
before the shuffle. The model has languages x 2**BITS entries, independent of the corpus size.

Edge cases: null text or text without a letter gives ``und`` with score 0. Texts of one word work like
others. Without any training row every text is ``und``. Ties go to the alphabetically first language.
Repeated rows are answered one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .store import arrow
from .quality import filter_rows

BITS = 15
GRAM = 4
SMOOTHING = 0.25
ROUNDS, ROUNDS_WITHIN = 8, 4
#: Words of one long document that EM takes at once.
SLICE = 1 << 18
#: A clean document's main language holds at least this share (pipeline stage).
LEAST_SHARE = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
SCHEMA = "doc_id long, lang_pred string, score double, n_langs int, langs string, shares string"


def _padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk with spaces after every document, so that no n-gram reaches into the next one."""
    if len(offs) == 2:
        return np.concatenate([buf, np.full(GRAM - 1, 32, np.uint8)]), np.array([0, len(buf) + GRAM - 1])
    new = offs + np.arange(len(offs)) * (GRAM - 1)
    out = np.full(new[-1], 32, np.uint8)
    out[np.arange(len(buf)) + np.repeat(new[:-1] - offs[:-1], np.diff(offs))] = buf
    return out, new


def _buckets(buf: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte."""
    x = np.concatenate([_FOLD[buf], np.full(GRAM - 1, 32, np.uint8)]).astype(np.uint32)
    n, h = len(buf), np.zeros(len(buf), np.uint32)
    for j in range(GRAM):
        h = (h << np.uint32(8)) | x[j : j + n]
    return ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32)


def _count(batches):
    total: dict[str, np.ndarray] = {}
    for b in batches:
        lang = np.asarray(b.column(1).to_pylist(), object)
        for lo, hi, buf, offs in K.chunks(b.column(0)):
            buf, offs = _padded(buf, offs)
            names = sorted(set(lang[lo:hi]))
            code = np.searchsorted(names, lang[lo:hi].astype(str)) if names else np.zeros(0, int)
            for at in range(0, len(buf), K.CHUNK_BYTES):  # in windows: one text can be long
                own = slice(at, at + K.CHUNK_BYTES)
                g = _buckets(buf[at : at + K.CHUNK_BYTES + GRAM - 1])[: len(buf[own])]
                ink = np.flatnonzero(buf[own] > 32)
                of = code[np.searchsorted(offs, ink + at, "right") - 1]
                for i, name in enumerate(names):
                    total[name] = total.get(name, 0) + np.bincount(g[ink[of == i]], minlength=1 << BITS)
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])


def fit(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages in order, log p[bucket, language]) from rows (text, lang); null texts or languages are skipped."""
    rows = train.where("text is not null and lang is not null").select("text", "lang").transform(arrow, _count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(rows["lang"].to_pylist()))
    counts = np.full((1 << BITS, len(names)), SMOOTHING)
    if names:
        code = np.searchsorted(names, rows["lang"].to_numpy(zero_copy_only=False).astype(str))
        counts[rows["bucket"].to_numpy(), code] += rows["n"].to_numpy()
    return names, np.log(counts / counts.sum(axis=0, keepdims=True)).astype(np.float32)


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from ``share``; languages of share 0 stay out. Returns the shares and the log-likelihood per document."""
    if len(first) == 2 and len(like) > SLICE:
        return _em_long(like, share, rounds)
    n = np.maximum(1, np.diff(first))[:, None]
    lo, some = first[:-1], np.diff(first) > 0

    def per_doc(x):
        out = np.zeros((len(lo), *x.shape[1:]))
        if some.any():
            out[some] = np.add.reduceat(x, lo[some], axis=0)
        return out

    for _ in range(rounds):
        r = like * share[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-30)
        share = (per_doc(r) / n).astype(np.float32)
    return share, per_doc(np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-30)))


def _em_long(like: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for one document, a slice of its words at a time."""
    parts = range(0, len(like), SLICE)
    for _ in range(rounds):
        total = np.zeros(like.shape[1])
        for at in parts:
            r = like[at : at + SLICE] * share[0]
            total += (r / np.maximum(r.sum(axis=1, keepdims=True), 1e-30)).sum(axis=0, dtype=float)
        share = (total / len(like)).astype(np.float32)[None]
    return share, np.array([sum(float(np.log(np.maximum(like[at : at + SLICE] @ share[0], 1e-30)).sum(dtype=float)) for at in parts)])


def _likelihoods(buf, s, e, logp) -> np.ndarray:
    """likelihood[word, language] over its largest, from windows of the padded chunk."""
    like = np.empty((len(s), logp.shape[1]), np.float32)
    cuts = np.unique(np.searchsorted(s, np.arange(0, len(buf), K.CHUNK_BYTES)))
    for i, j in zip(cuts, [*cuts[1:], len(s)]):
        if i == j:
            continue
        lo, hi = s[i], e[j - 1]
        grams = np.concatenate([logp[_buckets(buf[lo : hi + GRAM - 1])[: hi - lo]], np.zeros((1, logp.shape[1]), np.float32)])
        ll = np.add.reduceat(grams, np.column_stack([s[i:j], e[i:j]]).ravel() - lo, axis=0)[::2]
        like[i:j] = np.exp(ll - ll.max(axis=1, keepdims=True))
    return like


def infer(buf, offs, logp) -> tuple[np.ndarray, np.ndarray]:
    """(shares[document, language], selected[document, language]) of a chunk."""
    buf, offs = _padded(buf, offs)
    s, e, first = K.words(buf, offs)
    docs, langs = len(offs) - 1, logp.shape[1]
    if not len(s):
        return np.zeros((docs, langs)), np.zeros((docs, langs), bool)
    like = _likelihoods(buf, s, e, logp)
    doc = K.doc_of(first)
    share, _ = _em(like, doc, first, np.full((docs, langs), 1 / langs, np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    cost = 0.5 * np.log(np.maximum(2, np.diff(first)))
    best, out = np.full(docs, -np.inf), share
    for k in range(1, langs + 1):
        inside = np.where(rank < k, np.maximum(share, 1e-6), 0).astype(np.float32)
        inside /= np.maximum(inside.sum(axis=1, keepdims=True), 1e-30)
        got, value = _em(like, doc, first, inside, ROUNDS_WITHIN if k > 1 else 1)
        value = value - k * cost
        better = value > best
        if not better.any():
            break
        best, out = np.where(better, value, best), np.where(better[:, None], got, out)
    return out, out > 0


def _predict(model):
    def run(batches):
        names, logp = model.value
        for b in batches:
            pred, score, size, langs, parts = [], [], [], [], []
            lettered = np.asarray(b.column(2).fill_null(False).to_numpy(zero_copy_only=False), bool)
            for lo, hi, buf, offs in K.chunks(b.column(1)):
                share, chosen = infer(buf, offs, logp) if names else (np.zeros((hi - lo, 0)),) * 2
                for d in range(hi - lo):
                    if not lettered[lo + d] or not names:
                        pred.append("und"), score.append(0.0), size.append(0), langs.append(""), parts.append("")
                        continue
                    x = share[d]
                    i = int(np.argmax(x))
                    own = np.flatnonzero(chosen[d])
                    pred.append(names[i]), score.append(float(min(1.0, max(0.0, x[i])))), size.append(len(own))
                    langs.append(",".join(names[j] for j in own)), parts.append(",".join(f"{x[j]:.4f}" for j in own))
            yield pa.record_batch([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(size, pa.int32()), pa.array(langs, pa.string()), pa.array(parts, pa.string())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return run


LETTER = r"\p{L}"


def training_fold(docs: DataFrame) -> DataFrame:
    return docs.where("crc32(cast(doc_id as string)) % 4 <> 2")


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """One row per document: main language, its share, and the selected set with shares."""
    model = docs.sparkSession.sparkContext.broadcast(fit(train))
    return docs.select(F.col("doc_id").cast("long"), "text", F.col("text").rlike(LETTER).alias("lettered")).transform(arrow, _predict(model), SCHEMA)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a recognised language (``und``, or no language with LEAST_SHARE) go.

    All columns of the others stay, whatever their names. Equal rows get the same verdict; an empty table stays empty."""
    import regex

    model = spark.sparkContext.broadcast(fit(training_fold(docs)))
    run = _predict(model)

    def score(batches):
        letter = regex.compile(LETTER)
        for b in batches:
            mark = pa.array([t is not None and letter.search(t) is not None for t in b.column(1).to_pylist()], pa.bool_())
            for out in run(iter([pa.record_batch([b.column(0), b.column(1), mark], names=["a", "b", "c"])])):
                keep = np.asarray(out.column(2)) >= LEAST_SHARE
                yield pa.record_batch([pa.array(keep)], names=["keep"])

    return filter_rows(docs, score, "keep")
