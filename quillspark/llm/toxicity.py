"""Operator 5: toxic spans with a linear-chain conditional random field.

Sequences are sentences (words up to a line end or a word that ends in . ! ?). Two states: clean and
toxic. Potentials: a weight for each suspicious word and one for all other words (ASCII lower case, punctuation at the
ends dropped, hashed) and a 2 x 2 transition matrix. Labels exist per document only, so tokens are labelled first: in
documents marked toxic the words whose log-odds between toxic and clean documents exceed ``LOG_ODDS``
are toxic tokens, all others are clean, if their log-likelihood ratio reaches a level, which is the one
of ``LEVELS`` with the best F1 over held-out folds of the training documents. Words that reach the lowest level in some fold are
the suspicious ones. The field is then trained on those sentences by gradient
ascent of the conditional likelihood. Scoring runs forward-backward over every sentence of every
document; the marginals give token spans (marginal >= 0.5) with byte offsets, and a logistic function
of the document's largest marginal and of the sum of its marginals gives the score.

Training uses a bounded sample of rows: at most MAX_EACH labelled documents per class, chosen by hash of the id; all of
their words count. It runs on executors: contexts of words are counted by an aggregation; sentences become sequences of
suspicious or other words, of which equal ones are counted together; gradients are sums over parts of
PART_TOKENS tokens, which meet on the driver as one small vector a part and step (one part needs no steps on the driver: its
task takes all of them). All folds and levels are trained at once. The driver holds the suspicious words (at most
2**BITS), the gradients, and two numbers a model for each sampled document. Scoring covers every word, map-only.

Edge cases: of texts that repeat a labelled id one trains the model. Null, empty and wordless texts score as zero toxic tokens. Without training rows, or with
one class only, every score is 0. Repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernels as K
from .store import arrow, table

#: Labelled training documents per class, at most.
MAX_EACH = 1_000
BITS = 22
LOG_ODDS = 1.5
#: Levels of the log-likelihood ratio to choose from, lowest first, which wins a tie; 10.83 is p = 0.001.
LEVELS, FOLDS = (10.83, 15.13, 20.0, 40.0), 3
#: Words of a training document beyond this are split over further sequences, not dropped.
LONGEST = 256
#: Tokens of different sequences that one task takes in a training step.
PART_TOKENS = 1 << 20
#: Words that forward-backward takes at once when scoring.
SLICE = 1 << 18
STEPS, RATE, DECAY = 40, 0.5, 1e-5

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()[]{}*_~"]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
SCHEMA = "doc_id long, score double, predicted int, n_toxic_tokens long, spans string"


def tokens(buf, offs):
    """Word bounds without outer punctuation, bucket per word, (first) per document and sequence starts."""
    s, e, first = K.words(buf, offs)
    a, b = s.copy(), e.copy()
    for _ in range(3):
        a += (a < b - 1) & _PUNCT[buf[np.minimum(a, len(buf) - 1)]] if len(a) else 0
        b -= (b > a + 1) & _PUNCT[buf[b - 1]] if len(b) else 0
    bucket = (K.span_hashes(_LOW[buf], a, b) >> np.uint64(64 - BITS)).astype(np.int64)
    n = len(s)
    begin = np.zeros(n, bool)
    if n:
        begin[first[:-1][first[:-1] < n]] = True
        ends = np.flatnonzero(buf == 10)
        begin[1:] |= (np.searchsorted(ends, s[1:]) != np.searchsorted(ends, e[:-1])) | _STOP[buf[e[:-1] - 1]]
        run = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
        begin |= run % LONGEST == 0
    return a, b, bucket, first, np.flatnonzero(begin)


def marginals(weight: np.ndarray, trans: np.ndarray, bucket: np.ndarray, starts: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """P(toxic) per token, expected transition counts and log Z, by forward-backward over all sequences at once.

    times: how often each sequence counts. Sequences are sorted by length, so step t touches the sequences longer than t."""
    n = len(bucket)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    length = np.diff(np.append(starts, n))
    order = np.argsort(-length, kind="stable")
    st, ln = starts[order], length[order]
    often = np.ones(len(st)) if times is None else times[order].astype(float)
    longest = int(ln[0])
    live = np.searchsorted(-ln, -np.arange(longest), "left")  # sequences with length > t
    odds = np.exp(np.clip(weight[bucket], -30, 30))
    m = np.exp(trans)
    f = np.empty((n, 2))
    logz, scale = 0.0, np.empty(n)
    for t in range(longest):
        i = st[: live[t]] + t
        if t:
            p = f[i - 1]
            x0, x1 = p[:, 0] * m[0, 0] + p[:, 1] * m[1, 0], p[:, 0] * m[0, 1] + p[:, 1] * m[1, 1]
        else:
            x0, x1 = np.ones(len(i)), np.ones(len(i))
        x1 = x1 * odds[i]
        c = x0 + x1
        f[i, 0], f[i, 1], scale[i] = x0 / c, x1 / c, c
    logz = float((np.add.reduceat(np.log(scale), starts) * (1 if times is None else times)).sum())
    beta = np.ones((n, 2))
    pairs = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        i = st[: live[t + 1]] + t
        nx, c = beta[i + 1], scale[i + 1]
        e0, e1 = nx[:, 0] / c, nx[:, 1] * odds[i + 1] / c
        beta[i, 0], beta[i, 1] = m[0, 0] * e0 + m[0, 1] * e1, m[1, 0] * e0 + m[1, 1] * e1
        p = f[i]
        for u in (0, 1):
            for v, ev in ((0, e0), (1, e1)):
                pairs[u, v] += float((p[:, u] * ev) @ often[: live[t + 1]]) * m[u, v]
    return np.clip(f[:, 1] * beta[:, 1], 0, 1), pairs, logz


def _alone(other: float, trans: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(marginals of sequences of 1, 2, ... most other words, one after the other; where each length begins)."""
    length = np.arange(1, most + 1)
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    p, _, _ = marginals(np.array([other]), trans, np.zeros(length.sum(), np.int64), begin)
    return p, np.concatenate([[0], begin])


def scored(weight: np.ndarray, trans: np.ndarray, bucket: np.ndarray, starts: np.ndarray, known: np.ndarray | None = None, alone: tuple | None = None) -> np.ndarray:
    """P(toxic) per token, some sequences at a time, so one long text needs no more memory than its words.

    known: by bucket, is the word one with a weight of its own. Sequences of other words only depend on their length alone
    and are looked up in ``alone`` (see ``_alone``)."""
    out, n = np.zeros(len(bucket)), len(bucket)
    if not n:
        return out
    size = np.diff(np.append(starts, n))
    todo = np.arange(len(starts))
    if known is not None:
        some = np.logical_or.reduceat(known[bucket], starts)
        flat, begin = alone
        at = np.arange(n) - np.repeat(starts - begin[size], size)
        out = flat[at]
        todo = np.flatnonzero(some)
    ends = np.cumsum(size[todo])
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, SLICE)), len(todo)))
    for i, j in zip(cuts[:-1], cuts[1:]):
        own, m = starts[todo[i:j]], size[todo[i:j]]
        first = np.cumsum(m) - m
        at = np.arange(m.sum()) + np.repeat(own - first, m)
        out[at] = marginals(weight, trans, bucket[at], first)[0]
    return out


@dataclass
class Fields:
    """Models that are trained together: of each, the gold tokens among the suspicious words and the fold that it leaves out (-1: none)."""

    gold: np.ndarray  # models x suspicious words
    fold: np.ndarray  # models
    w: np.ndarray  # models x (suspicious words and the other words)
    trans: np.ndarray  # models x 2 x 2

    @classmethod
    def new(cls, gold: np.ndarray, fold: np.ndarray) -> "Fields":
        return cls(gold, fold, np.full((len(gold), gold.shape[1] + 1), -2.0), np.zeros((len(gold), 2, 2)))

    def gradient(self, words: np.ndarray, starts: np.ndarray, toxic: np.ndarray, fold: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sums over sequences of gold minus expected counts: of each model the words, then the transitions. Sequences: place of the word among the suspicious (last: other)."""
        k, size = self.w.shape[1], np.diff(np.append(starts, len(words)))
        inner = np.ones(len(words), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        out = np.zeros((len(self.w), k + 4))
        for j in range(len(self.w)):
            n = times * (fold != self.fold[j])
            each = np.repeat(n, size).astype(float)
            gold = np.append(self.gold[j], False)[words] & (np.repeat(toxic, size) == 1)
            p, pairs, _ = marginals(self.w[j], self.trans[j], words, starts, n)
            out[j, :k] = np.bincount(words, (gold - p) * each, k)
            seen = np.bincount(2 * gold[at - 1] + gold[at], each[at], 4)
            out[j, k:] = seen - pairs.ravel()
        return out

    def train(self, gradient) -> "Fields":
        """AdaGrad on the conditional log-likelihood; gradient: function of the models as they are."""
        k = self.w.shape[1]
        gw, gt = np.zeros_like(self.w), np.zeros_like(self.trans)
        for _ in range(STEPS):
            g = gradient(self)
            d = g[:, :k] - DECAY * self.w
            dt = g[:, k:].reshape(-1, 2, 2) - DECAY * self.trans
            gw += d * d
            gt += dt * dt
            self.w += RATE * d / np.sqrt(gw + 1e-8)
            self.trans += 0.2 * RATE * dt / np.sqrt(gt + 1e-8)
        return self


def _g2(a, b, n1, n0):
    """Log-likelihood ratio statistic of counts a of n1 against b of n0."""
    x = lambda k, e: np.where(k > 0, k * np.log(np.maximum(k, 1e-9) / np.maximum(e, 1e-9)), 0.0)
    both, n = a + b, n1 + n0
    return 2 * (x(a, both * n1 / n) + x(b, both * n0 / n) + x(n1 - a, (n - both) * n1 / n) + x(n0 - b, (n - both) * n0 / n))


def _doc_features(p, first):
    top = np.zeros(len(first) - 1)
    some = np.diff(first) > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, first[:-1][some])
    return top, np.log1p(K.sums(p, first))


def _gather(batches):
    for b in batches:
        rows = []
        for lo, hi, buf, offs in K.chunks(b.column(0)):
            _, _, bucket, first, starts = tokens(buf, offs)
            for d in range(hi - lo):
                own = starts[(starts >= first[d]) & (starts < first[d + 1])] - first[d]
                words = bucket[first[d] : first[d + 1]].astype(np.int32).tobytes()
                rows.append((words, own.astype(np.int32).tobytes(), zlib.crc32(words) % FOLDS))  # copies of a text share a fold
        yield pa.record_batch([b.column(1), b.column(2).cast(pa.int32()), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.binary(), pa.binary(), pa.int32())))], names=["id", "toxic", "words", "starts", "fold"])


def _rows(b: pa.RecordBatch):
    """(words, starts, toxic, fold) of each sampled document."""
    for i in range(b.num_rows):
        yield np.frombuffer(b.column("words")[i].as_py(), np.int32).astype(np.int64), np.frombuffer(b.column("starts")[i].as_py(), np.int32).astype(np.int64), b.column("toxic")[i].as_py(), b.column("fold")[i].as_py()


def _contexts(batches):
    """The different contexts (word before, word, word after) of each document's words, so copies of a document count once."""
    for b in batches:
        for words, _, toxic, fold in _rows(b):
            padded = np.concatenate([[0], words + 1, [0]]).astype(np.uint64)
            context, at = np.unique(K.mix(K.mix(K.mix(padded[:-2]) + padded[1:-1]) + padded[2:]), return_index=True)
            n = len(at)
            for i in range(0, n, 1 << 16):
                part = slice(i, i + (1 << 16))
                m = len(at[part])
                yield pa.record_batch([pa.array(context[part].view(np.int64)), pa.array(words[at[part]].astype(np.int32)), pa.array(np.full(m, toxic, np.int32)), pa.array(np.full(m, 1 << fold, np.int32))], names=["context", "bucket", "toxic", "folds"])


def suspicious(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, level): words that reach LEVELS[0] in the documents of some model, and for each model (folds 0, 1, ... left out; none) the number of levels reached."""
    once = train.transform(arrow, _contexts, "context long, bucket int, toxic int, folds int").groupBy("context", "bucket", "toxic").agg(F.bit_or("folds").alias("folds"))
    models = [((1 << FOLDS) - 1) & ~(1 << k) for k in range(FOLDS)] + [(1 << FOLDS) - 1]
    names = [f"c{c}_{m}" for m in range(len(models)) for c in (1, 0)]
    cells = [F.count_if((F.col("toxic") == c) & (F.col("folds").bitwiseAND(F.lit(mask)) != 0)).alias(f"c{c}_{m}") for m, mask in enumerate(models) for c in (1, 0)]
    counts = table(once.groupBy("bucket").agg(*cells), "toxicity-contexts")
    total = np.array([x or 0 for x in counts.agg(*[F.sum(n) for n in names]).first()], float).reshape(-1, 2)

    def reach(batches):
        for b in batches:
            c = np.stack([b.column(n).to_numpy() for n in names], 1).astype(float).reshape(b.num_rows, -1, 2)
            n = np.maximum(1, total)
            odds = np.log((c[:, :, 0] + 0.1) / n[:, 0]) - np.log((c[:, :, 1] + 0.1) / n[:, 1])
            g2 = _g2(c[:, :, 0], c[:, :, 1], n[:, 0], n[:, 1])
            level = np.where(odds >= LOG_ODDS, (g2[:, :, None] >= np.array(LEVELS)).sum(2), 0)
            some = level.any(1)
            yield pa.record_batch([b.column("bucket").filter(pa.array(some)), pa.array(level[some].tolist(), pa.list_(pa.int32()))], names=["bucket", "level"])

    found = arrow(counts, reach, "bucket int, level array<int>").toArrow()
    bucket = found["bucket"].to_numpy()
    order = np.argsort(bucket)
    level = np.array(found["level"].to_pylist(), np.int64).reshape(-1, len(models))
    return bucket[order].astype(np.int64), level[order]


def _placed(words: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Place of each word among the suspicious ones; their number for all others."""
    if not len(buckets):
        return np.zeros(len(words), np.int64)
    at = np.minimum(np.searchsorted(buckets, words), len(buckets) - 1)
    return np.where(buckets[at] == words, at, len(buckets))


def _sequences(buckets):
    def run(batches):
        for b in batches:
            for words, starts, toxic, fold in _rows(b):
                own = _placed(words, buckets).astype(np.int32)
                rows = [x.tobytes() for x in np.split(own, starts[1:])] if len(own) else []
                for i in range(0, len(rows), 1 << 14):
                    part = rows[i : i + (1 << 14)]
                    yield pa.record_batch([pa.array(part, pa.binary()), pa.array([toxic] * len(part), pa.int32()), pa.array([fold] * len(part), pa.int32())], names=["words", "toxic", "fold"])

    return run


def _arrays(rows: pa.Table) -> tuple:
    """Arguments of ``Fields.gradient`` from rows (words, toxic, fold, times)."""
    own = [np.frombuffer(x, np.int32) for x in rows["words"].to_pylist()]
    size = np.array([len(x) for x in own], np.int64)
    words = np.concatenate(own).astype(np.int64) if own else np.zeros(0, np.int64)
    return words, np.cumsum(size) - size, rows["toxic"].to_numpy(), rows["fold"].to_numpy(), rows["times"].to_numpy()


def trained(train: DataFrame, buckets: np.ndarray, fields: Fields) -> Fields:
    """The fields, trained on the sequences of the sampled documents; the sums of a step are made by executors."""
    spark = train.sparkSession
    same = train.transform(arrow, _sequences(buckets), "words binary, toxic int, fold int").groupBy("words", "toxic", "fold").agg(F.count("*").alias("times"))
    rows = table(same, "toxicity-sequences")
    tokens_ = rows.agg(F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()[0] // 4
    parts = max(1, -(-tokens_ // PART_TOKENS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("words", "toxic", "fold"), F.lit(parts)).cast("int"))
    if parts == 1:

        def all_steps(t: pa.Table) -> pa.Table:
            own = _arrays(t)
            done = fields.train(lambda f: f.gradient(*own))
            return pa.table({"w": [done.w.ravel().tolist()], "trans": [done.trans.ravel().tolist()]}, schema=pa.schema([("w", pa.list_(pa.float64())), ("trans", pa.list_(pa.float64()))]))

        r = dealt.groupBy("part").applyInArrow(all_steps, "w array<double>, trans array<double>").first()
        if r is not None:
            fields.w, fields.trans = np.array(r.w).reshape(fields.w.shape), np.array(r.trans).reshape(fields.trans.shape)
        return fields
    fixed = table(dealt.repartition(parts, "part"), "toxicity-parts", by="part")

    def step(f: Fields) -> np.ndarray:
        now = spark.sparkContext.broadcast(f)
        one = lambda t: pa.table({"g": [now.value.gradient(*_arrays(t)).ravel().tolist()]})
        got = fixed.groupBy("part").applyInArrow(one, "g array<double>").toArrow()["g"].to_pylist()
        now.destroy()
        return np.sum([np.array(g) for g in got], 0).reshape(len(f.w), -1)

    return fields.train(step)


def _judged(fields: Fields, buckets: np.ndarray):
    """Of each sampled document and model the largest marginal and the sum of the marginals."""

    def run(batches):
        known = np.append(np.ones(len(buckets), bool), False)
        alone = [_alone(w[-1], m, LONGEST) for w, m in zip(fields.w, fields.trans)]
        for b in batches:
            out = []
            for words, starts, _, _ in _rows(b):
                own = _placed(words, buckets)
                first = np.array([0, len(own)])
                each = [_doc_features(scored(fields.w[j], fields.trans[j], own, starts, known, alone[j]), first) for j in range(len(fields.w))]
                out.append([float(x[0]) for pair in each for x in pair])
            yield pa.record_batch([b.column("toxic"), b.column("fold"), pa.array(out, pa.list_(pa.float64()))], names=["toxic", "fold", "x"])

    return run


def _logistic(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Ridge logistic fit of (largest, sum) by Newton steps."""
    x, c = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + 0.1 * np.eye(3)
        c += np.linalg.solve(hess, x.T @ (toxic - q) - 0.1 * c)
    return c


def fit(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Model from (doc_id, toxic) rows; texts come from docs. Null labels or ids are skipped."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    pick = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_EACH) for k in (0, 1)]
    ids = pick[0].unionAll(pick[1]).withColumnsRenamed({"doc_id": "_l", "toxic": "_toxic"})
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_l")).select("text", F.col("_l").cast("long"), "_toxic").transform(arrow, _gather, "id long, toxic int, words binary, starts binary, fold int")
    # of texts that repeat an id one is taken
    train = table(rows.groupBy("id").agg(F.min(F.struct("words", "starts", "toxic", "fold")).alias("r")).select("r.*"), "toxicity-train")
    if train.agg(F.count_distinct("toxic")).first()[0] < 2:
        return None
    buckets, level = suspicious(train)
    # models: every level without each fold, then every level with all documents
    pairs = [(k, i) for k in [*range(FOLDS), FOLDS] for i in range(len(LEVELS))]
    gold = np.stack([level[:, k] > i for k, i in pairs]) if len(buckets) else np.zeros((len(pairs), 0), bool)
    fields = trained(train, buckets, Fields.new(gold, np.array([k if k < FOLDS else -1 for k, _ in pairs])))
    judged = arrow(train, _judged(fields, buckets), "toxic int, fold int, x array<double>").toArrow()
    toxic, fold, x = judged["toxic"].to_numpy(), judged["fold"].to_numpy(), np.array(judged["x"].to_pylist()).reshape(len(judged), -1, 2)
    best = max(range(len(LEVELS)), key=lambda i: _held_out(x[:, i :: len(LEVELS)], toxic, fold))
    j = FOLDS * len(LEVELS) + best
    w, listed = np.full(1 << BITS, fields.w[j, -1], np.float32), np.zeros(1 << BITS, bool)
    w[buckets], listed[buckets] = fields.w[j, :-1], True
    return {"w": w, "known": listed, "other": float(np.float32(fields.w[j, -1])), "trans": fields.trans[j], "c": _logistic(x[:, j], toxic)}


def _held_out(x: np.ndarray, toxic: np.ndarray, fold: np.ndarray) -> float:
    """F1 of the toxic class, each fold judged by a model of the others; x: documents x models x (largest, sum)."""
    found = np.zeros(len(toxic), bool)
    for k in range(FOLDS):
        own, rest = fold == k, fold != k
        if own.any() and rest.any() and toxic[rest].min() != toxic[rest].max():
            c = _logistic(x[rest, k], toxic[rest])
            found[own] = c[0] + x[own, k] @ c[1:] >= 0
    return 2 * int((found & (toxic == 1)).sum()) / (int(found.sum()) + int(toxic.sum()))


def _score(model):
    def run(batches):
        m = model.value
        alone = None if m is None else _alone(m["other"], m["trans"], LONGEST)
        for b in batches:
            score, count, spans = [], [], []
            for lo, hi, buf, offs in K.chunks(b.column(1)):
                if m is None:
                    score += [0.0] * (hi - lo)
                    count += [0] * (hi - lo)
                    spans += [""] * (hi - lo)
                    continue
                s, e, bucket, first, starts = tokens(buf, offs)
                p = scored(m["w"], m["trans"], bucket, starts, m["known"], alone)
                top, total = _doc_features(p, first)
                z = m["c"][0] + m["c"][1] * top + m["c"][2] * total
                score += (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
                hit = np.flatnonzero(p >= 0.5)
                doc = np.searchsorted(first, hit, "right") - 1
                text = [[] for _ in range(hi - lo)]
                for i, d in zip(hit.tolist(), doc.tolist()):
                    text[d].append(f"{s[i] - offs[d]}-{e[i] - offs[d]}")
                count += [len(x) for x in text]
                spans += [",".join(x) for x in text]
            x = np.array(score, float)
            yield pa.record_batch([b.column(0), pa.array(x), pa.array((x >= 0.5).astype(np.int32)), pa.array(np.array(count, np.int64)), pa.array(spans, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def training_fold(labels: DataFrame) -> DataFrame:
    return labels.where("crc32(cast(doc_id as string)) % 5 <> 0")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: score, predicted, toxic tokens and their byte offsets (``start-end`` joined by commas)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.select(F.col("doc_id").cast("long"), "text").transform(arrow, _score(model), SCHEMA)
