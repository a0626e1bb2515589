"""Plain loops over Python objects that state what the vectorised operators compute."""

import itertools
import math
from collections import Counter

import numpy as np
import pyarrow as pa

from quillspark.llm import kernels as K, language, quality


def grams(text):
    """Buckets of the hashed uni- and bigrams of a text; only the hash is the operator's."""
    *_, uni, bi, _ = quality._grams(*K.string_buffer(pa.array([text or ""])))
    return [*uni.tolist(), *bi.tolist()]


def ratios(texts, trusted):
    """Length-normalised log-likelihood ratio of each text; trusted: indexes of the target texts."""
    raw, good = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i in trusted:
            good.update(grams(t))
    size, a = 1 << quality.BITS, quality.SMOOTHING
    n, m = sum(raw.values()) + a * size, sum(good.values()) + a * size
    if not good:
        return [0.0] * len(texts)

    def one(g):
        prior = (raw[g] + a) / n
        return math.log((good[g] + prior * size * a) / m) - math.log(prior)

    return [sum(map(one, own)) / len(own) if (own := grams(t)) else 0.0 for t in texts]


def buckets(data):
    """Hashed 4-grams that begin at each byte."""
    low = [32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in data] + [32] * 3
    out = []
    for i in range(len(data)):
        h = (low[i] << 24) | (low[i + 1] << 16) | (low[i + 2] << 8) | low[i + 3]
        out.append(((h * 0x9E3779B1) & 0xFFFFFFFF) >> (32 - language.BITS))
    return out


def fit_languages(rows):
    """(names, log p[bucket][language]) from (text, lang)."""
    names, counts = sorted({lang for _, lang in rows}), {}
    for text, lang in rows:
        data = text.encode()
        for i, g in enumerate(buckets(data)):
            if data[i] > 32:
                counts.setdefault(lang, Counter())[g] += 1
    size, a = 1 << language.BITS, language.SMOOTHING
    total = {x: sum(counts[x].values()) + a * size for x in names}
    return names, lambda g: [math.log((counts[x][g] + a) / total[x]) for x in names]


def mixture(text, names, logp):
    """(shares, chosen) of one text by EM and BIC, word by word."""
    data, words, at = text.encode(), [], None
    for i, b in enumerate([*data, 32]):
        ink = b not in (9, 10, 11, 12, 13, 32)
        if ink and at is None:
            at = i
        if not ink and at is not None:
            words.append((at, i))
            at = None
    if not words:
        return [0.0] * len(names), []
    g = buckets(data)
    like = []
    for lo, hi in words:
        ll = [sum(x) for x in zip(*(logp(v) for v in g[lo:hi]))]
        like.append([math.exp(x - max(ll)) for x in ll])

    def em(share, rounds):
        for _ in range(rounds):
            total = [0.0] * len(names)
            for row in like:
                r = [x * s for x, s in zip(row, share)]
                for j, x in enumerate(r):
                    total[j] += x / max(sum(r), 1e-30)
            share = [x / len(like) for x in total]
        return share, sum(math.log(max(sum(x * s for x, s in zip(row, share)), 1e-30)) for row in like)

    share, _ = em([1 / len(names)] * len(names), language.ROUNDS)
    order, best, out = sorted(range(len(names)), key=lambda j: (-share[j], j)), -math.inf, share
    for k in range(1, len(names) + 1):
        inside = [max(share[j], 1e-6) if j in order[:k] else 0.0 for j in range(len(names))]
        got, value = em([x / sum(inside) for x in inside], language.ROUNDS_WITHIN if k > 1 else 1)
        value -= k * 0.5 * math.log(max(2, len(words)))
        if value > best:
            best, out = value, got
        else:
            break
    return out, [j for j, x in enumerate(out) if x > 0]


def field(weight, trans):
    """(marginals of state 1, expected transitions, log Z) of one sequence by enumeration of all taggings."""
    z, first, pairs = 0.0, np.zeros(len(weight)), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=len(weight)):
        p = math.exp(sum(w for w, t in zip(weight, tags) if t) + sum(trans[a][b] for a, b in zip(tags, tags[1:])))
        z += p
        first += p * np.array(tags)
        for a, b in zip(tags, tags[1:]):
            pairs[a, b] += p
    return first / z, pairs / z, math.log(z)
