"""Operator 2: near-duplicates by DartMinHash signatures.

Elements are hashed five-word shingles (a text of one to four words is one shingle). Each element owns a
region weight x rank; darts are thrown into it by hashing: the region is tiled with cells (dyadic weight
interval by dyadic rank interval, of area 1 at most) whose number of darts is Poisson with the cell's area,
decided by the hash of (element, cell). A dart has a place in its cell and a coordinate, both hashes; it
counts if it lies under the element's weight, and in each of K coordinates the dart of least rank stays.
Two documents agree in a coordinate with probability equal to the weighted Jaccard similarity, the sum of
the smaller weights over the sum of the larger ones. The rank bound is t / total weight of the document
with t = K ln K + 2K expected darts, doubled where a coordinate stays empty, so long documents touch few
cells an element.

``weighting``: 'count' weighs a shingle by its number of occurrences (the query's choice), 'set' by 1; a
function of (hashes, occurrences) gives any positive real weights, for instance inverse document
frequencies. Weights count to 2**-LOW; scale them so that usual ones are about 1.

Grouping, without all pairs inside a bucket:
 1. equal texts are one class (128-bit digest, map-side combine) with a number of its own;
 2. classes with equal band hashes share a bucket; each is verified against the bucket's member of the
    smallest id (of a group of copies most often the text they were made from), and components are formed from the verified links;
 3. in buckets that still hold several components, shingles that no other document there has bound a
    member's similarity; members that cannot reach the threshold leave, the rest is verified against
    the four most central members;
 4. only pairs of members of different components that two more bounds (by what either shares with the
    most central member, and by their weights in each of BINS classes of hashes) still allow are verified
    one by one, each in the first bucket both share. Components known so far are joined, not formed anew.
Verified links are weighted Jaccard similarities >= the threshold, computed from the weights of all shingles
and 48 bits of their hashes (two different shingles of a pair of texts of n words meet by chance with
probability n * n / 2**48, which would add the weight of one), so the components are those of the link graph over all candidate pairs.

Hot buckets: a fixed table of SLOTS numbers says over how many parts the buckets of a slot are dealt;
members are dealt by hash, what is known of a bucket (a row or HUBS rows) goes to each of its parts, and
the pairs of step 4 to pairs of parts.

Edge cases: ``group`` leaves rows without doc_id out, the stage lets them pass. Null, empty and wordless
texts are classes of their own (kept, never grouped). Rows that repeat an id are answered one by one and
keyed by (id, text), so two texts of one id are two documents. Empty tables give no row. Other columns are
ignored by ``group`` and kept by the stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import kernels as K
from .graph import bitmap, components, extended, in_bitmap, slot
from .store import arrow, cut, table

WORDS, SIMILARITY, WEIGHTING = 5, 0.8, "count"
BANDS, ROWS = 16, 4
COORDS = BANDS * ROWS
#: Rank cells: below 2**-FINE, dyadic up to 1, then one per unit.
FINE = 8
#: Weight tiles for real weights: below 2**-LOW, then dyadic; whole numbers begin with one tile up to 1.
LOW = 16
HUBS = 4
#: Classes of hashes; common weight is at most the sum of the smaller weights of each.
BINS = 128
#: Buckets are dealt over parts of about PART members (BLOCK where pairs are compared), MOST_PARTS at most.
SLOTS, PART, BLOCK, MOST_PARTS = 1 << 16, 1_024, 256, 4_096


def shingles(buf, offs, k: int = WORDS, weighting=WEIGHTING):
    """(hash, weight, first): the distinct elements of each document, sorted within it."""
    s, e, wf = K.words(buf, offs)
    h = K.span_hashes(buf, s, e)
    sh, _, first = K.windows(h, wf, k)
    n = np.diff(wf)
    doc = K.doc_of(first)
    for j in range(1, k):
        short = np.flatnonzero(n == j)
        if len(short):
            x = np.zeros(len(short), np.uint64)
            for i in range(j):
                x = x * np.uint64(0xD1342543DE82EF95) + h[wf[short] + i]
            sh, doc = np.concatenate([sh, K.mix(x + np.uint64(j))]), np.concatenate([doc, short])
    order = np.lexsort((sh, doc))
    sh, doc = sh[order], doc[order]
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(sh))).astype(float)
    sh, doc = sh[at], doc[at]
    weight = np.ones(len(sh)) if weighting == "set" else times if weighting == "count" else np.asarray(weighting(sh, times), float)
    return sh, weight, np.searchsorted(doc, np.arange(len(offs)))


def _poisson_cdf(area: float) -> np.ndarray:
    p, c, out = np.exp(-area), np.exp(-area), []
    for k in range(1, 24):
        out.append(c)
        p *= area / k
        c += p
    return np.array(out)


_UNIT = 2.0**-64
_CDF = {w: _poisson_cdf(w) for w in [2.0**-i for i in range(FINE + 1)]}


def _tile(key: np.ndarray, theta: np.ndarray):
    """Darts of rank < theta in the region of weight 1 of each element: (element index, rank, id)."""
    at, ranks, ids = [], [], []
    top = float(theta.max()) if len(theta) else 0.0
    cells = [(0.0, 2.0**-FINE)] + [(2.0 ** (q - FINE), 2.0 ** (q - FINE)) for q in range(FINE)]
    cells += [(float(j), 1.0) for j in range(1, int(np.ceil(top)))]
    for c, (lo, width) in enumerate(cells):
        own = np.flatnonzero(theta > lo) if lo else np.arange(len(key))
        if not len(own):
            break
        h = K.mix(key[own] ^ np.uint64(0xA5A5 + 0x9E3779B9 * (c + 1)))
        u = h.astype(np.float64) * _UNIT
        cdf = _CDF[width]
        hit = u >= cdf[0]
        own, h, u = own[hit], h[hit], u[hit]
        i = 0
        while len(own):
            g = K.mix(h + np.uint64(i + 1))
            r = lo + width * (K.mix(g).astype(np.float64) * _UNIT)
            ok = r < theta[own]
            at.append(own[ok]), ranks.append(r[ok]), ids.append(g[ok])
            i += 1
            more = u >= cdf[i] if i < len(cdf) else np.zeros(len(u), bool)
            own, h, u = own[more], h[more], u[more]
    if not at:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(ranks), np.concatenate(ids)


def darts(key: np.ndarray, weight: np.ndarray, theta: np.ndarray, low: int = 0):
    """Darts of rank < theta under the weight of each element: (element index, rank, id).

    A weight tile of width w is a region of weight 1 with ranks times w. The first tile is [0, 2**-low)."""
    at, ranks, ids = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.uint64)]
    begin, width, nth = 0.0, 2.0**-low, 0
    while len(own := np.flatnonzero(weight > begin)):
        i, r, g = _tile(K.mix(key[own] + np.uint64(0x7A11 * (nth + 1))), theta[own] * width)
        place = begin + width * (K.mix(g ^ np.uint64(0x5EED)).astype(np.float64) * _UNIT)
        ok = place < weight[own[i]]
        at.append(own[i[ok]]), ranks.append(r[ok] / width), ids.append(g[ok])
        begin, width, nth = begin + width, width * (2 if nth else 1), nth + 1
    return np.concatenate(at), np.concatenate(ranks), np.concatenate(ids)


def signatures(sh: np.ndarray, weight: np.ndarray, first: np.ndarray, k: int = COORDS, low: int = 0) -> np.ndarray:
    """K dart ids for each document; documents without elements get zeros."""
    docs, n = len(first) - 1, np.diff(first)
    sig = np.zeros((docs, k), np.uint64)
    total = K.sums(weight, first)
    todo, t = np.flatnonzero(n > 0), k * np.log(k) + 2 * k
    while len(todo):
        size = n[todo]
        of = np.repeat(np.arange(len(todo)), size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first[todo], size)
        at, rank, ids = darts(sh[pos], weight[pos], (t / total[todo])[of], low)
        cell = of[at] * k + (K.mix(ids ^ np.uint64(0xC0FFEE)) % np.uint64(k)).astype(np.int64)
        order = np.lexsort((rank, cell))
        cell, ids = cell[order], ids[order]
        lead = np.ones(len(cell), bool)
        lead[1:] = cell[1:] != cell[:-1]
        part = np.zeros(len(todo) * k, np.uint64)
        part[cell[lead]] = ids[lead]
        part = part.reshape(-1, k)
        full = (part != 0).all(axis=1)
        sig[todo[full]] = part[full]
        todo, t = todo[~full], 2 * t
    return sig


def band_hashes(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        x = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            x = K.mix(x ^ sig[:, b * ROWS + r]) + np.uint64(r)
        out[:, b] = x
    return out.astype(np.int64)


def _low(weighting) -> int:
    return 0 if weighting in ("set", "count") else LOW


def _sign(weighting):
    def run(batches):
        for b in batches:
            total, bands = [np.zeros(0)], [np.zeros((0, BANDS), np.int64)]
            for lo, hi, buf, offs in K.chunks(b.column(1)):
                sh, weight, first = shingles(buf, offs, WORDS, weighting)
                total.append(K.sums(weight, first))
                bands.append(band_hashes(signatures(sh, weight, first, low=_low(weighting))))
            flat = np.concatenate(bands).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat))
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(total)), lists, b.column(2), b.column(3)], names=["doc_id", "n", "bands", "d1", "d2"])

    return run


def _sets(words, weighting):
    def run(batches):
        for b in batches:
            b = b.filter(pa.array(in_bitmap(words.value, b.column(4).to_numpy())))
            sets, weights = [], []
            for lo, hi, buf, offs in K.chunks(b.column(1)):
                sh, weight, first = shingles(buf, offs, WORDS, weighting)
                for d in range(hi - lo):
                    own = weight[first[d] : first[d + 1]]
                    sets.append(_pack(sh[first[d] : first[d + 1]]))
                    weights.append(b"" if (own == 1).all() else own.tobytes())
            yield pa.record_batch([b.column(0), b.column(2), b.column(3), pa.array(sets, pa.binary()), pa.array(weights, pa.binary())], names=["rep", "d1", "d2", "sh", "wt"])

    return run


def _pack(sh: np.ndarray) -> bytes:
    """The upper 48 bits of each hash; the order stays."""
    return np.ascontiguousarray((sh >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(x, w) -> tuple[np.ndarray, np.ndarray]:
    six = np.frombuffer(x, np.uint8).reshape(-1, 6)
    sh = np.zeros((len(six), 8), np.uint8)
    sh[:, :6] = six
    sh = sh.view(np.uint64).ravel()
    return sh, np.frombuffer(w, np.float64) if len(w) else np.ones(len(sh))


def _overlap(a, b) -> float:
    """Sum of the smaller weights of the common values of two (sorted values without repeats, weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    hit = b[0][at] == a[0]
    return float(np.minimum(a[1][hit], b[1][at[hit]]).sum())


def _check(similarity):
    def run(batches):
        for b in batches:
            common, linked = [], []
            for x, v, y, w in zip(*(b.column(i) for i in range(2, 6))):
                one, two = _unpack(x.as_buffer(), v.as_buffer()), _unpack(y.as_buffer(), w.as_buffer())
                m = _overlap(one, two)
                common.append(m), linked.append(m > 0 and m >= similarity * (one[1].sum() + two[1].sum() - m) - 1e-9)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(common, pa.float64()), pa.array(linked, pa.bool_())], names=["a", "b", "m", "ok"])

    return run


def _elements(batches):
    for b in batches:
        for k, x, w in zip(*(b.column(i) for i in range(3))):
            sh, weight = _unpack(x.as_buffer(), w.as_buffer())
            yield pa.record_batch([pa.array(np.full(len(sh), k.as_py())), pa.array(sh.view(np.int64)), pa.array(weight)], names=["k", "v", "w"])


def _histograms(batches):
    """Weights of each document summed over BINS classes of its hashes, never rounded down."""
    for b in batches:
        out = []
        for x, w in zip(b.column(1), b.column(2)):
            sh, weight = _unpack(x.as_buffer(), w.as_buffer())
            out.append(np.bincount((sh % np.uint64(BINS)).astype(np.int64), weight, BINS))
        flat = np.nextafter(np.array(out).reshape(-1).astype(np.float32), np.float32(np.inf))
        yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BINS, dtype=np.int32)), pa.array(flat))], names=["k", "g"])


def overlaps(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, m, ok): common weight of each pair, and whether its exact similarity reaches the threshold."""
    one = sets.select(F.col("k").alias("a"), F.col("sh").alias("x"), F.col("wt").alias("v"))
    two = sets.select(F.col("k").alias("b"), F.col("sh").alias("y"), F.col("wt").alias("w"))
    rows = edges.select("a", "b").distinct().join(one, "a").join(two, "b").select("a", "b", "x", "v", "y", "w")
    return table(rows.transform(arrow, _check(similarity), "a long, b long, m double, ok boolean"), "dart-pairs")


def verify(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    return overlaps(edges, sets, similarity).where("ok").select("a", "b")


class Parts:
    """Over how many parts the members of a bucket are dealt: one number for each of SLOTS slots of buckets.

    A bucket that shares its slot with a hot one is dealt like that one, which costs copies of its known row only."""

    def __init__(self, counts: DataFrame, size: int):
        """counts: bucket, c."""
        spark = counts.sparkSession
        hot = counts.where(F.col("c") > size).select(self._slot(), F.least(F.ceil(F.col("c") / size), F.lit(MOST_PARTS)).cast("int").alias("n"))
        rows = hot.unionAll(spark.range(SLOTS).select(F.col("id").cast("int"), F.lit(1))).groupBy("s").agg(F.max("n").alias("n"))
        self.table = cut(rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "n"))), lambda x: x["n"]).alias("n")))

    @staticmethod
    def _slot() -> Column:
        return F.pmod(F.xxhash64("bucket"), F.lit(SLOTS)).cast("int").alias("s")

    def number(self) -> Column:
        return F.get(self.table.scalar(), self._slot())

    def of(self) -> Column:
        return F.pmod(F.xxhash64("k"), self.number()).cast("int")

    def deal(self, members: DataFrame) -> DataFrame:
        """Members (bucket, k) with their part."""
        return members.withColumn("part", self.of())

    def every(self, known: DataFrame) -> DataFrame:
        """What is known of a bucket, for each of its parts."""
        return known.withColumn("part", F.explode(F.sequence(F.lit(0), self.number() - 1)))

    def join(self, members: DataFrame, known: DataFrame, *more: str) -> DataFrame:
        return self.deal(members).join(self.every(known), ["bucket", "part", *more]).drop("part")


def _alike(n: str, m: str, similarity: float) -> Column:
    """Totals of two documents that can reach the similarity, which is the smaller over the larger total at most."""
    return F.least(n, m) >= F.greatest(n, m) * F.lit(similarity) - 1e-9


def _with_comps(members: DataFrame, comps: DataFrame, parts: Parts) -> DataFrame:
    """Members of buckets that hold more than one of the components (id, comp)."""
    rows = members.join(comps.select(F.col("id").alias("k"), "comp"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    return parts.join(rows, mixed)


def classes(docs: DataFrame, similarity: float = SIMILARITY, weighting=WEIGHTING) -> DataFrame:
    """doc_id, d1, d2 (digest of the text), class_id and kept, one row per row of docs with an id.

    One (id, text) of a class is kept: the smallest id, of its texts the one with the smallest digest."""
    spark = docs.sparkSession
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2"))
    sig = table(rows.transform(arrow, _sign(weighting), "doc_id long, n double, bands array<long>, d1 long, d2 long"), "dart-signatures")
    # texts are numbered in a written table, so the numbers hold whatever is computed again
    first = sig.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c"))
    reps = table(first.withColumn("k", F.monotonically_increasing_id()), "dart-texts")
    copies, reps = Parts(reps.select(F.col("d1").alias("bucket"), "c"), PART), reps.drop("c")
    own = sig.select(F.col("doc_id").alias("rep"), "d1", "d2", "n", "bands").join(reps, ["rep", "d1", "d2"]).dropDuplicates(["k"])
    entries = table(own.select("k", "rep", "n", F.explode("bands").alias("bucket")), "dart-entries")
    shared = cut(entries.groupBy("bucket").agg(F.min(F.struct("rep", "k", "n")).alias("h"), F.count("*").alias("c")).where("c > 1").select("bucket", F.col("h.k").alias("hub"), F.col("h.n").alias("hub_n"), "c"))
    parts = Parts(shared, PART)
    members = table(parts.join(entries, shared.drop("c")).select("bucket", "k", "n", "hub", "hub_n"), "dart-buckets")
    wanted = reps.join(members.select("k").distinct(), "k")
    words = spark.sparkContext.broadcast(bitmap(wanted.select("rep", "d1")))
    picked = rows.withColumn("s", slot("doc_id", "d1")).transform(arrow, _sets(words, weighting), "rep long, d1 long, d2 long, sh binary, wt binary")
    sets = table(picked.join(wanted, ["rep", "d1", "d2"]).select("k", "sh", "wt").dropDuplicates(["k"]), "dart-sets")

    links = verify(members.where("k <> hub").where(_alike("n", "hub_n", similarity)).select(F.col("hub").alias("a"), F.col("k").alias("b")), sets, similarity)
    comps = components(links)
    left = table(_with_comps(members, comps, parts).select("bucket", "k", "n", "comp"), "dart-left")
    if not left.isEmpty():
        comps = _cross(left, sets, similarity, comps, parts)
    named = reps.join(comps.select(F.col("id").alias("k"), "comp"), "k", "left").withColumn("comp", F.coalesce("comp", "k"))
    best = named.groupBy("comp").agg(F.min("rep").alias("class_id"), F.min_by(F.struct("d1", "d2"), F.struct("rep", "d1", "d2")).alias("best"))
    named = named.join(best, "comp").select(F.col("d1").alias("bucket"), "d2", "class_id", "best")
    worded = copies.join(sig.where("n > 0").select("doc_id", "d1", F.col("d1").alias("bucket"), "d2", F.col("doc_id").alias("k")), named, "d2")
    kept = (F.col("doc_id") == F.col("class_id")) & (F.col("best") == F.struct("d1", "d2"))
    alone = sig.where("n <= 0").select("doc_id", "d1", "d2", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return worded.select("doc_id", "d1", "d2", "class_id", kept.alias("kept")).unionAll(alone)


def group(docs: DataFrame, similarity: float = SIMILARITY, weighting=WEIGHTING) -> DataFrame:
    """doc_id, class_id (smallest id of the class) and kept, one row per row of docs with an id."""
    return classes(docs, similarity, weighting).select("doc_id", "class_id", "kept")


def _cross(left: DataFrame, sets: DataFrame, similarity: float, comps: DataFrame, parts: Parts) -> DataFrame:
    """Steps 3 and 4: the components (id, comp) joined by further verified links between those that share a bucket."""
    rare = sets.join(left.select("k").distinct(), "k", "left_semi").select("k", "sh", "wt").transform(arrow, _elements, "k long, v long, w double")
    single = rare.groupBy("v").agg(F.count("*").alias("c"), F.min("k").alias("k"), F.min("w").alias("w")).where("c = 1").groupBy("k").agg(F.sum("w").alias("u"))
    rows = left.join(single, "k", "left").withColumn("u", F.coalesce("u", F.lit(0.0)))
    # m <= n - u common weight; similarity needs m >= (n1 + n2) * s / (1 + s)
    most = (F.col("n") - F.col("u")) * F.lit((1 + similarity) / similarity)
    least = rows.groupBy("bucket").agg(F.min("n").alias("least"))
    rows = table(parts.join(rows, least).where(F.col("n") + F.col("least") <= most + 1e-6).select("bucket", "k", "n", "u", "comp"), "dart-left")

    # the most central members: the best of each part, then the best of those
    for keys in (["bucket", "part"], ["bucket"]):
        best = F.row_number().over(W.partitionBy(*keys).orderBy("u", "k"))
        hubs = (parts.deal(rows) if "part" in keys else hubs).withColumn("rn", best).where(F.col("rn") <= HUBS)
    hubs = table(hubs.select("bucket", "rn", F.col("k").alias("h"), F.col("comp").alias("ch"), F.col("n").alias("hn")), "dart-hubs")
    # the first hub meets every member, as its common weight bounds their similarities
    star = parts.join(rows, hubs).where(F.expr("k <> h and (rn = 1 or comp <> ch)") & ((F.col("rn") == 1) | _alike("n", "hn", similarity))).select(F.least("h", "k").alias("a"), F.greatest("h", "k").alias("b"))
    seen = overlaps(star, sets, similarity)
    comps = extended(comps, seen.where("ok").select("a", "b"))
    rest = table(_with_comps(rows.drop("comp"), comps, parts), "dart-rest")
    if rest.isEmpty():
        return comps
    # common weight of two members is shared with the hub, or outside it and not rare: at most min(m1, m2) + min(r1, r2)
    rest = parts.join(rest, hubs.where("rn = 1").select("bucket", "h")).withColumns({"a": F.least("h", "k"), "b": F.greatest("h", "k")})
    rest = rest.join(seen.select("a", "b", "m"), ["a", "b"], "left").withColumn("m", F.coalesce("m", "n"))
    rest = rest.withColumn("r", F.greatest(F.lit(0.0), F.col("n") - F.col("m") - F.col("u")))
    # a pair is taken up in the first bucket that both share
    own = rest.groupBy("k").agg(F.collect_set("bucket").alias("own"))
    hist = sets.join(own.select("k"), "k", "left_semi").transform(arrow, _histograms, "k long, g array<float>")
    rest = table(rest.join(own.join(hist, "k"), "k").select("bucket", "k", "n", "comp", "m", "r", "own", "g"), "dart-rest")
    blocks = Parts(rest.groupBy("bucket").agg(F.count("*").alias("c")), BLOCK)
    x = blocks.deal(rest).withColumn("other", F.explode(F.sequence(F.col("part"), blocks.number() - 1)))
    y = blocks.deal(rest).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("part"))))
    y = y.select("bucket", F.col("other").alias("part"), F.col("part").alias("other"), *[F.col(c).alias(f"{c}2") for c in ("k", "n", "comp", "m", "r", "own", "g")])
    bound = F.lit((1 + similarity) / similarity) * (F.least("m", "m2") + F.least("r", "r2")) + 1e-6
    binned = F.lit((1 + similarity) / similarity) * F.aggregate(F.zip_with("g", "g2", lambda x, y: F.least(x, y)), F.lit(0.0), lambda t, x: t + x) + 1e-6
    far = (F.col("n") + F.col("n2") <= bound) & _alike("n", "n2", similarity) & F.expr("(part <> other or k < k2) and comp <> comp2 and array_min(array_intersect(own, own2)) = bucket") & (F.col("n") + F.col("n2") <= binned)
    pair = x.join(y, ["bucket", "part", "other"]).where(far)
    return extended(comps, verify(pair.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")), sets, similarity))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each class stays (the smallest id; of rows that repeat an id and text, one).

    Rows whose (id, text) is not in a fixed-size bitmap of those to check pass without a shuffle; only the others are
    joined. Rows without an id pass, as do texts without words. An empty table stays empty, and of equal rows one stays. Columns may have
    any names; those that this stage adds for itself differ from them."""
    verdict = table(classes(docs).select("doc_id", "d1", "d2", "kept"), "dart-verdicts")
    doubt = verdict.groupBy("doc_id", "d1", "d2").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("c")).where("not kept or c > 1").select("doc_id", "d1", "d2", "kept")
    doubt = cut(doubt)
    words = spark.sparkContext.broadcast(bitmap(doubt.select("doc_id", "d1")))
    names, schema = docs.columns, docs.schema
    at, taken = len(names), {n.lower() for n in docs.columns}

    def own(name: str) -> str:
        while name in taken:
            name += "_"
        return name

    mark, num, d1, d2 = (own(n) for n in ("__slot", "__id", "__d1", "__d2"))

    def part(inside: bool):
        def run(batches):
            for b in batches:
                known = np.asarray(b.column(names.index("doc_id")).is_valid())
                hit = known & in_bitmap(words.value, np.asarray(b.column(at)))
                b = b.filter(pa.array(hit == inside))
                yield pa.record_batch([b.column(i) for i in range(at)], names=names)

        keys = docs.withColumn(mark, slot(F.col("doc_id").cast("long"), F.xxhash64("text")))
        return keys.transform(arrow, run, schema)

    digest = [F.xxhash64("text").alias(d1), F.xxhash64(F.lit(7), "text").alias(d2)]
    checked = part(True).select("*", F.col("doc_id").cast("long").alias(num), *digest)
    if not doubt.where("kept").isEmpty():
        checked = checked.dropDuplicates([num, d1, d2])
    gone = doubt.where("not kept").select(F.col("doc_id").alias(num), F.col("d1").alias(d1), F.col("d2").alias(d2))
    return part(False).unionByName(checked.join(gone, [num, d1, d2], "left_anti").select(*names))
