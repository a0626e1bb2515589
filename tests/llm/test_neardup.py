import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import kernels as K, neardup


def shingle_bag(text, k=5):
    w = (text or "").encode().split()
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def weighted(x, y):
    return sum((x & y).values()) / sum((x | y).values())


def brute(rows, similarity=0.8, bag=shingle_bag):
    sets = [bag(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(a):
        while comp[a] != a:
            a = comp[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and weighted(sets[i], sets[j]) >= similarity - 1e-9:
                a, b = sorted((find(i), find(j)), key=lambda x: rows[x][0])
                comp[b] = a
    best = {}
    for i, (k, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), k), k)
    return [best[find(i)] for i in range(len(rows))]


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows, out = [None, "", "  \n", "one", "one", "two words", "a a a a a a a a", "a a a a a a"], []
    for _ in range(12):
        base = [word() for _ in range(r.choice((8, 60, 150, 900)))]
        rows.append(" ".join(base))
        for _ in range(6):
            w = list(base)
            for _ in range(r.choice((0, 1, 1, 2, 3, 6)) * max(1, len(w) // 150)):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w))
    base = [word() for _ in range(146)]  # one large group: pairs lie on both sides of the threshold
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(7)):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    for i, t in enumerate(rows):
        out.append((i * 7 % 997, t))
    return out


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x", True) for k, t in rows], "doc_id long, text string, class_id string, kept boolean").repartition(5)
    got = {r.doc_id: r for r in neardup.group(docs).collect()}
    assert [got[k].class_id for k, _ in rows] == brute(rows)
    assert all(r.kept == (r.class_id == k) for k, r in got.items())


def fractional(sh, times):
    """A real weight for each hash, from 0.05 to 6, times the occurrences."""
    return times * (0.05 + 6 * (sh % np.uint64(1000)).astype(float) / 1000)


@pytest.mark.parametrize("weighting", ["set", "count", fractional])
@pytest.mark.parametrize("cut", [10, 60, 300])
def test_agreement_estimates_weighted_similarity(weighting, cut):
    a = [f"w{i}" for i in range(200)] * 2 + ["x", "y", "z", "u", "v"] * 20 + ["r"] * 300
    b = a[:-cut] + [f"n{i}" for i in range(40)]
    buf, offs = K.string_buffer(pa.array([" ".join(a), " ".join(b)]))
    sh, weight, first = neardup.shingles(buf, offs, 5, weighting)
    x, y = (dict(zip(sh[first[d] : first[d + 1]].tolist(), weight[first[d] : first[d + 1]].tolist())) for d in (0, 1))
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in x | y) / sum(max(x.get(k, 0), y.get(k, 0)) for k in x | y)
    sig = neardup.signatures(sh, weight, first, 2048, neardup._low(weighting))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    own = [neardup._unpack(neardup._pack(sh[first[d] : first[d + 1]]), weight[first[d] : first[d + 1]].tobytes()) for d in (0, 1)]
    m = neardup._overlap(*own)
    assert abs(m / (own[0][1].sum() + own[1][1].sum() - m) - want) < 1e-9


def test_fractional_weights_decide_classes(spark):
    # the same three of forty words differ; whether that matters is up to their weights
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-1] + ["other"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    buf, offs = K.string_buffer(pa.array([r[1] for r in rows]))
    sh, _, first = neardup.shingles(buf, offs)
    only = set(sh[first[0] : first[1]].tolist()) ^ set(sh[first[1] :].tolist())
    heavy = lambda s, n: np.where(np.isin(s, np.array(sorted(only), np.uint64)), 30.5, 0.25)
    assert {r.class_id for r in neardup.group(df).collect()} == {1}
    assert {r.class_id for r in neardup.group(df, weighting=heavy).collect()} == {1, 2}
    assert {r.class_id for r in neardup.group(df, weighting=lambda s, n: 0.25 + 0 * n).collect()} == {1}


def test_hot_buckets_in_parts(spark, monkeypatch):
    """One group of near copies much larger than a part: same classes, several parts and blocks."""
    monkeypatch.setattr(neardup, "PART", 8)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in neardup.group(docs).collect()}
    assert [got[k] for k, _ in rows] == brute(rows)


def test_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    rows = [(1, a), (5, a + " x"), (5, b), (5, b), (6, b + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.kept) for r in neardup.group(docs).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert sorted(tuple(r) for r in neardup.stage(spark, docs, "").collect()) == [(1, a), (5, b)]
    none = spark.createDataFrame([(None, a), (None, a), (7, a)], "doc_id long, text string")
    assert neardup.stage(spark, none, "").count() == 3  # rows without an id pass


def test_empty_table_and_repeated_ids(spark):
    assert neardup.group(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, None)]
    got = sorted((r.doc_id, r.class_id, r.kept) for r in neardup.group(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]


def test_stage_keeps_one_of_each_class(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, lang string")
    out = neardup.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(brute(rows)))


def test_stage_leaves_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 5, "a", 7, 8), (2, text + " end", 6, "b", 7, 8), (3, "other words of its own", 7, "c", 7, 8), (3, "other words of its own", 7, "c", 7, 8), (None, None, 8, "d", 7, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __slot int, __D1 string, __id int, __d2_ int")
    out = neardup.stage(spark, df, "")
    assert out.columns == df.columns and sorted((r.doc_id or 0, r["__slot"], r["__D1"]) for r in out.collect()) == [(0, 8, "d"), (1, 5, "a"), (3, 7, "c")]
    assert neardup.stage(spark, df.where("false"), "").collect() == []


def test_pairs_verified_grow_with_the_members_of_a_group(spark, monkeypatch):
    """Copies of one text just below the threshold, whose changes several share: most pairs are excluded before they are verified."""
    import random

    from quillspark.llm import neardup as N

    rng, base = random.Random(5), [f"w{i}" for i in range(200)]
    docs = []
    for i in range(120):
        words = list(base)
        for p in rng.sample(range(200), 5):
            words[p] = f"x{p}-{rng.randrange(2)}"
        docs.append((i, words))
    sets = [{tuple(w[j : j + 5]) for j in range(196)} for _, w in docs]
    root = list(range(120))
    for i in range(120):
        for j in range(i):
            m = len(sets[i] & sets[j])
            if m >= 0.8 * (len(sets[i]) + len(sets[j]) - m):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    counts, plain = [], N.overlaps

    def counted(edges, *rest):
        counts.append(edges.distinct().count())
        return plain(edges, *rest)

    monkeypatch.setattr(N, "overlaps", counted)
    got = N.group(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == dict(enumerate(root))
    assert len(counts) == 3 and counts[2] < 240


def test_components_that_are_extended(spark):
    import random

    from quillspark.llm.graph import components, extended

    rng = random.Random(3)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(80)]
    frame = lambda e: spark.createDataFrame(e, "a long, b long").where("a <> b")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(components(frame(edges)))
    assert rows(extended(components(frame(edges[:50])), frame(edges[50:]))) == whole
    assert rows(extended(components(frame(edges)), frame(edges[:0]))) == whole


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """Sizes that the planner multiplies at every join are those of the files again after each round."""
    from quillspark.llm.graph import components, extended

    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    path = components(spark.range(23).selectExpr("id as a", "id + 1 as b"))
    more = extended(path, spark.createDataFrame([(23, 24)], "a long, b long"))
    assert sorted(map(tuple, more.collect())) == [(i, 0) for i in range(25)]
    assert size(path) < 1 << 20 and size(more) < 1 << 20
