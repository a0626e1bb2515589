import numpy as np
import pytest

from quillspark.llm import capfilter


def brute(rows):
    good = {}
    for k, e, label in rows:
        if label is not None and e is not None and all(v is not None and np.isfinite(v) for v in e) and any(e):
            x = np.array(e, float)
            good[k] = (label, x / np.linalg.norm(x))
    links = {k: set() for k, *_ in rows}
    for a, (la, x) in good.items():
        for b, (lb, y) in good.items():
            if a != b and la == lb and len(x) == len(y) and x @ y >= 0.93:
                links[a].add(b)
    comp = {}
    for k in sorted(links):
        if k not in comp:
            todo = [k]
            while todo:
                i = todo.pop()
                if i not in comp:
                    comp[i] = k
                    todo += links[i]
    return {k: (len(links[k]), comp[k], comp[k] == k) for k in links}


def test_links_match_brute_force(spark):
    r = np.random.default_rng(4)
    rows, k = [], 0
    for label in (1, 2, None):
        for _ in range(60):
            c = r.standard_normal(32)
            for _ in range(r.integers(1, 5)):
                rows.append((k := k + 1, [float(v) for v in np.float32(c + 0.08 * r.standard_normal(32))], label))
    hot = r.standard_normal(32)
    for _ in range(700):  # more than a block
        rows.append((k := k + 1, [float(v) for v in np.float32(hot + 0.15 * r.standard_normal(32))], 1))
    same = [float(v) for v in np.float32(r.standard_normal(32))]
    rows += [(k + i, same, 2) for i in range(1, 40)]
    k += 40
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [1.0, 2.0], [1.0, 2.0]]
    rows += [(k + i, e, 1) for i, e in enumerate(odd)]
    df = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows], "vec_id long, embedding array<float>, label int, n_links int").repartition(6)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in capfilter.link(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    found, there = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert found <= there and found >= 0.99 * there
    exact = [i for i in want if want[i][0] in (0, 38)]
    assert all(got[i] == want[i] for i in exact)
    assert capfilter.link(df.where("false")).collect() == []


def at_threshold(r, n, dim, scale=1.0):
    x = r.standard_normal((n, dim)) * scale
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.standard_normal((n, dim)) * scale
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, 0.93 * x + np.sqrt(1 - 0.93**2) * z


@pytest.mark.parametrize("vectors", [100, 5_000, 100_000, 2_000_000])
def test_recall_and_chance_at_every_size(vectors):
    """Recall holds, and the chance meetings of a vector grow no faster than a square root, as the code grows with the vectors."""
    c = capfilter.code(vectors)
    x, y = at_threshold(np.random.default_rng(5), 400, 64)
    one, two = capfilter.decode(x, c), capfilter.decode(y, c)
    assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(one, two)]) >= 0.98
    chance = np.mean([len(np.intersect1d(one[i], two[i - k])) for i in range(400) for k in range(1, 40)])
    assert chance * vectors <= 20 + 2 * vectors**0.5


def test_subnormal_and_huge_vectors(spark):
    rows = [(1, [5e-324, 0.0], 1), (2, [1e-320, 1e-324], 1), (3, [1e200, 1e199], 1), (4, [1e300, 1e299], 1), (5, [0.0, 1e-310], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilter.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_repeated_and_missing_ids(spark):
    a, b, far = [1.0, 0.1, 0.0], [1.0, 0.12, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a, 1), (1, a, 2), (2, b, 1), (3, b, 2)]  # one id under two labels
    rows += [(7, far, 3), (7, a, 3), (8, b, 3)]  # one id with two vectors
    rows += [(None, a, 4), (9, b, 4), (None, far, 4), (None, None, 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in capfilter.link(df).collect()), key=str)
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (7, 0, 7, True), (7, 1, 7, True), (8, 1, 7, False), (0, 1, 9, False), (9, 1, 9, True), (0, 0, None, True), (0, 0, None, True)]
    assert got == sorted(want, key=str)


def test_recall_of_uneven_vectors():
    r = np.random.default_rng(6)
    cases = {"ordered": 1 / np.arange(1, 65), "padded": np.arange(64) < 32, "last": np.arange(64) >= 48, "two": np.ones(2), "eight": np.ones(8)}
    cases |= {share: np.repeat(np.sqrt([share, 1 - share]), 32) for share in (0.8, 0.9, 0.95)}
    centres, c = r.standard_normal((4, 64)), capfilter.code(10_000)
    for name, scale in (cases | {"sparse": None, "clustered": None}).items():
        if name == "clustered":
            x = centres[r.integers(0, 4, 400)] + 0.12 * r.standard_normal((400, 64))
        elif name == "sparse":
            x = r.standard_normal((400, 64)) * (np.argsort(r.random((400, 64)), axis=1) < 3)
        else:
            x = r.standard_normal((400, len(scale))) * scale
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z = r.standard_normal(x.shape) * (1 if scale is None else scale)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        y = 0.93 * x + np.sqrt(1 - 0.93**2) * z
        found = capfilter.decode(x, c)
        assert min(map(len, found)) >= c.least, name
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(found, capfilter.decode(y, c))]) >= 0.95, name
