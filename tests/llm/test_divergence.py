"""Term vectors against plain sums over terms and against DuckDB."""

import random
import re
from collections import Counter

import duckdb

from quillspark.llm import divergence

R = random.Random(12)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOW))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in {*d[2]})
        kept = [t for t in df if df[t] >= least]
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= least) for s in {d[1] for d in mine}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        q, each = p(sum(count.values(), Counter())), {s: p(c) for s, c in count.items()}
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = sorted(((-sum(gap(each[s][t], each[o][t]) for t in kept), o.encode()) for o in count if o != s))
            terms = sorted(((-gap(each[s][t], q[t]), t.encode()) for t in kept if count[s][t] and each[s][t] > q[t]))[:top]
            out |= {(lang, s, part, item.decode(), -v, k + 1) for part, ranked in (("pair", pairs), ("term", terms)) for k, (v, item) in enumerate(ranked)}
    return out


def rows():
    vocab = [f"w{chr(97 + i)}{c}" for i in range(26) for c in ("", "é", "ß", "漢")]
    out = []
    for _ in range(400):
        lang, source = R.choice(["en", "de", "", None]), R.choice(["hot", "hot", "hot", "a", "b", "c", "ç", "", None])
        lean = 3 if source == "hot" else 1
        words = [R.choice(vocab[:: R.choice([1, lean])]) for _ in range(R.randrange(0, 30))]
        out.append((lang, source, R.choice([" ", "1", "_-", "\n"]).join(w.upper() if R.random() < 0.1 else w for w in words)))
    return out + [("en", "empty", None), ("en", "empty", ""), ("lone", "only", "few words"), ("lone", "other", "not kept"), ("single", "s", "x " * 50)] + [("fr", "rep", "même texte")] * 12 + [("fr", "b", "Même " * 1000 + "rare")]


def test_against_plain_sums(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1, "z") for r in data], "lang string, source string, text string, term int, n string").repartition(7)
    got = [tuple(r) for r in divergence.audit(df).collect()]
    assert len(got) == len({*got}) and {*got} == brute(data, 10, 10)
    assert divergence.audit(df.where("false")).collect() == []
    got = {tuple(r) for r in divergence.audit(df, least=2, top=3).collect()}
    assert got == brute(data, 2, 3)


def test_joined_groups_and_sql(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    data = rows()
    df = spark.createDataFrame(data, "lang string, source string, text string")
    got = {tuple(r) for r in divergence.audit(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", data)
    assert got == {*con.execute(divergence.ORACLE).fetchall()}


def test_large_counts_are_exact(spark):
    from pyspark.sql import functions as F

    cases = [(n, t) for n in (0, 1, 9_000_000_000, 9_000_000_001, 10**15) for t in (5, 10**10, 10**16 + 7) if n + 2 <= t]
    df = spark.createDataFrame(cases, "n long, t long").select("n", "t", divergence._estimate(F.col("n"), F.col("t")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.n + 2) // r.t for r in df.collect())
