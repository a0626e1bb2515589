"""Toxic words that are rare in the labelled sample."""

import random

from quillspark.llm import toxicity


def test_rare_toxic_words(spark):
    r = random.Random(4)
    plain, vile = [f"w{i}" for i in range(300)], [f"vile{i}" for i in range(12)]

    def doc(bad):
        w = [r.choice(plain) for _ in range(60)]
        for _ in range(2 * bad):
            w[r.randrange(60)] = r.choice(vile)
        return " ".join(w)

    rows = [(i, doc(i % 4 == 0), int(i % 4 == 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    seen = df.where("doc_id < 320")  # each word about 13 times: under the old cut-off of 40
    got = {x.doc_id: x.predicted for x in toxicity.score(df, seen.select("doc_id", "toxic")).collect()}
    held = [(got[i], t) for i, _, t in rows if i >= 320]
    assert sum(p for p, t in held if t) >= 0.95 * sum(t for _, t in held)
    assert sum(p for p, t in held if not t) <= 0.02 * len(held)
