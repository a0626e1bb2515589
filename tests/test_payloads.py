"""Inverted indexes of whole texts."""

from pyspark.sql import functions as F

from quillspark.plans import catalog
from quillspark.sources import payloads as J


def test_inverted_index_is_brute_force(spark):
    texts = ["", "a", "b a b  a b", " lead and trail ", " ".join(f"w{i * i % 7919}" for i in range(20_000))]
    df = spark.createDataFrame([*enumerate(texts), (4, "same id again"), (9, None)], "k int, t string").withColumn("w", F.split("t", " ", -1))
    for r in df.select("t", J.inverted_index("w").alias("index"), J.rebuild_abstract(J.inverted_index("w")).alias("again")).collect():
        want = {}
        for i, w in enumerate(r.t.split(" ") if r.t is not None else ()):
            want.setdefault(w, []).append(i)
        assert (r["index"] or {}) == want and r.again == (r.t or "")


def test_whole_documents(spark, tmp_path):
    text = "word after word " * 2_000 + "and an end"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalog.QUERIES["inverted_text_rebuild"](spark, str(tmp_path)).first().rebuilt == text
