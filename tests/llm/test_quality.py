import random
import re

from quillspark.llm import quality

RAND = random.Random(5)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit), failed


def texts():
    some = ["a", "bé", "c#", "ñandú", "x y", "日本", "d|", "e"]
    out = [None, "", " \n\t", "one", "a b c a b c", "x\nx\n\nx\r\nx", "\n" * 5 + "z z\nz z", "w " * 3000, "é\n" * 60]
    for n in (3, 40, 49, 50, 51, 120, 700):
        for _ in range(6):
            out.append("".join(RAND.choice(some) + RAND.choice([" ", " ", "\n", "\t", "\x0b", " \n"]) for _ in range(n)))
    return out


def test_base_measures_match_brute_force(spark):
    rows = [(i, t, "en", i) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    trusted = spark.createDataFrame([(i,) for i in range(20, 30)] + [(None,)], "doc_id long")
    got = {r.doc_id: r for r in quality.judge(docs, trusted).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_ratio_separates_trusted_from_junk(spark):
    good = [" ".join(RAND.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(80)) for _ in range(60)]
    bad = [" ".join("".join(RAND.choice("qwxzkj%") for _ in range(4)) for _ in range(80)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = quality.judge(docs, spark.range(30).withColumnRenamed("id", "doc_id")).collect()
    assert min(r.llr for r in got if r.doc_id < 60) > 0 > max(r.llr for r in got if r.doc_id >= 60)
    assert all(not r.kept for r in got if r.doc_id >= 60)


def test_empty_and_no_trusted(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert quality.judge(docs, none).collect() == []
    one = spark.createDataFrame([(1, "w%d " * 3 % (1, 2, 3) + " ".join(map(str, range(60))))], "doc_id long, text string")
    assert [(r.llr, r.kept) for r in quality.judge(one, none).collect()] == [(0.0, True)]
