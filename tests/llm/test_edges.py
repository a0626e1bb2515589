"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; small brute-force checks."""

import random

import duckdb

from quillspark.llm import chat, language, licenses, toxicity, urlfilter

RAND = random.Random(8)


def test_licenses(spark):
    rows = [(1, None), (2, ""), (3, "Licensed under CC BY-NC 4.0.\nx. All rights reserved!"), (4, "Released under the MIT License. " * 3), (4, "Released under the MIT License. " * 3), (5, "word " * 50000 + "\nAll rights reserved.")]
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    rows += [(6, mit), (7, "This work is licensed under the GNU General Public License, version 3.\nOr, at your option, any later version."), (8, "Or, at your option, any later version.")]
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, ids string, left int")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[i].licenses for i in range(1, 9)] == ["", "", "CC-BY-NC-4.0,LicenseRef-All-Rights-Reserved", "MIT", "LicenseRef-All-Rights-Reserved", "MIT", "GPL-3.0-or-later", ""]
    assert got[4].n_known == 3 and got[8].n_unclaimed == 1 and licenses.scan(df).count() == 9
    assert licenses.scan(df.where("false")).collect() == []


def test_chat(spark):
    rows = []
    for conv in range(40):
        for t in range(RAND.randrange(1, 7)):
            rows.append((conv, t, "user", f"same {t}" if conv % 2 else RAND.choice("ab")))
    rows += [(100, t, "user", f"long {t}") for t in range(700)] + [(101, t, "user", f"long {t}") for t in range(500)]
    rows += [(300 + c, RAND.randrange(3), RAND.choice("ab"), RAND.choice("xyz")) for c in range(400) for _ in range(RAND.randrange(1, 4))]  # ties within a turn
    rows += [(None, 0, "user", "x"), (200, None, None, None), (201, 0, None, None), (202, 0, "", ""), (203, 1, "a", "b"), (203, 1, "a", "b")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long").repartition(5)
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat.maximal(df).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = {r[0]: r[1:] for r in con.execute(f"SELECT DISTINCT conv_id, n_turns, n_copies FROM ({chat.ORACLE})").fetchall()}
    assert got == want and 101 not in got and got[100] == (700, 1) and got[203] == (2, 1)
    assert chat.collapse(df.where("false")).collect() == []


def test_urls_and_cascade(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "https://a.example.com/en/1", "http://x.net/es/2#t", "http://notnet/es/", "http://ads.example.org/p", "http://ads.example.com/en/", "http://a.com?b/c", "x://é.org/ü"]
    urls += [f"http://h{i}.org/" for i in range(4000)]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, host string").repartition(4)
    listed = spark.createDataFrame([(f"h{i}.org",) for i in range(0, 4000, 3)] + [("ads.example.org",), (None,), ("absent.org",)], "key string")
    got = {r.page_id: r for r in urlfilter.judge(df, listed).collect()}
    assert [(r.host, r.path, r.rule, r.verdict) for r in (got[i] for i in range(12))] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/1", "example.com/en/", "block"),
        ("x.net", "/es/2", "net/es/", "block"), ("notnet", "/es/", None, "allow"), ("ads.example.org", "/p", None, "block"),
        ("ads.example.com", "/en/", "example.com/en/", "block"), ("a.com", "", None, "allow"), ("é.org", "/ü", None, "allow"),
    ]
    assert all((got[12 + i].verdict == "block") == (i % 3 == 0) for i in range(4000))  # exact: no false positive
    assert urlfilter.judge(df.where("false"), listed).collect() == []


def test_language(spark):
    words = {"en": "the house of green hills and rivers", "de": "das haus der grünen hügel und flüsse", "es": "la casa de las colinas y los ríos"}
    text = lambda lang, n=40: " ".join(RAND.choice(words[lang].split()) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(RAND.choice(list(words)) for _ in range(200))]
    odd = [(900, None, "en"), (901, "", None), (902, "123 !", "de"), (903, text("en") + " " + text("es"), None), (904, text("de", 60000), None), (905, "the", None), (905, "the", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.identify(df, language.training_fold(df)).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 198
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[904].lang_pred == "de"
    assert got[903].langs == "en,es" and 0.3 < got[903].score < 0.7
    assert language.identify(df, df.where("false")).where("lang_pred <> 'und'").count() == 0
    kept = language.stage(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {*range(200), 903, 904, 905}
    assert language.identify(df.where("false"), df).collect() == []


def test_toxicity(spark):
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [RAND.choice(plain) for _ in range(60)]
        for _ in range(3 * bad):
            w[RAND.randrange(60)] = RAND.choice(["Vile,", "rotten", "nasty."])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    odd = [(900, None), (901, ""), (902, "vile"), (902, "vile"), (903, "w1 " * 60000 + "rotten")]
    df = spark.createDataFrame([(*r, 7) for r in rows + odd], "doc_id long, text string, predicted int")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.training_fold(lab)).collect()}
    assert sum(got[i].predicted == t for i, t in labels) >= 396
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1 and got[902].spans == "0-4"
    assert got[903].n_toxic_tokens == 1
    none = toxicity.score(df, lab.where("toxic = 0")).collect()
    assert len(none) == len(rows) + 5 and all(r.score == 0 for r in none)
