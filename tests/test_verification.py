"""Verification against a row-by-row statement of its rules, and the cases of reuse, cache, budget and recovery."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillspark.operators import verify as V

R = random.Random(21)
FIELDS = "doi string, title string, journal string, publisher string, type string, year string, issn string, url string, created string, published string"


def same(a, b):
    a, b = (" ".join(x.strip().lower().rstrip(".").split()) for x in (a, b))
    return 0.0 if not a or not b else 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def normal(doi):
    x = doi.strip().lower()
    for head in ("https://doi.org/", "doi:"):
        x = x.removeprefix(head)
    return x.rstrip(".,;")


def plainly(row, authority, strict, title_lookup):
    """(status, mismatches, verified, method, title, doi) of one row, rule by rule."""
    doi, title, year, journal = (row[k].strip() for k in ("doi", "title", "publication_year", "journal"))
    if not doi:
        if not title_lookup:
            return "missing_doi", "NO_DOI", "false", "", "", ""
        best, score = None, 0.0
        for a in authority if len(title) >= 5 else ():
            s = same(title, a["title"])
            if s < (0.9 if year or journal else 0.95) or (year and a["year"] and year != a["year"]) or (journal and a["journal"] and same(journal, a["journal"]) < 0.8):
                continue
            if s > score:
                best, score = a, s
        if best is None:
            return "title_lookup_failed", "NO_DOI_TITLE_LOOKUP_FAILED", "false", "", "", ""
        return "title_recovered", "", "true", "title_search", f"{best['title']}|{score:.3f}|{'high' if score >= 0.97 and (year or journal) else 'medium'}", normal(best["doi"])
    a = next((a for a in authority if normal(a["doi"]) == normal(doi)), None)
    if a is None:
        return "lookup_failed", "CROSSREF_LOOKUP_FAILED", "false", "", "", row["doi"]
    out = []
    if title and a["title"]:
        s = same(title, a["title"])
        if s < 0.85:
            out.append(f"TITLE_MISMATCH: input='{title[:80]}' vs crossref='{a['title'][:80]}' (sim={s:.2f})")
        elif s < 0.95 and strict:
            out.append(f"TITLE_MINOR_DIFF: input vs crossref (sim={s:.2f})")
    if year and a["year"] and year != a["year"]:
        out.append(f"YEAR_MISMATCH: input={year} vs crossref={a['year']}")
    mine, theirs = journal.lower(), a["journal"].lower()
    if mine and theirs and mine != theirs and same(mine, theirs) < 0.8:
        out.append(f"JOURNAL_MISMATCH: input='{mine[:60]}' vs crossref='{theirs[:60]}'")
    return ("mismatch" if out else "verified"), "; ".join(out), "false" if out else "true", "doi", f"{a['title']}||", row["doi"]


def text(n):
    return " ".join("".join(R.choice("abcdefgh") for _ in range(R.randrange(1, 9))) for _ in range(n))


def typos(x, n):
    for _ in range(n):
        i = R.randrange(len(x) + 1)
        x = R.choice([x[:i] + x[i + 1 :], x[:i] + R.choice("xyz") + x[i:]])
    return x.strip()


def tables(spark):
    authority = [dict(_ord=i, doi=f"10.1/a{i}", title=text(R.randrange(2, 9)), journal=R.choice(["", "annals of tests", "review letters"]), publisher="P", type="journal-article", year=R.choice(["", "2020", "2021"]), issn="1234-5678", url="u", created="2020-1", published="") for i in range(60)]
    authority.append(authority[0] | dict(_ord=99, title="a later row of the first DOI"))
    rows = []
    for k in range(400):
        a = R.choice(authority[:60])
        doi = R.choice(["", "", a["doi"], "https://doi.org/" + a["doi"].upper() + ".", "10.1/none"])
        rows.append(dict(_ord=k, doi=doi, title=R.choice([a["title"], typos(a["title"], 1), typos(a["title"], 4), "Other words", "abc", ""]), publication_year=R.choice([a["year"], "2020", ""]), journal=R.choice([a["journal"], typos("annals of tests", 2), "Unrelated Weekly", "", "."])))
    return rows, authority, spark.createDataFrame(rows, "_ord long, doi string, title string, publication_year string, journal string").repartition(5), spark.createDataFrame(authority, f"_ord long, {FIELDS}")


def view(r):
    found = f"{r.crossref_title}|{r.crossref_title_similarity}|{r.crossref_recovered_doi_confidence}" if r.crossref_lookup_method else ""
    return r.crossref_status, r.crossref_mismatches, r.crossref_verified, r.crossref_lookup_method, found, r.doi


def test_every_rule(spark):
    rows, authority, df, auth = tables(spark)
    seen = set()
    for strict, titles in ((False, False), (True, True)):
        got = {r._ord: r for r in V.verify(df, auth, strict, titles).collect()}
        assert len(got) == len(rows)
        for row in rows:
            want = plainly(row, authority, strict, titles)
            assert view(got[row["_ord"]]) == want, row
            seen.add(want[0])
        known = [r for r in got.values() if r.crossref_lookup_method]
        assert all((r.crossref_publisher, r.crossref_type, r.crossref_issn, r.crossref_url, r.crossref_created, r.crossref_doi[:5]) == ("P", "journal-article", "1234-5678", "u", "2020-1", "10.1/") for r in known)
    assert seen == {"verified", "mismatch", "lookup_failed", "missing_doi", "title_recovered", "title_lookup_failed"}


def test_lookup_goes_by_the_rows_own_doi(spark):
    auth = spark.createDataFrame([("10.1/a", "T")], "doi string, title string")
    df = spark.createDataFrame([(0, "10.1/a", "10.1/b", "T")], "_ord long, doi string, crossref_doi string, title string")
    r = V.verify(df, auth).first()
    assert (r.crossref_status, r.crossref_doi) == ("verified", "10.1/a")
    r = V.verify(df.drop("doi"), auth).first()
    assert (r.crossref_status, r.crossref_mismatches, r.doi) == ("missing_doi", "NO_DOI", "")
    assert V.verify(df.where("false"), auth.where("false"), title_lookup=False).collect() == []


def test_final_rows_are_used_again(spark):
    auth = spark.createDataFrame([(0, "10.1/r", "A recovered paper", "2026", "Journal A"), (1, "10.1/x", "New", "", "")], "_ord long, doi string, title string, year string, journal string")
    schema = "_ord long, title string, doi string, publication_year string, journal string"
    df = spark.createDataFrame([(0, "A  Recovered paper", "", "2026", "journal a"), (1, "Old", "doi:10.1/Old", "", ""), (2, "New", "10.1/x", "", ""), (3, "Failed", "10.1/f", "", "")], schema)
    first = V.verify(df, auth, title_lookup=True)
    assert [r.crossref_status for r in first.orderBy("_ord").collect()] == ["title_recovered", "lookup_failed", "verified", "lookup_failed"]
    # the earlier output: the recovered row by its DOI and by its title; an older row of the same DOI loses; failures are asked again
    prior = first.unionByName(spark.createDataFrame([(9, "doi:10.1/old", "verified", "kept")], "_ord long, doi string, crossref_status string, crossref_title string"), allowMissingColumns=True)
    again = {r._ord: r for r in V.verify(df, auth.where("false"), title_lookup=True, prior=prior).collect()}
    assert [again[i].crossref_reused for i in range(4)] == [True, True, True, False]
    assert (again[0].crossref_status, again[0].doi) == ("title_recovered", "10.1/r") and again[1].crossref_title == "kept" and again[3].crossref_status == "lookup_failed"


def test_missing_dois_are_asked_again_with_titles(spark):
    schema = "_ord long, title string, doi string, publication_year string, journal string"
    df = spark.createDataFrame([(0, "Recoverable Paper", "", "2026", "Journal A")], schema)
    auth = spark.createDataFrame([(0, "10.1234/recovered", "Recoverable Paper", "2026", "Journal A")], "_ord long, doi string, title string, year string, journal string")
    prior = V.verify(df, auth)
    assert V.verify(df, auth, prior=prior).first().crossref_reused
    r = V.verify(df, auth, title_lookup=True, prior=prior).first()
    assert (r.crossref_status, r.doi, r.crossref_reused, r.crossref_title_similarity, r.crossref_recovered_doi_confidence) == ("title_recovered", "10.1234/recovered", False, "1.000", "high")


def test_context_chooses_among_equal_titles(spark):
    auth = spark.createDataFrame([(0, "10.1/a", "The same title", "2025", "J"), (1, "10.1/b", "The same title", "2026", "J")], "_ord long, doi string, title string, year string, journal string")
    df = spark.createDataFrame([(0, "The same title", "2026"), (1, "The same title", "")], "_ord long, title string, publication_year string")
    assert [r.doi for r in V.verify(df, auth, title_lookup=True).orderBy("_ord").collect()] == ["10.1/b", "10.1/a"]
    top = V.title_search(df, auth).orderBy("_ord", "place").collect()
    assert [(r._ord, r.place, r.a_ord) for r in top] == [(0, 1, 1), (1, 1, 0), (1, 2, 1)]


def test_cache_hits_expire_and_store(spark):
    now, later = F.to_timestamp(F.lit("2026-01-01 00:00:00")), F.to_timestamp(F.lit("2026-02-15 00:00:00"))
    auth = spark.createDataFrame([(0, "10.1/a", "Paper", "", "")], "_ord long, doi string, title string, year string, journal string")
    df = spark.createDataFrame([(0, "Paper", "10.1/A"), (1, "paper.", ""), (2, "none of them", ""), (3, "x", "10.1/none")], "_ord long, title string, doi string")
    empty = spark.createDataFrame([], V.CACHE)
    first = V.verify(df, auth, title_lookup=True, cache=empty, now=now)
    assert [r.crossref_cache_status for r in first.orderBy("_ord").collect()] == ["store", "store", "miss", "miss"]
    counts = first.agg(*[c.alias(k) for k, c in V.verification_counts().items()]).first()
    assert (counts.cache_store, counts.cache_miss, counts.cache_hit, counts.verified, counts.title_recovered) == (2, 4, 0, 1, 1)
    cache = V.upsert(empty, V.cache_rows(first, now, 30 * 86400))
    second = V.verify(df, auth.where("false"), title_lookup=True, cache=cache, now=now).orderBy("_ord").collect()
    assert [(r.crossref_cache_status, r.crossref_status) for r in second] == [("hit", "verified"), ("hit", "title_recovered"), ("miss", "title_lookup_failed"), ("miss", "lookup_failed")]
    assert second[0].crossref_title == "Paper" and second[1].doi == "10.1/a" and second[1].crossref_title_similarity == "1.000"
    expired = V.verify(df, auth.where("false"), title_lookup=True, cache=cache, now=later).orderBy("_ord").collect()
    assert [r.crossref_cache_status for r in expired] == ["miss"] * 4
    assert [r.crossref_cache_status for r in V.verify(df, auth).orderBy("_ord").collect()] == ["disabled", "", "", "disabled"]


def test_budget_and_failures(spark):
    auth = spark.createDataFrame([(0, "10.1/a", "Paper")], "_ord long, doi string, title string")
    df = spark.createDataFrame([(0, "10.1/a", "Paper"), (1, "10.1/b", "Other"), (2, "", "By title"), (3, "10.1/a", "Paper")], "_ord long, doi string, title string")
    fails = spark.createDataFrame([("10.1/B", "", "rate_limited", "60.0"), ("", "By title", "network_error", "")], "doi string, title string, status string, retry_after_seconds string")
    got = V.verify(df, auth, title_lookup=True, failures=fails, max_rows=3).orderBy("_ord").collect()
    assert [(r.crossref_status, r.crossref_mismatches, r.crossref_retry_after_seconds) for r in got] == [
        ("verified", "", ""), ("rate_limited", "CROSSREF_RATE_LIMITED", "60.0"), ("network_error", "CROSSREF_NETWORK_ERROR", ""), ("skipped_budget", "SKIPPED_BY_MAX_ROWS_BUDGET", ""),
    ]


def test_index_is_used_again(spark, tmp_path):
    _, _, df, auth = tables(spark)
    index = V.title_index(auth, str(tmp_path))
    plain = {r._ord: view(r) for r in V.verify(df, auth, title_lookup=True).collect()}
    assert {r._ord: view(r) for r in V.verify(df, auth, title_lookup=True, index=index).collect()} == plain
    V.title_index(auth.repartition(3), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 1
    V.title_index(auth.where("_ord < 5"), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2


def test_decimals_are_rounded_as_the_binary_value(spark):
    values = [0.125, 0.375, 0.285, 0.0, 1.0, 0.9999, 0.005, 0.015, 0.8499999999, 2 * 17 / 40] + [R.random() for _ in range(200)] + [2 * m / t for t in range(1, 60) for m in range(t // 2 + 1)]
    df = spark.createDataFrame([(x,) for x in values], "x double").select("x", V.fixed(F.col("x"), 2).alias("a"), V.fixed(F.col("x"), 3).alias("b"))
    assert all((r.a, r.b) == (f"{r.x:.2f}", f"{r.x:.3f}") for r in df.collect())
