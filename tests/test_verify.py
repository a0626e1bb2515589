"""Best title match against brute force over all pairs."""

import random
from difflib import SequenceMatcher

from quillspark.operators import verify as V

LETTERS = "abcdefghij klmnop rst"


def same(a, b):
    a, b = " ".join(a.split()), " ".join(b.split())
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def brute(rows, authority):
    out = {}
    for k, title, year, journal in rows:
        best = None
        for i, other, y, j in authority if len(title) >= 5 else ():
            score = same(title, other)
            if score < (0.9 if year or journal else 0.95) or (year and y and year != y) or (journal and j and same(journal, j) < 0.8):
                continue
            if best is None or score > best[1]:
                best = (i, score, "high" if score >= 0.97 and (year or journal) else "medium")
        out[k] = best
    return out


def test_best_title_is_brute_force(spark):
    r = random.Random(3)
    word = lambda n: "".join(r.choice(LETTERS) for _ in range(n)).strip().replace("  ", " ")

    def typos(x, n):
        for _ in range(n):
            i = r.randrange(len(x) + 1)
            x = r.choice([x[:i] + x[i + 1 :], x[:i] + r.choice("xyz") + x[i:], x[:i] + r.choice("xyz") + x[i + 1 :]])
        return x.strip()

    year, journal = (lambda: r.choice(["", "2020", "2021"])), (lambda: r.choice(["", "annals of tests", "annals of test", "review"]))
    authority = [(i, word(r.choice([5, 6, 8, 9, 12, 18, 30, 36, 60, 90, 240])), year(), journal()) for i in range(120)]
    rows = [(k, typos(t, r.randrange(1 + len(t) // 8)), year(), journal()) for k, (_, t, _, _) in enumerate(authority * 4)]
    # differs in its longest word only; no year there, so the year here is the context
    authority += [(500, "a crystallography note", "", ""), (501, "", "", ""), (502, "whole " * 11 + "prefix with another end", "", "")]
    rows += [(900, "a crystalography nots", "2020", ""), (901, "a crystalography nots", "", ""), (902, "", "2020", ""), (903, "whole " * 11 + "prefix that is not the same and goes on", "2020", "")]
    a = spark.createDataFrame(authority, "_ord long, title string, year string, journal string")
    d = spark.createDataFrame(rows, "_ord long, title string, publication_year string, journal string")
    got = {x._ord: (x.a_ord, x.similarity, x.match_confidence) if x.a_ord is not None else None for x in V.best_title(d, a).collect()}
    want = brute(rows, authority)
    assert got == want and got[900][0] == 500 and got[901] is None and got[903] is None
    assert sum(x is not None for x in want.values()) > 100
