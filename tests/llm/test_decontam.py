"""The suffix automaton against plain windows; shards, pieces, removal and edge cases."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from quillspark.llm import decontam

R = random.Random(13)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOW))


def brute(texts, items, window=10):
    """(n_words, hit places, ids of items) of each text."""
    wins = {}
    for i, t in items:
        w = split(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for t in texts:
        w, hit, ids = split(t), set(), set()
        for k in {len(x) for x in wins}:
            for a in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[a : a + k]))) is not None:
                    hit |= {*range(a, a + k)}
                    ids |= found
        out.append((len(w), hit, sorted(str(i) for i in ids if i is not None)))
    return out


def some(n, letters="abc"):
    return " ".join(R.choice(letters) for _ in range(n))


def cases():
    items = [(i, some(R.randrange(1, 40), "abcd")) for i in range(12)] + [(20, "x"), (21, "one two THREE"), (21, "one two THREE"), (22, None), (23, ""), (24, "-- !"), (None, "no id at all"), (25, "a " * 30), (26, "Ünï cödé wörter, die es gibt")]
    texts = [some(R.randrange(0, 120), "abcde") for _ in range(60)] + [None, "", " ..", "x", "One-two; three four", "one two", "no id at all", "z a " + "a " * 500, "ünï cödé wörter die es gibt", "ÜNÏ CÖDÉ"]
    for _ in range(20):  # items inside, over punctuation
        texts.append(some(9, "efg") + " " + R.choice(items[:12])[1].replace(" ", R.choice([" ", ", ", "\n"])).upper() + ". " + some(5, "efg"))
    return texts, items


def check(rows, texts, items, window=10):
    want = brute(texts, items, window)
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, len(hit), ids), texts[r.doc_id]
        assert {p for s in r.spans for p in range(s.word, s.word + s.words)} == hit
        text = texts[r.doc_id] or ""
        for s in r.spans:
            assert split(text[s.start : s.start + s.length]) == split(text)[s.word : s.word + s.words]


def test_against_windows(spark):
    texts, items = cases()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, items int").repartition(4)
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words int")
    check(decontam.scan(docs, bench).collect(), texts, items)
    got = {r.doc_id: r for r in decontam.digest(decontam.scan(docs, bench)).collect()}
    for i, (n, hit, ids) in enumerate(brute(texts, items)):
        assert got[i].n_items == len(ids) and got[i].items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest() and got[i].contaminated == bool(hit)
    assert decontam.scan(docs.where("false"), bench).collect() == []
    assert all(r.n_hit == 0 and r["items"] == [] for r in decontam.scan(docs, bench.where("false")).collect())


def test_shards_and_pieces_lose_nothing(spark):
    texts, items = cases()
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(texts)], "doc_id long, text string")  # each row twice
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.scan(docs, bench, most=40, piece=13).collect()
    assert len(rows) == 2 * len(texts)
    want = brute(texts, items)
    for r in rows:
        n, hit, ids = want[r.doc_id]
        assert (r.n_words, r.n_hit, r["items"]) == (n, len(hit), ids)
        assert {p for s in r.spans for p in range(s.word, s.word + s.words)} == hit
        assert all(a.word + a.words < b.word for a, b in zip(r.spans, r.spans[1:]))
    assert decontam.automata(bench, most=40, piece=13).count() > 3


def test_longest_matches():
    items = [some(200, "ab"), some(50, "abc"), "a " * 40]
    h, first = decontam.words(pa.array(items))[3], decontam.words(pa.array(items))[2]
    m = decontam.Matcher(decontam.build(h, first, np.arange(3), 5), ["0", "1", "2"])
    text = some(400, "abc") + " " + "a " * 60
    _, _, f, hd = decontam.words(pa.array([text]))
    ids = m.words.find(hd)
    state, length = m.longest(ids, f)
    w, have = split(text), {tuple(split(t)[a:b]) for t in items for a in range(len(split(t))) for b in range(a + 1, len(split(t)) + 1)}
    for i in range(len(w)):
        best = next((k for k in range(min(i + 1, 200), 0, -1) if tuple(w[i - k + 1 : i + 1]) in have), 0)
        assert length[i] == best or (length[i] == 0 and best < 5)
    assert length.max() == 40


def test_many_streams_step_together(monkeypatch):
    texts, items = cases()
    _, _, first, h = decontam.words(pa.array([t or "" for _, t in items]))
    m = decontam.Matcher(decontam.build(h, first, np.arange(len(items)), 10), [str(i) for i in range(len(items))])
    _, _, f, hd = decontam.words(pa.array([t or "" for t in texts]))
    together = []
    for few in (0, 10**9):
        monkeypatch.setattr(decontam, "FEW", few)
        together.append([x.tolist() for x in m.hits(hd, f)])
    assert together[0] == together[1]


def test_remove(spark):
    item = " ".join(f"q{i}" for i in range(20))
    texts = ["alpha " * 30 + item + " omega" * 30, item + " and little else", "clean text of its own", None, "", "pre " * 20 + " ".join(f"q{i}" for i in range(11)) + " post" * 20]
    docs = spark.createDataFrame([(i, "en", t, 5) for i, t in enumerate(texts)], "doc_id long, lang string, text string, spans int")
    bench = spark.createDataFrame([(1, item), (2, "other words that stand nowhere")], "item_id long, text string")
    out = decontam.remove(docs, bench)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and sorted(got) == [0, 2, 3, 4, 5]  # 1 is covered too far
    assert got[0] == "alpha " * 30 + " omega" * 30 and got[2] == texts[2] and got[3] is None and got[5] == texts[5]
    two = {r.doc_id: r.text for r in decontam.remove(docs, bench.unionAll(spark.createDataFrame([(9, "w " * 3000)], bench.schema))).collect()}
    assert two == got
